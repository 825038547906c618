"""Execution, accounting and drawdown limits of signals on bars, set-based.

An intent of one bar is filled at the open of the next. Without period limits the position doesn't depend on equity, so positions, entries, equity,
drawdown and the global limit are running windows over the series. Daily and monthly limits feed equity back into the position and go through
one ordered pass per series (`run_with_pauses`).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.features import Frame
from tidemark.session import ship


@dataclass(frozen=True)
class RiskConfig:
    """Limits in percent; None is no limit."""

    max_drawdown_pct: float | None = None
    daily_drawdown_pct: float | None = None
    monthly_drawdown_pct: float | None = None

    @property
    def by_period(self) -> bool:
        return self.daily_drawdown_pct is not None or self.monthly_drawdown_pct is not None


def drawdown_pct(peak, current):
    """Loss from the peak in percent of it, at least 0; 0 for a peak that isn't above 0. For columns."""
    return F.when(peak <= 0, F.lit(0.0)).otherwise(F.greatest((peak - current) / peak * 100, F.lit(0.0)))


def execute(bars: DataFrame, frame: Frame, capital: float, size: float = 1.0, direction: str = "direction") -> DataFrame:
    """Add position, entry, fills and equity to bars with `open`, `close` and a direction.

    `position` is held during the bar, `entry_price`/`entry_time` are of the open position or the one closed at this bar's open, `fill_pnl` is of a
    trade closed here (else null), and `equity`, `unrealized_pnl`, `realized_pnl` are after the close. A position is opened, closed or turned where the sign of what is wanted
    changes; another size of the same sign changes nothing, the size of the opening bar is held. The direction on a series' last bar is never
    filled, and a position open at the end stays open. Columns of the added names are replaced; other extra columns stay. Null and NaN directions are flat; bars with
    null prices give null equity.
    """
    w, run = frame.ordered, frame.so_far
    flat = F.lit(0.0)
    wanted = F.lag(direction).over(w).cast("double")
    step = bars.withColumn("_target", F.coalesce(F.when(~F.isnan(wanted), wanted * float(size)), flat))
    turn = F.signum("_target") != F.coalesce(F.signum(F.lag("_target").over(w)), flat)
    step = step.withColumn("_turn", F.when(turn, F.col("_target")))
    step = step.withColumn("position", F.coalesce(F.last("_turn", ignorenulls=True).over(run), flat))
    step = step.withColumn("_prev", F.coalesce(F.lag("position").over(w), flat))
    opened = (F.col("position") != F.col("_prev")) & (F.col("position") != 0)
    step = step.withColumns({
        "_entry": F.last(F.when(opened, F.col("open")), ignorenulls=True).over(run), "_since": F.last(F.when(opened, F.col(frame.time)), ignorenulls=True).over(run),
    })
    step = step.withColumns({"_was": F.lag("_entry").over(w), "_was_since": F.lag("_since").over(w)})
    closing = (F.col("position") != F.col("_prev")) & (F.col("_prev") != 0)
    step = step.withColumn("fill_pnl", F.when(closing, (F.col("open") - F.col("_was")) * F.col("_prev")))
    step = step.withColumns({
        "realized_pnl": F.coalesce(F.sum("fill_pnl").over(run), flat),
        "unrealized_pnl": F.when(F.col("position") != 0, (F.col("close") - F.col("_entry")) * F.col("position")).otherwise(flat),
        "fill_qty": F.when(closing, F.abs("_prev")), "fill_side": F.when(closing, F.when(F.col("_prev") > 0, "long").otherwise("short")),
        "fill_entry_price": F.when(closing, F.col("_was")), "fill_entry_ts": F.when(closing, F.col("_was_since")),
    })
    return step.withColumn("equity", F.lit(float(capital)) + F.col("realized_pnl") + F.col("unrealized_pnl")).drop("_target", "_turn", "_prev", "_entry", "_since", "_was", "_was_since")


def with_drawdown(equity: DataFrame, frame: Frame, capital: float) -> DataFrame:
    """Add `peak_equity`, `drawdown_pct` and `max_drawdown_pct` so far; the capital counts as the first peak."""
    run = frame.so_far
    out = equity.withColumn("peak_equity", F.greatest(F.lit(float(capital)), F.max("equity").over(run)))
    out = out.withColumn("drawdown_pct", drawdown_pct(F.col("peak_equity"), F.col("equity")))
    return out.withColumn("max_drawdown_pct", F.max("drawdown_pct").over(run))


def drawdown_error(curve: DataFrame, frame: Frame, capital: float) -> DataFrame:
    """By series, how far the curve's greatest drawdown is from one taken anew from its equity alone: a check of whatever made the curve."""
    anew = with_drawdown(curve.select(*frame.keys, frame.time, "equity", F.col("max_drawdown_pct").alias("_told")), frame, capital)
    return anew.groupBy(*frame.keys).agg(F.abs(F.max("_told") - F.max("max_drawdown_pct")).alias("error"))


_ADDED = ("position", "fill_pnl", "realized_pnl", "unrealized_pnl", "fill_qty", "fill_side", "fill_entry_price", "fill_entry_ts", "equity")


def run_set_based(bars: DataFrame, frame: Frame, capital: float, size: float = 1.0, max_drawdown_pct: float | None = None) -> DataFrame:
    """Equity curve of bars with a direction, with the global limit if there is one.

    The first bar whose drawdown reaches the limit on the unlimited path is also the first on the limited one; from it on the series is flat (filled at
    the next open) for good. Adds `halted`, `flatten`, `risk_reason`, `daily_halts` and `monthly_halts` (0 here).
    """
    out = with_drawdown(execute(bars, frame, capital, size), frame, capital)
    if max_drawdown_pct is None:
        out = out.withColumns({"halted": F.lit(False), "risk_reason": F.lit("")})
    else:
        limit = float(max_drawdown_pct)
        out = out.withColumn("halted", F.max(F.col("drawdown_pct") >= limit).over(frame.so_far))
        out = out.withColumn("_first", F.col("halted") & ~F.coalesce(F.lag("halted").over(frame.ordered), F.lit(False)))
        text = F.format_string(f"Global DD %.2f%% >= limit {limit:.2f}%%", "drawdown_pct")
        out = out.withColumns({"risk_reason": F.when(F.col("_first"), text).otherwise(""), "_allowed": F.when(F.col("halted"), 0.0).otherwise(F.col("direction"))})
        kept = out.select(*bars.columns, "halted", "risk_reason", "_allowed")
        out = with_drawdown(execute(kept, frame, capital, size, "_allowed"), frame, capital).drop("_allowed")
    return out.withColumns({"flatten": F.col("halted"), "daily_halts": F.lit(0), "monthly_halts": F.lit(0)})


def fold_with_limits(rows: pd.DataFrame, time: str, capital: float, size: float, risk: RiskConfig) -> pd.DataFrame:
    """One series' bars in order, bar by bar, with all limits."""
    t = pd.to_datetime(rows[time])
    day, month = (t.dt.normalize().astype("int64").to_numpy(), (t.dt.year * 12 + t.dt.month).to_numpy())
    opens, closes = rows["open"].to_numpy(float).tolist(), rows["close"].to_numpy(float).tolist()
    want = rows["direction"].fillna(0).to_numpy(float).tolist()
    stamps = rows[time].tolist()
    realised, position, entry, since, target = float(capital), 0.0, 0.0, None, 0.0
    peak = last = float(capital)
    most, halted = 0.0, False
    now_day = now_month = None
    day_base = month_base = float(capital)
    day_paused = month_paused = False
    n_day = n_month = 0
    loss = lambda base, eq: max((base - eq) / base * 100, 0.0) if base > 0 else 0.0
    out = []
    for i, (o, c) in enumerate(zip(opens, closes)):
        fill = (None,) * 5
        if target != position and not (target * position > 0):
            if position:
                pnl = (o - entry) * position
                realised += pnl
                fill = (pnl, abs(position), "long" if position > 0 else "short", entry, since)
            position = target
            if position:
                entry, since = o, stamps[i]
        floating = (c - entry) * position if position else 0.0
        equity = realised + floating
        if day[i] != now_day:
            now_day, day_paused, day_base = day[i], False, last
        if month[i] != now_month:
            now_month, month_paused, month_base = month[i], False, last
        peak = max(peak, equity)
        dd = loss(peak, equity)
        most, reasons = max(most, dd), []
        if risk.max_drawdown_pct is not None and not halted and dd >= risk.max_drawdown_pct:
            halted = True
            reasons.append(f"Global DD {dd:.2f}% >= limit {risk.max_drawdown_pct:.2f}%")
        if risk.daily_drawdown_pct is not None and not day_paused and day_base > 0 and loss(day_base, equity) >= risk.daily_drawdown_pct:
            day_paused, n_day = True, n_day + 1
            reasons.append(f"Daily DD {loss(day_base, equity):.2f}% >= limit {risk.daily_drawdown_pct:.2f}%")
        if risk.monthly_drawdown_pct is not None and not month_paused and month_base > 0 and loss(month_base, equity) >= risk.monthly_drawdown_pct:
            month_paused, n_month = True, n_month + 1
            reasons.append(f"Monthly DD {loss(month_base, equity):.2f}% >= limit {risk.monthly_drawdown_pct:.2f}%")
        last, flatten = equity, halted or day_paused or month_paused
        out.append((position, fill[0], realised - capital, floating, *fill[1:], equity, peak, dd, most, halted, "; ".join(reasons), flatten, n_day, n_month))
        target = 0.0 if flatten else want[i] * size
    names = [*_ADDED, "peak_equity", "drawdown_pct", "max_drawdown_pct", "halted", "risk_reason", "flatten", "daily_halts", "monthly_halts"]
    made = pd.DataFrame(out, columns=names, index=rows.index)
    return pd.concat([rows, made], axis=1)


def run_with_pauses(bars: DataFrame, frame: Frame, capital: float, size: float, risk: RiskConfig) -> DataFrame:
    """Like `run_set_based`, with daily and monthly limits.

    A period's base is the equity at the close before it; reaching the limit flattens until the period ends (UTC days and months). Each series is one task's
    work: the recurrence runs over all of its bars.
    """
    ship(bars.sparkSession)
    bars = bars.drop(*_ADDED, "peak_equity", "drawdown_pct", "max_drawdown_pct", "halted", "risk_reason", "flatten", "daily_halts", "monthly_halts")
    kinds = {f.name: f.dataType.simpleString() for f in bars.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(frame.time, kind="stable")
        made = fold_with_limits(pdf, frame.time, capital, size, risk)
        made["fill_entry_ts"] = pd.to_datetime(made["fill_entry_ts"])
        for c in ("fill_pnl", "fill_qty", "fill_entry_price"):
            made[c] = made[c].astype(float)
        return made

    added = (
        "position double, fill_pnl double, realized_pnl double, unrealized_pnl double, fill_qty double, fill_side string, fill_entry_price double, "
        f"fill_entry_ts {kinds[frame.time]}, equity double, peak_equity double, drawdown_pct double, max_drawdown_pct double, halted boolean, "
        "risk_reason string, flatten boolean, daily_halts int, monthly_halts int"
    )
    schema = ", ".join(f"`{n}` {t}" for n, t in kinds.items()) + ", " + added
    out = bars.groupBy(*frame.keys).applyInPandas(run, schema)
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("fill_pnl", "fill_qty", "fill_entry_price")})


def run(bars: DataFrame, frame: Frame, capital: float, size: float = 1.0, risk: RiskConfig = RiskConfig()) -> DataFrame:
    """The equity curve by the cheapest way that the limits allow."""
    if risk.by_period:
        return run_with_pauses(bars, frame, capital, size, risk)
    return run_set_based(bars, frame, capital, size, risk.max_drawdown_pct)


def trades(curve: DataFrame, frame: Frame) -> DataFrame:
    """One row per closed trade, as of the bar that closed it."""
    return curve.where(F.col("fill_pnl").isNotNull()).select(
        *frame.keys, F.col("fill_entry_ts").alias("entry_ts"), F.col(frame.time).alias("exit_ts"), F.col("fill_side").alias("side"), F.col("fill_qty").alias("qty"),
        F.col("fill_entry_price").alias("entry_price"), F.col("open").alias("exit_price"), F.col("fill_pnl").alias("pnl"),
    )


def equity_records(curve: DataFrame, frame: Frame) -> DataFrame:
    return curve.select(*frame.keys, F.col(frame.time).alias("timestamp"), "equity", "position", "unrealized_pnl", "realized_pnl")


def metrics(curve: DataFrame, frame: Frame, capital: float, risk: RiskConfig = RiskConfig()) -> DataFrame:
    """Summary of each series, in one aggregation of the curve.

    Averages of wins and losses are 0 without any; a trade of zero counts as no win. `total_pnl` is of closed trades, `ending_equity` includes open ones.
    """
    p = F.col("fill_pnl")
    num = lambda v: F.lit(v).cast("double")
    return curve.groupBy(*frame.keys).agg(
        F.count(F.lit(1)).alias("n_bars"), F.min(frame.time).alias("start_ts"), F.max(frame.time).alias("end_ts"), num(capital).alias("starting_capital"),
        F.max_by("equity", frame.time).alias("ending_equity"), F.count(p).alias("n_trades"), F.coalesce(F.sum(p), F.lit(0.0)).alias("total_pnl"),
        F.coalesce(F.avg((p > 0).cast("double")), F.lit(0.0)).alias("win_rate"), F.coalesce(F.avg(F.when(p > 0, p)), F.lit(0.0)).alias("average_win"),
        F.coalesce(F.avg(F.when(p < 0, p)), F.lit(0.0)).alias("average_loss"), F.max("drawdown_pct").alias("max_drawdown_pct"),
        F.max("halted").alias("risk_halted"), F.min(F.when(F.col("halted"), F.col(frame.time))).alias("risk_halted_at"),
        num(risk.daily_drawdown_pct).alias("daily_drawdown_pct_limit"), num(risk.monthly_drawdown_pct).alias("monthly_drawdown_pct_limit"),
        F.max("daily_halts").alias("daily_halts"), F.max("monthly_halts").alias("monthly_halts"),
    )
