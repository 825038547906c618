"""Whole backtest runs: configuration, artifacts, batches of runs, and simulations of expectancy."""

from __future__ import annotations

import csv
import json
import logging
import shutil
import subprocess
from datetime import UTC, datetime
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import backtest, expectancy, features, strategy, validate
from tidemark.operators.features import Frame
from tidemark.sources import snapshot

log = logging.getLogger(__name__)
SERIES = Frame(("symbol",))
PIXELS = 1400  # columns of a picture; of the bars of a column the lowest and highest are drawn


def load_config(path: str) -> dict:
    config = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if not isinstance(config, dict) or "strategy" not in config:
        raise ValueError(f"{path} has no 'strategy' section")
    return config


def git_state(directory: str = ".") -> dict:
    """Commit and whether there are changes; "unknown" and False where git can't tell."""
    def git(*args: str) -> str | None:
        try:
            done = subprocess.run(["git", *args], cwd=directory, capture_output=True, text=True, timeout=10)
        except (OSError, subprocess.SubprocessError):
            return None
        return done.stdout.strip() if done.returncode == 0 else None

    commit, status = git("rev-parse", "HEAD"), git("status", "--porcelain")
    return {"git_commit": commit or "unknown", "git_dirty": bool(status)}


def iso(col):
    """ISO-8601 text in UTC, with microseconds only where there are any."""
    utc = F.to_utc_timestamp(col, F.current_timezone())
    whole = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss")
    part = F.date_format(utc, "SSSSSS")
    return F.concat(F.when(part == "000000", whole).otherwise(F.concat(whole, F.lit("."), part)), F.lit("+00:00"))


def curve_of(bars: DataFrame, config: dict, frame: Frame = SERIES) -> tuple[DataFrame, backtest.RiskConfig, object]:
    """The equity curve of a configuration over bars of any number of series: one lazy plan."""
    made, specs = strategy.build_strategy(config["strategy"])
    risk = backtest.RiskConfig(config.get("max_drawdown_pct"), config.get("daily_drawdown_pct"), config.get("monthly_drawdown_pct"))
    rows = features.FeaturePipeline(specs, frame.keys, frame.time).transform(bars)
    signals = strategy.with_signal(rows, made, frame)
    return backtest.run(signals, frame, float(config["starting_capital"]), float(config.get("position_size", 1.0)), risk), risk, made


def envelope(curve: DataFrame, frame: Frame, n_bars: int, columns: int = PIXELS) -> DataFrame:
    """Time, and lowest and highest close and equity, of each of at most `columns` stretches of one series' curve: what a picture of that width shows of it."""
    part = F.floor((F.row_number().over(frame.ordered) - 1) * F.lit(columns) / F.lit(max(n_bars, columns)))
    cols = [f(c).alias(f"{name}_{c}") for c in ("close", "equity") for name, f in (("low", F.min), ("high", F.max))]
    return curve.select(frame.time, "close", "equity", part.alias("_part")).groupBy("_part").agg(F.min(frame.time).alias("time"), *cols)


def _pictures(draw) -> bool:
    """Run `draw` with the plotting library, if it is there."""
    try:
        import matplotlib

        matplotlib.use("Agg")
        from matplotlib import pyplot
    except ImportError:
        log.info("no plotting library: no pictures")
        return False
    draw(pyplot)
    return True


def _draw_curve(rows, folder: Path) -> bool:
    def draw(pyplot):
        for column, name in (("close", "close_price"), ("equity", "equity")):
            fig, ax = pyplot.subplots(figsize=(14, 5))
            ax.fill_between([r["time"] for r in rows], [r[f"low_{column}"] for r in rows], [r[f"high_{column}"] for r in rows], step="mid", linewidth=0.8)
            ax.set(title=name.replace("_", " "), xlabel="time", ylabel=column)
            fig.savefig(folder / f"{name}.png", dpi=100)
            pyplot.close(fig)

    return _pictures(draw)


def run_backtest(spark: SparkSession, config_path: str, root: str = ".") -> Path:
    """Run one configuration on its snapshot and write equity.csv, trades.csv (empty without trades), metrics.json, the plotted table and, with a plotting library, PNGs, DATA_REF.json,
    the configuration and a README into a new directory, which is returned."""
    config = load_config(config_path)
    symbol, directory = config["symbol"], Path(root) / config["snapshot_dir"]
    bars = snapshot.read_snapshot(spark, str(directory)).withColumn("symbol", F.lit(symbol))
    validate.validate_bars(bars)
    clean = bars.drop(validate.ARRIVAL)
    run_id = datetime.now(UTC).strftime("%Y%m%d_%H%M%S")
    out = Path(root) / config.get("output_dir", "runs") / run_id
    n = 1
    while out.exists():  # two runs within a second
        n += 1
        out = out.with_name(f"{run_id}_{n}")
    for folder in (out, out / "plots", out / "data_snapshot"):
        folder.mkdir(parents=True)
    curve, risk, made = curve_of(clean, config)
    curve = curve.persist()
    try:
        capital = float(config["starting_capital"])
        found = backtest.metrics(curve, SERIES, capital, risk)
        found = found.withColumns({c: iso(F.col(c)) for c in ("start_ts", "end_ts", "risk_halted_at")})
        figures = {"run_id": out.name, "symbol": symbol, "timeframe": config.get("timeframe", "M5"), **{k: v for k, v in found.first().asDict().items() if k != "symbol"}, **git_state(root)}
        records = backtest.equity_records(curve, SERIES).drop("symbol").withColumn("timestamp", iso(F.col("timestamp")))
        off = backtest.drawdown_error(curve, SERIES, capital).first()["error"]
        if off is not None and off >= 1e-10:
            raise AssertionError(f"The greatest drawdown differs from that of the equity by {off}")
        snapshot.write_csv(records, out / "equity.csv", "timestamp")
        if figures["n_trades"]:
            closed = backtest.trades(curve, SERIES).drop("symbol").withColumns({c: iso(F.col(c)) for c in ("entry_ts", "exit_ts")})
            snapshot.write_csv(closed, out / "trades.csv", "entry_ts")
        else:
            (out / "trades.csv").touch()
        snapshot.write_csv(curve.select(iso(F.col("time")).alias("time"), "close", "equity"), out / "plots" / "close_and_equity.csv", "time")
        _draw_curve(envelope(curve, SERIES, figures["n_bars"]).orderBy("time").collect(), out / "plots")
    finally:
        curve.unpersist()
    snapshot.write_atomically(out / "metrics.json", json.dumps(figures, indent=2))
    ref = snapshot.data_reference(str(directory), figures["n_bars"], config["snapshot_dir"])
    snapshot.write_atomically(out / "data_snapshot" / "DATA_REF.json", json.dumps(ref, indent=2))
    shutil.copy2(config_path, out / "config.yaml")
    name = config["strategy"]["type"]
    snapshot.write_atomically(out / "README.md", "\n".join([
        f"{name} backtest", f"Symbol: {symbol} {figures['timeframe']}", f"Run ID: {out.name}", f"Trades: {figures['n_trades']}, total PnL: {figures['total_pnl']:.2f}",
        f"Reproduce: python -m tidemark backtest --config {config_path}", "",
    ]))
    return out


def run_experiments(spark: SparkSession, configs: list[str], root: str = ".", summary: str = "experiment_summary.csv") -> list[dict]:
    """Run configurations one after the other; those that fail are logged and left out. Their metrics go to one CSV."""
    rows = []
    for path in configs:
        try:
            out = run_backtest(spark, path, root)
            rows.append({"config": Path(path).name, **json.loads((out / "metrics.json").read_text())})
        except Exception as e:  # one bad configuration must not stop the others
            log.error("%s failed: %s", path, e)
    if rows:
        target = Path(root) / summary
        with target.open("w", newline="", encoding="utf-8") as f:
            out = csv.DictWriter(f, list(rows[0]))
            out.writeheader()
            out.writerows(rows)
    return rows


def sweep(bars: DataFrame, configs: dict[str, dict], frame: Frame = SERIES) -> DataFrame:
    """Metrics of many configurations on the same bars as one plan: a row per configuration and series."""
    out = None
    for name, config in configs.items():
        curve, risk, _ = curve_of(bars, config, frame)
        part = backtest.metrics(curve, frame, float(config["starting_capital"]), risk).withColumn("config", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def run_expectancy(spark: SparkSession, config_path: str, out: str, exact: bool = True) -> list[dict]:
    """Simulate the scenarios of a configuration and write their figures (rates to 4, money to 2 places) as JSON."""
    config = yaml.safe_load(Path(config_path).read_text(encoding="utf-8"))
    scenarios = [expectancy.Scenario(**s) for s in config["scenarios"]]
    args = (config["n_trades"], config["n_sims"], float(config["starting_capital"]), config.get("seed", 42))
    found = expectancy.simulate_numpy(spark, scenarios, *args) if exact else expectancy.simulate(expectancy.scenario_table(spark, scenarios), *args)
    rates = {"expectancy_per_trade", "variance_per_trade", "probability_of_loss"}
    rows = [
        {k: v if isinstance(v, str) else round(v, 4 if k in rates else 2) for k, v in r.asDict().items() if k != "scenario"} for r in found.orderBy("scenario").collect()
    ]
    snapshot.write_atomically(Path(out), json.dumps(rows, indent=2))
    ends = expectancy.endings_numpy(spark, scenarios, *args) if exact else expectancy.endings(expectancy.scenario_table(spark, scenarios), *args)
    bins = expectancy.histogram(ends, "ending_equity", ["name"]).orderBy("name", "bin").toPandas()  # at most 80 rows a scenario
    snapshot.write_atomically(Path(out).with_suffix(".histogram.csv"), bins.to_csv(index=False))

    def draw(pyplot):
        fig, axes = pyplot.subplots(1, len(rows), figsize=(7 * len(rows), 5), squeeze=False)
        for ax, r in zip(axes[0], rows):
            mine = bins[bins["name"] == r["name"]]
            ax.step(mine["from_value"], mine["n"], where="post")
            for value, style in ((r["mean_ending_equity"], "--"), (r["median_ending_equity"], "-."), (args[2], ":")):
                ax.axvline(value, linestyle=style, linewidth=1)
            ax.set(title=r["name"], xlabel="ending equity", ylabel="simulations")
        fig.savefig(Path(out).with_suffix(".png"), dpi=150)
        pyplot.close(fig)

    _pictures(draw)
    return rows
