"""Monte-Carlo expectancy of trades: analytic figures and simulated equity paths."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import ship


@dataclass(frozen=True)
class Scenario:
    name: str
    p_win: float
    avg_win: float
    avg_loss: float
    win_std: float = 0.0
    loss_std: float = 0.0
    commission_per_trade: float = 0.0
    slippage: float = 0.0


_FIELDS = "scenario int, name string, p_win double, avg_win double, avg_loss double, win_std double, loss_std double, cost double"


def scenario_table(spark: SparkSession, scenarios: list[Scenario]) -> DataFrame:
    rows = [(i, s.name, s.p_win, s.avg_win, s.avg_loss, s.win_std, s.loss_std, s.commission_per_trade + s.slippage) for i, s in enumerate(scenarios)]
    return spark.createDataFrame([(r[0], r[1], *map(float, r[2:])) for r in rows], _FIELDS)


def analytic(scenarios: DataFrame) -> DataFrame:
    """Expectancy per trade after costs, and variance of the two payoffs (costs don't shift it, spreads of payoffs aren't in it)."""
    p, w, lo = F.col("p_win"), F.col("avg_win"), F.col("avg_loss")
    mean = p * w - (1 - p) * lo
    return scenarios.select(
        "scenario", "name", (mean - F.col("cost")).alias("expectancy_per_trade"), (p * F.pow(w - mean, F.lit(2.0)) + (1 - p) * F.pow(-lo - mean, F.lit(2.0))).alias("variance_per_trade")
    )


def _uniform(*parts: Column) -> Column:
    """Uniform in [0, 1) from a hash of its arguments, so it doesn't depend on partitions."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def _normal(*parts: Column) -> Column:
    u, v = _uniform(*parts, F.lit("u")), _uniform(*parts, F.lit("v"))
    return F.sqrt(-2 * F.ln(1 - u)) * F.cos(F.lit(2 * math.pi) * v)


def paths(scenarios: DataFrame, n_trades: int, n_sims: int, capital: float, seed: int = 42) -> DataFrame:
    """Equity after every trade of every simulation: scenario, sim, trade (from 1), payoff, equity.

    Scenarios are exploded into simulations, spread, and only then into trades; draws are functions of seed, scenario, simulation and trade.
    """
    sims = scenarios.withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(n_sims - 1)))).repartition("scenario", "sim")
    rows = sims.withColumn("trade", F.explode(F.sequence(F.lit(1), F.lit(n_trades))))
    at = [F.lit(seed) + F.col("scenario"), F.col("sim"), F.col("trade")]
    win = _uniform(*at) < F.col("p_win")
    up = F.when(F.col("win_std") > 0, F.col("avg_win") + F.col("win_std") * _normal(*at, F.lit("w"))).otherwise(F.col("avg_win"))
    down = F.when(F.col("loss_std") > 0, F.col("avg_loss") + F.col("loss_std") * _normal(*at, F.lit("l"))).otherwise(F.col("avg_loss"))
    payoff = F.when(win, up).otherwise(-down) - F.col("cost")
    w = Window.partitionBy("scenario", "sim").orderBy("trade").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("scenario", "sim", "trade", payoff.alias("payoff")).withColumn("equity", F.lit(float(capital)) + F.sum("payoff").over(w))


def simulate(scenarios: DataFrame, n_trades: int, n_sims: int, capital: float, seed: int = 42) -> DataFrame:
    """Per scenario: analytic figures and mean, median, population deviation of ending equity, chance of a loss, mean greatest drawdown in money."""
    run = paths(scenarios, n_trades, n_sims, capital, seed)
    w = Window.partitionBy("scenario", "sim").orderBy("trade").rowsBetween(Window.unboundedPreceding, 0)
    peak = F.greatest(F.lit(float(capital)), F.max("equity").over(w))
    per_sim = run.withColumn("_dd", peak - F.col("equity")).groupBy("scenario", "sim").agg(F.max_by("equity", "trade").alias("_end"), F.max("_dd").alias("_dd"))
    done = per_sim.groupBy("scenario").agg(
        F.avg("_end").alias("mean_ending_equity"), F.median("_end").alias("median_ending_equity"), F.stddev_pop("_end").alias("std_ending_equity"),
        F.avg((F.col("_end") < capital).cast("double")).alias("probability_of_loss"), F.avg("_dd").alias("mean_max_drawdown"),
    )
    return analytic(scenarios).join(done, "scenario")


def endings(scenarios: DataFrame, n_trades: int, n_sims: int, capital: float, seed: int = 42) -> DataFrame:
    """The ending equity of every simulation of `simulate`: name, sim, ending_equity."""
    last = paths(scenarios, n_trades, n_sims, capital, seed).where(F.col("trade") == n_trades).select("scenario", "sim", F.col("equity").alias("ending_equity"))
    return last.join(scenarios.select("scenario", "name"), "scenario").select("name", "sim", "ending_equity")


def _numpy_paths(s, n_trades: int, n_sims: int, capital: float, seed: int) -> np.ndarray:
    """Equity after every trade of every simulation of a scenario, by numpy's generator in a fixed order of draws."""
    rng = np.random.default_rng(seed + int(s.scenario))
    win = rng.random((n_sims, n_trades)) < s.p_win
    up = rng.normal(s.avg_win, s.win_std, win.shape) if s.win_std > 0 else s.avg_win
    down = rng.normal(s.avg_loss, s.loss_std, win.shape) if s.loss_std > 0 else s.avg_loss
    return capital + np.cumsum(np.where(win, up, -np.asarray(down)) - s.cost, axis=1)


def _by_numpy(spark: SparkSession, scenarios: list[Scenario], schema: str, rows_of, *args) -> DataFrame:
    ship(spark)
    table = scenario_table(spark, scenarios).repartition(max(1, len(scenarios)), "scenario")

    def run(batches):
        for b in batches:
            for s in b.itertuples():
                yield rows_of(s, _numpy_paths(s, *args))

    return table.mapInPandas(run, schema)


def simulate_numpy(spark: SparkSession, scenarios: list[Scenario], n_trades: int, n_sims: int, capital: float, seed: int = 42) -> DataFrame:
    """The same figures with numpy's generator, one task per scenario and seed `seed` plus the scenario's number: for results that must equal a run outside Spark."""
    names = ["scenario", "mean_ending_equity", "median_ending_equity", "std_ending_equity", "probability_of_loss", "mean_max_drawdown"]

    def figures(s, path):
        end, peak = path[:, -1], np.maximum(np.maximum.accumulate(path, axis=1), capital)
        return pd.DataFrame([(s.scenario, end.mean(), np.median(end), end.std(), (end < capital).mean(), (peak - path).max(axis=1).mean())], columns=names)

    done = _by_numpy(spark, scenarios, "scenario int, " + ", ".join(f"{n} double" for n in names[1:]), figures, n_trades, n_sims, capital, seed)
    return analytic(scenario_table(spark, scenarios)).join(done, "scenario")


def endings_numpy(spark: SparkSession, scenarios: list[Scenario], n_trades: int, n_sims: int, capital: float, seed: int = 42) -> DataFrame:
    """The ending equity of every simulation of `simulate_numpy`: name, sim, ending_equity."""
    rows = lambda s, path: pd.DataFrame({"name": s.name, "sim": np.arange(len(path)), "ending_equity": path[:, -1]})
    return _by_numpy(spark, scenarios, "name string, sim int, ending_equity double", rows, n_trades, n_sims, capital, seed)


def histogram(values: DataFrame, column: str, by: list[str], bins: int = 80) -> DataFrame:
    """Counts in equal bins between each group's smallest and greatest value; the last bin is closed."""
    span = values.groupBy(*by).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    place = F.floor((F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins).cast("int") + 1
    where = F.when(F.col("_hi") > F.col("_lo"), F.least(place, F.lit(bins))).otherwise(F.lit(1))
    return values.join(span, by).groupBy(*by, where.alias("bin"), "_lo", "_hi").agg(F.count(F.lit(1)).alias("n")).select(
        *by, "bin", (F.col("_lo") + (F.col("bin") - 1) * (F.col("_hi") - F.col("_lo")) / bins).alias("from_value"), "n"
    )
