import datetime as dt
import json

import pytest
import yaml
from pyspark.sql import functions as F

from tidemark.__main__ import main
from tidemark.operators import expectancy
from tidemark.operators.expectancy import Scenario
from tidemark.plans import runs


@pytest.fixture
def project(tmp_path):
    data = tmp_path / "data" / "20240101_000000"
    data.mkdir(parents=True)
    lines = ["time,open,high,low,close,tick_volume,spread,real_volume"]
    prev = 100.0
    for i in range(100):
        c = 110.0 if 10 <= i <= 15 else 90.0 if 20 <= i <= 25 else 100.0
        lines.append(f"{dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)}+00:00,{prev},{max(prev, c) + 5},{min(prev, c) - 5},{c},100,1,0")
        prev = c
    (data / "X_M5_2024.csv").write_text("\n".join(lines) + "\n")
    config = {"symbol": "X", "timeframe": "H1", "snapshot_dir": "data/20240101_000000", "starting_capital": 1000.0, "output_dir": "runs", "strategy": {"type": "ma_crossover", "fast_period": 2, "slow_period": 5}}
    return tmp_path, config


def save(root, name, config):
    (root / name).write_text(yaml.safe_dump(config))
    return str(root / name)


def test_run_writes_all_and_repeats(spark, project):
    root, config = project
    a = runs.run_backtest(spark, save(root, "c.yaml", config), str(root))
    b = runs.run_backtest(spark, save(root, "c.yaml", config), str(root))
    assert a != b
    for name in ("equity.csv", "trades.csv", "config.yaml"):
        assert (a / name).read_text() == (b / name).read_text()
    m = json.loads((a / "metrics.json").read_text())
    assert len(m) == 22 and m["n_bars"] == 100 and m["start_ts"] == "2024-01-01T00:00:00+00:00" and m["run_id"] == a.name and m["timeframe"] == "H1"
    equity = (a / "equity.csv").read_text().splitlines()
    assert equity[0] == "timestamp,equity,position,unrealized_pnl,realized_pnl" and len(equity) == 101
    trades = (a / "trades.csv").read_text().splitlines()
    assert trades[0] == "entry_ts,exit_ts,side,qty,entry_price,exit_price,pnl" and len(trades) == m["n_trades"] + 1 > 1
    assert sum(float(t.split(",")[-1]) for t in trades[1:]) == pytest.approx(m["total_pnl"])
    ref = json.loads((a / "data_snapshot" / "DATA_REF.json").read_text())
    assert ref["row_count"] == 100 and ref["snapshot_path"] == config["snapshot_dir"]
    assert len((a / "plots" / "close_and_equity.csv").read_text().splitlines()) == 101 and "Reproduce" in (a / "README.md").read_text()


def test_no_trades_is_an_empty_file(spark, project):
    root, config = project
    out = runs.run_backtest(spark, save(root, "c.yaml", config | {"strategy": {"type": "ma_crossover", "fast_period": 50, "slow_period": 99}}), str(root))
    assert (out / "trades.csv").read_text() == ""


def test_batch_skips_failures(spark, project):
    root, config = project
    good, bad = save(root, "good.yaml", config), save(root, "bad.yaml", {k: v for k, v in config.items() if k != "strategy"})
    rows = runs.run_experiments(spark, [bad, good, "/nowhere.yaml"], str(root))
    assert [r["config"] for r in rows] == ["good.yaml"] and len((root / "experiment_summary.csv").read_text().splitlines()) == 2


def test_sweep_is_one_plan(spark, project):
    root, config = project
    bars = runs.snapshot.read_snapshot(spark, str(root / config["snapshot_dir"]), arrival=False)
    both = bars.withColumn("symbol", F.explode(F.array(F.lit("a"), F.lit("b"))))
    found = runs.sweep(both, {"plain": config, "limited": config | {"daily_drawdown_pct": 1.0}}).collect()
    assert {(r["config"], r["symbol"]) for r in found} == {(c, s) for c in ("plain", "limited") for s in "ab"}


def test_scenarios_give_the_known_figures(spark, tmp_path):
    config = {"seed": 42, "starting_capital": 10_000, "n_trades": 200, "n_sims": 5000, "scenarios": [
        {"name": "A", "p_win": 0.65, "avg_win": 10, "avg_loss": 25}, {"name": "B", "p_win": 0.45, "avg_win": 30, "avg_loss": 10}]}
    a, b = runs.run_expectancy(spark, save(tmp_path, "ev.yaml", config), str(tmp_path / "out.json"))
    assert a == {"name": "A", "expectancy_per_trade": -2.25, "variance_per_trade": 278.6875, "mean_ending_equity": 9551.29, "median_ending_equity": 9550.0, "std_ending_equity": 238.56,
                 "probability_of_loss": 0.9672, "mean_max_drawdown": 550.36}
    bins = (tmp_path / "out.histogram.csv").read_text().splitlines()
    assert bins[0] == "name,bin,from_value,n" and sum(int(x.split(",")[3]) for x in bins[1:]) == 10_000
    assert b == {"name": "B", "expectancy_per_trade": 8.0, "variance_per_trade": 396.0, "mean_ending_equity": 11601.76, "median_ending_equity": 11600.0, "std_ending_equity": 282.82,
                 "probability_of_loss": 0.0, "mean_max_drawdown": 86.2}


def test_hashed_draws_agree_with_theory_and_partitions(spark):
    table = expectancy.scenario_table(spark, [Scenario("A", 0.65, 10, 25), Scenario("C", 0.5, 12, 11, 2, 3, 0.25, 0.1)])
    found = {r["name"]: r for r in expectancy.simulate(table, 100, 2000, 1000.0).collect()}
    for name, per_trade, sd in (("A", -2.25, 278.6875 ** 0.5), ("C", 0.15, (132.25 + 6.5) ** 0.5)):
        assert found[name]["mean_ending_equity"] == pytest.approx(1000 + 100 * per_trade, abs=5 * sd * 10 / 2000 ** 0.5)
        assert found[name]["std_ending_equity"] == pytest.approx(sd * 10, rel=0.1)
    one = expectancy.paths(table, 5, 10, 0.0).orderBy("scenario", "sim", "trade").collect()
    assert one == expectancy.paths(table.repartition(7), 5, 10, 0.0).orderBy("scenario", "sim", "trade").collect()


def test_envelope_keeps_the_extremes(spark):
    rows = [("s", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), float(i % 977), float(-(i % 991))) for i in range(5000)]
    df = spark.createDataFrame(rows, "symbol string, time timestamp, close double, equity double")
    got = runs.envelope(df, runs.SERIES, 5000, 100).collect()
    assert len(got) == 100 and max(r["high_close"] for r in got) == 976 and min(r["low_equity"] for r in got) == -990
    assert runs.envelope(df.limit(3), runs.SERIES, 3, 100).count() == 3


def test_histogram(spark):
    df = spark.createDataFrame([("a", float(x)) for x in range(81)] + [("b", 5.0)] * 3, "g string, x double")
    got = {(r["g"], r["bin"]): r["n"] for r in expectancy.histogram(df, "x", ["g"]).collect()}
    assert got[("a", 80)] == 2 and got[("a", 1)] == 1 and sum(n for (g, _), n in got.items() if g == "a") == 81 and got[("b", 1)] == 3


def test_command_line(spark, project, monkeypatch, capsys):
    root, config = project
    monkeypatch.chdir(root)
    monkeypatch.setattr("tidemark.sources.feed.time.sleep", lambda s: None)
    assert main(["backtest", "--config", save(root, "c.yaml", config)]) == 0 and "runs" in capsys.readouterr().out
    assert main(["experiments", save(root, "c.yaml", config), "nix"]) == 0 and "1 of 2" in capsys.readouterr().out
    assert main(["loader", "--client", "tests.test_sources:Empty", "--symbol", "X", "--start", "2024-01-01", "--end", "2024-01-02", "--root", str(root / "d")]) == 0
    with pytest.raises(SystemExit):
        main([])
