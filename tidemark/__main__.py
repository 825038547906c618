"""Command line: make snapshots, run backtests, batches and simulations."""

from __future__ import annotations

import argparse

from tidemark.plans import runs
from tidemark.session import session
from tidemark.sources import feed


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="tidemark")
    sub = ap.add_subparsers(dest="command", required=True)
    load = sub.add_parser("loader", help="fetch a symbol's bars into a snapshot")
    load.add_argument("--client", required=True, help="module:factory of the market-data client")
    load.add_argument("--symbol", default="XAUUSD")
    load.add_argument("--start", default="2005-01-01")
    load.add_argument("--end", default="", help="last day; yesterday (UTC) if left out")
    load.add_argument("--root", default="data")
    for option in feed.CLIENT_OPTIONS:
        load.add_argument(f"--{option}", type=int if option == "login" else str, help=f"{option} for the client, if it takes one")
    test = sub.add_parser("backtest", help="run one configuration")
    test.add_argument("--config", required=True)
    many = sub.add_parser("experiments", help="run configurations one after the other")
    many.add_argument("configs", nargs="+")
    ev = sub.add_parser("expectancy", help="simulate trade expectancy")
    ev.add_argument("--config", required=True)
    ev.add_argument("--out", default="ev_results.json")
    a = ap.parse_args(argv)
    spark = session()
    if a.command == "loader":
        print(feed.make_snapshot(spark, a.root, client=a.client, symbol=a.symbol, start=a.start, end=a.end, **{k: getattr(a, k) for k in feed.CLIENT_OPTIONS}) or "no bars")
    elif a.command == "backtest":
        print(runs.run_backtest(spark, a.config))
    elif a.command == "experiments":
        print(f"{len(runs.run_experiments(spark, a.configs))} of {len(a.configs)} runs succeeded")
    else:
        print(runs.run_expectancy(spark, a.config, a.out))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
