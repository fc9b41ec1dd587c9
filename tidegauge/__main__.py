"""Command lines: detect, repair, rollback, crosscheck, backtest, smoke and export over a store.

    python -m tidegauge detect --store /data/store --through 2024-01-31 --report /data/reports/1
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from tidegauge.errors import DataError, RequestError, ResultTooLargeError, UnavailableError
from tidegauge.operators import backtest as bt
from tidegauge.operators import crosscheck, detect, repair, runner
from tidegauge.operators.rules import DATASETS
from tidegauge.reader import ALL_SYMBOLS, Catalog, MarketReader
from tidegauge.sources.ingest import Progress
from tidegauge.sources.store import Store


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tidegauge", description=__doc__.split("\n")[0])
    each = out.add_subparsers(dest="command", required=True)

    def add(name: str, help_: str) -> argparse.ArgumentParser:
        p = each.add_parser(name, help=help_)
        p.add_argument("--store", required=True, help="root of the store")
        return p

    p = add("detect", "check tables; exit 1 if a rule has errors")
    p.add_argument("--through", required=True)
    p.add_argument("--start")
    p.add_argument("--tables", nargs="*")
    p.add_argument("--report", required=True, help="folder that the report is written to")
    p = add("repair", "what a report asks for; with --apply, patch what can be patched")
    p.add_argument("--report", required=True)
    p.add_argument("--apply", action="store_true")
    p = add("rollback", "undo a repair")
    p.add_argument("--repair-id", required=True)
    p = add("crosscheck", "compare two sources; exit 1 if they differ")
    for name in ("--start", "--end"):
        p.add_argument(name, required=True)
    p.add_argument("--sample", type=int, default=20)
    p.add_argument("--seed", type=int, default=0)
    p = add("backtest", "monthly momentum; prints its metrics")
    for name in ("--start", "--end", "--output"):
        p.add_argument(name, required=True)
    p.add_argument("--symbols", nargs="*")
    p.add_argument("--cash", type=float, default=1_000_000.0)
    p.add_argument("--slippage-bps", type=float, default=0.0)
    p.add_argument("--participation", type=float)
    p.add_argument("--lookback", type=int, default=20)
    p.add_argument("--top", type=int, default=10)
    p.add_argument("--minimum-sessions", type=int, default=60)
    p.add_argument("--keep-st", action="store_true")
    p.add_argument("--delisting", choices=("error", "write_off"), default="error")
    p = add("smoke", "every public query once, to CSV; exit 1 if one fails")
    p.add_argument("--as-of", required=True)
    p.add_argument("--output", required=True)
    p = add("export", "a table as CSV")
    p.add_argument("--table", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--limit", type=int)
    return out


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.getOrCreate()
    store = Store.open(spark, a.store)
    if not store.tables:
        raise RequestError(f"no store in {a.store}")
    frames = {n: store.read(n) for n in store.tables}
    return {"detect": _detect, "repair": _repair, "rollback": _rollback, "crosscheck": _crosscheck, "backtest": _backtest, "smoke": _smoke, "export": _export}[a.command](spark, a, store, frames)


def _reader(store: Store, frames) -> MarketReader:
    return MarketReader(Catalog(frames, covered=Progress(store).covered()), {"current": "daily"} if "ticks" not in frames else {})


def _detect(spark, a, store, frames) -> int:
    report = detect.detect({n: df for n, df in frames.items() if n in DATASETS}, a.through, a.start, a.tables, store, Catalog(frames).snapshot_id)
    report.write(a.report)
    for d, rule, status, n in report.checks:
        if status != "PASS":
            print(f"{status} {d} {rule} {n}")
    print("passed" if report.passed else "failed")
    return 0 if report.passed else 1


def _repair(spark, a, store, frames) -> int:
    issues = detect.read_report(spark, a.report).issues
    for r in repair.refetch_ranges(issues).orderBy("dataset", "start_date").collect():
        print(f"fetch {r['dataset']} {r['start_date']} {r['end_date']}")
    done = repair.apply_fixes(store, issues) if a.apply else []
    for d, found in done:
        print(f"patched {d}: {found}")
    left = repair.actions(issues).where("action = 'MANUAL'").groupBy("dataset", "rule").count().orderBy("dataset", "rule").collect()
    for r in left:
        print(f"by hand {r['dataset']} {r['rule']} {r['count']}")
    return 0 if not left else 1


def _rollback(spark, a, store, frames) -> int:
    repair.rollback(store, a.repair_id)
    print("rolled back")
    return 0


def _crosscheck(spark, a, store, frames) -> int:
    found = crosscheck.crosscheck(frames, a.start, a.end, a.sample, a.seed)
    print(json.dumps({"codes": found.codes, "checks": found.counts, "passed": found.passed}, ensure_ascii=False, indent=2))
    return 0 if found.passed else 1


def _backtest(spark, a, store, frames) -> int:
    reader, rule = _reader(store, frames), runner.Momentum(a.lookback, a.top, a.minimum_sessions, not a.keep_st)
    config = bt.Config(cash=a.cash, slippage_bps=a.slippage_bps, participation=a.participation, delisting=a.delisting)
    metadata = runner.run_metadata(reader, rule)
    from tidegauge.scratch import cut

    rows = cut(runner.run_momentum(reader, a.start, a.end, rule, config, a.symbols), "run")
    bt.require_bars(rows)
    print(json.dumps(runner.write_results(rows, a.output, config, metadata), default=str, ensure_ascii=False, indent=2))
    return 0


def _smoke(spark, a, store, frames) -> int:
    view, day = _reader(store, frames).at(a.as_of), a.as_of[:10]
    calls = {
        "bars": lambda: view.market.bars(ALL_SYMBOLS, "1d", count=5), "bars_forward": lambda: view.market.bars(ALL_SYMBOLS, "1d", count=5, adjustment="forward"), "bars_1m": lambda: view.market.bars(ALL_SYMBOLS, "1m", count=5),
        "current": lambda: view.market.current(ALL_SYMBOLS), "daily_metrics": lambda: view.market.daily_metrics(ALL_SYMBOLS, "2000-01-01", day), "moneyflow": lambda: view.market.moneyflow(ALL_SYMBOLS, "2000-01-01", day),
        "status": lambda: view.market.status([r[0] for r in view.reference.stocks(fields=[]).df.limit(20).collect()]),
        **{k: (lambda k=k: view.fundamentals.statements(k, ALL_SYMBOLS, periods=1)) for k in ("income", "balance_sheet", "cash_flow")},
        "indicators": lambda: view.fundamentals.indicators(ALL_SYMBOLS, periods=1), **{k: (lambda k=k: view.fundamentals.disclosures(k, ALL_SYMBOLS)) for k in ("forecast", "express", "audit")},
        "dividends": lambda: view.corporate_actions.dividends(ALL_SYMBOLS), "adjustment_factors": lambda: view.corporate_actions.adjustment_factors(ALL_SYMBOLS), "industry": lambda: view.classification.industry(ALL_SYMBOLS),
        "stocks": lambda: view.reference.stocks(), "sessions": lambda: view.calendar.sessions("2000-01-01"),
    }
    out = {}
    for name, call in calls.items():
        try:
            found = call()
            runner.export_csv(found.sorted, f"{a.output}/{name}")
            out[name] = {"rows": found.df.count(), "sources": list(found.sources)}
        except (UnavailableError, RequestError, DataError, ResultTooLargeError) as e:  # one that fails does not stop the others
            out[name] = {"error": f"{type(e).__name__}: {e}"}
    spark.createDataFrame([(json.dumps(out, ensure_ascii=False, indent=2),)], "value string").coalesce(1).write.text(f"{a.output}/manifest.json")
    print(json.dumps(out, ensure_ascii=False, indent=2))
    return 1 if any("error" in x for x in out.values()) else 0


def _export(spark, a, store, frames) -> int:
    runner.export_csv(store.read(a.table), a.output, a.limit)
    return 0


if __name__ == "__main__":
    sys.exit(main())
