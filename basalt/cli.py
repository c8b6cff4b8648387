"""python -m basalt.cli COMMAND: fetch, build, validate, summarize, explore, load."""

from __future__ import annotations

import argparse
import os
import sys

from .operators.checks import PASS
from .plans import explore, gate, summary, warehouse
from .session import session
from .sources import raw, store

RAW, PARQUET, REPORTS, TABLES = "data/raw/blocks", "data/parquet", "data/reports", "data/tables"


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="basalt")
    p.add_argument("--raw", default=RAW)
    p.add_argument("--parquet", default=PARQUET)
    p.add_argument("--reports", default=REPORTS)
    p.add_argument("--tables", default=TABLES)
    p.add_argument("--master", default=os.environ.get("BASALT_MASTER"))
    sub = p.add_subparsers(dest="command", required=True)
    f = sub.add_parser("fetch")
    f.add_argument("--height", type=int)
    for n in ("start-height", "end-height", "count", "behind-tip"):
        f.add_argument(f"--{n}", type=int)
    f.add_argument("--api-base-url", default=os.environ.get(raw.ADDRESS_VARIABLE))
    f.add_argument("--force", action="store_true")
    b = sub.add_parser("build")
    for n in ("height", "start-height", "end-height"):
        b.add_argument(f"--{n}", type=int)
    b.add_argument("--force", action="store_true")
    for n in ("validate", "summarize", "load"):
        s = sub.add_parser(n)
        s.add_argument("--start-height", type=int, required=True)
        s.add_argument("--end-height", type=int, required=True)
    sub.add_parser("explore")
    return p


def _fetch(a: argparse.Namespace, client=None) -> int:
    if not a.api_base_url and client is None:
        print(f"give --api-base-url or set {raw.ADDRESS_VARIABLE}", file=sys.stderr)
        return 2
    client = client or raw.RestClient(a.api_base_url)
    try:
        if a.height is not None:
            start = end = a.height
        else:
            tip = client.tip_height() if a.start_height is None else None
            start, end = raw.resolve_range(a.start_height, a.end_height, a.count, a.behind_tip, tip)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    r = raw.ingest_range(client, start, end, a.raw, a.force)
    print(f"fetched {len(r.fetched)}, skipped {len(r.skipped)}, failed {r.failed}")
    return 0 if r.complete and all(raw.is_complete(raw.block_dir(a.raw, h)) for h in range(start, end + 1)) else 1


def _build(a: argparse.Namespace) -> int:
    if (a.start_height is None) != (a.end_height is None) or (a.height is not None and a.start_height is not None):
        print("give --height, or --start-height and --end-height, or neither", file=sys.stderr)
        return 2
    wanted = [a.height] if a.height is not None else None if a.start_height is None else list(range(a.start_height, a.end_height + 1))
    r = store.build(session(master=a.master), a.raw, a.parquet, wanted, a.force)
    print(", ".join(f"{k} {v}" for k, v in r.items()))
    return 1 if r["failed"] or (wanted is not None and r["missing_raw"]) else 0


def main(argv: list[str] | None = None, client=None) -> int:
    a = _parser().parse_args(argv)
    if a.command == "fetch":
        return _fetch(a, client)
    if a.command == "build":
        return _build(a)
    if a.command == "explore":
        spark = session(master=a.master)
        explore.show(explore.Raw(raw.read_blocks(spark, a.raw), raw.read_transactions(spark, a.raw)))
        return 0
    if a.end_height < a.start_height:
        print("the end is below the start", file=sys.stderr)
        return 2
    spark = session(master=a.master)
    if a.command == "load":
        try:
            gate.load_report(a.reports, a.start_height, a.end_height)
        except RuntimeError as e:
            print(e, file=sys.stderr)
            return 2
        r = warehouse.load_range(warehouse.Raw(spark, a.tables), lambda n: store.read_dataset(spark, a.parquet, n), lambda n: store.heights(spark, a.parquet, n), a.reports, a.start_height, a.end_height)
        print(f"loaded {len(r.loaded)}, missing {r.missing}, failed {r.failed}")
        return 0 if not r.missing and not r.failed else 1
    w = store.read_ledger(spark, a.parquet).window(a.start_height, a.end_height)
    if a.command == "summarize":
        summary.show(w)
        return 0
    report = gate.validate(w)
    gate.print_report(report)
    gate.write_report(report, gate.report_path(a.reports, a.start_height, a.end_height))
    return 0 if report["overall_status"] == PASS else 1


if __name__ == "__main__":
    sys.exit(main())
