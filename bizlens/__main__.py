"""Run catalogued reports and write each one as parquet.

    python -m bizlens --input /data/tables --output /shared/reports [--queries a,b] [--list]

Each report is written to ``<output>/<name>`` (overwritten), through the
normal DataFrame writer; nothing is collected.
"""

from __future__ import annotations

import argparse
import sys


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="bizlens")
    ap.add_argument("--input", help="folder with the <table>.parquet inputs")
    ap.add_argument("--output", help="folder that receives one parquet folder per report")
    ap.add_argument("--queries", default="", help="comma-separated report names (default: all)")
    ap.add_argument("--list", action="store_true", help="list the report names and exit")
    args = ap.parse_args(argv)

    from bizlens.plans.catalog import QUERIES
    if args.list:
        print("\n".join(sorted(QUERIES)))
        return 0
    if not args.input or not args.output:
        ap.error("--input and --output are required")
    names = [n for n in args.queries.split(",") if n] or sorted(QUERIES)
    unknown = [n for n in names if n not in QUERIES]
    if unknown:
        ap.error(f"unknown reports: {', '.join(unknown)}")

    from bizlens.session import get_spark
    from bizlens.sources.sinks import write_report
    spark = get_spark()
    for name in names:
        write_report(QUERIES[name](spark, args.input), f"{args.output.rstrip('/')}/{name}")
        print(f"wrote {name}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
