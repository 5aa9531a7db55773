"""Command line: list the catalogue or run one query.

    python -m turnstile list
    python -m turnstile run d04_attrition_workflow /root/testdata/sf0.01 [--out DIR] [--rows N]
    python -m turnstile sql d04_attrition_workflow      # print its oracle SQL
"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="turnstile")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list")
    r = sub.add_parser("run")
    r.add_argument("name")
    r.add_argument("sf_dir")
    r.add_argument("--out", help="write the result as parquet to this folder")
    r.add_argument("--rows", type=int, default=20, help="rows to show when not writing")
    s = sub.add_parser("sql")
    s.add_argument("name")
    args = ap.parse_args(argv)

    from .plans.registry import load_all
    cat = load_all()
    if args.cmd == "list":
        for name, e in cat.items():
            print(f"{name}\t{'oracle' if e.sql else 'rows-only'}")
        return 0
    if args.name not in cat:
        print(f"unknown query {args.name!r}", file=sys.stderr)
        return 2
    if args.cmd == "sql":
        print(cat[args.name].sql or "-- no oracle SQL (model / iterative operator)")
        return 0
    from .operators.joins import staging
    from .session import build_session
    spark = build_session()
    with staging(spark):
        df = cat[args.name].build(spark, args.sf_dir)
        if args.out:
            df.write.mode("overwrite").parquet(args.out)
        else:
            df.show(args.rows, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
