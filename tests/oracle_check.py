"""Run a catalogue query in Spark and its oracle SQL in DuckDB; compare.

Comparison: same column names, same row count, and the same multiset of rows
after rounding doubles to 6 significant decimals (order-insensitive).
Usable from pytest and from the command line:

    python tests/oracle_check.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except Exception:
            return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(x) if not (isinstance(x, float) and math.isnan(x)) else None for x in rec))
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark, con, entry, sf_dir: str) -> dict:
    t0 = time.time()
    sdf = entry.build(spark, sf_dir)
    s_pdf = sdf.toPandas()
    t1 = time.time()
    res = {"name": entry.name, "spark_rows": len(s_pdf), "spark_sec": round(t1 - t0, 2)}
    if entry.sql is None:
        res["status"] = "rows-only"
        return res
    o_pdf = con.execute(entry.sql).df()
    res["oracle_rows"] = len(o_pdf)
    if sorted(s_pdf.columns) != sorted(o_pdf.columns):
        res["status"] = "schema"
        res["detail"] = f"spark={sorted(s_pdf.columns)} oracle={sorted(o_pdf.columns)}"
        return res
    if len(s_pdf) != len(o_pdf):
        res["status"] = "rowcount"
        return res
    a, b = _rows(s_pdf), _rows(o_pdf)
    if a == b:
        res["status"] = "ok"
        return res
    # near-equality: tolerate last-digit rounding differences of doubles
    bad = 0
    first = None
    for ra, rb in zip(a, b):
        for x, y in zip(ra, rb):
            if x == y:
                continue
            if isinstance(x, (int, float)) and isinstance(y, (int, float)) and \
                    abs(x - y) <= 2e-6 * max(1.0, abs(x), abs(y)):
                continue
            bad += 1
            first = first or (ra, rb)
            break
    res["status"] = "near" if bad == 0 else "values"
    if bad:
        res["detail"] = f"{bad} rows differ; first: {first}"
    return res


def main(argv: list[str]) -> int:
    sys.path.insert(0, "/root/repo")
    from turnstile.plans.registry import load_all
    from turnstile.session import build_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    cat = load_all()
    spark = build_session()
    con = duck(sf_dir)
    bad = 0
    for name, entry in cat.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        try:
            r = compare(spark, con, entry, sf_dir)
        except Exception as e:  # report and continue
            r = {"name": name, "status": "error", "detail": repr(e)[:400]}
        if r["status"] not in ("ok", "rows-only", "near"):
            bad += 1
        print(r, flush=True)
    print("failures:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv))
