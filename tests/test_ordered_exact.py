"""The ordered scan keeps values exact and doesn't hang on what the optimizer reuses."""

import math
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from turnstile.operators import ordered as od
from turnstile.operators.joins import stage_table, staging
from turnstile.session import ensure_checkpoint_dir


@pytest.fixture(params=["true", "false"])
def reuse(spark, request):
    spark.conf.set("spark.sql.exchange.reuse", request.param)
    yield
    spark.conf.unset("spark.sql.exchange.reuse")


def test_values_stay_exact(spark, reuse):
    big = 2**53
    rows = [(i, None if i % 3 == 0 else big + i, Decimal("0.1") * i, float("nan") if i % 5 == 0 else None if i % 7 == 0 else i / 3)
            for i in range(400)]
    df = spark.createDataFrame(rows, "id long, n long, d decimal(20,2), x double")
    got = od.ordered_scan(df, ["id"], row_number="rn", sums={"sn": "n", "sd": "d"}, fills={"fx": "x"}, num_partitions=7).orderBy("id").collect()
    sn, sd, last = 0, Decimal(0), None
    for k, (row, want) in enumerate(zip(got, rows), 1):
        sn, sd = sn + (want[1] or 0), sd + want[2]
        last = want[3] if want[3] is not None else last
        assert (row.rn, row.n, row.d, row.sn, row.sd) == (k, want[1], want[2], sn, sd)
        assert (row.x is None) == (want[3] is None) and (row.x is None or math.isnan(row.x) == math.isnan(want[3]))
        assert row.fx == last or math.isnan(row.fx) and math.isnan(last)


def test_row_numbers_are_whole_in_a_hot_group(spark, reuse):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), F.col("id") % 40)).alias("g"))
    got = od.row_number(df, [F.col("id").desc()], ["g"], num_partitions=9)
    bad = got.groupBy("g").agg(F.count("*").alias("n"), F.countDistinct("row_number").alias("d"), F.max("row_number").alias("m")).where("n <> d or n <> m")
    assert bad.count() == 0


def test_no_python_in_the_plan(spark, catalog):
    for name in ["w03_running_sum", "w05_row_number", "w06_ntile", "w09_fill_down", "p21_row_number", "e10_ranked_predictions"]:
        plan = catalog[name].build(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "MapInPandas" not in plan and "ArrowEval" not in plan, name


def test_ties_do_not_fill_a_range(spark):
    # a third of the rows tie on the order key, and another tenth are equal in all columns
    df = spark.range(20_000).select(
        F.when(F.col("id") % 10 == 9, F.lit(0)).otherwise(F.col("id")).alias("id"),
        F.when(F.col("id") % 10 == 9, F.lit(0.25)).when(F.col("id") % 3 == 0, F.lit(0.5)).otherwise(F.rand(1)).alias("score"))
    with staging(spark):
        df = stage_table(df, "tied")  # random scores are drawn once
        got = od.ordered_scan(df, [F.col("score").desc()], row_number="rn", num_partitions=8)
        rows = got.collect()
        assert sorted(r.rn for r in rows) == list(range(1, 20_001))
        by_place = sorted(rows, key=lambda r: r.rn)
        assert all(a.score >= b.score for a, b in zip(by_place, by_place[1:]))
        copy = [p for p in got.inputFiles() if "ordered" in p][0].rsplit("/", 1)[0]
        sizes = sorted(r["count"] for r in spark.read.parquet(copy).groupBy("__ospid").count().collect())
        assert len(sizes) >= 6 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_columns_with_working_names(spark):
    rows = [(i, i % 3, f"p{i}", float(i), "x", i) for i in range(60)]
    df = spark.createDataFrame(rows, "_pid long, _k_0 long, __ospid string, __os double, _rn string, __size long").repartition(4)
    got = od.ordered_scan(df, ["__os"], ["_k_0"], row_number="rn", sums={"s": "_pid"}, fills={"f": "_rn"}, num_partitions=5)
    assert got.columns == [*df.columns, "rn", "s", "f"]
    for r in got.collect():
        assert (r._pid, r._k_0, r["__ospid"], r["__os"]) == rows[r._pid][:4]
        assert r.rn == r._pid // 3 + 1 and r.s == sum(range(r._k_0, r._pid + 1, 3)) and r.f == "x"
    tiled = od.ntile(df, 4, ["__os"], ["_k_0"])
    assert tiled.columns == [*df.columns, "ntile"] and {r.ntile for r in tiled.collect()} == {1, 2, 3, 4}
    ranked = od.average_rank(df, "__os", ["_k_0"])
    assert ranked.columns == [*df.columns, "rank"] and all(r["rank"] == r._pid // 3 + 1 for r in ranked.collect())


def test_staged_copies_are_removed(spark):
    root = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(root))
    with staging(spark):
        assert od.row_number(spark.range(50), ["id"]).count() == 50
        assert set(os.listdir(root)) > before
    assert set(os.listdir(root)) == before
