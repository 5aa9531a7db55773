"""Properties of the operators, checked against plain Python / pandas."""

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_SMALL
from turnstile.operators import ordered as od
from turnstile.operators import evaluate as ev
from turnstile.operators import policy as pol
from turnstile.operators import profile as pf
from turnstile.operators.correlation import pearson, target_correlation
from turnstile.sources.people import people, scored


def _skewed(spark, n=5000, hot=0.34, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        g = 0 if rnd.random() < hot else rnd.randrange(1, 9)
        v = float(rnd.randrange(0, 200)) if rnd.random() > 0.05 else None
        s = str(i) if rnd.random() < 0.2 else None
        rows.append((i, g, v, s))
    return spark.createDataFrame(rows, "id long, g int, v double, s string")


def test_ordered_scan_matches_windows_with_hot_key(spark):
    df = _skewed(spark)
    out = od.ordered_scan(df, ["id"], ["g"], row_number="rn", sums={"cs": "v"}, fills={"fs": "s"},
                          num_partitions=7).toPandas().sort_values("id")
    pdf = df.toPandas().sort_values(["g", "id"])
    pdf["rn"] = pdf.groupby("g").cumcount() + 1
    pdf["cs"] = pdf["v"].fillna(0).groupby(pdf["g"]).cumsum()
    pdf["fs"] = pdf.groupby("g")["s"].ffill()
    exp = pdf.sort_values("id")
    assert (out["rn"].to_numpy() == exp["rn"].to_numpy()).all()
    assert np.allclose(out["cs"].to_numpy(), exp["cs"].to_numpy())
    a, b = out["fs"].tolist(), exp["fs"].tolist()
    assert all((x is None and (y is None or (isinstance(y, float) and math.isnan(y)))) or x == y
               for x, y in zip(a, b))


def test_global_row_number_and_ntile(spark):
    df = _skewed(spark, 3001)
    nt = od.ntile(df, 10, ["v", "id"]).select("id", "ntile")
    ref = df.select("id", F.ntile(10).over(Window.orderBy(F.col("v").asc_nulls_first(), "id")).alias("t"))
    assert nt.join(ref, "id").where(F.col("ntile") != F.col("t")).count() == 0


def test_exact_quantiles_match_numpy(spark):
    df = _skewed(spark, 4000)
    q = {(r["g"], r["prob"]): r["quantile"]
         for r in od.exact_quantiles(df, "v", [0, 0.25, 0.5, 0.9, 1], ["g"]).collect()}
    pdf = df.toPandas().dropna(subset=["v"])
    for (g, p), val in q.items():
        exp = np.quantile(pdf[pdf.g == g]["v"].to_numpy(), p)  # linear = type 7
        assert math.isclose(val, exp, rel_tol=1e-12, abs_tol=1e-12)


def test_average_rank_matches_pandas(spark):
    df = _skewed(spark, 2000).where(F.col("v").isNotNull())
    got = od.average_rank(df, "v", ["g"]).toPandas().sort_values("id")
    pdf = df.toPandas().sort_values("id")
    pdf["rank"] = pdf.groupby("g")["v"].rank(method="average")
    assert np.allclose(got["rank"].to_numpy(), pdf["rank"].to_numpy())


def test_rates_sum_to_one_and_auc_matches_mllib(spark):
    s = scored(spark, SF_SMALL)
    m = ev.metrics_by_threshold(s)
    bad = m.where((F.abs(F.col("tnr") + F.col("fpr") - 1) > 1e-12) | (F.abs(F.col("fnr") + F.col("tpr") - 1) > 1e-12))
    assert bad.count() == 0
    auc = ev.auc(m).first()["auc"]
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    lab = s.select(F.col("Yes").alias("rawPrediction"), (F.col("Attrition") == "Yes").cast("double").alias("label"))
    assert math.isclose(auc, BinaryClassificationEvaluator().evaluate(lab), abs_tol=1e-9)


def test_shares_sum_to_one_per_group(spark):
    from turnstile.operators.attrition import count_by, count_to_pct
    c = count_to_pct(count_by(people(spark, SF_SMALL), "Department", "JobRole", "Attrition"),
                     "Department", "JobRole")
    sums = c.groupBy("Department", "JobRole").agg(F.sum("pct").alias("t")).collect()
    assert all(math.isclose(r["t"], 1.0) for r in sums)


def test_full_expected_cost_equals_reduced_form(spark):
    s = scored(spark, SF_SMALL)
    p = pol.Policy("x", 0.2, tnr=0.7, fpr=0.3, fnr=0.4, tpr=0.6)
    full = pol.expected_costs_with_rates(s, p).agg(F.sum("expected_attrition_cost")).first()[0]
    via = pol.savings_for_policies(s, [p]).first()["total_expected_attrition_cost_1"]
    assert math.isclose(full, via, rel_tol=1e-9)


def test_prefix_sum_savings_equal_direct_sums(spark):
    s = scored(spark, SF_SMALL)
    m = ev.metrics_by_threshold(s)
    allt = {round(r["threshold"], 6): r["savings"] for r in pol.savings_all_thresholds(s).collect()}
    some = m.orderBy(F.col("threshold").desc()).limit(5).collect()
    ps = [pol.Policy("t", r["threshold"], r["tnr"], r["fpr"], r["fnr"], r["tpr"]) for r in some]
    for r in pol.savings_for_policies(s, ps).collect():
        assert math.isclose(r["savings"], allt[round(r["threshold"], 6)], rel_tol=1e-9, abs_tol=1e-6)


def test_last_gain_and_lift_are_one(spark):
    t = ev.gains_lift_table(scored(spark, SF_SMALL)).orderBy(F.col("group").desc()).first()
    assert math.isclose(t["cumulative_capture_rate"], 1.0) and math.isclose(t["cumulative_lift"], 1.0)


def test_histogram_bins_sum_to_rows(spark):
    hr = people(spark, SF_SMALL)
    n = hr.count()
    h = pf.histogram(hr, ["Age", "MonthlyIncome"]).groupBy("variable").agg(F.sum("n").alias("t")).collect()
    assert all(r["t"] == n for r in h)


def test_fold_of_lookup_joins_keeps_rows(spark):
    from turnstile.operators.readable import readable_people
    hr = people(spark, SF_SMALL)
    data, levels = readable_people(hr)
    assert data.count() == hr.count()
    assert data.where(F.col("JobSatisfaction").isNull()).count() == 0


def test_null_rules(spark):
    df = spark.createDataFrame([(1, 2.0, None), (2, None, 1.0), (3, 3.0, 2.0), (4, 5.0, 4.0), (5, 1.0, 1.0)],
                               "id int, x double, y double")
    # pairwise-complete: only rows 3,4,5 count
    r = df.agg(pearson(F.col("x"), F.col("y")).alias("r")).first()["r"]
    exp = np.corrcoef([3.0, 5.0, 1.0], [2.0, 4.0, 1.0])[0, 1]
    assert math.isclose(r, exp)
    # a constant column gives NULL, not an error
    c = df.withColumn("k", F.lit(1.0))
    assert target_correlation(c, "x", ["k"]).first()["x"] is None
    # null-safe NOT IN keeps NULLs
    t = spark.createDataFrame([("a",), (None,), ("b",)], "s string")
    kept = t.where(~F.coalesce(F.col("s").isin("a"), F.lit(False))).count()
    assert kept == 2


def test_rank_groups_with_ties_match_sql_ntile(spark):
    # three distinct scores over 1003 rows: every tile boundary falls inside a tie
    rows = [(i, float(i % 3), "Yes" if i % 7 == 0 else "No") for i in range(1003)]
    df = spark.createDataFrame(rows, "EmployeeNumber long, Yes double, Attrition string")
    got = {r["group"]: (r["cases"], r["responses"])
           for r in ev.rank_group_counts(df, ev.ntile_bounds(1003, 10), descending=False).collect()}
    ref = (df.withColumn("t", F.ntile(10).over(Window.orderBy("Yes", "EmployeeNumber")))
           .groupBy("t").agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("Attrition") == "Yes").alias("r")))
    exp = {r["t"]: (r["c"], r["r"]) for r in ref.collect()}
    assert got == exp
