"""Radix selection: the order of the keys, quantiles against numpy, and the shape of the plan."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnstile.operators.quantiles import from_ordered_key, radix_quantiles, with_ordered_key

EDGES = [0.0, -0.0, 5e-324, -5e-324, 2.0 ** -1074 * 3, 2.0 ** -1022, np.nextafter(2.0 ** -1022, 0), 2.0 ** -1021, 1.0, np.nextafter(1.0, 0),
         np.nextafter(1.0, 2), 2.0, np.nextafter(2.0, 0), 3.0, 1e308, np.finfo(float).max, float("inf"), -float("inf"), -1.0, -1e-300, 0.1,
         *[2.0 ** k for k in range(-1074, 1024, 37)], *[np.nextafter(2.0 ** k, 0) for k in range(-1000, 1024, 41)]]


def test_keys_are_the_bits_in_order(spark):
    rng = np.random.default_rng(0)
    some = [*map(float, EDGES), *(float(x) for x in rng.normal(0, 1, 500)), *(float(x) for x in np.exp(rng.uniform(-700, 700, 500)))]
    some += [struct.unpack("<d", struct.pack("<q", int(k)))[0] for k in rng.integers(0, 2047 << 52, 500)]
    df = spark.createDataFrame([(x,) for x in some], "x double")
    rows = with_ordered_key(df, "x", "k").withColumn("back", from_ordered_key(F.col("k"))).collect()
    for r in rows:
        bits = struct.unpack("<q", struct.pack("<d", abs(r.x)))[0]
        assert r.k == (-bits if r.x < 0 else bits), r
        assert r.back == r.x
    nan = with_ordered_key(spark.createDataFrame([(float("nan"),)], "x double"), "x", "k").withColumn("back", from_ordered_key(F.col("k"))).first()
    assert nan.k > max(r.k for r in rows) and math.isnan(nan.back)


PROBS = [0.0, 0.01, 0.25, 0.5, 0.613, 0.75, 0.99, 1.0]


def test_quantiles_of_groups_against_numpy(spark):
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(0, 1e6, 1000), "b": np.exp(rng.uniform(-300, 300, 801)), "c": rng.integers(0, 4, 500).astype(float),
              None: np.array([3.5]), "d": np.array([-1.0, 1.0]), "tied": np.array([7.25] * 900 + [1.0, 9.0])}
    rows = [(k, float(x)) for k, xs in groups.items() for x in xs] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    for few in (True, False):
        got = {(r.g, r.prob): r["quantile"] for r in radix_quantiles(df, "x", PROBS, ["g"], groups_bounded=few).collect()}
        assert len(got) == len(groups) * len(PROBS)
        for g, xs in groups.items():
            for p in PROBS:
                assert got[g, p] == pytest.approx(np.quantile(xs, p), rel=1e-12), (g, p)


def test_weights_count_rows(spark):
    df = spark.createDataFrame([(1.0, 3), (2.0, 1), (10.0, 6)], "x double, n long")
    got = [r["quantile"] for r in radix_quantiles(df, "x", [0.0, 0.3, 0.4, 1.0], weight="n").orderBy("prob").collect()]
    assert got == [pytest.approx(v) for v in np.quantile([1.0] * 3 + [2.0] + [10.0] * 6, [0.0, 0.3, 0.4, 1.0])]


def test_empty_and_null_columns(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert radix_quantiles(df, "x", [0.5]).count() == 0 and radix_quantiles(df.limit(0), "x", [0.5]).count() == 0


def test_no_range_shuffle_and_no_nested_loop(spark, catalog):
    for name in ("p18_pull_scalar", "e01_metrics_by_threshold_binned", "v07_savings_binned_thresholds", "m10_fitted_cuts"):
        plan = catalog[name].build(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "rangepartitioning" not in plan
        whole = catalog[name].build(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastNestedLoopJoin" not in whole and "CartesianProduct" not in whole, name


def test_passes_read_keys_that_are_written_once(spark, monkeypatch):
    """The key's formula is in no plan but that of the written copy, and the copy is gone in the end."""
    from turnstile.operators import quantiles as qu
    from turnstile.session import ensure_checkpoint_dir
    import glob
    import os
    formulas, real = [], qu.with_ordered_key
    monkeypatch.setattr(qu, "with_ordered_key", lambda df, value, out: formulas.append(1) or real(df, value, out))
    seen, stage = [], qu.stage_table
    monkeypatch.setattr(qu, "stage_table", lambda df, name: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or stage(df, name))
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.sqrt(F.col("id").cast("double")).alias("x"))
    out = radix_quantiles(df, "x", [0.25, 0.75], ["g"])
    assert out.count() == 6 and len(formulas) == 1 and len(seen) > 1
    assert not any("LOG2" in p.upper() for p in seen)
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    assert not glob.glob(os.path.join(folder, "turnstile-keys-*"))


def test_box_statistics_of_a_pair_in_two_groups(spark):
    from turnstile.operators.profile import grouped_box_stats
    rows = [(float(i % 11), "abc"[i % 3] if i % 5 else None) for i in range(400)] + [(None, "a"), (None, "z")]
    df = spark.createDataFrame(rows, "x double, y string")
    got = {(r.feature_group, r.level): [r.p0, r.p25, r.p50, r.p75, r.p100]
           for r in grouped_box_stats(df, [("one", "x", "y"), ("two", "x", "y")]).collect()}
    want = {(g, k): list(np.quantile([x for x, y in rows if y == k and x is not None], [0, 0.25, 0.5, 0.75, 1]))
            for g in ("one", "two") for k in ("a", "b", "c", None)}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
