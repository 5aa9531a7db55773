"""Local surrogate explanations (LIME, Ribeiro et al. 2016) on Spark.

X1 fit: per numeric feature, exact quantile bins (4) and their training
frequencies; per categorical feature, level frequencies.  The explainer is
a small table (bins x features).

X2/X3 explain: every case is expanded to ``n_permutations`` rows, in chunks
that are dealt over the cluster before they are expanded; each feature of each row is drawn from the training
distribution with a uniform derived from a hash of (seed, case, permutation,
feature) -- so results do not depend on partitioning or retries.  Row 1 of
every case is the case itself.  The binary representation z_j marks a draw
that falls in the case's own bin/level; the kernel weight is
sqrt(exp(-d^2 / width^2)) with d the Gower distance (share of features that
differ).  Per case, the weighted ridge normal equations are accumulated as
a partial aggregate (one row per case after the shuffle), then solved in a
grouped pandas function on that one row -- no case's rows are gathered.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .joins import stage_table
from .models import p_yes
from .ordered import average_rank, quantiles_from_counts
from .profile import frequency_table, value_counts

N_BINS = 4
RIDGE_LAMBDA = 0.001
#: Permutations of one case that a task expands at once.
CHUNK = 500
_U_SCALE = float(2 ** 31)


def fit_explainer(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                  n_bins: int = N_BINS) -> DataFrame:
    """``(feature, kind, bin, lower, upper, level, prob)``."""
    probs = [i / n_bins for i in range(n_bins + 1)]
    parts = []
    by_feature = Window.partitionBy("feature")  # at most n_bins rows, or one row per level
    if numeric:
        # every later step reads the counts of distinct values, not the rows
        seen = stage_table(value_counts(train, numeric).where(F.col("_v").isNotNull()), "value-counts")
        q = quantiles_from_counts(seen, probs, ["variable"], out="cut", groups_bounded=True).collect()
        cuts: dict[str, list[float]] = {}
        for r in sorted(q, key=lambda r: (r["variable"], r["prob"])):
            cuts.setdefault(r["variable"], []).append(r["cut"])
        b, lower, upper = F.lit(None).cast("int"), F.lit(None).cast("double"), F.lit(None).cast("double")
        for f in numeric:
            c = sorted(set(cuts.get(f, [])))
            if len(c) < 2:
                c = c * 2 if c else [0.0, 0.0]
            own, bounds = F.col("feature") == f, F.array(*[F.lit(v) for v in c])
            b = F.when(own, _bin_of(F.col("_v"), c)).otherwise(b)
            lower = F.when(own, F.element_at(bounds, F.col("bin"))).otherwise(lower)
            upper = F.when(own, F.element_at(bounds, F.col("bin") + 1)).otherwise(upper)
        counts = seen.withColumnRenamed("variable", "feature").withColumn("bin", b).groupBy("feature", "bin").agg(F.sum("_c").alias("n"))
        parts.append(counts.select(
            "feature", F.lit("numeric").alias("kind"), "bin", lower.alias("lower"), upper.alias("upper"),
            F.lit(None).cast("string").alias("level"), (F.col("n") / F.sum("n").over(by_feature)).alias("prob")))
    if categorical:
        counts = frequency_table(train, categorical).select(F.col("variable").alias("feature"), F.col("value").alias("level"), "n")
        parts.append(counts.select(
            "feature", F.lit("categorical").alias("kind"), F.row_number().over(by_feature.orderBy("level")).alias("bin"),
            F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper"), "level",
            (F.col("n") / F.sum("n").over(by_feature)).alias("prob")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _uniform(seed: int, *cols: Column) -> Column:
    """Deterministic U(0,1) from a hash of the seed and the given columns."""
    h = F.xxhash64(F.lit(seed), *cols)
    return (F.pmod(h, F.lit(2 ** 31)).cast("double") + 0.5) / F.lit(_U_SCALE)


def _bin_of(x: Column, cuts: list[float]) -> Column:
    b = F.lit(len(cuts) - 1)
    for i in range(len(cuts) - 2, 0, -1):
        b = F.when(x <= F.lit(cuts[i]), F.lit(i)).otherwise(b)
    return b


Predictor = Callable[[DataFrame], Column] | PipelineModel


def positive_score(df: DataFrame, predict: Predictor, out: str) -> DataFrame:
    """``df`` with P(Yes) by a fitted pipeline or by a function that gives a Column."""
    if isinstance(predict, PipelineModel):
        return p_yes(predict.transform(df)).select(*df.columns, F.col("Yes").alias(out))
    return df.withColumn(out, predict(df))


def permutations(cases: DataFrame, explainer_rows: list, features: Sequence[str], n_permutations: int,
                 seed: int, keep: Sequence[str] = ()) -> DataFrame:
    """Case x permutation rows with drawn feature values and z indicators; ``keep`` names columns of the case."""
    spec: dict[str, dict] = {}
    for r in explainer_rows:
        d = spec.setdefault(r["feature"], {"kind": r["kind"], "rows": []})
        d["rows"].append(r)
    parts = int(cases.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = cases.select("*", F.explode(F.sequence(F.lit(1), F.lit(n_permutations), F.lit(CHUNK))).alias("_from"))
    last = F.least(F.col("_from") + CHUNK - 1, F.lit(n_permutations))
    rows = chunks.repartition(parts, "case", "_from").select("*", F.explode(F.sequence("_from", last)).alias("perm"))
    first = F.col("perm") == 1
    out_cols = [F.col("case"), F.col("perm"), *(F.col(c) for c in keep)]
    z_cols = []
    for j, f in enumerate(features):
        d = spec[f]
        rs = sorted(d["rows"], key=lambda r: r["bin"])
        u = _uniform(seed, F.col("case"), F.col("perm"), F.lit(j))
        cum, acc = [], 0.0
        for r in rs:
            acc += r["prob"]
            cum.append(acc)
        if d["kind"] == "numeric":
            cuts = [rs[0]["lower"]] + [r["upper"] for r in rs]
            lo = F.lit(rs[-1]["lower"])
            hi = F.lit(rs[-1]["upper"])
            b = F.lit(rs[-1]["bin"])
            for r, c in reversed(list(zip(rs, cum))):
                hit = u <= F.lit(c)
                lo = F.when(hit, F.lit(r["lower"])).otherwise(lo)
                hi = F.when(hit, F.lit(r["upper"])).otherwise(hi)
                b = F.when(hit, F.lit(r["bin"])).otherwise(b)
            u2 = _uniform(seed + 1, F.col("case"), F.col("perm"), F.lit(j))
            drawn = lo + (hi - lo) * u2
            case_bin = _bin_of(F.col(f).cast("double"), cuts)
            value = F.when(first, F.col(f).cast("double")).otherwise(drawn)
            z = F.when(first, F.lit(1)).otherwise((b == case_bin).cast("int"))
            out_cols.append(value.alias(f))
        else:
            lv = F.lit(rs[-1]["level"])
            for r, c in reversed(list(zip(rs, cum))):
                lv = F.when(u <= F.lit(c), F.lit(r["level"])).otherwise(lv)
            value = F.when(first, F.col(f).cast("string")).otherwise(lv)
            z = (value == F.col(f).cast("string")).cast("int")
            out_cols.append(value.alias(f))
        z_cols.append(z.alias(f"z{j}"))
    return rows.select(*out_cols, *z_cols)


def _solve(pdf: pd.DataFrame, p: int, n_select: int, lam: float) -> pd.DataFrame:
    """Weighted ridge from aggregated sums, highest-weight feature choice."""
    r = pdf.iloc[0]
    sw = r["sw"]
    m = np.zeros((p + 1, p + 1))
    v = np.zeros(p + 1)
    m[0, 0] = sw
    for i in range(p):
        m[0, i + 1] = m[i + 1, 0] = r[f"sz{i}"]
        v[i + 1] = r[f"szy{i}"]
        for k in range(i, p):
            m[i + 1, k + 1] = m[k + 1, i + 1] = r[f"szz{i}_{k}"]
    v[0] = r["sy"]
    syy = r["syy"]

    def fit(idx):
        sel = [0] + [i + 1 for i in idx]
        a = m[np.ix_(sel, sel)].copy()
        a[1:, 1:] += lam * sw * np.eye(len(sel) - 1)
        beta = np.linalg.lstsq(a, v[sel], rcond=None)[0]
        sse = syy - 2 * beta @ v[sel] + beta @ m[np.ix_(sel, sel)] @ beta
        sst = syy - v[0] ** 2 / sw
        r2 = 1 - sse / sst if sst > 0 else 0.0
        return beta, r2

    beta, _ = fit(list(range(p)))
    order = sorted(range(p), key=lambda i: -abs(beta[i + 1]))[:n_select]
    chosen = sorted(order)
    beta, r2 = fit(chosen)
    rows = []
    for pos, i in enumerate(chosen):
        rows.append({"case": int(r["case"]), "feature_idx": i, "feature_weight": float(beta[pos + 1]),
                     "model_intercept": float(beta[0]), "model_r2": float(r2),
                     "model_prediction": float(beta.sum())})
    return pd.DataFrame(rows)


def explain(cases: DataFrame, explainer: DataFrame, features: Sequence[str],
            predict: Predictor, n_permutations: int = 5000, n_features: int = 8,
            kernel_width: float = 1.0, seed: int = 1234) -> DataFrame:
    """Explanations for every row of ``cases`` (column ``case`` + features).

    ``predict`` is a fitted pipeline, or maps a DataFrame with the feature
    columns to a Column with P(Yes).  The explained label is the case's most likely class.
    """
    ex_rows = explainer.collect()  # bins x features: a small table
    p = len(features)
    cases = positive_score(cases.select("case", *features), predict, "_case_pyes")
    perms = permutations(cases, ex_rows, features, n_permutations, seed, keep=["_case_pyes"])
    perms = positive_score(perms, predict, "_pyes")
    label_yes = F.col("_case_pyes") >= 0.5
    y = F.when(label_yes, F.col("_pyes")).otherwise(1 - F.col("_pyes"))
    zsum = sum((F.col(f"z{j}") for j in range(p)), F.lit(0))
    d = (F.lit(p) - zsum) / F.lit(p)
    w = F.sqrt(F.exp(-(d * d) / F.lit(kernel_width ** 2)))
    perms = perms.withColumn("_y", y).withColumn("_w", w)
    aggs = [F.sum("_w").alias("sw"), F.sum(F.col("_w") * F.col("_y")).alias("sy"),
            F.sum(F.col("_w") * F.col("_y") * F.col("_y")).alias("syy")]
    for i in range(p):
        zi = F.col(f"z{i}")
        aggs.append(F.sum(F.col("_w") * zi).alias(f"sz{i}"))
        aggs.append(F.sum(F.col("_w") * zi * F.col("_y")).alias(f"szy{i}"))
        for k in range(i, p):
            aggs.append(F.sum(F.col("_w") * zi * F.col(f"z{k}")).alias(f"szz{i}_{k}"))
    stats = perms.groupBy("case").agg(*aggs)
    schema = T.StructType([T.StructField("case", T.LongType()), T.StructField("feature_idx", T.IntegerType()),
                           T.StructField("feature_weight", T.DoubleType()),
                           T.StructField("model_intercept", T.DoubleType()),
                           T.StructField("model_r2", T.DoubleType()),
                           T.StructField("model_prediction", T.DoubleType())])
    fits = stats.groupBy("case").applyInPandas(lambda pdf: _solve(pdf, p, min(n_features, p), RIDGE_LAMBDA),
                                               schema)
    names = cases.sparkSession.createDataFrame([(i, f) for i, f in enumerate(features)],
                                               "feature_idx int, feature string")
    meta = cases.select("case", F.when(F.col("_case_pyes") >= 0.5, "Yes").otherwise("No").alias("label"),
                         F.greatest(F.col("_case_pyes"), 1 - F.col("_case_pyes")).alias("label_prob"))
    out = fits.join(F.broadcast(names), "feature_idx").join(meta, "case")
    # the case's own value and its bin description
    vals = cases.select("case", F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("feature_value")) for f in features
    ])).alias("v")).select("case", "v.*")
    out = out.join(vals, ["case", "feature"])
    desc = describe_bins(ex_rows, cases, features)
    return out.join(desc, ["case", "feature"]).select(
        "case", "label", "label_prob", "model_r2", "model_intercept", "model_prediction", "feature",
        "feature_value", "feature_weight", "feature_desc")


def _fmt(v: float) -> str:
    return f"{v:.2f}".rstrip("0").rstrip(".") if not math.isinf(v) else str(v)


def describe_bins(ex_rows: list, cases: DataFrame, features: Sequence[str]) -> DataFrame:
    """``feature_desc`` of each case's bin: "f <= a", "a < f <= b", "b < f"
    or "f = level"."""
    spec: dict[str, list] = {}
    for r in ex_rows:
        spec.setdefault(r["feature"], []).append(r)
    structs = []
    for f in features:
        rs = sorted(spec[f], key=lambda r: r["bin"])
        if rs[0]["kind"] == "numeric":
            cuts = [rs[0]["lower"]] + [r["upper"] for r in rs]
            b = _bin_of(F.col(f).cast("double"), cuts)
            text = F.lit(f"{_fmt(cuts[-2])} < {f}") if len(cuts) > 2 else F.lit(f)
            for i in range(len(cuts) - 2, 0, -1):
                t = f"{f} <= {_fmt(cuts[1])}" if i == 1 else f"{_fmt(cuts[i - 1])} < {f} <= {_fmt(cuts[i])}"
                text = F.when(b == i, F.lit(t)).otherwise(text)
        else:
            text = F.concat(F.lit(f"{f} = "), F.col(f).cast("string"))
        structs.append(F.struct(F.lit(f).alias("feature"), text.alias("feature_desc")))
    return cases.select("case", F.explode(F.array(*structs)).alias("d")).select("case", "d.*")


def feature_bars(explanation: DataFrame) -> DataFrame:
    """Bars ordered by |weight|, Supports/Contradicts and the texts."""
    from .ordered import lookup_row_number
    ranked = lookup_row_number(explanation, [F.abs(F.col("feature_weight")).asc(), F.col("feature")],
                               ["case"], out="desc_order")
    return ranked.select(
        "case", "feature_desc", "feature_weight", F.col("desc_order").cast("int").alias("desc_order"),
        F.when(F.col("feature_weight") > 0, "Supports").otherwise("Contradicts").alias("key"),
        F.concat(F.lit("Case: "), F.col("case").cast("string")).alias("case_text"),
        F.concat(F.lit("Label: "), F.col("label")).alias("label_text"),
        F.concat(F.lit("Probability: "), F.bround("label_prob", 2).cast("string")).alias("prob_text"),
        F.concat(F.lit("Explanation Fit: "), F.bround("model_r2", 2).cast("string")).alias("r2_text"))


def tile_order(explanation: DataFrame) -> DataFrame:
    """order = rank(feature) * 1000 + rank(feature_value) within feature
    (average ranks), feature_desc levels ordered by order descending."""
    e = explanation.withColumn("_fv", F.col("feature_value").try_cast("double"))
    r1 = average_rank(e, "feature", out="order_1")
    r2 = average_rank(r1, "_fv", ["feature"], out="order_2")
    return r2.select("case", "feature_desc", "feature_weight", "label",
                     (F.col("order_1") * 1000 + F.col("order_2")).alias("order"))


def mean_weight(explanation: DataFrame) -> DataFrame:
    """Mean feature weight by label x feature."""
    return explanation.groupBy("label", "feature").agg(F.avg("feature_weight").alias("mean_weight"))
