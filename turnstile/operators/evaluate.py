"""Classifier evaluation on a scored table ``(id, label, score)``.

Metrics by threshold (one row per distinct score, "positive" = score >=
threshold) come from a partial aggregate per distinct score followed by
distributed running sums over scores in descending order -- no single-task
window over the data.  AUC uses the same running sums (trapezoid rule, ties
counted half), so ROC points and AUC always agree.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import broadcast_if_small
from .ordered import lookup_row_number, ordered_scan, row_number, running_sum

# Cumulative data fractions of the 16-group gains/lift table.
GAIN_FRACTIONS = [0.01, 0.02, 0.03, 0.04, 0.05, 0.10, 0.15, 0.20, 0.30, 0.40, 0.50,
                  0.60, 0.70, 0.80, 0.90, 1.00]
LOGLOSS_EPS = 1e-15


def _is_pos(label: str, positive: str) -> Column:
    return F.col(label) == F.lit(positive)


def score_counts(scored: DataFrame, label: str, score: str, positive: str = "Yes",
                 by: Sequence[str] = ()) -> DataFrame:
    """Positives / negatives per distinct score (map-side partial aggregate)."""
    return scored.groupBy(*by, F.col(score).alias("threshold")).agg(
        F.count_if(_is_pos(label, positive)).alias("pos"),
        F.count_if(~_is_pos(label, positive)).alias("neg"))


def metrics_by_threshold(scored: DataFrame, label: str = "Attrition", score: str = "Yes",
                         positive: str = "Yes", by: Sequence[str] = (), with_rank: bool = False) -> DataFrame:
    """Threshold, tp/fp/tn/fn, precision, recall, f1, accuracy and rates.

    ``by`` evaluates several models at once (e.g. ``model_id``); class totals
    are then per model, joined from a one-row-per-model aggregate.
    ``with_rank`` adds ``threshold_rank`` (1 = highest threshold) from the
    same scan.
    """
    by = list(by)
    counts = score_counts(scored, label, score, positive, by)
    cum = ordered_scan(counts, [F.col("threshold").desc()], by, row_number="threshold_rank",
                       sums={"tp": "pos", "fp": "neg"})
    if by:
        tot = counts.groupBy(*by).agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
        cum = cum.join(broadcast_if_small(tot), by)  # one row per model, size checked
    else:
        total = cum.agg(F.max("tp").alias("p"), F.max("fp").alias("n")).first()  # the last running sums
        cum = cum.withColumns({"_P": F.lit(total["p"]).cast("long"), "_N": F.lit(total["n"]).cast("long")})
    tp, fp, P, N = F.col("tp"), F.col("fp"), F.col("_P"), F.col("_N")
    fn, tn = P - tp, N - fp
    precision = F.try_divide(tp, tp + fp)
    recall = F.try_divide(tp, P)
    return cum.select(
        *by, "threshold", *(["threshold_rank"] if with_rank else []), "pos", "neg",
        tp.alias("tp"), fp.alias("fp"), tn.alias("tn"), fn.alias("fn"),
        precision.alias("precision"), recall.alias("recall"),
        F.try_divide(2 * precision * recall, precision + recall).alias("f1"),
        F.try_divide(tp + tn, P + N).alias("accuracy"),
        F.try_divide(tn, N).alias("tnr"), F.try_divide(fn, P).alias("fnr"),
        F.try_divide(fp, N).alias("fpr"), recall.alias("tpr"))


def auc(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve from the metrics table (trapezoids;
    equal scores form one step, i.e. ties count half)."""
    num = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / F.lit(2.0)))
    den = F.first(F.col("tp") + F.col("fn")) * F.first(F.col("fp") + F.col("tn"))
    return metrics.groupBy(*by).agg(F.try_divide(num, den).alias("auc"))


def gini(auc_col: Column) -> Column:
    """E3."""
    return 2 * auc_col - 1


def logloss(scored: DataFrame, label: str = "Attrition", score: str = "Yes", positive: str = "Yes",
            by: Sequence[str] = ()) -> DataFrame:
    """Mean negative log-likelihood, probabilities clipped to [eps, 1-eps]."""
    p = F.least(F.greatest(F.col(score), F.lit(LOGLOSS_EPS)), F.lit(1 - LOGLOSS_EPS))
    ll = F.when(_is_pos(label, positive), -F.log(p)).otherwise(-F.log(1 - p))
    return scored.groupBy(*by).agg(F.avg(ll).alias("logloss"))


def max_metric_row(metrics: DataFrame, metric: str = "f1") -> DataFrame:
    """The row with the largest metric; ties go to the highest threshold.
    One aggregate, no sort of the metrics table."""
    best = metrics.agg(F.max_by(F.struct(*metrics.columns), F.struct(F.col(metric), F.col("threshold")))
                       .alias("b"))
    return best.select("b.*")


def confusion_matrix(scored: DataFrame, threshold: float, label: str = "Attrition", score: str = "Yes",
                     positive: str = "Yes", negative: str = "No") -> DataFrame:
    """E5: actual x predicted counts at ``threshold`` with error and rate, plus
    a Totals row (one aggregate pass)."""
    pred_pos = F.col(score) >= F.lit(threshold)
    actual_pos = _is_pos(label, positive)
    c = scored.agg(F.count_if(~actual_pos & ~pred_pos).alias("tn"), F.count_if(~actual_pos & pred_pos).alias("fp"),
                   F.count_if(actual_pos & ~pred_pos).alias("fn"), F.count_if(actual_pos & pred_pos).alias("tp"))
    rows = F.array(
        F.struct(F.lit(negative).alias("actual"), F.col("tn").alias(negative), F.col("fp").alias(positive),
                 F.col("fp").alias("_err"), (F.col("tn") + F.col("fp")).alias("_tot")),
        F.struct(F.lit(positive).alias("actual"), F.col("fn").alias(negative), F.col("tp").alias(positive),
                 F.col("fn").alias("_err"), (F.col("fn") + F.col("tp")).alias("_tot")),
        F.struct(F.lit("Totals").alias("actual"), (F.col("tn") + F.col("fn")).alias(negative),
                 (F.col("fp") + F.col("tp")).alias(positive), (F.col("fp") + F.col("fn")).alias("_err"),
                 (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("_tot")))
    x = c.select(F.explode(rows).alias("r")).select("r.*")
    return x.select("actual", negative, positive, F.try_divide(F.col("_err"), F.col("_tot")).alias("error"),
                    F.concat(F.col("_err").cast("string"), F.lit("/"), F.col("_tot").cast("string")).alias("rate"))


def metrics_at(scored: DataFrame, threshold: float, label: str = "Attrition", score: str = "Yes",
               positive: str = "Yes") -> DataFrame:
    """precision = TP/(TP+FP), recall = TP/(TP+FN), F1, accuracy at one threshold."""
    pred_pos = F.col(score) >= F.lit(threshold)
    actual_pos = _is_pos(label, positive)
    c = scored.agg(F.count_if(actual_pos & pred_pos).alias("tp"), F.count_if(~actual_pos & pred_pos).alias("fp"),
                   F.count_if(actual_pos & ~pred_pos).alias("fn"), F.count_if(~actual_pos & ~pred_pos).alias("tn"))
    return c.select("*", *definitions(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")))


def definitions(tp: Column, fp: Column, fn: Column, tn: Column) -> list[Column]:
    precision = F.try_divide(tp, tp + fp)
    recall = F.try_divide(tp, tp + fn)
    return [precision.alias("precision"), recall.alias("recall"),
            F.try_divide(2 * precision * recall, precision + recall).alias("f1"),
            F.try_divide(tp + tn, tp + fp + fn + tn).alias("accuracy")]


def ranked_predictions(scored: DataFrame, id_col: str = "EmployeeNumber", score: str = "Yes") -> DataFrame:
    """Scores in descending order with their global rank."""
    return row_number(scored, [F.col(score).desc(), F.col(id_col).asc()], out="rank")


def ntile_bounds(n: int, k: int) -> list[int]:
    """Upper rank of each of ``k`` tiles; the first ``n mod k`` tiles get one
    extra row (dplyr and SQL ``ntile`` agree)."""
    small, extra = divmod(n, k)
    out, acc = [], 0
    for t in range(1, k + 1):
        acc += small + (1 if t <= extra else 0)
        out.append(acc)
    return [b for i, b in enumerate(out) if b > 0 and (i == 0 or b > out[i - 1])]


def _group_of(rank: Column, bounds: Sequence[int]) -> Column:
    g = F.lit(len(bounds))
    for i in range(len(bounds) - 1, -1, -1):
        g = F.when(rank <= F.lit(bounds[i]), F.lit(i + 1)).otherwise(g)
    return g


def rank_group_counts(scored: DataFrame, bounds: Sequence[int], score: str = "Yes",
                      id_col: str = "EmployeeNumber", label: str = "Attrition", positive: str = "Yes",
                      descending: bool = True) -> DataFrame:
    """Rows and positives per rank group, ranks ordered by (score, id asc).

    Group g holds ranks (bounds[g-1], bounds[g]].  Rows are counted per
    distinct score (map-side partial aggregate) and running counts over the
    distinct scores place whole score groups; only the rows of the at most
    ``len(bounds) - 1`` scores that straddle a boundary are ranked by id
    (distributed), so the table is never sorted row by row.
    """
    per = score_counts(scored, label, score, positive).withColumn("_c", F.col("pos") + F.col("neg"))
    order = F.col("threshold").desc() if descending else F.col("threshold").asc()
    cum = running_sum(per, [order], {"_cum": "_c"})
    g_lo = _group_of(F.col("_cum") - F.col("_c") + 1, bounds)
    g_hi = _group_of(F.col("_cum"), bounds)
    cum = cum.withColumn("_glo", g_lo).withColumn("_ghi", g_hi)
    whole = (cum.where(F.col("_glo") == F.col("_ghi"))
             .groupBy(F.col("_glo").alias("group"))
             .agg(F.sum("_c").alias("cases"), F.sum("pos").alias("responses")))
    split = cum.where(F.col("_glo") != F.col("_ghi")).select(
        F.col("threshold").alias("_t"), (F.col("_cum") - F.col("_c")).alias("_before"))
    # at most len(bounds) - 1 straddling scores: a bounded broadcast
    rows = scored.select(F.col(score).alias("_t"), id_col, label).join(F.broadcast(split), "_t")
    # usually a few rows (size-checked lookup path); a hot tied score takes
    # the distributed scan instead
    ranked = lookup_row_number(rows, [F.col(id_col).asc()], ["_t"], out="_rn")
    parts = (ranked.withColumn("group", _group_of(F.col("_before") + F.col("_rn"), bounds))
             .groupBy("group").agg(F.count(F.lit(1)).alias("cases"),
                                   F.count_if(_is_pos(label, positive)).alias("responses")))
    return whole.unionByName(parts).groupBy("group").agg(F.sum("cases").cast("long").alias("cases"),
                                                          F.sum("responses").cast("long").alias("responses"))


def gain_lift_deciles(scored: DataFrame, k: int = 10, id_col: str = "EmployeeNumber", score: str = "Yes",
                      label: str = "Attrition", positive: str = "Yes") -> DataFrame:
    """``ntile(score, k)`` (ascending, id tie-break), group 1 = top tile;
    cases, responses, cumulative responses, gain, lift and baselines.

    Tile counts come from ``rank_group_counts``; the per-tile table has k
    rows, so its running sums use a window bounded by k.
    """
    n = scored.count()
    per = rank_group_counts(scored, ntile_bounds(n, k), score, id_col, label, positive, descending=False) \
        .withColumnRenamed("group", "_tile")
    w = Window.orderBy(F.col("_tile").desc()).rowsBetween(Window.unboundedPreceding, 0)
    w_all = Window.partitionBy()
    g = per.select(
        F.row_number().over(Window.orderBy(F.col("_tile").desc())).alias("group"), "cases", "responses",
        F.sum("responses").over(w).alias("cumulative_responses"),
        (F.col("responses") / F.sum("responses").over(w_all)).alias("pct_responses"),
        (F.sum("cases").over(w) / F.sum("cases").over(w_all)).alias("cumulative_pct_cases"))
    g = g.withColumn("gain", F.col("cumulative_responses") / F.sum("responses").over(w_all))
    return g.select("group", "cases", "responses", "cumulative_responses", "pct_responses", "gain",
                    "cumulative_pct_cases", (F.col("gain") / F.col("cumulative_pct_cases")).alias("lift"),
                    F.col("cumulative_pct_cases").alias("gain_baseline"),
                    (F.col("cumulative_pct_cases") / F.col("cumulative_pct_cases")).alias("lift_baseline"))


def group_bounds(n: int, fractions: Sequence[float] = GAIN_FRACTIONS) -> list[int]:
    """Rank upper bounds ceil(f * n) of the quantile groups (empty groups removed)."""
    out: list[int] = []
    for f in fractions:
        b = min(n, int(math.ceil(round(f * n, 9))))
        if b > 0 and (not out or b > out[-1]):
            out.append(b)
    return out


def gains_lift_table(scored: DataFrame, id_col: str = "EmployeeNumber", score: str = "Yes",
                     label: str = "Attrition", positive: str = "Yes",
                     fractions: Sequence[float] = GAIN_FRACTIONS) -> DataFrame:
    """gains/lift by quantile groups of the ranked scores (descending)."""
    n = scored.count()
    per = rank_group_counts(scored, group_bounds(n, fractions), score, id_col, label, positive, descending=True)
    w = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, 0)
    w_all = Window.partitionBy()
    t = per.select("group", "cases", "responses",
                   (F.sum("cases").over(w) / F.sum("cases").over(w_all)).alias("cumulative_data_fraction"),
                   (F.sum("responses").over(w) / F.sum("responses").over(w_all)).alias("cumulative_capture_rate"),
                   F.try_divide(F.col("responses") / F.col("cases"),
                                F.sum("responses").over(w_all) / F.sum("cases").over(w_all)).alias("lift"))
    return t.withColumn("cumulative_lift", F.try_divide(F.col("cumulative_capture_rate"),
                                                        F.col("cumulative_data_fraction")))


def gain_lift_long(table: DataFrame) -> DataFrame:
    """Gain and lift charts in long form with their baselines."""
    gain = table.select("group", "cumulative_data_fraction", F.lit("gain").alias("chart"),
                        F.explode(F.array(
                            F.struct(F.lit("gain").alias("key"), F.col("cumulative_capture_rate").alias("value")),
                            F.struct(F.lit("baseline").alias("key"), F.col("cumulative_data_fraction").alias("value"))
                        )).alias("kv"))
    lift = table.select("group", "cumulative_data_fraction", F.lit("lift").alias("chart"),
                        F.explode(F.array(
                            F.struct(F.lit("lift").alias("key"), F.col("cumulative_lift").alias("value")),
                            F.struct(F.lit("baseline").alias("key"), F.lit(1.0).alias("value"))
                        )).alias("kv"))
    return gain.unionByName(lift).select("group", "cumulative_data_fraction", "chart", "kv.key", "kv.value")


def rates_long(metrics: DataFrame) -> DataFrame:
    """Tnr, fnr, fpr, tpr by threshold in long form."""
    return metrics.select("threshold", "tnr", "fnr", "fpr", "tpr").unpivot(
        ["threshold"], ["tnr", "fnr", "fpr", "tpr"], "key", "value")


def leaderboard(scored_long: DataFrame, label: str = "Attrition", positive: str = "Yes") -> DataFrame:
    """Per-model auc and logloss, ranked by auc (descending)."""
    m = metrics_by_threshold(scored_long, label, "score", positive, by=["model_id"])
    a = auc(m, ["model_id"])
    ll = logloss(scored_long, label, "score", positive, by=["model_id"])
    board = a.join(ll, "model_id")
    return board


def quantile_thresholds(scored: DataFrame, score: str = "Yes", max_thresholds: int = 400) -> list[float]:
    """Thresholds at the exact quantiles j/k (j = 0..k-1) of the score,
    de-duplicated: at most ``max_thresholds`` values reach the driver."""
    from .ordered import exact_quantiles
    k = max_thresholds
    q = exact_quantiles(scored, score, [j / k for j in range(k)]).collect()
    return sorted({r["quantile"] for r in q if r["quantile"] is not None})


def metrics_binned(scored: DataFrame, thresholds: Sequence[float], label: str = "Attrition",
                   score: str = "Yes", positive: str = "Yes") -> DataFrame:
    """E1 with a bounded threshold table: one row per given threshold.

    Each row is placed in its threshold bucket by binary search (MLlib
    ``Bucketizer``, JVM), counted per bucket (partial aggregate), and the
    running sums run over at most len(thresholds) + 1 rows, so the table stays
    small however large the data is."""
    from pyspark.ml.feature import Bucketizer
    ts = sorted(set(float(t) for t in thresholds))
    splits = [float("-inf")] + ts + [float("inf")]
    b = Bucketizer(splits=splits, inputCol=score, outputCol="_b", handleInvalid="keep")
    per = b.transform(scored.select(score, label)).groupBy("_b").agg(
        F.count_if(_is_pos(label, positive)).alias("pos"), F.count_if(~_is_pos(label, positive)).alias("neg"))
    # bucket b holds thresholds[b-1] <= score < thresholds[b]; bucket 0 lies
    # below the first threshold.  All k + 1 buckets are listed so empty ones
    # count as zero; the windows below run over these k + 1 rows only.
    spark = scored.sparkSession
    idx = spark.createDataFrame([(float(i),) for i in range(len(ts) + 1)], "_b double")
    full = idx.join(per, "_b", "left").fillna(0, ["pos", "neg"])
    w = Window.orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, 0)
    w_all = Window.partitionBy()
    cum = full.select("_b", F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp"),
                      F.sum("pos").over(w_all).alias("_P"), F.sum("neg").over(w_all).alias("_N"))
    tt = spark.createDataFrame([(float(i + 1), t) for i, t in enumerate(ts)], "_b double, threshold double")
    j = tt.join(cum, "_b")  # threshold i <-> bucket i: tp = positives in buckets >= i
    tp, fp, P, N = F.col("tp"), F.col("fp"), F.col("_P"), F.col("_N")
    fn, tn = P - tp, N - fp
    precision = F.try_divide(tp, tp + fp)
    recall = F.try_divide(tp, P)
    return j.select("threshold", tp.alias("tp"), fp.alias("fp"), tn.alias("tn"), fn.alias("fn"),
                    precision.alias("precision"), recall.alias("recall"),
                    F.try_divide(2 * precision * recall, precision + recall).alias("f1"),
                    F.try_divide(tn, N).alias("tnr"), F.try_divide(fn, P).alias("fnr"),
                    F.try_divide(fp, N).alias("fpr"), recall.alias("tpr"))
