"""Queries for classifier evaluation (E1-E15) on the scored people view."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..sources.people import scored
from .registry import query
from .sql import with_ctes

RATES = ["precision", "recall", "f1", "accuracy", "tnr", "fnr", "fpr", "tpr"]
E7_THRESHOLD = 0.3315


def r6(df: DataFrame, cols) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def models_long(spark, sf) -> DataFrame:
    """Two scorings of the same employees as two 'models' (long form)."""
    s = scored(spark, sf)
    a = s.select(F.lit("as_is").alias("model_id"), "EmployeeNumber", "Attrition", F.col("Yes").alias("score"))
    b = s.select(F.lit("no_overtime").alias("model_id"), "EmployeeNumber", "Attrition",
                 F.col("Yes_no_ot").alias("score"))
    return a.unionByName(b)


MODELS_SQL = """SELECT 'as_is' AS model_id, EmployeeNumber, Attrition, Yes AS score FROM scored
UNION ALL SELECT 'no_overtime', EmployeeNumber, Attrition, Yes_no_ot FROM scored"""


def metrics_sql(source: str = "scored", score: str = "Yes", by: str = "") -> str:
    """Metrics by threshold in SQL (``by`` = optional model column)."""
    part = f"PARTITION BY {by} " if by else ""
    sel_by = f"{by}, " if by else ""
    join = f"USING ({by})" if by else "ON true"
    return f"""SELECT {sel_by}threshold, pos, neg, tp, fp, tn, fn, precision, recall,
  CASE WHEN precision + recall = 0 THEN NULL ELSE 2 * precision * recall / (precision + recall) END AS f1,
  (tp + tn) / (P + N) AS accuracy, tn / N AS tnr, fn / P AS fnr, fp / N AS fpr, recall AS tpr
FROM (SELECT *, P - tp AS fn, N - fp AS tn,
        CASE WHEN tp + fp = 0 THEN NULL ELSE tp / (tp + fp) END AS precision, tp / P AS recall FROM (
  SELECT c.*, CAST(sum(pos) OVER ({part}ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tp,
    CAST(sum(neg) OVER ({part}ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fp, t.P, t.N
  FROM (SELECT {sel_by}{score} AS threshold, count(*) FILTER (WHERE Attrition = 'Yes') AS pos,
          count(*) FILTER (WHERE Attrition <> 'Yes') AS neg FROM {source} GROUP BY {sel_by}{score}) c
  JOIN (SELECT {sel_by}CAST(count(*) FILTER (WHERE Attrition = 'Yes') AS BIGINT) AS P,
          CAST(count(*) FILTER (WHERE Attrition <> 'Yes') AS BIGINT) AS N FROM {source}
          {"GROUP BY " + by if by else ""}) t {join}) x) y"""


_M = ("m", metrics_sql())
_R6 = ", ".join(f"round({c}, 6) AS {c}" for c in RATES)


def _metrics(spark, sf):
    return ev.metrics_by_threshold(scored(spark, sf))


@query("e01_metrics_by_threshold", with_ctes(
    f"SELECT threshold, pos, neg, tp, fp, tn, fn, {_R6} FROM m", _M, scored=True))
def e01(spark, sf):
    return r6(_metrics(spark, sf), RATES)


_AUC_SQL = "SELECT sum(neg * (tp - pos / 2.0)) / (max(P) * max(N)) AS auc FROM m JOIN (SELECT max(tp + fn) AS P, max(fp + tn) AS N FROM m) t ON true"


@query("e02_auc", with_ctes(f"SELECT round(auc, 6) AS auc FROM ({_AUC_SQL}) a", _M, scored=True))
def e02(spark, sf):
    return ev.auc(_metrics(spark, sf)).select(F.round("auc", 6).alias("auc"))


@query("e03_gini", with_ctes(f"SELECT round(2 * auc - 1, 6) AS gini FROM ({_AUC_SQL}) a", _M, scored=True))
def e03(spark, sf):
    return ev.auc(_metrics(spark, sf)).select(F.round(ev.gini(F.col("auc")), 6).alias("gini"))


_LOGLOSS_SQL = """avg(CASE WHEN Attrition = 'Yes' THEN -ln(least(greatest({s}, 1e-15), 1 - 1e-15))
  ELSE -ln(1 - least(greatest({s}, 1e-15), 1 - 1e-15)) END)"""


@query("e04_logloss", with_ctes(
    f"SELECT round({_LOGLOSS_SQL.format(s='Yes')}, 6) AS logloss FROM scored", scored=True))
def e04(spark, sf):
    return ev.logloss(scored(spark, sf)).select(F.round("logloss", 6).alias("logloss"))


_BEST_SQL = "SELECT * FROM m ORDER BY f1 DESC, threshold DESC LIMIT 1"


@query("e05_confusion_matrix", with_ctes(
    """SELECT actual, "No", "Yes", round(err / tot, 6) AS error, CAST(err AS VARCHAR) || '/' || CAST(tot AS VARCHAR) AS rate
FROM (SELECT 'No' AS actual, tn AS "No", fp AS "Yes", fp AS err, tn + fp AS tot FROM cm
      UNION ALL SELECT 'Yes', fn, tp, fn, fn + tp FROM cm
      UNION ALL SELECT 'Totals', tn + fn, fp + tp, fp + fn, tn + fp + fn + tp FROM cm) r""",
    _M, ("best", _BEST_SQL), ("cm", """SELECT
      count(*) FILTER (WHERE Attrition <> 'Yes' AND Yes < (SELECT threshold FROM best)) AS tn,
      count(*) FILTER (WHERE Attrition <> 'Yes' AND Yes >= (SELECT threshold FROM best)) AS fp,
      count(*) FILTER (WHERE Attrition = 'Yes' AND Yes < (SELECT threshold FROM best)) AS fn,
      count(*) FILTER (WHERE Attrition = 'Yes' AND Yes >= (SELECT threshold FROM best)) AS tp FROM scored"""),
    scored=True))
def e05(spark, sf):
    s = scored(spark, sf)
    t = ev.max_metric_row(ev.metrics_by_threshold(s), "f1").first()["threshold"]  # one scalar
    return ev.confusion_matrix(s, t).withColumn("error", F.round("error", 6))


@query("e06_max_f1_threshold", with_ctes(
    f"SELECT threshold, tp, fp, tn, fn, {_R6} FROM ({_BEST_SQL}) b", _M, scored=True))
def e06(spark, sf):
    best = ev.max_metric_row(_metrics(spark, sf), "f1")
    return r6(best.select("threshold", "tp", "fp", "tn", "fn", *RATES), RATES)


@query("e07_metric_definitions", with_ctes(
    f"""SELECT tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(2 * precision * recall / (precision + recall), 6) AS f1, round(accuracy, 6) AS accuracy FROM (
  SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, (tp + tn) / (tp + fp + fn + tn) AS accuracy FROM (
    SELECT count(*) FILTER (WHERE Attrition = 'Yes' AND Yes >= {E7_THRESHOLD}) AS tp,
      count(*) FILTER (WHERE Attrition <> 'Yes' AND Yes >= {E7_THRESHOLD}) AS fp,
      count(*) FILTER (WHERE Attrition = 'Yes' AND Yes < {E7_THRESHOLD}) AS fn,
      count(*) FILTER (WHERE Attrition <> 'Yes' AND Yes < {E7_THRESHOLD}) AS tn FROM scored) c) d""",
    scored=True))
def e07(spark, sf):
    return r6(ev.metrics_at(scored(spark, sf), E7_THRESHOLD), ["precision", "recall", "f1", "accuracy"])


_MM = ("mm", metrics_sql("models", "score", "model_id"))
_MODELS = ("models", MODELS_SQL)


@query("e08_roc_per_model", with_ctes(
    "SELECT model_id, threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM mm", _MODELS, _MM, scored=True))
def e08(spark, sf):
    m = ev.metrics_by_threshold(models_long(spark, sf), score="score", by=["model_id"])
    return r6(m.select("model_id", "threshold", "fpr", "tpr"), ["fpr", "tpr"])


@query("e09_pr_per_model", with_ctes(
    "SELECT model_id, threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM mm",
    _MODELS, _MM, scored=True))
def e09(spark, sf):
    m = ev.metrics_by_threshold(models_long(spark, sf), score="score", by=["model_id"])
    return r6(m.select("model_id", "threshold", "precision", "recall"), ["precision", "recall"])


@query("e10_ranked_predictions", with_ctes(
    """SELECT EmployeeNumber, Yes, Attrition, row_number() OVER (ORDER BY Yes DESC, EmployeeNumber) AS rank
FROM scored""", scored=True))
def e10(spark, sf):
    return ev.ranked_predictions(scored(spark, sf).select("EmployeeNumber", "Yes", "Attrition"))


_GL = ["pct_responses", "gain", "cumulative_pct_cases", "lift", "gain_baseline", "lift_baseline"]


@query("e11_gain_lift_deciles", with_ctes(
    f"""SELECT "group", cases, responses, cumulative_responses, {", ".join(f"round({c}, 6) AS {c}" for c in _GL)}
FROM (SELECT *, cumulative_responses / sum(responses) OVER () AS gain,
        cumulative_responses / sum(responses) OVER () / cumulative_pct_cases AS lift,
        cumulative_pct_cases AS gain_baseline, cumulative_pct_cases / cumulative_pct_cases AS lift_baseline FROM (
  SELECT row_number() OVER (ORDER BY tile DESC) AS "group", cases, responses,
    CAST(sum(responses) OVER (ORDER BY tile DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative_responses,
    responses / sum(responses) OVER () AS pct_responses,
    sum(cases) OVER (ORDER BY tile DESC ROWS UNBOUNDED PRECEDING) / sum(cases) OVER () AS cumulative_pct_cases
  FROM (SELECT tile, count(*) AS cases, count(*) FILTER (WHERE Attrition = 'Yes') AS responses FROM (
          SELECT Attrition, ntile(10) OVER (ORDER BY Yes, EmployeeNumber) AS tile FROM scored) t GROUP BY tile) g) h) i""",
    scored=True))
def e11(spark, sf):
    return r6(ev.gain_lift_deciles(scored(spark, sf)), _GL)


def _gains_sql(source: str = "scored", score: str = "Yes") -> str:
    fr = ", ".join(f"({i + 1}, {f})" for i, f in enumerate(ev.GAIN_FRACTIONS))
    return f"""SELECT "group", cases, responses, cumulative_data_fraction, cumulative_capture_rate, lift,
  cumulative_capture_rate / cumulative_data_fraction AS cumulative_lift FROM (
  SELECT "group", cases, responses,
    sum(cases) OVER (ORDER BY "group" ROWS UNBOUNDED PRECEDING) / sum(cases) OVER () AS cumulative_data_fraction,
    sum(responses) OVER (ORDER BY "group" ROWS UNBOUNDED PRECEDING) / sum(responses) OVER ()
      AS cumulative_capture_rate,
    (responses / cases) / (sum(responses) OVER () / sum(cases) OVER ()) AS lift
  FROM (SELECT "group", count(*) AS cases, count(*) FILTER (WHERE Attrition = 'Yes') AS responses
        FROM (SELECT Attrition, row_number() OVER (ORDER BY {score} DESC, EmployeeNumber) AS rk FROM {source}) r
        JOIN (SELECT CAST(row_number() OVER (ORDER BY b) AS INT) AS "group", b,
                     coalesce(lag(b) OVER (ORDER BY b), 0) AS pb
              FROM (SELECT DISTINCT least(n, CAST(ceil(round(f * n, 9)) AS BIGINT)) AS b
                    FROM (VALUES {fr}) v(i, f), (SELECT count(*) AS n FROM {source}) c) d WHERE b > 0) bd
          ON r.rk <= bd.b AND r.rk > bd.pb GROUP BY "group") g) h"""


_GAINS = ("gains", _gains_sql())
_G12 = ["cumulative_data_fraction", "cumulative_capture_rate", "lift", "cumulative_lift"]


@query("e12_gain_lift_16_groups", with_ctes(
    f"""SELECT "group", cases, responses, {", ".join(f"round({c}, 6) AS {c}" for c in _G12)} FROM gains""",
    _GAINS, scored=True))
def e12(spark, sf):
    t = ev.gains_lift_table(scored(spark, sf))
    return r6(t.select(F.col("group").cast("int").alias("group"), "cases", "responses", *_G12), _G12)


@query("e13_gain_lift_long", with_ctes(
    """SELECT "group", round(cumulative_data_fraction, 6) AS cumulative_data_fraction, chart, key, round(value, 6) AS value
FROM (SELECT "group", cumulative_data_fraction, 'gain' AS chart, 'gain' AS key, cumulative_capture_rate AS value FROM gains
  UNION ALL SELECT "group", cumulative_data_fraction, 'gain', 'baseline', cumulative_data_fraction FROM gains
  UNION ALL SELECT "group", cumulative_data_fraction, 'lift', 'lift', cumulative_lift FROM gains
  UNION ALL SELECT "group", cumulative_data_fraction, 'lift', 'baseline', 1.0 FROM gains) u""",
    _GAINS, scored=True))
def e13(spark, sf):
    t = ev.gains_lift_table(scored(spark, sf)).withColumn("group", F.col("group").cast("int"))
    return r6(ev.gain_lift_long(t), ["cumulative_data_fraction", "value"])


@query("e14_model_dashboard", with_ctes(
    f"""SELECT model_id, round(auc, 3) AS auc, round(logloss, 4) AS logloss,
  CAST(row_number() OVER (ORDER BY auc DESC, model_id) AS INT) AS position FROM (
  SELECT a.model_id, a.auc, l.logloss FROM
    (SELECT model_id, sum(neg * (tp - pos / 2.0)) / (max(tp + fn) * max(fp + tn)) AS auc FROM mm GROUP BY model_id) a
  JOIN (SELECT model_id, {_LOGLOSS_SQL.format(s='score')} AS logloss FROM models GROUP BY model_id) l
    ON a.model_id = l.model_id) b""", _MODELS, _MM, scored=True))
def e14(spark, sf):
    board = ev.leaderboard(models_long(spark, sf))
    w = Window.orderBy(F.col("auc").desc(), F.col("model_id"))  # one row per model
    return board.select("model_id", F.round("auc", 3).alias("auc"), F.round("logloss", 4).alias("logloss"),
                        F.row_number().over(w).cast("int").alias("position"))


@query("e15_rates_long", with_ctes(
    """SELECT threshold, key, round(value, 6) AS value FROM (SELECT threshold, tnr, fnr, fpr, tpr FROM m)
UNPIVOT (value FOR key IN (tnr, fnr, fpr, tpr))""", _M, scored=True))
def e15(spark, sf):
    return ev.rates_long(_metrics(spark, sf)).withColumn("value", F.round("value", 6))


BINNED_K = 100
_BINNED_RATES = ["precision", "recall", "f1", "tnr", "fnr", "fpr", "tpr"]


@query("e01_metrics_by_threshold_binned", with_ctes(
    f"""SELECT threshold, tp, fp, N - fp AS tn, P - tp AS fn,
  round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(CASE WHEN precision + recall = 0 THEN NULL ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1,
  round((N - fp) / N, 6) AS tnr, round((P - tp) / P, 6) AS fnr, round(fp / N, 6) AS fpr, round(recall, 6) AS tpr
FROM (SELECT *, CASE WHEN tp + fp = 0 THEN NULL ELSE tp / (tp + fp) END AS precision, tp / P AS recall FROM (
  SELECT t.threshold, count(*) FILTER (WHERE s.Attrition = 'Yes' AND s.Yes >= t.threshold) AS tp,
    count(*) FILTER (WHERE s.Attrition <> 'Yes' AND s.Yes >= t.threshold) AS fp
  FROM (SELECT DISTINCT unnest(quantile_cont(Yes, [{", ".join(str(j / BINNED_K) for j in range(BINNED_K))}]))
          AS threshold FROM scored) t, scored s GROUP BY t.threshold) c,
  (SELECT count(*) FILTER (WHERE Attrition = 'Yes') AS P, count(*) FILTER (WHERE Attrition <> 'Yes') AS N
   FROM scored) tot) x""", scored=True))
def e01_binned(spark, sf):
    """E1 with at most BINNED_K thresholds at exact score quantiles (the
    bounded table for very large data; results differ from E1 by design)."""
    s = scored(spark, sf)
    m = ev.metrics_binned(s, ev.quantile_thresholds(s, "Yes", BINNED_K))
    return r6(m, _BINNED_RATES)


_MODEL_IDS = ["as_is", "no_overtime"]


@query("e14_dashboard_gain_lift", with_ctes(" UNION ALL ".join(
    f"""SELECT '{m}' AS model_id, "group", cases, responses,
  {", ".join(f"round({c}, 6) AS {c}" for c in _G12)} FROM ({_gains_sql(f"(SELECT * FROM models WHERE model_id = '{m}')", "score")}) g"""
    for m in _MODEL_IDS), _MODELS, scored=True))
def e14_gain(spark, sf):
    """gain/lift table of every model on the dashboard (one job per
    model; the model list is short and known)."""
    ml = models_long(spark, sf)
    parts = []
    for m in _MODEL_IDS:
        t = ev.gains_lift_table(ml.where(F.col("model_id") == m), score="score")
        parts.append(t.select(F.lit(m).alias("model_id"), F.col("group").cast("int").alias("group"),
                              "cases", "responses", *_G12))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return r6(out, _G12)
