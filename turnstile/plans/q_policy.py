"""Queries for expected value and policy optimisation (V1-V12), plus the
threshold x rows join (J7) they rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators import policy as pol
from ..operators.joins import stage_table
from ..sources.people import scored
from .q_evaluation import metrics_sql
from .q_relational import OVERTIME_PCTS, REVENUES, even_positions
from .registry import query
from .sql import cost_sql, with_ctes

PCT, REV = pol.DEFAULT_PCT, pol.DEFAULT_REVENUE
SAV = ["total_expected_attrition_cost_0", "total_expected_attrition_cost_1", "savings"]
RATE_COLS = ["tnr", "fnr", "fpr", "tpr"]


def money(df: DataFrame) -> DataFrame:
    out = df.withColumns({c: F.round(c, 2) for c in SAV if c in df.columns})
    if "pct_savings" in df.columns:
        out = out.withColumn("pct_savings", F.round("pct_savings", 6))
    return out.withColumns({c: F.round(c, 6) for c in RATE_COLS if c in df.columns})


def prc_sql(revenue=REV, pct=PCT) -> str:
    return f"""SELECT *, y0 * ac AS c0, y1 * ac * (1 + {pct} * ot) AS c1, (1 - y1) * {pct} * ot * ac AS c2 FROM (
  SELECT EmployeeNumber, OverTime, Yes AS y0, Yes_no_ot AS y1,
    {cost_sql(salary='MonthlyIncome * 12', revenue=str(revenue))} AS ac,
    CASE WHEN OverTime = 'Yes' THEN 1.0 ELSE 0.0 END AS ot FROM scored) r"""


_PRC = ("prc", prc_sql())
_M = ("m", metrics_sql())


def savings_sql(policies: str, prc: str = "prc") -> str:
    """Savings per policy row (policy, threshold, tnr, fnr, fpr, tpr)."""
    return f"""SELECT policy, threshold, tnr, fnr, fpr, tpr, s0 AS total_expected_attrition_cost_0,
  (tpr + fnr) * (s0 - f0) + (tpr + fnr) * f1 + (tnr + fpr) * f2 AS total_expected_attrition_cost_1,
  s0 - ((tpr + fnr) * (s0 - f0) + (tpr + fnr) * f1 + (tnr + fpr) * f2) AS savings,
  (s0 - ((tpr + fnr) * (s0 - f0) + (tpr + fnr) * f1 + (tnr + fpr) * f2)) / s0 AS pct_savings
FROM (SELECT p.policy, p.threshold, p.tnr, p.fnr, p.fpr, p.tpr,
        (SELECT sum(c0) FROM {prc}) AS s0,
        sum(CASE WHEN y0 >= p.threshold THEN c0 ELSE 0 END) AS f0,
        sum(CASE WHEN y0 >= p.threshold THEN c1 ELSE 0 END) AS f1,
        sum(CASE WHEN y0 >= p.threshold THEN c2 ELSE 0 END) AS f2
      FROM ({policies}) p, {prc} GROUP BY p.policy, p.threshold, p.tnr, p.fnr, p.fpr, p.tpr) s"""


def money_sql(cols: str, src: str) -> str:
    return f"""SELECT {cols}, round(total_expected_attrition_cost_0, 2) AS total_expected_attrition_cost_0,
  round(total_expected_attrition_cost_1, 2) AS total_expected_attrition_cost_1, round(savings, 2) AS savings,
  round(pct_savings, 6) AS pct_savings FROM ({src}) z"""


_R4 = "round(tnr, 6) AS tnr, round(fnr, 6) AS fnr, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr"
_BEST_F1 = "SELECT * FROM m ORDER BY f1 DESC, threshold DESC LIMIT 1"


def staged_scored(spark, sf) -> DataFrame:
    """The scored columns the optimisation reads, written once: the threshold
    search, the savings pass and the grid pass then read files instead of
    recomputing the people join."""
    cols = ["EmployeeNumber", "Attrition", "OverTime", "MonthlyIncome", "Yes", "Yes_no_ot"]
    return stage_table(scored(spark, sf).select(*cols), "scored")


def _max_f1_policy(s: DataFrame) -> pol.Policy:
    b = ev.max_metric_row(ev.metrics_by_threshold(s), "f1").first()  # one row
    return pol.Policy("max_f1", b["threshold"], b["tnr"], b["fpr"], b["fnr"], b["tpr"])


# ---------------------------------------------------------------- V1-V6

@query("v01_baseline_expected_cost", with_ctes(
    """SELECT EmployeeNumber, round(ac, 2) AS attrition_cost, 0.0::DOUBLE AS cost_of_policy_change,
  round(c0, 2) AS expected_attrition_cost FROM prc""", _PRC, scored=True))
def v01(spark, sf):
    b = pol.baseline_costs(scored(spark, sf))
    return b.withColumns({c: F.round(c, 2) for c in ["attrition_cost", "expected_attrition_cost"]})


@query("v02_blanket_counterfactual", with_ctes(
    """SELECT EmployeeNumber, OverTime AS OverTime_0, 'No' AS OverTime_1, Yes AS Yes_0, Yes_no_ot AS Yes_1
FROM scored""", scored=True))
def v02(spark, sf):
    return pol.counterfactual(scored(spark, sf), 0.0)


@query("v03_policy_cost", with_ctes(
    f"""SELECT EmployeeNumber, OverTime AS OverTime_0, 'No' AS OverTime_1, round(ac, 2) AS attrition_cost,
  round(CASE WHEN OverTime = 'Yes' THEN ac * {PCT} ELSE 0.0 END, 2) AS cost_of_policy_change FROM prc""",
    _PRC, scored=True))
def v03(spark, sf):
    c = pol.policy_costs(scored(spark, sf), 0.0)
    return c.withColumns({k: F.round(k, 2) for k in ["attrition_cost", "cost_of_policy_change"]})


@query("v04_savings_no_overtime", with_ctes(money_sql("policy", savings_sql(
    "SELECT 'no_overtime' AS policy, 0.0::DOUBLE AS threshold, 0.0::DOUBLE AS tnr, 0.0::DOUBLE AS fnr, "
    "1.0::DOUBLE AS fpr, 1.0::DOUBLE AS tpr")), _PRC, scored=True))
def v04(spark, sf):
    t = pol.savings_for_policies(scored(spark, sf), [pol.Policy("no_overtime", 0.0)])
    return money(t.select("policy", *SAV, "pct_savings"))


@query("v05_targeted_counterfactual", with_ctes(
    f"""SELECT EmployeeNumber, OverTime AS OverTime_0,
  CASE WHEN Yes >= (SELECT threshold FROM best) THEN 'No' ELSE OverTime END AS OverTime_1, Yes AS Yes_0,
  CASE WHEN Yes >= (SELECT threshold FROM best) THEN Yes_no_ot ELSE Yes END AS Yes_1 FROM scored""",
    _M, ("best", _BEST_F1), scored=True))
def v05(spark, sf):
    s = scored(spark, sf)
    return pol.counterfactual(s, _max_f1_policy(s).threshold)


@query("v06_expected_cost_with_rates", with_ctes(
    f"""SELECT EmployeeNumber, round(yes1 * (b.tpr * (ac + pc) + b.fnr * (ac + pc))
  + (1 - yes1) * (b.tnr * pc + b.fpr * pc), 2) AS expected_attrition_cost FROM (
  SELECT EmployeeNumber, ac, CASE WHEN y0 >= (SELECT threshold FROM best) THEN y1 ELSE y0 END AS yes1,
    CASE WHEN y0 >= (SELECT threshold FROM best) AND ot = 1.0 THEN ac * {PCT} ELSE 0.0 END AS pc FROM prc) x,
  best b""", _PRC, _M, ("best", _BEST_F1), scored=True))
def v06(spark, sf):
    s = scored(spark, sf)
    e = pol.expected_costs_with_rates(s, _max_f1_policy(s))
    return e.withColumn("expected_attrition_cost", F.round("expected_attrition_cost", 2))


# ---------------------------------------------------------------- V7-V12

@query("v07_savings_all_thresholds", with_ctes(
    f"""SELECT threshold, {_R4}, round(s0, 2) AS total_expected_attrition_cost_0,
  round(t1, 2) AS total_expected_attrition_cost_1, round(s0 - t1, 2) AS savings,
  round((s0 - t1) / s0, 6) AS pct_savings FROM (
  SELECT c.threshold, m.tnr, m.fnr, m.fpr, m.tpr, s0,
    (m.tpr + m.fnr) * (s0 - cf0) + (m.tpr + m.fnr) * cf1 + (m.tnr + m.fpr) * cf2 AS t1 FROM (
    SELECT threshold, sum(c0) OVER w AS cf0, sum(c1) OVER w AS cf1, sum(c2) OVER w AS cf2 FROM (
      SELECT y0 AS threshold, sum(c0) AS c0, sum(c1) AS c1, sum(c2) AS c2 FROM prc GROUP BY y0) g
    WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)) c
  JOIN m ON c.threshold = m.threshold, (SELECT sum(c0) AS s0 FROM prc) t) x""", _PRC, _M, scored=True))
def v07(spark, sf):
    return money(pol.savings_all_thresholds(scored(spark, sf)))


@query("v08_named_policies", with_ctes(money_sql("policy, threshold, " + _R4, savings_sql(
    """SELECT 'no_overtime' AS policy, 0.0::DOUBLE AS threshold, 0.0::DOUBLE AS tnr, 0.0::DOUBLE AS fnr,
      1.0::DOUBLE AS fpr, 1.0::DOUBLE AS tpr
    UNION ALL SELECT 'do_nothing', 1.0, 1.0, 1.0, 0.0, 0.0
    UNION ALL SELECT 'max_f1', threshold, tnr, fnr, fpr, tpr FROM best""")),
    _PRC, _M, ("best", _BEST_F1), scored=True))
def v08(spark, sf):
    s = scored(spark, sf)
    policies = [pol.Policy("no_overtime", 0.0, tnr=0, fpr=1, fnr=0, tpr=1),
                pol.Policy("do_nothing", 1.0, tnr=1, fpr=0, fnr=1, tpr=0),
                _max_f1_policy(s)]
    return money(pol.savings_for_policies(s, policies))


SAMPLE_SIZE = 20

_SAMPLED_SQL = f"""SELECT 'sampled' AS policy, threshold, tnr, fnr, fpr, tpr FROM (
  SELECT *, row_number() OVER (ORDER BY threshold DESC) AS sample_pos FROM m) r
WHERE sample_pos IN (SELECT DISTINCT CAST(round_even(1 + i * ((SELECT count(*) FROM m) - 1) / {SAMPLE_SIZE - 1}.0, 0) AS BIGINT)
              FROM range({SAMPLE_SIZE}) g(i))"""
_OPT = ("opt", savings_sql(_SAMPLED_SQL))
_BEST_OPT = ("best_opt", "SELECT * FROM opt ORDER BY savings DESC, threshold DESC LIMIT 1")


def sampled_policies(s: DataFrame) -> list[pol.Policy]:
    """O6 + V9: evenly spaced rows of the rates table (threshold descending)."""
    n = s.select("Yes").distinct().count()  # rows of the rates table
    m = ev.metrics_by_threshold(s, with_rank=True)
    rows = (m.where(F.col("threshold_rank").isin(even_positions(n, SAMPLE_SIZE)))
            .select("threshold", *RATE_COLS).collect())  # <= 20 rows
    return [pol.Policy("sampled", r["threshold"], r["tnr"], r["fpr"], r["fnr"], r["tpr"]) for r in rows]


def optimisation_table(s: DataFrame) -> DataFrame:
    return pol.savings_for_policies(s, sampled_policies(s))


def best_policy(s: DataFrame) -> pol.Policy:
    b = pol.best_row(optimisation_table(s)).first()
    return pol.Policy("best", b["threshold"], b["tnr"], b["fpr"], b["fnr"], b["tpr"])


@query("v09_threshold_optimisation", with_ctes(
    f"SELECT threshold, {_R4}, round(savings, 2) AS savings FROM opt", _PRC, _M, _OPT, scored=True))
def v09(spark, sf):
    t = optimisation_table(staged_scored(spark, sf))
    return money(t.select("threshold", *RATE_COLS, "savings"))


@query("v09_best_threshold", with_ctes(
    f"SELECT threshold, {_R4}, round(savings, 2) AS savings FROM best_opt", _PRC, _M, _OPT, _BEST_OPT,
    scored=True))
def v09_best(spark, sf):
    b = pol.best_row(optimisation_table(staged_scored(spark, sf)))
    return money(b.select("threshold", *RATE_COLS, "savings"))


@query("v10_annotated_optimisation", with_ctes(
    f"""SELECT threshold, round(savings, 2) AS savings,
  savings = max(savings) OVER () AS is_best, threshold = min(threshold) OVER () AS is_min_threshold,
  threshold = max(threshold) OVER () AS is_max_threshold,
  threshold = (SELECT threshold FROM best) AS is_max_f1 FROM opt""",
    _PRC, _M, _OPT, ("best", _BEST_F1), scored=True))
def v10(spark, sf):
    s = staged_scored(spark, sf)
    t = optimisation_table(s)
    f1_t = _max_f1_policy(s).threshold
    w = Window.partitionBy()  # the table has at most SAMPLE_SIZE rows
    return t.select("threshold", F.round("savings", 2).alias("savings"),
                    (F.col("savings") == F.max("savings").over(w)).alias("is_best"),
                    (F.col("threshold") == F.min("threshold").over(w)).alias("is_min_threshold"),
                    (F.col("threshold") == F.max("threshold").over(w)).alias("is_max_threshold"),
                    (F.col("threshold") == F.lit(f1_t)).alias("is_max_f1"))


@query("v11_savings_with_parameters", with_ctes(money_sql("threshold", savings_sql(
    "SELECT 'best' AS policy, threshold, tnr, fnr, fpr, tpr FROM best_opt", "prc2")),
    _PRC, _M, _OPT, _BEST_OPT, ("prc2", prc_sql(300000, 0.20)), scored=True))
def v11(spark, sf):
    s = staged_scored(spark, sf)
    t = pol.savings_for_policies(s, [best_policy(s)], revenue=300000, pct=0.20)
    return money(t.select("threshold", *SAV, "pct_savings"))


def _grid_sql() -> str:
    k = "((40 + 60 * 0.5) / 240.0)"
    a0 = "(CAST(18900 AS DOUBLE) - MonthlyIncome * 12 / 240.0 * 40)"
    hit = "Yes >= (SELECT threshold FROM best_opt)"
    fs = lambda x: f"sum(CASE WHEN {hit} THEN {x} ELSE 0.0 END)"
    ot = "(CASE WHEN OverTime = 'Yes' THEN 1.0 ELSE 0.0 END)"
    grid = ", ".join(f"({p}::DOUBLE, {float(r)}::DOUBLE)" for p in OVERTIME_PCTS for r in REVENUES)
    return f"""SELECT avg_overtime_pct, net_revenue_per_employee,
  round(t0, 2) AS total_expected_attrition_cost_0, round(t1, 2) AS total_expected_attrition_cost_1,
  round(t0 - t1, 2) AS savings, round((t0 - t1) / t0, 6) AS pct_savings FROM (
  SELECT avg_overtime_pct, net_revenue_per_employee, t0,
    a * (t0 - f0) + a * f1 + b * f2 AS t1 FROM (
    SELECT g.avg_overtime_pct, g.net_revenue_per_employee, bo.tpr + bo.fnr AS a, bo.tnr + bo.fpr AS b,
      s_y0a + net_revenue_per_employee * {k} * s_y0 AS t0,
      f_y0a + net_revenue_per_employee * {k} * f_y0 AS f0,
      f_y1a + net_revenue_per_employee * {k} * f_y1 + avg_overtime_pct * (f_y1oa + net_revenue_per_employee * {k} * f_y1o) AS f1,
      avg_overtime_pct * (f_noa + net_revenue_per_employee * {k} * f_no) AS f2
    FROM (SELECT sum(Yes * {a0}) AS s_y0a, sum(Yes) AS s_y0, {fs(f'Yes * {a0}')} AS f_y0a, {fs('Yes')} AS f_y0,
            {fs(f'Yes_no_ot * {a0}')} AS f_y1a, {fs('Yes_no_ot')} AS f_y1,
            {fs(f'Yes_no_ot * {ot} * {a0}')} AS f_y1oa, {fs(f'Yes_no_ot * {ot}')} AS f_y1o,
            {fs(f'(1 - Yes_no_ot) * {ot} * {a0}')} AS f_noa, {fs(f'(1 - Yes_no_ot) * {ot}')} AS f_no FROM scored) s,
      best_opt bo, (VALUES {grid}) g(avg_overtime_pct, net_revenue_per_employee)) x) y"""


@query("v12_sensitivity_grid", with_ctes(_grid_sql(), _PRC, _M, _OPT, _BEST_OPT, scored=True))
def v12(spark, sf):
    s = staged_scored(spark, sf)
    g = pol.sensitivity_grid(s, best_policy(s), OVERTIME_PCTS, REVENUES)
    return money(g)


@query("j07_threshold_cross", with_ctes(
    f"SELECT threshold, {_R4}, round(savings, 2) AS savings FROM opt", _PRC, _M, _OPT, scored=True))
def j07(spark, sf):
    """The threshold table x employee rows, expressed as one aggregate
    with a conditional sum per threshold (no cross join)."""
    return v09(spark, sf)


def _binned_sql(k: int) -> str:
    probs = ", ".join(str(j / k) for j in range(k))
    return f"""SELECT t.threshold, (SELECT sum(c0) FROM prc) AS s0,
    sum(CASE WHEN y0 >= t.threshold THEN c0 ELSE 0 END) AS f0,
    sum(CASE WHEN y0 >= t.threshold THEN c1 ELSE 0 END) AS f1,
    sum(CASE WHEN y0 >= t.threshold THEN c2 ELSE 0 END) AS f2,
    count(*) FILTER (WHERE y0 >= t.threshold AND Attrition = 'Yes') AS tp,
    count(*) FILTER (WHERE y0 >= t.threshold AND Attrition <> 'Yes') AS fp
  FROM (SELECT DISTINCT unnest(quantile_cont(Yes, [{probs}])) AS threshold FROM scored) t,
       (SELECT p.*, s.Attrition FROM prc p JOIN scored s USING (EmployeeNumber)) x
  GROUP BY t.threshold"""


@query("v07_savings_binned_thresholds", with_ctes(
    f"""SELECT threshold, {_R4}, round(s0, 2) AS total_expected_attrition_cost_0,
  round(t1, 2) AS total_expected_attrition_cost_1, round(s0 - t1, 2) AS savings,
  round((s0 - t1) / s0, 6) AS pct_savings FROM (
  SELECT threshold, tnr, fnr, fpr, tpr, s0, (tpr + fnr) * (s0 - f0) + (tpr + fnr) * f1 + (tnr + fpr) * f2 AS t1
  FROM (SELECT b.*, (N - fp) / N AS tnr, (P - tp) / P AS fnr, fp / N AS fpr, tp / P AS tpr FROM bins b,
          (SELECT count(*) FILTER (WHERE Attrition = 'Yes') AS P, count(*) FILTER (WHERE Attrition <> 'Yes') AS N
           FROM scored) tot) r) x""", _PRC, ("bins", _binned_sql(100)), scored=True))
def v07_binned(spark, sf):
    """V7 at the same bounded threshold set as the binned metrics table."""
    s = staged_scored(spark, sf)
    ts = ev.quantile_thresholds(s, "Yes", 100)
    return money(pol.savings_binned(s, ev.metrics_binned(s, ts), ts))
