"""K1-K6: the user-function surface, expressed the Spark way: table
functions over column names used with ``DataFrame.transform``, Column-returning
scalar functions (no Python UDF), comprehensions that build aggregates, and
``functools.partial`` for pre-filled arguments."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from ..functions.cost import attrition_cost
from ..operators import evaluate as ev
from ..operators import profile as pf
from ..operators import policy as pol
from ..operators.attrition import count_by, count_to_pct
from ..sources.people import people, scored
from .q_evaluation import MODELS_SQL, metrics_sql, models_long
from .q_policy import _BEST_OPT, _M, _OPT, _PRC, best_policy, money, prc_sql, savings_sql, staged_scored
from .q_relational import FREQ_COLUMNS, NUMERIC_ALL, _long_sql, skew_sql
from .registry import query
from .sql import cost_sql, with_ctes


@query("k01_table_function_transform", with_ctes(
    """SELECT OverTime, MaritalStatus, n, round(n / sum(n) OVER (PARTITION BY OverTime), 6) AS pct
FROM (SELECT OverTime, MaritalStatus, count(*) AS n FROM hr GROUP BY OverTime, MaritalStatus) t"""))
def k01(spark, sf):
    """K1: a table function with column-name arguments, chained by transform."""
    return (people(spark, sf)
            .transform(lambda d: count_by(d, "OverTime", "MaritalStatus"))
            .transform(lambda d: count_to_pct(d, "OverTime"))
            .withColumn("pct", F.round("pct", 6)))


@query("k02_scalar_column_function", with_ctes(
    f"""SELECT EmployeeNumber, round({cost_sql(salary='MonthlyIncome * 12', revenue='300000')}, 2) AS cost
FROM hr"""))
def k02(spark, sf):
    """K2: a vectorised scalar function is a Column expression (no UDF)."""
    cost = functools.partial(attrition_cost, net_revenue_per_employee=300000)
    return people(spark, sf).select("EmployeeNumber",
                                    F.round(cost(salary=F.col("MonthlyIncome") * 12), 2).alias("cost"))


@query("k03_per_column_function", with_ctes(
    f"""SELECT variable, round(max(share), 6) AS top_share FROM (
  SELECT variable, value, count(*) / sum(count(*)) OVER (PARTITION BY variable) AS share
  FROM ({_long_sql(FREQ_COLUMNS)}) l GROUP BY variable, value) s GROUP BY variable"""))
def k03(spark, sf):
    """K3: one anonymous function mapped over columns = one tall aggregate
    for all columns (the share of each column's most common value)."""
    freq = pf.frequency_table(people(spark, sf), FREQ_COLUMNS)
    return freq.groupBy("variable").agg(F.round(F.max("n") / F.sum("n"), 6).alias("top_share"))


@query("k04_per_row_table_function", with_ctes(
    "SELECT model_id, round(sum(neg * (tp - pos / 2.0)) / (max(tp + fn) * max(fp + tn)), 6) AS auc "
    "FROM mm GROUP BY model_id", ("models", MODELS_SQL), ("mm", metrics_sql("models", "score", "model_id")),
    scored=True))
def k04(spark, sf):
    """K4: a table function applied per model row = the same operator keyed
    by ``model_id`` (one job for all models instead of one per row)."""
    m = ev.metrics_by_threshold(models_long(spark, sf), score="score", by=["model_id"])
    return ev.auc(m, ["model_id"]).withColumn("auc", F.round("auc", 6))


_K05_SQL = " UNION ALL ".join(
    f"""SELECT {p}::DOUBLE AS avg_overtime_pct, {float(r)}::DOUBLE AS net_revenue_per_employee,
  round(savings, 2) AS savings FROM ({savings_sql("SELECT 'best' AS policy, threshold, tnr, fnr, fpr, tpr FROM best_opt",
                                                f"prc_{i}")}) s{i}"""
    for i, (p, r) in enumerate([(0.10, 250000), (0.20, 300000)]))


@query("k05_partial_arguments", with_ctes(_K05_SQL, _PRC, _M, _OPT, _BEST_OPT,
                                          ("prc_0", prc_sql(250000, 0.10)), ("prc_1", prc_sql(300000, 0.20)),
                                          scored=True))
def k05(spark, sf):
    """K5: ``partial`` pre-fills data and policy; the varied arguments are
    evaluated for all rows in one pass."""
    s = staged_scored(spark, sf)
    preloaded = functools.partial(pol.savings_for_policies, s, [best_policy(s)])
    parts = [preloaded(revenue=r, pct=p).select(F.lit(p).alias("avg_overtime_pct"),
                                                F.lit(float(r)).alias("net_revenue_per_employee"), "savings")
             for p, r in [(0.10, 250000), (0.20, 300000)]]
    return money(parts[0].unionByName(parts[1]))


@query("k06_aggregate_function_over_columns", with_ctes(skew_sql(NUMERIC_ALL)))
def k06(spark, sf):
    """K6: ``map_df(skewness)`` = one aggregate, one expression per column."""
    hr = people(spark, sf)
    row = hr.agg(*[F.skewness(F.col(c).cast("double")).alias(c) for c in NUMERIC_ALL])
    return row.unpivot([], NUMERIC_ALL, "variable", "skewness").withColumn("skewness", F.round("skewness", 6) + 0.0)
