"""Queries for the relational families: sources/sinks (S), projection and
predicates (P), joins (J), aggregation (A), windows (W), sorts (O), set
operations (U), reshaping (R) and scalar functions (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import categories as cat
from ..functions import columns as cols
from ..functions.cost import attrition_cost
from ..functions.labels import dollar_label, replace_first, split_piece, str_c
from ..operators import ordered as od
from ..operators import profile as pf
from ..operators.attrition import count_by, count_to_pct
from ..operators.correlation import target_correlation
from ..operators.joins import broadcast_if_small
from ..operators.readable import (DEFINITION_LABELS, SHEET_SCHEMA, definitions_sheet,
                                  parse_definitions, process_readable)
from ..session import scratch_path
from ..sources.people import people, scored
from ..sources.tables import read_table
from .q_domain import _WORKFLOW_SQL, flagship
from .registry import query
from .sql import cost_sql, with_ctes

# ---------------------------------------------------------------- SQL pieces

_LABEL_VALUES = ", ".join(f"({b}, '{c}', {i + 1}, '{lab}')" for b, (c, labs) in enumerate(DEFINITION_LABELS)
                          for i, lab in enumerate(labs))
_CODED = [c for c, _ in DEFINITION_LABELS]
SHEET_SQL = f"""SELECT * FROM (
  WITH present AS (SELECT DISTINCT column_name, code FROM (
      {" UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS INT) AS code FROM hr" for c in _CODED)}) u),
  labels(block, column_name, code, label) AS (VALUES {_LABEL_VALUES}),
  lab AS (SELECT l.* FROM present p JOIN labels l ON p.column_name = l.column_name AND p.code = l.code),
  firsts AS (SELECT block, min(code) AS f FROM lab GROUP BY block)
  SELECT CAST(lab.block * 100 + code AS INT) AS row_id,
         CASE WHEN code = f THEN column_name END AS c1,
         CAST(code AS VARCHAR) || ' ''' || label || '''' AS c2
  FROM lab JOIN firsts ON lab.block = firsts.block
  UNION ALL SELECT CAST(block * 100 + 99 AS INT), NULL, NULL FROM firsts) s"""

DEFS_SQL = """SELECT column_name, key, value,
  CAST(row_number() OVER (PARTITION BY column_name ORDER BY row_id) AS INT) AS level_order
FROM (SELECT row_id, column_name, TRY_CAST(split_part(c2, ' ''', 1) AS DOUBLE) AS key,
             regexp_replace(split_part(c2, ' ''', 2), '''', '') AS value
      FROM (SELECT row_id, c2, last_value(c1 IGNORE NULLS) OVER (ORDER BY row_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS column_name FROM sheet) f
      WHERE c2 IS NOT NULL) p"""

_SHEET = ("sheet", SHEET_SQL)
_DEFS = ("defs", DEFS_SQL)


def _hr(spark, sf):
    return people(spark, sf)


# ---------------------------------------------------------------- S: sources and sinks

@query("s01_typed_scan", with_ctes("SELECT * FROM hr"))
def s01(spark, sf):
    return _hr(spark, sf)


@query("s02_headerless_scan", with_ctes("SELECT * FROM sheet", _SHEET))
def s02(spark, sf):
    path = scratch_path(spark, "sheet")
    definitions_sheet(_hr(spark, sf)).write.mode("overwrite").option("header", False).csv(path)
    return spark.read.schema(SHEET_SCHEMA).option("header", False).csv(path)


_WF_SCHEMA = ("Department string, JobRole string, Attrition string, n long, pct double, "
              "above_industry_avg string, cost_of_attrition double")


@query("s03_csv_sink", with_ctes(
    f"""SELECT Department, JobRole, Attrition, n, round(pct, 6) AS pct, above_industry_avg,
  round(cost_of_attrition, 2) AS cost_of_attrition FROM ({_WORKFLOW_SQL}) w"""))
def s03(spark, sf):
    path = scratch_path(spark, "csv")
    flagship(spark, sf).write.mode("overwrite").option("header", True).csv(path)
    return spark.read.schema(_WF_SCHEMA).option("header", True).csv(path)


@query("s04_parquet_persist", with_ctes("SELECT * FROM scored", scored=True))
def s04(spark, sf):
    path = scratch_path(spark, "persist")
    scored(spark, sf).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


# ---------------------------------------------------------------- P: projection / predicates

@query("p01_select", with_ctes("SELECT EmployeeNumber, Department, JobRole, Attrition FROM hr"))
def p01(spark, sf):
    return _hr(spark, sf).select("EmployeeNumber", "Department", "JobRole", "Attrition")


@query("p02_drop_columns", with_ctes("SELECT * EXCLUDE (EmployeeCount, StandardHours, Over18) FROM hr"))
def p02(spark, sf):
    return _hr(spark, sf).drop("EmployeeCount", "StandardHours", "Over18")


@query("p03_select_by_fragment", with_ctes(
    "SELECT JobRole, JobLevel, JobInvolvement, JobSatisfaction FROM hr"))
def p03(spark, sf):
    return cols.select_contains(_hr(spark, sf), "job")


@query("p04_drop_by_fragment", with_ctes(
    "SELECT * EXCLUDE (YearsAtCompany, TotalWorkingYears, YearsInCurrentRole) FROM hr"))
def p04(spark, sf):
    return cols.drop_contains(_hr(spark, sf), "years")


@query("p05_move_first", with_ctes("SELECT Attrition, * EXCLUDE (Attrition) FROM hr"))
def p05(spark, sf):
    return cols.move_first(_hr(spark, sf), "Attrition")


@query("p06_column_range", with_ctes("SELECT Age, DistanceFromHome, MonthlyIncome FROM hr"))
def p06(spark, sf):
    hr = _hr(spark, sf)
    return hr.select(*cols.column_range(hr, "Age", "MonthlyIncome"))


@query("p07_select_by_type", with_ctes(
    "SELECT Attrition, Department, JobRole, OverTime, BusinessTravel, MaritalStatus, EducationField, Over18 FROM hr"))
def p07(spark, sf):
    hr = _hr(spark, sf)
    return hr.select(*cols.columns_of_type(hr, "string"))


@query("p08_select_from_names", with_ctes("SELECT EmployeeNumber, MonthlyIncome, OverTime FROM hr"))
def p08(spark, sf):
    return cols.all_of(_hr(spark, sf), ["EmployeeNumber", "MonthlyIncome", "OverTime"])


@query("p09_sort_columns", with_ctes("SELECT * FROM hr"))
def p09(spark, sf):
    return cols.sort_columns(_hr(spark, sf))


@query("p10_rename", with_ctes(
    """SELECT EmployeeNumber AS employee_id, JobSatisfaction AS JobSat,
  EnvironmentSatisfaction AS EnvironmentSat FROM hr"""))
def p10(spark, sf):
    hr = _hr(spark, sf).select("EmployeeNumber", "JobSatisfaction", "EnvironmentSatisfaction")
    return cols.rename_pattern(hr, "Satisfaction", "Sat").withColumnRenamed("EmployeeNumber", "employee_id")


@query("p11_mutate", with_ctes(
    """SELECT EmployeeNumber, MonthlyIncome * 12 AS salary,
  round(CASE WHEN TotalWorkingYears = 0 THEN NULL ELSE YearsAtCompany / TotalWorkingYears END, 6) AS tenure_share
FROM hr"""))
def p11(spark, sf):
    hr = _hr(spark, sf)
    return hr.select("EmployeeNumber", (F.col("MonthlyIncome") * 12).alias("salary"),
                     F.round(F.try_divide(F.col("YearsAtCompany"), F.col("TotalWorkingYears")), 6)
                     .alias("tenure_share"))


@query("p12_mutate_if", with_ctes(
    """SELECT EmployeeNumber, upper(Attrition) AS Attrition, upper(Department) AS Department,
  upper(JobRole) AS JobRole, upper(OverTime) AS OverTime, upper(BusinessTravel) AS BusinessTravel,
  upper(MaritalStatus) AS MaritalStatus, upper(EducationField) AS EducationField, upper(Over18) AS Over18
FROM hr"""))
def p12(spark, sf):
    hr = _hr(spark, sf)
    hr = hr.select("EmployeeNumber", *cols.columns_of_type(hr, "string"))
    return cols.mutate_if(hr, "string", F.upper)


@query("p13_filter_compare", with_ctes(
    "SELECT * FROM hr WHERE Age >= 40 AND abs(MonthlyIncome - 6000) < 2000"))
def p13(spark, sf):
    return _hr(spark, sf).where((F.col("Age") >= 40) & (F.abs(F.col("MonthlyIncome") - 6000) < 2000))


@query("p14_membership", with_ctes(
    """SELECT * FROM hr WHERE Department IN ('AMERICA', 'EUROPE')
  AND NOT coalesce(JobRole IN ('FRANCE', 'GERMANY'), false)"""))
def p14(spark, sf):
    hr = _hr(spark, sf)
    keep = F.col("Department").isin("AMERICA", "EUROPE")
    not_in = ~F.coalesce(F.col("JobRole").isin("FRANCE", "GERMANY"), F.lit(False))
    return hr.where(keep & not_in)


@query("p15_null_filter", with_ctes(
    """SELECT EmployeeNumber, YearsAtCompany / YearsInCurrentRole AS ratio FROM hr
WHERE YearsInCurrentRole <> 0"""))
def p15(spark, sf):
    hr = _hr(spark, sf).select(
        "EmployeeNumber", F.try_divide(F.col("YearsAtCompany"), F.col("YearsInCurrentRole")).alias("ratio"))
    return hr.where(F.col("ratio").isNotNull())


@query("p16_pattern_filter", with_ctes(
    "SELECT EmployeeNumber, JobRole FROM hr WHERE regexp_matches(JobRole, 'A.*N')"))
def p16(spark, sf):
    return _hr(spark, sf).select("EmployeeNumber", "JobRole").where(F.col("JobRole").rlike("A.*N"))


_AGE_BAND_SQL = "CASE WHEN Age < 30 THEN 'young' WHEN Age < 45 THEN 'mid' ELSE 'senior' END"


def _age_band():
    return F.when(F.col("Age") < 30, "young").when(F.col("Age") < 45, "mid").otherwise("senior")


@query("p17_case_when", with_ctes(
    f"""SELECT EmployeeNumber, {_AGE_BAND_SQL} AS age_band,
  CASE WHEN OverTime = 'Yes' THEN 1 ELSE 0 END AS overtime_flag FROM hr"""))
def p17(spark, sf):
    return _hr(spark, sf).select("EmployeeNumber", _age_band().alias("age_band"),
                                 F.when(F.col("OverTime") == "Yes", 1).otherwise(0).alias("overtime_flag"))


@query("p18_pull_scalar", with_ctes(
    """SELECT Department, count(*) AS n FROM hr
WHERE MonthlyIncome > (SELECT quantile_cont(MonthlyIncome, 0.5) FROM hr) GROUP BY Department"""))
def p18(spark, sf):
    hr = _hr(spark, sf)
    median = od.exact_quantiles(hr, "MonthlyIncome", [0.5]).first()["quantile"]  # one scalar
    return count_by(hr.where(F.col("MonthlyIncome") > F.lit(median)), "Department")


@query("p19_distinct", with_ctes("SELECT DISTINCT Department, JobRole FROM hr"))
def p19(spark, sf):
    return _hr(spark, sf).select("Department", "JobRole").distinct()


@query("p20_slice_top_k", with_ctes(
    "SELECT EmployeeNumber, MonthlyIncome FROM hr ORDER BY MonthlyIncome DESC, EmployeeNumber LIMIT 10"))
def p20(spark, sf):
    return (_hr(spark, sf).select("EmployeeNumber", "MonthlyIncome")
            .orderBy(F.col("MonthlyIncome").desc(), "EmployeeNumber").limit(10))


@query("p21_row_number", with_ctes(
    """SELECT EmployeeNumber, MonthlyIncome,
  row_number() OVER (ORDER BY MonthlyIncome DESC, EmployeeNumber) AS rowname FROM hr"""))
def p21(spark, sf):
    hr = _hr(spark, sf).select("EmployeeNumber", "MonthlyIncome")
    return od.row_number(hr, [F.col("MonthlyIncome").desc(), F.col("EmployeeNumber").asc()], out="rowname")


# ---------------------------------------------------------------- J: joins

@query("j01_left_join", with_ctes(
    """SELECT h.EmployeeNumber, h.JobSatisfaction, d.value AS JobSatisfaction_value
FROM hr h LEFT JOIN (SELECT key, value FROM defs WHERE column_name = 'JobSatisfaction') d
  ON CAST(h.JobSatisfaction AS DOUBLE) = d.key""", _SHEET, _DEFS))
def j01(spark, sf):
    hr = _hr(spark, sf)
    defs = parse_definitions(definitions_sheet(hr))
    lk = (defs.where(F.col("column_name") == "JobSatisfaction")
          .select(F.col("key").alias("_key"), F.col("value").alias("JobSatisfaction_value")))
    base = hr.select("EmployeeNumber", "JobSatisfaction")
    return (base.join(broadcast_if_small(lk), F.col("JobSatisfaction").cast("double") == F.col("_key"), "left")
            .drop("_key"))


def _fold_sql(select_cols: str) -> str:
    joins = "\n".join(
        f"LEFT JOIN (SELECT key, value FROM defs WHERE column_name = '{c}') d_{c} "
        f"ON CAST(h.{c} AS DOUBLE) = d_{c}.key" for c in sorted(_CODED))
    return f"SELECT {select_cols} FROM hr h\n{joins}"


@query("j02_fold_left_joins", with_ctes(
    _fold_sql("h.EmployeeNumber, " + ", ".join(f"d_{c}.value AS {c}" for c in sorted(_CODED))),
    _SHEET, _DEFS))
def j02(spark, sf):
    hr = _hr(spark, sf).select("EmployeeNumber", *_CODED)
    data, _ = process_readable(hr, parse_definitions(definitions_sheet(_hr(spark, sf))))
    return data


@query("j03_bind_predictions", with_ctes(
    "SELECT EmployeeNumber, predict, No, Yes, MonthlyIncome, OverTime FROM scored", scored=True))
def j03(spark, sf):
    preds = scored(spark, sf).select("EmployeeNumber", "predict", "No", "Yes")
    ids = _hr(spark, sf).select("EmployeeNumber", "MonthlyIncome", "OverTime")
    return preds.join(ids, "EmployeeNumber")


J4_THRESHOLD = 0.25


@query("j04_before_after", with_ctes(
    f"""SELECT EmployeeNumber, OverTime AS OverTime_0,
  CASE WHEN Yes >= {J4_THRESHOLD} THEN 'No' ELSE OverTime END AS OverTime_1,
  Yes AS Yes_0, CASE WHEN Yes >= {J4_THRESHOLD} THEN Yes_no_ot ELSE Yes END AS Yes_1 FROM scored""",
    scored=True))
def j04(spark, sf):
    s = scored(spark, sf)
    flip = F.col("Yes") >= J4_THRESHOLD
    return s.select("EmployeeNumber", F.col("OverTime").alias("OverTime_0"),
                    F.when(flip, F.lit("No")).otherwise(F.col("OverTime")).alias("OverTime_1"),
                    F.col("Yes").alias("Yes_0"),
                    F.when(flip, F.col("Yes_no_ot")).otherwise(F.col("Yes")).alias("Yes_1"))


@query("j05_bind_totals", with_ctes(
    f"""SELECT round(sum(CASE WHEN Attrition = 'Yes' THEN {cost_sql(salary='MonthlyIncome * 12')} ELSE 0 END), 2)
         AS total_cost_of_leavers,
       round(sum(MonthlyIncome * 12), 2) AS total_salary FROM hr"""))
def j05(spark, sf):
    hr = _hr(spark, sf)
    cost = attrition_cost(salary=F.col("MonthlyIncome") * 12)
    return hr.agg(F.round(F.sum(F.when(F.col("Attrition") == "Yes", cost).otherwise(0)), 2)
                  .alias("total_cost_of_leavers"),
                  F.round(F.sum(F.col("MonthlyIncome") * 12), 2).alias("total_salary"))


# The sensitivity grid of the policy step.
OVERTIME_PCTS = [0.05, 0.10, 0.15, 0.20, 0.25, 0.30]
REVENUES = [200000, 250000, 300000, 350000, 400000]


def grid_columns():
    """J6 ``cross_df``: the grid as two generators in one row context."""
    return (F.explode(F.array(*[F.lit(p) for p in OVERTIME_PCTS])).alias("avg_overtime_pct"),
            F.explode(F.array(*[F.lit(r) for r in REVENUES])).alias("net_revenue_per_employee"))


_GRID_SQL = ("SELECT p AS avg_overtime_pct, r AS net_revenue_per_employee FROM "
             f"(VALUES {', '.join(f'({p})' for p in OVERTIME_PCTS)}) a(p), "
             f"(VALUES {', '.join(f'({r})' for r in REVENUES)}) b(r)")


@query("j06_cross_params", with_ctes(
    """SELECT Department, CAST(avg_overtime_pct AS DOUBLE) AS avg_overtime_pct,
  CAST(net_revenue_per_employee AS INT) AS net_revenue_per_employee,
  round(sy * (18900 + net_revenue_per_employee * 70 / 240.0) - 2 * sym
        + avg_overtime_pct * (cot * (18900 + net_revenue_per_employee * 70 / 240.0) - 2 * mot), 2) AS expected_cost
FROM (SELECT Department, sum(Yes) AS sy, sum(Yes * MonthlyIncome) AS sym,
             sum(CASE WHEN OverTime = 'Yes' THEN 1 ELSE 0 END) AS cot,
             sum(CASE WHEN OverTime = 'Yes' THEN MonthlyIncome ELSE 0 END) AS mot
      FROM scored GROUP BY Department) s, grid""", ("grid", _GRID_SQL), scored=True))
def j06(spark, sf):
    s = scored(spark, sf)
    ot = F.col("OverTime") == "Yes"
    sums = s.groupBy("Department").agg(
        F.sum("Yes").alias("sy"), F.sum(F.col("Yes") * F.col("MonthlyIncome")).alias("sym"),
        F.sum(F.when(ot, 1).otherwise(0)).alias("cot"),
        F.sum(F.when(ot, F.col("MonthlyIncome")).otherwise(0)).alias("mot"))
    pct_col, rev_col = grid_columns()
    g = sums.select("*", pct_col).select("*", rev_col)
    base = F.lit(18900) + F.col("net_revenue_per_employee") * 70 / F.lit(240.0)
    val = (F.col("sy") * base - 2 * F.col("sym")
           + F.col("avg_overtime_pct") * (F.col("cot") * base - 2 * F.col("mot")))
    return g.select("Department", F.col("avg_overtime_pct").cast("double").alias("avg_overtime_pct"),
                    F.col("net_revenue_per_employee").cast("int").alias("net_revenue_per_employee"),
                    F.round(val, 2).alias("expected_cost"))


# ---------------------------------------------------------------- A: aggregation

@query("a01_count_one_key", with_ctes("SELECT Department, count(*) AS n FROM hr GROUP BY Department"))
def a01(spark, sf):
    return count_by(_hr(spark, sf), "Department")


@query("a02_count_two_keys", with_ctes(
    "SELECT Department, JobRole, count(*) AS n FROM hr GROUP BY Department, JobRole"))
def a02(spark, sf):
    return count_by(_hr(spark, sf), "Department", "JobRole")


@query("a03_count_three_keys", with_ctes(
    "SELECT Department, JobRole, Attrition, count(*) AS n FROM hr GROUP BY Department, JobRole, Attrition"))
def a03(spark, sf):
    return count_by(_hr(spark, sf), "Department", "JobRole", "Attrition")


@query("a04_global_sum", with_ctes("SELECT round(sum(MonthlyIncome * 12), 2) AS total_salary FROM hr"))
def a04(spark, sf):
    return _hr(spark, sf).agg(F.round(F.sum(F.col("MonthlyIncome") * 12), 2).alias("total_salary"))


_A05_SQL = """SELECT Department, count(*) AS cases,
  CAST(sum(CASE WHEN Attrition = 'Yes' THEN 1 ELSE 0 END) AS BIGINT) AS responses FROM hr GROUP BY Department"""


@query("a05_conditional_count", with_ctes(_A05_SQL))
def a05(spark, sf):
    return _hr(spark, sf).groupBy("Department").agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(F.col("Attrition") == "Yes").alias("responses"))


@query("a06_grouped_mean", with_ctes(
    "SELECT JobRole, Attrition, round(avg(MonthlyIncome), 6) AS mean_income FROM hr GROUP BY JobRole, Attrition"))
def a06(spark, sf):
    return _hr(spark, sf).groupBy("JobRole", "Attrition").agg(
        F.round(F.avg("MonthlyIncome"), 6).alias("mean_income"))


CHARACTER_COLUMNS = ["Attrition", "Department", "JobRole", "OverTime", "BusinessTravel", "MaritalStatus", "EducationField", "Over18"]
#: All character columns, and two numbers that are categories.
FREQ_COLUMNS = [*CHARACTER_COLUMNS, "JobLevel", "JobSatisfaction"]


def _long_sql(columns, source="hr", value="CAST({c} AS VARCHAR)", ids=""):
    return " UNION ALL ".join(f"SELECT {ids}'{c}' AS variable, {value.format(c=c)} AS value FROM {source}"
                              for c in columns)


_FREQ_SQL = f"SELECT variable, value, count(*) AS n FROM ({_long_sql(FREQ_COLUMNS)}) l " \
            "WHERE value IS NOT NULL GROUP BY variable, value"


@query("a07_frequency_table", with_ctes(_FREQ_SQL))
def a07(spark, sf):
    return pf.frequency_table(_hr(spark, sf), FREQ_COLUMNS)


@query("a08_proportion_table", with_ctes(
    f"SELECT variable, value, n, round(n / sum(n) OVER (PARTITION BY variable), 6) AS prop FROM ({_FREQ_SQL}) f"))
def a08(spark, sf):
    return pf.proportion_table(_hr(spark, sf), FREQ_COLUMNS).withColumn("prop", F.round("prop", 6))


@query("a09_unique_values", with_ctes(f"SELECT DISTINCT variable, value FROM ({_long_sql(FREQ_COLUMNS)}) l"))
def a09(spark, sf):
    return pf.unique_values(_hr(spark, sf), FREQ_COLUMNS)


HR_ALL = ["EmployeeNumber", "Attrition", "Department", "JobRole", "OverTime", "BusinessTravel",
          "MaritalStatus", "EducationField", "Age", "DistanceFromHome", "MonthlyIncome", "JobLevel",
          "StockOptionLevel", "JobInvolvement", "JobSatisfaction", "EnvironmentSatisfaction",
          "WorkLifeBalance", "PerformanceRating", "YearsAtCompany", "TotalWorkingYears",
          "YearsInCurrentRole", "EmployeeCount", "StandardHours", "Over18"]
_DISTINCT_SQL = f"""SELECT variable, count(*) AS n_distinct FROM (SELECT DISTINCT variable, value FROM
  ({_long_sql(HR_ALL)}) l) d GROUP BY variable"""


@query("a10_distinct_counts", with_ctes(_DISTINCT_SQL))
def a10(spark, sf):
    return pf.distinct_counts(_hr(spark, sf), HR_ALL)


@query("a11_discrete_continuous", with_ctes(
    f"""SELECT variable, n_distinct, CASE WHEN n_distinct <= 10 THEN 'discrete' ELSE 'continuous' END AS kind
FROM ({_DISTINCT_SQL}) d"""))
def a11(spark, sf):
    return pf.discrete_continuous(_hr(spark, sf), HR_ALL)


NUMERIC_FEATURES = ["Age", "DistanceFromHome", "MonthlyIncome", "JobLevel", "StockOptionLevel",
                    "JobInvolvement", "JobSatisfaction", "EnvironmentSatisfaction", "WorkLifeBalance",
                    "PerformanceRating", "YearsAtCompany", "TotalWorkingYears", "YearsInCurrentRole"]
NUMERIC_ALL = ["EmployeeNumber", *NUMERIC_FEATURES, "EmployeeCount", "StandardHours"]


def skew_sql(columns, source="hr"):
    long = _long_sql(columns, source, value="CAST({c} AS DOUBLE)")
    return f"""SELECT variable, round(CASE WHEN m2 = 0 THEN NULL ELSE m3 / pow(m2, 1.5) END, 6) + 0.0 AS skewness FROM (
  SELECT l.variable, avg(pow(value - mu, 3)) AS m3, avg(pow(value - mu, 2)) AS m2
  FROM ({long}) l JOIN (SELECT variable, avg(value) AS mu FROM ({long}) z GROUP BY variable) m
    ON l.variable = m.variable GROUP BY l.variable) s"""


@query("a12_skewness", with_ctes(skew_sql(NUMERIC_ALL)))
def a12(spark, sf):
    return pf.skewness_table(_hr(spark, sf), NUMERIC_ALL).withColumn("skewness", F.round("skewness", 6) + 0.0)


def corr_sql(target_expr, features, source="hr", out="corr"):
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CASE WHEN var_samp(CAST({c} AS DOUBLE)) = 0 OR var_samp({target_expr}) = 0 "
        f"THEN NULL ELSE round(corr(CAST({c} AS DOUBLE), {target_expr}), 6) END AS {out} FROM {source}"
        for c in features)
    return parts


@query("a13_target_correlation", with_ctes(corr_sql(
    "CAST(CASE WHEN Attrition = 'Yes' THEN 2 ELSE 1 END AS DOUBLE)", NUMERIC_FEATURES + ["EmployeeCount"],
    out="Attrition")))
def a13(spark, sf):
    hr = _hr(spark, sf).withColumn("Attrition", F.when(F.col("Attrition") == "Yes", 2).otherwise(1))
    cor = target_correlation(hr, "Attrition", NUMERIC_FEATURES + ["EmployeeCount"])
    return cor.withColumn("Attrition", F.round("Attrition", 6))


def _profile_sql(columns):
    long = _long_sql(columns, value="CAST({c} AS DOUBLE)")
    return f"""SELECT m.variable, n, n_missing, round(mean, 6) AS mean, round(sd, 6) AS sd,
  round(p0, 6) AS p0, round(p25, 6) AS p25, round(p50, 6) AS p50, round(p75, 6) AS p75, round(p100, 6) AS p100,
  n_distinct FROM (
  SELECT variable, count(*) AS n, CAST(count(*) - count(value) AS BIGINT) AS n_missing, avg(value) AS mean,
    stddev_samp(value) AS sd, quantile_cont(value, 0.0) AS p0, quantile_cont(value, 0.25) AS p25,
    quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 1.0) AS p100
  FROM ({long}) l GROUP BY variable) m
  JOIN (SELECT variable, count(*) AS n_distinct FROM (SELECT DISTINCT variable, value FROM ({long}) z) d
        GROUP BY variable) d ON m.variable = d.variable"""


@query("a14_table_profile", with_ctes(_profile_sql(NUMERIC_ALL)))
def a14(spark, sf):
    p = pf.numeric_profile(_hr(spark, sf), NUMERIC_ALL)
    return p.select("variable", "n", "n_missing",
                    *[F.round(c, 6).alias(c) for c in ["mean", "sd", "p0", "p25", "p50", "p75", "p100"]],
                    "n_distinct")


_CHARACTER_SQL = f"""SELECT variable, count(*) AS n, CAST(count(*) - count(value) AS BIGINT) AS n_missing,
  CAST(sum(CASE WHEN value = '' THEN 1 ELSE 0 END) AS BIGINT) AS n_empty,
  CAST(sum(CASE WHEN trim(value) = '' AND value <> '' THEN 1 ELSE 0 END) AS BIGINT) AS n_blank,
  CAST(min(length(value)) AS INT) AS min_length, CAST(max(length(value)) AS INT) AS max_length,
  CAST(count(DISTINCT value) + CASE WHEN count(value) < count(*) THEN 1 ELSE 0 END AS BIGINT) AS n_distinct
FROM ({_long_sql(CHARACTER_COLUMNS)}) l GROUP BY variable"""


@query("a14_character_profile", with_ctes(_CHARACTER_SQL))
def a14_character(spark, sf):
    return pf.character_profile(_hr(spark, sf), CHARACTER_COLUMNS)


_RATIO_SQL = "CASE WHEN YearsInCurrentRole = 0 THEN NULL ELSE YearsAtCompany / YearsInCurrentRole END"


@query("a15_missing_share", with_ctes(
    f"""SELECT variable, round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END), 6) AS pct_missing,
  CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing FROM (
  SELECT 'ratio' AS variable, CAST({_RATIO_SQL} AS VARCHAR) AS value FROM hr UNION ALL {_long_sql(HR_ALL)}) l GROUP BY variable"""))
def a15(spark, sf):
    """All columns of the people view, and a ratio that has missing values."""
    hr = _hr(spark, sf).withColumn("ratio", F.try_divide(F.col("YearsAtCompany"), F.col("YearsInCurrentRole")))
    return pf.missing_share(hr, ["ratio", *HR_ALL]).withColumn("pct_missing", F.round("pct_missing", 6))


@query("a16_summary", with_ctes(
    f"""SELECT variable, stat, value FROM (
  SELECT variable, round(p0, 6) AS "Min", round(p25, 6) AS "1st Qu.", round(p50, 6) AS "Median",
    round(mean, 6) AS "Mean", round(p75, 6) AS "3rd Qu.", round(p100, 6) AS "Max"
  FROM ({_profile_sql(NUMERIC_ALL)}) p) UNPIVOT (value FOR stat IN
  ("Min", "1st Qu.", "Median", "Mean", "3rd Qu.", "Max"))"""))
def a16(spark, sf):
    p = pf.numeric_profile(_hr(spark, sf), NUMERIC_ALL)
    stats = {"Min": "p0", "1st Qu.": "p25", "Median": "p50", "Mean": "mean", "3rd Qu.": "p75", "Max": "p100"}
    pairs = [F.struct(F.lit(name).alias("stat"), F.round(src, 6).alias("value")) for name, src in stats.items()]
    return p.select("variable", F.explode(F.array(*pairs)).alias("s")).select("variable", "s.stat", "s.value")


@query("a16_level_counts", with_ctes(
    f"""SELECT variable, CASE WHEN k <= 6 THEN value ELSE '(Other)' END AS level, CAST(sum(n) AS BIGINT) AS n, CAST(least(min(k), 7) AS INT) AS position
FROM (SELECT variable, value, n, row_number() OVER (PARTITION BY variable ORDER BY n DESC, value) AS k
  FROM (SELECT variable, value, count(*) AS n FROM ({_long_sql(CHARACTER_COLUMNS)}) l WHERE value IS NOT NULL GROUP BY variable, value) f) r
GROUP BY variable, CASE WHEN k <= 6 THEN value ELSE '(Other)' END"""))
def a16_levels(spark, sf):
    """The category half of ``summary()``: the most frequent levels of every character column, and all others."""
    return pf.level_counts(_hr(spark, sf), CHARACTER_COLUMNS, k=6)


@query("a17_max_as_filter", with_ctes(
    """SELECT EmployeeNumber, YearsAtCompany FROM hr
WHERE YearsAtCompany = (SELECT max(YearsAtCompany) FROM hr)"""))
def a17(spark, sf):
    hr = _hr(spark, sf)
    top = hr.agg(F.max("YearsAtCompany")).first()[0]  # one scalar
    return hr.where(F.col("YearsAtCompany") == top).select("EmployeeNumber", "YearsAtCompany")


@query("a18_grouped_label_counts", with_ctes(
    f"SELECT age_band, count(*) AS n FROM (SELECT {_AGE_BAND_SQL} AS age_band FROM hr) t GROUP BY age_band"))
def a18(spark, sf):
    return count_by(_hr(spark, sf).select(_age_band().alias("age_band")), "age_band")


GLIMPSE_COLUMNS = HR_ALL
_DUCK_TYPES = {c: "string" if c in CHARACTER_COLUMNS else "int" for c in HR_ALL} | {"EmployeeNumber": "bigint", "MonthlyIncome": "double"}


@query("a19_glimpse", with_ctes(
    "SELECT variable, type, CAST(position AS INT) AS position, first_values FROM (VALUES " +
    ", ".join(f"('{c}', '{_DUCK_TYPES[c]}', {i + 1})" for i, c in enumerate(GLIMPSE_COLUMNS)) +
    ") m(variable, type, position) LEFT JOIN (SELECT variable, string_agg(value, ', ' ORDER BY o) AS first_values FROM (" +
    " UNION ALL ".join(
        f"SELECT '{c}' AS variable, EmployeeNumber AS o, "
        + (f"format('{{:,.2f}}', {c})" if _DUCK_TYPES[c] == "double" else f"CAST({c} AS VARCHAR)")
        + " AS value FROM (SELECT * FROM hr ORDER BY EmployeeNumber LIMIT 3) h" for c in GLIMPSE_COLUMNS)
    + ") v GROUP BY variable) f USING (variable)"))
def a19(spark, sf):
    return pf.glimpse(_hr(spark, sf).select(*GLIMPSE_COLUMNS), "EmployeeNumber", k=3)


# ---------------------------------------------------------------- W: windows

@query("w01_share_within_group", with_ctes(
    """SELECT Department, OverTime, n, round(n / sum(n) OVER (PARTITION BY Department), 6) AS pct
FROM (SELECT Department, OverTime, count(*) AS n FROM hr GROUP BY Department, OverTime) t"""))
def w01(spark, sf):
    c = count_by(_hr(spark, sf), "Department", "OverTime")
    return count_to_pct(c, "Department").withColumn("pct", F.round("pct", 6))


@query("w02_share_of_total", with_ctes(
    """SELECT JobRole, n, round(n / sum(n) OVER (), 6) AS pct
FROM (SELECT JobRole, count(*) AS n FROM hr GROUP BY JobRole) t"""))
def w02(spark, sf):
    return count_to_pct(count_by(_hr(spark, sf), "JobRole")).withColumn("pct", F.round("pct", 6))


@query("w03_running_sum", with_ctes(
    """SELECT EmployeeNumber, Department, round(sum(MonthlyIncome) OVER (PARTITION BY Department
  ORDER BY EmployeeNumber ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS cum_income FROM hr"""))
def w03(spark, sf):
    hr = _hr(spark, sf).select("EmployeeNumber", "Department", "MonthlyIncome")
    r = od.running_sum(hr, ["EmployeeNumber"], {"cum_income": "MonthlyIncome"}, ["Department"])
    return r.select("EmployeeNumber", "Department", F.round("cum_income", 2).alias("cum_income"))


@query("w04_whole_column_ratio", with_ctes(
    f"SELECT Department, responses, round(responses / sum(responses) OVER (), 6) AS pct_responses FROM ({_A05_SQL}) a"))
def w04(spark, sf):
    a = a05(spark, sf)
    return count_to_pct(a.select("Department", "responses"), col="responses", out="pct_responses") \
        .withColumn("pct_responses", F.round("pct_responses", 6))


@query("w05_row_number", with_ctes(
    """SELECT EmployeeNumber, Department, row_number() OVER (PARTITION BY Department
  ORDER BY MonthlyIncome DESC, EmployeeNumber) AS row_number FROM hr"""))
def w05(spark, sf):
    hr = _hr(spark, sf).select("EmployeeNumber", "Department", "MonthlyIncome")
    r = od.row_number(hr, [F.col("MonthlyIncome").desc(), F.col("EmployeeNumber").asc()], ["Department"])
    return r.select("EmployeeNumber", "Department", "row_number")


@query("w06_ntile", with_ctes(
    "SELECT EmployeeNumber, Yes, CAST(ntile(10) OVER (ORDER BY Yes, EmployeeNumber) AS INT) AS ntile FROM scored",
    scored=True))
def w06(spark, sf):
    s = scored(spark, sf).select("EmployeeNumber", "Yes")
    return od.ntile(s, 10, ["Yes", "EmployeeNumber"])


@query("w07_rank_average_ties", with_ctes(
    """SELECT EmployeeNumber, Department, YearsAtCompany,
  rank() OVER (PARTITION BY Department ORDER BY YearsAtCompany)
  + (count(*) OVER (PARTITION BY Department, YearsAtCompany) - 1) / 2.0 AS rank FROM hr"""))
def w07(spark, sf):
    hr = _hr(spark, sf).select("EmployeeNumber", "Department", "YearsAtCompany")
    return od.average_rank(hr, "YearsAtCompany", ["Department"])


@query("w08_argmax_ties", with_ctes(
    """SELECT h.EmployeeNumber, h.JobRole, h.YearsAtCompany FROM hr h
JOIN (SELECT JobRole, max(YearsAtCompany) AS mx FROM hr GROUP BY JobRole) m
  ON h.JobRole = m.JobRole AND h.YearsAtCompany = m.mx"""))
def w08(spark, sf):
    hr = _hr(spark, sf).select("EmployeeNumber", "JobRole", "YearsAtCompany")
    mx = hr.groupBy("JobRole").agg(F.max("YearsAtCompany").alias("YearsAtCompany"))
    return hr.join(mx, ["JobRole", "YearsAtCompany"])


@query("w09_fill_down", """SELECT o_orderkey AS row_id,
  CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS c1,
  last_value(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END IGNORE NULLS) OVER (
    ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM orders""")
def w09(spark, sf):
    o = read_table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("c1"))
    return od.fill_down(o, ["row_id"], {"filled": "c1"})


# ---------------------------------------------------------------- O: sorts and top-k

@query("o01_arrange", with_ctes("SELECT JobRole, count(*) AS n FROM hr GROUP BY JobRole ORDER BY n DESC"))
def o01(spark, sf):
    return count_by(_hr(spark, sf), "JobRole").orderBy(F.col("n").desc(), "JobRole")


@query("o02_top_k", with_ctes(
    "SELECT EmployeeNumber, Yes FROM scored ORDER BY Yes DESC, EmployeeNumber LIMIT 20", scored=True))
def o02(spark, sf):
    return (scored(spark, sf).select("EmployeeNumber", "Yes")
            .orderBy(F.col("Yes").desc(), "EmployeeNumber").limit(20))


def nth_row(df, n, order):
    """O3 ``slice(n)``: top-n read (TakeOrdered), then the n-th of those."""
    head = df.orderBy(*order).limit(n)
    return od.row_number(head, order, out="_pos", num_partitions=1).where(F.col("_pos") == n).drop("_pos")


@query("o03_nth_row", with_ctes(
    """SELECT EmployeeNumber, Yes FROM (SELECT EmployeeNumber, Yes, row_number() OVER
  (ORDER BY Yes DESC, EmployeeNumber) AS rn FROM scored) t WHERE rn = 3""", scored=True))
def o03(spark, sf):
    s = scored(spark, sf).select("EmployeeNumber", "Yes")
    return nth_row(s, 3, [F.col("Yes").desc(), F.col("EmployeeNumber").asc()])


@query("o04_sort_by_category", with_ctes(
    """SELECT d.value AS JobSatisfaction, d.level_order AS code, count(*) AS n
FROM hr h JOIN defs d ON d.column_name = 'JobSatisfaction' AND CAST(h.JobSatisfaction AS DOUBLE) = d.key
GROUP BY d.value, d.level_order ORDER BY code""", _SHEET, _DEFS))
def o04(spark, sf):
    hr = _hr(spark, sf)
    defs = parse_definitions(definitions_sheet(hr))
    lk = (defs.where(F.col("column_name") == "JobSatisfaction")
          .select(F.col("key"), F.col("value").alias("level"), F.col("level_order").alias("code")))
    c = (hr.select(F.col("JobSatisfaction").cast("double").alias("key")).groupBy("key")
         .agg(F.count(F.lit(1)).alias("n")))
    return (c.join(broadcast_if_small(lk), "key")
            .select(F.col("level").alias("JobSatisfaction"), "code", "n").orderBy("code"))


@query("o05_order_by_statistic", with_ctes(
    """SELECT JobRole, round(med, 6) AS median_income,
  CAST(row_number() OVER (ORDER BY med, JobRole) AS INT) AS code
FROM (SELECT JobRole, quantile_cont(MonthlyIncome, 0.5) AS med FROM hr GROUP BY JobRole) t"""))
def o05(spark, sf):
    hr = _hr(spark, sf)
    med = od.exact_quantiles(hr, "MonthlyIncome", [0.5], ["JobRole"], out="med")
    r = od.row_number(med, [F.col("med").asc(), F.col("JobRole").asc()], out="code")
    return r.select("JobRole", F.round("med", 6).alias("median_income"), F.col("code").cast("int").alias("code"))


def even_positions(n: int, k: int = 20) -> list[int]:
    """O6 ``round(seq(1, n, length.out = k))`` with R's half-even rounding."""
    if n <= 0:
        return []
    if k == 1:
        return [1]
    return sorted({int(round(1 + i * (n - 1) / (k - 1))) for i in range(k)})


@query("o06_even_sample", with_ctes(
    """SELECT EmployeeNumber, Yes FROM (SELECT EmployeeNumber, Yes, row_number() OVER
  (ORDER BY Yes DESC, EmployeeNumber) AS rn FROM scored) t
WHERE rn IN (SELECT DISTINCT CAST(round_even(1 + i * ((SELECT count(*) FROM scored) - 1) / 19.0, 0) AS BIGINT)
             FROM range(20) r(i))""", scored=True))
def o06(spark, sf):
    s = scored(spark, sf).select("EmployeeNumber", "Yes")
    n = s.count()
    ranked = od.row_number(s, [F.col("Yes").desc(), F.col("EmployeeNumber").asc()], out="_rn")
    return ranked.where(F.col("_rn").isin(even_positions(n))).drop("_rn")


# ---------------------------------------------------------------- U: set operations

@query("u01_setdiff_names", with_ctes("SELECT * EXCLUDE (Attrition) FROM hr"))
def u01(spark, sf):
    hr = _hr(spark, sf)
    return hr.select(*cols.setdiff(hr.columns, ["Attrition"]))


@query("u02_union_by_name", with_ctes(
    """SELECT 'as_is' AS model_id, EmployeeNumber, Yes AS score FROM scored
UNION ALL SELECT 'no_overtime' AS model_id, EmployeeNumber, Yes_no_ot AS score FROM scored""", scored=True))
def u02(spark, sf):
    s = scored(spark, sf)
    a = s.select(F.lit("as_is").alias("model_id"), "EmployeeNumber", F.col("Yes").alias("score"))
    b = s.select("EmployeeNumber", F.col("Yes_no_ot").alias("score"), F.lit("no_overtime").alias("model_id"))
    return a.unionByName(b)


# ---------------------------------------------------------------- R: reshape

@query("r01_gather_all", with_ctes(
    f"SELECT variable, value FROM ({_long_sql(NUMERIC_FEATURES, value='CAST({c} AS DOUBLE)')}) l"))
def r01(spark, sf):
    return pf.tall(_hr(spark, sf), NUMERIC_FEATURES, "double")


SURVEY = ["JobInvolvement", "JobSatisfaction", "EnvironmentSatisfaction", "WorkLifeBalance"]


@query("r02_gather_keep_ids", with_ctes(
    f"SELECT EmployeeNumber, variable, value FROM ({_long_sql(SURVEY, value='CAST({c} AS INT)', ids='EmployeeNumber, ')}) l"))
def r02(spark, sf):
    return pf.tall(_hr(spark, sf), SURVEY, "int", ids=["EmployeeNumber"])


@query("r03_pivot_longer", with_ctes(
    f"""SELECT Department, key, value FROM ({_A05_SQL}) a UNPIVOT (value FOR key IN (cases, responses))"""))
def r03(spark, sf):
    return a05(spark, sf).unpivot(["Department"], ["cases", "responses"], "key", "value")


@query("r04_separate", with_ctes(
    """SELECT EmployeeNumber, TRY_CAST(split_part(txt, ' ''', 1) AS DOUBLE) AS key,
  regexp_replace(split_part(txt, ' ''', 2), '''', '') AS value
FROM (SELECT EmployeeNumber, CAST(JobLevel AS VARCHAR) || ' ''' || JobRole || '''' AS txt FROM hr) t"""))
def r04(spark, sf):
    hr = _hr(spark, sf).select("EmployeeNumber", F.concat(F.col("JobLevel").cast("string"), F.lit(" '"),
                                                          F.col("JobRole"), F.lit("'")).alias("txt"))
    return hr.select("EmployeeNumber", F.expr("try_cast(split_part(txt, \" '\", 1) AS DOUBLE)").alias("key"),
                     replace_first(split_piece(F.col("txt"), " '", 2), "'", "").alias("value"))


@query("r05_first_piece", with_ctes(
    "SELECT split_part(BusinessTravel, '_', 1) AS travel_base, count(*) AS n FROM hr GROUP BY travel_base"))
def r05(spark, sf):
    hr = _hr(spark, sf).select(split_piece(F.col("BusinessTravel"), "_", 1).alias("travel_base"))
    return count_by(hr, "travel_base")


@query("r06_unnest", with_ctes(
    """SELECT EmployeeNumber, 'Yes' AS label, Yes AS prob FROM scored
UNION ALL SELECT EmployeeNumber, 'No' AS label, No AS prob FROM scored""", scored=True))
def r06(spark, sf):
    s = scored(spark, sf)
    arr = F.array(F.struct(F.lit("Yes").alias("label"), F.col("Yes").alias("prob")),
                  F.struct(F.lit("No").alias("label"), F.col("No").alias("prob")))
    return s.select("EmployeeNumber", F.explode(arr).alias("m")).select("EmployeeNumber", "m.label", "m.prob")


@query("r07_split_by_key", with_ctes(
    "SELECT key, value, level_order FROM defs WHERE column_name = 'WorkLifeBalance'", _SHEET, _DEFS))
def r07(spark, sf):
    defs = parse_definitions(definitions_sheet(_hr(spark, sf)))
    return defs.where(F.col("column_name") == "WorkLifeBalance").select("key", "value", "level_order")


@query("r08_cor_to_target_column", with_ctes(corr_sql(
    "CAST(MonthlyIncome AS DOUBLE)", [c for c in NUMERIC_FEATURES if c != "MonthlyIncome"], out="MonthlyIncome")))
def r08(spark, sf):
    feats = [c for c in NUMERIC_FEATURES if c != "MonthlyIncome"]
    cor = target_correlation(_hr(spark, sf), "MonthlyIncome", feats)
    return cor.withColumn("MonthlyIncome", F.round("MonthlyIncome", 6))


# ---------------------------------------------------------------- F: scalar functions

@query("f01_concat", with_ctes(
    """SELECT EmployeeNumber, Department || ': ' || JobRole AS name, 'emp' || CAST(EmployeeNumber AS VARCHAR) AS tag,
  printf('%s at level %d', JobRole, JobLevel) AS note FROM hr"""))
def f01(spark, sf):
    hr = _hr(spark, sf)
    return hr.select("EmployeeNumber", str_c("Department", "JobRole", sep=": ").alias("name"),
                     F.concat(F.lit("emp"), F.col("EmployeeNumber").cast("string")).alias("tag"),
                     F.format_string("%s at level %d", F.col("JobRole"), F.col("JobLevel")).alias("note"))


@query("f02_replace", with_ctes(
    """SELECT EmployeeNumber, regexp_replace(BusinessTravel, '_', ' ') AS travel_first,
  replace(EducationField, 'O', '0') AS field_all FROM hr"""))
def f02(spark, sf):
    hr = _hr(spark, sf)
    return hr.select("EmployeeNumber", replace_first(F.col("BusinessTravel"), "_", " ").alias("travel_first"),
                     F.replace(F.col("EducationField"), F.lit("O"), F.lit("0")).alias("field_all"))


@query("f03_split_item", with_ctes(
    "SELECT EmployeeNumber, split_part(BusinessTravel, '_', 2) AS travel_kind FROM hr"))
def f03(spark, sf):
    return _hr(spark, sf).select("EmployeeNumber", split_piece(F.col("BusinessTravel"), "_", 2).alias("travel_kind"))


@query("f04_case", with_ctes("SELECT EmployeeNumber, lower(JobRole) AS lower_role, upper(OverTime) AS upper_ot FROM hr"))
def f04(spark, sf):
    return _hr(spark, sf).select("EmployeeNumber", F.lower("JobRole").alias("lower_role"),
                                 F.upper("OverTime").alias("upper_ot"))


@query("f05_currency_label", with_ctes(
    """SELECT EmployeeNumber, round(salary, 2) AS salary, '$' || CASE WHEN s.mx <= 1000 AND s.fr = 1
  THEN format('{:,.2f}', salary / 1000.0::DOUBLE) ELSE format('{:,.0f}', round(salary / 1000.0::DOUBLE, 0)) END
  || 'K' AS salary_text
FROM (SELECT EmployeeNumber, MonthlyIncome * 12 AS salary FROM hr) x,
  (SELECT max(abs(MonthlyIncome * 12 / 1000.0::DOUBLE)) AS mx, max(CASE WHEN MonthlyIncome * 12 / 1000.0::DOUBLE
     <> floor(MonthlyIncome * 12 / 1000.0::DOUBLE) THEN 1 ELSE 0 END) AS fr FROM hr) s"""))
def f05(spark, sf):
    hr = _hr(spark, sf).select("EmployeeNumber", (F.col("MonthlyIncome") * 12).alias("salary"))
    return dollar_label(hr, "salary", units="K", out="salary_text").withColumn("salary", F.round("salary", 2))


@query("f06_math", with_ctes(
    """SELECT EmployeeNumber, round(abs(MonthlyIncome - 5000), 6) AS gap, round_even(MonthlyIncome / 100, 0) AS hundreds,
  (Age * 2 + 1) % 7 AS mixed FROM hr"""))
def f06(spark, sf):
    hr = _hr(spark, sf)
    return hr.select("EmployeeNumber", F.round(F.abs(F.col("MonthlyIncome") - 5000), 6).alias("gap"),
                     F.bround(F.col("MonthlyIncome") / 100, 0).alias("hundreds"),
                     ((F.col("Age") * 2 + 1) % 7).alias("mixed"))


@query("f07_cast", with_ctes(
    """SELECT EmployeeNumber, TRY_CAST(JobRole AS DOUBLE) AS role_num, CAST(JobLevel AS VARCHAR) AS level_txt,
  TRY_CAST(CAST(Age AS VARCHAR) AS DOUBLE) AS age_num FROM hr"""))
def f07(spark, sf):
    hr = _hr(spark, sf)
    return hr.select("EmployeeNumber", F.col("JobRole").try_cast("double").alias("role_num"),
                     F.col("JobLevel").cast("string").alias("level_txt"),
                     F.col("Age").cast("string").try_cast("double").alias("age_num"))


@query("f08_as_factor", with_ctes(
    """SELECT 'sorted' AS kind, JobRole AS level, CAST(dense_rank() OVER (ORDER BY JobRole) AS INT) AS code
FROM (SELECT DISTINCT JobRole FROM hr) d
UNION ALL SELECT 'first_seen', JobRole, CAST(row_number() OVER (ORDER BY first_id, JobRole) AS INT)
FROM (SELECT JobRole, min(EmployeeNumber) AS first_id FROM hr GROUP BY JobRole) f"""))
def f08(spark, sf):
    hr = _hr(spark, sf)
    a = cat.sorted_levels(hr, ["JobRole"]).select(F.lit("sorted").alias("kind"), "level", "code")
    b = cat.first_seen_levels(hr, ["JobRole"], "EmployeeNumber").select(F.lit("first_seen").alias("kind"),
                                                                       "level", "code")
    return a.unionByName(b)


_BT_LEVELS_SQL = """SELECT BusinessTravel AS level, CAST(row_number() OVER (ORDER BY
  CASE BusinessTravel WHEN 'Non-Travel' THEN 0 WHEN 'Travel_Rarely' THEN 1 WHEN 'Travel_Frequently' THEN 2 ELSE 3 END,
  BusinessTravel) AS INT) AS code FROM (SELECT DISTINCT BusinessTravel FROM hr) d"""


@query("f09_relevel", with_ctes(_BT_LEVELS_SQL))
def f09(spark, sf):
    lv = cat.sorted_levels(_hr(spark, sf), ["BusinessTravel"])
    return cat.relevel(lv, "BusinessTravel", ["Non-Travel", "Travel_Rarely", "Travel_Frequently"]) \
        .select("level", "code")


@query("f10_rev", with_ctes(
    """SELECT MaritalStatus AS level, CAST(count(*) OVER () + 1 - dense_rank() OVER (ORDER BY MaritalStatus) AS INT)
  AS code FROM (SELECT DISTINCT MaritalStatus FROM hr) d"""))
def f10(spark, sf):
    return cat.reverse_levels(cat.sorted_levels(_hr(spark, sf), ["MaritalStatus"])).select("level", "code")


@query("f11_recode", with_ctes(
    "SELECT CASE WHEN OverTime = 'Yes' THEN 'No' ELSE OverTime END AS OverTime, count(*) AS n FROM hr GROUP BY 1"))
def f11(spark, sf):
    hr = _hr(spark, sf).select(cat.recode(F.col("OverTime"), {"Yes": "No"}).alias("OverTime"))
    return count_by(hr, "OverTime")


@query("f12_levels_to_code", with_ctes(
    """SELECT EmployeeNumber, CAST(d.code AS INT) AS Department FROM hr h JOIN
  (SELECT Department, dense_rank() OVER (ORDER BY Department) AS code FROM (SELECT DISTINCT Department FROM hr) x) d
  ON h.Department = d.Department"""))
def f12(spark, sf):
    hr = _hr(spark, sf).select("EmployeeNumber", "Department")
    return cat.to_codes(hr, cat.sorted_levels(hr, ["Department"]), ["Department"])


@query("f13_factor_constant", with_ctes(
    f"""SELECT CASE WHEN Yes >= {J4_THRESHOLD} THEN 'No' ELSE OverTime END AS OverTime, count(*) AS n
FROM scored GROUP BY 1""", scored=True))
def f13(spark, sf):
    s = scored(spark, sf)
    no = cat.checked_level(cat.sorted_levels(s, ["OverTime"]), "OverTime", "No")
    return count_by(s.select(F.when(F.col("Yes") >= J4_THRESHOLD, no).otherwise(F.col("OverTime"))
                             .alias("OverTime")), "OverTime")
