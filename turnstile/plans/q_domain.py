"""Queries for the attrition workflow (D1-D5), readable decoding (D6-D7, S2,
J1-J2, W9, R4, R7) and recommendation rules (G1-G5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.cost import attrition_cost
from ..operators import attrition as att
from ..operators import readable as rd
from ..operators import recommend as rec
from ..sources.people import people
from .registry import query
from .sql import cost_sql, with_ctes

KEYS3 = ("Department", "JobRole", "Attrition")

_COUNT3 = "SELECT Department, JobRole, Attrition, count(*) AS n FROM hr GROUP BY Department, JobRole, Attrition"
_PCT = f"""SELECT Department, JobRole, Attrition, n,
  n / sum(n) OVER (PARTITION BY Department, JobRole) AS pct FROM ({_COUNT3}) t"""


@query("d01_count_to_pct", with_ctes(
    f"SELECT Department, JobRole, Attrition, n, round(pct, 6) AS pct FROM ({_PCT}) p"))
def d01(spark, sf):
    counted = att.count_by(people(spark, sf), *KEYS3)
    return att.count_to_pct(counted, "Department", "JobRole").withColumn("pct", F.round("pct", 6))


@query("d02_assess_attrition", with_ctes(
    f"""SELECT Department, JobRole, Attrition, n, round(pct, 6) AS pct,
  CASE WHEN pct > 0.088 THEN 'Yes' ELSE 'No' END AS above_industry_avg
FROM ({_PCT}) p WHERE Attrition IN ('Yes')"""))
def d02(spark, sf):
    counted = att.count_by(people(spark, sf), *KEYS3)
    shared = att.count_to_pct(counted, "Department", "JobRole")
    return att.assess_attrition(shared, "Attrition", "Yes", 0.088).withColumn("pct", F.round("pct", 6))


@query("d03_attrition_cost", with_ctes(
    f"SELECT EmployeeNumber, round({cost_sql(salary='MonthlyIncome * 12')}, 2) AS attrition_cost FROM hr"))
def d03(spark, sf):
    hr = people(spark, sf)
    return hr.select("EmployeeNumber",
                     F.round(attrition_cost(salary=F.col("MonthlyIncome") * 12), 2).alias("attrition_cost"))


_WORKFLOW_SQL = f"""SELECT Department, JobRole, Attrition, n, pct,
  CASE WHEN pct > 0.088 THEN 'Yes' ELSE 'No' END AS above_industry_avg,
  {cost_sql(n='n')} AS cost_of_attrition
FROM ({_PCT}) p WHERE Attrition IN ('Yes')"""


def flagship(spark, sf):
    """The attrition workflow by department and job role."""
    wf = att.attrition_workflow(people(spark, sf))
    return wf.withColumn("pct", F.round("pct", 6)) \
             .withColumn("cost_of_attrition", F.round("cost_of_attrition", 2))


query("d04_attrition_workflow", with_ctes(
    f"""SELECT Department, JobRole, Attrition, n, round(pct, 6) AS pct, above_industry_avg,
  round(cost_of_attrition, 2) AS cost_of_attrition FROM ({_WORKFLOW_SQL}) w"""))(flagship)


@query("d05_cost_label_table", with_ctes(
    """SELECT name, round(cost_of_attrition, 2) AS cost_of_attrition,
  '$' || CASE WHEN s.mx <= 1000 AND s.fr = 1 THEN format('{:,.2f}', cost_of_attrition / 1000000.0::DOUBLE)
              ELSE format('{:,.0f}', round(cost_of_attrition / 1000000.0::DOUBLE, 0)) END || 'M' AS value_text,
  CAST(row_number() OVER (ORDER BY cost_of_attrition, name) AS INT) AS name_order
FROM (SELECT Department || ': ' || JobRole AS name, cost_of_attrition FROM w) x,
  (SELECT max(abs(cost_of_attrition / 1000000.0::DOUBLE)) AS mx,
          max(CASE WHEN cost_of_attrition / 1000000.0::DOUBLE <> floor(cost_of_attrition / 1000000.0::DOUBLE)
              THEN 1 ELSE 0 END) AS fr FROM w) s""", ("w", _WORKFLOW_SQL)))
def d05(spark, sf):
    wf = att.attrition_workflow(people(spark, sf))
    lab = att.cost_label_table(wf, ["Department", "JobRole"], "cost_of_attrition", units="M")
    return lab.withColumn("cost_of_attrition", F.round("cost_of_attrition", 2))


# ---------------------------------------------------------------- D6-D7 readable decoding

def _rel():
    from . import q_relational as qr
    return qr


@query("d06_parse_definitions", None)
def d06(spark, sf):
    return rd.parse_definitions(rd.definitions_sheet(people(spark, sf)))


@query("d07_readable", None)
def d07(spark, sf):
    data, _ = rd.readable_people(people(spark, sf))
    return data


@query("d07_readable_levels", None)
def d07_levels(spark, sf):
    _, levels = rd.readable_people(people(spark, sf))
    return levels.withColumnRenamed("column", "variable")


def _d67_sql():
    qr = _rel()
    coded = sorted(qr._CODED)
    excl = ", ".join(coded)
    d06_sql = with_ctes("SELECT * FROM defs", qr._SHEET, qr._DEFS)
    d07_sql = with_ctes(qr._fold_sql(f"h.* EXCLUDE ({excl}), " +
                                     ", ".join(f"d_{c}.value AS {c}" for c in coded)), qr._SHEET, qr._DEFS)
    strings = ["Attrition", "BusinessTravel", "Department", "EducationField", "JobRole", "MaritalStatus",
               "Over18", "OverTime"]
    rel = {"BusinessTravel": ["Non-Travel", "Travel_Rarely", "Travel_Frequently"],
           "MaritalStatus": ["Single", "Married", "Divorced"]}
    parts = []
    for c in strings:
        if c in rel:
            case = " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(rel[c]))
            order = f"CASE {c} {case} ELSE {len(rel[c])} END, {c}"
        else:
            order = c
        parts.append(f"SELECT '{c}' AS variable, {c} AS level, CAST(row_number() OVER (ORDER BY {order}) AS INT)"
                     f" AS code FROM (SELECT DISTINCT {c} FROM hr) x")
    parts.append("SELECT column_name AS variable, value AS level, level_order AS code FROM defs")
    lv_sql = with_ctes(" UNION ALL ".join(parts), qr._SHEET, qr._DEFS)
    return d06_sql, d07_sql, lv_sql


# ---------------------------------------------------------------- G1-G5 recommendation rules

_CODES_SQL = """SELECT EmployeeNumber, YearsAtCompany, TotalWorkingYears, YearsInCurrentRole, JobLevel,
  DistanceFromHome, PerformanceRating, JobSatisfaction, JobInvolvement, WorkLifeBalance, EnvironmentSatisfaction,
  CASE OverTime WHEN 'No' THEN 1 WHEN 'Yes' THEN 2 END AS OverTime,
  CASE BusinessTravel WHEN 'Non-Travel' THEN 1 WHEN 'Travel_Rarely' THEN 2 WHEN 'Travel_Frequently' THEN 3 END
    AS BusinessTravel FROM hr"""

G1_SQL = f"""CASE WHEN PerformanceRating = 1 OR JobSatisfaction = 1 OR JobInvolvement <= 2 THEN '{rec.CREATE_PDP}'
  WHEN YearsAtCompany < 3 OR TotalWorkingYears < 6 THEN '{rec.PROMOTE_TRAINING}'
  WHEN (YearsInCurrentRole > 3 OR YearsAtCompany >= 5) AND PerformanceRating >= 3 AND JobSatisfaction = 4
    THEN '{rec.SEEK_MENTORSHIP}'
  WHEN JobInvolvement >= 3 AND JobSatisfaction >= 3 AND PerformanceRating >= 3 THEN '{rec.SEEK_LEADERSHIP}'
  ELSE '{rec.RETAIN}' END"""
G2_SQL = f"""CASE WHEN YearsInCurrentRole >= 2 AND JobSatisfaction <= 2 THEN '{rec.READY_ROTATION}'
  WHEN JobLevel = 1 AND YearsInCurrentRole >= 2 AND JobInvolvement >= 3 AND PerformanceRating >= 3
    THEN '{rec.READY_PROMOTION}'
  WHEN JobLevel = 2 AND YearsInCurrentRole >= 2 AND JobInvolvement >= 4 AND PerformanceRating >= 3
    THEN '{rec.READY_PROMOTION}'
  WHEN JobLevel = 3 AND YearsInCurrentRole >= 3 AND JobInvolvement >= 4 AND PerformanceRating >= 3
    THEN '{rec.READY_PROMOTION}'
  WHEN JobLevel = 4 AND YearsInCurrentRole >= 4 AND JobInvolvement >= 4 AND PerformanceRating >= 3
    THEN '{rec.READY_PROMOTION}'
  WHEN YearsInCurrentRole >= 4 AND JobSatisfaction >= 4 AND PerformanceRating >= 3 THEN '{rec.INCENTIVIZE_SPEC}'
  ELSE '{rec.RETAIN}' END"""
G3_SQL = f"""CASE WHEN OverTime = 2 OR WorkLifeBalance = 1 THEN '{rec.IMPROVE_WLB}'
  WHEN (BusinessTravel = 3 OR DistanceFromHome >= 10) AND WorkLifeBalance = 2 THEN '{rec.MONITOR_TRAVEL}'
  WHEN EnvironmentSatisfaction = 1 AND YearsInCurrentRole >= 2 THEN '{rec.REVIEW_ASSIGNMENT}'
  WHEN JobInvolvement <= 2 THEN '{rec.PROMOTE_ENGAGEMENT}'
  ELSE '{rec.RETAIN}' END"""
_STRAT_SQL = f"""SELECT EmployeeNumber, {G1_SQL} AS personal_development_strategy,
  {G2_SQL} AS professional_development_strategy, {G3_SQL} AS work_environment_strategy FROM codes"""
_CODES = ("codes", _CODES_SQL)


def _coded_hr(spark, sf):
    """People table with factor columns as codes (sorted / relevelled levels)."""
    hr = people(spark, sf)
    ot = F.when(F.col("OverTime") == "No", 1).when(F.col("OverTime") == "Yes", 2)
    bt = (F.when(F.col("BusinessTravel") == "Non-Travel", 1).when(F.col("BusinessTravel") == "Travel_Rarely", 2)
          .when(F.col("BusinessTravel") == "Travel_Frequently", 3))
    return hr.withColumn("OverTime", ot).withColumn("BusinessTravel", bt)


@query("g01_personal_development", with_ctes(
    f"SELECT EmployeeNumber, {G1_SQL} AS personal_development_strategy FROM codes", _CODES))
def g01(spark, sf):
    return _coded_hr(spark, sf).select("EmployeeNumber",
                                       rec.personal_development().alias("personal_development_strategy"))


@query("g02_professional_development", with_ctes(
    f"SELECT EmployeeNumber, {G2_SQL} AS professional_development_strategy FROM codes", _CODES))
def g02(spark, sf):
    return _coded_hr(spark, sf).select("EmployeeNumber",
                                       rec.professional_development().alias("professional_development_strategy"))


@query("g03_work_environment", with_ctes(
    f"SELECT EmployeeNumber, {G3_SQL} AS work_environment_strategy FROM codes", _CODES))
def g03(spark, sf):
    return _coded_hr(spark, sf).select("EmployeeNumber", rec.work_environment().alias("work_environment_strategy"))


@query("g04_recommend_strategies", with_ctes(_STRAT_SQL, _CODES))
def g04(spark, sf):
    """Readable table -> factor codes from the levels table -> rule chains."""
    data, levels = rd.readable_people(people(spark, sf))
    return rec.recommend_strategies(data, levels)


@query("g04_recommend_one_employee", with_ctes(f"{_STRAT_SQL} WHERE EmployeeNumber = 19", _CODES))
def g04_one(spark, sf):
    return rec.strategies_from_codes(_coded_hr(spark, sf).where(F.col("EmployeeNumber") == 19))


@query("g05_strategy_counts", with_ctes(
    """SELECT work_environment_strategy, count(*) AS n FROM strat GROUP BY work_environment_strategy""",
    _CODES, ("strat", _STRAT_SQL)))
def g05(spark, sf):
    return rec.strategy_counts(rec.strategies_from_codes(_coded_hr(spark, sf)), "work_environment_strategy")


def attach_late_sql() -> None:
    """SQL that needs pieces defined in other query modules."""
    from .registry import set_sql
    d06_sql, d07_sql, lv_sql = _d67_sql()
    set_sql("d06_parse_definitions", d06_sql)
    set_sql("d07_readable", d07_sql)
    set_sql("d07_readable_levels", lv_sql)
