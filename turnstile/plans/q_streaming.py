"""Streaming form of the row-local operators (scores, cost, strategies)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming.scoring import scored_people_stream, start_to_parquet
from .q_domain import G1_SQL, G2_SQL, G3_SQL
from .registry import query
from .sql import cost_sql, score_sql, with_ctes

_CODED_SCORED = f"""SELECT EmployeeNumber, Department, JobRole, {score_sql('OverTime_s')} AS Yes,
  {score_sql("'No'")} AS Yes_no_ot, {cost_sql(salary='MonthlyIncome * 12')} AS attrition_cost,
  YearsAtCompany, TotalWorkingYears, YearsInCurrentRole, JobLevel, DistanceFromHome, PerformanceRating,
  JobSatisfaction, JobInvolvement, WorkLifeBalance, EnvironmentSatisfaction,
  CASE OverTime_s WHEN 'No' THEN 1 WHEN 'Yes' THEN 2 END AS OverTime,
  CASE BusinessTravel WHEN 'Non-Travel' THEN 1 WHEN 'Travel_Rarely' THEN 2 WHEN 'Travel_Frequently' THEN 3 END
    AS BusinessTravel
FROM (SELECT *, OverTime AS OverTime_s FROM hr) h"""


@query("st01_stream_score_and_recommend", with_ctes(
    f"""SELECT EmployeeNumber, Department, JobRole, Yes, Yes_no_ot, round(attrition_cost, 2) AS attrition_cost,
  {G1_SQL} AS personal_development_strategy, {G2_SQL} AS professional_development_strategy,
  {G3_SQL} AS work_environment_strategy FROM cs""", ("cs", _CODED_SCORED)))
def st01(spark, sf):
    """Run the stream to completion (available-now trigger) into parquet in
    the shared folder, then read the result back as a table."""
    q, path = start_to_parquet(scored_people_stream(spark, sf), once=True)
    q.awaitTermination()
    out = spark.read.parquet(path)
    return out.withColumn("attrition_cost", F.round("attrition_cost", 2))
