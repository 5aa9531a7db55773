"""Oracle SQL building blocks (DuckDB dialect) mirroring the Spark sources."""

from __future__ import annotations

HR_SQL = """SELECT o.o_orderkey AS EmployeeNumber,
  CASE WHEN o.o_orderstatus = 'F' THEN 'Yes' ELSE 'No' END AS Attrition,
  r.r_name AS Department, n.n_name AS JobRole,
  CASE WHEN o.o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'Yes' ELSE 'No' END AS OverTime,
  CASE o.o_orderkey % 3 WHEN 0 THEN 'Non-Travel' WHEN 1 THEN 'Travel_Rarely' ELSE 'Travel_Frequently' END AS BusinessTravel,
  CASE c.c_custkey % 3 WHEN 0 THEN 'Single' WHEN 1 THEN 'Married' ELSE 'Divorced' END AS MaritalStatus,
  c.c_mktsegment AS EducationField,
  CAST(18 + (o.o_orderkey * 3 + o.o_custkey) % 43 AS INT) AS Age,
  CAST(1 + c.c_custkey % 29 AS INT) AS DistanceFromHome,
  o.o_totalprice / 25.0 AS MonthlyIncome,
  CAST(1 + o.o_orderkey % 5 AS INT) AS JobLevel,
  CAST(c.c_custkey % 4 AS INT) AS StockOptionLevel,
  CAST(1 + (o.o_orderkey // 5) % 4 AS INT) AS JobInvolvement,
  CAST(1 + c.c_custkey % 4 AS INT) AS JobSatisfaction,
  CAST(1 + (o.o_orderkey // 7) % 4 AS INT) AS EnvironmentSatisfaction,
  CAST(1 + (o.o_orderkey // 11) % 4 AS INT) AS WorkLifeBalance,
  CAST(1 + (o.o_orderkey // 3) % 4 AS INT) AS PerformanceRating,
  CAST(o.o_orderkey * 7 % 41 AS INT) AS YearsAtCompany,
  CAST(o.o_orderkey * 7 % 41 + c.c_custkey % 10 AS INT) AS TotalWorkingYears,
  CAST(LEAST(o.o_orderkey * 7 % 41, c.c_custkey % 19) AS INT) AS YearsInCurrentRole,
  1 AS EmployeeCount, 80 AS StandardHours, 'Y' AS Over18
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey"""


def score_sql(overtime: str) -> str:
    """Same formula as ``sources.people.attrition_score`` (integer linear part)."""
    return ("round(1.0 / (1.0 + exp(-(CAST(-200 + CASE WHEN " + overtime +
            " = 'Yes' THEN 120 ELSE 0 END - 5 * YearsAtCompany + 3 * DistanceFromHome"
            " - 20 * JobSatisfaction AS DOUBLE) / CAST(100 AS DOUBLE)))), 6)")


SCORED_SQL = f"""SELECT EmployeeNumber, Attrition, OverTime, MonthlyIncome, YearsAtCompany,
  DistanceFromHome, JobSatisfaction, Department, JobRole,
  {score_sql('OverTime')} AS Yes,
  round(1.0 - {score_sql('OverTime')}, 6) AS No,
  {score_sql("'No'")} AS Yes_no_ot,
  CASE WHEN {score_sql('OverTime')} >= 0.5 THEN 'Yes' ELSE 'No' END AS predict
FROM hr"""


def with_ctes(body: str, *extra: tuple[str, str], scored: bool = False) -> str:
    """``WITH hr AS (...) [, scored AS (...)] [, extra...] body``."""
    parts = [f"hr AS (\n{HR_SQL}\n)"]
    if scored:
        parts.append(f"scored AS (\n{SCORED_SQL}\n)")
    parts += [f"{name} AS (\n{text}\n)" for name, text in extra]
    return "WITH " + ",\n".join(parts) + "\n" + body


# Attrition cost with salary = 12 * MonthlyIncome, revenue as a SQL expression.
def cost_sql(salary: str = "80000", revenue: str = "250000", n: str = "1") -> str:
    return (f"({n}) * (CAST(18900 AS DOUBLE) + CAST({revenue} AS DOUBLE) / 240.0 * (40 + 60 * 0.5)"
            f" - CAST({salary} AS DOUBLE) / 240.0 * 40)")
