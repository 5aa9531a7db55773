"""The people (HR) view over the driver tables and the scored view.

The driver tables hold no HR data, so a deterministic employee table is
derived from orders x customer x nation x region.  Work grows with
``orders``: one employee per order.

orders x customer is a shuffle join on the customer key (both sides grow with
the data); nation x region is tiny and broadcast after a size check.  A hot
customer key is handled by AQE's skew-join split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import broadcast_if_small
from .tables import read_table

# Column order of the people view (several operators select by position).
PEOPLE_COLUMNS = [
    "EmployeeNumber", "Attrition", "Department", "JobRole", "OverTime", "BusinessTravel",
    "MaritalStatus", "EducationField", "Age", "DistanceFromHome", "MonthlyIncome",
    "JobLevel", "StockOptionLevel", "JobInvolvement", "JobSatisfaction",
    "EnvironmentSatisfaction", "WorkLifeBalance", "PerformanceRating", "YearsAtCompany",
    "TotalWorkingYears", "YearsInCurrentRole", "EmployeeCount", "StandardHours", "Over18",
]


def _div(c: Column, k: int) -> Column:
    """Integer division of a non-negative integer column."""
    return F.floor(c / F.lit(k)).cast("long")


def _int(c: Column) -> Column:
    return c.cast("int")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People view ``hr`` (one row per order)."""
    return people_from(read_table(spark, sf_dir, "orders"), spark, sf_dir)


def people_from(orders: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """People projection of an orders DataFrame (batch or streaming); the
    customer / nation / region sides are static tables."""
    o = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")
    x = (o.join(c, o.o_custkey == c.c_custkey)
         .join(broadcast_if_small(geo), F.col("c_nationkey") == F.col("n_nationkey")))
    ok, ck = F.col("o_orderkey"), F.col("c_custkey")
    yac = ok * 7 % 41
    return x.select(
        ok.alias("EmployeeNumber"),
        F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("No").alias("Attrition"),
        F.col("r_name").alias("Department"),
        F.col("n_name").alias("JobRole"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "Yes").otherwise("No")
        .alias("OverTime"),
        F.when(ok % 3 == 0, "Non-Travel").when(ok % 3 == 1, "Travel_Rarely")
        .otherwise("Travel_Frequently").alias("BusinessTravel"),
        F.when(ck % 3 == 0, "Single").when(ck % 3 == 1, "Married").otherwise("Divorced")
        .alias("MaritalStatus"),
        F.col("c_mktsegment").alias("EducationField"),
        _int(18 + (ok * 3 + F.col("o_custkey")) % 43).alias("Age"),
        _int(1 + ck % 29).alias("DistanceFromHome"),
        (F.col("o_totalprice") / F.lit(25.0)).alias("MonthlyIncome"),
        _int(1 + ok % 5).alias("JobLevel"),
        _int(ck % 4).alias("StockOptionLevel"),
        _int(1 + _div(ok, 5) % 4).alias("JobInvolvement"),
        _int(1 + ck % 4).alias("JobSatisfaction"),
        _int(1 + _div(ok, 7) % 4).alias("EnvironmentSatisfaction"),
        _int(1 + _div(ok, 11) % 4).alias("WorkLifeBalance"),
        _int(1 + _div(ok, 3) % 4).alias("PerformanceRating"),
        _int(yac).alias("YearsAtCompany"),
        _int(yac + ck % 10).alias("TotalWorkingYears"),
        _int(F.least(yac, ck % 19)).alias("YearsInCurrentRole"),
        F.lit(1).alias("EmployeeCount"),
        F.lit(80).alias("StandardHours"),
        F.lit("Y").alias("Over18"),
    )


def attrition_score(overtime: Column, years_at_company: Column, distance: Column,
                    job_satisfaction: Column) -> Column:
    """Deterministic stand-in for a model: P(Attrition = Yes), 6 decimals.

    The linear part is formed in integers and divided once, so every engine
    gets the same double before ``exp``.
    """
    lin = (F.lit(-200) + F.when(overtime == "Yes", 120).otherwise(0)
           - 5 * years_at_company + 3 * distance - 20 * job_satisfaction) / F.lit(100.0)
    return F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-lin)), 6)


def score_columns(df: DataFrame, overtime_col: str = "OverTime") -> DataFrame:
    """Add ``Yes``/``No`` (as scored) and ``Yes_no_ot`` (scored with OverTime='No')."""
    yac, dist, js = F.col("YearsAtCompany"), F.col("DistanceFromHome"), F.col("JobSatisfaction")
    yes = attrition_score(F.col(overtime_col), yac, dist, js)
    return (df.withColumn("Yes", yes)
              .withColumn("No", F.round(F.lit(1.0) - F.col("Yes"), 6))
              .withColumn("Yes_no_ot", attrition_score(F.lit("No"), yac, dist, js)))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scored``: id, label, OverTime, income and both scorings.

    Scoring twice (as-is and with OverTime='No') is all the policy operators
    need: a threshold only decides which of the two a row uses.
    """
    base = people(spark, sf_dir).select(
        "EmployeeNumber", "Attrition", "OverTime", "MonthlyIncome", "YearsAtCompany",
        "DistanceFromHome", "JobSatisfaction", "Department", "JobRole")
    return (score_columns(base)
            .withColumn("predict", F.when(F.col("Yes") >= 0.5, "Yes").otherwise("No")))
