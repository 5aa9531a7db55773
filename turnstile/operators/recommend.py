"""Rule-based development strategies (first matching rule wins).

Rules read factor *codes* (1-based level positions), exactly as the rule
tables are written: ``OverTime == 2`` is "Yes" (levels No < Yes) and
``BusinessTravel == 3`` is "Travel_Frequently" (relevelled order).  All three
rule chains are one projection -- row-local, no shuffle -- so the operator
also runs unchanged on a streaming DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.categories import to_codes

# Strategy texts.
CREATE_PDP = "Create Personal Development Plan"
PROMOTE_TRAINING = "Promote Training and Formation"
SEEK_MENTORSHIP = "Seek Mentorship Role"
SEEK_LEADERSHIP = "Seek Leadership Role"
READY_ROTATION = "Ready for Rotation"
READY_PROMOTION = "Ready for Promotion"
INCENTIVIZE_SPEC = "Incentivize Specialization"
IMPROVE_WLB = "Improve Work-Life Balance"
MONITOR_TRAVEL = "Monitor Business Travel"
REVIEW_ASSIGNMENT = "Review Job Assignment"
PROMOTE_ENGAGEMENT = "Promote Job Engagement"
RETAIN = "Retain and Maintain"

OUTPUT = ["EmployeeNumber", "personal_development_strategy",
          "professional_development_strategy", "work_environment_strategy"]


def _c(name: str) -> Column:
    return F.col(name)


def personal_development(c=_c) -> Column:
    """G1."""
    pr, js, ji = c("PerformanceRating"), c("JobSatisfaction"), c("JobInvolvement")
    yac, twy, ycr = c("YearsAtCompany"), c("TotalWorkingYears"), c("YearsInCurrentRole")
    return (F.when((pr == 1) | (js == 1) | (ji <= 2), CREATE_PDP)
            .when((yac < 3) | (twy < 6), PROMOTE_TRAINING)
            .when(((ycr > 3) | (yac >= 5)) & (pr >= 3) & (js == 4), SEEK_MENTORSHIP)
            .when((ji >= 3) & (js >= 3) & (pr >= 3), SEEK_LEADERSHIP)
            .otherwise(RETAIN))


def professional_development(c=_c) -> Column:
    """G2."""
    ycr, js, jl = c("YearsInCurrentRole"), c("JobSatisfaction"), c("JobLevel")
    ji, pr = c("JobInvolvement"), c("PerformanceRating")
    return (F.when((ycr >= 2) & (js <= 2), READY_ROTATION)
            .when((jl == 1) & (ycr >= 2) & (ji >= 3) & (pr >= 3), READY_PROMOTION)
            .when((jl == 2) & (ycr >= 2) & (ji >= 4) & (pr >= 3), READY_PROMOTION)
            .when((jl == 3) & (ycr >= 3) & (ji >= 4) & (pr >= 3), READY_PROMOTION)
            .when((jl == 4) & (ycr >= 4) & (ji >= 4) & (pr >= 3), READY_PROMOTION)
            .when((ycr >= 4) & (js >= 4) & (pr >= 3), INCENTIVIZE_SPEC)
            .otherwise(RETAIN))


def work_environment(c=_c) -> Column:
    """G3 (codes: OverTime 2 = Yes, BusinessTravel 3 = Travel_Frequently)."""
    ot, wlb, bt = c("OverTime"), c("WorkLifeBalance"), c("BusinessTravel")
    dist, es, ycr, ji = c("DistanceFromHome"), c("EnvironmentSatisfaction"), c("YearsInCurrentRole"), \
        c("JobInvolvement")
    return (F.when((ot == 2) | (wlb == 1), IMPROVE_WLB)
            .when(((bt == 3) | (dist >= 10)) & (wlb == 2), MONITOR_TRAVEL)
            .when((es == 1) & (ycr >= 2), REVIEW_ASSIGNMENT)
            .when(ji <= 2, PROMOTE_ENGAGEMENT)
            .otherwise(RETAIN))


def strategies_from_codes(coded: DataFrame) -> DataFrame:
    """All three strategies from a table whose factor columns hold codes."""
    return coded.select("EmployeeNumber",
                        personal_development().alias("personal_development_strategy"),
                        professional_development().alias("professional_development_strategy"),
                        work_environment().alias("work_environment_strategy"))


FACTOR_COLUMNS = ["PerformanceRating", "JobSatisfaction", "JobInvolvement", "OverTime",
                  "WorkLifeBalance", "BusinessTravel", "EnvironmentSatisfaction"]


def recommend_strategies(readable: DataFrame, levels: DataFrame,
                         employee_number: int | None = None) -> DataFrame:
    """Strategies for one employee (``employee_number``) or for all.

    ``readable``/``levels`` come from ``process_readable``; factor columns
    are turned into codes with the levels table, then the rule chains run.
    """
    df = readable
    if employee_number is not None:
        df = df.where(F.col("EmployeeNumber") == employee_number)
    cols = [c for c in FACTOR_COLUMNS if c in df.columns]
    coded = to_codes(df.select("EmployeeNumber", "YearsAtCompany", "TotalWorkingYears",
                               "YearsInCurrentRole", "JobLevel", "DistanceFromHome", *cols), levels, cols)
    return strategies_from_codes(coded)


def strategy_counts(strategies: DataFrame, column: str) -> DataFrame:
    """Number of employees per strategy."""
    return strategies.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
