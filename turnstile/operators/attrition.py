"""The attrition workflow.

count by keys -> share within parent groups -> keep the attrition rows and
compare with a baseline -> price the leavers -> label table for reporting.

The count is a partial (map-side) aggregate, so the shuffle carries one row
per key per task no matter how skewed a key is; everything after it runs on
the small grouped table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cost import attrition_cost
from ..functions.labels import dollar_label


def count_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    """A3: dplyr ``count(k1, k2, ...)``; NULL keys form their own group."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def count_to_pct(df: DataFrame, *group: str, col: str = "n", out: str = "pct") -> DataFrame:
    """``col / sum(col)`` within ``group``; no groups = share of total.

    Runs on an already-counted table (one row per key), so the window holds
    one row per child value of each parent group.
    """
    if group:
        total = F.sum(col).over(Window.partitionBy(*group))
        return df.withColumn(out, F.col(col) / total)
    grand = df.agg(F.sum(col)).first()[0]
    return df.withColumn(out, F.try_divide(F.col(col), F.lit(grand)))


def assess_attrition(df: DataFrame, attrition_col: str, attrition_value: str | Sequence[str],
                     baseline_pct: float) -> DataFrame:
    """Keep the attrition value rows, flag groups strictly above baseline.

    The filter must run after ``count_to_pct`` (filtering first would change
    the shares); the result is ordered by pct descending.
    """
    values = [attrition_value] if isinstance(attrition_value, str) else list(attrition_value)
    return (df.where(F.coalesce(F.col(attrition_col).isin(values), F.lit(False)))
              .orderBy(F.col("pct").desc())
              .withColumn("above_industry_avg",
                          F.when(F.col("pct") > F.lit(baseline_pct), "Yes").otherwise("No")))


def attrition_workflow(hr: DataFrame, keys: Sequence[str] = ("Department", "JobRole"),
                       attrition_col: str = "Attrition", attrition_value: str = "Yes",
                       baseline_pct: float = 0.088, salary: float | Column = 80000) -> DataFrame:
    """Count -> share within keys -> assess -> cost of attrition."""
    counted = count_by(hr.select(*keys, attrition_col), *keys, attrition_col)
    shared = count_to_pct(counted, *keys)
    assessed = assess_attrition(shared, attrition_col, attrition_value, baseline_pct)
    return assessed.withColumn("cost_of_attrition", attrition_cost(n=F.col("n"), salary=salary))


def cost_label_table(df: DataFrame, keys: Sequence[str], value: str,
                     units: str = "M") -> DataFrame:
    """Data half of the cost chart.

    ``name`` = keys joined with ": ", ``value_text`` = dollar label in the
    chosen unit, ``name_order`` = position of ``name`` when names are
    ordered by value (``fct_reorder``; one value per name).
    """
    named = df.withColumn("name", F.concat_ws(": ", *[F.col(k) for k in keys]))
    labelled = dollar_label(named, value, units=units, out="value_text")
    from .ordered import row_number
    ordered = row_number(labelled, [F.col(value).asc(), F.col("name").asc()], out="name_order")
    return ordered.select("name", value, "value_text", F.col("name_order").cast("int").alias("name_order"))
