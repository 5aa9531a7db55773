"""Row-local operators on a stream of new employees.

The attrition cost (D3), the scoring used by the policy operators and the
three strategy rule chains (G1-G3) look at one row at a time, so they run
unchanged on a streaming DataFrame: orders arrive as a stream, are joined to
the static customer / nation / region tables (stream-static joins, no
streaming state), projected to the people view and scored.  Output goes to
any sink; ``foreachBatch`` gives exactly-once file output with the
checkpoint folder named by the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cost import attrition_cost
from ..operators.recommend import personal_development, professional_development, work_environment
from ..session import scratch_path
from ..sources.people import people_from, score_columns
from ..sources.tables import SCHEMAS


def orders_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int = 1) -> DataFrame:
    """The orders table read as a file stream (schema declared, no inference)."""
    # a file stream reads a folder; the glob keeps only the orders file(s)
    return (spark.readStream.schema(SCHEMAS["orders"]).option("maxFilesPerTrigger", max_files_per_trigger)
            .option("pathGlobFilter", "orders*.parquet").parquet(sf_dir.rstrip("/")))


def score_and_recommend(hr: DataFrame) -> DataFrame:
    """One row-local projection: cost of leaving, both scores, strategies.

    Works on batch and streaming DataFrames alike (no aggregation, no join
    between streams, no state)."""
    scored = score_columns(hr).withColumn(
        "attrition_cost", attrition_cost(salary=F.col("MonthlyIncome") * 12))
    ot = F.when(F.col("OverTime") == "No", 1).when(F.col("OverTime") == "Yes", 2)
    bt = (F.when(F.col("BusinessTravel") == "Non-Travel", 1).when(F.col("BusinessTravel") == "Travel_Rarely", 2)
          .when(F.col("BusinessTravel") == "Travel_Frequently", 3))
    coded = scored.withColumn("OverTime", ot).withColumn("BusinessTravel", bt)
    return coded.select(
        "EmployeeNumber", "Department", "JobRole", "Yes", "Yes_no_ot", "attrition_cost",
        personal_development().alias("personal_development_strategy"),
        professional_development().alias("professional_development_strategy"),
        work_environment().alias("work_environment_strategy"))


def scored_people_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaming people view with cost of leaving, scores and strategies."""
    return score_and_recommend(people_from(orders_stream(spark, sf_dir), spark, sf_dir))


def start_to_parquet(df: DataFrame, out_path: str | None = None, checkpoint: str | None = None,
                     once: bool = True):
    """Write a streaming DataFrame to parquet; returns (query, out_path)."""
    spark = df.sparkSession
    out_path = out_path or scratch_path(spark, "stream-out")
    checkpoint = checkpoint or scratch_path(spark, "stream-ckpt")
    w = df.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime="10 seconds")
    return w.start(), out_path
