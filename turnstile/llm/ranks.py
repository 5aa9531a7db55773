"""Row numbers and running sums over groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that a bucket of a group has on average.
BUCKET_ROWS = 20_000


def running_sum(df: DataFrame, group: str, order: list[Column | str], value: Column, name: str, rows: int,
                bucket_rows: int = BUCKET_ROWS, tie: str | None = None) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the same ``group``
    that come before this one.  The group's rows come in buckets by hash of
    ``order``, and in a bucket by ``order``; the total of earlier buckets is
    added to the sum within the bucket.  ``rows`` is the size of the table, ``df`` must
    give the same rows each time it is read (a written table).

    ``tie`` only orders rows that agree in ``order``, and chooses no bucket.
    Such rows must have equal values; where they are more than a bucket's
    rows, they get buckets of their own, over which ``tie`` spreads them.
    """
    buckets = max(1, -(-rows // bucket_rows))
    place = F.xxhash64(F.lit("bucket"), *order)
    at = df.withColumns({"__bucket": F.pmod(place, F.lit(buckets)), "__part": F.lit(0).cast("bigint"), "__value": value})
    if tie and buckets > 1:
        # at most rows / bucket_rows such keys
        hot = df.groupBy(F.col(group).alias("__hot"), place.alias("__place")).agg(F.count("*").alias("__n")).where(F.col("__n") > bucket_rows)
        met = at.withColumn("__key", place).join(
            F.broadcast(hot), F.col(group).eqNullSafe(F.col("__hot")) & (F.col("__key") == F.col("__place")), "left")
        part = 1 + F.pmod(F.xxhash64(F.lit("tie"), tie), F.ceil(F.col("__n") / bucket_rows).cast("bigint"))
        at = met.withColumns({"__bucket": F.coalesce("__place", "__bucket"), "__part": F.coalesce(part, "__part")}).drop(
            "__key", "__hot", "__place", "__n")
    totals = at.groupBy(group, "__bucket", "__part").agg(F.sum("__value").alias("__total"))
    earlier = Window.partitionBy(group).orderBy("__bucket", "__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col(group).alias("__group"), F.col("__bucket").alias("__at"), F.col("__part").alias("__of"),
                           F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__ahead"))
    within = Window.partitionBy(group, "__bucket", "__part").orderBy(*order, *([tie] if tie else [])).rowsBetween(
        Window.unboundedPreceding, -1)
    summed = at.withColumn("__within", F.coalesce(F.sum("__value").over(within), F.lit(0)))
    joined = summed.join(totals, summed[group].eqNullSafe(totals["__group"]) & (summed["__bucket"] == totals["__at"])
                         & (summed["__part"] == totals["__of"]))
    return joined.withColumn(name, F.col("__ahead") + F.col("__within")).drop(
        "__bucket", "__part", "__value", "__within", "__ahead", "__group", "__at", "__of")
