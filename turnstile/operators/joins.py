"""J-family helpers: size-checked broadcast, fold of left joins, staged copies."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete_path, scratch_path

# A side is broadcast only after its row count is checked against this bound;
# above it the join falls back to a shuffle join planned by Spark (AQE may
# still convert it at run time from real sizes).
BROADCAST_MAX_ROWS = 200_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast hint only when ``df`` provably holds at most ``max_rows`` rows.

    The check is a ``limit(max_rows + 1).count()``: it stops reading as soon
    as the bound is exceeded, so it is cheap for both small and huge inputs.
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def fold_left_joins(base: DataFrame, lookups: Iterable[tuple[DataFrame, str]],
                    max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """``reduce(left_join)`` of a fact table with lookup tables.

    Each lookup shares exactly one key column name with ``base``; the key is
    cast to the lookup's key type so both sides are typed alike.  Lookups are
    broadcast after a size check, so the whole fold runs in the fact table's
    scan stage with no shuffle.
    """
    out = base
    for lk, key in lookups:
        key_type = lk.schema[key].dataType
        out = out.withColumn(key, F.col(key).cast(key_type))
        out = out.join(broadcast_if_small(lk, max_rows), on=key, how="left")
    return out


# Lookup tables (levels, definitions, per-column summaries) are bounded by the
# number of distinct category values, not by the data.  They are materialised
# once after a size check, which also cuts their lineage so later size checks
# and joins do not recompute the scan that produced them.
LOOKUP_MAX_ROWS = 100_000


def materialize_lookup(df: DataFrame, max_rows: int = LOOKUP_MAX_ROWS) -> DataFrame | None:
    """Materialised copy of ``df`` if it has at most ``max_rows`` rows, else None."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return None
    return df.sparkSession.createDataFrame(rows, df.schema)


#: Staged copies by application, until they are released.
_staged: dict[str, list[str]] = {}


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    For operators that scan the same input several times (fit passes,
    quantiles, then the apply pass): the input -- often a join -- is computed
    once, later passes read columnar files, and the lineage is cut so a lost
    executor does not recompute the join.  The copy stays until ``release_staged``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    _staged.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def release_staged(spark: SparkSession, keep: int = 0) -> None:
    """Remove the staged copies but the first ``keep``: no frame that reads them may be used any more."""
    paths = _staged.get(spark.sparkContext.applicationId, [])
    while len(paths) > keep:
        delete_path(spark, paths.pop())


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Copies that are staged inside the block are removed at its end."""
    before = len(_staged.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        release_staged(spark, before)
