"""Ordered categories (R factors) as a levels table ``(column, level, code)``.

Spark has no factor type: data keeps strings and a small levels table says
each level's 1-based position.  Levels tables are built with distributed
aggregates and ranks (``ordered_scan``), never by gathering a column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import broadcast_if_small, materialize_lookup
from ..operators.ordered import lookup_row_number as row_number


_LEVELS_SCHEMA = "column string, level string, code int"


def _long_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns]
    return df.select(F.explode(F.array(*pairs)).alias("_p")).select("_p.column", "_p.level")


def sorted_levels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """F8 ``as.factor``: distinct non-NULL values in sorted order, code 1.."""
    if not columns:
        return df.sparkSession.createDataFrame([], _LEVELS_SCHEMA)
    distinct = _long_values(df, columns).where(F.col("level").isNotNull()).distinct()
    ranked = row_number(distinct, [F.col("level").asc()], ["column"], out="code")
    return ranked.select("column", "level", F.col("code").cast("int").alias("code"))


def first_seen_levels(df: DataFrame, columns: Sequence[str], order_col: str) -> DataFrame:
    """F8 ``as_factor``: levels in order of first appearance along ``order_col``."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level"),
                      F.col(order_col).alias("pos")) for c in columns]
    long = df.select(F.explode(F.array(*pairs)).alias("_p")).select("_p.*")
    first = long.where(F.col("level").isNotNull()).groupBy("column", "level").agg(F.min("pos").alias("pos"))
    ranked = row_number(first, [F.col("pos").asc(), F.col("level").asc()], ["column"], out="code")
    return ranked.select("column", "level", F.col("code").cast("int").alias("code"))


def relevel(levels: DataFrame, column: str, first: Sequence[str]) -> DataFrame:
    """F9 ``fct_relevel``: listed levels first (in the given order), the rest
    keep their current order."""
    pos = F.lit(len(first))
    for i, lv in reversed(list(enumerate(first))):
        pos = F.when(F.col("level") == lv, F.lit(i)).otherwise(pos)
    mine = levels.where(F.col("column") == column).withColumn("_k", pos)
    ranked = row_number(mine, [F.col("_k").asc(), F.col("code").asc()], ["column"], out="_new")
    ranked = ranked.select("column", "level", F.col("_new").cast("int").alias("code"))
    out = levels.where(F.col("column") != column).unionByName(ranked)
    small = materialize_lookup(out)
    return small if small is not None else out


def reverse_levels(levels: DataFrame) -> DataFrame:
    """F10 ``fct_rev``: code -> n + 1 - code within each column."""
    n = levels.groupBy("column").agg(F.max("code").alias("_n"))
    return (levels.join(broadcast_if_small(n), "column")
            .select("column", "level", (F.col("_n") + 1 - F.col("code")).cast("int").alias("code")))


def recode(col: Column, mapping: dict[str, str]) -> Column:
    """F11 ``fct_recode``: replace listed levels, keep the rest."""
    out = col
    for old, new in mapping.items():
        out = F.when(col == old, F.lit(new)).otherwise(out)
    return out


def checked_level(levels: DataFrame, column: str, level: str) -> Column:
    """F13 ``factor("No", levels = levels(x))``: a literal that must exist."""
    ok = levels.where((F.col("column") == column) & (F.col("level") == level)).limit(1).count()
    if not ok:
        raise ValueError(f"{level!r} is not a level of {column}")
    return F.lit(level)


def to_codes(df: DataFrame, levels: DataFrame, columns: Sequence[str]) -> DataFrame:
    """F12 ``as.numeric(factor)``: replace each listed column by its code.

    One size-checked broadcast join per column against its slice of the
    levels table; values without a level become NULL (R gives NA).
    """
    out = df
    for c in columns:
        lk = (levels.where(F.col("column") == c)
              .select(F.col("level").alias("_lv"), F.col("code").alias("_code")))
        out = (out.join(broadcast_if_small(lk), F.col(c).cast("string") == F.col("_lv"), "left")
               .withColumn(c, F.col("_code")).drop("_lv", "_code"))
    return out
