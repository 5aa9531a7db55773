"""Correlation of every feature with a target.

All features are correlated in one aggregate pass.  Pairwise-complete rule:
for each feature, only rows where both feature and target are non-NULL count
-- the covariance and both deviations use the same pairs.  A constant column
gives NULL (``try_divide``) instead of an ANSI divide-by-zero error.

For one-hot (0/1) features against a 0/1 target the correlation follows from
four counts per (column, level); ``indicator_correlation`` uses that form, so
hundreds of dummy columns never need to exist as columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.categories import sorted_levels, to_codes
from .joins import broadcast_if_small, stage_table
from .ordered import row_number


def pearson(x: Column, y: Column) -> Column:
    """Pairwise-complete Pearson correlation as an aggregate expression."""
    xp = F.when(y.isNotNull(), x.cast("double"))
    yp = F.when(x.isNotNull(), y.cast("double"))
    return F.try_divide(F.covar_samp(xp, yp), F.stddev_samp(xp) * F.stddev_samp(yp))


def target_correlation(df: DataFrame, target: str, features: Sequence[str],
                       out: str | None = None) -> DataFrame:
    """Tall ``(feature, <target>)`` table, one pass."""
    out = out or target
    row = df.agg(*[pearson(F.col(f), F.col(target)).alias(f) for f in features])
    return row.unpivot([], list(features), "feature", out)


def as_numeric_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text columns as the 1-based codes of their sorted levels; the others unchanged."""
    strings = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    if not strings:
        return df
    return to_codes(df, sorted_levels(df, strings), strings)


def get_cor(df: DataFrame, target: str, fct_reorder: bool = False, fct_rev: bool = False) -> DataFrame:
    """Correlation of every other column with ``target``.

    Strings become sorted-level codes first.  ``feature_order`` is the
    feature's level code: column order by default, ordered by correlation
    with ``fct_reorder``, reversed with ``fct_rev``.
    """
    coded = as_numeric_codes(df, df.columns)
    feats = [c for c in df.columns if c != target]
    cor = target_correlation(coded, target, feats)
    spark = df.sparkSession
    pos = spark.createDataFrame([(f, i + 1) for i, f in enumerate(feats)], "feature string, _pos int")
    cor = cor.join(F.broadcast(pos), "feature")
    order = [F.col(target).asc_nulls_last(), F.col("_pos")] if fct_reorder else [F.col("_pos")]
    ranked = row_number(cor, order, out="feature_order")
    if fct_rev:
        ranked = ranked.withColumn("feature_order", F.lit(len(feats)) + 1 - F.col("feature_order"))
    return ranked.select("feature", target, F.col("feature_order").cast("int").alias("feature_order"))


def signed_correlation(cor: DataFrame, target: str, precision: int = 2) -> DataFrame:
    """Rounded label (half-even, as R) and Positive/Negative (0 is Positive)."""
    return cor.withColumn("feature_name_text", F.bround(F.col(target), precision)) \
              .withColumn("Correlation", F.when(F.col(target) >= 0, "Positive").otherwise("Negative"))


def make_names(level: Column) -> Column:
    """R ``make.names`` for level text: invalid characters -> '.', leading
    digit gets an 'X' prefix."""
    clean = F.regexp_replace(level, "[^A-Za-z0-9._]", ".")
    return F.when(clean.rlike("^[0-9]"), F.concat(F.lit("X"), clean)).otherwise(clean)


def indicator_correlation(long: DataFrame) -> DataFrame:
    """Correlation of every one-hot indicator ``column_level`` with a 0/1 target.

    ``long`` is a tall ``(variable, level, y)`` table (one row per input row
    and column).  With n rows, a = rows at the level, t = target rows and
    b = rows at the level with target 1:
    r = (n*b - a*t) / sqrt((n*a - a^2) * (n*t - t^2)); NULL for constants.
    """
    per = stage_table(long.groupBy("variable", "level").agg(F.count(F.lit(1)).alias("_a"),
                                                          F.sum("y").alias("_b")), "indicator-counts")
    tot = per.groupBy("variable").agg(F.sum("_a").alias("_n"), F.sum("_b").alias("_t"))  # from the counts
    j = per.join(broadcast_if_small(tot), "variable")
    n, a, b, t = (F.col(c).cast("double") for c in ("_n", "_a", "_b", "_t"))
    r = F.try_divide(n * b - a * t, F.sqrt((n * a - a * a) * (n * t - t * t)))
    return j.select(F.concat(F.col("variable"), F.lit("_"), make_names(F.col("level"))).alias("feature"),
                    "variable", "level", r.alias("corr"))
