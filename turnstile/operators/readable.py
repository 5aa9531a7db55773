"""Decode coded survey columns through a messy definitions sheet.

Sheet shape (headerless, order matters): ``row_id, c1, c2`` where ``c1``
names the column only on the first row of its block, ``c2`` reads like
``1 'Low'`` and spacer rows have ``c2`` NULL.

Parsing = fill-down of ``c1`` (``ordered_scan``, no single-task window) ->
drop spacers -> split ``c2`` on `` '`` -> numeric key (``try_cast``) ->
strip the closing quote -> level order by first appearance.

Decoding = fold of size-checked broadcast left joins, one per coded column,
so the fact table is scanned once with no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.categories import first_seen_levels, relevel, sorted_levels
from ..functions.labels import replace_first, split_piece
from .joins import broadcast_if_small, materialize_lookup
from .ordered import fill_down, lookup_row_number

# Survey code labels of the HR definitions sheet, per column,
# in sheet order (block order, then code order).
DEFINITION_LABELS: list[tuple[str, list[str]]] = [
    ("EnvironmentSatisfaction", ["Low", "Medium", "High", "Very High"]),
    ("JobInvolvement", ["Low", "Medium", "High", "Very High"]),
    ("JobSatisfaction", ["Low", "Medium", "High", "Very High"]),
    ("PerformanceRating", ["Low", "Good", "Excellent", "Outstanding"]),
    ("WorkLifeBalance", ["Bad", "Good", "Better", "Best"]),
]

# Level orders forced by ``fct_relevel`` in the readable step.
RELEVEL = {
    "BusinessTravel": ["Non-Travel", "Travel_Rarely", "Travel_Frequently"],
    "MaritalStatus": ["Single", "Married", "Divorced"],
}

SHEET_SCHEMA = T.StructType([T.StructField("row_id", T.IntegerType(), False),
                             T.StructField("c1", T.StringType(), True),
                             T.StructField("c2", T.StringType(), True)])


def _label_table(spark: SparkSession) -> DataFrame:
    rows = [(b, col, i + 1, lab) for b, (col, labs) in enumerate(DEFINITION_LABELS)
            for i, lab in enumerate(labs)]
    return spark.createDataFrame(rows, "block int, column_name string, code int, label string")


def definitions_sheet(hr: DataFrame) -> DataFrame:
    """Sheet-shaped definitions for the codes that occur in ``hr``.

    The distinct (column, code) pairs are a partial aggregate over the whole
    table; the sheet itself has one row per code plus one spacer per block.
    """
    spark = hr.sparkSession
    cols = [c for c, _ in DEFINITION_LABELS]
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("int").alias("code"))
                      for c in cols])
    present = hr.select(F.explode(pairs).alias("p")).select("p.*").distinct()
    labelled = present.join(F.broadcast(_label_table(spark)), ["column_name", "code"])
    first = labelled.groupBy("block").agg(F.min("code").alias("_first"))
    body = (labelled.join(first, "block")
            .select((F.col("block") * 100 + F.col("code")).cast("int").alias("row_id"),
                    F.when(F.col("code") == F.col("_first"), F.col("column_name")).alias("c1"),
                    F.concat(F.col("code").cast("string"), F.lit(" '"), F.col("label"), F.lit("'"))
                    .alias("c2")))
    spacers = first.select((F.col("block") * 100 + 99).cast("int").alias("row_id"),
                           F.lit(None).cast("string").alias("c1"), F.lit(None).cast("string").alias("c2"))
    return body.unionByName(spacers)


def parse_definitions(sheet: DataFrame) -> DataFrame:
    """D6 -> ``(column_name, key double, value string, level_order int)``."""
    small = materialize_lookup(sheet)
    sheet = small if small is not None else sheet
    filled = fill_down(sheet, ["row_id"], {"column_name": "c1"})
    rows = filled.where(F.col("c2").isNotNull())
    parsed = rows.select(
        "row_id", "column_name",
        F.expr("try_cast(split_part(c2, \" '\", 1) AS DOUBLE)").alias("key"),
        replace_first(split_piece(F.col("c2"), " '", 2), "'", "").alias("value"))
    ranked = lookup_row_number(parsed, ["row_id"], ["column_name"], out="level_order")
    return ranked.select("column_name", "key", "value",
                         F.col("level_order").cast("int").alias("level_order"))


MAX_DEFINITION_ROWS = 100_000


def _materialize_small(definitions: DataFrame) -> DataFrame:
    """The parsed definitions are a lookup table (one row per code); it is
    materialised once so the per-column joins do not recompute its lineage.
    Its size is checked first."""
    rows = definitions.limit(MAX_DEFINITION_ROWS + 1).collect()
    if len(rows) > MAX_DEFINITION_ROWS:
        raise ValueError("definitions table is larger than a lookup table should be")
    return definitions.sparkSession.createDataFrame(rows, definitions.schema)


def process_readable(hr: DataFrame, definitions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """D7 ``process_hr_data_readable``: decoded table + its levels table.

    Returns ``(data, levels)``; ``data`` has columns sorted by name
    (case-insensitive), decoded columns carry labels, and ``levels`` gives
    every string column's level codes (decoded columns in sheet order,
    BusinessTravel/MaritalStatus relevelled, the rest sorted).
    """
    definitions = _materialize_small(definitions)
    names = [r[0] for r in definitions.select("column_name").distinct().collect()]
    names = sorted(n for n in names if n in hr.columns)
    out = hr
    for c in names:
        lk = (definitions.where(F.col("column_name") == c)
              .select(F.col("key").alias(c), F.col("value").alias(f"{c}_value")))
        out = out.withColumn(c, F.col(c).cast("double")).join(broadcast_if_small(lk), c, "left")
    out = out.drop(*names).withColumnsRenamed({f"{c}_value": c for c in names})
    out = out.select(*sorted(out.columns, key=str.lower))
    decoded_levels = (definitions.where(F.col("column_name").isin(names))
                      .select(F.col("column_name").alias("column"), F.col("value").alias("level"),
                              F.col("level_order").alias("code")))
    strings = [f.name for f in out.schema.fields
               if isinstance(f.dataType, T.StringType) and f.name not in names]
    levels = sorted_levels(out, strings)
    for col, first in RELEVEL.items():
        if col in strings:
            levels = relevel(levels, col, first)
    all_levels = levels.unionByName(decoded_levels)
    small = materialize_lookup(all_levels)
    return out, small if small is not None else all_levels


def readable_people(hr: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sheet -> definitions -> decoded people table and levels."""
    return process_readable(hr, parse_definitions(definitions_sheet(hr)))


def decoded_levels_by_first_seen(df: DataFrame, columns: Sequence[str], order_col: str) -> DataFrame:
    """``as_factor`` levels of arbitrary columns (first appearance order)."""
    return first_seen_levels(df, columns, order_col)
