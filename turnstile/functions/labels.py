"""F1-F6 text helpers: concatenation, first/all replacement, split pieces,
currency labels and half-even rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unit name -> divisor used by the currency labels.
UNITS = {"0": 1.0, "K": 1e3, "M": 1e6}
LARGEST_WITH_CENTS = 1e3


def str_c(*cols: Column | str, sep: str = "") -> Column:
    """``str_c(a, b, sep=)`` / ``paste0``; NULL parts are skipped."""
    return F.concat_ws(sep, *[F.col(c) if isinstance(c, str) else c for c in cols])


def replace_first(col: Column, literal: str, replacement: str) -> Column:
    """``str_replace`` for a plain literal: only the first occurrence."""
    pos = F.instr(col, literal)
    return F.when(pos == 0, col).otherwise(
        F.concat(F.substr(col, F.lit(1), pos - 1), F.lit(replacement),
                 F.substr(col, pos + len(literal))))


def split_piece(col: Column, sep: str, index: int) -> Column:
    """1-based piece of a split (``str_split(x, sep)[, i]``); '' if absent."""
    return F.split_part(col, F.lit(sep), F.lit(index))


def half_even(col: Column, digits: int = 0) -> Column:
    """R ``round`` on doubles is half-to-even."""
    return F.bround(col, digits)


def dollar_label(df: DataFrame, value: str, units: str = "M", out: str = "value_text") -> DataFrame:
    """``$`` + amount in units + unit letter (``scales::dollar`` rules).

    Cents are shown only when every scaled amount fits under 1,000 and at
    least one is not whole -- a property of the whole column, computed with
    one aggregate (a single row reaches the driver).
    """
    unit_val = UNITS[units]
    suffix = "" if units == "0" else units
    scaled = F.col(value) / F.lit(unit_val)
    stats = df.agg(F.max(F.abs(scaled)).alias("mx"),
                   F.max(F.when(scaled != F.floor(scaled), 1).otherwise(0)).alias("frac")).first()
    cents = stats is not None and stats["mx"] is not None and stats["mx"] <= LARGEST_WITH_CENTS \
        and bool(stats["frac"])
    amount = F.format_number(scaled, 2) if cents else F.format_number(F.round(scaled, 0), 0)
    return df.withColumn(out, F.concat(F.lit("$"), amount, F.lit(suffix)))
