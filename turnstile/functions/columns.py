"""Column selection by name fragment, position, type and name
lists.  These work on the schema only (no data is read), then hand a column
list to ``select``/``drop``; the optimizer prunes the scan accordingly."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType)


def contains(df: DataFrame, fragment: str, ignore_case: bool = True) -> list[str]:
    """P3 tidyselect ``contains()``."""
    f = fragment.lower() if ignore_case else fragment
    return [c for c in df.columns if f in (c.lower() if ignore_case else c)]


def select_contains(df: DataFrame, fragment: str) -> DataFrame:
    return df.select(*contains(df, fragment))


def drop_contains(df: DataFrame, fragment: str) -> DataFrame:
    """P4 ``select(-contains(...))``."""
    return df.drop(*contains(df, fragment))


def move_first(df: DataFrame, *first: str) -> DataFrame:
    """P5 ``select(x, everything())``."""
    return df.select(*first, *[c for c in df.columns if c not in first])


def column_range(df: DataFrame, start: str, end: str) -> list[str]:
    """P6 ``a:b`` (inclusive, by position)."""
    cols = df.columns
    i, j = cols.index(start), cols.index(end)
    return cols[i:j + 1] if i <= j else cols[j:i + 1][::-1]


def columns_of_type(df: DataFrame, kind: str) -> list[str]:
    """P7 ``select_if(is.character / is.numeric)``."""
    if kind == "string":
        return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if kind == "numeric":
        return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]
    raise ValueError(f"unknown kind {kind!r}")


def all_of(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """P8 ``all_of``: every name must exist."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    return df.select(*names)


def sort_columns(df: DataFrame) -> DataFrame:
    """P9 ``select(sort(names(.)))`` (case-insensitive collation)."""
    return df.select(*sorted(df.columns, key=lambda c: (c.lower(), c)))


def rename_pattern(df: DataFrame, pattern: str, replacement: str) -> DataFrame:
    """P10 ``set_names(str_replace_all(names, pattern, replacement))``."""
    return df.withColumnsRenamed({c: c.replace(pattern, replacement) for c in df.columns
                                  if pattern in c})


def mutate_if(df: DataFrame, kind: str, fn: Callable[[Column], Column]) -> DataFrame:
    """P12 ``mutate_if(is.<kind>, fn)``: one projection for all matches."""
    from pyspark.sql import functions as F
    return df.withColumns({c: fn(F.col(c)) for c in columns_of_type(df, kind)})


def setdiff(names: Sequence[str], remove: Sequence[str]) -> list[str]:
    """U1 ``setdiff`` of name vectors, order kept."""
    gone = set(remove)
    return [n for n in names if n not in gone]
