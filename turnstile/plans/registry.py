"""Query catalogue: each entry is a Spark builder plus, where SQL can state the
same result, a DuckDB oracle over the same parquet tables.

Builders take ``(spark, sf_dir)`` and return a DataFrame; every builder reads
the driver tables (or what Spark derives from them) in full.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    build: Builder
    sql: str | None


CATALOG: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn`` as query ``name`` with its oracle SQL (or None)."""

    def deco(fn: Builder) -> Builder:
        if name in CATALOG:
            raise ValueError(f"duplicate query {name}")
        CATALOG[name] = Entry(name, fn, sql)
        return fn

    return deco


def load_all() -> dict[str, Entry]:
    """Import every query module (registration happens at import)."""
    from . import (q_relational, q_domain, q_features, q_evaluation, q_policy, q_models,  # noqa: F401
                   q_streaming, q_udf)
    q_domain.attach_late_sql()
    q_features.attach_recipe_sql()
    return CATALOG


def set_sql(name: str, sql: str) -> None:
    """Attach oracle SQL to an entry registered before the SQL was built."""
    e = CATALOG[name]
    CATALOG[name] = Entry(e.name, e.build, sql)
