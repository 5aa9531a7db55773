"""Training-data pipeline: each stage's rows are written and reread as the next one's documents.

Language ID lets go what has no letters, and longer texts of which no language holds
half; exact dedup, then SimHash near-dedup keep one row of each group; mixing
returns per document and turn the words that the mixture takes; packing
returns the pieces of the sequences.

A null text is let go by the first stage; rows with a null or repeated id, language or source
stay rows of their own; repeated rows fall to exact dedup; columns that carry an
operator's working names come through unchanged; an empty table gives an empty result.

A stage's rows are to be written before the next stage on the same folder of
tables is called: each stage first removes the working tables that the stages
before it left.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from turnstile.llm import exact_dedup, langid, mixing, packing, simhash  # noqa: E402
from turnstile.llm.workspace import Workspace, delete_folder  # noqa: E402

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: No SQL: the network and the seeded permutations can't be expressed; tests
#: hold each stage against a brute-force version.
ORACLE_SQL = None


#: Working tables that the frame returned last still reads, by the folder of tables it was made for.
_left: dict[str, str] = {}


def _begin(spark: SparkSession, sf_dir: str) -> None:
    """The earlier stage's rows have been written, so nothing reads its working tables."""
    if sf_dir in _left:
        delete_folder(spark, _left.pop(sf_dir))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language the network can tell; rows with a letter when there is nothing to learn from."""
    _begin(spark, sf_dir)
    return langid.named(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the one with the least id."""
    _begin(spark, sf_dir)
    found = exact_dedup.ExactDedup(docs, carry=True)
    _left[sf_dir] = found.work.root
    return found.kept()


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near fingerprints: the one with the least id."""
    _begin(spark, sf_dir)
    found = simhash.NearDedup(docs, carry=True)
    _left[sf_dir] = found.work.root
    return found.kept()


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document and turn, the words that the mixture takes; n_chars counted anew."""
    _begin(spark, sf_dir)
    found = mixing.Mix(docs, carry=True)
    _left[sf_dir] = found.work.root
    return found.mixed_rows("n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    _begin(spark, sf_dir)
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id), ("exact_dedup", exact), ("simhash_near_dedup", near), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    last = None
    for name, stage in STAGES:
        docs = work.put(stage(spark, docs, sf_dir), name)
        if last:
            work.drop(last)
        last = name
    return docs
