"""SimHash near-dedup by tiled exact comparison.

Fingerprints within ``radius`` bits of each other agree on at least one of
``radius + 1`` words of the fingerprint, so the comparison table is cut along
these words: a tile holds fingerprints whose word begins with the same bits
(as many bits as keep a tile near ``TILE_ROWS``).  Inside a tile the rows stand in
order of their population count; numpy xors strips against the stretch whose
counts are within the radius and skips all other strip pairs.  A tile with
more rows than ``TILE_MAX`` is cut along the population count into parts, and
each pair of parts whose counts come within the radius is a task of its own.

Every pair within the radius is met in some tile, so no link is lost; a tile
reports its links as stars (one row per linked fingerprint), which keeps
components whole without listing pairs.

Defined results: a null text counts as empty; empty texts have fingerprint
zero and link like any other; repeated rows link (distance zero); a null id
sorts after all others and gets the group's least id (null if it has none);
an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .workspace import Workspace, releasing

SHINGLE_WORDS = 3
RADIUS = 3
SEED = 42
TILE_ROWS = 1024
TILE_MAX = 4096
#: Shingles hashed at once; the bit sums of a longer text add up over such blocks.
BLOCK = 1 << 15


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """64-bit SimHash of a text's word shingles (repeats included)."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(parts) - words + 1)
    firsts, lasts = starts[:n].tolist(), ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(firsts[at:at + BLOCK], lasts[at:at + BLOCK])], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["__rid", "fp"])

    return run


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within ``radius`` bits; strips of ``a`` against the part of
    ``b`` (in order of population count) that the counts allow."""
    bits_a, bits_b = np.bitwise_count(a).astype(np.int64), np.bitwise_count(b).astype(np.int64)
    left, right = [], []
    for at in range(0, len(a), 256):
        strip, counts = a[at:at + 256], bits_a[at:at + 256]
        lo = np.searchsorted(bits_b, counts[0] - radius, "left")
        hi = np.searchsorted(bits_b, counts[-1] + radius, "right")
        if lo == hi:
            continue
        i, j = np.nonzero(np.bitwise_count(strip[:, None] ^ b[None, lo:hi]) <= radius)
        left.append(i + at)
        right.append(j + lo)
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _stars(fps: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[list, list]:
    """Linked fingerprints with the least of their component in this tile."""
    root = np.arange(len(fps))
    while True:  # minimum label with pointer jumping
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    linked = root != np.arange(len(fps))
    return fps[linked].tolist(), fps[root[linked]].tolist()


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _tile(radius: int):
    """Links of one tile; ``part`` tells the two sides of a pair of parts (0: one tile against itself)."""

    def run(table: pa.Table) -> pa.Table:
        fps = table.column("fp").to_numpy().view(np.uint64)
        part = table.column("part").to_numpy()
        order = np.lexsort((fps, np.bitwise_count(fps)))
        fps, part = fps[order], part[order]
        if (part == part[0]).all():
            i, j = _near(fps, fps, radius)
            keep = i < j
            i, j = i[keep], j[keep]
        else:
            one, two = np.nonzero(part == part.min())[0], np.nonzero(part != part.min())[0]
            i, j = _near(fps[one], fps[two], radius)
            i, j = one[i], two[j]
        a, b = _stars(fps.view(np.int64), i, j)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())}, schema=_LINKS)

    return run


def near_links(fps: DataFrame, work: Workspace, radius: int = RADIUS, tile_rows: int = TILE_ROWS,
               tile_max: int = TILE_MAX) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) that hold their components together."""
    total = fps.count()
    words = radius + 1
    width = 64 // words
    cut = min(width, max(0, math.ceil(math.log2(max(1, total) / tile_rows))))
    word = [F.shiftrightunsigned(F.shiftleft("fp", k * width), 64 - cut) if cut else F.lit(0).cast("long") for k in range(words)]
    rows = fps.select("fp", F.bit_count("fp").alias("ones"), F.posexplode(F.array(*word)).alias("word", "value"))
    # parts of a tile: one, or stretches of population counts split by hash
    levels = work.put(rows.groupBy("word", "value", "ones").agg(F.count("*").alias("n")), "levels")
    size = levels.groupBy("word", "value").agg(F.sum("n").alias("size"))
    full = size.where(F.col("size") > tile_max).select("word", "value")
    parts = levels.join(full, ["word", "value"]).withColumn("splits", F.ceil(F.col("n") / tile_rows).cast("int"))
    parts = work.put(parts.select("word", "value", "ones", "splits"), "parts")
    single = size.where(F.col("size").between(2, tile_max)).select("word", "value")
    one = rows.join(single, ["word", "value"]).select(
        "word", "value", F.lit(-1).alias("low"), F.lit(-1).alias("low_split"), F.lit(-1).alias("high"),
        F.lit(-1).alias("high_split"), F.lit(0).alias("part"), "fp")
    links = one.groupBy("word", "value", "low", "low_split", "high", "high_split").applyInArrow(_tile(radius), "a long, b long")
    if not parts.isEmpty():
        lower = parts.select("word", "value", F.col("ones").alias("low"), F.explode(F.expr("sequence(0, splits - 1)")).alias("low_split"))
        upper = parts.select("word", "value", F.col("ones").alias("high"), F.explode(F.expr("sequence(0, splits - 1)")).alias("high_split"))
        pairs = lower.join(upper, ["word", "value"]).where(
            (F.col("high") - F.col("low")).between(0, radius)
            & ((F.col("high") > F.col("low")) | (F.col("high_split") >= F.col("low_split"))))
        held = rows.join(parts, ["word", "value", "ones"]).withColumn(
            "split", F.pmod(F.xxhash64("fp"), F.col("splits")).cast("int"))
        key = ["word", "value", "low", "low_split", "high", "high_split"]
        # each side of a pair of parts; a part against itself is sent once
        as_low = held.withColumnsRenamed({"ones": "low", "split": "low_split"}).join(
            pairs, ["word", "value", "low", "low_split"]).select(*key, F.lit(0).alias("part"), "fp")
        as_high = held.withColumnsRenamed({"ones": "high", "split": "high_split"}).join(
            pairs.where("low <> high or low_split <> high_split"), ["word", "value", "high", "high_split"]).select(
            *key, F.lit(1).alias("part"), "fp")
        links = links.unionByName(as_low.unionByName(as_high).groupBy(*key).applyInArrow(_tile(radius), "a long, b long"))
    return links


class NearDedup:
    """Result of one run: ``assign()`` per row, ``kept()`` one row per group."""

    def __init__(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False,
                 words: int = SHINGLE_WORDS, radius: int = RADIUS, tile_rows: int = TILE_ROWS,
                 tile_max: int = TILE_MAX) -> None:
        self.work = Workspace(df.sparkSession, "simhash")
        self.columns = df.columns
        rows = df.withColumn("__rid", F.monotonically_increasing_id())
        self.rows = rows = self.work.put(rows, "rows") if carry else rows
        id_type = df.schema[id_col].dataType
        source = rows.select(F.struct("__rid", F.col(id_col).alias("id")).alias("__rid"), text_col)
        marked = source.mapInArrow(releasing(_fingerprints(words)), T.StructType([
            T.StructField("__rid", T.StructType([T.StructField("__rid", T.LongType()), T.StructField("id", id_type)])),
            T.StructField("fp", T.LongType())]))
        self.marked = self.work.put(marked.select("__rid.__rid", "__rid.id", "fp"), "marked")
        # least id (nulls last), then least row, of each distinct fingerprint
        first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "__rid"))
        self.prints = self.work.put(self.marked.groupBy("fp").agg(first.alias("first")), "prints")
        links = self.work.put(near_links(self.prints.select("fp"), self.work, radius, tile_rows, tile_max), "links")
        found = components(links, self.work)
        prints = self.prints.join(found.withColumnRenamed("vertex", "fp"), "fp", "left").withColumn(
            "root", F.coalesce("root", "fp"))
        roots = prints.groupBy("root").agg(F.min("first").alias("least"))
        self.groups = self.work.put(prints.join(roots, "root").select("fp", "least"), "groups")

    def assign(self, id_name: str = "doc_id") -> DataFrame:
        """One row per input row: id, fingerprint (16 hex digits), component_id."""
        return self.marked.join(self.groups, "fp").select(
            F.col("id").alias(id_name), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
            F.col("least.id").alias("component_id"))

    def kept(self) -> DataFrame:
        """The row of each group with the least id, with all its columns."""
        gone = self.marked.join(self.groups, "fp").where("__rid <> least.__rid").select("__rid")
        gone = self.work.put(gone, "gone")
        return self.rows.join(gone, "__rid", "left_anti").select(*self.columns)
