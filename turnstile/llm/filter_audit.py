"""Audit of text filters and their order, with duplicates found by radix tries.

1. *Claim* (no shuffle): a reading task tests its texts and inserts them whole
   into a compressed trie, a bounded window at a time.  A terminal holds the
   least id of its text; a row that meets a lesser id is a duplicate for sure and
   needs no text any more, so a text that makes up a third of all rows leaves
   each window once.
2. *Ranges*: the claims are cut into ranges of their leading characters.  Where
   the texts behind a prefix weigh more than a range may hold, the prefix is
   made four times as long, until it is light or has one text only; the hash of
   the prefix so found splits the range.  A single text that is claimed very
   often is first combined by salted tries.
3. *Tries*: one task per range inserts its claims; traversing the trie tells
   which rows hold their text's least id, the others get the duplicate bit.
4. *Masks*: rows are counted by part, mask of failed filters and labels; all
   orders are evaluated from at most ``2 ** filters`` counts a part.

Defined results: a null text counts as empty, a null part as the empty string;
all empty texts are identical; a null id is greater than all others, so it never
makes another row a duplicate; rows with the same id and text are no duplicates
of each other; a document has a label if any row of ``labels`` gives it, and a
null id has none; an empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workspace import Workspace

#: Text bytes a claim task holds before it emits what it has.
WINDOW_BYTES = 8 << 20
#: Text bytes (and overhead of rows) that one trie is to hold.
RANGE_BYTES = 16 << 20
#: Claims of one text that are combined by salted tries first.
HOT_CLAIMS = 4096
ROW_BYTES = 200
LEAD = 16

MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 50, 65, 5
LETTERS = "ABCDE"
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_INSIDE = bytes(range(0x80, 0xC0))  # UTF-8 bytes that begin no character
_SYMBOLS = re.compile(rb"[#$%&*|]")


def failed(raw: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words = raw.split()  # bytes split at ASCII white space only
    mask = len(words) < MIN_WORDS
    mask |= (100 * len(set(words)) < MIN_DISTINCT * len(words)) << 1
    capitals = len(raw) - len(raw.translate(None, _UPPER))
    mask |= (100 * capitals > MAX_CAPITALS * len(raw.translate(None, _INSIDE))) << 2
    return mask | (_SYMBOLS.search(raw) is not None) << 3


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the longest beginning of ``a`` that stands in ``b`` at ``at``."""
    low, high = 0, len(a)
    while low < high:
        mid = (low + high + 1) // 2
        if b.startswith(a[:mid], at):
            low = mid
        else:
            high = mid - 1
    return low


class Trie:
    """Compressed radix trie over bytes.  A node is ``[label, children by first
    byte, value]``; ``terminal`` gives the node where a text ends."""

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]

    def terminal(self, text: bytes) -> list:
        node, at = self.root, 0
        while at < len(text):
            child = node[1].get(text[at])
            if child is None:
                child = node[1][text[at]] = [text[at:], {}, None]
                return child
            if not text.startswith(child[0], at):
                shared = _common(child[0], text, at)
                upper = [child[0][:shared], {child[0][shared]: child}, None]
                child[0] = child[0][shared:]
                node[1][text[at]] = child = upper
            node, at = child, at + len(child[0])
        return node

    def items(self) -> Iterator[tuple[bytes, object]]:
        """(text, value) of each terminal that has a value."""
        todo = [(b"", self.root)]
        while todo:
            before, node = todo.pop()
            text = before + node[0]
            if node[2] is not None:
                yield text, node[2]
            todo += [(text, child) for child in node[1].values()]


_FIELDS = ["id", "part", "mask", "n", "text"]


def _insert(id_type: pa.DataType, duplicate: int, window_bytes: int | None, last: bool) -> Callable:
    """Rows (id, part, mask or null, n, text) -> rows whose duplicate bit is settled, without text,
    and (unless ``last``) the rows that hold the least id so far, with text."""
    schema = pa.schema(list(zip(_FIELDS, [id_type, pa.string(), pa.int32(), pa.int64(), pa.binary()])))

    def flush(trie: Trie, settled: dict) -> Iterator[pa.RecordBatch]:
        rows, held = [(*key, n, None) for key, n in settled.items()], 0
        for text, (mask, (_, best), least) in trie.items():
            rows += [(best, part, mask, n, None if last else text) for part, n in least.items()]
            held += 0 if last else len(text) * len(least)
            if held >= 4 << 20 or len(rows) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, settled, held = Trie(), {}, 0

        def settle(row_id, part, mask, n) -> None:
            key = (row_id, part, mask | duplicate)
            settled[key] = settled.get(key, 0) + n

        for batch in batches:
            for row_id, part, mask, n, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
                node = trie.terminal(text)
                rank = (row_id is None, row_id)
                found = node[2]
                held += ROW_BYTES
                if found is None:
                    node[2] = [failed(text) if mask is None else mask, rank, {part: n}]
                    held += len(text)
                elif rank == found[1]:
                    found[2][part] = found[2].get(part, 0) + n
                elif found[1][0] or not rank[0] and rank[1] < found[1][1]:
                    for old, count in found[2].items():
                        settle(found[1][1], old, found[0], count)
                    found[1:] = [rank, {part: n}]
                else:
                    settle(row_id, part, found[0], n)
                if window_bytes and held >= window_bytes:
                    yield from flush(trie, settled)
                    trie, settled, held = Trie(), {}, 0
        yield from flush(trie, settled)

    return run


def _prefix(text: Column, length: int) -> Column:
    return F.xxhash64(F.substring(text, 1, length))


class FilterAudit:
    """``flags()``: rows counted by (id, part, mask); ``report()``: all orders of the filters."""

    def __init__(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
                 window_bytes: int = WINDOW_BYTES, range_bytes: int = RANGE_BYTES, hot_claims: int = HOT_CLAIMS) -> None:
        self.work = work = Workspace(df.sparkSession, "filter-audit")
        self.id_col, self.range_bytes, self.hot_claims = id_col, range_bytes, hot_claims
        self.id_type = id_type = df.schema[id_col].dataType
        self.arrow_id = pa.int64() if isinstance(id_type, T.LongType) else pa.int32() if isinstance(id_type, T.IntegerType) else pa.string()
        source = df.select(
            F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
            F.lit(None).cast("int").alias("mask"), F.lit(1).cast("long").alias("n"),
            F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
        claims = work.put(self._tries(source, window_bytes, False), "claims")
        done = [claims.where("text is null").drop("text")]
        held = claims.where("text is not null")
        turn, most = 0, None
        while True:
            # a text claimed very often: one claim a salt stays (and rows that tie in their id)
            hot = self._often(held, turn)
            met = hot.agg(F.sum("n")).first()[0]
            if not met or most and met >= most:
                break
            most = met
            salted = held.join(F.broadcast(hot.drop("n")), F.xxhash64("text") == F.col("__hot"), "left")
            some = salted.where("__hot is not null").repartition("__hot", F.pmod(F.xxhash64("id", "part"), F.col("__salts")))
            fewer = work.put(self._tries(some.select(*_FIELDS), None, False), f"claims-{turn}")
            done.append(fewer.where("text is null").drop("text"))
            rest = salted.where("__hot is null").select(*_FIELDS)
            held = rest.unionByName(fewer.where("text is not null"))
            turn += 1
        size = held.agg(F.sum(F.octet_length("text") + ROW_BYTES)).first()[0] or 0
        ranges = max(1, math.ceil(size / range_bytes))
        dealt = self._keys(held).repartitionByRange(ranges, "__lead", "__spread").select(*_FIELDS)
        done.append(self._tries(dealt, None, True).drop("text"))
        rows = done[0]
        for more in done[1:]:
            rows = rows.unionByName(more)
        self.rows = work.put(rows, "flags")
        work.drop("claims", *[f"claims-{t}" for t in range(turn)])

    def _tries(self, rows: DataFrame, window_bytes: int | None, last: bool) -> DataFrame:
        fields = zip(_FIELDS, [self.id_type, T.StringType(), T.IntegerType(), T.LongType(), T.BinaryType()])
        duplicate = 1 << (len(LETTERS) - 1)
        return rows.mapInArrow(_insert(self.arrow_id, duplicate, window_bytes, last),
                               T.StructType([T.StructField(name, kind) for name, kind in fields]))

    def _often(self, held: DataFrame, turn: int) -> DataFrame:
        """Texts with more than ``hot_claims`` claims: at most (number of claims) / ``hot_claims`` rows, which are broadcast."""
        often = held.groupBy(F.xxhash64("text").alias("__hot")).agg(F.count("*").alias("n")).where(F.col("n") > self.hot_claims)
        return self.work.put(often.select("__hot", "n", F.floor(F.sqrt("n")).cast("long").alias("__salts")), f"often-{turn}")

    def _keys(self, held: DataFrame) -> DataFrame:
        """Adds the leading characters and the hash of a prefix that is long enough.

        Each table of heavy prefixes has at most 2 * (bytes of all claims) / ``range_bytes`` rows and is broadcast.
        """
        text, whole = F.col("text").cast("string"), F.xxhash64("text")
        rows = held.withColumns({"__lead": F.substring(text, 1, LEAD), "__spread": _prefix(text, LEAD)})
        length = LEAD
        under = rows
        while True:
            weights = under.groupBy("__spread").agg(
                F.sum(F.octet_length("text") + ROW_BYTES).alias("bytes"), F.min(whole).alias("a"), F.max(whole).alias("b"))
            heavy = weights.where((F.col("bytes") > self.range_bytes // 2) & (F.col("a") != F.col("b")))
            heavy = self.work.put(heavy.select(F.col("__spread").alias("__heavy")), f"prefixes-{length}")
            if heavy.isEmpty():
                return rows
            length *= 4
            met = F.col("__spread") == F.col("__heavy")
            longer = F.when(F.col("__heavy").isNotNull(), _prefix(text, length)).otherwise(F.col("__spread"))
            under = under.join(F.broadcast(heavy), met).withColumn("__spread", _prefix(text, length)).drop("__heavy")
            rows = rows.join(F.broadcast(heavy), met, "left").withColumn("__spread", longer).drop("__heavy")

    def flags(self) -> DataFrame:
        """id, part, mask (bit k: fails the k-th filter, the last one is the duplicate filter), n rows."""
        found = self.rows.groupBy("id", "part", "mask").agg(F.sum("n").alias("n"))
        return found.withColumnRenamed("id", self.id_col)

    def report(self, labels: DataFrame) -> DataFrame:
        """Per part, order of all filters and step: what the step's filter removes, and what it would have."""
        marks = labels.groupBy(F.col(self.id_col).alias("__id")).agg(
            F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
        flags = self.flags()
        marked = flags.join(marks, flags[self.id_col] == marks["__id"], "left")
        zero = F.lit(0).cast("long")
        counts = marked.groupBy("part", "mask").agg(
            F.sum("n").alias("rows"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(zero)).alias("good"),
            F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(zero)).alias("toxic"))
        # at most 2 ** filters masks a part
        parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "rows", "good", "toxic")).alias("__masks"))
        orders = " ".join("".join(p) for p in itertools.permutations(LETTERS))
        steps = parts.select("part", "__masks", F.explode(F.split(F.lit(orders), " ")).alias("filter_order"))
        steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step"))
        place = f"locate(substring(filter_order, {{}}, 1), '{LETTERS}') - 1"
        steps = steps.withColumns({
            "__bit": F.expr(f"shiftleft(1, {place.format('step')})"),
            "__before": F.expr(f"aggregate(sequence(1, step), 0, (a, k) -> a | shiftleft(1, {place.format('k')}))")})
        bit, before = F.col("__bit"), F.col("__before").bitwiseXOR(F.col("__bit"))

        def total(picked: Callable[[Column], Column], what: str = "rows", times: Callable[[Column], Column] = lambda m: zero + 1) -> Column:
            return F.aggregate("__masks", zero, lambda a, x: a + F.when(picked(x["mask"]), x[what] * times(x["mask"])).otherwise(zero))

        def fails(mask: Column) -> Column:
            return mask.bitwiseAND(bit) != 0

        def gone(mask: Column) -> Column:
            return mask.bitwiseAND(before) != 0

        # a row that fails k filters is removed by each of them in one k-th of the orders
        share = lambda m: F.floor(F.lit(math.factorial(len(LETTERS))) / F.bit_count(m)).cast("long")
        return steps.select(
            "part", "filter_order", "step",
            total(lambda m: ~fails(m) & ~gone(m)).alias("kept"), total(lambda m: fails(m) & ~gone(m)).alias("removed"),
            total(lambda m: fails(m) & gone(m)).alias("redundant"), total(lambda m: m == bit).alias("unique_fails"),
            total(lambda m: fails(m) & ~gone(m), "good").alias("good_lost"),
            total(lambda m: fails(m) & ~gone(m), "toxic").alias("toxic_lost"), total(fails, times=share).alias("shapley"))
