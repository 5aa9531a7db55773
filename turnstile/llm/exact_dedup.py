"""Exact dedup with an extendible-hash index on shared files.

1. *Claim* (no shuffle): every task hashes its normalised texts and collapses
   the copies that it meets within a bounded window, so that a text which
   makes up a third of all rows leaves each window once.  The claims of a text
   that very many windows make are counted by their digest, and one of them stands for all.
2. *Index*: the 64-bit key space is cut into 2**r key ranges, sized from the
   bytes to be indexed.  An owner task inserts a range's claims into an
   extendible-hash directory; a bucket over capacity splits, and the directory
   doubles when the bucket was as deep as the directory.  Equal keys chain in
   their bucket, and only equal bytes join a chain entry.  The entries are
   written to the shared folder.  Beyond ``2 ** TASK_BITS`` ranges a task
   does several, one after another.
3. *Answer*: rows look up the entry of their window's claim.

Defined results: a null text counts as empty; all empty texts are one group; a
null id sorts after all others; of repeated rows (equal text and id) one is
kept; an empty table gives an empty result.  Other columns are never read but
by ``kept``, which returns them unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workspace import Workspace, releasing

#: Text bytes a claim task holds before it emits what it has.
WINDOW_BYTES = 4 << 20
#: Text bytes of a key range.
OWNER_BYTES = 8 << 20
#: Owner tasks at most, as a power of two.
TASK_BITS = 16
#: Claims of one text that travel one by one.
HOT_CLAIMS = 32
#: Keys a bucket holds before it splits.
BUCKET_KEYS = 512
KEY_BITS = 64

_SPACE = b" \t\n\x0b\x0c\r"


def normalise(text: str | None) -> bytes:
    """UTF-8 bytes with each run of ASCII white space as one space."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return raw
    words = raw.split()  # bytes split at ASCII white space only
    if not words:
        return b" "
    return b" " * (raw[0] in _SPACE) + b" ".join(words) + b" " * (raw[-1] in _SPACE)


class Directory:
    """Extendible-hash directory of one owner's key range.

    ``slots`` maps the next ``depth`` bits after the range's own prefix to a
    bucket ``[local depth, {key: chain}]``; several slots may share a bucket.
    """

    def __init__(self, range_bits: int, capacity: int = BUCKET_KEYS, key_bits: int = KEY_BITS) -> None:
        self.free_bits = key_bits - range_bits
        self.capacity = capacity
        self.depth = 0
        self.slots: list[list] = [[0, {}]]

    def _slot(self, key: int) -> int:
        own = key & ((1 << self.free_bits) - 1)
        return own >> (self.free_bits - self.depth)

    def chain(self, key: int) -> list:
        """The chain of ``key``, made (with any splits it takes) if absent."""
        while True:
            bucket = self.slots[self._slot(key)]
            found = bucket[1].get(key)
            if found is not None:
                return found
            if len(bucket[1]) < self.capacity or bucket[0] == self.free_bits:
                return bucket[1].setdefault(key, [])
            self._split(self._slot(key))

    def _split(self, slot: int) -> None:
        local, entries = self.slots[slot]
        if local == self.depth:
            self.slots = [b for b in self.slots for _ in (0, 1)]
            self.depth += 1
            slot *= 2
        span = 1 << (self.depth - local)
        first = slot - slot % span
        halves: list[list] = [[local + 1, {}], [local + 1, {}]]
        for key, chain in entries.items():
            halves[self._slot(key) >= first + span // 2][1][key] = chain
        for i in range(span):
            self.slots[first + i] = halves[i >= span // 2]

    def buckets(self) -> Iterator[tuple[int, int, dict]]:
        """(bucket prefix, local depth, entries) of each bucket once."""
        at = 0
        while at < len(self.slots):
            local, entries = self.slots[at]
            yield at >> (self.depth - local), local, entries
            at += 1 << (self.depth - local)


def _rank(row_id, rid: int) -> tuple:
    return (row_id is None, 0 if row_id is None else row_id, rid)


def _claim(id_type: pa.DataType, window_bytes: int, key_bits: int) -> Callable:
    schema = pa.schema([("rid", pa.int64()), ("id", id_type), ("rep", pa.int64()), ("key", pa.int64()),
                        ("sha", pa.string()), ("copies", pa.int64()), ("n_bytes", pa.int64()),
                        ("text", pa.binary())])

    def key_of(sha: str) -> int:
        key = int(sha[:16], 16) >> (64 - key_bits)
        return key - (1 << 64) if key >> 63 else key

    def flush(rows: list) -> pa.RecordBatch:
        # the group where the row makes its claim, else nothing
        claims = [group if group[0][2] == rid else None for rid, _, group in rows]
        columns = [[r[0] for r in rows], [r[1] for r in rows], [r[2][0][2] for r in rows], [g and key_of(g[1]) for g in claims]]
        columns += [[g and g[k] for g in claims] for k in (1, 2, 3, 4)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []
        groups: dict = {}  # normalised bytes -> [least row, digest, copies, size, bytes]
        held = 0
        for batch in batches:
            for rid, row_id, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                norm = normalise(text)
                mine = _rank(row_id, rid)
                group = groups.get(norm)
                if group is None:
                    group = groups[norm] = [mine, hashlib.sha256(norm).hexdigest(), 1, len(norm), norm]
                    held += len(norm)
                else:
                    group[0] = min(group[0], mine)
                    group[2] += 1
                held += 200
                rows.append((rid, row_id, group))
                if held >= window_bytes:
                    yield flush(rows)
                    rows, groups, held = [], {}, 0
        if rows:
            yield flush(rows)

    return run


def _own(id_type: pa.DataType, range_bits: int, capacity: int, key_bits: int) -> Callable:
    schema = pa.schema([("rep", pa.int64()), ("keep_rid", pa.int64()), ("keep_id", id_type),
                        ("group_size", pa.int64()), ("sha", pa.string()), ("key", pa.int64()),
                        ("bucket", pa.int64()), ("depth", pa.int32()), ("link", pa.int32())])

    def entries(index: Directory) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[] for _ in schema]
        for prefix, depth, held in index.buckets():
            for key, chain in held.items():
                signed = key - (1 << 64) if key >> 63 else key
                for link, (_, best, size, reps, sha) in enumerate(chain):
                    columns[0] += reps
                    for column, value in zip(columns[1:], (best[2], None if best[0] else best[1], size, sha, signed, prefix, depth, link)):
                        column += [value] * len(reps)
            if len(columns[0]) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
                columns = [[] for _ in schema]
        if columns[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, index = None, Directory(range_bits, capacity, key_bits)
        for batch in batches:
            for mine, rid, row_id, key, sha, copies, text in zip(*(batch.column(i) for i in range(7))):
                if mine.as_py() != owner:  # a task's ranges come one after another
                    yield from entries(index)
                    owner, index = mine.as_py(), Directory(range_bits, capacity, key_bits)
                rid, norm = rid.as_py(), text.as_py()
                mine = _rank(row_id.as_py(), rid)
                chain = index.chain(key.as_py() & ((1 << 64) - 1))
                for entry in chain:
                    if entry[0] == norm:
                        entry[1] = min(entry[1], mine)
                        entry[2] += copies.as_py()
                        entry[3].append(rid)
                        break
                else:
                    chain.append([norm, mine, copies.as_py(), [rid], sha.as_py()])
        yield from entries(index)

    return run


class ExactDedup:
    """Result of one run: ``assign()`` per row, ``kept()`` rows that stay.

    ``index`` is the written index: one row per claim with its bucket (owner
    range, prefix after it, local depth), key, place in the chain and the group's answer.
    """

    def __init__(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False,
                 window_bytes: int = WINDOW_BYTES, owner_bytes: int = OWNER_BYTES,
                 bucket_keys: int = BUCKET_KEYS, key_bits: int = KEY_BITS, hot_claims: int = HOT_CLAIMS,
                 task_bits: int = TASK_BITS) -> None:
        spark = df.sparkSession
        self.work = Workspace(spark, "exact-dedup")
        self.columns = df.columns
        id_type = df.schema[id_col].dataType
        arrow_id = pa.int64() if isinstance(id_type, T.LongType) else pa.int32() if isinstance(id_type, T.IntegerType) else pa.string()
        rows = df.withColumns({"__rid": F.monotonically_increasing_id()})
        if carry:  # a row's other columns must be found by the id that the claims use
            rows = self.work.put(rows, "rows")
        self.rows = rows
        source = rows.select(F.col("__rid"), F.col(id_col), F.col(text_col))
        fields = [("rid", T.LongType()), ("id", id_type), ("rep", T.LongType()), ("key", T.LongType()), ("sha", T.StringType()),
                  ("copies", T.LongType()), ("n_bytes", T.LongType()), ("text", T.BinaryType())]
        claims = self.work.put(source.mapInArrow(releasing(_claim(arrow_id, window_bytes, key_bits)),
                                                 T.StructType([T.StructField(*f) for f in fields])), "claims")
        self.members = self.work.put(claims.select("rid", "id", "rep"), "members")
        claimed = claims.where(F.col("key").isNotNull())
        total = claimed.agg(F.sum("n_bytes")).first()[0] or 0
        self.range_bits = range_bits = min(max(0, (int(total) // owner_bytes).bit_length()), key_bits - 1)
        # texts that very many windows claim: at most (number of claims) / hot_claims rows
        least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid")).alias("least")
        hot = claimed.groupBy(F.col("sha").alias("hot_sha")).agg(F.count("*").alias("claims"), F.sum("copies").alias("hot_copies"), least)
        hot = self.work.put(hot.where(F.col("claims") > hot_claims).select("hot_sha", "hot_copies", F.col("least.rid").alias("holder")), "hot")
        marked = claimed.join(F.broadcast(hot), F.col("sha") == F.col("hot_sha"), "left")
        owner = F.shiftrightunsigned(F.col("key"), key_bits - range_bits) if range_bits else F.lit(0)
        sent = marked.where("holder is null or rid = holder").select(
            owner.cast("long").alias("owner"), "rid", "id", "key", "sha", F.coalesce("hot_copies", "copies").alias("copies"), "text")
        bits = min(range_bits, task_bits)
        dealt = sent.repartitionById(1 << bits, F.shiftright("owner", range_bits - bits).cast("int"))
        if range_bits > bits:
            dealt = dealt.sortWithinPartitions("owner")
        fields = [("rep", T.LongType()), ("keep_rid", T.LongType()), ("keep_id", id_type), ("group_size", T.LongType()),
                  ("sha", T.StringType()), ("key", T.LongType()), ("bucket", T.LongType()), ("depth", T.IntegerType()), ("link", T.IntegerType())]
        index = self.work.put(dealt.mapInArrow(releasing(_own(arrow_id, range_bits, bucket_keys, key_bits)),
                                               T.StructType([T.StructField(*f) for f in fields])), "index")
        # the other claims of a hot text have its holder's answer
        others = marked.where("rid <> holder").select(F.col("rid").alias("other"), "holder")
        answers = index.join(others, index["rep"] == others["holder"]).withColumn("rep", F.col("other")).select(*index.columns)
        self.index = self.work.put(index.unionByName(answers), "answers") if not hot.isEmpty() else index
        self.work.drop("claims", "hot")

    def assign(self, id_name: str = "doc_id") -> DataFrame:
        """One row per input row: id, keep_id, group_size, kept, text_sha256."""
        found = self.index.select("rep", "keep_rid", "keep_id", "group_size", "sha")
        out = self.members.join(found, "rep").select(
            F.col("id").alias(id_name), "keep_id", "group_size",
            (F.col("rid") == F.col("keep_rid")).alias("kept"), F.col("sha").alias("text_sha256"))
        return self.work.put(out, "answer")

    def kept(self) -> DataFrame:
        """The rows that stay, with all their columns (needs ``carry``)."""
        gone = self.members.join(self.index.select("rep", "keep_rid"), "rep").where("rid <> keep_rid").select("rid")
        gone = self.work.put(gone.withColumnRenamed("rid", "__rid"), "gone")
        return self.rows.join(gone, "__rid", "left_anti").select(*self.columns)
