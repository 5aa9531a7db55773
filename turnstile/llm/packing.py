"""Hierarchical multi-length packing.

Documents are tokenised and packed by the task that reads them, in blocks of
``BLOCK_TOKENS``; nothing is shuffled but one small row per piece.  Within a block:

1. a document's full windows of the longest tier stand alone, its remainder
   is routed to the shortest tier that holds it;
2. each tier, longest first, opens a window per remainder and fills the gap
   with whole remainders of shorter tiers, largest first; one cut closes it;
3. the shortest tier is filled end to end;
4. what is left when no shorter remainder exists is laid end to end into
   longest windows, and its tail into windows whose lengths are powers of two.

Every window is thus full.  Windows are numbered per length over all blocks, and
``step_id`` groups them so that each full step has ``STEP_TOKENS`` tokens of
one window length.

Defined results: a null text counts as empty and still has its end id;
repeated rows and ids are packed once per row; other columns are not read; an
empty table gives an empty result.  The packing follows the partitions that
the table is read in.
"""

from __future__ import annotations

import bisect
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .merges import Merger
from .pretokens import Pretokeniser
from .vocab import bundles
from .workspace import Workspace, releasing

VOCAB = "word_bpe_49k.json"
END_ID = 2
#: Window lengths, longest first; powers of two.
TIERS = (4096, 2048, 1024, 512)
BLOCK_TOKENS = 2_000_000
STEP_TOKENS = 1 << 17
#: Characters of text whose words are held at once (a longer text is held alone).
BUNDLE = 1_000_000
# fixed value: the vocabulary file's split pattern
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
#: Pre-tokens whose ids a worker remembers.
REMEMBERED = 150_000


class PieceIds(dict):
    """Pre-token -> its ids as little-endian 32-bit bytes, merged once and remembered."""

    def __init__(self, vocab: str) -> None:
        super().__init__()
        self.cutter = Pretokeniser(vocab, PATTERN, lower=True)
        self.merger = Merger(vocab)

    def learn(self, pieces: set[str]) -> None:
        new = list(pieces.difference(self))
        if len(self) + len(new) > REMEMBERED:
            self.clear()
            new = list(pieces)
        self.update(zip(new, self.merger.ids([p.encode("utf-8") for p in new])))

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as the library gives them."""
        cut = [self.cutter.cut(t) for t in texts]
        self.learn({p for found in cut if found for some in found[0] for p in some})
        out = []
        for text, found in zip(texts, cut):
            if found is None:
                out.append(np.array(self.cutter.encode(text), "<u4"))
                continue
            raw = [b"".join(map(self.__getitem__, some)) for some in found[0]]
            marks = [np.array([k], "<u4").tobytes() for k in found[1]] + [b""]
            out.append(np.frombuffer(b"".join(x for pair in zip(raw, marks) for x in pair), "<u4"))
        return out


@functools.lru_cache(maxsize=2)
def piece_ids(vocab: str) -> PieceIds:
    return PieceIds(vocab)


def pack_block(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Windows of (document, start, length) pieces; each full: of a tier's
    length or, in the block's tail, of another power of two."""
    longest, shortest = tiers[0], tiers[-1]
    windows: list[list[tuple[int, int, int]]] = []
    held: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}  # (length, document, start), in order

    def route(doc: int, start: int, length: int) -> None:
        tier = next(t for t in reversed(tiers) if length <= t)
        bisect.insort(held[tier], (length, doc, start))

    loose: dict[int, list] = {t: [] for t in tiers}
    for doc, n in enumerate(lengths):
        full = n // longest * longest
        windows += [[(doc, at, longest)] for at in range(0, full, longest)]
        if n > full:
            loose[next(t for t in reversed(tiers) if n - full <= t)].append((n - full, doc, full))
    for tier in tiers:
        held[tier] = sorted(loose[tier])

    left: list[tuple[int, int, int]] = []  # pieces of windows that nothing is left to fill
    for place, tier in enumerate(tiers[:-1]):
        shorter = tiers[place + 1:]
        while held[tier]:
            length, doc, start = held[tier].pop()
            window, gap = [(doc, start, length)], tier - length
            while gap:
                for t in shorter:
                    at = bisect.bisect_right(held[t], (gap, float("inf"), 0))
                    if at:
                        n, d, s = held[t].pop(at - 1)
                        window.append((d, s, n))
                        gap -= n
                        break
                else:  # none fits whole: cut the one that is next in length
                    t = next((t for t in reversed(shorter) if held[t]), None)
                    if t is None:
                        break
                    n, d, s = held[t].pop(0)
                    window.append((d, s, gap))
                    route(d, s + gap, n - gap)
                    gap = 0
            if gap:
                left += window
            else:
                windows.append(window)

    def lay(pieces: list[tuple[int, int, int]], sizes: Iterator[int]) -> None:
        """Cut the pieces, end to end, into windows of these sizes."""
        window: list[tuple[int, int, int]] = []
        gap = next(sizes, 0)
        for doc, start, length in pieces:
            while length:
                n = min(gap, length)
                window.append((doc, start, n))
                start, length, gap = start + n, length - n, gap - n
                if not gap:
                    windows.append(window)
                    window, gap = [], next(sizes, 0)

    ends = [(d, s, n) for n, d, s in held[shortest]]
    total = sum(n for _, _, n in ends)
    fit, whole = total // shortest * shortest, []
    for doc, start, length in ends:
        n = min(length, fit)
        if n:
            whole.append((doc, start, n))
        if length > n:
            left.append((doc, start + n, length - n))
        fit -= n
    lay(whole, iter([shortest] * (total // shortest)))
    total = sum(n for _, _, n in left)
    sizes = [longest] * (total // longest) + [1 << k for k in range(longest.bit_length() - 1, -1, -1) if total % longest >> k & 1]
    lay(left, iter(sizes))
    return windows


_PIECES = pa.schema([("id", pa.null()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                     ("doc_tokens", pa.int64()), ("part", pa.int64()), ("local", pa.int64()), ("window", pa.int64()),
                     ("offset", pa.int64())])


def _packer(id_type: pa.DataType, vocab: str, end_id: int, tiers: tuple[int, ...], block_tokens: int):
    schema = _PIECES.set(0, pa.field("id", id_type))
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, part, local = piece_ids(vocab), TaskContext.get().partitionId(), 0

        def block(keys: list, ids: list) -> pa.RecordBatch:
            nonlocal local
            out = []
            for window in pack_block([len(x) for x in ids], tiers):
                size, offset = sum(n for _, _, n in window), 0
                for doc, start, n in window:
                    out.append((keys[doc], start, n, zlib.crc32(ids[doc][start:start + n].tobytes()), len(ids[doc]),
                                part, local, size, offset))
                    offset += n
                local += 1
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        keys: list = []
        ids: list = []
        held = 0
        for batch in batches:
            at = iter(batch.column(0).to_pylist())
            for texts in bundles((t.as_py() or "" for t in batch.column(1)), BUNDLE):
                for some in pieces.ids(texts):
                    keys.append(next(at))
                    ids.append(np.concatenate([some, end]))
                    held += len(ids[-1])
                    if held >= block_tokens:
                        yield block(keys, ids)
                        keys, ids, held = [], [], 0
        if keys:
            yield block(keys, ids)
        pieces.clear()  # the worker lives on and serves other stages

    return run


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = VOCAB, end_id: int = END_ID,
         tiers: tuple[int, ...] = TIERS, block_tokens: int = BLOCK_TOKENS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, window (the sequence's length), step_id."""
    spark = df.sparkSession
    work = Workspace(spark, "packing")
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_kind = source.schema["id"].dataType
    arrow_id = pa.int64() if isinstance(id_kind, T.LongType) else pa.int32() if isinstance(id_kind, T.IntegerType) else pa.string()
    pieces = work.put(source.mapInArrow(
        releasing(_packer(arrow_id, vocab, end_id, tiers, block_tokens)),
        f"id {id_kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, part long, local long, "
        "window long, offset long"), "pieces")
    # windows are numbered over all parts: by length, part, and place in the part
    firsts = pieces.where("offset = 0").select("part", "local", "window")
    within = firsts.withColumn("k", F.row_number().over(Window.partitionBy("part", "window").orderBy("local")) - 1)
    counts = firsts.groupBy("window", "part").agg(F.count("*").alias("n"))
    before = Window.orderBy(F.desc("window"), "part").rowsBetween(Window.unboundedPreceding, -1)
    of_length = Window.partitionBy("window").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("window", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"),
                            F.coalesce(F.sum("n").over(of_length), F.lit(0)).alias("ahead_of_length"))
    per_step = F.greatest(F.lit(1), F.floor(F.lit(step_tokens) / F.col("window")))
    numbered = within.join(offsets, ["window", "part"]).select(
        "part", "local", (F.col("ahead") + F.col("k")).alias("sequence_id"),
        F.concat_ws("-", F.col("window"), F.floor((F.col("ahead_of_length") + F.col("k")) / per_step).cast("long")).alias("step_id"))
    return pieces.join(numbered, ["part", "local"]).select(
        F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_id")
