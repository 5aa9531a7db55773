"""Language-model scores by subword lattice likelihood.

An existing vocabulary's pieces and their scores weight all segmentations of
a text: the text's probability is the sum over every way to spell it with
pieces, found by a forward recursion in log space.  Pieces don't cross words,
so the recursion runs once per distinct word of the corpus.  The scores in the
file are merge ranks; they give the starting weights (inverse rank), and one
expectation step over all distinct training words, weighted by their counts,
turns these into the piece probabilities.

The vocabulary of a corpus grows with it and is never gathered whole: texts
are cut into blocks; a block sends its distinct words, in hash buckets,
to the buckets' owners, which add up counts, run the lattice once per word and
answer each block in the order of its words.  A frequent word costs
one entry per block.  The blocks then score their texts.

Defined results: a null text counts as empty (one token, the end); a null id
counts as an empty one for the held-out split; repeated rows and ids keep one
row each; with nothing to learn from, counts are zero and the starting
weights stand; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .langid import held_out
from .tables import PairTable
from .vocab import resolve
from .workspace import Workspace

VOCAB = "piece_bpe_32k.model"
FOLDS, FOLD = 7, 2
#: Bytes of text in a block, and bytes of corpus per hash bucket of words.
BLOCK_BYTES = 16 << 20
BUCKET_BYTES = 16 << 20
#: Weight of the starting probabilities, in pieces.
PRIOR = 10_000.0
#: Characters of the words whose lattices run side by side.
BATCH_CHARS = 100_000
_START = "▁"
_LN10 = math.log(10.0)


class Pieces:
    """The vocabulary file's pieces: ids, starting weights, byte pieces, prefixes."""

    def __init__(self, vocab: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=resolve(vocab))
        self.ids: dict[str, int] = {}
        self.bytes = [0] * 256
        size = model.vocab_size()
        scores = np.full(size, -np.inf)
        for i in range(size):
            if model.is_byte(i):
                self.bytes[int(model.id_to_piece(i)[1:-1], 16)] = i
                scores[i] = -float(size)
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[model.id_to_piece(i)] = i
                scores[i] = model.get_score(i)
        used = np.isfinite(scores)
        weight = np.where(used, 1.0 / (3.0 - np.where(used, scores, 0.0)), 0.0)
        self.start = weight / weight.sum()
        self.prefixes = {p[:k] for p in self.ids for k in range(1, len(p))}
        # a trie of the pieces: node 0 is the root, steps by code point
        nodes = {p: k for k, p in enumerate(sorted(self.prefixes | self.ids.keys(), key=len), 1)}
        nodes[""] = 0
        steps = [(nodes[p[:-1]], ord(p[-1]), k) for p, k in nodes.items() if p]
        parent, char, node = (np.array(c, np.int64) for c in zip(*steps))
        self.trie = PairTable(parent, char, node=(node, -1))
        self.ends = np.full(len(nodes), -1, np.int32)
        for p, i in self.ids.items():
            self.ends[nodes[p]] = i


@functools.lru_cache(maxsize=2)
def pieces_of(vocab: str) -> Pieces:
    return Pieces(vocab)


class Lattice:
    """Segmentations of a word into pieces of given probabilities."""

    def __init__(self, pieces: Pieces, p: np.ndarray) -> None:
        with np.errstate(divide="ignore"):
            logs = np.log(p).tolist()
        self.pieces, self.log = pieces, logs
        self.of = {piece: (logs[i], i) for piece, i in pieces.ids.items()}
        self.byte = [logs[i] for i in pieces.bytes]
        self.chars: dict[str, float] = {}

    def spelled(self, char: str) -> float:
        """A character as byte pieces."""
        found = self.chars.get(char)
        if found is None:
            found = self.chars[char] = sum(self.byte[b] for b in char.encode("utf-8"))
        return found

    def edges(self, text: str) -> Iterator[tuple[int, int, float, int]]:
        """(from, to, log weight, piece or -1 for a character's bytes), by from."""
        of, prefixes, n = self.of, self.pieces.prefixes, len(text)
        for i in range(n):
            yield i, i + 1, self.spelled(text[i]), -1
            j = i + 1
            while j <= n:
                part = text[i:j]
                found = of.get(part)
                if found is not None:
                    yield i, j, found[0], found[1]
                if part not in prefixes:
                    break
                j += 1

    def forward(self, text: str) -> list[float]:
        """Log probability of each prefix over all its segmentations."""
        log1p, exp = math.log1p, math.exp
        a: list = [None] * (len(text) + 1)
        a[0] = 0.0
        for i, j, w, _ in self.edges(text):
            x, y = a[i] + w, a[j]
            if y is None:
                a[j] = x
            elif x > y:
                a[j] = x + log1p(exp(y - x))
            else:
                a[j] = y + log1p(exp(x - y))
        return a

    def word(self, word: bytes) -> float:
        return self.forward(_START + word.decode("utf-8"))[-1]

    # many words of one length side by side -----------------------------------

    def _batches(self, words: list[bytes]) -> Iterator[tuple[list[int], np.ndarray]]:
        """(which words, their code points after the start mark), by length."""
        texts = [_START + w.decode("utf-8") for w in words]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        for n in np.unique(lengths).tolist():
            which = np.nonzero(lengths == n)[0]
            step = max(1, BATCH_CHARS // n)
            for at in range(0, len(which), step):
                some = which[at:at + step].tolist()
                raw = "".join([texts[k] for k in some]).encode("utf-32-le")
                yield some, np.frombuffer(raw, "<u4").reshape(len(some), n).astype(np.int64)

    def _edges(self, x: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray | None]]:
        """(from, to, rows, log weights, pieces or None for a character's bytes), by from."""
        trie, ends = self.pieces.trie, self.pieces.ends
        logs = np.array(self.log)
        chars, inverse = np.unique(x, return_inverse=True)
        spelled = np.array([self.spelled(chr(c)) for c in chars.tolist()])[inverse.reshape(x.shape)]
        everyone = np.arange(len(x))
        for i in range(x.shape[1]):
            yield i, i + 1, everyone, spelled[:, i], None
            rows, node = everyone, np.zeros(len(x), np.int64)
            for j in range(i, x.shape[1]):
                node = trie.node[trie.find(node, x[rows, j])].astype(np.int64)
                on = node >= 0
                rows, node = rows[on], node[on]
                if not len(rows):
                    break
                piece = ends[node]
                found = piece >= 0
                if found.any():
                    yield i, j + 1, rows[found], logs[piece[found]], piece[found]

    def words(self, words: list[bytes]) -> np.ndarray:
        """Log probability of each word over all its segmentations."""
        out = np.empty(len(words))
        for which, x in self._batches(words):
            a = np.full((x.shape[1] + 1, len(x)), -np.inf)
            a[0] = 0.0
            for i, j, rows, w, _ in self._edges(x):
                a[j, rows] = np.logaddexp(a[j, rows], a[i, rows] + w)
            out[which] = a[-1]
        return out

    def expectations(self, words: list[bytes], weights: list[int]) -> np.ndarray:
        """Expected use of each piece in ``weights`` copies of the words."""
        into = np.zeros(len(self.log))
        weights = np.array(weights, float)
        for which, x in self._batches(words):
            edges = list(self._edges(x))
            n = x.shape[1]
            a, b = np.full((n + 1, len(x)), -np.inf), np.full((n + 1, len(x)), -np.inf)
            a[0] = b[n] = 0.0
            for i, j, rows, w, _ in edges:
                a[j, rows] = np.logaddexp(a[j, rows], a[i, rows] + w)
            for i, j, rows, w, _ in reversed(edges):
                b[i, rows] = np.logaddexp(b[i, rows], b[j, rows] + w)
            for i, j, rows, w, piece in edges:
                share = weights[which][rows] * np.exp(a[i, rows] + w + b[j, rows] - a[n, rows])
                if piece is not None:
                    into += np.bincount(piece, share, len(into))
                    continue
                chars, inverse = np.unique(x[:, i], return_inverse=True)
                for c, s in zip(chars.tolist(), np.bincount(inverse, share).tolist()):
                    for byte in chr(c).encode("utf-8"):
                        into[self.pieces.bytes[byte]] += s
        return into


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _bucketed(words: set[bytes], buckets: int) -> dict[int, list[bytes]]:
    """Distinct words by hash bucket, in order."""
    out: dict[int, list[bytes]] = {}
    digest = xxhash.xxh64_intdigest
    for w in words:
        out.setdefault(digest(w) % buckets, []).append(w)
    for some in out.values():
        some.sort()
    return out


def _requests(id_type: pa.DataType, buckets: int, block_bytes: int):
    schema = pa.schema([("block", pa.int64()), ("id", id_type), ("held_out", pa.bool_()), ("text", pa.string()),
                        ("bucket", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), ("docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 32, 0
        every: set[bytes] = set()
        counts: Counter = Counter()
        docs = 0

        def ask() -> pa.RecordBatch:
            rows = [(block, None, None, None, k, b"\n".join(some), np.array([counts[w] for w in some], "<i8").tobytes(), 0)
                    for k, some in _bucketed(every, buckets).items()]
            rows.append((block, None, None, None, None, None, None, docs))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            marks, texts = batch.column(1).to_pylist(), batch.column(2)
            blocks = []
            asked = []
            for out, text in zip(marks, texts):
                text = text.as_py()
                words = _words(text)
                if out:
                    every.update(words)
                else:
                    counts.update(words)
                    docs += 1
                blocks.append(block)
                held += len(text or "") + 64
                if held >= block_bytes:
                    every |= counts.keys()
                    asked.append(ask())
                    block, held, every, counts, docs = block + 1, 0, set(), Counter(), 0
            none = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks, pa.int64()), batch.column(0), batch.column(1), texts, none.cast(pa.int32()), none.cast(pa.binary()),
                 none.cast(pa.binary()), none.cast(pa.int64())], schema=schema)
            yield from asked
        every |= counts.keys()
        yield ask()

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> tuple[dict[bytes, int], list]:
    """Counts of a bucket owner's words, and its requests."""
    counts: dict[bytes, int] = {}
    asked = []
    for batch in batches:
        for block, bucket, words, given in zip(*(batch.column(i).to_pylist() for i in range(4))):
            asked.append((block, bucket, words))
            for w, n in zip(words.split(b"\n"), np.frombuffer(given, "<i8").tolist()):
                counts[w] = counts.get(w, 0) + n
    return counts, asked


def _expectation(vocab: str):
    schema = pa.schema([("piece", pa.int32()), ("expected", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, _ = _merged(batches)
        if not counts:
            return
        pieces = pieces_of(vocab)
        known = [w for w, n in counts.items() if n]
        weights = [counts[w] for w in known]
        into = Lattice(pieces, pieces.start).expectations(known, weights)
        # the pieces used, then (below zero) distinct words and words
        used = np.nonzero(into)[0]
        yield pa.RecordBatch.from_arrays([pa.array([*used.tolist(), -1, -2], pa.int32()),
                                          pa.array([*into[used].tolist(), float(len(known)), float(sum(weights))], pa.float64())], schema=schema)

    return run


def _answers(vocab: str, p: np.ndarray):
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("known", pa.binary()), ("logs", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, asked = _merged(batches)
        lattice = Lattice(pieces_of(vocab), p)
        every = list(counts)
        logs = dict(zip(every, (lattice.words(every) / _LN10).tolist()))
        for block, bucket, words in asked:
            some = words.split(b"\n")
            yield pa.RecordBatch.from_arrays([
                pa.array([block], pa.int64()), pa.array([bucket], pa.int32()),
                pa.array([np.array([counts[w] for w in some], "<i8").tobytes()], pa.binary()),
                pa.array([np.array([logs[w] for w in some], "<f8").tobytes()], pa.binary())], schema=schema)

    return run


def _score(buckets: int, total: int, distinct: int, ends: int, end_log: float):
    base_of = math.log10(total + distinct + 1)

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        texts = docs.column("text").to_pylist()
        every: set[bytes] = set()
        for t in texts:
            every.update(_words(t))
        asked = _bucketed(every, buckets)
        logs: dict[bytes, tuple[float, float, int]] = {}
        for bucket, known, given in zip(*(answers.column(c).to_pylist() for c in ("bucket", "known", "logs"))):
            counts = np.frombuffer(known, "<i8")
            base = np.log10(counts + 1.0) - base_of
            logs.update(zip(asked[bucket], zip(base.tolist(), np.frombuffer(given, "<f8").tolist(), (counts > 0).tolist())))
        end = (math.log10(ends + 1) - base_of, end_log, ends > 0)
        tokens, seen, base, score = [], [], [], []
        for t in texts:
            found = [logs[w] for w in _words(t)]
            found.append(end)
            a, b, c = zip(*found)
            tokens.append(len(found))
            seen.append(sum(c))
            base.append(math.fsum(a))
            score.append(math.fsum(b))
        n = len(texts)
        return pa.table({"id": docs.column("id"), "held_out": docs.column("held_out"), "n_tokens": pa.array(tokens, pa.int64()),
                         "n_known": pa.array(seen, pa.int64()), "train_tokens": pa.array([total] * n, pa.int64()),
                         "base_score": pa.array(base, pa.float64()), "score": pa.array(score, pa.float64())})

    return run


def lm_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = VOCAB, folds: int = FOLDS, fold: int = FOLD,
              block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, prior: float = PRIOR) -> DataFrame:
    """One row per row of ``df``: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = df.sparkSession
    work = Workspace(spark, "lm-score")
    source = df.select(F.col(id_col).alias("id"), held_out(id_col, folds, fold).alias("held_out"), F.col(text_col).alias("text"))
    id_kind = source.schema["id"].dataType
    arrow_id = pa.int64() if isinstance(id_kind, T.LongType) else pa.int32() if isinstance(id_kind, T.IntegerType) else pa.string()
    volume = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-int(volume) // bucket_bytes))
    table = work.put(source.mapInArrow(
        _requests(arrow_id, buckets, block_bytes),
        f"block long, id {id_kind.simpleString()}, held_out boolean, text string, bucket int, words binary, counts binary, docs long"), "blocks")
    owned = table.where("bucket IS NOT NULL").select("block", "bucket", "words", "counts").repartitionById(buckets, F.col("bucket"))
    size = len(pieces_of(vocab).start)
    expected = owned.mapInArrow(_expectation(vocab), "piece int, expected double").groupBy("piece").agg(F.sum("expected").alias("n")).collect()
    ends = int(table.agg(F.sum("docs")).first()[0] or 0)
    learned, special = np.zeros(size), {-1: 0.0, -2: 0.0}
    for piece, n in expected:
        if piece < 0:
            special[piece] = n
        else:
            learned[piece] = n
    words = int(special[-2])
    mass = learned.sum() + prior + ends + 1.0
    p = (learned + prior * pieces_of(vocab).start) / mass
    total, distinct = words + ends, int(special[-1]) + (ends > 0)
    answers = owned.mapInArrow(_answers(vocab, p), "block long, bucket int, known binary, logs binary")
    docs = table.where("held_out IS NOT NULL").select("block", "id", "held_out", "text")
    scored = docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _score(buckets, total, distinct, ends, math.log10((ends + 1.0) / mass)),
        f"id {id_kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumnRenamed("id", id_col)
