"""Token counts of a byte-level BPE with the whole-token shortcut.

Before any text is read, each worker proves which vocabulary strings encode
alone as one token: the library's own pre-tokeniser must leave the string whole and its
merges must end in one piece.  A text's pre-tokens are then looked up: proven
ones count one, the rest is merged once and remembered.

The split pattern is proven too (see ``pretokens``); a text that it can't be
proven for is encoded by the library as a whole.

Defined results: a null text counts as empty (0 tokens, 0 bytes); special
strings inside a text count as the library's default has it, one token each;
repeated rows and ids keep one row each; other columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .merges import Merger
from .pretokens import Pretokeniser
from .vocab import bundles, load

VOCAB = "byte_bpe_50k.json"
LIMIT = 1024
#: Pre-tokens other than proven ones that a worker remembers.
REMEMBERED = 600_000
#: Characters of text whose pre-tokens are held at once (a longer text is held alone).
BUNDLE = 2_000_000
# fixed value: the split pattern of byte-level BPE vocabularies
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class PieceCounts(dict):
    """Pre-token -> number of tokens; ``learn`` merges the ones it lacks."""

    def __init__(self, vocab: str) -> None:
        super().__init__()
        tokenizer = load(vocab)
        cut, merge, plain = tokenizer.pre_tokenizer.pre_tokenize_str, tokenizer.model.tokenize, tokenizer.decoder.decode
        for piece in tokenizer.get_vocab(with_added_tokens=False):
            text = plain([piece])
            if "\ufffd" not in text:
                found = cut(text)
                if len(found) == 1 and found[0][0] == piece and len(merge(piece)) == 1:
                    self[text] = 1
        self.whole = len(self)
        self.merger = Merger(vocab)

    def learn(self, pieces: set[str]) -> None:
        new = list(pieces.difference(self))
        if len(self) + len(new) - self.whole > REMEMBERED:
            for old in list(self)[self.whole:]:
                del self[old]
            new = list(pieces.difference(self))
        self.update(zip(new, self.merger.counts([p.encode("utf-8") for p in new])))


class Counter:
    """Counts the tokens of whole texts as the library does."""

    def __init__(self, vocab: str = VOCAB) -> None:
        self.cutter = Pretokeniser(vocab, PATTERN, lower=False)
        self.pieces = PieceCounts(vocab)

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; the texts' unknown pre-tokens are merged together."""
        cut = [self.cutter.cut(t) for t in texts]
        self.pieces.learn({p for found in cut if found for some in found[0] for p in some})
        one = self.pieces.__getitem__
        return [len(self.cutter.encode(text)) if found is None else len(found[1]) + sum(sum(map(one, some)) for some in found[0])
                for text, found in zip(texts, cut)]


@functools.lru_cache(maxsize=2)
def counter(vocab: str) -> Counter:
    return Counter(vocab)


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = VOCAB,
                 limit: int = LIMIT) -> DataFrame:
    """One row per row of ``df``: id, n_bytes, n_tokens, over_limit.  No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocab).counts
        for batch in batches:
            n: list[int] = []
            for texts in bundles((t.as_py() or "" for t in batch.column(1)), BUNDLE):
                n += count(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())],
                                             names=[id_col, "n_bytes", "n_tokens"])

    source = df.select(F.col(id_col), F.col(text_col),
                       F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    kind = source.schema[id_col].dataType.simpleString()
    counted = source.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
