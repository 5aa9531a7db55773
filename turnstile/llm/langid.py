"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent units read each text's bytes, one from either end; at
every byte a softmax over both states labels the position.  A document's
probability of a language is the mean over all its positions.  Texts are read
whole, in windows of ``WINDOW`` bytes (the states start anew in each), many
windows at a time.  The network is trained in numpy by backpropagation through
time, on a bounded sample: up to ``PER_LANGUAGE`` labelled rows of each of the
``LANGUAGES`` most frequent languages, ``SNIPPET`` characters of each.  The hash of
a text alone decides whether and where it is sampled.

``named`` keeps the rows whose language the network can tell: a text of
``SURE_BYTES`` or more is let go when no language holds ``MAJORITY`` of its
positions.  On all held-out texts that bar is lowered, if need be, until all
but ``LOST`` of them pass.

Defined results: a null text, and one without any letter, is ``und`` with
score 0, and so is every text when there is nothing to learn from; rows
without a language aren't learned from; a null id counts as an empty one;
repeated rows keep one row each; an empty table gives an empty result.
Columns other than id, text and language are only passed through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workspace import Workspace, releasing

HIDDEN = 6
WINDOW = 128
#: Windows that run side by side.
ROWS = 2048
#: Texts that a task labels before it hands them on.
SLICE = 1024
PER_LANGUAGE = 200
SNIPPET = 512
TRAIN_WINDOW = 64
EPOCHS = 8
LANGUAGES = 256
MAJORITY, SURE_BYTES, LOST = 0.5, 64, 0.01
SEED = 17
UNKNOWN = "und"
#: The part of the rows, by checksum of the id, that is held out.
FOLDS = 5


def has_letter(text: str) -> bool:
    """Whether a character of ``text`` is of Unicode category L."""
    return any(map(str.isalpha, text))


def held_out(id_col: str = "doc_id", folds: int = FOLDS, fold: int = 0) -> Column:
    """Whether crc32 of the id as text leaves ``fold`` when divided by ``folds``."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


class Network:
    """Weights of both directions; gates in the order update, reset, candidate.

    Arrays hold features by rows side by side, so that every gate is one
    contiguous stretch."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        self.w: dict[str, np.ndarray] = {"o": np.zeros((len(labels), 1))}
        for d in "fb":
            self.w["x" + d] = rng.normal(0, 0.3, (3 * hidden, 256))
            self.w["u" + d] = rng.normal(0, 1 / np.sqrt(hidden), (3 * hidden, hidden))
            self.w["o" + d] = rng.normal(0, 1 / np.sqrt(hidden), (len(labels), hidden))

    # training ----------------------------------------------------------------

    def _forward(self, d: str, x: np.ndarray) -> tuple[np.ndarray, list]:
        """x (time, rows) -> states (time, hidden, rows) and what the way back needs."""
        h, n = np.zeros((self.hidden, x.shape[1])), self.hidden
        states, kept = [], []
        for t in range(len(x)):
            g, u = self.w["x" + d].take(x[t], axis=1), self.w["u" + d] @ h
            gate = 1 / (1 + np.exp(-(g[:2 * n] + u[:2 * n])))
            c = np.tanh(g[2 * n:] + gate[n:] * u[2 * n:])
            kept.append((h, gate[:n], gate[n:], c, u[2 * n:]))
            h = c + gate[:n] * (h - c)
            states.append(h)
        return np.array(states), kept

    def _backward(self, d: str, x: np.ndarray, kept: list, down: np.ndarray, grad: dict) -> None:
        """Backpropagation through time of ``down``, the states' gradients."""
        dh = np.zeros_like(down[0])
        u = self.w["u" + d]
        inputs = np.empty((len(x), len(u), x.shape[1]))
        for t in range(len(x) - 1, -1, -1):
            h, z, r, c, uc = kept[t]
            dh = dh + down[t]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            dr = dc * uc * r * (1 - r)
            inputs[t] = np.concatenate([dz, dr, dc])
            du = np.concatenate([dz, dr, dc * r])
            grad["u" + d] += du @ h.T
            dh = dh * z + u.T @ du
        at = x.ravel()
        for k in range(len(u)):
            grad["x" + d][k] = np.bincount(at, inputs[:, k].ravel(), 256)

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions of x (rows, time), and its gradient."""
        ahead, back = np.ascontiguousarray(x.T), np.ascontiguousarray(x.T[::-1])
        sf, kf = self._forward("f", ahead)
        sb, kb = self._forward("b", back)
        logits = self.w["of"] @ sf + self.w["ob"] @ sb[::-1] + self.w["o"]
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        rows = np.arange(len(y))
        loss = -np.log(p[:, y, rows] + 1e-12).mean()
        p[:, y, rows] -= 1
        p /= x.size
        grad = {k: np.zeros_like(v) for k, v in self.w.items()}
        grad["o"] = p.sum((0, 2))[:, None]
        grad["of"] = np.einsum("tcb,thb->ch", p, sf, optimize=True)
        grad["ob"] = np.einsum("tcb,thb->ch", p, sb[::-1], optimize=True)
        self._backward("f", ahead, kf, self.w["of"].T @ p, grad)
        self._backward("b", back, kb, (self.w["ob"].T @ p)[::-1], grad)
        return loss, grad

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 256, rate: float = 0.03, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(w) for k, w in self.w.items()} for _ in range(2))
        step, steps = 0, epochs * -(-len(y) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), batch):
                step += 1
                some = order[at:at + batch]
                _, grad = self.loss(x[some], y[some])
                now = rate * (1 - step / (steps + 1))
                for k, g in grad.items():  # Adam
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.w[k] -= now * m[k] / (1 - 0.9 ** step) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)

    # labelling ---------------------------------------------------------------

    def ready(self) -> Network:
        """Single precision, gate weights halved: a logistic is half a tanh of half its argument."""
        n = self.hidden
        self.fast = {k: v.astype(np.float32) for k, v in self.w.items()}
        for d in "fb":
            for k in ("x" + d, "u" + d):
                self.fast[k][:2 * n] *= np.float32(0.5)
            self.fast["x" + d] = np.ascontiguousarray(self.fast["x" + d])
        return self

    def _pass(self, d: str, x: np.ndarray, live: np.ndarray, out: np.ndarray) -> None:
        """Adds a direction's logits to ``out``; ``live[t]`` rows reach position t."""
        n, wx, wu, wo = self.hidden, self.fast["x" + d], self.fast["u" + d], self.fast["o" + d]
        h = np.zeros((n, x.shape[1]), np.float32)
        half = np.float32(0.5)
        ahead = d == "f"
        for t in range(len(x)) if ahead else range(len(x) - 1, -1, -1):
            k = int(live[t])
            if ahead and k < h.shape[1]:  # rows that ended are done with
                h = np.ascontiguousarray(h[:, :k])
            s = h if k == h.shape[1] else np.ascontiguousarray(h[:, :k])
            g, u = wx.take(x[t, :k], axis=1), wu @ s
            gate = g[:2 * n]
            gate += u[:2 * n]
            np.tanh(gate, out=gate)
            gate *= half
            gate += half
            c = u[2 * n:]
            c *= gate[n:]
            c += g[2 * n:]
            np.tanh(c, out=c)
            s -= c
            s *= gate[:n]
            s += c
            if s is not h:
                h[:, :k] = s
            out[t, :, :k] += wo @ s

    def _windows(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sums over positions of the label probabilities, per window."""
        order = np.argsort(-lengths, kind="stable")
        sizes = lengths[order]
        longest = int(sizes[0])
        x = np.ascontiguousarray(x[order, :longest].T)
        live = (sizes[None, :] > np.arange(longest)[:, None]).sum(1)
        logits = np.empty((longest, len(self.labels), len(order)), np.float32)
        logits[:] = self.fast["o"]
        self._pass("f", x, live, logits)
        self._pass("b", x, live, logits)
        sums = np.zeros((len(self.labels), len(order)))
        for t in range(longest):  # softmax of each position
            p = logits[t, :, :live[t]]
            p = np.exp(p - p.max(0))
            sums[:, :live[t]] += p / p.sum(0)
        out = np.empty((len(order), len(self.labels)))
        out[order] = sums.T
        return out

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """(texts, labels): mean over all positions; every text has a byte."""
        sums = np.zeros((len(texts), len(self.labels)))
        rows, lengths, owner = [], [], []

        def run() -> None:
            x = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), WINDOW)
            np.add.at(sums, owner, self._windows(x, np.array(lengths)))
            rows.clear(), lengths.clear(), owner.clear()

        for i, text in enumerate(texts):
            for at in range(0, len(text), WINDOW):
                part = text[at:at + WINDOW]
                rows.append(part.ljust(WINDOW, b"\0"))
                lengths.append(len(part))
                owner.append(i)
                if len(rows) == ROWS:
                    run()
        if rows:
            run()
        return sums / np.array([len(t) for t in texts])[:, None]


def _snippets(usable: DataFrame, text_col: str, lang_col: str, per_language: int, seed: int) -> dict[str, list[bytes]]:
    """Up to ``per_language`` snippets of each language: a bounded sample, drawn by the hash of the text."""
    counts = {r[0]: r[1] for r in usable.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(LANGUAGES).collect()}
    if not counts:
        return {}
    draw = F.xxhash64(F.lit(seed), text_col)
    share = F.create_map(*[x for k in sorted(counts) for x in (F.lit(k), F.lit(min(1.0, 1.3 * per_language / counts[k])))])
    picked = usable.where(F.shiftrightunsigned(draw, 12) <= share[F.col(lang_col)] * float(1 << 52))
    span = F.greatest(F.length(text_col) - SNIPPET, F.lit(0)) + 1
    # copies of one text are drawn together: each text counts once
    rows = picked.select(F.col(lang_col), draw.alias("draw"), F.substring(
        F.col(text_col), (F.pmod(draw, span) + 1).cast("int"), F.lit(SNIPPET)).alias("part")).distinct().orderBy("draw").limit(
        2 * per_language * len(counts)).collect()
    found: dict[str, list[bytes]] = {k: [] for k in sorted(counts)}
    for lang, _, part in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if part and len(found[lang]) < per_language:
            found[lang].append(part.encode("utf-8"))
    return found


def _labelled(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE,
        folds: int = FOLDS, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = SEED) -> Network | None:
    """Network trained on up to ``per_language`` rows of each language outside the held-out fold."""
    found = _snippets(_labelled(df, text_col, lang_col).where(~held_out(id_col, folds)), text_col, lang_col, per_language, seed)
    if not found:
        return None
    labels, x, y = list(found), [], []
    for k, parts in enumerate(found.values()):
        for raw in parts:
            for at in range(0, len(raw), TRAIN_WINDOW):
                x.append(np.frombuffer(raw[at:at + TRAIN_WINDOW].ljust(TRAIN_WINDOW), np.uint8))
                y.append(k)
    net = Network(labels, hidden, seed)
    if len(labels) > 1 and x:
        # equal weight to languages: the rarer ones' windows are repeated
        y = np.array(y)
        most = np.bincount(y, minlength=len(labels)).max()
        order = np.concatenate([np.resize(np.nonzero(y == k)[0], most) for k in range(len(labels)) if (y == k).any()])
        net.train(np.array(x)[order], y[order], epochs, seed=seed)
    return net.ready()


def label(df: DataFrame, net: Network | None, text_col: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``df`` with the predicted language and its probability; no shuffle."""
    at = df.columns.index(text_col)
    out = T.StructType([*(f for f in df.schema if f.name not in (pred, score)), T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    keep = [i for i, c in enumerate(df.columns) if c not in (pred, score)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (batch.slice(i, SLICE) for batch in batches for i in range(0, batch.num_rows, SLICE))
        for batch in parts:
            names, scores = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
            which, texts = [], []
            for i, t in enumerate(batch.column(at)):
                t = t.as_py()
                if net is not None and t and has_letter(t):
                    which.append(i)
                    texts.append(t.encode("utf-8"))
            if which:
                p = net.probabilities(texts)
                for i, best, row in zip(which, p.argmax(1).tolist(), p):
                    names[i], scores[i] = net.labels[best], round(min(1.0, float(row[best])), 6)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             names=out.names)

    return df.mapInArrow(releasing(run), out)


def bar(df: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = FOLDS) -> float:
    """The mean probability below which a text has no language that the network can tell: every labelled text
    outside the training fold is scored whole, each text once, and its place is counted off."""
    spark = df.sparkSession
    held = _labelled(df, text_col, lang_col).where(held_out(id_col, folds) & (F.octet_length(text_col) >= SURE_BYTES))
    told = label(held.select(F.sha2(text_col, 256).alias("__key"), F.col(text_col)), net, text_col, "__lang", "__score")
    work = Workspace(spark, "langid-bar")
    # without a letter the score is zero
    scores = work.put(told.where("__score > 0").groupBy("__key").agg(F.min("__score").alias("score")).select("score"), "scores")

    def at(rows: DataFrame, value: Column, place: int) -> tuple[float, int]:
        """The value at ``place``, and the place within its equals; a score has six decimals, so both tables have a thousand rows."""
        for v, n in sorted(rows.groupBy(value.alias("v")).count().collect()):
            if place < n:
                break
            place -= n
        return v, place

    try:
        n = scores.count()
        if not n:
            return 0.0
        thousandth = F.floor(F.col("score") * 1000)
        part, place = at(scores, thousandth, int((n - 1) * LOST))
        return min(MAJORITY, at(scores.where(thousandth == part), F.col("score"), place)[0])
    finally:
        work.drop("scores")


def named(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **how) -> DataFrame:
    """The rows of ``df`` that are in a language; all with a letter when there is nothing to learn from."""
    net = fit(df, id_col, text_col, lang_col, **how)
    if net is None:
        return df.where(df[text_col].rlike(r"\p{L}"))
    told = label(df, net, text_col, "__lang", "__score")
    sure = (F.octet_length(text_col) < SURE_BYTES) | (F.col("__score") >= round(bar(df, net, id_col, text_col, lang_col), 6))
    return told.where((F.col("__lang") != UNKNOWN) & sure).select(*df.columns)


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **how) -> DataFrame:
    """One row per row of ``df``: id, held_out, lang_pred, score."""
    net = fit(df, id_col, text_col, lang_col, **how)
    slim = df.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).alias("__text"))
    return label(slim, net, "__text").select(id_col, "held_out", "lang_pred", "score")
