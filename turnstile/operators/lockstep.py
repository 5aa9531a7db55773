"""Trainings that go over the rows together.

Perceptrons of all grid points and folds ask for a loss and a gradient each, at weights of their own; one pass over
the rows answers them all.  The optimiser is Breeze's L-BFGS with its strong Wolfe search, step by step, and the loss is that of
``MultilayerPerceptronClassifier`` (means over blocks of ``blockSize`` rows of a partition, averaged), so that a
model is MLlib's but for the order of sums.  The weights after ``n`` iterations are the model
of the limit ``n``: limits that differ alone are one training.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Generator, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.common import _py2java
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block that are computed at once; more leave the processor's cache.
ROWS_AT_ONCE = 256
#: Rows that are packed and dealt as one.
BLOCK_ROWS = 2500
#: Rows of a task of a pass, up to ``MANY_TASKS`` tasks; beyond, up to ten times as many.
TASK_ROWS, MANY_TASKS = 32_000, 96
#: Beyond so many tasks, sums are added up on the executors before they reach the driver.
FLAT_SUMS = 128

Ask = Generator[np.ndarray, tuple[float, np.ndarray], None]


class _Failure(Exception):
    """Breeze's FirstOrderException: the history is dropped once, then the search ends."""


def _direction(grad: np.ndarray, steps: list[np.ndarray], changes: list[np.ndarray]) -> np.ndarray:
    """Minus the approximate inverse Hessian times ``grad``; the latest step and change come first."""
    scale = 1.0
    if steps:
        sy = steps[0] @ changes[0]
        if sy < 0 or math.isnan(sy):
            raise _Failure
        scale = sy / (changes[0] @ changes[0])
    out, shares = grad.copy(), []
    for s, y in zip(steps, changes):
        rho = s @ y
        a = (s @ out) / rho
        if math.isnan(a):
            raise _Failure
        shares.append((a, rho))
        out -= a * y
    out *= scale
    for s, y, (a, rho) in reversed([*zip(steps, changes, shares)]):
        out += (a - (y @ out) / rho) * s
    return -out


def _between(left: tuple, right: tuple) -> float:
    """The minimum of the cubic through two brackets (step, value, slope), a tenth away from both ends at least."""
    (lt, lf, ld), (rt, rf, rd) = left, right
    d1 = ld + rd - 3 * (lf - rf) / (lt - rt)
    inner = d1 * d1 - ld * rd
    d2 = math.sqrt(inner) if inner >= 0 else math.nan
    t = rt - (rt - lt) * (rd + d2 - d1) / (rd - ld + 2 * d2)
    low, high = lt + 0.1 * (rt - lt), lt + 0.9 * (rt - lt)
    return low if t < low else high if t > high else t


def _wolfe(x: np.ndarray, value: float, grad: np.ndarray, direction: np.ndarray, step: float, tries: int = 10):
    """Asks along ``direction``; returns (step, x, value, gradient) of a point that meets the strong Wolfe conditions."""
    slope = grad @ direction
    if slope > 0:
        raise _Failure

    def phi(t: float):
        at = x + direction * t
        f, g = yield at
        return (t, f, g @ direction), at, g

    def zoom(low: tuple, high: tuple):
        for _ in range(tries):
            c, at, g = yield from phi(_between(high, low) if low[0] > high[0] else _between(low, high))
            if c[1] > value + 1e-4 * c[0] * slope or c[1] >= low[1]:
                high = c
            else:
                if abs(c[2]) <= 0.9 * abs(slope):
                    return c[0], at, c[1], g
                if c[2] * (high[0] - low[0]) >= 0:
                    high = low
                low = c
        raise _Failure

    t, low = step, (0.0, value, slope)
    for i in range(tries):
        c, at, g = yield from phi(t)
        if math.isinf(c[1]) or math.isnan(c[1]):
            t /= 2.0
            continue
        if c[1] > value + 1e-4 * t * slope or (c[1] >= low[1] and i > 0):
            return (yield from zoom(low, c))
        if abs(c[2]) <= 0.9 * abs(slope):
            return c[0], at, c[1], g
        if c[2] >= 0:
            return (yield from zoom(c, low))
        low = c
        t *= 1.5
    raise _Failure


def lbfgs(start: np.ndarray, limits: Sequence[int], tol: float, found: dict[int, np.ndarray], memory: int = 10) -> Ask:
    """Yields points, is sent (value, gradient) there; ``found`` gets the point after each of ``limits`` iterations, or the last one before."""
    x = start
    value, grad = yield x
    first, recent = value, [math.inf]
    steps: list[np.ndarray] = []
    changes: list[np.ndarray] = []
    done, failed = 0, False
    while True:
        if done in limits:
            found[done] = x
        if (done >= max(limits) or len(recent) >= 2 and abs(value - max(recent)) <= tol * first
                or math.sqrt(grad @ grad) <= max(tol * value, 1e-8)):
            break
        try:
            direction = _direction(grad, steps, changes)
            norm = math.sqrt(direction @ direction)
            step, at, f, g = yield from _wolfe(x, value, grad, direction, 1.0 / norm if done == 0 else 1.0)
            if step * math.sqrt(grad @ grad) < 1e-10:
                raise _Failure
        except _Failure:
            if failed:
                break
            failed, steps, changes = True, [], []
            continue
        steps, changes = [at - x, *steps][:memory], [g - grad, *changes][:memory]
        x, value, grad, failed = at, f, g, False
        recent = [*recent, value][-20:]
        done += 1
    for limit in limits:
        found.setdefault(limit, x)


def answered(asks: Sequence[Ask], answer: Callable[[dict[int, np.ndarray]], dict[int, tuple[float, np.ndarray]]]) -> None:
    """Every optimiser to its end: each round answers the points that all of them ask for."""
    points = {i: next(ask) for i, ask in enumerate(asks)}
    while points:
        values = answer(points)
        points = {}
        for i, value in values.items():
            try:
                points[i] = asks[i].send(value)
            except StopIteration:
                pass


def packed(rows: DataFrame, features: str, folds: int, block: int) -> tuple[RDD, list[int]]:
    """Blocks of ``rows``, dealt evenly and in their order, and the number of stacks of every training.

    ``rows`` are written ones: their partitions and order count.  Training ``k < folds`` leaves out fold ``k``, the last
    one nothing.  A block has the features by column (as codes of its distinct values where they
    are few), the labels, and a row's weight in each training: one over the rows of its stack of ``block`` rows.
    Its rows are sorted by fold.
    """
    sizes: dict[int, np.ndarray] = {}
    for r in rows.groupBy(F.spark_partition_id().alias("part"), "fold").count().collect():  # one row per partition and fold
        sizes.setdefault(r["part"], np.zeros(folds, dtype=np.int64))[r["fold"]] = r["count"]
    trained = {p: np.append(n.sum() - n, n.sum()) for p, n in sorted(sizes.items())}
    stacks = sum(-(-n // block) for n in trained.values())
    n_rows, first = 0, {}
    for p, n in trained.items():
        first[p] = n_rows
        n_rows += int(n[-1])
    tasks = max(min(MANY_TASKS, -(-n_rows // TASK_ROWS)), -(-n_rows // (10 * TASK_ROWS)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        total, before = trained.get(part, 0), np.zeros(folds + 1, dtype=np.int64)
        for batch in (b.slice(a, BLOCK_ROWS) for b in batches for a in range(0, b.num_rows, BLOCK_ROWS)):
            label, fold = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "fold"))
            values = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(len(label), -1)
            used = fold[:, None] != np.arange(folds + 1)
            place, at = before + np.cumsum(used, axis=0) - used, first[part] + int(before[-1])
            before = before + used.sum(axis=0)
            weight = (used / np.minimum(block, total - place // block * block)).T
            order = np.argsort(fold, kind="stable")
            columns = []
            for column in values[order].T:
                distinct, codes = np.unique(column, return_inverse=True)
                columns.append((distinct, codes.astype(np.uint8)) if len(distinct) <= 256 else (None, column.copy()))
            data = (columns, label[order].astype(np.int8), np.searchsorted(fold[order], np.arange(folds + 1)), weight[:, order])
            yield pa.RecordBatch.from_pydict({"at": pa.array([at], pa.int64()),
                                              "block": pa.array([pickle.dumps(data, pickle.HIGHEST_PROTOCOL)], pa.binary())})
        if (before != total).any():
            raise RuntimeError("the rows came in other partitions than they were counted in")

    blocks = rows.select(vector_to_array(features).alias("features"), "label", "fold").mapInArrow(pack, "at long, block binary").rdd
    dealt = blocks.map(lambda r: (r["at"], bytes(r["block"]))).partitionBy(tasks, lambda at: at * tasks // n_rows)
    in_order = dealt.mapPartitions(lambda part: (data for _, data in sorted(part, key=lambda one: one[0])))
    return in_order.persist(StorageLevel.MEMORY_AND_DISK), [int(n) for n in stacks]


def unpacked(data: bytes, folds: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(fold, features by column, labels, weights by training) of at most ``ROWS_AT_ONCE`` rows of one fold."""
    columns, label, bounds, weight = pickle.loads(data)
    for k in range(folds):
        for a in range(bounds[k], bounds[k + 1], ROWS_AT_ONCE):
            b = min(a + ROWS_AT_ONCE, bounds[k + 1])
            x = np.empty((len(columns), b - a))
            for row, (distinct, codes) in zip(x, columns):
                if distinct is None:
                    row[:] = codes[a:b]
                else:
                    np.take(distinct, codes[a:b], out=row)
            yield k, x, label[a:b], weight[:, a:b]


@dataclass
class Perceptron:
    """One training: sizes of the layers, and the fold that it leaves out (or the number of folds)."""
    layers: list[int]
    training: int

    def split(self, weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(inputs x outputs, bias) by layer: views of MLlib's vector of weights."""
        out, at = [], 0
        for n, m in zip(self.layers, self.layers[1:]):
            out.append((weights[at:at + n * m].reshape(n, m), weights[at + n * m:at + (n + 1) * m]))
            at += (n + 1) * m
        return out


def _sigmoid(z: np.ndarray) -> None:
    np.negative(z, out=z)
    np.exp(z, out=z)
    z += 1.0
    np.reciprocal(z, out=z)


def _losses(x: np.ndarray, label: np.ndarray, weight: np.ndarray, nets: Sequence[tuple], sums: Sequence[tuple]) -> None:
    """Adds loss and gradient of rows (``x`` by column) to ``sums`` of every (training, layers' weights) of ``nets``.
    The first layers are one product, forth and back."""
    first = np.concatenate([layers[0][0] for _, layers in nets], axis=1).T @ x
    first += np.concatenate([layers[0][1] for _, layers in nets])[:, None]
    _sigmoid(first)
    deltas, at = np.empty_like(first), 0
    classes = [label == c for c in range(len(nets[0][1][-1][1]))]
    for (training, layers), (loss, grads) in zip(nets, sums):
        own = slice(at, at + len(layers[0][1]))
        at = own.stop
        outs = [first[own]]
        for w, b in layers[1:]:
            z = w.T @ outs[-1]
            z += b[:, None]
            if len(outs) < len(layers) - 1:
                _sigmoid(z)
                outs.append(z)
        z -= z.max(axis=0)
        np.exp(z, out=z)
        z /= z.sum(axis=0)
        share = weight[training]
        for is_class, p in zip(classes, z):
            loss[0] -= np.log(p, where=is_class, out=np.zeros_like(p)) @ share
            p -= is_class
        z *= share
        for i in range(len(layers) - 1, 0, -1):
            o, (gw, gb) = outs[i - 1], grads[i]
            gw += o @ z.T
            gb += z.sum(axis=1)
            z = np.matmul(layers[i][0], z, out=deltas[own] if i == 1 else None)
            z *= o
            np.subtract(1.0, o, out=o)
            z *= o
    products, bias, at = deltas @ x.T, deltas.sum(axis=1), 0
    for (_, layers), (_, grads) in zip(nets, sums):
        own = slice(at, at + len(layers[0][1]))
        at = own.stop
        gw, gb = grads[0]
        gw += products[own].T
        gb += bias[own]


def perceptrons(points: Sequence[tuple[MultilayerPerceptronClassifier, dict]], rows: DataFrame, folds: int,
                trainings: Sequence[int]) -> list[list[MultilayerPerceptronClassificationModel]]:
    """Of each (estimator, parameters), the models of ``trainings``: number ``k < folds`` leaves out fold ``k``, ``folds`` takes all
    rows.  The estimators have the same features and ``blockSize``; ``rows`` are written ones."""
    ests = [est.copy(params) for est, params in points]
    chains: dict[tuple, list[int]] = {}
    for i, est in enumerate(ests):
        chains.setdefault((*est.getLayers(), est.getSeed(), est.getTol()), []).append(i)
    one = rows.limit(1).cache()
    starts = {key: ests[chain[0]].copy({ests[0].maxIter: 0}).fit(one).weights.toArray() for key, chain in chains.items()}
    one.unpersist()
    blocks, stacks = packed(rows, ests[0].getFeaturesCol(), folds, ests[0].getBlockSize())
    jobs = [(key, chain, k) for key, chain in chains.items() for k in trainings]
    nets = [Perceptron(list(ests[chain[0]].getLayers()), k) for _, chain, k in jobs]
    found: list[dict[int, np.ndarray]] = [{} for _ in jobs]
    asks = [lbfgs(starts[key], sorted({ests[i].getMaxIter() for i in chain}), ests[chain[0]].getTol(), found[j])
            for j, (key, chain, _) in enumerate(jobs)]

    def answer(points: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray]]:
        shared = rows.sparkSession.sparkContext.broadcast({j: (nets[j], w) for j, w in points.items()})

        def of_part(part: Iterator[bytes]) -> Iterator[dict[int, tuple[float, np.ndarray]]]:
            asked = {j: (net.training, net.split(w)) for j, (net, w) in shared.value.items()}
            totals = {j: (np.zeros(1), np.zeros_like(w)) for j, (_, w) in shared.value.items()}
            sums = {j: (totals[j][0], net.split(totals[j][1])) for j, (net, _) in shared.value.items()}
            with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
                for data in part:
                    for k, x, label, weight in unpacked(data, folds):
                        some = [j for j, (training, _) in asked.items() if training != k]
                        if some:
                            _losses(x, label, weight, [asked[j] for j in some], [sums[j] for j in some])
            yield {j: (float(loss[0]), grad) for j, (loss, grad) in totals.items()}

        def added(a: dict, b: dict) -> dict:
            return {j: (a[j][0] + b[j][0], a[j][1] + b[j][1]) for j in a}

        parts = blocks.mapPartitions(of_part)
        total = parts.treeReduce(added) if blocks.getNumPartitions() > FLAT_SUMS else reduce(added, parts.collect())
        shared.destroy()
        return {j: (loss / stacks[nets[j].training], grad / stacks[nets[j].training]) for j, (loss, grad) in total.items()}

    answered(asks, answer)
    blocks.unpersist()

    def model(i: int, weights: np.ndarray) -> MultilayerPerceptronClassificationModel:
        made = rows.sparkSession._jvm.org.apache.spark.ml.classification.MultilayerPerceptronClassificationModel(
            ests[i].uid, _py2java(rows.sparkSession.sparkContext, DenseVector(weights)))
        return ests[i]._copyValues(ests[i]._create_model(made))

    at = {(i, k): found[j][ests[i].getMaxIter()] for j, (_, chain, k) in enumerate(jobs) for i in chain}
    return [[model(i, at[i, k]) for k in trainings] for i in range(len(points))]
