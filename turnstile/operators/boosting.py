"""Boosted trees of all folds grown together, level by level.

Each level of a tree takes one pass over the rows, for the models of all folds at once.  Thresholds are those that MLlib
finds for each model's rows, and so are targets, gains and leaves: a model is ``GBTClassifier``'s but for
the order of sums.  Rows are kept as codes of the thresholds of all models, with a score per model.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lockstep import FLAT_SUMS

#: Rows of a task of a pass, up to ``MANY_TASKS`` tasks; beyond, up to ten times as many.
TASK_ROWS, MANY_TASKS = 96_000, 96
#: Codes that a column can have at most: the thresholds of all models of a call, and one.
CODES = 256


def supports(est: GBTClassifier, rows: DataFrame) -> bool:
    """Whether ``est`` draws no rows or features, weighs rows alike, and splits categories in two at most."""
    attributes = rows.schema[est.getFeaturesCol()].metadata.get("ml_attr", {}).get("attrs", {})
    return (est.getLossType() == "logistic" and est.getSubsamplingRate() == 1.0 and est.getFeatureSubsetStrategy() == "all"
            and est.getMinWeightFractionPerNode() == 0.0 and 1 <= est.getMaxDepth() <= 6 and est.getImpurity() == "variance"
            and not any(est.isSet(p) for p in (est.weightCol, est.validationIndicatorCol, est.leafCol)) and "nominal" not in attributes)


@dataclass
class Tree:
    """A full binary tree in heap order: below a leaf, rows go left and keep its value."""
    depth: int
    column: np.ndarray = field(init=False)  # -1: a leaf, or below one
    code: np.ndarray = field(init=False)  # a row goes left up to this code
    threshold: np.ndarray = field(init=False)
    gain: np.ndarray = field(init=False)
    stats: np.ndarray = field(init=False)  # count, sum and sum of squares of the targets
    below: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        n = 2 ** (self.depth + 1) - 1
        self.column, self.code = np.full(n, -1), np.full(n, CODES)
        self.threshold, self.gain, self.stats = np.zeros(n), np.zeros(n), np.zeros((n, 3))
        self.below = np.zeros(n, dtype=bool)

    def values(self) -> np.ndarray:
        return self.stats[:, 1] / np.maximum(self.stats[:, 0], 1)


def places(codes: np.ndarray, column: np.ndarray, code: np.ndarray, level: int) -> np.ndarray:
    """Where the rows are in a tree after ``level`` splits, counted from the left."""
    node, rows = np.zeros(codes.shape[1], dtype=np.int64), np.arange(codes.shape[1])
    for _ in range(level):
        node = 2 * node + 1 + (codes[column[node], rows] > code[node])
    return node - (2 ** level - 1)


def _module(package, name: str):
    """A Scala object."""
    return getattr(getattr(package, f"{name}$"), "MODULE$")


def mllib_thresholds(est: GBTClassifier, rows: DataFrame) -> list[np.ndarray]:
    """By column, the thresholds that MLlib finds for a training on ``rows``."""
    jvm, seed = rows.sparkSession._jvm, est.getSeed()
    est._transfer_params_to_java()
    instances = _module(jvm.org.apache.spark.ml.util, "DatasetUtils").extractInstances(est._java_obj, rows._jdf, jvm.scala.Some(2))
    categories = jvm.org.apache.spark.ml.util.MetadataUtils.getCategoricalFeatures(rows._jdf.schema().apply(est.getFeaturesCol()))
    regression = jvm.org.apache.spark.mllib.tree.configuration.Algo.Regression()
    strategy = est._java_obj.getOldBoostingStrategy(categories, regression).treeStrategy()
    metadata = jvm.org.apache.spark.ml.tree.impl.DecisionTreeMetadata.buildMetadata(instances, strategy, 1, "all")
    found = _module(jvm.org.apache.spark.ml.tree.impl, "RandomForest").findSplits(instances, metadata, seed)
    return [np.array([0.5]) if categories.contains(j) else np.array([split.threshold() for split in splits]) for j, splits in enumerate(found)]


def coded(rows: DataFrame, features: str, folds: int, cuts: Sequence[np.ndarray], trainings: int) -> RDD:
    """Blocks of (codes by column, labels -1 and 1, bounds of the folds, score of each training), dealt evenly."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            label, fold = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "fold"))
            values = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(len(label), -1)
            order = np.argsort(fold, kind="stable")
            codes = np.stack([np.searchsorted(cut, column, side="left").astype(np.uint8) for cut, column in zip(cuts, values[order].T)])
            data = (codes, 2.0 * label[order] - 1, np.searchsorted(fold[order], np.arange(folds + 1)), np.zeros((trainings, len(label))))
            yield pa.RecordBatch.from_pydict({"block": pa.array([pickle.dumps(data, pickle.HIGHEST_PROTOCOL)], pa.binary())})

    n, parts = rows.count(), rows.rdd.getNumPartitions()
    tasks = max(min(MANY_TASKS, -(-n // TASK_ROWS)), -(-n // (10 * TASK_ROWS)))
    blocks = rows.select(vector_to_array(features).alias("features"), "label", "fold").mapInArrow(pack, "block binary").rdd
    numbered = blocks.mapPartitionsWithIndex(lambda p, part: (((i, p), bytes(r["block"])) for i, r in enumerate(part)))
    dealt = numbered.partitionBy(tasks, lambda at: (at[0] * parts + at[1]) % tasks)
    return dealt.mapPartitions(lambda part: (data for _, data in sorted(part, key=lambda one: one[0]))).persist(StorageLevel.MEMORY_AND_DISK)


def targets(label: np.ndarray, score: np.ndarray, first: bool) -> np.ndarray:
    """What a tree learns: the labels, then the negative gradient of the logistic loss."""
    with np.errstate(over="ignore"):
        return label + np.zeros_like(score) if first else 4.0 * label / (1.0 + np.exp(2.0 * label * score))


def counted(part: Iterator[bytes], folds: int, trainings: Sequence[int], sizes: np.ndarray, trees: Sequence[tuple], level: int,
            first: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Count, sum and sum of squares of the targets of the rows: by training, node and code of the columns that have
    more than two codes (``sizes`` of them); by training, node and column with two codes, of the upper one, and of all rows last."""
    many, two, nodes = np.flatnonzero(sizes > 2), np.flatnonzero(sizes == 2), 2 ** level
    starts = np.concatenate([[0], np.cumsum(sizes[many])])
    coded_sums, upper_sums = np.zeros((len(trainings), nodes, starts[-1], 3)), np.zeros((len(trainings), nodes, len(two) + 1, 3))
    for data in part:
        codes, label, bounds, scores = pickle.loads(data)
        for k in range(folds):
            some, own = [i for i, training in enumerate(trainings) if training != k], slice(bounds[k], bounds[k + 1])
            n = bounds[k + 1] - bounds[k]
            if not some or not n:
                continue
            x, y = codes[:, own], targets(label[own], scores[some, own], first)
            node = np.stack([places(x, *trees[i], level) for i in some])
            squares, slots = y * y, np.arange(len(some))[:, None] * nodes + node
            for j, c in enumerate(many):
                size = sizes[c]
                at = (slots * size + x[c]).ravel()
                for s, weights in enumerate((None, y.ravel(), squares.ravel())):
                    sums = np.bincount(at, weights, len(some) * nodes * size)
                    coded_sums[some, :, starts[j]:starts[j + 1], s] += sums.reshape(len(some), nodes, size)
            upper = np.ones((len(two) + 1, n))
            upper[:-1] = x[two]
            spread = np.zeros((len(some) * nodes, 3, n))
            rows = np.arange(n)
            for s, weights in enumerate((1.0, y, squares)):
                spread[slots, s, rows] = weights
            products = (upper @ spread.reshape(-1, n).T).reshape(len(two) + 1, len(some), nodes, 3)
            upper_sums[some] += products.transpose(1, 2, 0, 3)
    yield coded_sums, upper_sums


def variance(stats: np.ndarray) -> np.ndarray:
    count, total, squares = np.moveaxis(stats, -1, 0)
    safe = np.maximum(count, 1)
    return (squares - total * total / safe) / safe


def best_split(lower: np.ndarray, total: np.ndarray, least_rows: int, least_gain: float) -> tuple[int, float]:
    """Place of the first split with the greatest gain, and the gain; ``lower`` are its left side's sums."""
    upper = total - lower
    gain = variance(total) - lower[:, 0] / total[0] * variance(lower) - upper[:, 0] / total[0] * variance(upper)
    valid = (lower[:, 0] >= least_rows) & (upper[:, 0] >= least_rows) & (gain >= least_gain)
    gain = np.where(valid, gain, -np.inf)
    return int(gain.argmax()), float(gain.max())


def boosted(est: GBTClassifier, rows: DataFrame, folds: int, trainings: Sequence[int]) -> list[GBTClassificationModel]:
    """The models of ``trainings``: number ``k < folds`` leaves out fold ``k``, ``folds`` takes all rows, which are written ones."""
    cuts = [mllib_thresholds(est, rows if k == folds else rows.where(F.col("fold") != k)) for k in trainings]
    every = [np.unique(np.concatenate(column)) for column in zip(*cuts)]
    sizes = np.array([len(cut) + 1 for cut in every])
    if sizes.max() > CODES:  # more thresholds than a code tells apart: in two halves
        half = len(trainings) // 2
        return boosted(est, rows, folds, trainings[:half]) + boosted(est, rows, folds, trainings[half:])
    many, two = np.flatnonzero(sizes > 2), np.flatnonzero(sizes == 2)
    starts = dict(zip(many, np.concatenate([[0], np.cumsum(sizes[many])])))
    uppers = {c: j for j, c in enumerate(two)}
    n_steps, depth, blocks = est.getMaxIter(), est.getMaxDepth(), coded(rows, est.getFeaturesCol(), folds, every, len(trainings))
    forests: list[list[Tree]] = [[] for _ in trainings]
    for step in range(n_steps):
        grown = [Tree(depth) for _ in trainings]
        for level in range(depth):
            trees = [(tree.column, tree.code) for tree in grown]
            parts = blocks.mapPartitions(lambda part, trees=trees, level=level, first=step == 0: counted(part, folds, trainings, sizes, trees, level, first))
            added = lambda a, b: (a[0] + b[0], a[1] + b[1])
            coded_sums, upper_sums = parts.treeReduce(added) if blocks.getNumPartitions() > FLAT_SUMS else reduce(added, parts.collect())
            if level == 0 and step:
                before.unpersist()  # this pass has read it, and written the scores after it
            for i, tree in enumerate(grown):
                for place in range(2 ** level):
                    _grow(tree, 2 ** level - 1 + place, coded_sums[i, place], upper_sums[i, place], cuts[i], every, starts, uppers, est)
        for forest, tree in zip(forests, grown):
            forest.append(tree)
        if step + 1 < n_steps:
            learned = [(tree.column, tree.code, tree.values(), 1.0 if step == 0 else est.getStepSize()) for tree in grown]

            def scored(data: bytes, learned: list = learned) -> bytes:
                codes, label, bounds, scores = pickle.loads(data)
                for score, (column, code, values, share) in zip(scores, learned):
                    score += share * values[2 ** depth - 1 + places(codes, column, code, depth)]
                return pickle.dumps((codes, label, bounds, scores), pickle.HIGHEST_PROTOCOL)

            before, blocks = blocks, blocks.map(scored).persist(StorageLevel.MEMORY_AND_DISK)
    blocks.unpersist()
    return [_model(est, rows, forest, len(sizes)) for forest in forests]


def _grow(tree: Tree, node: int, by_code: np.ndarray, upper: np.ndarray, cuts: Sequence[np.ndarray], every: Sequence[np.ndarray],
          starts: dict, uppers: dict, est: GBTClassifier) -> None:
    """Splits ``node``, or leaves it a leaf whose rows and value go to the left below."""
    left, right, total = 2 * node + 1, 2 * node + 2, upper[-1]
    if node == 0:
        tree.stats[0] = total
    found: list[tuple[float, int, int, float, np.ndarray]] = []
    if not tree.below[node]:
        lower, at = [], []
        for c, own in enumerate(cuts):
            if not len(own):
                continue
            codes = np.searchsorted(every[c], own)
            if c in starts:
                lower.append(np.cumsum(by_code[starts[c]:starts[c] + len(every[c]) + 1], axis=0)[codes])
            else:
                lower.append(total - upper[uppers[c]][None, :])
            at += [(c, int(code), float(cut)) for code, cut in zip(codes, own)]
        if at:
            sides = np.concatenate(lower)
            place, gain = best_split(sides, total, est.getMinInstancesPerNode(), est.getMinInfoGain())
            if gain > 0:
                found.append((gain, *at[place], sides[place]))
    if not found:
        tree.below[[left, right]] = True
        tree.stats[left] = tree.stats[right] = tree.stats[node]
        tree.column[node] = -1
        return
    tree.gain[node], tree.column[node], tree.code[node], tree.threshold[node], tree.stats[left] = found[0]
    tree.stats[right] = total - tree.stats[left]


def _model(est: GBTClassifier, rows: DataFrame, forest: Sequence[Tree], n_columns: int) -> GBTClassificationModel:
    """MLlib's model of the trees."""
    jvm, gateway = rows.sparkSession._jvm, rows.sparkSession.sparkContext._gateway
    tree_of, regression = jvm.org.apache.spark.ml.tree, jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel

    def built(tree: Tree, node: int):
        stats = gateway.new_array(gateway.jvm.double, 3)
        for i, value in enumerate(tree.stats[node]):
            stats[i] = float(value)
        impurity = float(variance(tree.stats[node]))
        calculator = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator(stats, int(tree.stats[node][0]))
        value = float(tree.values()[node])
        if tree.column[node] < 0:
            return tree_of.LeafNode(value, impurity, calculator)
        split = tree_of.ContinuousSplit(int(tree.column[node]), float(tree.threshold[node]))
        return tree_of.InternalNode(value, impurity, float(tree.gain[node]), built(tree, 2 * node + 1), built(tree, 2 * node + 2), split, calculator)

    trees, weights = gateway.new_array(regression, len(forest)), gateway.new_array(gateway.jvm.double, len(forest))
    for i, tree in enumerate(forest):
        trees[i], weights[i] = regression(built(tree, 0), n_columns), 1.0 if i == 0 else est.getStepSize()
    made = jvm.org.apache.spark.ml.classification.GBTClassificationModel(est.uid, trees, weights, n_columns, 2)
    return est._copyValues(est._create_model(made))
