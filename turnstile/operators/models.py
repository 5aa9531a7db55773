"""Model training and ranking with Spark MLlib.

* L1 split: a deterministic hash of the id (not ``randomSplit``), so the
  split does not depend on partitioning and survives recomputation.
* L2-L4 "automl": a fixed list of model families, each cross-validated over
  folds that a hash of the id fixes, all trainings side by side; every grid point
  is a model of the leaderboard.  Two stacked ensembles (all models, best of
  each family) learn from out-of-fold scores only.  An optional wall-clock
  budget is checked between families.
* L5/L6 leaderboard and its long form; L7 predictions with the id kept;
  L8 grid search; L9 cross-validation metrics; L10 parameters.
* S5/S6: ``PipelineModel`` save/load in the shared checkpoint folder and a
  registry table of saved models.
"""

from __future__ import annotations

import functools
import math
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression,
                                       MultilayerPerceptronClassifier, RandomForestClassifier)
from pyspark.ml.evaluation import BinaryClassificationEvaluator, Evaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, scratch_path
from . import boosting, lockstep

SPLIT_SEED = 1234


def split_bucket(id_col: str = "EmployeeNumber", seed: int = SPLIT_SEED) -> F.Column:
    """Deterministic 0..99 bucket: first 32 bits of md5("seed:id") as a share of 100."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    part = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(part * 100 / F.lit(1 << 32)).cast("int")


def split_train_test(df: DataFrame, ratio: float = 0.85, id_col: str = "EmployeeNumber",
                     seed: int = SPLIT_SEED) -> tuple[DataFrame, DataFrame]:
    """L1: ``ratio`` of rows to train, the rest to test (by id hash)."""
    b = split_bucket(id_col, seed)
    cut = int(round(ratio * 100))
    return df.where(b < cut), df.where(b >= cut)


def split_three(df: DataFrame, ratios: Sequence[float] = (0.7, 0.15), id_col: str = "EmployeeNumber",
                seed: int = SPLIT_SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """L1 three-way variant (train / valid / test)."""
    b = split_bucket(id_col, seed)
    c1 = int(round(ratios[0] * 100))
    c2 = c1 + int(round(ratios[1] * 100))
    return df.where(b < c1), df.where((b >= c1) & (b < c2)), df.where(b >= c2)


#: Rows that a task trains on, up to ``MANY_TASKS`` tasks; beyond, up to ten times as many (a task has a cost of its own in every pass).
TASK_ROWS, MANY_TASKS = 60_000, 32


def spread(df: DataFrame, id_col: str = "EmployeeNumber") -> DataFrame:
    """``df`` in as many partitions as its rows are worth, whatever files it is read from, in the order of the id.

    A model is trained in hundreds of passes, each as slow as the largest partition, and a
    file may come as one.  The number follows from the rows alone, so that what is
    drawn by partition is the same on any cluster; one task's rows stay as they are.
    """
    n = df.count()
    parts = max(min(MANY_TASKS, -(-n // TASK_ROWS)), -(-n // (10 * TASK_ROWS)))
    return df.repartition(parts, id_col).sortWithinPartitions(id_col) if parts > 1 else df


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once, its partitions and their order as they are, and cached.

    Every task carries the steps that its rows come from, and a training has hundreds of short
    passes: a plan that begins at the written rows leaves the joins and the preparation out of them.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint().cache()


CATEGORICAL = ["Department", "JobRole", "OverTime", "BusinessTravel", "MaritalStatus", "EducationField"]
NUMERIC = ["Age", "DistanceFromHome", "MonthlyIncome", "JobLevel", "StockOptionLevel", "JobInvolvement",
           "JobSatisfaction", "EnvironmentSatisfaction", "WorkLifeBalance", "PerformanceRating",
           "YearsAtCompany", "TotalWorkingYears", "YearsInCurrentRole"]


def feature_stages(categorical: Sequence[str] = CATEGORICAL, numeric: Sequence[str] = NUMERIC,
                   label: str = "Attrition", positive: str = "Yes"):
    """Index + one-hot the categories, assemble a feature vector, index the
    label so that ``positive`` is 1.0.  The id column is not a predictor.
    A missing category is a level of its own; a missing number becomes the
    training median."""
    idx = StringIndexer(inputCols=list(categorical), outputCols=[f"{c}__idx" for c in categorical], handleInvalid="keep")
    ohe = OneHotEncoder(inputCols=[f"{c}__idx" for c in categorical],
                        outputCols=[f"{c}__ohe" for c in categorical], dropLast=True, handleInvalid="keep")
    imp = Imputer(inputCols=list(numeric), outputCols=[f"{c}__num" for c in numeric], strategy="median")
    asm = VectorAssembler(inputCols=[f"{c}__ohe" for c in categorical] + [f"{c}__num" for c in numeric],
                          outputCol="features")
    lab = StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc")
    return [idx, ohe, imp, asm, lab], positive


def families(n_features: int, seed: int = SPLIT_SEED) -> list[tuple[str, object, list]]:
    """(model_type, estimator, param grid) for each family."""
    lr = LogisticRegression(maxIter=50)
    gbm = GBTClassifier(maxIter=20, maxDepth=3, seed=seed)
    rf = RandomForestClassifier(numTrees=30, maxDepth=5, seed=seed)
    mlp = MultilayerPerceptronClassifier(layers=[n_features, 8, 2], maxIter=50, seed=seed)
    return [
        ("GLM", lr, ParamGridBuilder().addGrid(lr.regParam, [0.0, 0.01]).build()),
        ("GBM", gbm, ParamGridBuilder().addGrid(gbm.maxDepth, [3]).build()),
        ("DRF", rf, ParamGridBuilder().addGrid(rf.numTrees, [30]).build()),
        ("DeepLearning", mlp, ParamGridBuilder().addGrid(mlp.maxIter, [50]).build()),
    ]


def p_yes(pred: DataFrame) -> DataFrame:
    """Probability of the positive class (label index 1 = 'Yes' in
    alphabetical order) as a plain column."""
    return pred.withColumn("Yes", vector_to_array("probability")[1]) \
               .withColumn("No", vector_to_array("probability")[0])


def areas_under_roc(scored: DataFrame, keys: int) -> list[float]:
    """Of each key 0..keys-1 of (key, score, label): the share of (positive, negative) pairs that the scores put
    in the right order, ties half, which is the area under the ROC curve at every distinct score, from whole
    numbers.  Rows are read once for all keys, and counted by key and score."""
    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """By key: positives, negatives and twice the pairs in the right order of a range of scores, which ascend."""
        sums: dict[int, list[int]] = {}
        for batch in batches:
            key, pos, neg = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "pos", "neg"))
            starts = np.flatnonzero(np.diff(key, prepend=-1))  # keys ascend from 0
            for k, p, n in zip(key[starts], np.split(pos, starts[1:]), np.split(neg, starts[1:])):
                at = sums.setdefault(int(k), [0, 0, 0])
                at[2] += int((p * (2 * (at[1] + np.cumsum(n) - n) + n)).sum())
                at[0], at[1] = at[0] + int(p.sum()), at[1] + int(n.sum())
        names = ("pos", "neg", "pairs")
        columns = {"key": pa.array(sums, pa.int32())} | {c: pa.array([at[i] for at in sums.values()], pa.int64()) for i, c in enumerate(names)}
        yield pa.RecordBatch.from_pydict(columns)

    yes = F.col("label") > 0.5
    counts = (scored.groupBy(F.col("key").cast("int").alias("key"), "score")
              .agg(F.count_if(yes).alias("pos"), F.count_if(~yes).alias("neg")))
    ranges = (counts.repartitionByRange("key", "score").sortWithinPartitions("key", "score")
              .mapInArrow(in_order, "key int, pos long, neg long, pairs long"))
    sums = {k: (0, 0, 0) for k in range(keys)}
    for r in ranges.collect():  # one row per range and key in it, in their order
        pos, neg, pairs = sums[r["key"]]
        sums[r["key"]] = pos + r["pos"], neg + r["neg"], pairs + r["pairs"] + 2 * r["pos"] * neg
    # the curve of one class, as MLlib draws it
    return [pairs / (2 * pos * neg) if pos and neg else 1.0 if pos else 0.0 if neg else 0.5 for pos, neg, pairs in sums.values()]


class AreaUnderROC(Evaluator):
    """``areas_under_roc`` of one model's probabilities."""

    def _evaluate(self, dataset: DataFrame) -> float:
        return areas_under_roc(dataset.select(F.lit(0).alias("key"), vector_to_array("probability")[1].alias("score"), "label"), 1)[0]


def ranking(metric: str) -> Evaluator:
    """Area under a curve over the probabilities that ``predict`` returns (equal
    ones tie, where raw margins may differ), at every distinct score."""
    if metric == "areaUnderROC":
        return AreaUnderROC()
    return BinaryClassificationEvaluator(metricName=metric, rawPredictionCol="probability", numBins=0)


def score_metrics(pred: DataFrame) -> dict[str, float]:
    """auc, aucpr, logloss, rmse, mse, mean_per_class_error at 0.5 (one pass
    + two evaluator passes, over rows that are scored once)."""
    ev_roc, ev_pr = ranking("areaUnderROC"), ranking("areaUnderPR")
    pred = pred.select("probability", "label").cache()
    p = p_yes(pred)
    y = F.col("label")
    pc = F.least(F.greatest(F.col("Yes"), F.lit(1e-15)), F.lit(1 - 1e-15))
    row = p.agg(F.avg(F.when(y == 1, -F.log(pc)).otherwise(-F.log(1 - pc))).alias("logloss"),
                F.avg((F.col("Yes") - y) ** 2).alias("mse"),
                F.avg(F.when(y == 1, (F.col("Yes") < 0.5).cast("double"))).alias("err1"),
                F.avg(F.when(y == 0, (F.col("Yes") >= 0.5).cast("double"))).alias("err0")).first()
    mse = row["mse"] or 0.0
    auc, aucpr = ev_roc.evaluate(pred), ev_pr.evaluate(pred)
    pred.unpersist()
    return {"auc": auc, "aucpr": aucpr, "logloss": row["logloss"],
            "mean_per_class_error": ((row["err0"] or 0.0) + (row["err1"] or 0.0)) / 2,
            "rmse": mse ** 0.5, "mse": mse}


@dataclass
class AutoMLResult:
    """``models`` holds every model of the leaderboard, ensembles included;
    ``fold_models`` the cross-validation models of each one that is no ensemble, all behind the same preparation."""
    leaderboard: DataFrame
    models: dict[str, PipelineModel] = field(default_factory=dict)
    types: dict[str, str] = field(default_factory=dict)
    fold_models: dict[str, list[PipelineModel]] = field(default_factory=dict)


def _pos_rank(df: DataFrame, order_col: str, desc: bool) -> DataFrame:
    w = Window.orderBy(F.col(order_col).desc() if desc else F.col(order_col).asc(), "model_id")
    return df.withColumn("position", F.row_number().over(w))  # one row per model


def fold_of(id_col: str, folds: int, seed: int = SPLIT_SEED) -> F.Column:
    """Cross-validation fold 0..folds-1 of a row, by a hash of its id."""
    digest = F.md5(F.concat(F.lit(f"fold:{seed}:"), F.col(id_col).cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")


def _base_stages(bases: Sequence[tuple[str, Model]]) -> list:
    """Stages that score one frame by each base model in turn (no joins) and
    gather the positive probabilities in ``base_scores``, in their order."""
    stages: list = []
    for i, (_, model) in enumerate(bases):
        own = model.copy()
        own.setRawPredictionCol(f"_raw{i}").setProbabilityCol(f"_prob{i}").setPredictionCol(f"_pred{i}")
        stages += [own, VectorSlicer(inputCol=f"_prob{i}", outputCol=f"_yes{i}", indices=[1])]
    return [*stages, VectorAssembler(inputCols=[f"_yes{i}" for i in range(len(bases))], outputCol="base_scores")]


def _out_of_fold(tr: DataFrame, fold_bases: Sequence[Sequence[tuple[str, Model]]]) -> DataFrame:
    """(fold, label, base_scores): each row scored by the models that did not see its fold."""
    parts = [PipelineModel(stages=_base_stages(bases)).transform(tr.where(F.col("fold") == k))
             .select("fold", "label", "base_scores") for k, bases in enumerate(fold_bases)]
    return functools.reduce(DataFrame.unionByName, parts)


def _long(scored: DataFrame, scores: str, n: int, fold: F.Column | int = 0) -> DataFrame:
    """(key, score, label): a row per model for each of ``scored``; the key is the fold times ``n``, the number of models, plus the model's place."""
    return scored.select(F.lit(fold).alias("_fold"), "label", F.posexplode(vector_to_array(scores)).alias("_place", "score")) \
                 .select((F.col("_fold") * n + F.col("_place")).alias("key"), "score", "label")


def fold_areas(held_out: DataFrame, n: int, folds: int) -> list[list[float]]:
    """Of each of the ``n`` models, its area under the ROC curve on every fold of ``_out_of_fold``, all counted in one pass."""
    areas = areas_under_roc(_long(held_out, "base_scores", n, F.col("fold")), n * folds)
    return [areas[i::n] for i in range(n)]


def _every_score(bases: Sequence[tuple[str, Model]], metas: Sequence[tuple[list[int], Model]]) -> PipelineModel:
    """Scores of all models in one pass, in ``scores``: the base models', then those of the ensembles, each from the base models
    at its places."""
    stages = [*_base_stages(bases)]
    for j, (places, meta) in enumerate(metas):
        own = meta.copy()
        own.setFeaturesCol(f"_chosen{j}").setRawPredictionCol(f"_metaraw{j}").setProbabilityCol(f"_meta{j}").setPredictionCol(f"_metapred{j}")
        stages += [VectorSlicer(inputCol="base_scores", outputCol=f"_chosen{j}", indices=places), own,
                   VectorSlicer(inputCol=f"_meta{j}", outputCol=f"_metayes{j}", indices=[1])]
    return PipelineModel(stages=[*stages, VectorAssembler(inputCols=["base_scores", *(f"_metayes{j}" for j in range(len(metas)))], outputCol="scores")])


#: Trainings, scorings or model files that are under way at the same time.
AT_ONCE = 8


def side_by_side(fn: Callable, items: Sequence, at_once: int = AT_ONCE) -> list:
    """``fn`` of every item, in order.  A model is trained, scored or saved in many short
    passes that leave cores idle between them; ``at_once`` of them share the cluster."""
    if not items:
        return []
    with ThreadPool(min(at_once, len(items))) as pool:
        return pool.map(inheritable_thread_target(SparkSession.active())(fn), items, chunksize=1)


def _chains(points: Sequence[tuple[Estimator, dict]]) -> list[list[int]]:
    """Places of the points; perceptrons that differ in the limit of iterations alone are together, the greatest limit first."""
    chains: dict = {}
    for i, (est, params) in enumerate(points):
        alike = i
        if isinstance(est, MultilayerPerceptronClassifier):
            alike = (est.uid, *sorted((p.name, str(v)) for p, v in params.items() if p != est.maxIter))
        chains.setdefault(alike, []).append(i)
    return [sorted(chain, key=lambda i: -_limit(*points[i])) if len(chain) > 1 else chain for chain in chains.values()]


def _limit(est: MultilayerPerceptronClassifier, params: dict) -> int:
    return params.get(est.maxIter, est.getMaxIter())


def _need_folds(rows: DataFrame, folds: int) -> None:
    seen = {r[0] for r in rows.select("fold").distinct().collect()}  # one row per fold
    if seen != set(range(folds)) or folds < 2:
        raise ValueError(f"every fold from 0 to {folds - 1} needs rows, and every row a fold; found {sorted(map(str, seen))}")


def cross_validate(points: Sequence[tuple[Estimator, dict]], rows: DataFrame, folds: int, evaluator: Evaluator | None,
                   refit: bool = True, at_once: int = AT_ONCE) -> list[tuple[float | None, list[Model], Model | None]]:
    """Of each (estimator, parameters): the mean metric over the folds, the folds' models and, with ``refit``, the model of all rows.
    Without an evaluator there is no metric: ``fold_areas`` takes that of all models from one pass over the rows.

    ``rows``, best cached, has a column ``fold``.  A training filters it by column, without
    ``CrossValidator``'s Python check of every row and its copy of the rows for each fold and
    family; trainings of all points and folds share one pool.  A perceptron that ended by itself is
    also the model of a smaller limit of iterations that it didn't reach.
    """
    _need_folds(rows, folds)

    def trained(job: tuple[list[int], int | None]) -> list[tuple[Model, float | None]]:
        chain, k = job
        others = rows if k is None else rows.where(F.col("fold") != k)
        found: list[tuple[Model, float | None]] = []
        taken = math.inf  # iterations of the last training
        for i in chain:
            est, params = points[i]
            if found and taken <= _limit(est, params):
                model, metric = found[-1]
                found.append((model.copy({model.maxIter: _limit(est, params)}), metric))
                continue
            model = est.fit(others, params)
            if i != chain[-1]:
                taken = model.summary().totalIterations
            unseen = k is not None and evaluator is not None
            found.append((model, evaluator.evaluate(model.transform(rows.where(F.col("fold") == k))) if unseen else None))
        return found

    jobs = [(chain, k) for chain in _chains(points) for k in ([None] if refit else []) + list(range(folds))]
    done = {(i, k): one for (chain, k), found in zip(jobs, side_by_side(trained, jobs, at_once)) for i, one in zip(chain, found)}
    return [(math.fsum(done[i, k][1] for k in range(folds)) / folds if evaluator else None, [done[i, k][0] for k in range(folds)],
             done[i, None][0] if refit else None) for i in range(len(points))]


def _alike(est: Estimator, rows: DataFrame) -> tuple:
    """What the perceptrons that ``lockstep`` trains together have in common; () for what MLlib trains."""
    if not isinstance(est, MultilayerPerceptronClassifier) or est.getSolver() != "l-bfgs" or est.isSet(est.initialWeights):
        return ()
    return (est.getFeaturesCol(), est.getBlockSize()) if rows.rdd.getNumPartitions() > 1 else ()


def _grown_together(est: Estimator, rows: DataFrame) -> bool:
    return isinstance(est, GBTClassifier) and rows.rdd.getNumPartitions() > 1 and boosting.supports(est, rows)


def cross_fit(points: Sequence[tuple[Estimator, dict]], rows: DataFrame, folds: int, refit: bool = True,
              at_once: int = AT_ONCE) -> list[tuple[list[Model], Model | None]]:
    """Of each (estimator, parameters): the folds' models and, with ``refit``, the model of all rows.  On rows of more than
    one task, perceptrons are trained together, in passes over the rows that they share, and so are the
    boosted trees of all folds; the others side by side."""
    _need_folds(rows, folds)
    shared: dict[tuple, list[int]] = {}
    for i, (est, params) in enumerate(points):
        own = est.copy(params)
        shared.setdefault(("boosted", i) if _grown_together(own, rows) else _alike(own, rows), []).append(i)

    def trained(key: tuple) -> list[tuple[list[Model], Model | None]]:
        some = [points[i] for i in shared[key]]
        if key[:1] == ("boosted",):
            [(est, params)] = some
            fits = boosting.boosted(est.copy(params), rows, folds, range(folds + refit))
            return [(fits[:folds], fits[folds] if refit else None)]
        if key:
            return [(fits[:folds], fits[folds] if refit else None) for fits in lockstep.perceptrons(some, rows, folds, range(folds + refit))]
        return [(of_folds, model) for _, of_folds, model in cross_validate(some, rows, folds, None, refit, at_once)]

    done = {i: fit for key, fits in zip(shared, side_by_side(trained, list(shared), at_once)) for i, fit in zip(shared[key], fits)}
    return [done[i] for i in range(len(points))]


def automl(train: DataFrame, leaderboard_frame: DataFrame, folds: int = 5, budget_sec: float | None = None,
           seed: int = SPLIT_SEED, parallelism: int = AT_ONCE, id_col: str = "EmployeeNumber") -> AutoMLResult:
    """Fit every family with k-fold CV, add the stacked ensembles, rank.

    The leaderboard has ``auc`` on ``leaderboard_frame``, ``train_auc`` and
    ``cv_auc`` (mean over the folds; NULL for ensembles, which are fitted on
    out-of-fold scores and have no folds of their own).
    """
    stages, _ = feature_stages()
    train = spread(train.select(id_col, *CATEGORICAL, *NUMERIC, "Attrition"), id_col).cache()
    prep = Pipeline(stages=stages).fit(train)
    prepared = [lambda: prep.transform(train.withColumn("fold", fold_of(id_col, folds, seed))).select("features", "label", "fold"),
                lambda: prep.transform(spread(leaderboard_frame, id_col)).select("features", "label")]
    tr, lb = side_by_side(lambda rows: kept(rows()), prepared, parallelism)
    n_features = len(tr.first()["features"])
    models, types, fold_models = {}, {}, {}
    bases: dict[str, Model] = {}
    subs: dict[str, list[Model]] = {}

    start = time.time()
    every = families(n_features, seed)
    # families are trained at once, but for a budget, which is checked between them
    for some in [every] if budget_sec is None else [[family] for family in every]:
        points = [(mtype, est, params) for mtype, est, grid in some for params in grid]
        fits = cross_fit([(est, params) for _, est, params in points], tr, folds, at_once=parallelism)
        for (mtype, _, _), (of_folds, model) in zip(points, fits):
            mid = f"{mtype}_{sum(t == mtype for t in types.values()) + 1}_AutoML"
            bases[mid], subs[mid], types[mid] = model, of_folds, mtype
            fold_models[mid] = [PipelineModel(stages=[*prep.stages, sub]) for sub in of_folds]
            models[mid] = PipelineModel(stages=[*prep.stages, model])
        if budget_sec is not None and time.time() - start > budget_sec:
            break

    # written: a pass of the ensembles' training would carry every base model of every fold to each task
    held_out = kept(_out_of_fold(tr, [[(mid, subs[mid][k]) for mid in bases] for k in range(folds)]))
    cv_auc = {mid: math.fsum(areas) / folds for mid, areas in zip(bases, fold_areas(held_out, len(bases), folds))}
    best_of: dict[str, str] = {}
    for mid in bases:
        if types[mid] not in best_of or cv_auc[mid] > cv_auc[best_of[types[mid]]]:
            best_of[types[mid]] = mid

    def stacked(places: list[int]) -> Model:
        chosen = VectorSlicer(inputCol="every_score", outputCol="base_scores", indices=places)
        rows = chosen.transform(held_out.withColumnRenamed("base_scores", "every_score"))
        return LogisticRegression(maxIter=50, featuresCol="base_scores").fit(rows)

    ensembles = {f"StackedEnsemble_{name}_AutoML": [list(bases).index(mid) for mid in chosen] for name, chosen in
                 (("AllModels", list(bases)), ("BestOfFamily", list(best_of.values()))) if len(chosen) > 1}
    metas = side_by_side(stacked, list(ensembles.values()), parallelism)
    held_out.unpersist()
    for (mid, places), meta in zip(ensembles.items(), metas):
        models[mid], types[mid] = PipelineModel(stages=[*prep.stages, *_base_stages([list(bases.items())[i] for i in places]), meta]), "StackedEnsemble"

    scorer = _every_score(list(bases.items()), list(zip(ensembles.values(), metas)))
    lb_scores = scorer.transform(lb).select("label", vector_to_array("scores").alias("scores")).cache()
    lb_scores.count()  # scored once; the metrics of all models read the scores side by side

    def measured(i: int) -> dict[str, float]:
        yes = F.col("scores")[i]
        return score_metrics(lb_scores.select(array_to_vector(F.array(1 - yes, yes)).alias("probability"), "label"))

    *metrics, train_auc = side_by_side(lambda job: job(), [
        *(functools.partial(measured, i) for i in range(len(models))),
        lambda: areas_under_roc(_long(scorer.transform(tr), "scores", len(models)), len(models))], parallelism)
    lb_scores.unpersist()
    rows = [(mid, types[mid], m["auc"], m["logloss"], m["aucpr"], m["mean_per_class_error"], m["rmse"], m["mse"], area, cv_auc.get(mid))
            for mid, m, area in zip(models, metrics, train_auc)]
    board = train.sparkSession.createDataFrame(
        rows, "model_id string, model_type string, auc double, logloss double, aucpr double, "
              "mean_per_class_error double, rmse double, mse double, train_auc double, cv_auc double")
    board = _pos_rank(board, "auc", desc=True)
    train.unpersist()
    tr.unpersist()
    lb.unpersist()
    return AutoMLResult(board, models, types, fold_models)


def fold_metrics(result: AutoMLResult, train: DataFrame, folds: int = 5, seed: int = SPLIT_SEED,
                 id_col: str = "EmployeeNumber") -> DataFrame:
    """(model_id, fold, auc) of the cross-validation models, each on the fold it did not see."""
    rows_of = spread(train.select(id_col, *CATEGORICAL, *NUMERIC, "Attrition"), id_col).withColumn("fold", fold_of(id_col, folds, seed))
    prep = PipelineModel(stages=next(iter(result.fold_models.values()))[0].stages[:-1])
    of_folds = zip(*([(mid, sub.stages[-1]) for sub in models] for mid, models in result.fold_models.items()), strict=True)
    prepared = prep.transform(rows_of).select("features", "label", "fold").cache()
    areas = fold_areas(_out_of_fold(prepared, list(of_folds)), len(result.fold_models), folds)
    prepared.unpersist()
    rows = [(mid, k, area) for mid, of_model in zip(result.fold_models, areas) for k, area in enumerate(of_model)]
    return train.sparkSession.createDataFrame(rows, "model_id string, fold int, auc double")


def leaderboard_long(board: DataFrame, order_by: str = "auc", n_max: int = 20) -> DataFrame:
    """Top ``n_max`` models, id prefixed with its position, metrics long.

    ``order_by`` is "auc" or "logloss"."""
    order_by = order_by.lower()
    if order_by not in ("auc", "logloss"):
        raise ValueError(f"a leaderboard can be ordered by auc or logloss, not by {order_by!r}")
    # the first n_max models of the leaderboard keep their place as prefix; level
    # orders them by the metric, the best one last
    ranked = board.where(F.col("position") <= n_max)
    best_last = Window.orderBy(F.col(order_by).asc() if order_by == "auc" else F.col(order_by).desc(), "model_id")
    ranked = ranked.withColumn("level", F.row_number().over(best_last))  # one row per model
    ranked = ranked.withColumn("model_id", F.concat(F.col("position").cast("string"), F.lit(". "), F.col("model_id")))
    metrics = ["auc", "logloss", "aucpr", "mean_per_class_error", "rmse", "mse"]
    return ranked.unpivot(["position", "level", "model_id", "model_type"], metrics, "key", "value")


def model_by_position(board: DataFrame, n: int = 1) -> str:
    """Id of the model in place ``n`` of the leaderboard."""
    return board.where(F.col("position") == n).select("model_id").first()[0]


def predict(model: PipelineModel, df: DataFrame, threshold: float = 0.5, keep: Sequence[str] = ()) -> DataFrame:
    """Id + predicted class + P(No) + P(Yes), and the columns ``keep`` of ``df``."""
    p = p_yes(model.transform(df))
    return p.select("EmployeeNumber", F.when(F.col("Yes") >= threshold, "Yes").otherwise("No").alias("predict"),
                    "No", "Yes", *keep)


class GridSearch:
    """Hidden layers x epochs grid of perceptrons with k-fold CV.

    Folds are fixed by a hash of the id and the features have unit spread, so
    the grid is the same on any partitioning.  ``table`` has a row per grid
    point, best first; ``model(model_id)`` is that point's model, fitted on all
    training rows when it is first asked for; ``save`` and ``saved`` keep it under the id.
    """

    def __init__(self, train: DataFrame, hidden: Sequence[Sequence[int]], epochs: Sequence[int], folds: int = 5,
                 seed: int = SPLIT_SEED, id_col: str = "EmployeeNumber") -> None:
        self.folds = folds
        stages, _ = feature_stages()
        scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=False)
        slim = spread(train.select(id_col, *CATEGORICAL, *NUMERIC, "Attrition"), id_col)
        self.train = slim.withColumn("fold", fold_of(id_col, folds, seed))
        slim.cache()
        self.prep = Pipeline(stages=[*stages, scaler]).fit(slim)
        tr = kept(self._prepared())
        nf = len(tr.first()["scaled"])
        self.mlp = MultilayerPerceptronClassifier(featuresCol="scaled", seed=seed)
        grid = (ParamGridBuilder().addGrid(self.mlp.layers, [[nf, *h, 2] for h in hidden])
                .addGrid(self.mlp.maxIter, list(epochs)).build())
        fits = cross_fit([(self.mlp, params) for params in grid], tr, folds, refit=False)
        held_out = _out_of_fold(tr, [[(str(i), of_folds[k]) for i, (of_folds, _) in enumerate(fits)] for k in range(folds)])
        areas = fold_areas(held_out, len(grid), folds)
        tr.unpersist()
        slim.unpersist()
        self.points = {f"dl_grid_model_{i + 1}": pm for i, pm in enumerate(grid)}
        rows = [(mid, str(pm[self.mlp.layers][1:-1]), int(pm[self.mlp.maxIter]), metric)
                for (mid, pm), metric in zip(self.points.items(), (math.fsum(of_folds) / folds for of_folds in areas))]
        board = train.sparkSession.createDataFrame(rows, "model_id string, hidden string, epochs int, auc double")
        self.table = board.orderBy(F.col("auc").desc(), "model_id")
        self._models: dict[str, PipelineModel] = {}

    def _prepared(self) -> DataFrame:
        return self.prep.transform(self.train).select("scaled", "label", "fold")

    def model(self, model_id: str) -> PipelineModel:
        if model_id not in self.points:
            raise KeyError(f"no model {model_id!r} in the grid")
        if model_id not in self._models:
            tr = kept(self._prepared())
            point = self.mlp, self.points[model_id]
            fitted = lockstep.perceptrons([point], tr, self.folds, [self.folds])[0][0] if _alike(self.mlp, tr) else self.mlp.fit(tr, point[1])
            tr.unpersist()
            self._models[model_id] = PipelineModel(stages=[*self.prep.stages, fitted])
        return self._models[model_id]

    def save(self, model_id: str, folder: str) -> None:
        self.model(model_id).write().overwrite().save(f"{folder}/{model_id}")

    @staticmethod
    def saved(model_id: str, folder: str) -> PipelineModel:
        return PipelineModel.load(f"{folder}/{model_id}")


def model_params(model: PipelineModel, model_id: str) -> DataFrame:
    """Every parameter of the final estimator; ``is_set`` tells those given from defaults."""
    last = model.stages[-1]
    rows = [(model_id, p.name, str(v), last.isSet(p)) for p, v in last.extractParamMap().items()]
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame(rows, "model_id string, param string, value string, is_set boolean")


def save_model(model: PipelineModel, model_id: str, spark) -> str:
    """Save under the shared checkpoint folder, return the path."""
    path = scratch_path(spark, f"model-{model_id}")
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
