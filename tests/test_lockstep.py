"""Trainings in shared passes: the models are MLlib's, and the passes are shared."""

import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from turnstile.operators import lockstep as ls
from turnstile.operators import models as md


@pytest.fixture(scope="module")
def rows(spark):
    """Three partitions of 400 rows with two features, a noisy label of them and a fold."""
    base = spark.range(0, 1200, numPartitions=3).select("id", (F.col("id") * 37 % 101 / 101).alias("a"), (F.col("id") * 53 % 89 % 2).alias("b"))
    base = base.withColumn("label", (F.col("a") + F.col("id") * 71 % 97 / 97 > 1).cast("double"))
    return md.kept(VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(base).withColumn("fold", md.fold_of("id", 3)))


def test_perceptrons_trained_together_are_mllibs(rows, monkeypatch):
    monkeypatch.setattr(ls, "BLOCK_ROWS", 150)
    monkeypatch.setattr(ls, "TASK_ROWS", 500)
    est = MultilayerPerceptronClassifier(seed=3)
    grid = [{est.layers: [2, *h, 2], est.maxIter: n} for h in ([3], [4, 2]) for n in (2, 12)]
    mine = ls.perceptrons([(est, params) for params in grid], rows, 3, range(4))
    for models, params in zip(mine, grid):
        for k, model in enumerate(models):
            alone = est.fit(rows.where(F.col("fold") != k), params)
            assert abs(model.weights.toArray() - alone.weights.toArray()).max() < 1e-8
            assert (model.getMaxIter(), model.getLayers()) == (params[est.maxIter], params[est.layers])
            here, there = (m.transform(rows).select("probability").first()[0].toArray() for m in (model, alone))
            assert abs(here - there).max() < 1e-8


def test_perceptrons_end_where_mllibs_do(rows):
    est = MultilayerPerceptronClassifier(seed=5, tol=1e-3, layers=[2, 2, 2])
    (short, full), = zip(*ls.perceptrons([(est, {est.maxIter: n}) for n in (300, 600)], rows, 3, [3]))
    alone = est.fit(rows, {est.maxIter: 600})
    assert alone.summary().totalIterations < 300  # it ended by itself
    assert short.weights == full.weights and abs(full.weights.toArray() - alone.weights.toArray()).max() < 1e-6


def test_points_and_folds_share_their_passes(rows, monkeypatch):
    """The passes of ten trainings are those of the longest one; limits that differ alone are one training."""
    rounds, answered, fits = [], ls.answered, []
    monkeypatch.setattr(ls, "answered", lambda asks, answer: answered(asks, lambda points: rounds.append(len(points)) or answer(points)))
    fit = MultilayerPerceptronClassifier._fit
    monkeypatch.setattr(MultilayerPerceptronClassifier, "_fit", lambda self, df: fits.append(self.getMaxIter()) or fit(self, df))
    est = MultilayerPerceptronClassifier(seed=3, layers=[2, 3, 2])
    md.cross_fit([(est, {est.maxIter: n}) for n in (3, 6, 9)], rows, 3, refit=False)
    assert rounds[0] == 3 and len(rounds) < 30 and fits == [0]


def test_trees_grown_together_are_mllibs(spark, rows, monkeypatch):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import OneHotEncoder

    from turnstile.operators import boosting as bo
    monkeypatch.setattr(bo, "TASK_ROWS", 500)
    levels = rows.withColumn("c", (F.col("id") * 13 % 4).cast("double")).withColumn("z", F.lit(1.0)).withColumn("w", F.col("id") * 29 % 997 / 7)
    levels = OneHotEncoder(inputCol="c", outputCol="one_hot", dropLast=False).fit(levels).transform(levels).drop("features")
    frame = md.kept(VectorAssembler(inputCols=["one_hot", "a", "z", "w"], outputCol="features").transform(levels).select("features", "label", "fold"))
    for est in (GBTClassifier(maxIter=4, maxDepth=3, seed=7), GBTClassifier(maxIter=2, maxDepth=2, minInstancesPerNode=150, stepSize=0.3)):
        assert bo.supports(est, frame) and not bo.supports(est.copy({est.subsamplingRate: 0.5}), frame)
        for k, model in enumerate(bo.boosted(est, frame, 3, range(4))):
            alone = est.fit(frame.where(F.col("fold") != k))
            here, there = ([r[0].toArray().tolist() for r in m.transform(frame).select("rawPrediction").collect()] for m in (model, alone))
            assert max(abs(a[1] - b[1]) for a, b in zip(here, there)) < 1e-9
            assert abs(model.featureImportances.toArray() - alone.featureImportances.toArray()).max() < 1e-9
            assert model.treeWeights == alone.treeWeights and model.getMaxDepth() == est.getMaxDepth()


def test_a_model_of_trees_grown_together_is_stored(rows, tmp_path):
    from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
    [([], model)] = [(of_folds[3:], model) for of_folds, model in md.cross_fit([(GBTClassifier(maxIter=2, seed=7), {})], rows, 3)]
    model.write().save(str(tmp_path / "trees"))
    there = GBTClassificationModel.load(str(tmp_path / "trees"))
    assert there.transform(rows).select("probability").collect() == model.transform(rows).select("probability").collect()


def test_all_folds_share_the_passes_of_a_tree(rows, monkeypatch):
    from pyspark.ml.classification import GBTClassifier

    from turnstile.operators import boosting as bo
    fits, grown = [], bo.boosted
    monkeypatch.setattr(GBTClassifier, "_fit", lambda self, df: fits.append(1))
    monkeypatch.setattr(bo, "boosted", lambda *args: fits.append("together") or grown(*args))
    [(of_folds, model)] = md.cross_fit([(GBTClassifier(maxIter=2), {})], rows, 3)
    assert fits == ["together"] and len(of_folds) == 3 and model.getNumTrees == 2
