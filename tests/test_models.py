"""Models: deterministic split, planted-signal quality, leaderboard input check."""

import math
import threading

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import functions as F

from conftest import SF_SMALL
from turnstile.operators import models as md
from turnstile.sources.people import people, score_columns


def test_split_is_deterministic_and_near_ratio(spark):
    hr = people(spark, SF_SMALL)
    tr1, te1 = md.split_train_test(hr)
    tr2, _ = md.split_train_test(hr.repartition(5))
    ids1 = {r[0] for r in tr1.select("EmployeeNumber").collect()}
    ids2 = {r[0] for r in tr2.select("EmployeeNumber").collect()}
    assert ids1 == ids2
    n, ntr = hr.count(), len(ids1)
    assert ntr + te1.count() == n
    assert abs(ntr / n - 0.85) < 0.05


def test_planted_signal_is_learned(spark):
    # label planted from the deterministic score: leave when above its median
    hr = score_columns(people(spark, SF_SMALL))
    med = hr.approxQuantile("Yes", [0.5], 0.0)[0]
    data = hr.withColumn("Attrition", F.when(F.col("Yes") > med, "Yes").otherwise("No"))
    train, test = md.split_train_test(data)
    stages, _ = md.feature_stages()
    model = Pipeline(stages=[*stages, LogisticRegression(maxIter=50)]).fit(train)
    m = md.score_metrics(model.transform(test))
    assert m["auc"] > 0.8
    p = md.predict(model, test)
    assert p.count() == test.count() and set(p.columns) == {"EmployeeNumber", "predict", "No", "Yes"}


def test_leaderboard_rejects_unknown_order(spark):
    board = spark.createDataFrame([("GLM_1", "GLM", 0.7, 0.5, 0.3, 0.2, 0.4, 0.16, 0.7, 1)],
                                  "model_id string, model_type string, auc double, logloss double, aucpr double, "
                                  "mean_per_class_error double, rmse double, mse double, cv_auc double, "
                                  "position int")
    with pytest.raises(ValueError):
        md.leaderboard_long(board, "rmse")
    long = md.leaderboard_long(board, "logloss")
    assert long.count() == 6 and long.first()["model_id"].startswith("1. ")


def test_split_reaches_every_residue(spark):
    from turnstile.operators import models as md
    ids = spark.range(-20000, 20000).withColumnRenamed("id", "EmployeeNumber")
    test = md.split_train_test(ids)[1]
    assert test.selectExpr("pmod(EmployeeNumber, 20) AS r").distinct().count() == 20
    assert 0.14 < test.count() / 40000 < 0.16
    assert 0 < test.where("EmployeeNumber < 0").count()
    other = md.split_train_test(ids, seed=5)[1]
    assert other.join(test, "EmployeeNumber").count() < 0.3 * test.count()


@pytest.fixture(scope="module")
def trained(spark):
    hr = score_columns(people(spark, SF_SMALL))
    med = hr.approxQuantile("Yes", [0.5], 0.0)[0]
    data = hr.withColumn("Attrition", F.when(F.col("Yes") > med, "Yes").otherwise("No")).drop("Yes", "No")
    train, test = md.split_train_test(data)
    return train, test, md.automl(train, test, folds=3)


def test_ensembles_are_models_of_the_board(spark, trained):
    train, test, result = trained
    board = {r["model_id"]: r for r in result.leaderboard.collect()}
    assert set(board) == set(result.models)
    for name in ("StackedEnsemble_AllModels_AutoML", "StackedEnsemble_BestOfFamily_AutoML"):
        assert board[name]["auc"] > 0.8
        loaded = md.load_model(md.save_model(result.models[name], name, spark))
        here = {r[0]: r["Yes"] for r in md.predict(result.models[name], test).collect()}
        there = {r[0]: r["Yes"] for r in md.predict(loaded, test).collect()}
        assert here.keys() == there.keys() and all(abs(here[k] - there[k]) < 1e-12 for k in here)
    # one base per grid point against one per family
    assert [len(result.models[f"StackedEnsemble_{n}_AutoML"].stages[-1].coefficients) for n in ("AllModels", "BestOfFamily")] == [5, 4]


def logloss(y, p):
    clipped = [min(max(q, 1e-15), 1 - 1e-15) for q in p]
    return -sum(math.log(q if t else 1 - q) for t, q in zip(y, clipped)) / len(y)


def auc(y, p):
    """Share of (positive, negative) pairs in the right order, ties half."""
    pos, neg = [q for t, q in zip(y, p) if t], [q for t, q in zip(y, p) if not t]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


def test_board_metrics_from_scores(trained):
    _, test, result = trained
    for row in result.leaderboard.collect():
        got = md.predict(result.models[row["model_id"]], test, keep=["Attrition"]).collect()
        y, p = [r["Attrition"] == "Yes" for r in got], [r["Yes"] for r in got]
        assert abs(logloss(y, p) - row["logloss"]) < 1e-9
        assert abs(auc(y, p) - row["auc"]) < 1e-9


def test_fold_metrics_average_to_cv_auc(trained):
    train, _, result = trained
    folds = md.fold_metrics(result, train, folds=3).groupBy("model_id").agg(F.avg("auc").alias("auc")).collect()
    board = {r["model_id"]: r["cv_auc"] for r in result.leaderboard.collect()}
    assert len(folds) == 5 and all(abs(board[r["model_id"]] - r["auc"]) < 1e-6 for r in folds)


def test_missing_numbers_score_as_the_median(spark, trained):
    _, test, result = trained
    gaps = test.withColumn("Age", F.lit(None).cast("int")).withColumn("JobRole", F.lit(None).cast("string"))
    for model in result.models.values():
        p = md.predict(model, gaps)
        assert p.count() == test.count() and p.where("Yes IS NULL OR isnan(Yes)").isEmpty()


def test_params_tell_set_from_default(trained):
    rows = {r["param"]: r["is_set"] for r in md.model_params(trained[2].models["GLM_2_AutoML"], "m").collect()}
    assert rows["maxIter"] and rows["regParam"] and not rows["fitIntercept"]


def test_long_board_keeps_places(spark):
    board = spark.createDataFrame(
        [("a", "GLM", 0.9, 0.5, 0.1, 0.1, 0.1, 0.1, 0.9, 0.9, 1), ("b", "GBM", 0.8, 0.3, 0.1, 0.1, 0.1, 0.1, 0.9, 0.9, 2)],
        "model_id string, model_type string, auc double, logloss double, aucpr double, mean_per_class_error double, "
        "rmse double, mse double, train_auc double, cv_auc double, position int")
    got = {(r["model_id"], r["level"]) for r in md.leaderboard_long(board, "logloss").collect()}
    assert got == {("1. a", 1), ("2. b", 2)}
    assert {r["model_id"] for r in md.leaderboard_long(board, "logloss", n_max=1).collect()} == {"1. a"}


def test_grid_is_fixed_by_the_rows_and_models_come_by_id(spark, tmp_path):
    hr = score_columns(people(spark, SF_SMALL)).withColumn("Attrition", F.when(F.col("Yes") > 0.1, "Yes").otherwise("No"))
    train, test = md.split_train_test(hr.drop("Yes", "No", "Yes_no_ot"))
    one = md.GridSearch(train, hidden=[[3], [2]], epochs=[30], folds=2)
    two = md.GridSearch(train.repartition(7), hidden=[[3], [2]], epochs=[30], folds=2)
    board = [tuple(r) for r in one.table.collect()]
    assert [r[:3] for r in board] == [tuple(r)[:3] for r in two.table.collect()] and len(board) == 2
    assert board[0][3] >= board[1][3] > 0.6  # scaled features: the perceptron learns the planted signal
    one.save(board[0][0], str(tmp_path))
    again = md.GridSearch.saved(board[0][0], str(tmp_path))
    assert sorted(map(str, md.predict(one.model(board[0][0]), test).collect())) == sorted(map(str, md.predict(again, test).collect()))
    with pytest.raises(KeyError):
        one.model("dl_grid_model_9")


def test_training_rows_are_spread_by_their_number(spark, monkeypatch):
    from turnstile.operators import models as md
    one = spark.range(1000).withColumnRenamed("id", "EmployeeNumber").coalesce(1)
    assert md.spread(one) is one
    monkeypatch.setattr(md, "TASK_ROWS", 100)
    parts = md.spread(one).withColumn("p", F.spark_partition_id())
    assert parts.select("p").distinct().count() == 10 and parts.count() == 1000
    monkeypatch.setattr(md, "MANY_TASKS", 4)
    assert md.spread(one).rdd.getNumPartitions() == 4


def _planted(spark):
    """Rows with an id, two features, a label that they tell with noise, and a fold."""
    rows = spark.range(600).select("id", (F.col("id") * 37 % 101 / 101).alias("a"), (F.col("id") * 53 % 89 / 89).alias("b"))
    rows = rows.withColumn("label", (F.col("a") + F.col("id") * 71 % 97 / 97 > 1).cast("double"))
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows).withColumn("fold", md.fold_of("id", 3)).cache()


def test_cross_validation_agrees_with_mllib(spark):
    rows, est = _planted(spark), LogisticRegression(maxIter=20)
    grid = [{est.regParam: 0.0}, {est.regParam: 0.5}]
    mllib = CrossValidator(estimator=est, estimatorParamMaps=grid, evaluator=md.ranking("areaUnderROC"), numFolds=3,
                           foldCol="fold", collectSubModels=True).fit(rows)
    mine = md.cross_validate([(est, params) for params in grid], rows, 3, md.ranking("areaUnderROC"))
    for g, (metric, of_folds, model) in enumerate(mine):
        assert abs(metric - mllib.avgMetrics[g]) < 1e-9
        for k in range(3):
            assert abs(of_folds[k].coefficients.toArray() - mllib.subModels[k][g].coefficients.toArray()).max() < 1e-9
        assert abs(model.coefficients.toArray() - est.fit(rows, grid[g]).coefficients.toArray()).max() < 1e-9


def test_folds_need_rows_and_rows_a_fold(spark):
    est, rows = LogisticRegression(maxIter=5), _planted(spark)
    for bad in (rows.where("fold != 1"), rows.withColumn("fold", F.when(F.col("id") > 5, F.col("fold")))):
        with pytest.raises(ValueError):
            md.cross_validate([(est, {})], bad, 3, md.ranking("areaUnderROC"))


def test_trainings_of_all_points_and_folds_run_at_once(spark):
    together = threading.Barrier(8, timeout=60)

    class Waiting:
        def fit(self, rows, params):
            plan = rows._jdf.queryExecution().executedPlan().toString()
            assert "Python" not in plan
            together.wait()  # passes when eight trainings are under way
            return LogisticRegression(maxIter=5).fit(rows)

    found = md.cross_validate([(Waiting(), {}), (Waiting(), {})], _planted(spark), 3, md.ranking("areaUnderROC"), at_once=8)
    assert len(found) == 2 and all(len(of_folds) == 3 and model is not None for _, of_folds, model in found)


def test_side_by_side_keeps_order(spark):
    assert md.side_by_side(lambda n: spark.range(n).count(), [5, 0, 3, 9], 3) == [5, 0, 3, 9] and md.side_by_side(str, []) == []


def test_training_plans_begin_at_written_rows(spark):
    rows = spark.range(1000).repartition(5, "id").sortWithinPartitions("id").withColumn("p", F.spark_partition_id())
    held = md.kept(rows)
    plan = held._jdf.queryExecution().logical().toString()
    assert "LogicalRDD" in plan and "Repartition" not in plan and held.is_cached
    assert held.rdd.glom().collect() == rows.rdd.glom().collect()


def test_auc_from_counts_agrees_with_mllib(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.functions import array_to_vector
    rows = spark.range(3000).select((F.col("id") * 7919 % 613 / 613).alias("p"), (F.col("id") * 31 % 97 > 60).cast("double").alias("label"))
    rows = rows.select(array_to_vector(F.array(1 - F.col("p"), "p")).alias("probability"), "p", "label")
    mllib = BinaryClassificationEvaluator(rawPredictionCol="probability", numBins=0)
    for some in (rows, rows.where("label = 1 OR p > 0.4"), rows.where("label = 0"), rows.where("label = 1"), rows.where("p < 0.001")):
        assert abs(md.ranking("areaUnderROC").evaluate(some) - mllib.evaluate(some)) < 1e-12
    scores = [(r["p"], r["label"]) for r in rows.collect()]
    assert abs(md.ranking("areaUnderROC").evaluate(rows) - auc([t for _, t in scores], [q for q, _ in scores])) < 1e-12


def test_a_perceptron_that_ended_stands_for_smaller_limits(spark, monkeypatch):
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    rows, est = _planted(spark), MultilayerPerceptronClassifier(layers=[2, 2, 2], seed=3, tol=1e-3)
    grid = [{est.maxIter: n} for n in (2, 400, 600)]
    fit, limits = MultilayerPerceptronClassifier._fit, []

    def noted(self, dataset):
        limits.append(self.getMaxIter())
        return fit(self, dataset)

    monkeypatch.setattr(MultilayerPerceptronClassifier, "_fit", noted)
    mine = md.cross_validate([(est, params) for params in grid], rows, 3, md.ranking("areaUnderROC"), refit=False)
    assert sorted(limits) == [2] * 3 + [600] * 3  # 400 is not reached
    for (metric, of_folds, _), params in zip(mine, grid):
        alone = [est.fit(rows.where(F.col("fold") != k), params) for k in range(3)]
        assert [m.weights.toArray().tolist() for m in of_folds] == [m.weights.toArray().tolist() for m in alone]
        assert [m.getMaxIter() for m in of_folds] == [params[est.maxIter]] * 3
        scores = [md.ranking("areaUnderROC").evaluate(m.transform(rows.where(F.col("fold") == k))) for k, m in enumerate(alone)]
        assert abs(metric - sum(scores) / 3) < 1e-12


def test_areas_of_many_keys_come_from_one_pass(spark):
    rows = spark.range(4000).select((F.col("id") % 5).cast("int").alias("key"), (F.col("id") * 7919 % 613 / 613).alias("score"),
                                    (F.col("id") * 31 % 97 > 60).cast("double").alias("label"))
    rows = rows.where("key != 3 OR label = 1").where("key != 4").repartition(7)
    found = md.areas_under_roc(rows, 5)
    for k in range(3):
        some = rows.where(F.col("key") == k).collect()
        assert abs(found[k] - auc([r["label"] for r in some], [r["score"] for r in some])) < 1e-12
    assert found[3:] == [1.0, 0.5]  # one class, no rows


def test_fold_areas_agree_with_the_evaluator(spark):
    rows, est, evaluator = _planted(spark), LogisticRegression(maxIter=20), md.ranking("areaUnderROC")
    fits = md.cross_validate([(est, {est.regParam: v}) for v in (0.0, 0.5)], rows, 3, None, refit=False)
    assert [metric for metric, _, _ in fits] == [None, None]
    held_out = md._out_of_fold(rows, [[(str(i), of_folds[k]) for i, (_, of_folds, _) in enumerate(fits)] for k in range(3)])
    assert held_out.count() == rows.count()
    for (_, of_folds, _), areas in zip(fits, md.fold_areas(held_out, 2, 3)):
        assert areas == [evaluator.evaluate(m.transform(rows.where(F.col("fold") == k))) for k, m in enumerate(of_folds)]


def test_the_board_is_scored_in_one_pass(spark, trained, monkeypatch):
    train, test, _ = trained
    seen, alone = [], md.AreaUnderROC._evaluate
    monkeypatch.setattr(md.AreaUnderROC, "_evaluate", lambda self, rows: seen.append(1) or alone(self, rows))
    monkeypatch.setattr(md, "families", lambda n, seed: [("GLM", est := LogisticRegression(maxIter=5), [{est.regParam: v} for v in (0.0, 0.1)])])
    board = md.automl(train, test, folds=2).leaderboard
    assert len(seen) == board.count() == 3  # on the leaderboard's frame alone: not per fold, nor again on the training rows
    assert board.where("train_auc IS NULL").isEmpty() and board.where("cv_auc IS NOT NULL").count() == 2
