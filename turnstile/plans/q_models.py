"""Queries for modelling (L1-L10), model storage (S5-S6) and local
explanations (X1-X8).  Model-based outputs have no SQL oracle (rows-only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators import explain as xp
from ..operators import models as md
from ..session import scratch_path
from ..sources.people import people
from .registry import query
from .sql import with_ctes

_CACHE: dict[tuple, object] = {}


def _key(spark, sf, what):
    return (spark.sparkContext.applicationId, sf, what)


def splits(spark, sf):
    return md.split_train_test(people(spark, sf))


def automl_result(spark, sf) -> md.AutoMLResult:
    """Train once per session and data folder; later queries reuse it."""
    k = _key(spark, sf, "automl")
    if k not in _CACHE:
        train, test = splits(spark, sf)
        _CACHE[k] = md.automl(train, test, folds=5)
    return _CACHE[k]


# DuckDB's form of the split bucket
_BUCKET = f"""floor(CAST('0x' || substr(md5('{md.SPLIT_SEED}:' || CAST(EmployeeNumber AS VARCHAR)), 1, 8) AS BIGINT) * 100 / 4294967296.0)"""


@query("l01_split", with_ctes(
    f"""SELECT EmployeeNumber, CASE WHEN {_BUCKET} < 85 THEN 'train' ELSE 'test' END AS split FROM hr"""))
def l01(spark, sf):
    hr = people(spark, sf).select("EmployeeNumber")
    b = md.split_bucket("EmployeeNumber")
    return hr.select("EmployeeNumber", F.when(b < 85, "train").otherwise("test").alias("split"))


@query("l01_split_three", with_ctes(
    f"""SELECT EmployeeNumber, CASE WHEN {_BUCKET} < 70 THEN 'train' WHEN {_BUCKET} < 85 THEN 'valid' ELSE 'test' END AS split FROM hr"""))
def l01_three(spark, sf):
    parts = md.split_three(people(spark, sf).select("EmployeeNumber"))
    named = [p.withColumn("split", F.lit(n)) for p, n in zip(parts, ("train", "valid", "test"))]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query("l02_automl_leaderboard")
def l02(spark, sf):
    return automl_result(spark, sf).leaderboard


@query("l03_model_families")
def l03(spark, sf):
    return automl_result(spark, sf).leaderboard.select("model_type").distinct()


@query("l04_stacked_ensemble")
def l04(spark, sf):
    return automl_result(spark, sf).leaderboard.where(F.col("model_type") == "StackedEnsemble")


@query("l05_leader")
def l05(spark, sf):
    return automl_result(spark, sf).leaderboard.where(F.col("position") == 1)


@query("l06_leaderboard_long")
def l06(spark, sf):
    return md.leaderboard_long(automl_result(spark, sf).leaderboard, "auc")


@query("l06_leaderboard_long_logloss")
def l06b(spark, sf):
    return md.leaderboard_long(automl_result(spark, sf).leaderboard, "logloss")


def leader(spark, sf):
    """Id and model in the first place of the leaderboard (an ensemble too)."""
    r = automl_result(spark, sf)
    mid = md.model_by_position(r.leaderboard, 1)
    return mid, r.models[mid]


def max_f1_threshold(spark, sf, model) -> float:
    """Class threshold = the one maximising F1 on the training predictions
    (the label rule of the source's predictions)."""
    train, _ = splits(spark, sf)
    p = md.predict(model, md.spread(train), keep=["Attrition"])
    return ev.max_metric_row(ev.metrics_by_threshold(p), "f1").first()["threshold"]


@query("l07_predict")
def l07(spark, sf):
    _, model = leader(spark, sf)
    _, test = splits(spark, sf)
    return md.predict(model, test, threshold=max_f1_threshold(spark, sf, model))


def grid(spark, sf) -> md.GridSearch:
    """The perceptron grid, trained once per session and data folder."""
    k = _key(spark, sf, "grid")
    if k not in _CACHE:
        train, _ = splits(spark, sf)
        _CACHE[k] = md.GridSearch(train, hidden=[[10, 10, 10], [50, 20, 10], [20, 20, 20]], epochs=[10, 50, 100])
    return _CACHE[k]


@query("l08_grid_search")
def l08(spark, sf):
    return grid(spark, sf).table


@query("l08_grid_model_by_id")
def l08_model(spark, sf):
    """The test split scored by the grid's best model, stored and loaded by its id."""
    found = grid(spark, sf)
    best = found.table.first()["model_id"]
    folder = scratch_path(spark, "grid")
    found.save(best, folder)
    _, test = splits(spark, sf)
    return md.predict(md.GridSearch.saved(best, folder), test).withColumn("model_id", F.lit(best))


@query("l09_cross_validation_metrics")
def l09(spark, sf):
    return automl_result(spark, sf).leaderboard.select("model_id", "train_auc", F.col("auc").alias("valid_auc"), "cv_auc")


@query("l09_fold_metrics")
def l09_folds(spark, sf):
    train, _ = splits(spark, sf)
    return md.fold_metrics(automl_result(spark, sf), train, folds=5)


@query("l10_model_params")
def l10(spark, sf):
    mid, model = leader(spark, sf)
    return md.model_params(model, mid)


@query("s05_model_save_load")
def s05(spark, sf):
    mid, model = leader(spark, sf)
    path = md.save_model(model, mid, spark)
    _, test = splits(spark, sf)
    return md.predict(md.load_model(path), test)


@query("s06_model_registry")
def s06(spark, sf):
    """Registry of saved models -> load each -> score the test split ->
    ROC points per model (E8 on stored models)."""
    r = automl_result(spark, sf)
    rows = md.side_by_side(lambda mid: (mid, md.save_model(r.models[mid], mid, spark), r.types[mid]), list(r.models))
    registry = spark.createDataFrame(rows, "model_id string, path string, family string")
    _, test = splits(spark, sf)
    scored_parts = []
    stored = registry.collect()  # one row per saved model
    for row, model in zip(stored, md.side_by_side(lambda row: md.load_model(row["path"]), stored)):
        p = md.predict(model, test, keep=["Attrition"])
        scored_parts.append(p.select(F.lit(row["model_id"]).alias("model_id"), "Attrition",
                                     F.col("Yes").alias("score")))
    allp = scored_parts[0]
    for p in scored_parts[1:]:
        allp = allp.unionByName(p)
    m = ev.metrics_by_threshold(allp, score="score", by=["model_id"])
    return m.select("model_id", "threshold", "fpr", "tpr")


# ---------------------------------------------------------------- X: explanations

X_NUMERIC = md.NUMERIC
X_CATEGORICAL = md.CATEGORICAL
X_FEATURES = X_CATEGORICAL + X_NUMERIC
N_CASES = 20


def explainer(spark, sf) -> DataFrame:
    train, _ = splits(spark, sf)
    return xp.fit_explainer(train.select(*X_FEATURES), X_NUMERIC, X_CATEGORICAL)


def explanation(spark, sf) -> DataFrame:
    k = _key(spark, sf, "explanation")
    if k not in _CACHE:
        _, test = splits(spark, sf)
        # the first N_CASES test employees by id are explained (the feature)
        head = test.orderBy("EmployeeNumber").limit(N_CASES).select("EmployeeNumber", *X_FEATURES)
        from ..operators.ordered import row_number
        cases = row_number(head, ["EmployeeNumber"], out="case", num_partitions=1)
        ex = xp.explain(cases, explainer(spark, sf), X_FEATURES, leader(spark, sf)[1],
                        n_permutations=5000, n_features=8, kernel_width=1.0)
        _CACHE[k] = ex.checkpoint()  # cut the lineage: later X queries reuse it
    return _CACHE[k]


@query("x01_explainer_fit")
def x01(spark, sf):
    return explainer(spark, sf)


@query("x02_explain_one_case")
def x02(spark, sf):
    return explanation(spark, sf).where(F.col("case") == 5)


@query("x03_explain_cases")
def x03(spark, sf):
    return explanation(spark, sf)


@query("x04_fit_quality")
def x04(spark, sf):
    from ..operators.profile import histogram
    per_case = explanation(spark, sf).select("case", "model_r2").distinct()
    return histogram(per_case, ["model_r2"])


@query("x05_feature_bars")
def x05(spark, sf):
    return xp.feature_bars(explanation(spark, sf).where(F.col("case") == 1))


@query("x06_tile_order")
def x06(spark, sf):
    return xp.tile_order(explanation(spark, sf))


@query("x07_mean_weight")
def x07(spark, sf):
    return xp.mean_weight(explanation(spark, sf))


@query("x08_filter_cases")
def x08(spark, sf):
    return explanation(spark, sf).where(F.col("case").isin(list(range(1, 7))))
