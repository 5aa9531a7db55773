"""Explanations against a direct numpy solve; spread of the permutations; fitted pipelines."""

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import functions as F

from turnstile.operators import explain as xp

FEATURES = ["city", "age", "pay", "tenure"]


def _table(spark):
    return spark.range(400).select(
        F.col("id"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 3 + 1).cast("int")).alias("city"),
        (F.col("id") * 37 % 41).alias("age"), (F.col("id") * 11 % 97).cast("double").alias("pay"),
        (F.col("id") % 7).alias("tenure"))


def _score(df):
    return 1 / (1 + F.exp(-(F.col("age") / 10 - 2 + F.when(F.col("city") == "b", 1.5).otherwise(0.0))))


def _cases(table):
    return table.where("id in (3, 50, 201)").select((F.col("id") + 0).alias("case"), *FEATURES)


def test_weights_match_a_direct_solve(spark):
    table = _table(spark)
    explainer = xp.fit_explainer(table, ["age", "pay", "tenure"], ["city"])
    cases = _cases(table)
    got = xp.explain(cases, explainer, FEATURES, _score, n_permutations=1200, n_features=2, kernel_width=1.0).toPandas()
    assert got.groupby("case").size().tolist() == [2, 2, 2]
    perms = xp.permutations(cases, explainer.collect(), FEATURES, 1200, 1234)
    rows = perms.withColumn("_p", _score(perms)).toPandas()
    for case, part in rows.groupby("case"):
        assert len(part) == 1200
        own = part[part.perm == 1]["_p"].iloc[0]
        z = part[[f"z{j}" for j in range(4)]].to_numpy(float)
        y = part["_p"].to_numpy() if own >= 0.5 else 1 - part["_p"].to_numpy()
        w = np.sqrt(np.exp(-(1 - z.mean(1)) ** 2))

        def ridge(idx):
            a = np.hstack([np.ones((len(z), 1)), z[:, idx]])
            lhs = a.T @ (a * w[:, None])
            lhs[1:, 1:] += xp.RIDGE_LAMBDA * w.sum() * np.eye(len(idx))
            return np.linalg.solve(lhs, a.T @ (w * y))

        full = ridge([0, 1, 2, 3])[1:]
        chosen = sorted(np.argsort(-abs(full))[:2])
        beta = ridge(chosen)
        mine = got[got.case == case].set_index("feature")
        assert set(mine.index) == {FEATURES[i] for i in chosen}
        for i, weight in zip(chosen, beta[1:]):
            assert abs(mine.loc[FEATURES[i], "feature_weight"] - weight) < 1e-8
        assert abs(mine["model_intercept"].iloc[0] - beta[0]) < 1e-8
        assert abs(mine["label_prob"].iloc[0] - max(own, 1 - own)) < 1e-12


def test_one_case_is_spread_over_tasks(spark):
    table = _table(spark)
    explainer = xp.fit_explainer(table, ["age", "pay", "tenure"], ["city"]).collect()
    one = _cases(table).where("case = 50")
    perms = xp.permutations(one, explainer, FEATURES, 5000, 1)
    assert perms.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert perms.select("perm").distinct().count() == perms.count() == 5000


def test_fitted_pipeline_is_explained(spark):
    table = _table(spark).withColumn("label", (F.col("age") > 20).cast("double"))
    model = Pipeline(stages=[StringIndexer(inputCol="city", outputCol="city_i", handleInvalid="keep"),
                             VectorAssembler(inputCols=["city_i", "age", "pay", "tenure"], outputCol="features"),
                             LogisticRegression(regParam=0.01)]).fit(table)
    explainer = xp.fit_explainer(table, ["age", "pay", "tenure"], ["city"])
    got = xp.explain(_cases(table), explainer, FEATURES, model, n_permutations=1000, n_features=1).collect()
    assert len(got) == 3 and {r["feature"] for r in got} == {"age"}
    scored = {r["case"]: r["p"] for r in xp.positive_score(_cases(table), model, "p").collect()}
    for r in got:
        assert abs(r["label_prob"] - max(scored[r["case"]], 1 - scored[r["case"]])) < 1e-12
