"""The recipe estimator: lambdas, roles, pipelines, storage, and categories with very many levels."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from turnstile.operators import features as fe
from turnstile.operators import recipe as rc


def transformed(x, lam):
    y = np.empty_like(x)
    up, down = x >= 0, x < 0
    y[up] = np.log1p(x[up]) if abs(lam) < 1e-3 else ((x[up] + 1) ** lam - 1) / lam
    y[down] = -np.log1p(-x[down]) if abs(lam - 2) < 1e-3 else -((1 - x[down]) ** (2 - lam) - 1) / (2 - lam)
    return y


def likelihood(x, lam):
    return -0.5 * len(x) * np.log(transformed(x, lam).var()) + (lam - 1) * (np.sign(x) * np.log1p(abs(x))).sum()


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(0)
    n = 3000
    cols = {"expo": rng.exponential(3, n), "both": rng.normal(0, 1, n) ** 3, "plain": rng.normal(0, 1, n), "heavy": rng.lognormal(0, 1, n)}
    rows = [(i, *(float(cols[c][i]) for c in cols), 1.0, float(i % 3)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, expo double, both double, plain double, heavy double, same double, few double"), cols


def test_lambdas_in_lockstep_are_the_peaks(skewed):
    df, cols = skewed
    found = rc.yj_lambdas(df, [*cols, "same", "few"])
    assert found.pop("same") is None and found.pop("few") is None  # too few values
    on_grid = rc.yj_lambdas(df, list(cols), grain=0.01)
    grid = np.round(np.arange(-500, 501) / 100, 2)
    for c, x in cols.items():
        best = max(grid, key=lambda lam: likelihood(x, lam))
        assert on_grid[c] == pytest.approx(best)
        assert abs(found[c] - best) <= 0.01 and likelihood(x, found[c]) >= likelihood(x, best) - 1e-6


def test_passes_do_not_grow_with_columns(skewed, monkeypatch):
    df, cols = skewed
    jobs = []
    first = type(df).first
    monkeypatch.setattr(type(df), "first", lambda self: (jobs.append(1), first(self))[1])
    rc.yj_lambdas(df, ["expo"])
    one = len(jobs)
    rc.yj_lambdas(df, list(cols))
    assert len(jobs) - one <= one + 1


def test_lambda_at_a_limit_is_not_used(spark):
    df = spark.createDataFrame([(float(i) ** 40,) for i in range(1, 60)], "x double")
    assert rc.yj_lambdas(df, ["x"], limits=(0.5, 5.0)) == {"x": None}


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    rows = [(i, ["No", "Yes"][int(rng.integers(0, 2))], float(rng.exponential(2)), int(rng.integers(1, 4)), 7, "s",
             ["a b", "c", "1x", None][int(rng.integers(0, 4))]) for i in range(500)]
    return spark.createDataFrame(rows, "id long, target string, pay double, grade int, same int, word string, kind string")


def steps():
    return (rc.Recipe(target="target", idCol="id").step_zv().step_yeo_johnson(exclude=["grade"]).step_num2factor(["grade"])
            .step_center().step_scale().step_dummy())


def test_recipe_against_numpy(table):
    train, test = table.where("id % 5 > 0"), table.where("id % 5 = 0")
    model = steps().fit(train)
    baked = model.transform(test)
    assert baked.columns == ["id", "pay", "target_Yes", "grade_X2", "grade_X3", "kind_a.b", "kind_c"]
    x = np.array([r.pay for r in train.collect()])
    lam = rc.yj_lambdas(train, ["pay"])["pay"]
    fit = transformed(x, lam)
    for r, t in zip(baked.orderBy("id").collect(), test.orderBy("id").collect()):
        assert r.pay == pytest.approx((transformed(np.array([t.pay]), lam)[0] - fit.mean()) / fit.std(ddof=1))
        assert (r.target_Yes, r.grade_X2, r.grade_X3) == (int(t.target == "Yes"), int(t.grade == 2), int(t.grade == 3))
        assert (r["kind_a.b"], r.kind_c) == ((None, None) if t.kind is None else (int(t.kind == "a b"), int(t.kind == "c")))


def test_tidy_lists_steps_and_terms(spark, table):
    model = steps().fit(table)
    assert [r.type for r in model.tidy(spark).collect()] == ["zv", "YeoJohnson", "num2factor", "center", "scale", "dummy"]
    assert {r.terms for r in model.tidy(spark, 1).collect()} == {"same", "word"}
    assert [r.terms for r in model.tidy(spark, 2).collect()] == ["pay"]
    assert {(r.terms, r.position, r.level) for r in model.tidy(spark, 6).collect()} >= {("target", 1, "No"), ("kind", 1, "1x")}


def test_recipe_in_a_stored_pipeline(spark, table, tmp_path):
    binned = (rc.Recipe(target="target", idCol="id").step_zv().step_discretize().step_num2factor(["grade"]).step_dummy(one_hot=True))
    for recipe in (steps(), binned):
        model = Pipeline(stages=[recipe]).fit(table)
        path = str(tmp_path / recipe.uid)
        model.write().overwrite().save(path)
        again = PipelineModel.load(path)
        one, two = model.transform(table), again.transform(table)
        assert one.columns == two.columns and sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
        assert again.stages[0].tidy(spark).count() == len(recipe.getOrDefault(recipe.steps))
    recipe.write().overwrite().save(str(tmp_path / "unfitted"))
    assert rc.Recipe.load(str(tmp_path / "unfitted")).fit(table).transform(table).columns == one.columns


def test_indicators_of_very_many_levels(spark, tmp_path):
    n = 100_000
    df = spark.range(n).select("id", F.format_string("u%06d", F.col("id")).alias("user"),
                               F.when(F.col("id") % 3 == 0, "x").when(F.col("id") % 3 == 1, "y").alias("kind"),
                               (F.col("id") % 2).cast("double").alias("label"))
    model = rc.Recipe(target="label", idCol="id").step_indicators(["user", "kind"], output="features").fit(df)
    path = str(tmp_path / "many")
    model.write().save(path)
    model = rc.RecipeModel.load(path)
    out = model.transform(df)
    assert out.columns == ["id", "label", "features"]
    names = model.feature_names(1)
    assert names.count() == n - 1 + 1
    row = out.where("id = 5").first().features
    assert row.size == n and row.numNonzeros() == 1  # its kind is null
    got = {(r.id, r.term) for r in rc.vector_entries(out, "id", "features", names).where("id < 5").collect()}
    assert got == {(1, "user_u000001"), (2, "user_u000002"), (3, "user_u000003"), (4, "user_u000004"), (1, "kind_y"), (4, "kind_y")}
    unseen = model.transform(spark.createDataFrame([(1, "nobody", "y", 0.0)], df.schema)).first().features
    assert unseen.size == n and list(unseen.indices) == [n - 1]
    LogisticRegression(maxIter=1).fit(out.where("id < 2000"))


def test_indicators_agree_with_dummies(spark, table):
    for one_hot in (False, True):
        dense = rc.Recipe(target="target", idCol="id").step_num2factor(["grade"]).step_dummy(["kind", "grade"], one_hot=one_hot).fit(table)
        sparse = rc.Recipe(target="target", idCol="id").step_num2factor(["grade"]).step_indicators(
            ["kind", "grade"], output="v", one_hot=one_hot).fit(table)
        names = [r.name for r in sparse.feature_names(2).orderBy("place").collect()]
        assert set(names) == set(dense.transform(table).columns) & set(names) and len(names) == (6 if one_hot else 4)
        wide = {r.id: [r[c] or 0 for c in names] for r in dense.transform(table).collect()}
        assert {r.id: r.v for r in sparse.transform(table).select("id", vector_to_array("v").alias("v")).collect()} == wide


def test_recipe_of_awkward_tables(spark):
    nulls = spark.createDataFrame([(1, None, None, "a"), (2, None, None, "a")], "id long, x double, k string, target string")
    baked = steps().fit(nulls).transform(nulls)
    assert baked.columns == ["id"] and baked.count() == 2
    one = rc.Recipe(target="target", idCol="id").step_indicators(["k"]).fit(nulls).transform(nulls)
    assert one.select(vector_to_array("indicators").alias("v")).first().v == []
    assert fe.zero_variance(nulls, ["x", "k"]) == ["x", "k"]
