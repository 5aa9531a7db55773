"""Queries for feature preparation (M2-M10) and the correlation / profiling
domain operators (D8-D15)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import correlation as cr
from ..operators import features as fe
from ..operators import profile as pf
from ..operators import recipe as rc
from ..operators.joins import stage_table
from ..operators.ordered import lookup_row_number
from ..session import scratch_path
from ..sources.people import people
from ..sources.tables import read_table
from .q_relational import CHARACTER_COLUMNS, HR_ALL, NUMERIC_ALL, NUMERIC_FEATURES, _long_sql, skew_sql
from .registry import query, set_sql
from .sql import with_ctes

DISCRETE_NUMERIC = ["JobLevel", "StockOptionLevel"]  # numbers that are categories


# ---------------------------------------------------------------- M2-M10

@query("m02_zero_variance", with_ctes(" UNION ALL ".join(
    f"SELECT '{c}' AS variable FROM hr HAVING coalesce(min({c}) = max({c}), true)" for c in HR_ALL)))
def m02(spark, sf):
    hr = people(spark, sf)
    dropped = fe.zero_variance(hr, HR_ALL)  # one aggregate pass; names only
    return spark.createDataFrame([(c,) for c in dropped], "variable string")


_SKEW_FEATURES = [c for c in NUMERIC_FEATURES if c not in DISCRETE_NUMERIC]


@query("m03_skewed_columns", with_ctes(
    f"SELECT variable, skewness FROM ({skew_sql(_SKEW_FEATURES)}) s WHERE skewness >= 0.8"))
def m03(spark, sf):
    # rounding first, as the oracle does, so the cutoff sees the same value
    t = pf.skewness_table(people(spark, sf), _SKEW_FEATURES).withColumn("skewness", F.round("skewness", 6) + 0.0)
    return t.where(F.col("skewness") >= fe.SKEW_CUTOFF)


YJ_GRID = [-5.0 + 0.5 * i for i in range(21)]


def _yj_sql(source: str, col: str) -> str:
    grid = ", ".join(f"({lam})" for lam in YJ_GRID)
    x = f"CAST({col} AS DOUBLE)"
    pos = f"CASE WHEN abs(l) < 0.001 THEN ln({x} + 1) ELSE (pow({x} + 1, l) - 1) / l END"
    neg = f"CASE WHEN abs(l - 2) < 0.001 THEN -ln(1 - {x}) ELSE -(pow(1 - {x}, 2 - l) - 1) / (2 - l) END"
    return f"""SELECT '{col}' AS variable, l AS lambda,
  round(-0.5 * count({x}) * ln(var_pop(CASE WHEN {x} >= 0 THEN {pos} ELSE {neg} END))
        + (l - 1.0) * sum(sign({x}) * ln(abs({x}) + 1)), 4) AS loglik
FROM {source}, (VALUES {grid}) g(l) GROUP BY l"""


@query("m04_yeo_johnson_loglik", with_ctes(
    _yj_sql("hr", "MonthlyIncome") + " UNION ALL " + _yj_sql("events", "value")))
def m04(spark, sf):
    a = fe.yj_loglik_table(people(spark, sf), ["MonthlyIncome"], YJ_GRID)
    b = fe.yj_loglik_table(read_table(spark, sf, "events"), ["value"], YJ_GRID)
    return a.unionByName(b).withColumn("loglik", F.round("loglik", 4))


#: Lambdas of the recipes lie on this grid, which SQL can search.
YJ_GRAIN = 0.01


def _yj_value_sql(x: str, lam: str) -> str:
    """Yeo-Johnson transform of ``x``; null lambda: ``x`` as it is."""
    return f"""CASE WHEN {lam} IS NULL THEN {x} WHEN {x} >= 0 THEN
  CASE WHEN abs({lam}) < 0.001 THEN ln(greatest({x}, 0) + 1) ELSE (pow(greatest({x}, 0) + 1, {lam}) - 1) / {lam} END
  ELSE CASE WHEN abs({lam} - 2) < 0.001 THEN -ln(1 - least({x}, 0)) ELSE -(pow(1 - least({x}, 0), 2 - {lam}) - 1) / (2 - {lam}) END END"""


def _yj_lambda_ctes(col: str, source: str, name: str) -> list[tuple[str, str]]:
    """The grid's lambda of greatest likelihood: a coarse grid, then the grain around its best (one peak)."""
    x = f"CAST({col} AS DOUBLE)"

    def scan(grid: str) -> str:
        return f"""SELECT arg_max(l, ll) AS lam FROM (
  SELECT l, -0.5 * count({x}) * ln(var_pop({_yj_value_sql(x, "l")})) + (l - 1.0) * sum(sign({x}) * ln(abs({x}) + 1)) AS ll
  FROM {source}, ({grid}) g GROUP BY l)"""

    return [(f"{name}_coarse", scan("SELECT unnest(range(-10, 11)) / 2.0 AS l")),
            (name, scan(f"SELECT round(lam + unnest(range(-50, 51)) * {YJ_GRAIN}, 2) AS l FROM {name}_coarse"))]


@query("m04_yeo_johnson_transform", with_ctes(
    f"SELECT event_id, CAST(lam AS DOUBLE) AS lambda, round({_yj_value_sql('value', 'lam')}, 6) AS value_yj FROM events, lam",
    *_yj_lambda_ctes("value", "events", "lam")))
def m04_apply(spark, sf):
    """The lambda of greatest likelihood, then the transform."""
    ev = read_table(spark, sf, "events").select("event_id", "value")
    lam = rc.yj_lambdas(ev, ["value"], grain=YJ_GRAIN)["value"]
    return ev.select("event_id", F.lit(lam).alias("lambda"), F.round(fe.yeo_johnson(F.col("value"), lam), 6).alias("value_yj"))


@query("m05_num_to_factor", with_ctes(" UNION ALL ".join(
    f"SELECT '{c}' AS variable, level, CAST(dense_rank() OVER (ORDER BY level) AS INT) AS code FROM "
    f"(SELECT DISTINCT CAST({c} AS VARCHAR) AS level FROM hr) d" for c in DISCRETE_NUMERIC)))
def m05(spark, sf):
    from ..functions.categories import sorted_levels
    hr = people(spark, sf).withColumns({c: F.col(c).cast("string") for c in DISCRETE_NUMERIC})
    return sorted_levels(hr, DISCRETE_NUMERIC).withColumnRenamed("column", "variable")


_CS = ["Age", "MonthlyIncome", "YearsAtCompany"]


@query("m06_center", with_ctes(
    "SELECT EmployeeNumber, " + ", ".join(f"round({c} - avg({c}) OVER (), 6) AS {c}" for c in _CS) + " FROM hr"))
def m06(spark, sf):
    hr = people(spark, sf).select("EmployeeNumber", *_CS)
    means, _ = fe.center_scale_params(hr, _CS)
    return hr.withColumns({c: F.round(F.col(c) - F.lit(means[c]), 6) for c in _CS})


@query("m07_scale", with_ctes(
    "SELECT EmployeeNumber, " + ", ".join(
        f"round(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER (), 6) AS {c}" for c in _CS) + " FROM hr"))
def m07(spark, sf):
    hr = people(spark, sf).select("EmployeeNumber", *_CS)
    means, sds = fe.center_scale_params(hr, _CS)
    return fe.center_scale(hr, means, sds).withColumns({c: F.round(c, 6) for c in _CS})


@query("m08_dummies", with_ctes(
    """SELECT EmployeeNumber,
  CAST(BusinessTravel = 'Travel_Frequently' AS INT) AS BusinessTravel_Travel_Frequently,
  CAST(BusinessTravel = 'Travel_Rarely' AS INT) AS BusinessTravel_Travel_Rarely,
  CAST(OverTime = 'Yes' AS INT) AS OverTime_Yes FROM hr"""))
def m08(spark, sf):
    hr = people(spark, sf).select("EmployeeNumber", "BusinessTravel", "OverTime")
    return fe.dummies(hr, fe.category_levels(hr, ["BusinessTravel", "OverTime"]))


@query("m08_one_hot", with_ctes(
    "SELECT EmployeeNumber, " + ", ".join(
        f"CAST(Department = '{d}' AS INT) AS \"Department_{d.replace(' ', '.')}\""
        for d in ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]) + " FROM hr"))
def m08_one_hot(spark, sf):
    hr = people(spark, sf).select("EmployeeNumber", "Department")
    return fe.dummies(hr, fe.category_levels(hr, ["Department"]), one_hot=True)


_BIN = ["Age", "MonthlyIncome", "YearsAtCompany"]


def _cuts_sql(columns, source="hr") -> str:
    long = _long_sql(columns, source, value="CAST({c} AS DOUBLE)")
    return f"""SELECT variable, CAST(position AS INT) AS position,
  CASE WHEN position = 1 THEN '-inf'::DOUBLE WHEN position = m THEN 'inf'::DOUBLE ELSE cut END AS cut FROM (
  SELECT variable, cut, row_number() OVER (PARTITION BY variable ORDER BY cut) AS position,
    count(*) OVER (PARTITION BY variable) AS m FROM (
    SELECT DISTINCT variable, unnest([quantile_cont(value, 0.0), quantile_cont(value, 0.25),
      quantile_cont(value, 0.5), quantile_cont(value, 0.75), quantile_cont(value, 1.0)]) AS cut
    FROM ({long}) l GROUP BY variable) u) r"""


@query("m10_fitted_cuts", with_ctes(_cuts_sql(_BIN)))
def m10(spark, sf):
    return fe.discretize_cuts(people(spark, sf), _BIN)


def _binned_sql(columns, source="hr", ids="EmployeeNumber") -> str:
    long = _long_sql(columns, source, value="CAST({c} AS DOUBLE)", ids=f"{ids} AS id, ")
    return f"""SELECT n.id, n.variable, 'bin' || CAST(1 + count(i.cut) AS VARCHAR) AS level
FROM ({long}) n LEFT JOIN (SELECT variable, cut FROM cuts WHERE cut > '-inf'::DOUBLE AND cut < 'inf'::DOUBLE) i
  ON i.variable = n.variable AND i.cut < n.value GROUP BY n.id, n.variable"""


@query("m09_discretize", with_ctes(
    "SELECT id AS EmployeeNumber, " + ", ".join(
        f"max(CASE WHEN variable = '{c}' THEN level END) AS {c}" for c in _BIN) + " FROM binned GROUP BY id",
    ("cuts", _cuts_sql(_BIN)), ("binned", _binned_sql(_BIN))))
def m09(spark, sf):
    hr = people(spark, sf).select("EmployeeNumber", *_BIN)
    return fe.discretize(hr, fe.discretize_cuts(hr, _BIN))


#: Skewness from which the recipe transforms a column of the people view (its most skewed one has 0.3).
RECIPE_SKEW = 0.25
_ZERO_VARIANCE = ["EmployeeCount", "StandardHours", "Over18"]
_NUMBERS = [c for c in NUMERIC_FEATURES if c not in DISCRETE_NUMERIC]
_FACTORS = ["Attrition", "Department", "JobRole", "OverTime", "BusinessTravel", "MaritalStatus", "EducationField", *DISCRETE_NUMERIC]
# a level as part of a column's name
_NAME_SQL = "regexp_replace(CASE WHEN regexp_matches(level, '^[0-9]') THEN 'X' ELSE '' END || level, '[^A-Za-z0-9._]', '.', 'g')"


def recipe_steps(one_hot: bool = False) -> rc.Recipe:
    """The machine-readable preparation: zero variance, Yeo-Johnson of skewed columns, numbers that are
    categories, centre, scale, dummies (the target among them)."""
    return (rc.Recipe(target="Attrition", idCol="EmployeeNumber").step_zv()
            .step_yeo_johnson(skew=RECIPE_SKEW, exclude=DISCRETE_NUMERIC, grain=YJ_GRAIN)
            .step_num2factor(DISCRETE_NUMERIC).step_center().step_scale().step_dummy(one_hot=one_hot))


def _prepared(spark, sf) -> tuple[rc.RecipeModel, DataFrame]:
    from ..operators.models import split_train_test
    train, test = split_train_test(people(spark, sf))
    return recipe_steps().fit(train), test


def _long_form(baked: DataFrame) -> DataFrame:
    """(EmployeeNumber, term, value): the baked table's columns as rows, rounded."""
    terms = [c for c in baked.columns if c != "EmployeeNumber"]
    wide = baked.select("EmployeeNumber", *[F.col(f"`{c}`").cast("double").alias(c) for c in terms])
    return wide.unpivot(["EmployeeNumber"], [F.col(f"`{c}`") for c in terms], "term", "value").withColumn("value", F.round("value", 6))


def _lam_of(c: str) -> str:
    return f"(SELECT lam FROM used WHERE variable = '{c}')"


def _recipe_ctes() -> list[tuple[str, str]]:
    """train, test, each number's lambda, and the ones that are used."""
    from .q_models import _BUCKET
    lams = " UNION ALL ".join(f"SELECT '{c}' AS variable, CAST(lam AS DOUBLE) AS lam FROM l_{c}" for c in _NUMBERS)
    return [("train", f"SELECT * FROM hr WHERE {_BUCKET} < 85"), ("test", f"SELECT * FROM hr WHERE {_BUCKET} >= 85"),
            *[x for c in _NUMBERS for x in _yj_lambda_ctes(c, "train", f"l_{c}")],
            ("used", f"""SELECT s.variable, CASE WHEN skewness >= {RECIPE_SKEW} THEN lam END AS lam
  FROM ({skew_sql(_NUMBERS, "train")}) s JOIN ({lams}) l ON l.variable = s.variable""")]


def _recipe_sql() -> str:
    numbers, fits = [], []
    for c in _NUMBERS:
        x = _yj_value_sql(f"CAST({c} AS DOUBLE)", _lam_of(c))
        fits.append((f"fit_{c}", f"SELECT avg(v) AS m, stddev_samp(v) AS s FROM (SELECT {x} AS v FROM train)"))
        numbers.append(f"SELECT EmployeeNumber, '{c}' AS term, ({x} - m) / s AS value FROM test, fit_{c}")
    factors = [f"""SELECT EmployeeNumber, '{c}_' || {_NAME_SQL} AS term, CAST(CAST({c} AS VARCHAR) = level AS DOUBLE) AS value
  FROM test, (SELECT DISTINCT CAST({c} AS VARCHAR) AS level FROM train) v WHERE level > (SELECT min(CAST({c} AS VARCHAR)) FROM train)"""
               for c in _FACTORS]
    return with_ctes(f"SELECT EmployeeNumber, term, round(value, 6) + 0.0 AS value FROM ({' UNION ALL '.join(numbers + factors)}) b",
                     *_recipe_ctes(), *fits)


@query("m01_recipe", None)  # its SQL is attached once the split's is known
def m01(spark, sf):
    """The recipe fitted on the training split and applied to the test split, a row per column of the result."""
    model, test = _prepared(spark, sf)
    return _long_form(model.transform(test))


@query("m01_recipe_reloaded", None)
def m01_reloaded(spark, sf):
    """The same through a pipeline that was saved and loaded."""
    from pyspark.ml import Pipeline, PipelineModel
    from ..operators.models import split_train_test
    train, test = split_train_test(people(spark, sf))
    path = scratch_path(spark, "recipe-model")
    Pipeline(stages=[recipe_steps()]).fit(train).write().overwrite().save(path)
    return _long_form(PipelineModel.load(path).transform(test))


_STEPS = ["zv", "YeoJohnson", "num2factor", "center", "scale", "dummy"]


@query("m10_recipe_steps", "SELECT * FROM (VALUES " + ", ".join(
    f"({k}, 'step', '{kind}', true, false, '{kind}_{k}')" for k, kind in enumerate(_STEPS, 1))
    + ") t(number, operation, type, trained, skip, id) WHERE (SELECT count(*) FROM orders) >= 0")
def m10_steps(spark, sf):
    model, _ = _prepared(spark, sf)
    return model.tidy(spark)


@query("m10_recipe_terms", None)
def m10_terms(spark, sf):
    """What each step of the fitted recipe learned."""
    model, _ = _prepared(spark, sf)
    parts = [model.tidy(spark, k).withColumn("number", F.lit(k)) for k in range(1, len(_STEPS) + 1)]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.select("number", "terms", F.coalesce("position", F.lit(0)).alias("position"), F.coalesce("level", F.lit("")).alias("level"),
                      F.round("value", 6).alias("value"))


def _recipe_terms_sql() -> str:
    null = "0 AS position, '' AS level"
    moments = " UNION ALL ".join(
        f"SELECT '{c}' AS terms, avg(v) AS m, stddev_samp(v) AS s FROM (SELECT {_yj_value_sql(f'CAST({c} AS DOUBLE)', _lam_of(c))} AS v FROM train)"
        for c in _NUMBERS)
    levels = " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS terms, CAST({c} AS VARCHAR) AS level FROM train" for c in _FACTORS)
    body = " UNION ALL ".join([
        *[f"SELECT 1 AS number, '{c}' AS terms, {null}, CAST(NULL AS DOUBLE) AS value" for c in _ZERO_VARIANCE],
        f"SELECT 2, variable, {null}, round(lam, 6) FROM used WHERE lam IS NOT NULL",
        *[f"SELECT 3, '{c}', {null}, NULL" for c in DISCRETE_NUMERIC],
        f"SELECT 4, terms, {null}, round(m, 6) FROM moments", f"SELECT 5, terms, {null}, round(s, 6) FROM moments",
        f"SELECT 6, terms, CAST(row_number() OVER (PARTITION BY terms ORDER BY level) AS INT), level, NULL FROM ({levels}) l"])
    return with_ctes(body, *_recipe_ctes(), ("moments", moments))


@query("m08_indicators", """
WITH levels AS (SELECT DISTINCT 'user_id' AS f, CAST(user_id AS VARCHAR) AS level FROM events
  UNION ALL SELECT DISTINCT 'event_type', event_type FROM events),
long AS (SELECT event_id, 'user_id' AS f, CAST(user_id AS VARCHAR) AS level FROM events
  UNION ALL SELECT event_id, 'event_type', event_type FROM events),
firsts AS (SELECT f, min(level) AS first FROM levels GROUP BY f)
SELECT event_id, l.f || '_' || """ + _NAME_SQL + """ AS term, CAST(1.0 AS DOUBLE) AS value
FROM long l JOIN firsts USING (f) WHERE level > first""")
def m08_indicators(spark, sf):
    """Indicators of a category with as many levels as there are users: one sparse vector a row, read back by place."""
    ev = read_table(spark, sf, "events").select("event_id", F.col("user_id").cast("string").alias("user_id"), "event_type")
    model = rc.Recipe(idCol="event_id").step_indicators(["user_id", "event_type"], output="features").fit(ev)
    return rc.vector_entries(model.transform(ev), "event_id", "features", model.feature_names(1))


def attach_recipe_sql() -> None:
    """The recipe's SQL needs the split's, which the model queries hold."""
    for name in ("m01_recipe", "m01_recipe_reloaded"):
        set_sql(name, _recipe_sql())
    set_sql("m10_recipe_terms", _recipe_terms_sql())


# ---------------------------------------------------------------- D8-D12 correlation

D8_COLUMNS = ["Attrition", "Age", "DistanceFromHome", "MonthlyIncome", "OverTime", "JobSatisfaction",
              "YearsAtCompany", "Department"]
_STRINGS = {"Attrition", "OverTime", "Department", "JobRole", "BusinessTravel", "MaritalStatus",
            "EducationField", "Over18"}


def _coded_sql(columns) -> str:
    parts = [f"CAST(dense_rank() OVER (ORDER BY {c}) AS DOUBLE) AS {c}" if c in _STRINGS
             else f"CAST({c} AS DOUBLE) AS {c}" for c in columns]
    return "SELECT " + ", ".join(parts) + " FROM hr"


def _cor_rows_sql(features, target="Attrition", source="coded") -> str:
    return " UNION ALL ".join(
        f"SELECT '{f}' AS feature, {i + 1} AS pos, CASE WHEN var_samp({f}) = 0 OR var_samp({target}) = 0 THEN NULL "
        f"ELSE corr({f}, {target}) END AS {target} FROM {source}" for i, f in enumerate(features))


_D8_FEATS = [c for c in D8_COLUMNS if c != "Attrition"]
_D8_SQL = f"""SELECT feature, Attrition,
  CAST(row_number() OVER (ORDER BY Attrition ASC NULLS LAST, pos) AS INT) AS feature_order
FROM ({_cor_rows_sql(_D8_FEATS)}) c"""


@query("d08_get_cor", with_ctes(
    "SELECT feature, round(Attrition, 6) AS Attrition, feature_order FROM d8", ("coded", _coded_sql(D8_COLUMNS)),
    ("d8", _D8_SQL)))
def d08(spark, sf):
    hr = people(spark, sf).select(*D8_COLUMNS)
    return cr.get_cor(hr, "Attrition", fct_reorder=True).withColumn("Attrition", F.round("Attrition", 6))


@query("d09_signed_correlation", with_ctes(
    """SELECT feature, round(Attrition, 6) AS Attrition, feature_order, round_even(Attrition, 2) AS feature_name_text,
  CASE WHEN Attrition >= 0 THEN 'Positive' ELSE 'Negative' END AS Correlation FROM d8""",
    ("coded", _coded_sql(D8_COLUMNS)), ("d8", _D8_SQL)))
def d09(spark, sf):
    hr = people(spark, sf).select(*D8_COLUMNS)
    cor = cr.get_cor(hr, "Attrition", fct_reorder=True)
    return cr.signed_correlation(cor, "Attrition").withColumn("Attrition", F.round("Attrition", 6))


def _group_members(columns):
    out = []
    for g, frags in pf.FEATURE_GROUPS:
        seen = []
        for f in frags:
            for c in columns:
                if f in c.lower() and c not in seen and c != "Attrition":
                    seen.append(c)
        out += [(g, c) for c in seen]
    return out


_D10_COLUMNS = [c for c in HR_ALL if c not in ("StandardHours",)]
_D10_MEMBERS = _group_members(_D10_COLUMNS)


@query("d10_correlation_by_group", with_ctes(
    "SELECT feature_group, m.feature, round(c.Attrition, 6) AS Attrition FROM (VALUES " +
    ", ".join(f"('{g}', '{c}')" for g, c in _D10_MEMBERS) + ") m(feature_group, feature) JOIN (" +
    _cor_rows_sql(sorted({c for _, c in _D10_MEMBERS})) + ") c ON m.feature = c.feature",
    ("coded", _coded_sql(["Attrition"] + sorted({c for _, c in _D10_MEMBERS})))))
def d10(spark, sf):
    """All groups in one aggregate pass; group membership is a small literal."""
    feats = sorted({c for _, c in _D10_MEMBERS})
    hr = cr.as_numeric_codes(people(spark, sf).select("Attrition", *feats), ["Attrition", *feats])
    cor = cr.target_correlation(hr, "Attrition", feats)
    members = spark.createDataFrame(_D10_MEMBERS, "feature_group string, feature string")
    return members.join(F.broadcast(cor), "feature").select(
        "feature_group", "feature", F.round("Attrition", 6).alias("Attrition"))


D11_NUMERIC = ["EmployeeNumber", "Age", "DistanceFromHome", "MonthlyIncome", "YearsAtCompany",
               "TotalWorkingYears", "YearsInCurrentRole"]
D11_CATEGORIES = ["Department", "JobRole", "OverTime", "BusinessTravel", "MaritalStatus", "EducationField",
                  "JobLevel", "StockOptionLevel", "JobInvolvement", "JobSatisfaction",
                  "EnvironmentSatisfaction", "WorkLifeBalance", "PerformanceRating", "EmployeeCount",
                  "StandardHours", "Over18"]
CORR_LEVEL = 0.06


def discretised_correlation(hr: DataFrame) -> DataFrame:
    """Zero-variance columns dropped, numbers cut into quartile bins,
    every category one-hot, correlation of each indicator with
    Attrition_Yes (count form), ordered (fct_reorder + fct_rev)."""
    cols = D11_NUMERIC + D11_CATEGORIES
    hr = stage_table(hr.select("Attrition", *cols), "d11-input")  # several passes follow
    dropped = set(fe.zero_variance(hr, cols))  # one aggregate pass
    keep = [c for c in cols if c not in dropped]
    nums = [c for c in D11_NUMERIC if c in keep]
    cats = [c for c in D11_CATEGORIES if c in keep]
    binned = fe.discretize(hr.select("Attrition", *nums, *cats), fe.discretize_cuts(hr, nums))
    long = pf.tall(binned.withColumn("y", (F.col("Attrition") == "Yes").cast("int")), nums + cats,
                   "string", ids=["y"]).withColumnRenamed("value", "level")
    cor = cr.indicator_correlation(long)
    ranked = lookup_row_number(cor, [F.col("corr").asc_nulls_last(), F.col("feature").asc()], out="_r")
    n = ranked.count()
    return ranked.select("feature", F.col("corr").alias("Attrition_Yes"),
                         (F.lit(n) + 1 - F.col("_r")).cast("int").alias("feature_order"))


def _d11_sql() -> str:
    long_cats = " UNION ALL ".join(
        f"SELECT EmployeeNumber AS id, '{c}' AS variable, CAST({c} AS VARCHAR) AS level FROM hr"
        for c in D11_CATEGORIES if c not in ("EmployeeCount", "StandardHours", "Over18"))
    return f"""SELECT feature, corr AS Attrition_Yes,
  CAST(count(*) OVER () + 1 - row_number() OVER (ORDER BY corr ASC NULLS LAST, feature) AS INT) AS feature_order
FROM (SELECT variable || '_' || CASE WHEN regexp_matches(nm, '^[0-9]') THEN 'X' || nm ELSE nm END AS feature,
        CASE WHEN (n * a - a * a) * (n * t - t * t) = 0 THEN NULL
             ELSE (n * b - a * t) / sqrt((n * a - a * a) * (n * t - t * t)) END AS corr
  FROM (SELECT l.variable, regexp_replace(l.level, '[^A-Za-z0-9._]', '.', 'g') AS nm,
          CAST(count(*) AS DOUBLE) AS a, CAST(sum(y) AS DOUBLE) AS b
        FROM lv l GROUP BY l.variable, l.level) p
  JOIN (SELECT variable, CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS t FROM lv GROUP BY variable) q
    USING (variable)) f"""


_D11_LV = f"""SELECT x.variable, x.level, CASE WHEN h.Attrition = 'Yes' THEN 1 ELSE 0 END AS y FROM (
  SELECT id, variable, level FROM binned UNION ALL {" UNION ALL ".join(
    f"SELECT EmployeeNumber, '{c}', CAST({c} AS VARCHAR) FROM hr"
    for c in D11_CATEGORIES if c not in ("EmployeeCount", "StandardHours", "Over18"))}) x
  JOIN hr h ON h.EmployeeNumber = x.id"""
_D11_CTES = (("cuts", _cuts_sql(D11_NUMERIC)), ("binned", _binned_sql(D11_NUMERIC)), ("lv", _D11_LV),
             ("d11", _d11_sql()))


@query("d11_discretised_correlation", with_ctes(
    f"""SELECT feature, round(Attrition_Yes, 6) AS Attrition_Yes, feature_order,
  CASE WHEN Attrition_Yes > 0 THEN 'Supports' ELSE 'Contradicts' END AS relationship,
  split_part(feature, '_', 1) AS feature_base FROM d11 WHERE abs(Attrition_Yes) >= {CORR_LEVEL}""", *_D11_CTES))
def d11(spark, sf):
    c = discretised_correlation(people(spark, sf))
    return (c.where(F.abs("Attrition_Yes") >= CORR_LEVEL)
            .select("feature", F.round("Attrition_Yes", 6).alias("Attrition_Yes"), "feature_order",
                    F.when(F.col("Attrition_Yes") > 0, "Supports").otherwise("Contradicts").alias("relationship"),
                    F.split_part(F.col("feature"), F.lit("_"), F.lit(1)).alias("feature_base")))


@query("d12_distinct_feature_groups", with_ctes(
    f"SELECT count(DISTINCT split_part(feature, '_', 1)) AS n_groups FROM d11 WHERE abs(Attrition_Yes) >= {CORR_LEVEL}",
    *_D11_CTES))
def d12(spark, sf):
    return d11(spark, sf).agg(F.count_distinct("feature_base").alias("n_groups"))


# ---------------------------------------------------------------- D13-D15 distributions and pairs

_HIST = NUMERIC_ALL


def _hist_sql(columns, source="hr", group: str | None = None) -> str:
    g = f"{group}, " if group else ""
    long = " UNION ALL ".join(f"SELECT {g}'{c}' AS variable, CAST({c} AS DOUBLE) AS value FROM {source}"
                              for c in columns)
    return f"""SELECT {g}l.variable, CAST(CASE WHEN hi = lo THEN 1 ELSE least(floor((value - lo) / (hi - lo) * 10) + 1, 10) END AS INT) AS bin,
  count(*) AS n, min(lo) AS min, min(hi) AS max
FROM ({long}) l JOIN (SELECT variable, min(value) AS lo, max(value) AS hi FROM ({long}) z GROUP BY variable) r
  ON l.variable = r.variable WHERE value IS NOT NULL GROUP BY {g}l.variable, bin"""


@query("d13_histogram", with_ctes(_hist_sql(_HIST)))
def d13(spark, sf):
    return pf.histogram(people(spark, sf), _HIST)


@query("d13_histogram_events", _hist_sql(["value"], "events"))
def d13_events(spark, sf):
    return pf.histogram(read_table(spark, sf, "events"), ["value"])


PAIR_NUMERIC = ["Age", "DistanceFromHome", "MonthlyIncome"]


def pair_correlations(df: DataFrame, numeric, group: str) -> DataFrame:
    """D14 numeric x numeric: correlation of every pair within each colour
    group, all pairs in one grouped aggregate."""
    pairs = [(a, b) for i, a in enumerate(numeric) for b in numeric[i + 1:]]
    aggs = [cr.pearson(F.col(a), F.col(b)).alias(f"{a}__{b}") for a, b in pairs]
    row = df.groupBy(group).agg(*aggs)
    structs = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"{a}__{b}").alias("corr"))
               for a, b in pairs]
    return row.select(group, F.explode(F.array(*structs)).alias("p")).select(group, "p.*")


def _pairs_sql(numeric, group="Attrition", extra="") -> str:
    pairs = [(a, b) for i, a in enumerate(numeric) for b in numeric[i + 1:]]
    return " UNION ALL ".join(
        f"SELECT {extra}{group}, '{a}' AS x, '{b}' AS y, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS corr "
        f"FROM hr GROUP BY {group}" for a, b in pairs)


@query("d14_pairs_correlation", with_ctes(_pairs_sql(PAIR_NUMERIC)))
def d14_corr(spark, sf):
    return pair_correlations(people(spark, sf), PAIR_NUMERIC, "Attrition").withColumn("corr", F.round("corr", 6))


@query("d14_pairs_box_stats", with_ctes(" UNION ALL ".join(
    f"SELECT '{c}' AS variable, Attrition, " + ", ".join(
        f"round(quantile_cont({c}, {p}), 6) AS p{int(p * 100)}" for p in pf.PROFILE_PROBS) +
    " FROM hr GROUP BY Attrition" for c in PAIR_NUMERIC)))
def d14_box(spark, sf):
    hr = people(spark, sf)
    parts = [pf.box_stats(hr, c, "Attrition").select(F.lit(c).alias("variable"), "*") for c in PAIR_NUMERIC]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumns({f"p{int(p * 100)}": F.round(f"p{int(p * 100)}", 6) for p in pf.PROFILE_PROBS})


@query("d14_pairs_counts", with_ctes(
    "SELECT MaritalStatus, Attrition, count(*) AS n FROM hr GROUP BY MaritalStatus, Attrition"))
def d14_counts(spark, sf):
    return pf.pair_counts(people(spark, sf), "MaritalStatus", "Attrition")


@query("d14_pairs_density", with_ctes(_hist_sql(PAIR_NUMERIC, group="Attrition")))
def d14_density(spark, sf):
    """Diagonal of the pairs plot: per-colour-group histogram over common bins."""
    hr = people(spark, sf)
    long = pf.tall(hr, PAIR_NUMERIC, "double", ids=["Attrition"]).where(F.col("value").isNotNull())
    rng = long.groupBy("variable").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    b = F.when(F.col("_hi") == F.col("_lo"), F.lit(1)).otherwise(
        F.least(F.floor((F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 10) + 1, F.lit(10)))
    binned = long.join(F.broadcast(rng), "variable").withColumn("bin", b.cast("int"))
    return binned.groupBy("Attrition", "variable", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.first("_lo").alias("min"), F.first("_hi").alias("max"))


def _d15_groups():
    numeric = [c for c in NUMERIC_FEATURES] + ["EmployeeNumber"]
    out = []
    for g, frags in pf.FEATURE_GROUPS:
        cols = []
        for f in frags:
            for c in numeric:
                if f in c.lower() and c not in cols:
                    cols.append(c)
        if len(cols) >= 2:
            out.append((g, cols))
    return out


@query("d15_pairs_by_feature_group", with_ctes(" UNION ALL ".join(
    _pairs_sql(cols, extra=f"'{g}' AS feature_group, ") for g, cols in _d15_groups())))
def d15(spark, sf):
    hr = people(spark, sf)
    parts = [pair_correlations(hr, cols, "Attrition").select(F.lit(g).alias("feature_group"), "*")
             for g, cols in _d15_groups()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("corr", F.round("corr", 6))


def _members(kind: list[str]) -> list[tuple[str, list[str]]]:
    """Columns of ``kind`` in each feature group, the target first where it is one of the kind."""
    return [(g, [c for c in kind if c != "Attrition" and any(f in c.lower() for f in frags)]) for g, frags in pf.FEATURE_GROUPS]


#: Pairs of categories of each group, the target among them: (group, x, y).
CATEGORY_PAIRS = [(g, a, b) for g, cols in _members(CHARACTER_COLUMNS) for i, a in enumerate(["Attrition", *cols]) for b in cols[i:]]
#: Numbers by category of each group: (group, number, category).
NUMBER_BY_CATEGORY = [(g, x, y) for (g, cats), (_, nums) in zip(_members(CHARACTER_COLUMNS), _members(NUMERIC_ALL))
                      for x in nums for y in ["Attrition", *cats]]


@query("d15_pairs_counts", with_ctes(" UNION ALL ".join(
    f"SELECT '{g}' AS feature_group, '{a}' AS x, '{b}' AS y, {a} AS level_x, {b} AS level_y, count(*) AS n FROM hr GROUP BY {a}, {b}"
    for g, a, b in CATEGORY_PAIRS)))
def d15_counts(spark, sf):
    """Category by category in every feature group: one read of the rows."""
    return pf.grouped_pair_counts(people(spark, sf), CATEGORY_PAIRS)


@query("d15_pairs_box_stats", with_ctes(" UNION ALL ".join(
    f"SELECT '{g}' AS feature_group, '{x}' AS x, '{y}' AS y, {y} AS level, " + ", ".join(
        f"round(quantile_cont(CAST({x} AS DOUBLE), {p}), 6) AS p{int(p * 100)}" for p in pf.PROFILE_PROBS) + f" FROM hr GROUP BY {y}"
    for g, x, y in NUMBER_BY_CATEGORY)))
def d15_box(spark, sf):
    """Number by category in every feature group: all five-number summaries from the same passes."""
    box = pf.grouped_box_stats(people(spark, sf), NUMBER_BY_CATEGORY)
    return box.withColumns({f"p{int(p * 100)}": F.round(f"p{int(p * 100)}", 6) for p in pf.PROFILE_PROBS})


@query("d11_indicator_correlation", with_ctes(
    "SELECT feature, round(Attrition_Yes, 6) AS Attrition_Yes, feature_order FROM d11", *_D11_CTES))
def d11_all(spark, sf):
    """D11 before the |r| cutoff: every indicator's correlation and order."""
    c = discretised_correlation(people(spark, sf))
    return c.withColumn("Attrition_Yes", F.round("Attrition_Yes", 6))
