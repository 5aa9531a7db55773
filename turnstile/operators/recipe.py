"""The preparation recipe as a Spark ML estimator.

``Recipe`` is an ``Estimator``: its steps are parameters, ``fit`` learns each
step from the rows as the steps before it leave them, and the fitted
``RecipeModel`` is a ``Model`` with its own writer and reader, so that a recipe
stands in a ``Pipeline``, is saved with it and prepares any other table alike.

Every step is fitted by aggregates over one written copy of the training
columns; what a step learns is a few numbers per column (and the levels of
the categories that become columns of their own).  Categories with very many
levels go through ``step_indicators``: their levels are a table, joined to
the rows, and come out as one sparse vector.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable,
                             MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete_path, scratch_path
from .correlation import make_names
from .features import (SKEW_CUTOFF, YJ_EPS, YJ_LIMITS, category_levels, center_scale_params, discretize, discretize_cuts, dummies,
                       is_numeric_type, skewed_columns, yeo_johnson, zero_variance)

#: Likelihoods per column that one pass evaluates.
PROBES = 8
TOLERANCE = 1e-6
#: Columns with fewer distinct values are not transformed.
YJ_MIN_UNIQUE = 5


def yj_lambdas(df: DataFrame, columns: Sequence[str], limits: tuple[float, float] = YJ_LIMITS, probes: int = PROBES,
               tolerance: float = TOLERANCE, grain: float | None = None, min_unique: int = YJ_MIN_UNIQUE) -> dict[str, float | None]:
    """M4: the lambda of greatest likelihood of every column, all columns in lockstep.

    The likelihood has one peak.  A pass over the rows evaluates ``probes``
    lambdas within each column's bracket, and the neighbours of the best one are
    the next bracket: the search of the golden section with more probes, since a
    pass costs more than a logarithm.  ``grain`` puts the result on the better of the two
    grid points around the peak.  None where the column has too few distinct values or
    the peak is at a limit.
    """
    columns = list(columns)
    if not columns:
        return {}
    x = {c: F.col(c).cast("double") for c in columns}
    first = df.agg(*[e for c in columns for e in (
        F.count(x[c]).alias(f"n_{c}"), F.count_distinct(x[c]).alias(f"d_{c}"),
        F.sum(F.signum(x[c]) * F.log1p(F.abs(x[c]))).alias(f"k_{c}"))]).first()

    def best(tried: dict[str, list[float]]) -> dict[str, int]:
        """Place of the best of each column's lambdas."""
        row = df.agg(*[F.var_pop(yeo_johnson(x[c], lam)).alias(f"v{i}_{c}") for c, ls in tried.items() for i, lam in enumerate(ls)]).first()
        found = {}
        for c, ls in tried.items():
            likelihood = []
            for i, lam in enumerate(ls):
                v = row[f"v{i}_{c}"]
                ok = v is not None and math.isfinite(v) and v > 0
                likelihood.append(-0.5 * first[f"n_{c}"] * math.log(v) + (lam - 1) * first[f"k_{c}"] if ok else -math.inf)
            found[c] = max(range(len(ls)), key=likelihood.__getitem__)
        return found

    found: dict[str, float | None] = dict.fromkeys(columns)
    bracket = {c: limits for c in columns if first[f"d_{c}"] >= min_unique}
    while bracket and max(hi - lo for lo, hi in bracket.values()) > tolerance:
        tried = {c: [lo + (hi - lo) * k / (probes + 1) for k in range(probes + 2)] for c, (lo, hi) in bracket.items()}
        for c, k in best(tried).items():
            bracket[c] = (tried[c][max(0, k - 1)], tried[c][min(probes + 1, k + 1)])
    peak = {c: (lo + hi) / 2 for c, (lo, hi) in bracket.items()}
    inside = {c: v for c, v in peak.items() if min(v - limits[0], limits[1] - v) > YJ_EPS}
    if grain and inside:
        tried = {c: [round(math.floor(v / grain) * grain, 10), round(math.floor(v / grain) * grain + grain, 10)] for c, v in inside.items()}
        inside = {c: tried[c][k] for c, k in best(tried).items()}
    return found | inside


# what a step learned, one row per term (and level or cut point)
_TERMS = "number int, step string, terms string, position int, level string, value double"
_DICTIONARY = "feature string, level string, position long, slot long"


def level_dictionary(df: DataFrame, columns: Sequence[str], one_hot: bool = False) -> DataFrame:
    """(feature, level, position from 1 in order of the level, slot): the levels of every column as a table.

    Without ``one_hot`` the first level is the reference: its slot is the last one, which the encoder drops.
    """
    from .ordered import row_number
    from .profile import tall
    levels = tall(df, columns).where(F.col("value").isNotNull()).groupBy(F.col("variable").alias("feature"), F.col("value").alias("level")).agg(
        F.lit(1).alias("one")).drop("one")
    ranked = row_number(levels, ["level"], ["feature"], out="position")
    if one_hot:
        return ranked.withColumn("slot", F.col("position") - 1)
    sizes = ranked.groupBy(F.col("feature").alias("of")).agg(F.max("position").alias("size"))
    return ranked.join(sizes, F.col("feature") == F.col("of")).withColumn(
        "slot", F.when(F.col("position") == 1, F.col("size") - 1).otherwise(F.col("position") - 2)).select("feature", "level", "position", "slot")


class Recipe(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Steps in order; columns are names, ``all_predictors``, ``all_numeric`` or ``all_nominal``.

    ``all_predictors`` leaves out the target; no selection ever holds the id.
    """

    target = Param(Params._dummy(), "target", "column to be predicted", TypeConverters.toString)
    idCol = Param(Params._dummy(), "idCol", "column that tells rows apart", TypeConverters.toString)
    steps = Param(Params._dummy(), "steps", "the steps in order, as JSON", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, target: str | None = None, idCol: str | None = None, steps: list[str] | None = None) -> None:
        super().__init__()
        self._setDefault(target="", idCol="", steps=[])
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _step(self, kind: str, columns: str | Sequence[str], **how) -> Recipe:
        step = {"type": kind, "columns": columns if isinstance(columns, str) else list(columns), **how}
        return self._set(steps=[*self.getOrDefault(self.steps), json.dumps(step)])

    def step_zv(self, columns: str | Sequence[str] = "all_predictors") -> Recipe:
        """M2: drop columns with one value."""
        return self._step("zv", columns)

    def step_yeo_johnson(self, columns: str | Sequence[str] = "all_predictors", skew: float | None = SKEW_CUTOFF,
                         exclude: Sequence[str] = (), grain: float | None = None) -> Recipe:
        """M3, M4: transform the given numeric columns, or those of them that are as skewed as ``skew``."""
        return self._step("YeoJohnson", columns, skew=skew, exclude=list(exclude), grain=grain)

    def step_num2factor(self, columns: Sequence[str]) -> Recipe:
        """M5: numbers that are categories."""
        return self._step("num2factor", columns)

    def step_center(self, columns: str | Sequence[str] = "all_numeric") -> Recipe:
        return self._step("center", columns)

    def step_scale(self, columns: str | Sequence[str] = "all_numeric") -> Recipe:
        return self._step("scale", columns)

    def step_discretize(self, columns: str | Sequence[str] = "all_numeric", cuts: int = 4, min_unique: int = 1) -> Recipe:
        """M9: quantile bins."""
        return self._step("discretize", columns, cuts=cuts, min_unique=min_unique)

    def step_dummy(self, columns: str | Sequence[str] = "all_nominal", one_hot: bool = False) -> Recipe:
        """M8: a column per level (but the first, without ``one_hot``)."""
        return self._step("dummy", columns, one_hot=one_hot)

    def step_indicators(self, columns: str | Sequence[str] = "all_nominal", output: str = "indicators", one_hot: bool = False) -> Recipe:
        """M8 for any number of levels: one sparse vector of all columns' indicators.  A level not seen in
        training, and a null, has none."""
        return self._step("indicators", columns, output=output, one_hot=one_hot)

    def _columns(self, df: DataFrame, step: dict) -> list[str]:
        chosen, target, id_col = step["columns"], self.getOrDefault(self.target), self.getOrDefault(self.idCol)
        if not isinstance(chosen, str):
            return [c for c in chosen if c in df.columns and c != id_col]
        numeric = {f.name for f in df.schema.fields if is_numeric_type(f.dataType)}
        text = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
        pool = {"all_predictors": (numeric | text) - {target}, "all_numeric": numeric, "all_nominal": text}[chosen]
        return [c for c in df.columns if c in pool and c != id_col]

    def _fit(self, dataset: DataFrame) -> RecipeModel:
        spark = dataset.sparkSession
        root = scratch_path(spark, "recipe")
        dataset.write.parquet(f"{root}/train")
        try:
            df = spark.read.parquet(f"{root}/train")
            learned: list[tuple] = []
            tables: dict[int, DataFrame] = {}
            for number, text in enumerate(self.getOrDefault(self.steps), 1):
                step = json.loads(text)
                columns = self._columns(df, step)
                rows, table = _learn(df, step, columns)
                if table is not None:
                    table.write.parquet(f"{root}/dictionary-{number}")
                    table = tables[number] = spark.read.parquet(f"{root}/dictionary-{number}")
                rows = [(number, step["type"], *r) for r in rows]
                learned += rows
                df = _apply(df, step, rows, table)
        finally:
            delete_path(spark, f"{root}/train")
        model = RecipeModel(learned, tables)
        return self._copyValues(model)


def _learn(df: DataFrame, step: dict, columns: list[str]) -> tuple[list[tuple], DataFrame | None]:
    """Rows (terms, position, level, value) that a step learns from ``df``, or its table."""
    kind = step["type"]
    if kind == "indicators":
        return [(c, None, None, None) for c in columns], level_dictionary(df, columns, step["one_hot"])
    if not columns:
        return [], None
    if kind == "zv":
        return [(c, None, None, None) for c in zero_variance(df, columns)], None
    if kind == "YeoJohnson":
        numeric = [c for c in columns if is_numeric_type(df.schema[c].dataType) and c not in step["exclude"]]
        if step["skew"] is not None and numeric:
            skewed = {r["variable"] for r in skewed_columns(df, numeric, step["skew"]).collect()}
            numeric = [c for c in numeric if c in skewed]
        return [(c, None, None, lam) for c, lam in yj_lambdas(df, numeric, grain=step["grain"]).items()], None
    if kind == "num2factor":
        return [(c, None, None, None) for c in columns], None
    if kind in ("center", "scale"):
        values = center_scale_params(df, columns)[kind == "scale"]
        return [(c, None, None, values[c]) for c in columns], None
    if kind == "discretize":
        cuts = discretize_cuts(df, columns, step["cuts"], step["min_unique"])
        return [(r["variable"], r["position"], None, r["cut"]) for r in cuts.orderBy("variable", "position").collect()], None
    levels = category_levels(df, columns)
    return [(c, k, level, None) for c in columns for k, level in enumerate(levels[c], 1)], None


def _apply(df: DataFrame, step: dict, rows: list[tuple], table: DataFrame | None) -> DataFrame:
    """One step with what it learned: rows (number, step, terms, position, level, value)."""
    kind, terms = step["type"], list(dict.fromkeys(r[2] for r in rows))
    if kind == "zv":
        return df.drop(*terms)
    if kind == "indicators":
        return _indicators(df, step, terms, table)
    if not rows:
        return df
    if kind == "YeoJohnson":
        return df.withColumns({r[2]: yeo_johnson(F.col(r[2]), r[5]) for r in rows if r[5] is not None})
    if kind == "num2factor":
        return df.withColumns({c: F.col(c).cast("string") for c in terms})
    if kind == "center":
        return df.withColumns({r[2]: F.col(r[2]) - F.lit(r[5]) for r in rows})
    if kind == "scale":
        return df.withColumns({r[2]: F.try_divide(F.col(r[2]), F.lit(r[5])) for r in rows})
    if kind == "discretize":
        return discretize(df, df.sparkSession.createDataFrame([(r[2], r[3], r[5]) for r in rows], "variable string, position int, cut double"))
    levels: dict[str, list[str]] = {c: [] for c in terms}
    for r in rows:
        levels[r[2]].append(r[4])
    return dummies(df, levels, one_hot=step["one_hot"])


def _indicators(df: DataFrame, step: dict, columns: list[str], dictionary: DataFrame) -> DataFrame:
    """Each column's level is looked up in the dictionary by a join that Spark plans from real sizes."""
    names = {c: (f"__slot_{i}", f"__vector_{i}") for i, c in enumerate(columns)}
    # a null, or a level that training never met, takes the slot that the encoder drops: the reference's, or one after all
    last = {r["feature"]: float(r["last"] + step["one_hot"]) for r in dictionary.groupBy("feature").agg(F.max("slot").alias("last")).collect()}
    used = [c for c in columns if last.get(c)]  # others have no indicator
    out = df
    for c in used:
        slot, level = names[c][0], f"{names[c][0]}_level"
        slots = dictionary.where(F.col("feature") == c).select(F.col("level").alias(level), F.col("slot").cast("double").alias(slot))
        out = out.join(slots, F.col(c) == F.col(level), "left").drop(level).fillna(last[c], [slot])
    if not used:
        return out.withColumn(step["output"], array_to_vector(F.array().cast("array<double>"))).drop(*columns)
    # the encoder learns the number of slots from the greatest one
    shape = df.sparkSession.createDataFrame([tuple(last[c] for c in used)], [names[c][0] for c in used])
    encoder = OneHotEncoder(inputCols=[names[c][0] for c in used], outputCols=[names[c][1] for c in used], dropLast=True).fit(shape)
    keep = VectorAssembler(inputCols=[names[c][1] for c in used], outputCol=step["output"])
    return keep.transform(encoder.transform(out)).drop(*columns, *[n for pair in names.values() for n in pair])


def vector_entries(df: DataFrame, id_col: str, vector_col: str, names: DataFrame) -> DataFrame:
    """(id, term, value): a vector's entries that aren't zero, by the names of their places (place, name)."""
    # a vector is written as its size, places and values; a dense one has values only
    shape = f"struct<`{vector_col}`:struct<indices:array<int>,values:array<double>>>"
    given = F.from_json(F.to_json(F.struct(vector_col)), shape)[vector_col]
    places = F.coalesce(given["indices"], F.sequence(F.lit(0), F.size(given["values"]) - 1))
    entries = df.select(id_col, F.explode(F.arrays_zip(places.alias("place"), given["values"].alias("value"))).alias("e"))
    return entries.select(id_col, F.col("e.place").alias("place"), F.col("e.value").alias("value")).where("value <> 0").join(
        names, "place").select(id_col, F.col("name").alias("term"), "value")


class RecipeModel(Model, MLReadable, MLWritable):
    """A fitted recipe."""

    target = Recipe.target
    idCol = Recipe.idCol
    steps = Recipe.steps

    def __init__(self, learned: list[tuple] | None = None, tables: dict[int, DataFrame] | None = None) -> None:
        super().__init__()
        self._setDefault(target="", idCol="", steps=[])
        self.learned, self.tables = learned or [], tables or {}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = dataset
        for number, text in enumerate(self.getOrDefault(self.steps), 1):
            out = _apply(out, json.loads(text), [r for r in self.learned if r[0] == number], self.tables.get(number))
        return out

    def tidy(self, spark: SparkSession, number: int | None = None) -> DataFrame:
        """The list of steps, or what step ``number`` learned (terms, position, level, value)."""
        if number is None:
            kinds = [json.loads(s)["type"] for s in self.getOrDefault(self.steps)]
            return spark.createDataFrame([(k, "step", kind, True, False, f"{kind}_{k}") for k, kind in enumerate(kinds, 1)],
                                         "number int, operation string, type string, trained boolean, skip boolean, id string")
        if number in self.tables:
            return self.tables[number].select(F.col("feature").alias("terms"), F.col("position").cast("int").alias("position"), "level",
                                              F.lit(None).cast("double").alias("value"))
        return spark.createDataFrame([r for r in self.learned if r[0] == number], _TERMS).drop("number", "step")

    def feature_names(self, number: int) -> DataFrame:
        """Names ``Feature_Level`` of the places of an indicator step's vector."""
        step = json.loads(self.getOrDefault(self.steps)[number - 1])
        table, columns = self.tables[number], [r[2] for r in self.learned if r[0] == number]
        used = table if step["one_hot"] else table.where("position > 1")
        sizes = {r["feature"]: r["n"] for r in used.groupBy("feature").agg(F.count("*").alias("n")).collect()}
        ahead, starts = 0, {}
        for c in columns:
            starts[c], ahead = ahead, ahead + sizes.get(c, 0)
        start = F.coalesce(*[F.when(F.col("feature") == c, F.lit(s)) for c, s in starts.items()])
        return used.select((start + F.col("slot")).alias("place"), F.concat(F.col("feature"), F.lit("_"), make_names(F.col("level"))).alias("name"))

    def write(self) -> MLWriter:
        return _RecipeWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _RecipeReader()


class _RecipeWriter(MLWriter):
    def __init__(self, model: RecipeModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sc)
        spark = self.sparkSession
        rows = [(k, *r) for k, r in enumerate(self.model.learned)]
        spark.createDataFrame(rows, f"place int, {_TERMS}").coalesce(1).write.parquet(f"{path}/learned")
        for number, table in self.model.tables.items():
            table.write.parquet(f"{path}/dictionary-{number}")


class _RecipeReader(MLReader):
    def load(self, path: str) -> RecipeModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sc)
        spark = self.sparkSession
        model = RecipeModel()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.learned = [tuple(r)[1:] for r in spark.read.parquet(f"{path}/learned").orderBy("place").collect()]
        for number, text in enumerate(model.getOrDefault(model.steps), 1):
            if json.loads(text)["type"] == "indicators":
                model.tables[number] = spark.read.parquet(f"{path}/dictionary-{number}")
        return model
