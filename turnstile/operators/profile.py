"""Table profiling in few passes.

Per-variable work is done for all columns at once: either one ``agg`` with
many expressions, or an ``unpivot`` to a tall ``(variable, value)`` table
followed by one grouped aggregate.  Quantiles are exact and distributed
(``exact_quantiles``); nothing gathers a variable into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import contains
from .joins import broadcast_if_small, stage_table
from .ordered import exact_quantiles, quantiles_from_counts

# Feature groups of the data-understanding step, as
# (group name, name fragments matched case-insensitively).
FEATURE_GROUPS: list[tuple[str, list[str]]] = [
    ("descriptive", ["age", "gender", "maritalstatus", "numcompaniesworked", "over18",
                     "distancefromhome"]),
    ("employment", ["employee", "department", "job"]),
    ("compensation", ["income", "rate", "salary", "stock"]),
    ("survey", ["satisfaction", "life"]),
    ("performance", ["performance", "involvement"]),
    ("work_life", ["overtime", "travel"]),
    ("training_education", ["training", "education"]),
    ("time", ["years"]),
]

DISCRETE_MAX_DISTINCT = 10


def feature_group_columns(df: DataFrame, fragments: Sequence[str],
                          exclude: Sequence[str] = ()) -> list[str]:
    seen: list[str] = []
    for f in fragments:
        for c in contains(df, f):
            if c not in seen and c not in exclude:
                seen.append(c)
    return seen


def tall(df: DataFrame, columns: Sequence[str], as_type: str = "string",
         ids: Sequence[str] = ()) -> DataFrame:
    """R1/R2 ``gather``: ``(ids..., variable, value)`` with one value type."""
    cast = df.select(*ids, *[F.col(c).cast(as_type).alias(c) for c in columns])
    return cast.unpivot(list(ids), list(columns), "variable", "value")


def frequency_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A7 ``map(table)``: counts per (variable, value); NULLs dropped like ``table``."""
    return (tall(df, columns).where(F.col("value").isNotNull())
            .groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n")))


def proportion_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A8 ``prop.table``: count / variable total (totals: one row per variable,
    broadcast after a size check)."""
    freq = frequency_table(df, columns)
    totals = freq.groupBy("variable").agg(F.sum("n").alias("_tot"))
    return (freq.join(broadcast_if_small(totals), "variable")
            .select("variable", "value", "n", (F.col("n") / F.col("_tot")).alias("prop")))


def unique_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A9 ``map(unique)``: distinct (variable, value), NULL kept as a value."""
    return tall(df, columns).distinct()


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A10: distinct values per variable, NULL counted as one value (R ``unique``)."""
    return (unique_values(df, columns).groupBy("variable")
            .agg(F.count(F.lit(1)).alias("n_distinct")))


def discrete_continuous(df: DataFrame, columns: Sequence[str],
                        max_distinct: int = DISCRETE_MAX_DISTINCT) -> DataFrame:
    """``kind`` = discrete when at most ``max_distinct`` values."""
    return distinct_counts(df, columns).withColumn(
        "kind", F.when(F.col("n_distinct") <= max_distinct, "discrete").otherwise("continuous"))


def skewness_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Population skewness m3 / m2^1.5 per numeric variable (one pass)."""
    row = df.agg(*[F.skewness(F.col(c).cast("double")).alias(c) for c in columns])
    return row.unpivot([], list(columns), "variable", "skewness")


def missing_share(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A15 ``plot_missing`` data: number and share of NULLs per variable (one pass)."""
    row = df.agg(*[F.struct(F.avg(F.col(c).isNull().cast("double")).alias("pct_missing"),
                            F.count_if(F.col(c).isNull()).alias("n_missing")).alias(c) for c in columns])
    return row.unpivot([], list(columns), "variable", "m").select("variable", "m.pct_missing", "m.n_missing")


PROFILE_PROBS = [0.0, 0.25, 0.5, 0.75, 1.0]


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(variable, _v, _c)``: rows per distinct value of every column (NULL
    kept as a value).  One partial aggregate; the profile, the quantiles and
    the distinct counts are all derived from it, so the input is read once."""
    return tall(df, columns, "double").groupBy("variable", F.col("value").alias("_v")) \
        .agg(F.count(F.lit(1)).alias("_c"))


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """N, missing, mean, sd, p0/p25/p50/p75/p100, distinct values.

    Moments are one aggregate over all columns.  The value counts are written
    once: quantiles are selected from them by digit, and their rows are the
    distinct values (NULL counted as one, as R ``unique``)."""
    x = {c: F.col(c).cast("double") for c in columns}
    # one row of structs, a column each
    row = df.agg(*[F.struct(F.count(F.lit(1)).alias("n"), F.count_if(F.col(c).isNull()).alias("n_missing"),
                            F.avg(x[c]).alias("mean"), F.stddev_samp(x[c]).alias("sd")).alias(c) for c in columns])
    moments = row.unpivot([], list(columns), "variable", "m").select("variable", "m.*")
    counts = stage_table(value_counts(df, columns), "value-counts")
    q = quantiles_from_counts(counts, PROFILE_PROBS, ["variable"], groups_bounded=True)
    wide = q.groupBy("variable").pivot("prob", PROFILE_PROBS).agg(F.first("quantile"))
    wide = wide.select("variable", *[F.col(f"`{p}`").alias(f"p{int(p * 100)}") for p in PROFILE_PROBS])
    distinct = counts.groupBy("variable").agg(F.count(F.lit(1)).alias("n_distinct"))
    return (moments.join(wide, "variable", "left").join(distinct, "variable", "left")
            .select("variable", "n", "n_missing", "mean", "sd", *[f"p{int(p * 100)}" for p in PROFILE_PROBS], "n_distinct"))


def character_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A14, the character half of ``skim``: n, missing, empty, blank, lengths, distinct values (NULL counted as one).

    Counts and lengths are one aggregate; distinct values are the rows of the frequency table."""
    row = df.agg(*[F.struct(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(c).isNull()).alias("n_missing"), F.count_if(F.col(c) == "").alias("n_empty"),
        F.count_if((F.trim(F.col(c)) == "") & (F.col(c) != "")).alias("n_blank"), F.min(F.length(c)).alias("min_length"),
        F.max(F.length(c)).alias("max_length")).alias(c) for c in columns])
    return row.unpivot([], list(columns), "variable", "m").select("variable", "m.*").join(distinct_counts(df, columns), "variable", "left")


def level_counts(df: DataFrame, columns: Sequence[str], k: int = 6) -> DataFrame:
    """A16, the category half of ``summary``: the ``k`` most frequent levels per column (ties by level), and
    the others' count as ``(Other)``, the last position.

    ``k`` is the feature: each task keeps its own first ``k`` levels of a column before they meet."""
    freq = frequency_table(df, columns)
    order = Window.partitionBy("variable").orderBy(F.desc("n"), "value")
    top = freq.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)
    top = top.select("variable", F.col("value").alias("level"), "n", "position")
    rest = freq.groupBy("variable").agg(F.sum("n").alias("_all")).join(
        top.groupBy("variable").agg(F.sum("n").alias("_top")), "variable").where("_all > _top")
    other = rest.select("variable", F.lit("(Other)").alias("level"), (F.col("_all") - F.col("_top")).alias("n"), F.lit(k + 1).alias("position"))
    return top.unionByName(other)


def grouped_pair_counts(df: DataFrame, pairs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """D15 category x category: rows per pair of levels of every (group, x, y), from one read."""
    each = F.array(*[F.struct(F.lit(g).alias("feature_group"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(x).alias("level_x"),
                              F.col(y).alias("level_y")) for g, x, y in pairs])
    return df.select(F.explode(each).alias("p")).select("p.*").groupBy("feature_group", "x", "y", "level_x", "level_y").agg(
        F.count(F.lit(1)).alias("n"))


def grouped_box_stats(df: DataFrame, pairs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """D15 numeric x category: exact five-number summary of x by level of y for every (group, x, y)."""
    places = {p: i for i, p in enumerate(dict.fromkeys((x, y) for _, x, y in pairs))}
    each = F.array(*[F.struct(F.lit(i).alias("pair"), F.col(y).alias("level"), F.col(x).cast("double").alias("_v")) for (x, y), i in places.items()])
    # equal values of a pair and level are one row, and a pair of several groups is worked out once
    counts = df.select(F.explode(each).alias("p")).select("p.*").where(F.col("_v").isNotNull()).groupBy("pair", "level", "_v").agg(
        F.count(F.lit(1)).alias("_c"))
    q = quantiles_from_counts(counts, PROFILE_PROBS, ["pair", "level"])
    names = df.sparkSession.createDataFrame([(places[x, y], g, x, y) for g, x, y in dict.fromkeys(pairs)],
                                            "pair int, feature_group string, x string, y string")
    key = ["feature_group", "x", "y", "level"]
    return q.join(F.broadcast(names), "pair").groupBy(*key).pivot("prob", PROFILE_PROBS).agg(F.first("quantile")).select(
        *key, *[F.col(f"`{p}`").alias(f"p{int(p * 100)}") for p in PROFILE_PROBS])


def type_name(dt: T.DataType) -> str:
    return dt.simpleString()


def glimpse(df: DataFrame, order_col: str, k: int = 3) -> DataFrame:
    """A19 ``glimpse`` as rows: variable, type, position and the first ``k``
    values (by ``order_col``) as text.  ``k`` is the feature: a top-k read."""
    head = df.orderBy(order_col).limit(k)
    cols = [c for c in df.columns]
    spark = df.sparkSession
    meta = spark.createDataFrame([(c, type_name(df.schema[c].dataType), i + 1) for i, c in enumerate(cols)],
                                 "variable string, type string, position int")
    texts = []
    for f in df.schema.fields:
        v = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            v = F.format_number(v, 2)
        texts.append(F.struct(F.lit(f.name).alias("variable"), v.cast("string").alias("value")))
    vals = (head.select(F.col(order_col).alias("_o"), F.explode(F.array(*texts)).alias("_t"))
            .select("_o", "_t.variable", "_t.value")
            .groupBy("variable")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "value"))),
                                          lambda s: s["value"]), ", ").alias("first_values")))
    return meta.join(vals, "variable", "left")


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """Equal-width bins per variable; the maximum falls in the last bin.

    Column ranges come from one aggregate (one row per variable, broadcast
    after a size check); the counts are a partial aggregate.
    """
    long = tall(df, columns, "double").where(F.col("value").isNotNull())
    rng = long.groupBy("variable").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    b = F.when(F.col("_hi") == F.col("_lo"), F.lit(1)).otherwise(
        F.least(F.floor((F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins) + 1,
                F.lit(bins)))
    binned = long.join(broadcast_if_small(rng), "variable").withColumn("bin", b.cast("int"))
    return binned.groupBy("variable", "bin").agg(F.count(F.lit(1)).alias("n"),
                                               F.first("_lo").alias("min"), F.first("_hi").alias("max"))


def box_stats(df: DataFrame, value: str, group: str) -> DataFrame:
    """D14 numeric x category: exact five-number summary per category."""
    q = exact_quantiles(df, value, PROFILE_PROBS, [group])  # group set checked inside
    return q.groupBy(group).pivot("prob", PROFILE_PROBS).agg(F.first("quantile")).select(
        group, *[F.col(f"`{p}`").alias(f"p{int(p * 100)}") for p in PROFILE_PROBS])


def pair_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """D14 category x category: counts per value pair."""
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))

