"""Feature preparation, fitted on one table and applied to any.

Fitting is aggregate work (one or a few passes); the fitted parameters are a
handful of numbers per column.  Applying is a single projection, so train and
test get identical treatment.  ``recipe.Recipe`` puts the steps together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .profile import skewness_table

SKEW_CUTOFF = 0.8
# Lambda search interval of the Yeo-Johnson step.
YJ_LIMITS = (-5.0, 5.0)
YJ_EPS = 0.001
MAX_DUMMY_LEVELS = 1000


def zero_variance(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """M2 ``step_zv``: columns with fewer than two distinct non-NULL values.

    min == max (or all NULL) is the same test as one distinct value and
    needs only one pass with two aggregates per column, strings included.
    """
    row = df.agg(*[F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def skewed_columns(df: DataFrame, columns: Sequence[str], cutoff: float = SKEW_CUTOFF,
                   exclude: Sequence[str] = ()) -> DataFrame:
    """M3: skewness >= cutoff, minus listed (discrete) columns."""
    return (skewness_table(df, columns).where(F.col("skewness") >= cutoff)
            .where(~F.col("variable").isin(list(exclude)) if exclude else F.lit(True)))


def yeo_johnson(x: Column, lam: float) -> Column:
    """Yeo-Johnson transform with a fixed lambda."""
    x = x.cast("double")
    if abs(lam) < YJ_EPS:
        pos = F.log1p(x)
    else:
        pos = (F.pow(x + 1, F.lit(lam)) - 1) / F.lit(lam)
    if abs(lam - 2) < YJ_EPS:
        neg = -F.log1p(-x)
    else:
        neg = -(F.pow(1 - x, F.lit(2 - lam)) - 1) / F.lit(2 - lam)
    return F.when(x >= 0, pos).otherwise(neg)


def yj_loglik_table(df: DataFrame, columns: Sequence[str], grid: Sequence[float]) -> DataFrame:
    """Log-likelihood of every lambda in ``grid`` for every column, one pass:
    -n/2 * ln(var_pop(y)) + (lambda - 1) * sum(sign(x) * ln(|x| + 1))."""
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        aggs.append(F.count(x).alias(f"{c}__n"))
        aggs.append(F.sum(F.signum(x) * F.log1p(F.abs(x))).alias(f"{c}__k"))
        for i, lam in enumerate(grid):
            aggs.append(F.var_pop(yeo_johnson(x, lam)).alias(f"{c}__v{i}"))
    row = df.agg(*aggs)
    structs = []
    for c in columns:
        for i, lam in enumerate(grid):
            ll = (-0.5 * F.col(f"{c}__n") * F.log(F.col(f"{c}__v{i}"))
                  + F.lit(lam - 1.0) * F.col(f"{c}__k"))
            structs.append(F.struct(F.lit(c).alias("variable"), F.lit(float(lam)).alias("lambda"),
                                    ll.alias("loglik")))
    return row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def center_scale_params(df: DataFrame, columns: Sequence[str]) -> tuple[dict, dict]:
    """M6/M7: mean and sample sd of every column in one aggregate (1 row)."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns],
                 *[F.stddev_samp(c).alias(f"s_{c}") for c in columns]).first()
    return {c: row[f"m_{c}"] for c in columns}, {c: row[f"s_{c}"] for c in columns}


def center_scale(df: DataFrame, means: dict, sds: dict) -> DataFrame:
    return df.withColumns({c: F.try_divide(F.col(c) - F.lit(means[c]), F.lit(sds[c]))
                           for c in means})


def category_levels(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Sorted levels per categorical column (needed to name dummy columns).

    Only distinct values travel to the driver.  A column per level is for
    categories of up to MAX_DUMMY_LEVELS levels; beyond, ``Recipe.step_indicators``
    keeps the levels in a table and the indicators in one sparse vector.
    """
    out = {}
    for c in columns:
        vals = (df.select(F.col(c).cast("string").alias("v")).where(F.col("v").isNotNull())
                .distinct().limit(MAX_DUMMY_LEVELS + 1).collect())
        if len(vals) > MAX_DUMMY_LEVELS:
            raise ValueError(f"{c} has more than {MAX_DUMMY_LEVELS} levels: use step_indicators")
        out[c] = sorted(r[0] for r in vals)
    return out


def dummy_name(column: str, level: str) -> str:
    import re
    clean = re.sub(r"[^A-Za-z0-9._]", ".", level)
    if re.match(r"^[0-9]", clean):
        clean = "X" + clean
    return f"{column}_{clean}"


def dummies(df: DataFrame, levels: dict[str, list[str]], one_hot: bool = False) -> DataFrame:
    """M8 ``step_dummy``: n-1 indicator columns (first level is the
    reference) or n with ``one_hot``; the source column is replaced."""
    out = df
    for c, lvs in levels.items():
        use = lvs if one_hot else lvs[1:]
        out = out.withColumns({dummy_name(c, lv): (F.col(c).cast("string") == lv).cast("int")
                               for lv in use}).drop(c)
    return out


QUARTILES = [0.0, 0.25, 0.5, 0.75, 1.0]


def discretize_cuts(df: DataFrame, columns: Sequence[str], cuts: int = 4,
                    min_unique: int = 1) -> DataFrame:
    """M9/M10 fit: exact quantile cut points per column, de-duplicated, outer
    ends replaced by -Inf/+Inf.  Returns ``(variable, position, cut)``.

    Columns with fewer than ``min_unique * (cuts + 1)`` distinct values are
    not binned (no rows returned for them).
    """
    from .joins import stage_table
    from .ordered import quantiles_from_counts
    from .profile import value_counts
    probs = [i / cuts for i in range(cuts + 1)]
    counts = stage_table(value_counts(df, columns).where(F.col("_v").isNotNull()), "value-counts")
    q = quantiles_from_counts(counts, probs, ["variable"], out="cut", groups_bounded=True)
    nd = counts.groupBy("variable").agg(F.count(F.lit(1)).alias("_nd"))
    q = q.join(F.broadcast(nd), "variable").where(F.col("_nd") / F.lit(cuts + 1) >= min_unique)
    # at most cuts + 1 rows a variable
    ranked = q.select("variable", "cut").distinct().withColumn(
        "position", F.row_number().over(Window.partitionBy("variable").orderBy("cut")))
    last = ranked.groupBy("variable").agg(F.max("position").alias("_last"))
    ranked = ranked.join(last, "variable")
    cut = (F.when(F.col("position") == 1, F.lit(float("-inf")))
           .when(F.col("position") == F.col("_last"), F.lit(float("inf"))).otherwise(F.col("cut")))
    return ranked.select("variable", F.col("position").cast("int").alias("position"), cut.alias("cut"))


def discretize(df: DataFrame, cuts_table: DataFrame, prefix: str = "bin") -> DataFrame:
    """M9 apply: value in (cut[i], cut[i+1]] -> ``bin<i>`` (R ``cut``,
    right-closed).  The cut table is tiny (<= cuts + 1 rows per column), so
    it is collected once and applied as a ``when`` chain in one projection."""
    by_col: dict[str, list[float]] = {}
    for r in cuts_table.orderBy("variable", "position").collect():
        by_col.setdefault(r["variable"], []).append(r["cut"])
    exprs = {}
    for c, cuts in by_col.items():
        width = len(str(len(cuts) - 1))
        x = F.col(c).cast("double")
        e = F.lit(None).cast("string")
        for i in range(len(cuts) - 1, 0, -1):
            e = F.when(x <= F.lit(cuts[i]), F.lit(f"{prefix}{str(i).zfill(width)}")).otherwise(e)
        exprs[c] = F.when(x.isNull(), F.lit(None).cast("string")).otherwise(e)
    return df.withColumns(exprs)


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.IntegerType, T.LongType, T.DoubleType, T.FloatType, T.ShortType))
