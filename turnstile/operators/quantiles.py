"""Exact quantiles by radix selection (A14, A16, M9, X1, P18, binned E1 and V7).

A double becomes a 64-bit number of the same order, and a quantile is found
digit by digit: a pass counts the rows by the next ``DIGIT`` bits within the
prefixes that still hold a wanted rank, and the running counts tell in which
bucket each rank lies.  All columns, groups and probabilities go through the
same passes, at most four of them; a bucket that holds one value ends its
search early.  What is shuffled is counts (at most ``2 ** DIGIT`` a prefix,
aggregated before the shuffle), never values, and nothing is sorted but the counts.
The ordered numbers are written once and the passes read them: the optimizer would
otherwise copy their formula into every filter of every pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import delete_path, scratch_path
from .joins import stage_table

DIGIT = 16
_ONE = 1 << 52  # a unit of the exponent
_INFINITE, _NAN = 2047 * _ONE, 2048 * _ONE - 1


def _two(power: Column) -> Column:
    return F.pow(F.lit(2.0), power)


def with_ordered_key(df: DataFrame, value: str, out: str) -> DataFrame:
    """Adds ``out``: a long that orders as the double ``value`` does (both zeros alike, NaN above all).

    It is the IEEE form of the absolute value, made by exact scalings with powers
    of two, with the sign of the value.
    """
    a, e, s = F.abs(F.col(value)), F.col(f"{out}_e"), F.col(f"{out}_s")
    steps = df.withColumn(f"{out}_e", F.when((a > 0) & (a < float("inf")), F.greatest(F.floor(F.log2(a)), F.lit(-1022))))
    half = F.floor(-e / 2)
    steps = steps.withColumn(f"{out}_s", a * _two(half) * _two(-e - half))

    def bits(exponent: Column, scaled: Column) -> Column:
        return exponent * _ONE + ((scaled - 1) * float(_ONE)).cast("long")

    # the logarithm may be one off next to a power of two
    normal = F.when(s >= 2, bits(e + 1024, s / 2)).when(s >= 1, bits(e + 1023, s)).otherwise(bits(e + 1022, s * 2))
    small = a * _two(F.lit(537.0)) * _two(F.lit(537.0))  # below the least normal number
    size = F.when(F.isnan(a), F.lit(_NAN)).when(a == float("inf"), F.lit(_INFINITE)).when(a == 0, F.lit(0)).when(
        a < 2.0 ** -1022, small.cast("long")).otherwise(normal).cast("long")
    return steps.withColumn(out, F.when(F.col(value) < 0, -size).otherwise(size)).drop(f"{out}_e", f"{out}_s")


def from_ordered_key(key: Column) -> Column:
    """The double of an ordered key."""
    size = F.abs(key)
    exponent, part = F.shiftright(size, 52), F.pmod(size, F.lit(_ONE))
    value = (F.when(size == _NAN, F.lit(float("nan"))).when(size == _INFINITE, F.lit(float("inf")))
             .when(exponent == 0, part.cast("double") * _two(F.lit(-537.0)) * _two(F.lit(-537.0)))
             .otherwise((F.lit(1.0) + part / F.lit(float(_ONE))) * _two(exponent - 1023)))
    return F.when(key < 0, -value).otherwise(value)


def radix_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), weight: str | None = None,
                    prob_col: str = "prob", out: str = "quantile", groups_bounded: bool = False) -> DataFrame:
    """Linear-interpolation quantiles (R type 7) of ``value`` within the groups of ``by``, as (by..., prob, quantile).

    ``weight`` counts a row as that many.  Nulls are left out; a group without
    values has no rows.  Without groups, or with ``groups_bounded`` (the caller
    vouches for a few groups, as one per column), the wanted ranks are a few rows and go
    through the driver; otherwise they are a written table.
    """
    by = list(by)
    names = [f"__g{i}" for i in range(len(by))]
    few = not by or groups_bounded
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(by, names)], F.col(value).cast("double").alias("__v"),
                     (F.col(weight) if weight else F.lit(1)).cast("long").alias("__c")).where("__v IS NOT NULL")
    spark = df.sparkSession
    keys = scratch_path(spark, "keys")
    with_ordered_key(rows, "__v", "__k").drop("__v").write.parquet(keys)
    rows = spark.read.parquet(keys)

    def fixed(wanted: DataFrame, name: str) -> DataFrame:
        return wanted.sparkSession.createDataFrame(wanted.collect(), wanted.schema) if few else stage_table(wanted, name)

    def same(left: str, right: str) -> Column:
        """Equal groups, nulls alike."""
        cond = F.lit(True)
        for n in names:
            cond = cond & F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}"))
        return cond

    def counted(kept: DataFrame, shift: int, prefix: list[str]) -> DataFrame:
        """Rows by the next digit, with the number of rows before it in the same prefix."""
        hist = kept.groupBy(*names, *prefix, F.shiftright("__k", shift).alias("__d")).agg(
            F.sum("__c").alias("__n"), F.min("__k").alias("__lo"), F.max("__k").alias("__hi"))
        part = Window.partitionBy(*names, *prefix)
        run = part.orderBy("__d").rowsBetween(Window.unboundedPreceding, 0)
        return hist.withColumns({"__before": F.sum("__n").over(run) - F.col("__n"), "__all": F.sum("__n").over(part)})

    try:
        shift = 64 - DIGIT
        hist = counted(rows, shift, [])
        at = (F.col("__all") - 1).cast("double")
        ranks = F.flatten(F.transform(F.array(*[F.lit(float(p)) for p in probs]), lambda p: F.array(*[
            F.struct(p.alias("p"), F.lit(w).alias("w"), end(at * p).cast("long").alias("r"), (at * p - F.floor(at * p)).alias("f"))
            for w, end in ((0, F.floor), (1, F.ceil))])))
        inside = F.filter(ranks, lambda t: (t["r"] >= F.col("__before")) & (t["r"] < F.col("__before") + F.col("__n")))
        wanted = hist.select(*names, "__d", "__lo", "__hi", "__before", F.explode(inside).alias("__t"))
        wanted = fixed(wanted.select(*names, F.col("__t.p").alias("__p"), F.col("__t.w").alias("__w"), F.col("__t.f").alias("__f"),
                                     (F.col("__t.r") - F.col("__before")).alias("__r"), "__d", "__lo", "__hi"), "ranks")
        found = wanted.where("__lo = __hi")
        while shift:
            left = wanted.where("__lo < __hi")
            if left.isEmpty():
                break
            prefixes = left.select(*names, F.col("__d").alias("__x")).distinct()
            prefixes = F.broadcast(prefixes) if few else prefixes
            met = rows.withColumn("__x", F.shiftright("__k", shift)).alias("a").join(
                prefixes.alias("b"), same("a", "b") & (F.col("a.__x") == F.col("b.__x")), "left_semi")
            shift -= DIGIT
            hist = counted(met, shift, ["__x"])
            placed = hist.alias("h").join((F.broadcast(left) if few else left).alias("l"), same("h", "l") & (F.col("h.__x") == F.col("l.__d"))
                                          & (F.col("l.__r") >= F.col("h.__before")) & (F.col("l.__r") < F.col("h.__before") + F.col("h.__n")))
            wanted = fixed(placed.select(*[F.col(f"l.{n}").alias(n) for n in names], "l.__p", "l.__w", "l.__f",
                                         (F.col("l.__r") - F.col("h.__before")).alias("__r"), "h.__d", "h.__lo", "h.__hi"), "ranks")
            found = found.unionByName(wanted.where("__lo = __hi"))
    finally:
        delete_path(spark, keys)  # every pass has been run
    ends = found.groupBy(*names, "__p").agg(F.max(F.when(F.col("__w") == 0, F.col("__lo"))).alias("__a"),
                                            F.max(F.when(F.col("__w") == 1, F.col("__lo"))).alias("__b"), F.max("__f").alias("__f"))
    low, high = from_ordered_key(F.col("__a")), from_ordered_key(F.col("__b"))
    return ends.select(*[F.col(n).alias(c) for c, n in zip(by, names)], F.col("__p").alias(prob_col),
                       F.when(F.col("__a") == F.col("__b"), low).otherwise(low + (high - low) * F.col("__f")).alias(out))
