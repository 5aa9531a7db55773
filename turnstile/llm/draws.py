"""Random counts as Column expressions: binomial and hypergeometric draws.

Both walk the window of twelve standard deviations around the mode with the
ratio of neighbouring probabilities, once for the sum and once for the draw,
so that the counts follow the law to double precision and cost a number of
steps that grows with the standard deviation only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*key: Column | str) -> Column:
    """A number in (0, 1) fixed by ``key``."""
    return (F.shiftrightunsigned(F.xxhash64(*key), 12).cast("double") + 0.5) / F.lit(float(1 << 52))


def _invert(u: Column, low: Column, high: Column, ratio: Callable[[Column], Column]) -> Column:
    """The draw from ``low``..``high`` whose neighbours' ratio p(k+1)/p(k) is ``ratio(k)``."""
    steps = F.when(high > low, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>"))
    total = F.aggregate(
        steps, F.struct(F.lit(1e-200).alias("p"), F.lit(1e-200).alias("s")),
        lambda a, k: F.struct((a["p"] * ratio(k)).alias("p"), (a["s"] + a["p"] * ratio(k)).alias("s")), lambda a: a["s"])
    # the draw is low plus the number of steps whose cumulated mass lies under u times the sum
    return F.aggregate(
        steps, F.struct(F.lit(1e-200).alias("p"), F.lit(1e-200).alias("s"), low.alias("at"), (u * total).alias("aim")),
        lambda a, k: F.struct((a["p"] * ratio(k)).alias("p"), (a["s"] + a["p"] * ratio(k)).alias("s"),
                              F.when(a["s"] < a["aim"], k + 1).otherwise(a["at"]).alias("at"), a["aim"].alias("aim")),
        lambda a: a["at"])


def _window(mode: Column, variance: Column, low: Column, high: Column) -> tuple[Column, Column]:
    reach = F.ceil(F.sqrt(F.greatest(variance, F.lit(0.0))) * 12 + 12).cast("bigint")
    return F.greatest(low, mode - reach), F.least(high, mode + reach)


def binomial(n: Column, p: Column, u: Column) -> Column:
    """Successes in ``n`` trials of probability ``p``."""
    low, high = _window(F.floor((n + 1) * p).cast("bigint"), n * p * (1 - p), F.lit(0).cast("bigint"), n)
    drawn = _invert(u, low, F.greatest(low, high), lambda k: (n - k) / (k + 1) * (p / (1 - p)))
    return F.when((n <= 0) | (p <= 0), F.lit(0).cast("bigint")).when(p >= 1, n).otherwise(drawn)


def hypergeometric(population: Column, marked: Column, draws: Column, u: Column) -> Column:
    """Marked items among ``draws`` taken from ``population`` without replacement."""
    low = F.greatest(F.lit(0).cast("bigint"), draws - (population - marked))
    high = F.least(marked, draws)
    share = marked / population
    mode = F.floor((draws + 1).cast("double") * (marked + 1) / (population + 2)).cast("bigint")
    spread = draws * share * (1 - share) * (population - draws) / F.greatest(population - 1, F.lit(1))
    start, end = _window(mode, spread, low, high)
    ratio = lambda k: ((marked - k).cast("double") * (draws - k)) / ((k + 1).cast("double") * (population - marked - draws + k + 1))
    drawn = _invert(u, start, F.greatest(start, end), ratio)
    return F.when((population <= 0) | (high <= low), low).otherwise(drawn)
