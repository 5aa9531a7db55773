"""Quality rules with robust multivariate outliers.

Plain counts of each whole text give the base rules and a vector of
transformed statistics (shares of words, smoothed so that short texts stay
near the middle).  Per language and source, the minimum covariance
determinant estimate of centre and covariance is sought by concentration
steps: from three robust starts, the half (``H``) of the rows nearest to the estimate
gives the next estimate until the determinant falls no more; the start with
the least determinant wins.  A row is rejected
when its squared Mahalanobis distance exceeds the chi-square quantile.

Half is the most robust share: copies of one text, or other junk, may hold
nearly half of a group.  Distances are ordered by fine bins, so a step is two aggregations with
map-side sums and its rows never meet in one task; the rows of the subset's last bin
weigh what the share still lacks, so equal rows don't enter all at once.
Rows that fail the base rules don't take part in
the estimates.  A group of fewer than ``MIN_ROWS`` rows joins its
language's small groups, those the pool of all small groups; if that is
small too, its rows are judged by the estimate of their whole language, or,
if even that is small, of the whole table.

Defined results: a null text has no words (and fails the base rules); null
languages and sources are groups of their own; repeated rows and ids keep one row each;
other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .workspace import Workspace

H = 0.5
MIN_ROWS = 60
#: Fall of the logarithm of the determinant that is worth another step.
FALL = 1e-6
#: Share of well-behaved rows that the cut lets go.
ALPHA = 1e-9
#: Standard deviations below which a statistic isn't told apart.
FLOORS = (0.06, 0.35, 0.35, 0.08)
#: Words added to every text, at the usual length and with nothing odd.
PRIOR_WORDS, PRIOR_LENGTH = 40, 5.5
P = len(FLOORS)
_STARTS = 3


def base_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` without its text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    keep = [c for c in df.columns if c != text_col]
    word = r"[^\\x20\\x09-\\x0D]+"
    one = df.select(*keep, F.coalesce(text_col, F.lit("")).alias("__text"))
    one = one.withColumn("__words", F.expr(f"regexp_extract_all(__text, '{word}', 0)"))
    two = one.select(
        *keep, F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.expr("regexp_count(__text, '[#*$%&|<>]')").cast("long").alias("n_symbols"),
        F.expr(f"filter(split(__text, '\\n', -1), l -> l RLIKE '{word}')").alias("__lines"),
        F.expr("""CASE WHEN size(__words) >= 6 THEN transform(sequence(0, size(__words) - 5),
            i -> xxhash64(__words[i], __words[i + 1], __words[i + 2], __words[i + 3], __words[i + 4]))
            ELSE cast(array() AS array<bigint>) END""").alias("__windows"))
    three = two.withColumn("__sorted", F.expr("""CASE WHEN size(array_distinct(__windows)) < size(__windows)
        THEN array_sort(transform(__windows, (h, i) -> struct(h AS h, i AS i))) END"""))
    four = three.withColumn("__again", F.expr("""array_sort(transform(filter(__sorted, (x, k) ->
        coalesce(get(__sorted, k - 1).h = x.h, false) OR coalesce(get(__sorted, k + 1).h = x.h, false)), x -> x.i))"""))
    return four.select(
        *keep, "n_words", "word_chars", "n_symbols",
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.expr("""coalesce(aggregate(__again, struct(0 AS n, -5 AS last),
            (a, i) -> struct(a.n + least(5, i - a.last) AS n, i AS last), a -> a.n), 0)""").cast("long").alias("n_repeat_words"))


def _vector() -> list[Column]:
    words = F.col("n_words") + PRIOR_WORDS
    return [F.log((F.col("word_chars") + PRIOR_WORDS * PRIOR_LENGTH) / words), F.log1p(100.0 * F.col("n_symbols") / words),
            F.log1p(100.0 * F.col("n_dup_lines") / words), F.sqrt(F.col("n_repeat_words") / words)]


def chi_square(x: float, p: int) -> float:
    """P(chi-square with ``p`` degrees, ``p`` even, is at most ``x``)."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(p // 2))


def chi_square_quantile(q: float, p: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, p) < q else (low, mid)
    return low


def _quantile_bins(binned: DataFrame, keys: list[str], share: float) -> DataFrame:
    """(keys, bin): the least bin up to which a group has ``share`` of its rows."""
    counts = binned.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy(*keys).orderBy("bin")
    summed = counts.withColumns({"upto": F.sum("n").over(ahead), "all": F.sum("n").over(Window.partitionBy(*keys))})
    return summed.where(F.col("upto") >= F.ceil(F.col("all") * F.lit(share))).groupBy(*keys).agg(F.min("bin").alias("cut"))


def _centres(rows: DataFrame, values: list[Column], name: str) -> DataFrame:
    """Medians per group of the columns, by bins of 1/512: (grp, name1, ...)."""
    tall = rows.select("grp", F.posexplode(F.array(*[F.round(v * 512).cast("long") for v in values])).alias("c", "bin"))
    cut = _quantile_bins(tall, ["grp", "c"], 0.5)
    return cut.groupBy("grp").agg(*[F.max(F.when(F.col("c") == i, F.col("cut") / 512.0)).alias(f"{name}{i}") for i in range(P)])


def _subset(binned: DataFrame, keys: list[str], share: float) -> DataFrame:
    """(keys, cut, part): the bin in which the subset ends, and the weight of that bin's rows."""
    counts = binned.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy(*keys).orderBy("bin")
    summed = counts.withColumns({"upto": F.sum("n").over(ahead), "all": F.sum("n").over(Window.partitionBy(*keys))})
    need = F.least("all", F.greatest(F.ceil(F.col("all") * F.lit(share)), F.floor((F.col("all") + P + 1) / 2)))
    ends = summed.withColumn("need", need).where("upto >= need").withColumn("part", F.expr("(need - upto + n) / n"))
    return ends.groupBy(*keys).agg(F.min(F.struct("bin", "part")).alias("e")).select(
        *keys, F.col("e.bin").alias("cut"), F.col("e.part").alias("part"))


def _estimate(chosen: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """Mean and Cholesky factor of the (scaled, floored) covariance of rows with weight w, per group."""
    pairs = [(i, j) for i in range(P) for j in range(i + 1)]
    mean = lambda v: F.sum(F.col("w") * v) / F.sum("w")
    sums = chosen.groupBy(*keys).agg(
        *[mean(F.col(f"x{i}")).alias(f"m{i}") for i in range(P)],
        *[mean(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"c{i}{j}") for i, j in pairs])
    sums = sums.withColumns({f"c{i}{j}": F.col(f"c{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}") for i, j in pairs})
    out = sums.withColumns({f"c{i}{j}": F.col(f"c{i}{j}") * factor + (FLOORS[i] ** 2 if i == j else 0.0) for i, j in pairs})
    for i in range(P):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}"))
    det = F.lit(0.0)
    for i in range(P):
        det = det + 2 * F.log(f"l{i}{i}")
    return out.select(*keys, *[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i, j in pairs], det.alias("log_det"))


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    solved: list[Column] = []
    for i in range(P):
        y = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            y = y - F.col(f"l{i}{k}") * solved[k]
        solved.append(y / F.col(f"l{i}{i}"))
    total = F.lit(0.0)
    for y in solved:
        total = total + y * y
    return total


def minimum_covariance(rows: DataFrame, work: Workspace, h: float = H) -> DataFrame:
    """rows (grp, x0...) -> one estimate per group."""
    xs = [F.col(f"x{i}") for i in range(P)]
    medians = work.put(_centres(rows, xs, "a"), "medians")
    met = rows.join(medians, "grp")
    spreads = work.put(_centres(met, [F.abs(F.col(f"x{i}") - F.col(f"a{i}")) for i in range(P)], "s"), "spreads")
    z = [F.abs(F.col(f"x{i}") - F.col(f"a{i}")) / F.greatest(F.col(f"s{i}") * 1.4826, F.lit(FLOORS[i])) for i in range(P)]
    squares, plain = F.lit(0.0), F.lit(0.0)
    for v in z:
        squares, plain = squares + v * v, plain + v
    starts = met.join(spreads, "grp").select("grp", *xs, F.posexplode(F.array(squares, plain, F.greatest(*z))).alias("start", "d"))
    middle = chi_square_quantile(h, P)
    factor = h / chi_square(middle, P + 2)
    keys = ["grp", "start"]

    def concentrate(near: DataFrame, step: int) -> DataFrame:
        binned = near.withColumn("bin", F.floor(F.log1p("d") * 128))
        met = binned.join(_subset(binned.select(*keys, "bin"), keys, h), keys).where("bin <= cut")
        chosen = met.withColumn("w", F.when(F.col("bin") < F.col("cut"), F.lit(1.0)).otherwise(F.col("part")))
        return work.put(_estimate(chosen, keys, factor), f"estimate-{step}")

    found = falling = concentrate(starts, 0)
    spread = rows.select("grp", *xs, F.explode(F.sequence(F.lit(0), F.lit(_STARTS - 1))).alias("start"))
    step = 0
    while not falling.isEmpty():
        step += 1
        tried = concentrate(spread.join(falling, keys).select(*keys, *xs, _distance().alias("d")), step)
        before = found.select(*keys, F.col("log_det").alias("before"))
        falling = work.put(tried.join(before, keys).where(F.col("log_det") < F.col("before") - FALL).drop("before"), f"falling-{step}")
        found = work.put(falling.unionByName(found.join(falling, keys, "left_anti")), f"found-{step}")
    best = Window.partitionBy("grp").orderBy(F.round("log_det", 9), "start")
    return found.withColumn("k", F.row_number().over(best)).where("k = 1").drop("k", "start")


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
            alpha: float = ALPHA, min_rows: int = MIN_ROWS) -> DataFrame:
    """One row per row of ``df``: id, the base counts, base_failed, kept, distance, grp."""
    work = Workspace(df.sparkSession, "quality")
    slim = df.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    stats = base_statistics(slim, "text").withColumn("base_failed", failed)
    stats = work.put(stats.withColumns({f"x{i}": v for i, v in enumerate(_vector())}), "statistics")
    # groups too small to estimate: of the language, then of all; what is left asks its whole language, then the table
    sizes = stats.where("not base_failed").groupBy("lang", "source").agg(F.count("*").alias("n"))
    of_lang = Window.partitionBy("lang")
    named_by = lambda *c: F.to_json(F.array(*c), {"ignoreNullFields": "false"})
    own = F.when(F.col("n") >= min_rows, named_by("lang", "source"))
    pooled = sizes.withColumn("own", own).withColumns({
        "small": F.sum(F.when(F.col("own").isNull(), F.col("n"))).over(of_lang), "whole": F.sum("n").over(of_lang)})
    lang = F.when(F.col("small") >= min_rows, named_by("lang"))
    named = work.put(pooled.select("lang", "source", "n", "whole", F.coalesce("own", lang).alias("grp")), "sizes")
    rest = named.where("grp IS NULL").agg(F.sum("n")).first()[0] or 0
    wider = F.when(F.lit(rest >= min_rows), F.lit("rest")).when(
        F.col("whole") >= min_rows, F.concat(F.lit("all of "), named_by("lang"))).otherwise(F.lit("all"))
    asked = named.withColumns({"joins": F.coalesce("grp", F.lit("rest" if rest >= min_rows else None)), "grp": F.coalesce("grp", wider)})
    # the estimates that a row enters: its own group's and the wider ones that some row asks for
    asked = asked.withColumns({
        "of_lang": F.max(F.when(F.col("grp").startswith("all of "), F.col("grp"))).over(of_lang),
        "of_all": F.lit("all" if not asked.where("grp = 'all'").isEmpty() else None)})
    groups = work.put(asked.select(F.col("lang").alias("l"), F.col("source").alias("s"), "grp", F.expr(
        "filter(array(joins, of_lang, of_all), g -> g IS NOT NULL)").alias("enters")), "groups")
    rows = stats.join(groups, stats["lang"].eqNullSafe(groups["l"]) & stats["source"].eqNullSafe(groups["s"]), "left").drop("l", "s")
    estimates = minimum_covariance(
        rows.where("NOT base_failed").select(F.explode("enters").alias("grp"), *[f"x{i}" for i in range(P)]), work)
    limit = chi_square_quantile(1 - alpha, P)
    judged = rows.join(estimates, "grp", "left").withColumn("distance", _distance())
    return judged.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(F.col("distance") <= limit, F.lit(False))).alias("kept"), "distance", "grp")
