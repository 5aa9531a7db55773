"""Mixing sources to target weights by blocks.

Every source's words, its documents one after another in a fixed
pseudorandom order, are packed into blocks of ``BLOCK`` words.  A source's
target is turned into a number of block slots; a multinomial draw spreads
them over the output shards.  A slot's number within its source goes through a
pseudorandom permutation of the source's whole blocks (a new one for each time
round; the words left over make a short block, which ends each round), and
blocks are joined by index: no block comes twice before all came once, and none
more than twice, since no target exceeds twice its source.  The last slot takes
only the words that are still missing, so that a source of any size meets its target to the word.

Defined results: a null text has no words; a null source is a source of its
own, last in order; texts without words have nothing to take; rows with equal or null ids and repeated
rows are rows like any other; an empty table gives an empty result; other columns are
not read but by ``mixed_rows``, which returns them.  Everything is fixed by the seed and the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .draws import binomial, uniform
from .ranks import BUCKET_ROWS, running_sum
from .workspace import Workspace

BLOCK = 32
SHARDS = 64
SEED = 7_919
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
#: Rounds of the permutation, and steps that bring an index back in range.
ROUNDS = 4
WALK = 64
#: Slots that are numbered from one row, and slots of a task.
RUN = 4096
TASK_SLOTS = 250_000

WORD = r"[^\\x20\\x09-\\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """sizes (source, source_size) -> with weight and target.

    Capped proportional shares: with sources in order of size per weight, the
    first ones stop at ``cap`` times their size, and the level of the others follows from what is left.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    given = sizes.withColumn("weight", F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    all_of_it = Window.partitionBy()
    full = F.col("source_size") * float(cap)
    ratio = given.withColumns({"full": full, "ratio": full / F.col("weight"), "wanted": F.sum("source_size").over(all_of_it) * share})
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    later = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # the level if all before this one stop and none from here on does
    tried = ratio.withColumns({
        "level": (F.col("wanted") - F.coalesce(F.sum("full").over(earlier), F.lit(0.0))) / F.sum("weight").over(later)})
    fits = tried.withColumn("first", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(all_of_it))
    return fits.select("source", "source_size", "weight", F.least("full", F.col("weight") * F.coalesce(F.col("first.level"), F.lit(float("inf")))).alias("target"))


def permutation(df: DataFrame, k: str, n: str, key: list[str], out: str) -> DataFrame:
    """Adds ``out``: where the permutation of 0..n-1 chosen by ``key`` takes ``k``.

    The numbers lie on a grid of about n cells; a round shifts the row by a
    hash of the column, then the column by a hash of the row, and each shift
    can be undone.  A cell beyond n (at most side - 1 are) is taken through the rounds
    again until it lies within.
    """
    whole = df.columns
    at = df.withColumn("__side", F.greatest(F.lit(1), F.ceil(F.sqrt(F.col(n).cast("double")))).cast("bigint"))
    at = at.withColumn("__other", F.greatest(F.lit(1), F.ceil(F.col(n) / F.col("__side"))).cast("bigint"))
    at = at.withColumns({"__row": F.expr(f"`{k}` DIV __other"), "__col": F.expr(f"`{k}` % __other")})
    names = ", ".join(f"`{c}`" for c in key)
    step = {"__row": "(__row + pmod(xxhash64({0}, {1}, __col), __side)) % __side",
            "__col": "(__col + pmod(xxhash64({0}, {1}, __row), __other)) % __other"}
    for r in range(ROUNDS):
        at = at.withColumn("__row", F.expr(step["__row"].format(names, 2 * r)))
        at = at.withColumn("__col", F.expr(step["__col"].format(names, 2 * r + 1)))
    at = at.withColumn("__cell", F.expr("__row * __other + __col"))
    again = "y"
    for r in range(ROUNDS):
        again = f"""transform(array({again}), z -> (z DIV __other + pmod(xxhash64({names}, {2 * r}, z % __other), __side)) % __side
            * __other + z % __other)[0]"""
        again = f"""transform(array({again}), z -> (z DIV __other) * __other
            + (z % __other + pmod(xxhash64({names}, {2 * r + 1}, z DIV __other), __other)) % __other)[0]"""
    walked = f"aggregate(sequence(1, {WALK}), __cell, (y, i) -> CASE WHEN y < `{n}` THEN y ELSE {again} END)"
    return at.withColumn(out, F.expr(f"CASE WHEN __cell < `{n}` THEN __cell ELSE {walked} END")).select(
        *(c for c in whole if c != out), out)


class Mix:
    """One run: ``report()`` per row, ``mixed_rows()`` the mixture itself."""

    def __init__(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                 carry: bool = False, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP,
                 block: int = BLOCK, shards: int = SHARDS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS) -> None:
        self.work = work = Workspace(df.sparkSession, "mixing")
        self.columns, self.text_col = df.columns, text_col
        size = F.coalesce(F.expr(f"regexp_count(`{text_col}`, '{WORD}')"), F.lit(0)).cast("long")
        made = {"__rid": F.monotonically_increasing_id(), "__id": F.col(id_col), "__size": size, "__source": F.col(source_col),
                # rows that share an id are told apart by their text
                "__mark": F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))}
        marked = df.withColumns(made)
        self.rows = rows = work.put(marked if carry else marked.select(*made), "rows")
        head = rows.select("__rid", "__id", "__size", "__source", "__mark")
        sizes = head.groupBy(F.col("__source").alias("source")).agg(F.sum("__size").alias("source_size"))
        level = targets(sizes, weights, share, cap)
        # whole blocks, slots of a round, rounds, and words of the last round
        plan = level.withColumns({"blocks": F.expr(f"source_size DIV {block}"), "goal": F.round("target").cast("bigint")})
        plan = plan.withColumns({"per": F.expr(f"blocks + int(source_size % {block} > 0)"),
                                 "turns": F.expr("if(source_size > 0, goal DIV source_size, 0L)"),
                                 "rest": F.expr("if(source_size > 0, goal % source_size, 0L)")})
        slots = F.col("turns") * F.col("per") + F.least(F.col("per"), F.ceil(F.col("rest") / float(block)).cast("bigint"))
        # a source is known by its place in code point order from here on
        place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
        self.sources = work.put(plan.withColumns({"slots": slots, "s": place}), "sources")
        source = self.sources.select("s", F.col("source").alias("__name"), "blocks")
        known = head.join(source, head["__source"].eqNullSafe(source["__name"])).select("s", "__rid", "__mark", "__size", "__id")
        known = work.put(known, "known")
        # row ids depend on how the input was split: they only tell equal rows apart
        placed = running_sum(known, "s", ["__mark", "__id"], F.col("__size"), "start", known.count(), bucket_rows, "__rid")
        # the stretch of each block that a document covers
        cover = placed.where("__size > 0").select("s", "__rid", "start", "__size", F.explode(F.sequence(
            F.floor(F.col("start") / block).cast("bigint"), F.floor((F.col("start") + F.col("__size") - 1) / block).cast("bigint"))).alias("block"))
        low = F.greatest(F.col("start"), F.col("block") * block)
        high = F.least(F.col("start") + F.col("__size"), (F.col("block") + 1) * block)
        self.cover = cover.select("s", "block", "__rid", (low - F.col("start")).alias("at"), (high - low).alias("words"),
                                  (low - F.col("block") * block).alias("ahead"))
        # multinomial: each shard in turn takes a binomial share of the slots that are left
        dealt = F.aggregate(
            F.sequence(F.lit(0), F.lit(shards - 1)),
            F.struct(F.col("slots").alias("left"), F.array().cast("array<bigint>").alias("counts")),
            lambda a, t: F.transform(F.array(binomial(a["left"], 1.0 / (shards - t), uniform(F.lit(seed), F.lit("shard"), F.col("source"), t))),
                                     lambda d: F.struct((a["left"] - d).alias("left"), F.concat(a["counts"], F.array(d)).alias("counts")))[0],
            lambda a: a["counts"])
        count, total = self.sources.agg(F.count("*"), F.coalesce(F.sum("slots"), F.lit(0))).first()
        spread = self.sources.where("slots > 0").repartition(max(1, count // 4), "s")
        shared = work.put(spread.select("s", "blocks", "per", "turns", "rest", F.posexplode(dealt).alias("shard", "n")), "shares")
        ahead = Window.partitionBy("s").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        numbered = shared.withColumn("first", F.coalesce(F.sum("n").over(ahead), F.lit(0))).where("n > 0")
        # a run of slots at a time to a task
        runs = numbered.select("s", "blocks", "per", "turns", "rest", "shard", (F.col("first") + F.col("n")).alias("end"),
                               F.explode(F.expr(f"sequence(first, first + n - 1, {RUN})")).alias("from"))
        runs = runs.repartition(max(1, int(total) // TASK_SLOTS), "s", "from")
        slot = runs.select("s", "blocks", "per", "turns", "rest", "shard",
                           F.explode(F.expr(f"sequence(from, least(from + {RUN}, end) - 1)")).alias("k"))
        slot = slot.select("s", "blocks", "turns", "rest", "shard", F.expr("k DIV per").alias("turn"), F.expr("k % per").alias("k"),
                           F.lit(seed).alias("seed"))
        placed = permutation(slot.where("k < blocks"), "k", "blocks", ["seed", "s", "turn"], "block").unionByName(
            slot.where("k = blocks").withColumn("block", F.col("blocks")))
        # known not to be null: the join need not compute it twice to see that
        self.slots = placed.select("s", "turn", "shard", F.coalesce("block", F.lit(-1)).alias("block"), F.when(
            F.col("turn") == F.col("turns"), F.col("rest") - F.col("k") * block).otherwise(F.lit(block)).alias("most"))

    def taken(self) -> DataFrame:
        """One row per stretch of a document that the mix takes: __rid, turn, shard, at, words."""
        # neither side is small, whatever the plan thinks of rows that are made by explode
        met = self.cover.hint("merge").join(self.slots, ["s", "block"])
        return met.withColumn("words", F.least("words", F.col("most") - F.col("ahead"))).where("words > 0").select(
            "__rid", "turn", "shard", "at", "words")

    def report(self, id_name: str = "doc_id") -> DataFrame:
        """One row per input row: id, size, source_size, target, taken."""
        sums = self.taken().groupBy("__rid").agg(F.sum("words").alias("taken"))
        level = self.sources.select(F.col("source").alias("__name"), "source_size", "target")
        rows = self.rows.select("__rid", "__id", "__size", "__source")
        return (rows.join(sums, "__rid", "left").join(level, rows["__source"].eqNullSafe(level["__name"]))
                .select(F.col("__id").alias(id_name), F.col("__size").alias("size"), "source_size", "target",
                        F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))

    def mixed_rows(self, chars_col: str | None = None) -> DataFrame:
        """The mixture: per document and turn, a row whose text is the words that this
        turn takes, with the white space after each; ``chars_col`` is counted anew."""
        parts = self.taken().groupBy("__rid", "turn").agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("__parts"))
        # neighbouring stretches are one
        joined = F.expr("""aggregate(__parts, cast(array() AS array<struct<at:bigint,words:bigint>>), (a, p) ->
            CASE WHEN size(a) > 0 AND element_at(a, -1).at + element_at(a, -1).words = p.at
            THEN concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).at AS at, element_at(a, -1).words + p.words AS words)))
            ELSE concat(a, array(struct(p.at AS at, p.words AS words))) END)""")
        met = self.rows.join(parts.withColumn("__parts", joined), "__rid")
        # words with the white space that follows; what stands before the first word goes with it
        words = F.expr(f"regexp_extract_all(`{self.text_col}`, '(?:^[\\\\x20\\\\x09-\\\\x0D]*)?{WORD}[\\\\x20\\\\x09-\\\\x0D]*', 0)")
        met = met.withColumn("__words", words)
        text = F.expr("array_join(transform(__parts, p -> array_join(slice(__words, int(p.at) + 1, int(p.words)), '')), '')")
        out = met.withColumn(self.text_col, text)
        if chars_col:
            out = out.withColumn(chars_col, F.length(self.text_col).cast("long"))
        return out.select(*self.columns)
