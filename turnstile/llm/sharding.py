"""Uniform shuffle into shards of exact sizes by a communication matrix.

How many rows each reading partition sends to each shard follows the
multivariate hypergeometric law whose margins are the partitions' row counts
and the shards' sizes (at most one row apart).  The matrix is drawn by
halving: a node holds a range of partitions and its counts per shard; the left half's
share is drawn shard after shard, each conditional on what is left.  Rows are
permuted within their partition, cut by the partition's counts, exchanged,
and permuted again within the shard.

Defined results: a null text counts as empty; rows with equal or null ids and
repeated rows are rows like any other; other columns are not read; an empty
table gives an empty result.  The draw is fixed by the seed and by the
partitions that the table is read in.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .draws import hypergeometric, uniform
from .ranks import running_sum
from .workspace import Workspace

SHARDS = 24
SEED = 20_240_601
#: Levels of the halving that one plan holds.
LEVELS = 6


def _left_half(counts: Column, rows: Column, left_rows: Column, node: Column, seed: int) -> Column:
    """Counts per shard of the left half: ``left_rows`` of the node's ``rows`` rows."""
    big = lambda n: F.lit(n).cast("bigint")
    start = F.struct(F.array().cast("array<bigint>").alias("out"), rows.alias("rest"), left_rows.alias("draws"))

    def step(a: Column, x: Column) -> Column:
        drawn = hypergeometric(a["rest"], x, a["draws"], uniform(F.lit(seed), node, F.size(a["out"])))
        # computed once per shard, then used three times
        return F.transform(F.array(drawn), lambda d: F.struct(
            F.concat(a["out"], F.array(d)).alias("out"), (a["rest"] - x).alias("rest"), (a["draws"] - d).alias("draws")))[0]

    return F.aggregate(counts, F.struct(start["out"].alias("out"), (rows + big(0)).alias("rest"), (left_rows + big(0)).alias("draws")),
                       step, lambda a: a["out"])


def communication_matrix(parts: DataFrame, work: Workspace, sizes: list[int], seed: int) -> DataFrame:
    """parts (part, n) -> (part, counts): rows that each part sends to each shard."""
    placed = work.put(parts.withColumn("i", (F.row_number().over(Window.orderBy("part")) - 1).cast("bigint")), "parts")
    number = placed.count()
    depth = max(0, math.ceil(math.log2(max(1, number))))
    rows = placed.select(F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"), "i", "n").select(
        "level", F.expr(f"shiftright(i, {depth} - level)").alias("node"), "n").groupBy("level", "node").agg(F.sum("n").alias("rows"))
    rows = work.put(rows, "rows-of-nodes")
    nodes = placed.sparkSession.range(1).select(
        F.lit(0).cast("bigint").alias("node"), F.lit(sum(sizes)).cast("bigint").alias("rows"),
        F.array(*[F.lit(s).cast("bigint") for s in sizes]).alias("counts"))
    for level in range(1, depth + 1):
        left = rows.where((F.col("level") == level) & (F.col("node") % 2 == 0)).select(
            F.shiftright("node", 1).alias("node"), F.col("rows").alias("left_rows"))
        met = nodes.join(left, "node").select(
            "node", "rows", "counts", "left_rows",
            _left_half(F.col("counts"), F.col("rows"), F.col("left_rows"), F.concat(F.lit(f"{level}/"), F.col("node")), seed).alias("left"))
        nodes = met.select(F.explode(F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("left_rows").alias("rows"), F.col("left").alias("counts")),
            F.struct((F.col("node") * 2 + 1).alias("node"), (F.col("rows") - F.col("left_rows")).alias("rows"),
                     F.zip_with("counts", "left", lambda a, b: a - b).alias("counts")))).alias("x")).select("x.*").where("rows > 0")
        if level % LEVELS == 0:
            nodes = work.put(nodes, f"nodes-{level}")
    matrix = placed.join(nodes.withColumnRenamed("node", "i"), "i").select("part", "counts")
    return work.put(matrix, "matrix")


def shard(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per row of ``df``: id, size, text_crc32, law, shard, slot, grown_shard."""
    work = Workspace(df.sparkSession, "sharding")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = work.put(df.select(
        F.col(id_col).alias("id"),
        F.when(F.col(text_col).isNull(), F.lit(8)).otherwise(F.octet_length(text_col) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().alias("rid")), "rows")
    total = rows.count()
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix(rows.groupBy("part").agg(F.count("*").alias("n")), work, sizes, seed)
    first = F.row_number().over(Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed), F.lit("first"), "rid"), "rid")) - 1
    sent = rows.withColumn("place", first).join(matrix, "part")
    reached = F.aggregate("counts", F.struct(F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("sum")), lambda a, n: F.struct(
        (a["shard"] + F.when(a["sum"] + n <= F.col("place"), 1).otherwise(0)).alias("shard"), (a["sum"] + n).alias("sum")), lambda a: a["shard"])
    dealt = work.put(sent.select("id", "size", "text_crc32", "rid", reached.alias("shard")), "dealt")
    second = [F.xxhash64(F.lit(seed), F.lit("second"), "rid"), F.col("rid")]
    out = running_sum(dealt, "shard", second, F.lit(1).cast("bigint"), "slot", total)
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                      F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
