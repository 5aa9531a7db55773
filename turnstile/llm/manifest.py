"""Merkle manifest of a table by slot pivots.

Each row is a leaf: the digest of its columns.  The leaves of a group, in the
order of their ids, are hashed in runs of ``fanout`` until one node remains,
the group's subroot; the subroots, in the order of the groups, are hashed in
the same way to the root.

A pass over a level groups the nodes by the ancestor ``LEVELS`` levels up and
spreads them by conditional aggregates into slot columns, ``fanout`` to a
parent; concatenating a parent's columns hashes it, and leaving out the own
slot's column gives the siblings.  A pass thus shuffles a level's nodes once
and leaves ``fanout ** -LEVELS`` of them.  On the way down, an ancestor's
siblings are joined once to each block of nodes below it, not to each leaf.

Positions come from a range partitioning that is written once: row numbers
within (range, group), and the counts of the ranges before it, so that no
group has to fit a task.

Defined results: a null is hashed as ``-``; leaves with a null id come first;
leaves of one id stand in the order of their digests, so repeated rows give the
same tree in any order; a null group is a group of its own and stands first; a
lone node of a level with more than one node is hashed alone; the proof of a
table of one row is the digest of nothing; an empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .workspace import Workspace

FANOUT = 2
#: Levels that one pass folds.
LEVELS = 3


def encode(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def positions(rows: DataFrame, work: Workspace, name: str, group: str, order: Sequence[str]) -> DataFrame:
    """Adds ``at`` (from 0, in ``order``) and ``total`` within ``group`` (not null)."""
    keys = [group, *order]
    ranged = work.put(rows.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()), name)
    sizes = ranged.groupBy(F.col("__range").alias("__of"), F.col(group).alias("__group")).agg(F.count("*").alias("__n"))
    whole = Window.partitionBy("__group")
    earlier = whole.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__of", "__group", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"),
                         F.sum("__n").over(whole).alias("total"))
    within = F.row_number().over(Window.partitionBy("__range", group).orderBy(*order))
    met = ranged.withColumn("__within", within).join(
        sizes, (F.col("__range") == F.col("__of")) & (F.col(group) == F.col("__group")))
    return met.select(*rows.columns, (F.col("__before") + F.col("__within") - 1).alias("at"), "total")


class Tree:
    """Hash trees of all groups of ``nodes`` (group, at, total, node), where
    node is a struct with a field ``digest``; passes are written, lowest first."""

    def __init__(self, nodes: DataFrame, work: Workspace, name: str, fanout: int = FANOUT, levels: int = LEVELS) -> None:
        self.work, self.name, self.fanout, self.levels = work, name, fanout, levels
        self.width = fanout ** levels
        most = nodes.agg(F.max("total")).first()[0] or 1
        self.passes: list[DataFrame] = []
        while not self.passes or most > 1:
            self.passes.append(work.put(self._pivot(nodes), f"{name}-{len(self.passes)}"))
            folded, tops = self._fold(self.passes[-1])
            nodes = folded.select("group", F.col("block").alias("at"), F.col(f"total{levels}").alias("total"),
                                  F.struct(tops[0].alias("digest")).alias("node"))
            most = -(-most // self.width)
        #: One row per group that has one node left: (group, digest).
        self.roots = work.put(nodes.select("group", F.col("node.digest").alias("digest")), f"{name}-roots")

    def _pivot(self, nodes: DataFrame) -> DataFrame:
        slot = F.pmod("at", F.lit(self.width))
        return nodes.groupBy("group", F.floor(F.col("at") / self.width).cast("long").alias("block")).agg(
            F.max("total").alias("total0"),
            *[F.max(F.when(slot == s, F.col("node"))).alias(f"slot{s}") for s in range(self.width)])

    def _fold(self, blocks: DataFrame) -> tuple[DataFrame, list[Column]]:
        """Columns ``node{level}_{place}`` and ``total{level}`` of every level of the blocks."""
        rows = blocks.withColumns({f"node0_{s}": F.col(f"slot{s}.digest") for s in range(self.width)})
        for level in range(self.levels):
            total = F.col(f"total{level}")
            parents = {}
            for place in range(self.fanout ** (self.levels - level - 1)):
                kids = self._kids(level, place)
                parents[f"node{level + 1}_{place}"] = F.when(
                    (total > 1) & kids[0].isNotNull(), F.sha2(F.concat_ws("", *kids), 256)).otherwise(kids[0])
            rows = rows.withColumns(parents | {f"total{level + 1}": F.ceil(total / self.fanout)})
        return rows, [F.col(f"node{self.levels}_0")]

    def _kids(self, level: int, place: int) -> list[Column]:
        return [F.col(f"node{level}_{place * self.fanout + k}") for k in range(self.fanout)]

    def _path(self, slot: int) -> Column:
        """Per level that is hashed, from the lowest: the siblings before and after the slot's node."""
        steps = []
        for level in range(self.levels):
            place = slot // self.fanout ** level
            kids, own = self._kids(level, place // self.fanout), place % self.fanout
            steps.append(F.when(F.col(f"total{level}") > 1, F.struct(
                F.concat_ws("", *kids[:own]).alias("before"), F.concat_ws("", *kids[own + 1:]).alias("after"))))
        return F.array_compact(F.array(*steps))

    def paths(self, above: DataFrame) -> DataFrame:
        """``above`` (group, path, ...): what stands above each group's root.
        Returns per lowest node: group, the node's fields, path from the node up, and the other columns."""
        carried = [c for c in above.columns if c not in ("group", "path")]
        over = above.withColumn("at", F.lit(0).cast("long"))
        for depth in range(len(self.passes) - 1, -1, -1):
            folded, _ = self._fold(self.passes[depth])
            met = folded.join(over.withColumnRenamed("at", "block"), ["group", "block"])
            slots = F.array(*[F.struct(F.lit(s).alias("slot"), F.col(f"slot{s}").alias("node"), self._path(s).alias("steps"))
                              for s in range(self.width)])
            each = met.select("group", "block", "path", *carried, F.explode(F.filter(slots, lambda x: x["node"].isNotNull())).alias("of"))
            over = each.select("group", (F.col("block") * self.width + F.col("of.slot")).alias("at"),
                               F.concat("of.steps", "path").alias("path"), "of.node", *carried)
            if depth:
                over = self.work.put(over.drop("node"), f"{self.name}-above-{depth}")
        return over.select("group", "node.*", "path", *carried)


class Manifest:
    """The manifest of one table; ``proofs`` checks rows against the root.

    ``columns`` are hashed in this order; ``claimed`` replaces columns by other
    expressions in the rows that are to be checked.
    """

    def __init__(self, df: DataFrame, columns: Sequence[str], id_col: str = "doc_id", group_col: str = "lang",
                 claimed: Mapping[str, Column] | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> None:
        self.work = work = Workspace(df.sparkSession, "manifest")
        self.id_col = id_col
        claimed = claimed or {}
        own = {c: encode(F.col(c)) for c in columns}
        other = own | {c: encode(e) for c, e in claimed.items()}
        differs = F.lit(False)
        for c in claimed:
            differs = differs | (other[c] != own[c])
        rows = df.select(
            encode(F.col(group_col)).alias("group"), F.col(group_col).alias("key"), F.col(id_col).alias("id"),
            digest(*[own[c] for c in columns]).alias("digest"),
            F.when(differs, digest(*[other[c] for c in columns])).alias("claim"), F.monotonically_increasing_id().alias("row"))
        rows = work.put(rows, "rows")
        leaves = positions(rows.drop("key"), work, "leaves", "group", ["id", "digest", "row"])
        self.tree = Tree(leaves.select("group", "at", "total", F.struct("digest", "id", "claim").alias("node")), work, "tree",
                         fanout, levels)
        # the groups' subroots are the leaves of the last tree
        keys = rows.groupBy("group").agg(F.max("key").alias("key"))
        subroots = self.tree.roots.join(keys, "group").withColumn("all", F.lit(""))
        placed = positions(subroots, work, "subroots", "all", ["key"])
        self.top = Tree(placed.select(F.col("all").alias("group"), "at", "total", F.struct("digest", F.col("group").alias("of")).alias("node")),
                        work, "top", fanout, levels)
        work.drop("rows")

    def root(self) -> str | None:
        """The table's root digest (None for an empty table)."""
        found = self.top.roots.first()
        return found and found["digest"]

    def proofs(self) -> DataFrame:
        """One row per row: id, leaf, subroot, root, proof_sha256, folded_root, verified, proof
        (the siblings before and after each level's node)."""
        none = F.array().cast("array<struct<before:string,after:string>>")
        upper = self.top.paths(self.top.roots.select("group", none.alias("path"), F.col("digest").alias("root")))
        upper = self.work.put(upper.select(F.col("of").alias("group"), "path", F.col("digest").alias("subroot"), "root"), "groups")
        found = self.tree.paths(upper)
        siblings = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
        folded = F.aggregate("path", F.coalesce("claim", "digest"), lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))
        return found.select(
            F.col("id").alias(self.id_col), F.col("digest").alias("leaf"), "subroot", "root",
            F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"), F.col("path").alias("proof")).withColumn(
            "verified", F.col("folded_root") == F.col("root"))
