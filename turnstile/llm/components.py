"""Connected components of a link table by alternating stars.

Each round points every vertex's larger neighbours at the least vertex near
it (large star), then its smaller neighbours (small star); components become
stars in a number of rounds that grows with the logarithm of their diameter.
Minima are taken with map-side aggregation and joined back, so that no
vertex's neighbours meet in one list; a vertex with very many links is a
skewed join, which Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (u, v), both ways for the large star, v < u for the small one."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = links.join(least, "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame, work: Workspace) -> DataFrame:
    """links (a, b) -> (vertex, root): the least vertex reachable, for each vertex but the roots."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = work.put(edges, "links-0")
    size = None
    for turn in range(1, 200):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearer = work.put(_star(both, large=True), f"large-{turn}")
        nxt = work.put(_star(nearer, large=False), f"links-{turn}")
        row = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
        work.drop(f"large-{turn}", f"links-{turn - 1}")
        edges = nxt
        if tuple(row) == size:
            # a fixed point: every vertex has one link, and it leads to a root
            return edges.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
        size = tuple(row)
    raise RuntimeError("the components did not settle")
