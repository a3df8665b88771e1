"""Connected components of an edge table by alternating large-star and small-star rounds on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut


#: Edges from which the least neighbours are written before they are joined, so that both sides of the join are plain
#: exchanges and the edges of one hot node can be split over tasks. Below, a task holds all of them with ease.
WRITE_FROM = 2_000_000


def _least(least: DataFrame, large: bool) -> DataFrame:
    return cut(least) if large else least


def _large_star(edges: DataFrame, large: bool) -> DataFrame:
    """Every larger neighbour of a node is tied to the least node around it."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = _least(both.groupBy("src").agg(F.min("dst").alias("least")).withColumn("least", F.least("src", "least")), large)
    return both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("least").alias("dst")).where("src <> dst").distinct()


def _small_star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges point from the larger node to a smaller one: the smaller ones, and the node, are tied to the least of them."""
    least = _least(edges.groupBy("src").agg(F.min("dst").alias("least")), large)
    tied = edges.join(least, "src").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    return tied.unionByName(least.select("src", F.col("least").alias("dst"))).where("src <> dst").distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of links; component is the least node reachable. Nodes without links aren't returned.

    Rounds go on until the edge table, a set of stars by then, no longer changes: about the square of the logarithm of the
    longest chain, and no result is returned before. No link or label leaves the executors; the driver sees a count and a
    checksum a round. Nulls and loops are dropped, repeated links are one.
    """
    edges = links.select(F.greatest(a, b).alias("src"), F.least(a, b).alias("dst")).where("src is not null and dst is not null and src <> dst").distinct()
    edges = cut(edges)
    seen, large = None, edges.count() >= WRITE_FROM
    while True:
        edges = cut(_small_star(_large_star(edges, large), large))
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("s")).first()
        if (now["n"], now["s"]) == seen or not now["n"]:
            break
        seen = (now["n"], now["s"])
    roots = edges.select(F.col("dst").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(roots)
