"""Removal of near-duplicates inside time windows.

Rows of one identity that are close in time and look alike are linked; links chain, so a group can be longer than the
window. The pair join is an equi-join on stretches of time little longer than the window: a row meets those of its own
stretch and of the next. A gap longer than the window between neighbours in time can't be crossed by any link, so each
identity falls into islands, inside which components are found.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..checkpoints import cut
from ..functions.vectors import cosine, hamming, map_cosine
from ..params import Dedup
from ..shipping import ship
from .clustering import components


def islands(rows: DataFrame, window: float, partition: list[str], time: str = "timestamp", order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """rows with `island`: numbers within a partition, a new one after a gap longer than the window. Null keys are keys."""
    w = Window.partitionBy(*partition).orderBy(time, *order)
    gap = F.coalesce((F.col(time) - F.lag(time).over(w) > window).cast("int"), F.lit(0))
    return rows.withColumn("_gap", gap).withColumn("island", F.sum("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_gap")


def duplicate_edges(rows: DataFrame, p: Dedup = Dedup(), partition: tuple[str, ...] = ("identity_cluster",)) -> DataFrame:
    """(a, b, keys, island): linked pairs of `id`, a the earlier one.

    Null identities are one identity. A null hash is far from every hash, a null embedding links to nothing. Expression maps
    are compared if any row has one. Cheap tests come first: Spark keeps the order of the conditions. An identity that is
    seen without a gap is one island but many stretches, and only rows of neighbouring stretches become pairs. Rows without
    a timestamp link to nothing.
    """
    parts = list(partition)
    numbered = islands(rows, p.window, parts)
    any_blends = rows.agg(F.coalesce(F.max(F.size("blendshapes") > 0), F.lit(False)).alias("_blends"))
    keyed = numbered.join(F.broadcast(any_blends))  # one row
    # Longer than the window by more than the rounding of a division of large timestamps.
    keyed = keyed.withColumn("stretch", F.floor(F.col("timestamp") / F.lit(max(p.window * 1.001, 1e-3))))
    cols = ["id", "timestamp", "ord", "phash", "embedding", "blendshapes", "_blends", "island", *parts]
    a = keyed.select(*(F.col(c).alias(f"a_{c}") for c in cols), F.explode(F.array("stretch", F.col("stretch") + 1)).alias("a_stretch"))
    b = keyed.select(*(F.col(c).alias(f"b_{c}") for c in (*cols, "stretch")))
    same = F.col("a_stretch") == F.col("b_stretch")
    for c in parts:
        same = same & F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    earlier = (F.col("a_timestamp") < F.col("b_timestamp")) | ((F.col("a_timestamp") == F.col("b_timestamp")) & (F.col("a_ord") < F.col("b_ord")))
    near = same & earlier & (F.col("b_timestamp") - F.col("a_timestamp") <= p.window) & (hamming(F.col("a_phash"), F.col("b_phash")) <= p.max_hamming)
    pairs = a.join(b, near).where("a_embedding is not null and b_embedding is not null")
    pairs = pairs.where(cosine(F.col("a_embedding"), F.col("b_embedding")) >= p.min_cosine)
    pairs = pairs.where(~F.col("a__blends") | (map_cosine(F.col("a_blendshapes"), F.col("b_blendshapes")) >= p.min_blend_cosine))
    return pairs.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), *(F.col(f"a_{c}").alias(c) for c in parts), F.col("a_island").alias("island"))


def _roots(edges: pd.DataFrame) -> pd.DataFrame:
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(edges["a"], edges["b"], strict=True):
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    nodes = sorted(parent)
    return pd.DataFrame({"id": nodes, "group_id": [find(x) for x in nodes]})


#: Links of an island up to which one task finds its components, and links that are given to a task together.
ISLAND_EDGES, TASK_EDGES = 200_000, 50_000


def groups(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """rows with group_id, the least id of the component. No component leaves its island, so whole islands are dealt out to
    tasks, many small ones together; islands of more than ISLAND_EDGES links are left to joins over the whole cluster."""
    ship(rows.sparkSession)
    kind = rows.schema["id"].dataType
    out = T.StructType([T.StructField("id", kind), T.StructField("group_id", kind)])
    keys = [c for c in edges.columns if c not in ("a", "b")]
    edges = cut(edges)
    sizes = edges.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > ISLAND_EDGES)
    large = cut(sizes.select(*(F.col(k).alias(f"_{k}") for k in keys)))
    same = [edges[k].eqNullSafe(large[f"_{k}"]) for k in keys]
    small = edges.join(large, same, "left_anti")
    tasks = max(edges.sparkSession.sparkContext.defaultParallelism, -(-edges.count() // TASK_EDGES))
    dealt = small.select("a", "b", F.pmod(F.xxhash64(*keys), F.lit(tasks)).alias("_task"))
    found = dealt.groupBy("_task").applyInPandas(lambda pdf: _roots(pdf[["a", "b"]]), out)
    if not large.isEmpty():
        wide = edges.join(large, same, "left_semi").select("a", "b")
        nodes = wide.select(F.col("a").alias("id")).union(wide.select("b")).distinct()
        found = found.unionByName(components(nodes, wide).select("id", F.col("component").alias("group_id")))
    return rows.join(found, "id", "left").withColumn("group_id", F.coalesce("group_id", "id"))


def keep_best(grouped: DataFrame, keep: int = 2, quality: str = "quality") -> DataFrame:
    """grouped with rank_in_group, kept and duplicate_of, the best id of the group for rows that aren't kept. Null quality is 0; ties by time, then ord."""
    w = Window.partitionBy("group_id").orderBy(F.coalesce(F.col(quality), F.lit(0.0)).desc(), "timestamp", "ord")
    ranked = grouped.withColumns({"rank_in_group": F.row_number().over(w), "_best": F.first("id").over(w)})
    return ranked.withColumn("kept", F.col("rank_in_group") <= keep).withColumn("duplicate_of", F.when(~F.col("kept"), F.col("_best"))).drop("_best")


def deduplicate(rows: DataFrame, p: Dedup = Dedup(), partition: tuple[str, ...] = ("identity_cluster",)) -> DataFrame:
    """rows (id, timestamp, ord, identity_cluster, phash, embedding, blendshapes, quality) with group_id, rank_in_group, kept, duplicate_of and sel_ord.

    sel_ord is the order of the survivors that selection goes by: groups by their first row in time, best first inside.
    """
    marked = keep_best(groups(rows, duplicate_edges(rows, p, partition)), p.keep)
    first = F.min(F.struct("timestamp", "ord")).over(Window.partitionBy("group_id"))
    return marked.withColumn("sel_ord", F.struct(first.alias("first"), F.col("rank_in_group").alias("rank")))
