"""Distributions, bests, manifests and contact sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order of what contact sheets show. Fixed values.
POSE_SHEET = ["front", "three_quarter_left", "three_quarter_right", "profile_left", "profile_right", "looking_up", "looking_down"]
IDENTITY_SHEET = POSE_SHEET[:5]
EXPRESSION_SHEET = ["neutral", "slight_smile", "serious", "laughing", "focused", "talking", "looking_down", "looking_up"]


def quality_bin(q: Column) -> Column:
    lo = F.least(F.lit(90), (q * 10).cast("int") * 10)
    return F.concat(lo.cast("string"), F.lit("-"), (lo + 10).cast("string"), F.lit("%"))


def quality_distribution(rows: DataFrame, quality: str = "quality") -> DataFrame:
    """(bin, n) in the order of the bins' names."""
    return rows.groupBy(quality_bin(F.col(quality)).alias("bin")).agg(F.count("*").alias("n")).orderBy("bin")


def tag_distribution(rows: DataFrame, tags: str = "expressions") -> DataFrame:
    return rows.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag")


def pose_distribution(rows: DataFrame, pose: str = "pose") -> DataFrame:
    return rows.groupBy(pose).agg(F.count("*").alias("n")).orderBy(F.desc("n"), pose)


def best_by(rows: DataFrame, key: str, quality: str = "quality", order: str = "ord") -> DataFrame:
    """The best row of each value of key, the first in ties, null quality last. Rows are folded before the shuffle, not sorted."""
    worst_last = F.struct(F.col(quality).isNull(), -F.col(quality), F.col(order))
    best = F.min_by(F.struct(*(f"`{c}`" for c in rows.columns)), worst_last)
    return rows.groupBy(F.col(key).alias("_key")).agg(best.alias("_best")).select("_best.*")


def first_members(rows: DataFrame, key: str = "identity_cluster", most: int = 12, order: str = "ord") -> DataFrame:
    """The first members of each cluster, for a sheet of candidates."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def union_ordered(parts: list[DataFrame], key: str = "id", order: str = "pick") -> DataFrame:
    """(key, position) of the distinct keys of the parts, one part after the other, each in its order."""
    tagged = [p.select(key, F.lit(i).alias("_part"), F.col(order).alias("_at")) for i, p in enumerate(parts)]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t)
    first = every.groupBy(key).agg(F.min(F.struct("_part", "_at")).alias("_first"))
    return first.select(key, F.row_number().over(Window.orderBy("_first", key)).alias("position"))


def blend_keys(rows: DataFrame, column: str = "blendshapes") -> DataFrame:
    """(name) of the keys of all rows' maps, in order. Keys are folded before the shuffle."""
    return rows.select(F.explode(F.map_keys(column)).alias("name")).distinct().orderBy("name")


def grid(items: DataFrame, order: str, columns: int) -> DataFrame:
    """items with row, col, of a sheet with at most `columns` columns (no more than there are items), and rows, the sheet's height."""
    whole = Window.partitionBy()
    placed = items.withColumns({"_k": F.row_number().over(Window.orderBy(order)) - 1, "_n": F.count("*").over(whole)})
    wide = F.greatest(F.lit(1), F.least(F.lit(columns), F.col("_n")))
    return placed.withColumns({"row": F.floor(F.col("_k") / wide).cast("int"), "col": (F.col("_k") % wide).cast("int"), "rows": F.ceil(F.col("_n") / wide).cast("int")}).drop("_k", "_n")


def sheet(best: DataFrame, key: str, show: list[str], columns: int) -> DataFrame:
    """(key, id, row, col, rows) of a contact sheet of the bests, in the order of `show`."""
    table = F.array(*map(F.lit, show))
    return grid(best.where(F.col(key).isin(show)).withColumn("_place", F.array_position(table, F.col(key))), "_place", columns).select(key, "id", "row", "col", "rows")


def run_counts(frames: DataFrame, detections: DataFrame, clusters: DataFrame, survivors: DataFrame) -> DataFrame:
    """One row: frames_examined, faces_found, identities_found, after_dedup."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    out = count(frames, "frames_examined")
    for df, name in ((detections, "faces_found"), (clusters, "identities_found"), (survivors, "after_dedup")):
        out = out.join(F.broadcast(count(df, name)))  # one row each
    return out


def manifest(images: DataFrame, video: dict[str, str | float | int | None], counts: dict[str, int], reference: DataFrame | None = None, synthetic: DataFrame | None = None) -> DataFrame:
    """One row: video, counts, images as an array of structs by position, distributions as maps, and, apart from the images, synthetic rows."""
    to_map = lambda df, k: df.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(k, "n")))).alias("m"))
    cols = [c for c in images.columns if c != "position"]
    out = images.agg(F.transform(F.sort_array(F.collect_list(F.struct("position", F.struct(*cols).alias("image")))), lambda x: x["image"]).alias("images"))
    out = out.select(F.struct(*(F.lit(v).alias(k) for k, v in video.items())).alias("video"), *(F.lit(v).cast("long").alias(k) for k, v in counts.items()), "images")
    for name, df, key in (("quality_distribution", quality_distribution(images), "bin"), ("expression_distribution", tag_distribution(images), "tag"), ("pose_distribution", pose_distribution(images), "pose")):
        out = out.join(F.broadcast(to_map(df, key).withColumnRenamed("m", name)))  # one row each
    if reference is not None:
        out = out.join(F.broadcast(reference.agg(F.transform(F.sort_array(F.collect_list(F.struct("pick", "id"))), lambda x: x["id"]).alias("reference_pack"))))
    if synthetic is not None:
        out = out.join(F.broadcast(synthetic.agg(F.collect_list(F.struct(*synthetic.columns)).alias("synthesized_images"))))
    return out
