"""Planning what to synthesise: which categories are missing, from which row, with what prompt and strength."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.categories import CATEGORIES, NAMES, categories_for
from ..functions.text import TAG_PHRASES
from .reports import best_by

#: The synthesis planner's own view of the categories: smiling three-quarter views ask for a slight smile. Fixed values.
SPEC: dict[str, tuple[str | None, list[str]]] = {n: (p, tags[:1]) for n, p, tags in CATEGORIES}

#: Fixed values.
POSE_PHRASES = {
    "front": "facing directly forward, front view",
    "three_quarter_left": "three-quarter view, face turned to the left",
    "three_quarter_right": "three-quarter view, face turned to the right",
    "profile_left": "side profile view, face turned fully to the left",
    "profile_right": "side profile view, face turned fully to the right",
    "looking_up": "looking upward, chin raised slightly",
    "looking_down": "looking downward, chin lowered slightly",
}
PROMPT_SUFFIX = "head and shoulders portrait photo, close-up, face clearly visible, photorealistic, natural lighting, sharp focus, realistic skin texture"
ADJACENCY = {
    "front": ["front", "three_quarter_left", "three_quarter_right"],
    "three_quarter_left": ["three_quarter_left", "front", "profile_left"],
    "three_quarter_right": ["three_quarter_right", "front", "profile_right"],
    "profile_left": ["profile_left", "three_quarter_left", "front"],
    "profile_right": ["profile_right", "three_quarter_right", "front"],
    "looking_down": ["looking_down", "front"],
    "looking_up": ["looking_up", "front"],
}
ANY_POSE = ["front", "three_quarter_left", "three_quarter_right"]
STRENGTH = {"profile_left": 0.10, "profile_right": 0.10, "three_quarter_left": 0.05, "three_quarter_right": 0.05, "looking_up": 0.03, "looking_down": 0.03}
LEAST_STRENGTH, MOST_STRENGTH = 0.05, 0.75


def _case(of: Column, table: dict, otherwise) -> Column:
    out = F.lit(otherwise)
    for k, v in table.items():
        out = F.when(of == k, F.lit(v)).otherwise(out)
    return out


def prompt(category: Column) -> Column:
    """Pose, what the tags say, and the suffix; an unknown category has the suffix alone."""
    texts = {n: ", ".join(filter(None, [POSE_PHRASES.get(p or ""), *(TAG_PHRASES[t] for t in tags), PROMPT_SUFFIX])) for n, (p, tags) in SPEC.items()}
    return _case(category, texts, PROMPT_SUFFIX)


def strength(category: Column, base: Column) -> Column:
    add = _case(category, {n: STRENGTH[p] for n, (p, _) in SPEC.items() if p in STRENGTH}, 0.0)
    return F.least(F.lit(MOST_STRENGTH), F.greatest(F.lit(LEAST_STRENGTH), base + add))


def face_restore(explicit: Column, mode: Column) -> Column:
    """The explicit choice, or else whether everything is made anew."""
    return F.coalesce(explicit, mode == "full")


def category_table(df: DataFrame) -> DataFrame:
    """(rank, category) of the 17 categories."""
    return df.sparkSession.createDataFrame(list(enumerate(NAMES, 1)), "rank int, category string")


def missing_categories(rows: DataFrame, least: float = 0.35, mode: str = "missing", most: int | None = None) -> DataFrame:
    """(rank, category) without a row (pose, expressions, quality) that matches with quality `least`; with mode full all of them."""
    table = category_table(rows)
    if mode != "full":
        have = rows.where(F.coalesce(F.col("quality"), F.lit(0.0)) >= least).select(F.explode(categories_for(F.col("pose"), F.col("expressions"))).alias("category")).distinct()
        table = table.join(have, "category", "left_anti")
    table = table.select("rank", "category").orderBy("rank")
    return table if most is None else table.limit(most)


def pick_bases(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """categories (category) with base_id: the best row of the first pose in the category's search order, else the best of all.

    rows: id, pose, quality, ord; rows without a pose or quality are left out. For each pose only its best row matters, so
    seven rows meet the seventeen categories. base_id is null if there is none.
    """
    usable = rows.where("quality is not null and pose is not null")
    best = best_by(usable.select("id", "pose", "quality", "ord"), "pose")
    order = {n: ADJACENCY[p] if p else ANY_POSE for n, (p, _) in SPEC.items()}
    searched = F.array(*(F.struct(F.lit(n).alias("c"), F.array(*map(F.lit, poses)).alias("p")) for n, poses in order.items()))
    own = F.get(F.filter(searched, lambda x: x["c"] == F.col("category")), 0)["p"]
    ranked = categories.withColumn("_poses", F.coalesce(own, F.array(*map(F.lit, ANY_POSE)))).join(F.broadcast(best), F.lit(True), "left")
    place = F.coalesce(F.nullif(F.array_position("_poses", F.col("pose")), F.lit(0)), F.lit(99))
    pick = F.row_number().over(Window.partitionBy("category").orderBy(place, F.col("quality").desc_nulls_last(), "ord"))
    return ranked.withColumn("_rn", pick).where("_rn = 1").select(*categories.columns, F.col("id").alias("base_id"), F.col("pose").alias("base_pose"))


def plan(rows: DataFrame, mode: str = "missing", base_strength: float = 0.6, most: int | None = None) -> DataFrame:
    """(rank, category, base_id, base_pose, prompt, strength) of what a synthesis run would make."""
    bases = pick_bases(rows, missing_categories(rows, mode=mode, most=most))
    return bases.withColumns({"prompt": prompt(F.col("category")), "strength": strength(F.col("category"), F.lit(float(base_strength)))})
