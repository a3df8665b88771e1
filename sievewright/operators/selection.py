"""Packs: a diverse one by category coverage, spacing and quotas, and a reference one by score.

Every accepted row changes what may come after it, so a pack is a greedy fold over one identity's rows in one video, best
first, under rules that are data: coverage, fill and relaxation of the diverse pack, and the reference pack, differ in their
rules only. Rows are ranked and, where that is exact, thinned out by Spark before they are grouped: what a group holds is
what is left of one person in one video after dedup, or less.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.categories import NAMES, categories_for
from ..params import Selection
from ..shipping import ship

#: What a pose adds to a reference score. Fixed values.
POSE_BONUS = {"front": 1.0, "three_quarter_left": 0.85, "three_quarter_right": 0.85, "looking_up": 0.6, "looking_down": 0.6, "profile_left": 0.5, "profile_right": 0.5}
OTHER_BONUS = 0.5
UNCATEGORIZED = "uncategorized"


class Look(NamedTuple):
    """A row as the fold sees it; score is what it was ranked by."""

    id: object
    time: float
    score: float
    categories: list[str]


@dataclass(frozen=True)
class Rule:
    """What a row must have to be picked, and what its pick counts as.

    A row needs a score of `least`, a distance of `spacing` in time from all picks, and the `category` if there is one. With a
    `quota`, some category of it must have fewer picks; rows without a category, and all rows while there are fewer than
    `exempt` picks, are free of that. The rule ends after `most` picks. A pick counts for the rule's category, or for all
    its own.
    """

    phase: int
    least: float = float("-inf")
    spacing: float = 0.0
    category: str | None = None
    quota: int | None = None
    exempt: int = 0
    most: int | None = None


def greedy(looks: list[Look], size: int, rules: list[Rule]) -> list[tuple[Look, int]]:
    """(look, phase) of up to `size` looks, in the order of choice: each rule goes through all looks, best first as they come."""
    picked: dict[object, tuple[Look, int]] = {}
    used: Counter = Counter()

    def fits(rule: Rule, x: Look) -> bool:
        wanted = x.score >= rule.least and (rule.category is None or rule.category in x.categories)
        bound = rule.quota is not None and x.categories and len(picked) >= rule.exempt
        open_ = not bound or any(used[c] < rule.quota for c in x.categories)
        return wanted and open_ and (not rule.spacing or all(abs(x.time - y.time) >= rule.spacing for y, _ in picked.values()))

    for rule in rules:
        before = len(picked)
        for x in looks:
            if len(picked) >= size:
                return list(picked.values())
            if rule.most is not None and len(picked) - before >= rule.most:
                break
            if x.id not in picked and fits(rule, x):
                picked[x.id] = x, rule.phase
                used.update([rule.category] if rule.category else x.categories)
    return list(picked.values())


def diverse_rules(p: Selection) -> list[Rule]:
    """The best row of each category; then rows apart in time, some category of which isn't full; then any that are good enough."""
    coverage = [Rule(1, p.min_category_quality, category=name, most=1) for name in NAMES]
    return [*coverage, Rule(2, p.min_fill_quality, p.spacing, quota=p.per_category), Rule(3, p.min_fill_quality)]


def reference_rules(size: int, per_category: int) -> list[Rule]:
    """The first half as they come, then only rows some category of which isn't full."""
    return [Rule(1, quota=per_category, exempt=max(1, size // 2))]


def fold_diverse(rows: list[tuple[str, float, float, list[str]]], size: int, p: Selection = Selection()) -> list[tuple[str, int]]:
    """(id, phase) of the pack, in the order of choice, from rows (id, timestamp, quality, categories) in selection order; rows of quality 0 never count."""
    looks = sorted((Look(*r) for r in rows if r[2] > 0), key=lambda x: -x.score)
    return [(x.id, phase) for x, phase in greedy(looks, size, diverse_rules(p))]


def fold_reference(rows: list[tuple[str, float, list[str]]], size: int, per_category: int = 3) -> list[str]:
    """Ids of the reference pack from rows (id, score, categories) in selection order; rows without a category are one category of their own."""
    looks = sorted((Look(i, 0.0, score, cats or [UNCATEGORIZED]) for i, score, cats in rows), key=lambda x: -x.score)
    return [x.id for x, _ in greedy(looks, size, reference_rules(size, per_category))]


def reference_score(quality: Column, sharpness: Column, pose: Column) -> Column:
    """0 without quality or pose."""
    table = F.create_map(*(F.lit(x) for kv in POSE_BONUS.items() for x in kv))
    bonus = F.coalesce(F.try_element_at(table, pose), F.lit(OTHER_BONUS))
    return F.when(quality.isNull() | pose.isNull(), 0.0).otherwise(0.55 * quality + 0.25 * sharpness + 0.20 * bonus)


def _ranked(rows: DataFrame, keys: tuple[str, ...], order: str, score: Column) -> DataFrame:
    """(keys, id, timestamp, categories, score, place): place is the row's rank in its group, best score first, ties by `order`."""
    cats = F.coalesce(categories_for(F.col("pose"), F.col("expressions")), F.array().cast("array<string>"))
    looks = rows.select(*keys, "id", "timestamp", F.col(order).alias("_order"), cats.alias("categories"), score.alias("score"))
    best_first = Window.partitionBy(*keys).orderBy(F.desc("score"), "_order")
    return looks.withColumn("place", F.row_number().over(best_first)).drop("_order")


def _packed(ranked: DataFrame, keys: tuple[str, ...], size: int, rules: list[Rule], more: dict[str, T.DataType]) -> DataFrame:
    """(keys, id, pick, more) of each group's greedy fold; more: columns among phase, score and categories."""
    ship(ranked.sparkSession)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        looks = [Look(*x) for x in zip(pdf["id"], pdf["timestamp"], pdf["score"], map(list, pdf["categories"]), strict=True)]
        pack = greedy(looks, size, rules)
        told = {"phase": [phase for _, phase in pack], "score": [x.score for x, _ in pack], "categories": pd.Series([x.categories for x, _ in pack], dtype=object)}
        plain = lambda values: pd.Series(list(values), dtype=object)
        return pd.DataFrame({**{k: plain([pdf[k].iloc[0]] * len(pack)) for k in keys}, "id": plain(x.id for x, _ in pack), "pick": range(1, len(pack) + 1), **{c: told[c] for c in more}})

    fields = [*(ranked.schema[k] for k in keys), ranked.schema["id"], T.StructField("pick", T.IntegerType()), *(T.StructField(c, t) for c, t in more.items())]
    return ranked.groupBy(*keys).applyInPandas(work, T.StructType([T.StructField(f.name, f.dataType) for f in fields]))


#: A person in a video; packs never reach over either. Rows that have no such column are of one person, or video.
KEYS = ("video_id", "identity_cluster")


def _keys(rows: DataFrame, keys: tuple[str, ...] | None) -> tuple[str, ...]:
    return tuple(k for k in KEYS if k in rows.columns) if keys is None else keys


def diverse_pack(rows: DataFrame, p: Selection = Selection(), size: int | None = None, keys: tuple[str, ...] | None = None, order: str = "sel_ord") -> DataFrame:
    """(keys, id, pick, phase, categories) of each pack, a person's in a video, pick from 1, phase 1 coverage, 2 fill, 3 relaxed.

    rows: id, timestamp, quality (null, like 0, never counts), pose, expressions, and `order`, which pins every tie.
    """
    keys = _keys(rows, keys)
    ranked = _ranked(rows.where("quality > 0"), keys, order, F.col("quality"))
    return _packed(ranked, keys, size or p.pack, diverse_rules(p), {"phase": T.IntegerType(), "categories": T.ArrayType(T.StringType())})


def reference_pack(rows: DataFrame, p: Selection = Selection(), size: int | None = None, keys: tuple[str, ...] | None = None, order: str = "sel_ord") -> DataFrame:
    """(keys, id, pick, score) of each group's reference pack; rows need quality and sharpness, rows without quality are left out.

    A row beyond the free first half is picked only while a category of it isn't full, so all better rows of that category
    were picked: it is among the category's best few. All others are left out before the fold, whatever the group's size.
    """
    size, keys = size or p.reference, _keys(rows, keys)
    ranked = _ranked(rows.where("quality is not null"), keys, order, reference_score(F.col("quality"), F.col("sharpness"), F.col("pose")))
    ranked = ranked.withColumn("categories", F.when(F.size("categories") > 0, F.col("categories")).otherwise(F.array(F.lit(UNCATEGORIZED))))
    of_category = Window.partitionBy(*keys, "category").orderBy("place")
    each = ranked.withColumn("category", F.explode("categories")).withColumn("nth", F.row_number().over(of_category))
    few = each.where((F.col("nth") <= p.reference_per_category) | (F.col("place") <= max(1, size // 2)))
    return _packed(few.drop("category", "nth").distinct(), keys, size, reference_rules(size, p.reference_per_category), {"score": T.DoubleType()})
