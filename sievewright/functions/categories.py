"""The 17 target categories: a pose, tags of which one must be there, or both."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (name, pose or None, any of these tags), in order of priority. Fixed values.
CATEGORIES: list[tuple[str, str | None, list[str]]] = [
    ("front_neutral", "front", ["neutral"]),
    ("front_slight_smile", "front", ["slight_smile"]),
    ("front_serious", "front", ["serious"]),
    ("left_three_quarter_neutral", "three_quarter_left", ["neutral"]),
    ("left_three_quarter_smile", "three_quarter_left", ["slight_smile", "confident_smile", "big_smile"]),
    ("left_three_quarter_serious", "three_quarter_left", ["serious"]),
    ("right_three_quarter_neutral", "three_quarter_right", ["neutral"]),
    ("right_three_quarter_smile", "three_quarter_right", ["slight_smile", "confident_smile", "big_smile"]),
    ("right_three_quarter_serious", "three_quarter_right", ["serious"]),
    ("left_profile", "profile_left", []),
    ("right_profile", "profile_right", []),
    ("looking_down", "looking_down", []),
    ("looking_up", "looking_up", []),
    ("laughing", None, ["laughing"]),
    ("talking", None, ["talking"]),
    ("focused", None, ["focused"]),
    ("confident", None, ["confident_smile"]),
]
NAMES = [n for n, _, _ in CATEGORIES]


def categories_for(pose: Column, tags: Column) -> Column:
    """Names of the categories that a row matches, in order; null pose or tags match nothing that asks for them."""

    def match(want: str | None, some: list[str]) -> Column:
        ok = F.lit(True) if want is None else pose == want
        return ok & F.arrays_overlap(tags, F.array(*map(F.lit, some))) if some else ok

    return F.filter(F.array(*(F.when(match(p, s), F.lit(n)) for n, p, s in CATEGORIES)), lambda x: x.isNotNull())
