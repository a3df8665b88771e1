"""Expression tags from a map of blendshape weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import ExpressionThresholds

#: Averaged blendshapes of each signal. Fixed values.
SIGNALS = {
    "smile": ["mouthSmileLeft", "mouthSmileRight"],
    "jaw": ["jawOpen"],
    "blink": ["eyeBlinkLeft", "eyeBlinkRight"],
    "brow_up": ["browOuterUpLeft", "browOuterUpRight", "browInnerUp"],
    "brow_down": ["browDownLeft", "browDownRight"],
    "frown": ["mouthFrownLeft", "mouthFrownRight"],
    "squint": ["eyeSquintLeft", "eyeSquintRight"],
    "wide": ["eyeWideLeft", "eyeWideRight"],
    "left": ["eyeLookOutLeft", "eyeLookInRight"],
    "right": ["eyeLookOutRight", "eyeLookInLeft"],
    "down": ["eyeLookDownLeft", "eyeLookDownRight"],
    "up": ["eyeLookUpLeft", "eyeLookUpRight"],
    "press": ["mouthPressLeft", "mouthPressRight"],
    "cheek": ["cheekSquintLeft", "cheekSquintRight"],
}
BLENDSHAPES = [n for names in SIGNALS.values() for n in names]


def signals(blend: Column) -> dict[str, Column]:
    """Averages; a missing weight is 0, whatever is missing."""
    weight = lambda n: F.coalesce(F.try_element_at(blend, F.lit(n)), F.lit(0.0))
    return {s: sum((weight(n) for n in names[1:]), weight(names[0])) / float(len(names)) for s, names in SIGNALS.items()}


def tags(s: dict[str, Column], t: ExpressionThresholds = ExpressionThresholds()) -> Column:
    """Tags in their fixed order; never empty."""
    smile, jaw = s["smile"], s["jaw"]
    calm = smile < t.smile_slight
    focused = ((s["press"] >= t.squint) | (s["squint"] >= t.squint) | (s["cheek"] >= t.squint)) & calm
    found = [
        F.when(smile >= t.smile_big, F.when(jaw >= t.jaw_talking, "laughing").otherwise("big_smile")).when(smile >= t.smile_confident, "confident_smile").when(smile >= t.smile_slight, "slight_smile"),
        F.when(jaw >= t.jaw_big, "mouth_open").when((jaw >= t.jaw_talking) & (smile < t.smile_confident), "talking"),
        F.when(s["blink"] >= t.eyes_closed, "eyes_closed"),
        F.when((s["left"] >= t.gaze) & (s["left"] > s["right"]), "eyes_left").when((s["right"] >= t.gaze) & (s["right"] > s["left"]), "eyes_right"),
        F.when((s["down"] >= t.gaze) & (s["down"] > s["up"]), "looking_down").when((s["up"] >= t.gaze) & (s["up"] > s["down"]), "looking_up"),
        F.when(s["brow_up"] >= t.brow_raise, "raised_eyebrows"),
        F.when((s["brow_down"] >= t.frown) | (s["frown"] >= t.frown), "frowning"),
        F.when(((s["brow_up"] + jaw + s["wide"]) / 3.0 >= t.surprise) & calm, "surprised"),
        F.when(focused, "focused"),
        F.when(calm & (jaw < t.jaw_talking) & (s["frown"] < t.frown) & (s["brow_down"] < t.frown), F.when(focused, "serious").otherwise("neutral")),
    ]
    seen = F.filter(F.array(*found), lambda x: x.isNotNull())
    return F.when(F.size(seen) > 0, seen).otherwise(F.array(F.lit("neutral")))


def with_expressions(df: DataFrame, blend: str = "blendshapes", t: ExpressionThresholds = ExpressionThresholds()) -> DataFrame:
    """df with `expressions`; the signals are projected first, so that each is computed once."""
    return df.withColumns({f"_s_{k}": c for k, c in signals(F.col(blend)).items()}).withColumn("expressions", tags({k: F.col(f"_s_{k}") for k in SIGNALS}, t)).drop(*(f"_s_{k}" for k in SIGNALS))
