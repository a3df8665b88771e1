"""Parameters, one frozen group for each concern; operators take them explicitly and Catalyst folds them in as literals.

The default values are fixed values: results must be the same for the same input.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Sampling:
    fps: float = 3.0
    max_frames: int = 4000
    start: float = 0.0
    end: float | None = None
    max_duration: float | None = None
    min_side: int = 40

    def __post_init__(self):
        # Values that make no sense fall back on the defaults instead of failing a long run.
        if self.fps <= 0:
            object.__setattr__(self, "fps", 3.0)
        if self.max_frames <= 0:
            object.__setattr__(self, "max_frames", 4000)


@dataclass(frozen=True)
class QualityWeights:
    sharpness: float = 0.30
    exposure: float = 0.20
    face_resolution: float = 0.20
    landmark_confidence: float = 0.20
    artifact: float = 0.05
    obstruction: float = 0.05


@dataclass(frozen=True)
class PoseThresholds:
    front_yaw: float = 15.0
    three_quarter_yaw: float = 45.0
    pitch_up: float = 12.0
    pitch_down: float = 12.0
    invert_yaw: bool = False
    invert_pitch: bool = False


@dataclass(frozen=True)
class ExpressionThresholds:
    smile_slight: float = 0.25
    smile_confident: float = 0.45
    smile_big: float = 0.70
    jaw_talking: float = 0.20
    jaw_big: float = 0.45
    eyes_closed: float = 0.55
    brow_raise: float = 0.35
    frown: float = 0.30
    surprise: float = 0.40
    gaze: float = 0.30
    squint: float = 0.35


@dataclass(frozen=True)
class Dedup:
    max_hamming: int = 8
    min_cosine: float = 0.93
    min_blend_cosine: float = 0.97
    window: float = 1.5
    keep: int = 2


@dataclass(frozen=True)
class Clustering:
    cosine: float = 0.363
    merge_cosine: float = 0.75
    min_size: int = 4
    dominance: float = 0.70
    #: A limit for those who want one: a component of the threshold graph with more rows is an error instead of work.
    max_component: int | None = None


@dataclass(frozen=True)
class Selection:
    pack: int = 45
    reference: int = 16
    min_category_quality: float = 0.35
    min_fill_quality: float = 0.30
    spacing: float = 2.0
    per_category: int = 4
    reference_per_category: int = 3

    def __post_init__(self):
        object.__setattr__(self, "pack", min(60, max(30, self.pack)))
        object.__setattr__(self, "reference", min(20, max(12, self.reference)))
