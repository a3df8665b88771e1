"""Head pose: angles from and to rotation matrices, and named buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import PoseThresholds


def euler(m: Column) -> Column:
    """struct<pitch, yaw, roll> in degrees of an array<array<double>> rotation, at least 3 by 3; null stays null."""
    r = lambda i, j: m[i][j]
    pitch, yaw, roll = F.atan2(r(2, 1), r(2, 2)), F.atan2(-r(2, 0), F.sqrt(r(0, 0) * r(0, 0) + r(1, 0) * r(1, 0))), F.atan2(r(1, 0), r(0, 0))
    return F.when(m.isNotNull(), F.struct(F.degrees(pitch).alias("pitch"), F.degrees(yaw).alias("yaw"), F.degrees(roll).alias("roll")))


def rotation(pitch: Column, yaw: Column, roll: Column) -> Column:
    """The rotation of angles in degrees: about z by roll, of about y by yaw, of about x by pitch."""
    (sp, cp), (sy, cy), (sr, cr) = ((F.sin(F.radians(a)), F.cos(F.radians(a))) for a in (pitch, yaw, roll))
    return F.array(
        F.array(cr * cy, cr * sy * sp - sr * cp, cr * sy * cp + sr * sp),
        F.array(sr * cy, sr * sy * sp + cr * cp, sr * sy * cp - cr * sp),
        F.array(-sy, cy * sp, cy * cp),
    )


def bucket(yaw: Column, pitch: Column, t: PoseThresholds = PoseThresholds()) -> Column:
    """The pose's name. Flags turn the signs for the decision only."""
    yaw, pitch = (-yaw if t.invert_yaw else yaw), (-pitch if t.invert_pitch else pitch)
    turned = F.abs(yaw)
    return (
        F.when((turned < t.three_quarter_yaw) & (pitch >= t.pitch_down), "looking_down")
        .when((turned < t.three_quarter_yaw) & (pitch <= -t.pitch_up), "looking_up")
        .when(turned <= t.front_yaw, "front")
        .when(turned <= t.three_quarter_yaw, F.when(yaw < 0, "three_quarter_left").otherwise("three_quarter_right"))
        .otherwise(F.when(yaw < 0, "profile_left").otherwise("profile_right"))
    )


def head_pose(m: Column, t: PoseThresholds = PoseThresholds()) -> Column:
    """struct<yaw, pitch, roll, pose> of a matrix; without one, straight ahead. Null entries leave angles null, and the pose front without a yaw."""
    a = euler(m)
    zero = F.coalesce(m.isNull(), F.lit(True))
    angle = lambda n: F.when(zero, F.lit(0.0)).otherwise(a[n])
    return F.struct(*(angle(n).alias(n) for n in ("yaw", "pitch", "roll")), F.when(zero | a["yaw"].isNull(), "front").otherwise(bucket(a["yaw"], a["pitch"], t)).alias("pose"))
