"""The whole run for candidates of videos: cluster, choose, score, deduplicate, select, plan and report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import Checkpoints, cut, parameter_key
from ..operators import clustering, dedup, reports, selection, synthesis
from ..params import Clustering, Dedup, Selection


@dataclass(frozen=True)
class Curation:
    clustering: Clustering = field(default_factory=Clustering)
    dedup: Dedup = field(default_factory=Dedup)
    selection: Selection = field(default_factory=Selection)
    person: int | None = None
    #: A vector that the chosen identity should be like.
    reference: tuple[float, ...] | None = None
    mode: str = "missing"


@dataclass
class Result:
    target: int
    why: str
    survivors: DataFrame
    pack: DataFrame
    reference: DataFrame
    plan: DataFrame
    manifest: DataFrame


def identify(spark: SparkSession, rows: DataFrame, p: Curation, checkpoints: Checkpoints | None = None, source: str = "", ask: Callable[[list], int] | None = None) -> tuple[DataFrame, int, str]:
    """(rows with identity_cluster, the target's number, why). Clusters may come from a checkpoint named by all parameters and the source."""
    build = lambda: clustering.cluster_identities(rows, p.clustering)
    known = checkpoints.stage("identity", parameter_key(p.clustering, source), build) if checkpoints else cut(build())
    target, why = clustering.choose_target(clustering.summarize(known), known, p.person, list(p.reference) if p.reference else None, ask, p.clustering)
    return known, target, why


def curate(spark: SparkSession, rows: DataFrame, p: Curation = Curation(), checkpoints: Checkpoints | None = None, source: str = "", ask: Callable[[list], int] | None = None) -> Result:
    """rows: id, video_id, frame_number, timestamp, ord, frame_path, detection_confidence, embedding, blendshapes, phash, pose, expressions, quality, sharpness.

    One video. ask is called with the identities if neither a number nor a reference vector names one and none is dominant.
    Selection is always made again. The filter on the chosen identity stands before everything that is dear.
    """
    known, target, why = identify(spark, rows, p, checkpoints, source, ask)
    survivors = cut(dedup.deduplicate(known.where(F.col("identity_cluster") == target), p.dedup)).where("kept")
    counts = {"frames_examined": rows.select("frame_number").distinct().count(), "faces_found": rows.count(), "identities_found": known.where("identity_cluster is not null").select("identity_cluster").distinct().count(), "after_dedup": survivors.count()}
    return selected(survivors, p, target, why, counts, {"source": source})


def selected(survivors: DataFrame, p: Curation, target: int, why: str, counts: dict[str, int], video: dict, shown: tuple[str, ...] = ()) -> Result:
    """Packs, synthesis plan and manifest of what dedup left of the target; shown: further columns of the manifest's images."""
    pack = cut(selection.diverse_pack(survivors, p.selection))
    reference = cut(selection.reference_pack(survivors, p.selection))
    plan = synthesis.plan(survivors, p.mode)
    ids = reports.union_ordered([pack, reference])
    images = survivors.drop("position").join(ids, "id").select("position", "id", "frame_number", "timestamp", "quality", "pose", "expressions", *shown)
    return Result(target, why, survivors, pack, reference, plan, reports.manifest(images, video, counts, reference))
