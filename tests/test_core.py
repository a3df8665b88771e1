"""Cases of the operators and functions, and the folds against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright import params, schema
from sievewright.checkpoints import Checkpoints, parameter_key
from sievewright.errors import ComponentTooLarge, NoTarget
from sievewright.functions import body, geometry, pixels, pose, quality, text, vectors
from sievewright.functions.categories import NAMES, categories_for
from sievewright.functions.expressions import SIGNALS, with_expressions
from sievewright.operators import clustering, dedup, reports, sampling, selection, synthesis
from sievewright.params import Clustering, Dedup, PoseThresholds, Sampling, Selection


def one(spark, *cols):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first()


def box(*v):
    return geometry.box(*map(F.lit, v))


def test_boxes(spark):
    r = one(spark, geometry.area(box(0, 0, 10, 5)), geometry.area(box(0, 0, -3, 5)), geometry.iou(box(0, 0, 10, 10), box(0, 0, 10, 10)), geometry.iou(box(0, 0, 10, 10), box(50, 50, 5, 5)), geometry.iou(box(0, 0, 10, 10), box(5, 0, 10, 10)), geometry.iou(box(0, 0, 0, 0), box(0, 0, 0, 0)))
    assert (r[0], r[1], r[2], r[3]) == (50, 0, 1.0, 0.0) and r[4] == pytest.approx(50 / 150) and r[5] == 0.0
    r = one(spark, geometry.normalised_box(F.lit(-3.7), F.lit(2.9), F.lit(0.2), F.lit(7.9)), geometry.corners(box(1, 2, 3, 4)), geometry.portrait_crop(box(100, 900, 100, 100), F.lit(1000)), geometry.landmark_crop(box(5000, 10, 10, 10), F.lit(100), F.lit(100)))
    assert tuple(r[0]) == (0, 2, 1, 7) and tuple(r[1]) == (1, 2, 4, 6) and r[2] is None and tuple(r[3]) == (5000, 10, 5010, 20)
    sizes = one(spark, *(geometry.working_size(F.lit(w), F.lit(h), t) for w, h, t in ((1024, 1024, 512), (1000, 500, 512), (300, 200, 512), (1024, 512, 256), (5000, 1, 512))))
    assert [tuple(s) for s in sizes] == [(512, 512), (512, 256), (300, 200), (256, 128), (512, 1)]


def test_quality(spark):
    flat = lambda v: F.array(*[F.lit(v)] * 64)
    r = one(spark, quality.exposure(flat(0)), quality.exposure(flat(128)), quality.exposure(flat(255)), quality.exposure(F.array().cast("array<int>")), quality.sharpness(F.lit(None).cast("double")), quality.face_resolution(box(0, 0, 50, 50)), quality.face_resolution(box(0, 0, 300, 300)))
    assert r[0] < 0.2 and r[1] == 1.0 and r[2] < 0.2 and r[3] == 0.0 and r[4] == 0.0 and r[5] < 0.1 and r[6] == 1.0
    r = one(spark, quality.obstruction(box(0, 0, 50, 50), F.lit(640), F.lit(480), F.lit(1.0)), quality.obstruction(box(200, 200, 50, 50), F.lit(640), F.lit(480), F.lit(1.0)), quality.plausibility(F.array().cast("array<struct<x:double,y:double>>")), quality.landmark_confidence(F.lit(2.0), F.lit(1.0)))
    assert r[0] == pytest.approx(0.8) and r[1] == 1.0 and r[2] == 0.0 and r[3] == 1.0
    parts = {k: F.lit(1.0) for k in vars(params.QualityWeights())}
    assert one(spark, quality.overall(parts))[0] == pytest.approx(1.0)
    assert sum(one(spark, quality.histogram(F.array(F.lit(1), F.lit(1), F.lit(3))))[0]) == 3


def test_pixels(spark):
    rng = np.random.default_rng(0)
    flat, noisy = np.full((32, 32), 128.0), 128 + 40 * rng.normal(size=(32, 32))
    blocks = np.kron(rng.integers(0, 255, (4, 4)), np.ones((8, 8)))
    rows = spark.createDataFrame([(k, a.flatten().tolist(), a.shape[1]) for k, a in (("flat", flat), ("noisy", noisy), ("blocks", blocks))] + [("none", [], 0)], "k string, g array<double>, w int")
    got = {r["k"]: r for r in rows.select("k", quality.sharpness(pixels.laplacian(F.col("g"), F.col("w"))).alias("s"), pixels.artifact(F.col("g"), F.col("w")).alias("a")).collect()}
    assert got["flat"]["s"] == 0 and got["noisy"]["s"] > 0.9 and got["none"]["s"] == 0
    assert got["blocks"]["a"] < got["noisy"]["a"] and got["none"]["a"] == 1.0
    rgb = F.array(F.struct(F.lit(200).alias("r"), F.lit(30).alias("g"), F.lit(30).alias("b")), F.struct(F.lit(202).alias("r"), F.lit(30).alias("g"), F.lit(32).alias("b")))
    mean = pixels.mean_colour(rgb)
    assert one(spark, text.nearest_colour(mean["r"], mean["g"], mean["b"]))[0] == "red"


@pytest.mark.parametrize("angles", [(0, 0, 0), (10, 20, 30), (-15, 40, -60), (5, -80, 10), (60, 10, 170), (-45, -45, -45)])
def test_pose_round_trip(spark, angles):
    got = one(spark, pose.euler(pose.rotation(*(F.lit(float(a)) for a in angles))))[0]
    assert tuple(got) == pytest.approx(angles, abs=1e-3)


def test_pose_buckets(spark):
    cases = [((0, 0), "front"), ((15, 0), "front"), ((15.1, 0), "three_quarter_right"), ((-45, 0), "three_quarter_left"), ((-45, 30), "three_quarter_left"), ((46, 30), "profile_right"), ((0, 12), "looking_down"), ((0, -12), "looking_up"), ((-60, 0), "profile_left")]
    assert [x for x in one(spark, *(pose.bucket(F.lit(float(y)), F.lit(float(p))) for (y, p), _ in cases))] == [w for _, w in cases]
    turned = PoseThresholds(invert_yaw=True, invert_pitch=True)
    assert one(spark, pose.bucket(F.lit(30.0), F.lit(0.0), turned), pose.bucket(F.lit(0.0), F.lit(20.0), turned))[:] == ("three_quarter_left", "looking_up")
    assert tuple(one(spark, pose.head_pose(F.lit(None).cast("array<array<double>>")))[0]) == (0.0, 0.0, 0.0, "front")


def tags_of(spark, **weights):
    both = {}
    for k, v in weights.items():
        for n in SIGNALS[k]:
            both[n] = v
    rows = spark.createDataFrame([(both,)], "blendshapes map<string,double>")
    return with_expressions(rows).first()["expressions"]


def test_expressions(spark):
    t = lambda **w: tags_of(spark, **w)
    assert t() == ["neutral"]
    assert t(smile=0.3) == ["slight_smile"] and t(smile=0.5) == ["confident_smile"] and t(smile=0.8) == ["big_smile"] and t(smile=0.9, jaw=0.5) == ["laughing", "mouth_open"]
    assert t(jaw=0.25) == ["talking"] and "mouth_open" in t(jaw=0.6) and "eyes_closed" in t(blink=0.9)
    assert "eyes_left" in tags_of(spark, left=0.6) and "eyes_right" in tags_of(spark, right=0.6) and not {"eyes_left", "eyes_right"} & set(t(left=0.5, right=0.5))
    assert t(frown=0.5) == ["frowning"] and "raised_eyebrows" in t(brow_up=0.5) and "surprised" in t(brow_up=0.5, jaw=0.4, wide=0.5) and t(press=0.5) == ["focused", "serious"]
    assert set(t(smile=0.5, brow_up=0.5)) == {"confident_smile", "raised_eyebrows"}
    assert set(NAMES) and all(x in schema.EXPRESSIONS for x in t(press=0.5))


def test_categories(spark):
    c = lambda p, *tags: categories_for(F.lit(p), F.array(*map(F.lit, tags)))
    r = one(spark, c("front", "neutral"), c("profile_left", "neutral"), c("front", "slight_smile", "talking"), c("looking_up", "serious"))
    assert [list(x) for x in r] == [["front_neutral"], ["left_profile"], ["front_slight_smile", "talking"], ["looking_up"]]


def test_vectors(spark):
    a = lambda *v: F.array(*(F.lit(float(x)) for x in v))
    r = one(spark, vectors.cosine(a(1, 0), a(1, 0)), vectors.cosine(a(1, 0), a(0, 0)), vectors.hamming(F.lit(None).cast("long"), F.lit(1)), vectors.hamming(F.lit(-1).cast("long"), F.lit(0).cast("long")), vectors.unit(a(3, 4)))
    assert r[0] == 1.0 and r[1] == 0.0 and r[2] == 999 and r[3] == 64 and list(r[4]) == pytest.approx([0.6, 0.8])
    m = lambda **k: F.create_map(*(F.lit(x) for kv in k.items() for x in kv))
    r = one(spark, vectors.map_cosine(m(a=1.0), m(a=2.0, b=0.0)), vectors.map_cosine(m(a=1.0), F.lit(None).cast("map<string,double>")), vectors.map_cosine(m(a=3.0, b=4.0), m(b=1.0)))
    assert r[0] == 1.0 and r[1] == 0.0 and r[2] == pytest.approx(0.8)


def test_body(spark):
    def landmarks(nose, seen, visible=0.9):
        return [(nose[0], nose[1], visible) if i == 0 else (0.0, 0.0, 0.9 if i in seen else None) for i in range(33)]

    kind = "frame int, pose_no int, pose array<struct<x:double,y:double,visibility:double>>"
    poses = spark.createDataFrame([(1, 0, landmarks((0.9, 0.9), {11, 23, 27})), (1, 1, landmarks((0.5, 0.5), {11})), (1, 2, landmarks((0.5, 0.5), {24}, 0.1)), (2, 0, landmarks((0.1, 0.1), {24}, None))], kind)
    faces = spark.createDataFrame([(1, 1, 0.5, 0.5), (1, 2, 0.8, 0.9), (2, 3, 0.5, 0.5), (3, 4, 0.5, 0.5)], "frame int, face_id int, cx double, cy double")
    got = {r["face_id"]: r["v"] for r in body.nearest_pose(faces, poses).select("face_id", body.visibility(F.col("pose")).alias("v")).collect()}
    assert got == {1: "upper_body", 2: "full_body", 3: "half_body", 4: "none"}


def test_sampling(spark):
    videos = spark.createDataFrame([("a", 30.0, 300), ("b", 0.0, 90), ("c", 30.0, 0)], "video_id string, fps double, total_frames long")
    got = {}
    for r in sampling.sample_frames(videos, Sampling(fps=3)).collect():
        got.setdefault(r["video_id"], []).append(r["frame_number"])
    assert got == {"a": list(range(0, 300, 10)), "b": list(range(0, 90, 10))}
    assert sampling.sample_frames(videos, Sampling(fps=30, max_frames=7)).where("video_id = 'a'").count() == 7
    assert Sampling(fps=-1, max_frames=0) == Sampling() and Selection(pack=5, reference=99) == Selection(pack=30, reference=20)
    dets = spark.createDataFrame([(1, 1, (0, 0, 50, 50)), (1, 2, (0, 0, 10, 90)), (2, 3, (0, 0, 10, 10)), (2, 4, (0, 0, 20, 10)), (2, 5, (0, 0, 10, 20))], "frame int, id int, bbox struct<x:int,y:int,w:int,h:int>")
    assert sorted(r["id"] for r in sampling.keep_large(dets, ["frame"], ["id"]).collect()) == [1, 4]


DUP = "id long, timestamp double, ord long, identity_cluster int, phash long, embedding array<double>, blendshapes map<string,double>, quality double"


def dedup_rows(spark, rows):
    base = {"identity_cluster": 0, "phash": 0, "embedding": [1.0, 0.0], "blendshapes": {}, "quality": 0.8}
    names = [c.split()[0] for c in DUP.split(", ")]
    return spark.createDataFrame([tuple((base | {"ord": i, "id": i} | r).get(n) for n in names) for i, r in enumerate(rows)], DUP)


def survivors(spark, rows, **p):
    got = dedup.deduplicate(dedup_rows(spark, rows), Dedup(**p)).collect()
    return sorted(r["id"] for r in got if r["kept"]), {r["id"]: r["duplicate_of"] for r in got if not r["kept"]}


def test_dedup_cases(spark):
    three = [{"timestamp": 0.3 * i, "quality": q} for i, q in enumerate((0.5, 0.9, 0.7))]
    assert survivors(spark, three, keep=1) == ([1], {0: 1, 2: 1})
    assert len(survivors(spark, [{"timestamp": 0.2 * i} for i in range(5)])[0]) == 2
    assert survivors(spark, [{"timestamp": 0.0}, {"timestamp": 30.0}], keep=1)[0] == [0, 1]
    for other in ({"phash": -1}, {"phash": None}, {"embedding": [0.0, 1.0]}, {"embedding": None}, {"identity_cluster": 1}, {"blendshapes": {"a": 1.0}}):
        assert survivors(spark, [{"timestamp": 0.0}, {"timestamp": 0.1, **other}], keep=1)[0] == [0, 1], other
    assert survivors(spark, [{"timestamp": 1.4 * i} for i in range(6)], keep=1)[0] == [0]  # a chain longer than the window
    assert survivors(spark, [{"timestamp": 0.0, "identity_cluster": None}, {"timestamp": 0.1, "identity_cluster": None}], keep=1)[0] == [0]
    assert survivors(spark, [], keep=1) == ([], {})
    assert survivors(spark, [{"timestamp": 0.0, "quality": None}, {"timestamp": 0.1, "quality": 0.1}], keep=1) == ([1], {0: 1})


@pytest.mark.parametrize("one_task", [200_000, 3])
def test_dedup_against_brute_force(spark, one_task, monkeypatch):
    monkeypatch.setattr(dedup, "ISLAND_EDGES", one_task)
    rnd = random.Random(3)
    rows = [{"timestamp": rnd.uniform(0, 60), "identity_cluster": rnd.choice([None, 0, 1]), "phash": rnd.choice([0, 7, 2**40 - 1]), "quality": rnd.choice([None, 0.3, 0.9])} for _ in range(150)]
    group = list(range(len(rows)))
    links = [(i, j) for i, a in enumerate(rows) for j, b in enumerate(rows) if i < j and abs(a["timestamp"] - b["timestamp"]) <= 1.5 and a["identity_cluster"] == b["identity_cluster"] and (a["phash"] ^ b["phash"]).bit_count() <= 8]
    for _ in rows:
        for i, j in links:
            group[i] = group[j] = min(group[i], group[j])
    got = {r["id"]: r["group_id"] for r in dedup.deduplicate(dedup_rows(spark, rows).repartition(5)).collect()}
    assert [got[i] for i in range(len(rows))] == group


def brute_linkage(x, limit):
    clusters = [[i] for i in range(len(x))]
    far = lambda a, b: max(np.linalg.norm(x[i] - x[j]) for i in a for j in b)
    while len(clusters) > 1:
        d, i, j = min((far(a, b), i, j) for i, a in enumerate(clusters) for j, b in enumerate(clusters) if i < j)
        if d >= limit:
            break
        clusters[i] += clusters.pop(j)
    return {frozenset(c) for c in clusters}


def test_complete_linkage_alone_and_in_components(spark):
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 40):
        x = clustering.unit_rows(rng.normal(size=(n, 6)))
        label = clustering.complete_linkage(x, math.sqrt(2 - 2 * 0.5))
        assert {frozenset(np.flatnonzero(label == k)) for k in set(label)} == brute_linkage(x, math.sqrt(2 - 2 * 0.5))
    x = clustering.unit_rows(rng.normal(size=(60, 6)))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "id long, embedding array<double>").repartition(4)
    got = {}
    for r in clustering.linkage_clusters(rows, Clustering(cosine=0.6)).collect():
        got.setdefault(r["cluster"], set()).add(r["id"])
    assert {frozenset(v) for v in got.values()} == brute_linkage(x, math.sqrt(2 - 2 * 0.6))
    with pytest.raises(ComponentTooLarge):
        clustering.linkage_clusters(rows, Clustering(cosine=-1.0, max_component=10)).collect()


def planted(spark, sizes, spread=0.02, dim=32):
    rng = np.random.default_rng(1)
    rows, k = [], 0
    for c, n in enumerate(sizes):
        centre = rng.normal(size=dim) * 3
        for _ in range(n):
            rows.append((k, (centre + spread * rng.normal(size=dim)).tolist(), f"f{k}", 0.9, k, c))
            k += 1
    return spark.createDataFrame(rows, "id long, embedding array<double>, frame_path string, detection_confidence double, ord long, truth int")


def test_identities_and_target(spark):
    got = clustering.cluster_identities(planted(spark, [8, 8, 2]))
    by = {}
    for r in got.collect():
        by.setdefault((r["truth"], r["identity_cluster"]), []).append(r["id"])
    assert {k: len(v) for k, v in by.items()} == {(0, 0): 8, (1, 1): 8, (2, None): 2}
    info = lambda *ns: spark.createDataFrame([(i, n, "f") for i, n in enumerate(ns)], "identity_cluster int, n long, representative string")
    pick = clustering.choose_target
    assert pick(info(90, 10)) == (0, "dominant") and pick(info(60, 40), person=2) == (1, "number") and pick(info(55, 45)) == (0, "largest") and pick(info(55, 45), ask=lambda i: i[1]["identity_cluster"]) == (1, "asked")
    for bad in (lambda: pick(info(5), person=5), lambda: pick(info())):
        with pytest.raises(NoTarget):
            bad()
    apart = planted(spark, [8, 6, 6]).withColumn("video_id", F.when(F.col("truth") == 2, "w").otherwise("v"))
    numbers = {(r["video_id"], r["truth"], r["identity_cluster"]) for r in clustering.cluster_identities(apart, keys=("video_id",)).collect()}
    assert numbers == {("v", 0, 0), ("v", 1, 1), ("w", 2, 0)}
    second = got.where("truth = 1").first()["embedding"]
    assert pick(info(90, 10), got, reference=second) == (1, "reference") and pick(info(90, 10), got, person=1, reference=second) == (0, "number")


CAND = "video_id long, id string, timestamp double, quality double, sharpness double, pose string, expressions array<string>, sel_ord long"


def cand(spark, rows):
    return spark.createDataFrame([(0, f"c{i}", float(t), q, 0.5, p, tags, i) for i, (t, q, p, tags) in enumerate(rows)], CAND).repartition(3)


def model_pack(rows, size):
    """The pack's rules, written once more in the plainest way."""
    cats = []
    for _, _, p, tags in rows:
        own = []
        for n, want, some in __import__("sievewright.functions.categories", fromlist=["x"]).CATEGORIES:
            if (want is None or want == p) and (not some or set(some) & set(tags)):
                own.append(n)
        cats.append(own)
    q = [r[1] or 0 for r in rows]
    chosen, count = [], dict.fromkeys(NAMES, 0)
    for n in NAMES:
        fit = [i for i in range(len(rows)) if i not in chosen and n in cats[i] and q[i] >= 0.35]
        if fit:
            chosen.append(max(fit, key=lambda i: (q[i], -i)))
            count[n] += 1
            if len(chosen) >= size:
                return chosen
    order = sorted((i for i in range(len(rows)) if q[i] > 0 and i not in chosen), key=lambda i: -q[i])
    for i in order:
        if len(chosen) < size and q[i] >= 0.3 and not (cats[i] and all(count[c] >= 4 for c in cats[i])) and all(abs(rows[i][0] - rows[j][0]) >= 2 for j in chosen):
            chosen.append(i)
            for c in cats[i]:
                count[c] += 1
    for i in order:
        if len(chosen) < size and i not in chosen and q[i] >= 0.3:
            chosen.append(i)
    return chosen


def test_packs_against_the_plain_rules(spark):
    rnd = random.Random(6)
    for size in (1, 5, 30):
        rows = [(rnd.uniform(0, 90), rnd.choice([None, 0.05, 0.32, 0.5, 0.8, 0.9]), rnd.choice(schema.POSES), rnd.sample(schema.EXPRESSIONS, rnd.randint(1, 3))) for _ in range(120)]
        got = selection.diverse_pack(cand(spark, rows), size=size).orderBy("pick").collect()
        assert [r["id"] for r in got] == [f"c{i}" for i in model_pack(rows, size)]
    assert selection.diverse_pack(cand(spark, [(0, 0.05, "front", ["neutral"])] * 3)).where("phase = 1").count() == 0


def test_reference_pack(spark):
    got = selection.reference_pack(cand(spark, [(0, 0.8, "profile_left", ["neutral"]), (1, 0.8, "front", ["neutral"])]), size=1).collect()
    assert [r["id"] for r in got] == ["c1"]
    many = [(i, 0.8, schema.POSES[i % 5], ["neutral"]) for i in range(20)]
    assert selection.reference_pack(cand(spark, many), size=5).count() == 5 and selection.reference_pack(cand(spark, [])).count() == 0
    same = [(i, 0.9 - i / 100, "front", ["neutral"]) for i in range(9)]
    assert [r["id"] for r in selection.reference_pack(cand(spark, same), size=12).orderBy("pick").collect()] == [f"c{i}" for i in range(6)]


def test_synthesis(spark):
    rows = lambda *r: spark.createDataFrame([(f"c{i}", i, *x) for i, x in enumerate(r)], "id string, ord long, pose string, expressions array<string>, quality double")
    assert synthesis.missing_categories(rows()).count() == 17
    assert "front_neutral" not in {r["category"] for r in synthesis.missing_categories(rows(("front", ["neutral"], 0.8))).collect()}
    assert "front_neutral" in {r["category"] for r in synthesis.missing_categories(rows(("front", ["neutral"], 0.2))).collect()}
    assert synthesis.missing_categories(rows(("front", ["neutral"], 0.8)), mode="full", most=3).count() == 3
    base = {r["category"]: r["base_id"] for r in synthesis.plan(rows(("front", ["neutral"], 0.5), ("three_quarter_left", [], 0.4), ("looking_up", [], 0.9), (None, [], 1.0)), mode="full").collect()}
    assert base["left_profile"] == "c1" and base["right_profile"] == "c0" and base["looking_up"] == "c2" and base["talking"] == "c0"
    lone = {r["base_id"] for r in synthesis.plan(rows(("profile_left", [], 0.5)), mode="full").collect()}
    assert lone == {"c0"} and {r["base_id"] for r in synthesis.plan(rows(("front", [], None)), mode="full").collect()} == {None}


def test_reports_and_checkpoints(spark, tmp_path):
    images = spark.createDataFrame([(1, "a", 0.95, "front", ["neutral", "talking"]), (2, "b", 0.55, "front", ["neutral"])], "position long, id string, quality double, pose string, expressions array<string>")
    m = reports.manifest(images, {"id": "v"}, {"faces_found": 2}).first()
    assert m["quality_distribution"] == {"50-60%": 1, "90-100%": 1} and m["expression_distribution"] == {"neutral": 2, "talking": 1} and m["pose_distribution"] == {"front": 2} and [i["id"] for i in m["images"]] == ["a", "b"]
    empty = reports.manifest(images.limit(0), {"id": "v"}, {}).first()
    assert empty["images"] == [] and empty["pose_distribution"] == {}
    from sievewright.sources import readers, sinks

    sinks.write_manifest(reports.manifest(images, {"id": "v"}, {"faces_found": 2}), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first()["faces_found"] == 2
    assert "Images" in sinks.report(reports.manifest(images, {"id": "<v>"}, {"faces_found": 2})) and "&lt;v&gt;" in sinks.report(reports.manifest(images, {"id": "<v>"}, {}))
    store, calls = Checkpoints(spark, str(tmp_path / "store")), []
    build = lambda: calls.append(1) or images
    keys = [parameter_key(Clustering()), parameter_key(Clustering(cosine=0.4))]
    assert store.stage("s", keys[0], build).count() == store.stage("s", keys[0], build).count() == 2 and calls == [1] and keys[0] != keys[1]
    store.drop("s")
    assert not store.has("s", keys[0])
    r = one(spark, readers.parse_hash(F.lit("ffffffffffffffff")), readers.parse_hash(F.lit("zz")), readers.parse_hash(F.lit("1f")))
    assert tuple(r) == (-1, None, 31)
    (tmp_path / "bad.json").write_text("{nope")
    (tmp_path / "good.json").write_text('{"a": 1}')
    from pyspark.sql import types as T

    assert [r["a"] for r in readers.read_json(spark, str(tmp_path / "*.json"), T.StructType([T.StructField("a", T.LongType())])).collect()] == [1]


def test_curation_end_to_end(spark):
    from sievewright.plans.curate import curate

    rows = planted(spark, [20, 5]).withColumns({"video_id": F.lit("v"), "frame_number": F.col("id"), "timestamp": F.col("id") * 0.5, "blendshapes": F.create_map().cast("map<string,double>"), "phash": F.lit(0).cast("long"), "pose": F.lit("front"), "expressions": F.array(F.lit("neutral")), "quality": 0.5 + F.col("id") / 100, "sharpness": F.lit(0.5)})
    got = curate(spark, rows)
    assert got.why == "dominant" and got.survivors.count() == 2 and got.pack.count() == 2 and got.plan.count() == 16
    m = got.manifest.first()
    assert m["faces_found"] == 25 and m["after_dedup"] == 2 and len(m["images"]) == 2


def test_hash_of_images():
    rng = np.random.default_rng(2)
    img = np.kron(rng.integers(0, 255, (8, 8)), np.ones((6, 6))).astype(float)
    near = (pixels.hash_bits(img) ^ pixels.hash_bits(img + rng.normal(0, 3, img.shape))) & (2**64 - 1)
    far = (pixels.hash_bits(img) ^ pixels.hash_bits(np.kron(rng.integers(0, 255, (8, 8)), np.ones((6, 6))))) & (2**64 - 1)
    assert near.bit_count() <= 8 < far.bit_count() and pixels.hash_bits(np.zeros((0, 0))) is None


def test_plugged_models(spark):
    from sievewright.operators.inference import detect, embed

    frames = spark.createDataFrame([("v", 1, 0.0, bytearray(b"ab")), ("v", 2, 1.0, bytearray(b"")), ("v", 3, 2.0, bytearray(b"bad"))], "video_id string, frame_number long, timestamp double, content binary")

    def detector():
        def run(content):
            if content == b"bad":
                raise ValueError("no image")
            return [(1.5, -2.0, 10.0 * (i + 1), 10.0, 0.7 + 0.2 * i) for i in range(len(content))]

        return run

    got = detect(frames, detector).collect()
    assert [(r["frame_number"], r["position"], tuple(r["bbox"]), r["candidate_id"]) for r in got] == [(1, 1, (1, 0, 20, 10), "f00000001_1_0_20_10")]
    rows = detect(frames, detector, 0.5).join(frames.select("frame_number", "content"), "frame_number")
    made = embed(rows, lambda: lambda content, box: None if box[2] == 20 else np.ones(4)).collect()
    assert [list(r["embedding"]) for r in made] == [[1.0] * 4]


def test_command_line(spark, tmp_path, capsys):
    from sievewright.cli import main

    rows = planted(spark, [20, 5]).withColumns({"video_id": F.lit("v"), "frame_number": F.col("id"), "timestamp": F.col("id") * 0.5, "blendshapes": F.create_map().cast("map<string,double>"), "phash": F.lit(0).cast("long"), "pose": F.lit("front"), "expressions": F.array(F.lit("neutral")), "quality": 0.5 + F.col("id") / 100, "sharpness": F.lit(0.5)})
    rows.write.parquet(str(tmp_path / "in"))
    args = [str(tmp_path / "in"), "--output", str(tmp_path / "out"), "--checkpoints", str(tmp_path / "kept")]
    assert main(args, spark) == 0 and "identity 0 (dominant)" in capsys.readouterr().out
    assert spark.read.json(str(tmp_path / "out" / "manifest")).first()["faces_found"] == 25
    assert spark.read.parquet(str(tmp_path / "out" / "pack")).count() == 2
    assert main([*args, "--person", "9"], spark) == 1 and "out of range" in capsys.readouterr().err


@pytest.mark.parametrize("limit", [0.2, 0.5])
def test_large_components_merge_in_rounds(spark, monkeypatch, limit):
    """Blocks and tasks far smaller than the components: rounds of mutual nearest neighbours give the whole set's clusters."""
    monkeypatch.setattr(clustering, "BLOCK_ROWS", 40)
    monkeypatch.setattr(clustering, "TASK_CLUSTERS", 8)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(260, 4))
    x = np.concatenate([x, x[:40], x[:40], np.zeros((2, 4))])  # copies, and vectors without a length
    rows = spark.createDataFrame([(f"r{i:04d}", "v", v.tolist()) for i, v in enumerate(x)] + [("none", "v", None)], "id string, video_id string, embedding array<double>").repartition(5)
    got = {}
    for r in clustering.linkage_clusters(rows, Clustering(cosine=limit), keys=("video_id",)).collect():
        got.setdefault(r["cluster"], set()).add(int(r["id"][1:]))
    label = clustering.complete_linkage(clustering.unit_rows(x), math.sqrt(2 - 2 * limit))
    assert {frozenset(v) for v in got.values()} == {frozenset(np.flatnonzero(label == k).tolist()) for k in set(label.tolist())}
    assert all(k == f"r{min(v):04d}" for k, v in got.items())


def test_spanning_links_leave_the_components():
    rng = np.random.default_rng(3)
    near = rng.random((60, 50)) < 0.03
    p, q = clustering._forest(near)
    assert len(p) < 110 and all(near[p, q])
    reach = lambda pairs: {frozenset(c) for c in _joined(60 + 50, pairs)}
    assert reach([(i, 60 + j) for i, j in zip(*np.nonzero(near), strict=True)]) == reach([(i, 60 + j) for i, j in zip(p, q, strict=True)])


def _joined(n, pairs):
    of = [{i} for i in range(n)]
    for a, b in pairs:
        if of[a] is not of[b]:
            of[a] |= of[b]
            for i in of[b]:
                of[i] = of[a]
    return of


def test_pairs_over_the_borders_of_stretches(spark):
    """A person seen without a gap for long: links are those of all pairs within the window, to its very end."""
    rows = [(k, k * 0.5, k, 1, 7, [1.0, 0.0], {}) for k in range(60)] + [(100, 1.7e9, 100, 1, 7, [1.0, 0.0], {}), (101, 1.7e9 + 1.5, 101, 1, 7, [1.0, 0.0], {}), (102, None, 102, 1, 7, [1.0, 0.0], {})]
    frame = spark.createDataFrame(rows, "id long, timestamp double, ord long, identity_cluster int, phash long, embedding array<double>, blendshapes map<string,double>")
    got = {(r["a"], r["b"]) for r in dedup.duplicate_edges(frame).collect()}
    assert got == {(a, b) for a in range(60) for b in range(a + 1, a + 4) if b < 60} | {(100, 101)}


def test_reference_pack_of_thinned_out_rows(spark):
    """Leaving out rows that can't be picked changes no pack."""
    rnd = random.Random(13)
    rows = [(k, rnd.choice([0.3, 0.5, 0.7, 0.9]), rnd.choice(schema.POSES), rnd.sample(schema.EXPRESSIONS, rnd.randint(1, 3))) for k in range(400)]
    frame = cand(spark, rows)
    scored = frame.where("quality is not null").withColumn("score", selection.reference_score(F.col("quality"), F.col("sharpness"), F.col("pose"))).withColumn("cats", selection.categories_for(F.col("pose"), F.col("expressions"))).orderBy("sel_ord").collect()
    want = selection.fold_reference([(r["id"], r["score"], r["cats"]) for r in scored], 16, 3)
    assert [r["id"] for r in selection.reference_pack(frame, size=16).orderBy("pick").collect()] == want


def test_merges_over_links_are_those_of_the_whole_matrix():
    rng = np.random.default_rng(2)
    for n, dim, least in ((1, 3, 0.1), (200, 4, 0.2), (300, 32, 0.1)):
        d = clustering.squares(*[clustering.unit_rows(rng.normal(size=(n, dim)))] * 2)
        a, b = np.nonzero(np.triu(d < 2 - 2 * least, 1))
        assert clustering.merge_links(a, b, d[a, b], n).tolist() == clustering.agglomerate(d, 2 - 2 * least).tolist()


def test_levels_need_few_passes_and_many_tasks(spark, monkeypatch):
    """A component larger than all limits: a few passes over all pairs instead of one for each round of merges; block pairs are
    dealt to several tasks, however few bytes they have; links beyond a task's are merged by joins."""
    for name, value in {"BLOCK_ROWS": 50, "TASK_CLUSTERS": 2, "LEVEL_LINKS": 20, "TASK_LINKS": 100}.items():
        monkeypatch.setattr(clustering, name, value)
    passes, deal = [], clustering._block_pairs
    monkeypatch.setattr(clustering, "_block_pairs", lambda *a: passes.append(a) or deal(*a))
    x = np.random.default_rng(8).normal(size=(150, 5))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>").repartition(3)
    assert clustering.similar_pairs(rows, 0.3).rdd.getNumPartitions() > 1
    passes.clear()
    got = sorted((r["id"], r["cluster"]) for r in clustering.linkage_clusters(rows, Clustering(cosine=0.3)).collect())
    assert [c for _, c in got] == clustering.complete_linkage(clustering.unit_rows(x), math.sqrt(1.4)).tolist()
    assert len(passes) <= 7


def test_identities_of_a_large_component_need_few_passes(spark, monkeypatch):
    rows = planted(spark, [30, 20, 12], spread=2.5, dim=8)
    whole = sorted((r["id"], r["identity_cluster"]) for r in clustering.cluster_identities(rows, Clustering(cosine=0.1)).collect())
    for name, value in {"BLOCK_ROWS": 30, "TASK_CLUSTERS": 2}.items():
        monkeypatch.setattr(clustering, name, value)
    passes, deal = [], clustering._block_pairs
    monkeypatch.setattr(clustering, "_block_pairs", lambda *a: passes.append(a) or deal(*a))
    assert sorted((r["id"], r["identity_cluster"]) for r in clustering.cluster_identities(rows, Clustering(cosine=0.1)).collect()) == whole
    assert len(passes) <= 4 and len({c for _, c in whole}) > 2


def test_blocks_are_sent_packed(spark, monkeypatch):
    """A pass over the pairs of blocks sends a row for each block, not each vector once for every block."""
    for name, value in {"BLOCK_ROWS": 40, "TASK_CLUSTERS": 2}.items():
        monkeypatch.setattr(clustering, name, value)
    sent, deal = [], clustering._block_pairs
    monkeypatch.setattr(clustering, "_block_pairs", lambda *a: sent.append(a[0]) or deal(*a))
    x = np.random.default_rng(4).normal(size=(120, 5))
    rows = spark.createDataFrame([(f"r{i:03d}", v.tolist()) for i, v in enumerate(x)], "id string, embedding array<double>")
    got = sorted((r["id"], r["cluster"]) for r in clustering.linkage_clusters(rows, Clustering(cosine=0.3)).collect())
    label = clustering.complete_linkage(clustering.unit_rows(x), math.sqrt(1.4))
    assert [c for _, c in got] == [f"r{k:03d}" for k in label]
    assert len(sent) > 1 and all(s.count() <= 3 for s in sent)


@pytest.mark.parametrize("layer", [1, 3, 64])
def test_farthest_members_of_clusters_of_all_sizes(monkeypatch, layer):
    monkeypatch.setattr(clustering, "LAYER_CLUSTERS", layer)
    rng = np.random.default_rng(6)
    for sizes in ([1], [1, 1, 1], [3, 1, 9, 2, 2], [1, 1100, 4, *[2] * 70]):
        number = np.repeat(np.arange(len(sizes)), sizes)
        x = clustering.unit_rows(rng.normal(size=(len(number), 3)))
        d = clustering.squares(x, x)
        want = [[d[np.ix_(number == a, number == b)].max() for b in range(len(sizes))] for a in range(len(sizes))]
        for cells in (1, 5, 1 << 20):
            assert np.allclose(clustering.farthest(x, number, cells), want, rtol=0, atol=2e-12)
