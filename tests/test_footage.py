"""The whole run from frames to report, with models that read what a frame's bytes say."""

import json
import os
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from sievewright.checkpoints import Checkpoints
from sievewright.cli import ask_on_terminal, factory, main
from sievewright.errors import MissingTool, NothingDetected
from sievewright.operators import inference
from sievewright.params import Clustering, Dedup, Sampling
from sievewright.plans import footage
from sievewright.plans.curate import Curation
from sievewright.sources.sinks import report

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import the tests
SIDE = 200


def face(who, x, smile=0.0, yaw=0.0):
    return {"who": who, "box": [x, 40, 60, 60], "smile": smile, "yaw": yaw}


def content(faces, seed):
    return json.dumps({"faces": faces, "seed": seed}).encode()


def detector():
    return lambda b: [(*f["box"], 0.9) for f in json.loads(b)["faces"]]


def _of(b, box):
    return next(f for f in json.loads(b)["faces"] if f["box"][0] == box[0])


def embedder():
    def run(b, box):
        f = _of(b, box)
        if f["who"] is None:
            raise ValueError("no face")
        v = np.zeros(16)
        v[f["who"]] = 1.0
        return v + 0.01 * np.random.default_rng(json.loads(b)["seed"]).normal(size=16)

    return run


def decoder():
    def run(b):
        return np.kron(np.random.default_rng(json.loads(b)["seed"]).integers(0, 255, (20, 20, 3)), np.ones((10, 10, 1)))

    return run


def analyser():
    def run(b, box):
        f = _of(b, box)
        a = np.radians(f["yaw"])
        turn = [[np.cos(a), 0, np.sin(a), 0], [0, 1, 0, 0], [-np.sin(a), 0, np.cos(a), 0], [0, 0, 0, 1]]
        return {"blendshapes": {"mouthSmileLeft": f["smile"], "mouthSmileRight": f["smile"]}, "points": [(0.5, 0.5)] * 10, "transform": turn}

    return run


def poser():
    return lambda b: [[(0.3, 0.3, 1.0)] * 33]


MODELS = footage.Models(detector, embedder, decoder, analyser, poser)


@pytest.fixture(scope="module")
def video(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("frames")
    rows = []
    for k in range(60):
        faces = [face(0, 20, smile=(k // 20) * 0.4, yaw=(k % 3) * 30.0)] if k % 2 == 0 else []
        faces += [face(1, 110)] if k % 3 == 0 else []
        faces += [face(None, 150)] if k == 4 else []
        path = str(folder / f"f{k}.img")
        data = content(faces, k) if k != 6 else b"broken"
        with open(path, "wb") as f:
            f.write(data)
        rows.append(("v", k, path, bytearray(data)))
    frames = spark.createDataFrame(rows, "video_id string, frame_number long, frame_path string, content binary").repartition(3)
    return spark.createDataFrame([("v", 2.0, 60)], "video_id string, fps double, total_frames long"), frames, folder


P = footage.Footage(sampling=Sampling(fps=2.0), curation=Curation(clustering=Clustering(cosine=0.6), dedup=Dedup(window=0.1)))


def test_frames_to_report(spark, video):
    videos, frames, _ = video
    got = footage.run(spark, videos, frames, MODELS, P, source="here")
    m = got.result.manifest.first()
    assert m["frames_examined"] == 60 and m["faces_found"] == 48 and m["identities_found"] == 2 and got.result.why == "largest"
    survivors = got.result.survivors.collect()
    assert len(survivors) == 29 == m["after_dedup"] and {r["frame_number"] for r in survivors} == set(range(0, 60, 2)) - {6}
    by = {r["frame_number"]: r for r in survivors}
    assert by[0]["pose"] == "front" and by[2]["pose"] == "profile_right" and by[4]["pose"] == "three_quarter_right" and "big_smile" in by[54]["expressions"] and by[0]["body_visibility"] == "full_body"
    assert by[0]["caption"].startswith("person, ") and "shirt" in by[0]["caption"] and 0 < by[0]["quality"] <= 1 and by[0]["crops"]["face"] is not None and by[0]["phash"] is not None
    assert m["images"] and set(m["reference_pack"]) <= {i["id"] for i in m["images"]}
    assert {r["pose"] for r in got.sheets["poses"].collect()} == {"front", "three_quarter_right", "profile_right"}
    page = report(got.result.manifest, got.sheets)
    assert all(x in page for x in ("Poses sheet", "Identity sheet", "Best references", "Head angles", "Bodies", "<table class='sheet'>"))


def test_target_by_vector_and_by_asking(spark, video):
    videos, frames, _ = video
    image = content([face(None, 0), face(1, 30)], 99)
    vector = inference.reference_vector(content([face(1, 30)], 99), detector(), embedder())
    by_vector = footage.run(spark, videos, frames, MODELS, footage.Footage(P.sampling, Curation(P.curation.clustering, P.curation.dedup, reference=tuple(vector))))
    assert by_vector.result.why == "reference" and by_vector.result.survivors.count() == 19
    said = iter(["x", "0", "2"])
    asked = footage.run(spark, videos, frames, MODELS, P, ask=lambda infos: ask_on_terminal(infos, lambda _: next(said), lambda _: None))
    assert asked.result.why == "asked" and asked.result.survivors.count() == 19
    with pytest.raises(NothingDetected):
        inference.reference_vector(content([], 1), detector(), embedder())
    with pytest.raises(ValueError):
        inference.reference_vector(image, lambda b: [(0, 0, 60, 60, 0.5)], embedder())
    with pytest.raises(NothingDetected):
        footage.run(spark, videos, frames.where("frame_number = 1"), MODELS, P)


def test_frame_checkpoint_lasts_as_long_as_its_frames(spark, video, tmp_path):
    videos, frames, folder = video
    store = Checkpoints(spark, str(tmp_path / "store"))
    first = footage.detections(spark, videos, frames, MODELS, P, store, "s").count()
    none = frames.where("false")
    assert footage.detections(spark, videos, none, MODELS, P, store, "s").count() == first
    other = footage.Footage(Sampling(fps=1.0))
    assert footage.detections(spark, videos, none, MODELS, other, store, "s").count() == 0
    moved = str(folder) + "-moved"
    os.rename(folder, moved)
    try:
        assert footage.detections(spark, videos, none, MODELS, P, store, "s").count() == 0
    finally:
        os.rename(moved, folder)


def test_command_line_from_frames(spark, video, tmp_path, capsys):
    videos, frames, _ = video
    frames.write.parquet(str(tmp_path / "frames"))
    videos.write.parquet(str(tmp_path / "videos"))
    image = tmp_path / "who.img"
    image.write_bytes(content([face(1, 30)], 5))
    out = str(tmp_path / "out")
    args = [str(tmp_path / "frames"), "--videos", str(tmp_path / "videos"), "--output", out, "--reference", str(image), "--clustering-cosine", "0.6", "--sampling-fps", "2", "--dedup-window", "0.1"]
    models = [x for name in ("detector", "embedder", "decoder", "analyser", "poser") for x in (f"--{name}", f"test_footage:{name}")]
    assert main([*args, *models], spark) == 0 and "reference" in capsys.readouterr().out
    written = sorted(os.listdir(f"{out}/captions"))
    assert any(w.endswith(".txt") for w in written) and len([w for w in written if w.endswith(".txt")]) == len([w for w in written if w.endswith(".img")])
    one_ = next(w for w in written if w.endswith(".txt"))
    assert open(f"{out}/captions/{one_}").read().startswith("person") and b"faces" in open(f"{out}/captions/{one_[:-4]}.img", "rb").read()
    assert "Bodies" in "".join(r[0] for r in spark.read.text(f"{out}/report").collect())
    assert main(args, spark) == 1
    with pytest.raises(MissingTool):
        factory("nowhere:x", "detector")


def test_measures_of_what_is_no_image(spark):
    rows = spark.createDataFrame([("a", bytearray(b"broken"), (0, 0, 5, 5)), ("b", bytearray(content([], 1)), (500, 500, 5, 5)), ("c", bytearray(content([], 1)), (10, 10, 50, 50))], "id string, content binary, bbox struct<x:int,y:int,w:int,h:int>")
    got = {r["id"]: r for r in inference.measure(rows, decoder).collect()}
    assert got["a"]["laplacian"] is None and got["a"]["width"] is None and got["b"]["phash"] is None and got["b"]["width"] == SIDE and got["c"]["artifact"] is not None and got["c"]["shirt"] is not None
    assert inference.analyse(rows.where("id = 'a'"), analyser).select(F.col("points").isNull()).first()[0]
