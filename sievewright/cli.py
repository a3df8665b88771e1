"""Command line: curate a table of candidates, or the frames of one video with plugged-in models.

Exit codes: 0 done, 1 an expected error, 130 interrupted.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from collections.abc import Callable
from dataclasses import fields, replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .checkpoints import Checkpoints, clean, written
from .errors import CurationError, MissingTool
from .operators.inference import reference_vector
from .params import Clustering, Dedup, Sampling, Selection
from .plans import footage
from .plans.curate import Curation, Result, curate
from .sources.sinks import caption_rows, report, write_by_pose, write_caption_files, write_manifest

GROUPS = (Sampling, Clustering, Dedup, Selection)
MODELS = ("detector", "embedder", "decoder", "analyser", "poser")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sievewright", description="Curate candidates of one video into a pack.")
    p.add_argument("candidates", help="Parquet table of candidates; with --videos, of frames (video_id, frame_number, frame_path, content)")
    p.add_argument("--output", required=True, help="folder for manifest, pack, plan and report")
    p.add_argument("--person", type=int, help="number of the identity, 1 for the largest")
    p.add_argument("--reference", help="JSON file with the vector, or, with --videos, an image of the person to look for")
    p.add_argument("--ask", action="store_true", help="ask on the terminal if no identity is dominant")
    p.add_argument("--mode", choices=["missing", "full"], default="missing", help="which categories to plan a synthesis for")
    p.add_argument("--checkpoints", help="folder in which stages are kept for a later run")
    p.add_argument("--forget-checkpoints", action="store_true", help="remove them after a whole run")
    p.add_argument("--videos", help="Parquet table (video_id, fps, total_frames): start from frames")
    p.add_argument("--trigger", default="person", help="first word of captions")
    for name in MODELS:
        p.add_argument(f"--{name}", help="package.module:factory")
    for group in GROUPS:
        for f in fields(group):
            kind = type(f.default) if f.default is not None else int if f.name.startswith("max_component") else float
            p.add_argument(f"--{group.__name__.lower()}-{f.name.replace('_', '-')}", type=kind, default=f.default)
    return p


def _group(args: argparse.Namespace, group: type):
    return group(**{f.name: getattr(args, f"{group.__name__.lower()}_{f.name}") for f in fields(group)})


def factory(name: str | None, what: str) -> Callable:
    """The function that package.module:name names."""
    try:
        module, _, attribute = (name or "").partition(":")
        return getattr(importlib.import_module(module), attribute)
    except (ImportError, ValueError, AttributeError) as error:
        raise MissingTool(f"no {what}: {name or 'none was named'}") from error


def ask_on_terminal(infos: list, read: Callable[[str], str] = input, say: Callable[[str], None] = print) -> int:
    """The identity that the user names by its number, asked again until the answer is one."""
    for k, info in enumerate(infos, 1):
        say(f"{k}: {info['n']} detections, {info['representative']}")
    while True:
        answer = read(f"person (1-{len(infos)}): ").strip()
        if answer.isdigit() and 1 <= int(answer) <= len(infos):
            return infos[int(answer) - 1]["identity_cluster"]
        say("please give one of the numbers")


def _write(got: Result, output: str, page: str) -> None:
    write_manifest(got.manifest, f"{output}/manifest")
    write_by_pose(got.survivors.join(got.pack.select("id", "pick", "phase", "categories"), "id").drop("sel_ord"), f"{output}/pack")
    got.plan.write.mode("overwrite").parquet(f"{output}/plan")
    got.plan.sparkSession.createDataFrame([(page,)], "page string").coalesce(1).write.mode("overwrite").text(f"{output}/report", lineSep="\n")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        spark = spark or SparkSession.builder.appName("sievewright").getOrCreate()
        rows, before = spark.read.parquet(args.candidates), written()
        store = Checkpoints(spark, args.checkpoints) if args.checkpoints else None
        asked = ask_on_terminal if args.ask and sys.stdin.isatty() else None
        p = Curation(_group(args, Clustering), _group(args, Dedup), _group(args, Selection), args.person, mode=args.mode)
        if args.videos:
            made = {name: factory(getattr(args, name), name) for name in MODELS if name != "poser" or args.poser}
            if args.reference:
                with open(args.reference, "rb") as image:
                    p = replace(p, reference=tuple(reference_vector(image.read(), made["detector"](), made["embedder"]())))
            whole = footage.run(spark, spark.read.parquet(args.videos), rows, footage.Models(**made), footage.Footage(_group(args, Sampling), p, trigger=args.trigger), store, args.candidates, asked)
            got = whole.result
            _write(got, args.output, report(got.manifest, whole.sheets))
            captions = got.survivors.join(got.pack.select("id"), "id").select(*footage.FRAME, "id", "frame_path", "caption")
            files = caption_rows(captions).join(captions.select(F.concat_ws("_", F.lit("frame"), F.lpad(F.col("frame_number").cast("string"), 8, "0"), "id").alias("file"), *footage.FRAME, "frame_path"), "file")
            write_caption_files(files.withColumn("file", F.translate("file", "/", "_")).join(rows.select(*footage.FRAME, "content"), footage.FRAME), f"{args.output}/captions")
        else:
            if args.reference:
                with open(args.reference) as f:
                    p = replace(p, reference=tuple(map(float, json.load(f))))
            got = curate(spark, rows, p, store, args.candidates, asked)
            _write(got, args.output, report(got.manifest))
        if store and args.forget_checkpoints:
            store.drop("frames", "identity")
        clean(spark, before)
    except CurationError as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    except KeyboardInterrupt:
        return 130
    print(f"identity {got.target} ({got.why})")
    return 0


if __name__ == "__main__":
    sys.exit(main())
