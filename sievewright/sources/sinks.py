"""Sinks: manifest, caption data set, fan-out by pose, and an HTML report."""

from __future__ import annotations

import html
import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import label
from ..shipping import ship


def write_manifest(manifest: DataFrame, path: str) -> None:
    """One JSON file; Spark commits it when it is whole."""
    manifest.coalesce(1).write.mode("overwrite").json(path)


def caption_rows(images: DataFrame, captions: str = "caption", source: str = "frame_path") -> DataFrame:
    """(file, caption) of the data set; rows without a source are left out."""
    return images.where(F.col(source).isNotNull()).select(F.concat_ws("_", F.lit("frame"), F.lpad(F.col("frame_number").cast("string"), 8, "0"), "id").alias("file"), F.col(captions).alias("caption"))


def write_captions(rows: DataFrame, path: str) -> None:
    """A Parquet data set of files and captions. One small text file a row doesn't suit a shared store."""
    rows.write.mode("overwrite").parquet(path)


def write_by_pose(images: DataFrame, path: str, pose: str = "pose") -> None:
    """Metadata under a folder for each pose."""
    images.write.mode("overwrite").partitionBy(pose).parquet(path)


def links_by_category(images: DataFrame, categories: str = "categories") -> DataFrame:
    """(category, id) for each category of each image: what a link in a folder would say."""
    return images.select(F.explode(categories).alias("category"), "id")


def write_caption_files(rows: DataFrame, path: str) -> int:
    """A folder with, for each row (file, frame_path, caption, content), the image as it was, and its caption in a .txt beside it.

    Executors write, by any address that pyarrow's file systems know; a task that is repeated writes the same files
    again. Rows without a source or content are left out. Returns how many images were written.
    """
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pa_fs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")
        fs.create_dir(folder, recursive=True)
        for batch in batches:
            for row in batch.to_pylist():
                suffix = os.path.splitext(row["frame_path"])[1] or ".jpg"
                for name, data in ((row["file"] + suffix, row["content"]), (row["file"] + ".txt", (row["caption"] or "").encode())):
                    with fs.open_output_stream(f"{folder}/{name}") as out:
                        out.write(data)
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    usable = rows.where("frame_path is not null and content is not null").select("file", "frame_path", "caption", "content")
    return usable.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _grid(title: str, images: list[dict], words, badge: str = "") -> str:
    esc = lambda x: html.escape(str(x if x is not None else ""))
    cells = "".join(f"<figure>{badge}<img src='{esc(i.get('file') or i.get('frame_path') or i.get('id'))}' loading='lazy'><figcaption>{esc(words(i))}</figcaption></figure>" for i in images)
    return f"<section><h2>{esc(title)}</h2><div class='grid'>{cells or '<p>There is none.</p>'}</div></section>"


def _sheet(title: str, cells: list[dict], files: dict) -> str:
    esc = lambda x: html.escape(str(x))
    rows: dict[int, dict[int, dict]] = {}
    for c in cells:
        rows.setdefault(c["row"], {})[c["col"]] = c
    key = next((k for k in (cells[0] if cells else {}) if k not in ("id", "row", "col", "rows")), "id")
    body = "".join("<tr>" + "".join(f"<td><img src='{esc(files.get(c['id'], c['id']))}'><br>{esc(str(c[key]).replace('_', ' '))}</td>" for _, c in sorted(r.items())) + "</tr>" for _, r in sorted(rows.items()))
    return f"<section><h2>{esc(title)}</h2><table class='sheet'>{body}</table></section>"


def report(manifest: DataFrame, sheets: dict[str, DataFrame] | None = None) -> str:
    """An HTML page of a manifest's one row: counts, distributions, contact sheets, grids of the reference pack, of expressions, head
    angles and bodies, and synthetic images under a heading of their own, marked as such. All text is escaped."""
    row = manifest.first().asDict(recursive=True)
    esc = lambda x: html.escape(str(x))
    table = lambda title, items: f"<section><h2>{esc(title)}</h2><table>" + "".join(f"<tr><th>{esc(k)}</th><td>{esc(v)}</td></tr>" for k, v in items) + "</table></section>"
    images = row["images"]
    files = {i.get("id"): i.get("file") or i.get("frame_path") or i.get("id") for i in images}
    by_id = {i.get("id"): i for i in images}
    parts = [table("Video", row["video"].items()), table("Counts", ((k, v) for k, v in row.items() if isinstance(v, int)))]
    parts += [table(name.replace("_", " ").capitalize(), (row.get(name) or {}).items()) for name in ("quality_distribution", "expression_distribution", "pose_distribution")]
    parts += [_sheet(f"{name.capitalize()} sheet", [r.asDict() for r in df.collect()], files) for name, df in (sheets or {}).items()]  # at most a cell for each pose or tag
    if row.get("reference_pack"):
        parts.append(_grid("Best references", [by_id[i] for i in row["reference_pack"] if i in by_id], lambda i: i.get("pose")))
    parts.append(table("Images", ((i.get("id"), f"{i.get('pose')}, {', '.join(i.get('expressions') or [])}") for i in images)))
    parts.append(_grid("Expressions", images, lambda i: ", ".join(i.get("expressions") or [])))
    parts.append(_grid("Head angles", images, lambda i: f"{i.get('pose')} ({i['yaw']:.0f}\u00b0)" if i.get("yaw") is not None else i.get("pose")))
    parts.append(_grid("Bodies", [i for i in images if i.get("body_visibility") not in (None, "none")], lambda i: i.get("body_visibility")))
    if row.get("synthesized_images"):
        parts.append(_grid("Synthetic images", row["synthesized_images"], lambda i: f"{i.get('category')}: {i.get('prompt')}", badge="<b class='synthetic'>not from the footage</b>"))
    style = ".grid{display:flex;flex-wrap:wrap;gap:8px}figure{margin:0;max-width:180px}img{max-width:100%}.synthetic{color:#a00}"
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Report</title><style>{style}</style></head><body>" + "".join(parts) + "</body></html>"


def labelled(items: DataFrame, key: str) -> DataFrame:
    return items.withColumn("label", label(F.col(key)))
