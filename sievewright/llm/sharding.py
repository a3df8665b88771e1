"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash within each source and ranked there; sorting by the fractional rank, the rank over the
source's number of rows, spreads every source evenly over the whole order. Cutting that order into runs of equal length
gives shards that each have the corpus's mixture and row counts at most one apart: the law `rows`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, text_or_empty
from .ranking import positions


def shard(docs: DataFrame, shards: int = 40, seed: int = 17, source: str = "source") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, source) for each row of docs (doc_id, text, source).

    size is the UTF-8 bytes of the text plus 16, a null text having none; text_crc32 is that of the text (null: of nothing).
    Rows with a null source are a source of their own, a missing source column makes all rows one. Equal keys of the
    shuffle (repeated rows) are told apart by doc_id, then by crc and size; rows equal in all of these can be exchanged
    without a change to the result. Rows with a null doc_id share a key, and so lie side by side among those of their source, by
    crc and size. Columns of other names, even those of the result, change nothing. With fewer rows than shards, some shards are empty. grown_shard is null: another number
    of shards is another cut, which the law `rows` doesn't bind to the old one.
    """
    text = text_or_empty()
    of = F.col(source).cast("string") if source in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(16)).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), of.alias("_source"))
    rows = rows.withColumn("_shuffled", F.xxhash64(F.lit(seed), "doc_id"))
    ranked = cut(positions(rows, ["_source", "_shuffled", "doc_id", "text_crc32", "size"], within="_source").withColumnRenamed("position", "_rank"))
    totals = ranked.groupBy("_source").agg(F.count("*").alias("_n")).withColumnRenamed("_source", "_of")
    spread = ranked.join(totals, F.col("_source").eqNullSafe(F.col("_of"))).withColumn("_fraction", (F.col("_rank") + 0.5) / F.col("_n")).drop("_rank", "_n", "_of")
    placed = positions(spread, ["_fraction", "_source", "_shuffled", "doc_id", "text_crc32", "size"])
    total = max(1, ranked.count())
    first = F.expr(f"(shard * cast({total} as long) + {shards - 1}) div {shards}")
    out = placed.withColumn("shard", F.expr(f"cast((position * {shards}) div {total} as int)")).withColumn("slot", (F.col("position") - first).cast("long"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("_source").alias("source"))
