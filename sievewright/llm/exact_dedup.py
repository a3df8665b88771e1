"""Exact dedup: group by a 128-bit content hash, keep one row of each group, and compare bytes inside the groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut, text_or_empty

#: White space that the normal form leaves out. Fixed values.
DELETED = [" ", "\t", "\n", "\x0b", "\x0c", "\r"]


def normalised(text: Column) -> Column:
    for c in DELETED:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _best() -> Column:
    """The longest row's length and the complement of its doc_id, which goes down as doc_id goes up and, unlike -doc_id, always exists."""
    return F.max(F.struct(F.col("length"), F.bitwise_not("doc_id").alias("not_id"))).alias("best")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of docs (doc_id, text; further columns don't matter).

    Texts are equal if their normal forms, without any white space, are; a null text counts as empty. Of equal texts the
    row with the most code points in its original text stays, then the one with the smallest doc_id; a null doc_id comes
    last, and keep_id is null only if all ids of a group are. doc_id names a document, so rows that repeat the doc_id which
    stays are all kept here; base.keep_judged, which the pipeline goes by, keeps one of them. Any 64-bit doc_id will do. An
    empty table gives an empty result.

    The group key is the first 128 bits of the normal form's SHA-256. Groups are formed over (key, normal form), so that
    the hash aggregation itself compares bytes: a text goes over the network once for each task that holds it, copies are
    folded before the shuffle, and two texts of one hash are two groups. Rows find their group by the hash alone, unless
    a hash has more than one group; then, and only then, these rows' texts decide.
    """
    text = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text).alias("length"), normalised(text).alias("norm"))
    rows = rows.withColumn("text_sha256", F.sha2("norm", 256)).withColumn("key", F.unhex(F.substring("text_sha256", 1, 32)))
    groups = cut(rows.groupBy("key", "norm").agg(_best(), F.count("*").alias("group_size")).select("key", F.bitwise_not("best.not_id").alias("keep_id"), "group_size"))
    apart = groups.groupBy("key").agg(F.count("*").alias("texts")).where("texts > 1").select("key")
    of_row = rows.select("doc_id", "key", "text_sha256")
    if apart.isEmpty():
        found = of_row.join(groups.select("key", "keep_id", "group_size"), "key")
    else:
        found = _by_bytes(rows, of_row, groups, apart)
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("doc_id").isNull() & F.col("keep_id").isNull())
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def _by_bytes(rows: DataFrame, of_row: DataFrame, groups: DataFrame, apart: DataFrame) -> DataFrame:
    """Some 128-bit keys stand for several texts: rows of such keys are grouped again by the bytes of their texts."""
    plain = of_row.join(apart, "key", "left_anti").join(groups.select("key", "keep_id", "group_size"), "key")
    odd = rows.join(apart, "key", "left_semi")
    of_text = odd.groupBy("key", "norm").agg(_best(), F.count("*").alias("group_size"))
    told = odd.join(of_text.withColumn("keep_id", F.bitwise_not("best.not_id")).drop("best"), ["key", "norm"])
    return plain.unionByName(told.select("key", "doc_id", "text_sha256", "keep_id", "group_size"))
