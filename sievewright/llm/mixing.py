"""Mixing sources to target weights by hash-threshold histograms.

Each document has a fixed pseudo-random hash. Words are summed by source and hash bucket; where a source's running sum passes
its budget lies the boundary bucket, and only its documents are summed again by finer buckets. What remains is one hash
threshold for each source, and the mix is a filter: nothing is sorted, and a larger budget's selection holds a smaller one's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import WORD, cut, text_or_empty

#: Hash bits that each of the histograms refines.
LEVEL_BITS = [12, 12, 12, 12, 15]
HASH_BITS = sum(LEVEL_BITS)


def _hash(seed: int) -> Column:
    """Of doc_id and text, so that unlike texts of one doc_id, or of none, are taken or left each for itself."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), text_or_empty()), 64 - HASH_BITS)


def sized(docs: DataFrame, seed: int = 11, source: str = "source") -> DataFrame:
    """docs' doc_id, source, number of words and 63-bit hash; a missing source column makes all rows one source."""
    of = F.col(source).cast("string") if source in docs.columns else F.lit(None).cast("string")
    words = F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), of.alias("source"), words.alias("size"), _hash(seed).alias("h"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, repeats: float = 2) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, have the weights in turn and share `share` times all words. A target stops at
    `repeats` times its source's size; what is beyond is shared again by weight. In closed form: with the sources in order of
    capacity over weight, the first ones are full and the rest share what is left by weight. One row a source is sorted.
    """
    order = F.col("source").isNull().cast("int"), F.col("source")
    table = F.array(*(F.lit(float(w)) for w in weights))
    numbered = sizes.withColumn("_w", F.element_at(table, F.pmod(F.row_number().over(Window.orderBy(*order)) - 1, F.lit(len(weights))) + 1))
    numbered = numbered.withColumn("_cap", F.col("source_size") * F.lit(float(repeats)))
    by_level = Window.orderBy(F.col("_cap") / F.col("_w"), *order)
    whole, upto, after = Window.partitionBy(), by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(upto), F.lit(0.0))
    level = numbered.withColumn("_level", left / F.sum("_w").over(after)).withColumn("_full", F.col("_cap") <= F.col("_w") * F.col("_level"))
    open_level = F.min(F.when(~F.col("_full"), F.struct(F.col("_cap") / F.col("_w"), *(x.alias(f"o{i}") for i, x in enumerate(order)), F.col("_level")))).over(whole)["_level"]
    return level.withColumn("_open", open_level).select("source", "source_size", F.when(F.col("_full") | F.col("_open").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_w") * F.col("_open"))).alias("target"))


def _thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, below): documents of the source with h < below have about `budget` words, budget being under the whole."""
    found = budgets.select("source", "rest", F.lit(0).cast("long").alias("prefix"))
    done = 0
    for bits in LEVEL_BITS:
        at = found.select(F.col("source").alias("_s"), "prefix", "rest")
        of_source, in_boundary = F.col("source").eqNullSafe(F.col("_s")), F.shiftrightunsigned("h", HASH_BITS - done) == F.col("prefix")
        inside = rows.join(at, of_source & in_boundary if done else of_source)
        sums = inside.groupBy("source", F.shiftrightunsigned("h", HASH_BITS - done - bits).alias("bucket")).agg(F.sum("size").alias("words"))
        ran = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("bucket")))
        first = ran.join(at, of_source).where("upto > rest").groupBy("source").agg(F.min(F.struct("bucket", "words", "upto", "rest")).alias("m"))
        found = cut(first.select("source", F.expr("m.rest - (m.upto - m.words)").alias("rest"), F.col("m.bucket").alias("prefix"), F.col("m.words").alias("words")))
        done += bits
    return found.select("source", (F.col("prefix") + F.when(F.col("rest") * 2 > F.col("words"), 1).otherwise(0)).alias("below"))


def plan(rows: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, repeats: float = 2) -> DataFrame:
    """(source, source_size, target, times, below) of rows as sized() has them: every document of a source is taken `times`
    times, and once more if its hash is under `below` (null: none is)."""
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, repeats)
    goals = cut(goals.withColumn("times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")))
    budgets = goals.select("source", (F.col("target") - F.col("times") * F.col("source_size")).alias("rest")).where("rest > 0")
    below = _thresholds(rows, budgets).withColumnRenamed("source", "_b")
    return cut(goals.join(below, F.col("source").eqNullSafe(F.col("_b")), "left").drop("_b"))


def _times() -> Column:
    return F.col("times") + F.coalesce((F.col("h") < F.col("below")).cast("int"), F.lit(0))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2, seed: int = 11, source: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken, source) for each row of docs (doc_id, text, source).

    taken is the words that the mix takes of the document: whole multiples of its size. All documents of a source are taken
    as often as its target holds the source whole, and those under the source's hash threshold once more. The sum differs
    from the target by at most half of one document, the one at the threshold. Rows alike in doc_id and text share a hash and
    stand or fall together, as one document of their joint size; with a null doc_id the text alone decides. Null and empty texts have size 0 and take nothing; a null source is one of its own; an empty
    table gives an empty result.
    """
    rows = cut(sized(docs, seed, source))
    of = plan(rows, weights, share, repeats).withColumnRenamed("source", "_s")
    joined = rows.join(of, F.col("source").eqNullSafe(F.col("_s")))
    return joined.select("doc_id", "size", "source_size", "target", (_times() * F.col("size")).cast("long").alias("taken"), "source")


def mixed(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2, seed: int = 11, source: str = "source") -> DataFrame:
    """The mix itself: docs' rows and columns, each row as often as mix() takes it. Texts stay in their partitions: only the
    plan, a row for each source, is joined to them. Rows without a word come as often as their source and hash say."""
    of = plan(cut(sized(docs, seed, source)), weights, share, repeats).select(F.col("source").alias("_s"), "times", "below")
    name = F.col(source).cast("string") if source in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"), _hash(seed).alias("h"), name.alias("of")).join(of, F.col("of").eqNullSafe(F.col("_s")))
    return rows.select("row", F.explode(F.array_repeat(F.lit(1), _times())).alias("copy")).select("row.*")
