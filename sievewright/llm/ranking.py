"""Global positions of rows in a total order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import cut


def positions(rows: DataFrame, order: list[str], within: str | None = None, parts: int | None = None) -> DataFrame:
    """rows with `position`, gapless from 0 in the given order; with `within`, order's first column, from 0 in each of its values.

    Rows are dealt out by ranges of the order and sorted in each. Numbers inside a range come from the sorted partition,
    the numbers of rows before it from a count for each range (and value of `within`). The dealt table is written before it
    is counted, so that counts and rows come from the same ranges. Only these counts, as many as there are ranges plus
    values of `within`, are summed up in one place; they are joined, not collected.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    dealt = cut(dealt.withColumn("_part", F.shiftrightunsigned("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id"))
    keys = ["_part"] + ([within] if within else [])
    counts = dealt.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    run = (Window.partitionBy(within) if within else Window.partitionBy()).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = cut(counts.withColumn("_before", F.coalesce(F.sum("_n").over(run), F.lit(0)) - F.col("_first")).drop("_n", "_first"))
    if not within:
        return dealt.join(before, "_part").withColumn("position", F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")
    same = (dealt["_part"] == before["_part"]) & dealt[within].eqNullSafe(before[within])
    return dealt.join(before, same).select(*(dealt[c] for c in rows.columns), (dealt["_at"] + before["_before"]).alias("position"))
