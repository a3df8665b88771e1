"""Near-duplicate removal on a stream: the first row of a look in each window stays.

The batch operator links rows over chains and keeps the best of a group, which needs the group's end. A stream can't wait for
that; this variant keeps the first row of each (identity, hash) within a watermark and drops what repeats it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_of_look(stream: DataFrame, time: str = "ts", keys: tuple[str, ...] = ("identity_cluster", "phash"), watermark: str = "10 seconds") -> DataFrame:
    """Rows whose keys weren't seen within the watermark before; state is let go of when the watermark has passed it."""
    return stream.withWatermark(time, watermark).dropDuplicatesWithinWatermark(list(keys))


def counts_by_window(stream: DataFrame, time: str = "ts", key: str = "pose", size: str = "1 minute", watermark: str = "10 seconds") -> DataFrame:
    """(start, key, n): rows in tumbling windows; late rows beyond the watermark don't count."""
    counted = stream.withWatermark(time, watermark).groupBy(F.window(time, size), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), key, "n")
