"""Lineage cuts and named checkpoints, in folders that the whole cluster sees."""

from __future__ import annotations

import atexit
import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import asdict, is_dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []
_tables: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset and all tasks run in this process.

    A cluster without it is refused: executors would write to disks of their own, and tables would read as empty.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="sievewright-"))
    return _own[0]


def cut(df: DataFrame) -> DataFrame:
    """df written to a table in the shared folder and read again, so that a lost executor doesn't cost what came before.

    The table stays until `clean` or the process's end, as what is returned, and all that is made of it, reads it.
    """
    path = f"{shared_folder(df.sparkSession)}/sievewright/{uuid.uuid4().hex}"
    if not _tables:
        atexit.register(_clean_up, df.sparkSession)
    _tables.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables there are that `cut` wrote."""
    return len(_tables)


def clean(spark: SparkSession, since: int = 0) -> None:
    """Remove the tables that were cut, but for the first `since`: for long sessions that have written their results."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _tables[since:]:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    del _tables[since:]


def _clean_up(spark: SparkSession) -> None:
    try:
        clean(spark)
    except Exception:  # noqa: BLE001  the session has gone; the cluster clears its folder
        return


def parameter_key(*groups) -> str:
    """A short hash of everything that a stage's result depends on: all parameters, not a chosen few."""
    plain = [asdict(g) if is_dataclass(g) else g for g in groups]
    return hashlib.sha256(json.dumps(plain, sort_keys=True, default=str).encode()).hexdigest()[:16]


class Checkpoints:
    """Stages of a run as Parquet under root/stage/key. A stage is read if it was written whole under the same key."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _fs(self, path: str):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(conf), where

    def has(self, stage: str, key: str) -> bool:
        fs, where = self._fs(f"{self.root}/{stage}/{key}/_SUCCESS")
        return fs.exists(where)

    def stage(self, stage: str, key: str, build: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.root}/{stage}/{key}"
        if not self.has(stage, key):
            build().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def drop(self, *stages: str) -> None:
        """Forget stages, and with them what later stages would have read."""
        for s in stages:
            fs, where = self._fs(f"{self.root}/{s}")
            fs.delete(where, True)


def exists(spark: SparkSession, paths: DataFrame, most: int = 5) -> bool:
    """Whether a few of the files that paths (one column) names are there; yes if it names none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    named = [r[0] for r in paths.where(F.col(paths.columns[0]).isNotNull()).distinct().orderBy(F.xxhash64(paths.columns[0])).limit(most).collect()]
    there = (jvm.org.apache.hadoop.fs.Path(p) for p in named)
    return all(p.getFileSystem(conf).exists(p) for p in there)
