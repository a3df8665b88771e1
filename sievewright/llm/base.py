"""Helpers that every operator of this subpackage shares: tables, lineage cuts and Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Rows of an Arrow batch. Texts are long, so batches are kept far below Spark's default of 10,000 rows.
BATCH_ROWS = 512

#: White space of every contract: the blank and the characters 9 to 13.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def session(df: DataFrame) -> SparkSession:
    spark = ship(df.sparkSession)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_own_folder: list[str] = []
#: Tables that are still there, in the order they were written.
_tables: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where that is unset and all tasks run
    in this process. A cluster without it is refused: executors would write to disks of their own, and tables read as empty."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="sievewright-"))
    return _own_folder[0]


def cut(df: DataFrame) -> DataFrame:
    """Write df to a table in the shared folder and read it again.

    The lineage ends there: a lost executor costs tasks of the current job only, nothing that depends on a random
    order or on sampled range bounds is computed twice, and Spark knows the size of what it reads.
    """
    spark = session(df)
    path = f"{shared_folder(spark)}/sievewright/{uuid.uuid4().hex}"
    schema = df.schema
    if not _tables:
        atexit.register(_remove_all, spark)
    _tables.append(path)
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def settled(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """cut(build()), after which the tables that build wrote on its way are removed: a long session needn't keep them."""
    before = len(_tables)
    out = cut(build())
    for path in _tables[before:-1]:
        _remove(spark, path)
    del _tables[before:-1]
    return out


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove_all(spark: SparkSession) -> None:
    """Free the tables at the end of the process; a session that has gone already leaves them to the cluster."""
    try:
        for path in _tables:
            _remove(spark, path)
    except Exception:  # noqa: BLE001  the gateway is closed
        return


def release() -> None:
    """Give memory that Python no longer uses back to the system: workers stay for later stages, and executors are small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def in_batches(df: DataFrame, schema, work: Callable[[pa.RecordBatch], pa.RecordBatch | dict | None], max_bytes: int = 1 << 20, by: str | None = None) -> DataFrame:
    """mapInArrow that hands out slices of at most max_bytes of the column `by` (or single rows beyond that)."""
    session(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, by, max_bytes):
                out = work(part)
                if out is None:
                    continue
                yield pa.RecordBatch.from_pydict(out) if isinstance(out, dict) else out
        release()

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, by: str | None, max_bytes: int) -> Iterator[pa.RecordBatch]:
    if by is None or batch.num_rows < 2 or batch.column(by).nbytes <= max_bytes:
        if batch.num_rows:
            yield batch
        return
    half = batch.num_rows // 2
    yield from slices(batch.slice(0, half), by, max_bytes)
    yield from slices(batch.slice(half), by, max_bytes)


#: Ids up to which a set of them is broadcast (8 bytes each); beyond, it is joined by shuffle.
BROADCAST_IDS = 500_000


def bounded(ids: DataFrame) -> DataFrame:
    """ids (one long column), to be broadcast if there are few."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def without(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id has a verdict (doc_id, kept) that drops it; doc_ids are unique and not null."""
    dropped = cut(verdicts.where("not kept").select(F.col("doc_id").alias("_gone")))
    return docs.join(bounded(dropped), docs["doc_id"] == dropped["_gone"], "left_anti")


def repeated_ids(docs: DataFrame, nulls: bool = False) -> bool:
    """Whether a doc_id stands in several rows or, with nulls, in none."""
    of_id = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("n"))
    return not of_id.where(("n > 1 or doc_id is null") if nulls else ("n > 1 and doc_id is not null")).isEmpty()


def numbered(docs: DataFrame) -> DataFrame:
    """(nth, row): docs' rows as structs under unique numbers that go up with doc_id, null last. Rows of one doc_id, however
    many, are spread over tasks."""
    from .ranking import positions

    rows = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("_doc"), F.col("doc_id").isNull().alias("_none"), F.monotonically_increasing_id().alias("_salt"))
    return cut(positions(rows, ["_none", "_doc", "_salt"]).select(F.col("position").alias("nth"), "row"))


def keep_judged(docs: DataFrame, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of docs that judge keeps, with docs' columns. judge takes (doc_id, text) and returns (doc_id, kept) for each row.

    Every row is judged by its own text and stands for itself. Where doc_ids repeat or are null, judge sees numbers in their
    place that are unique and go up with doc_id, null last: no text is lost because another row has its doc_id, and of rows
    that are alike in everything one stays.
    """
    if not repeated_ids(docs, nulls=True):
        return without(docs, judge(docs.select("doc_id", "text")))
    rows = numbered(docs)
    dropped = cut(judge(rows.select(F.col("nth").alias("doc_id"), F.col("row.text").alias("text"))).where("not kept").select(F.col("doc_id").alias("_gone")))
    return rows.join(bounded(dropped), rows["nth"] == dropped["_gone"], "left_anti").select("row.*")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
