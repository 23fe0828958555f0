"""What the operators share: tables in the cluster's shared folder, size-bounded filters, and tasks that give memory back."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most distinct values that a bounded filter broadcasts: 2**18 integers, about 8 MB as a hash table.
BUCKETS = 1 << 18
#: A column that numbers the rows of a written table.
ROW = "row__"

_local_dirs: dict[str, str] = {}
#: Folders of the scopes that are open, outermost first.
_folders: contextvars.ContextVar[tuple[str, ...]] = contextvars.ContextVar("folders", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a local master (tests) has a folder of this machine; a cluster is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='quakeloom-')}"
    return _local_dirs[context.applicationId]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts lineage without a local copy: any executor can read the table after another is lost.
    """
    return _written(df, (f"{shared_dir(df.sparkSession)}/quakeloom", *_folders.get())[-1], name)


def keep(df: DataFrame, name: str) -> DataFrame:
    """As :func:`materialise`, for a table that outlives the :func:`working_tables` it is made from: it belongs to the
    scope around that one or, if there is none, stays until its reader deletes it."""
    root = f"{shared_dir(df.sparkSession)}/quakeloom"
    return _written(df, (root, root, *_folders.get())[-2], name)


def _written(df: DataFrame, folder: str, name: str) -> DataFrame:
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def working_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that :func:`materialise` writes within are deleted at the end; what is to last is written with :func:`keep`.

    Scopes nest: what an operator keeps for its lazy result belongs to its caller's scope, who writes the result
    and then leaves the scope, so nothing but what was written with :func:`keep` in the outermost one is left.
    """
    path = f"{shared_dir(spark)}/quakeloom/work-{uuid.uuid4().hex}"
    token = _folders.set((*_folders.get(), path))
    try:
        yield
    finally:
        _folders.reset(token)
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` as a written table with a number of its own in each row (``ROW``), which no later plan can change.

    The table belongs to the caller's scope, for what :func:`drop_rows` returns reads it.
    """
    return materialise(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``; its task then gives the memory it freed back to the system.

    Python workers outlive tasks, and what their allocators keep of a peak would count against the
    executor for as long as they live.
    """

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def bucket(*cols: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(buckets)).cast("int")


def mark_buckets(df: DataFrame, key: Column, wanted: DataFrame, flag: str, buckets: int = BUCKETS) -> DataFrame:
    """``df`` with boolean ``flag``: may ``key`` be among the rows of ``wanted`` (its columns hashed in order)?

    The broadcast side holds at most ``buckets`` integers whatever the data. False is certain; true
    may be a collision, so callers follow it with an exact join.
    """
    hit = f"{flag}__b"
    present = (
        wanted.select(bucket(*[F.col(c) for c in wanted.columns], buckets=buckets).alias(hit))
        .distinct()
        .withColumn(f"{flag}__y", F.lit(True))
    )
    return (
        df.withColumn(hit, key)
        .join(F.broadcast(present), hit, "left")
        .withColumn(flag, F.coalesce(F.col(f"{flag}__y"), F.lit(False)))
        .drop(hit, f"{flag}__y")
    )


def drop_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """A :func:`numbered` table without the rows whose number is in the one-column ``rows``, and without the numbers.

    Rows that certainly stay pass without a shuffle; only rows whose bucket holds a dropped number are
    moved for the exact anti-join. Rows are told apart by number, so what is dropped or kept of a
    repeated or null id is what the operator decided on that very row.
    """
    cols = [c for c in docs.columns if c != ROW]
    gone = rows.toDF("gone__row")
    marked = mark_buckets(docs, bucket(F.col(ROW)), gone, "maybe__")
    stay = marked.filter(~F.col("maybe__")).select(*cols)
    checked = marked.filter(F.col("maybe__")).join(gone, F.col(ROW) == F.col("gone__row"), "left_anti").select(*cols)
    return stay.unionByName(checked)
