"""Written tables in the folder that a cluster's driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, one in the warehouse, which a cluster shares as well.

    With a local master there is one machine: then an unset folder is a temporary one, deleted when Python ends.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/quakeloom-tables"
    if context.applicationId not in _local:
        _local[context.applicationId] = tempfile.mkdtemp(prefix="quakeloom-")
        atexit.register(shutil.rmtree, _local[context.applicationId], ignore_errors=True)
    return f"file://{_local[context.applicationId]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: plans that read it twice see the same rows, and
    any executor can read it after another is lost."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
