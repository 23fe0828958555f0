"""Files on storage: listings, checksums and header tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quakeloom.functions.scalar import filename_epoch

HEADER_SCHEMA = (
    "path string, status string, error string, size_bytes long, start_utc timestamp, end_utc timestamp, sample_rate_hz double, sample_count int, channel_count int, time_axis int, start_locus_index int, "
    "channel_spacing_m double, gauge_length_m double, raw_data_unit string, raw_description string, root_uuid string, acquisition_uuid string, raw_uuid string, gps_enabled int, gps_sync_guaranteed int, "
    "timestamp_span_residual_s double, sample_counter_residual long, source_name string"
)
TRACE_SCHEMA = "event_id string, network string, station string, location string, channel string, sampling_rate double, start_epoch_s double, npts int, stream_order int, samples array<double>"
ARRAY_SCHEMA = "event_id string, source_file string, file_order int, column_index int, locus_index int, start_epoch_s double, sample_rate_hz double, unit string, samples array<float>"


def list_files(spark: SparkSession, root: str, pattern: str = "*.h5") -> DataFrame:
    """(path, length, stamp) of files below ``root``; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "length")
    return found.withColumn("stamp", filename_epoch(F.col("path"))).orderBy("path")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, md5, sha256) of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))


def verify_checksum(sums: DataFrame, expected_md5: str) -> DataFrame:
    """:func:`checksums` as they are; a file with another MD5 is an error when the result is read."""
    same = F.when(F.lower("md5") == expected_md5.lower(), True).otherwise(F.raise_error(F.concat(F.lit("checksum differs: "), F.col("path"))))
    return sums.filter(same)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """The header ledger; a file that could not be read is a row with its error."""
    return spark.read.schema(HEADER_SCHEMA).parquet(path)


def read_configuration(spark: SparkSession, path: str) -> DataFrame:
    """A JSON configuration as one row with ``config_path`` and ``config_sha256``, the digest of the file as it is."""
    row = spark.read.option("multiLine", "true").json(path)
    digest = checksums(spark, path).select(F.col("path").alias("config_path"), F.col("sha256").alias("config_sha256"))
    return row.join(F.broadcast(digest), F.lit(True))


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Landed traces (``TRACE_SCHEMA``), each with its place in its event's stream: by network, station, location, channel and start."""
    order = Window.partitionBy("event_id").orderBy("network", "station", "location", "channel", "start_epoch_s", "npts")
    return spark.read.schema(TRACE_SCHEMA).parquet(path).withColumn("stream_order", F.row_number().over(order) - 1)


def read_status(spark: SparkSession, path: str) -> DataFrame:
    """A status document as one row."""
    return spark.read.option("multiLine", "true").json(path)


def window_samples(samples: DataFrame, start_s: float, end_s: float, first: int = 0, last: int | None = None, stride: int = 1) -> DataFrame:
    """(event_id, column_index, locus_index, epoch_s, value) of [start_s, end_s), columns first:last:stride, scaled to radians.

    Rows of the array table that cannot overlap are dropped by their own start before samples are exploded.
    Of samples at one time the first file's stays.
    """
    from quakeloom.functions.scalar import phase_scale
    from quakeloom.operators.array import dedupe_times

    if end_s <= start_s or stride <= 0:
        raise ValueError("a window must end after its start and a stride be positive")
    n = F.size("samples") / F.col("sample_rate_hz")
    rows = samples.filter((F.col("start_epoch_s") < end_s) & (F.col("start_epoch_s") + n > start_s) & (F.col("column_index") >= first) & ((F.col("column_index") - first) % stride == 0))
    if last is not None:
        rows = rows.filter(F.col("column_index") < last)
    long = rows.select("event_id", "column_index", "locus_index", "file_order", "start_epoch_s", "sample_rate_hz", phase_scale(F.col("unit")).alias("k"), F.posexplode("samples").alias("i", "x"))
    long = long.withColumn("epoch_s", F.col("start_epoch_s") + F.col("i") / F.col("sample_rate_hz")).filter((F.col("epoch_s") >= start_s) & (F.col("epoch_s") < end_s))
    kept = dedupe_times(long, ["event_id", "column_index"], "epoch_s", ["file_order", "i"])
    return kept.select("event_id", "column_index", "locus_index", "epoch_s", (F.col("x").cast("float") * F.col("k").cast("float")).alias("value"))
