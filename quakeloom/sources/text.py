"""Text catalogues to typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.functions.scalar import catalogue_time, event_time, optional_float
from quakeloom.operators.coverage import MANIFEST
from quakeloom.operators.ordered import carry_forward, global_rank
from quakeloom.tables import written

# The columns of a pipe-separated catalogue line.
CATALOGUE_FIELDS = (
    "event_id origin_time latitude longitude depth_km author catalog contributor contributor_id magnitude_type magnitude magnitude_author location_name event_type"
).split()
_NUMBERS = {"latitude", "longitude", "depth_km", "magnitude"}

CATALOGUE_SCHEMA = ", ".join(f"{c} {'timestamp' if c == 'origin_time' else 'double' if c in _NUMBERS else 'string'}" for c in CATALOGUE_FIELDS) + ", source_url string, retrieved_utc timestamp"


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, value): the lines of text files with their number in the file, from 0. A file is read in splits.

    A split's lines are in order of their row ids; its place in the file is where its block starts. Numbers are
    ranks over (block, row id), so a large file is in no single task.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    rows = raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block__"), F.monotonically_increasing_id().alias("id__"), F.regexp_replace("value", "\r$", "").alias("value")
    )
    return global_rank(written(rows, "lines"), ["file"], ["block__", "id__"], "pos").select("file", "pos", "value")


def read_manifest(spark: SparkSession, path: str, source_name: str) -> DataFrame:
    """(source_name, value): the lines of one manifest file below its header; another header than that of a manifest is an error.

    Only the header is read by this call; the lines are read in splits.
    """
    head = spark.read.text(path).head()
    if head is None or head["value"].split() != MANIFEST:
        raise ValueError(f"not the header of a manifest: {path}")
    lines = spark.read.schema("value string").csv(path, header=True, sep="\x01", quote="", nullValue="\x02", emptyValue="")
    return lines.select(F.lit(source_name).alias("source_name"), "value")


def catalogue_lines(lines: DataFrame, source_url: str = "", text: str = "value") -> DataFrame:
    """Events of pipe-separated lines. Blank, comment and short lines are left out; a number that is none is an error."""
    rows = lines.filter((F.trim(text) != "") & ~F.col(text).startswith("#")).withColumn("f__", F.transform(F.split(text, r"\|"), lambda x: F.trim(x))).filter(F.size("f__") >= len(CATALOGUE_FIELDS))

    def field(i: int, name: str) -> Column:
        x = F.get("f__", F.lit(i))
        return (catalogue_time(x) if name == "origin_time" else x.cast("double") if name in _NUMBERS else x).alias(name)

    return rows.select(*[field(i, n) for i, n in enumerate(CATALOGUE_FIELDS)], F.lit(source_url).alias("source_url"), F.current_timestamp().alias("retrieved_utc"))


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A catalogue CSV with four numeric columns; all others as strings."""
    raw = spark.read.csv(path, header=True)
    return raw.withColumns({c: F.col(c).cast("double") for c in _NUMBERS if c in raw.columns})


def read_strings(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with every column as string, empty ones as empty strings."""
    return spark.read.csv(path, header=True, inferSchema=False).fillna("")


def _carried(lines: DataFrame, text: str) -> DataFrame:
    f = F.split(F.trim(text), r"\s+")
    head = F.col(text).rlike(r"^\s*#") & (F.size(f) >= 15) & F.get(f, F.lit(1)).rlike(r"^\d+$") & F.element_at(f, -1).startswith("R")
    rows = lines.filter(F.trim(text) != "").withColumn("f__", f).withColumn("is_head__", F.coalesce(head, F.lit(False)))
    return carry_forward(rows, ["file"], ["pos"], {"sequence_id": F.when(F.col("is_head__"), F.element_at("f__", -1))})


def sequence_headers(lines: DataFrame, text: str = "value") -> DataFrame:
    """Published sequences, one for each header line of (file, pos, value)."""
    g = lambda i: F.get("f__", F.lit(i))
    o = lambda i, n: optional_float(g(i)).alias(n)
    return _carried(lines, text).filter("is_head__").select(
        "sequence_id", g(1).cast("int").alias("published_event_count"), g(2).cast("double").alias("median_latitude"), g(3).cast("double").alias("median_longitude"), g(4).cast("double").alias("median_depth_km"),
        o(5, "median_differential_magnitude"), o(6, "differential_magnitude_std"), o(7, "median_recurrence_days"), o(8, "recurrence_std_days"), o(9, "recurrence_cv"), o(13, "median_long_window_correlation"),
    )


def sequence_events(lines: DataFrame, text: str = "value") -> DataFrame:
    """Events of sequences: lines of exactly 18 fields that begin with digits, each in the sequence of the last header before it.

    The last header's name is carried across range partitions of a file's lines.
    """
    g = lambda i: F.get("f__", F.lit(i))
    d = lambda i, n: g(i).cast("double").alias(n)
    rows = _carried(lines, text).filter(~F.col("is_head__") & ~F.col(text).rlike(r"^\s*#") & (F.size("f__") == 18) & g(0).rlike(r"^\d+$"))
    time = event_time(*[g(i).cast("int") for i in range(5)], g(5).cast("double"))
    names = {6: "days_since_1984_01_01", 7: "latitude", 8: "longitude", 9: "depth_km", 10: "relative_error_x_m", 11: "relative_error_y_m", 12: "relative_error_z_m", 13: "magnitude"}
    optional = {14: "differential_magnitude", 15: "differential_magnitude_error", 16: "median_long_window_correlation"}
    return rows.select(g(17).alias("event_id"), time.alias("origin_time"), *[d(i, n) for i, n in names.items()], *[optional_float(g(i)).alias(n) for i, n in optional.items()], "sequence_id")


def sequence_faults(headers: DataFrame, events: DataFrame) -> DataFrame:
    """(fault, subject): what makes a parsed sequence catalogue unfit; no rows if it is sound."""
    fault = lambda df, name, col: df.select(F.lit(name).alias("fault"), F.col(col).cast("string").alias("subject"))
    twice = headers.groupBy("sequence_id").count().filter("count > 1")
    shared = events.groupBy("event_id").count().filter("count > 1")
    counts = headers.join(events.groupBy("sequence_id").agg(F.count("*").alias("n")), "sequence_id", "left").filter("coalesce(n, 0) <> published_event_count")
    empty = headers.limit(1).agg(F.count("*").alias("n")).filter("n = 0")
    return (
        fault(twice, "duplicate sequence", "sequence_id")
        .unionByName(fault(shared, "event in several sequences", "event_id"))
        .unionByName(fault(events.filter("sequence_id is null"), "event before a header", "event_id"))
        .unionByName(fault(counts, "declared count differs", "sequence_id"))
        .unionByName(fault(empty, "no sequences", "n"))
    )
