"""The coverage ledger: one row for each source of recordings, whatever its kind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakeloom.functions.scalar import filename_epoch
from quakeloom.operators import coverage

# Kinds of sources, coverage levels, the stamp in a packet file's name
ARRAY_ROOT, MANIFEST, PACKETS = "optasense_h5_root", "whitespace_manifest", "protobuf_root"
LEVELS = {ARRAY_ROOT: "filename_complete_header_sampled", MANIFEST: "manifest_rows_complete_headers_not_rechecked", PACKETS: "filename_only_requires_protobuf_packet_audit"}
MISSING = "missing"
PACKET_STAMP = r"(20\d{2}-\d{2}-\d{2}T\d{6}Z)"

HEADER_MODE = ["sample_rate_hz", "channel_count", "channel_spacing_m", "gauge_length_m", "start_locus_index", "raw_data_unit"]
MANIFEST_MODE = HEADER_MODE[:4]


def array_root_summary(files: DataFrame, headers: DataFrame, sample: int) -> DataFrame:
    """Per source_name of ``files`` (source_name, path): all names counted and spanned, ``sample`` headers read.

    headers: the header ledger (path, status, root_uuid and ``HEADER_MODE``); only sampled paths are joined. A sampled file
    without a header row counts as an error.
    """
    spans = coverage.span(files.select("source_name", filename_epoch(F.col("path")).alias("stamp")), ["source_name"], "stamp")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    picked = coverage.uniform_sample(files.select("source_name", "path"), ["source_name"], ["path"], sample).drop("file_count")
    # ``sample`` paths a source: headers of other paths do not leave their task
    near = headers.select("path", "status", "root_uuid", *HEADER_MODE).join(F.broadcast(picked.select("path").distinct()), "path", "left_semi")
    read = picked.join(near, "path", "left")
    good = read.filter(F.col("status") == "ok")
    counts = read.groupBy("source_name").agg(F.count("*").alias("headers_read"), F.count(F.when(F.col("status") == "ok", 1)).alias("ok"))
    repeats = coverage.duplicate_count(good, ["source_name"], "root_uuid")
    modes = coverage.configuration_census(good, "source_name", HEADER_MODE, count="sample_count")
    joined = spans.join(counts, "source_name").join(repeats, "source_name", "left").join(modes, "source_name", "left")
    return joined.select(
        "source_name", F.col("n").alias("file_count"), iso("first").alias("filename_start_utc"), iso("last").alias("filename_end_utc"), "headers_read",
        (F.col("headers_read") - F.col("ok")).alias("header_errors"), F.coalesce("duplicates", F.lit(0)).alias("sample_duplicate_root_uuids"),
        F.coalesce("configurations", F.lit("[]")).alias("sampled_configurations"),
    )


def manifest_source_summary(lines: DataFrame) -> DataFrame:
    """Per source_name of manifest ``lines`` (source_name, value): lines, placeholders, span as text, census by output rate."""
    rows = coverage.manifest_rows(lines, ["source_name"])
    valid = rows.filter("valid").select(
        "source_name", (F.col("fs") / F.col("Desample")).alias("sample_rate_hz"), F.col("nChannels").alias("channel_count"), F.col("dCh").alias("channel_spacing_m"), F.col("GaugeLen").alias("gauge_length_m"),
    )
    modes = coverage.configuration_census(valid, "source_name", MANIFEST_MODE, numeric=True)
    return coverage.manifest_summary(rows, ["source_name"]).join(modes, "source_name", "left").select(
        "source_name", "file_count", "valid_record_count", "placeholder_count", F.col("first_start").alias("filename_start_utc"), F.col("last_end").alias("filename_end_utc"),
        F.lit(0).cast("long").alias("headers_read"), F.coalesce("configurations", F.lit("[]")).alias("sampled_configurations"),
    )


def packet_root_summary(files: DataFrame) -> DataFrame:
    """Per source_name of packet ``files`` (source_name, path): names counted, stamps spanned as text."""
    stamp = F.nullif(F.regexp_extract(F.element_at(F.split("path", "/"), -1), PACKET_STAMP, 1), F.lit(""))
    spans = coverage.span(files.select("source_name", stamp.alias("stamp")), ["source_name"], "stamp")
    return spans.select(
        "source_name", F.col("n").alias("file_count"), F.col("first").alias("filename_start_utc"), F.col("last").alias("filename_end_utc"),
        F.lit(0).cast("long").alias("headers_read"), F.lit("[]").alias("sampled_configurations"),
    )


def coverage_ledger(sources: DataFrame, files: DataFrame, headers: DataFrame, lines: DataFrame, sample: int) -> DataFrame:
    """One row of each source (source_name, kind, path, exists): what its files, headers or manifest lines show.

    A source that does not exist has no files and the level "missing"; one that exists without files has a count of 0; one
    that exists and is of no known kind is an error when the row is read. ``files`` holds the files of both kinds of roots.
    What a kind cannot know is null.
    """
    kinds = sources.select("source_name", "kind").filter("exists")
    of = lambda kind, rows: rows.join(F.broadcast(kinds.filter(F.col("kind") == kind).select("source_name")), "source_name", "left_semi")
    found = array_root_summary(of(ARRAY_ROOT, files), headers, sample)
    for more in (manifest_source_summary(of(MANIFEST, lines)), packet_root_summary(of(PACKETS, files))):
        found = found.unionByName(more, allowMissingColumns=True)
    level = F.lit(None).cast("string")
    for kind, name in LEVELS.items():
        level = F.when(F.col("kind") == kind, name).otherwise(level)
    unknown = F.raise_error(F.concat(F.lit("unsupported kind of source: "), F.coalesce("kind", F.lit("none"))))
    out = sources.join(found, "source_name", "left").withColumn("coverage_level", F.when(~F.col("exists"), MISSING).when(level.isNotNull(), level).otherwise(unknown.cast("string")))
    return out.withColumns({"file_count": F.coalesce("file_count", F.lit(0)), "sampled_configurations": F.when(F.col("exists"), F.coalesce("sampled_configurations", F.lit("[]"))),
                            "headers_read": F.when(F.col("exists"), F.coalesce("headers_read", F.lit(0)))})
