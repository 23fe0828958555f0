"""Header records derived from what an array file holds: its axes, times, counters and attributes; a bad file is a row with its error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One row a file: its attributes as text by group, the shape of its data, the time of every sample and, if it has one,
#: the counter of every sample; read_error is what went wrong before.
RAW_SCHEMA = (
    "path string, size_bytes long, root map<string,string>, acquisition map<string,string>, raw map<string,string>, custom map<string,string>, data_shape array<long>, times_us array<long>, "
    "counters array<long>, read_error string"
)

# Names of attributes.
RATE, LOCUS, SPACING, GAUGE, UNIT, DESCRIPTION, UUID = "OutputDataRate", "StartLocusIndex", "SpatialSamplingInterval", "GaugeLength", "RawDataUnit", "RawDescription", "uuid"
GPS_ENABLED, GPS_SYNC = "GPS Enabled", "GPS Sync Guaranteed"

_KINDS = {
    "size_bytes": "long", "start_utc": "timestamp", "end_utc": "timestamp", "sample_rate_hz": "double", "sample_count": "int", "channel_count": "int", "time_axis": "int", "start_locus_index": "int",
    "channel_spacing_m": "double", "gauge_length_m": "double", "raw_data_unit": "string", "raw_description": "string", "root_uuid": "string", "acquisition_uuid": "string", "raw_uuid": "string",
    "gps_enabled": "int", "gps_sync_guaranteed": "int", "timestamp_span_residual_s": "double", "sample_counter_residual": "long",
}


def _number(x: Column, kind: str) -> Column:
    """An attribute's number: a whole one may be written with a fraction, what is none is null."""
    value = F.trim(x).try_cast("double")
    value = F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(None).cast("double")).otherwise(value)
    return value if kind == "double" else value.try_cast(kind)


def derive_headers(raw: DataFrame) -> DataFrame:
    """One header record per row of ``raw`` (``RAW_SCHEMA``): path, status, error, and the derived columns, null where there is an error.

    The time axis is the one whose length is the number of times; if both or neither are, it cannot be known.
    The end is the start and the samples at the nominal rate; timestamp_span_residual_s is how much the times' span
    is off that, sample_counter_residual how many counts are missing (null without a counter for each sample).
    All is columns: a file costs its two end times, sizes and attributes.
    """
    shape, n = F.col("data_shape"), F.size("times_us")
    rate = _number(F.col("raw")[RATE], "double")
    fits = lambda k: F.get(shape, k) == n
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    axis = F.when(fits(0) & ~fits(1), 0).when(fits(1) & ~fits(0), 1)
    size = F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(shape, F.array().cast("array<long>")), lambda x: x.cast("string")), ", "), F.lit("]"))
    error = (
        F.when(F.col("read_error").isNotNull(), F.col("read_error"))
        .when(F.col("acquisition").isNull() | F.col("raw").isNull(), "a group is missing")
        .when(shape.isNull() | F.col("times_us").isNull(), "data or times are missing")
        .when(n == 0, "there are no sample times")
        .when(rate.isNull() | (rate <= 0), F.concat(F.lit("invalid sample rate "), shown(F.col("raw")[RATE])))
        .when(F.size(shape) != 2, F.concat(F.lit("data must have two axes, not "), size))
        .when(axis.isNull(), F.concat(F.lit("cannot tell the time axis: data "), size, F.lit(", times "), n.cast("string")))
    )
    first, last = F.get("times_us", 0), F.try_element_at(F.col("times_us"), F.lit(-1))
    counted = F.size("counters") == n
    rows = raw.withColumns({"error": error, "rate__": rate, "axis__": axis, "n__": n, "first__": first, "last__": last})
    start, text = F.col("first__") * F.lit(1e-6), lambda group, name: F.coalesce(F.col(group)[name], F.lit(""))
    values = {
        "size_bytes": F.col("size_bytes"), "start_utc": F.timestamp_micros("first__"), "end_utc": F.timestamp_micros((F.col("first__") + F.round(F.col("n__") / F.col("rate__") * 1e6)).cast("long")),
        "sample_rate_hz": F.col("rate__"), "sample_count": F.col("n__"), "channel_count": F.get(shape, 1 - F.col("axis__")), "time_axis": F.col("axis__"),
        "start_locus_index": _number(F.coalesce(F.col("raw")[LOCUS], F.col("acquisition")[LOCUS]), "int"), "channel_spacing_m": _number(F.col("acquisition")[SPACING], "double"),
        "gauge_length_m": _number(F.col("acquisition")[GAUGE], "double"), "raw_data_unit": text("raw", UNIT), "raw_description": text("raw", DESCRIPTION), "root_uuid": text("root", UUID),
        "acquisition_uuid": text("acquisition", UUID), "raw_uuid": text("raw", UUID), "gps_enabled": _number(F.col("custom")[GPS_ENABLED], "int"), "gps_sync_guaranteed": _number(F.col("custom")[GPS_SYNC], "int"),
        "timestamp_span_residual_s": F.col("last__") * F.lit(1e-6) - start - (F.col("n__") - 1) / F.col("rate__"),
        "sample_counter_residual": F.when(counted, F.try_element_at(F.col("counters"), F.lit(-1)) - F.get("counters", 0) - (F.col("n__") - 1)),
    }
    kept = [(c if name == "size_bytes" else F.when(F.col("error").isNull(), c)).cast(_KINDS[name]).alias(name) for name, c in values.items()]
    return rows.select("path", F.when(F.col("error").isNull(), "ok").otherwise("error").alias("status"), F.coalesce("error", F.lit("")).alias("error"), *kept)


def as_window_files(headers: DataFrame, raw: DataFrame, stamp_s: Column) -> DataFrame:
    """Sound headers with their sample times as files of :func:`quakeloom.sources.windows.read_windows`; ``stamp_s`` is the time in a name."""
    times = raw.select(F.col("path").alias("of__"), "times_us")
    rows = headers.filter("status = 'ok'").join(times, F.col("path") == F.col("of__"))
    return rows.select("path", stamp_s.alias("stamp_s"), "sample_rate_hz", F.col("start_locus_index").cast("long").alias("start_locus_index"), "raw_data_unit", "channel_count", "times_us")
