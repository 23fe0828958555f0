"""Header records from raw files: what is derived, and a row for each way to be bad."""

import pytest
from pyspark.sql import functions as F

from quakeloom.sources.headers import RAW_SCHEMA, as_window_files, derive_headers
from quakeloom.sources.windows import TRACE_SCHEMA, read_windows

RAW = {"OutputDataRate": "100.0", "StartLocusIndex": "1800", "RawDataUnit": "rad * 2PI/2^16", "uuid": "r"}
ACQ = {"SpatialSamplingInterval": "1.02", "GaugeLength": "10", "uuid": "a"}
TIMES = [1_000_000 + 10_000 * k for k in range(5)]


def row(path, **change):
    base = {"size_bytes": 9, "root": {"uuid": "u"}, "acquisition": ACQ, "raw": RAW, "custom": None, "data_shape": [5, 3], "times_us": TIMES, "counters": None, "read_error": None}
    return (path, *{**base, **change}.values())


def test_derived_columns(spark):
    rows = [
        row("rows"), row("columns", data_shape=[3, 5], counters=[7, 8, 9, 10, 13], custom={"GPS Enabled": "1", "GPS Sync Guaranteed": "0.0"}),
        row("late", times_us=[*TIMES[:4], TIMES[4] + 250], raw={"OutputDataRate": "100"}, acquisition=ACQ | {"StartLocusIndex": "40.0"}, counters=[1, 2]), row("odd", raw=RAW | {"StartLocusIndex": "many"}, acquisition={}, root=None),
    ]
    got = {r.path: r for r in derive_headers(spark.createDataFrame(rows, RAW_SCHEMA)).collect()}
    r = got["rows"]
    assert (r.status, r.error, r.sample_rate_hz, r.sample_count, r.channel_count, r.time_axis, r.start_locus_index, r.channel_spacing_m, r.gauge_length_m) == ("ok", "", 100.0, 5, 3, 0, 1800, 1.02, 10.0)
    assert (r.root_uuid, r.acquisition_uuid, r.raw_uuid, r.raw_description, r.gps_enabled, r.sample_counter_residual) == ("u", "a", "r", "", None, None)
    assert r.timestamp_span_residual_s == pytest.approx(0, abs=1e-12) and (r.end_utc - r.start_utc).total_seconds() == 0.05
    c = got["columns"]
    assert (c.time_axis, c.channel_count, c.sample_counter_residual, c.gps_enabled, c.gps_sync_guaranteed) == (1, 3, 2, 1, 0)
    late = got["late"]
    assert late.timestamp_span_residual_s == pytest.approx(250e-6) and late.start_locus_index == 40 and late.sample_counter_residual is None and late.raw_data_unit == ""
    assert (got["odd"].start_locus_index, got["odd"].gauge_length_m, got["odd"].root_uuid) == (None, None, "")


@pytest.mark.parametrize("change, error", [
    ({"read_error": "truncated"}, "truncated"), ({"raw": None}, "a group is missing"), ({"acquisition": None}, "a group is missing"), ({"data_shape": None}, "data or times are missing"), ({"times_us": None}, "data or times are missing"),
    ({"times_us": []}, "there are no sample times"), ({"raw": {"OutputDataRate": "0"}}, "invalid sample rate 0"), ({"raw": {"OutputDataRate": "-3"}}, "invalid sample rate -3"), ({"raw": {}}, "invalid sample rate none"),
    ({"raw": {"OutputDataRate": "nan"}}, "invalid sample rate nan"), ({"data_shape": [5]}, "data must have two axes, not [5]"), ({"data_shape": [5, 3, 2]}, "data must have two axes, not [5, 3, 2]"),
    ({"data_shape": [5, 5]}, "cannot tell the time axis: data [5, 5], times 5"), ({"data_shape": [4, 3]}, "cannot tell the time axis: data [4, 3], times 5"),
])
def test_a_bad_file_is_a_row(spark, change, error):
    got = {r.path: r for r in derive_headers(spark.createDataFrame([row("bad", **change), row("good")], RAW_SCHEMA)).collect()}
    assert got["good"].status == "ok" and (got["bad"].status, got["bad"].error, got["bad"].size_bytes) == ("error", error, 9)
    assert all(v is None for k, v in got["bad"].asDict().items() if k not in ("path", "status", "error", "size_bytes"))


def test_headers_feed_the_window_reader(spark):
    raw = spark.createDataFrame([row("f1"), row("f2", times_us=[t + 50_000 for t in TIMES]), row("bad", data_shape=[5, 5])], RAW_SCHEMA)
    files = as_window_files(derive_headers(raw), raw, F.lit(1.0))
    traces = spark.createDataFrame([(p, c, [float(10 * k + c) for k in range(5)]) for p in ("f1", "f2", "bad") for c in range(3)], TRACE_SCHEMA)
    w = spark.createDataFrame([("w", 1.025, 1.075)], "event_id string, start_s double, end_s double")
    heads, channels = read_windows(w, files, traces)
    assert (heads.collect()[0].samples, heads.collect()[0].source_files, channels.count()) == (5, ["f1", "f2"], 3)
