"""Time windows of array recordings: adjacent files joined by index arithmetic, their invariants checked file by file."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakeloom.functions.scalar import phase_scale
from quakeloom.operators.intervals import coarse_file_filter, overlap_join

#: One row a file: the time in its name, its acquisition settings, and the time of every sample.
FILE_SCHEMA = "path string, stamp_s double, sample_rate_hz double, start_locus_index long, raw_data_unit string, channel_count int, times_us array<long>"
#: One row a file and column; the array is in the order of the file's times.
TRACE_SCHEMA = "path string, column_index int, samples array<float>"

#: Seconds by which a file may begin before, and end after, the time in its name.
LEAD_S, TAIL_S = 2.0, 62.0

_MERGED = "struct<kept array<int>, epoch_s array<double>, max_gap_s double>"


def _merge(times_us: Column) -> Column:
    """From the sample times of a window's files one after the other: which samples stay, their times, the greatest gap.

    Samples are put in order of time; of equal times the first file's stays. One sample has an infinite gap.
    """

    @F.pandas_udf(_MERGED)
    def run(v: pd.Series) -> pd.DataFrame:
        rows = []
        for parts in v:
            t = np.asarray(parts, np.int64)
            order = np.argsort(t, kind="stable")
            kept = order[np.concatenate([[True], np.diff(t[order]) > 0])] if len(t) else order
            s = t[kept] * 1e-6
            rows.append((kept.astype(np.int32), s, float(np.diff(s).max()) if len(s) > 1 else float("inf")))
        return pd.DataFrame(rows, columns=["kept", "epoch_s", "max_gap_s"])

    return run(times_us)


def candidate_files(windows: DataFrame, files: DataFrame) -> DataFrame:
    """(event_id, start_s, end_s, path) of the files whose name's time may hold samples of a window; names without a time match nothing."""
    f = files.filter("stamp_s is not null").select("path", "stamp_s", (F.col("stamp_s") - LEAD_S).alias("near__"), (F.col("stamp_s") + TAIL_S).alias("far__"))
    hits = overlap_join(windows.select("event_id", "start_s", "end_s"), f, ("start_s", "end_s", "near__", "far__"))
    return hits.filter(coarse_file_filter(F.col("stamp_s"), F.col("start_s"), F.col("end_s"), LEAD_S, TAIL_S)).select("event_id", "start_s", "end_s", "path")


def used_files(windows: DataFrame, files: DataFrame, first: int = 0, last: int | None = None, stride: int = 1) -> DataFrame:
    """(event_id, path, file_order, from_sample, to_sample, times_us, settings, error) of the files with samples in a window.

    file_order is by name's time, then path. Error is the first of: an empty channel slice, or a sample
    rate, columns, loci or unit other than those of the window's first file. Windows meet names and
    times of files; only the files found bring their sample times, by path.
    """
    start, end = F.col("start_s"), F.col("end_s")
    seconds = lambda t: t * F.lit(1e-6)
    inside = F.filter("times_us", lambda t: (seconds(t) >= start) & (seconds(t) < end))
    rows = candidate_files(windows, files).join(files, "path").withColumn("from_sample", F.size(F.filter("times_us", lambda t: seconds(t) < start)))
    rows = rows.withColumn("times_us", inside).filter(F.size("times_us") > 0)
    stop = F.col("channel_count") if last is None else F.least("channel_count", F.lit(last))
    rows = rows.withColumns({
        "stop__": stop, "columns__": F.when(stop > first, F.floor((stop - 1 - first) / stride) + 1).otherwise(0).cast("int"), "locus__": F.coalesce("start_locus_index", F.lit(0)),
        "to_sample": F.col("from_sample") + F.size("times_us"), "scale": phase_scale(F.coalesce("raw_data_unit", F.lit(""))),
    })
    raw = F.coalesce("raw_data_unit", F.lit(""))
    unit = F.when(F.col("scale") != 1, "processed_optical_phase_rad").when(raw == "", "raw_counts_unknown_unit").otherwise(raw)  # fixed values: names of units
    order = Window.partitionBy("event_id").orderBy("stamp_s", "path")
    rows = rows.withColumn("unit", unit).withColumn("file_order", F.row_number().over(order) - 1)
    of_first = lambda c: F.first(c).over(order)
    error = (
        F.when((F.lit(first) < 0) | (F.col("columns__") == 0), F.concat(F.lit(f"invalid channel slice {first}:"), F.col("stop__"), F.lit(" for "), F.col("channel_count"), F.lit(" channels")))
        .when(F.col("sample_rate_hz") != of_first("sample_rate_hz"), "sample rate changes inside the window")
        .when(F.col("columns__") != of_first("columns__"), "channel columns change inside the window")
        .when(F.col("locus__") != of_first("locus__"), "locus indices change inside the window")
        .when(F.col("unit") != of_first("unit"), "raw unit changes inside the window")
    )
    return rows.select(
        "event_id", "start_s", "end_s", "path", "file_order", "from_sample", "to_sample", "times_us", "sample_rate_hz", F.col("columns__").alias("columns"),
        F.col("locus__").alias("start_locus_index"), "unit", "scale", F.when(error.isNotNull(), F.concat(error, F.lit(": "), F.col("path"))).alias("error"),
    )


def read_windows(windows: DataFrame, files: DataFrame, traces: DataFrame, first: int = 0, last: int | None = None, stride: int = 1) -> tuple[DataFrame, DataFrame]:
    """Windows and their channels.

    windows: event_id, start_s, end_s; files: ``FILE_SCHEMA``; traces: ``TRACE_SCHEMA``. Columns first:last:stride
    are read. The first result has one row per window: event_id, error, source_files, sample_rate_hz, unit, channels,
    samples, epoch_s, max_gap_s, missing_fraction. The second has one row per window without error and column: event_id,
    column_index, locus_index, values, in the order of the window's epoch_s, scaled to radians where the unit is one of phase.

    A window's error names the first file, by time, that breaks an invariant; a window without a file of a
    fitting name, or without a sample in such a file, has one as well. Samples are not exploded: each file's
    part is a slice, and what stays of the parts, in which order, is found once a window and applied to each
    column. Files of a window are joined to it by an interval index, columns by path.
    """
    if first < 0 or stride <= 0:
        raise ValueError("the first channel must not be negative and a stride be positive")
    empty = windows.filter("end_s <= start_s").select("event_id").withColumn("error", F.lit("a window must end after its start"))
    ok = windows.filter("end_s > start_s")
    named = candidate_files(ok, files).select("event_id").distinct().withColumn("named__", F.lit(True))
    used = used_files(ok, files, first, last, stride)
    parts = F.array_sort(F.collect_list(F.struct("file_order", "error", "path", "times_us")))
    told = used.groupBy("event_id").agg(
        parts.alias("p"), F.min_by("sample_rate_hz", "file_order").alias("sample_rate_hz"), F.min_by("unit", "file_order").alias("unit"), F.min_by("columns", "file_order").alias("channels"),
    )
    told = told.select(
        "event_id", "sample_rate_hz", "unit", "channels", F.get(F.filter("p.error", lambda e: e.isNotNull()), 0).alias("broken__"), F.col("p.path").alias("source_files"), _merge(F.flatten("p.times_us")).alias("m"),
    )
    rows = ok.select("event_id", "start_s", "end_s").join(named, "event_id", "left").join(told, "event_id", "left")
    error = F.when(F.col("named__").isNull(), "no file name intersects the window").when(F.col("m").isNull(), "candidate files do not contain the window").otherwise(F.col("broken__"))
    expected = F.greatest(F.lit(1.0), F.bround((F.col("end_s") - F.col("start_s")) * F.col("sample_rate_hz")))
    fine = lambda c: F.when(F.col("error").isNull(), c)
    rows = rows.withColumn("error", error).select(
        "event_id", "error", fine(F.col("source_files")).alias("source_files"), fine(F.col("sample_rate_hz")).alias("sample_rate_hz"), fine(F.col("unit")).alias("unit"), fine(F.col("channels")).alias("channels"),
        fine(F.size("m.kept")).alias("samples"), fine(F.col("m.epoch_s")).alias("epoch_s"), fine(F.col("m.max_gap_s")).alias("max_gap_s"),
        fine(F.greatest(F.lit(0.0), 1 - F.size("m.kept") / expected)).alias("missing_fraction"), fine(F.col("m.kept")).alias("kept__"),
    )
    wanted = (F.col("column_index") >= first) & ((F.col("column_index") - first) % stride == 0)
    columns = traces.filter(wanted if last is None else wanted & (F.col("column_index") < last))
    pieces = used.select("event_id", "path", "file_order", "from_sample", "to_sample", "start_locus_index", "scale").join(columns, "path")
    piece = F.slice("samples", F.col("from_sample") + 1, F.col("to_sample") - F.col("from_sample"))
    whole = pieces.groupBy("event_id", "column_index").agg(
        F.array_sort(F.collect_list(F.struct("file_order", piece.alias("x")))).alias("p"), F.min("start_locus_index").alias("locus__"), F.min("scale").alias("scale"),
    ).select("event_id", "column_index", (F.col("column_index") + F.col("locus__")).alias("locus_index"), F.col("scale").cast("float").alias("scale"), F.flatten("p.x").alias("x"))
    joined = whole.join(rows.filter("error is null").select("event_id", "kept__"), "event_id")
    channels = joined.select("event_id", "column_index", "locus_index", F.transform("kept__", lambda i: F.get("x", i) * F.col("scale")).alias("values"))
    heads = rows.drop("kept__")
    return heads.unionByName(empty, allowMissingColumns=True), channels
