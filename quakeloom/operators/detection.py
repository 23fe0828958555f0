"""Detectability of events in sample-by-channel windows: any number of events in one plan."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakeloom.functions.scalar import log_snr
from quakeloom.operators import array
from quakeloom.operators.signal import lagged_peak, welch_rows
from quakeloom.tables import written


@dataclass(frozen=True)
class DetectionOptions:
    noise: tuple[float, float] = (-3.5, -0.5)
    signal: tuple[float, float] | None = (0.0, 10.0)
    search: tuple[float, float] | None = None
    block: int = 50
    min_z: float = 5.0
    min_fraction: float = 0.10
    #: Samples a second, where the samples have no column ``rate_hz``.
    rate_hz: float = 1000.0
    #: Least seconds of noise and of signal.
    min_noise_s: float = 1.0
    min_signal_s: float = 0.5
    #: Longest segment of a spectrum, and the power ratio from which a bin is usable.
    nperseg: int = 1024
    min_ratio: float = 9.0


def within(t: Column, bounds: tuple[float, float]) -> Column:
    return (t >= bounds[0]) & (t < bounds[1])


def _welch(samples: Column, rate_hz: Column, nperseg: Column) -> Column:
    """Power density of each array at its own rate and segment length."""

    @F.pandas_udf("array<double>")
    def run(v: pd.Series, rate: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or not len(x) else welch_rows(np.asarray(x, float)[None], r, int(k))[1][0] for x, r, k in zip(v, rate, n, strict=True)], index=v.index)

    return run(samples, rate_hz, nperseg)


def event_windows(samples: DataFrame, opts: DetectionOptions) -> DataFrame:
    """One row per event: peak time and value, the signal window used, sizes of both windows, and the first guard that fails.

    samples: event_id, sample, t, value of the array's envelope, rate_hz. The peak is the first of the
    greatest samples of the search window, or else of the signal window.
    """
    t, sought = F.col("t"), within(F.col("t"), opts.search or opts.signal)
    peak = F.max(F.when(sought, F.struct("value", (-F.col("sample")).alias("back"), "t")))
    rows = samples.groupBy("event_id").agg(
        F.count(F.when(within(t, opts.noise), 1)).alias("noise_samples"), F.max("rate_hz").alias("rate_hz"), F.min("rate_hz").alias("least_rate__"), peak.alias("p__")
    )
    first, last = (F.col("p__.t") - 0.25, F.col("p__.t") + 2.75) if opts.search else (F.lit(opts.signal[0]), F.lit(opts.signal[1]))
    rows = rows.select("*", F.col("p__.t").alias("peak_t"), F.col("p__.value").alias("peak_value"), first.cast("double").alias("signal_first"), last.cast("double").alias("signal_last")).drop("p__")
    held = samples.select("event_id", "t").join(rows.select("event_id", "signal_first", "signal_last"), "event_id").groupBy("event_id")
    rows = rows.join(held.agg(F.count(F.when((t >= F.col("signal_first")) & (t < F.col("signal_last")), 1)).alias("signal_samples")), "event_id")
    error = (
        F.when(F.col("least_rate__") != F.col("rate_hz"), "sample rate changes within the event")
        .when(F.col("noise_samples") < F.floor(opts.min_noise_s * F.col("rate_hz")), "too little noise")
        .when(F.col("peak_t").isNull(), "empty search window" if opts.search else "empty signal window")
        .when(F.col("signal_samples") < F.floor(opts.min_signal_s * F.col("rate_hz")), "too little signal")
    )
    return rows.withColumn("error", error).drop("least_rate__")


def _keyed_z(values: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    return array.robust_z(values, reference, keys).select(*keys, F.col("z").alias("peak_robust_z"))


def _adjacent(marked: DataFrame) -> DataFrame:
    """(event_id, channel, correlation) of each channel's signal with the next channel's of the event."""
    nxt = Window.partitionBy("event_id", "sample").orderBy("channel")
    rows = marked.filter("s__").select("event_id", "channel", F.col("value").alias("x"), F.lead("value").over(nxt).alias("y")).filter("y is not null")
    sums = rows.groupBy("event_id", "channel").agg(F.count("*").alias("n"), F.covar_pop("x", "y").alias("c"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"))
    norm = F.sqrt(F.col("vx") * F.col("vy"))
    return sums.select("event_id", "channel", F.when(norm * F.col("n") > array.EPS64, F.col("c") / norm).alias("correlation"))


def event_spectra(marked: DataFrame, windows: DataFrame, opts: DetectionOptions) -> DataFrame:
    """(event_id, bin, frequency_hz, signal_power, noise_power, power_ratio): medians over channels of their power densities.

    marked: samples with n__ and s__. Segments are as long as both windows allow.
    """
    series = lambda flag: F.transform(F.array_sort(F.collect_list(F.when(F.col(flag), F.struct("sample", "value")))), lambda x: x["value"])
    traces = marked.filter("n__ or s__").groupBy("event_id", "channel").agg(series("s__").alias("signal"), series("n__").alias("noise"))
    n = F.least(F.lit(opts.nperseg).cast("long"), "noise_samples", "signal_samples")
    traces = traces.join(windows.select("event_id", "rate_hz", n.alias("nperseg")), "event_id")
    both = traces.select("event_id", "rate_hz", "nperseg", *[_welch(F.col(c), F.col("rate_hz"), F.col("nperseg")).alias(c) for c in ("signal", "noise")])
    bins = both.select("event_id", (F.col("rate_hz") / F.col("nperseg")).alias("step"), F.posexplode(F.arrays_zip("signal", "noise")).alias("bin", "p"))
    rows = bins.groupBy("event_id", "bin").agg(F.max(F.col("bin") * F.col("step")).alias("frequency_hz"), F.median("p.signal").alias("signal_power"), F.median("p.noise").alias("noise_power"))
    return rows.withColumn("power_ratio", F.col("signal_power") / (F.col("noise_power") + array.EPS32))


def event_usable_ranges(spectra: DataFrame, min_ratio: float = 9.0) -> DataFrame:
    """(event_id, ranges): [first_hz, last_hz] of runs of two and more neighbouring bins at ``min_ratio``, in order."""
    ok = spectra.filter(~F.isnan("power_ratio") & (F.abs("power_ratio") < float("inf")) & (F.col("power_ratio") >= min_ratio))
    island = F.col("bin") - F.row_number().over(Window.partitionBy("event_id").orderBy("bin"))
    runs = ok.withColumn("island", island).groupBy("event_id", "island").agg(F.min("frequency_hz").alias("a"), F.max("frequency_hz").alias("z"), F.count("*").alias("bins"))
    return runs.filter("bins >= 2").groupBy("event_id").agg(F.array_sort(F.collect_list(F.array("a", "z"))).alias("ranges"))


def mark_windows(samples: DataFrame, windows: DataFrame, opts: DetectionOptions) -> DataFrame:
    """Samples of the events that pass their guards, with n__ (noise) and s__ (signal)."""
    good = windows.filter("error is null").select("event_id", "signal_first", "signal_last")
    t = F.col("t")
    rows = samples.join(good, "event_id")
    return rows.withColumns({"n__": within(t, opts.noise), "s__": (t >= F.col("signal_first")) & (t < F.col("signal_last"))}).drop("signal_first", "signal_last")


def event_blocks(marked: DataFrame, opts: DetectionOptions) -> DataFrame:
    """Per event and block of channels: span, channels, median SNR, robust z of the block envelope's peak, whether it is detected."""
    block = F.floor(F.col("channel") / opts.block).cast("long").alias("block_id")
    square = F.col("value") * F.col("value")
    env = marked.filter("n__ or s__").groupBy("event_id", block, "sample", "n__", "s__").agg(F.sqrt(F.avg(square)).alias("value"))
    z = _keyed_z(env.filter("s__").groupBy("event_id", "block_id").agg(F.max("value").alias("value")), env.filter("n__"), ["event_id", "block_id"])
    snr = channel_snr(marked)
    span = snr.groupBy("event_id", block).agg(F.min("channel").alias("column_start"), F.max("channel").alias("column_end"), F.count("*").alias("sampled_channel_count"), F.median("snr").alias("median_channel_snr"))
    return span.join(z, ["event_id", "block_id"]).withColumn("detected", F.col("peak_robust_z") >= opts.min_z)


def channel_snr(marked: DataFrame) -> DataFrame:
    """(event_id, channel, noise_rms, signal_rms, snr)."""
    rms = lambda flag: F.sqrt(F.avg(F.when(F.col(flag), F.col("value") * F.col("value"))))
    rows = marked.groupBy("event_id", "channel").agg(rms("n__").alias("noise_rms"), rms("s__").alias("signal_rms"))
    return rows.withColumn("snr", F.col("signal_rms") / (F.col("noise_rms") + array.EPS32))


def detect_events(samples: DataFrame, opts: DetectionOptions = DetectionOptions()) -> DataFrame:
    """One row per event: peak, channel SNR, share of detected blocks, adjacent correlation, usable ranges, verdict or error.

    samples: event_id, sample, t (seconds from the event's origin), channel, value, already filtered, and
    perhaps rate_hz; one value a sample and channel. Every step is keyed by event, so a thousand events are a
    thousand groups of the same few shuffles. Robust scales are of each event's, and each block's, own
    noise. The events' windows, a row each, are written once, as every later step starts from them. An event that fails a guard (rate, seconds of noise or signal, empty window) has status ERROR, its
    error, and no figures; the others are not held up. A group is one event's envelope, channels or bins.
    """
    if not opts.search and not opts.signal:
        raise ValueError("a signal or search window is needed")
    if "rate_hz" not in samples.columns:
        samples = samples.withColumn("rate_hz", F.lit(float(opts.rate_hz)))
    env = samples.groupBy("event_id", "sample", "t", "rate_hz").agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("value"))
    windows = written(event_windows(env, opts), "windows")
    marked = mark_windows(samples, windows, opts)
    peaks = windows.filter("error is null").select("event_id", F.col("peak_value").alias("value"))
    z = _keyed_z(peaks, mark_windows(env, windows, opts).filter("n__").select("event_id", "value"), ["event_id"])
    snr = channel_snr(marked).groupBy("event_id").agg(F.median("snr").alias("median_channel_snr"), F.percentile("snr", 0.1).alias("p10_channel_snr"), F.count("*").alias("sampled_channel_count"), F.min("channel").alias("column_start"), F.max("channel").alias("column_end"))
    share = event_blocks(marked, opts).groupBy("event_id").agg(F.count("*").alias("block_count"), F.avg(F.col("detected").cast("double")).alias("detected_block_fraction"))
    beside = _adjacent(marked).groupBy("event_id").agg(F.median("correlation").alias("median_adjacent_correlation"), F.median(F.abs("correlation")).alias("median_absolute_adjacent_correlation"))
    ranges = event_usable_ranges(event_spectra(marked, windows, opts), opts.min_ratio)
    out = windows.select("event_id", "error", "noise_samples", "signal_samples", "peak_t", "signal_first", "signal_last")
    for part in (z, snr, share, beside, ranges):
        out = out.join(part, "event_id", "left")
    found = (F.col("peak_robust_z") >= opts.min_z) & (F.col("detected_block_fraction") >= opts.min_fraction)
    status = F.when(F.col("error").isNotNull(), "ERROR").when(found, "PASS").otherwise("STOP")
    ranged = F.when(F.col("error").isNull(), F.coalesce("ranges", F.array().cast("array<array<double>>")))
    return out.withColumns({"detected": F.when(F.col("error").isNull(), found), "status": status, "usable_power_snr_ranges_hz": ranged}).drop("ranges")



def hard_negative_baseline(samples: DataFrame, pairs: DataFrame, opts: DetectionOptions = DetectionOptions(), window: tuple[float, float] = (0.5, 10.0), max_lag_s: float = 0.5, limit: float = 0.8) -> DataFrame:
    """One row per pair of events: how alike two events are, channel by channel, that are known to be of different families.

    samples: see :func:`detect_events`; pairs: first, second, event ids. Traces of ``window`` are joined by event and
    channel, so channels are those that both events have, and cut to the shorter. Columns: first, second,
    channel_count (channels with energy in both), median, p90, p95 and maximum of their greatest correlations within
    ``max_lag_s``, the share at ``limit`` or above, and the rank correlation of the two events' log SNR by channel,
    which is null where a pair fails a guard of detection.
    """
    if "rate_hz" not in samples.columns:
        samples = samples.withColumn("rate_hz", F.lit(float(opts.rate_hz)))
    cut = samples.filter(within(F.col("t"), window)).groupBy("event_id", "channel").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample", "value"))), lambda x: x["value"]).alias("v"))
    sides = pairs.join(cut.toDF("first", "channel", "x"), "first").join(cut.toDF("second", "channel", "y"), ["second", "channel"])
    found = sides.select("first", "second", lagged_peak(F.col("x"), F.col("y"), opts.rate_hz, max_lag_s)["correlation"].alias("c")).filter("c is not null")
    alike = found.groupBy("first", "second").agg(
        F.count("*").alias("channel_count"), F.median("c").alias("median"), F.percentile("c", 0.9).alias("p90"), F.percentile("c", 0.95).alias("p95"), F.max("c").alias("maximum"),
        F.avg((F.col("c") >= limit).cast("double")).alias("fraction_above"),
    )
    env = samples.groupBy("event_id", "sample", "t", "rate_hz").agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("value"))
    loud = channel_snr(mark_windows(samples, event_windows(env, opts), opts)).select("event_id", "channel", log_snr(F.col("snr")).alias("s"))
    both = pairs.join(loud.toDF("first", "channel", "a"), "first").join(loud.toDF("second", "channel", "b"), ["second", "channel"])
    ranked = array.average_ranks(array.average_ranks(both, ["first", "second"], "a", "ra"), ["first", "second"], "b", "rb")
    print_ = ranked.groupBy("first", "second").agg(F.corr("ra", "rb").alias("fingerprint_spearman"))
    return pairs.join(alike, ["first", "second"], "left").join(print_, ["first", "second"], "left").fillna(0, ["channel_count"])
