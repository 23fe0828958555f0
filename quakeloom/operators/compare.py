"""Waveform comparison of event pairs, trace by trace and band by band."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakeloom.functions.scalar import band_label, trace_key
from quakeloom.operators import gates, pairs, signal


@dataclass(frozen=True)
class CompareOptions:
    noise: tuple[float, float] = (-8.0, -2.0)
    signal: tuple[float, float] = (0.5, 10.0)
    bands: tuple[tuple[float, float], ...] = ((2.0, 10.0), (5.0, 20.0), (10.0, 40.0), (2.0, 40.0))
    max_lag_s: float = 0.5
    pair: pairs.PairOptions = field(default_factory=pairs.PairOptions)

    @property
    def band_names(self) -> list[str]:
        return [f"{a}-{b}Hz" for a, b in self.bands]


def windowed_traces(traces: DataFrame, origins: DataFrame, opts: CompareOptions = CompareOptions()) -> DataFrame:
    """The longest trace of each event and key with its signal and noise window relative to the event's origin.

    traces: see ``sources.files.TRACE_SCHEMA``; origins: event_id, origin_epoch_s. Traces that do not
    reach over both windows are left out.
    """
    keyed = traces.withColumn("trace_key", trace_key(F.col("network"), F.col("station"), F.col("channel")))
    rows = pairs.longest_traces(keyed).join(origins, "event_id").withColumn("rel", F.col("start_epoch_s") - F.col("origin_epoch_s"))
    cut = lambda w: signal.on_grid(F.col("samples"), F.col("rel"), F.col("sampling_rate"), *w)
    out = rows.select("event_id", "trace_key", "station", "channel", "sampling_rate", cut(opts.signal).alias("signal"), cut(opts.noise).alias("noise"))
    return out.filter("signal is not null and noise is not null")


def pair_metrics(windowed: DataFrame, event_pairs: DataFrame, fs: float, opts: CompareOptions = CompareOptions()) -> DataFrame:
    """One row per pair, common trace key and band: SNR of both sides, correlation, lag, usable.

    event_pairs: pair_name, a, b. Traces are filtered once for each band, before they are paired; keys
    and bands spread the join, so no event's traces meet in one task.
    """
    one_rate = windowed.filter(F.abs(F.col("sampling_rate") - fs) <= 1e-6)
    banded = None
    for low, high in opts.bands:
        s, n = signal.bandpass(F.col("signal"), low, high, fs), signal.bandpass(F.col("noise"), low, high, fs)
        part = one_rate.select("event_id", "trace_key", "station", "channel", band_label(F.lit(low), F.lit(high)).alias("band"), s.alias("s"), n.alias("n"))
        banded = part if banded is None else banded.unionByName(part)
    banded = banded.withColumn("snr", signal.rms_snr(F.col("s"), F.col("n"))).drop("n")
    left = banded.select(F.col("event_id").alias("a"), "trace_key", "band", "station", F.col("channel").alias("component"), F.col("s").alias("x"), F.col("snr").alias("reference_snr"))
    right = banded.select(F.col("event_id").alias("b"), "trace_key", "band", F.col("s").alias("y"), F.col("snr").alias("comparison_snr"))
    rows = event_pairs.join(left, "a").join(right, ["b", "trace_key", "band"])
    rows = rows.withColumn("p", signal.lagged_peak(F.col("x"), F.col("y"), fs, opts.max_lag_s))
    rows = rows.select("pair_name", "a", "b", "trace_key", "station", "component", "band", "reference_snr", "comparison_snr", F.col("p.correlation").alias("correlation"), F.col("p.lag_s").alias("lag_s"))
    return rows.withColumn("usable", pairs.usable(F.col("correlation"), F.col("reference_snr"), F.col("comparison_snr"), opts.pair))


def score_shortlist(metrics: DataFrame, shortlist: DataFrame, seed_id: str, opts: CompareOptions = CompareOptions()) -> DataFrame:
    """Every shortlisted event's decision against the seed; one without any metric is a data error, the seed is itself.

    metrics: :func:`pair_metrics` of pairs (seed, event) named by the event's id.
    """
    decided = pairs.pair_decision(metrics, opts.band_names, opts.pair).withColumnRenamed("pair_name", "event_id")
    rows = shortlist.withColumn("event_id", F.col("event_id").cast("string")).join(decided, "event_id", "left")
    decision = F.when(F.col("event_id") == seed_id, "seed").otherwise(F.coalesce("decision", F.lit("download_or_data_error")))
    rows = rows.withColumn("decision", decision)
    return rows.withColumn("membership_status", gates.membership_status(F.col("decision")))
