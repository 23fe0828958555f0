"""Display caches and profile tables: what detection works out of samples, as Parquet tables that later steps read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.functions.scalar import log_snr
from quakeloom.operators import array, detection, signal

#: The tables of an event cache, and of a profile cache.
EVENT_TABLES = ("traces", "channels", "spectra")
PROFILE_TABLES = ("profiles", "spearman")


def display_traces(samples: DataFrame, rate_hz: float, display_hz: float = 250.0) -> DataFrame:
    """(event_id, channel, display_rate_hz, first_t, last_t, values): traces at about ``display_hz``, never more than they have.

    samples: event_id, sample, t, channel, value. The rate is divided by a whole number, the nearest. A row is one
    channel of one event; times run evenly from first_t to last_t.
    """
    down = max(1, round(rate_hz / display_hz))
    traces = samples.groupBy("event_id", "channel").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("sample", "value"))), lambda x: x["value"].cast("double")).alias("v"), F.min("t").alias("first_t"), F.max("t").alias("last_t")
    )
    values = signal.resample(F.col("v"), down) if down > 1 else F.col("v")
    return traces.select("event_id", "channel", F.lit(rate_hz / down).alias("display_rate_hz"), "first_t", "last_t", values.alias("values"))


def event_cache(samples: DataFrame, opts: detection.DetectionOptions, display_hz: float = 250.0) -> dict[str, DataFrame]:
    """The cache of all events that pass their guards: display traces, noise and SNR by channel, median spectra by bin."""
    if "rate_hz" not in samples.columns:
        samples = samples.withColumn("rate_hz", F.lit(float(opts.rate_hz)))
    env = samples.groupBy("event_id", "sample", "t", "rate_hz").agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("value"))
    windows = detection.event_windows(env, opts)
    marked = detection.mark_windows(samples, windows, opts)
    return {"traces": display_traces(marked, opts.rate_hz, display_hz), "channels": detection.channel_snr(marked), "spectra": detection.event_spectra(marked, windows, opts)}


def profile_cache(channels: DataFrame) -> dict[str, DataFrame]:
    """Log SNR profiles of events (event_id, channel, log10_snr) and the matrix of their rank correlations (a, b, spearman)."""
    profiles = channels.select("event_id", "channel", log_snr(F.col("snr")).alias("log10_snr"))
    return {"profiles": profiles, "spearman": array.spearman_matrix(profiles.toDF("profile", "channel", "value"))}


def write_cache(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as a Parquet folder below ``path``; a cache that is there is replaced table by table."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def read_cache(spark: SparkSession, path: str, names: tuple[str, ...] = EVENT_TABLES) -> dict[str, DataFrame]:
    """The tables of a cache; one that is not there is an error."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}
