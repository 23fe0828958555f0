"""Scalar expressions over events and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.functions import scalar
from quakeloom.operators import gates
from quakeloom.sources.shots import read_shots


def shot_log_utc(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    log = e.select(F.col("event_id").cast("string").alias("shot_number"), F.date_format("ts", "HH:mm:ss").alias("local_time"), F.date_format("ts", "yyyy-MM-dd").alias("date"))
    out = read_shots(log, "America/Los_Angeles")
    return out.select("shot_number", "local_time", F.col("nominal_origin_time").cast("timestamp_ntz").alias("nominal_origin_time"))


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet")


def brune_ratio(spark: SparkSession, d: str) -> DataFrame:
    p = _parts(spark, d).select("p_partkey", (F.col("p_partkey") % 80 + 1).cast("double").alias("f"))
    r = scalar.brune_ratio(F.col("f"), F.lit(1.7), F.lit(18.0), F.lit(45.0))
    return p.select("p_partkey", "f", F.round(r, 6).alias("ratio"))


def relative_stress_drop(spark: SparkSession, d: str) -> DataFrame:
    p = _parts(spark, d).select("p_partkey", (F.col("p_partkey") % 7 + 1).cast("double").alias("m"), (F.col("p_partkey") % 30 + 5).cast("double").alias("ft"), (F.col("p_partkey") % 11 + 3).cast("double").alias("fr"))
    drop = scalar.relative_stress_drop(F.col("m"), F.col("ft"), F.col("fr"))
    gate = scalar.stress_drop_gate(F.when(F.col("p_partkey") % 3 == 0, "PASS").otherwise("STOP"), F.col("m") / 10, F.col("fr") / 20)
    return p.select("p_partkey", F.round(drop, 6).alias("relative_stress_drop"), gate.alias("status"))


def optional_float(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.when(k % 5 == 0, "NaN").when(k % 5 == 1, "Infinity").when(k % 5 == 2, "").when(k % 5 == 3, "n/a").otherwise((k / 4).cast("string"))
    return _parts(spark, d).select("p_partkey", scalar.optional_float(text).alias("value"))


def catalogue_time(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, ".55").otherwise(".1234567"), F.when(F.col("event_id") % 2 == 0, "Z").otherwise(""))
    return e.select("event_id", scalar.catalogue_time(text).alias("origin_time"), scalar.iso_ms(scalar.catalogue_time(text)).alias("iso"))


def event_time(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    k = F.col("event_id")
    t = scalar.event_time(F.lit(2001), (k % 12 + 1).cast("int"), (k % 28 + 1).cast("int"), (k % 24).cast("int"), (k % 60).cast("int"), (k % 6100) / 100.0)
    return e.select("event_id", t.alias("origin_time"))


def phase_scale(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    unit = F.when(k % 3 == 0, "rad * 2PI/2^16").when(k % 3 == 1, "Rad*2pi/2^16 (raw)").otherwise("strain")
    return _parts(spark, d).select("p_partkey", F.round(scalar.phase_scale(unit) * 1e6, 6).alias("scale_ppm"), scalar.trace_key(F.lit("BP"), (k % 9).cast("string"), F.lit("DP1")).alias("trace"), scalar.band_label(k % 5 + 1, k % 5 + 9).alias("band"))


def describe_by_role(spark: SparkSession, d: str) -> DataFrame:
    """Count, mean, deviation and percentiles of values by type."""
    v = F.col("value")
    p = lambda q: F.round(F.percentile(v, q), 6)
    return spark.read.parquet(f"{d}/events.parquet").groupBy("event_type").agg(
        F.count(v).alias("count"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_samp(v), 6).alias("std"), F.min(v).alias("min"), p(0.1).alias("p10"), p(0.5).alias("p50"), p(0.9).alias("p90"), F.max(v).alias("max")
    )


def calibration_verdict(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    shots = e.select("event_type", (F.col("event_id") % 2 == 0).alias("detected"), (F.col("event_id") % 40 / 10.0).alias("median_snr"), (F.col("event_id") % 15 - 7).cast("double").alias("offset_s"), (F.col("event_id") % 9 != 0).alias("has_band"))
    return gates.calibration_verdict(shots)


def exclusion_reasons(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    r = gates.exclusion_reason(F.col("event_id") % 2 == 0, F.col("event_id") % 40 / 10.0, (F.col("event_id") % 15 - 7).cast("double"), F.col("event_id") % 9 != 0)
    return e.groupBy(r.alias("exclusion_reason")).agg(F.count("*").alias("n"))


_K = "SELECT p_partkey, "
QUERIES = {
    f.__name__: f
    for f in (shot_log_utc, brune_ratio, relative_stress_drop, optional_float, catalogue_time, event_time, phase_scale, describe_by_role, calibration_verdict, exclusion_reasons)
}
SQL = {
    "shot_log_utc": """SELECT event_id::VARCHAR AS shot_number, strftime(ts, '%H:%M:%S') AS local_time, (date_trunc('second', ts) AT TIME ZONE 'America/Los_Angeles') AT TIME ZONE 'UTC' AS nominal_origin_time FROM events""",
    "brune_ratio": "SELECT p_partkey, f, round(1.7::DOUBLE * (1 + pow(f / 45.0::DOUBLE, 2)) / (1 + pow(f / 18.0::DOUBLE, 2)), 6) AS ratio FROM (SELECT p_partkey, (p_partkey % 80 + 1)::DOUBLE AS f FROM part)",
    "relative_stress_drop": """SELECT p_partkey, round(m * pow(ft / fr, 3), 6) AS relative_stress_drop, CASE WHEN p_partkey % 3 = 0 AND m / 10 <= 0.5 AND fr / 20 <= 0.5 THEN 'PASS' ELSE 'STOP' END AS status
FROM (SELECT p_partkey, (p_partkey % 7 + 1)::DOUBLE AS m, (p_partkey % 30 + 5)::DOUBLE AS ft, (p_partkey % 11 + 3)::DOUBLE AS fr FROM part)""",
    "optional_float": "SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN p_partkey / 4 END AS value FROM part",
    "catalogue_time": """SELECT event_id, t AS origin_time, strftime(t, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso FROM (SELECT event_id, date_trunc('second', ts) + CASE event_id % 3 WHEN 0 THEN INTERVAL 0 SECOND WHEN 1 THEN INTERVAL 550000 MICROSECOND ELSE INTERVAL 123456 MICROSECOND END AS t FROM events)""",
    "event_time": """SELECT event_id, make_timestamp(2001, event_id % 12 + 1, event_id % 28 + 1, event_id % 24, event_id % 60, 0.0) + to_microseconds((event_id % 6100) * 10000) AS origin_time FROM events""",
    "phase_scale": """SELECT p_partkey, round(CASE WHEN p_partkey % 3 < 2 THEN 6.283185307179586::DOUBLE / 65536 ELSE 1.0::DOUBLE END * 1e6, 6) AS scale_ppm, 'BP.' || (p_partkey % 9) || '.DP1' AS trace,
  (p_partkey % 5 + 1) || '.0-' || (p_partkey % 5 + 9) || '.0Hz' AS band FROM part""",
    "describe_by_role": """SELECT event_type, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50,
  round(quantile_cont(value, 0.9), 6) AS p90, max(value) AS max FROM events GROUP BY 1""",
    "calibration_verdict": """SELECT *, CASE WHEN usable >= 3 THEN 'PASS' ELSE 'STOP' END AS shot_detectability, CASE WHEN usable >= 3 THEN 'PASS' ELSE 'CONDITIONAL' END AS channel_response,
  'CONDITIONAL' AS absolute_timing, 'STOP' AS absolute_geometry FROM (SELECT count(*) AS shots, count(*) FILTER (WHERE event_id % 2 = 0) AS detected,
  count(*) FILTER (WHERE event_id % 2 = 0 AND event_id % 40 >= 15 AND event_id % 15 - 7 BETWEEN 0 AND 5 AND event_id % 9 <> 0) AS usable FROM events)""",
    "exclusion_reasons": """SELECT CASE WHEN event_id % 2 = 0 AND event_id % 40 >= 15 AND event_id % 15 - 7 BETWEEN 0 AND 5 AND event_id % 9 <> 0 THEN ''
  ELSE 'nominal offset, median channel SNR, or array-median usable band failed the calibration-quality rule' END AS exclusion_reason, count(*) AS n FROM events GROUP BY 1""",
}
