"""Array queries: each vector is a sample over 64 channels; small labels are noise, the others signal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.operators import array


def _samples(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    rows = e.select(F.col("vec_id").alias("sample"), (F.col("label") < 5).alias("noise"), F.posexplode("embedding").alias("channel", "x"))
    return rows.select("sample", "noise", "channel", F.col("x").cast("double").alias("value"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c, t in df.dtypes if t == "double"})


def rms_envelope(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(array.envelope(_samples(spark, d))).withColumnRenamed("value", "envelope")


def robust_z(spark: SparkSession, d: str) -> DataFrame:
    env = array.envelope(_samples(spark, d), ["noise"])
    return _rounded(array.robust_z(env.filter("not noise"), env.filter("noise"), [])).select("sample", F.col("value").alias("envelope"), "z")


def argmax_first(spark: SparkSession, d: str) -> DataFrame:
    env = array.envelope(_samples(spark, d), ["noise"]).filter("not noise").select("sample", F.round("value", 6).alias("value"))
    return array.peak_sample(env).select(F.col("sample").alias("peak_sample"), F.col("value").alias("peak_value"))


def channel_snr(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(array.channel_snr(_samples(spark, d), F.col("noise"), ~F.col("noise")))


def block_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = array.block_metrics(_samples(spark, d), F.col("noise"), ~F.col("noise"), 8, 2.5, ["noise"])
    return _rounded(out.drop("detected")).withColumn("detected", F.col("peak_robust_z") >= 2.5)


def detected_fraction(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(array.detected_fraction(block_metrics(spark, d)))


def adjacent_correlation(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(array.adjacent_correlation(_samples(spark, d).filter("not noise").drop("noise")))


def spearman_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of the channel profiles (mean square per channel) of every two labels."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    s = e.select("label", F.posexplode("embedding").alias("channel", "x"))
    profile = s.groupBy(F.col("label").alias("profile"), "channel").agg(F.round(F.log10(F.greatest(F.avg(F.col("x").cast("double") * F.col("x").cast("double")), F.lit(1e-6))), 4).alias("value"))
    return _rounded(array.spearman(profile))


def spearman_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The whole matrix of rank correlations of a hundred channel profiles: vectors by label and last digit of their id."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    s = e.select((F.col("label") * 10 + F.col("vec_id") % 10).alias("profile"), F.posexplode("embedding").alias("channel", "x"))
    profile = s.groupBy("profile", "channel").agg(F.round(F.log10(F.greatest(F.avg(F.col("x").cast("double") * F.col("x").cast("double")), F.lit(1e-6))), 4).alias("value"))
    return _rounded(array.spearman_matrix(profile, 32))


def usable_ranges(spark: SparkSession, d: str) -> DataFrame:
    snr = array.channel_snr(_samples(spark, d), F.col("noise"), ~F.col("noise"))
    spectrum = snr.select(F.col("channel").alias("bin"), (F.col("channel") * 0.5).alias("frequency_hz"), F.round("snr", 6).alias("power_ratio"))
    return array.usable_ranges(spectrum, 1.0)


def gap_stats(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    sec = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("double")
    rows = array.dedupe_times(e.select("event_type", sec.alias("epoch_s"), "event_id"), ["event_type"], "epoch_s", ["event_id"])
    return _rounded(array.gap_stats(rows.withColumn("expected", F.lit(5000.0)), ["event_type"], "epoch_s", "expected"))


_V = "WITH s AS (SELECT vec_id AS sample, label < 5 AS noise, label, unnest(range(0, 64)) AS channel, unnest(embedding)::DOUBLE AS x FROM embeddings)\n"
_E = _V + ", v AS (SELECT sample, noise, sqrt(avg(x * x)) AS value FROM s GROUP BY 1, 2)\n"
_N = _V + """, c AS (SELECT channel, sqrt(avg(x * x) FILTER (WHERE noise)) AS nr, sqrt(avg(x * x) FILTER (WHERE NOT noise)) AS sr FROM s GROUP BY 1),
n AS (SELECT channel, nr AS noise_rms, sr AS signal_rms, sr / (nr + 1.1920929e-07::DOUBLE) AS snr FROM c)
"""
_B = _N + """, be AS (SELECT channel // 8 AS block_id, sample, noise, sqrt(avg(x * x)) AS value FROM s GROUP BY 1, 2, 3),
md AS (SELECT block_id, median(value) AS med, stddev_pop(value) AS sd FROM be WHERE noise GROUP BY 1),
ad AS (SELECT be.block_id, med, sd, 1.4826::DOUBLE * median(abs(value - med)) AS mad FROM be JOIN md USING (block_id) WHERE noise GROUP BY 1, 2, 3),
pk AS (SELECT block_id, max(value) AS value FROM be WHERE NOT noise GROUP BY 1),
bz AS (SELECT block_id, (value - med) / (CASE WHEN mad <= 2.220446049250313e-16::DOUBLE THEN sd ELSE mad END + 2.220446049250313e-16::DOUBLE) AS z FROM pk JOIN ad USING (block_id)),
b AS (SELECT channel // 8 AS block_id, min(channel)::INT AS column_start, max(channel)::INT AS column_end, count(*) AS sampled_channel_count, round(median(snr), 6) AS median_channel_snr, round(any_value(z), 6) AS peak_robust_z,
  round(any_value(z), 6) >= 2.5::DOUBLE AS detected FROM n JOIN bz ON bz.block_id = n.channel // 8 GROUP BY 1)
"""

QUERIES = {f.__name__: f for f in (rms_envelope, robust_z, argmax_first, channel_snr, block_metrics, detected_fraction, adjacent_correlation, spearman_fingerprint, spearman_matrix, usable_ranges, gap_stats)}

SQL = {
    "rms_envelope": _E + "SELECT sample, round(value, 6) AS envelope FROM v",
    "robust_z": _E
    + """, m AS (SELECT median(value) AS med, stddev_pop(value) AS sd FROM v WHERE noise), a AS (SELECT med, sd, 1.4826::DOUBLE * median(abs(value - med)) AS mad FROM v, m WHERE noise GROUP BY 1, 2)
SELECT sample, round(value, 6) AS envelope, round((value - med) / (CASE WHEN mad <= 2.220446049250313e-16::DOUBLE THEN sd ELSE mad END + 2.220446049250313e-16::DOUBLE), 6) AS z FROM v, a WHERE NOT noise""",
    "argmax_first": _E + "SELECT sample AS peak_sample, round(value, 6) AS peak_value FROM v WHERE NOT noise ORDER BY round(value, 6) DESC, sample LIMIT 1",
    "channel_snr": _N + "SELECT channel, round(noise_rms, 6) AS noise_rms, round(signal_rms, 6) AS signal_rms, round(snr, 6) AS snr FROM n",
    "block_metrics": _B + "SELECT * FROM b",
    "detected_fraction": _B + "SELECT count(*) AS block_count, round(avg(detected::DOUBLE), 6) AS detected_block_fraction FROM b",
    "adjacent_correlation": _V + "SELECT a.channel, round(corr(a.x, b.x), 6) + 0.0::DOUBLE AS correlation FROM s a JOIN s b ON a.sample = b.sample AND b.channel = a.channel + 1 WHERE NOT a.noise GROUP BY 1",
    "spearman_fingerprint": _V
    + """, p AS (SELECT label, channel, round(log10(greatest(avg(x * x), 1e-6::DOUBLE)), 4) AS v FROM s GROUP BY 1, 2),
r AS (SELECT label, channel, rank() OVER (PARTITION BY label ORDER BY v) + (count(*) OVER (PARTITION BY label, v) - 1) / 2 AS r FROM p)
SELECT a.label AS a, b.label AS b, round(corr(a.r, b.r), 6) + 0.0::DOUBLE AS spearman FROM r a JOIN r b ON a.channel = b.channel AND a.label < b.label GROUP BY 1, 2""",
    "spearman_matrix": _V
    + """, p AS (SELECT s.label * 10 + sample % 10 AS profile, channel, round(log10(greatest(avg(x * x), 1e-6::DOUBLE)), 4) AS v FROM s GROUP BY 1, 2),
r AS (SELECT profile::VARCHAR AS profile, channel, rank() OVER (PARTITION BY profile ORDER BY v) + (count(*) OVER (PARTITION BY profile, v) - 1) / 2 AS r FROM p)
SELECT a.profile AS a, b.profile AS b, CASE WHEN a.profile = b.profile THEN 1 ELSE round(corr(a.r, b.r), 6) + 0.0::DOUBLE END::DOUBLE AS spearman FROM r a JOIN r b ON a.channel = b.channel GROUP BY 1, 2""",
    "usable_ranges": _N
    + """, u AS (SELECT channel, channel - row_number() OVER (ORDER BY channel) AS g FROM n WHERE round(snr, 6) >= 1.0)
SELECT min(channel) * 0.5::DOUBLE AS first_hz, max(channel) * 0.5::DOUBLE AS last_hz, count(*) AS bins FROM u GROUP BY g HAVING count(*) >= 2""",
    "gap_stats": """WITH t AS (SELECT DISTINCT event_type, floor(epoch_us(ts) / 1e6) AS s FROM events), g AS (SELECT event_type, s - lag(s) OVER (PARTITION BY event_type ORDER BY s) AS g FROM t)
SELECT event_type, count(*) AS samples, round(coalesce(max(g), 'infinity'::DOUBLE), 6) AS max_gap_s, round(greatest(0.0::DOUBLE, 1 - count(*) / 5000.0::DOUBLE), 6) AS missing_fraction FROM g GROUP BY 1""",
}
