"""Signal kernels over vectors as short traces at 100 samples a second."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.functions.scalar import brune_ratio
from quakeloom.operators import array, compare, detection, gates, ordered, pairs, signal
from quakeloom.sources import caches
from quakeloom.tables import written

FS = 100.0


def _traces(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def bandpass(spark: SparkSession, d: str) -> DataFrame:
    return _traces(spark, d).select("vec_id", signal.bandpass(F.col("v"), 5.0, 20.0, FS).alias("filtered"))


def welch_psd(spark: SparkSession, d: str) -> DataFrame:
    return signal.median_spectrum(_traces(spark, d), "v", FS, 32, ["label"]).withColumn("power", F.round("power", 9))


def multitaper(spark: SparkSession, d: str) -> DataFrame:
    return _traces(spark, d).select("vec_id", signal.multitaper(F.col("v")).alias("amplitude"))


def resample(spark: SparkSession, d: str) -> DataFrame:
    return _traces(spark, d).select("vec_id", signal.resample(F.col("v"), 2).alias("resampled"))


def display_traces(spark: SparkSession, d: str) -> DataFrame:
    """Channels of every event of 96 vectors at half their rate, value by value."""
    out = caches.display_traces(_event_samples(spark, d), 40.0, 20.0)
    out = out.select("event_id", "channel", "display_rate_hz", "first_t", "last_t", F.posexplode("values").alias("k", "x"))
    return out.withColumn("x", F.round("x", 6))


def interpolate(spark: SparkSession, d: str) -> DataFrame:
    """Values halfway between samples, 32 of them; rounded."""
    grid = signal.on_grid(F.col("v"), F.lit(0.0), F.lit(FS), 0.005, 0.325)
    return _traces(spark, d).select("vec_id", F.posexplode(grid).alias("k", "x")).select("vec_id", "k", F.round("x", 6).alias("x"))


def brune_fit(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    f = F.transform(F.sequence(F.lit(0), F.lit(199)), lambda i: 2.0 + i * 0.4)
    corner = (k % 30 + 8).cast("double")
    r = F.transform(f, lambda x: brune_ratio(x, F.lit(1.7), corner, F.lit(45.0)))
    fit = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", signal.corner_fit(f, r, 5.0, 60.0, 45.0).alias("fit"))
    return fit.select("p_partkey", F.round("fit.corner_hz", 3).alias("corner_hz"), F.round("fit.omega_ratio", 3).alias("omega_ratio"), "fit.points", "fit.status")


def hard_negative_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Peaks of vectors against the next vector of another label in the whole table, within 8 samples, summed up.

    Two carries over the order of ids find it: forward, whether a vector begins a run of its label; backward, the next such beginning.
    """
    t = _traces(spark, d).withColumn("back", -F.col("vec_id"))
    t = ordered.carry_forward(t, [], ["vec_id"], {"before": F.col("label")}, include_own=False)
    begins = F.when(F.col("before").isNull() | (F.col("before") != F.col("label")), F.col("v"))
    t = ordered.carry_forward(t, [], ["back"], {"w": begins}, include_own=False).filter("w is not null")
    c = t.select(signal.lagged_peak(F.col("v"), F.col("w"), FS, 0.08)["correlation"].alias("c")).filter("c is not null")
    c = written(c, "peaks")
    q = ordered.exact_quantiles(c, [], "c", {"median": 0.5, "p90": 0.9, "p95": 0.95}).withColumnRenamed("n", "channel_count")
    rest = c.agg(F.max("c").alias("maximum"), F.avg((F.col("c") >= 0.3).cast("double")).alias("fraction_above"))
    out = q.join(F.broadcast(rest), F.lit(True))
    return out.withColumns({x: F.round(x, 6) for x, kind in out.dtypes if kind == "double"})


def hard_negative_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every event of 96 vectors against the next: channel by channel, with the rank correlation of their SNR profiles."""
    s = _event_samples(spark, d)
    k = s.select(F.col("event_id").alias("first")).distinct()
    events = k.select("first", (F.col("first") + 1).alias("second")).join(k.toDF("second"), "second", "left_semi")
    out = detection.hard_negative_baseline(s, events.select("first", "second"), DETECT, (0.0, 1.2), 0.1, 0.3)
    return out.withColumns({x: F.round(x, 6) for x, kind in out.dtypes if kind == "double"})


def active_source_status(spark: SparkSession, d: str) -> DataFrame:
    """Events as shots, from their samples to the status."""
    return gates.active_source_status(gates.calibrated_shots(detection.detect_events(_event_samples(spark, d), DETECT), 0.99, 0.8), "0123456789abcdef", 2)


#: Every 96 vectors are an event: samples of 64 channels at 40 a second, noise before its origin and signal after it.
DETECT = detection.DetectionOptions(noise=(-1.2, 0.0), signal=(0.0, 1.2), block=8, min_z=1.5, min_fraction=0.5, rate_hz=40.0, min_ratio=1.0)


def _event_samples(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("vec_id")
    rows = _traces(spark, d).select(F.floor(k / 96).cast("long").alias("event_id"), (k % 96).cast("long").alias("at"), "v")
    return array.explode_channels(rows, "at", "v", ["event_id"]).withColumn("t", (F.col("sample") - 48) / 40.0)


def detection_summary(spark: SparkSession, d: str) -> DataFrame:
    """Every event's verdict or error; usable frequency ranges as their number, their first frequency and their width together."""
    out = detection.detect_events(_event_samples(spark, d), DETECT)
    ranges = F.col("usable_power_snr_ranges_hz")
    out = out.withColumns({"usable_ranges": F.size(ranges), "usable_first_hz": F.get(F.get(ranges, 0), 0), "usable_hz": F.aggregate(ranges, F.lit(0.0), lambda w, r: w + r[1] - r[0])})
    out = out.withColumn("usable_ranges", F.when(F.col("error").isNull(), F.col("usable_ranges"))).drop("usable_power_snr_ranges_hz", "signal_first", "signal_last")
    return out.withColumns({c: F.round(c, 6) for c, x in out.dtypes if x == "double"})


def detection_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Every block of channels of every event without an error."""
    samples = _event_samples(spark, d).withColumn("rate_hz", F.lit(DETECT.rate_hz))
    env = samples.groupBy("event_id", "sample", "t", "rate_hz").agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("value"))
    out = detection.event_blocks(detection.mark_windows(samples, detection.event_windows(env, DETECT), DETECT), DETECT)
    return out.withColumns({c: F.round(c, 6) for c, x in out.dtypes if x == "double"})


def event_spectra(spark: SparkSession, d: str) -> DataFrame:
    """Every event's median power in noise and signal, bin by bin."""
    samples = _event_samples(spark, d).withColumn("rate_hz", F.lit(DETECT.rate_hz))
    env = samples.groupBy("event_id", "sample", "t", "rate_hz").agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("value"))
    windows = detection.event_windows(env, DETECT)
    out = detection.event_spectra(detection.mark_windows(samples, windows, DETECT), windows, DETECT)
    return out.withColumns({c: F.round(c, 6) for c, x in out.dtypes if x == "double"})


#: Windows and bands that fit traces of 64 samples.
SHORT = compare.CompareOptions(noise=(-0.3, 0.0), signal=(0.0, 0.3), bands=((5.0, 20.0), (10.0, 40.0)), max_lag_s=0.05, pair=pairs.PairOptions(min_snr=0.5, min_components=1, min_stations=1))


def _windowed(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as traces of events of ten vectors each, five stations with two channels."""
    k = F.col("vec_id")
    t = _traces(spark, d).select(
        F.floor(k / 10).cast("string").alias("event_id"), F.lit("BP").alias("network"), (F.floor(k % 10 / 2)).cast("string").alias("station"), F.lit("").alias("location"), (k % 2).cast("string").alias("channel"),
        F.lit(FS).alias("sampling_rate"), F.lit(-0.32).alias("start_epoch_s"), F.size("v").alias("npts"), k.cast("int").alias("stream_order"), F.col("v").alias("samples"),
    )
    origins = t.select("event_id", F.lit(0.0).alias("origin_epoch_s")).distinct()
    return compare.windowed_traces(t, origins, SHORT)


def waveform_pair_metrics(spark: SparkSession, d: str) -> DataFrame:
    w = _windowed(spark, d)
    events = w.select("event_id").distinct().filter("event_id <> '0'")
    return compare.pair_metrics(w, events.select(F.col("event_id").alias("pair_name"), F.lit("0").alias("a"), F.col("event_id").alias("b")), FS, SHORT)


def single_anchor_scoring(spark: SparkSession, d: str) -> DataFrame:
    shortlist = _traces(spark, d).select(F.floor(F.col("vec_id") / 10).cast("string").alias("event_id")).distinct()
    return compare.score_shortlist(waveform_pair_metrics(spark, d), shortlist, "0", SHORT)


_DET = """WITH s AS (SELECT vec_id // 96 AS event_id, vec_id % 96 AS sample, (vec_id % 96 - 48) / 40.0::DOUBLE AS t, unnest(range(0, 64)) AS channel, unnest(embedding)::DOUBLE AS x FROM embeddings),
env AS (SELECT event_id, sample, t, sqrt(avg(x * x)) AS v FROM s GROUP BY ALL),
top AS (SELECT event_id, max(v) AS v FROM env WHERE t >= 0 GROUP BY 1),
win AS (
  SELECT event_id, count(*) FILTER (WHERE t < 0) AS noise_samples, count(*) FILTER (WHERE t >= 0) AS signal_samples, min(t) FILTER (WHERE t >= 0 AND env.v = top.v) AS peak_t, any_value(top.v) AS peak
  FROM env LEFT JOIN top USING (event_id) GROUP BY 1
), ev AS (SELECT *, CASE WHEN noise_samples < 40 THEN 'too little noise' WHEN peak_t IS NULL THEN 'empty signal window' WHEN signal_samples < 20 THEN 'too little signal' END AS error FROM win),
good AS (SELECT *, least(1024, noise_samples, signal_samples) AS n FROM ev WHERE error IS NULL),
g AS (SELECT s.* FROM s JOIN good USING (event_id)),
chan AS (SELECT event_id, channel, sqrt(avg(x * x) FILTER (WHERE t >= 0)) / (sqrt(avg(x * x) FILTER (WHERE t < 0)) + 1.1920929e-07::DOUBLE) AS snr FROM g GROUP BY 1, 2),
m1 AS (SELECT event_id, median(v) AS med, stddev_pop(v) AS sd FROM env JOIN good USING (event_id) WHERE t < 0 GROUP BY 1),
m2 AS (SELECT event_id, med, sd, 1.4826::DOUBLE * median(abs(v - med)) AS mad FROM env JOIN m1 USING (event_id) WHERE t < 0 GROUP BY 1, 2, 3),
z AS (SELECT event_id, (peak - med) / (CASE WHEN mad <= 2.220446049250313e-16::DOUBLE THEN sd ELSE mad END + 2.220446049250313e-16::DOUBLE) AS peak_robust_z FROM m2 JOIN good USING (event_id)),
be AS (SELECT event_id, channel // 8 AS block_id, sample, t, sqrt(avg(x * x)) AS v FROM g GROUP BY ALL),
b1 AS (SELECT event_id, block_id, median(v) AS med, stddev_pop(v) AS sd FROM be WHERE t < 0 GROUP BY 1, 2),
b2 AS (SELECT event_id, block_id, med, sd, 1.4826::DOUBLE * median(abs(v - med)) AS mad FROM be JOIN b1 USING (event_id, block_id) WHERE t < 0 GROUP BY ALL),
bp AS (SELECT event_id, block_id, max(v) AS v FROM be WHERE t >= 0 GROUP BY 1, 2),
bz AS (SELECT event_id, block_id, (v - med) / (CASE WHEN mad <= 2.220446049250313e-16::DOUBLE THEN sd ELSE mad END + 2.220446049250313e-16::DOUBLE) AS z FROM bp JOIN b2 USING (event_id, block_id)),
blocks AS (SELECT c.event_id, channel // 8 AS block_id, min(channel)::INT AS column_start, max(channel)::INT AS column_end, count(*) AS sampled_channel_count, median(snr) AS median_channel_snr, any_value(z) AS peak_robust_z, any_value(z) >= 1.5 AS detected
  FROM chan c JOIN bz ON bz.event_id = c.event_id AND bz.block_id = channel // 8 GROUP BY 1, 2),
ser AS (SELECT event_id, channel, t >= 0 AS sig, n, list(x ORDER BY sample) AS v FROM g JOIN good USING (event_id) GROUP BY 1, 2, 3, 4),
seg AS (SELECT event_id, channel, sig, n, v[p + 1:p + n] AS y FROM (SELECT *, unnest(range(0, len(v) - n + 1, n - n // 2)) AS p FROM ser)),
tap AS (SELECT event_id, channel, sig, n, list_transform(y, lambda a, i: (a - list_avg(y)) * (0.5 - 0.5 * cos(2 * pi() * (i - 1) / n))) AS y FROM seg),
fre AS (SELECT *, unnest(range(0, n // 2 + 1)) AS bin FROM tap),
pow AS (SELECT event_id, channel, sig, n, bin, avg((list_sum(list_transform(y, lambda a, i: a * cos(2 * pi() * bin * (i - 1) / n))) ** 2 + list_sum(list_transform(y, lambda a, i: a * sin(2 * pi() * bin * (i - 1) / n))) ** 2)
  / (40 * 0.375 * n) * CASE WHEN bin = 0 OR 2 * bin = n THEN 1 ELSE 2 END) AS p FROM fre GROUP BY 1, 2, 3, 4, 5),
spec AS (SELECT event_id, bin, any_value(bin * (40.0::DOUBLE / n)) AS frequency_hz, median(p) FILTER (WHERE sig) AS signal_power, median(p) FILTER (WHERE NOT sig) AS noise_power FROM pow GROUP BY 1, 2),
rat AS (SELECT *, signal_power / (noise_power + 1.1920929e-07::DOUBLE) AS power_ratio FROM spec),
isl AS (SELECT *, bin - row_number() OVER (PARTITION BY event_id ORDER BY bin) AS k FROM rat WHERE power_ratio >= 1.0),
ran AS (SELECT event_id, min(frequency_hz) AS a, max(frequency_hz) AS z FROM isl GROUP BY event_id, k HAVING count(*) >= 2),
use AS (SELECT event_id, count(*) AS usable_ranges, min(a) AS usable_first_hz, sum(z - a) AS usable_hz FROM ran GROUP BY 1),
adj AS (SELECT a.event_id, a.channel, CASE WHEN sqrt(var_pop(a.x) * var_pop(b.x)) * count(*) > 2.220446049250313e-16::DOUBLE THEN covar_pop(a.x, b.x) / sqrt(var_pop(a.x) * var_pop(b.x)) END AS c
  FROM g a JOIN g b ON a.event_id = b.event_id AND a.sample = b.sample AND b.channel = a.channel + 1 WHERE a.t >= 0 GROUP BY 1, 2)
"""

QUERIES = {f.__name__: f for f in (bandpass, welch_psd, multitaper, resample, display_traces, interpolate, brune_fit, hard_negative_baseline, hard_negative_pairs, active_source_status, detection_summary, detection_blocks, event_spectra, waveform_pair_metrics, single_anchor_scoring)}
SQL = {
    "hard_negative_pairs": _DET + """, tr AS (SELECT event_id, channel, list(x ORDER BY sample) AS v FROM s WHERE t >= 0 GROUP BY 1, 2),
pr AS (SELECT DISTINCT a.event_id AS first, a.event_id + 1 AS second FROM s a WHERE a.event_id + 1 IN (SELECT event_id FROM s)),
ct AS (SELECT first, second, a.channel, len(a.v) AS na, len(b.v) AS nb, list_transform(a.v[:least(len(a.v), len(b.v))], lambda q: q - list_avg(a.v[:least(len(a.v), len(b.v))])) AS x,
  list_transform(b.v[:least(len(a.v), len(b.v))], lambda q: q - list_avg(b.v[:least(len(a.v), len(b.v))])) AS y FROM pr JOIN tr a ON a.event_id = first JOIN tr b ON b.event_id = second AND b.channel = a.channel),
pk AS (SELECT first, second, channel, max(list_dot_product(x[1 + greatest(k, 0):len(x) + least(k, 0)], y[1 + greatest(-k, 0):len(x) - greatest(k, 0)]) / sqrt(list_dot_product(x, x) * list_dot_product(y, y))) AS c
  FROM ct, (SELECT unnest(range(-4, 5)) AS k) WHERE abs(k) < len(x) GROUP BY 1, 2, 3),
al AS (SELECT first, second, count(c) AS channel_count, median(c) AS median, quantile_cont(c, 0.9) AS p90, quantile_cont(c, 0.95) AS p95, max(c) AS maximum, avg((c >= 0.3::DOUBLE)::INT::DOUBLE) AS fraction_above FROM pk GROUP BY 1, 2),
lg AS (SELECT event_id, channel, log10(greatest(snr, 1e-6::DOUBLE)) AS s FROM chan),
rk AS (SELECT first, second, rank() OVER (PARTITION BY first ORDER BY a.s) + (count(*) OVER (PARTITION BY first, a.s) - 1) / 2 AS ra, rank() OVER (PARTITION BY first ORDER BY b.s) + (count(*) OVER (PARTITION BY first, b.s) - 1) / 2 AS rb
  FROM pr JOIN lg a ON a.event_id = first JOIN lg b ON b.event_id = second AND b.channel = a.channel),
fp AS (SELECT first, second, corr(ra, rb) AS f FROM rk GROUP BY 1, 2)
SELECT first, second, coalesce(channel_count, 0) AS channel_count, round(median, 6) AS median, round(p90, 6) AS p90, round(p95, 6) AS p95, round(maximum, 6) AS maximum, round(fraction_above, 6) AS fraction_above, round(f, 6) AS fingerprint_spearman
FROM pr LEFT JOIN al USING (first, second) LEFT JOIN fp USING (first, second)""",
    "active_source_status": _DET + f""", cs AS (SELECT event_id, median(snr) AS m FROM chan GROUP BY 1), bs AS (SELECT event_id, avg(detected::DOUBLE) AS f FROM blocks GROUP BY 1),
sh AS (SELECT coalesce(peak_robust_z >= 1.5 AND f >= 0.5, false) AS found, m, peak_t, coalesce(usable_ranges, 0) AS n FROM ev LEFT JOIN z USING (event_id) LEFT JOIN cs USING (event_id) LEFT JOIN bs USING (event_id) LEFT JOIN use USING (event_id)),
ct AS (SELECT count(*) FILTER (WHERE found) AS shots_time_domain_detected, count(*) FILTER (WHERE found AND m >= 0.99 AND peak_t >= 0 AND peak_t <= 0.8 AND n > 0) AS shots_calibration_usable, count(*) AS shots_total FROM sh)
SELECT ct.*, CASE WHEN shots_calibration_usable >= 2 THEN 'PASS' ELSE 'STOP' END AS shot_detectability, CASE WHEN shots_calibration_usable >= 2 THEN 'PASS' ELSE 'CONDITIONAL' END AS channel_response, 'CONDITIONAL' AS absolute_timing,
  '{gates.TIMING_REASON}' AS absolute_timing_reason, 'STOP' AS absolute_geometry, '{gates.GEOMETRY_REASON}' AS absolute_geometry_reason, '0123456789abcdef' AS config_sha256 FROM ct""",
    "welch_psd": """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
g AS (SELECT vec_id, label, v[p + 1:p + 32] AS y FROM e, (SELECT unnest([0, 16, 32]) AS p)),
t AS (SELECT vec_id, label, list_transform(y, lambda a, i: (a - list_avg(y)) * (0.5 - 0.5 * cos(2 * pi() * (i - 1) / 32))) AS y FROM g),
q AS (SELECT vec_id, label, bin, avg((list_sum(list_transform(y, lambda a, i: a * cos(2 * pi() * bin * (i - 1) / 32))) ** 2 + list_sum(list_transform(y, lambda a, i: a * sin(2 * pi() * bin * (i - 1) / 32))) ** 2) / (100 * 12)
  * CASE WHEN bin IN (0, 16) THEN 1 ELSE 2 END) AS p FROM t, (SELECT unnest(range(0, 17)) AS bin) GROUP BY 1, 2, 3)
SELECT label, bin::INT AS bin, any_value(bin * 100.0 / 32)::DOUBLE AS frequency_hz, round(median(p), 9) AS power FROM q GROUP BY 1, 2""",
    "display_traces": """WITH s AS (SELECT vec_id // 96 AS event_id, vec_id % 96 AS sample, unnest(range(0, 64)) AS channel, unnest(embedding)::DOUBLE AS x FROM embeddings),
tap AS (SELECT i, CASE WHEN i = 0 THEN 0.5 ELSE sin(pi() * i / 2) / (pi() * i) END * list_sum(list_transform(range(0, 60), lambda k: pow(2.5 * sqrt(1 - (i / 20.0) ** 2), 2 * k) / exp(2 * lgamma(k + 1)))) AS w FROM (SELECT unnest(range(-20, 21)) AS i)),
nrm AS (SELECT i, w / sum(w) OVER () AS w FROM tap),
sz AS (SELECT event_id, count(DISTINCT sample) AS n FROM s GROUP BY 1)
SELECT o.event_id, o.channel::INT AS channel, 20.0::DOUBLE AS display_rate_hz, -1.2::DOUBLE AS first_t, (n - 49) / 40.0::DOUBLE AS last_t, o.k::INT AS k, round(sum(w * s.x), 6) + 0.0::DOUBLE AS x
FROM (SELECT event_id, n, unnest(range(0, (n + 1) // 2)) AS k FROM sz) z JOIN LATERAL (SELECT z.event_id, z.k, unnest(range(0, 64)) AS channel) o ON true, nrm, s
WHERE s.event_id = o.event_id AND s.channel = o.channel AND s.sample = 2 * o.k + i GROUP BY o.event_id, o.channel, o.k, n""",
    "detection_summary": _DET + """, cs AS (SELECT event_id, median(snr) AS m, quantile_cont(snr, 0.1) AS p10, count(*) AS n, min(channel)::INT AS c0, max(channel)::INT AS c1 FROM chan GROUP BY 1),
bs AS (SELECT event_id, count(*) AS n, avg(detected::DOUBLE) AS f FROM blocks GROUP BY 1),
as_ AS (SELECT event_id, median(c) AS m, median(abs(c)) AS a FROM adj GROUP BY 1)
SELECT ev.event_id, ev.error, ev.noise_samples, ev.signal_samples, round(ev.peak_t, 6) AS peak_t, round(peak_robust_z, 6) AS peak_robust_z, round(cs.m, 6) AS median_channel_snr, round(cs.p10, 6) AS p10_channel_snr,
  cs.n AS sampled_channel_count, cs.c0 AS column_start, cs.c1 AS column_end, bs.n AS block_count, round(bs.f, 6) AS detected_block_fraction, round(as_.m, 6) AS median_adjacent_correlation, round(as_.a, 6) AS median_absolute_adjacent_correlation,
  CASE WHEN ev.error IS NULL THEN peak_robust_z >= 1.5 AND bs.f >= 0.5 END AS detected, CASE WHEN ev.error IS NOT NULL THEN 'ERROR' WHEN peak_robust_z >= 1.5 AND bs.f >= 0.5 THEN 'PASS' ELSE 'STOP' END AS status,
  CASE WHEN ev.error IS NULL THEN coalesce(usable_ranges, 0) END::INT AS usable_ranges, round(usable_first_hz, 6) AS usable_first_hz, CASE WHEN ev.error IS NULL THEN round(coalesce(usable_hz, 0), 6) END AS usable_hz
FROM ev LEFT JOIN z USING (event_id) LEFT JOIN cs USING (event_id) LEFT JOIN bs USING (event_id) LEFT JOIN as_ USING (event_id) LEFT JOIN use USING (event_id)""",
    "detection_blocks": _DET + "SELECT event_id, block_id, column_start, column_end, sampled_channel_count, round(median_channel_snr, 6) AS median_channel_snr, round(peak_robust_z, 6) AS peak_robust_z, detected FROM blocks",
    "event_spectra": _DET + "SELECT event_id, bin::INT AS bin, round(frequency_hz, 6) AS frequency_hz, round(signal_power, 6) AS signal_power, round(noise_power, 6) AS noise_power, round(power_ratio, 6) AS power_ratio FROM rat",
    "interpolate": "SELECT vec_id, k::INT AS k, round((embedding[k + 1]::DOUBLE + embedding[k + 2]::DOUBLE) / 2, 6) + 0.0::DOUBLE AS x FROM embeddings, (SELECT unnest(range(0, 32)) AS k)",
    "brune_fit": "SELECT p_partkey, round((p_partkey % 30 + 8)::DOUBLE, 3) AS corner_hz, 1.7::DOUBLE AS omega_ratio, 138 AS points, 'PASS' AS status FROM part",
    "hard_negative_baseline": """WITH z AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x - list_avg(embedding::DOUBLE[])) AS z FROM embeddings),
r AS (SELECT vec_id, label IS DISTINCT FROM lag(label) OVER (ORDER BY vec_id) AS begins FROM embeddings),
n AS (SELECT vec_id, min(CASE WHEN begins THEN vec_id END) OVER (ORDER BY vec_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS other FROM r),
p AS (SELECT x.z AS a, y.z AS b, x.vec_id FROM n JOIN z x ON x.vec_id = n.vec_id JOIN z y ON y.vec_id = other),
c AS (SELECT vec_id, max(list_dot_product(a[1 + greatest(k, 0):64 + least(k, 0)], b[1 + greatest(-k, 0):64 - greatest(k, 0)]) / sqrt(list_dot_product(a, a) * list_dot_product(b, b))) AS c
  FROM p, (SELECT unnest(range(-8, 9)) AS k) WHERE b IS NOT NULL GROUP BY 1)
SELECT count(*) AS channel_count, round(median(c), 6) AS median, round(quantile_cont(c, 0.9), 6) AS p90, round(quantile_cont(c, 0.95), 6) AS p95, round(max(c), 6) AS maximum, round(avg((c >= 0.3::DOUBLE)::INT), 6) AS fraction_above FROM c""",
}
