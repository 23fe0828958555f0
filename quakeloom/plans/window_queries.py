"""Window reading: every eight vectors are a file of eight channels, with names, rates, loci and units that now and then change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.operators import intervals
from quakeloom.sources import headers, windows


def _recordings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Windows, files and traces: a second's file each second, some begun early, one in eleven without a time in its name."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    f = F.floor(F.col("vec_id") / 8).cast("long")
    path = F.concat(F.lit("f"), f.cast("string"))
    traces = e.select(path.alias("path"), (F.col("vec_id") % 8).cast("int").alias("column_index"), F.col("embedding").cast("array<float>").alias("samples"))
    k = F.col("f")
    files = e.groupBy(f.alias("f")).agg(F.count("*").cast("int").alias("channel_count"))
    files = files.select(
        "f", F.concat(F.lit("f"), k.cast("string")).alias("path"), F.when(k % 11 != 10, k.cast("double")).alias("stamp_s"), F.when(k % 13 == 7, 32.0).otherwise(64.0).alias("sample_rate_hz"),
        (1800 + (k % 17 == 9).cast("int")).cast("long").alias("start_locus_index"), F.when(k % 19 == 4, "rad * 2PI/2^16").otherwise("counts").alias("raw_data_unit"), "channel_count",
        F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: k * 1000000 - (k % 3) * 125000 + i * 15625).alias("times_us"),
    )
    w = files.select(F.floor(k / 4).cast("long").alias("event_id")).distinct()
    w = w.select("event_id", (4 * F.col("event_id") + 0.25).cast("double").alias("start_s"), (4 * F.col("event_id") + 2.75).cast("double").alias("end_s"))
    return w, files.drop("f"), traces


def window_reading(spark: SparkSession, d: str) -> DataFrame:
    heads, _ = windows.read_windows(*_recordings(spark, d), first=1, stride=2)
    out = heads.withColumns({"files": F.array_join("source_files", ";"), "first_s": F.get("epoch_s", 0), "last_s": F.element_at("epoch_s", -1)}).drop("source_files", "epoch_s")
    return out.withColumns({c: F.round(c, 6) for c, t in out.dtypes if t == "double"})


def window_channels(spark: SparkSession, d: str) -> DataFrame:
    _, channels = windows.read_windows(*_recordings(spark, d), first=1, stride=2)
    v = F.transform("values", lambda x: x.cast("double"))
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    return channels.select("event_id", "column_index", "locus_index", F.size("values").alias("samples"), F.round(total, 4).alias("total"), F.round(F.get(v, 0), 6).alias("first"), F.round(F.element_at(v, -1), 6).alias("last"))


def mixed_span_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Short event windows over files of an hour, a day and the whole time at once."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    w = e.select(F.col("event_id").cast("string").alias("event_id"), (F.col("t") - 4).alias("start_s"), (F.col("t") + 12).alias("end_s"))
    piece = lambda n, name: e.select((F.floor(F.col("t") / n) * n).cast("double").alias("a")).distinct().select(F.concat(F.lit(name), F.col("a").cast("long").cast("string")).alias("path"), F.col("a").alias("start_s"), (F.col("a") + n).alias("end_s"))
    hours, days = piece(3600, "h").filter("cast(start_s / 3600 as long) % 7 <> 0"), piece(86400, "d").filter("cast(start_s / 86400 as long) % 3 = 0")
    whole = e.agg(F.floor(F.min("t")).cast("double").alias("start_s"), F.floor(F.max("t")).cast("double").alias("end_s")).select(F.lit("whole").alias("path"), "start_s", "end_s")
    return intervals.interval_overlap(w, hours.unionByName(days).unionByName(whole))


def header_derivation(spark: SparkSession, d: str) -> DataFrame:
    """An order is a file with a sample for each of its lines; by its key it is sound, turned, square, of other axes, short or late."""
    k = F.col("k")
    n = F.col("n")
    has = lambda cond, x: F.when(cond, x)
    rows = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"))
    shape = (
        F.when(k % 7 == 1, F.array(F.lit(9), n)).when(k % 7 == 2, F.array(n, n)).when(k % 7 == 3, F.array(n)).when(k % 7 == 4, F.array(n + 1, F.lit(99))).otherwise(F.array(n, F.lit(12)))
    )
    rate = F.when(k % 11 == 0, "0").when(k % 11 == 1, None).otherwise("100.0")
    times = F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: k * 1000000 + i * 10000 + F.when((k % 5 == 0) & (i == n - 1), 3).otherwise(0))
    counters = F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: i + F.when((k % 3 == 0) & (i == n - 1), 2).otherwise(0))
    raw = rows.select(
        F.concat(F.lit("f"), k.cast("string")).alias("path"), (n * 100).alias("size_bytes"), F.create_map(F.lit("uuid"), k.cast("string")).alias("root"),
        has(k % 17 != 3, F.create_map(F.lit(headers.LOCUS), F.lit("40"), F.lit(headers.GAUGE), F.lit("10"))).alias("acquisition"),
        F.map_filter(F.create_map(F.lit(headers.RATE), rate, F.lit(headers.LOCUS), has(k % 2 == 0, "1800")), lambda _, v: v.isNotNull()).alias("raw"), F.lit(None).cast("map<string,string>").alias("custom"),
        shape.cast("array<long>").alias("data_shape"), F.when(k % 13 == 0, F.array().cast("array<long>")).otherwise(times.cast("array<long>")).alias("times_us"), has(k % 4 != 1, counters.cast("array<long>")).alias("counters"),
        has(k % 19 == 5, "truncated").alias("read_error"),
    )
    out = headers.derive_headers(raw)
    out = out.select("path", "status", "error", "size_bytes", F.unix_micros("start_utc").alias("start_us"), F.unix_micros("end_utc").alias("end_us"), "sample_rate_hz", "sample_count", "channel_count", "time_axis", "start_locus_index", "gauge_length_m", "timestamp_span_residual_s", "sample_counter_residual", "root_uuid")
    return out.withColumn("timestamp_span_residual_s", F.round("timestamp_span_residual_s", 6) + 0.0)


QUERIES = {f.__name__: f for f in (header_derivation, window_reading, window_channels, mixed_span_overlap)}

_WIN = """WITH files AS (
  SELECT f, 'f' || f AS path, CASE WHEN f % 11 <> 10 THEN f::DOUBLE END AS stamp, CASE WHEN f % 13 = 7 THEN 32.0 ELSE 64.0 END::DOUBLE AS rate, 1800 + (f % 17 = 9)::INT AS locus,
         CASE WHEN f % 19 = 4 THEN 'processed_optical_phase_rad' ELSE 'counts' END AS unit, CASE WHEN f % 19 = 4 THEN 2 * pi() / 65536 ELSE 1 END::FLOAT AS scale, nc
  FROM (SELECT vec_id // 8 AS f, count(*) AS nc FROM embeddings GROUP BY 1)
), w AS (SELECT DISTINCT f // 4 AS event_id, f // 4 * 4 + 0.25::DOUBLE AS a, f // 4 * 4 + 2.75::DOUBLE AS z FROM files),
s AS (SELECT files.*, i, f * 1000000 - (f % 3) * 125000 + i * 15625 AS us FROM files, (SELECT unnest(range(0, 64)) AS i)),
n AS (SELECT DISTINCT event_id FROM w JOIN files ON stamp < z + 2 AND stamp + 62 > a),
u AS (SELECT event_id, a, z, s.* FROM w JOIN s ON us * 1e-6 >= a AND us * 1e-6 < z AND stamp < z + 2 AND stamp + 62 > a),
uf AS (SELECT DISTINCT event_id, f, path, stamp, rate, locus, unit, greatest((nc - 2) // 2 + 1, 0) AS c, nc FROM u),
ue AS (
  SELECT *, CASE WHEN nc < 2 THEN 'invalid channel slice 1:' || nc || ' for ' || nc || ' channels' WHEN rate <> first_value(rate) OVER o THEN 'sample rate changes inside the window'
    WHEN c <> first_value(c) OVER o THEN 'channel columns change inside the window' WHEN locus <> first_value(locus) OVER o THEN 'locus indices change inside the window'
    WHEN unit <> first_value(unit) OVER o THEN 'raw unit changes inside the window' END || ': ' || path AS error
  FROM uf WINDOW o AS (PARTITION BY event_id ORDER BY stamp, path)
), ev AS (
  SELECT event_id, any_value(error ORDER BY stamp, path) AS broken, string_agg(path, ';' ORDER BY stamp, path) AS files, first(rate ORDER BY stamp, path) AS rate, first(unit ORDER BY stamp, path) AS unit,
         first(c ORDER BY stamp, path) AS c FROM ue GROUP BY 1
), st AS (
  SELECT w.event_id, CASE WHEN n.event_id IS NULL THEN 'no file name intersects the window' WHEN ev.event_id IS NULL THEN 'candidate files do not contain the window' ELSE broken END AS error, files, rate, unit, c
  FROM w LEFT JOIN n ON n.event_id = w.event_id LEFT JOIN ev ON ev.event_id = w.event_id
), k AS (SELECT u.*, us * 1e-6 AS t FROM u JOIN st USING (event_id) WHERE error IS NULL QUALIFY row_number() OVER (PARTITION BY event_id, us ORDER BY stamp, path) = 1),
g AS (SELECT event_id, a, z, t, t - lag(t) OVER (PARTITION BY event_id ORDER BY t) AS gap FROM k)
"""

SQL = {
    "header_derivation": """WITH o AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1),
s AS (
  SELECT *, CASE k % 7 WHEN 1 THEN [9, n] WHEN 2 THEN [n, n] WHEN 3 THEN [n] WHEN 4 THEN [n + 1, 99] ELSE [n, 12] END AS shape, CASE WHEN k % 13 = 0 THEN 0 ELSE n END AS m,
         CASE k % 11 WHEN 0 THEN '0' WHEN 1 THEN NULL ELSE '100.0' END AS rate FROM o
), e AS (
  SELECT *, CASE WHEN k % 19 = 5 THEN 'truncated' WHEN k % 17 = 3 THEN 'a group is missing' WHEN m = 0 THEN 'there are no sample times' WHEN rate IS NULL THEN 'invalid sample rate none'
    WHEN rate = '0' THEN 'invalid sample rate 0' WHEN len(shape) <> 2 THEN 'data must have two axes, not [' || shape[1] || ']'
    WHEN (shape[1] = m) = (shape[2] = m) THEN 'cannot tell the time axis: data [' || shape[1] || ', ' || shape[2] || '], times ' || m END AS error FROM s
)
SELECT 'f' || k AS path, CASE WHEN error IS NULL THEN 'ok' ELSE 'error' END AS status, coalesce(error, '') AS error, n * 100 AS size_bytes, CASE WHEN error IS NULL THEN k * 1000000 + CASE WHEN n = 1 AND k % 5 = 0 THEN 3 ELSE 0 END END AS start_us,
  CASE WHEN error IS NULL THEN k * 1000000 + n * 10000 + CASE WHEN n = 1 AND k % 5 = 0 THEN 3 ELSE 0 END END AS end_us, CASE WHEN error IS NULL THEN 100.0 END::DOUBLE AS sample_rate_hz, CASE WHEN error IS NULL THEN n END::INT AS sample_count,
  CASE WHEN error IS NULL THEN CASE WHEN shape[1] = m THEN shape[2] ELSE shape[1] END END::INT AS channel_count, CASE WHEN error IS NULL THEN CASE WHEN shape[1] = m THEN 0 ELSE 1 END END::INT AS time_axis,
  CASE WHEN error IS NULL THEN CASE WHEN k % 2 = 0 THEN 1800 ELSE 40 END END::INT AS start_locus_index, CASE WHEN error IS NULL THEN 10.0 END::DOUBLE AS gauge_length_m,
  CASE WHEN error IS NULL THEN round(CASE WHEN k % 5 = 0 AND n > 1 THEN 3e-6 ELSE 0 END, 6) END::DOUBLE AS timestamp_span_residual_s,
  CASE WHEN error IS NULL AND k % 4 <> 1 THEN CASE WHEN k % 3 = 0 AND n > 1 THEN 2 ELSE 0 END END::BIGINT AS sample_counter_residual, CASE WHEN error IS NULL THEN k::VARCHAR END AS root_uuid
FROM e""",
    "window_reading": _WIN + """, h AS (SELECT event_id, count(*) AS samples, min(t) AS first_s, max(t) AS last_s, coalesce(max(gap), 'infinity'::DOUBLE) AS gap, any_value(z - a) AS span FROM g GROUP BY 1)
SELECT event_id, error, CASE WHEN error IS NULL THEN files END AS files, CASE WHEN error IS NULL THEN rate END AS sample_rate_hz, CASE WHEN error IS NULL THEN unit END AS unit, CASE WHEN error IS NULL THEN c END::INT AS channels,
  samples::INT AS samples, round(first_s, 6) AS first_s, round(last_s, 6) AS last_s, round(gap, 6) AS max_gap_s, CASE WHEN error IS NULL THEN round(greatest(0.0::DOUBLE, 1 - samples / greatest(1, round_even(span * rate, 0))), 6) END AS missing_fraction
FROM st LEFT JOIN h USING (event_id)""",
    "window_channels": _WIN + """, x AS (
  SELECT k.event_id, vec_id % 8 AS column_index, vec_id % 8 + locus AS locus_index, t, (embedding[i + 1]::FLOAT * scale)::FLOAT::DOUBLE AS v FROM k JOIN embeddings ON vec_id // 8 = f WHERE vec_id % 8 % 2 = 1
)
SELECT event_id, column_index::INT AS column_index, min(locus_index) AS locus_index, count(*)::INT AS samples, round(sum(v), 4) AS total, round(first(v ORDER BY t), 6) AS first, round(last(v ORDER BY t), 6) AS last FROM x GROUP BY 1, 2""",
    "mixed_span_overlap": """WITH e AS (SELECT event_id, epoch_us(ts) / 1e6 AS t FROM events),
f AS (
  SELECT 'h' || (a * 3600)::BIGINT AS path, a * 3600 AS fs, a * 3600 + 3600 AS fe FROM (SELECT DISTINCT floor(t / 3600) AS a FROM e) WHERE a::BIGINT % 7 <> 0
  UNION ALL SELECT 'd' || (a * 86400)::BIGINT, a * 86400, a * 86400 + 86400 FROM (SELECT DISTINCT floor(t / 86400) AS a FROM e) WHERE a::BIGINT % 3 = 0
  UNION ALL SELECT 'whole', floor(min(t)), floor(max(t)) FROM e
), h AS (SELECT event_id, t - 4 AS a, t + 12 AS z, path, fs, fe FROM e JOIN f ON fs < t + 12 AND fe > t - 4),
p AS (SELECT event_id, greatest(fs, a) AS s, least(fe, z) AS x FROM h),
q AS (SELECT event_id, s, coalesce(max(x) OVER (PARTITION BY event_id ORDER BY s, x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), NULL) AS before, x FROM p),
o AS (SELECT event_id, max(CASE WHEN s > before THEN 1 ELSE 0 END) AS hole FROM q GROUP BY 1),
c AS (SELECT event_id, count(*) AS n, min(fs) <= any_value(a) AND max(fe) >= any_value(z) AS whole, string_agg(path, ';' ORDER BY path) AS files FROM h GROUP BY 1)
SELECT e.event_id::VARCHAR AS event_id, coalesce(n, 0) AS file_count, coalesce(whole, false) AS complete, coalesce(whole, false) AND coalesce(hole, 0) = 1 AS has_gap,
  CASE WHEN whole THEN 'PASS' WHEN n > 0 THEN 'CONDITIONAL' ELSE 'STOP' END AS coverage_status, coalesce(files, '') AS source_files
FROM e LEFT JOIN c ON c.event_id = e.event_id LEFT JOIN o ON o.event_id = e.event_id""",
}
