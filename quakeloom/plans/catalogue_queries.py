"""Nomination, crosswalk and interval queries, with events and documents as catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.operators import catalogue, crosswalk, gates, intervals

NEIGHBOURS = ["lang_de", "lang_fr"]


def _catalogue(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(
        "event_id", F.col("ts").alias("origin_time"), (36.0 + (F.col("event_id") % 97) * 1e-5).alias("latitude"), (-120.5 + (F.col("user_id") % 89) * 1e-5).alias("longitude"),
        (4.5 + (F.col("event_id") % 31) * 0.01).alias("depth_km"), (1.0 + (F.col("event_id") % 13) * 0.1).alias("magnitude"),
    )


def nominate_candidates(spark: SparkSession, d: str) -> DataFrame:
    events = _catalogue(spark, d)
    first = events.agg(F.min("event_id").alias("event_id"))
    seed = events.join(F.broadcast(first), "event_id", "left_semi")
    out = catalogue.nominate_candidates(events, seed, catalogue.NominationOptions(digits=6))
    return out.withColumns({c: F.round(c, 6) for c, t in out.dtypes if t == "double"}).withColumn("event_id", F.col("event_id").cast("string"))


def _shortlist(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = spark.read.parquet(f"{d}/documents.parquet").select(
        F.col("doc_id").alias("event_id"), F.when(F.col("n_chars") % 5 == 0, "family").when(F.col("n_chars") % 5 == 1, "insufficient_data").when(F.col("n_chars") % 5 == 2, "seed").otherwise("not_family").alias("decision")
    )
    labels = spark.read.parquet(f"{d}/labels.parquet").select(
        F.col("doc_id").alias("event_id"), F.when(F.col("toxic") == 1, "lang_de").when(F.col("quality") == 1, "target").when(F.col("doc_id") % 7 == 0, "").otherwise("other").alias("sequence_id"), "quality"
    )
    return docs, labels


def exact_id_crosswalk(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = _shortlist(spark, d)
    return crosswalk.exact_id_crosswalk(docs, labels, "target", NEIGHBOURS)


def validation_population(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = _shortlist(spark, d)
    walk = crosswalk.exact_id_crosswalk(docs, labels, "target", NEIGHBOURS)
    return crosswalk.validation_population(labels, walk, "target", NEIGHBOURS)


def repair_confusion(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = _shortlist(spark, d)
    return crosswalk.repair_confusion(crosswalk.exact_id_crosswalk(docs, labels, "target", NEIGHBOURS))


def epoch_role(spark: SparkSession, d: str) -> DataFrame:
    cutoff = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    role = F.when(F.col("origin_time") > cutoff, "prospective_post_catalog").otherwise("published_catalog_era")
    return _catalogue(spark, d).groupBy(role.alias("epoch_role")).agg(F.count("*").alias("n"), F.max("origin_time").alias("last_origin"))


def interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "ts")
    epoch = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    windows = e.select(F.col("event_id").cast("string").alias("event_id"), (epoch - 4).alias("start_s"), (epoch + 12).alias("end_s"))
    hour = (F.floor(epoch / 3600) * 3600).cast("double")
    files = e.select(hour.alias("h")).distinct().filter(F.floor(F.col("h") / 3600) % 7 != 0)
    files = files.select(F.concat(F.lit("seg_"), F.col("h").cast("long").cast("string")).alias("path"), F.col("h").alias("start_s"), (F.col("h") + 3600).alias("end_s"))
    return intervals.interval_overlap(windows, files)


def coverage_verdict(spark: SparkSession, d: str) -> DataFrame:
    return interval_overlap(spark, d).groupBy("coverage_status").agg(F.count("*").alias("n"), F.sum("file_count").alias("files"))


def population_gate(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = _shortlist(spark, d)
    walk = crosswalk.exact_id_crosswalk(docs, labels, "target", NEIGHBOURS)
    return gates.population_gate(crosswalk.validation_population(labels, walk, "target", NEIGHBOURS), 3, 1)


def catalogue_timeline(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    rows = o.select(F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 4 != 0, (F.col("o_orderkey") % 9).cast("double")).alias("size"))
    return gates.timeline(rows, "status", "size")


_CAT = """
WITH e AS (SELECT event_id, ts AS origin_time, 36.0::DOUBLE + (event_id % 97) * 1e-5 AS latitude, -120.5::DOUBLE + (user_id % 89) * 1e-5 AS longitude,
  4.5::DOUBLE + (event_id % 31) * 0.01::DOUBLE AS depth_km, 1.0::DOUBLE + (event_id % 13) * 0.1::DOUBLE AS magnitude FROM events)
"""
_WALK = """
WITH s AS (SELECT doc_id::VARCHAR AS event_id, doc_id, CASE n_chars % 5 WHEN 0 THEN 'family' WHEN 1 THEN 'insufficient_data' WHEN 2 THEN 'seed' ELSE 'not_family' END AS decision FROM documents),
l AS (SELECT doc_id::VARCHAR AS event_id, CASE WHEN toxic = 1 THEN 'lang_de' WHEN quality = 1 THEN 'target' WHEN doc_id % 7 = 0 THEN '' ELSE 'other' END AS sequence_id, quality FROM labels),
j AS (SELECT s.event_id, s.doc_id, decision, l.sequence_id AS external_sequence_id, l.quality AS external_quality, CASE WHEN l.event_id IS NOT NULL THEN 'exact_event_id' ELSE 'none' END AS external_match_type,
  CASE WHEN sequence_id = 'target' THEN 'published_target_positive' WHEN sequence_id IN ('lang_de', 'lang_fr') THEN 'published_neighbor_family_negative'
  WHEN coalesce(sequence_id, '') <> '' THEN 'published_other_family' ELSE 'no_published_label' END AS external_role FROM s LEFT JOIN l USING (event_id)),
w AS (SELECT *, CASE WHEN external_role = 'published_target_positive' THEN CASE WHEN decision = 'family' THEN 'agreement_target_positive' WHEN decision IN ('insufficient_data', 'seed') THEN 'published_positive_single_anchor_abstain' ELSE 'discordant_target_false_negative' END
  WHEN external_role = 'published_neighbor_family_negative' THEN CASE WHEN decision = 'family' THEN 'discordant_single_anchor_overmerge' WHEN decision IN ('insufficient_data', 'seed') THEN 'published_negative_single_anchor_abstain' ELSE 'agreement_neighbor_negative' END
  ELSE 'unlabeled_not_scored' END AS diagnostic_outcome FROM j)
"""
_INT = """
WITH e AS (SELECT event_id::VARCHAR AS event_id, epoch_us(ts) / 1e6 AS t FROM events),
f AS (SELECT DISTINCT (floor(t / 3600) * 3600)::DOUBLE AS a FROM e WHERE floor(t / 3600)::BIGINT % 7 <> 0),
j AS (SELECT event_id, t - 4 AS ws, t + 12 AS we, a, a + 3600 AS z FROM e LEFT JOIN f ON a < t + 12 AND a + 3600 > t - 4),
g AS (SELECT event_id, ws, we, count(a) AS n, min(a) AS lo, max(z) AS hi, coalesce(string_agg('seg_' || a::BIGINT, ';' ORDER BY 'seg_' || a::BIGINT), '') AS files FROM j GROUP BY 1, 2, 3),
o AS (SELECT event_id, n AS file_count, coalesce(lo <= ws AND hi >= we, false) AS complete, false AS has_gap, files AS source_files FROM g),
i AS (SELECT event_id, file_count, complete, has_gap, CASE WHEN complete THEN 'PASS' WHEN file_count > 0 THEN 'CONDITIONAL' ELSE 'STOP' END AS coverage_status, source_files FROM o)
"""

QUERIES = {f.__name__: f for f in (nominate_candidates, exact_id_crosswalk, validation_population, repair_confusion, epoch_role, interval_overlap, coverage_verdict, population_gate, catalogue_timeline)}

SQL = {
    "nominate_candidates": _CAT
    + """, s AS (SELECT * FROM e WHERE event_id = (SELECT min(event_id) FROM e)),
o AS (SELECT e.*, 6371008.8::DOUBLE * cos(radians(s.latitude)) * radians(e.longitude - s.longitude) AS east_m, 6371008.8::DOUBLE * radians(e.latitude - s.latitude) AS north_m,
  1000 * (e.depth_km - s.depth_km) AS down_m, e.magnitude - s.magnitude AS magnitude_difference, e.event_id = s.event_id AS is_seed FROM e, s),
h AS (SELECT *, sqrt(east_m * east_m + north_m * north_m) AS hd FROM o), k AS (SELECT *, sqrt(hd * hd + down_m * down_m) AS dd FROM h)
SELECT event_id::VARCHAR AS event_id, origin_time, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, round(depth_km, 6) AS depth_km, round(magnitude, 6) AS magnitude,
  round(east_m, 6) + 0.0::DOUBLE AS east_m, round(north_m, 6) + 0.0::DOUBLE AS north_m, round(down_m, 6) + 0.0::DOUBLE AS down_m, round(hd, 6) AS horizontal_distance_m, round(dd, 6) AS distance_3d_m,
  round(magnitude_difference, 6) + 0.0::DOUBLE AS magnitude_difference, is_seed, CASE WHEN is_seed THEN 'seed' ELSE 'waveform_test_required' END AS nomination_status
FROM k WHERE is_seed OR (round(dd, 6) <= 120 AND round(abs(magnitude_difference), 6) <= 0.7::DOUBLE)""",
    "exact_id_crosswalk": _WALK + "SELECT event_id, decision, external_sequence_id, external_quality, external_match_type, external_role, diagnostic_outcome FROM w",
    "validation_population": _WALK
    + """SELECT l.event_id, l.sequence_id, l.quality, CASE WHEN s.event_id IS NOT NULL THEN s.decision ELSE 'not_tested' END AS single_anchor_decision,
  CASE WHEN l.sequence_id = 'target' THEN 'target_positive' ELSE 'neighbor_family_negative' END AS validation_role, s.event_id IS NOT NULL AS in_frozen_shortlist
  FROM l LEFT JOIN s USING (event_id) WHERE l.sequence_id IN ('target', 'lang_de', 'lang_fr')""",
    "repair_confusion": _WALK
    + """SELECT r.external_role, count(event_id) AS event_count, count(*) FILTER (WHERE decision = 'family') AS predicted_target_positive, count(*) FILTER (WHERE decision = 'not_family') AS predicted_target_negative,
  count(*) FILTER (WHERE decision IN ('insufficient_data', 'seed')) AS abstained FROM (SELECT unnest(['published_target_positive', 'published_neighbor_family_negative']) AS external_role) r LEFT JOIN w USING (external_role) GROUP BY 1""",
    "population_gate": _WALK
    + """, p AS (SELECT sequence_id FROM l WHERE sequence_id IN ('target', 'lang_de', 'lang_fr')), c AS (SELECT count(*) FILTER (WHERE sequence_id = 'target') AS t, count(DISTINCT sequence_id) FILTER (WHERE sequence_id <> 'target') AS n FROM p)
SELECT t AS target_events, n AS neighbour_families, CASE WHEN t >= 3 AND n >= 1 THEN 'PASS' ELSE 'STOP' END AS status FROM c""",
    "catalogue_timeline": "SELECT o_orderstatus AS status, count(*) AS n, sum(CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey % 9)::DOUBLE ELSE 1.0::DOUBLE END) AS total FROM orders GROUP BY 1",
    "epoch_role": _CAT + "SELECT CASE WHEN origin_time > TIMESTAMP '2024-01-15 00:00:00' THEN 'prospective_post_catalog' ELSE 'published_catalog_era' END AS epoch_role, count(*) AS n, max(origin_time) AS last_origin FROM e GROUP BY 1",
    "interval_overlap": _INT + "SELECT * FROM i",
    "coverage_verdict": _INT + "SELECT coverage_status, count(*) AS n, sum(file_count)::BIGINT AS files FROM i GROUP BY 1",
}
