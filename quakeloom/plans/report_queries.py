"""Reports over all sources and statuses: the coverage ledger, the checkpoint and the claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.operators import checkpoint
from quakeloom.operators.coverage_ledger import ARRAY_ROOT, MANIFEST, PACKETS
from quakeloom.operators.coverage_ledger import coverage_ledger as ledger
from quakeloom.operators.gates import CONDITIONAL, PASS, STOP

SAMPLE = 64
HASH = "0123456789abcdef"
SOURCES = [("root-0", ARRAY_ROOT, True), ("root-1", ARRAY_ROOT, True), ("empty", ARRAY_ROOT, True), ("lines-0", MANIFEST, True), ("lines-1", MANIFEST, True), ("packets", PACKETS, True), ("gone", "tape", False)]


def _sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(name, kind, f"/data/{name}", there) for name, kind, there in SOURCES], "source_name string, kind string, path string, exists boolean")


def coverage_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Line items as array files with headers, orders as manifest lines, events as packet files."""
    li, orders, events = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("lineitem", "orders", "events"))
    text = lambda c: F.col(c).cast("string")
    stamp = F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.when(F.col("l_orderkey") % 9 == 0, "T000000").otherwise("T000000Z"))
    path = F.concat(F.lpad(text("l_orderkey"), 12, "0"), F.lit("-"), text("l_linenumber"), F.lit("_"), stamp, F.lit(".h5"))
    arrays = li.select(F.concat(F.lit("root-"), (F.col("l_orderkey") % 2).cast("string")).alias("source_name"), path.alias("path"))
    headers = li.select(
        path.alias("path"), F.when(F.col("l_suppkey") % 7 == 0, "error").otherwise("ok").alias("status"), (F.col("l_suppkey") % 20).cast("string").alias("root_uuid"),
        F.when(F.col("l_partkey") % 2 == 0, 1000.0).otherwise(800.0).alias("sample_rate_hz"), F.col("l_linenumber").cast("int").alias("channel_count"), F.lit(1.5).alias("channel_spacing_m"),
        F.lit(10.0).alias("gauge_length_m"), F.lit(None).cast("int").alias("start_locus_index"), F.col("l_returnflag").alias("raw_data_unit"),
    )
    rate = F.when(F.col("o_orderkey") % 13 == 0, "0").when(F.col("o_orderkey") % 3 == 0, "2000.0").otherwise("500.0")
    line = F.concat_ws(" ", F.lit("sys"), text("o_orderkey"), F.lit("100"), rate, F.lit("2"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("16"), F.lit("2.0"), F.lit("10.0"), F.lit("0"))
    lines = orders.select(F.concat(F.lit("lines-"), (F.col("o_custkey") % 2).cast("string")).alias("source_name"), F.when(F.col("o_orderkey") % 17 == 0, "sys short").otherwise(line).alias("value"))
    packets = events.select(F.lit("packets").alias("source_name"), F.concat(F.lit("/data/packets/p"), F.date_format("ts", "yyyy-MM-dd'T'HHmmss'Z'"), text("event_id"), F.lit(".pb")).alias("path"))
    return ledger(_sources(spark), arrays.unionByName(packets), headers, lines, SAMPLE)


def _inputs(spark: SparkSession, d: str) -> DataFrame:
    docs, orders, labels, emb = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "orders", "labels", "embeddings"))
    k = F.col("n_chars") % 5
    shortlist = docs.select(
        F.when(k == 0, "unlabeled_deep_seed").when(k == 1, "single_anchor_high_similarity").otherwise("insufficient_data").alias("membership_status"),
        F.when(k == 3, "insufficient_data").when(k == 4, "download_or_data_error").otherwise("family").alias("decision"),
    )
    n, f = F.count("*"), F.count(F.when(F.col("o_orderstatus") == "F", 1))
    gate = F.when(f > 0, PASS).otherwise(STOP)
    external = orders.agg(
        F.lit(HASH).alias("config_sha256"), gate.alias("external_population_gate"), f.alias("published_target_population_events"), (n - f).alias("published_neighbor_population_events"),
        F.countDistinct("o_orderpriority").alias("published_neighbor_family_count"), n.alias("shortlist_exact_id_matches"), F.countDistinct("o_custkey").alias("discordant_single_anchor_overmerges"),
    )
    hrsn = orders.agg(F.lit(HASH).alias("config_sha256"), gate.alias("target_control_pair_gate"))
    active = orders.agg(
        F.lit(None).cast("string").alias("config_sha256"), gate.alias("shot_detectability"), F.lit(CONDITIONAL).alias("absolute_timing"), F.lit("no trigger").alias("absolute_timing_reason"),
        f.alias("shots_calibration_usable"), n.alias("shots_total"), n.alias("shots_time_domain_detected"),
    )
    vectors = emb.agg(F.count("*").alias("n"), F.count(F.when(F.col("label") > 0, 1)).alias("c"))
    network = vectors.select(F.lit(HASH).alias("config_sha256"), F.lit(STOP).alias("classification_gate"), F.col("n").alias("waveform_available_events"), (F.col("n") + 3).alias("labeled_events"), F.col("c").alias("classified_events"),
                             F.lit(0.5625).alias("top_family_accuracy_ignoring_abstention_policy"))
    negative = vectors.select(F.col("n").alias("channel_count"), F.lit(0.125).alias("median_per_channel_correlation"), F.lit(0.25).alias("p95_per_channel_correlation"), F.lit(0.5).alias("maximum_per_channel_correlation"))
    deep = labels.agg(
        F.lit(HASH).alias("config_sha256"), F.when(F.count("*") > 0, PASS).otherwise(STOP).alias("deep_template_detectability"), F.lit(PASS).alias("hard_negative_baseline"), F.lit(STOP).alias("geometry"), F.lit("no survey").alias("geometry_reason"),
        F.lit(CONDITIONAL).alias("direct_das_repeatability"), F.lit("one event").alias("direct_das_repeatability_reason"), F.lit(STOP).alias("stress_drop"), F.lit("no response").alias("stress_drop_reason"),
    )
    metrics = spark.createDataFrame([("control", 1.0, 0.0, "[]"), ("deep_template", 6.25, 0.75, "[[2.0, 20.0]]")], "role string, median_channel_snr double, detected_block_fraction double, usable_power_snr_ranges_hz string")
    return checkpoint.inputs(hrsn, deep, active, external, network, negative, shortlist, metrics, _sources(spark), HASH)


def checkpoint_branches(spark: SparkSession, d: str) -> DataFrame:
    return checkpoint.branches(_inputs(spark, d))


def checkpoint_summary(spark: SparkSession, d: str) -> DataFrame:
    return checkpoint.summary(_inputs(spark, d))


def claim_status(spark: SparkSession, d: str) -> DataFrame:
    row = _inputs(spark, d)
    return checkpoint.claim_status(row.select("external.*"), row.select("deep.*"))


QUERIES = {f.__name__: f for f in (coverage_ledger, checkpoint_branches, checkpoint_summary, claim_status)}

_values = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
_STATUS = """o AS (SELECT count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(DISTINCT o_custkey) AS c, count(DISTINCT o_orderpriority) AS p FROM orders),
e AS (SELECT count(*) AS n, count(*) FILTER (WHERE label > 0) AS c FROM embeddings),
l AS (SELECT count(*) AS n, count(*) FILTER (WHERE n_chars % 5 < 2) AS high, count(*) FILTER (WHERE n_chars % 5 = 3) AS few, count(*) FILTER (WHERE n_chars % 5 = 4) AS none FROM documents)"""
_GATE = "CASE WHEN o.f > 0 THEN 'PASS' ELSE 'STOP' END"
_DEEP = "CASE WHEN (SELECT count(*) FROM labels) > 0 THEN 'PASS' ELSE 'STOP' END"
_branches = lambda names: ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(names))

SQL = {
    "coverage_ledger": f"""WITH s(source_name, kind, exists) AS (VALUES {_values(SOURCES)}),
a AS (SELECT 'root-' || (l_orderkey % 2) AS source_name, lpad(l_orderkey::VARCHAR, 12, '0') || '-' || l_linenumber || '_' || strftime(l_shipdate, '%Y-%m-%d') || CASE WHEN l_orderkey % 9 = 0 THEN 'T000000' ELSE 'T000000Z' END || '.h5' AS path,
  CASE WHEN l_orderkey % 9 <> 0 THEN strftime(l_shipdate, '%Y-%m-%dT00:00:00.000Z') END AS stamp, l_suppkey % 7 <> 0 AS ok, l_suppkey % 20 AS u, CASE WHEN l_partkey % 2 = 0 THEN 1000.0 ELSE 800.0 END::DOUBLE AS rate, l_linenumber AS ch, l_returnflag AS unit FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY path) - 1 AS p, count(*) OVER (PARTITION BY source_name) AS n FROM a),
w AS (SELECT DISTINCT source_name, round_even(i * (n - 1) / {SAMPLE - 1}.0, 0)::BIGINT AS p FROM (SELECT DISTINCT source_name, n FROM r), (SELECT unnest(range(0, {SAMPLE})) AS i)),
h AS (SELECT r.* FROM r JOIN w ON r.source_name = w.source_name AND r.p = w.p),
hm AS (SELECT source_name, rate, ch, unit, count(*) AS n FROM h WHERE ok GROUP BY ALL),
hj AS (SELECT source_name, '[' || string_agg('{{"sample_rate_hz":' || rate || ',"channel_count":' || ch || ',"channel_spacing_m":1.5,"gauge_length_m":10.0,"start_locus_index":null,"raw_data_unit":"' || unit || '","sample_count":' || n || '}}', ',' ORDER BY rate::VARCHAR, ch::VARCHAR, unit) || ']' AS j FROM hm GROUP BY 1),
hc AS (SELECT source_name, count(*) AS hr, count(*) FILTER (WHERE NOT ok) AS he, count(u) FILTER (WHERE ok) - count(DISTINCT u) FILTER (WHERE ok) AS du FROM h GROUP BY 1),
ac AS (SELECT source_name, count(*) AS n, min(stamp) AS a, max(stamp) AS z FROM a GROUP BY 1),
m AS (SELECT 'lines-' || (o_custkey % 2) AS source_name, o_orderkey % 17 <> 0 AND o_orderkey % 13 <> 0 AS ok, CASE WHEN o_orderkey % 3 = 0 THEN 1000.0 ELSE 250.0 END::DOUBLE AS rate, strftime(o_orderdate, '%Y-%m-%d') AS t FROM orders),
mj AS (SELECT source_name, '[' || string_agg('{{"sample_rate_hz":' || rate || ',"channel_count":16,"channel_spacing_m":2.0,"gauge_length_m":10.0,"record_count":' || n || '}}', ',' ORDER BY rate) || ']' AS j FROM (SELECT source_name, rate, count(*) AS n FROM m WHERE ok GROUP BY ALL) GROUP BY 1),
mc AS (SELECT source_name, count(*) AS n, count(*) FILTER (WHERE ok) AS v, count(*) FILTER (WHERE NOT ok) AS b, min(t) FILTER (WHERE ok) AS a, max(t) FILTER (WHERE ok) AS z FROM m GROUP BY 1),
found AS (
SELECT source_name, n, NULL::BIGINT AS v, NULL::BIGINT AS b, a, z, hr, he, du, j FROM ac JOIN hc USING (source_name) LEFT JOIN hj USING (source_name)
UNION ALL SELECT source_name, n, v, b, a, z, 0, NULL, NULL, j FROM mc LEFT JOIN mj USING (source_name)
UNION ALL SELECT 'packets', count(*), NULL, NULL, min(strftime(ts, '%Y-%m-%dT%H%M%SZ')), max(strftime(ts, '%Y-%m-%dT%H%M%SZ')), 0, NULL, NULL, '[]' FROM events)
SELECT source_name, kind, '/data/' || source_name AS path, exists, coalesce(n, 0) AS file_count, v AS valid_record_count, b AS placeholder_count, a AS filename_start_utc, z AS filename_end_utc,
  CASE WHEN exists THEN coalesce(hr, 0) END AS headers_read, he AS header_errors, du AS sample_duplicate_root_uuids, CASE WHEN exists THEN coalesce(j, '[]') END AS sampled_configurations,
  CASE kind WHEN 'optasense_h5_root' THEN 'filename_complete_header_sampled' WHEN 'whitespace_manifest' THEN 'manifest_rows_complete_headers_not_rechecked' WHEN 'protobuf_root' THEN 'filename_only_requires_protobuf_packet_audit' ELSE 'missing' END AS coverage_level
FROM s LEFT JOIN found USING (source_name)""",
    "checkpoint_branches": f"""WITH {_STATUS}, b(position, branch, next_gate) AS (VALUES {_branches(checkpoint.BRANCHES)})
SELECT position::INT AS position, branch, next_gate,
  CASE position WHEN 0 THEN 'PASS' WHEN 2 THEN {_GATE} WHEN 4 THEN {_GATE} WHEN 10 THEN {_GATE} WHEN 7 THEN {_DEEP} WHEN 8 THEN 'PASS' WHEN 1 THEN 'CONDITIONAL' WHEN 11 THEN 'CONDITIONAL' WHEN 13 THEN 'CONDITIONAL' ELSE 'STOP' END AS status,
  CASE position WHEN 0 THEN 'all generated status products share config hash 0123456789ab' WHEN 1 THEN '{len(SOURCES)} sources inventoried; HDF5 filenames complete but headers sampled'
  WHEN 2 THEN '2026 candidate versus published 2014 target member is high-similarity; matched 2026 spatial control is dissimilar'
  WHEN 3 THEN l.high || ' high-similarity candidates, ' || l.few || ' insufficient-data rows, and ' || l.none || ' no-data rows; ' || o.c || ' exact-ID published neighboring-family events were overmerged'
  WHEN 4 THEN o.f || ' target events and ' || (o.n - o.f) || ' events from ' || o.p || ' neighboring families; ' || o.n || ' exact shortlist ID matches'
  WHEN 5 THEN e.n || ' of ' || (e.n + 3) || ' labeled events available; ' || e.c || ' classified and ' || (e.n - e.c) || ' abstained under the frozen margin; diagnostic top-family accuracy without the margin is 56%'
  WHEN 6 THEN 'not run on the exact DAS UTC/configuration intervals' WHEN 7 THEN 'median channel SNR 6.25; 75% of sampled channel blocks detected; usable median power-SNR ranges [[2.0, 20.0]]'
  WHEN 8 THEN e.n || ' loci: median correlation 0.125, p95 0.250, max 0.500' WHEN 9 THEN 'no blinded same-interval network-only versus DAS-only versus joint scan has run'
  WHEN 10 THEN o.f || ' of ' || o.n || ' shots pass calibration-quality rules; all ' || o.n || ' have time-domain detections' WHEN 11 THEN 'no trigger' WHEN 12 THEN 'no survey' WHEN 13 THEN 'one event' WHEN 14 THEN 'no response'
  ELSE 'no DAS-extended complete family exists and event slip is unconstrained' END AS evidence FROM b, o, e, l""",
    "checkpoint_summary": f"""WITH {_STATUS} SELECT CASE WHEN {_GATE} = 'PASS' AND {_DEEP} = 'PASS' THEN 'PROCEED_WITH_CONDITIONS' ELSE 'PAUSE_AND_REPAIR' END AS pilot_decision,
  CASE WHEN {_GATE} = 'PASS' AND {_DEEP} = 'PASS' THEN '{checkpoint.BASIS[checkpoint.PROCEED]}' ELSE '{checkpoint.BASIS[checkpoint.PAUSE]}' END AS decision_basis, {", ".join(f"'{v}' AS {k}" for k, v in checkpoint.HIGHEST_VALUE.items())}, l.high AS high_similarity_candidates_in_bounded_pilot,
  o.c AS single_anchor_overmerges_in_published_neighbors, o.f AS published_target_population_events, o.n - o.f AS published_neighbor_population_events, e.n AS network_labeled_events_with_waveforms, l.n AS events_in_frozen_shortlist,
  '{HASH}' AS config_sha256 FROM o, e, l""",
    "claim_status": f"""WITH {_STATUS}, b(position, claim, next_gate) AS (VALUES {_branches(checkpoint.CLAIMS)})
SELECT claim, next_gate, CASE position WHEN 0 THEN {_GATE} WHEN 3 THEN 'CONDITIONAL' ELSE 'STOP' END AS status,
  CASE position WHEN 0 THEN o.f || ' target positives and ' || o.p || ' neighboring families are frozen' WHEN 1 THEN o.c || ' externally labeled neighboring-family events were overmerged'
  WHEN 2 THEN 'DAS detectability has been shown, but no blinded DAS-only versus network-only scan has run' ELSE 'one prospective 2026 target-family candidate is detected on the deep fiber' END AS evidence FROM b, o""",
}
