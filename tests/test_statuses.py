"""Statuses, gates and decimals on small tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quakeloom import plans
from quakeloom.functions.scalar import fixed_text
from quakeloom.operators import array, crosswalk, detection, gates, pairs


def test_decimals_are_those_of_the_binary_value(spark):
    r = random.Random(1)
    xs = [0.125, 0.375, 0.625, 2.675, 1.005, 0.5, 1.5, 2.5, 0.0, 99.995, 1e-9, 62.5, 0.045, 123456.789, 9.995, 0.0005, 0.0015] + [r.uniform(0, 1000) for _ in range(2000)] + [k / 1000 for k in range(0, 5000, 5)] + [k / 16 for k in range(400)]
    df = spark.createDataFrame([(s * x,) for x in xs for s in (1, -1) if x or s > 0], "x double")
    for digits in (0, 1, 2, 3):
        for row in df.select("x", fixed_text(F.col("x"), digits).alias("t")).collect():
            assert row.t == f"{row.x:.{digits}f}", (row, digits)


def test_a_name_is_given_once(monkeypatch):
    from quakeloom.plans import array_queries, catalogue_queries

    monkeypatch.setitem(catalogue_queries.QUERIES, "robust_z", array_queries.robust_z)
    with pytest.raises(ValueError, match="robust_z"):
        plans.collect()


def test_control_gate_by_pair(spark):
    rows = [("t", "family", 0.95), ("low", "not_family", 0.3), ("high", "not_family", 0.9), ("few", "insufficient_data", None), ("none", None, None)]
    decisions = spark.createDataFrame(rows, "pair_name string, decision string, overall_median_correlation double")
    gate = spark.createDataFrame([("t", "low"), ("t", "high"), ("t", "few"), ("t", "gone"), ("low", "high"), ("gone", "low")], "candidate string, control string")
    got = {(r.candidate, r.control): r.status for r in pairs.control_gate(decisions, gate).collect()}
    assert got == {("t", "low"): "PASS", ("t", "high"): "STOP", ("t", "few"): "STOP", ("t", "gone"): "STOP", ("low", "high"): "STOP", ("gone", "low"): "STOP"}


def test_availability_and_external_status(spark):
    population = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "b"), ("4", "b")], "event_id string, sequence_id string")
    traces = spark.createDataFrame([(1, None), (1, None), (2, "no data"), (3, None), (3, "short"), (9, None)], "event_id int, error string")
    got = {r.event_id: (r.status, r.trace_count, r.error) for r in gates.waveform_availability(population, traces).collect()}
    assert got == {"1": ("available", 2, ""), "2": ("unavailable", 0, "no data"), "3": ("available", 1, ""), "4": ("unavailable", 0, "no waveform")}
    published = spark.createDataFrame([("1", "t"), ("2", "t"), ("3", "t"), ("4", "n1"), ("5", "x")], "event_id string, sequence_id string")
    shortlist = spark.createDataFrame([("1", "family"), ("4", "family"), ("8", "family")], "event_id string, decision string")
    walk = crosswalk.exact_id_crosswalk(shortlist, published, "t", ["n1", "n2"])
    chosen = crosswalk.validation_population(published, walk, "t", ["n1", "n2"])
    s = gates.external_status(walk, chosen, published.select("sequence_id").distinct(), published, "t", ["n1", "n2"], 7, "h").collect()[0]
    assert (s.external_population_gate, s.published_catalog_sequence_count, s.published_catalog_event_count, s.record_minus_file_event_count) == ("PASS", 3, 5, 2)
    assert (s.frozen_shortlist_events, s.shortlist_exact_id_matches, s.published_target_population_events, s.published_neighbor_population_events, s.discordant_single_anchor_overmerges) == (3, 2, 3, 1, 1)
    assert (s.published_target_shortlist_overlap, s.published_neighbor_shortlist_overlap, s.published_neighbor_family_count, s.hard_negative_sequence_ids) == (1, 1, 2, ["n1", "n2"])
    assert gates.external_status(walk, chosen, published, published, "t", ["n1"], 7, "h").collect()[0].external_population_gate == "STOP"


def test_missing_times_and_columns_come_from_the_catalogue(spark):
    shortlist = spark.createDataFrame([("1", "family", ""), ("2", "family", "2015"), ("3", "family", None)], "event_id string, decision string, origin_time string")
    catalogue = spark.createDataFrame([("1", "2001", 1.5, 3.0), ("2", "2002", 2.5, 4.0)], "event_id string, origin_time string, magnitude double, depth_km double")
    published = spark.createDataFrame([("1", "t", 2.0)], "event_id string, sequence_id string, depth_km double")
    got = {r.event_id: (r.origin_time, r.magnitude, r.catalogue_minus_external_depth_km, r.epoch_role) for r in crosswalk.exact_id_crosswalk(shortlist, published, "t", [], catalogue, F.lit("2010")).collect()}
    assert got == {"1": ("2001", 1.5, 1.0, "published_catalog_era"), "2": ("2015", 2.5, None, "prospective_post_catalog"), "3": (None, None, None, "published_catalog_era")}


def test_shots_from_samples_to_status(spark):
    opts = detection.DetectionOptions(noise=(-2.0, 0.0), signal=None, search=(0.0, 3.0), block=2, min_z=4.0, min_fraction=0.5, rate_hz=20.0, nperseg=32, min_ratio=2.0)
    r = random.Random(1)
    rows = []
    for shot, (loud, at) in enumerate([(9, 0.5), (9, 1.0), (9, 0.8), (9, 2.9), (0, 0.5)]):
        for k in range(-40, 100):
            for c in range(4):
                t = k / 20
                rows.append((shot, k, t, c, r.gauss(0, 1) + (loud * math.sin(6 * t + c) * math.exp(-2 * (t - at)) if t >= at else 0.0)))
    df = spark.createDataFrame(rows, "event_id int, sample int, t double, channel int, value double")
    shots = gates.calibrated_shots(detection.detect_events(df, opts), 1.0, 2.0)
    got = {s.event_id: (s.status, s.calibration_status, s.calibration_exclusion_reason == "") for s in shots.collect()}
    assert got[4][0] == "STOP" and got[3] == ("PASS", "CONDITIONAL", False) and [got[k] for k in (0, 1, 2)] == [("PASS", "PASS", True)] * 3
    s = gates.active_source_status(shots, "h").collect()[0]
    assert (s.shot_detectability, s.channel_response, s.shots_total, s.shots_time_domain_detected, s.shots_calibration_usable) == ("PASS", "PASS", 5, 4, 3)
    none = gates.active_source_status(shots.filter("event_id > 2"), "h").collect()[0]
    assert (none.shot_detectability, none.channel_response, none.absolute_timing, none.absolute_geometry) == ("STOP", "CONDITIONAL", "CONDITIONAL", "STOP")


def test_rank_matrix_is_whole_and_cut_to_the_shortest(spark):
    rows = [(p, c, v) for p, vs in {"a": [1, 2, 2, 5, 9], "b": [9, 5, 5, 1], "c": [1, 3, 3, 4, 0, 0], "flat": [2, 2, 2, 2]}.items() for c, v in enumerate(vs)]
    m = {(x.a, x.b): x.spearman for x in array.spearman_matrix(spark.createDataFrame(rows, "profile string, channel int, value int"), 2).collect()}
    assert len(m) == 16 and all(m[p, p] == 1 for p in ("a", "b", "c", "flat")) and all(m[x] == m[x[::-1]] for x in m)
    assert m["a", "b"] == pytest.approx(-1) and m["a", "c"] == pytest.approx(1) and m["a", "flat"] is None


def test_hard_negatives_by_channel(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = {e: rng.normal(size=(60, 3)) for e in (1, 2)}
    x[2][20:, 0] = np.roll(x[1][20:, 0], 2)
    x[2][:, 2] = 0.0
    rows = [(e, k, (k - 20) / 20, c, float(v[k, c])) for e, v in x.items() for k in range(60) for c in range(3)]
    df = spark.createDataFrame(rows, "event_id int, sample int, t double, channel int, value double")
    pair = spark.createDataFrame([(1, 2), (1, 5)], "first int, second int")
    opts = detection.DetectionOptions(noise=(-1.0, 0.0), signal=(0.0, 2.0), block=2, rate_hz=20.0)
    got = {r.second: r for r in detection.hard_negative_baseline(df, pair, opts, (0.0, 2.0), 0.2).collect()}
    assert got[5].channel_count == 0 and got[5].median is None
    peaks = []
    for c in (0, 1):
        a, b = (v[20:, c] - v[20:, c].mean() for v in (x[1], x[2]))
        full = np.correlate(a, b, "full") / np.sqrt((a @ a) * (b @ b))
        peaks.append(full[len(a) - 1 - 4 : len(a) + 4].max())
    assert got[2].channel_count == 2 and got[2].maximum == pytest.approx(max(peaks)) and got[2].median == pytest.approx(np.mean(peaks)) and got[2].fraction_above == 0.5


def test_shortlist_status(spark):
    scored = spark.createDataFrame([("seed", "unlabeled_deep_seed"), ("family", "single_anchor_high_similarity"), ("insufficient_data", "insufficient_data"), ("download_or_data_error", "insufficient_data")], "decision string, membership_status string")
    gate = spark.createDataFrame([("PASS", "family", "not_family")], "status string, candidate_decision string, control_decision string")
    s = gates.shortlist_status(scored, gate, "h").collect()[0]
    assert (s.events_in_frozen_shortlist, s.high_similarity_candidates_in_pilot, s.provisional_events_in_pilot, s.no_data_events_in_pilot) == (4, 2, 1, 1)
    assert (s.target_control_pair_gate, s.candidate_pair_decision, s.classifier_claim) == ("PASS", "family", "STOP")


def test_configuration_statuses_headers_and_traces(spark, tmp_path):
    import hashlib

    from quakeloom.sources import files, sinks

    text = '{\n  "pilot": {"limit": 120.5},\n  "paths": ["a", "b"]\n}\n'
    (tmp_path / "c.json").write_text(text)
    c = files.read_configuration(spark, str(tmp_path / "c.json")).collect()[0]
    assert c.pilot.limit == 120.5 and c.paths == ["a", "b"] and c.config_sha256 == hashlib.sha256(text.encode()).hexdigest() and c.config_path.endswith("c.json")
    status = spark.createDataFrame([("PASS", 3, None)], "gate string, n int, reason string")
    sinks.write_status(status, str(tmp_path / "s.json"))
    s = files.read_status(spark, str(tmp_path / "s.json")).collect()[0]
    assert (s.gate, s.n, s.reason) == ("PASS", 3, None)
    spark.createDataFrame([("p", "error", "bad")], "path string, status string, error string").write.parquet(str(tmp_path / "h"))
    h = files.read_headers(spark, str(tmp_path / "h")).collect()[0]
    assert (h.path, h.status, h.error, h.sample_count) == ("p", "error", "bad", None)
    rows = [("e", "N", "B", "", "Z", 100.0, 5.0, 1, 7, [1.0]), ("e", "N", "A", "", "Z", 100.0, 6.0, 1, 7, [2.0]), ("e", "N", "A", "", "Z", 100.0, 5.0, 1, 7, [3.0]), ("f", "N", "A", "", "Z", 100.0, 5.0, 1, 7, [4.0])]
    spark.createDataFrame(rows, files.TRACE_SCHEMA).write.parquet(str(tmp_path / "t"))
    assert {r.samples[0]: r.stream_order for r in files.read_traces(spark, str(tmp_path / "t")).collect()} == {3.0: 0, 2.0: 1, 1.0: 2, 4.0: 0}
    same = spark.createDataFrame([("a",), ("a",), (None,)], "h string")
    assert gates.provenance_gate(same, "h").collect()[0].status == "PASS" and gates.provenance_gate(same.unionByName(spark.createDataFrame([("b",)], "h string")), "h").collect()[0].status == "STOP"
