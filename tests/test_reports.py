"""The coverage ledger, the checkpoint and static relations on small inputs."""

import pytest

from quakeloom.operators import checkpoint
from quakeloom.operators.coverage_ledger import ARRAY_ROOT, MANIFEST, PACKETS, coverage_ledger
from quakeloom.sources import manifests
from quakeloom.sources.text import read_manifest

HEADER = "path string, status string, root_uuid string, sample_rate_hz double, channel_count int, channel_spacing_m double, gauge_length_m double, start_locus_index int, raw_data_unit string"
HEAD = "system file nSamples fs Desample startTime endTime nChannels dCh GaugeLen firstSample"


def ledger(spark, sources, files=(), headers=(), lines=(), sample=3):
    out = coverage_ledger(
        spark.createDataFrame(sources, "source_name string, kind string, path string, exists boolean"), spark.createDataFrame(list(files), "source_name string, path string"),
        spark.createDataFrame(list(headers), HEADER), spark.createDataFrame(list(lines), "source_name string, value string"), sample,
    )
    return {r["source_name"]: r for r in out.collect()}


def test_ledger_of_every_kind(spark):
    sources = [("a", ARRAY_ROOT, "/a", True), ("m", MANIFEST, "/m", True), ("p", PACKETS, "/p", True), ("gone", ARRAY_ROOT, "/g", False), ("odd", "tape", "/o", False), ("bare", PACKETS, "/b", True)]
    files = [("a", f"/a/x{i}_2026-01-0{i + 1}T000000Z.h5") for i in range(5)] + [("a", "/a/x9.h5"), ("p", "/2026-01-09T000000Z/p.pb"), ("p", "/p/q2026-01-03T010203Z.pb"), ("gone", "/g/x.h5"), ("other", "/x.h5")]
    good = (1000.0, 4, 1.0, 10.0, 0, "rad")
    headers = [("/a/x0_2026-01-01T000000Z.h5", "ok", "u", *good), ("/a/x9.h5", "ok", "u", *good), ("/a/x1_2026-01-02T000000Z.h5", "ok", "never sampled", *good)]
    lines = [("m", "s f 10 1000 2 2026-01-02 2026-01-03 16 2.0 10.0 0"), ("m", "s f 10 1000 2 -1 -1 16 2.0 10.0 0"), ("m", "short"), ("m", "  "), ("m", "s f 10 0 2 a b 16 2 10 0")]
    got = ledger(spark, sources, files, headers, lines)
    a, m, p = got["a"], got["m"], got["p"]
    assert (a["file_count"], a["headers_read"], a["header_errors"], a["sample_duplicate_root_uuids"]) == (6, 3, 1, 1)
    assert (a["filename_start_utc"], a["filename_end_utc"]) == ("2026-01-01T00:00:00.000Z", "2026-01-05T00:00:00.000Z")
    assert a["sampled_configurations"] == '[{"sample_rate_hz":1000.0,"channel_count":4,"channel_spacing_m":1.0,"gauge_length_m":10.0,"start_locus_index":0,"raw_data_unit":"rad","sample_count":2}]'
    assert (m["file_count"], m["valid_record_count"], m["placeholder_count"], m["filename_start_utc"]) == (4, 2, 2, "2026-01-02")
    assert '"sample_rate_hz":500.0' in m["sampled_configurations"] and '"record_count":2' in m["sampled_configurations"]
    assert (p["file_count"], p["filename_start_utc"], p["filename_end_utc"]) == (2, "2026-01-03T010203Z", "2026-01-03T010203Z")
    assert {got[x]["coverage_level"] for x in ("gone", "odd")} == {"missing"} and got["gone"]["file_count"] == 0
    assert got["bare"]["file_count"] == 0 and got["bare"]["sampled_configurations"] == "[]" and "other" not in got


def test_ledger_of_unknown_kind_is_an_error(spark):
    with pytest.raises(Exception, match="unsupported kind of source: tape"):
        ledger(spark, [("x", "tape", "/x", True)])


def test_manifest_header(spark, tmp_path):
    (tmp_path / "good.txt").write_text(f"{HEAD}\n\ns f 1 \"2\" 3\n{HEAD}\n")
    (tmp_path / "bad.txt").write_text("system file\n1 2\n")
    (tmp_path / "empty.txt").write_text("")
    assert [r["value"] for r in read_manifest(spark, str(tmp_path / "good.txt"), "m").collect()] == ['s f 1 "2" 3', HEAD]
    for name in ("bad", "empty"):
        with pytest.raises(ValueError, match="header of a manifest"):
            read_manifest(spark, str(tmp_path / f"{name}.txt"), "m")


def statuses(spark, hash_of_deep="h", gate="PASS"):
    one = lambda **c: spark.createDataFrame([tuple(c.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double' if isinstance(v, float) else 'bigint'}" for k, v in c.items()))
    hrsn = one(config_sha256="h", target_control_pair_gate="PASS")
    deep = one(config_sha256=hash_of_deep, deep_template_detectability="PASS", hard_negative_baseline="PASS", geometry="STOP", geometry_reason="g", direct_das_repeatability=None, direct_das_repeatability_reason="r", stress_drop="STOP", stress_drop_reason="s")
    active = one(config_sha256=None, shot_detectability=gate, absolute_timing="CONDITIONAL", absolute_timing_reason="t", shots_calibration_usable=3, shots_total=5, shots_time_domain_detected=5)
    external = one(config_sha256="h", external_population_gate="PASS", published_target_population_events=7, published_neighbor_population_events=11, published_neighbor_family_count=3, shortlist_exact_id_matches=9, discordant_single_anchor_overmerges=2)
    network = one(config_sha256="h", classification_gate="STOP", waveform_available_events=17, labeled_events=18, classified_events=4, top_family_accuracy_ignoring_abstention_policy=0.75)
    negative = one(channel_count=8, median_per_channel_correlation=0.1, p95_per_channel_correlation=0.2, maximum_per_channel_correlation=0.3)
    shortlist = spark.createDataFrame([("unlabeled_deep_seed", "seed"), ("insufficient_data", "insufficient_data"), (None, None)], "membership_status string, decision string")
    metrics = spark.createDataFrame([("deep_template", 2.0, 0.5, "[]")], "role string, median_channel_snr double, detected_block_fraction double, usable_power_snr_ranges_hz string")
    sources = spark.createDataFrame([("a",), ("b",)], "source_name string")
    return checkpoint.inputs(hrsn, deep, active, external, network, negative, shortlist, metrics, sources, "h"), external, deep


def test_checkpoint(spark):
    row, external, deep = statuses(spark)
    got = checkpoint.branches(row).orderBy("position").collect()
    assert [r["branch"] for r in got] == [b for b, _ in checkpoint.BRANCHES]
    assert got[0]["status"] == "PASS" and got[1]["evidence"].startswith("2 sources") and got[3]["evidence"].startswith("1 high-similarity candidates, 1 insufficient-data rows, and 0 no-data rows; 2 ")
    assert "17 of 18 labeled events available; 4 classified and 13 abstained" in got[5]["evidence"] and got[5]["evidence"].endswith("75%")
    assert got[13]["status"] is None and got[15]["status"] == "STOP"
    assert checkpoint.summary(row).first()["pilot_decision"] == "PROCEED_WITH_CONDITIONS"
    assert [r["status"] for r in checkpoint.claim_status(external, deep).collect()] == ["PASS", "STOP", "STOP", "CONDITIONAL"]


def test_checkpoint_stops(spark):
    row, _, _ = statuses(spark, hash_of_deep="other", gate="CONDITIONAL")
    first = checkpoint.branches(row).orderBy("position").first()
    assert (first["status"], first["evidence"]) == ("STOP", "configuration hashes disagree")
    assert checkpoint.summary(row).first()["pilot_decision"] == "PAUSE_AND_REPAIR"
    assert checkpoint.summary(statuses(spark, gate=None)[0]).first()["pilot_decision"] == "PAUSE_AND_REPAIR"


def test_static_relations(spark):
    assert checkpoint.milestones(spark).count() == 5
    assert manifests.pipeline_manifest(spark).select("pipeline").distinct().count() == 3 and manifests.metric_manifest(spark).filter("current_status = 'STOP'").count() == 4
