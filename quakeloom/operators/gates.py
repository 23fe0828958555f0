"""Verdicts and the evidence ledger: PASS, CONDITIONAL and STOP."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASS, CONDITIONAL, STOP = "PASS", "CONDITIONAL", "STOP"


def coverage_verdict(complete: Column, some: Column) -> Column:
    return F.when(complete, PASS).when(some, CONDITIONAL).otherwise(STOP)


def membership_status(decision: Column) -> Column:
    """What a single-anchor decision says of membership."""
    # The statuses
    return (
        F.when(decision == "seed", "unlabeled_deep_seed")
        .when(decision == "family", "single_anchor_high_similarity")
        .when(decision == "not_family", "single_anchor_dissimilar_neighbor")
        .otherwise("insufficient_data")
    )


def threshold_sandbox(scores: DataFrame, score: Column, margin: Column, label: Column, min_scores: list[float], min_margins: list[float]) -> DataFrame:
    """Accepted and abstained rows, and how many accepted ones are right, for every pair of thresholds."""
    grid = scores.sparkSession.createDataFrame([(float(s), float(m)) for s in min_scores for m in min_margins], "min_score double, min_margin double")
    rows = scores.select(score.alias("s"), margin.alias("m"), label.alias("right")).crossJoin(F.broadcast(grid))
    take = F.coalesce((F.col("s") >= F.col("min_score")) & (F.col("m") >= F.col("min_margin")), F.lit(False))
    return rows.groupBy("min_score", "min_margin").agg(
        F.count(F.when(take, 1)).alias("accepted"), F.count(F.when(~take, 1)).alias("abstained"), F.count(F.when(take & F.col("right"), 1)).alias("accepted_right")
    )


# Fixed value: the one reason for which a shot is not used
NOT_USABLE = "nominal offset, median channel SNR, or array-median usable band failed the calibration-quality rule"


def calibration_usable(detected: Column, median_snr: Column, offset_s: Column, has_band: Column, min_snr: float = 1.5, max_offset_s: float = 5.0) -> Column:
    """Whether a shot may calibrate: detected, loud enough, its peak from 0 to ``max_offset_s`` after the nominal time, with a usable band."""
    return F.coalesce(detected & (median_snr >= min_snr) & (offset_s >= 0) & (offset_s <= max_offset_s) & has_band, F.lit(False))


def calibration_verdict(shots: DataFrame, min_usable: int = 3, min_snr: float = 1.5, max_offset_s: float = 5.0) -> DataFrame:
    """One row: shots, detected and usable ones, shot_detectability (PASS or STOP) and channel_response (PASS or CONDITIONAL).

    shots: detected, median_snr, offset_s, has_band. Absolute timing is always conditional and geometry a stop: no input can show them.
    """
    usable = calibration_usable(F.col("detected"), F.col("median_snr"), F.col("offset_s"), F.col("has_band"), min_snr, max_offset_s)
    counts = shots.agg(F.count("*").alias("shots"), F.count(F.when(F.col("detected"), 1)).alias("detected"), F.count(F.when(usable, 1)).alias("usable"))
    enough = F.col("usable") >= min_usable
    return counts.select(
        "*", F.when(enough, PASS).otherwise(STOP).alias("shot_detectability"), F.when(enough, PASS).otherwise(CONDITIONAL).alias("channel_response"),
        F.lit(CONDITIONAL).alias("absolute_timing"), F.lit(STOP).alias("absolute_geometry"),
    )


def exclusion_reason(detected: Column, median_snr: Column, offset_s: Column, has_band: Column, min_snr: float = 1.5, max_offset_s: float = 5.0) -> Column:
    return F.when(calibration_usable(detected, median_snr, offset_s, has_band, min_snr, max_offset_s), "").otherwise(NOT_USABLE)


def ledger(statuses: DataFrame, required: list[str]) -> DataFrame:
    """Branches (branch, status, evidence) with the decision that holds for all: proceed only if every required branch passed.

    A conditional branch is never taken for a passed one; a missing branch is a stop.
    """
    spine = statuses.sparkSession.createDataFrame([(b,) for b in required], "branch string")
    gate = F.broadcast(spine).join(statuses.select("branch", "status"), "branch", "left").agg(F.min((F.coalesce("status", F.lit(STOP)) == PASS).cast("int")).alias("ok"))
    decision = F.when(F.col("ok") == 1, "PROCEED_WITH_CONDITIONS").otherwise("PAUSE_AND_REPAIR")
    return statuses.crossJoin(F.broadcast(gate)).withColumn("decision", decision).drop("ok")


def provenance_gate(rows: DataFrame, hash_col: str) -> DataFrame:
    """PASS if all rows with a hash have the same one."""
    return rows.agg(F.countDistinct(hash_col).alias("hashes")).withColumn("status", F.when(F.col("hashes") == 1, PASS).otherwise(STOP))


def population_gate(population: DataFrame, min_targets: int = 3, min_families: int = 2) -> DataFrame:
    """PASS if a validation population has enough target events and neighbour families."""
    target = F.col("validation_role") == "target_positive"
    counts = population.agg(F.count(F.when(target, 1)).alias("target_events"), F.countDistinct(F.when(~target, F.col("sequence_id"))).alias("neighbour_families"))
    return counts.withColumn("status", F.when((F.col("target_events") >= min_targets) & (F.col("neighbour_families") >= min_families), PASS).otherwise(STOP))


def timeline(rows: DataFrame, status: str, size: str) -> DataFrame:
    """Rows and summed sizes by status; a missing size counts as 1."""
    return rows.fillna(1.0, [size]).groupBy(status).agg(F.count("*").alias("n"), F.sum(size).alias("total"))


def waveform_availability(population: DataFrame, traces: DataFrame) -> DataFrame:
    """(event_id, sequence_id, status, trace_count, error): every event of the population, available if it has a trace.

    traces: event_id, one row a trace, and perhaps error, a text where the trace could not be read; the first such text is shown.
    """
    bad = F.col("error") if "error" in traces.columns else F.lit(None).cast("string")
    own = traces.groupBy(F.col("event_id").cast("string").alias("of__")).agg(F.count(F.when(bad.isNull(), 1)).alias("n__"), F.min(bad).alias("bad__"))
    rows = population.join(own, F.col("event_id").cast("string") == F.col("of__"), "left")
    n = F.coalesce("n__", F.lit(0))
    error = F.when(n > 0, "").otherwise(F.coalesce("bad__", F.lit("no waveform")))
    return rows.select("event_id", "sequence_id", F.when(n > 0, "available").otherwise("unavailable").alias("status"), n.alias("trace_count"), error.alias("error"))


# What is said of the benchmark
NETWORK_REASON = "the HRSN correlation-only diagnostic classified no events under the frozen margin; continuous network detection, differential relocation, and bootstrap uncertainty are not complete"
NETWORK_METHOD = "median of frozen top-k multi-anchor HRSN correlations with an explicit abstention margin"
NETWORK_SCOPE = "waveform-correlation family-assignment diagnostic; not the final best-network baseline"


def network_status(summary: DataFrame, per_family: DataFrame, thresholds: dict[str, float], config_sha256: str) -> DataFrame:
    """The benchmark's status: :func:`~quakeloom.operators.family.classification_summary` with its thresholds and every family's figures.

    per_family: :func:`~quakeloom.operators.family.per_family_metrics`; it becomes an array of structs by family.
    A correlation-only diagnostic never passes the gate and no continuous detection has run, whatever the figures.
    """
    families = per_family.agg(F.array_sort(F.collect_list(F.struct("sequence_id", *[c for c in per_family.columns if c != "sequence_id"]))).alias("per_family"))
    return summary.join(F.broadcast(families), F.lit(True)).select(
        F.lit(STOP).alias("status"), F.lit(STOP).alias("classification_gate"), F.lit("NOT_RUN").alias("continuous_detection_status"),
        F.lit(NETWORK_REASON).alias("reason"), F.lit(NETWORK_METHOD).alias("method"), F.lit(NETWORK_SCOPE).alias("scope"),
        *summary.columns, (F.col("labeled_events") - F.col("waveform_available_events")).alias("waveform_unavailable_events"), "per_family",
        F.struct(*[F.lit(v).alias(k) for k, v in thresholds.items()]).alias("thresholds"), F.lit(config_sha256).alias("config_sha256"),
    )


# What is said of a catalogue made with a single anchor
SINGLE_ANCHOR_REASON = "external exact-ID labels show cross-family merges"


def external_status(
    crosswalk: DataFrame, population: DataFrame, sequences: DataFrame, published_events: DataFrame, target: str, neighbours: list[str], advertised_events: int, config_sha256: str
) -> DataFrame:
    """The external validation's status as one row: its gate, the catalogue's counts against what its record advertises, and how the shortlist meets it.

    crosswalk: :func:`~quakeloom.operators.crosswalk.exact_id_crosswalk`; population: its validation population. The
    gate asks for three target events and two neighbour families that were named, found or not.
    """
    count = lambda c: F.count(F.when(c, 1))
    role = F.col("external_role")
    walk = crosswalk.agg(
        F.count("*").alias("frozen_shortlist_events"), count(F.col("external_match_type") == "exact_event_id").alias("shortlist_exact_id_matches"),
        count(role == "published_target_positive").alias("published_target_shortlist_overlap"), count(role == "published_neighbor_family_negative").alias("published_neighbor_shortlist_overlap"),
        count(F.col("diagnostic_outcome") == "discordant_single_anchor_overmerge").alias("discordant_single_anchor_overmerges"),
    )
    kind = F.col("validation_role")
    own = population.agg(count(kind == "target_positive").alias("published_target_population_events"), count(kind == "neighbor_family_negative").alias("published_neighbor_population_events"))
    counts = sequences.agg(F.count("*").alias("published_catalog_sequence_count")).join(F.broadcast(published_events.agg(F.count("*").alias("published_catalog_event_count"))), F.lit(True))
    row = walk.join(F.broadcast(own), F.lit(True)).join(F.broadcast(counts), F.lit(True))
    gate = F.when((F.col("published_target_population_events") >= 3) & F.lit(len(neighbours) >= 2), PASS).otherwise(STOP)
    return row.select(
        gate.alias("external_population_gate"), *counts.columns, F.lit(advertised_events).cast("long").alias("record_advertised_event_count"),
        (F.lit(advertised_events).cast("long") - F.col("published_catalog_event_count")).alias("record_minus_file_event_count"), *walk.columns, *own.columns,
        F.lit(len(neighbours)).cast("long").alias("published_neighbor_family_count"), F.lit(STOP).alias("single_anchor_catalog_claim"), F.lit(SINGLE_ANCHOR_REASON).alias("single_anchor_catalog_reason"),
        F.lit(target).alias("target_sequence_id"), F.array(*[F.lit(x) for x in neighbours]).alias("hard_negative_sequence_ids"), F.lit(config_sha256).alias("config_sha256"),
    )


# What is said of a classifier with one seed
CLASSIFIER_REASON = "one-seed thresholding is only a similarity diagnostic; exact-ID external labels show cross-family overmerging"


def shortlist_status(scored: DataFrame, gate: DataFrame, config_sha256: str) -> DataFrame:
    """The single-anchor pilot's status as one row.

    scored: decision and membership_status of every shortlisted event; gate: one row of
    :func:`~quakeloom.operators.pairs.control_gate` with candidate_decision and control_decision.
    """
    count = lambda c: F.count(F.when(c, 1))
    rows = scored.agg(
        F.count("*").alias("events_in_frozen_shortlist"), count(F.col("membership_status").isin("unlabeled_deep_seed", "single_anchor_high_similarity")).alias("high_similarity_candidates_in_pilot"),
        count(F.col("decision") == "insufficient_data").alias("provisional_events_in_pilot"), count(F.col("decision") == "download_or_data_error").alias("no_data_events_in_pilot"),
    )
    own = gate.select(F.col("status").alias("target_control_pair_gate"), F.col("candidate_decision").alias("candidate_pair_decision"), F.col("control_decision").alias("hard_control_decision"))
    return rows.join(F.broadcast(own), F.lit(True)).select(
        *own.columns, *rows.columns, F.lit(STOP).alias("single_anchor_catalog_claim"), F.lit(STOP).alias("classifier_claim"), F.lit(CLASSIFIER_REASON).alias("classifier_reason"),
        F.lit(config_sha256).alias("config_sha256"),
    )


# Why timing and geometry stay open
TIMING_REASON = "available shot log has nominal local times but no independent GPS/detonator trigger uncertainty"
GEOMETRY_REASON = "deep locus-to-MD/TVD/XYZ trajectory unavailable"


def calibrated_shots(detections: DataFrame, min_snr: float = 1.5, max_offset_s: float = 5.0) -> DataFrame:
    """:func:`~quakeloom.operators.detection.detect_events` of shots with calibration_status, PASS or CONDITIONAL, and calibration_exclusion_reason."""
    rule = F.coalesce(F.col("status") == PASS, F.lit(False)), F.col("median_channel_snr"), F.col("peak_t"), F.size("usable_power_snr_ranges_hz") > 0, min_snr, max_offset_s
    return detections.withColumns({"calibration_status": F.when(calibration_usable(*rule), PASS).otherwise(CONDITIONAL), "calibration_exclusion_reason": exclusion_reason(*rule)})


def active_source_status(shots: DataFrame, config_sha256: str, min_usable: int = 3) -> DataFrame:
    """The status of :func:`calibrated_shots` as one row; timing is conditional and geometry a stop whatever they show."""
    count = lambda c: F.count(F.when(c, 1))
    row = shots.agg(count(F.col("status") == PASS).alias("shots_time_domain_detected"), count(F.col("calibration_status") == PASS).alias("shots_calibration_usable"), F.count("*").alias("shots_total"))
    enough = F.col("shots_calibration_usable") >= min_usable
    return row.select(
        F.when(enough, PASS).otherwise(STOP).alias("shot_detectability"), *row.columns, F.lit(CONDITIONAL).alias("absolute_timing"), F.lit(TIMING_REASON).alias("absolute_timing_reason"),
        F.when(enough, PASS).otherwise(CONDITIONAL).alias("channel_response"), F.lit(STOP).alias("absolute_geometry"), F.lit(GEOMETRY_REASON).alias("absolute_geometry_reason"), F.lit(config_sha256).alias("config_sha256"),
    )
