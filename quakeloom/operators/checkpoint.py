"""The checkpoint: branches of evidence, milestones and the decision, from one-row status tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.functions.scalar import fixed_text
from quakeloom.operators.gates import CONDITIONAL, PASS, STOP

# The branches in their order, each with its next gate
BRANCHES = [
    ("Pilot product provenance", "rerun stale branches after any config edit"),
    ("Archive/configuration ledger", "full header/UUID epoch audit before completeness claims"),
    ("Single-pair HRSN target/control diagnostic", "use as nomination evidence only, never as a family label"),
    ("Single-anchor shortlist as a family catalog", "replace one-seed assignment with labeled multi-anchor classification plus relative location"),
    ("Published external validation population", "preserve exact-ID matching and event-held-out evaluation"),
    ("HRSN multi-family correlation baseline", "add event-held-out differential-time relocation; do not relax the margin on these test labels"),
    ("Continuous best-network detection baseline", "freeze HRSN/NCSN templates and false-discovery controls, then scan blind to DAS"),
    ("Prospective 2026 candidate on deep DAS", "independently classify the event and preserve clock/configuration QC"),
    ("Matched same-fiber hard negative", "retain this frozen negative baseline for a preregistered DAS score"),
    ("DAS incremental catalog value", "compare recall at matched event-level false-discovery rate with interval bootstrap uncertainty"),
    ("June active-source detectability/response", "obtain precise triggers; keep shot 1 conditional"),
    ("Absolute shot/DAS timing", "GPS/detonator trigger log and clock audit"),
    ("Deep channel geometry", "surveyed locus-to-MD/TVD/XYZ/cable-tangent table"),
    ("Direct DAS repeatability", "second independently classified target-family event on the same configuration"),
    ("Corner frequency / stress drop", "response correction, same-path EGF ensemble, in-band corner, model and synthetic tests"),
    ("Repeater-derived creep rate", "validated extension, at least three complete intervals, and a defensible moment/area/slip model"),
]
# The evidence of the branches, in the same order, where it holds no text of a status table
EVIDENCE = {
    "provenance": "all generated status products share config hash %s",
    "stale": "configuration hashes disagree",
    "archive": "%d sources inventoried; HDF5 filenames complete but headers sampled",
    "pair": "2026 candidate versus published 2014 target member is high-similarity; matched 2026 spatial control is dissimilar",
    "shortlist": "%d high-similarity candidates, %d insufficient-data rows, and %d no-data rows; %d exact-ID published neighboring-family events were overmerged",
    "population": "%d target events and %d events from %d neighboring families; %d exact shortlist ID matches",
    "families": "%d of %d labeled events available; %d classified and %d abstained under the frozen margin; diagnostic top-family accuracy without the margin is %s%%",
    "continuous": "not run on the exact DAS UTC/configuration intervals",
    "candidate": "median channel SNR %s; %s%% of sampled channel blocks detected; usable median power-SNR ranges %s",
    "negative": "%d loci: median correlation %s, p95 %s, max %s",
    "increment": "no blinded same-interval network-only versus DAS-only versus joint scan has run",
    "shots": "%d of %d shots pass calibration-quality rules; all %d have time-domain detections",
    "creep": "no DAS-extended complete family exists and event slip is unconstrained",
}
# milestones
MILESTONES = [
    ("Checkpoint 1: repair labels", "MET", "exact-ID published population frozen and single-anchor overmerge documented"),
    ("Checkpoint 2: best network-only baseline", "WAITING", "event-held-out differential relocation plus continuous same-interval detection"),
    ("Checkpoint 3: DAS incremental value", "WAITING", "DAS-only or joint recall/classification improves over network-only at matched false-discovery rate"),
    ("Checkpoint 4: direct DAS source physics", "WAITING", "second independently classified member on one deep configuration and surveyed geometry"),
    ("Checkpoint 5: stress drop and creep rate", "STOP", "response/EGF/source-model gates plus validated complete recurrence intervals"),
]
# Claims, each with its next gate
CLAIMS = [
    ("external_validation_population", "add event-held-out differential relocation and continuous same-interval network detection"),
    ("single_anchor_family_catalog", "replace one-seed thresholding with published-family multi-anchor classification"),
    ("DAS_catalog_extension", "same-interval network-only, DAS-only, and joint comparison"),
    ("deep_DAS_source_physics", "second independently classified target-family member in the same deep configuration"),
]
# What is said of the claims
CLAIM_EVIDENCE = [
    "%d target positives and %d neighboring families are frozen",
    "%d externally labeled neighboring-family events were overmerged",
    "DAS detectability has been shown, but no blinded DAS-only versus network-only scan has run",
    "one prospective 2026 target-family candidate is detected on the deep fiber",
]
PROCEED, PAUSE = "PROCEED_WITH_CONDITIONS", "PAUSE_AND_REPAIR"
# What the decision rests on, and what is worth most next
BASIS = {
    PROCEED: "The dataset supports a rigorous incremental-value experiment: published labels expose where conventional correlation confuses nearby families, while the prospective 2026 candidate and a hard control are both measurable on the deep fiber. This is permission to run the benchmark, not evidence that DAS has extended the catalog.",
    PAUSE: "One or more prerequisites for the incremental-value experiment failed.",
}
HIGHEST_VALUE = {
    "highest_value_next_analysis": "run a best-effort network-only detector on the exact DAS intervals, freeze its candidates and scores, then run DAS-only and joint pipelines blind to those results",
    "highest_value_next_observation": "a second independently network-classified target-family event on the same deep-DAS configuration",
    "highest_value_metadata_request": "surveyed deep locus-to-MD/TVD/XYZ/cable-tangent mapping",
}


def _one(df: DataFrame, name: str) -> DataFrame:
    """``df``, a table of one row, as one struct column; of more rows the first found counts, of none the fields are null."""
    return df.agg(F.first(F.struct("*")).alias(name))


def _beside(tables: list[DataFrame]) -> DataFrame:
    """Aggregates of one row each as one row."""
    row = tables[0]
    for t in tables[1:]:
        row = row.crossJoin(F.broadcast(t))
    return row


def inputs(
    hrsn: DataFrame, deep: DataFrame, active: DataFrame, external: DataFrame, network: DataFrame, negative: DataFrame, shortlist: DataFrame, deep_metrics: DataFrame, sources: DataFrame, config_sha256: str
) -> DataFrame:
    """All that the checkpoint reads, as one row.

    hrsn: config_sha256, target_control_pair_gate. deep: config_sha256, deep_template_detectability, hard_negative_baseline,
    geometry, direct_das_repeatability, stress_drop and their ``_reason`` columns. active: config_sha256, shot_detectability,
    absolute_timing, absolute_timing_reason, shots_calibration_usable, shots_total, shots_time_domain_detected. external:
    config_sha256, external_population_gate, published_target_population_events, published_neighbor_population_events,
    published_neighbor_family_count, shortlist_exact_id_matches, discordant_single_anchor_overmerges. network: config_sha256,
    classification_gate, waveform_available_events, labeled_events, classified_events,
    top_family_accuracy_ignoring_abstention_policy. negative: channel_count, median_per_channel_correlation,
    p95_per_channel_correlation, maximum_per_channel_correlation. These are tables of one row.
    shortlist: membership_status, decision. deep_metrics: role, median_channel_snr, detected_block_fraction,
    usable_power_snr_ranges_hz, one row with the role "deep_template". sources: the coverage ledger.
    """
    count = lambda c: F.count(F.when(c, 1))
    listed = shortlist.agg(
        F.count("*").alias("rows"), count(F.col("membership_status").isin("unlabeled_deep_seed", "single_anchor_high_similarity")).alias("high"),
        count(F.col("decision") == "insufficient_data").alias("provisional"), count(F.col("decision") == "download_or_data_error").alias("no_data"),
    )
    named = {"hrsn": hrsn, "deep": deep, "active": active, "external": external, "network": network, "negative": negative, "listed": listed,
             "target": deep_metrics.filter(F.col("role") == "deep_template"), "archive": sources.agg(F.count("*").alias("rows"))}
    return _beside([_one(df, name) for name, df in named.items()]).withColumn("config_sha256", F.lit(config_sha256))


def _same_hash() -> Column:
    """No status has another configuration's hash; a status without a hash does not count."""
    return F.forall(F.array(*[F.col(f"{t}.config_sha256") for t in ("hrsn", "deep", "active", "external", "network")]), lambda h: h.isNull() | (h == F.col("config_sha256")))


def _proceed() -> Column:
    """The five gates; a missing status is no pass."""
    gates = ("external.external_population_gate", "hrsn.target_control_pair_gate", "deep.deep_template_detectability", "deep.hard_negative_baseline", "active.shot_detectability")
    return F.forall(F.array(*[F.col(g) for g in gates]), lambda g: g.isNotNull() & (g == PASS))


def branches(row: DataFrame) -> DataFrame:
    """(position, branch, status, evidence, next_gate): the 16 branches of :func:`inputs`; nothing conditional is promoted."""
    say = lambda key, *columns: F.format_string(EVIDENCE[key], *[F.col(c) if isinstance(c, str) else c for c in columns])
    number = lambda c, digits: fixed_text(F.col(c).cast("double"), digits)
    percent = lambda c: fixed_text(F.col(c).cast("double") * 100, 0)
    fixed = lambda status, key: (F.lit(status), F.lit(EVIDENCE[key]))
    reason = lambda table, c: (F.col(f"{table}.{c}"), F.col(f"{table}.{c}_reason"))
    abstained = F.col("network.waveform_available_events") - F.col("network.classified_events")
    found = [
        (F.when(_same_hash(), PASS).otherwise(STOP), F.when(_same_hash(), say("provenance", F.substring("config_sha256", 1, 12))).otherwise(EVIDENCE["stale"])),
        (F.lit(CONDITIONAL), say("archive", "archive.rows")),
        (F.col("hrsn.target_control_pair_gate"), F.lit(EVIDENCE["pair"])),
        (F.lit(STOP), say("shortlist", "listed.high", "listed.provisional", "listed.no_data", "external.discordant_single_anchor_overmerges")),
        (F.col("external.external_population_gate"), say("population", *[f"external.{c}" for c in (
            "published_target_population_events", "published_neighbor_population_events", "published_neighbor_family_count", "shortlist_exact_id_matches")])),
        (F.col("network.classification_gate"), say("families", "network.waveform_available_events", "network.labeled_events", "network.classified_events", abstained,
                                                   percent("network.top_family_accuracy_ignoring_abstention_policy"))),
        fixed(STOP, "continuous"),
        (F.col("deep.deep_template_detectability"), say("candidate", number("target.median_channel_snr", 2), percent("target.detected_block_fraction"), "target.usable_power_snr_ranges_hz")),
        (F.col("deep.hard_negative_baseline"), say("negative", "negative.channel_count", *[number(f"negative.{c}", 3) for c in (
            "median_per_channel_correlation", "p95_per_channel_correlation", "maximum_per_channel_correlation")])),
        fixed(STOP, "increment"),
        (F.col("active.shot_detectability"), say("shots", "active.shots_calibration_usable", "active.shots_total", "active.shots_time_domain_detected")),
        reason("active", "absolute_timing"), reason("deep", "geometry"), reason("deep", "direct_das_repeatability"), reason("deep", "stress_drop"),
        fixed(STOP, "creep"),
    ]
    rows = [
        F.struct(F.lit(i).alias("position"), F.lit(name).alias("branch"), status.alias("status"), evidence.alias("evidence"), F.lit(gate).alias("next_gate"))
        for i, ((name, gate), (status, evidence)) in enumerate(zip(BRANCHES, found, strict=True))
    ]
    return row.select(F.inline(F.array(*rows)))


def summary(row: DataFrame) -> DataFrame:
    """The decision, its basis, what is worth most next, and the headline counts of :func:`inputs` as one row."""
    external = [F.col(f"external.{c}") for c in ("published_target_population_events", "published_neighbor_population_events")]
    return row.select(
        F.when(_proceed(), PROCEED).otherwise(PAUSE).alias("pilot_decision"), F.when(_proceed(), BASIS[PROCEED]).otherwise(BASIS[PAUSE]).alias("decision_basis"),
        *[F.lit(v).alias(k) for k, v in HIGHEST_VALUE.items()], F.col("listed.high").alias("high_similarity_candidates_in_bounded_pilot"),
        F.col("external.discordant_single_anchor_overmerges").alias("single_anchor_overmerges_in_published_neighbors"), *external,
        F.col("network.waveform_available_events").alias("network_labeled_events_with_waveforms"), F.col("listed.rows").alias("events_in_frozen_shortlist"), "config_sha256",
    )


def milestones(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MILESTONES, "name string, status string, criterion string")


def claim_status(external: DataFrame, deep: DataFrame) -> DataFrame:
    """(claim, status, evidence, next_gate): four claims of two one-row statuses; a missing repeatability is conditional."""
    row = _beside([_one(external, "external"), _one(deep, "deep")])
    say = lambda i, *columns: F.format_string(CLAIM_EVIDENCE[i], *[F.col(f"external.{c}") for c in columns]) if columns else F.lit(CLAIM_EVIDENCE[i])
    found = [
        (F.when(F.col("external.external_population_gate") == PASS, PASS).otherwise(STOP), say(0, "published_target_population_events", "published_neighbor_family_count")),
        (F.lit(STOP), say(1, "discordant_single_anchor_overmerges")),
        (F.lit(STOP), say(2)),
        (F.coalesce("deep.direct_das_repeatability", F.lit(CONDITIONAL)), say(3)),
    ]
    rows = [F.struct(F.lit(c).alias("claim"), s.alias("status"), e.alias("evidence"), F.lit(g).alias("next_gate")) for (c, g), (s, e) in zip(CLAIMS, found, strict=True)]
    return row.select(F.inline(F.array(*rows)))
