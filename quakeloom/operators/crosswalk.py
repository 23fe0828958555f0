"""Exact-identifier joins of a shortlist with published families. Location never matches anything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ABSTAIN = ["insufficient_data", "download_or_data_error", "seed"]
ROLES = ["published_target_positive", "published_neighbor_family_negative"]


def external_role(sequence_id: Column, target: str, neighbours: list[str]) -> Column:
    return (
        F.when(sequence_id == target, ROLES[0])
        .when(sequence_id.isin(neighbours), ROLES[1])
        .when(F.coalesce(sequence_id, F.lit("")) != "", "published_other_family")
        .otherwise("no_published_label")
    )


def diagnostic_outcome(role: Column, decision: Column) -> Column:
    family, abstain = F.coalesce(decision == "family", F.lit(False)), F.coalesce(decision.isin(ABSTAIN), F.lit(False))
    return (
        F.when((role == ROLES[0]) & family, "agreement_target_positive")
        .when((role == ROLES[0]) & abstain, "published_positive_single_anchor_abstain")
        .when(role == ROLES[0], "discordant_target_false_negative")
        .when((role == ROLES[1]) & family, "discordant_single_anchor_overmerge")
        .when((role == ROLES[1]) & abstain, "published_negative_single_anchor_abstain")
        .when(role == ROLES[1], "agreement_neighbor_negative")
        .otherwise("unlabeled_not_scored")
    )


def exact_id_crosswalk(shortlist: DataFrame, published: DataFrame, target: str, neighbours: list[str], catalogue: DataFrame | None = None, cutoff: Column | None = None) -> DataFrame:
    """Every shortlist row with the published event of the same id, its role and the diagnostic outcome.

    shortlist: event_id, decision, and optionally origin_time; published: event_id, sequence_id and
    other columns, prefixed external_. With ``catalogue`` an origin_time that is missing or empty text is taken from
    there, so are columns origin_time and magnitude that the shortlist has not, and depths are compared; with ``cutoff`` later events are prospective. Ids compare as strings.
    """
    text = lambda c: F.col(c).cast("string")
    left = shortlist.withColumn("event_id", text("event_id"))
    right = published.select(text("event_id").alias("event_id"), F.lit(True).alias("published__"), *[F.col(c).alias(f"external_{c}") for c in published.columns if c != "event_id"])
    rows = left.join(right, "event_id", "left")
    if catalogue is not None:
        rows = rows.join(catalogue.select(text("event_id").alias("event_id"), *[F.col(c).alias(f"catalogue_{c}") for c in catalogue.columns if c != "event_id"]), "event_id", "left")
        if "origin_time" in shortlist.columns and "origin_time" in catalogue.columns:
            own = F.col("origin_time")  # empty text is no time
            own = F.when(F.trim(own) != "", own) if dict(shortlist.dtypes)["origin_time"] == "string" else own
            rows = rows.withColumn("origin_time", F.coalesce(own, "catalogue_origin_time"))
        for c in ("origin_time", "magnitude"):
            if c not in shortlist.columns and c in catalogue.columns:
                rows = rows.withColumn(c, F.col(f"catalogue_{c}"))
        if "depth_km" in catalogue.columns and "depth_km" in published.columns:
            rows = rows.withColumn("catalogue_minus_external_depth_km", F.col("catalogue_depth_km") - F.col("external_depth_km"))
    if cutoff is not None:
        rows = rows.withColumn("epoch_role", F.when(F.col("origin_time") > cutoff, "prospective_post_catalog").otherwise("published_catalog_era"))
    rows = rows.withColumns(
        {"external_match_type": F.when(F.col("published__"), "exact_event_id").otherwise("none"), "external_role": external_role(F.col("external_sequence_id"), target, neighbours)}
    )
    return rows.withColumn("diagnostic_outcome", diagnostic_outcome(F.col("external_role"), F.col("decision"))).drop("published__")


def validation_population(sequence_events: DataFrame, crosswalk: DataFrame, target: str, neighbours: list[str]) -> DataFrame:
    """All events of the target and neighbour families, whether in the shortlist, and what was decided there; by family and time."""
    events = sequence_events.filter(F.col("sequence_id").isin([target, *neighbours]))
    seen = crosswalk.select("event_id", F.col("decision").alias("single_anchor_decision"), F.lit(True).alias("in__"))
    order = ["sequence_id", *(c for c in ("origin_time",) if c in events.columns)]
    return (
        events.withColumn("event_id", F.col("event_id").cast("string"))
        .join(seen, "event_id", "left")
        .withColumns(
            {
                "validation_role": F.when(F.col("sequence_id") == target, "target_positive").otherwise("neighbor_family_negative"),
                "in_frozen_shortlist": F.coalesce("in__", F.lit(False)),
                "single_anchor_decision": F.when(F.col("in__"), F.col("single_anchor_decision")).otherwise("not_tested"),
            }
        )
        .drop("in__")
        .orderBy(*order)
    )


def missing_sequences(sequence_events: DataFrame, wanted: DataFrame) -> DataFrame:
    """Ids of ``wanted`` (sequence_id) that no event has; a population may only be built if there is none."""
    return wanted.join(sequence_events.select("sequence_id").distinct(), "sequence_id", "left_anti")


def repair_confusion(crosswalk: DataFrame) -> DataFrame:
    """Counts of decisions for the two scored roles; both are always there."""
    spine = crosswalk.sparkSession.createDataFrame([(r,) for r in ROLES], "external_role string")
    count = lambda cond: F.count(F.when(cond, 1))
    d, there = F.col("decision"), F.col("there")
    return (
        F.broadcast(spine)
        .join(crosswalk.select("external_role", "decision", F.lit(True).alias("there")), "external_role", "left")
        .groupBy("external_role")
        .agg(
            count(there).alias("event_count"),
            count(d == "family").alias("predicted_target_positive"),
            count(d == "not_family").alias("predicted_target_negative"),
            count(there & ~F.coalesce(d.isin("family", "not_family"), F.lit(False))).alias("abstained"),
        )
    )
