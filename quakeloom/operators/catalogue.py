"""Candidate nomination around a seed event."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakeloom.functions.scalar import local_offsets


@dataclass(frozen=True)
class NominationOptions:
    max_distance_m: float = 120.0
    max_magnitude_difference: float = 0.7
    #: Digits that distances and differences are rounded to before they are compared; None compares as they are.
    digits: int | None = None


def find_event(events: DataFrame, event_id: str) -> DataFrame:
    """The one event of that id; none or several are an error when the result is read."""
    found = events.filter(F.col("event_id").cast("string") == event_id)
    one = F.when(F.col("n__") == 1, True).otherwise(F.raise_error(F.lit(f"expected one event {event_id}")))
    # counted over the whole match, which is a row even where there is none
    counted = found.agg(F.count("*").alias("n__")).select(one.alias("one__"))
    return counted.join(found, F.col("one__"), "left").select(*found.columns)


def replace_configured(configured: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``configured`` rows with the catalogue's values where it has an event of that id (as text); columns of ``configured``.

    Configured rows are few and ids in a catalogue unique, so they are sent to its scan and not the other way round.
    """
    own = [c for c in configured.columns if c != "event_id"]
    key = configured.select(F.col("event_id").cast("string").alias("event_id")).distinct()
    rows = catalogue.withColumn("event_id", F.col("event_id").cast("string")).join(F.broadcast(key), "event_id", "left_semi")
    rows = rows.select("event_id", F.lit(True).alias("in__"), *[F.col(c).alias(f"c__{c}") for c in own if c in catalogue.columns])
    out = configured.withColumn("event_id", F.col("event_id").cast("string")).join(rows, "event_id", "left")
    return out.select("event_id", *[F.when(F.col("in__"), F.col(f"c__{c}")).otherwise(F.col(c)).alias(c) if c in catalogue.columns else F.col(c) for c in own])


def catalogue_provenance(sequences: DataFrame, events: DataFrame, advertised_sequences: int, advertised_events: int, expected_md5: str, observed_md5: str) -> DataFrame:
    """One row: counts in the file, those advertised, their difference, both checksums."""
    counts = sequences.agg(F.count("*").alias("sequence_count")).crossJoin(events.agg(F.count("*").alias("event_count")))
    return counts.select(
        F.lit(expected_md5).alias("expected_md5"), F.lit(observed_md5).alias("observed_md5"), "sequence_count", "event_count",
        F.lit(advertised_sequences).cast("long").alias("record_advertised_sequence_count"), F.lit(advertised_events).cast("long").alias("record_advertised_event_count"),
        (F.lit(advertised_events) - F.col("event_count")).cast("long").alias("record_minus_file_event_count"),
    )


def nominate_candidates(events: DataFrame, seed: DataFrame, opts: NominationOptions = NominationOptions()) -> DataFrame:
    """Events near the one-row ``seed`` in space and magnitude, and the seed itself, with offsets; nearest first.

    Columns event_id, latitude, longitude, depth_km and magnitude are read. The seed is one row, so it
    is broadcast; the scan of events is filtered without a shuffle.
    """
    s = seed.select(*[F.col(c).alias(f"s_{c}") for c in ("event_id", "latitude", "longitude", "depth_km", "magnitude")]).limit(1)
    rows = events.crossJoin(F.broadcast(s))
    offsets = local_offsets(*[F.col(c) for c in ("latitude", "longitude", "depth_km", "s_latitude", "s_longitude", "s_depth_km")])
    rows = rows.withColumns(offsets).withColumns(
        {"magnitude_difference": F.col("magnitude") - F.col("s_magnitude"), "is_seed": F.col("event_id").cast("string") == F.col("s_event_id").cast("string")}
    )
    near = lambda c: F.round(c, opts.digits) if opts.digits is not None else c
    kept = F.col("is_seed") | (
        (near(F.col("distance_3d_m")) <= opts.max_distance_m) & (near(F.abs("magnitude_difference")) <= opts.max_magnitude_difference)
    )
    status = F.when(F.col("is_seed"), "seed").otherwise("waveform_test_required")
    order = ["distance_3d_m", *(c for c in ("origin_time",) if c in events.columns)]
    return rows.filter(kept).withColumn("nomination_status", status).drop(*s.columns).orderBy(*order)


def nearest_nominees(nominated: DataFrame, most: int = 38) -> DataFrame:
    """The seed and the nearest ``most`` - 1 others, by distance, then time."""
    order = ["distance_3d_m", "origin_time"]
    seed = nominated.filter("is_seed")
    return seed.unionByName(nominated.filter("not is_seed").orderBy(*order).limit(most - 1)).orderBy(*order)
