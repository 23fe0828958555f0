"""Leave-one-event-out family classification over symmetric pair scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quakeloom.operators.ordered import running


@dataclass(frozen=True)
class FamilyOptions:
    max_anchors: int = 3
    min_score: float = 0.85
    min_margin: float = 0.02
    #: Digits that margins are rounded to before they are compared.
    digits: int | None = None


def symmetric_edges(pairs: DataFrame) -> DataFrame:
    """(event_id, anchor_id, score) in both directions from pairs (a, b, score) that passed and have a score."""
    ok = pairs.filter("a <> b and score is not null and not isnan(score)")
    if "status" in pairs.columns:
        ok = ok.filter("status = 'PASS'")
    way = lambda x, y: F.struct(F.col(x).alias("event_id"), F.col(y).alias("anchor_id"), "score")
    return ok.select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("e")).select("e.*")


def published_pairs(pairs: DataFrame, population: DataFrame) -> DataFrame:
    """Pairs (a, b, ...) with the published family of both and whether it is the same; pairs without a family on a side are left out."""
    of = lambda c, name: population.select(F.col("event_id").alias(c), F.col("sequence_id").alias(name))
    rows = pairs.join(of("a", "reference_sequence_id"), "a").join(of("b", "comparison_sequence_id"), "b")
    return rows.withColumn("same_published_family", F.col("reference_sequence_id") == F.col("comparison_sequence_id"))


def published_pair_counts(population: DataFrame) -> DataFrame:
    """(reference_sequence_id, same_published_family, n): how many rows :func:`published_pairs` of all pairs of the population
    (event_id, sequence_id) has, a < b as text, counted without making them.

    The pairs of an event as a are the events behind it, so positions in the order of events say how many there are. A
    pair with a null family has a null comparison; equal events are no pair.
    """
    rows = population.select(F.col("event_id").cast("string").alias("event_id"), F.col("sequence_id").alias("family")).filter("event_id is not null")
    own = rows.groupBy("event_id", "family").agg(F.count("*").alias("c"))
    ids = own.groupBy("event_id").agg(F.sum("c").alias("rows"), F.sum(F.when(F.col("family").isNotNull(), F.col("c")).otherwise(0)).alias("known"))
    ids = running(ids, [], ["event_id"], {"rows_before": F.col("rows"), "known_before": F.col("known")})
    total = rows.agg(F.count("*").alias("all_rows"), F.count("family").alias("all_known"))
    behind = ids.join(F.broadcast(total), F.lit(True)).select("event_id", (F.col("all_rows") - F.col("rows_before") - F.col("rows")).alias("behind"), (F.col("all_known") - F.col("known_before") - F.col("known")).alias("known_behind"))
    every = own.join(behind, "event_id").groupBy("family").agg(F.sum(F.col("c") * F.col("behind")).alias("every"), F.sum(F.col("c") * F.col("known_behind")).alias("known"))
    inside = running(own.filter("family is not null"), ["family"], ["event_id"], {"before": F.col("c")}).groupBy("family").agg(F.sum(F.col("c") * F.col("before")).alias("same"))
    known, same = F.when(F.col("family").isNotNull(), F.col("known")).otherwise(0), F.coalesce("same", F.lit(0))
    kinds = F.array(*[F.struct(F.lit(k).cast("boolean").alias("same_published_family"), n.cast("long").alias("n")) for k, n in ((True, same), (False, known - same), (None, F.col("every") - known))])
    out = every.join(inside, "family", "left").select(F.col("family").alias("reference_sequence_id"), F.explode(kinds).alias("k"))
    return out.select("reference_sequence_id", "k.*").filter("n > 0")


def family_scores(edges: DataFrame, population: DataFrame, opts: FamilyOptions = FamilyOptions()) -> DataFrame:
    """One row per event and family with an eligible anchor: the median of its best ``max_anchors`` pair scores.

    population: event_id, sequence_id, available. Families without an anchor have no row here; see
    :func:`all_family_scores`. Only available anchors count.
    """
    anchors = population.filter("available").select(F.col("event_id").alias("anchor_id"), F.col("sequence_id").alias("scored_sequence_id"))
    best = Window.partitionBy("event_id", "scored_sequence_id").orderBy(F.desc("score"), "anchor_id")
    ranked = edges.join(anchors, "anchor_id").withColumn("rank", F.row_number().over(best))
    counted = ranked.withColumn("n", F.count("*").over(Window.partitionBy("event_id", "scored_sequence_id")))
    return (
        counted.filter(F.col("rank") <= opts.max_anchors)
        .groupBy("event_id", "scored_sequence_id")
        .agg(F.median("score").alias("family_score"), F.max("n").alias("eligible_anchor_count"), F.count("*").alias("anchors_used"))
    )


def scores_of_top(top: DataFrame, opts: FamilyOptions = FamilyOptions()) -> DataFrame:
    """As :func:`family_scores` from what :func:`pairs.top_anchor_scores` keeps of each event and family; scores are rounded as margins are."""
    best = F.slice("top", 1, opts.max_anchors)
    if opts.digits is not None:
        best = F.transform(best, lambda x: F.round(x, opts.digits))
    rows = top.select("event_id", "scored_sequence_id", "eligible_anchor_count", best.alias("best"))
    n = F.size("best")
    middle = (F.get("best", F.floor((n - 1) / 2).cast("int")) + F.get("best", F.floor(n / 2).cast("int"))) / 2
    return rows.select("event_id", "scored_sequence_id", middle.alias("family_score"), "eligible_anchor_count", n.cast("long").alias("anchors_used"))


def all_family_scores(scores: DataFrame, population: DataFrame) -> DataFrame:
    """:func:`family_scores` with a row for every event and family, null and 0 where there is no anchor.

    The result has a row for each of them, so events meet all families; Spark sends the families to the events only if they are few.
    """
    families = population.select(F.col("sequence_id").alias("scored_sequence_id")).distinct()
    spine = population.select("event_id", F.col("sequence_id").alias("published_sequence_id")).join(families, F.lit(True))
    return spine.join(scores, ["event_id", "scored_sequence_id"], "left").fillna(0, ["eligible_anchor_count", "anchors_used"])


def classify(scores: DataFrame, population: DataFrame, opts: FamilyOptions = FamilyOptions()) -> DataFrame:
    """One row per event of the population: top and second family score, margin, prediction and its reason.

    Ties of scores go to the smaller family id. Events that are not available have no scores. Score and
    margin thresholds are inclusive.
    """
    order = Window.partitionBy("event_id").orderBy(F.desc("family_score"), "scored_sequence_id")
    top = (
        scores.filter("family_score is not null")
        .withColumn("rank", F.row_number().over(order))
        .filter("rank <= 2")
        .groupBy("event_id")
        .agg(
            F.max(F.when(F.col("rank") == 1, F.col("scored_sequence_id"))).alias("top"),
            F.max(F.when(F.col("rank") == 1, F.col("family_score"))).alias("one"),
            F.max(F.when(F.col("rank") == 2, F.col("family_score"))).alias("two"),
        )
    )
    rows = population.select("event_id", F.col("sequence_id").alias("published_sequence_id"), "available").join(top, "event_id", "left")
    shown = lambda c: F.when(F.col("available"), F.col(c))
    margin = F.col("top_family_score") - F.col("second_family_score")
    rows = rows.select("event_id", "published_sequence_id", F.col("available").alias("waveform_available"), shown("top").alias("top_sequence_id"), shown("one").alias("top_family_score"), shown("two").alias("second_family_score"))
    rows = rows.withColumn("classification_margin", F.round(margin, opts.digits) if opts.digits is not None else margin)
    reason = (
        F.when(F.col("top_family_score").isNull(), "event_waveform_unavailable")
        .when(F.col("top_family_score") < opts.min_score, "top_score_below_frozen_threshold")
        .when(F.col("classification_margin").isNull(), "fewer_than_two_family_scores")
        .when(F.col("classification_margin") < opts.min_margin, "top_two_families_within_frozen_margin")
        .otherwise("classified")
    )
    rows = rows.withColumn("classification_reason", reason)
    rows = rows.withColumn("predicted_sequence_id", F.when(F.col("classification_reason") == "classified", F.col("top_sequence_id").cast("string")).otherwise("abstain"))
    return rows.withColumn("correct", F.col("predicted_sequence_id") == F.col("published_sequence_id").cast("string"))


def per_family_metrics(classified: DataFrame) -> DataFrame:
    """Counts, precision, recall and F1 of every published label over available events; abstaining is a miss, 0/0 is 0."""
    labels = classified.select(F.col("published_sequence_id").cast("string").alias("sequence_id")).distinct()
    own = classified.filter("waveform_available").select(F.col("published_sequence_id").cast("string").alias("label"), F.col("predicted_sequence_id").alias("guess"))
    sides = own.select(F.col("label").alias("sequence_id"), (F.col("label") == F.col("guess")).cast("int").alias("tp"), F.lit(0).alias("fp"), (F.col("label") != F.col("guess")).cast("int").alias("fn"))
    wrong = own.filter("label <> guess").select(F.col("guess").alias("sequence_id"), F.lit(0).alias("tp"), F.lit(1).alias("fp"), F.lit(0).alias("fn"))
    counts = sides.unionByName(wrong).groupBy("sequence_id").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    rows = labels.join(counts, "sequence_id", "left").fillna(0, ["tp", "fp", "fn"])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    rows = rows.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return rows.select("sequence_id", F.col("tp").alias("true_positive"), F.col("fp").alias("false_positive"), F.col("fn").alias("false_negative_or_abstain"), "precision", "recall", f1.alias("f1"))


def classification_summary(classified: DataFrame, target: str) -> DataFrame:
    """One row of event-level metrics; ratios without cases are null."""
    have, published, guess, top = F.col("waveform_available"), F.col("published_sequence_id").cast("string"), F.col("predicted_sequence_id"), F.col("top_sequence_id").cast("string")
    n = lambda cond: F.count(F.when(cond, 1))
    is_target = published == target
    counts = classified.agg(
        n(F.lit(True)).alias("labeled_events"),
        n(have).alias("waveform_available_events"),
        n(have & (guess != "abstain")).alias("classified_events"),
        n(have & (guess == "abstain")).alias("abstained_available_events"),
        n(have & F.col("correct")).alias("correct_events"),
        n(have & is_target).alias("target_event_count"),
        n(have & is_target & (guess == target)).alias("target_hits"),
        n(have & ~is_target).alias("neighbor_event_count"),
        n(have & ~is_target & (guess == target)).alias("neighbor_to_target_overmerge_count"),
        n(have & (top == published)).alias("top_correct"),
        n(have & is_target & (top == target)).alias("top_target_hits"),
        n(have & ~is_target & (top == target)).alias("top_target_wrong"),
    )
    macro = per_family_metrics(classified).agg(F.avg("f1").alias("macro_f1_with_abstention_as_error"))
    ratio = lambda a, b: F.try_divide(F.col(a), b if not isinstance(b, str) else F.col(b))
    return counts.crossJoin(macro).select(
        "labeled_events", "waveform_available_events", "classified_events", "abstained_available_events",
        ratio("correct_events", "classified_events").alias("classified_accuracy"),
        ratio("correct_events", "waveform_available_events").alias("all_available_accuracy"),
        "macro_f1_with_abstention_as_error", "target_event_count",
        ratio("target_hits", "target_event_count").alias("target_recall"),
        ratio("target_hits", F.col("target_hits") + F.col("neighbor_to_target_overmerge_count")).alias("target_precision"),
        "neighbor_to_target_overmerge_count",
        ratio("neighbor_to_target_overmerge_count", "neighbor_event_count").alias("neighbor_to_target_overmerge_rate"),
        ratio("top_correct", "waveform_available_events").alias("top_family_accuracy"),
        ratio("top_target_hits", "target_event_count").alias("top_target_recall"),
        ratio("top_target_hits", F.col("top_target_hits") + F.col("top_target_wrong")).alias("top_target_precision"),
    )
