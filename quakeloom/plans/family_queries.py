"""Pair scores and family classification, with vectors as traces and labels as families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.operators import family, gates, pairs

#: Thresholds that make every reason occur on the test vectors.
OPTS = family.FamilyOptions(max_anchors=3, min_score=0.28, min_margin=0.02, digits=6)
PAIR_OPTS = pairs.PairOptions(min_components=3, min_stations=3, family_median=0.1, family_weakest_band=0.0)
BANDS = ["0.0-16.0Hz", "16.0-32.0Hz", "32.0-48.0Hz", "48.0-64.0Hz"]


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.pair_correlation(_vectors(spark, d).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), digits=6)


def _population(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select(F.col("vec_id").cast("string").alias("event_id"), F.col("label").cast("string").alias("sequence_id"), (F.col("vec_id") % 10 != 0).alias("available"))


def _scores(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    population = _population(spark, d)
    v = _vectors(spark, d).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    s = family.scores_of_top(pairs.top_anchor_scores(v, population, OPTS.max_anchors), OPTS)
    return s.withColumn("family_score", F.round("family_score", 6)), population


def pair_correlation(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d)


def pair_lagged_peak(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return pairs.pair_lagged_peak(v, 8, digits=6)


def loo_scores(spark: SparkSession, d: str) -> DataFrame:
    s, population = _scores(spark, d)
    return family.all_family_scores(s, population)


def _classified(spark: SparkSession, d: str) -> DataFrame:
    return family.classify(*_scores(spark, d), OPTS)


def loo_family_classification(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d)


def per_family_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = family.per_family_metrics(_classified(spark, d))
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


def classification_summary(spark: SparkSession, d: str) -> DataFrame:
    out = family.classification_summary(_classified(spark, d), "3")
    return out.withColumns({c: F.round(c, 6) for c, t in out.dtypes if t == "double"})


def reason_counts(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d).groupBy("classification_reason").agg(F.count("*").alias("n"))


def availability_pivot(spark: SparkSession, d: str) -> DataFrame:
    p = _population(spark, d)
    return p.groupBy("sequence_id").agg(F.count(F.when(F.col("available"), 1)).alias("available_events"), F.count(F.when(~F.col("available"), 1)).alias("missing_events"))


def threshold_sandbox(spark: SparkSession, d: str) -> DataFrame:
    c = _classified(spark, d).filter("waveform_available")
    right = F.col("top_sequence_id") == F.col("published_sequence_id")
    return gates.threshold_sandbox(c, F.col("top_family_score"), F.col("classification_margin"), right, [0.25, 0.3, 0.35], [0.0, 0.02, 0.05])


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    """Four slices of each vector as bands, against the next vector of its label in id order; the slice's station by id."""
    from pyspark.sql import Window

    v = _vectors(spark, d).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    w = Window.partitionBy("label").orderBy("vec_id")
    both = v.withColumn("other", F.lead("e").over(w)).filter("other is not null")
    rows = both.select("label", "vec_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"), "e", "other")
    cut = lambda c: F.slice(c, F.col("k") * 16 + 1, F.lit(16))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    centred = lambda a: F.transform(a, lambda x: x - total(a) / 16)
    rows = rows.select("label", "vec_id", "k", centred(cut("e")).alias("a"), centred(cut("other")).alias("b"))
    dot = lambda a, b: total(F.zip_with(a, b, lambda x, y: x * y))
    c = dot("a", "b") / F.sqrt(dot("a", "a") * dot("b", "b"))
    return rows.select(
        F.concat(F.lit("label_"), F.col("label").cast("string")).alias("pair_name"),
        F.concat((F.col("k") * 16).cast("double").cast("string"), F.lit("-"), (F.col("k") * 16 + 16).cast("double").cast("string"), F.lit("Hz")).alias("band"),
        (F.col("vec_id") % 4).alias("station"), F.round(c, 6).alias("correlation"), (F.col("vec_id") % 3 != 0).alias("usable"),
    )


def pair_band_summary(spark: SparkSession, d: str) -> DataFrame:
    out = pairs.band_summary(_metrics(spark, d), BANDS)
    return out.withColumns({c: F.round(c, 6) for c in ("median_correlation", "minimum_correlation", "p10_correlation")})


def pair_decision(spark: SparkSession, d: str) -> DataFrame:
    out = pairs.pair_decision(_metrics(spark, d), BANDS, PAIR_OPTS)
    return out.withColumns({c: F.round(c, 6) for c in ("overall_median_correlation", "weakest_band_median_correlation")})


def station_lag_range(spark: SparkSession, d: str) -> DataFrame:
    """Peak-to-peak of station medians, in thousandths, of each pair."""
    m = _metrics(spark, d).filter("usable").groupBy("pair_name", "station").agg(F.median("correlation").alias("m"))
    return m.groupBy("pair_name").agg(F.round(1000 * (F.max("m") - F.min("m")), 6).alias("peak_to_peak"), F.count("*").alias("stations"))


_P = """
WITH v AS (SELECT vec_id::VARCHAR AS id, label::VARCHAR AS label, vec_id % 10 <> 0 AS avail, embedding::DOUBLE[] AS e FROM embeddings),
z AS (SELECT id, label, avail, list_transform(e, lambda x: x - list_avg(e)) AS z FROM v),
n AS (SELECT *, sqrt(list_dot_product(z, z)) AS nn FROM z),
p AS (SELECT a.id AS a, b.id AS b, round(list_dot_product(a.z, b.z) / (a.nn * b.nn), 6) + 0.0::DOUBLE AS score FROM n a JOIN n b ON a.id < b.id)
"""
_S = _P + """,
e AS (SELECT a AS ev, b AS anc, score FROM p UNION ALL SELECT b, a, score FROM p),
r AS (SELECT ev, v.label AS fam, score, row_number() OVER (PARTITION BY ev, v.label ORDER BY score DESC, anc) AS rn,
             count(*) OVER (PARTITION BY ev, v.label) AS n FROM e JOIN v ON v.id = anc AND avail),
f AS (SELECT ev, fam, round(median(score), 6) AS score, max(n) AS n, count(*) AS used FROM r WHERE rn <= 3 GROUP BY ev, fam)
"""
_C = _S + """,
k AS (SELECT *, row_number() OVER (PARTITION BY ev ORDER BY score DESC, fam) AS rk FROM f),
c0 AS (SELECT v.id AS event_id, v.label AS published_sequence_id, avail AS waveform_available, CASE WHEN avail THEN a.fam END AS top_sequence_id,
       CASE WHEN avail THEN a.score END AS top_family_score, CASE WHEN avail THEN b.score END AS second_family_score
  FROM v LEFT JOIN k a ON a.ev = v.id AND a.rk = 1 LEFT JOIN k b ON b.ev = v.id AND b.rk = 2),
c1 AS (SELECT *, round(top_family_score - second_family_score, 6) AS classification_margin FROM c0),
c2 AS (SELECT *, CASE WHEN top_family_score IS NULL THEN 'event_waveform_unavailable' WHEN top_family_score < 0.28::DOUBLE THEN 'top_score_below_frozen_threshold'
  WHEN classification_margin IS NULL THEN 'fewer_than_two_family_scores' WHEN classification_margin < 0.02::DOUBLE THEN 'top_two_families_within_frozen_margin'
  ELSE 'classified' END AS classification_reason FROM c1),
c3 AS (SELECT *, CASE WHEN classification_reason = 'classified' THEN top_sequence_id ELSE 'abstain' END AS predicted_sequence_id FROM c2),
c AS (SELECT *, predicted_sequence_id = published_sequence_id AS correct FROM c3)
"""
_F = _C + """,
cnt AS (SELECT l.label AS sequence_id,
  count(*) FILTER (WHERE published_sequence_id = l.label AND predicted_sequence_id = l.label) AS tp,
  count(*) FILTER (WHERE published_sequence_id <> l.label AND predicted_sequence_id = l.label) AS fp,
  count(*) FILTER (WHERE published_sequence_id = l.label AND predicted_sequence_id <> l.label) AS fn
  FROM (SELECT DISTINCT label FROM v) l LEFT JOIN (SELECT * FROM c WHERE waveform_available) x ON true GROUP BY l.label),
pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pp, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS rr FROM cnt),
fam AS (SELECT sequence_id, tp AS true_positive, fp AS false_positive, fn AS false_negative_or_abstain, pp, rr, CASE WHEN pp + rr > 0 THEN 2 * pp * rr / (pp + rr) ELSE 0 END AS f1 FROM pr)
"""
_M = """
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, lead(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS o FROM embeddings),
s AS (SELECT label, vec_id, k, e[k * 16 + 1:k * 16 + 16] AS a, o[k * 16 + 1:k * 16 + 16] AS b FROM v, (SELECT unnest(range(0, 4)) AS k) WHERE o IS NOT NULL),
q AS (SELECT label, vec_id, k, list_transform(a, lambda x: x - list_avg(a)) AS a, list_transform(b, lambda x: x - list_avg(b)) AS b FROM s),
m AS (SELECT 'label_' || label AS pair_name, (k * 16) || '.0-' || (k * 16 + 16) || '.0Hz' AS band, vec_id % 4 AS station,
  round(list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)), 6) + 0.0::DOUBLE AS correlation, vec_id % 3 <> 0 AS usable FROM q),
sp AS (SELECT pair_name, band FROM (SELECT DISTINCT pair_name FROM m), (SELECT unnest(['0.0-16.0Hz', '16.0-32.0Hz', '32.0-48.0Hz', '48.0-64.0Hz']) AS band)),
bs AS (SELECT sp.pair_name, sp.band, count(correlation) AS usable_components, count(DISTINCT station) AS usable_stations, median(correlation) AS med,
  min(correlation) AS lo, quantile_cont(correlation, 0.1) AS p10 FROM sp LEFT JOIN (SELECT * FROM m WHERE usable) u ON u.pair_name = sp.pair_name AND u.band = sp.band GROUP BY 1, 2)
"""
_ROUND = "round({0}, 6) AS {1}"

QUERIES = {
    f.__name__: f
    for f in (
        loo_family_classification, loo_scores, classification_summary, per_family_metrics, pair_correlation, pair_lagged_peak, pair_band_summary,
        pair_decision, reason_counts, availability_pivot, threshold_sandbox, station_lag_range,
    )
}

SQL = {
    "pair_correlation": _P + "SELECT * FROM p",
    "loo_scores": _S
    + """SELECT v.id AS event_id, v.label AS published_sequence_id, l.label AS scored_sequence_id, f.score AS family_score, coalesce(f.n, 0) AS eligible_anchor_count,
         coalesce(f.used, 0) AS anchors_used FROM v, (SELECT DISTINCT label FROM v) l LEFT JOIN f ON f.ev = v.id AND f.fam = l.label""",
    "loo_family_classification": _C + "SELECT * FROM c",
    "reason_counts": _C + "SELECT classification_reason, count(*) AS n FROM c GROUP BY 1",
    "per_family_metrics": _F + "SELECT sequence_id, true_positive, false_positive, false_negative_or_abstain, round(pp, 6)::DOUBLE AS precision, round(rr, 6)::DOUBLE AS recall, round(f1, 6)::DOUBLE AS f1 FROM fam",
    "classification_summary": _F
    + """, t AS (SELECT count(*) AS n, count(*) FILTER (WHERE waveform_available) AS av, count(*) FILTER (WHERE waveform_available AND predicted_sequence_id <> 'abstain') AS cl,
  count(*) FILTER (WHERE waveform_available AND correct) AS ok, count(*) FILTER (WHERE waveform_available AND published_sequence_id = '3') AS tg,
  count(*) FILTER (WHERE waveform_available AND published_sequence_id = '3' AND predicted_sequence_id = '3') AS hit,
  count(*) FILTER (WHERE waveform_available AND published_sequence_id <> '3') AS nb, count(*) FILTER (WHERE waveform_available AND published_sequence_id <> '3' AND predicted_sequence_id = '3') AS ov,
  count(*) FILTER (WHERE waveform_available AND top_sequence_id = published_sequence_id) AS topok,
  count(*) FILTER (WHERE waveform_available AND published_sequence_id = '3' AND top_sequence_id = '3') AS toph,
  count(*) FILTER (WHERE waveform_available AND published_sequence_id <> '3' AND top_sequence_id = '3') AS topw FROM c)
SELECT n AS labeled_events, av AS waveform_available_events, cl AS classified_events, av - cl AS abstained_available_events, round(ok / nullif(cl, 0), 6) AS classified_accuracy,
  round(ok / nullif(av, 0), 6) AS all_available_accuracy, (SELECT round(avg(f1), 6) FROM fam) AS macro_f1_with_abstention_as_error, tg AS target_event_count,
  round(hit / nullif(tg, 0), 6) AS target_recall, round(hit / nullif(hit + ov, 0), 6) AS target_precision, ov AS neighbor_to_target_overmerge_count,
  round(ov / nullif(nb, 0), 6) AS neighbor_to_target_overmerge_rate, round(topok / nullif(av, 0), 6) AS top_family_accuracy, round(toph / nullif(tg, 0), 6) AS top_target_recall,
  round(toph / nullif(toph + topw, 0), 6) AS top_target_precision FROM t""",
    "availability_pivot": "SELECT label::VARCHAR AS sequence_id, count(*) FILTER (WHERE vec_id % 10 <> 0) AS available_events, count(*) FILTER (WHERE vec_id % 10 = 0) AS missing_events FROM embeddings GROUP BY label",
    "threshold_sandbox": _C
    + """, g AS (SELECT s::DOUBLE AS min_score, m::DOUBLE AS min_margin FROM (SELECT unnest([0.25, 0.3, 0.35]) AS s), (SELECT unnest([0.0, 0.02, 0.05]) AS m))
SELECT min_score, min_margin, count(*) FILTER (WHERE coalesce(top_family_score >= min_score AND classification_margin >= min_margin, false)) AS accepted,
  count(*) FILTER (WHERE NOT coalesce(top_family_score >= min_score AND classification_margin >= min_margin, false)) AS abstained,
  count(*) FILTER (WHERE coalesce(top_family_score >= min_score AND classification_margin >= min_margin, false) AND top_sequence_id = published_sequence_id) AS accepted_right
FROM c, g WHERE waveform_available GROUP BY 1, 2""",
    "pair_lagged_peak": """
WITH v AS (SELECT vec_id::VARCHAR AS id, embedding::DOUBLE[] AS e FROM embeddings),
z AS (SELECT id, list_transform(e, lambda x: x - list_avg(e)) AS z FROM v), n AS (SELECT *, sqrt(list_dot_product(z, z)) AS nn FROM z),
l AS (SELECT a.id AS a, b.id AS b, k, list_dot_product(a.z[1 + greatest(k, 0):64 + least(k, 0)], b.z[1 + greatest(-k, 0):64 - greatest(k, 0)]) / (a.nn * b.nn) AS s
      FROM n a JOIN n b ON a.id < b.id, (SELECT unnest(range(-8, 9)) AS k))
SELECT a, b, round(s, 6) + 0.0::DOUBLE AS score, k AS lag FROM l QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY s DESC, k) = 1""",
    "pair_band_summary": _M + "SELECT pair_name, band, usable_components, usable_stations, round(med, 6) AS median_correlation, round(lo, 6) AS minimum_correlation, round(p10, 6) AS p10_correlation FROM bs",
    "pair_decision": _M
    + """, w AS (SELECT pair_name, min(usable_components) AS mc, min(usable_stations) AS ms, min(med) AS weak FROM bs GROUP BY 1),
o AS (SELECT pair_name, median(correlation) AS med, count(*) AS n FROM m WHERE usable GROUP BY 1)
SELECT w.pair_name, mc AS minimum_components_per_band, ms AS minimum_stations_per_band, round(weak, 6) AS weakest_band_median_correlation, round(med, 6) AS overall_median_correlation,
  coalesce(n, 0) AS usable_metric_count, CASE WHEN mc >= 3 AND ms >= 3 AND coalesce(med >= 0.1::DOUBLE AND weak >= 0.0::DOUBLE, false) THEN 'family' WHEN mc >= 3 AND ms >= 3 THEN 'not_family' ELSE 'insufficient_data' END AS decision,
  CASE WHEN mc >= 3 AND ms >= 3 THEN 'PASS' ELSE 'STOP' END AS status FROM w LEFT JOIN o USING (pair_name)""",
    "station_lag_range": _M
    + ", t AS (SELECT pair_name, station, median(correlation) AS x FROM m WHERE usable GROUP BY 1, 2) SELECT pair_name, round(1000 * (max(x) - min(x)), 6) AS peak_to_peak, count(*) AS stations FROM t GROUP BY 1",
}
