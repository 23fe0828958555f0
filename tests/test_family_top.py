"""Best anchors kept inside the pair kernel against those of all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakeloom.operators import family, pairs


@pytest.mark.parametrize("block, stripe", [(512, 64), (7, 2), (16, 1), (5, 100)])
def test_top_of_blocks_equals_top_of_all_pairs(spark, block, stripe):
    r = random.Random(block)
    rows = [(f"e{k}", [r.gauss(0, 1) for _ in range(6)] if k % 13 else [2.0] * 6, r.choice(["a", "a", "a", "b", "c", None, f"own{k}"]), r.choice([True, True, False, None])) for k in range(90)]
    df = spark.createDataFrame(rows, "id string, v array<double>, sequence_id string, available boolean").repartition(3)
    vectors, population = df.select("id", "v"), df.select(F.col("id").alias("event_id"), "sequence_id", "available").filter("event_id <> 'e5'")
    opts = family.FamilyOptions(max_anchors=3, digits=6)
    edges = family.symmetric_edges(pairs.pair_correlation(vectors).withColumn("score", F.round("score", 6)))
    want = family.family_scores(edges, population, opts)
    top = pairs.top_anchor_scores(vectors, population, 3, block, stripe)
    got = family.scores_of_top(top, opts)
    one, two = (sorted(((x.event_id, x.scored_sequence_id, round(x.family_score, 9), x.eligible_anchor_count, x.anchors_used) for x in d.collect()), key=str) for d in (got, want))
    assert one == two and len(one) > 300
    assert all(t == sorted(t, reverse=True) and len(t) <= 3 for (t,) in top.select("top").collect())


def test_kernel_gives_no_row_per_pair(spark):
    rows = spark.range(600).select(F.col("id").cast("string").alias("id"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.sin(F.col("id") * i)).alias("v"))
    population = rows.select(F.col("id").alias("event_id"), (F.col("id").cast("int") % 4).alias("sequence_id"), F.lit(True).alias("available"))
    assert pairs.top_anchor_scores(rows, population, 2, 64, 4).count() == 599 * 4  # one vector has no energy
    assert pairs.top_anchor_scores(rows.filter("false"), population, 2).count() == 0 == pairs.top_anchor_scores(rows, population.filter("false"), 2).count()


def test_scores_that_single_precision_cannot_tell_apart():
    r = np.random.default_rng(5)
    units = pairs._unit(r.normal(size=(1, 16)) + 1e-5 * r.normal(size=(300, 16)))
    scores = units @ units.T
    assert len(np.unique(scores.astype(np.float32))) < 100 < len(np.unique(scores)) // 100
    np.fill_diagonal(scores, -np.inf)
    ids = [str(k) for k in range(300)]
    best = pairs._Best(ids, units, 3, 64)
    for lo in range(0, 300, 50):
        best.add(ids[lo : lo + 50], units[lo : lo + 50], [k % 4 for k in range(lo, lo + 50)])
    for family in range(4):
        want = np.sort(scores[:, family::4], axis=1)[:, -3:]
        assert np.abs(best.top[family] - want).max() < 1e-15 and (best.count[family] == 75 - (np.arange(300) % 4 == family)).all()
