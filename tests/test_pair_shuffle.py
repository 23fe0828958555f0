"""What pair scores shuffle grows as their vectors do, though the pairs are quadratic."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quakeloom.operators import family, pairs


def shuffled(spark, run) -> int:
    """Records that the stages of ``run`` write for shuffles."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = lambda: store.stageList(spark._jvm.java.util.ArrayList(), False, False, gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    before = {stages().apply(k).stageId() for k in range(stages().size())}
    run()
    after = stages()
    return sum(after.apply(k).shuffleWriteRecords() * (after.apply(k).stageId() not in before) for k in range(after.size()))


def vectors(spark, n):
    return spark.range(n).select(F.col("id").cast("string").alias("id"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.sin(F.col("id") * i + 1)).alias("v"))


@pytest.mark.parametrize("name", ["correlation", "lagged", "family"])
def test_shuffle_grows_as_the_vectors(spark, name):
    def run(n):
        v = vectors(spark, n)
        population = v.select(F.col("id").alias("event_id"), (F.col("id").cast("int") % 4).alias("sequence_id"), F.lit(True).alias("available"))
        if name == "family":
            return pairs.top_anchor_scores(v, population, 2, 4)
        return pairs.pair_correlation(v, 4) if name == "correlation" else pairs.pair_lagged_peak(v, 1, 4)

    # when each block went to all others, the greater size with 8 times the blocks wrote some 8 times the records per vector
    small, large = (shuffled(spark, lambda n=n: run(n).write.format("noop").mode("overwrite").save()) / n for n in (200, 1600))
    assert large <= 1.3 * small


def test_family_shuffle_stays_in_proportion_when_tasks_hold_many_blocks(spark):
    def run(n):  # vectors without energy, so that only dealing them is work
        v = vectors(spark, n).withColumn("v", F.array_repeat(F.lit(1.0), 8))
        population = v.select(F.col("id").alias("event_id"), F.lit(0).alias("sequence_id"), F.lit(True).alias("available"))
        return pairs.top_anchor_scores(v, population, 2, 4)

    # when a task held 64 blocks at most, the greater size had 50 tasks for 24 and so twice the copies per vector
    small, large = (shuffled(spark, lambda n=n: run(n).write.format("noop").mode("overwrite").save()) / n for n in (1600, 12_800))
    assert large <= 1.1 * small


def test_pairs_of_many_cells_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(pairs, "HELD", 20 * 8 * 8)
    v = vectors(spark, 130).unionByName(vectors(spark, 3)).unionByName(spark.range(1).select(F.lit(None).cast("string").alias("id"), F.array_repeat(F.lit(1.0), 8).alias("v")))
    rows = [(r.a, r.b) for r in pairs.pair_correlation(v, 7).collect()]
    assert len(rows) == 133 * 132 // 2 and len(set(rows)) == 130 * 129 // 2 + 3 and all(a <= b for a, b in rows)


def test_pair_counts_are_those_of_all_pairs_without_making_them(spark):
    r = random.Random(3)
    rows = [(str(r.randrange(40)), r.choice(["a", "b", "c", None])) for _ in range(90)] + [(None, "a"), ("x", "alone")]
    got = {(x.reference_sequence_id, x.same_published_family): x.n for x in family.published_pair_counts(spark.createDataFrame(rows, "event_id string, sequence_id string")).collect()}
    known = [x for x in rows if x[0] is not None]
    assert got == Counter((f, None if f is None or g is None else f == g) for a, f in known for b, g in known if a < b)
    n = 400_000  # 8e10 pairs
    many = spark.range(n).select(F.lpad(F.col("id").cast("string"), 9, "0").alias("event_id"), F.lit("one").alias("sequence_id"))
    assert [tuple(x) for x in family.published_pair_counts(many).collect()] == [("one", True, n * (n - 1) // 2)]
