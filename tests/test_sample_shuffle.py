"""Of the rows that a uniform sample is drawn from, only those in ranges with a wanted row are dealt a second time."""

from pyspark.sql import functions as F

from quakeloom.operators import coverage
from tests.test_pair_shuffle import shuffled


def test_only_ranges_with_a_wanted_row_are_put_in_order(spark):
    n = 400_000
    rows = spark.range(n, numPartitions=4).select(F.lit("a").alias("source"), F.lpad(F.col("id").cast("string"), 9, "0").alias("path"))
    got = []
    moved = shuffled(spark, lambda: got.extend(coverage.uniform_sample(rows, ["source"], ["path"], 3).collect()))
    assert sorted((r.path, r.file_count) for r in got) == [(f"{k:09d}", n) for k in (0, 200_000, n - 1)]
    assert moved < 1.7 * n, moved / n
