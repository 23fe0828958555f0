"""Carries, ranks and order statistics against plain ones, on groups that one task could not be trusted with."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quakeloom.operators import ordered

SPECIAL = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.0**-1022, 1.7976931348623157e308, -1.7976931348623157e308, float("inf"), float("-inf"), float("nan"), 0.1, 0.30000000000000004, 1e-310, 3.0, 1.9999999999999998, 2.0, 4503599627370497.0]


@pytest.fixture
def eight(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_bits_order_as_doubles(spark):
    r = random.Random(1)
    values = SPECIAL + [r.uniform(-1, 1) * 10.0 ** r.randint(-320, 308) for _ in range(3000)] + [2.0**k for k in range(-1074, 1024, 7)] + [math.nextafter(2.0**k, 0) for k in range(-1000, 1000, 13)]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", ordered.order_bits(F.col("x")).alias("b"))
    rows = sorted(df.collect(), key=lambda t: t.b)
    for one, two in zip(rows, rows[1:]):
        assert (one.b == two.b) == (one.x == two.x or (math.isnan(one.x) and math.isnan(two.x)))
        assert math.isnan(two.x) or one.x <= two.x


@pytest.mark.parametrize("keys, few", [([], 0), (["k"], 0), (["k"], 100), (["k"], ordered.FEW)])
def test_quantiles_equal_percentile(eight, keys, few):
    r = random.Random(2)
    rows = [("hot", r.gauss(0, 1)) for _ in range(3000)] + [("ties", r.choice([1.5, -2.0, 7.0])) for _ in range(501)] + [("one", 3.25), ("none", None), (None, 1.0), (None, 2.0), (None, None), ("odd", -0.0), ("odd", float("inf")), ("odd", float("inf"))]
    rows += [("wide", 10.0 ** r.randint(-300, 300)) for _ in range(400)] + [("nan", float("nan")), ("nan", 1.0), ("nan", 2.0)]
    df = eight.createDataFrame(rows, "k string, x double").repartition(5)
    probs = {"p10": 0.1, "median": 0.5, "p95": 0.95, "top": 1.0, "low": 0.0}
    want = df.groupBy(*keys).agg(F.count("x").alias("n"), *[F.percentile("x", p).alias(name) for name, p in probs.items()])
    one, two = (sorted((tuple(x) for x in d.select(*keys, "n", *probs).collect()), key=str) for d in (ordered.exact_quantiles(df, keys, "x", probs, few), want))
    assert len(one) == len(two)
    for a, b in zip(one, two):
        for x, y in zip(a, b):
            assert x == y or (isinstance(x, float) and (math.isnan(x) and math.isnan(y) or math.isclose(x, y, rel_tol=1e-12)))
    empty = ordered.exact_quantiles(df.filter("false"), ["k"], "x", {"m": 0.5})
    assert empty.columns == ["k", "n", "m"] and empty.count() == 0
    assert [tuple(x) for x in ordered.exact_quantiles(df.filter("false"), [], "x", {"m": 0.5}).collect()] == [(0, None)]


def test_running_sums_and_ranks_cross_partitions(eight):
    r = random.Random(3)
    rows = [(r.choice(["a", "a", "a", "b", None]), k, r.randint(0, 9) if r.random() < 0.9 else None) for k in range(2000)]
    df = eight.createDataFrame(rows, "k string, i int, v int").repartition(3)
    assert ordered.ranged(df, ["k"], ["i"]).select(ordered.PART).distinct().count() > 4
    w = Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("k", "i", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s"), (F.row_number().over(Window.partitionBy("k").orderBy("i")) - 1).alias("at"))
    got = ordered.running(df, ["k"], ["i"], {"s": F.col("v"), "at": F.lit(1)}).select("k", "i", "s", "at")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    alone = ordered.global_rank(df, [], ["i"], "at")
    assert all(x.i == x["at"] for x in alone.collect())
    assert ordered.global_rank(df.filter("false"), ["k"], ["i"], "at").count() == 0


@pytest.mark.parametrize("own", [True, False])
def test_carried_values_cross_partitions_without_one(eight, own):
    r = random.Random(4)
    rows = [(r.choice(["hot", "hot", "hot", "b"]), k, f"s{k}" if k % 700 == 3 else None) for k in range(3000)]
    df = eight.createDataFrame(rows, "k string, i int, v string").repartition(3)
    w = Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    want = df.select("k", "i", F.last("v", ignorenulls=True).over(w).alias("c"))
    got = ordered.carry_forward(df, ["k"], ["i"], {"c": F.col("v")}, include_own=own).select("k", "i", "c")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_lines_of_a_file_in_splits(eight, tmp_path):
    from quakeloom.sources.text import lines_of

    before = eight.conf.get("spark.sql.files.maxPartitionBytes")
    lines = [f"line {k} " + "x" * (k % 40) if k % 9 else "" for k in range(4000)]
    (tmp_path / "one.txt").write_bytes("\r\n".join(lines).encode())
    (tmp_path / "two.txt").write_text("a\nb\n")
    try:
        eight.conf.set("spark.sql.files.maxPartitionBytes", "20k")
        assert eight.read.text(str(tmp_path / "one.txt")).rdd.getNumPartitions() > 4
        rows = lines_of(eight, str(tmp_path)).collect()
    finally:
        eight.conf.set("spark.sql.files.maxPartitionBytes", before)
    one = sorted((r.pos, r.value) for r in rows if r.file.endswith("one.txt"))
    assert one == list(enumerate(lines)) and sorted((r.pos, r.value) for r in rows if r.file.endswith("two.txt")) == [(0, "a"), (1, "b")]
