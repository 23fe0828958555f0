"""Overlaps of intervals of every length against all pairs."""

import random

import pytest

from quakeloom.operators import intervals


@pytest.mark.parametrize("base", [1.0, 60.0, 1e5])
def test_mixed_spans_equal_all_pairs(spark, base):
    r = random.Random(1)
    lengths = [0.0, 0.01, 1.0, 59.9, 60.0, 61.0, 3600.0, 86400.0, 31e6, 3e8]
    make = lambda n: [(k, a := r.choice([r.uniform(-5e6, 5e6), r.uniform(0, 500.0), 60.0 * r.randint(0, 20)]), a + r.choice(lengths)) for k in range(n)]
    one, two = make(250) + [(900, None, 5.0), (901, 10.0, 5.0), (902, 5.0, None)], make(250) + [(900, 7.0, None), (901, 30.0, -1e9)]
    a = spark.createDataFrame(one, "i long, ls double, le double").repartition(3)
    b = spark.createDataFrame(two, "j long, rs double, re double").repartition(2)
    got = sorted((x.i, x.j) for x in intervals.overlap_join(a, b, ("ls", "le", "rs", "re"), base).collect())
    ok = lambda x: x[1] is not None and x[2] is not None and x[2] >= x[1]
    want = sorted((i, j) for i, a, z in filter(ok, one) for j, b, y in filter(ok, two) if b < z and y > a)
    assert len(want) > 500 and got == want
    assert intervals.overlap_join(a.filter("false"), b, ("ls", "le", "rs", "re")).count() == 0 == intervals.overlap_join(a, b.filter("false"), ("ls", "le", "rs", "re")).count()


def test_a_year_makes_few_rows(spark):
    year = spark.createDataFrame([("y", 0.0, 31_536_000.0)], "event_id string, start_s double, end_s double")
    files = spark.range(5000).selectExpr("cast(id as string) as path", "id * 60.0D as start_s", "id * 60.0D + 60.0D as end_s", "id * 60.0D as stamp_s")
    plan = intervals.overlap_join(year.toDF("e", "ws", "we"), files.toDF("p", "fs", "fe", "st"), ("ws", "we", "fs", "fe"))
    assert plan.count() == 5000
    shown = plan._jdf.queryExecution().toString()
    assert "NestedLoop" not in shown and "Cartesian" not in shown
    row = intervals.interval_overlap(year, files).collect()[0]
    assert row.file_count == 5000 and row.coverage_status == "CONDITIONAL" and not row.complete


def test_files_are_looked_at_by_their_stamp_first(spark):
    w = spark.createDataFrame([("e", 100.0, 130.0)], "event_id string, start_s double, end_s double")
    f = spark.createDataFrame([("near", 90.0, 150.0, 90.0), ("misnamed", 90.0, 150.0, 10.0), ("unnamed", 90.0, 150.0, None)], "path string, start_s double, end_s double, stamp_s double")
    assert intervals.interval_overlap(w, f).collect()[0].source_files == "near"
