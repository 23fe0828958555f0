"""Rows of pairs are whole and right in whatever tiles they are made, and pack well where a query writes them."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quakeloom.operators import pairs
from quakeloom.plans import family_queries


@pytest.mark.parametrize("name", ["pair_correlation", "pair_lagged_peak"])
def test_written_pairs_take_few_bytes(spark, tmp_path, name):
    n = 2000
    v = np.random.default_rng(1).normal(size=(n, 64)).astype(np.float32)
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(v), pa.list_(pa.float32())), "label": pa.array(np.arange(n) % 10, pa.int32())}), tmp_path / "embeddings.parquet")
    getattr(family_queries, name)(spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert tuple(got.agg(F.count("*"), F.countDistinct("a", "b"), F.min(F.expr("int(a < b)"))).first()) == (n * (n - 1) // 2, n * (n - 1) // 2, 1)
    # in the order of ids a score took 8 bytes, and a row 8.3 of pair_correlation and 8.9 of pair_lagged_peak
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 6 * n * (n - 1) // 2


def peak(x, y, most):
    x, y = x - x.mean(), y - y.mean()
    scores = [sum(x[t + k] * y[t] for t in range(len(x)) if 0 <= t + k < len(x)) for k in range(-most, most + 1)]
    return max(scores) / np.sqrt((x * x).sum() * (y * y).sum()), int(np.argmax(scores)) - most


@pytest.mark.parametrize("digits", [None, 3])
@pytest.mark.parametrize("tile, block, held", [(4096, 2048, 1 << 26), (13, 20, 1 << 26), (13, 20, 640), (50, 7, 1 << 26)])
def test_pairs_of_any_tiles_are_those_of_numpy(spark, monkeypatch, tile, block, held, digits):
    monkeypatch.setattr(pairs, "TILE", tile)
    monkeypatch.setattr(pairs, "HELD", held)
    r = np.random.default_rng(2)
    v = {f"e{k}": r.normal(size=8) for k in range(90)} | {"flat": np.ones(8)}
    df = spark.createDataFrame([(k, x.tolist()) for k, x in v.items()], "id string, v array<double>").repartition(5)
    near = lambda x, y: abs(x - y) <= (1e-12 if digits is None else 0.5 * 10.0**-digits + 1e-12) and (digits is None or x == round(x, digits))
    for rows in (pairs.pair_correlation(df, block, digits).collect(), pairs.pair_lagged_peak(df, 3, block, digits).collect()):
        assert len(rows) == len({(x.a, x.b) for x in rows}) == 91 * 90 // 2
        for x in rows:
            assert x.a < x.b and (x.score is None) == (x.b == "flat")
            if x.score is not None and "lag" in x:
                score, lag = peak(v[x.a], v[x.b], 3)
                assert near(x.score, score) and x.lag == lag
            elif x.score is not None:
                assert near(x.score, np.corrcoef(v[x.a], v[x.b])[0, 1])


def test_scores_without_a_number_and_ties(spark):
    one, two = np.array([[3.0, np.nan], [np.inf, -np.inf]]), pa.array(["a", "b"])
    rows = [x for b in pairs._tile((two, one), (pa.array(["c", "d"]), one), False, lambda x, y: [x], ["score"], 6) for x in b.to_pylist()]
    assert [(x["a"], x["b"], x["score"]) for x in rows] == [("b", "d", -np.inf), ("a", "c", 3.0), ("b", "c", np.inf), ("a", "d", None)]
    halves = np.array([[0.5, -0.5], [1.5, -0.25]])
    rows = [x for b in pairs._tile((two, halves), (pa.array(["c", "d"]), halves), False, lambda x, y: [x], ["score"], 0) for x in b.to_pylist()]
    assert [str(x["score"]) for x in rows] == ["-1.0", "0.0", "1.0", "2.0"]  # half away from zero as in the SQL, and no negative zero
    with pytest.raises(ValueError):
        pairs.pair_correlation(spark.range(2).select(F.col("id"), F.array(F.lit(1.0)).alias("v")), digits=20)
