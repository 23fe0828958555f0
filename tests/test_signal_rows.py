"""Signal kernels over batches of many rows: a bounded number at once, each with the result that it has alone."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quakeloom.operators import signal


def test_a_kernel_gets_a_bounded_number_of_rows():
    rows = pd.Series([None if k % 7 == 0 else np.full(20, float(k)) for k in range(5000)] + [np.ones(3)])
    seen = []

    def double(x):
        seen.append(len(x))
        return (x * 2)[:, 1:-1]

    out = signal._by_length(rows, double)
    assert max(seen) <= 1024 and sum(seen) == rows.notna().sum()
    assert all(y is None if x is None else (y == 2 * x[1:-1]).all() for x, y in zip(rows, out, strict=True))
    # what is kept of a slice is what was asked for
    assert max(y.base.nbytes if y.base is not None else y.nbytes for y in out if y is not None) <= 1024 * 18 * 8


def test_lagged_peaks_of_many_rows_are_those_of_each(spark):
    r = np.random.default_rng(2)
    rows = []
    for k in range(2500):
        a, b = (r.normal(size=r.choice([1, 2, 9, 30])).tolist() for _ in range(2))
        rows.append((k, None if k % 11 == 0 else [] if k % 13 == 0 else [4.0] * len(a) if k % 17 == 0 else a, None if k % 19 == 0 else b))
    df = spark.createDataFrame(rows, "k long, a array<double>, b array<double>").coalesce(1)
    got = {x.k: x.p for x in df.select("k", signal.lagged_peak(F.col("a"), F.col("b"), 10.0, 0.3).alias("p")).collect()}
    assert len(got) == len(rows)
    for k, a, b in rows:
        n = min(len(a or []), len(b or []))
        x, y = (np.array((v or [])[:n]) - (np.mean(v[:n]) if n else 0) for v in (a, b))
        norm = np.sqrt((x @ x) * (y @ y))
        if norm <= 0:
            assert got[k] is None or got[k].correlation is None and got[k].lag_s is None
            continue
        reach = min(3, n - 1)
        near = (np.correlate(x, y, "full") / norm)[n - 1 - reach : n + reach]
        assert got[k].correlation == pytest.approx(near.max(), abs=1e-12)
        assert near[reach + round(got[k].lag_s * 10)] == pytest.approx(near.max(), abs=1e-12)
