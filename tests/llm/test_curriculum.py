import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quakeloom.llm.curriculum import FIVE_TWO_ONE, integral, mix, plan_mix, source_targets, training_time, word_count

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def reshared(sizes, weights, percent, most):
    """Targets by sharing, capping what is above, and sharing the excess again until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, target = min(sum(sizes.values()) * percent / 100, sum(sizes.values()) * most), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = most * sizes[s]
        open_ = [s for s in open_ if s not in over]
        left -= sum(target[s] for s in over)
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 20, "c": 30}, {"a": 1, "b": 1000, "c": 5, None: 4000, "d": 0}, {"z": 7}, {"a": 0, None: 0}, {"é": 50, "z": 3, "Z": 900, "😀": 80}])
def test_targets_against_repeated_sharing(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    for percent in (150, 20, 400):
        got = {r.source: r.target for r in source_targets(df, [5, 2, 1], percent, 2).collect()}
        want = reshared(sizes, [5, 2, 1], percent, 2)
        assert set(got) == set(want) and all(got[s] == pytest.approx(want[s], abs=1e-9) for s in want), (percent, got, want)


def _docs():
    r = random.Random(7)
    say = lambda n: "".join(r.choice(["word", "größe", " x", "y\x85"]) + r.choice([" ", "\n ", "\t"]) for _ in range(n))
    docs = [(k, " " * (k % 2) + say(r.randint(0, 12)), r.choice(["hot"] * 6 + ["b", "c", "", None])) for k in range(400)]
    return docs + [(400, None, "b"), (401, "", "hot"), (402, " \n", "only"), (None, "a b c", "hot"), (None, "a b c", "hot"), (3, "x y", "c"), (3, "x y", "c"), (403, say(5000), "long")]


def test_plan_against_brute_force(spark):
    docs = _docs()
    df = spark.createDataFrame([(*d, "q", 1.5) for d in docs], "doc_id long, text string, source string, target string, size double").repartition(3)
    out = plan_mix(df).collect()
    size = [(i, s, len(WORD.findall(t or ""))) for i, t, s in docs]
    sizes = defaultdict(int)
    for _, s, n in size:
        sizes[s] += n
    targets = reshared(sizes, [5, 2, 1], 150, 2)
    want = []
    for s in sizes:
        key = lambda x: hashlib.md5(f"42:{'' if x[0] is None else x[0]}".encode()).hexdigest()
        own = sorted(((i, n) for i, t, n in size if t == s), key=lambda x: (key(x), x[0] or 0, x[1]))
        asked, before = int(targets[s] + 0.5), 0
        for i, n in own:
            takes = [max(0, min(asked - k * sizes[s] - before, n)) for k in (0, 1)]
            want.append((i, s, n, sizes[s], sum(takes)))
            before += n
    assert sorted(((x.doc_id, x.source, x["size"], x.source_size, x.taken) for x in out), key=str) == sorted(want, key=str)
    for s in sizes:
        assert abs(sum(x.taken for x in out if x.source == s) - targets[s]) <= 0.5 and all(x.target == pytest.approx(targets[s]) for x in out if x.source == s)
    again = plan_mix(df.repartition(5)).collect()
    assert sorted(map(lambda x: str((x.doc_id, x.source, x["size"], x.taken, x.takes)), out)) == sorted(map(lambda x: str((x.doc_id, x.source, x["size"], x.taken, x.takes)), again))
    assert plan_mix(df.filter("false")).count() == 0 == mix(df.filter("false")).count()


def test_run_is_in_order_of_position(spark):
    docs = _docs()
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, source string, mix int").repartition(3)
    rows = mix(df).collect()
    at = [r.mix_position for r in rows]
    assert at == sorted(at) and 0 <= at[0] and at[-1] < 1
    taken = sum(r.taken for r in plan_mix(df).collect())
    assert sum(r.mix_words for r in rows) == taken and all(r.mix_words <= len(WORD.findall(r.text)) for r in rows)
    # at any time a source has given about what its integrated weight says
    order = sorted({d[2] for d in docs if WORD.findall(d[1] or "")} | {"only"}, key=lambda s: (s is None, s or ""))
    hot = [r for r in rows if r.source == "hot"]
    total, done = sum(r.mix_words for r in hot), 0
    schedule = FIVE_TWO_ONE[order.index("hot") % 3]
    (t0, w0), (_, w1) = schedule
    for r in hot:
        t = r.mix_position
        share = (w0 * t + (w1 - w0) * t * t / 2) / ((w0 + w1) / 2)
        assert done == pytest.approx(share * total, abs=1e-6)
        done += r.mix_words


def test_inverse_of_integrated_weights(spark):
    schedules = [((0, 0), (0.25, 0), (0.5, 4), (0.75, 0), (1, 0)), ((0, 1), (1, 1)), ((0, 0), (1, 3)), ((0, 3), (0.9, 0), (1, 6))]
    for k, schedule in enumerate(schedules):
        knots = integral(schedule)
        assert training_at(spark, [0.0], schedules, k)[0] == (0.25 if k == 0 else 0.0)
        xs = [j / 97 for j in range(1, 97)]
        for x, t in zip(xs, training_at(spark, xs, schedules, k)):
            i = max(i for i, n in enumerate(knots) if n[0] <= t)
            t0, w, slope, done = knots[i]
            assert done + w * (t - t0) + slope * (t - t0) ** 2 / 2 == pytest.approx(x * knots[-1][3], abs=1e-12)
    for bad in ([(0, 1)], [(0, 1), (0.5, 1)], [(0, -1), (1, 2)], [(0, 0), (1, 0)], [(0, 1), (0.7, 1), (0.7, 2), (1, 1)]):
        with pytest.raises(ValueError):
            integral(bad)


def training_at(spark, xs, schedules, k):
    df = spark.createDataFrame([(x, k) for x in xs], "x double, k int")
    return [r.t for r in df.select(training_time(F.col("x"), schedules, F.col("k")).alias("t")).collect()]


def test_words_of_one_space_only(spark):
    texts = ["", None, " ", "a", " a", "a ", "a b c", "\x85", "a\x0bb\x0cc", "x" * 10000 + " y", "\n\n", "  z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.n for r in df.select(word_count(F.col("t")).alias("n")).collect()] == [len(WORD.findall(t or "")) for t in texts]
