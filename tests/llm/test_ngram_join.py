import itertools
import random
import re
from collections import Counter, defaultdict

import pytest

from quakeloom.llm.ngram_join import _open, drop_near_copies, jaccard_components


def brute(docs, size, percent):
    sets = {}
    for i, x in docs:
        w = [y for y in re.split("[ \t\n\x0b\x0c\r]+", (x or "").translate({c: c + 32 for c in range(65, 91)})) if y]
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    inverted, common = defaultdict(list), Counter()
    for i, s in sets.items():
        for h in s:
            inverted[h].append(i)
    for ids in inverted.values():
        common.update(itertools.combinations(ids, 2))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), o in common.items():
        if 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def families(seed=5):
    """Star families (copies like their base, hardly like each other), chains, shared passages, short and odd texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6)))
    passage = [word() for _ in range(40)]
    docs = []
    for edits, copies, with_base in ((1, 25, True), (2, 60, True), (2, 60, False), (3, 60, True)):
        base = [word() for _ in range(150)]
        docs += [base] * with_base
        for _ in range(copies):
            x = list(base)
            for _ in range(edits):
                x[r.randrange(len(x))] = word()
            docs.append(x)
    x = [word() for _ in range(100)]
    for _ in range(30):
        x = list(x)
        x[r.randrange(len(x))] = word()
        docs.append(x)
    docs += [passage + [word() for _ in range(r.randint(0, 12))] for _ in range(80)]
    docs = [" ".join(x) for x in docs] + ["", None, "one", "ONE ", "two words", "a b c d", "A b\tc  d", "d c b a", "   "]
    order = list(range(len(docs)))
    r.shuffle(order)
    return [(10 + k, docs[i]) for k, i in enumerate(order)]


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80), (3, 60)])
def test_against_brute_force(spark, size, percent):
    docs = families(size)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df, size=size, percent=percent).collect()}
    assert got == brute(docs, size, percent)


def test_nulls_repeats_and_filter(spark):
    t = " ".join(f"w{k}" for k in range(60))
    rows = [(None, t, "x"), (3, t, "x"), (3, t, "x"), (2, t + " end", "x"), (9, None, "x"), (8, "", "x"), (7, "clean words stand here alone", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard_components(df).collect())
    assert got == [(0, 57, None), (2, 58, 2), (3, 57, 2), (3, 57, 2), (7, 2, 7), (8, 0, 8), (9, 0, 9)]
    kept = drop_near_copies(df)
    assert kept.columns == df.columns
    # rows are the documents, so the one with a null id stands for the group, as null ids come first
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 7, 8, 9]
    assert jaccard_components(df.filter("false")).count() == 0


def test_opened_groups_hold_every_text_of_a_repeated_id(spark):
    say = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    docs = spark.createDataFrame([(1, say("x", 90)), (1, say("y", 60)), (1, say("y", 60)), (2, say("y", 62)), (3, say("x", 92)), (4, say("z", 50))], "doc_id long, text string")
    grouped = spark.createDataFrame([(1, 1, 87), (1, 1, 57), (2, 2, 59), (3, 2, 89), (4, 2, 47)], "node long, grp long, n long")
    for small, large in ((1, 2), (2, 1)):
        apart = spark.createDataFrame([(small, large)], "small long, large long")
        got = {(min(r), max(r)) for r in map(tuple, _open(apart, grouped, docs, 4, 85).collect())}
        assert got == {(1, 2), (1, 3)}


def test_ids_of_text_are_integers_or_an_error(spark):
    text = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([("7", text), ("12", text)], "doc_id string, text string")
    assert {r.doc_id for r in jaccard_components(df).collect()} == {7, 12}
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        jaccard_components(df.unionByName(spark.createDataFrame([("x", text)], df.schema))).collect()
