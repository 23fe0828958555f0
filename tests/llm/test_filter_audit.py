import random
import re
from collections import defaultdict
from fractions import Fraction
from itertools import permutations

import pytest

from quakeloom.llm.filter_audit import RemovalPolynomial, audit_filters, interactions


def test_polynomial_against_orders():
    r = random.Random(1)
    for n in (1, 3, 5):
        counts = [r.choice([0, 0, r.randint(0, 20)]) for _ in range(1 << n)]
        p = RemovalPolynomial(counts)
        for s in range(1 << n):
            assert p.corners[s] == sum(c for m, c in enumerate(counts) if m & s)
        for i in range(n):
            # a document's share is split evenly among the filters that it fails
            assert p.shapley(i) == sum((Fraction(c, m.bit_count()) for m, c in enumerate(counts) if m >> i & 1), Fraction(0))
        assert sum(p.shapley(i) for i in range(n)) == sum(counts[1:])


def test_interactions_of_a_part():
    rows = interactions("p", "AB", [5, 3, 2, 4], [0, 0, 0, 1], [0, 1, 0, 0])
    assert rows == [
        ("p", "AB", 1, 7, 7, 0, 3, 1, 1, 10), ("p", "AB", 2, 5, 2, 4, 2, 0, 0, 8),
        ("p", "BA", 1, 8, 6, 0, 2, 1, 0, 8), ("p", "BA", 2, 5, 3, 4, 3, 0, 1, 10),
    ]


def brute(docs, labels):
    """Every order walked document by document."""
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    fails = defaultdict(list)
    for i, t, s in docs:
        t, f = t or "", set()
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f |= {"A"} if len(w) < 50 else set()
        f |= {"B"} if 100 * len(set(w)) < 65 * len(w) else set()
        f |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t) else set()
        f |= {"D"} if re.search("[#$%&*|]", t) else set()
        f |= {"E"} if i is not None and i > least[t] else set()
        fails[s or ""].append((i, f))
    out, shares = {}, defaultdict(int)
    for part, own in fails.items():
        for order in permutations("ABCDE"):
            left = own
            for step, c in enumerate(order, 1):
                gone = [x for x in left if c in x[1]]
                left = [x for x in left if c not in x[1]]
                all_, only = [x for x in own if c in x[1]], [x for x in own if x[1] == {c}]
                lost = [sum(x[0] in s for x in gone) for s in (good, toxic)]
                out[part, "".join(order), step] = (len(left), len(gone), len(all_) - len(gone), len(only), *lost)
                shares[part, c] += len(gone)
    return sorted((*k, *v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def test_against_walks_of_every_order(spark):
    r = random.Random(2)
    say = lambda n, v: " ".join(r.choice(v) for _ in range(n))
    many, few = [f"w{k}" for k in range(200)] + ["Wort", "größe"], ["a", "bb", "CC"]
    texts = [say(r.choice([0, 3, 49, 50, 51, 80]), r.choice([many, few])) + r.choice(["", "", " #", " $ x", "  |"]) for _ in range(60)]
    docs = [(k, r.choice(texts), r.choice(["hot"] * 4 + ["b", "", None])) for k in range(250)]
    docs += [(300, None, "b"), (301, "", "b"), (302, " ", "only"), (None, texts[0], "hot"), (None, texts[0], "hot"), (None, None, None), (5, texts[1], "b"), (5, texts[1], "b"), (-1, texts[2], "c"), (400, "word " * 300_000, "c"), (401, "word " * 300_000, "c")]
    labels = [(k, r.choice([0, 1, None]), r.choice([0, 0, 1])) for k in range(0, 250, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    df = spark.createDataFrame([(*d, 0, "m") for d in docs], "doc_id long, text string, source string, quality int, mask string").repartition(3)
    lf = spark.createDataFrame([(*x, "t") for x in labels], "doc_id long, quality int, toxic int, text string")
    got = sorted(tuple(x) for x in audit_filters(df, lf).collect())
    assert got == brute(docs, labels)
    assert len(got) == 600 * len({d[2] or "" for d in docs})
    assert audit_filters(df.filter("false"), lf).count() == 0
    assert sum(x.good_lost + x.toxic_lost for x in audit_filters(df, lf.filter("false")).collect()) == 0
    ids = audit_filters(df.withColumn("doc_id", df.doc_id.cast("string")), lf.withColumn("doc_id", lf.doc_id.cast("string")), {"S": lambda t: t.contains("|")}, "X")
    assert {x.filter_order for x in ids.collect()} == {"SX", "XS"}
    with pytest.raises(ValueError):
        audit_filters(df, lf, duplicate="A")
