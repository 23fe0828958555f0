import random
import re
from collections import defaultdict

import pytest

from quakeloom.llm.suffix_dedup import repeated_passages


def brute(docs, size):
    texts = defaultdict(list)
    for i, x in docs:
        if i is not None:
            texts[i].append([y for y in re.split("[ \t\n\x0b\x0c\r]+", (x or "").translate({c: c + 32 for c in range(65, 91)})) if y])
    holders = defaultdict(set)
    for i, ws in texts.items():
        for w in ws:
            for k in range(len(w) - size + 1):
                holders[tuple(w[k : k + size])].add(i)
    out = set()
    for i, ws in texts.items():
        spans = sorted({(k, k + size, min(holders[tuple(w[k : k + size])])) for w in ws for k in range(len(w) - size + 1) if len(holders[tuple(w[k : k + size])]) > 1})
        runs = []
        for a, b, low in spans:
            if runs and a <= runs[-1][1]:
                runs[-1] = [runs[-1][0], max(b, runs[-1][1]), min(low, runs[-1][2])]
            else:
                runs.append([a, b, low])
        out |= {(i, a, b, b - a, low) for a, b, low in runs}
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6)))
    words = lambda n: [word() for _ in range(n)]
    docs = [words(r.randint(0, 200)) for _ in range(30)]
    for n in (12, 49, 50, 51, 60, 90, 300):
        passage = words(n)
        for _ in range(r.choice([2, 3, 12])):
            d = words(r.randint(0, 80))
            at = r.randint(0, len(d))
            docs.append(d[:at] + passage + d[at:])
    halves = words(60)
    docs += [words(20) + halves[:35] + words(20), words(20) + halves[25:] + words(20), words(5) + halves + words(5)]
    base = words(200)
    for _ in range(8):
        x = list(base)
        x[r.randrange(200)] = word()
        docs.append(x)
    docs += [["same"] * 120, ["same"] * 70, ["line", "two"] * 60] + [words(150)] * 3
    docs = [" ".join(x) if r.random() < 0.9 else "\n".join(x).upper() for x in docs] + ["", None]
    r.shuffle(docs)
    return [(100 + k, x) for k, x in enumerate(docs)]


@pytest.mark.parametrize("seed,bits", [(1, 16), (2, 16), (3, 1), (4, 3), (5, 2), (6, 4)])
def test_against_brute_force(spark, seed, bits):
    # with few bits most words look alike where suffixes are sorted: one-word differences must be found all the same
    docs = corpus(seed) + [(None, "x " * 80)]
    df = spark.createDataFrame([(i, x, 0) for i, x in docs], "doc_id long, text string, h int").repartition(4)
    assert {tuple(r) for r in repeated_passages(df, sort_bits=bits).collect()} == brute(docs, 50)


def test_empty_and_one_document_twice(spark):
    t = " ".join(f"w{k}" for k in range(100))
    df = spark.createDataFrame([(1, t), (1, t)], "doc_id long, text string")
    assert repeated_passages(df).count() == 0 == repeated_passages(df.filter("false")).count()


def test_ids_of_text_are_integers_or_an_error(spark):
    text = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([("7", text), ("12", text)], "doc_id string, text string")
    assert {r.doc_id for r in repeated_passages(df).collect()} == {7, 12}
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        repeated_passages(df.unionByName(spark.createDataFrame([("x", text)], df.schema))).collect()
