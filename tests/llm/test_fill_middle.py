import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakeloom.llm.fill_middle import boundaries, fill_in_middle, restore

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text, percent=50, spm=80):
    """By regular expression and string slices."""
    tokens = TOKEN.findall(text or "")
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(tokens)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= percent:
        return n, "plain", None, None, text or ""
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_boundaries_are_those_of_the_pattern():
    r = random.Random(3)
    for _ in range(400):
        text = "".join(r.choice(" \t\n\x0b\x0c\rab\x85\xa0é😀 ") for _ in range(r.randint(0, 14)))
        ends = boundaries(np.frombuffer(text.encode("utf-32-le"), "<u4")).tolist()
        assert [text[a:b] for a, b in zip(ends, ends[1:])] == TOKEN.findall(text)


def test_against_brute_force_and_back(spark):
    r = random.Random(5)
    say = lambda n: "".join(r.choice(["a", "größe", "😀", " ", "  ", "\n", "<", "P>", "<M", "\t", "中"]) for _ in range(n))
    docs = [(k, say(r.randint(0, 30))) for k in range(300)] + [(7, None), (8, ""), (9, " \n"), (9, " \n"), (None, "some words here"), (None, None), (301, "a <P> b"), (302, "x<S>"), (303, "<M>")]
    docs += [(k, "word  " * 150_000 + "end") for k in range(400, 404)]
    df = spark.createDataFrame([(*d, "z", 1) for d in docs], "doc_id long, text string, form string, n int").repartition(3)
    out = fill_in_middle(df).withColumn("back", restore(F.col("output"), F.col("form"))).collect()
    got = sorted(((x.doc_id, x.n, x.form, x.prefix_chars, x.middle_chars, x.output, x.back) for x in out), key=str)
    assert got == sorted(((i, *brute(i, t), t or "") for i, t in docs), key=str)
    assert {x.form for x in out} == {"plain", "psm", "spm"}
    assert fill_in_middle(df.filter("false")).count() == 0
    named = fill_in_middle(df.selectExpr("cast(doc_id as string) as name", "text as body"), id_col="name", text_col="body", percent=100, spm_percent=0)
    assert {x.form for x in named.filter("n > 0").collect()} == {"psm", "plain"}


def test_markers_must_not_overlap(spark):
    df = spark.createDataFrame([(1, "aa b")], "doc_id long, text string")
    for bad in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("<P>", "<P>x", "<M>"), ("ab", "bc", "d"), ("aa", "b", "c")):
        with pytest.raises(ValueError):
            fill_in_middle(df, markers=bad)
    own = ("|p.", "|s*", "|m?")
    out = fill_in_middle(df, percent=100, markers=own).withColumn("back", restore(F.col("output"), F.col("form"), own)).collect()[0]
    assert out.back == "aa b" and out.output.startswith("|") and out.form != "plain"
