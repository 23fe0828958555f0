import re
from collections import defaultdict

import corpus_pipeline
from tests.llm.test_ngram_join import brute

SPACE = re.compile("[ \t\n\x0b\x0c\r]+")


def words(x):
    folded = (x or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def test_each_stage_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    extra = [(90_001, "123 !!! 456", None, "x", 11), (90_002, None, None, None, None), (90_003, "", "en", "x", 0)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    items = [r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = corpus_pipeline.keep(stage(spark, docs, d), "test")
        if name == "packing":
            assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == set(before)
            break
        assert out.columns == docs.columns
        after = {r.doc_id for r in out.collect()}
        if name == "language_id":
            want = {i for i, x in before.items() if any(c.isalpha() for c in x or "")}
        elif name == "exact_dedup":
            groups = defaultdict(list)
            for i, x in before.items():
                groups[SPACE.sub("", x)].append((-len(x), i))
            want = {min(g)[1] for g in groups.values()}
        elif name == "ngram_jaccard":
            want = {i for i, (_, c) in brute(list(before.items()), 5, 80).items() if i == c}
        else:
            windows = set()
            for x in items:
                w = words(x)
                windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
            sizes = {len(x) for x in windows}
            hit = lambda w: any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))
            want = {i for i, x in before.items() if not hit(words(x))}
        assert after == want, name
        docs = out


def test_texts_of_no_learned_language_go(spark):
    import base64
    import random

    rnd = random.Random(3)
    letters = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    bad = [
        "Wczoraj wieczorem poszliśmy do kina, żeby zobaczyć nowy film, który wszyscy chwalili, ale był bardzo nudny.",
        "Suomen kesä on lyhyt mutta valoisa, ja monet ihmiset viettävät sen mökillä järven rannalla kalastaen ja saunoen.",
        "昨天晚上我们去看了一部非常好看的电影，然后回家吃饭。",
        base64.b64encode(rnd.randbytes(300)).decode(),
        letters(200),
        " ".join(letters(rnd.randint(2, 9)) for _ in range(40)),
    ]
    good = ["The it of ensh.", "Is that for and with the.", "La é le de de.", "Und die das in den.", "De la que el."]
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    extra = [(900_000 + k, x, None, "x", len(x)) for k, x in enumerate(bad + good)]
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    out = corpus_pipeline.identify_language(spark, docs.unionByName(spark.createDataFrame(extra, docs.schema)), d)
    after = {r.doc_id for r in out.select("doc_id").collect()}
    assert after == before | {900_000 + k for k in range(len(bad), len(bad + good))}


def test_rows_are_dropped_not_ids(spark):
    from quakeloom.llm.decontaminate import drop_contaminated
    from quakeloom.llm.exact_dedup import drop_exact_copies
    from quakeloom.llm.ngram_join import drop_near_copies

    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, "aa bb", "p"), (2, "aa  bb", "q"), (2, "unique text here", "r"), (None, "unique  text here", "s"), (None, "cc", "t"), (None, "cc", "u"), (3, text, "v"), (3, "dd", "w"), (3, "dd", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string").coalesce(1)
    kept = lambda out: sorted(r["row"] for r in out.collect())
    out = drop_exact_copies(df)
    assert out.columns == df.columns and kept(out) == ["q", "s", "t", "v", "w"]
    assert kept(drop_near_copies(df)) == ["p", "s", "t", "v", "w"]
    items = spark.createDataFrame([(1, text)], "item_id long, text string")
    assert kept(drop_contaminated(df, items)) == sorted(set("pqrstuwx"))


def test_working_tables_go(spark):
    import os

    from quakeloom.llm._scale import keep, materialise, shared_dir, working_tables

    with working_tables(spark):
        inner = materialise(spark.range(3), "inner")
        path = inner.inputFiles()[0].removeprefix("file://")
        outer = keep(inner.selectExpr("id + 1 as id"), "outer")
    assert not os.path.exists(path) and outer.count() == 3 and shared_dir(spark)


def _left(spark):
    from pathlib import Path

    from quakeloom.llm._scale import shared_dir

    return {x.name for x in Path(shared_dir(spark).removeprefix("file://"), "quakeloom").glob("*")}


def test_only_stage_tables_are_left(spark):
    before = _left(spark)
    corpus_pipeline.run(spark, "/root/testdata/sf0.001").count()
    new = sorted(x.rsplit("-", 1)[0] for x in _left(spark) - before)
    assert new == sorted(f"stage-{name}" for name, _ in corpus_pipeline.STAGES)


def test_a_scope_owns_what_a_dropping_operator_keeps(spark):
    from quakeloom.llm._scale import keep, working_tables
    from quakeloom.llm.exact_dedup import drop_exact_copies

    df = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c")], "doc_id long, text string")
    before = _left(spark)
    with working_tables(spark):
        out = keep(drop_exact_copies(df), "mine")
    assert sorted(r.doc_id for r in out.collect()) == [1, 3]
    assert [x.rsplit("-", 1)[0] for x in _left(spark) - before] == ["mine"]


def test_language_model_and_limit_rest_on_every_row_and_whole_texts(spark):
    import numpy as np

    from quakeloom.llm.language_id import _Scorer, rate_limit, train

    # more rows than a sample held, and a text whose end lies beyond what was read of it
    rows = [(k, f"ab{k:04d} the of and", "en") for k in range(900)] + [(900, "und der " * 3000 + "zzz qqq", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train(docs)
    english = [g for g, *_ in [t[model.langs.index("en")] for t in model.tables[-1:]]][0]
    assert {int.from_bytes(f"b{k:04d}".encode(), "big") for k in range(900)} <= set(english.tolist())
    german = model.tables[-1][model.langs.index("de")][0]
    assert int.from_bytes(b"z qqq"[-5:], "big") in german.tolist()
    clean = [(k, "the of and ab0001 the of and ab0002 the of and ab0003 the of and ab0004 the of and", "en") for k in range(2000)]
    dear = "the of and xy the of bd the and fo thx of end the ob and the og anf dthe of anc the fo and the off and"
    held = lambda xs: spark.createDataFrame(xs, docs.schema)
    buf = np.frombuffer(dear.encode(), np.uint8)
    rate = float(_Scorer(model).quiet(buf, np.array([0, len(buf)]))[1][0])
    found = [rate_limit(held([*clean, (k, dear, "en")]), model) for k in (10_000, 10_001, 10_002)]
    assert rate_limit(held(clean), model) < found[0] and all(abs(x - min(8.0, 2 * rate)) < 1e-4 for x in found)
