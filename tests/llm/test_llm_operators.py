import random
import re
import zlib
from collections import defaultdict

import pytest
from tokenizers import Tokenizer

from quakeloom.llm import lm_scoring, queries
from quakeloom.llm.decontaminate import find_benchmark_passages
from quakeloom.llm.exact_dedup import drop_exact_copies, exact_dedup
from quakeloom.llm.language_id import identify, keep_languages, train
from quakeloom.llm.token_counts import count_section_tokens
from quakeloom.llm.tokenizer import default_path
from tests.compare import difference, oracle

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_with_sql(spark, name):
    assert difference(queries.queries()[name](spark, SF).toPandas(), oracle(queries.oracle_sql()[name], SF)) == ""


def test_exact_dedup_cases(spark):
    rows = [(5, "a b"), (4, "a  b"), (3, "ab"), (9, "x"), (None, "x"), (7, None), (8, " \n\t"), (2, "alone"), (2, "alone")]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, prefix string, len int")
    for digest_all in (False, True):
        out = exact_dedup(df, digest_all=digest_all)
        got = sorted(((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in out.collect()), key=str)
        want = [(0, None, 2, True), (2, 2, 2, True), (2, 2, 2, True), (3, 4, 3, False), (4, 4, 3, True), (5, 4, 3, False), (7, 8, 2, False), (8, 8, 2, True), (9, None, 2, False)]
        assert got == sorted(want, key=str)
        assert (out.filter("full_hash is null").count() == 0) >= digest_all
    kept = drop_exact_copies(df)
    assert kept.columns == df.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 2, 4, 8]
    assert exact_dedup(df.filter("false")).count() == 0 == drop_exact_copies(df.filter("false")).count()


def brute_windows(docs, items, size=10):
    words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = defaultdict(set)
    for i, x in items:
        w = words(x)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[k : k + size])].add(str(i))
    out = []
    for d, x in docs:
        w, hit, found = words(x), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if (owners := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= owners
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [200_000, 7])
def test_decontamination_against_brute_force(spark, block):
    r = random.Random(2)
    vocab = [f"w{k}" for k in range(30)] + ["Ünd", "42", "ça"]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(k, say(r.choice([1, 3, 9, 10, 11, 25]))) for k in range(12)]
    docs = []
    for k in range(60):
        x = say(r.randint(0, 40))
        if k % 3 == 0:
            own = r.choice(items)[1]
            cut = r.randint(0, max(0, len(own) - 10))
            x = x[:5] + own[cut : cut + r.choice([8, 10, 30])] + x[5:]
        docs.append((k, r.choice([" ", ", ", "\n- "]).join(x).upper() if k % 2 else " ".join(x)))
    docs += [(100, None), (101, ""), (101, " ".join(items[0][1])), (None, " ".join(items[1][1]))]
    items = [(i, "; ".join(x)) for i, x in items] + [(0, "; ".join(items[0][1])), (50, None), (51, "!?")]
    d = spark.createDataFrame([(*x, "a") for x in docs], "doc_id long, text string, windows string")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((x.doc_id, x.n_words, x.n_hit, sorted(x["items"])) for x in find_benchmark_passages(d, i, block_windows=block).collect()), key=str)
    assert got == brute_windows(docs, items)
    assert find_benchmark_passages(d, i.filter("false")).filter("contaminated").count() == 0
    assert find_benchmark_passages(d.filter("false"), i).count() == 0


def test_section_counts_add_up(spark):
    t = Tokenizer.from_file(default_path())
    texts = ["one two\nthree  four\n\n\nfive", "", None, "größe\nñandú 😀\n", "\n\n", "plain", "a\r\nb"]
    df = spark.createDataFrame([(k, x, 0) for k, x in enumerate(texts)], "doc_id long, text string, section int")
    rows = count_section_tokens(df).collect()
    for k, x in enumerate(texts):
        own = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.section)
        assert sum(r.n_tokens for r in own) == len(t.encode(x or "", add_special_tokens=False).ids)
        assert own[0].char_start == 0 and own[-1].char_end == len(x or "") and all(a.char_end == b.char_start for a, b in zip(own, own[1:]))
    for rule in ("first", "largest"):
        whole = "Hello wonderful world"
        want = {"first": [2, 1], "largest": [1, 2]}[rule]
        s = spark.createDataFrame([(1, whole, [("head", 0, 8), ("tail", 8, 21)])], "doc_id long, text string, s array<struct<name string, start int, end int>>")
        got = {r.name: (r.n_tokens, r.n_crossing) for r in count_section_tokens(s, sections_col="s", rule=rule).collect()}
        assert [got["head"][0], got["tail"][0]] == want, (rule, got)
    gap = spark.createDataFrame([(1, "aa bb cc", [("x", 3, 5)])], "doc_id long, text string, s array<struct<name string, start int, end int>>")
    assert sum(r.n_tokens for r in count_section_tokens(gap, sections_col="s").collect()) == len(t.encode("aa bb cc").ids)
    assert count_section_tokens(df.filter("false")).count() == 0
    with pytest.raises(ValueError):
        count_section_tokens(df, rule="half")


def brute_sections(t, text, spans, rule):
    """(section, first character) to tokens and crossing ones, byte by byte."""
    stretch, start = [], {}
    for p, c in enumerate(text):
        owner = next((k for k, (_, a, b) in enumerate(spans) if a <= p < b), -1)
        if not p or owner != stretch[-1][0]:
            key = (owner, p)
            start[key] = [0, 0]
        stretch += [key] * len(c.encode())
    at = 0
    for token in t.encode(text, add_special_tokens=False).tokens:
        own = stretch[at : at + len(token)]  # each letter of a token stands for one byte
        at += len(token)
        winner = own[0] if rule == "first" else max(dict.fromkeys(own), key=own.count)
        start[winner][0] += 1
        start[winner][1] += len(set(own)) > 1
    assert at == len(stretch)
    return {k: tuple(v) for k, v in start.items()}


@pytest.mark.parametrize("rule", ["first", "largest"])
def test_sections_against_brute_force(spark, rule):
    t, r = Tokenizer.from_file(default_path()), random.Random(11)
    bits = ["the quick ", "größe", "😀😀", "\n\n", "internationalisation", "中文字", " ", "12345", "<|endoftext|>", "e\u0301", "_" * 9]
    docs = []
    for k in range(80):
        text = "".join(r.choice(bits) for _ in range(r.randint(1, 12)))
        cuts = sorted(r.sample(range(len(text) + 1), min(len(text) + 1, 2 * r.randint(0, 4))))
        docs.append((k, text, [(f"s{a}", a, b) for a, b in zip(cuts[::2], cuts[1::2])], "z"))
    df = spark.createDataFrame(docs, "doc_id long, text string, parts array<struct<name string, start int, end int>>, name string")
    got = defaultdict(dict)
    for x in count_section_tokens(df, sections_col="parts", rule=rule).collect():
        got[x.doc_id][x.section, x.char_start] = (x.n_tokens, x.n_crossing)
    for k, text, spans, _ in docs:
        assert got[k] == brute_sections(t, text, spans, rule), (text, spans)


def test_language_code_lengths_against_plain_trees(spark):
    import math

    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").limit(60)
    d = spark.createDataFrame(d.collect() + [(900, "aaa bbb", "zz"), (901, "aab", "zz"), (902, None, "zz"), (903, "unlabelled", None)], d.schema)
    fold = lambda x: bytes(4) + bytes(b + 32 if 65 <= b <= 90 else b for b in x.encode())
    trees = defaultdict(lambda: defaultdict(lambda: defaultdict(int)))
    for x in d.collect():
        if x.text and x.lang:
            b = fold(x.text)
            for p in range(4, len(b)):
                for order in range(5):
                    trees[x.lang][b[p - order : p]][b[p]] += 1

    def code_length(tree, text):
        b, out = fold(text), 0.0
        for p in range(4, len(b)):
            for order in range(4, -1, -1):
                seen = tree.get(b[p - order : p])
                if seen and b[p] in seen:
                    out -= math.log2((seen[b[p]] - 0.5) / sum(seen.values()))
                    break
                out -= math.log2(len(seen) / (2 * sum(seen.values()))) if seen else 0
            else:
                out += 8
        return out

    texts = [x.text[:300] for x in d.collect()[:20] if x.text] + ["AAA bbb aab", "qqqq zebra 中文 ñandú", "a", "x" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x for x in identify(df, train(d)).collect()}
    for k, text in enumerate(texts):
        bits = {lang: code_length(tree, text) for lang, tree in sorted(trees.items())}
        least = min(bits.values())
        assert got[k].bits_per_byte == pytest.approx(least / len(text.encode()), rel=1e-4)
        assert bits[got[k].lang_pred] == pytest.approx(least, rel=1e-4)
        assert got[k].score == pytest.approx(1 / sum(2 ** (least - x) for x in bits.values()), abs=0.02)


def test_very_long_texts(spark):
    """Two million characters beside short texts, with columns whose names the operators use themselves."""
    r = random.Random(3)
    vocab = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7))) for _ in range(3000)]
    words = [r.choice(vocab) for _ in range(400_000)]
    item = [f"exam{k}" for k in range(12)]
    passage = [f"notice{k}" for k in range(60)]
    words[200_000:200_000] = item
    words[399_000:399_000] = passage
    text = " ".join(words)
    rows = [(1, text, "en"), (2, " ".join(["short", *passage, "text"]), "en"), (3, None, None), (4, text + " end", "en"), (5, text.replace(" ", "\n"), "en")]
    df = spark.createDataFrame([(*x, "q", 7) for x in rows], "doc_id long, text string, lang string, word string, n int").repartition(2)
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    hit = {x.doc_id: (x.n_words, x.n_hit) for x in find_benchmark_passages(df, items).collect()}
    assert hit == {1: (400_072, 12), 2: (62, 0), 3: (0, 0), 4: (400_073, 12), 5: (400_072, 12)}
    from quakeloom.llm.ngram_join import jaccard_components
    from quakeloom.llm.suffix_dedup import repeated_passages

    joined = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_components(df).collect()}
    n = len({tuple(words[k : k + 4]) for k in range(len(words) - 3)})
    assert joined == {1: (n, 1), 2: (59, 2), 3: (0, 3), 4: (n + 1, 1), 5: (n, 1)}
    spans = {tuple(x) for x in repeated_passages(df).collect()}
    assert spans == {(1, 0, 400_072, 400_072, 1), (2, 1, 61, 60, 1), (4, 0, 400_072, 400_072, 1), (5, 0, 400_072, 400_072, 1)}
    groups = {x.doc_id: (x.keep_id, x.group_size) for x in exact_dedup(df).collect()}
    assert groups == {1: (1, 2), 2: (2, 1), 3: (3, 1), 4: (4, 1), 5: (1, 2)}
    model = train(df)
    assert {x.doc_id: x.lang_pred for x in identify(df, model).collect()} == {1: "en", 2: "en", 3: "und", 4: "en", 5: "en"}
    counted = lm_scoring.count_words(df)
    opts = lm_scoring.LmOptions(classes=64, tails=16, frequent=200, batch=256)
    scores = {x.doc_id: x for x in lm_scoring.score(df, counted, lm_scoring.train(df, counted, opts=opts)).collect()}
    assert {k: (x.n_tokens, x.n_known) for k, x in scores.items()} == {1: (400_073,) * 2, 2: (63, 63), 3: (1, 1), 4: (400_074,) * 2, 5: (400_073,) * 2}
    assert scores[1].score == pytest.approx(scores[5].score, rel=1e-6)


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op6_language_id(spark, "/root/testdata/sf0.01").join(d.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.98 and all(0 <= r.score <= 1 for r in got)


def test_language_odd_texts(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    model = train(d)
    rows = [(1, None, 1), (2, "", 1), (3, "123 !?", 1), (None, "the thing of", 1), (4, "中文", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang int")
    got = {r.doc_id: (r.lang_pred, r.score > 0) for r in identify(df, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", False) and got[None] == ("en", True) and got[4][0] in model.langs
    assert sorted((r.doc_id or 0) for r in keep_languages(df, model, min_score=0.0).collect()) == [0, 4]
    assert train(d.filter("false")) is None and keep_languages(df, None).count() == 0
    assert {r.lang_pred for r in identify(df, None).collect()} == {"und"}
    assert identify(df.filter("false"), model).count() == 0


def test_language_model(spark):
    import math
    from collections import Counter

    tokens = lambda x: [w for w in re.split("[ \t\n\x0b\x0c\r]+", (x or "").translate({c: c + 32 for c in range(65, 91)})) if w] + [None]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(None, "the the"), (90_000, None), (90_001, "")], "doc_id long, text string"))
    rows = {r.doc_id: r.text for r in docs.collect()}
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    count = Counter(w for i, x in rows.items() if not out(i) for w in tokens(x))
    total, kinds = sum(count.values()), len(count)
    training = docs.filter(~lm_scoring.held_out(docs.doc_id))
    opts = lm_scoring.LmOptions(classes=64, tails=16, frequent=200, batch=256)  # most words come by the join
    words = lm_scoring.count_words(training)
    model = lm_scoring.train(training, words, opts=opts)
    got = {r.doc_id: r for r in lm_scoring.score(docs, words, model).collect()}
    for i, x in rows.items():
        w = tokens(x)
        base = sum(math.log10((count[y] + 0.5) / (total + 0.5 * (kinds + 1))) for y in w)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w), sum(count[y] > 0 for y in w), total)
        assert got[i].base_score == pytest.approx(base, rel=1e-9) and got[i].score < 0
    # the score of each text from the model's vectors, word by word; probabilities of all classes after any two add up to one
    import numpy as np

    a, b = model.before1 @ model.target.T + model.bias, model.before2 @ model.target.T
    of = {}

    def seen(word):
        """Class of a word, and the logarithm of its share of that class."""
        if word not in of:
            buf = np.frombuffer((word or "").encode(), np.uint8)
            h, tail, _ = lm_scoring._tokens(buf, np.array([0, len(buf)]))
            k = int(model.classify(h, tail)[1][0])
            of[word] = k, 0.0 if k < model.base else math.log10(count[word] + 0.5)
        return of[word]

    mass = Counter()
    for w in count:
        k, _ = seen(w)
        mass[k] += count[w] + 0.5
    for k in range(model.base, opts.classes):
        assert model.mass[k] == pytest.approx(mass[k] + 0.5)
    for i, x in rows.items():
        kinds_of = [seen(w)[0] for w in tokens(x)]
        total_log = 0.0
        for j, w in enumerate(tokens(x)):
            one, two = (kinds_of[j - 1] if j > 0 else 0), (kinds_of[j - 2] if j > 1 else 0)
            z = (a[one] + b[two]).astype(np.float64)
            total_log += (z[kinds_of[j]] - np.log(np.exp(z).sum())) / math.log(10)
            total_log += seen(w)[1] - (math.log10(model.mass[kinds_of[j]]) if kinds_of[j] >= model.base else 0)
        assert got[i].score == pytest.approx(total_log, rel=1e-4)
    empty = lm_scoring.count_words(training.filter("false"))
    assert lm_scoring.score(docs, empty, lm_scoring.train(training.filter("false"), empty, opts=opts)).count() == len(rows)
