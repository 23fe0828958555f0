import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from quakeloom.llm._text import slabs
from quakeloom.llm.packing import pack
from quakeloom.llm.tokenizer import default_path, encoder

ODD = [
    "", "'s", "it's they'll 'x 're''s  ' s", " \n\n a  b\t c'd", "a'sb don't  　x <|endoftext|> 12 345th ١٢ 😀😀'll ",
    "   ", "x\n\n", "'", "a 's b", "x'", "'ve\n", "<|endoftext|>", "a<|endoftext|>b  <|endoftext|><|endof", "\u1c89'll go", "x \U0001ffff\u0378y's", None, "o'relly's '' 's", "ärger Ünder ñandú", "a b  c",
]


TOKENIZER = Tokenizer.from_file(default_path())


def reference(texts):
    t = TOKENIZER
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_ids_equal_the_tokenizers_own(spark):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()] + ODD
    for limit in (50, 100_000):
        for lo, hi, buf, offs in slabs(pa.array(docs, pa.string()), limit):
            ids, at = encoder(default_path()).encode(buf, offs)
            assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == reference(docs[lo:hi])


def check(rows, docs, window):
    """Round trip: each id once, sequences gapless, little padding."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        assert len(r.ids) == 4 * r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32 and r.length > 0
    want = defaultdict(list)
    for (i, _), ids in zip(docs, reference([t for _, t in docs])):
        want[i].append(ids + [1])
    for i, texts in want.items():
        got = sorted(by_doc[i], key=lambda r: r.start)
        if len(texts) == 1:
            assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in got]).tolist() == texts[0]
            assert [r.start for r in got] == np.cumsum([0, *(r.length for r in got)])[:-1].tolist()
            assert {r.doc_tokens for r in got} == {len(texts[0])}
        else:
            assert sum(r.length for r in got) == sum(map(len, texts))
    padding = 0
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == np.cumsum([0, *(r.length for r in pieces)])[:-1].tolist()
        n = sum(r.length for r in pieces)
        assert n <= window
        padding += 0 if n & (n - 1) == 0 else window - n
    assert padding == 0
    assert set(by_doc) == set(want)


def test_round_trip(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    docs += [(100_000 + k, t) for k, t in enumerate(ODD)] + [(None, "no id"), (7_000_000, "word " * 9000), (8_000_000, "twice"), (8_000_000, "twice")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).withColumnRenamed("x", "x")
    check(pack(df, with_ids=True, open_windows=3, merge=2).collect(), docs, 2048)
    check(pack(df, with_ids=True, window=64, open_windows=2).collect(), docs, 64)


def test_random_unicode_with_added_tokens(spark):
    import random

    r = random.Random(5)
    parts = ["<|endoftext|>", "<|end", "'s", " 'll", "\u1c89", "\u0378", "é", "\u0301", "\u3000", "\n", "  ", "12", "٣", "ǅ", "😀", "of", "İ", "\u00a0", "\x00"]
    texts = ["".join(r.choice(parts) if r.random() < 0.7 else chr(r.choice([r.randrange(32, 0xD800), r.randrange(0xE000, 0x11000)])) for _ in range(r.randint(0, 30))) for _ in range(400)]
    for _, _, buf, offs in slabs(pa.array(texts, pa.string())):
        ids, at = encoder(default_path()).encode(buf, offs)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == reference(texts)


def test_ids_keep_their_type(spark):
    df = spark.createDataFrame([("a", "one two"), (None, None)], "doc_id string, text string")
    assert {(r.doc_id, r.doc_tokens) for r in pack(df).collect()} == {(None, 1), ("a", 3)}


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, ids string, start int")
    assert pack(df).count() == 0
    df = spark.createDataFrame([(1, "a b", "x", 5)], "doc_id long, text string, ids string, start int")
    assert [(r.doc_id, r.start, r.length, r.doc_tokens, r.offset) for r in pack(df).orderBy("start").collect()] == [(1, 0, 2, 3, 0), (1, 2, 1, 3, 0)]
