"""Passages that repeat across documents, by a sparse suffix array over content-selected positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakeloom.llm._scale import lean, materialise
from quakeloom.llm._text import NONSPACE, mix, powers, signed, slabs, word_hashes

#: Words of the gram whose hash selects a position.
GRAM = 8
#: Places of the filter for shared positions: 8 MB of bits, whatever the data.
_BITS = 1 << 26
_STEP = np.uint64(0x9E3779B97F4A7C15)


def anchors(w: np.ndarray, at: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Selected positions in the words ``w`` of texts with word offsets ``at``, and the hash of the gram there.

    Of every ``window`` consecutive grams of a text the one with the least hash is selected, the first
    of equal ones, so two texts with ``window + gram - 1`` words in common select the same position in them.
    """
    n = len(w) - gram + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(gram):
        h = h * _STEP + w[j : j + n]
    h = mix(h)
    low = np.uint64(28)
    key = (h >> low << low) | np.arange(n, dtype=np.uint64)
    inside = np.zeros(n + 1, np.int64)
    for j in range(1, gram):  # grams that would run over the end of their text
        past = at[1:] - j
        past = past[(past >= 0) & (past < n)]
        inside[past] = 1
    bad = inside[:-1] > 0
    key[bad] = np.uint64(2**64 - 1)
    least, reach = key, 1
    while reach < window:
        step = min(reach, window - reach)
        shifted = np.concatenate([least[step:], np.full(step, 2**64 - 1, np.uint64)])[: len(least)]
        least, reach = np.minimum(least, shifted), reach + step
    chosen = np.unique(least[least != np.uint64(2**64 - 1)] & np.uint64((1 << 28) - 1)).astype(np.int64)
    return chosen, h[chosen]


def _positions(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, buf, offs in slabs(batch.column(1)):
                w, at = word_hashes(buf, offs, NONSPACE)
                pos, h = anchors(w, at, GRAM, window)
                text = np.searchsorted(at, pos, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(signed(h)), batch.column(0).take(pa.array(lo + text))], names=["h", "doc_id"])

    return run


def _spans(w: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the words in each [start, end), made of whole word hashes."""
    up, down = powers(len(w) + 1)
    sums = np.zeros(len(w) + 1, np.uint64)
    np.cumsum(w * up[: len(w)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _STEP)


def _contexts(size: int, window: int, bits: int, shared):
    """Selected positions that may be shared, with ``size`` words on each side, the left ones nearest first.

    Sides are ``bits`` of each word's hash, by which they are sorted, and a hash of all whole words, by
    which they are told apart.
    """
    mask = np.uint64((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        reach = np.arange(size)
        for batch in batches:
            for lo, _, buf, offs in slabs(batch.column(1)):
                w, at = word_hashes(buf, offs, NONSPACE)
                pos, h = anchors(w, at, GRAM, window)
                place = (h & np.uint64(_BITS - 1)).astype(np.int64)
                kept = (wanted[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
                pos, h = pos[kept], h[kept]
                short = np.maximum(w & mask, np.uint64(1)).astype(">u2")
                for k in range(0, max(1, len(pos)), 20_000):
                    p, hh = pos[k : k + 20_000], h[k : k + 20_000]
                    text = np.searchsorted(at, p, "right") - 1
                    right, left = p[:, None] + reach, p[:, None] - 1 - reach
                    far, near = right >= at[text + 1][:, None], left < at[text][:, None]
                    r, left_words = short[np.where(far, 0, right)], short[np.where(near, 0, left)]
                    r[far] = left_words[near] = 0
                    kr = mix(hh + _spans(w, p, np.minimum(p + size, at[text + 1])))
                    kl = mix(~hh + _spans(w, np.maximum(p - size, at[text]), p))
                    fixed = lambda x: pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * size), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(signed(hh)),
                            batch.column(0).take(pa.array(lo + text)),
                            pa.array(p - at[text]),
                            pa.array(at[text + 1] - at[text]),
                            fixed(r),
                            fixed(left_words),
                            pa.array(signed(kr)),
                            pa.array(signed(kl)),
                        ],
                        names=["h", "doc_id", "pos", "n", "right", "left", "kr", "kl"],
                    )

    return run


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    if not len(column):
        return np.zeros((0, size), ">u2")
    flat = column.cast(pa.binary(2 * size))
    return np.frombuffer(flat.buffers()[1], ">u2", len(flat) * size, flat.offset * 2 * size).reshape(len(flat), size)


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that rows of a and b have in common from their start."""
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def _compare(size: int):
    """Sorted suffixes (h, ctx, ...) with the words each shares with the neighbour before or after it, whichever are more.

    The first and last row of a task are marked, for their neighbours in other tasks are yet to be compared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, True

        def out(rows: pa.Table, alike: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
            cols = [rows[c].combine_chunks() for c in ("h", "ctx", "key", "low", "several")]
            cols[1] = pc.if_else(pa.array(edge), cols[1], pa.scalar(None, pa.binary()))  # the rest have been compared
            return pa.RecordBatch.from_arrays(
                cols + [pa.array(alike.astype(np.int32)), pa.array(edge)], names=["h", "ctx", "key", "low", "several", "alike", "edge"]
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            carry = None
            if held is not None:
                rows, carry = pa.concat_tables([held[0], rows]), held[1]
            h = rows["h"].to_numpy()
            words = _matrix(rows["ctx"].combine_chunks(), size)
            common = np.where(h[1:] == h[:-1], _alike(words[1:], words[:-1]), 0)
            most = np.zeros(len(rows), np.int64)
            most[1:] = common
            most[:-1] = np.maximum(most[:-1], common)
            if carry is not None:
                most[0] = max(most[0], carry)
            edge = np.zeros(len(rows), bool)
            edge[0] = first
            if len(rows) > 1:
                yield out(rows.slice(0, len(rows) - 1), most[:-1], edge[:-1])
                first = False
            held = rows.slice(len(rows) - 1), int(most[-1])
        if held is not None:
            yield out(held[0], np.array([held[1]]), np.array([True]))

    return run


_SORTED = "h long, ctx binary, key long, low long, several boolean, alike int, edge boolean"


def _suffix_order(rows: DataFrame, side: str, key: str, size: int, name: str) -> DataFrame:
    """(key, low, several, alike) of every distinct side: the words that it may share with the nearest suffix.

    Equal suffixes are counted before they are sorted; the sort is by range of (h, content), so one
    frequent position is spread over tasks. Only first and last rows of tasks are compared in one.
    """
    distinct = rows.groupBy("h", F.col(side).alias("ctx"), F.col(key).alias("key")).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    distinct = distinct.select("h", "ctx", "key", "low", (F.col("low") != F.col("high")).alias("several"))
    ordered = distinct.repartitionByRange("h", "ctx").sortWithinPartitions("h", "ctx")
    table = materialise(ordered.mapInArrow(lean(_compare(size)), _SORTED), name)
    edges = table.filter("edge").drop("alike", "edge").coalesce(1).sortWithinPartitions("h", "ctx").mapInArrow(lean(_compare(size)), _SORTED)
    edges = edges.select("key", F.col("alike").alias("across"))  # two rows of each task, whatever the data
    return (
        table.join(F.broadcast(edges), "key", "left")
        .select("key", "low", "several", F.when(F.col("several"), size).otherwise(F.greatest("alike", F.coalesce("across", F.lit(0)))).alias("alike"))
    )


def _windows(size: int):
    """Texts with the ranges of starts that are asked for to (doc_id, start, hash) of each such window once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(2)
            for lo, hi, buf, offs in slabs(batch.column(1)):
                w, at = word_hashes(buf, offs, NONSPACE)
                text, starts = [], []
                for k in range(hi - lo):
                    ranges = asked[lo + k].values
                    most = at[k + 1] - at[k] - size + 1  # starts that the text has
                    if most <= 0:
                        continue
                    change = np.zeros(most + 1, np.int64)
                    np.add.at(change, ranges.field("a").to_numpy().clip(0, most), 1)
                    np.add.at(change, (ranges.field("b").to_numpy() + 1).clip(0, most), -1)
                    own = np.flatnonzero(np.cumsum(change[:-1]) > 0)
                    text.append(np.full(len(own), k))
                    starts.append(own)
                if text:
                    text, starts = np.concatenate(text), np.concatenate(starts)
                    first = at[text] + starts
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(lo + text)), pa.array(starts), pa.array(signed(_spans(w, first, first + size)))], names=["doc_id", "start", "w"]
                    )

    return run


def _filter_bits(shared: DataFrame) -> np.ndarray:
    """A bit for each place that holds a shared position; 8 MB whatever the data."""
    place = F.col("h").bitwiseAND(F.lit(_BITS - 1)) + 1
    rows = shared.select(F.bitmap_bucket_number(place).alias("b"), F.bitmap_bit_position(place).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits")).toArrow()
    out = np.zeros(_BITS // 8, np.uint8)
    for b, bits in zip(rows["b"].to_pylist(), rows["bits"], strict=True):
        part = np.frombuffer(bits.as_buffer(), np.uint8)
        out[(b - 1) * 4096 : (b - 1) * 4096 + len(part)] = part
    return out


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, sort_bits: int = 16) -> DataFrame:
    """One row per maximal run of words of a document that is covered by windows of ``min_words`` found in other documents too.

    Columns: doc_id, start_word, end_word (exclusive), n_words, first_doc_id, the least id among documents
    that share one of the run's windows. Words stand between white space, A-Z folded.

    Suffixes are kept only at minimiser positions, so that any ``min_words`` words in common hold one.
    They are sorted by what follows and, apart from that, by what precedes; neighbours in either order
    tell how far a match may reach right and left, which is where words are compared by ``sort_bits`` of
    their hashes (1 to 16). What is reported is told apart by 64-bit hashes made of whole word hashes: a side
    of ``min_words`` words that several documents share, or a window within both reaches, hashed from its
    text, that another document has too. So two halves from two documents do not count, and ``sort_bits``
    changes what is looked at but not the result.

    Ids are integers. Null text is empty. Documents with null id are not compared. Rows with one id are one
    document. A frequent passage is pre-aggregated by its content; no group is gathered; an empty table gives none.
    """
    spark = docs.sparkSession
    window = min_words - GRAM + 1
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter(F.col("doc_id").isNotNull())
    found = base.mapInArrow(lean(_positions(window)), "h long, doc_id long")
    shared = materialise(
        found.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("h"), "shared-positions"
    )
    bits = spark.sparkContext.broadcast(_filter_bits(shared))
    ddl = "h long, doc_id long, pos long, n long, right binary, left binary, kr long, kl long"
    rows = materialise(base.mapInArrow(lean(_contexts(min_words, window, sort_bits, bits)), ddl), "positions")
    right = _suffix_order(rows, "right", "kr", min_words, "suffixes")
    left = _suffix_order(rows, "left", "kl", min_words, "prefixes")

    def side(df: DataFrame, s: str) -> DataFrame:
        return df.select(F.col("key").alias(f"k{s}"), F.col("low").alias(f"low_{s}"), F.col("several").alias(f"many_{s}"), F.col("alike").cast("long").alias(s))

    # contexts stay behind: positions carry their keys only
    extended = rows.select("h", "doc_id", "pos", "n", "kr", "kl").join(side(right, "r"), "kr").join(side(left, "l"), "kl")
    extended = extended.withColumn("r", F.least(F.col("r"), F.col("n") - F.col("pos"))).withColumn("l", F.least("l", "pos"))
    extended = extended.withColumn("whole_r", F.col("many_r") & (F.col("r") >= min_words)).withColumn("whole_l", F.col("many_l") & (F.col("l") >= min_words))
    extended = materialise(extended.filter(f"whole_r or whole_l or r + l >= {min_words}"), "extended")

    span = lambda a, b, low: F.struct(a.alias("start"), b.alias("stop"), low.alias("low"))
    known = F.array_compact(
        F.array(
            F.when(F.col("whole_r"), span(F.col("pos"), F.col("pos") + min_words, F.col("low_r"))),
            F.when(F.col("whole_l"), span(F.col("pos") - min_words, F.col("pos"), F.col("low_l"))),
        )
    )
    sure = extended.select("doc_id", F.explode(known).alias("s")).select("doc_id", "s.start", "s.stop", "s.low")

    open_rows = extended.filter(f"not (whole_r and whole_l) and l > 0 and r > 0 and r + l >= {min_words}")
    # the other holder of such a window may be shared whole on both sides; documents alike there for a whole side each way hold
    # the same windows, so the first and last of them speak for all
    whole = extended.filter("whole_r and whole_l").groupBy("h", "kr", "kl").agg(F.min(F.struct("doc_id", "pos", "r", "l")).alias("x"), F.max(F.struct("doc_id", "pos", "r", "l")).alias("y"))
    whole = whole.join(open_rows.select("h").distinct(), "h", "left_semi").select(F.explode(F.array_distinct(F.array("x", "y"))).alias("x")).select("x.*")
    asked = open_rows.select("doc_id", "pos", "r", "l").unionByName(whole)
    asked = asked.groupBy("doc_id").agg(F.collect_set(F.struct((F.col("pos") - F.col("l")).alias("a"), (F.col("pos") + F.col("r") - min_words).alias("b"))).alias("asked"))
    asked = materialise(asked, "asked")  # ranges of a document: one for each of its positions at most
    texts = base.join(asked, "doc_id").select("doc_id", "text", "asked")
    windows = materialise(texts.mapInArrow(lean(_windows(min_words)), "doc_id long, start long, w long"), "windows")
    confirmed = windows.groupBy("w").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("w", "low")
    confirmed = materialise(confirmed, "confirmed")  # aggregated before the join, so that a hot window's rows can be split there
    sure = sure.unionByName(windows.join(confirmed, "w").select("doc_id", "start", (F.col("start") + min_words).alias("stop"), "low"))
    return _merged(sure.distinct())


def _merged(spans: DataFrame) -> DataFrame:
    """Overlapping or touching spans of a document as one; a document's spans are at most a few for each of its words."""
    listed = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "low"))).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, items in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                a, b, low = (items.values.field(c).to_numpy() for c in ("start", "stop", "low"))
                reach = np.maximum.accumulate(b)
                new = np.flatnonzero(np.concatenate([[True], a[1:] > reach[:-1]]))
                ends = reach[np.append(new[1:], len(a)) - 1]
                out += zip([doc] * len(new), a[new].tolist(), ends.tolist(), (ends - a[new]).tolist(), np.minimum.reduceat(low, new).tolist(), strict=True)
            cols = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start_word", "end_word", "n_words", "first_doc_id"])

    return listed.mapInArrow(lean(run), "doc_id long, start_word long, end_word long, n_words long, first_doc_id long")
