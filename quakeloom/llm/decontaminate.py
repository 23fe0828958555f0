"""Benchmark passages in documents: prefix-filtered join of item windows, verified over whole windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.llm._scale import ROW, drop_rows, keep, lean, materialise, numbered, working_tables
from quakeloom.llm._text import WORDISH, mix, signed, slabs, word_hashes

_BITS = 1 << 20


def _windows(size: int):
    """Batches of (item_id, text) to distinct windows of each item: word hashes and the window's own hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in slabs(batch.column(1)):
                w, at = word_hashes(buf, offs, WORDISH)
                items, keys, found = [], [], []
                for k in range(hi - lo):
                    own = w[at[k] : at[k + 1]]
                    n = min(size, len(own))
                    if not n:
                        continue
                    rows = np.lib.stride_tricks.sliding_window_view(own, n)
                    key = np.full(len(rows), n, np.uint64)
                    for j in range(n):
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
                    items += [lo + k] * len(rows)
                    keys.append(key)
                    found += [x.tolist() for x in signed(rows)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(items, pa.int64())),
                        pa.array(signed(np.concatenate(keys)) if keys else [], pa.int64()),
                        pa.array(found, pa.list_(pa.int64())),
                    ],
                    names=["item_id", "window", "words"],
                )

    return run


class _Block:
    """Windows of one block, found by their rarest word."""

    def __init__(self, keys: np.ndarray, words: np.ndarray, sizes: np.ndarray, vocab: np.ndarray, counts: np.ndarray):
        inside = np.arange(words.shape[1])[None, :] < sizes[:, None]
        rarity = np.where(inside, counts[np.searchsorted(vocab, words).clip(max=len(vocab) - 1)], np.iinfo(np.int64).max)
        self.place = rarity.argmin(axis=1)  # where in the window its necessary word stands
        rare = words[np.arange(len(words)), self.place]
        order = np.argsort(rare, kind="stable")
        self.keys, self.words, self.sizes, self.place = keys[order], words[order], sizes[order], self.place[order]
        self.rare, self.first = np.unique(rare[order], return_index=True)
        self.last = np.append(self.first[1:], len(order))
        self.bits = np.zeros(_BITS, bool)
        self.bits[(self.rare & np.uint64(_BITS - 1)).astype(np.int64)] = True

    def find(self, w: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of each occurrence in texts with words ``w`` and word offsets ``at``."""
        pos = np.flatnonzero(self.bits[(w & np.uint64(_BITS - 1)).astype(np.int64)])
        k = np.searchsorted(self.rare, w[pos])
        k[k == len(self.rare)] = 0
        hit = self.rare[k] == w[pos]
        pos, k = pos[hit], k[hit]
        n = self.last[k] - self.first[k]
        start = np.repeat(pos, n)
        win = np.repeat(self.first[k] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else pos
        text = np.searchsorted(at, start, "right") - 1
        start = start - self.place[win]
        ok = (start >= at[text]) & (start + self.sizes[win] <= at[text + 1])  # the window lies within the text
        start, win = start[ok], win[ok]
        for j in range(self.words.shape[1]):
            longer = self.sizes[win] > j
            same = ~longer
            same[longer] = w[start[longer] + j] == self.words[win[longer], j]
            start, win = start[same], win[same]
        return start, win


def _blocks(spark: SparkSession, windows: DataFrame, docs: DataFrame, size: int, block_windows: int) -> Iterator[_Block]:
    """Blocks of at most about ``block_windows`` distinct windows, so what a scan of the documents needs is bounded."""
    total = windows.select("window").distinct().count()
    n_blocks = -(-total // block_windows)
    for b in range(n_blocks):
        own = windows.filter(F.pmod(F.xxhash64("window"), F.lit(n_blocks)) == b).select("window", "words").dropDuplicates(["window"])
        table = own.toArrow()
        sizes = np.array([len(x) for x in table["words"].to_pylist()], np.int64)
        words = np.zeros((len(sizes), size), np.int64)
        words[np.arange(size)[None, :] < sizes[:, None]] = table["words"].combine_chunks().flatten().to_numpy()
        words = words.view(np.uint64)
        vocab = np.unique(words[np.arange(size)[None, :] < sizes[:, None]])
        shared = spark.sparkContext.broadcast(vocab)

        def count(batches, shared=shared):
            vocab = shared.value
            bits = np.zeros(_BITS, bool)
            bits[(vocab & np.uint64(_BITS - 1)).astype(np.int64)] = True
            seen = np.zeros(len(vocab), np.int64)
            for batch in batches:
                for _, _, buf, offs in slabs(batch.column(0)):
                    w, _ = word_hashes(buf, offs, WORDISH)
                    w = w[bits[(w & np.uint64(_BITS - 1)).astype(np.int64)]]
                    k = np.searchsorted(vocab, w)
                    k[k == len(vocab)] = 0
                    seen += np.bincount(k[vocab[k] == w], minlength=len(vocab))
            k = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(seen[k], pa.int64())], names=["k", "n"])

        found = docs.select("text").mapInArrow(lean(count), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(len(vocab), np.int64)
        counts[found["k"].to_numpy()] = found["n"].to_numpy()
        yield _Block(table["window"].to_numpy().view(np.uint64), words, sizes, vocab, counts)


def find_benchmark_passages(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    size: int = 10,
    block_windows: int = 200_000,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items (sorted ids), contaminated.

    Words are runs of digits, A-Z folded letters and characters beyond ASCII. A window is ``size``
    consecutive words of an item; an item with fewer words is one window. A window must be contained
    whole, so its one necessary word, the rarest over all documents, is the prefix it is joined by; a
    hit must leave room in the document for the words before and after it, and is verified word by
    word, words being told apart by their 64-bit hashes. A document's word inside any verified window is hit.

    Windows are searched in blocks of about ``block_windows``, each broadcast (88 bytes a window) for
    one scan of the documents, so no broadcast grows with the data. Null or wordless documents have no
    words; null or wordless items no windows; a null item id is the empty string; repeated items count
    once by their id. Null and repeated document ids each keep a row of their own.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    named = items.select(F.coalesce(F.col(item_id_col).cast("string"), F.lit("")).alias("item_id"), F.col(item_text_col).alias("text"))
    windows = materialise(named.mapInArrow(lean(_windows(size)), "item_id string, window long, words array<long>").distinct(), "item-windows")
    kind = base.schema["doc_id"].dataType.simpleString()
    ddl = f"row long, doc_id {kind}, n_words long, first array<int>, last array<int>, windows array<long>"

    def found(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, row = (block.value if block is not None else None), TaskContext.get().partitionId() << 40
            for batch in batches:
                for lo, hi, buf, offs in slabs(batch.column(1)):
                    w, at = word_hashes(buf, offs, WORDISH)
                    n = hi - lo
                    firsts, lasts, keys = [[]] * n, [[]] * n, [[]] * n
                    if own is not None:
                        start, win = own.find(w, at)
                        text = np.searchsorted(at, start, "right") - 1
                        order = np.argsort(text, kind="stable")
                        start, win, text = start[order], win[order], text[order]
                        runs = np.append(np.flatnonzero(np.diff(text, prepend=-1)), len(text))
                        for a, b in zip(runs[:-1], runs[1:], strict=True):
                            k = text[a]
                            s = start[a:b] - at[k]
                            firsts[k], lasts[k] = _union(s, s + own.sizes[win[a:b]])
                            keys[k] = np.unique(signed(own.keys[win[a:b]])).tolist()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.arange(row, row + n), pa.int64()),
                            batch.column(0).slice(lo, n),
                            pa.array(np.diff(at), pa.int64()),
                            pa.array(firsts, pa.list_(pa.int32())),
                            pa.array(lasts, pa.list_(pa.int32())),
                            pa.array(keys, pa.list_(pa.int64())),
                        ],
                        names=["row", "doc_id", "n_words", "first", "last", "windows"],
                    )
                    row += n

        return run

    scans = [
        materialise(base.mapInArrow(lean(found(spark.sparkContext.broadcast(b))), ddl), "passages")
        for b in _blocks(spark, windows, base, size, block_windows)
    ] or [materialise(base.mapInArrow(lean(found(None)), ddl), "passages")]
    if len(scans) == 1:
        hits = scans[0].withColumn("n_hit", F.aggregate(F.zip_with("first", "last", lambda a, b: b - a), F.lit(0), lambda a, b: a + b).cast("long"))
    else:
        hits = _over_blocks(scans)
    rows = scans[0].select("row", "doc_id", "n_words")
    per_item = (
        _union_all([s.select("row", F.explode("windows").alias("window")) for s in scans])
        .join(windows.select("window", "item_id"), "window")
        .groupBy("row")
        .agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    return (
        rows.join(hits.select("row", "n_hit").filter("n_hit > 0").join(per_item, "row"), "row", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            F.col("n_hit").isNotNull().alias("contaminated"),
        )
    )


def _union(first: np.ndarray, last: np.ndarray) -> tuple[list[int], list[int]]:
    """Disjoint spans that cover the same words as [first, last)."""
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    new = np.concatenate([[True], first[1:] > last[:-1]])
    return first[new].tolist(), last[np.append(np.flatnonzero(new)[1:], len(first)) - 1].tolist()


def _union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _over_blocks(scans: list[DataFrame]) -> DataFrame:
    """Hit words of each row when several blocks each found some: the union of their spans."""
    spans = _union_all([s.select("row", F.explode(F.arrays_zip("first", "last")).alias("s")) for s in scans])
    words = spans.select("row", F.explode(F.sequence("s.first", F.col("s.last") - 1)).alias("w")).distinct()
    return words.groupBy("row").agg(F.count("*").alias("n_hit"))


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that hold a window of an item; columns as they were.

    Each row is judged by its own text, whatever other rows share its id, null or not.
    """
    rows = numbered(docs)
    with working_tables(docs.sparkSession):
        gone = keep(find_benchmark_passages(rows, items, ROW, text_col, **options).filter("contaminated").select("doc_id"), "contaminated")
    return drop_rows(rows, gone)
