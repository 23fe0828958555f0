"""Language of texts by prediction by partial matching over bytes, with statistics frozen after training."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakeloom.llm._scale import lean
from quakeloom.llm._text import LOWER, slabs

#: Longest context in bytes; a tree node is a context and the byte after it.
ORDER = 4
#: What a process keeps of code lengths it has worked out; beyond it the table starts anew.
KEPT = 1 << 19
#: Grams of a language that a model holds at most.
MOST = 1 << 20
#: Bits of a byte as it is.
RAW = 8.0
#: Bytes of the windows whose code lengths tell whether a text is language, and how many a text has at least.
WINDOW, LEAST = 8, 8


def _grams(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each byte, A-Z folded, it (low 8 bits) and the ORDER bytes before it; before a text stand zero bytes."""
    buf = LOWER[buf]
    g = np.zeros(len(buf), np.uint64)
    starts = offs[:-1][np.diff(offs) > 0]
    at = np.arange(len(buf)) - np.repeat(starts, np.diff(np.append(starts, len(buf)))) if len(buf) else g.astype(np.int64)
    for k in range(ORDER + 1):
        shifted = np.zeros(len(buf), np.uint64)
        shifted[k:] = buf[: len(buf) - k] if k else buf
        shifted[at < k] = 0
        g |= shifted << np.uint64(8 * k)
    return g


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for lo, hi, buf, offs in slabs(batch.column(1)):
            g = _grams(buf, offs)
            who, names = pd.factorize(np.repeat(np.array(langs[lo:hi], object), np.diff(offs)))
            for k, lang in enumerate(names):
                values, n = np.unique(g[who == k], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(n), pa.string()), pa.array(values.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"]
                )


class Model:
    """Context trees of all languages as sorted tables, one for each order, and exact code lengths from them.

    Under a context that was seen n times with q different bytes, a byte seen c times has probability
    (c - 1/2) / n and the escape to the next shorter context q / 2n (method D). Below the empty context
    all 256 bytes are alike. An unseen context escapes for nothing.
    """

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray):
        self.langs = langs
        self.tables = []
        for order in range(ORDER + 1):
            keep = np.uint64((1 << 8 * (order + 1)) - 1)
            per = []
            for k in range(len(langs)):
                mine = lang == k
                g, inv = np.unique(gram[mine] & keep, return_inverse=True)
                c = np.bincount(inv, n[mine]).astype(np.float64)
                ctx, at = np.unique(g >> np.uint64(8), return_inverse=True)
                total, kinds = np.bincount(at, c), np.bincount(at)
                per.append((g, -np.log2((c - 0.5) / total[at]).astype(np.float32), ctx, -np.log2(kinds / (2 * total)).astype(np.float32)))
            self.tables.append(per)

    def bits(self, gram: np.ndarray) -> np.ndarray:
        """Code length of each gram's last byte after the others, a column for each language."""
        out = np.zeros((len(gram), len(self.langs)), np.float32)
        for k in range(len(self.langs)):
            left = np.arange(len(gram))
            for order in range(ORDER, -1, -1):
                g, cost, ctx, escape = self.tables[order][k]
                own = gram[left] & np.uint64((1 << 8 * (order + 1)) - 1)
                i = np.searchsorted(g, own).clip(max=len(g) - 1)
                seen = g[i] == own
                out[left[seen], k] += cost[i[seen]]
                left, own = left[~seen], own[~seen] >> np.uint64(8)
                i = np.searchsorted(ctx, own).clip(max=len(ctx) - 1)
                known = ctx[i] == own
                out[left[known], k] += escape[i[known]]
            out[left, k] += 8
        return out


def _labelled(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, text) of every row that has both."""
    return docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter(F.col("lang").isNotNull() & (F.length("text") > 0))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = MOST) -> Model | None:
    """Fit context trees on the whole text of every labelled row; rows without label or text are left out. None if nothing is left.

    Spark counts; of each language the ``most`` grams that occur oftenest, which are all unless there are more kinds,
    reach the driver, so the model's size is bounded.
    """
    table = _labelled(docs, text_col, lang_col).mapInArrow(lean(_count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # in two levels, so that a frequent language is no one task's work: of each of 64 parts the most frequent, then of these
    for keys in (["lang", F.pmod(F.xxhash64("gram"), F.lit(64))], ["lang"]):
        w = Window.partitionBy(*keys).orderBy(F.desc("n"), "gram")
        table = table.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most).drop("r")
    table = table.toArrow()
    if not len(table):
        return None
    codes, langs = pd.factorize(table["lang"].to_numpy(zero_copy_only=False), sort=True)
    return Model(list(langs), codes, table["gram"].to_numpy().view(np.uint64), table["n"].to_numpy().astype(np.float64))


class _Scorer:
    """Code lengths of whole texts; kept grams are looked up, new ones worked out."""

    def __init__(self, model: Model):
        self.model = model
        self.bits_of = np.zeros((0, len(model.langs)), np.float32)
        self.index = pd.Index(np.zeros(0, np.uint64))
        self.fresh: list[tuple[np.ndarray, np.ndarray]] = []

    def score(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Code length of each text, a column for each language."""
        return self._score(buf, offs)[0]

    def quiet(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code lengths of each text as :meth:`score`, and bits a byte of the lower quartile of its windows under the nearest language.

        A name, number or secret makes some windows of a text dear; what is no text of the language is dear
        throughout. Texts of under ``LEAST`` windows have none.
        """
        bits, codes, each = self._score(buf, offs)
        best, out = bits.argmin(axis=1), np.full(len(offs) - 1, np.nan)
        for k, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
            n = (b - a) // WINDOW
            if n >= LEAST:
                rates = each[codes[a : a + n * WINDOW], best[k]].reshape(n, WINDOW).mean(axis=1)
                out[k] = np.partition(rates, (n - 1) // 4)[(n - 1) // 4]
        return bits, out

    def _score(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes, distinct = pd.factorize(_grams(buf, offs))
        at = self.index.get_indexer(distinct)
        bits = self.bits_of[at] if len(self.bits_of) else np.zeros((len(distinct), len(self.model.langs)), np.float32)
        new = np.flatnonzero(at < 0)
        if len(new):
            bits[new] = self.model.bits(distinct[new])
            self.fresh.append((distinct[new], bits[new]))
            if sum(len(x) for x, _ in self.fresh) > max(50_000, len(self.index) // 4):
                self._keep()
        out = np.zeros((len(offs) - 1, len(self.model.langs)))
        for k in range(out.shape[1]):
            sums = np.zeros(len(codes) + 1)
            np.cumsum(bits[:, k][codes], out=sums[1:], dtype=np.float64)
            out[:, k] = sums[offs[1:]] - sums[offs[:-1]]
        return out, codes, bits

    def _keep(self) -> None:
        grams = np.concatenate([self.index.to_numpy(), *(x for x, _ in self.fresh)])
        bits = np.concatenate([self.bits_of, *(x for _, x in self.fresh)])
        self.fresh = []
        if len(grams) > KEPT:
            grams, bits = grams[:0], bits[:0]
        grams, first = np.unique(grams, return_index=True)
        self.index, self.bits_of = pd.Index(grams), bits[first]


def rate_limit(docs: DataFrame, model: Model | None, text_col: str = "text", lang_col: str = "lang", margin: float = 2.0) -> float:
    """Most bits a byte in the quieter windows of a text (see ``_Scorer.quiet``) in a language of ``model``.

    Learned from the whole text of every labelled row of ``docs``, which ``model`` was not fitted on: ``margin`` times the
    highest; never above RAW, which also holds where there are none.
    """
    if model is None:
        return RAW
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for batch in batches:
            for _, _, buf, offs in slabs(batch.column(1)):
                rate = scorer.quiet(buf, offs)[1]
                yield pa.RecordBatch.from_arrays([pa.array(rate[~np.isnan(rate)])], names=["rate"])

    rates = _labelled(docs, text_col, lang_col).mapInArrow(lean(run), "rate double")
    top = rates.agg(F.max("rate")).first()[0]
    return RAW if top is None else min(RAW, margin * top)


_LATIN = np.zeros(256, bool)
_LATIN[65:91] = _LATIN[97:123] = True


def _has_letter(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    seen = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(_LATIN[buf], out=seen[1:])
    found = seen[offs[1:]] > seen[offs[:-1]]
    for k in np.flatnonzero(~found):
        found[k] = any(c.isalpha() for c in buf[offs[k] : offs[k + 1]].tobytes().decode())
    return found


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score, bits_per_byte.

    The whole text is coded under every language's frozen statistics; the shortest code names the
    language (of equal codes the first name in order), ``score`` is its share of the probability that
    all languages give the text, and ``bits_per_byte`` its code length, high for what is no language.
    Null or letterless text is ``und`` with score 0, as is everything when ``model`` is None. Ids may be
    null or repeated; an empty table gives no rows. Memory: the model, kept code lengths, one slab.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = _Scorer(model) if model else None
        for batch in batches:
            for lo, hi, buf, offs in slabs(batch.column(1)):
                known = _has_letter(buf, offs)
                if scorer:
                    bits = scorer.score(buf, offs)
                    best = bits.argmin(axis=1)
                    share = 1 / np.exp2(bits.min(axis=1, keepdims=True) - bits).sum(axis=1)
                    rate = bits.min(axis=1) / np.maximum(np.diff(offs), 1)
                    names = np.array(model.langs, object)[best]
                else:
                    known &= False
                    share = rate = np.zeros(hi - lo)
                    names = np.full(hi - lo, "und", object)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(np.where(known, names, "und"), pa.string()),
                        pa.array(np.where(known, share, 0.0)),
                        pc.if_else(pa.array(known), pa.array(rate), pa.scalar(None, pa.float64())),
                    ],
                    names=["doc_id", "lang_pred", "score", "bits_per_byte"],
                )

    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(lean(run), f"doc_id {kind}, lang_pred string, score double, bits_per_byte double")


def keep_languages(
    docs: DataFrame, model: Model | None, text_col: str = "text", langs: list[str] | None = None, min_score: float = 0.0, limit: float | None = None
) -> DataFrame:
    """``docs`` without the rows whose text is in no known language: those that :func:`identify` calls ``und``, scores
    under ``min_score``, or, with ``langs``, gives another language. The score only tells which language is nearest;
    with ``limit``, as of :func:`rate_limit`, a text also goes if its quieter windows cost more bits a byte. Texts of under 64 bytes are not held against it. Columns and their order stay; no row moves.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = _Scorer(model) if model else None
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for lo, hi, buf, offs in slabs(batch.column(place)):
                keep[lo:hi] = _has_letter(buf, offs)
                if scorer:
                    bits, rate = scorer.quiet(buf, offs)
                    share = 1 / np.exp2(bits.min(axis=1, keepdims=True) - bits).sum(axis=1)
                    keep[lo:hi] &= share >= min_score
                    if limit is not None:
                        keep[lo:hi] &= ~(rate > limit)
                    if langs is not None:
                        keep[lo:hi] &= np.isin(np.array(model.langs)[bits.argmin(axis=1)], langs)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(lean(run), docs.schema) if model else docs.filter("false")


def held_out(doc_id: Column, parts: int = 3) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo ``parts``, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == 1, F.lit(False))
