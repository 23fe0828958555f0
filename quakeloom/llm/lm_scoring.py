"""Log-bilinear language model: noise-contrastive training in numpy on Spark, exact normalised scores."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakeloom.llm._scale import lean, materialise
from quakeloom.llm._text import LOWER, NONSPACE, hashes, mix, signed, slabs, words

#: The hash that stands for the end of a text; no word is hashed to it but by chance.
END = np.uint64(0x5BD1E9955BD1E995)
_STRETCHES = 16


@dataclass(frozen=True)
class LmOptions:
    """classes: vectors there are: of the end, of ``tails`` classes of words by their last letters, and for the rest of the most
    frequent words, each a class of its own. frequent: words whose counts are broadcast (17 bytes each); the counts of all
    others are joined. noise: samples shared by a batch."""

    classes: int = 2048
    tails: int = 256
    dims: int = 32
    noise: int = 48
    batch: int = 4096
    rate: float = 0.06
    frequent: int = 1 << 17
    seed: int = 7


def _tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens, the end after each text's words, what their last two bytes hash to, and the texts' n + 1 token offsets."""
    starts, ends, at = words(buf, offs, NONSPACE)
    own = at + np.arange(len(at))
    out, tail = np.full(own[-1], END, np.uint64), np.zeros(own[-1], np.uint16)
    inside = np.ones(len(out), bool)
    inside[own[1:] - 1] = False
    out[inside] = hashes(buf, starts, ends)
    folded = LOWER[buf].astype(np.uint64)
    last = folded[ends - 1] | np.where(ends - starts > 1, folded[ends - 2], 0).astype(np.uint64) << np.uint64(8)
    tail[inside] = mix(last + np.uint64(1)) >> np.uint64(48)
    return out, tail, own


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def flush():
        h, first, inv = np.unique(np.concatenate([x for x, _, _ in held]), return_index=True, return_inverse=True)
        n = np.bincount(inv, np.concatenate([y for _, y, _ in held])).astype(np.int64)
        tail = np.concatenate([z for _, _, z in held])[first]
        return pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(n), pa.array(tail.astype(np.int32))], names=["word", "n", "tail"])

    for batch in batches:
        for _, _, buf, offs in slabs(batch.column(0)):
            h, tail, _ = _tokens(buf, offs)
            h, first, n = np.unique(h, return_index=True, return_counts=True)
            held.append((h, n, tail[first]))
            size += len(held[-1][0])
            if size > 1_000_000:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


@dataclass
class LmModel:
    """Frozen statistics and vectors. Class 0 is the end (and what stands before a text), then come the words with a class of
    their own, from ``base`` on the classes of all other words by their last letters."""

    frequent: np.ndarray  # sorted hashes
    counts: np.ndarray  # of frequent
    classes: np.ndarray  # of frequent
    p: np.ndarray  # share of each class in training, smoothed
    total: int
    kinds: int
    base: int
    mass: np.ndarray  # for each class the sum of (count + 1/2) over its words, and 1/2 for one not seen; 1 where it is one word
    before1: np.ndarray
    before2: np.ndarray
    target: np.ndarray
    bias: np.ndarray
    log_z: np.ndarray | None = None
    tables: tuple | None = field(default=None, repr=False)

    def classify(self, h: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in ``frequent`` (-1: not there) and class of each token."""
        codes, distinct = pd.factorize(h)
        i = np.searchsorted(self.frequent, distinct)
        i[i == len(self.frequent)] = 0
        found = self.frequent[i] == distinct if len(self.frequent) else np.zeros(len(distinct), bool)
        place = np.where(found, i, -1)[codes]
        own = self.base + tail.astype(np.int64) % (len(self.p) - self.base)
        kind = np.where(place >= 0, self.classes[place], own) if len(self.frequent) else own
        return place, np.where(h == END, 0, kind)

    def normalise(self) -> None:
        """log Z of every pair of preceding classes. The model is bilinear, so all are one matrix product."""
        a, b = self.before1 @ self.target.T, self.before2 @ self.target.T
        ma, mb = a.max(axis=1, keepdims=True), b.max(axis=1, keepdims=True)
        z = (np.exp(a - ma) * np.exp(self.bias)) @ np.exp(b - mb).T
        self.log_z = (np.log(z) + ma + mb.T).astype(np.float32)

    def log_probability(self, kind: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Natural log probability of each token's class after the two before it."""
        if self.tables is None:
            self.tables = (self.before1 @ self.target.T + self.bias, self.before2 @ self.target.T)
        one, two = _before(kind, own)
        return self.tables[0][one, kind] + self.tables[1][two, kind] - self.log_z[one, two]


def _before(kind: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one, two = np.zeros_like(kind), np.zeros_like(kind)
    one[1:], two[2:] = kind[:-1], kind[:-2]
    starts = own[:-1]
    one[starts] = 0
    two[starts] = 0
    second = starts + 1
    two[second[second < own[1:]]] = 0
    return one, two


def _nce(shared, opts: LmOptions):
    """One pass of noise-contrastive estimation over a task's texts; gives the task's vectors, weighted by its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        task = TaskContext.get().partitionId()
        rng = np.random.default_rng([opts.seed, task])
        params = [model.before1.copy(), model.before2.copy(), model.target.copy(), model.bias.copy()]
        memory = [np.full_like(p, 1e-2) for p in params]
        cumulative = np.cumsum(model.p)
        log_noise = (np.log(model.p) + np.log(opts.noise)).astype(np.float32)
        size, seen = len(model.p), 0

        def gather(index, rows):
            return np.stack([np.bincount(index, rows[:, j], minlength=size) for j in range(rows.shape[1])], axis=1)

        def step(w, one, two):
            b1, b2, q, bias = params
            noise = np.minimum(np.searchsorted(cumulative, rng.random(opts.noise)), size - 1)
            r = b1[one] + b2[two]
            right = (r * q[w]).sum(axis=1) + bias[w] - log_noise[w]
            wrong = r @ q[noise].T + (bias[noise] - log_noise[noise])
            g = 1 / (1 + np.exp(np.clip(right, -30, 30)))  # towards the true word
            gn = -1 / (1 + np.exp(-np.clip(wrong, -30, 30)))  # away from the noise
            gr = g[:, None] * q[w] + gn @ q[noise]
            gq = gather(w, g[:, None] * r)
            np.add.at(gq, noise, gn.T @ r)
            gb = np.bincount(w, g, minlength=size)
            np.add.at(gb, noise, gn.sum(axis=0))
            for p, m, d in zip(params, memory, (gather(one, gr), gather(two, gr), gq, gb), strict=True):
                d = (d / np.sqrt(len(w))).astype(np.float32)
                m += d * d
                p += opts.rate * d / np.sqrt(m)

        for batch in batches:
            for _, _, buf, offs in slabs(batch.column(0)):
                h, tail, own = _tokens(buf, offs)
                _, kind = model.classify(h, tail)
                one, two = _before(kind, own)
                order = rng.permutation(len(kind))
                for k in range(0, len(kind), opts.batch):
                    x = order[k : k + opts.batch]
                    step(kind[x], one[x], two[x])
                seen += len(kind)
        if seen:
            flat = np.concatenate([p.ravel() for p in params]).astype(np.float64) * seen
            parts = np.array_split(flat, _STRETCHES)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([task // 256] * _STRETCHES, pa.int64()),
                    pa.array(range(_STRETCHES), pa.int64()),
                    pa.array([seen] * _STRETCHES, pa.int64()),
                    pa.array([x.astype(np.float32).tobytes() for x in parts], pa.binary()),
                ],
                names=["tasks", "stretch", "seen", "vectors"],
            )

    return run


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_buffer(), np.float32).astype(np.float64) for x in table["vectors"])
    seen = sum(table["seen"].to_pylist())
    return pa.table({"tasks": pa.array([0], pa.int64()), "stretch": table["stretch"][:1], "seen": pa.array([seen], pa.int64()), "vectors": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word hash, n, tail: what its last letters hash to) of all tokens of all texts."""
    found = docs.select(F.col(text_col).alias("text")).mapInArrow(lean(_count), "word long, n long, tail int")
    return materialise(found.groupBy("word").agg(F.sum("n").alias("n"), F.min("tail").alias("tail")), "word-counts")


def train(docs: DataFrame, words: DataFrame, text_col: str = "text", opts: LmOptions = LmOptions()) -> LmModel:
    """Fit the model on all of ``docs`` with their :func:`count_words`.

    Each task passes once over all its texts, starting from the same vectors; the tasks' vectors are
    averaged by their tokens, 256 tasks at a time. What reaches the driver is bounded by the options.
    """
    spark = docs.sparkSession
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = words.orderBy(F.desc("n"), "word").limit(opts.frequent).toArrow()
    h, n = top["word"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.lexsort((h, -n))
    tail = top["tail"].to_numpy().astype(np.int64)
    own = [i for i in order if h[i] != END][: max(0, opts.classes - opts.tails - 1)]
    base = 1 + len(own)
    size = base + opts.tails
    kind = base + tail % opts.tails
    kind[own] = np.arange(1, base)
    kind[h == END] = 0
    # all words by last letters, less those with a class of their own
    end = F.lit(int(np.array([END]).view(np.int64)[0]))
    sums, number = np.zeros(size), np.zeros(size)
    by_tail = words.filter(F.col("word") != end).groupBy(F.expr(f"tail % {opts.tails}").alias("t")).agg(F.sum("n").alias("n"), F.count("*").alias("v"))
    for r in by_tail.collect():  # at most opts.tails rows
        sums[base + r.t], number[base + r.t] = r.n, r.v
    np.subtract.at(sums, base + tail[own] % opts.tails, n[own])
    np.subtract.at(number, base + tail[own] % opts.tails, 1)
    mass = sums + 0.5 * (number + 1)
    sums[kind[own]], mass[:base] = n[own], 1.0
    sums[0] = n[h == END].sum()
    p = (sums + 0.5) / (total + 0.5 * size)
    rng = np.random.default_rng(opts.seed)
    near = lambda: (rng.normal(size=(size, opts.dims)) * 0.1).astype(np.float32)
    s = np.argsort(h)
    model = LmModel(
        h[s], n[s], kind[s], p, int(total), int(kinds), base, mass,
        near(), near(), near(), np.log(p).astype(np.float32),
    )
    ddl = "tasks long, stretch long, seen long, vectors binary"
    shared = spark.sparkContext.broadcast(model)
    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(lean(_nce(shared, opts)), ddl)
    table = parts.groupBy("stretch", "tasks").applyInArrow(_add, ddl).groupBy("stretch").applyInArrow(_add, ddl).toArrow().sort_by("stretch")
    if len(table):
        flat = np.concatenate([np.frombuffer(x.as_buffer(), np.float32) for x in table["vectors"]]) / table["seen"][0].as_py()
        cut = np.cumsum([size * opts.dims] * 3)
        one, two, q, bias = np.split(flat.astype(np.float32), cut)
        model.before1, model.before2, model.target = (x.reshape(size, opts.dims) for x in (one, two, q))
        model.bias = bias
    model.normalise()
    return model


def score(docs: DataFrame, words: DataFrame, model: LmModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score, score (log10).

    Tokens are words between white space, A-Z folded, and an end. ``score`` is the log probability of
    the whole text: of each token's class after the two tokens before it, normalised over all classes,
    and for a word without a class of its own its share (count + 1/2) among the words of its class, which is
    that of its last letters, and one unseen. So all words count with their contexts, and as contexts.
    ``base_score`` is that of single words, (c + 1/2) / (N + (V + 1) / 2). The most frequent words'
    counts are broadcast, a number that options bound; a text's other words are joined to ``words``.

    Null text is empty: only the end. Ids may be null or repeated; each row keeps its own score.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    all_words = model.total + 0.5 * (model.kinds + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, row = shared.value, TaskContext.get().partitionId() << 40
        log_all = np.log10((model.counts + 0.5) / all_words)
        log_mass = np.log10(model.mass)
        log_own = np.where(model.classes >= model.base, np.log10(model.counts + 0.5), 0)
        for batch in batches:
            for lo, hi, buf, offs in slabs(batch.column(1)):
                h, tail, own = _tokens(buf, offs)
                place, kind = model.classify(h, tail)
                rare = place < 0
                single = np.where(rare, 0, log_all[place]) if len(log_all) else np.zeros(len(h))
                joint = model.log_probability(kind, own).astype(np.float64) / np.log(10)
                joint -= log_mass[kind]
                joint += np.where(rare, 0, log_own[place]) if len(log_all) else 0
                text = np.repeat(np.arange(hi - lo), np.diff(own))
                sums = [np.bincount(text, x, minlength=hi - lo) for x in (~rare, single, joint)]
                unknown, seen, at = [], [], [0]
                r = np.flatnonzero(rare)
                bounds = np.searchsorted(r, own)
                for k in range(hi - lo):
                    u, c = np.unique(h[r[bounds[k] : bounds[k + 1]]], return_counts=True)
                    unknown.append(signed(u))
                    seen.append(c)
                    at.append(at[-1] + len(u))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + hi - lo), pa.int64()),
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(np.diff(own), pa.int64()),
                        pa.array(sums[0].astype(np.int64)),
                        pa.array(sums[1]),
                        pa.array(sums[2]),
                        pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(unknown), pa.int64())),
                        pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(seen), pa.int64())),
                    ],
                    names=["row", "doc_id", "n_tokens", "n_known", "single", "joint", "rare", "seen"],
                )
                row += hi - lo

    kind = base.schema["doc_id"].dataType.simpleString()
    ddl = f"row long, doc_id {kind}, n_tokens long, n_known long, single double, joint double, rare array<long>, seen array<long>"
    rows = materialise(base.mapInArrow(lean(run), ddl), "scored")
    end = F.lit(int(np.array([END]).view(np.int64)[0]))
    count = F.coalesce(F.col("n"), F.lit(0))
    rare = (
        rows.select("row", F.explode(F.arrays_zip("rare", "seen")).alias("x"))
        .select("row", F.col("x.rare").alias("word"), F.col("x.seen").alias("seen"))
        .join(words, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(count > 0, F.col("seen")).otherwise(0)).alias("known"),
            F.sum(F.col("seen") * F.log10((count + 0.5) / F.lit(float(all_words)))).alias("more_single"),
            F.sum(F.when(F.col("word") == end, 0.0).otherwise(F.col("seen") * F.log10(count + 0.5))).alias("more_joint"),
        )
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.join(rare, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + zero("known")).cast("long").alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("single") + zero("more_single")).cast("double").alias("base_score"),
        (F.col("joint") + zero("more_joint")).cast("double").alias("score"),
    )


def held_out(doc_id: Column, parts: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == 1, F.lit(False))
