"""Scores of all unordered pairs of traces, block by block, and their band summaries and decisions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


#: Cells of a side of the triangle of pairs, and bytes of vectors that a task holds; more cells than these only for more bytes.
SIDE, HELD = 28, 1 << 26
#: Vectors of a side of a tile, whose pairs are put in order at once, and rows of a batch that leaves it.
TILE, ROWS = 4096, 1 << 17
#: Tasks that the events of :func:`top_anchor_scores` are dealt to, if that many blocks are there.
DEALT = 24


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(cell, side, rows) of batches that are sorted by these two columns, a run of a batch at a time."""
    for batch in batches:
        cell, side = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
        cuts = [0, *(np.flatnonzero(np.diff(cell * 3 + side)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi > lo:
                yield int(cell[lo]), int(side[lo]), batch.slice(lo, hi - lo)


def _dealt(rows: DataFrame, side: int, cells: Column) -> DataFrame:
    """``rows`` once for each of an array of ``cells``, as one side of them."""
    return rows.select(F.explode(cells).alias("cell"), F.lit(side).cast("byte").alias("side"), *rows.columns)


def _in_cells(left: DataFrame, right: DataFrame, n: int) -> DataFrame:
    """Both sides in one shuffle, the rows of each of ``n`` cells together and its left side first."""
    return left.unionByName(right).repartition(min(2048, 2 * n), "cell").sortWithinPartitions("cell", "side")


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """As :func:`_runs`, with the rows of a cell and side put together, ``most`` at a time."""
    at, parts, n = (0, 0), [], 0
    for cell, side, rows in _runs(batches):
        if parts and at != (cell, side):
            yield *at, pa.concat_batches(parts)
            parts, n = [], 0
        at = cell, side
        for lo in range(0, rows.num_rows + n, most):
            parts.append(rows.slice(max(0, lo - n), min(most, lo + most - n)))
            if lo + most <= rows.num_rows + n:
                yield *at, pa.concat_batches(parts)
                parts = []
        n = (rows.num_rows + n) % most
    if parts:
        yield *at, pa.concat_batches(parts)


def _cuts(ids: DataFrame, side: int) -> list[str]:
    """Ids that cut all of them, in order, into ``side`` ranges about equally long."""
    ends = ids.repartitionByRange(side, "id").groupBy(F.spark_partition_id().alias("part")).agg(F.max("id").alias("end")).collect()
    ends = sorted(x.end for x in ends)[:-1]
    step = -(-(len(ends) + 1) // side)
    return ends[step - 1 :: step]


def _blocked_pairs(vectors: DataFrame, prepare, score, names: list[str], ddl: str, block: int, digits: int | None) -> DataFrame:
    """``score`` of every unordered pair of vectors (id, v), tile by tile of what ``prepare`` makes of them; see :func:`_tile` for their order.

    Vectors are dealt to the cells (i, j) of a triangle, i and j being ranges of ids, of ``block`` vectors or more. A task
    holds the vectors of i and lets those of j pass by, so it holds ``HELD`` bytes of them at most. The triangle has
    ``SIDE`` cells a side until these are more bytes than that: what is shuffled is ``SIDE`` times the vectors, though the
    pairs are quadratic.
    """
    if digits is not None and not 0 <= digits <= 10:
        raise ValueError(f"digits must be 0 to 10, not {digits}")
    vectors = vectors.filter("id is not null")
    rows, width = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    cuts = _cuts(vectors.select("id"), max(1, min(SIDE, -(-rows // block)), -(-rows * (width or 1) * 8 // HELD)))
    side = len(cuts) + 1
    b = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: F.col("id") > cut)) if cuts else F.lit(0)
    # the cell of ranges lo <= hi is number hi * (hi + 1) / 2 + lo; in it lo is side 0, hi side 1, and vectors of lo = hi are side 2
    dealt = vectors.select(F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("k"), b.alias("b"), "id", "v")
    low, high = F.least("k", "b"), F.greatest("k", "b")
    role = F.when(F.col("k") > F.col("b"), 0).when(F.col("k") < F.col("b"), 1).otherwise(2)
    dealt = dealt.select((high * (high + 1) / 2 + low).cast("int").alias("cell"), role.cast("byte").alias("side"), "id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for cell, role, batch in _chunks(batches, TILE):
            if cell != at:
                at, held = cell, []
            part = batch.column("id"), prepare(_values(batch))
            if role:
                for other in held:
                    yield from _tile(other, part, False, score, names, digits)
            if role == 2:
                yield from _tile(part, part, True, score, names, digits)
            if role != 1:
                held.append(part)

    cells = dealt.repartitionById(min(2048, side * (side + 1) // 2), "cell").sortWithinPartitions("cell", "side", "id")
    return cells.mapInArrow(run, ddl)


def _values(rows: pa.RecordBatch) -> np.ndarray:
    return rows.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows.num_rows, -1)


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows without their mean and of length 1; NaN for a row without energy."""
    v = v - v.mean(axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _tile(x: tuple, y: tuple, same: bool, score, names: list[str], digits: int | None) -> Iterator[pa.RecordBatch]:
    """A row for each pair of a vector of ``x`` with one of ``y``, whose ids are not smaller; with ``same`` they are one and each pair counts once.

    With ``digits`` the scores are rounded to them, half away from zero, and rows come in order of the score. Written as columns,
    long runs of equal doubles take a byte a row or less, where scores in the order of ids take 8; ids, which then do not repeat,
    take 12 bits. Put in order here, a tile at a time, no row per pair is spilled as in a sort by Spark.
    """
    (ids_x, vx), (ids_y, vy) = x, y
    m, n = len(ids_x), len(ids_y)
    # a key is a whole number of units above the pair's place in the tile; ``none`` stands for NaN, the numbers next to it for infinity
    bits, unit = (m * n).bit_length(), 10.0 ** (digits or 0)
    none = 1 << min(50, 62 - bits)
    keys, more, done = np.empty(0 if digits is None else m * (m - 1) // 2 if same else m * n, np.int64), [], 0

    def batch(at: np.ndarray, scores: np.ndarray, rest: list[np.ndarray]) -> pa.RecordBatch:
        ids = ids_x.take(pa.array(at // n)), ids_y.take(pa.array(at % n))
        return pa.RecordBatch.from_arrays([*ids, pa.array(scores, mask=np.isnan(scores)), *map(pa.array, rest)], names=["a", "b", *names])

    for lo in range(0, m, step := max(1, ROWS // n)):
        scores, *rest = score(vx[lo : lo + step], vy)
        at = np.arange(lo * n, lo * n + scores.size)
        scores = scores.reshape(-1)
        kept = at % n > at // n if same else slice(None)
        if digits is None:
            yield batch(at[kept], scores[kept], [c.reshape(-1)[kept] for c in rest])
            continue
        more = more or [np.empty((m, n), c.dtype) for c in rest]
        for whole, c in zip(more, rest, strict=True):
            whole[lo : lo + step] = c
        scores = scores * unit
        scores = np.clip(np.trunc(scores + np.copysign(0.5, scores)), 1 - none, none - 1)
        found = ((np.where(np.isnan(scores), none, scores).astype(np.int64) << bits) | at)[kept]
        keys[done : done + len(found)] = found
        done += len(found)
    keys.sort()
    for lo in range(0, len(keys), ROWS):
        at, number = keys[lo : lo + ROWS] & ((1 << bits) - 1), keys[lo : lo + ROWS] >> bits
        scores = number / unit
        scores[number == none] = np.nan
        scores[np.abs(number) == none - 1] *= np.inf
        yield batch(at, scores, [c.reshape(-1)[at] for c in more])


def pair_correlation(vectors: DataFrame, block: int = 2048, digits: int | None = None) -> DataFrame:
    """(a, b, score): zero-mean normalised correlation of all unordered pairs of (id, v), rounded to ``digits``; ids as strings, a < b.

    A vector without energy gives a null score. Vectors must be of one length.
    """

    rows = vectors.select(F.col("id").cast("string").alias("id"), "v")
    return _blocked_pairs(rows, _unit, lambda x, y: [x @ y.T], ["score"], "a string, b string, score double", block, digits)


def pair_lagged_peak(vectors: DataFrame, max_lag: int, block: int = 2048, digits: int | None = None) -> DataFrame:
    """(a, b, score, lag): the greatest normalised correlation within ``max_lag`` samples, rounded to ``digits``, and the first lag that has it.

    The norm is that of the whole traces; a positive lag means that a is later than b.
    """

    def score(zx: np.ndarray, zy: np.ndarray) -> list[np.ndarray]:
        norm = np.sqrt((zx * zx).sum(axis=1))[:, None] * np.sqrt((zy * zy).sum(axis=1))[None, :]
        n = zx.shape[1]
        best, lag = np.full(norm.shape, -np.inf), np.zeros(norm.shape, np.int32)
        for k in range(-max_lag, max_lag + 1):
            # sum over t of a[t + k] * b[t]
            c = zx[:, max(0, k) : n + min(0, k)] @ zy[:, max(0, -k) : n - max(0, k)].T
            better = c > best
            np.copyto(best, c, where=better)
            np.copyto(lag, k, where=better)
        with np.errstate(invalid="ignore", divide="ignore"):
            return [best / norm, lag]

    rows = vectors.select(F.col("id").cast("string").alias("id"), "v")
    out = _blocked_pairs(rows, lambda v: v - v.mean(axis=1, keepdims=True), score, ["score", "shift"], "a string, b string, score double, shift int", block, digits)
    return out.select("a", "b", "score", F.col("shift").cast("long").alias("lag"))


class _Best:
    """For the events of one task: by family of anchors, how many scores there were and the ``k`` greatest of them, the least first.

    Scores in single precision say which events may have a greater one in a family, ``slack`` being more than these are off;
    only for them it is worked out in double precision, and only that is kept.
    """

    def __init__(self, ids: list, units: np.ndarray, k: int, block: int):
        self.ids, self.units, self.k, self.block, self.count, self.top = ids, units, k, block, {}, {}
        self.single, self.slack = units.astype(np.float32), (units.shape[1] + 4) * 2.0**-23
        self.rows: dict = {}
        for row, name in enumerate(ids):
            self.rows.setdefault(name, []).append(row)

    def add(self, ids: list, units: np.ndarray, families: list) -> None:
        """Scores of all events with these anchors, but of no event with itself."""
        code: dict = {}
        codes = np.array([code.setdefault(f, len(code)) for f in families], np.int64)
        order = np.argsort(codes, kind="stable")
        units, starts = units[order], np.searchsorted(codes[order], np.arange(len(code)))
        single = units.astype(np.float32).T
        ends = np.append(starts[1:], len(codes))
        own = [(row, at) for at, k in enumerate(order.tolist()) for row in self.rows.get(ids[k], ())]
        own_row, own_at = np.array(own, np.int64).reshape(-1, 2).T
        for c, family in enumerate(code):
            if family not in self.count:
                self.count[family] = np.zeros(len(self.ids), np.int64)
                self.top[family] = np.full((len(self.ids), self.k), -np.inf)
            self.count[family] += ends[c] - starts[c]
            np.subtract.at(self.count[family], own_row[(own_at >= starts[c]) & (own_at < ends[c])], 1)
        for lo in range(0, len(self.ids), self.block):
            hi = min(len(self.ids), lo + self.block)
            scores = self.single[lo:hi] @ single
            here = (own_row >= lo) & (own_row < hi)
            scores[own_row[here] - lo, own_at[here]] = -np.inf
            found = np.maximum.reduceat(scores, starts, axis=1)
            for c, family in enumerate(code):
                top, inside = self.top[family], slice(starts[c], ends[c])
                rows = np.flatnonzero(found[:, c] > top[lo:hi, 0] - self.slack)  # only these may push a score out
                if len(rows):
                    exact = np.where(np.isneginf(scores[rows, inside]), -np.inf, self.units[rows + lo] @ units[inside].T)
                    both = np.concatenate([top[rows + lo], exact], axis=1)
                    top[rows + lo] = np.sort(np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :], axis=1)

    def batches(self, family_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        ids = pa.array(self.ids, pa.string())
        for family, n in self.count.items():
            some = np.flatnonzero(n)
            for rows in (some[lo : lo + 10_000] for lo in range(0, len(some), 10_000)):
                top = self.top[family][rows, ::-1]
                kept = top > -np.inf
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(kept.sum(axis=1))), pa.int32()), pa.array(top[kept]))
                names = pa.array([family] * len(rows), family_type)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), names, pa.array(n[rows]), lists], names=["event_id", "scored_sequence_id", "n", "top"])


def top_anchor_scores(vectors: DataFrame, population: DataFrame, k: int, block: int = 512, stripe: int | None = None) -> DataFrame:
    """(event_id, scored_sequence_id, eligible_anchor_count, top): per event and family of anchors the ``k`` greatest correlations, falling.

    vectors: id, v; population: event_id, sequence_id, available. Anchors are the available events of the
    population; an event is no anchor of its own, and pairs without a score do not count. A task holds its events,
    ``HELD`` bytes of them and their scores at most (and ``stripe`` blocks, if given), and what :class:`_Best` keeps of the
    anchors that pass by. Events are dealt to ``DEALT`` tasks until these hold more than that, so what is shuffled are so
    many copies of the anchors; what leaves a task is bounded by events times families and not by pairs.
    """
    own = population.select(F.col("event_id").cast("string").alias("id"), F.col("sequence_id").alias("family"), F.coalesce("available", F.lit(False)).alias("anchor"))
    vectors = vectors.select(F.col("id").cast("string").alias("id"), "v").filter("id is not null")
    total, width = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    families = own.filter("anchor").agg(F.countDistinct("family")).first()[0] + 1
    held = max(block, HELD // (12 * (width or 1) + 8 * families * (k + 1)))
    held = held if stripe is None else min(block * stripe, held)
    tasks = max(1, min(DEALT, -(-total // block)), -(-total // held))
    rows = vectors.join(own, "id", "left").fillna(False, ["anchor"])
    left = _dealt(rows.select("id", "v", F.lit(None).cast(own.schema["family"].dataType).alias("family")), 0, F.array(F.pmod(F.xxhash64("id"), F.lit(tasks)).cast("int")))
    right = _dealt(rows.filter("anchor").select("id", "v", "family"), 1, F.sequence(F.lit(0), F.lit(tasks - 1)))
    kind = own.schema["family"].dataType
    family_type = to_arrow_type(kind)

    def scored(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, units = np.array(batch.column("id").to_pylist(), object), _unit(_values(batch))
        good = np.flatnonzero(~np.isnan(units).any(axis=1))  # the others have no score with anything
        return ids[good], units[good], good

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, events, best = None, [], None
        for cell, side, batch in _runs(batches):
            if cell != at:
                if best is not None:
                    yield from best.batches(family_type)
                at, events, best = cell, [], None
            if side == 0:
                events.append(scored(batch)[:2])
                continue
            if best is None:
                if not events:
                    continue
                best = _Best(np.concatenate([e[0] for e in events]).tolist(), np.concatenate([e[1] for e in events]), k, block)
                events = []
            for lo in range(0, batch.num_rows, 4 * block):
                part = batch.slice(lo, 4 * block)
                ids, units, good = scored(part)
                if len(ids):
                    best.add(ids.tolist(), units, part.column("family").take(pa.array(good)).to_pylist())
        if best is not None:
            yield from best.batches(family_type)

    found = _in_cells(left, right, tasks).mapInArrow(run, f"event_id string, scored_sequence_id {kind.simpleString()}, n long, top array<double>")
    merged = F.slice(F.sort_array(F.flatten(F.collect_list("top")), asc=False), 1, k)
    return found.groupBy("event_id", "scored_sequence_id").agg(F.sum("n").alias("eligible_anchor_count"), merged.alias("top"))


@dataclass(frozen=True)
class PairOptions:
    min_snr: float = 3.0
    min_components: int = 6
    min_stations: int = 3
    family_median: float = 0.85
    family_weakest_band: float = 0.75
    control_median: float = 0.75


def longest_traces(traces: DataFrame) -> DataFrame:
    """Of the traces of an event with one key the longest; of equally long ones the first in stream order."""
    from pyspark.sql import Window

    w = Window.partitionBy("event_id", "trace_key").orderBy(F.desc("npts"), "stream_order")
    return traces.withColumn("rank__", F.row_number().over(w)).filter("rank__ = 1").drop("rank__")


def usable(correlation, ref_snr, cmp_snr, opts: PairOptions = PairOptions()):
    """Whether a metric row counts: a finite correlation and enough signal on both sides."""
    return correlation.isNotNull() & ~F.isnan(correlation) & (F.least(ref_snr, cmp_snr) >= opts.min_snr)


def band_summary(metrics: DataFrame, bands: list[str]) -> DataFrame:
    """Per pair and band: components, stations, median, least and 10th percentile of usable correlations; every band has a row.

    metrics: pair_name, band, station, correlation, usable.
    """
    spine = metrics.select("pair_name").distinct().withColumn("band", F.explode(F.array(*[F.lit(b) for b in bands])))
    rows = spine.join(metrics.filter("usable").select("pair_name", "band", "station", "correlation"), ["pair_name", "band"], "left")
    c = F.col("correlation")
    return rows.groupBy("pair_name", "band").agg(
        F.count(c).alias("usable_components"), F.countDistinct("station").alias("usable_stations"), F.median(c).alias("median_correlation"),
        F.min(c).alias("minimum_correlation"), F.percentile(c, 0.1).alias("p10_correlation"),
    )


def pair_decision(metrics: DataFrame, bands: list[str], opts: PairOptions = PairOptions()) -> DataFrame:
    """Per pair: least counts over bands, overall and weakest-band median, decision and status."""
    weakest = band_summary(metrics, bands).groupBy("pair_name").agg(
        F.min("usable_components").alias("minimum_components_per_band"), F.min("usable_stations").alias("minimum_stations_per_band"),
        F.min("median_correlation").alias("weakest_band_median_correlation"),
    )
    overall = metrics.filter("usable").groupBy("pair_name").agg(F.median("correlation").alias("overall_median_correlation"), F.count("*").alias("usable_metric_count"))
    rows = weakest.join(overall, "pair_name", "left").fillna(0, ["usable_metric_count"])
    enough = (F.col("minimum_components_per_band") >= opts.min_components) & (F.col("minimum_stations_per_band") >= opts.min_stations)
    family = enough & F.coalesce((F.col("overall_median_correlation") >= opts.family_median) & (F.col("weakest_band_median_correlation") >= opts.family_weakest_band), F.lit(False))
    return rows.withColumns(
        {"decision": F.when(family, "family").when(enough, "not_family").otherwise("insufficient_data"), "status": F.when(enough, "PASS").otherwise("STOP")}
    )


def control_gate(decisions: DataFrame, gates: DataFrame, opts: PairOptions = PairOptions()) -> DataFrame:
    """(candidate, control, candidate_decision, control_decision, status): PASS if the candidate pair is a family, its control is not and the control's median is low.

    decisions: :func:`pair_decision`; gates: candidate, control, names of pairs. A pair without a decision passes nothing.
    """
    one = decisions.select(F.col("pair_name").alias("candidate"), F.col("decision").alias("found__"))
    two = decisions.select(F.col("pair_name").alias("control"), F.col("decision").alias("other__"), F.col("overall_median_correlation").alias("median__"))
    ok = (F.col("found__") == "family") & (F.col("other__") == "not_family") & (F.col("median__") <= opts.control_median)
    return gates.join(one, "candidate", "left").join(two, "control", "left").select("candidate", "control", F.col("found__").alias("candidate_decision"), F.col("other__").alias("control_decision"), F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("STOP").alias("status"))
