"""How filters interact: who removes what in which order, and each filter's Shapley share, from one polynomial a part."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakeloom.llm._scale import lean, materialise

#: A document's text to whether it fails.
Filter = Callable[[Column], Column]


def _count(text: Column, kept: str) -> Column:
    """Characters of ``text`` in the set ``kept``."""
    return F.length(F.regexp_replace(text, f"[^{kept}]+", ""))


def words(text: Column) -> Column:
    """Maximal runs of characters but space and 09-0D."""
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


#: Under 50 words; under 65 % distinct words; over 5 % of A-Z; any of #$%&*|.
STANDARD: dict[str, Filter] = {
    "A": lambda t: F.size(words(t)) < 50,
    "B": lambda t: 100 * F.size(F.array_distinct(words(t))) < 65 * F.size(words(t)),
    "C": lambda t: 100 * _count(t, "A-Z") > 5 * F.length(t),
    "D": lambda t: t.rlike("[#$%&*|]"),
}


class RemovalPolynomial:
    """The multilinear extension of "documents that fail a filter of the set".

    ``counts[m]`` documents fail exactly the filters of bit mask m. With x_i the chance that filter i is
    used, sum of counts[m] * (1 - product over i in m of (1 - x_i)) are removed; ``terms[s]`` is the
    coefficient of the product of x_i over i in s.
    """

    def __init__(self, counts: list[int]):
        self.n, self.total = len(counts).bit_length() - 1, sum(counts)
        above = list(counts)  # documents that fail at least the filters of a mask
        for bit in range(self.n):
            for m in range(len(above)):
                if not m >> bit & 1:
                    above[m] += above[m | 1 << bit]
        self.terms = [0] + [above[m] if m.bit_count() % 2 else -above[m] for m in range(1, len(above))]
        # at a corner the terms of all its subsets
        self.corners = list(self.terms)
        for bit in range(self.n):
            for m in range(len(self.corners)):
                if m >> bit & 1:
                    self.corners[m] += self.corners[m ^ 1 << bit]

    def shapley(self, i: int) -> Fraction:
        """The partial derivative in x_i, on the diagonal x = (t, ..., t) a polynomial in t, integrated from 0 to 1."""
        powers = [Fraction(0)] * self.n
        for m, a in enumerate(self.terms):
            if m >> i & 1:
                powers[m.bit_count() - 1] += a
        return sum((a / (k + 1) for k, a in enumerate(powers)), Fraction(0))


_FIELDS = [
    ("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), ("kept", pa.int64()), ("removed", pa.int64()), ("redundant", pa.int64()),
    ("unique_fails", pa.int64()), ("good_lost", pa.int64()), ("toxic_lost", pa.int64()), ("shapley", pa.int64()),
]


def interactions(part: str, letters: str, docs: list[int], good: list[int], toxic: list[int]) -> list[tuple]:
    """The rows of one part: every order of the filters, every step of it."""
    f, g, x = (RemovalPolynomial(c) for c in (docs, good, toxic))
    every, scale = (1 << f.n) - 1, math.factorial(f.n)
    shares = [f.shapley(i) * scale for i in range(f.n)]
    assert all(s.denominator == 1 for s in shares)
    rows = []
    for order in permutations(range(f.n)):
        name, used = "".join(letters[i] for i in order), 0
        for step, i in enumerate(order, 1):
            now = used | 1 << i
            removed = f.corners[now] - f.corners[used]
            rows.append(
                (part, name, step, f.total - f.corners[now], removed, f.corners[1 << i] - removed, f.corners[every] - f.corners[every ^ 1 << i],
                 g.corners[now] - g.corners[used], x.corners[now] - x.corners[used], int(shares[i]))
            )
            used = now
    return rows


def mask_counts(docs: DataFrame, labels: DataFrame, filters: dict[str, Filter], id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the exact set of filters they fail; bit k for the k-th filter, the bit after the last for a repeated text.

    A repeated text is one whose digest some smaller id has too. Its copies are counted with all others
    first; then only the rows with the least id of each digest, found by a combined minimum and an equi-join
    on digest and id, are moved over. So no group of copies is gathered or joined to one row.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    mask = F.lit(0)
    for k, fails in enumerate(filters.values()):
        mask = mask + F.when(F.coalesce(fails(text), F.lit(False)), 1 << k).otherwise(0)
    again = 1 << len(filters)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), mask.alias("mask"))
    said = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long"))
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("labelled")).agg(said("quality").alias("good"), said("toxic").alias("toxic"))
    rows = rows.join(known, F.col("id") == F.col("labelled"), "left").drop("labelled").fillna(0, ["good", "toxic"])
    counted = materialise(rows.groupBy("id", "part", "digest", "mask", "good", "toxic").agg(F.count("*").alias("n")), "audited")
    least = counted.filter("id is not null").groupBy("digest").agg(F.min("id").alias("id"))
    first = counted.join(least, ["digest", "id"], "left_semi")
    none = counted.filter("id is null")  # a null id is not greater than another
    own = first.unionByName(none).groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))
    moved = own.select("part", "good", "toxic", F.explode(F.array(F.struct("mask", "n"), F.struct((F.col("mask") + again).alias("mask"), (-F.col("n")).alias("n")))).alias("m"))
    parts = counted.groupBy("part", (F.col("mask") + again).alias("mask"), "good", "toxic").agg(F.sum("n").alias("n")).unionByName(moved.select("part", "m.mask", "good", "toxic", "m.n"))
    return parts.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def audit_filters(
    docs: DataFrame, labels: DataFrame, filters: dict[str, Filter] = STANDARD, duplicate: str = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> DataFrame:
    """One row per part, order of the filters (all permutations of their letters, applied left to right) and step.

    Columns: part, filter_order, step (from 1; its filter is that letter of the order), and counts of the
    part's documents: kept after the step, removed in it, redundant (fail its filter, removed earlier),
    unique_fails (fail its filter only), good_lost and toxic_lost (removed in it, with quality or toxic 1 in
    ``labels``), shapley (removed by the filter, summed over all orders). The last filter, named
    ``duplicate``, fails texts identical to that of any smaller id in the whole table.

    From each part's counts by set of failed filters its removal polynomial is made: values at corners are
    what a set of filters removes, and Shapley shares are integrals of partial derivatives, exact
    rationals times the number of orders. Rows of ``docs`` are read once; a part is at most 2 ** filters counts.

    Null text is empty; a null part is the empty string; a filter that is null does not fail; a null id has no labels and is never
    a duplicate; rows of one id and text are no duplicates of one another; several labels of an id count if one
    is 1. Empty tables give no rows.
    """
    if len(duplicate) != 1 or any(len(x) != 1 for x in filters) or duplicate in filters or len(filters) > 6:
        raise ValueError("filters have different one-letter names, and are at most seven")
    letters, size = "".join(filters) + duplicate, 2 << len(filters)
    counts = mask_counts(docs, labels, filters, id_col, text_col, part_col)
    listed = counts.filter("n > 0").groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tables = {c: [0] * size for c in ("n", "good", "toxic")}
                for x in found:
                    for c, table in tables.items():
                        table[x["mask"]] = x[c]
                rows = interactions(part, letters, tables["n"], tables["good"], tables["toxic"])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _FIELDS, strict=True)], names=[n for n, _ in _FIELDS])

    counted = "kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return listed.mapInArrow(lean(run), f"part string, filter_order string, step int, {counted}")
