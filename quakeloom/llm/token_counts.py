"""Token counts of the sections of documents, from one encoding of each whole document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakeloom.llm._scale import lean
from quakeloom.llm._text import slabs
from quakeloom.llm.tokenizer import default_path, encoder

_DDL = "doc_id {id}, section long, name string, char_start long, char_end long, n_tokens long, n_crossing long"
RULES = ("first", "largest")


def _allocate(rule: str, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token span, and whether it crosses a bound. Sections are [bounds[k], bounds[k + 1])."""
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends - 1, "right") - 1
    crossing = last > first
    if rule == "first" or not crossing.any():
        return first, crossing
    owner = first.copy()
    for t in np.flatnonzero(crossing):
        k = np.arange(first[t], last[t] + 1)
        shared = np.minimum(ends[t], bounds[k + 1]) - np.maximum(starts[t], bounds[k])
        owner[t] = k[np.argmax(shared)]  # of equal shares the earlier
    return owner, crossing


def count_section_tokens(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sections_col: str | None = None,
    rule: str = "largest",
    tokenizer_path: str | None = None,
) -> DataFrame:
    """One row per section of each document: doc_id, section, name, char_start, char_end, n_tokens, n_crossing.

    A document is encoded once, whole, and each token's span of the text is joined to the sections it
    overlaps. Without ``sections_col`` sections are lines, each with its line end; else that column
    holds ``array<struct<name string, start int, end int>>`` of character spans, sorted, disjoint and
    not empty; tokens outside all of them are counted in a row with section -1.

    A token within one section is counted there. One that crosses a bound belongs, by ``rule``
    ``largest``, to the section holding most of its bytes, the earlier if equal; by ``first``, to the
    section of its first byte. So the counts of a document add up to the tokens of its whole text.
    ``n_crossing`` tells how many of a section's tokens cross a bound.

    Null or empty text has no tokens: one row of section 0, empty, 0. Null ids stay null; repeated rows
    give repeated results; an empty table gives none. Memory of a task: one slab and the longest text.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = tokenizer_path or default_path()

    def lines(buf: np.ndarray) -> tuple[np.ndarray, list | None]:
        bounds = np.flatnonzero(buf == 10) + 1
        return np.unique(np.concatenate([[0], bounds, [len(buf)]])), None

    def given(buf: np.ndarray, spans: list) -> tuple[np.ndarray, list]:
        """Byte bounds of all stretches in order, and (section, name) of each; section -1 lies between sections."""
        lead = np.append(np.flatnonzero((buf & 0xC0) != 0x80), len(buf))
        bounds, labels = [0], []
        for k, x in enumerate(spans or []):
            a, b = (int(lead[min(max(v, 0), len(lead) - 1)]) for v in (x["start"], x["end"]))
            if a > bounds[-1]:
                bounds.append(a)
                labels.append((-1, None))
            if b > a:
                bounds.append(b)
                labels.append((k, x["name"]))
        if bounds[-1] < len(buf):
            bounds.append(len(buf))
            labels.append((-1, None))
        return np.array(bounds), labels

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            spans_of = batch.column(2).to_pylist() if sections_col else None
            for lo, hi, buf, offs in slabs(batch.column(1)):
                ids, at = enc.encode(buf, offs)
                ends_all = np.cumsum(enc.byte_lengths[ids], dtype=np.int64)
                chars = np.zeros(len(buf) + 1, np.int64)
                np.cumsum((buf & 0xC0) != 0x80, out=chars[1:])
                doc, out, names = [], [], []
                for k in range(hi - lo):
                    a, b = int(offs[k]), int(offs[k + 1])
                    bounds, labels = lines(buf[a:b]) if spans_of is None else given(buf[a:b], spans_of[lo + k])
                    if b == a:
                        bounds = np.zeros(2, np.int64)
                        labels = None
                    n = len(bounds) - 1
                    ends = ends_all[at[k] : at[k + 1]] - a
                    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                    owner, crossing = _allocate(rule, starts, ends, bounds)
                    count = np.bincount(owner, minlength=n)
                    cross = np.bincount(owner[crossing], minlength=n)
                    at_char = chars[a + bounds] - chars[a]
                    number = np.arange(n) if labels is None else np.array([x for x, _ in labels])
                    doc.append(np.full(n, lo + k))
                    out.append(np.stack([number, at_char[:-1], at_char[1:], count, cross]))
                    names += [None] * n if labels is None else [x for _, x in labels]
                cols = np.concatenate(out, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pc.take(batch.column(0), pa.array(np.concatenate(doc))),
                        pa.array(cols[0], pa.int64()),
                        pa.array(names, pa.string()),
                        *(pa.array(c, pa.int64()) for c in cols[1:]),
                    ],
                    names=["doc_id", "section", "name", "char_start", "char_end", "n_tokens", "n_crossing"],
                )

    cols = [F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")]
    cols += [F.col(sections_col).alias("sections")] if sections_col else []
    base = docs.select(*cols)
    return base.mapInArrow(lean(counted), _DDL.format(id=base.schema["doc_id"].dataType.simpleString()))
