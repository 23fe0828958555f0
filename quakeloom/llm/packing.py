"""Bounded-space online packing of token sequences into windows of fixed length."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quakeloom.llm._scale import lean, materialise
from quakeloom.llm._text import slabs
from quakeloom.llm.tokenizer import default_path, encoder

#: A document's piece before it has a place: id, first token, tokens of the document, ids.
Piece = tuple[object, int, int, np.ndarray]

_FIELDS = [
    ("start", pa.int64()),
    ("length", pa.int64()),
    ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()),
    ("offset", pa.int64()),
    ("ids", pa.binary()),
]
_DDL = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


class _Out:
    """Placed pieces, column by column. Ids leave as bytes where they are wanted or not yet placed for good."""

    def __init__(self, base: int, with_ids: bool, id_type: pa.DataType):
        self.base, self.with_ids, self.made, self.rows = base, with_ids, 0, []
        self.fields = [("doc_id", id_type), *_FIELDS]

    def sequence(self, pieces: list[Piece], number: int | None = None) -> None:
        """A whole sequence; with ``number`` given (below 0) an unfinished one for the next merge."""
        seq = self.base + self.made if number is None else number
        self.made += number is None
        offset = 0
        for doc, start, total, ids in pieces:
            raw = ids.astype("<u4").tobytes()
            self.rows.append((doc, start, len(ids), zlib.crc32(raw), total, seq, offset, raw if self.with_ids or number is not None else None))
            offset += len(ids)

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(self.fields)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, self.fields, strict=True)], names=[n for n, _ in self.fields])


def _cut(pieces: list[Piece], size: int) -> Iterator[list[Piece]]:
    """The pieces in order as runs of ``size`` tokens, cut where a run is full; the last may be shorter."""
    run, room = [], size
    for doc, start, total, ids in pieces:
        while len(ids):
            part, ids = ids[:room], ids[room:]
            run.append((doc, start, total, part))
            start, room = start + len(part), room - len(part)
            if not room:
                yield run
                run, room = [], size
    if run:
        yield run


class _Open:
    """At most ``most`` open windows, found by free space."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.free, self.windows, self.next = size, most, [], {}, 0

    def place(self, piece: Piece, out: _Out) -> None:
        doc, start, total, ids = piece
        while len(ids):
            k = bisect_left(self.free, (len(ids), -1))
            if k < len(self.free):  # the least space that is enough
                room, name = self.free.pop(k)
                window = self.windows[name]
                part, ids = ids, ids[:0]
            elif len(self.free) < self.most:
                room, name, window = self.size, self.next, []
                self.windows[name] = window
                self.next += 1
                part, ids = ids, ids[:0]
            else:  # the fullest is filled with the piece's head and goes
                room, name = self.free.pop(0)
                window = self.windows[name]
                part, ids = ids[:room], ids[room:]
            window.append((doc, start, total, part))
            start += len(part)
            if room == len(part):
                out.sequence(self.windows.pop(name))
            else:
                insort(self.free, (room - len(part), name))

    def leftovers(self) -> list[Piece]:
        return [p for _, name in self.free for p in self.windows[name]]


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 2048,
    open_windows: int = 32,
    end_id: int = 1,
    tokenizer_path: str | None = None,
    merge: int = 64,
    with_ids: bool = False,
) -> DataFrame:
    """Pack all documents into sequences of at most ``window`` tokens; one row per piece of a document.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (little-endian
    uint32 bytes) with ``with_ids``. A document is its token ids and ``end_id``. Whole windows are cut
    off a long document; what remains goes to the open window with the least sufficient space, else to
    a new one, else its head fills the fullest, which is emitted. At most ``open_windows`` are open in
    a partition. At its end they are merged into full windows; the one remainder of each partition is
    merged with those of ``merge`` - 1 others, and what a merge leaves is cut into sequences of powers
    of two, which need no padding.

    Null text is empty (only ``end_id``); null ids stay null, ids keep their type; repeated rows are packed
    as often as they stand; an empty table gives no rows. Memory of a task: the Arrow batches in and out,
    one slab of texts, the open windows, and the longest document. A task that is run again gives the same pieces, and the table of placed pieces is
    written before the remainders are merged.
    """
    path = tokenizer_path or default_path()
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ddl = _DDL.format(id=base.schema["doc_id"].dataType.simpleString())
    id_type = to_arrow_type(base.schema["doc_id"].dataType)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, opened = encoder(path), _Open(window, open_windows)
        out = _Out(TaskContext.get().partitionId() << 32, with_ids, id_type)
        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            for lo, _, buf, offs in slabs(batch.column(1)):
                ids, at = enc.encode(buf, offs)
                for k in range(len(offs) - 1):
                    own = np.append(ids[at[k] : at[k + 1]], np.uint32(end_id))
                    total, doc = len(own), ids_of[lo + k]
                    whole = total // window * window
                    for s in range(0, whole, window):
                        out.sequence([(doc, s, total, own[s : s + window])])
                    if whole < total:
                        opened.place((doc, whole, total, own[whole:]), out)
                yield out.batch()
        for run in _cut(opened.leftovers(), window):
            full = sum(len(p[3]) for p in run) == window
            out.sequence(run, None if full else -1 - TaskContext.get().partitionId())
        yield out.batch()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by([("sequence_id", "descending"), ("offset", "ascending")])
        rows = table.to_pylist()
        out = _Out((1 << 62) + ((-1 - rows[0]["sequence_id"]) // merge << 20), with_ids, id_type)
        pieces = [(r["doc_id"], r["start"], r["doc_tokens"], np.frombuffer(r["ids"], "<u4")) for r in rows]
        for run in _cut(pieces, window):
            left = sum(len(p[3]) for p in run)
            if left == window:
                out.sequence(run)
                continue
            while left:
                part = 1 << left.bit_length() - 1
                head, *tail = _cut(run, part)
                out.sequence(head)
                run, left = [p for r in tail for p in r], left - part
        yield out.batch()

    pieces = materialise(base.mapInArrow(lean(placed), ddl), "packed")
    rest = (
        pieces.filter("sequence_id < 0")
        .groupBy(F.floor((-1 - F.col("sequence_id")) / F.lit(merge)).alias("g"))
        .applyInArrow(merged_group(merged), ddl)
    )
    out = pieces.filter("sequence_id >= 0").unionByName(rest)
    return out if with_ids else out.drop("ids")


def merged_group(f):
    """A grouped function from one on batches; a group holds under one window from each of ``merge`` partitions."""

    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(f(iter(table.select(["doc_id", *(n for n, _ in _FIELDS)]).to_batches()))))

    return run
