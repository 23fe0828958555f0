"""Fill-in-the-middle: cut texts between words into prefix, middle and suffix, and put the middle last."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quakeloom.llm._scale import lean

#: Characters between words: space and 09-0D.
_SPACE = np.array([9, 10, 11, 12, 13, 32], "<u4")
#: Code points of output after which a batch leaves a task.
_FLUSH = 1 << 22


def _check(markers: tuple[str, str, str]) -> None:
    """Markers must be told apart wherever they meet text or one another: none may hold or overlap another, or itself."""
    if len(set(markers)) < 3 or not all(markers):
        raise ValueError("three different markers are needed, none of them empty")
    for a in markers:
        for b in markers:
            if (a != b and a in b) or any(a.endswith(b[:k]) for k in range(1, len(b))):
                raise ValueError(f"markers {a!r} and {b!r} overlap")


def boundaries(points: np.ndarray) -> np.ndarray:
    """Offsets 0, after each word, and the end: token k is [out[k], out[k + 1]), a word with the white space before it.

    White space at the end of a text is a token of its own. ``points`` are the text's code points.
    """
    space = np.isin(points, _SPACE)
    after = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.concatenate([[0], after, [len(points)]]) if len(points) else np.zeros(1, np.int64)


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of an id and ``seed``: groups of eight hexadecimal digits of a SHA-256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = 50,
    spm_percent: int = 80,
    seed: int = 42,
    markers: tuple[str, str, str] = ("<P>", "<S>", "<M>"),
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars, output.

    A text is an array of code points; where its class (word or white space) changes from word to white
    space, a token ends. Two ranks drawn from the id among the n + 1 token ends cut it into prefix, middle
    and suffix, each of which may be empty. ``percent`` of the texts are transformed, of these
    ``spm_percent`` with the suffix first: S suffix P prefix M middle; else P prefix S suffix M middle.
    Texts that hold a marker stay plain, so an output gives its text back; see :func:`restore`.

    Null text is empty and plain with n = 0; a null id draws like an empty one; repeated rows give the same
    row again; an empty table gives no rows. Other columns are not read. A task holds a batch of texts
    and the code points of one of them.
    """
    _check(markers)
    head, tail, mid = markers
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.array(*draws(F.col(id_col), seed)).alias("h"))
    id_type = to_arrow_type(base.schema["doc_id"].dataType)
    fields = [("doc_id", id_type), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.large_string())]

    def cut(text: str, h: list[int]) -> tuple[int, str, int | None, int | None, str]:
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        ends = boundaries(points)
        n = len(ends) - 1
        if not n or h[2] % 100 >= percent or any(m in text for m in markers):
            return n, "plain", None, None, text
        one, two = (int(ends[r]) for r in sorted((h[0] % (n + 1), h[1] % (n + 1))))
        prefix, middle, suffix = (p.tobytes().decode("utf-32-le") for p in (points[:one], points[one:two], points[two:]))
        if h[3] % 100 < spm_percent:
            return n, "spm", one, two - one, f"{tail}{suffix}{head}{prefix}{mid}{middle}"
        return n, "psm", one, two - one, f"{head}{prefix}{tail}{suffix}{mid}{middle}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, rows, size = 0, [], 0
            for k in range(batch.num_rows):
                rows.append(cut(batch.column(1)[k].as_py() or "", batch.column(2)[k].as_py()))
                size += len(rows[-1][-1])
                if size >= _FLUSH or k + 1 == batch.num_rows:
                    columns = zip(*rows, strict=True)
                    arrays = [batch.column(0).slice(lo, len(rows)), *(pa.array(c, t) for c, (_, t) in zip(columns, fields[1:], strict=True))]
                    yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema(fields))
                    lo, rows, size = k + 1, [], 0

    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(lean(run), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: Column, form: Column, markers: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> Column:
    """The text that :func:`fill_in_middle` made ``output`` of, from the output and its form alone."""
    _check(markers)
    parts = F.split(output, "|".join(re.escape(m) for m in markers), -1)
    one, two, middle = (F.get(parts, k) for k in (1, 2, 3))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).when(form == "spm", F.concat(two, middle, one))
