"""Sinks: CSV tables with a header, deterministic JSON documents, Parquet."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_rows(df: DataFrame, path: str) -> None:
    """A CSV folder with header; an empty table is an error. Nested columns are written as JSON text."""
    if df.isEmpty():
        raise ValueError("no rows to write")
    nested = {c: F.to_json(c, {"ignoreNullFields": "false"}) for c, t in df.dtypes if t.startswith(("array", "map", "struct"))}
    df.withColumns(nested).write.mode("overwrite").option("header", "true").csv(path)


def write_union(tables: list[DataFrame], path: str) -> None:
    """Tables with different columns as one CSV with all of them."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    write_rows(out, path)


def write_status(df: DataFrame, path: str) -> None:
    """A one-row table as a JSON document with sorted keys, two spaces of indent and a final line end."""
    row = json.loads(df.limit(1).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j")).first()["j"])
    Path(path).write_text(json.dumps(row, indent=2, sort_keys=True) + "\n")
