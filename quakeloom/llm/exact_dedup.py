"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakeloom.llm._scale import ROW, bucket, drop_rows, keep, mark_buckets, materialise, numbered, working_tables

#: White space that does not count when texts are compared.
SPACE = r"[\x20\x09-\x0D]+"


def _normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 256, digest_all: bool = False, row_col: str | None = None
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, full_hash, and with ``row_col`` row.

    Texts are equal when identical without white space. The row with the longest original text, then
    the smallest id, stays. Groups are refined in three steps: equal length, equal hash of the first
    ``prefix_chars`` characters, equal SHA-256; a row alone after a step goes no further, so its text
    is not hashed in full and ``full_hash`` (32 bytes) is null, unless ``digest_all`` asks for it.

    Null text is empty, and all empty texts are one group. A null id sorts before all others. Rows
    that share an id and a text are one document repeated: with the smallest id all of them are kept,
    but if ``row_col`` names a column that numbers the rows, only the first of them is. An empty table gives an empty result; other columns of ``docs``, whatever their names, are unread.
    A group of any size is pre-aggregated in each task and never gathered.
    """
    row = F.lit(None).cast("long") if row_col is None else F.col(row_col)
    base = docs.select(row.alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    base = base.select(
        "row", "doc_id", F.char_length(F.coalesce("t", F.lit(""))).cast("long").alias("n_chars"), _normalised(F.col("t")).alias("norm")
    )
    base = base.withColumn("len", F.char_length("norm")).withColumn("prefix", F.xxhash64(F.substring("norm", 1, prefix_chars)))

    keys = materialise(base.select("len", "prefix"), "exact-keys")
    by_length = keys.groupBy("len").agg(F.count("*").alias("n")).filter("n > 1").select("len")
    by_prefix = (
        keys.join(by_length, "len", "left_semi").groupBy("len", "prefix").agg(F.count("*").alias("n")).filter("n > 1")
    ).select("len", "prefix")

    marked = mark_buckets(base, bucket(F.col("len"), F.col("prefix")), by_prefix, "shared")
    digest = F.unhex(F.sha2("norm", 256))
    rows = materialise(
        marked.select("row", "doc_id", "n_chars", "shared", (digest if digest_all else F.when(F.col("shared"), digest)).alias("full_hash")),
        "exact-digests",
    )
    groups = (
        rows.filter("shared")
        .groupBy(F.col("full_hash").alias("h"))
        .agg(F.count("*").alias("size"), F.min(F.struct((-F.col("n_chars")).alias("short"), "doc_id", "row")).alias("best"))
        .filter("size > 1")
        .select("h", "size", F.col("best.doc_id").alias("best"), F.col("best.row").alias("best_row"))
    )
    groups = materialise(groups, "exact-groups")  # aggregated before the join, so that a hot digest's rows can be split there
    keep = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("best"))
    return rows.join(groups, F.col("full_hash") == F.col("h"), "left").select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("doc_id").eqNullSafe(keep) & (F.col("size").isNull() | F.col("row").eqNullSafe(F.col("best_row")))).alias("kept"),
        "full_hash",
        *(["row"] if row_col else []),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, as :func:`exact_dedup` chooses; columns as they were.

    Decisions are made and carried out on rows: a row stays or goes whatever other rows share its id, null or not.
    """
    rows = numbered(docs)
    with working_tables(docs.sparkSession):
        gone = keep(exact_dedup(rows, id_col, text_col, row_col=ROW).filter(~F.col("kept")).select("row"), "exact-dropped")
    return drop_rows(rows, gone)
