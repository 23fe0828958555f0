"""Census of recordings: configurations, spans, duplicates, uniform samples and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quakeloom.operators.ordered import PART, ranged


def configuration_census(headers: DataFrame, source: str, columns: list[str], numeric: bool = False, count: str = "record_count") -> DataFrame:
    """(source, configurations): a JSON array of each combination of ``columns`` with its count, named ``count``.

    Sorted by the values' text, or with ``numeric`` by the values.
    """
    counts = headers.groupBy(source, *columns).agg(F.count("*").alias(count))
    key = F.struct(*[F.col(c) if numeric else F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in columns])
    item = F.struct(key.alias("k"), F.struct(*columns, count).alias("v"))
    listed = counts.groupBy(source).agg(F.array_sort(F.collect_list(item)).alias("x"))
    return listed.select(source, F.to_json(F.transform("x", lambda e: e["v"]), {"ignoreNullFields": "false"}).alias("configurations"))


def uniform_sample(rows: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """Up to ``k`` rows of each group, evenly spread over its order: those at round(i * (n - 1) / (k - 1)), half to even,
    with the group's size as file_count. Rows are dealt to many ranges; only ranges that hold a wanted row are put in order."""
    total = rows.count()
    # a range of few rows: then the rows in order are those of some k ranges a group, not all
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(2000, total // 50_000))
    placed = ranged(rows, keys, order, n)
    counts = placed.groupBy(*keys, PART).agg(F.count("*").alias("here__"))
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*keys)
    counts = counts.withColumns({"before__": F.coalesce(F.sum("here__").over(before), F.lit(0)), "file_count": F.sum("here__").over(group)})
    i = F.sequence(F.lit(0), F.lit(k - 1))
    spots = F.array_distinct(F.transform(i, lambda j: F.bround(j * (F.col("file_count") - 1) / max(1, k - 1)).cast("long") - F.col("before__")))
    spots = F.filter(spots, lambda x: (x >= 0) & (x < F.col("here__")))
    wanted = counts.select(*keys, PART, "file_count", spots.alias("spots__")).filter(F.size("spots__") > 0)
    # at most k ranges a group
    near = placed.join(F.broadcast(wanted), [*keys, PART])
    place = F.row_number().over(Window.partitionBy(PART, *keys).orderBy(*order)) - 1
    return near.withColumn("pos__", place.cast("long")).filter(F.array_contains("spots__", F.col("pos__"))).drop("pos__", "spots__", PART)


def span(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count(value).alias("with_value"), F.count("*").alias("n"))


def duplicate_count(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per group: values beyond the first of each kind; null and empty values do not count."""
    v = F.nullif(F.col(value).cast("string"), F.lit(""))
    return rows.groupBy(*keys).agg((F.count(v) - F.countDistinct(v)).alias("duplicates"))


# The columns of a manifest line.
MANIFEST = ["system", "file", "nSamples", "fs", "Desample", "startTime", "endTime", "nChannels", "dCh", "GaugeLen", "firstSample"]


def manifest_rows(lines: DataFrame, keys: list[str], text: str = "value") -> DataFrame:
    """Fields of manifest lines with ``valid``; short lines, unreadable numbers and rates not above 0 are placeholders."""
    rows = lines.filter(F.trim(text) != "").withColumn("f__", F.split(F.trim(text), r"\s+"))
    field = lambda name: F.get("f__", MANIFEST.index(name))
    numbers = {"nSamples": "bigint", "fs": "double", "Desample": "int", "nChannels": "int", "dCh": "double", "GaugeLen": "double"}
    out = rows.select(
        *keys, F.size("f__").alias("n_fields"), field("startTime").alias("startTime"), field("endTime").alias("endTime"), *[field(c).try_cast(t).alias(c) for c, t in numbers.items()]
    )
    ok = (F.col("n_fields") >= len(MANIFEST)) & (F.col("nSamples") > 0) & (F.col("fs") > 0) & (F.col("Desample") > 0)
    for c in ("nChannels", "dCh", "GaugeLen"):
        ok = ok & F.col(c).isNotNull()
    return out.withColumn("valid", F.coalesce(ok, F.lit(False)))


def manifest_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: lines, valid ones, placeholders, first start and last end (as text, without -1)."""
    known = lambda c: F.when(F.col("valid") & (F.col(c) != "-1"), F.col(c))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("file_count"), F.count(F.when(F.col("valid"), 1)).alias("valid_record_count"), F.count(F.when(~F.col("valid"), 1)).alias("placeholder_count"),
        F.min(known("startTime")).alias("first_start"), F.max(known("endTime")).alias("last_end"),
    )
