"""Census, sample and manifest queries, with order lines as headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.functions.scalar import filename_epoch
from quakeloom.operators import coverage


def _source():
    return F.concat_ws("-", "l_linestatus", (F.col("l_suppkey") % 5).cast("string"))


def _headers(spark: SparkSession, d: str) -> DataFrame:
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return li.select(_source().alias("source_name"), F.col("l_linenumber").cast("int").alias("channel_count"), F.col("l_returnflag").alias("raw_data_unit"), "l_orderkey", "l_linenumber", "l_partkey")


def coverage_census(spark: SparkSession, d: str) -> DataFrame:
    return coverage.configuration_census(_headers(spark, d), "source_name", ["channel_count", "raw_data_unit"])


def uniform_header_sample(spark: SparkSession, d: str) -> DataFrame:
    return coverage.uniform_sample(_headers(spark, d), ["source_name"], ["l_orderkey", "l_linenumber"], 7).select("source_name", "l_orderkey", "l_linenumber", "file_count")


def uuid_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return coverage.duplicate_count(_headers(spark, d), ["source_name"], "l_partkey")


def filename_span(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HHmmss")
    path = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("raw_"), stamp, F.lit(".h5"))).otherwise(F.concat(F.lit("raw_"), stamp, F.lit("Z.h5")))
    rows = e.select("event_type", filename_epoch(path).cast("timestamp_ntz").alias("stamp"))
    out = coverage.span(rows, ["event_type"], "stamp")
    return out.select("event_type", F.col("first").alias("first_stamp"), F.col("last").alias("last_stamp"), F.col("with_value").alias("stamped"), F.col("n").alias("file_count"))


def manifest_summary(spark: SparkSession, d: str) -> DataFrame:
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    s = lambda c: F.col(c).cast("string")
    full = F.concat_ws(" ", F.lit("sys"), s("l_orderkey"), F.when(F.col("l_orderkey") % 11 == 0, "n/a").otherwise(s("l_partkey")), F.when(F.col("l_orderkey") % 13 == 0, "0").otherwise("1000.0"), F.lit("2"),
                       F.when(F.col("l_orderkey") % 3 == 0, "-1").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")), F.date_format("l_shipdate", "yyyy-MM-dd"), s("l_linenumber"), F.lit("2.0"), F.lit("10.0"), F.lit("0"))
    line = F.when(F.col("l_orderkey") % 17 == 0, F.lit("sys short line")).otherwise(full)
    rows = coverage.manifest_rows(li.select(_source().alias("source_name"), line.alias("value")), ["source_name"])
    return coverage.manifest_summary(rows, ["source_name"])


_H = "WITH h AS (SELECT l_linestatus || '-' || (l_suppkey % 5) AS source_name, l_linenumber::INT AS channel_count, l_returnflag AS raw_data_unit, l_orderkey, l_linenumber, l_partkey FROM lineitem)\n"

QUERIES = {f.__name__: f for f in (coverage_census, uniform_header_sample, uuid_duplicates, filename_span, manifest_summary)}

SQL = {
    "coverage_census": _H
    + """, c AS (SELECT source_name, channel_count, raw_data_unit, count(*) AS n FROM h GROUP BY 1, 2, 3)
SELECT source_name, '[' || string_agg('{"channel_count":' || channel_count || ',"raw_data_unit":"' || raw_data_unit || '","record_count":' || n || '}', ',' ORDER BY channel_count::VARCHAR, raw_data_unit) || ']' AS configurations FROM c GROUP BY 1""",
    "uniform_header_sample": _H
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY l_orderkey, l_linenumber) - 1 AS p, count(*) OVER (PARTITION BY source_name) AS n FROM h),
w AS (SELECT DISTINCT source_name, n, round_even(i * (n - 1) / 6.0, 0)::BIGINT AS p FROM (SELECT DISTINCT source_name, n FROM r), (SELECT unnest(range(0, 7)) AS i))
SELECT r.source_name, l_orderkey, l_linenumber, r.n AS file_count FROM r JOIN w ON r.source_name = w.source_name AND r.p = w.p""",
    "uuid_duplicates": _H + "SELECT source_name, count(l_partkey) - count(DISTINCT l_partkey) AS duplicates FROM h GROUP BY 1",
    "filename_span": """SELECT event_type, min(s) AS first_stamp, max(s) AS last_stamp, count(s) AS stamped, count(*) AS file_count
FROM (SELECT event_type, CASE WHEN event_id % 5 <> 0 THEN date_trunc('second', ts) END AS s FROM events) GROUP BY 1""",
    "manifest_summary": """WITH m AS (SELECT l_linestatus || '-' || (l_suppkey % 5) AS source_name, l_orderkey % 17 <> 0 AND l_orderkey % 11 <> 0 AND l_orderkey % 13 <> 0 AND l_partkey > 0 AS ok, CASE WHEN l_orderkey % 3 <> 0 THEN strftime(l_shipdate, '%Y-%m-%d') END AS a,
  strftime(l_shipdate, '%Y-%m-%d') AS z FROM lineitem)
SELECT source_name, count(*) AS file_count, count(*) FILTER (WHERE ok) AS valid_record_count, count(*) FILTER (WHERE NOT ok) AS placeholder_count, min(a) FILTER (WHERE ok) AS first_start, max(z) FILTER (WHERE ok) AS last_end FROM m GROUP BY 1""",
}
