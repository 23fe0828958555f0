"""Text parsers and the ledger, over lines made from regions, nations and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.operators import gates
from quakeloom.sources import text


def _nations(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/nation.parquet")


def catalogue_text_parse(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    s = lambda c: c.cast("string")
    line = F.concat_ws("|", F.concat(F.lit(" "), s(k)), F.concat(F.lit("2014-02-"), F.lpad(s(k + 1), 2, "0"), F.lit("T21:41:40.55")), s(k / 4), s(-k / 8), s(k / 2), F.lit("NC"), F.lit("DD"), F.lit("NC"), F.lit(""), F.lit("Md"), s(k / 10), F.lit("NC"), F.col("n_name"), F.lit("earthquake"))
    line = F.when(k % 6 == 0, F.lit("# comment")).when(k % 6 == 1, F.lit("too|short")).otherwise(line)
    out = text.catalogue_lines(_nations(spark, d).select(line.alias("value")))
    return out.select("event_id", "origin_time", "latitude", "longitude", "depth_km", "magnitude", "location_name")


def _sequence_lines(spark: SparkSession, d: str) -> DataFrame:
    n = _nations(spark, d)
    s = lambda c: F.col(c).cast("string")
    head = n.groupBy("n_regionkey").agg(F.count("*").alias("c")).select(
        (F.col("n_regionkey") * 1000).alias("pos"), F.concat(F.lit("# "), s("c"), F.lit(" 36.5 -120.5 4.0 0.1 nan 10 1 0.1 10 1 0.1 0.95 R."), s("n_regionkey")).alias("value")
    )
    line = F.concat(F.lit("2009 1 "), (F.col("n_nationkey") % 28 + 1).cast("string"), F.lit(" 3 59 61.25 1.5 36.25 -120.25 4.0 1 2 3 1.5 - 0.1 0.9 "), s("n_nationkey"))
    event = n.select((F.col("n_regionkey") * 1000 + F.col("n_nationkey") + 1).alias("pos"), line.alias("value"))
    note = n.select((F.col("n_regionkey") * 1000 + 500 + F.col("n_nationkey")).alias("pos"), F.lit("# a note").alias("value"))
    return head.unionByName(event).unionByName(note).withColumn("file", F.lit("f"))


def sequence_text_parse(spark: SparkSession, d: str) -> DataFrame:
    e = text.sequence_events(_sequence_lines(spark, d))
    return e.select("event_id", "origin_time", "latitude", "relative_error_z_m", "magnitude", "differential_magnitude", "median_long_window_correlation", "sequence_id")


def sequence_header_parse(spark: SparkSession, d: str) -> DataFrame:
    return text.sequence_headers(_sequence_lines(spark, d)).select("sequence_id", "published_event_count", "median_latitude", "differential_magnitude_std", "median_long_window_correlation")


def sequence_faults(spark: SparkSession, d: str) -> DataFrame:
    lines = _sequence_lines(spark, d).filter("pos <> 2000")
    return text.sequence_faults(text.sequence_headers(lines), text.sequence_events(lines))


def sequence_stream_parse(spark: SparkSession, d: str) -> DataFrame:
    """One file of all events in order of id, every fiftieth a header: events of each sequence, and those before any header."""
    e = spark.read.parquet(f"{d}/events.parquet")
    s = lambda c: c.cast("string")
    k = F.col("event_id")
    head = F.concat(F.lit("# 49 36.5 -120.5 4.0 0.1 nan 10 1 0.1 10 1 0.1 0.95 0.9 R."), s(k))
    line = F.concat(F.lit("2009 1 "), s(k % 28 + 1), F.lit(" 3 59 61.25 1.5 36.25 -120.25 4.0 1 2 3 1.5 - 0.1 0.9 "), s(k))
    lines = e.select(F.lit("f").alias("file"), k.alias("pos"), F.when(k % 50 == 7, head).otherwise(line).alias("value"))
    return text.sequence_events(lines).groupBy("sequence_id").agg(F.count("*").alias("events"), F.min(F.col("event_id").cast("long")).alias("first_id"), F.max(F.col("event_id").cast("long")).alias("last_id"))


def _branches(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    share = o.groupBy(F.col("o_orderpriority").alias("branch")).agg(F.count("*").alias("n"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("f"))
    status = gates.coverage_verdict(F.col("f") * 2 > F.col("n"), F.col("f") > 0)
    return share.select("branch", status.alias("status"), F.format_string("%d of %d", "f", "n").alias("evidence"))


def checkpoint_ledger(spark: SparkSession, d: str) -> DataFrame:
    return gates.ledger(_branches(spark, d), ["1-URGENT", "2-HIGH"])


_SEQ_ORIGIN = "make_timestamp(2009, 1, n_nationkey % 28 + 1, 3, 59, 0.0) + INTERVAL 61250 MILLISECOND"
QUERIES = {f.__name__: f for f in (catalogue_text_parse, sequence_text_parse, sequence_stream_parse, sequence_header_parse, sequence_faults, checkpoint_ledger)}
SQL = {
    "catalogue_text_parse": """SELECT n_nationkey::VARCHAR AS event_id, make_timestamp(2014, 2, n_nationkey + 1, 21, 41, 40.55) AS origin_time, n_nationkey / 4 AS latitude, -n_nationkey / 8 AS longitude, n_nationkey / 2 AS depth_km,
  n_nationkey / 10 AS magnitude, n_name AS location_name FROM nation WHERE n_nationkey % 6 > 1""",
    "sequence_text_parse": f"""SELECT n_nationkey::VARCHAR AS event_id, {_SEQ_ORIGIN} AS origin_time, 36.25::DOUBLE AS latitude, 3.0::DOUBLE AS relative_error_z_m, 1.5::DOUBLE AS magnitude, NULL::DOUBLE AS differential_magnitude,
  0.9::DOUBLE AS median_long_window_correlation, 'R.' || n_regionkey AS sequence_id FROM nation""",
    "sequence_stream_parse": """WITH e AS (SELECT event_id, last_value(CASE WHEN event_id % 50 = 7 THEN 'R.' || event_id END IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS sequence_id FROM events)
SELECT sequence_id, count(*) AS events, min(event_id)::BIGINT AS first_id, max(event_id)::BIGINT AS last_id FROM e WHERE event_id % 50 <> 7 GROUP BY 1""",
    "sequence_header_parse": "SELECT 'R.' || n_regionkey AS sequence_id, count(*)::INT AS published_event_count, 36.5::DOUBLE AS median_latitude, NULL::DOUBLE AS differential_magnitude_std, 0.95::DOUBLE AS median_long_window_correlation FROM nation GROUP BY n_regionkey",
    "sequence_faults": "SELECT 'declared count differs' AS fault, 'R.1' AS subject",
    "checkpoint_ledger": """WITH s AS (SELECT o_orderpriority AS branch, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS f FROM orders GROUP BY 1),
b AS (SELECT branch, CASE WHEN f * 2 > n THEN 'PASS' WHEN f > 0 THEN 'CONDITIONAL' ELSE 'STOP' END AS status, f || ' of ' || n AS evidence FROM s)
SELECT *, CASE WHEN (SELECT count(*) FROM b WHERE branch IN ('1-URGENT', '2-HIGH') AND status = 'PASS') = 2 THEN 'PROCEED_WITH_CONDITIONS' ELSE 'PAUSE_AND_REPAIR' END AS decision FROM b""",
}
