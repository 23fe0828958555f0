"""Shot logs: local wall time and zone to UTC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shot_log(spark: SparkSession, path: str, date: str) -> DataFrame:
    """A CSV log with its own column names to shot_number, name, latitude, longitude, elevation_m, local_time, description, date.

    The byte order mark is dropped, as are rows without a shot number; a log without any other is an error.
    """
    raw = spark.read.csv(path, header=True)
    names = {c.lstrip("﻿").strip(): c for c in raw.columns}
    time_col = next(c for n, c in names.items() if n.startswith("shot time"))
    get = lambda n: F.col(f"`{names[n]}`")
    rows = raw.filter(F.trim(F.coalesce(get("Shot Num"), F.lit(""))) != "")
    if rows.isEmpty():
        raise ValueError(f"no shots in {path}")
    return rows.select(
        F.trim(get("Shot Num")).alias("shot_number"), get("name").alias("name"), get("lat").cast("double").alias("latitude"), get("lon").cast("double").alias("longitude"),
        get("ele").cast("double").alias("elevation_m"), F.trim(F.col(f"`{time_col}`")).alias("local_time"), get("description").alias("description"), F.lit(date).alias("date"),
    )


def read_shots(log: DataFrame, zone: str) -> DataFrame:
    """Adds nominal_origin_time, the UTC instant of ``date`` and ``local_time`` in ``zone``."""
    wall = F.to_timestamp_ntz(F.concat_ws("T", "date", "local_time"), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    return log.withColumn("nominal_origin_time", F.convert_timezone(F.lit(zone), F.lit("UTC"), wall)).drop("date")
