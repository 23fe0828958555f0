"""Overlap of event windows with recorded files, as an equi-join on cells of several resolutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: The highest level of cells: of the shortest, two to this power.
LEVELS = 50


def coarse_file_filter(stamp: Column, start: Column, end: Column, lead_s: float = 2.0, tail_s: float = 62.0) -> Column:
    """Whether a file with that name stamp may hold samples of [start, end); no stamp, no."""
    return F.coalesce((stamp < end + lead_s) & (stamp + tail_s > start), F.lit(False))


def _level(start: Column, end: Column, base_s: float) -> Column:
    """The dyadic level whose cells, ``base_s`` times 2 ** level long, are as long as the interval or just longer."""
    return F.least(F.greatest(F.ceil(F.log2(F.greatest((end - start) / base_s, F.lit(1.0)))), F.lit(0)), F.lit(LEVELS)).cast("int")


def _cells(start: Column, end: Column, level: Column, base_s: float) -> Column:
    width = base_s * F.pow(F.lit(2.0), level)
    return F.explode(F.sequence(F.floor(start / width).cast("long"), F.floor(end / width).cast("long")))


def overlap_join(left: DataFrame, right: DataFrame, spans: tuple[str, str, str, str], base_s: float = 60.0) -> DataFrame:
    """Pairs of rows whose open intervals overlap: ``spans`` are the columns left start and end, right start and end (seconds).

    A multi-resolution index: an interval lies in one or two cells of the dyadic level of its own length,
    and the longer of two that overlap meets there the cells of the shorter one's ancestors at that level. So a
    record of a year makes two rows and not one for each hour, and a row makes two more for each level
    that occurs on the other side, at most some thirty. The join is an equi-join on (side, level, cell);
    a pair that meets in two cells counts where the later of the two begins. Where many short
    intervals lie in one long one, their key holds few rows on the long side, and adaptive execution
    splits it. Intervals that end before they start, or have a null end, overlap nothing.
    """
    ls, le, rs, re_ = spans
    a = left.filter(F.col(le) >= F.col(ls)).withColumn("level__", _level(F.col(ls), F.col(le), base_s))
    b = right.filter(F.col(re_) >= F.col(rs)).withColumn("level__", _level(F.col(rs), F.col(re_), base_s))

    def at_home(rows: DataFrame, start: str, end: str, side: str) -> DataFrame:
        return rows.select("*", F.lit(side).alias("side__"), _cells(F.col(start), F.col(end), F.col("level__"), base_s).alias("cell__"))

    def above(rows: DataFrame, start: str, end: str, side: str, others: DataFrame, own: bool) -> DataFrame:
        levels = others.select(F.col("level__").alias("up__")).distinct()  # LEVELS rows at most
        up = rows.withColumn("up__", F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))).filter("up__ >= level__" if own else "up__ > level__")
        up = up.join(F.broadcast(levels), "up__").drop("level__").withColumnRenamed("up__", "level__")
        return up.select(*rows.columns, F.lit(side).alias("side__"), _cells(F.col(start), F.col(end), F.col("level__"), base_s).alias("cell__"))

    one = at_home(a, ls, le, "l").unionByName(above(a, ls, le, "r", b, False))
    two = above(b, rs, re_, "l", a, True).unionByName(at_home(b, rs, re_, "r"))
    meet = one.join(two, ["side__", "level__", "cell__"]).filter((F.col(rs) < F.col(le)) & (F.col(re_) > F.col(ls)))
    home = F.floor(F.greatest(ls, rs) / (base_s * F.pow(F.lit(2.0), F.col("level__"))))
    return meet.filter(F.col("cell__") == home).select(*left.columns, *right.columns)


def interval_overlap(windows: DataFrame, files: DataFrame, base_s: float = 60.0) -> DataFrame:
    """One row per window: event_id, file_count, complete, has_gap, coverage_status, source_files.

    windows: event_id, start_s, end_s; files: path, start_s, end_s (epoch seconds) and perhaps stamp_s, the time in the
    file's name: then only files that :func:`coarse_file_filter` lets through are looked at. A file counts if it
    overlaps the open window. A window is complete if the files' first start and last end reach over it,
    has_gap if yet some of it lies in none. Pairs are found by :func:`overlap_join`.
    """
    w = windows.select("event_id", F.col("start_s").alias("ws"), F.col("end_s").alias("we"))
    f = files.filter("end_s > start_s").select("path", F.col("start_s").alias("fs"), F.col("end_s").alias("fe"), *(["stamp_s"] if "stamp_s" in files.columns else []))
    hits = overlap_join(w, f, ("ws", "we", "fs", "fe"), base_s)
    if "stamp_s" in files.columns:
        hits = hits.filter(coarse_file_filter(F.col("stamp_s"), F.col("ws"), F.col("we")))
    clip = F.struct(F.greatest("fs", "ws").alias("a"), F.least("fe", "we").alias("z"))
    found = hits.groupBy("event_id").agg(
        F.count("*").alias("n"), F.min("fs").alias("lo"), F.max("fe").alias("hi"), F.array_sort(F.collect_list("path")).alias("paths"), F.array_sort(F.collect_list(clip)).alias("parts")
    )
    # the furthest point covered without a hole, from the window's start
    reach = F.aggregate("parts", F.col("ws"), lambda acc, x: F.when(x["a"] <= acc, F.greatest(acc, x["z"])).otherwise(acc))
    rows = w.join(found, "event_id", "left")
    complete = F.coalesce((F.col("lo") <= F.col("ws")) & (F.col("hi") >= F.col("we")), F.lit(False))
    return rows.select(
        "event_id",
        F.coalesce("n", F.lit(0)).alias("file_count"),
        complete.alias("complete"),
        (complete & (F.coalesce(reach, F.col("ws")) < F.col("we"))).alias("has_gap"),
        F.when(complete, "PASS").when(F.coalesce("n", F.lit(0)) > 0, "CONDITIONAL").otherwise("STOP").alias("coverage_status"),
        F.coalesce(F.array_join("paths", ";"), F.lit("")).alias("source_files"),
    )
