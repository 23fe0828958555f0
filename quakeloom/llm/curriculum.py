"""Mixing of sources to target weights that change over the training run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakeloom.llm._scale import ROW, materialise, numbered
from quakeloom.operators.ordered import global_rank, running

#: A weight over training time: (time, weight) knots from time 0 to 1, linear between them.
Schedule = Sequence[tuple[float, float]]

#: Weights of 5, 2 and 1 over the whole run: the first source fades, the second grows, the third is level.
FIVE_TWO_ONE: tuple[Schedule, ...] = (((0.0, 6.0), (1.0, 4.0)), ((0.0, 1.0), (1.0, 3.0)), ((0.0, 1.0), (1.0, 1.0)))


def integral(schedule: Schedule) -> list[tuple[float, float, float, float]]:
    """(time, weight, slope, weight integrated up to there) at each knot but the last, and the last with slope 0."""
    if len(schedule) < 2 or schedule[0][0] != 0 or schedule[-1][0] != 1 or any(b[0] <= a[0] for a, b in zip(schedule, schedule[1:])):
        raise ValueError("a schedule has knots from time 0 to 1 in order")
    if any(w < 0 for _, w in schedule) or not any(w > 0 for _, w in schedule):
        raise ValueError("weights are not negative and not all zero")
    out, done = [], 0.0
    for (t, w), (u, v) in zip(schedule, schedule[1:]):
        out.append((t, w, (v - w) / (u - t), done))
        done += (v + w) / 2 * (u - t)
    return [*out, (1.0, schedule[-1][1], 0.0, done)]


def word_count(text: Column) -> Column:
    """Words between white space, of which Unicode's other spaces are none: one mark a word, then the marks are counted."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+", "x")
    return F.length(F.rtrim(F.regexp_replace(marks, "[\\x20\\x09-\\x0D]+", ""))).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], percent: int, most: int) -> DataFrame:
    """``sizes`` (source, source_size) with schedule_no, weight and target: shares of ``percent`` of all words by weight.

    Sources take the weights in turn, by code point, null last. No target exceeds ``most`` times its source;
    what is over is shared anew by weight among the others until none is above: with sources in order of
    cap over weight, those are full whose cap is reached by the share of what the ones before leave.
    Sources are ranked and summed up across partitions, however many there are.
    """
    first = F.col("source").isNull().cast("int")
    ranked = global_rank(sizes.withColumn("null__", first), [], ["null__", "source"], "place__")
    turn = (F.col("place__") % len(weights)).cast("int")
    ranked = ranked.withColumn("schedule_no", turn).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    ranked = ranked.withColumn("cap__", most * F.col("source_size")).withColumn("fill__", F.col("cap__") / F.col("weight"))
    summed = running(ranked, [], ["fill__", "null__", "source"], {"caps__": F.col("cap__"), "weights__": F.col("weight")})
    summed = materialise(summed, "sources")
    total = summed.agg(F.sum("source_size").alias("all__"), F.sum("weight").alias("all_weights__"))
    asked = F.least(F.col("all__") * percent, F.col("all__") * most * 100) / 100
    rows = summed.join(F.broadcast(total), F.lit(True))
    rows = rows.withColumn("full__", (asked - F.col("caps__")) / (F.col("all_weights__") - F.col("weights__")) >= F.col("fill__")).withColumn("asked__", asked)
    rest = rows.agg(
        F.coalesce(F.sum(F.when(F.col("full__"), F.col("cap__"))), F.lit(0)).alias("given__"), F.coalesce(F.sum(F.when(F.col("full__"), F.col("weight"))), F.lit(0.0)).alias("gone__")
    )
    rows = rows.join(F.broadcast(rest), F.lit(True))
    share = F.try_divide(F.col("asked__") - F.col("given__"), F.col("all_weights__") - F.col("gone__")) * F.col("weight")
    target = F.when(F.col("full__"), F.col("cap__").cast("double")).otherwise(F.least(share, F.col("cap__").cast("double")))
    return rows.select("source", "source_size", "schedule_no", "weight", target.alias("target"))


def training_time(demand: Column, schedules: Sequence[Schedule], schedule_no: Column) -> Column:
    """When a source has met the share ``demand`` (0 to 1) of its whole demand: the inverse of its integrated weight.

    Between knots the integral is quadratic; the form of its root that cancels nothing is used.
    """

    def inverse(schedule: Schedule) -> Column:
        knots = integral(schedule)
        area, out = demand * knots[-1][3], None
        for (t, w, slope, done), following in reversed(list(zip(knots, knots[1:]))):
            rest = area - done
            step = F.try_divide(2 * rest, w + F.sqrt(F.greatest(w * w + 2 * slope * rest, F.lit(0.0))))
            at = t + F.coalesce(step, F.lit(0.0))
            out = at if out is None else F.when(area < following[3], at).otherwise(out)
        return out

    return F.element_at(F.array(*[inverse(s) for s in schedules]), schedule_no + 1)


def plan_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    schedules: Sequence[Schedule] = FIVE_TWO_ONE,
    percent: int = 150,
    most: int = 2,
    seed: int = 42,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size (words), source_size, target, taken, takes, and the row's number if it has one.

    ``takes`` are the document's places in the run: pass (from 0), words, and position, a training time from
    0 to 1. The words of a source, its documents in an order drawn from the ids, are read again and again
    until its target is met; the last document is taken in part. A source's weight over time, integrated and
    scaled to the target, is how many words it has given by then, and a document's position is where that
    number is the words before it. Targets: see :func:`source_targets`; weights are the schedules' integrals.

    Null text has size 0, and what has size 0 is never taken; a null source is a source; rows with one id and
    size are interchangeable; empty tables give no rows. Running sums cross range partitions, so a source of
    any size is split; only one row for each source is joined to the documents.
    """
    row = F.col(ROW) if ROW in docs.columns else F.monotonically_increasing_id()
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("key__"), row.alias(ROW))
    slim = materialise(slim, "sizes")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialise(source_targets(sizes, [integral(s)[-1][3] for s in schedules], percent, most), "targets")
    placed = running(slim, ["source"], ["key__", "doc_id", "size", ROW], {"before__": F.col("size")})
    rows = placed.join(targets.withColumnRenamed("source", "of__"), F.col("source").eqNullSafe(F.col("of__"))).drop("of__")
    wanted = F.floor(F.col("target") + 0.5)

    def take(k: Column) -> Column:
        start = k * F.col("source_size") + F.col("before__")
        words = F.greatest(F.least(wanted - start, F.col("size")), F.lit(0))
        time = training_time(F.try_divide(start.cast("double"), wanted.cast("double")), schedules, F.col("schedule_no"))
        return F.struct(k.alias("pass"), words.alias("words"), time.alias("position"))

    takes = F.filter(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), take), lambda x: x["words"] > 0)
    out = rows.withColumn("takes", takes).withColumn("taken", F.aggregate("takes", F.lit(0).cast("long"), lambda n, x: n + x["words"]))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", "takes", ROW)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The training run: rows of ``docs`` in order of position, once for each take, with ``mix_position``, ``mix_pass``, ``mix_words``.

    A document is whole where mix_words is its size, else its first mix_words words are asked for. Options: see
    :func:`plan_mix`. Documents are numbered in a written table, so repeated and null ids are rows of their own;
    the result is sorted by range of position, no two partitions overlap.
    """
    rows = numbered(docs)
    plan = plan_mix(rows, **options).select(F.col(ROW).alias("taken__row"), F.explode("takes").alias("take"))
    out = rows.join(plan, F.col(ROW) == F.col("taken__row"))
    out = out.select(*docs.columns, F.col("take.position").alias("mix_position"), F.col("take.pass").alias("mix_pass"), F.col("take.words").alias("mix_words"), ROW)
    return out.orderBy("mix_position", ROW).drop(ROW)
