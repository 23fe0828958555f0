"""Order within groups of any size: range partitions, carries between them, ranks, and exact order statistics.

A window over a whole group puts the group in one task. Here rows are dealt by range of (keys, order), so a
group lies in neighbouring partitions; what a row must know of the partitions before its own is an aggregate of
one row for each partition and group, and only rows within a partition are put in a window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakeloom.tables import written

#: The number of a row's range partition, ascending with (keys, order).
PART = "part__"


def ranged(rows: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """``rows`` as a written table with the number of the range partition of (keys, order) in ``PART``.

    Rows equal in all of ``keys`` and ``order`` share a partition, so an order with few ties keeps partitions even.
    """
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, *keys, *order) if keys or order else rows.repartition(n)
    return written(placed.withColumn(PART, F.spark_partition_id()), "ranged")


def _partial(placed: DataFrame, keys: list[str], aggs: list[Column]) -> DataFrame:
    return placed.groupBy(*keys, PART).agg(*aggs)


def _join_part(placed: DataFrame, carried: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Rows with their partition's carried columns; there is one carried row for each partition and group."""
    other = carried.select(*[F.col(c).alias(f"{c}__r") for c in [*keys, PART]], *names)
    on = reduce(lambda x, y: x & y, [placed[k].eqNullSafe(other[f"{k}__r"]) for k in keys], placed[PART] == other[f"{PART}__r"])
    return placed.join(other, on).drop(*[f"{c}__r" for c in [*keys, PART]])


def running(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with, for each of ``sums``, the sum over the rows of its group that come before it in ``order`` (0 for the first).

    A null adds nothing. Rows that tie in ``order`` follow one another in any order.
    """
    values = {f"{name}__v": F.coalesce(c, F.lit(0)) for name, c in sums.items()}
    placed = ranged(rows.withColumns(values), keys, order)
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    totals = _partial(placed, keys, [F.sum(v).alias(v.replace("__v", "__t")) for v in values])
    offsets = totals.select(*keys, PART, *[F.coalesce(F.sum(f"{name}__t").over(before), F.lit(0)).alias(f"{name}__o") for name in sums])
    within = Window.partitionBy(PART, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = _join_part(placed, offsets, keys, [f"{name}__o" for name in sums])
    out = out.withColumns({name: F.col(f"{name}__o") + F.coalesce(F.sum(f"{name}__v").over(within), F.lit(0)) for name in sums})
    return out.drop(PART, *values, *[f"{name}__o" for name in sums])


def global_rank(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with their position in the group, from 0."""
    return running(rows, keys, order, {name: F.lit(1).cast("long")})


def carry_forward(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], include_own: bool = True) -> DataFrame:
    """``rows`` with, for each of ``values``, its last value in ``order`` that is not null: at or, without ``include_own``,
    before the row; null where there is none.

    A carried state crosses partitions: the last value of each partition is one row, and a partition with
    none passes on what it was given.
    """
    names = {f"{name}__v": c for name, c in values.items()}
    placed = ranged(rows.withColumns(names), keys, order)
    at = F.struct(*[F.col(c) for c in order])
    lasts = _partial(placed, keys, [F.max_by(F.col(v), F.when(F.col(v).isNotNull(), at)).alias(f"{v}l") for v in names])
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    given = lasts.select(*keys, PART, *[F.last(f"{v}l", ignorenulls=True).over(before).alias(f"{v}g") for v in names])
    within = Window.partitionBy(PART, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if include_own else -1)
    out = _join_part(placed, given, keys, [f"{v}g" for v in names])
    out = out.withColumns({name: F.coalesce(F.last(f"{name}__v", ignorenulls=True).over(within), F.col(f"{name}__vg")) for name in values})
    return out.drop(PART, *names, *[f"{v}g" for v in names])


def order_bits(x: Column) -> Column:
    """A long that orders as the double ``x`` does: exponent above mantissa, negative numbers mirrored, NaN above all."""
    size = F.abs(x)
    guess = F.floor(F.log2(size))
    high = F.when(size < F.pow(F.lit(2.0), guess), guess - 1).when(size >= F.pow(F.lit(2.0), guess + 1), guess + 1).otherwise(guess)
    normal = F.shiftleft((high + 1023).cast("long"), 52) + ((size / F.pow(F.lit(2.0), high) - 1) * F.lit(2.0**52)).cast("long")
    subnormal = (size * F.lit(2.0**537) * F.lit(2.0**537)).cast("long")
    bits = F.when(size == 0, F.lit(0).cast("long")).when(size == float("inf"), F.lit(2047 << 52)).when(size < 2.0**-1022, subnormal).otherwise(normal)
    return F.when(F.isnan(x), F.lit((1 << 63) - 1)).when(x < 0, -bits).otherwise(bits)


def _digit(bits: Column, level: int) -> Column:
    """The ``level``-th 16 bits from the top, the sign turned so that they order as unsigned numbers."""
    top = F.shiftrightunsigned(bits, 48 - 16 * level).bitwiseAND(F.lit(0xFFFF))
    return (top.bitwiseXOR(F.lit(0x8000)) if level == 0 else top).cast("int")


#: Values left around a wanted rank that are sorted as they are, and not counted by further bits.
FEW = 65_536


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, probs: dict[str, float], few: int = FEW) -> DataFrame:
    """Per group: n (values that are not null) and, for each named probability, the exact interpolated quantile.

    As ``percentile``, which holds every distinct value of a group in one task; here no task does. Values are
    numbers of 64 bits that order alike. A round counts them by 16 bits, among the values that share the
    bits found so far with a wanted rank; counts are combined before they are shuffled, so a round moves at
    most 65,536 counts a wanted rank and task. Once no wanted rank has more than ``few`` values left, or
    after four rounds, the distinct values left are counted. NaN is greater than all numbers, as in
    Spark's order, -0.0 is 0.0, null does not count, and a group without values has n = 0 and nulls.

    ``rows`` is written once, with only its keys and value; the number of values left is all that the driver reads.
    """
    slim = rows.select(*keys, F.col(value).cast("double").alias("x__"))
    slim = written(slim.withColumn("bits__", order_bits(F.col("x__"))), "values")
    sizes = slim.groupBy(*keys).agg(F.count("x__").alias("n"))
    items = F.array(*[F.struct(F.lit(name).alias("name"), (p * (F.col("n") - 1)).alias("spot")) for name, p in probs.items()])
    asked = sizes.filter("n > 0").select(*keys, F.explode(items).alias("i")).select(*keys, "i.name", "i.spot")
    ends = F.array(F.floor("spot"), F.ceil("spot"))
    wanted = asked.select(*keys, "name", (F.col("spot") - F.floor("spot")).alias("part"), F.posexplode(ends).alias("end", "rank"))
    left = slim.filter("x__ is not null").withColumns({f"d{k}": _digit(F.col("bits__"), k) for k in range(4)})
    found: list[str] = []
    while len(found) < 4:
        wanted = written(_narrowed(left, wanted, keys, found, f"d{len(found)}"), "ranks")
        found.append(f"d{len(found)}")
        if (wanted.agg(F.max("c__")).first()[0] or 0) <= few:
            break
    if len(found) < 4:
        wanted = _narrowed(left, wanted, keys, found, "bits__")
    end = lambda k: F.max(F.when(F.col("end") == k, F.col("least__")))
    pairs = wanted.groupBy(*keys, "name").agg(end(0).alias("lo"), end(1).alias("hi"), F.max("part").alias("part"))
    # as percentile: equal ends are the value, so that infinities stay
    between = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise((1 - F.col("part")) * F.col("lo") + F.col("part") * F.col("hi"))
    pivot = pairs.withColumn("q", between).groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, F.col("q"))).alias(name) for name in probs])
    return _left_join(sizes, pivot, keys).select(*keys, "n", *probs)


def _left_join(a: DataFrame, b: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``a`` with the columns of ``b`` by null-safe keys, which come from ``a``."""
    if not keys:
        return a.join(b, F.lit(True), how)
    b = b.withColumnsRenamed({c: f"{c}__r" for c in keys})
    return a.join(b, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"{c}__r")) for c in keys]), how).drop(*[f"{c}__r" for c in keys])


def _narrowed(left: DataFrame, wanted: DataFrame, keys: list[str], found: list[str], digit: str) -> DataFrame:
    """``wanted`` with the next ``digit`` of each rank, the rank within it, its number of values and the least of them.

    ``left`` has the digits of all values; those that share no wanted rank's digits so far are passed over.
    """
    on = [*keys, *found]
    if found:
        left = _left_join(left, wanted.select(*on).distinct(), on, "left_semi")
    counts = left.groupBy(*on, digit).agg(F.count("*").alias("c__"), F.min("x__").alias("least__"))
    below = Window.partitionBy(*on).orderBy(digit).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("below__", F.coalesce(F.sum("c__").over(below), F.lit(0)))
    here = (F.col("rank") >= F.col("below__")) & (F.col("rank") < F.col("below__") + F.col("c__"))
    placed = _left_join(wanted.drop("c__", "least__"), counts, on, "inner").filter(here)
    return placed.withColumn("rank", F.col("rank") - F.col("below__")).drop("below__")
