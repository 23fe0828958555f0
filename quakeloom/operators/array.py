"""Sample-by-channel array operators in long form: (sample, channel, value) or one value column by group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quakeloom.operators.ordered import carry_forward, exact_quantiles
from quakeloom.operators.pairs import pair_correlation

EPS32 = 1.1920929e-07
EPS64 = 2.220446049250313e-16


def explode_channels(rows: DataFrame, sample: str, values: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, sample, channel, value) from one array of channels per sample."""
    own = keys or []
    return rows.select(*own, F.col(sample).alias("sample"), F.posexplode(values).alias("channel", "value")).select(*own, "sample", "channel", F.col("value").cast("double").alias("value"))


def robust_scale(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per group: median and scale, 1.4826 times the median absolute deviation or, if that is 0, the population deviation.

    With keys a group is what one task can hold, as the samples of a window; without, all rows are one group
    and both medians are found by :func:`exact_quantiles`, in no single task.
    """
    scale = F.when(F.col("mad__") <= EPS64, F.col("sd__")).otherwise(F.col("mad__")).alias("scale")
    if not keys:
        centre = exact_quantiles(rows, [], value, {"median": 0.5}).select("median")
        far = rows.select(value).join(F.broadcast(centre), F.lit(True)).select(F.abs(F.col(value) - F.col("median")).alias("far__"))
        mad = exact_quantiles(far, [], "far__", {"m__": 0.5}).select((1.4826 * F.col("m__")).alias("mad__"))
        spread = rows.agg(F.stddev_pop(value).alias("sd__"))
        return centre.join(mad, F.lit(True)).join(spread, F.lit(True)).select("median", scale)
    med = rows.groupBy(*keys).agg(F.median(value).alias("median"), F.stddev_pop(value).alias("sd__"))
    dev = rows.join(med, keys)
    mad = dev.groupBy(*keys, "median", "sd__").agg((1.4826 * F.median(F.abs(F.col(value) - F.col("median")))).alias("mad__"))
    return mad.select(*keys, "median", scale)


def robust_z(values: DataFrame, reference: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """``values`` with z: distance from the reference group's median in robust scales."""
    scale = robust_scale(reference, keys, value)
    rows = values.join(scale, keys) if keys else values.crossJoin(F.broadcast(scale))
    return rows.withColumn("z", (F.col(value) - F.col("median")) / (F.col("scale") + EPS64)).drop("median", "scale")


def envelope(samples: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Root mean square over channels at each sample (and further ``keys``)."""
    return samples.groupBy("sample", *(keys or [])).agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("value"))


def channel_snr(samples: DataFrame, noise, signal) -> DataFrame:
    """(channel, noise_rms, signal_rms, snr) by two conditions on rows, in one grouping."""
    rms = lambda cond: F.sqrt(F.avg(F.when(cond, F.col("value") * F.col("value"))))
    out = samples.groupBy("channel").agg(rms(noise).alias("noise_rms"), rms(signal).alias("signal_rms"))
    return out.withColumn("snr", F.col("signal_rms") / (F.col("noise_rms") + EPS32))


def block_metrics(samples: DataFrame, noise, signal, block: int = 50, min_z: float = 5.0, carried: list[str] | None = None) -> DataFrame:
    """Per block of channels: range, count, median SNR, robust z of the block envelope's peak, and whether it is detected.

    ``noise`` and ``signal`` are conditions on sample and the ``carried`` columns, which depend on sample alone.
    """
    rows = samples.withColumn("block_id", F.floor(F.col("channel") / block))
    env = rows.groupBy("block_id", "sample", *(carried or [])).agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("value"))
    peak = env.filter(signal).groupBy("block_id").agg(F.max("value").alias("value"))
    z = robust_z(peak, env.filter(noise), ["block_id"]).select("block_id", F.col("z").alias("peak_robust_z"))
    snr = channel_snr(samples, noise, signal).withColumn("block_id", F.floor(F.col("channel") / block))
    span = snr.groupBy("block_id").agg(F.min("channel").alias("column_start"), F.max("channel").alias("column_end"), F.count("*").alias("sampled_channel_count"), F.median("snr").alias("median_channel_snr"))
    return span.join(z, "block_id").withColumn("detected", F.col("peak_robust_z") >= min_z)


def detected_fraction(blocks: DataFrame) -> DataFrame:
    return blocks.agg(F.count("*").alias("block_count"), F.avg(F.col("detected").cast("double")).alias("detected_block_fraction"))


def peak_sample(env: DataFrame) -> DataFrame:
    """The first sample of the greatest envelope value."""
    return env.orderBy(F.desc("value"), "sample").limit(1)


def adjacent_correlation(samples: DataFrame) -> DataFrame:
    """(channel, correlation) of each channel with the next one there is; null where one has no energy."""
    order = samples.select("channel").distinct().withColumn("next", F.lead("channel").over(Window.orderBy("channel"))).filter("next is not null")
    nxt = samples.select(F.col("channel").alias("next"), "sample", F.col("value").alias("other"))
    paired = samples.join(F.broadcast(order), "channel").join(nxt, ["next", "sample"])
    x, y = F.col("value"), F.col("other")
    sums = paired.groupBy("channel").agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.covar_pop(x, y).alias("c"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"))
    norm = F.sqrt(F.col("vx") * F.col("vy"))
    return sums.select("channel", F.when(norm * F.col("n") > EPS64, F.col("c") / norm).alias("correlation"))


def usable_ranges(spectrum: DataFrame, min_ratio: float = 9.0) -> DataFrame:
    """(first_hz, last_hz, bins) of runs of two and more neighbouring bins at ``min_ratio``. spectrum: bin, frequency_hz, power_ratio."""
    ok = spectrum.filter(f"not isnan(power_ratio) and abs(power_ratio) < double('infinity') and power_ratio >= {min_ratio}")
    island = F.col("bin") - F.row_number().over(Window.orderBy("bin"))
    runs = ok.withColumn("island", island).groupBy("island").agg(F.min("frequency_hz").alias("first_hz"), F.max("frequency_hz").alias("last_hz"), F.count("*").alias("bins"))
    return runs.filter("bins >= 2").drop("island")


def dedupe_times(rows: DataFrame, keys: list[str], time: str, order: list[str]) -> DataFrame:
    """Of rows at one time the first in ``order``."""
    w = Window.partitionBy(*keys, time).orderBy(*order)
    return rows.withColumn("rank__", F.row_number().over(w)).filter("rank__ = 1").drop("rank__")


def gap_stats(rows: DataFrame, keys: list[str], epoch_s: str, expected: str | None = None) -> DataFrame:
    """Per group: samples, greatest gap in seconds (infinite for one sample), and the missing share of ``expected`` samples.

    The time before a row's is carried across range partitions, so a stream of one key is worked on in many tasks.
    """
    gaps = carry_forward(rows, keys, [epoch_s], {"last__": F.col(epoch_s)}, include_own=False).withColumn("gap__", F.col(epoch_s) - F.col("last__"))
    aggs = [F.count("*").alias("samples"), F.coalesce(F.max("gap__"), F.lit(float("inf"))).alias("max_gap_s")]
    if expected:
        aggs.append(F.greatest(F.lit(0.0), 1 - F.count("*") / F.max(expected)).alias("missing_fraction"))
    return gaps.groupBy(*keys).agg(*aggs)


def average_ranks(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Ranks with ties sharing their mean."""
    w = Window.partitionBy(*keys)
    return rows.withColumn(name, F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2)


def spearman(profiles: DataFrame) -> DataFrame:
    """(a, b, spearman) of all pairs of profiles (profile, channel, value) over their channels."""
    ranked = average_ranks(profiles, ["profile"], "value", "r").select("profile", "channel", "r")
    left = ranked.select(F.col("profile").alias("a"), "channel", F.col("r").alias("ra"))
    right = ranked.select(F.col("profile").alias("b"), "channel", F.col("r").alias("rb"))
    return left.join(right, "channel").filter("a < b").groupBy("a", "b").agg(F.corr("ra", "rb").alias("spearman"))


def spearman_matrix(profiles: DataFrame, block: int = 512) -> DataFrame:
    """(a, b, spearman) for all ordered pairs of profiles, the diagonal 1: rank correlations as products of blocks.

    profiles: profile, channel, value. All are cut to the channels of the shortest, in order of channel; values are
    replaced by average ranks within their profile, so the correlation of ranks is one matrix product
    per pair of blocks (see :func:`quakeloom.operators.pairs.pair_correlation`). A constant profile has null
    correlations with the others. Names are text.
    """
    own = profiles.select(F.col("profile").cast("string").alias("profile"), "channel", F.col("value").cast("double").alias("value"))
    at = F.row_number().over(Window.partitionBy("profile").orderBy("channel"))
    least = own.groupBy("profile").agg(F.count("*").alias("n")).agg(F.min("n").alias("least__"))
    cut = own.withColumn("at", at).join(F.broadcast(least), F.lit(True)).filter("at <= least__")
    ranked = average_ranks(cut, ["profile"], "value", "r")
    vectors = ranked.groupBy(F.col("profile").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "r"))), lambda x: x["r"].cast("double")).alias("v"))
    pairs = pair_correlation(vectors, block).toDF("a", "b", "spearman")
    same = vectors.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("spearman"))
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "spearman")).unionByName(same)
