"""Scalar expressions over catalogue, header and spectral columns; all are built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371008.8
PHASE_UNIT = "rad * 2PI/2^16"


def catalogue_time(text: Column) -> Column:
    """Catalogue time text to timestamp: a trailing Z goes, the fraction is padded or cut to microseconds."""
    bare = F.regexp_replace(F.trim(text), "Z$", "")
    whole = F.substring_index(bare, ".", 1)
    fraction = F.when(bare.contains("."), F.rpad(F.substring_index(bare, ".", -1).substr(1, 6), 6, "0")).otherwise("000000")
    return F.to_timestamp_ntz(F.concat(whole, F.lit("."), fraction), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def iso_ms(ts: Column) -> Column:
    """Timestamp to ISO text with milliseconds (cut, not rounded) and Z."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def optional_float(text: Column) -> Column:
    """Text to double; what is no finite number is null."""
    x = text.try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None).cast("double")).otherwise(x)


def event_time(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """Timestamp from parts; seconds of 60 and more run into the next minute."""
    start = F.make_timestamp_ntz(year, month, day, hour, minute, F.lit(0))
    return start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), second.cast("decimal(18,6)"))


def filename_epoch(path: Column) -> Column:
    """Timestamp from a name ending in _yyyy-MM-ddTHHmmssZ.h5; null for others."""
    found = F.regexp_extract(path, r"_(\d{4}-\d{2}-\d{2}T\d{6})Z\.h5$", 1)
    return F.try_to_timestamp(F.nullif(found, F.lit("")), F.lit("yyyy-MM-dd'T'HHmmss"))


def phase_scale(unit: Column) -> Column:
    """Radians for a raw count in units of 2 pi / 2**16, else 1."""
    plain = F.lower(F.regexp_replace(unit, " ", ""))
    return F.when(plain.contains("rad") & plain.contains("2pi/2^16"), F.lit(6.283185307179586 / 65536)).otherwise(F.lit(1.0))


def trace_key(network: Column, station: Column, channel: Column) -> Column:
    """Name of a trace without its location code."""
    return F.concat_ws(".", network, station, channel)


def band_label(low: Column, high: Column) -> Column:
    return F.concat(low.cast("double").cast("string"), F.lit("-"), high.cast("double").cast("string"), F.lit("Hz"))


def local_offsets(lat: Column, lon: Column, depth_km: Column, lat0: Column, lon0: Column, depth0_km: Column) -> dict[str, Column]:
    """East, north, down, horizontal and whole distance in metres on a local tangent sphere."""
    north = F.lit(EARTH_RADIUS_M) * F.radians(lat - lat0)
    east = F.lit(EARTH_RADIUS_M) * F.cos(F.radians(lat0)) * F.radians(lon - lon0)
    down = F.lit(1000.0) * (depth_km - depth0_km)
    horizontal = F.hypot(east, north)
    return {"east_m": east, "north_m": north, "down_m": down, "horizontal_distance_m": horizontal, "distance_3d_m": F.hypot(horizontal, down)}


def brune_ratio(frequency: Column, omega: Column, target_corner: Column, egf_corner: Column) -> Column:
    return omega * (1 + F.pow(frequency / egf_corner, 2)) / (1 + F.pow(frequency / target_corner, 2))


def relative_stress_drop(moment_ratio: Column, target_corner: Column, reference_corner: Column) -> Column:
    """Moment ratio times the cubed ratio of corners; values not above 0 are an error."""
    ok = F.least(moment_ratio, target_corner, reference_corner) > 0
    return F.when(ok, moment_ratio * F.pow(target_corner / reference_corner, 3)).otherwise(
        F.raise_error(F.lit("moments and corner frequencies must be positive"))
    )


def stress_drop_gate(corner_status: Column, synthetic_error: Column, model_spread: Column, limit: float = 0.5) -> Column:
    return F.when((corner_status == "PASS") & (synthetic_error <= limit) & (model_spread <= limit), "PASS").otherwise("STOP")


def log_snr(snr: Column) -> Column:
    return F.log10(F.greatest(snr, F.lit(1e-6)))


def fixed_text(x: Column, digits: int) -> Column:
    """``x`` with so many decimals, rounded on its exact binary value, ties to even; for numbers below 2**52 / 10**digits.

    ``format_string`` rounds the shortest decimal text half up: 0.125 to two places is 0.13 there, 0.12 here, and
    2.675, in binary a little less, 2.68 and 2.67. The error of x * 10**digits is found exactly, by halves of the factors.
    """
    scale, size = F.lit(10.0**digits), F.abs(x)
    product = size * scale

    def halves(a: Column) -> tuple[Column, Column]:
        big = a * F.lit(134217729.0)
        high = big - (big - a)
        return high, a - high

    (a, b), (c, d) = halves(size), halves(scale)
    error = ((a * c - product) + a * d + b * c) + b * d
    whole = F.floor(product)
    part = product - whole
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
    units = whole + F.when(up, 1).otherwise(0)
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    if not digits:
        return F.concat(sign, units.cast("long").cast("string"))
    tens = F.lit(10**digits)
    return F.concat(sign, F.floor(units / tens).cast("long").cast("string"), F.lit("."), F.lpad((units % tens).cast("long").cast("string"), digits, "0"))


def finite(x: Column) -> Column:
    """NaN and infinities to null, so that medians and maxima pass over them."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)
