"""Scalar column expressions: time, motion, confidence, text and byte formatting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# ---- Fixed values: compass labels, image y axis pointing down, clockwise from east ----
COMPASS = (
    "Eastbound (→)",
    "South-East (↘)",
    "Southbound (↓)",
    "South-West (↙)",
    "Westbound (←)",
    "North-West (↖)",
    "Northbound (↑)",
    "North-East (↗)",
)
STATIONARY = "Stationary"
STATIONARY_BELOW_PX_S = 5.0

# ---- Fixed values: size units ----
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def plus_seconds(ts: Column, seconds: Column) -> Column:
    """Timestamp shifted by a (fractional) number of seconds."""
    return F.timestamp_micros(F.unix_micros(ts) + F.round(seconds * 1e6).cast("bigint"))


def speed(vx: Column, vy: Column) -> Column:
    return F.sqrt(vx * vx + vy * vy)


def heading(vx: Column, vy: Column) -> Column:
    """Eight-sector direction of a velocity, `Stationary` below 5 px/s."""
    angle = F.pmod(F.degrees(F.atan2(vy, vx)), F.lit(360.0))
    sector = F.pmod(F.floor((angle + 22.5) / 45.0), F.lit(8)).cast("int")
    labels = F.array(*(F.lit(name) for name in COMPASS))
    return F.when(speed(vx, vy) < STATIONARY_BELOW_PX_S, F.lit(STATIONARY)).otherwise(
        F.get(labels, sector)
    )


def circular_std_degrees(sum_sin: Column, sum_cos: Column, n: Column) -> Column:
    resultant = F.sqrt(sum_sin * sum_sin + sum_cos * sum_cos) / n
    return F.degrees(F.sqrt(-2.0 * F.log(F.greatest(F.lit(1e-9), resultant))))


def clamp_confidence(c: Column) -> Column:
    return F.round(F.least(F.lit(0.97), F.greatest(F.lit(0.30), c)), 3)


def interval_gap_seconds(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Seconds between two intervals, 0 when they overlap."""
    return F.greatest(F.lit(0.0), seconds_between(s2, e1), seconds_between(s1, e2))


def confidence_label(c: Column) -> Column:
    return (
        F.when(c >= 0.80, F.lit("HIGH"))
        .when(c >= 0.60, F.lit("MEDIUM"))
        .when(c >= 0.35, F.lit("LOW"))
        .otherwise(F.lit("VERY LOW"))
    )


def entity_id(object_type: Column, track: Column) -> Column:
    return F.when(track.isNull(), object_type).otherwise(
        F.concat(object_type, F.lit("#"), track.cast("string"))
    )


def off_hours(ts: Column) -> Column:
    return (F.hour(ts) < 6) | (F.hour(ts) >= 22)


def parse_rate(text: Column) -> Column:
    """`"n/d"` or a plain number as double; null for 0/0, N/A, zero denominators."""
    parts = F.split(text, "/")
    num = F.get(parts, F.lit(0)).try_cast("double")
    den = F.get(parts, F.lit(1)).try_cast("double")
    ratio = F.when(den != 0, F.try_divide(num, den))
    return F.when(F.size(parts) == 2, ratio).when(F.size(parts) == 1, num)


def dot(a: Column, b: Column) -> Column:
    """Dot product of two numeric arrays, summed in element order as double."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null when one vector is zero."""
    denom = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(denom > 0, dot(a, b) / denom)


def changed_fraction(a: Column, b: Column, delta: float) -> Column:
    """Share of positions whose absolute difference is above `delta`."""
    diffs = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    n = F.size(diffs)
    return F.when(n > 0, F.size(F.filter(diffs, lambda d: d > F.lit(float(delta)))) / n).otherwise(
        F.lit(0.0)
    )


def contains_any(text: Column, markers: list[str]) -> Column:
    """Case-folded containment of at least one marker."""
    low = F.lower(text)
    hits = [F.contains(low, F.lit(m.lower())) for m in markers]
    return reduce(lambda x, y: x | y, hits, F.lit(False))


def fixed(x: Column, digits: int = 1) -> Column:
    """Non-negative double as text with a fixed number of decimals.

    Rounds the exact binary value, half to even, as C and Python formatting do; the built-in
    formatter rounds the shortest decimal form half up. The product with the scale is split
    in two exact halves so that the comparison with the midpoint is exact.
    """
    scale = 10.0**digits
    big = x * F.lit(134217729.0)
    hi = big - (big - x)
    lo = x - hi
    low = F.floor(x * scale).cast("double")
    off = (hi * (2 * scale) - (2 * low + 1)) + lo * (2 * scale)
    up = F.when(off > 0, 1.0).when(off < 0, 0.0).otherwise(F.pmod(low, F.lit(2.0)))
    return F.format_string(f"%.{digits}f", (low + up) / F.lit(scale))


def human_size(size_bytes: Column) -> Column:
    size = size_bytes.cast("double")
    out = F.concat(size_bytes.cast("bigint").cast("string"), F.lit(" B"))
    for power in range(1, len(SIZE_UNITS)):
        unit = float(1024**power)
        out = F.when(
            size >= unit, F.concat(fixed(size / F.lit(unit)), F.lit(" " + SIZE_UNITS[power]))
        ).otherwise(out)
    return out


def hex_dump_line(chunk: Column, offset: Column) -> Column:
    """One line of a hex dump for a binary chunk of up to 16 bytes."""
    pairs = F.regexp_extract_all(F.lower(F.hex(chunk)), F.lit("([0-9a-f]{2})"), F.lit(1))
    left = F.rpad(F.array_join(F.slice(pairs, 1, 8), " "), 23, " ")
    right = F.array_join(F.slice(pairs, 9, 8), " ")
    body = F.rpad(F.rtrim(F.concat(left, F.lit("  "), right)), 48, " ")
    shown = F.regexp_replace(F.decode(chunk, "ISO-8859-1"), "[^ -~]", ".")
    return F.concat(F.lpad(F.lower(F.hex(offset)), 8, "0"), F.lit("  "), body, F.lit("  |"), shown, F.lit("|"))


def utf8_lossy(b: Column) -> Column:
    """Bytes as text, invalid sequences replaced."""
    return F.decode(b, "UTF-8")


def little_endian(binary: Column, offset: int, size: int) -> Column:
    """Unsigned little-endian integer of up to 7 bytes at a fixed 0-based offset."""
    raw = F.substring(binary, offset + 1, size)
    hexed = F.hex(raw)
    swapped = F.concat(
        *(F.substring(hexed, 2 * i + 1, 2) for i in reversed(range(size)))
    )
    return F.conv(swapped, 16, 10).cast("decimal(20,0)")


def packed_date(bits: Column) -> Column:
    """32-bit 6/4/5/5/6/6 packed date; null when a field is out of range."""
    v = bits.cast("bigint")

    def field(shift: int, mask: int) -> Column:
        return F.shiftright(v, shift).bitwiseAND(F.lit(mask)).cast("int")

    year = (field(26, 0x3F) + 2000).cast("int")
    month, day = field(22, 0xF), field(17, 0x1F)
    hour, minute, second = field(12, 0x1F), field(6, 0x3F), field(0, 0x3F)
    ok = (second <= 59) & (hour <= 23) & (minute <= 59) & (month >= 1) & (month <= 12) & (day >= 1)
    return F.when(ok, F.try_make_timestamp(year, month, day, hour, minute, second))
