"""Times as integer milliseconds: parsing, rounding and printing, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the form of a timestamp.
TIMESTAMP = r"^(?:(\d+):)?(\d{1,2}):(\d{1,2})(?:[,.](\d{1,3}))?$"


def half_up(x: Column) -> Column:
    """Round to the nearest integer, halves towards positive infinity (unlike round(), which goes away from zero)."""
    return F.floor(x.cast("double") + F.lit(0.5)).cast("long")


def parse_timestamp(text: Column) -> Column:
    """`h:mm:ss,fff` (hours and fraction may be missing) as milliseconds; null if it is something else.

    A fraction is padded on the right: `0,5` is 500 ms. Minutes and seconds are not checked for range.
    """
    t = F.trim(text)
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(t, TIMESTAMP, k), F.lit("")).try_cast("long"), F.lit(0))
    fraction = F.rpad(F.regexp_extract(t, TIMESTAMP, 4), 3, "0").try_cast("long")
    return F.when(F.regexp_like(t, F.lit(TIMESTAMP)), (part(1) * 3600 + part(2) * 60 + part(3)) * 1000 + F.coalesce(fraction, F.lit(0)))


def _clock(ms: Column) -> tuple[Column, Column, Column, Column]:
    return tuple(F.floor(ms / F.lit(d)).cast("long") % F.lit(m) for d, m in ((3_600_000, 1 << 40), (60_000, 60), (1000, 60), (1, 1000)))


def format_timestamp(ms: Column) -> Column:
    """`HH:MM:SS.mmm`, with a sign in front of negative times."""
    h, m, s, f = _clock(half_up(F.abs(ms)))
    return F.concat(F.when(ms < 0, "-").otherwise(""), F.format_string("%02d:%02d:%02d.%03d", h, m, s, f))


def _short(whole: Column) -> Column:
    h, m, s, _ = _clock(whole)
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def format_clock(ms: Column) -> Column:
    """`m:ss`, or `h:mm:ss` from an hour on; negative times are zero. Fractions of a second are cut off."""
    return _short(F.greatest(F.lit(0), half_up(ms)))


def format_duration(ms: Column) -> Column:
    """Like format_clock, but rounded to the nearest second."""
    return _short(F.greatest(F.lit(0), half_up(ms / F.lit(1000.0))) * 1000)


def to_seconds(ms: Column) -> Column:
    return half_up(ms) / F.lit(1000.0)


def format_bytes(n: Column) -> Column:
    """`512 B`, `12 KB`, `3.4 MB` or `1.25 GB`: the nearest number of those digits, of two the one whose last digit is even."""
    n = n.cast("long")

    def scaled(bits: int, digits: int, name: str) -> Column:
        # in whole numbers, as format_string rounds halves up: 2560 bytes would be 3 KB; the part behind the unit alone is multiplied, so that nothing overflows
        unit, ten = 1 << bits, 10**digits
        behind = n.bitwiseAND(F.lit(unit - 1)) * F.lit(ten)
        down, left = F.shiftright(n, bits) * F.lit(ten) + F.shiftright(behind, bits), behind.bitwiseAND(F.lit(unit - 1))
        up = (left > unit // 2) | ((left == unit // 2) & (down % 2 == 1))
        k = down + up.cast("long")
        whole = ((k - k % ten) / F.lit(ten)).cast("long")
        return F.format_string(f"%d.%0{digits}d {name}", whole, k % ten) if digits else F.concat(k.cast("string"), F.lit(f" {name}"))

    return (
        F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, scaled(10, 0, "KB"))
        .when(n < 1 << 30, scaled(20, 1, "MB")).otherwise(scaled(30, 2, "GB"))
    )


#: Steps of a time axis in seconds.
TICK_STEPS = (1, 2, 5, 10, 15, 30, 60, 120, 300, 600, 900, 1800)


def ticks(total_ms: Column, most: int = 12) -> Column:
    """Times of axis ticks: the least step of at most `most` spans, without a tick in the last 0.4 of a step."""
    step = F.lit(3_600_000)
    for s in reversed(TICK_STEPS):
        step = F.when(total_ms / F.lit(s * 1000.0) <= most, F.lit(s * 1000)).otherwise(step)
    step = step.cast("long")
    last = F.floor((total_ms - step * F.lit(0.4)) / step).cast("long")
    return F.when((total_ms > 0) & (last >= 0), F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0))), lambda k: k * step)).otherwise(F.array().cast("array<long>"))
