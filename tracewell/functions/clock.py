"""Clock readings, frame times and shares, in whole microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: RFC 3339 with an optional fraction and zone.
READING = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})[Tt]([0-9]{2}):([0-9]{2}):([0-9]{2})(?:\.([0-9]+))?([Zz]|[+-][0-9]{2}:?[0-9]{2})?\z"
#: One time that stands alone: not inside a longer number, date, word or offset.
FACE = r"(?<![0-9A-Za-z:./+\-])([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?(?![0-9A-Za-z:/\-]|\.[0-9])"
MAX_READING_BYTES, MAX_LINE_BYTES, MAX_OFFSET_S = 40, 64, 14 * 3600


def parse_clock_reading(text: Column) -> Column:
    """``struct<utc_us, local_us, offset_s>``, null if it is no reading.

    With ``Z``, or ``-00:00``, only utc_us is known; with another offset all three;
    without a zone only local_us, which names no instant. A fraction is cut to micros.
    """
    part = lambda i: F.regexp_extract(text, READING, i)
    whole = lambda i: part(i).try_cast("int")
    date = F.to_date(F.try_to_timestamp(F.concat_ws("-", part(1), part(2), part(3)), F.lit("yyyy-MM-dd")))
    day = F.unix_date(date).cast("long")
    fraction = F.rpad(F.substring(part(7), 1, 6), 6, "0").try_cast("long")
    local = ((day * 24 + whole(4)) * 60 + whole(5)) * 60_000_000 + whole(6) * F.lit(1_000_000).cast("long") + fraction
    zone = F.regexp_replace(part(8), ":", "")
    size = F.substring(zone, 2, 2).try_cast("int") * 3600 + F.substring(zone, 4, 2).try_cast("int") * 60
    utc = F.upper(zone).isin("Z", "-0000")
    offset = F.when((zone == "") | utc, None).otherwise(F.when(zone.startswith("-"), -size).otherwise(size))
    good = text.rlike(READING) & (F.octet_length(text) <= MAX_READING_BYTES) & date.isNotNull() & (whole(4) < 24) & (whole(5) < 60) & (whole(6) < 60)
    good = good & ((zone == "") | utc | ((F.substring(zone, 4, 2).try_cast("int") < 60) & (size <= MAX_OFFSET_S)))
    return F.when(good, F.struct(F.when(utc, local).when(offset.isNotNull(), local - offset * F.lit(1_000_000).cast("long")).alias("utc_us"), F.when(~utc, local).alias("local_us"), offset.cast("int").alias("offset_s")))


def read_clock_face(line: Column) -> Column:
    """``struct<refusal, value_us>`` of a line with a 24-hour time: exactly one that stands alone."""
    found = F.regexp_extract_all(line, F.lit(FACE), 0)
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(line, FACE, i), F.lit("")).cast("long"), F.lit(0))
    real = (part(1) < 24) & (part(2) < 60) & (part(3) < 60)
    refusal = F.when(F.octet_length(line) > MAX_LINE_BYTES, "too_long").when(F.size(found) == 0, "no_time").when(F.size(found) > 1, "several_times").when(~real, "no_time")
    return F.struct(refusal.alias("refusal"), F.when(refusal.isNull(), ((part(1) * 60 + part(2)) * 60 + part(3)) * 1_000_000).alias("value_us"))


def pts_to_micros(pts: Column, num: int, den: int, offset_us: int) -> Column:
    """trunc(pts * num * 1e6 / den) + offset, null below zero."""
    value = pts.cast("decimal(25,0)") * F.lit(num * 1_000_000).cast("decimal(13,0)")
    micros = F.when(value < 0, F.ceil(value / den)).otherwise(F.floor(value / den)).cast("long") + offset_us
    return F.when(micros >= 0, micros)


def first_pts_at_or_after(time_us: Column, num: int, den: int, offset_us: int) -> Column:
    """The least pts whose time is at or after the time."""
    wanted = (time_us - offset_us).cast("decimal(25,0)") * F.lit(den).cast("decimal(13,0)")
    step = num * 1_000_000
    # below zero, times are cut towards zero, so the pts just under a whole step still counts
    return F.when(wanted > 0, F.ceil(wanted / step)).otherwise(F.floor((wanted - den) / step) + 1).cast("long")


def basis_points(part: Column, whole: Column) -> Column:
    return F.floor(part.cast("decimal(20,0)") * 10_000 / F.nullif(whole, F.lit(0))).cast("long")


def same_place(a: Column, b: Column) -> Column:
    """Whether two boxes (x, y, w, h) share at least half of the smaller one."""
    side = lambda p, s: F.greatest(F.lit(0).cast("long"), F.least(a[p] + a[s], b[p] + b[s]) - F.greatest(a[p], b[p]))
    smaller = F.least(a["w"] * a["h"], b["w"] * b["h"])
    return (smaller > 0) & (side("x", "w") * side("y", "h") * 2 >= smaller)
