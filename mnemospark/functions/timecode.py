"""Ordinal day codes and clock strings as column expressions.

A time code is day * 10^8 + HHMMSSFF, a long. Days are ordinals without a calendar; FF (hundredths or frames) is ignored
when a code becomes seconds. All functions take and return columns, so they stay in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_UNIT = 100_000_000


def zero_fill(col: Column, width: int = 8) -> Column:
    """Left-pads with zeros; longer strings stay whole (lpad alone would cut them)."""
    return F.when(F.length(col) >= width, col).otherwise(F.lpad(col, width, "0"))


def day_number(date: Column) -> Column:
    """The digits of DAY7 or day12."""
    return F.regexp_extract(date, r"(\d+)", 1).try_cast("long")


def time_code(date: Column, time: Column) -> Column:
    """day and HHMMSSFF as one long."""
    return F.concat(day_number(date).cast("string"), zero_fill(time)).try_cast("long")


def code_seconds(code: Column) -> Column:
    """Seconds within the day of a code or an HHMMSSFF number; hundredths are dropped."""
    clock = F.floor(code / 100) % 1_000_000
    return (F.floor(clock / 10_000) * 3600 + F.floor(clock / 100) % 100 * 60 + clock % 100).cast("long")


def code_total_seconds(code: Column) -> Column:
    """Seconds since day 0."""
    return F.floor(code / DAY_UNIT) * 86_400 + code_seconds(code)


def code_difference(later: Column, earlier: Column) -> Column:
    return code_total_seconds(later) - code_total_seconds(earlier)


def seconds_clock(seconds: Column) -> Column:
    """Seconds as HHMMSS00; hours do not wrap at 24."""
    s = F.floor(seconds).cast("long")
    part = lambda c: F.lpad(c.cast("string"), 2, "0")
    hours = F.floor(s / 3600)
    return F.concat(F.when(hours >= 100, hours.cast("string")).otherwise(part(hours)), part(F.floor(s / 60) % 60), part(s % 60), F.lit("00"))


def floor_clock(seconds: Column) -> Column:
    """HHMMSS00 of the second that a time lies in, with a tolerance of 1e-9."""
    return seconds_clock(F.floor(seconds + 1e-9))


def ceil_clock(seconds: Column) -> Column:
    return seconds_clock(F.ceil(seconds - 1e-9))


def human_clock(seconds: Column, millis: bool = False) -> Column:
    """HH:MM:SS, or the subtitle stamp HH:MM:SS,mmm."""
    ms = F.round(seconds * 1000).cast("long")
    whole = F.floor(ms / 1000)
    out = F.format_string("%02d:%02d:%02d", F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60)
    return F.concat(out, F.format_string(",%03d", ms % 1000)) if millis else out


def display(code: Column) -> Column:
    """DAYd HH:MM:SS of a code; a value of under nine digits has no day and stays as it is."""
    text = code.cast("string")
    clock = F.right(text, F.lit(8))
    pretty = F.concat(F.lit("DAY"), F.substring(text, F.lit(1), F.length(text) - 8), F.lit(" "), F.substring(clock, 1, 2), F.lit(":"), F.substring(clock, 3, 2), F.lit(":"), F.substring(clock, 5, 2))
    return F.when(F.length(text) < 9, text).otherwise(pretty)


#: Two of these in a query make it a range query.
RANGE_PATTERN = r"(?i)DAY\s*(\d+)\s+(\d{1,2}):(\d{2}):(\d{2})"


def range_bounds(query: Column) -> Column:
    """struct<start, end> codes of 'DAY 1 11:09:43 - DAY 1 11:12:00'; null when under two stamps are found."""
    part = lambda k: F.regexp_extract_all(query, F.lit(RANGE_PATTERN), F.lit(k))
    d, h, m, s = part(1), part(2), part(3), part(4)
    code = lambda i: F.get(d, F.lit(i)).cast("long") * DAY_UNIT + F.get(h, F.lit(i)).cast("long") * 1_000_000 + F.get(m, F.lit(i)).cast("long") * 10_000 + F.get(s, F.lit(i)).cast("long") * 100
    return F.when(F.size(d) >= 2, F.struct(code(0).alias("start"), code(1).alias("end")))


def is_range_query(query: Column) -> Column:
    return F.size(F.regexp_extract_all(query, F.lit(RANGE_PATTERN), F.lit(0))) >= 2


def target_spans(target: Column) -> Column:
    """array<struct<start, end>> codes of a target: 'HHMMSSFFDAYd_HHMMSSFF', one 'HHMMSSFFDAYd', or a ';' list of them."""
    one = lambda t: F.struct(
        F.concat(F.regexp_extract(t, r"(?i)DAY(\d+)", 1), F.regexp_extract(t, r"^(\d{8})", 1)).cast("long").alias("start"),
        F.concat(F.regexp_extract(t, r"(?i)DAY(\d+)", 1), F.when(t.contains("_"), F.regexp_extract(t, r"_(\d{8})$", 1)).otherwise(F.regexp_extract(t, r"^(\d{8})", 1))).cast("long").alias("end"),
    )
    return F.transform(F.filter(F.split(target, r"\s*;\s*"), lambda t: t.rlike(r"(?i)^\d{8}DAY\d+(_\d{8})?$")), one)
