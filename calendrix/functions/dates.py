"""Dates and times as pages write them, read into UTC instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
ZONE = "America/Chicago"


def month_number(name: Column) -> Column:
    """1 to 12 from the first three letters of a month's name; null for other words."""
    short = F.substring(F.lower(name), 1, 3)
    return F.coalesce(*[F.when(short == m[:3], F.lit(n + 1)) for n, m in enumerate(MONTHS)])


def clock_hour(hour: Column, half: Column) -> Column:
    """0 to 23 from a 12-hour clock; half is am or pm in any case."""
    base = hour.cast("int") % 12
    return F.when(F.lower(half) == "pm", base + 12).otherwise(base)


def local_instant(year: Column, month: Column, day: Column, hour: Column, minute: Column, zone: str = ZONE) -> Column:
    """The instant of a local wall-clock time, summer time included; null if it is no time."""
    return F.to_utc_timestamp(F.try_make_timestamp(year.cast("int"), month, day.cast("int"), hour, minute.cast("int"), F.lit(0)), zone)


def month_day_line(text: Column, as_of: Column, zone: str = ZONE) -> Column:
    """`Month D, YYYY ... h:mm PM` anywhere in a line, 9 in the morning without a time."""
    names = "|".join(m[:3] + "[a-z]*" for m in MONTHS)
    line = rf"(?i)\b({names})\.?\s+(\d{{1,2}})(?:\s*-\s*\d{{1,2}})?(?:,\s*(\d{{4}}))?"
    part = lambda n: F.nullif(F.regexp_extract(text, line, n), F.lit(""))
    clock = r"(?i)\b(\d{1,2})(?::(\d{2}))?\s*(am|pm)\b"
    time = lambda n: F.nullif(F.regexp_extract(text, clock, n), F.lit(""))
    hour = F.coalesce(clock_hour(time(1), time(3)), F.lit(9))
    minute = F.coalesce(time(2).cast("int"), F.lit(0))
    return local_instant(F.coalesce(part(3).cast("int"), F.year(as_of)), month_number(part(1)), part(2), hour, minute, zone)


def slash_line(text: Column, as_of: Column, zone: str = ZONE) -> Column:
    """struct(title, start) of `M/D: title, hpm`, with -D and h-h ranges; 9 in the morning without a time."""
    line = r"(?i)^\s*(\d{1,2})/(\d{1,2})(?:\s*-\s*\d{1,2})?\s*:\s*(.*?)(?:,\s*(\d{1,2})(?::(\d{2}))?(?:\s*-\s*\d{1,2}(?::\d{2})?)?\s*(am|pm))?\s*$"
    part = lambda n: F.nullif(F.regexp_extract(text, line, n), F.lit(""))
    hour = F.coalesce(clock_hour(part(4), part(6)), F.lit(9))
    start = local_instant(F.year(as_of), part(1).cast("int"), part(2), hour, F.coalesce(part(5).cast("int"), F.lit(0)), zone)
    return F.struct(part(3).alias("title"), start.alias("start"))


def event_year(event_id: Column, as_of: Column) -> Column:
    """The year after a W in an event id, else the current one."""
    return F.coalesce(F.nullif(F.regexp_extract(event_id, r"W(\d{4})", 1), F.lit("")).cast("int"), F.year(as_of))


def february_year(as_of: Column) -> Column:
    """The year of the next February event: once February is over, next year's."""
    return F.year(as_of) + (F.month(as_of) > 2).cast("int")


def calendar_link(url: Column) -> Column:
    """struct(start, end) of a calendar link's dates=YYYYMMDDTHHMMSSZ/YYYYMMDDTHHMMSSZ."""
    stamp = lambda n: F.try_to_timestamp(F.nullif(F.regexp_extract(url, r"dates=(\d{8}T\d{6}Z)/(\d{8}T\d{6}Z)", n), F.lit("")), F.lit("yyyyMMdd'T'HHmmssX"))
    return F.struct(stamp(1).alias("start"), stamp(2).alias("end"))


def mistagged_local(text: Column, zone: str = ZONE) -> Column:
    """A local time that carries a wrong offset or Z: the offset is dropped and the zone applied."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(Z|[+-]\d{2}:?\d{2})$", ""), "T", " ")
    return F.to_utc_timestamp(F.try_to_timestamp(bare), zone)


def flat_address(address: Column) -> Column:
    """A JSON address, given as a string or as an object with street, town and region."""
    field = lambda k: F.nullif(F.get_json_object(address, f"$.{k}"), F.lit(""))
    joined = F.concat_ws(", ", field("streetAddress"), field("addressLocality"), field("addressRegion"))
    return F.when(address.startswith("{"), F.nullif(joined, F.lit(""))).otherwise(address)
