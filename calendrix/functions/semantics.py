"""Clock, rounding and missing-value rules that the operators share. All clocks are parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hours_between(a: Column, b: Column) -> Column:
    """Whole hours between two instants, without sign, cut towards zero; null if either is."""
    return F.floor(F.abs(F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 3_600_000_000).cast("int")


def within_hours(a: Column, b: Column, hours: int) -> Column:
    """Whether hours_between is at most hours: under hours + 1 full hours apart."""
    return hours_between(a, b) <= hours


def local_day(at: Column, zone: str = "UTC") -> Column:
    return F.to_date(F.from_utc_timestamp(at.cast("timestamp"), zone))


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Halves go towards plus infinity."""
    scale = 10.0**digits
    return F.floor(x * scale + 0.5) / scale


def or_else(*cols: Column) -> Column:
    """The first column that is neither null nor an empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def midnight(at: Column) -> Column:
    """A placeholder time: exactly midnight UTC."""
    return F.date_format(at.cast("timestamp"), "HH:mm:ss") == "00:00:00"


def parsed(text: Column) -> Column:
    """The instant a string states, null if it states none."""
    return F.try_to_timestamp(text)


def upcoming(start: Column, as_of: Column) -> Column:
    """Not known to be over: rows without a readable start stay."""
    return ~F.coalesce(parsed(start) < as_of, F.lit(False))


def days_since(at: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 86_400_000_000


def decayed_priority(last_success: Column, created: Column, as_of: Column, rate: float = 0.9, floor: float = 0.01) -> Column:
    """rate to the power of the days since the last success (or since creation), floor at least."""
    days = F.coalesce(days_since(last_success, as_of), days_since(created, as_of), F.lit(0.0))
    return F.greatest(F.lit(floor), F.pow(F.lit(rate), days))


def time_ago(at: Column, as_of: Column) -> Column:
    minutes = F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 60_000_000)
    return (
        F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h ago")))
        .otherwise(F.concat(F.floor(minutes / 1440).cast("string"), F.lit("d ago")))
    )


def pass_rate(passed: Column, failed: Column) -> Column:
    """Percentage, rounded half up; null without any outcome."""
    return F.floor(F.try_divide(passed * 100.0, passed + failed) + 0.5).cast("int")


def call_cost(calls: Column, fast: float = 0.001, standard: float = 0.015, strategic: float = 0.10) -> Column:
    """One strategic call, five in a hundred standard ones, the rest fast; 0 without calls."""
    mid = F.floor(calls * 0.05 + 0.5)
    rest = F.greatest(calls - 1 - mid, F.lit(0))
    return F.when(calls > 0, strategic + mid * standard + rest * fast).otherwise(0.0)


def zero_padded(n: Column, width: int = 6) -> Column:
    """Longer numbers are not cut."""
    text = n.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)
