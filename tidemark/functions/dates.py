"""Parsers for the two conversation date layouts; unparseable input gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names in calendar order.
MONTHS = (
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
)

_SLASH = r"(\d{4})/(\d{2})/(\d{2})\s*\([^)]*\)\s*(\d{2}):(\d{2})"
_CLOCK = r"(?i)(\d+):(\d+)\s*(am|pm)\s*on\s*(\d+)\s*(\w+),?\s*(\d+)"


def _iso(year: Column, month: Column, day: Column, hour: Column, minute: Column) -> Column:
    """ISO text in UTC; day, hour and minute overflow carries forward like a civil calendar."""
    one, zero = F.lit(1), F.lit(0)
    first = F.try_make_timestamp_ntz(year, month, one, zero, zero, zero.cast("decimal(16,6)"))
    moment = first + F.make_dt_interval(day - 1, hour, minute, zero)
    return F.concat(F.replace(moment.cast("string"), F.lit(" "), F.lit("T")), F.lit(".000Z"))


def _clock(hour: Column, minute: Column) -> Column:
    twelve = F.when(hour % 12 == 0, F.lit(12)).otherwise(hour % 12)
    return F.concat(twelve.cast("string"), F.lit(":"), minute, F.lit(" "),
                    F.when(hour >= 12, "pm").otherwise("am"))


def _result(ok: Column, iso: Column, formatted: Column) -> Column:
    return F.when(ok & iso.isNotNull(), F.struct(iso.alias("iso"), formatted.alias("formatted")))


def parse_slash_date(text: Column) -> Column:
    """``yyyy/MM/dd (xxx) HH:mm`` to ``struct(iso, formatted)``."""

    def part(i: int) -> Column:
        return F.regexp_extract(text, _SLASH, i)

    def num(i: int) -> Column:
        return part(i).try_cast("int")

    names = F.array(*[F.lit(m) for m in MONTHS])
    formatted = F.concat(
        _clock(num(4), part(5)), F.lit(" on "), num(3).cast("string"), F.lit(" "),
        F.get(names, num(2) - 1), F.lit(", "), part(1),
    )
    return _result(text.rlike(_SLASH), _iso(num(1), num(2), num(3), num(4), num(5)), formatted)


def parse_clock_date(text: Column) -> Column:
    """``h:mm am on d Month, yyyy`` to ``struct(iso, formatted)``; months match by prefix.

    An unknown month gives null.
    """

    def part(i: int) -> Column:
        return F.regexp_extract(text, _CLOCK, i)

    def num(i: int) -> Column:
        return part(i).try_cast("int")

    half = F.lower(part(3))
    hour = (
        F.when((half == "pm") & (num(1) != 12), num(1) + 12)
        .when((half == "am") & (num(1) == 12), F.lit(0))
        .otherwise(num(1))
    )
    month = F.lit(None).cast("int")
    for number, name in reversed(list(enumerate(MONTHS, start=1))):
        month = F.when(F.lit(name.lower()).startswith(F.lower(part(5))), F.lit(number)).otherwise(month)
    formatted = F.concat(
        _clock(hour, part(2)), F.lit(" on "), part(4), F.lit(" "), part(5), F.lit(", "), part(6)
    )
    return _result(text.rlike(_CLOCK), _iso(num(6), month, num(4), hour, num(2)), formatted)


def date_of(iso: Column) -> Column:
    """Text before ``T``; ``unknown`` when absent."""
    return F.coalesce(F.split_part(F.when(iso != "", iso), F.lit("T"), F.lit(1)), F.lit("unknown"))
