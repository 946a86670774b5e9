"""Date parts from text, as native expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabkit.functions.numbers import as_int

# Weekday names, Monday first.
WEEKDAYS_ES = ("Lunes", "Martes", "Miércoles", "Jueves", "Viernes", "Sábado", "Domingo")

DATE_FORMAT = "M/d/yyyy"
_DATE_SHAPE = r"^\d{1,2}/\d{1,2}/\d{4}$"


def parse_date(c: Column, fmt: str = DATE_FORMAT) -> Column:
    """Text to date; NULL and malformed text give NULL.

    Text of another shape than the default format is turned away first, so a
    date followed by more text is malformed under every parser policy.
    """
    text = F.when(c.rlike(_DATE_SHAPE), c) if fmt == DATE_FORMAT else c
    return F.try_to_date(text, fmt)


def weekday_name(
    c: Column, fmt: str = DATE_FORMAT, names: Sequence[str] = WEEKDAYS_ES
) -> Column:
    """Name of the weekday of a date text."""
    day = F.weekday(parse_date(c, fmt))
    # try_: under ANSI the strict form turns a NULL index into the last name.
    return F.try_element_at(F.array(*[F.lit(n) for n in names]), day + 1)


def month_of_date(c: Column, fmt: str = DATE_FORMAT) -> Column:
    """Calendar month of a date text."""
    return F.month(parse_date(c, fmt))


def date_field_by_position(c: Column, start: int = 4, length: int = 2) -> Column:
    """The characters at a position as a whole number.

    On month-first text positions 4 and 5 hold the day of the month; see
    :func:`month_of_date` for the month.
    """
    return as_int(F.substring(c, start, length))


# Calendar units, coarse to fine.
DATE_UNITS = ("year", "quarter", "month", "week", "day")
CLOCK_UNITS = ("hour", "minute", "second")


def time_bucket(source: T.DataType, c: Column, unit: str) -> Column:
    """A time cut down to its calendar unit, in the column's own type.

    A time without zone is cut by its own date and clock: going through the
    session's zone would move the hours that a clock change skips.
    """
    if unit not in (*DATE_UNITS, *CLOCK_UNITS):
        raise ValueError(f"unit is one of {', '.join((*DATE_UNITS, *CLOCK_UNITS))}")
    if isinstance(source, T.TimestampType):
        return F.date_trunc(unit, c)
    date = c.cast("date")
    if unit in DATE_UNITS:
        start = date if unit == "day" else F.trunc(date, unit)
        return start.cast(source)
    clock = [F.hour(c), F.minute(c), F.floor(F.second(c))]
    kept = clock[: CLOCK_UNITS.index(unit) + 1]
    return date.cast(source) + F.make_dt_interval(F.lit(0), *[k.cast("int") for k in kept])
