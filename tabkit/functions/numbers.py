"""Lenient number casts with one answer whatever the ANSI setting is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGRAL = ("tinyint", "smallint", "int", "bigint")


def as_int(c: Column, kind: str = "int") -> Column:
    """Text to whole number: a fraction is cut off, bad text is NULL.

    The pattern runs only on the cells that the plain cast refuses.
    """
    whole = F.regexp_extract(c, r"^[\x00-\x20]*([+-]?\d+)\.\d*[\x00-\x20]*$", 1)
    return F.coalesce(c.try_cast(kind), whole.try_cast(kind))


def as_double(c: Column, nan_to_null: bool = True) -> Column:
    """Text to double: bad text is NULL, and so is NaN unless it is wanted."""
    number = c.try_cast("double")
    return F.when(~F.isnan(number), number) if nan_to_null else number


def as_number(df_type: T.DataType, c: Column, nan_to_null: bool = True) -> Column:
    """A column as a number to average: strings are read, numbers are kept."""
    if isinstance(df_type, T.StringType):
        return as_double(c, nan_to_null)
    return c


def to_type(source: T.DataType, c: Column, target: str, nan_to_null: bool = True) -> Column:
    """Cast for a declared type map; what does not fit is NULL."""
    if isinstance(source, T.StringType) and target in _INTEGRAL:
        return as_int(c, target)
    if target in ("double", "float"):
        number = c.try_cast(target)
        return F.when(~F.isnan(number), number) if nan_to_null else number
    return c.try_cast(target)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient that is NULL over zero."""
    return F.try_divide(numerator, denominator)
