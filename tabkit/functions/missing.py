"""Predicates for missing values; each fits the type of the column it tests."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The texts that stand for a missing value.
MISSING_TOKENS = ("(No value)", "UNKNOWN", "(null)")

# What a cast to double turns into NaN.  A pattern, so that ordinary text is
# turned away at its first letter and never reaches the number parser.
_TEXT_NAN = r"^[\x00-\x20]*(?:(?i:nan)|[+-]NaN)[\x00-\x20]*$"


def is_text_nan(c: Column) -> Column:
    """True where a string would become NaN as a double."""
    return c.rlike(_TEXT_NAN)


def is_missing(
    field: T.StructField, tokens: Sequence[str] = MISSING_TOKENS, nan: bool = True
) -> Column:
    """Never-NULL test of one column for NULL, NaN and the sentinel texts.

    NaN is tested on floating columns and on texts that read as NaN, sentinels
    on string columns only, so nothing is cast and ANSI mode has nothing to
    object to.
    """
    c = F.col(f"`{field.name}`")
    test = c.isNull()
    if isinstance(field.dataType, T.StringType):
        if tokens:
            test = test | c.isin(*tokens)
        if nan:
            test = test | is_text_nan(c)
    elif isinstance(field.dataType, (T.FloatType, T.DoubleType)) and nan:
        test = test | F.isnan(c)
    return test


def is_complete(fields: Sequence[T.StructField]) -> Column:
    """True where no column is NULL and no floating column is NaN."""
    tests = [
        ~is_missing(f, tokens=(), nan=not isinstance(f.dataType, T.StringType)) for f in fields
    ]
    return reduce(and_, tests, F.lit(True))


def not_equal_keep_null(c: Column, value: object) -> Column:
    """``!=`` that keeps NULL rows, where the plain operator drops them."""
    return ~c.eqNullSafe(F.lit(value))
