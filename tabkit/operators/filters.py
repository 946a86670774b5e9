"""Row filters that compare typed values, never text with numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.functions import not_equal_keep_null, to_type


def _typed(df: DataFrame, column: str, kind: str | None):
    c = F.col(f"`{column}`")
    return c if kind is None else to_type(df.schema[column].dataType, c, kind)


def filter_range(
    df: DataFrame,
    column: str,
    low: object = None,
    high: object = None,
    kind: str | None = None,
) -> DataFrame:
    """Rows with ``low <= column <= high``; NULL and unreadable text drop out.

    ``kind`` names the type to compare in when the column is text.  Without it
    the bare comparison reaches the scan as a pushed filter.
    """
    c = _typed(df, column, kind)
    kept = df
    if low is not None:
        kept = kept.where(c >= F.lit(low))
    if high is not None:
        kept = kept.where(c <= F.lit(high))
    return kept


def filter_in(
    df: DataFrame, column: str, values: Sequence[object], kind: str | None = None
) -> DataFrame:
    """Rows whose value is listed; ``kind`` as in :func:`filter_range`."""
    return df.where(_typed(df, column, kind).isin(*values))


def filter_ne(
    df: DataFrame, column: str, value: object, keep_null: bool = False
) -> DataFrame:
    """Rows whose value differs; NULL rows go too unless ``keep_null``."""
    c = F.col(f"`{column}`")
    return df.where(not_equal_keep_null(c, value) if keep_null else c != F.lit(value))
