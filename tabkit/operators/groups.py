"""Counts and means per group, and rows compared with their group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabkit.functions import as_number, ratio, time_bucket, to_type
from tabkit.operators.lookup import BROADCAST_BYTES, join_lookup
from tabkit.sources import settle


def _named(columns: Sequence[str]) -> list[Column]:
    """Columns by their whole names; a dot in a name is part of it."""
    return [F.col(f"`{c}`") for c in columns]


def row_count(df: DataFrame, name: str = "n") -> DataFrame:
    """Number of rows, as a one-row frame."""
    return df.agg(F.count(F.lit(1)).alias(name))


def group_count(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Rows per group; NULL is a group."""
    return df.groupBy(*_named(keys)).agg(F.count(F.lit(1)).alias(name))


def group_count_ranked(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Rows per group, largest group first, ties by key."""
    return group_count(df, keys, name).orderBy(F.col(f"`{name}`").desc(), *_named(keys))


def top_k(df: DataFrame, keys: Sequence[str], k: int, name: str = "n") -> DataFrame:
    """The ``k`` largest groups, ties by key."""
    return group_count_ranked(df, keys, name).limit(k)


def histogram(df: DataFrame, key: str, kind: str = "int", name: str = "n") -> DataFrame:
    """Rows per value of a column, cast first so that 9 sorts before 18."""
    value = to_type(df.schema[key].dataType, F.col(f"`{key}`"), kind)
    return group_count(df.select(value.alias(key)), [key], name).orderBy(*_named([key]))


def time_bucket_count(df: DataFrame, ts: str, unit: str, name: str = "n") -> DataFrame:
    """Rows per calendar unit of a time column, oldest first."""
    bucket = time_bucket(df.schema[ts].dataType, F.col(f"`{ts}`"), unit).alias("bucket")
    return group_count(df.select(bucket), ["bucket"], name).orderBy("bucket")


def group_mean(df: DataFrame, keys: Sequence[str], x: str, name: str = "mean") -> DataFrame:
    """Mean of ``x`` per group; text is read as numbers, bad text is left out."""
    value = as_number(df.schema[x].dataType, F.col(f"`{x}`"))
    return df.groupBy(*_named(keys)).agg(F.avg(value).alias(name))


def join_group_mean(
    df: DataFrame,
    keys: Sequence[str],
    x: str,
    name: str = "group_mean",
    null_key: str = "null",
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Every row with the mean of its group.

    The means are aggregated (combined before the shuffle) and joined back; a
    window over the keys would move every row and put a large group in one
    task.  Runs one job for the means.  ``null_key="null"``: rows without a key
    get no mean; ``"group"``: they form a group of their own.
    """
    if null_key not in ("null", "group"):
        raise ValueError("null_key is 'null' or 'group'")
    value = as_number(df.schema[x].dataType, F.col(f"`{x}`"))
    means = df.groupBy(*_named(keys)).agg(
        F.avg(value).alias(name), F.count(F.lit(1)).alias("_rows")
    )
    if null_key == "null":
        means = means.where(reduce(and_, [k.isNotNull() for k in _named(keys)]))
    return join_lookup(
        df, settle(means), keys, "_rows", null_safe=null_key == "group", max_bytes=max_bytes
    )


def group_mean_ratio(
    df: DataFrame,
    keys: Sequence[str],
    x: str,
    mean_name: str = "group_mean",
    ratio_name: str = "ratio",
    null_key: str = "null",
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """:func:`join_group_mean` and ``x`` over that mean; NULL over zero."""
    joined = join_group_mean(df, keys, x, mean_name, null_key, max_bytes)
    value = as_number(df.schema[x].dataType, F.col(f"`{x}`"))
    return joined.withColumn(ratio_name, ratio(value, F.col(f"`{mean_name}`")))
