"""Row numbers over tables that need not fit in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabkit.operators.lookup import BROADCAST_BYTES, measured_bytes
from tabkit.sources import settle

# Bytes of a range that is sorted and numbered in one task.
RANGE_BYTES = 32 * 1024 * 1024

# monotonically_increasing_id puts the partition above this many bits.
_WITHIN = 33


def number_rows(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    name: str,
    max_bytes: int = BROADCAST_BYTES,
    size: int | None = None,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """``row_number()`` per ``by`` group in a total order, starting at 0.

    ``df`` must be settled.  Measured below ``max_bytes``, it is one window.
    Beyond that the rows are put in ranges of about ``range_bytes`` by group and
    order, sorted there, and settled with their place in the range: one
    shuffle.  A group's number is that place, less the group's first place in
    the range, plus the group's rows in the ranges before; the table of these
    has one row per range and group in it.
    """
    keys = [F.col(f"`{b}`") for b in by]
    size = measured_bytes(df) if size is None else size
    if size <= max_bytes:
        window = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, F.row_number().over(window) - 1)

    n = max(2, -(-size // range_bytes))
    placed = settle(
        df.repartitionByRange(n, *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_at", F.monotonically_increasing_id())
    ).withColumn("_range", F.shiftright("_at", _WITHIN))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(*keys, "_range")
        .agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
        .withColumn("_shift", F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first"))
        .select(
            *[k.alias(f"_by{i}") for i, k in enumerate(keys)], F.col("_range").alias("_range_of"), "_shift"
        )
    )
    same = F.col("_range") == F.col("_range_of")
    for i, k in enumerate(keys):
        same = same & k.eqNullSafe(F.col(f"_by{i}"))
    return (
        placed.join(starts, same, "inner")
        .withColumn(name, F.col("_at") + F.col("_shift"))
        .select(*[F.col(f"`{c}`") for c in df.columns], name)
    )
