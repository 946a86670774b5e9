"""Training and test parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_random(
    df: DataFrame, weights: Sequence[float] = (0.8, 0.2), seed: int = 42
) -> list[DataFrame]:
    """``randomSplit``.

    The parts depend on how the input is partitioned.  Settle or write the
    input first, or use :func:`with_part`, where that may change.
    """
    return df.randomSplit(list(weights), seed=seed)


def with_part(
    df: DataFrame, keys: Sequence[str], train_pct: int = 80, name: str = "part"
) -> DataFrame:
    """Add ``"train"`` or ``"test"``, decided by a hash of the key alone.

    A key lands in the same part in every run, on every cluster and after every
    repartition; rows that share a key stay together.
    """
    text = F.concat_ws("\x1f", *[F.col(f"`{k}`").cast("string") for k in keys])
    bucket = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % 100
    return df.withColumn(name, F.when(bucket < train_pct, F.lit("train")).otherwise(F.lit("test")))


def split_by_key(
    df: DataFrame, keys: Sequence[str], train_pct: int = 80
) -> tuple[DataFrame, DataFrame]:
    """The two parts of :func:`with_part`."""
    marked = with_part(df, keys, train_pct, "_part")
    train = marked.where(F.col("_part") == "train").drop("_part")
    test = marked.where(F.col("_part") == "test").drop("_part")
    return train, test
