"""Attaching a small or large per-key table to the rows it was made from."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A side is broadcast only when its rows were measured to be below this.
BROADCAST_BYTES = 64 * 1024 * 1024

# Rows of one key that a task may get; a key with more of them is split.
ROWS_PER_TASK = 1_000_000

# Split keys travel to every task as a hash and a number, so that this many fit.
MOST_SPLIT = 1_000_000


def row_bytes(df: DataFrame) -> Column:
    """Rough size of a row: text by its length, numbers by a word.

    Nested values have no bound that one could read off them; they are refused.
    """
    nested = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.UserDefinedType))
    ]
    if nested:
        raise ValueError(f"the size of nested columns is not known: {', '.join(nested)}")
    parts = [
        F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) + 16
        if isinstance(f.dataType, (T.StringType, T.BinaryType))
        else F.lit(16)
        for f in df.schema.fields
    ]
    return reduce(add, parts).cast("bigint")


def measured_bytes(df: DataFrame) -> int:
    """Size of a settled table; one job, one number."""
    return df.agg(F.sum(row_bytes(df))).head()[0] or 0


def join_lookup(
    df: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    weight: str,
    null_safe: bool = False,
    max_bytes: int = BROADCAST_BYTES,
    rows_per_task: int = ROWS_PER_TASK,
    size: int | None = None,
) -> DataFrame:
    """Left join of ``df`` with ``lookup``, which holds one row per key.

    ``lookup`` must be settled and must carry, as ``weight``, how many rows of
    ``df`` have the key; that column is not added.  NULL keys find nothing
    unless ``null_safe`` is set.  Values of the lookup are not nested.

    A lookup measured below ``max_bytes`` is broadcast and ``df`` is not
    shuffled.  Beyond that ``df`` is read once and shuffled by the key's hash;
    a key with more than ``rows_per_task`` rows is dealt over as many tasks as
    it needs, and its row of the lookup goes to each of them.  Which keys those
    are is known everywhere from their hashes, at most MOST_SPLIT of them: with
    more rows than that many times ``rows_per_task``, a task gets more.
    """
    values = [c for c in lookup.columns if c not in keys and c != weight]
    side = lookup.select(
        *[F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(keys)],
        *[F.col(f"`{v}`") for v in values],
        F.col(f"`{weight}`").alias("_weight"),
    )
    helpers = [f"_key{i}" for i in range(len(keys))]
    pairs = [(F.col(f"`{k}`"), F.col(h)) for k, h in zip(keys, helpers, strict=True)]
    on = reduce(and_, [a.eqNullSafe(b) if null_safe else a == b for a, b in pairs])

    size = measured_bytes(side) if size is None else size
    if size <= max_bytes:
        return df.join(F.broadcast(side.drop("_weight")), on, "left").drop(*helpers)

    total = side.agg(F.sum("_weight")).head()[0] or 0
    share = max(rows_per_task, -(-total // MOST_SPLIT))
    side = side.withColumns(
        {"_hash": F.xxhash64(*helpers), "_tasks": F.ceil(F.col("_weight") / share).cast("int")}
    ).drop("_weight")
    split = (
        side.where(F.col("_tasks") > 1)
        .groupBy(F.col("_hash").alias("_of"))
        .agg(F.max("_tasks").alias("_among"))
    )
    # Keys that share a hash are split alike, so that both sides agree.
    copies = side.join(F.broadcast(split), F.col("_hash") == F.col("_of"), "left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.coalesce("_among", F.lit(1)) - 1))
    )
    copies = copies.drop("_tasks", "_of", "_among").withColumnsRenamed(
        {"_hash": "_lookup_hash", "_part": "_lookup_part"}
    )
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    own = F.xxhash64(*[F.col(f"`{c}`") for c in plain], F.spark_partition_id())
    lost = F.lit(False) if null_safe else reduce(lambda a, b: a | b, [a.isNull() for a, _ in pairs])
    # Rows without a key find nothing; their own hash spreads them.
    key_hash = F.when(lost, own).otherwise(F.xxhash64(*[a for a, _ in pairs]))
    dealt = (
        df.withColumn("_own", own)
        .withColumn("_hash", key_hash)
        .join(F.broadcast(split), F.col("_hash") == F.col("_of"), "left")
        .withColumn("_part", F.pmod(F.col("_own"), F.coalesce("_among", F.lit(1))).cast("int"))
        .drop("_own", "_of", "_among")
    )
    same = (F.col("_hash") == F.col("_lookup_hash")) & (F.col("_part") == F.col("_lookup_part")) & on
    return dealt.join(copies, same, "left").drop(*helpers, "_hash", "_part", "_lookup_hash", "_lookup_part")
