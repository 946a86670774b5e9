"""One scan that counts the values of several columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMN = "_column"
COUNT = "_n"
ROWS = "_rows"

# Types whose values share one bigint column.
_WHOLE = ("tinyint", "smallint", "int", "bigint")


def value_homes(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[str, str]]:
    """Per column the value column that :func:`count_values` puts it in, and its type."""
    kinds = dict(df.dtypes)
    types = {c: "bigint" if kinds[c] in _WHOLE else kinds[c] for c in columns}
    order = list(dict.fromkeys(types.values()))
    return {c: (f"_value{order.index(t)}", t) for c, t in types.items()}


def count_values(
    df: DataFrame,
    columns: Sequence[str],
    weight: str | None = None,
    carried: Mapping[str, Column] | None = None,
    measures: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Count of every value of every column; NULL is a value.

    Returns ``_column``, ``_rows``, ``_n`` (the sum of ``weight``, or the rows
    again) and one value column per type, of which the one that
    :func:`value_homes` names for the column is filled.  Columns of one type are
    unpivoted and counted together, so each is read once and the grouping key
    stays two columns wide.  The counts are combined before the shuffle: a
    value that fills a third of the rows costs one row per task.

    ``measures`` are further aggregates of each value's rows, over the columns
    ``carried`` that are computed from the row.
    """
    homes = value_homes(df, columns)
    types = dict(homes.values())
    carried, measures = carried or {}, measures or {}
    keep = [*carried, *([] if weight is None else ["_weight"])]
    parts = []
    for home, kind in types.items():
        own = [c for c in columns if homes[c][0] == home]
        chosen = df.select(
            *[F.col(f"`{c}`").cast(kind).alias(c) for c in own],
            *[x.alias(name) for name, x in carried.items()],
            *([] if weight is None else [F.col(f"`{weight}`").alias("_weight")]),
        )
        total = F.count(F.lit(1)) if weight is None else F.sum("_weight")
        counted = (
            chosen.unpivot(keep, [F.col(f"`{c}`") for c in own], COLUMN, home)
            .groupBy(COLUMN, home)
            .agg(
                F.count(F.lit(1)).alias(ROWS),
                total.alias(COUNT),
                *[x.alias(name) for name, x in measures.items()],
            )
        )
        parts.append(
            counted.select(
                COLUMN,
                ROWS,
                COUNT,
                *measures,
                *[(F.col(h) if h == home else F.lit(None).cast(k)).alias(h) for h, k in types.items()],
            )
        )
    return reduce(DataFrame.unionByName, parts)


def value_text(df: DataFrame, columns: Sequence[str]) -> Column:
    """The value of a :func:`count_values` row as text."""
    homes = dict.fromkeys(h for h, _ in value_homes(df, columns).values())
    return F.coalesce(*[F.col(h).cast("string") for h in homes])
