"""Choosing, renaming, dropping and casting columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.functions import to_type

# The short type names Spark prints for number columns.
NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
INT_AND_DOUBLE = ("int", "double")


def project(df: DataFrame, columns: Sequence[str] | Mapping[str, str]) -> DataFrame:
    """Keep named columns; a mapping goes from old name to new name."""
    if isinstance(columns, Mapping):
        return df.select(*[F.col(f"`{old}`").alias(new) for old, new in columns.items()])
    return df.select(*[F.col(f"`{c}`") for c in columns])


def drop_columns(df: DataFrame, names: Sequence[str], strict: bool = True) -> DataFrame:
    """Drop columns; an unknown name is an error unless ``strict`` is off."""
    unknown = [n for n in names if n not in df.columns]
    if strict and unknown:
        raise ValueError(f"no such column: {', '.join(unknown)}")
    return df.drop(*names)


def columns_of_type(df: DataFrame, types: Sequence[str] = NUMERIC_TYPES) -> list[str]:
    """Names of the columns whose type is listed, in table order.

    ``decimal`` stands for every precision.  Pass ``INT_AND_DOUBLE`` to leave
    out bigint, float and decimal.
    """
    return [c for c, kind in df.dtypes if kind.split("(")[0] in types]


def cast_columns(
    df: DataFrame,
    casts: Mapping[str, str | tuple[str, str]],
    nan_to_null: bool = True,
) -> DataFrame:
    """Cast by a declared map, in one projection.

    ``{"age": "int"}`` casts in place; ``{"age_n": ("age", "int")}`` leaves the
    source column alone and adds the cast one under a second name.
    """
    planned = {
        new: (spec if isinstance(spec, tuple) else (new, spec)) for new, spec in casts.items()
    }
    return df.withColumns(
        {
            new: to_type(df.schema[old].dataType, F.col(f"`{old}`"), kind, nan_to_null)
            for new, (old, kind) in planned.items()
        }
    )
