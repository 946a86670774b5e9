"""Min-max scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import MinMaxScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.functions import as_number


def column_bounds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: a struct ``(low, high)`` per column.  NaN does not count."""
    out = []
    for c in columns:
        x = as_number(df.schema[c].dataType, F.col(f"`{c}`")).cast("double")
        x = F.when(~F.isnan(x), x)
        out.append(F.struct(F.min(x).alias("low"), F.max(x).alias("high")).alias(c))
    return df.agg(*out)


def min_max(df: DataFrame, columns: Sequence[str], suffix: str = "_scaled") -> DataFrame:
    """Scale each column to [0, 1]; a constant column becomes 0.5, NULL stays.

    The bounds are one aggregate over all columns and enter the projection as one
    scalar subquery.
    """
    bounds = column_bounds(df, columns).select(F.struct(*[f"`{c}`" for c in columns])).scalar()
    added = {}
    for c in columns:
        x = as_number(df.schema[c].dataType, F.col(f"`{c}`")).cast("double")
        low, high = F.col("_bounds")[c]["low"], F.col("_bounds")[c]["high"]
        added[c + suffix] = F.when(
            x.isNotNull(),
            F.when(low == high, F.lit(0.5)).otherwise(F.try_divide(x - low, high - low)),
        )
    return df.withColumn("_bounds", bounds).withColumns(added).drop("_bounds")


def min_max_vector(
    df: DataFrame,
    columns: Sequence[str],
    output: str = "scaled_features",
    handle_invalid: str = "skip",
) -> DataFrame:
    """The same as one vector column, by Spark ML."""
    packed = VectorAssembler(
        inputCols=list(columns), outputCol="_packed", handleInvalid=handle_invalid
    ).transform(df)
    scaler = MinMaxScaler(inputCol="_packed", outputCol=output)
    return scaler.fit(packed).transform(packed).drop("_packed")
