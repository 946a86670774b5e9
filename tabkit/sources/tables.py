"""Scans and first looks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T


def read_csv_text(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """CSV with a header row; every column is a nullable string.

    With ``columns`` the schema is declared, so no job is needed to read the
    header, and a file whose header differs from it is an error.
    """
    reader = spark.read.option("header", True)
    if columns is not None:
        schema = T.StructType([T.StructField(c, T.StringType(), True) for c in columns])
        reader = reader.schema(schema).option("enforceSchema", False)
    return reader.csv(path)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def preview(df: DataFrame, order: Sequence[str | Column], n: int = 20) -> DataFrame:
    """The first ``n`` rows in a stated order, so that two looks agree."""
    return df.orderBy(*order).limit(n)


def matrix_frame(
    spark: SparkSession, matrix: Sequence[Sequence[float]], names: Sequence[str]
) -> DataFrame:
    """A small square matrix from the driver as a frame with named columns."""
    schema = T.StructType([T.StructField(c, T.DoubleType(), True) for c in names])
    rows = [[None if v != v else float(v) for v in row] for row in matrix]
    return spark.createDataFrame(rows, schema)
