"""Quality of class predictions, from one pass over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _comparable(df: DataFrame, label: str, prediction: str) -> tuple[Column, Column]:
    """Both columns in one type: numbers as doubles, else as they are.

    A number is never compared with a text, where 1 and 1.0 would be two classes.
    """
    kinds = [df.schema[c].dataType for c in (label, prediction)]
    columns = (F.col(f"`{label}`"), F.col(f"`{prediction}`"))
    if all(isinstance(k, T.NumericType) for k in kinds):
        return columns[0].cast("double"), columns[1].cast("double")
    if kinds[0] != kinds[1]:
        raise ValueError(f"{label} and {prediction} are of different types")
    return columns


def confusion_counts(
    predictions: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """``(label, prediction, n)``; one small row per pair that occurs.

    Numbers come out as doubles.
    """
    actual, predicted = _comparable(predictions, label, prediction)
    return predictions.groupBy(actual.alias("label"), predicted.alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def metrics_row(
    predictions: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """One row: accuracy, weighted precision, weighted recall, F1.

    Each is the mean over true classes, weighted by their rows; a class never
    predicted has precision 0.  The predictions are counted once, where one
    evaluator call per metric would compute them four times.
    """
    cell = confusion_counts(predictions, label, prediction)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("bigint")

    def side(of: str, actual: Column, predicted: Column, right: Column) -> Column:
        return F.struct(
            F.col(of).alias("class"),
            actual.alias("actual"),
            predicted.alias("predicted"),
            right.cast("bigint").alias("hit"),
        )

    sides = F.array(
        side("label", F.col("n"), zero, hit),
        side("prediction", zero, F.col("n"), zero),
    )
    per_class = (
        cell.select(F.inline(sides))
        .groupBy("class")
        .agg(*[F.sum(c).alias(c) for c in ("actual", "predicted", "hit")])
    )
    precision = F.coalesce(F.try_divide(F.col("hit"), F.col("predicted")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("hit"), F.col("actual")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    rows = F.sum("actual")

    def weighted(c: Column) -> Column:
        return F.try_divide(F.sum(c * F.col("actual")), rows)

    return per_class.agg(
        F.try_divide(F.sum("hit"), rows).alias("accuracy"),
        weighted(precision).alias("weightedPrecision"),
        weighted(recall).alias("weightedRecall"),
        weighted(f1).alias("f1"),
    )


def classification_metrics(
    predictions: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """:func:`metrics_row` as ``(metric, value)``."""
    row = metrics_row(predictions, label, prediction)
    lines = [F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in row.columns]
    return row.select(F.inline(F.array(*lines)))
