"""Arrests: from the raw text table to the severity forests."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit import functions as fn
from tabkit import operators as op
from tabkit.sources import store

# The columns of an arrests table and what each is for.
IMPUTED = ("LAW_CAT_CD", "PERP_RACE")
REQUIRED = ("PD_DESC", "KY_CD", "OFNS_DESC", "LAW_CODE")
CASTS = {
    "X_COORD_CD": "double",
    "Y_COORD_CD": "double",
    "Latitude": "double",
    "Longitude": "double",
    "KY_CD": "int",
    "JURISDICTION_CODE": "int",
}
MINORS = "<18"
CORRELATED = (
    "KY_CD",
    "X_COORD_CD",
    "Y_COORD_CD",
    "Latitude",
    "Longitude",
    "DIA_SEMANA_INDEX",
    "MONTH_ARREST",
)
CATEGORIES = (
    "PERP_RACE",
    "MONTH_ARREST",
    "DIA_SEMANA_INDEX",
    "AGE_GROUP",
    "ARREST_BORO",
    "PERP_SEX",
)
LABEL = "LAW_CAT_CD"
# Trees and depth of the three forests compared.
FORESTS = ((10, 5), (50, 5), (20, 20))


def clean(raw: DataFrame, modes: DataFrame | None = None) -> DataFrame:
    """Sentinels to NULL, modes filled in, incomplete rows dropped.

    ``modes`` as in :func:`tabkit.operators.impute_modes`.
    """
    named = op.null_tokens(raw)
    return op.drop_missing(op.impute_modes(named, IMPUTED, modes=modes), REQUIRED)


def typed(cleaned: DataFrame) -> DataFrame:
    """The declared number types."""
    return op.cast_columns(cleaned, CASTS)


def age_counts(df: DataFrame) -> DataFrame:
    """Arrests per age group, most first."""
    return op.group_count_ranked(df, ["AGE_GROUP"])


def adults(df: DataFrame) -> DataFrame:
    """Without minors; rows whose age group is unknown go as well."""
    return op.filter_ne(df, "AGE_GROUP", MINORS)


def dated(df: DataFrame, month: str = "position") -> DataFrame:
    """Add ``MONTH_ARREST`` and ``DIA_SEMANA`` from the date text.

    ``month="position"`` reads characters 4 and 5, the day of the month in
    month-first text; ``"calendar"`` is the month itself.
    """
    if month not in ("position", "calendar"):
        raise ValueError("month is 'position' or 'calendar'")
    date = F.col("ARREST_DATE")
    number = fn.date_field_by_position(date) if month == "position" else fn.month_of_date(date)
    return df.withColumns({"MONTH_ARREST": number, "DIA_SEMANA": fn.weekday_name(date)})


def prepared(
    raw: DataFrame, month: str = "position", columns: Sequence[str] | None = None
) -> DataFrame:
    """All steps before statistics and models.

    ``columns`` are those of the raw table that are wanted (default: all); the
    ones that the steps themselves need are read beside them.  The modes are
    counted from their columns of the raw table, all rows; what is written is
    the cleaned, typed and dated rest: adults' complete rows.  Everything after
    reads that table, which :func:`tabkit.sources.cleared` removes.
    """
    named = op.null_tokens(raw)
    modes = op.settled_modes(named, IMPUTED)
    if columns is not None:
        own = dict.fromkeys([*columns, *REQUIRED, "AGE_GROUP", "ARREST_DATE"])
        named = named.select(*[c for c in named.columns if c in own])
    known = [c for c in IMPUTED if c in named.columns]
    complete = adults(op.drop_missing(named, REQUIRED))
    filled = op.impute_modes(complete, known, modes=modes) if known else complete
    ready = store(dated(_typed_among(filled), month), "arrests")
    indexed = op.index_labels(ready, ["DIA_SEMANA"])
    return indexed.withColumnRenamed("DIA_SEMANA_index", "DIA_SEMANA_INDEX")


def _typed_among(df: DataFrame) -> DataFrame:
    return op.cast_columns(df, {c: kind for c, kind in CASTS.items() if c in df.columns})


def correlation(ready: DataFrame) -> DataFrame:
    """Correlation of the number columns, long form."""
    return op.corr_long(ready, CORRELATED)


def split(
    ready: DataFrame, keys: Sequence[str] | None = None, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """80/20, by a key's hash where the table has a key, else at random."""
    if keys:
        return op.split_by_key(ready, keys)
    train, test = op.split_random(ready, seed=seed)
    return train, test


def severity_features(train: DataFrame) -> op.Features:
    """Indices fitted on the training part."""
    return op.fit_features(train, CATEGORIES, LABEL)


def severity_importances(
    train: DataFrame,
    test: DataFrame,
    seed: int,
    forests: Sequence[tuple[int, int]] = FORESTS,
) -> tuple[DataFrame, DataFrame]:
    """:func:`severity_sweep`, and the importances of each forest."""
    params = [op.ForestParams(seed, trees, depth) for trees, depth in forests]
    features = severity_features(train)
    metrics, models = op.sweep_models(train, test, features, params)
    return metrics, op.sweep_importances(models, features, params)


def severity_sweep(
    train: DataFrame,
    test: DataFrame,
    seed: int,
    forests: Sequence[tuple[int, int]] = FORESTS,
) -> DataFrame:
    """The metrics of each forest on the test part."""
    params = [op.ForestParams(seed, trees, depth) for trees, depth in forests]
    return op.sweep(train, test, severity_features(train), params)


def severity_agreement(
    train: DataFrame,
    test: DataFrame,
    keys: Sequence[str],
    seed: int,
    forests: Sequence[tuple[int, int]] = FORESTS,
) -> DataFrame:
    """``(num_trees, max_depth, ...)``: :func:`tabkit.operators.agreement` of each forest on the test part."""
    params = [op.ForestParams(seed, trees, depth) for trees, depth in forests]
    features = severity_features(train)
    _, models = op.sweep_models(train, test, features, params)
    rows = [
        op.agreement(model, features, op.predict(model, features, test), keys, op.importances(model, features)).select(
            F.lit(p.num_trees).alias("num_trees"), F.lit(p.max_depth).alias("max_depth"), "*"
        )
        for p, model in zip(params, models, strict=True)
    ]
    return reduce(DataFrame.unionByName, rows)
