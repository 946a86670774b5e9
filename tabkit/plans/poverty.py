"""Poverty: from the raw text table to the poverty-status forest."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame

from tabkit import operators as op
from tabkit.sources import store

# The columns of a poverty table and what each is for.
MOSTLY_MISSING = ("JWTR", "ENG", "WKW")
IMPUTED = ("SCHL", "EducAttain", "LANX", "MSP")
UNUSED = (
    "EST_PovGap",
    "EST_PovGapIndex",
    "NYCgov_REL",
    "NYCgov_Threshold",
    "Off_Threshold",
    "Povunit_ID",
    "Povunit_Rel",
    "AgeCateg",
    "DS",
    "ESR",
    "HHT",
    "INTP_adj",
    "JWTR",
    "MRGP_adj",
    "NP",
    "REL",
    "RELP",
    "RELSHIPP",
    "RETP_adj",
    "RNTP_adj",
    "SERIALNO",
    "WGTP",
    "WKHP",
    "WKW",
    "JWTRNS",
    "WKWN",
)
CASTS = {
    "PWGTP": "int",
    "AGEP": "int",
    "EST_Childcare": "double",
    "EST_Commuting": "double",
    "EST_FICAtax": "double",
    "EST_HEAP": "double",
    "EST_Housing": "double",
    "EST_IncomeTax": "double",
    "EST_MOOP": "double",
    "EST_Nutrition": "double",
    "NYCgov_Income": "double",
    "PreTaxIncome_PU": "double",
    "TotalWorkHrs_PU": "int",
}
LEAKING = ("EST_FICAtax", "EST_IncomeTax", "NYCgov_Income", "PreTaxIncome_PU")
CORRELATED_CATEGORIES = ("Ethnicity", "TEN", "SEX", "SCH", "MSP", "LANX", "CIT", "DIS")
SCALED = (
    "PWGTP",
    "AGEP",
    "EST_Childcare",
    "EST_Commuting",
    "EST_HEAP",
    "EST_Housing",
    "EST_MOOP",
    "EST_Nutrition",
)
FEATURES = (
    "Ethnicity",
    "AGEP",
    "SEX",
    "Boro",
    "CitizenStatus",
    "EducAttain",
    "FamType_PU",
    "FTPTWork",
    "TotalWorkHrs_PU",
    "CIT",
    "DIS",
    "SCH",
    "TEN",
)
NUMBERS = ("AGEP", "TotalWorkHrs_PU")
LABEL = "NYCgov_Pov_Stat"
ADULT_AGE = 18
CITIZENS = (1, 2)
# Trees and depth of the forest.
FOREST = (100, 10)


def dense(raw: DataFrame, max_missing_pct: float | None = None) -> DataFrame:
    """Sentinels to NULL, sparse and unused columns dropped.

    The sparse columns are the listed ones, or with ``max_missing_pct`` those
    that the profile of this table shows.
    """
    named = op.null_tokens(raw)
    if max_missing_pct is None:
        kept = op.drop_columns(named, MOSTLY_MISSING, strict=False)
    else:
        kept = op.drop_sparse(named, max_missing_pct)
    return op.drop_columns(kept, UNUSED, strict=False)


def clean(
    raw: DataFrame, max_missing_pct: float | None = None, modes: DataFrame | None = None
) -> DataFrame:
    """:func:`dense`, with the modes filled in.

    ``modes`` as in :func:`tabkit.operators.impute_modes`.
    """
    return op.impute_modes(dense(raw, max_missing_pct), IMPUTED, modes=modes)


def typed(cleaned: DataFrame) -> DataFrame:
    """The declared number types."""
    return op.cast_columns(cleaned, CASTS)


def adult_citizens(numbers: DataFrame) -> DataFrame:
    """Only adults who are citizens, from a typed table.

    Numbers are compared as numbers; the bound on the age reaches the scan.
    """
    return op.filter_in(adults(numbers), "CitizenStatus", CITIZENS, kind="int")


def adults(numbers: DataFrame) -> DataFrame:
    """Everyone of age, citizen or not; the bound reaches the scan."""
    return op.filter_range(numbers, "AGEP", low=ADULT_AGE)


def citizen_counts(df: DataFrame) -> DataFrame:
    """People per citizen status."""
    return op.histogram(df, "CitizenStatus")


def age_counts(df: DataFrame) -> DataFrame:
    """People per age, youngest first."""
    return op.histogram(df, "AGEP")


def enriched(df: DataFrame) -> DataFrame:
    """Add the marital index, scaled income, and income relative to the
    mean of the same education."""
    relative = op.group_mean_ratio(
        op.min_max(df, ["PreTaxIncome_PU"]),
        ["EducAttain"],
        "PreTaxIncome_PU",
        mean_name="AvgIncomeByEducation",
        ratio_name="NormalizedIncomeByEducation",
    )
    indexed = op.index_labels(relative, ["MAR"])
    return indexed.withColumnRenamed("MAR_index", "MaritalStatusIndex")


def residents(raw: DataFrame, max_missing_pct: float | None = None) -> DataFrame:
    """Everyone, cleaned and typed, read from a stored table.

    The text is parsed into that table once: the sparse and unused columns are
    gone, numbers are numbers.  :func:`tabkit.sources.cleared` removes it.
    """
    table = store(typed(dense(raw, max_missing_pct)), "poverty")
    return op.impute_modes(table, IMPUTED, modes=op.settled_modes(table, IMPUTED))


def people(raw: DataFrame, max_missing_pct: float | None = None) -> DataFrame:
    """Adult citizens; the modes are those of everyone."""
    return adult_citizens(residents(raw, max_missing_pct))


def prepared(raw: DataFrame) -> DataFrame:
    """All steps before statistics and models."""
    return enriched(people(raw))


def numeric_correlation(ready: DataFrame) -> DataFrame:
    """Correlation of every int and double column, long form."""
    names = [
        c
        for c in op.columns_of_type(ready, op.INT_AND_DOUBLE)
        if c != "PreTaxIncome_PU_scaled"
    ]
    return op.corr_long(ready, names)


def category_correlation(ready: DataFrame) -> DataFrame:
    """Correlation of the category ranks, long form."""
    return op.corr_categorical(ready, CORRELATED_CATEGORIES)


def category_association(ready: DataFrame) -> DataFrame:
    """Cramér's V of the same categories."""
    return op.cramers_v(ready, CORRELATED_CATEGORIES)


def without_leaks(ready: DataFrame) -> DataFrame:
    """Without the columns that give the label away."""
    return op.drop_columns(ready, LEAKING)


def scaled(df: DataFrame) -> DataFrame:
    """Eight number columns scaled to [0, 1]."""
    return op.min_max(df, SCALED)


@dataclass(frozen=True)
class StatusModel:
    """A fitted forest with its scored test part."""

    forest: RandomForestClassificationModel
    features: op.Features
    predictions: DataFrame
    metrics: DataFrame
    importances: DataFrame
    skipped: DataFrame


def status_forest(
    ready: DataFrame,
    seed: int,
    keys: Sequence[str] | None = None,
    forest: tuple[int, int] = FOREST,
    fit_on: str = "train",
    number_invalid: str = "error",
) -> StatusModel:
    """Poverty status from scaled features, scored on a 20 percent part.

    ``fit_on="all"`` fits indices and scaler before the split, so that the test
    part leaks into them; ``"train"`` does not.  A NULL or NaN number fails the
    job, or with ``number_invalid="skip"`` its row is left out; ``skipped``
    counts such rows of the test part.
    """
    if fit_on not in ("train", "all"):
        raise ValueError("fit_on is 'train' or 'all'")
    columns = [*FEATURES, LABEL, *(keys or [])]
    narrow = ready.select(*dict.fromkeys(columns))
    train, test = (
        op.split_by_key(narrow, keys) if keys else op.split_random(narrow, seed=42)
    )
    features = op.fit_features(
        train if fit_on == "train" else narrow,
        [c for c in FEATURES if c not in NUMBERS],
        LABEL,
        numeric=NUMBERS,
        order=FEATURES,
        scale=True,
        number_invalid=number_invalid,
    )
    trees, depth = forest
    model = op.train_forest(
        op.apply_features(features, train), features, op.ForestParams(seed, trees, depth)
    )
    predictions = op.predict(model, features, test)
    return StatusModel(
        model,
        features,
        predictions,
        op.classification_metrics(predictions, features.label),
        op.importances(model, features),
        op.skipped_rows(features, test),
    )
