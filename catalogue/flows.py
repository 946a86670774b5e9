"""The two analyses over tables of their shape, and the first slice."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue.inputs import ARRESTS, DIRTY_CUSTOMER, POVERTY, arrests, dirty_customer, poverty
from catalogue.registry import query
from catalogue.statistics import (
    corr_categorical_sql,
    corr_sql,
    cramers_sql,
    index_sql,
    rounded,
    scaled_sql,
)
from tabkit import functions as fn
from tabkit import operators as op
from tabkit.plans import arrests as arrests_plan
from tabkit.plans import poverty as poverty_plan

_TOKENS = "('(No value)', 'UNKNOWN', '(null)')"


def _named(columns: tuple[str, ...]) -> str:
    return ", ".join(f"CASE WHEN {c} NOT IN {_TOKENS} THEN {c} END AS {c}" for c in columns)


def _filled(columns: tuple[str, ...], source: str) -> str:
    return ", ".join(
        f"coalesce({c}, (SELECT {c} FROM {source} WHERE {c} IS NOT NULL GROUP BY {c} "
        f"ORDER BY count(*) DESC, {c} LIMIT 1)) AS {c}"
        for c in columns
    )


@query(
    "segment_slice",
    f"""WITH t AS (SELECT c_custkey, {_named(('seg',))}, TRY_CAST(bal_text AS DOUBLE) AS x
        FROM ({DIRTY_CUSTOMER})),
      u AS (SELECT {_filled(('seg',), 't')}, x FROM t WHERE x >= 0 AND NOT isnan(x))
    SELECT seg, count(*) AS n, round(avg(x), 4) AS mean_balance FROM u GROUP BY seg
    ORDER BY n DESC, seg""",
)
def segment_slice(spark: SparkSession, d: str) -> DataFrame:
    named = op.null_tokens(dirty_customer(spark, d))
    filled = op.impute_modes(named, ["seg"])
    kept = op.filter_range(op.cast_columns(filled, {"bal_text": "double"}), "bal_text", low=0.0)
    return (
        kept.groupBy("seg")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("bal_text"), 4).alias("mean_balance"))
        .orderBy(F.desc("n"), "seg")
    )


_ARREST_TEXTS = (
    "LAW_CAT_CD",
    "PERP_RACE",
    "PD_DESC",
    "OFNS_DESC",
    "LAW_CODE",
    "KY_CD",
    "X_COORD_CD",
    "Y_COORD_CD",
    "Latitude",
    "Longitude",
    "JURISDICTION_CODE",
    "AGE_GROUP",
    "ARREST_DATE",
    "ARREST_BORO",
    "PERP_SEX",
)
_REST = ", ".join(c for c in _ARREST_TEXTS if c not in arrests_plan.IMPUTED)
_ARRESTS_CLEAN = f"""a0 AS ({ARRESTS}), a1 AS (SELECT ARREST_KEY, {_named(_ARREST_TEXTS)} FROM a0),
  a2 AS (SELECT ARREST_KEY, {_filled(arrests_plan.IMPUTED, 'a1')}, {_REST} FROM a1),
  clean AS (SELECT * FROM a2 WHERE PD_DESC IS NOT NULL AND KY_CD IS NOT NULL
    AND OFNS_DESC IS NOT NULL AND LAW_CODE IS NOT NULL)"""
_WEEKDAYS = ", ".join(f"'{n}'" for n in fn.WEEKDAYS_ES)
_ARRESTS_READY = f"""{_ARRESTS_CLEAN},
  d AS (SELECT * REPLACE (CAST(KY_CD AS INTEGER) AS KY_CD, CAST(X_COORD_CD AS DOUBLE) AS X_COORD_CD,
      CAST(Y_COORD_CD AS DOUBLE) AS Y_COORD_CD, CAST(Latitude AS DOUBLE) AS Latitude,
      CAST(Longitude AS DOUBLE) AS Longitude, CAST(JURISDICTION_CODE AS INTEGER) AS JURISDICTION_CODE),
    CAST(substring(ARREST_DATE, 4, 2) AS INTEGER) AS MONTH_ARREST,
    [{_WEEKDAYS}][isodow(strptime(ARREST_DATE, '%m/%d/%Y'))] AS DIA_SEMANA
    FROM clean WHERE AGE_GROUP <> '<18'),
  w AS ({index_sql('DIA_SEMANA', 'd')}),
  ready AS (SELECT d.*, w.i AS DIA_SEMANA_INDEX FROM d LEFT JOIN w ON DIA_SEMANA = v)"""


@query("arrests_clean", f"WITH {_ARRESTS_CLEAN} SELECT * FROM clean")
def arrests_clean(spark: SparkSession, d: str) -> DataFrame:
    return arrests_plan.clean(arrests(spark, d))


@query(
    "arrests_age_counts",
    f"WITH {_ARRESTS_CLEAN} SELECT AGE_GROUP, count(*) AS n FROM clean GROUP BY 1 ORDER BY n DESC, 1",
)
def arrests_age_counts(spark: SparkSession, d: str) -> DataFrame:
    return arrests_plan.age_counts(arrests_plan.clean(arrests(spark, d)))


@query("arrests_ready", f"WITH {_ARRESTS_READY} SELECT * FROM ready")
def arrests_ready(spark: SparkSession, d: str) -> DataFrame:
    return arrests_plan.prepared(arrests(spark, d))


_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in arrests_plan.CORRELATED)


@query(
    "arrests_correlation",
    f"WITH {_ARRESTS_READY}, whole AS (SELECT * FROM ready WHERE {_COMPLETE}) "
    f"{corr_sql(arrests_plan.CORRELATED, 'whole')}",
)
def arrests_correlation(spark: SparkSession, d: str) -> DataFrame:
    ready = arrests_plan.prepared(arrests(spark, d), columns=arrests_plan.CORRELATED)
    return rounded(arrests_plan.correlation(ready))


@query(
    "arrests_adult_age_counts",
    f"WITH {_ARRESTS_READY} SELECT AGE_GROUP, count(*) AS n FROM ready GROUP BY 1 ORDER BY n DESC, 1",
)
def arrests_adult_age_counts(spark: SparkSession, d: str) -> DataFrame:
    """Age groups after the minors are gone."""
    return arrests_plan.age_counts(arrests_plan.adults(arrests_plan.clean(arrests(spark, d))))


@query(
    "arrests_importance_sums",
    "SELECT num_trees, max_depth, CAST(6 AS BIGINT) AS n_features, 1.0::DOUBLE AS importances FROM (VALUES "
    + ", ".join(f"({n}, {k})" for n, k in arrests_plan.FORESTS)
    + ") AS f(num_trees, max_depth)",
)
def arrests_importance_sums(spark: SparkSession, d: str) -> DataFrame:
    """What must hold for the importances of any forest of the sweep."""
    needed = (*arrests_plan.CATEGORIES, arrests_plan.LABEL, "ARREST_KEY")
    ready = arrests_plan.prepared(arrests(spark, d), columns=needed)
    train, test = arrests_plan.split(ready, ["ARREST_KEY"])
    _, found = arrests_plan.severity_importances(train, test, seed=42)
    return found.groupBy("num_trees", "max_depth").agg(
        F.count(F.lit(1)).alias("n_features"), F.round(F.sum("importance"), 9).alias("importances")
    )


_AGREED = ", ".join(f"count(*) AS {c}" for c in ("n_rows", "n_votes", "n_predictions"))


@query(
    "arrests_severity_agreement",
    f"""WITH {_ARRESTS_READY} SELECT num_trees, max_depth, {_AGREED}, CAST(6 AS BIGINT) AS n_features,
      CAST(6 AS BIGINT) AS n_importances
    FROM ready, (VALUES {", ".join(f"({n}, {k})" for n, k in arrests_plan.FORESTS)}) AS f(num_trees, max_depth)
    WHERE CAST('0x' || substring(md5(ARREST_KEY), 1, 8) AS BIGINT) % 100 >= 80 GROUP BY num_trees, max_depth""",
)
def arrests_severity_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Votes, predictions and importances of the three forests, made again from their nodes."""
    needed = (*arrests_plan.CATEGORIES, arrests_plan.LABEL, "ARREST_KEY")
    ready = arrests_plan.prepared(arrests(spark, d), columns=needed)
    train, test = arrests_plan.split(ready, ["ARREST_KEY"])
    return arrests_plan.severity_agreement(train, test, ["ARREST_KEY"], seed=42)


@query("arrests_severity_sweep")
def arrests_severity_sweep(spark: SparkSession, d: str) -> DataFrame:
    ready = arrests_plan.prepared(arrests(spark, d))
    train, test = arrests_plan.split(ready, ["ARREST_KEY"])
    return arrests_plan.severity_sweep(train, test, seed=42)


_POVERTY_TEXTS = ("SCHL", "EducAttain", "LANX", "MSP")
_CASTS = ", ".join(
    f"CAST({c} AS {kind.replace('int', 'INTEGER').upper()}) AS {c}"
    for c, kind in poverty_plan.CASTS.items()
)
_POVERTY_CLEAN = f"""p0 AS ({POVERTY}),
  p1 AS (SELECT * EXCLUDE (JWTR, ENG, WKW) REPLACE ({_named(_POVERTY_TEXTS)}) FROM p0),
  clean AS (SELECT * EXCLUDE (SERIALNO, HHT) REPLACE ({_filled(poverty_plan.IMPUTED, 'p1')}) FROM p1)"""
_POVERTY_READY = f"""{_POVERTY_CLEAN},
  adults AS (SELECT * FROM (SELECT * REPLACE ({_CASTS}) FROM clean)
    WHERE AGEP >= 18 AND CAST(CitizenStatus AS INTEGER) IN (1, 2)),
  mar AS ({index_sql('MAR', 'adults')}),
  means AS (SELECT EducAttain AS e, avg(PreTaxIncome_PU) AS m FROM adults GROUP BY 1),
  ready AS (SELECT adults.*, mar.i AS MaritalStatusIndex,
    {scaled_sql('PreTaxIncome_PU', 'adults')} AS PreTaxIncome_PU_scaled,
    round(m, 6) AS AvgIncomeByEducation,
    round(PreTaxIncome_PU / m, 6) AS NormalizedIncomeByEducation
    FROM adults LEFT JOIN mar ON MAR = v LEFT JOIN means ON EducAttain = e)"""
_ROUNDED = ("PreTaxIncome_PU_scaled", "AvgIncomeByEducation", "NormalizedIncomeByEducation")


@query("poverty_clean", f"WITH {_POVERTY_CLEAN} SELECT * FROM clean")
def poverty_clean(spark: SparkSession, d: str) -> DataFrame:
    return poverty_plan.clean(poverty(spark, d))


@query("poverty_clean_by_profile", f"WITH {_POVERTY_CLEAN} SELECT * FROM clean")
def poverty_clean_by_profile(spark: SparkSession, d: str) -> DataFrame:
    return poverty_plan.clean(poverty(spark, d), max_missing_pct=50.0)


@query(
    "poverty_age_counts",
    f"WITH {_POVERTY_READY} SELECT AGEP, count(*) AS n FROM ready GROUP BY 1 ORDER BY 1",
)
def poverty_age_counts(spark: SparkSession, d: str) -> DataFrame:
    return poverty_plan.age_counts(poverty_plan.people(poverty(spark, d)))


_POVERTY_ALL = f"""{_POVERTY_CLEAN},
  everyone AS (SELECT * REPLACE ({_CASTS}) FROM clean)"""


@query(
    "poverty_adult_age_counts",
    f"WITH {_POVERTY_ALL} SELECT AGEP, count(*) AS n FROM everyone WHERE AGEP >= 18 GROUP BY 1 ORDER BY 1",
)
def poverty_adult_age_counts(spark: SparkSession, d: str) -> DataFrame:
    """All adults, before the citizens are chosen."""
    return poverty_plan.age_counts(poverty_plan.adults(poverty_plan.residents(poverty(spark, d))))


@query(
    "poverty_citizen_counts",
    f"""WITH {_POVERTY_ALL} SELECT CAST(CitizenStatus AS INTEGER) AS CitizenStatus, count(*) AS n
    FROM everyone WHERE AGEP >= 18 GROUP BY 1 ORDER BY 1""",
)
def poverty_citizen_counts(spark: SparkSession, d: str) -> DataFrame:
    adults = poverty_plan.adults(poverty_plan.residents(poverty(spark, d)))
    return poverty_plan.citizen_counts(adults)


@query("poverty_ready", f"WITH {_POVERTY_READY} SELECT * FROM ready")
def poverty_ready(spark: SparkSession, d: str) -> DataFrame:
    ready = poverty_plan.prepared(poverty(spark, d))
    return ready.withColumns({c: F.round(c, 6) for c in _ROUNDED})


_POVERTY_NUMBERS = (
    *poverty_plan.CASTS,
    "MaritalStatusIndex",
    "AvgIncomeByEducation",
    "NormalizedIncomeByEducation",
)


@query(
    "poverty_numeric_correlation",
    f"""WITH {_POVERTY_READY}, exact AS (SELECT ready.* REPLACE (m AS AvgIncomeByEducation,
      PreTaxIncome_PU / m AS NormalizedIncomeByEducation)
      FROM ready LEFT JOIN means ON EducAttain = e)
    SELECT col_a, col_b, CASE WHEN isnan(corr) THEN NULL ELSE corr END AS corr
    FROM ({corr_sql(_POVERTY_NUMBERS, 'exact')})""",
)
def poverty_numeric_correlation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(poverty_plan.numeric_correlation(poverty_plan.prepared(poverty(spark, d))))


@query(
    "poverty_category_correlation",
    f"WITH {_POVERTY_READY}, {corr_categorical_sql(poverty_plan.CORRELATED_CATEGORIES, 'ready')}",
)
def poverty_category_correlation(spark: SparkSession, d: str) -> DataFrame:
    ready = poverty_plan.people(poverty(spark, d))
    return rounded(poverty_plan.category_correlation(ready))


@query(
    "poverty_category_association",
    f"WITH {_POVERTY_READY} {cramers_sql(poverty_plan.CORRELATED_CATEGORIES, 'ready')}",
)
def poverty_category_association(spark: SparkSession, d: str) -> DataFrame:
    ready = poverty_plan.people(poverty(spark, d))
    return poverty_plan.category_association(ready).withColumn("v", F.round("v", 6))


@query(
    "poverty_scaled",
    f"WITH {_POVERTY_READY} SELECT PERSON_KEY, "
    + ", ".join(f"{scaled_sql(c, 'ready')} AS {c}_scaled" for c in poverty_plan.SCALED)
    + " FROM ready",
)
def poverty_scaled(spark: SparkSession, d: str) -> DataFrame:
    ready = poverty_plan.people(poverty(spark, d))
    scaled = poverty_plan.scaled(poverty_plan.without_leaks(ready))
    return scaled.select(
        "PERSON_KEY",
        *[F.round(f"{c}_scaled", 6).alias(f"{c}_scaled") for c in poverty_plan.SCALED],
    )


@query(
    "poverty_status_checks",
    f"""WITH {_POVERTY_READY} SELECT count(*) AS n_rows, count(*) AS n_sums_of_one, TRUE AS recall_is_accuracy,
      1.0::DOUBLE AS importances, CAST(0 AS BIGINT) AS n_skipped FROM ready
      WHERE CAST('0x' || substring(md5(PERSON_KEY), 1, 8) AS BIGINT) % 100 >= 80""",
)
def poverty_status_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold for the forest of 100 trees of depth 10, whatever it learns."""
    model = poverty_plan.status_forest(
        poverty_plan.people(poverty(spark, d)), seed=42, keys=["PERSON_KEY"]
    )
    sums = F.aggregate(vector_to_array("probability"), F.lit(0.0), lambda a, x: a + x)
    rows = model.predictions.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.abs(sums - 1) < 1e-9).alias("n_sums_of_one")
    )
    value = F.max(F.when(F.col("metric") == "accuracy", F.col("value")))
    recall = F.max(F.when(F.col("metric") == "weightedRecall", F.col("value")))
    agree = model.metrics.agg((F.abs(value - recall) < 1e-9).alias("recall_is_accuracy"))
    total = model.importances.agg(F.round(F.sum("importance"), 9).alias("importances"))
    skipped = model.skipped.select((F.col("n_bad_number") + F.col("n_bad_label")).alias("n_skipped"))
    return rows.select("n_rows", "n_sums_of_one", *[t.scalar().alias(t.columns[0]) for t in (agree, total, skipped)])


@query("poverty_status_forest")
def poverty_status_forest(spark: SparkSession, d: str) -> DataFrame:
    ready = poverty_plan.people(poverty(spark, d))
    return poverty_plan.status_forest(ready, seed=42, keys=["PERSON_KEY"]).metrics


@query(
    "poverty_status_agreement",
    f"""WITH {_POVERTY_READY} SELECT {_AGREED}, CAST({len(poverty_plan.FEATURES)} AS BIGINT) AS n_features,
      CAST({len(poverty_plan.FEATURES)} AS BIGINT) AS n_importances FROM ready
      WHERE CAST('0x' || substring(md5(PERSON_KEY), 1, 8) AS BIGINT) % 100 >= 80""",
)
def poverty_status_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Votes, predictions and importances of 100 trees of depth 10, made again from their nodes."""
    model = poverty_plan.status_forest(poverty_plan.people(poverty(spark, d)), seed=42, keys=["PERSON_KEY"])
    return op.agreement(model.forest, model.features, model.predictions, ["PERSON_KEY"], model.importances)
