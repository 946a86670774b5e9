"""Random forests.

SQL has no twin for a forest on real labels, so those queries carry none.  The
``_rule`` queries train on orders whose label follows from one feature; a forest
that works must find the rule, and then SQL knows every answer.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue.inputs import labelled_documents
from catalogue.registry import query
from tabkit import operators as op
from tabkit.sources import read_table

_SEED = 42
_CATEGORIES = ("lang", "source")


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return op.split_by_key(labelled_documents(spark, d), ["doc_id"])


def _features(train: DataFrame, scale: bool) -> op.Features:
    return op.fit_features(train, _CATEGORIES, "quality", numeric=["n_chars"], scale=scale)


def _predicted(spark: SparkSession, d: str, params: op.ForestParams, scale: bool) -> DataFrame:
    train, test = _parts(spark, d)
    features = _features(train, scale)
    model = op.train_forest(op.apply_features(features, train), features, params)
    out = op.predict(model, features, test)
    return out.select(
        "doc_id",
        "label",
        "prediction",
        F.round(vector_to_array("probability")[0], 6).alias("probability_0"),
        F.round(vector_to_array("rawPrediction")[0], 6).alias("raw_0"),
    )


_DOC_TEST = """doc_id IN (SELECT doc_id FROM documents JOIN labels USING (doc_id)
    WHERE CAST('0x' || substring(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 >= 80)"""


@query("rf_predict")
def rf_predict(spark: SparkSession, d: str) -> DataFrame:
    return _predicted(spark, d, op.ForestParams(_SEED, 10), scale=False)


@query("rf_predict_scaled")
def rf_predict_scaled(spark: SparkSession, d: str) -> DataFrame:
    return _predicted(spark, d, op.ForestParams(_SEED, 100, 10), scale=True)


@query(
    "rf_nodes_agreement",
    f"""SELECT count(*) AS n_rows, count(*) AS n_votes, count(*) AS n_predictions, CAST(3 AS BIGINT) AS n_features,
    CAST(3 AS BIGINT) AS n_importances FROM documents JOIN labels USING (doc_id) WHERE {_DOC_TEST}""",
)
def rf_nodes_agreement(spark: SparkSession, d: str) -> DataFrame:
    """The forest of 100 trees of depth 10, walked in SQL from its table of nodes."""
    train, test = _parts(spark, d)
    features = _features(train, scale=True)
    ready = op.apply_features(features, train)
    model = op.train_forest(ready, features, op.ForestParams(_SEED, 100, 10))
    scored = op.predict(model, features, test)
    return op.agreement(model, features, scored, ["doc_id"], op.importances(model, features))


@query("rf_importance")
def rf_importance(spark: SparkSession, d: str) -> DataFrame:
    train, _ = _parts(spark, d)
    features = _features(train, scale=False)
    ready = op.apply_features(features, train)
    model = op.train_forest(ready, features, op.ForestParams(_SEED, 20))
    return op.importances(model, features)


@query("rf_sweep")
def rf_sweep(spark: SparkSession, d: str) -> DataFrame:
    train, test = _parts(spark, d)
    params = [
        op.ForestParams(_SEED, 10),
        op.ForestParams(_SEED, 50),
        op.ForestParams(_SEED, 20, 20),
    ]
    return op.sweep(train, test, _features(train, scale=False), params)


@query(
    "rf_class_count",
    f"""SELECT count(*) AS n_rows, (SELECT count(DISTINCT quality) FROM labels) AS n_classes,
    count(*) AS n_sums_of_one FROM documents JOIN labels USING (doc_id) WHERE {_DOC_TEST}""",
)
def rf_class_count(spark: SparkSession, d: str) -> DataFrame:
    """One probability per label, no class beside them; they sum to one in every row."""
    train, test = _parts(spark, d)
    features = _features(train, scale=True)
    model = op.train_forest(op.apply_features(features, train), features, op.ForestParams(_SEED, 10))
    chances = vector_to_array("probability")
    sums = F.aggregate(chances, F.lit(0.0), lambda a, x: a + x)
    return op.predict(model, features, test).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max(F.size(chances)).cast("bigint").alias("n_classes"),
        F.count_if(F.abs(sums - 1) < 1e-9).alias("n_sums_of_one"),
    )


@query(
    "rf_skipped_rows",
    """SELECT count(*) AS n_rows, count(*) FILTER (WHERE o_orderkey % 5 = 0) AS n_bad_number,
    count(*) FILTER (WHERE o_orderkey % 7 = 0) AS n_bad_label FROM orders""",
)
def rf_skipped_rows(spark: SparkSession, d: str) -> DataFrame:
    """What a forest leaves out when it is told to, counted."""
    orders = read_table(spark, d, "orders").selectExpr(
        "o_orderpriority",
        "CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END AS price",
        "CASE WHEN o_orderkey % 7 > 0 THEN o_orderstatus END AS status",
    )
    features = op.fit_features(
        orders, ["o_orderpriority"], "status", numeric=["price"], number_invalid="skip", label_invalid="skip"
    )
    return op.skipped_rows(features, orders)


# The order state decides nothing, the priority everything.
_RULE = "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'fast' ELSE 'slow' END AS speed"
_RULE_FEATURES = ("o_orderstatus", "o_orderpriority")
_RULE_FORESTS = ((10, 5), (50, 5), (20, 20))
_TRAIN = (
    "CAST('0x' || substring(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 80 AS train"
)
_RULE_SQL = f"""WITH t AS (SELECT o_orderkey, {_RULE}, {_TRAIN} FROM orders),
    x AS (SELECT speed, CAST(row_number() OVER (ORDER BY count(*) DESC, speed) - 1 AS DOUBLE) AS i
      FROM t WHERE train GROUP BY speed)
    SELECT o_orderkey, i AS label, i AS prediction FROM t JOIN x USING (speed) WHERE NOT train"""


def _rule_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    orders = read_table(spark, d, "orders").selectExpr("o_orderkey", *_RULE_FEATURES, _RULE)
    return op.split_by_key(orders, ["o_orderkey"])


def _rule_predicted(spark: SparkSession, d: str, scale: bool) -> DataFrame:
    train, test = _rule_parts(spark, d)
    features = op.fit_features(train, _RULE_FEATURES, "speed", scale=scale)
    model = op.train_forest(op.apply_features(features, train), features, op.ForestParams(_SEED, 10))
    return op.predict(model, features, test).select("o_orderkey", "label", "prediction")


@query("rf_predict_rule", _RULE_SQL)
def rf_predict_rule(spark: SparkSession, d: str) -> DataFrame:
    return _rule_predicted(spark, d, scale=False)


@query("rf_predict_scaled_rule", _RULE_SQL)
def rf_predict_scaled_rule(spark: SparkSession, d: str) -> DataFrame:
    return _rule_predicted(spark, d, scale=True)


@query(
    "rf_importance_rule",
    """SELECT 'o_orderpriority_index' AS feature, 1.0::DOUBLE AS importance
    UNION ALL SELECT 'o_orderstatus_index', 0.0::DOUBLE""",
)
def rf_importance_rule(spark: SparkSession, d: str) -> DataFrame:
    train, _ = _rule_parts(spark, d)
    features = op.fit_features(train, _RULE_FEATURES, "speed")
    model = op.train_forest(op.apply_features(features, train), features, op.ForestParams(_SEED, 10))
    return op.importances(model, features)


@query(
    "rf_sweep_rule",
    "SELECT num_trees, max_depth, metric, 1.0::DOUBLE AS \"value\" FROM (VALUES "
    + ", ".join(f"({n}, {k})" for n, k in _RULE_FORESTS)
    + ") AS f(num_trees, max_depth), (VALUES ('accuracy'), ('weightedPrecision'), "
    "('weightedRecall'), ('f1')) AS m(metric)",
)
def rf_sweep_rule(spark: SparkSession, d: str) -> DataFrame:
    train, test = _rule_parts(spark, d)
    params = [op.ForestParams(_SEED, n, k) for n, k in _RULE_FORESTS]
    features = op.fit_features(train, _RULE_FEATURES, "speed")
    table = op.sweep(train, test, features, params)
    return table.withColumn("value", F.round("value", 9))
