"""Indices, scaling, correlation, splits, metrics."""

from __future__ import annotations

from itertools import combinations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue.inputs import DIRTY_CUSTOMER, DIRTY_PART, dirty_customer, dirty_part
from catalogue.registry import query
from tabkit import operators as op
from tabkit.sources import matrix_frame, read_table


def index_sql(column: str, source: str) -> str:
    """(v, i): the text of a category and its index."""
    return (
        f"SELECT CAST({column} AS VARCHAR) AS v, CAST(row_number() OVER (ORDER BY count(*) DESC, "
        f"CAST({column} AS VARCHAR)) - 1 AS DOUBLE) AS i FROM {source} "
        f"WHERE {column} IS NOT NULL GROUP BY {column}"
    )


@query(
    "string_index",
    f"WITH x AS ({index_sql('p_type', 'part')}) SELECT p_partkey, p_type, i AS p_type_index "
    "FROM part LEFT JOIN x ON p_type = v",
)
def string_index(spark: SparkSession, d: str) -> DataFrame:
    part = read_table(spark, d, "part").select("p_partkey", "p_type")
    return op.index_labels(part, ["p_type"])


@query(
    "string_index_multi",
    f"""WITH t AS ({DIRTY_PART}), a AS ({index_sql('kind', 't')}), b AS ({index_sql('brand', 't')})
    SELECT p_partkey, coalesce(a.i, (SELECT count(*) FROM a)) AS kind_index,
      coalesce(b.i, (SELECT count(*) FROM b)) AS brand_index
    FROM t LEFT JOIN a ON kind = a.v LEFT JOIN b ON brand = b.v""",
)
def string_index_multi(spark: SparkSession, d: str) -> DataFrame:
    indexed = op.index_labels(dirty_part(spark, d), ["kind", "brand"], null="keep")
    return indexed.select("p_partkey", "kind_index", "brand_index")


@query(
    "string_index_numeric",
    f"""WITH x AS ({index_sql('l_quantity', 'lineitem')})
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, i AS l_quantity_index
    FROM lineitem LEFT JOIN x ON CAST(l_quantity AS VARCHAR) = v""",
)
def string_index_numeric(spark: SparkSession, d: str) -> DataFrame:
    lines = read_table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"
    )
    return op.index_labels(lines, ["l_quantity"])


@query(
    "assemble_vector",
    f"""WITH t AS ({DIRTY_CUSTOMER}) SELECT c_custkey, bal AS feature_0,
    CAST(c_nationkey AS DOUBLE) AS feature_1 FROM t WHERE bal IS NOT NULL AND NOT isnan(bal)""",
)
def assemble_vector(spark: SparkSession, d: str) -> DataFrame:
    packed = op.assemble(dirty_customer(spark, d), ["bal", "c_nationkey"])
    values = vector_to_array("features")
    return packed.select("c_custkey", values[0].alias("feature_0"), values[1].alias("feature_1"))


@query(
    "assembly_report",
    f"""WITH t AS ({DIRTY_CUSTOMER}) SELECT count(*) AS n_rows,
    count(*) FILTER (WHERE bal IS NULL OR isnan(bal)) AS n_skipped FROM t""",
)
def assembly_report(spark: SparkSession, d: str) -> DataFrame:
    return op.assembly_report(dirty_customer(spark, d), ["bal", "c_nationkey"])


def scaled_sql(column: str, source: str) -> str:
    low, high = (f"(SELECT {f}({column}) FROM {source})" for f in ("min", "max"))
    return (
        f"CASE WHEN {column} IS NULL THEN NULL WHEN {low} = {high} THEN 0.5::DOUBLE "
        f"ELSE round(({column} - {low}) / ({high} - {low}), 6)::DOUBLE END"
    )


@query(
    "min_max_single",
    f"SELECT p_partkey, {scaled_sql('p_retailprice', 'part')} AS p_retailprice_scaled FROM part",
)
def min_max_single(spark: SparkSession, d: str) -> DataFrame:
    scaled = op.min_max(read_table(spark, d, "part"), ["p_retailprice"])
    return scaled.select("p_partkey", F.round("p_retailprice_scaled", 6).alias("p_retailprice_scaled"))


_SCALED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "min_max_multi",
    "SELECT l_orderkey, l_linenumber, l_partkey, "
    + ", ".join(f"{scaled_sql(c, 'lineitem')} AS {c}_scaled" for c in _SCALED)
    + " FROM lineitem",
)
def min_max_multi(spark: SparkSession, d: str) -> DataFrame:
    scaled = op.min_max(read_table(spark, d, "lineitem"), _SCALED)
    return scaled.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        *[F.round(f"{c}_scaled", 6).alias(f"{c}_scaled") for c in _SCALED],
    )


_ML_SCALED = ("p_retailprice", "p_size")


@query(
    "min_max_vector",
    "SELECT p_partkey, "
    + ", ".join(f"{scaled_sql(c, 'part')} AS scaled_{i}" for i, c in enumerate(_ML_SCALED))
    + " FROM part",
)
def min_max_vector(spark: SparkSession, d: str) -> DataFrame:
    scaled = op.min_max_vector(read_table(spark, d, "part"), _ML_SCALED)
    values = vector_to_array("scaled_features")
    return scaled.select(
        "p_partkey",
        *[F.round(values[i], 6).alias(f"scaled_{i}") for i in range(len(_ML_SCALED))],
    )


def corr_sql(columns: tuple[str, ...], source: str, digits: int = 6) -> str:
    """Ordered pairs over ``source``, as UNION ALL."""
    return " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, "
        f"round(corr({a}::DOUBLE, {b}::DOUBLE), {digits})::DOUBLE AS corr FROM {source}"
        for a in columns
        for b in columns
    )


def rounded(long: DataFrame, digits: int = 6) -> DataFrame:
    return long.withColumn("corr", F.round("corr", digits))


_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")


@query("corr_long", corr_sql(_NUMBERS, "lineitem"))
def corr_long(spark: SparkSession, d: str) -> DataFrame:
    return rounded(op.corr_long(read_table(spark, d, "lineitem"), _NUMBERS))


_MANY = (
    "l_orderkey",
    "l_partkey",
    "l_suppkey",
    "l_linenumber",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "day",
    "net",
)
_MANY_SQL = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
    l_discount, l_tax, CAST(day(l_shipdate) AS INTEGER) AS day,
    l_extendedprice * (1 - l_discount) AS net FROM lineitem"""


@query("corr_long_many_columns", f"WITH t AS ({_MANY_SQL}) {corr_sql(_MANY, 't')}")
def corr_long_many_columns(spark: SparkSession, d: str) -> DataFrame:
    lines = read_table(spark, d, "lineitem").withColumns(
        {
            "day": F.dayofmonth("l_shipdate"),
            "net": F.expr("l_extendedprice * (1 - l_discount)"),
        }
    )
    return rounded(op.corr_long(lines, _MANY))


@query(
    "corr_wide",
    " UNION ALL ".join(
        f"SELECT '{a}' AS \"column\", "
        + ", ".join(f"round(corr({a}::DOUBLE, {b}::DOUBLE), 6)::DOUBLE AS {b}" for b in _NUMBERS)
        + " FROM lineitem"
        for a in _NUMBERS
    ),
)
def corr_wide(spark: SparkSession, d: str) -> DataFrame:
    long = op.corr_long(read_table(spark, d, "lineitem"), _NUMBERS)
    return op.corr_wide(rounded(long), _NUMBERS)


_CATEGORIES = ("l_returnflag", "l_linestatus", "l_linenumber")


def corr_categorical_sql(columns: tuple[str, ...], source: str) -> str:
    """Index every column of ``source`` and correlate; a list of CTEs and a body."""
    ctes = ", ".join(f"x_{c} AS ({index_sql(c, source)})" for c in columns)
    joins = " ".join(f"JOIN x_{c} ON CAST({c} AS VARCHAR) = x_{c}.v" for c in columns)
    picks = ", ".join(f"x_{c}.i AS {c}" for c in columns)
    return f"{ctes}, indexed AS (SELECT {picks} FROM (SELECT {', '.join(columns)} FROM {source}) AS s {joins}) {corr_sql(columns, 'indexed')}"


@query("corr_categorical", f"WITH {corr_categorical_sql(_CATEGORIES, 'lineitem')}")
def corr_categorical(spark: SparkSession, d: str) -> DataFrame:
    return rounded(op.corr_categorical(read_table(spark, d, "lineitem"), _CATEGORIES))


def cramers_sql(columns: tuple[str, ...], source: str) -> str:
    lines = []
    for a, b in combinations(columns, 2):
        lines.append(
            f"""SELECT '{a}' AS col_a, '{b}' AS col_b, (
            WITH c AS (SELECT {a} AS a, {b} AS b, count(*)::DOUBLE AS n FROM {source}
                       WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL),
              m AS (SELECT a, b, n, sum(n) OVER (PARTITION BY a) AS na,
                    sum(n) OVER (PARTITION BY b) AS nb FROM c)
            SELECT CASE WHEN least(count(DISTINCT a), count(DISTINCT b)) > 1 THEN
              round(sqrt(greatest(0, sum(n * n / (na * nb)) - 1)
                / (least(count(DISTINCT a), count(DISTINCT b)) - 1)), 6) END FROM m)::DOUBLE AS v"""
        )
    return " UNION ALL ".join(lines)


_ASSOCIATED = ("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity")


@query("cramers_v", cramers_sql(_ASSOCIATED, "lineitem"))
def cramers_v(spark: SparkSession, d: str) -> DataFrame:
    lines = op.cramers_v(read_table(spark, d, "lineitem"), _ASSOCIATED)
    return lines.withColumn("v", F.round("v", 6))


@query(
    "split_by_key_hash",
    """SELECT o_orderkey, CASE WHEN CAST('0x' || substring(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT)
    % 100 < 80 THEN 'train' ELSE 'test' END AS part FROM orders""",
)
def split_by_key_hash(spark: SparkSession, d: str) -> DataFrame:
    return op.with_part(read_table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])


@query(
    "split_random",
    """SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_in_both, CAST(0 AS BIGINT) AS n_in_none,
    TRUE AS share_near_80 FROM orders""",
)
def split_random(spark: SparkSession, d: str) -> DataFrame:
    """What must hold for any random split: disjoint, complete, about 80 to 20."""
    orders = read_table(spark, d, "orders").select("o_orderkey")
    train, test = op.split_random(orders)
    marks = [
        part.select("o_orderkey", F.lit(a).alias("train"), F.lit(b).alias("test"))
        for part, a, b in ((orders, 0, 0), (train, 1, 0), (test, 0, 1))
    ]
    seen = (
        marks[0]
        .unionByName(marks[1])
        .unionByName(marks[2])
        .groupBy("o_orderkey")
        .agg(F.sum("train").alias("train"), F.sum("test").alias("test"))
    )
    return seen.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if((F.col("train") > 0) & (F.col("test") > 0)).alias("n_in_both"),
        F.count_if((F.col("train") == 0) & (F.col("test") == 0)).alias("n_in_none"),
        # Within five standard deviations of 80 percent.
        ((F.avg("train") - 0.8) * (F.avg("train") - 0.8) * F.count(F.lit(1)) <= 25 * 0.16).alias(
            "share_near_80"
        ),
    )


_RULE = """CASE WHEN o_totalprice > 300000 THEN 'F' WHEN o_totalprice > 150000 THEN 'O'
  ELSE 'X' END AS prediction"""
_CONFUSION = f"""t AS (SELECT o_orderstatus AS label, {_RULE} FROM orders),
    c AS (SELECT l.label AS k,
      (SELECT count(*) FROM t WHERE t.label = l.label)::DOUBLE AS actual,
      (SELECT count(*) FROM t WHERE t.prediction = l.label)::DOUBLE AS predicted,
      (SELECT count(*) FROM t WHERE t.label = l.label AND t.prediction = l.label)::DOUBLE AS hit
      FROM (SELECT DISTINCT label FROM t) AS l),
    m AS (SELECT actual, hit, CASE WHEN predicted = 0 THEN 0 ELSE hit / predicted END AS p,
      hit / actual AS r FROM c)"""


@query(
    "classification_metrics",
    f"""WITH {_CONFUSION}, v AS (SELECT sum(hit) / sum(actual) AS accuracy,
      sum(p * actual) / sum(actual) AS wp, sum(r * actual) / sum(actual) AS wr,
      sum(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END * actual) / sum(actual) AS f1 FROM m)
    SELECT 'accuracy' AS metric, round(accuracy, 6) AS "value" FROM v
    UNION ALL SELECT 'weightedPrecision', round(wp, 6) FROM v
    UNION ALL SELECT 'weightedRecall', round(wr, 6) FROM v
    UNION ALL SELECT 'f1', round(f1, 6) FROM v""",
)
def classification_metrics(spark: SparkSession, d: str) -> DataFrame:
    judged = read_table(spark, d, "orders").selectExpr("o_orderstatus AS label", _RULE)
    return op.classification_metrics(judged).withColumn("value", F.round("value", 6))


@query(
    "classification_metrics_numeric",
    """WITH t AS (SELECT l_linenumber AS label, CAST(l_quantity AS INTEGER) % 7 + 1 AS prediction FROM lineitem),
    c AS (SELECT l.label AS k,
      (SELECT count(*) FROM t WHERE t.label = l.label)::DOUBLE AS actual,
      (SELECT count(*) FROM t WHERE t.prediction = l.label)::DOUBLE AS predicted,
      (SELECT count(*) FROM t WHERE t.label = l.label AND t.prediction = l.label)::DOUBLE AS hit
      FROM (SELECT DISTINCT label FROM t) AS l),
    m AS (SELECT actual, hit, CASE WHEN predicted = 0 THEN 0 ELSE hit / predicted END AS p,
      hit / actual AS r FROM c),
    v AS (SELECT sum(hit) / sum(actual) AS accuracy,
      sum(p * actual) / sum(actual) AS wp, sum(r * actual) / sum(actual) AS wr,
      sum(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END * actual) / sum(actual) AS f1 FROM m)
    SELECT 'accuracy' AS metric, round(accuracy, 6) AS "value" FROM v
    UNION ALL SELECT 'weightedPrecision', round(wp, 6) FROM v
    UNION ALL SELECT 'weightedRecall', round(wr, 6) FROM v
    UNION ALL SELECT 'f1', round(f1, 6) FROM v""",
)
def classification_metrics_numeric(spark: SparkSession, d: str) -> DataFrame:
    """Whole numbers judged against doubles."""
    judged = read_table(spark, d, "lineitem").selectExpr(
        "cast(l_linenumber as int) AS label", "cast(cast(l_quantity as int) % 7 + 1 AS double) AS prediction"
    )
    return op.classification_metrics(judged).withColumn("value", F.round("value", 6))


@query(
    "corr_matrix_frame",
    " UNION ALL ".join(
        "SELECT " + ", ".join(f"round(corr({a}::DOUBLE, {b}::DOUBLE), 6)::DOUBLE AS {b}" for b in _NUMBERS)
        + " FROM lineitem"
        for a in _NUMBERS
    ),
)
def corr_matrix_frame(spark: SparkSession, d: str) -> DataFrame:
    """The matrix as the driver holds it, as a frame again."""
    long = rounded(op.corr_long(read_table(spark, d, "lineitem"), _NUMBERS))
    cells = {(r["col_a"], r["col_b"]): r["corr"] for r in long.collect()}
    matrix = [[float("nan") if cells[a, b] is None else cells[a, b] for b in _NUMBERS] for a in _NUMBERS]
    return matrix_frame(spark, matrix, _NUMBERS)


@query(
    "confusion_counts",
    f"""WITH t AS (SELECT o_orderstatus AS label, {_RULE} FROM orders)
    SELECT label, prediction, count(*) AS n FROM t GROUP BY ALL""",
)
def confusion_counts(spark: SparkSession, d: str) -> DataFrame:
    judged = read_table(spark, d, "orders").selectExpr("o_orderstatus AS label", _RULE)
    return op.confusion_counts(judged)
