"""Scans, projections, filters, groups, joins, dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue.inputs import (
    DIRTY_CUSTOMER,
    DIRTY_PART,
    ORDER_DATES,
    dirty_customer,
    dirty_part,
    order_dates,
)
from catalogue.registry import query
from tabkit import functions as fn
from tabkit import operators as op
from tabkit.sources import preview, read_csv_text, read_table, shared_path

_CUSTOMER_COLUMNS = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query(
    "csv_scan",
    f"SELECT {', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in _CUSTOMER_COLUMNS)} FROM customer",
)
def csv_scan(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "csv_scan")
    read_table(spark, d, "customer").select(*_CUSTOMER_COLUMNS).write.csv(path, header=True)
    return read_csv_text(spark, path, _CUSTOMER_COLUMNS)


@query(
    "csv_scan_header",
    "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, count(*) AS n "
    "FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2",
)
def csv_scan_header(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "csv_scan_header")
    customer = read_table(spark, d, "customer").select("c_nationkey")
    nation = read_table(spark, d, "nation").select("n_nationkey", "n_name")
    named = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    named.select("n_nationkey", "n_name").write.csv(path, header=True)
    return op.group_count(read_csv_text(spark, path), ["n_nationkey", "n_name"])


@query(
    "project_columns",
    "SELECT p_partkey AS id, p_brand AS brand, p_retailprice AS price FROM part",
)
def project_columns(spark: SparkSession, d: str) -> DataFrame:
    columns = {"p_partkey": "id", "p_brand": "brand", "p_retailprice": "price"}
    return op.project(read_table(spark, d, "part"), columns)


_AGE_INT = (
    "TRY_CAST(CASE WHEN regexp_matches(age_text, '^[+-]?[0-9]+[.][0-9]*$') "
    "THEN split_part(age_text, '.', 1) ELSE age_text END AS INTEGER)"
)


@query(
    "cast_columns",
    f"""WITH t AS ({DIRTY_CUSTOMER})
    SELECT c_custkey, {_AGE_INT} AS age_text, {_AGE_INT} AS age_copy,
      CASE WHEN isnan(TRY_CAST(bal_text AS DOUBLE)) THEN NULL
           ELSE TRY_CAST(bal_text AS DOUBLE) END AS bal_text
    FROM t""",
)
def cast_columns(spark: SparkSession, d: str) -> DataFrame:
    casts = {"age_text": "int", "age_copy": ("age_text", "int"), "bal_text": "double"}
    cast = op.cast_columns(dirty_customer(spark, d), casts)
    return cast.select("c_custkey", "age_text", "age_copy", "bal_text")


@query(
    "drop_columns",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, "
    "l_discount, l_shipdate FROM lineitem",
)
def drop_columns(spark: SparkSession, d: str) -> DataFrame:
    lineitem = read_table(spark, d, "lineitem")
    present = op.drop_columns(lineitem, ["l_returnflag", "l_linestatus", "l_tax"])
    return op.drop_columns(present, ["no_such_column"], strict=False)


@query("numeric_columns", "SELECT p_size, p_retailprice FROM part")
def numeric_columns(spark: SparkSession, d: str) -> DataFrame:
    part = read_table(spark, d, "part")
    return op.project(part, op.columns_of_type(part, op.INT_AND_DOUBLE))


@query("numeric_columns_all", "SELECT p_partkey, p_size, p_retailprice FROM part")
def numeric_columns_all(spark: SparkSession, d: str) -> DataFrame:
    part = read_table(spark, d, "part")
    return op.project(part, op.columns_of_type(part))


@query("preview_topn", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def preview_topn(spark: SparkSession, d: str) -> DataFrame:
    return preview(read_table(spark, d, "orders"), [F.desc("o_totalprice"), "o_orderkey"], 20)


@query(
    "filter_range",
    f"""WITH t AS ({DIRTY_CUSTOMER}) SELECT c_custkey, age_text FROM t
    WHERE {_AGE_INT} BETWEEN 18 AND 90""",
)
def filter_range(spark: SparkSession, d: str) -> DataFrame:
    kept = op.filter_range(dirty_customer(spark, d), "age_text", 18, 90, kind="int")
    return kept.select("c_custkey", "age_text")


@query("filter_range_typed", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 18")
def filter_range_typed(spark: SparkSession, d: str) -> DataFrame:
    kept = op.filter_range(read_table(spark, d, "lineitem"), "l_quantity", low=18.0)
    return kept.select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "filter_in",
    "SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS nation FROM customer WHERE c_nationkey IN (1, 2)",
)
def filter_in(spark: SparkSession, d: str) -> DataFrame:
    text = read_table(spark, d, "customer").select(
        "c_custkey", F.col("c_nationkey").cast("string").alias("nation")
    )
    return op.filter_in(text, "nation", [1, 2], kind="int")


@query(
    "filter_ne",
    f"WITH t AS ({DIRTY_CUSTOMER}) SELECT c_custkey, seg FROM t WHERE seg <> 'UNKNOWN'",
)
def filter_ne(spark: SparkSession, d: str) -> DataFrame:
    return op.filter_ne(dirty_customer(spark, d), "seg", "UNKNOWN").select("c_custkey", "seg")


@query(
    "filter_ne_keep_null",
    f"WITH t AS ({DIRTY_CUSTOMER}) SELECT c_custkey, seg FROM t WHERE seg IS DISTINCT FROM 'UNKNOWN'",
)
def filter_ne_keep_null(spark: SparkSession, d: str) -> DataFrame:
    kept = op.filter_ne(dirty_customer(spark, d), "seg", "UNKNOWN", keep_null=True)
    return kept.select("c_custkey", "seg")


@query("row_count", "SELECT count(*) AS n FROM lineitem")
def row_count(spark: SparkSession, d: str) -> DataFrame:
    return op.row_count(read_table(spark, d, "lineitem"))


@query("group_count", f"WITH t AS ({DIRTY_CUSTOMER}) SELECT seg, count(*) AS n FROM t GROUP BY seg")
def group_count(spark: SparkSession, d: str) -> DataFrame:
    return op.group_count(dirty_customer(spark, d), ["seg"])


@query(
    "group_count_ranked",
    "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1",
)
def group_count_ranked(spark: SparkSession, d: str) -> DataFrame:
    return op.group_count_ranked(read_table(spark, d, "orders"), ["o_orderpriority"])


@query(
    "histogram_by_key",
    f"WITH t AS ({DIRTY_CUSTOMER}) SELECT {_AGE_INT} AS age_text, count(*) AS n FROM t GROUP BY 1 ORDER BY 1",
)
def histogram_by_key(spark: SparkSession, d: str) -> DataFrame:
    return op.histogram(dirty_customer(spark, d), "age_text")


@query(
    "group_mean",
    f"""WITH t AS ({DIRTY_CUSTOMER}), u AS (SELECT seg, TRY_CAST(bal_text AS DOUBLE) AS x FROM t)
    SELECT seg, round(avg(CASE WHEN NOT isnan(x) THEN x END), 6) AS mean FROM u GROUP BY seg""",
)
def group_mean(spark: SparkSession, d: str) -> DataFrame:
    means = op.group_mean(dirty_customer(spark, d), ["seg"], "bal_text")
    return means.select("seg", F.round("mean", 6).alias("mean"))


@query(
    "left_join_group_mean",
    """WITH g AS (SELECT l_suppkey, avg(l_extendedprice) AS m FROM lineitem GROUP BY l_suppkey)
    SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice, round(m, 4) AS group_mean
    FROM lineitem LEFT JOIN g USING (l_suppkey)""",
)
def left_join_group_mean(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"
    )
    joined = op.join_group_mean(rows, ["l_suppkey"], "l_extendedprice")
    return joined.withColumn("group_mean", F.round("group_mean", 4))


_RATIO = f"""WITH t AS ({DIRTY_PART}),
    g AS (SELECT kind, avg(p_retailprice) AS m FROM t GROUP BY kind)
    SELECT p_partkey, t.kind AS kind, round(m, 6) AS group_mean,
      round(p_retailprice / m, 6) AS ratio
    FROM t LEFT JOIN g ON {{on}}"""


def _ratio(spark: SparkSession, d: str, null_key: str) -> DataFrame:
    out = op.group_mean_ratio(dirty_part(spark, d), ["kind"], "p_retailprice", null_key=null_key)
    return out.select(
        "p_partkey",
        "kind",
        F.round("group_mean", 6).alias("group_mean"),
        F.round("ratio", 6).alias("ratio"),
    )


@query("group_mean_ratio", _RATIO.format(on="t.kind = g.kind"))
def group_mean_ratio(spark: SparkSession, d: str) -> DataFrame:
    return _ratio(spark, d, "null")


@query("group_mean_ratio_null_group", _RATIO.format(on="t.kind IS NOT DISTINCT FROM g.kind"))
def group_mean_ratio_null_group(spark: SparkSession, d: str) -> DataFrame:
    return _ratio(spark, d, "group")


@query(
    "date_field_by_position",
    f"""WITH t AS ({ORDER_DATES})
    SELECT o_orderkey, TRY_CAST(substring(date_txt, 4, 2) AS INTEGER) AS field FROM t""",
)
def date_field_by_position(spark: SparkSession, d: str) -> DataFrame:
    return order_dates(spark, d).select(
        "o_orderkey", fn.date_field_by_position(F.col("date_txt")).alias("field")
    )


@query(
    "month_of_date",
    f"""WITH t AS ({ORDER_DATES})
    SELECT o_orderkey, CAST(month(try_strptime(date_txt, '%m/%d/%Y')) AS INTEGER) AS month FROM t""",
)
def month_of_date(spark: SparkSession, d: str) -> DataFrame:
    return order_dates(spark, d).select(
        "o_orderkey", fn.month_of_date(F.col("date_txt")).alias("month")
    )


_WEEKDAYS = ", ".join(f"'{n}'" for n in fn.WEEKDAYS_ES)


@query(
    "weekday_name",
    f"""WITH t AS ({ORDER_DATES})
    SELECT o_orderkey, [{_WEEKDAYS}][isodow(try_strptime(date_txt, '%m/%d/%Y'))] AS weekday FROM t""",
)
def weekday_name(spark: SparkSession, d: str) -> DataFrame:
    return order_dates(spark, d).select(
        "o_orderkey", fn.weekday_name(F.col("date_txt")).alias("weekday")
    )


@query(
    "time_bucket_count",
    "SELECT date_trunc('hour', ts) AS bucket, count(*) AS n FROM events GROUP BY 1 ORDER BY 1",
)
def time_bucket_count(spark: SparkSession, d: str) -> DataFrame:
    return op.time_bucket_count(read_table(spark, d, "events"), "ts", "hour")


@query(
    "top_k_categories",
    "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3",
)
def top_k_categories(spark: SparkSession, d: str) -> DataFrame:
    return op.top_k(read_table(spark, d, "events"), ["event_type"], 3)
