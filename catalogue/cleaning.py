"""Missing values: naming, counting, filling, dropping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue.inputs import DIRTY_CUSTOMER, DIRTY_PART, dirty_customer, dirty_part
from catalogue.registry import query
from tabkit import operators as op
from tabkit.sources import read_table

_TOKENS = "('(No value)', 'UNKNOWN', '(null)')"
_CLEAN = f"""SELECT c_custkey, c_nationkey, CASE WHEN seg NOT IN {_TOKENS} THEN seg END AS seg,
    bal_text, bal, CASE WHEN age_text NOT IN {_TOKENS} THEN age_text END AS age_text, rare
    FROM ({DIRTY_CUSTOMER})"""


def _clean(spark: SparkSession, d: str) -> DataFrame:
    return op.null_tokens(dirty_customer(spark, d))


@query("null_tokens", f"SELECT c_custkey, seg, age_text FROM ({_CLEAN})")
def null_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _clean(spark, d).select("c_custkey", "seg", "age_text")


_COLUMNS = ("c_custkey", "c_nationkey", "seg", "bal_text", "bal", "age_text", "rare")
_TEXTS = ("seg", "bal_text", "age_text", "rare")


def _missing(column: str, nan: bool) -> str:
    test = f"{column} IS NULL"
    if column in _TEXTS:
        test += f" OR {column} IN {_TOKENS}"
        if nan:
            test += f" OR {column} = 'NaN'"
    elif column == "bal" and nan:
        test += " OR isnan(bal)"
    return f"count(*) FILTER (WHERE {test})"


def _profile(nan: bool, pct: bool) -> str:
    lines = []
    for c in _COLUMNS:
        n = _missing(c, nan)
        share = f", round(100.0 * {n} / count(*), 6)::DOUBLE AS pct" if pct else ""
        lines.append(f"SELECT '{c}' AS \"column\", count(*) AS n_rows, {n} AS n_missing{share} FROM t")
    return f"WITH t AS ({DIRTY_CUSTOMER}) " + " UNION ALL ".join(lines)


@query(
    "missing_counts",
    f"WITH t AS ({DIRTY_CUSTOMER}) SELECT "
    + ", ".join(f"{_missing(c, True)} AS {c}" for c in _COLUMNS)
    + " FROM t",
)
def missing_counts(spark: SparkSession, d: str) -> DataFrame:
    return op.missing_counts(dirty_customer(spark, d))


@query("missing_profile", _profile(nan=True, pct=False))
def missing_profile(spark: SparkSession, d: str) -> DataFrame:
    return op.missing_profile(dirty_customer(spark, d)).select("column", "n_rows", "n_missing")


@query("missing_profile_typed", _profile(nan=False, pct=False))
def missing_profile_typed(spark: SparkSession, d: str) -> DataFrame:
    profile = op.missing_profile(dirty_customer(spark, d), nan=False)
    return profile.select("column", "n_rows", "n_missing")


@query("missing_pct", _profile(nan=True, pct=True))
def missing_pct(spark: SparkSession, d: str) -> DataFrame:
    return op.missing_profile(dirty_customer(spark, d)).withColumn("pct", F.round("pct", 6))


@query(
    "mode_value",
    f"""WITH t AS ({_CLEAN}) SELECT 'seg' AS "column", seg AS "value", count(*) AS n FROM t
    WHERE seg IS NOT NULL GROUP BY seg ORDER BY n DESC, seg LIMIT 1""",
)
def mode_value(spark: SparkSession, d: str) -> DataFrame:
    return op.column_modes(_clean(spark, d), ["seg"])


@query(
    "mode_value_with_null",
    f"""WITH t AS ({_CLEAN}) SELECT 'seg' AS "column", seg AS "value", count(*) AS n FROM t
    GROUP BY seg ORDER BY n DESC, seg NULLS FIRST LIMIT 1""",
)
def mode_value_with_null(spark: SparkSession, d: str) -> DataFrame:
    return op.column_modes(_clean(spark, d), ["seg"], include_null=True)


_PART_MODES = {
    "kind": "kind",
    "brand": "brand",
    "size": "CAST(size AS VARCHAR)",
}


@query(
    "column_modes_multi",
    f"WITH t AS ({DIRTY_PART}) "
    + " UNION ALL ".join(
        f"""(SELECT '{c}' AS "column", {text} AS "value", count(*) AS n FROM t
        WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, {c} LIMIT 1)"""
        for c, text in _PART_MODES.items()
    ),
)
def column_modes_multi(spark: SparkSession, d: str) -> DataFrame:
    return op.column_modes(dirty_part(spark, d), list(_PART_MODES))


_LINE_MODES = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_shipdate")


@query(
    "column_modes_cells",
    " UNION ALL ".join(
        f"""(SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS "value", count(*) AS n FROM lineitem
        GROUP BY {c} ORDER BY n DESC, {c} LIMIT 1)"""
        for c in _LINE_MODES
    ),
)
def column_modes_cells(spark: SparkSession, d: str) -> DataFrame:
    """Modes of columns with very many values, of which only those that can be modes move."""
    return op.column_modes(read_table(spark, d, "lineitem"), _LINE_MODES, cells=4096)


def _mode(column: str) -> str:
    return (
        f"(SELECT {column} FROM t WHERE {column} IS NOT NULL GROUP BY {column} "
        f"ORDER BY count(*) DESC, {column} LIMIT 1)"
    )


@query(
    "impute_mode",
    f"WITH t AS ({_CLEAN}) SELECT c_custkey, coalesce(seg, {_mode('seg')}) AS seg FROM t",
)
def impute_mode(spark: SparkSession, d: str) -> DataFrame:
    return op.impute_modes(_clean(spark, d), ["seg"]).select("c_custkey", "seg")


@query(
    "impute_modes_multi",
    f"""WITH t AS ({DIRTY_PART}) SELECT p_partkey, coalesce(kind, {_mode('kind')}) AS kind,
    coalesce(brand, {_mode('brand')}) AS brand, coalesce(size, {_mode('size')}) AS size FROM t""",
)
def impute_modes_multi(spark: SparkSession, d: str) -> DataFrame:
    filled = op.impute_modes(dirty_part(spark, d), ["kind", "brand", "size"])
    return filled.select("p_partkey", "kind", "brand", "size")


@query(
    "drop_missing_rows",
    f"""WITH t AS ({_CLEAN}) SELECT c_custkey, seg, age_text FROM t
    WHERE seg IS NOT NULL AND age_text IS NOT NULL""",
)
def drop_missing_rows(spark: SparkSession, d: str) -> DataFrame:
    kept = op.drop_missing(_clean(spark, d), ["seg", "age_text"])
    return kept.select("c_custkey", "seg", "age_text")


@query(
    "row_count_before_after",
    f"""WITH t AS ({_CLEAN}) SELECT count(*) AS n_before,
    count(*) FILTER (WHERE seg IS NOT NULL AND age_text IS NOT NULL) AS n_after FROM t""",
)
def row_count_before_after(spark: SparkSession, d: str) -> DataFrame:
    return op.rows_before_after(_clean(spark, d), ["seg", "age_text"])


@query("drop_sparse_columns", f"SELECT c_custkey, c_nationkey, seg, bal_text, bal, age_text FROM ({DIRTY_CUSTOMER})")
def drop_sparse_columns(spark: SparkSession, d: str) -> DataFrame:
    return op.drop_sparse(dirty_customer(spark, d), max_pct=60.0)


@query(
    "impute_modes_nan",
    """WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'NaN'::DOUBLE
        WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey % 4 END AS x FROM orders),
      m AS (SELECT x FROM t WHERE x IS NOT NULL AND NOT isnan(x) GROUP BY x ORDER BY count(*) DESC, x LIMIT 1)
    SELECT o_orderkey, CASE WHEN x IS NULL OR isnan(x) THEN (SELECT x FROM m) ELSE x END AS x FROM t""",
)
def impute_modes_nan(spark: SparkSession, d: str) -> DataFrame:
    """NaN is missing: never the mode, and filled with it."""
    orders = read_table(spark, d, "orders").selectExpr(
        "o_orderkey",
        """CASE WHEN o_orderkey % 3 = 0 THEN double('NaN') WHEN o_orderkey % 5 = 0 THEN NULL
           ELSE cast(o_custkey % 4 AS double) END AS x""",
    )
    return op.impute_modes(orders, ["x"])
