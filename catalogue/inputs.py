"""Tables with faults, derived from the test tables.

The test tables hold no NULL, so the faults are put in here: for Spark by
``selectExpr``, for the SQL side by the query of the same name in capitals.
Every row of the source table is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabkit.sources import read_table

_SEG = """CASE WHEN c_custkey % 7 = 0 THEN 'UNKNOWN' WHEN c_custkey % 11 = 0 THEN '(null)'
  WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 17 = 0 THEN '(No value)'
  ELSE c_mktsegment END AS seg"""
_BAL_TEXT = """CASE WHEN c_custkey % 9 = 0 THEN 'NaN' WHEN c_custkey % 10 = 0 THEN 'bad'
  WHEN c_custkey % 19 = 0 THEN NULL ELSE CAST(c_acctbal AS {text}) END AS bal_text"""
_BAL = """CASE WHEN c_custkey % 23 = 0 THEN CAST('NaN' AS DOUBLE)
  WHEN c_custkey % 29 = 0 THEN NULL ELSE c_acctbal END AS bal"""
_AGE_TEXT = """CASE WHEN c_custkey % 31 = 0 THEN '(null)' WHEN c_custkey % 37 = 0 THEN '7.5'
  ELSE CAST(5 + c_custkey % 110 AS {text}) END AS age_text"""
_RARE = "CASE WHEN c_nationkey = 3 THEN c_name ELSE NULL END AS rare"

_CUSTOMER = ["c_custkey", "c_nationkey", _SEG, _BAL_TEXT, _BAL, _AGE_TEXT, _RARE]


def _spark(parts: list[str]) -> list[str]:
    return [p.replace("{text}", "STRING") for p in parts]


def _sql(parts: list[str], table: str) -> str:
    return f"SELECT {', '.join(p.replace('{text}', 'VARCHAR') for p in parts)} FROM {table}"


def dirty_customer(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "customer").selectExpr(*_spark(_CUSTOMER))


DIRTY_CUSTOMER = _sql(_CUSTOMER, "customer")

_PART = [
    "p_partkey",
    """CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_type END AS kind""",
    """CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_brand END AS brand""",
    """CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE p_size END AS size""",
    "p_retailprice",
]


def dirty_part(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "part").selectExpr(*_spark(_PART))


DIRTY_PART = _sql(_PART, "part")

_DATE = """CASE WHEN o_orderkey % 13 = 0 THEN '13/45/2020' WHEN o_orderkey % 17 = 0 THEN NULL
  WHEN o_orderkey % 19 = 0 THEN '1/2/2021' ELSE {date} END AS date_txt"""


def order_dates(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_table(spark, folder, "orders")
    date = _DATE.replace("{date}", "date_format(o_orderdate, 'MM/dd/yyyy')")
    return orders.selectExpr("o_orderkey", date)


ORDER_DATES = "SELECT o_orderkey, {} FROM orders".format(
    _DATE.replace("{date}", "strftime(o_orderdate, '%m/%d/%Y')")
)

# An arrests-shaped table: text columns only.
_ARRESTS = [
    "CAST(o_orderkey AS {text}) AS ARREST_KEY",
    """CASE WHEN o_orderkey % 7 = 0 THEN 'UNKNOWN' WHEN o_orderkey % 11 = 0 THEN NULL
       ELSE substring(o_orderpriority, 1, 1) END AS LAW_CAT_CD""",
    """CASE WHEN o_orderkey % 9 = 0 THEN '(null)' ELSE o_orderstatus END AS PERP_RACE""",
    "CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_orderpriority END AS PD_DESC",
    "CASE WHEN o_orderkey % 37 = 0 THEN '(null)' ELSE o_orderpriority END AS OFNS_DESC",
    "CASE WHEN o_orderkey % 41 = 0 THEN 'UNKNOWN' ELSE o_orderstatus END AS LAW_CODE",
    "CASE WHEN o_orderkey % 43 = 0 THEN NULL ELSE CAST(100 + o_custkey % 900 AS {text}) END AS KY_CD",
    "CAST(o_totalprice AS {text}) AS X_COORD_CD",
    "CAST(o_custkey AS {text}) AS Y_COORD_CD",
    "CASE WHEN o_orderkey % 47 = 0 THEN NULL ELSE CAST(o_totalprice + o_custkey * 10 AS {text}) END AS Latitude",
    "CAST(-(o_custkey % 71) AS {text}) AS Longitude",
    "CAST(o_custkey % 4 AS {text}) AS JURISDICTION_CODE",
    """CASE WHEN o_custkey % 6 = 0 THEN '<18' WHEN o_custkey % 6 = 1 THEN '18-24'
       WHEN o_custkey % 6 = 2 THEN '25-44' WHEN o_custkey % 6 = 3 THEN '45-64'
       WHEN o_custkey % 6 = 4 THEN '65+' ELSE 'UNKNOWN' END AS AGE_GROUP""",
    "{date} AS ARREST_DATE",
    """CASE WHEN o_custkey % 5 = 0 THEN 'B' WHEN o_custkey % 5 = 1 THEN 'K'
       WHEN o_custkey % 5 = 2 THEN 'M' WHEN o_custkey % 5 = 3 THEN 'Q' ELSE 'S' END AS ARREST_BORO""",
    "CASE WHEN o_custkey % 3 = 0 THEN 'F' ELSE 'M' END AS PERP_SEX",
]


def arrests(spark: SparkSession, folder: str) -> DataFrame:
    date = "date_format(o_orderdate, 'MM/dd/yyyy')"
    parts = [p.replace("{date}", date) for p in _spark(_ARRESTS)]
    return read_table(spark, folder, "orders").selectExpr(*parts)


ARRESTS = _sql(_ARRESTS, "orders").replace("{date}", "strftime(o_orderdate, '%m/%d/%Y')")

# A poverty-shaped table: text columns only.
_POVERTY = [
    "CAST(p_partkey AS {text}) AS PERSON_KEY",
    "CASE WHEN p_partkey % 10 = 0 THEN '1' ELSE NULL END AS JWTR",
    "CASE WHEN p_partkey % 12 = 0 THEN '2' ELSE '(null)' END AS ENG",
    "CASE WHEN p_partkey % 14 = 0 THEN '3' ELSE 'UNKNOWN' END AS WKW",
    "CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(p_partkey % 24 AS {text}) END AS SCHL",
    "CASE WHEN p_partkey % 8 = 0 THEN '(No value)' ELSE CAST(p_size % 4 AS {text}) END AS EducAttain",
    "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(1 + p_size % 2 AS {text}) END AS LANX",
    "CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_brand END AS MSP",
    "CAST(p_partkey AS {text}) AS SERIALNO",
    "p_name AS HHT",
    "CAST(5 + p_size AS {text}) AS AGEP",
    "CAST(1 + p_partkey % 5 AS {text}) AS CitizenStatus",
    "p_type AS MAR",
    "CAST(p_retailprice * 10 AS {text}) AS PreTaxIncome_PU",
    "CAST(10 + p_size * 3 AS {text}) AS PWGTP",
    "CAST(p_size % 60 AS {text}) AS TotalWorkHrs_PU",
    "CAST(1 AS {text}) AS SPORDER",
    "CAST(p_size % 7 AS {text}) AS EST_Childcare",
    "CAST(p_partkey % 11 AS {text}) AS EST_Commuting",
    "CAST(p_retailprice AS {text}) AS EST_FICAtax",
    "CAST(0 AS {text}) AS EST_HEAP",
    "CAST(p_size * p_size AS {text}) AS EST_Housing",
    "CAST(p_retailprice + p_size AS {text}) AS EST_IncomeTax",
    "CAST(p_partkey % 13 AS {text}) AS EST_MOOP",
    "CAST(p_partkey % 17 + p_size AS {text}) AS EST_Nutrition",
    "CAST(p_retailprice * 2 AS {text}) AS NYCgov_Income",
    "CAST(p_partkey % 6 AS {text}) AS Ethnicity",
    "CAST(p_size % 3 AS {text}) AS TEN",
    "CAST(1 + p_partkey % 2 AS {text}) AS SEX",
    "CAST(p_partkey % 3 AS {text}) AS SCH",
    "CAST(1 + p_partkey % 5 AS {text}) AS CIT",
    "CAST(1 + p_size % 2 AS {text}) AS DIS",
    "CASE WHEN p_size % 5 = 0 THEN '1' ELSE '2' END AS NYCgov_Pov_Stat",
    "CAST(1 + p_partkey % 5 AS {text}) AS Boro",
    "CAST(p_size % 8 AS {text}) AS FamType_PU",
    "CAST(p_partkey % 4 AS {text}) AS FTPTWork",
]


def poverty(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "part").selectExpr(*_spark(_POVERTY))


POVERTY = _sql(_POVERTY, "part")


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that carry a quality label."""
    documents = read_table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = read_table(spark, folder, "labels").select("doc_id", "quality")
    return documents.join(labels, "doc_id")
