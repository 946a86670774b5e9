from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(params=["true", "false"], ids=["ansi", "lenient"])
def ansi(spark: SparkSession, request):
    """The same test under both ANSI settings."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", request.param)
    yield request.param
    spark.conf.set("spark.sql.ansi.enabled", before)


NAN = float("nan")
EDGE = [
    (1, None, "1", 1.0, 5.0, "01/02/2024", "a"),
    (2, None, "01", NAN, 5.0, "1/2/2024", "a"),
    (3, None, "1.5", None, 5.0, "13/01/2024", "b"),
    (4, None, "NaN", 4.0, 5.0, None, "b"),
    (5, None, "bad", 5.0, 5.0, "01/02/2024 late", "c"),
    (6, "a", "", 6.0, 5.0, "02/30/2024", "a"),
    (7, "a", None, 7.0, 5.0, "12/31/2023", "a"),
    (8, "b", "3000000000", 8.0, 5.0, "", "b"),
    (9, "b", " 18 ", 9.0, 5.0, "2024-01-02", "b"),
    (10, "(No value)", "100", 10.0, 5.0, "07/04/2024", "a"),
    (11, "UNKNOWN", "9", 11.0, 5.0, "07/07/2024", "a"),
    (12, "(null)", "-2.9", 12.0, 5.0, "07/08/2024", "a"),
    (13, "unknown", "nan", 13.0, 5.0, "07/09/2024", "a"),
    (14, " UNKNOWN", "+NaN", 14.0, 5.0, "07/10/2024", "a"),
]
EDGE_SCHEMA = (
    "id bigint, cat string, txt_num string, num double, const double, date_txt string, label string"
)


@pytest.fixture(scope="session")
def edge(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EDGE, EDGE_SCHEMA)


def rows(df: DataFrame) -> list[tuple]:
    """All rows, in an order of their own."""
    return sorted((tuple(r) for r in df.collect()), key=repr)


def executed(df: DataFrame) -> str:
    """The physical plan after a run."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df: DataFrame) -> str:
    """What ran, of a frame that was collected: the last adaptive plan."""
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
