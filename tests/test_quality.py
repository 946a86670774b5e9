from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tabkit import operators as op
from tests.conftest import executed, rows


def test_null_tokens_is_exact(ansi, edge):
    cats = {r["id"]: r["cat"] for r in op.null_tokens(edge).collect()}
    assert [cats[i] for i in (10, 11, 12)] == [None] * 3
    assert cats[13] == "unknown" and cats[14] == " UNKNOWN"


def test_null_tokens_leaves_other_types(edge):
    assert op.null_tokens(edge).schema == edge.schema
    numbers = edge.select("id", "const")
    assert rows(op.null_tokens(numbers)) == rows(numbers)


def test_profile(ansi, edge):
    got = {r["column"]: r["n_missing"] for r in op.missing_profile(edge).collect()}
    assert got == {
        "id": 0, "cat": 8, "txt_num": 4, "num": 2, "const": 0, "date_txt": 1, "label": 0,
    }
    plain = {r["column"]: r["n_missing"] for r in op.missing_profile(edge, nan=False).collect()}
    assert plain["txt_num"] == 1 and plain["num"] == 1


def test_profile_and_counts_agree(ansi, edge):
    wide = op.missing_counts(edge).head().asDict()
    long = {r["column"]: r["n_missing"] for r in op.missing_profile(edge).collect()}
    assert wide == long


def test_profile_is_one_scan(spark, edge, tmp_path):
    edge.write.parquet(str(tmp_path / "e"))
    plan = executed(op.missing_profile(spark.read.parquet(str(tmp_path / "e"))))
    assert plan.split("== Initial Plan ==")[0].count("FileScan") == 1


def test_profile_of_an_empty_table(ansi, edge):
    got = op.missing_profile(edge.where("id < 0")).collect()
    assert all(r["n_rows"] == 0 and r["pct"] is None for r in got)


def test_mode_ignores_null_and_breaks_ties_low(ansi, edge):
    clean = op.null_tokens(edge)
    assert rows(op.column_modes(clean, ["cat"])) == [("cat", "a", 2)]
    assert rows(op.column_modes(clean, ["cat"], include_null=True)) == [("cat", None, 8)]


def test_mode_keeps_the_type(spark):
    df = spark.createDataFrame([(9, "x"), (10, "x"), (9, "y"), (10, "y")], "n int, s string")
    df = df.selectExpr("n", "s", "date '2024-01-01' as d", "n > 9 as b", "cast(n as decimal(9, 2)) as m")
    odd = {r["column"]: r["value"] for r in op.column_modes(df, df.columns).collect()}
    assert odd == {"n": "9", "s": "x", "d": "2024-01-01", "b": "false", "m": "9.00"}
    row = op.mode_row(df, ["n", "s"])
    assert row.schema["n"].dataType.simpleString() == "int"
    assert rows(row) == [(9, "x")]


def test_mode_of_column_without_values_stays_null(ansi, spark):
    df = spark.createDataFrame([(None, "x"), (None, "x")], "e string, s string")
    assert rows(op.column_modes(df, ["e", "s"])) == [("e", None, None), ("s", "x", 2)]
    assert op.impute_modes(df, ["e", "s"]).where("e is null").count() == 2


def test_modes_of_many_columns(spark):
    wide = spark.range(10).select(*[(F.col("id") % (i + 2)).alias(f"c{i}") for i in range(70)])
    got = {r["column"]: (r["value"], r["n"]) for r in op.column_modes(wide, wide.columns).collect()}
    assert len(got) == 70 and got["c0"] == ("0", 5) and got["c69"] == ("0", 1)


def test_impute_leaves_nothing_missing(ansi, edge):
    clean = op.null_tokens(edge)
    filled = op.impute_modes(clean, ["cat", "num"])
    left = {r["column"]: r["n_missing"] for r in op.missing_profile(filled, nan=False).collect()}
    assert left["cat"] == 0 and left["num"] == 0
    assert filled.columns == edge.columns


def test_impute_counts_values_once(spark, tmp_path, edge):
    edge.write.parquet(str(tmp_path / "e"))
    df = spark.read.parquet(str(tmp_path / "e"))
    plan = executed(op.impute_modes(df, ["cat", "label"]))
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("Expand") == 1 and "Join" not in final


def test_modes_read_each_column_once(spark, tmp_path, edge):
    edge.write.parquet(str(tmp_path / "e"))
    df = spark.read.parquet(str(tmp_path / "e"))
    plan = executed(op.column_modes(df, ["cat", "num", "label", "id"]))
    final = plan.split("== Initial Plan ==")[0]
    schemas = sorted(re.findall(r"ReadSchema: struct<([^>]*)>", final))
    assert schemas == ["cat:string,label:string", "id:bigint", "num:double"]


def test_impute_with_given_modes(edge):
    clean = op.null_tokens(edge)
    modes = op.settled_modes(clean, ["cat"])
    given = op.impute_modes(clean, ["cat"], modes=modes)
    own = op.impute_modes(clean, ["cat"])
    assert {r["cat"] for r in given.collect()} == {r["cat"] for r in own.collect()}


def test_hot_value_is_combined_before_the_shuffle(spark):
    df = spark.range(100_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("v"))
    assert rows(op.column_modes(df, ["v"])) == [("v", "hot", 33_334)]
    plan = op.mode_row(df, ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan


def test_rows_before_after_matches_the_drop(ansi, edge):
    clean = op.null_tokens(edge)
    for subset in (["cat", "num"], ["num"], ["txt_num", "num"]):
        before, after = op.rows_before_after(clean, subset).head()
        assert before == clean.count() and after == op.drop_missing(clean, subset).count()


@pytest.mark.parametrize("limit, gone", [(10.0, {"cat", "txt_num", "num"}), (50.0, {"cat"}), (99.0, set())])
def test_drop_sparse(edge, limit, gone):
    assert set(edge.columns) - set(op.drop_sparse(edge, limit).columns) == gone


def test_nan_is_no_mode_and_is_filled(ansi, spark):
    nan = float("nan")
    df = spark.createDataFrame([(nan,), (nan,), (None,), (1.0,)], "x double")
    assert rows(op.mode_row(df, ["x"])) == [(1.0,)]
    assert rows(op.impute_modes(df, ["x"])) == [(1.0,)] * 4
    assert op.missing_profile(op.impute_modes(df, ["x"])).head()["n_missing"] == 0
    assert rows(op.column_modes(df, ["x"], include_null=True)) == [("x", None, 3)]


def test_unknown_columns_and_maps_are_refused(spark, edge):
    with pytest.raises(ValueError, match="no such columns: nowhere"):
        op.null_tokens(edge, columns=["nowhere"])
    with pytest.raises(ValueError, match="a map has no mode"):
        op.mode_row(spark.createDataFrame([({"a": 1},)], "m map<string,int>"), ["m"])


DOTTED = {
    "null_tokens": lambda df: op.null_tokens(df, ["-"], ["a.b"]),
    "missing_profile": op.missing_profile,
    "missing_counts": op.missing_counts,
    "modes": lambda df: op.column_modes(df, ["a.b", "n.m"]),
    "impute": lambda df: op.impute_modes(df, ["a.b", "n.m"]),
    "drop_missing": lambda df: op.drop_missing(df, ["a.b"]),
    "before_after": lambda df: op.rows_before_after(df, ["a.b"]),
    "group_count": lambda df: op.group_count_ranked(df, ["a.b"]),
    "top_k": lambda df: op.top_k(df, ["a.b"], 1),
    "histogram": lambda df: op.histogram(df, "n.m"),
    "group_mean": lambda df: op.group_mean(df, ["a.b"], "n.m"),
    "group_mean_ratio": lambda df: op.group_mean_ratio(df, ["a.b"], "n.m"),
    "index": lambda df: op.index_labels(df, ["a.b"]),
    "corr": lambda df: op.corr_long(df, ["n.m", "k"]),
    "corr_categorical": lambda df: op.corr_categorical(df, ["a.b", "k"]),
    "cramers": lambda df: op.cramers_v(df, ["a.b", "k"]),
    "min_max": lambda df: op.min_max(df, ["n.m"]),
}


@pytest.mark.parametrize("name", sorted(DOTTED))
def test_dots_in_names(spark, name):
    df = spark.createDataFrame(
        [("x", 1.0, 1), ("x", 2.0, 2), ("-", None, 1), (None, 4.0, 3)], "`a.b` string, `n.m` double, k int"
    )
    assert DOTTED[name](df).count() > 0


@pytest.mark.parametrize(("cells", "first"), [(1, 1), (7, 2), (4096, 4)])
def test_modes_by_cells_are_exact(spark, cells, first):
    """Ties, unique values, signed zeros, NaN, NULL and a value that stands out."""
    df = spark.range(900).select(
        F.col("id").alias("unique"),
        (F.col("id") % 30).cast("int").alias("tied"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), F.col("id"))).alias("hot"),
        F.when(F.col("id") % 5 == 0, F.lit(float("nan"))).when(F.col("id") % 5 < 3, F.when(F.col("id") % 2 == 0, -0.0).otherwise(0.0))
        .otherwise(F.col("id") / 7).alias("zeros"),
        F.lit(None).cast("string").alias("none"),
        F.when(F.col("id") < 2, F.lit("b")).when(F.col("id") < 4, F.lit("a")).alias("few"),
    )
    want = rows(op.column_modes(df, df.columns))
    assert rows(op.column_modes(op.narrowed(df, df.columns, cells, first), df.columns)) == want
    assert {r[0]: r[2] for r in want} == {"unique": 1, "tied": 30, "hot": 300, "zeros": 360, "none": None, "few": 2}


def test_only_values_that_can_be_modes_move(spark):
    df = spark.range(20_000).select(
        F.when(F.col("id") % 4 == 0, -1).otherwise(F.col("id")).alias("skewed"), F.col("id").alias("unique")
    )
    left = op.narrowed(df, ["skewed"])
    assert left.distinct().count() < 50 and left.where("skewed = -1").count() == 5000
    assert op.narrowed(df, ["unique"]).count() == 20_000


def test_null_is_no_candidate_in_cells(spark):
    with pytest.raises(ValueError, match="no candidate"):
        op.column_modes(spark.range(3), ["id"], include_null=True, cells=8)
