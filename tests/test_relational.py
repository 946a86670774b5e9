from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tabkit import operators as op
from tabkit.operators.lookup import join_lookup, measured_bytes
from tabkit.sources import (
    matrix_frame,
    preview,
    read_csv_text,
    read_table,
    settle,
    shared_dir,
    store,
)
from tests.conftest import SMALL, executed, rows


def test_csv_is_all_text(spark, tmp_path, edge):
    path = str(tmp_path / "csv")
    edge.select("id", "num", "label").write.csv(path, header=True)
    declared = read_csv_text(spark, path, ["id", "num", "label"])
    header = read_csv_text(spark, path)
    assert {t for _, t in declared.dtypes} == {t for _, t in header.dtypes} == {"string"}
    assert rows(declared) == rows(header) and declared.count() == edge.count()


def test_csv_with_another_header_is_an_error(spark, tmp_path, edge):
    path = str(tmp_path / "csv")
    edge.select("id", "label").write.csv(path, header=True)
    with pytest.raises(Exception, match="(?i)header"):
        read_csv_text(spark, path, ["id", "other"]).collect()


def test_matrix_frame(spark):
    frame = matrix_frame(spark, [[1.0, float("nan")], [0.5, 1.0]], ["a", "b"])
    assert [tuple(r) for r in frame.collect()] == [(1.0, None), (0.5, 1.0)]


def test_preview_is_stable(edge):
    assert [r["id"] for r in preview(edge, ["id"], 3).collect()] == [1, 2, 3]


def test_drop_columns_names_the_unknown(edge):
    with pytest.raises(ValueError, match="nope"):
        op.drop_columns(edge, ["cat", "nope"])
    assert "cat" not in op.drop_columns(edge, ["cat", "nope"], strict=False).columns


def test_columns_of_type(spark):
    df = spark.sql("select 1 as i, 2L as b, 1.5D as d, 1.5BD as e, 'x' as s, float(1) as f")
    assert op.columns_of_type(df, op.INT_AND_DOUBLE) == ["i", "d"]
    assert op.columns_of_type(df) == ["i", "b", "d", "e", "f"]


def test_cast_keeps_the_source_of_a_copy(ansi, edge):
    cast = op.cast_columns(edge, {"n": ("txt_num", "int"), "num": "int"})
    assert cast.schema["txt_num"].dataType.simpleString() == "string"
    assert {r["id"]: r["n"] for r in cast.collect()}[10] == 100


def test_ages_compare_as_numbers(ansi, edge):
    kept = op.filter_range(edge, "txt_num", low=18, kind="int")
    assert sorted(r["id"] for r in kept.collect()) == [9, 10]
    assert [r["txt_num"] for r in op.histogram(kept, "txt_num").collect()] == [18, 100]


def test_filter_in_reads_padded_text(ansi, edge):
    assert sorted(r["id"] for r in op.filter_in(edge, "txt_num", [1], kind="int").collect()) == [1, 2, 3]


def test_filter_ne(ansi, edge):
    assert op.filter_ne(edge, "cat", "a").count() == 7
    assert op.filter_ne(edge, "cat", "a", keep_null=True).count() == 12


def test_typed_filter_and_columns_reach_the_scan(spark):
    lines = read_table(spark, SMALL, "lineitem")
    plan = executed(op.project(op.filter_range(lines, "l_quantity", low=18.0), ["l_orderkey"]))
    assert "GreaterThanOrEqual(l_quantity,18.0)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_group_counts_add_up(edge):
    assert op.group_count(edge, ["cat"]).agg(F.sum("n")).head()[0] == edge.count()
    ranked = [r["n"] for r in op.group_count_ranked(edge, ["cat"]).collect()]
    assert ranked == sorted(ranked, reverse=True)


def test_group_mean_reads_text(ansi, edge):
    got = {r["label"]: r["mean"] for r in op.group_mean(edge, ["label"], "txt_num").collect()}
    assert got["c"] is None
    assert got["b"] == pytest.approx((1.5 + 3e9 + 18) / 3)


def test_ratio_over_zero_and_null_key(ansi, spark):
    df = spark.createDataFrame(
        [("z", 1.0), ("z", -1.0), (None, 4.0), (None, 6.0), ("k", 2.0)], "k string, x double"
    )
    out = {(r["k"], r["x"]): (r["group_mean"], r["ratio"]) for r in op.group_mean_ratio(df, ["k"], "x").collect()}
    assert out[("z", 1.0)] == (0.0, None) and out[(None, 4.0)] == (None, None)
    own = op.group_mean_ratio(df, ["k"], "x", null_key="group").collect()
    assert {(r["k"], r["x"]): r["ratio"] for r in own}[(None, 4.0)] == 0.8


def skewed(spark):
    """A third of the rows under one key, a fifth without a key."""
    key = (
        F.when(F.col("id") % 3 == 0, F.lit("hot"))
        .when(F.col("id") % 5 == 0, F.lit(None))
        .otherwise(F.concat(F.lit("k"), (F.col("id") % 997).cast("string")))
    )
    return spark.range(6000).select("id", key.alias("k"), (F.col("id") % 7).cast("double").alias("x"))


@pytest.mark.parametrize("null_safe", [False, True])
@pytest.mark.parametrize("max_bytes, rows_per_task", [(1 << 20, 100), (0, 100), (0, 1), (0, 10_000)])
def test_join_lookup_paths_agree(spark, null_safe, max_bytes, rows_per_task):
    df = skewed(spark)
    stats = settle(df.groupBy("k").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("_rows")))
    got = join_lookup(df, stats, ["k"], "_rows", null_safe, max_bytes, rows_per_task)
    means: dict = {}
    for _, k, x in df.collect():
        means.setdefault(k, []).append(x)
    want = [
        (i, k, x, None if k is None and not null_safe else pytest.approx(sum(means[k]) / len(means[k])))
        for i, k, x in sorted(df.collect())
    ]
    assert sorted(tuple(r) for r in got.collect()) == want


def test_a_hot_and_long_key_is_split_and_the_source_read_once(spark, tmp_path):
    """Half of the rows have one key, of ten thousand characters."""
    key = F.when(F.col("id") % 2 == 0, F.repeat(F.lit("h"), 10_000)).otherwise(F.col("id").cast("string"))
    spark.range(4000).select("id", key.alias("k")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    stats = settle(df.groupBy("k").agg(F.max("id").alias("m"), F.count(F.lit(1)).alias("_rows")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = join_lookup(df, stats, ["k"], "_rows", False, 0, 100)
        plan = executed(joined).split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("FileScan") == 1 and "LeftAnti" not in plan
    got = {r["id"]: r["m"] for r in joined.select("id", "m").collect()}
    assert got == {i: 3998 if i % 2 == 0 else i for i in range(4000)}


def test_the_size_of_nested_values_is_not_guessed(spark):
    with pytest.raises(ValueError, match="nested columns is not known: v"):
        measured_bytes(spark.createDataFrame([(1, [1.0])], "k int, v array<double>"))


def test_group_mean_does_not_shuffle_the_rows(spark):
    lines = read_table(spark, SMALL, "lineitem")
    plan = executed(op.join_group_mean(lines, ["l_suppkey"], "l_extendedprice"))
    final = plan.split("== Initial Plan ==")[0]
    assert "BroadcastHashJoin" in final and "hashpartitioning" not in final
    assert "Window" not in final


def test_time_bucket_keeps_the_type(spark):
    events = read_table(spark, SMALL, "events")
    out = op.time_bucket_count(events, "ts", "day")
    assert out.schema["bucket"].dataType == events.schema["ts"].dataType


def test_top_k(edge):
    assert [tuple(r) for r in op.top_k(edge, ["label"], 2).collect()] == [("a", 9), ("b", 4)]


UNITS = ("year", "quarter", "month", "week", "day", "hour", "minute", "second")


@pytest.mark.parametrize("unit", UNITS)
def test_time_bucket_ignores_the_session_zone(ansi, spark, unit):
    times = ["2024-03-10 02:30:45.5", "2024-11-03 01:59:59.999", "2023-12-31 23:00:00"]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(
        F.col("t").cast("timestamp_ntz").alias("t")
    )
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    utc = df.select(F.date_trunc(unit, F.col("t").cast("timestamp")).cast("timestamp_ntz").alias("b"))
    want = sorted(r["b"] for r in utc.collect())
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = op.time_bucket_count(df, "t", unit).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert sorted(b for b, n in got for _ in range(n)) == want


def test_time_bucket_of_other_types(spark):
    df = spark.sql("select timestamp '2024-05-06 07:08:09' as z, date '2024-05-06' as d")
    assert str(op.time_bucket_count(df, "z", "hour").head()[0]) == "2024-05-06 07:00:00"
    assert str(op.time_bucket_count(df, "d", "month").head()[0]) == "2024-05-01"
    with pytest.raises(ValueError, match="unit"):
        op.time_bucket_count(df, "z", "fortnight")


class _NoFolder:
    """A session without a checkpoint folder."""

    def __init__(self, master):
        self.sparkContext = self
        self.conf = self
        self.master = master
        self.folder = None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder

    def get(self, key, default):
        return default


def test_only_a_local_session_gets_a_temporary_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(_NoFolder("spark://host"))
    assert "tabkit-" in shared_dir(_NoFolder("local[2]"))


def test_stored_table_reads_back(spark, edge):
    stored = store(edge, "edge")
    assert stored.count() == edge.count() and stored.dtypes == edge.dtypes
    assert shared_dir(spark).removeprefix("file:") in stored.inputFiles()[0]


def test_stored_tables_can_be_cleared(spark, edge, tmp_path):
    from pathlib import Path

    from catalogue.inputs import arrests
    from tabkit.plans import arrests as plan
    from tabkit.sources import cleared

    with cleared(spark):
        ready = plan.prepared(arrests(spark, SMALL), columns=plan.CORRELATED)
        kinds = dict(ready.dtypes)
        assert kinds["Latitude"] == "double" and kinds["KY_CD"] == "int" and "PERP_SEX" not in kinds
        folder = Path(ready.inputFiles()[0].removeprefix("file://").removeprefix("file:")).parent
        assert folder.is_dir() and ready.count() > 0
    assert not folder.exists()
