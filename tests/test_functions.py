"""Column expressions on the edge table, under both ANSI settings."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tabkit import functions as fn
from tests.conftest import EDGE, rows


def by_id(df):
    return {r[0]: r[1] for r in df.collect()}


def test_text_to_int(ansi, edge):
    got = by_id(edge.select("id", fn.as_int(F.col("txt_num"))))
    assert got == {
        1: 1, 2: 1, 3: 1, 4: None, 5: None, 6: None, 7: None,
        8: None, 9: 18, 10: 100, 11: 9, 12: -2, 13: None, 14: None,
    }


def test_text_to_double(ansi, edge):
    got = by_id(edge.select("id", fn.as_double(F.col("txt_num"))))
    assert got[3] == 1.5 and got[12] == -2.9 and got[8] == 3e9
    assert [got[i] for i in (4, 5, 6, 7, 13, 14)] == [None] * 6


def test_text_nan_agrees_with_the_cast(ansi, spark):
    texts = ["NaN", "nan", "NAN", " NaN", "NaN\t", "+NaN", "-NaN", "+nan", "NaNs", "Nan", "",
             "1", "Infinity", "n an", "NaNd", "naN", "bad", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", fn.is_text_nan(F.col("t")), F.isnan(F.col("t").try_cast("double")))
    for text, mine, cast in got.collect():
        assert bool(mine) == bool(cast), repr(text)


def test_weekday_and_month(ansi, edge):
    got = edge.select("id", fn.weekday_name(F.col("date_txt")), fn.month_of_date(F.col("date_txt")))
    for i, name, month in got.collect():
        text = EDGE[i - 1][5]
        try:
            day = datetime.strptime(text, "%m/%d/%Y")
            want = (fn.WEEKDAYS_ES[day.weekday()], day.month)
        except (ValueError, TypeError):
            want = (None, None)
        assert (name, month) == want, text


def test_weekday_of_every_day(spark):
    days = spark.range(0, 800).select(
        F.date_add(F.lit(date(2023, 1, 1)), F.col("id").cast("int")).alias("d")
    )
    named = days.select("d", fn.weekday_name(F.date_format("d", "MM/dd/yyyy")).alias("n"))
    assert all(r["n"] == fn.WEEKDAYS_ES[r["d"].weekday()] for r in named.collect())


def test_field_by_position_is_not_the_month(edge):
    got = by_id(edge.where("id in (7, 10)").select("id", fn.date_field_by_position(F.col("date_txt"))))
    assert got == {7: 31, 10: 4}


@pytest.mark.parametrize("top, bottom, want", [(1.0, 2.0, 0.5), (1.0, 0.0, None), (None, 1.0, None)])
def test_ratio(ansi, spark, top, bottom, want):
    df = spark.createDataFrame([(top, bottom)], "a double, b double")
    assert df.select(fn.ratio(F.col("a"), F.col("b"))).head()[0] == want


def test_missing_test_is_never_null(ansi, edge):
    tests = edge.select(*[fn.is_missing(f).alias(f.name) for f in edge.schema.fields])
    assert all(v is not None for r in tests.collect() for v in r)


def test_no_python_worker_in_any_expression(edge):
    c = F.col("date_txt")
    plan = edge.select(fn.weekday_name(c), fn.month_of_date(c), fn.date_field_by_position(c))
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()


def test_expressions_work_on_a_stream(spark, tmp_path, edge):
    folder = str(tmp_path / "edge")
    edge.write.parquet(folder)
    from tabkit import operators as op

    stream = op.null_tokens(spark.readStream.schema(edge.schema).parquet(folder))
    stream = op.cast_columns(op.filter_ne(stream, "cat", "a"), {"txt_num": "int"})
    stream = stream.withColumn("day", fn.weekday_name(F.col("date_txt")))
    run = stream.writeStream.format("memory").queryName("edge_stream").outputMode("append").start()
    run.processAllAvailable()
    run.stop()
    batch = op.cast_columns(op.filter_ne(op.null_tokens(edge), "cat", "a"), {"txt_num": "int"})
    batch = batch.withColumn("day", fn.weekday_name(F.col("date_txt")))
    assert rows(spark.table("edge_stream")) == rows(batch)
