"""Indices, scaling, correlation: each against Spark ML or brute force."""

from __future__ import annotations

import math
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import functions as F

from tabkit import operators as op
from tabkit.operators import correlation
from tabkit.sources import read_table, settle
from tests.conftest import SMALL, rows


@pytest.fixture(scope="module")
def part(spark):
    return read_table(spark, SMALL, "part")


@pytest.mark.parametrize("column", ["p_type", "p_brand", "p_size", "p_retailprice"])
@pytest.mark.parametrize("max_bytes", [1 << 20, 0])
def test_index_equals_string_indexer(spark, part, column, max_bytes):
    ml = StringIndexer(inputCol=column, outputCol="i").fit(part).transform(part)
    mine = op.index_labels(part, [column], max_bytes=max_bytes)
    assert rows(mine.select("p_partkey", column + "_index")) == rows(ml.select("p_partkey", "i"))


def test_index_of_null(spark, edge):
    clean = op.null_tokens(edge)
    kept = {r["id"]: r["cat_index"] for r in op.index_labels(clean, ["cat"], null="keep").collect()}
    left = {r["id"]: r["cat_index"] for r in op.index_labels(clean, ["cat"]).collect()}
    assert kept[1] == 4.0 and left[1] is None and kept[6] == left[6] == 0.0
    with pytest.raises(Exception, match="NULL in cat"):
        op.index_labels(clean, ["cat"], null="error").collect()


def test_row_numbers_across_ranges(spark):
    df = settle(
        spark.range(5000).select(
            F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"),
            F.xxhash64("id").alias("v"),
        )
    )
    near = op.number_rows(df, ["g"], [F.col("v").desc()], "n")
    far = op.number_rows(df, ["g"], [F.col("v").desc()], "n", max_bytes=0)
    assert rows(near) == rows(far)
    assert far.rdd.getNumPartitions() > 0


def test_labels_are_those_of_the_string_indexer(spark, part):
    labels = op.fit_labels(part, ["p_type", "p_size"])
    for c in ("p_type", "p_size"):
        want = list(StringIndexer(inputCol=c, outputCol="o").fit(part).labels)
        own = labels.table.where(F.col("column") == c).orderBy("index")
        assert [r["value"] for r in own.collect()] == want


def test_more_than_ten_thousand_labels(spark):
    train = spark.range(12_000).selectExpr("cast(id as string) as k", "id % 2 as y")
    labels = op.fit_labels(train, ["k"])
    assert labels.count("k") == 12_000
    test = spark.createDataFrame([("7",), ("new",), (None,)], "k string")
    got = dict(rows(op.apply_labels(test, labels, ["k"], ["i"], "keep")))
    assert got["new"] == got[None] == 12_000.0 and got["7"] < 12_000
    kept = op.apply_labels(test, labels, ["k"], ["i"], "keep").schema["i"].metadata["ml_attr"]
    assert kept["num_vals"] == 12_001 and "vals" not in kept
    with pytest.raises(Exception, match="a new value in k"):
        op.apply_labels(test, labels, ["k"], ["i"], "null", "error").collect()
    assert dict(rows(op.apply_labels(test, labels, ["k"], ["i"])))["new"] is None


def test_unseen_label_gets_the_last_index(spark, edge):
    labels = op.fit_labels(edge.where("label != 'c'"), ["label"])
    seen = op.apply_labels(edge.where("label = 'c'"), labels, ["label"], ["i"], "keep")
    assert {r["i"] for r in seen.collect()} == {2.0}


def test_min_max_equals_the_vector_form(spark, part):
    columns = ["p_size", "p_retailprice"]
    sql = op.min_max(part, columns).select(*[f"{c}_scaled" for c in columns])
    vec = op.min_max_vector(part, columns)
    values = vector_to_array("scaled_features")
    got = np.array(rows(sql))
    want = np.array(rows(vec.select(values[0], values[1])))
    assert np.allclose(got, want) and got.min() == 0.0 and got.max() == 1.0


def test_min_max_edges(ansi, edge):
    out = op.min_max(edge, ["const", "num", "txt_num"])
    got = {r["id"]: r for r in out.collect()}
    assert {r["const_scaled"] for r in got.values()} == {0.5}
    assert got[3]["num_scaled"] is None and got[1]["num_scaled"] == 0.0 and got[14]["num_scaled"] == 1.0
    assert got[5]["txt_num_scaled"] is None and got[8]["txt_num_scaled"] == 1.0
    assert out.columns[: len(edge.columns)] == edge.columns


def test_assemble_skips_what_the_report_counts(edge):
    n, skipped = op.assembly_report(edge, ["num", "const"]).head()
    assert (n, skipped) == (14, 2) and op.assemble(edge, ["num", "const"]).count() == n - skipped
    with pytest.raises(Exception):
        op.assemble(edge, ["num"], handle_invalid="error").collect()


def matrix(long, columns):
    cells = {(r["col_a"], r["col_b"]): r["corr"] for r in long.collect()}
    return np.array([[np.nan if cells[a, b] is None else cells[a, b] for b in columns] for a in columns])


COLUMNS = ["l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount"]


def test_correlation_equals_spark_ml(spark):
    lines = read_table(spark, SMALL, "lineitem")
    got = matrix(op.corr_long(lines, COLUMNS), COLUMNS)
    packed = VectorAssembler(inputCols=COLUMNS, outputCol="f").transform(lines)
    want = Correlation.corr(packed, "f").head()[0].toArray()
    assert np.allclose(got, want, atol=1e-9)
    assert np.allclose(got, got.T) and np.allclose(np.diag(got), 1.0)


def test_correlation_of_constant_and_missing(ansi, spark):
    df = spark.createDataFrame(
        [(1.0, 0.1, 2.0), (2.0, 0.1, 4.1), (3.0, 0.1, 6.0), (None, 0.1, 9.0), (5.0, 0.1, float("nan"))],
        "a double, c double, b double",
    )
    got = matrix(op.corr_long(df, ["a", "c", "b"]), ["a", "c", "b"])
    assert np.isnan(got[1]).all() and np.isnan(got[:, 1]).all()
    assert got[0, 2] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4.1, 6])[0, 1])
    with pytest.raises(Exception, match="NULL or NaN"):
        op.corr_long(df, ["a", "b"], null="error").collect()
    empty = op.corr_long(df.where("a > 99"), ["a", "b"]).collect()
    assert all(r["corr"] is None for r in empty)


@pytest.mark.parametrize("width", [2, 10, 11, 40])
def test_correlation_does_not_depend_on_the_width(spark, width):
    names = [f"c{i}" for i in range(width)]
    cell = "CASE WHEN {i} = 0 AND id = 7 THEN double('Infinity') ELSE cast(pmod(xxhash64(id, {i}), 97) AS double) END AS c{i}"
    df = spark.range(200).selectExpr("id", *[cell.format(i=i) for i in range(width)])
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in op.corr_long(df, names).collect()}
    assert len(got) == width * width
    assert all(v is None for (a, b), v in got.items() if "c0" in (a, b))
    assert got["c1", "c1"] == 1.0
    if width > 2:
        pdf = df.select("c1", "c2").toPandas()
        assert got["c1", "c2"] == pytest.approx(np.corrcoef(pdf["c1"], pdf["c2"])[0, 1], abs=1e-12)


def test_forty_categories_and_a_pair_without_rows(spark):
    names = [f"k{i}" for i in range(40)]
    df = spark.range(60).selectExpr(*[f"pmod(xxhash64(id, {i}), 3) AS k{i}" for i in range(40)])
    assert op.cramers_v(df, names).count() == 780
    assert op.corr_categorical(df, names).count() == 1600
    apart = spark.createDataFrame([("a", None, "x"), (None, "b", "y"), ("c", None, "y")], "p string, q string, r string")
    got = {(r["col_a"], r["col_b"]): r["v"] for r in op.cramers_v(apart, ["p", "q", "r"]).collect()}
    assert set(got) == {("p", "q"), ("p", "r"), ("q", "r")} and got["p", "q"] is None and got["p", "r"] == 1.0


def test_correlation_far_from_zero(spark):
    df = spark.range(1000).select(
        (F.col("id") * 1e-3 + 1e9).alias("a"), (F.col("id") % 7 * 1e-3 - 1e9).alias("b")
    )
    pdf = df.toPandas()
    want = np.corrcoef(pdf["a"] - 1e9, pdf["b"] + 1e9)[0, 1]
    assert matrix(op.corr_long(df, ["a", "b"]), ["a", "b"])[0, 1] == pytest.approx(want, abs=1e-6)


def test_wide_form(spark):
    lines = read_table(spark, SMALL, "lineitem")
    long = op.corr_long(lines, COLUMNS)
    wide = {r["column"]: r.asDict() for r in op.corr_wide(long, COLUMNS).collect()}
    for r in long.collect():
        assert wide[r["col_a"]][r["col_b"]] == pytest.approx(r["corr"])


def test_category_correlation_is_pearson_of_indices(spark, part):
    columns = ["p_type", "p_brand", "p_size"]
    direct = op.corr_long(op.index_labels(part, columns), [c + "_index" for c in columns])
    mine = op.corr_categorical(part, columns)
    assert np.allclose(
        matrix(mine, columns), matrix(direct, [c + "_index" for c in columns]), atol=1e-9
    )


def cramers(pairs):
    cells = Counter(p for p in pairs if None not in p)
    n = sum(cells.values())
    left, right = Counter(), Counter()
    for (a, b), k in cells.items():
        left[a] += k
        right[b] += k
    chi2 = sum((cells[a, b] - left[a] * right[b] / n) ** 2 / (left[a] * right[b] / n) for a, b in product(left, right))
    least = min(len(left), len(right)) - 1
    return math.sqrt(chi2 / n / least) if least else None


def test_cramers_v_by_brute_force(ansi, spark, edge):
    df = op.null_tokens(edge)
    got = {(r["col_a"], r["col_b"]): r["v"] for r in op.cramers_v(df, ["cat", "label", "const", "date_txt"]).collect()}
    data = df.collect()
    assert len(got) == 6
    for (a, b), v in got.items():
        want = cramers([(r[a], r[b]) for r in data])
        assert v == (None if want is None else pytest.approx(want)), (a, b)


def test_moments_of_parts_add_up():
    rng = np.random.default_rng(1)
    values = rng.standard_normal((4, 500)) * [[1e-3], [1.0], [1e6], [0.5]] + [[1e9], [0.0], [-1e12], [3.0]]
    values[3] += 2 * values[1]
    cuts = [0, 1, 3, 90, 91, 300, 500]
    parts = [correlation.Moments.of(values[:, a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    whole = sum(parts[1:], parts[0])
    centred = values - values.mean(axis=1, keepdims=True)
    centred -= centred.mean(axis=1, keepdims=True)
    want = centred @ centred.T
    spread = np.sqrt(np.diag(want))
    assert whole.n == 500 and np.allclose(whole.co / spread / spread[:, None], want / spread / spread[:, None], atol=1e-9)
    assert (whole.low == values.min(axis=1)).all() and (whole.high == values.max(axis=1)).all()


def test_correlation_runs_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    lines = read_table(spark, SMALL, "lineitem").select(*COLUMNS)
    got = op.corr_long(lines.mapInArrow(count, lines.schema), COLUMNS)
    assert got.count() == 25 and seen.value == lines.count()


@pytest.mark.parametrize(("width", "height"), [(3, 4), (40, 50)])
def test_table_of_two_codes(width, height):
    rng = np.random.default_rng(2)
    a, b = rng.integers(-1, width, 90), rng.integers(-1, height, 90)
    want = Counter((x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True) if x >= 0 and y >= 0)
    cells = zip(*(x.tolist() for x in correlation._table_of(a, b, width, height)), strict=True)
    assert {(x, y): n for x, y, n in cells} == want


def test_pairs_leave_a_batch_as_cells(spark):
    """Forty columns of three values: a task sends at most nine cells a pair and batch."""
    df = spark.range(3000).repartition(2).selectExpr(*[f"pmod(xxhash64(id, {i}), 3) AS k{i}" for i in range(40)])
    cells = op.pair_counts(df, df.columns, complete=False)
    assert cells.count() == 780 * 9 and cells.agg(F.sum("_n")).head()[0] == 780 * 3000


def test_association_with_a_column_of_unique_values(spark):
    df = spark.range(2000).selectExpr("cast(id as string) as id", "id % 3 as a", "pmod(xxhash64(id), 4) as b")
    got = {(r["col_a"], r["col_b"]): r["v"] for r in op.cramers_v(df, ["id", "a", "b"]).collect()}
    assert got["id", "a"] == pytest.approx(1.0) and got["id", "b"] == pytest.approx(1.0)
    data = df.collect()
    assert got["a", "b"] == pytest.approx(cramers([(r["a"], r["b"]) for r in data]))
    ranks = {(r["col_a"], r["col_b"]): r["corr"] for r in op.corr_categorical(df, ["id", "a"]).collect()}
    assert ranks["id", "id"] == 1.0 and abs(ranks["id", "a"]) < 0.1
