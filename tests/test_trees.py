"""How rows of a forest are dealt, its scaling, and its nodes."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.ml.feature import MinMaxScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabkit import operators as op
from tabkit.operators import forest, trees


def mixed(spark, n=900):
    """Half of the rows are one row repeated."""
    return spark.range(n).select(
        "id",
        F.when(F.col("id") % 2 == 0, "same").otherwise(F.concat(F.lit("k"), F.col("id") % 11)).alias("kind"),
        F.when(F.col("id") % 2 == 0, 5.0).otherwise((F.xxhash64("id") % 100).cast("double")).alias("x"),
        F.when((F.col("id") % 2 == 0) | (F.xxhash64("id", F.lit(1)) % 100 < F.col("id") % 11 * 9), "yes").otherwise("no").alias("answer"),
    )


@pytest.mark.parametrize(("together", "most"), [(4096, 4096), (10, 4096), (1, 45)])
def test_a_repeated_row_is_spread(spark, monkeypatch, together, most):
    monkeypatch.setattr(forest, "TOGETHER", together)
    monkeypatch.setattr(forest, "MOST_PIECES", most)
    df = mixed(spark, 4000)
    features = op.fit_features(df, ["kind"], "answer", numeric=["x"], parts=8)
    ready = op.apply_features(features, df)
    dealt = op.deal(ready, features)
    assert dealt.schema["features"].metadata == ready.schema["features"].metadata
    rows = dealt.select(F.spark_partition_id().alias("p"), vector_to_array("features").alias("x"), "label")
    want = ready.select(vector_to_array("features").alias("x"), "label")
    assert rows.select("x", "label").exceptAll(want).isEmpty() and want.exceptAll(rows.select("x", "label")).isEmpty()
    sizes = [r["count"] for r in rows.groupBy("p").count().collect()]
    if together == 4096:
        assert max(sizes) >= 2000
    else:
        assert len(sizes) == 8 and max(sizes) < 2 * 4000 / 8
    again = op.deal(op.apply_features(features, df.repartition(13)), features)
    listed = [[(r["p"], r["x"], r["label"]) for r in t.select(F.spark_partition_id().alias("p"), vector_to_array("features").alias("x"), "label").collect()] for t in (dealt, again)]
    assert listed[0] == listed[1]


def test_same_forest_from_4_and_64_partitions(spark, monkeypatch):
    monkeypatch.setattr(forest, "TOGETHER", 16)
    df = mixed(spark)
    features = op.fit_features(df, ["kind"], "answer", numeric=["x"])
    found = [
        op.train_forest(op.apply_features(features, df.repartition(n)), features, op.ForestParams(3, 4, 6)).toDebugString.split("\n", 1)[1]
        for n in (4, 64)
    ]
    assert found[0] == found[1]


def test_parts_grow_with_the_rows(spark, monkeypatch):
    df = mixed(spark)
    assert op.fit_features(df, ["kind"], "answer").parts == forest.PARTS
    monkeypatch.setattr(forest, "PART_ROWS", 30)
    assert op.fit_features(df, ["kind"], "answer").parts == 30
    assert op.fit_features(df, ["kind"], "answer", parts=3).parts == 3
    assert op.fit_features(df.where("id < 0"), ["kind"], "answer").parts == forest.PARTS


def test_many_equal_rows_are_drawn_together(spark, monkeypatch):
    df = mixed(spark, 4000)
    assert op.fit_features(df, ["kind"], "answer", numeric=["x"]).drawn == 1
    monkeypatch.setattr(forest, "DRAWS", 100)
    features = op.fit_features(df, ["kind"], "answer", numeric=["x"])
    assert features.drawn > 1
    ready = op.apply_features(features, df)
    cells = [vector_to_array("features").alias("x"), "label"]
    dealt = op.deal(ready, features).select(*cells, "weight")
    want = ready.select(*cells).groupBy("x", "label").agg(F.count(F.lit(1)).cast("double").alias("n"))
    got = dealt.groupBy("x", "label").agg(F.sum("weight").alias("n"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert dealt.count() <= 100 + want.count()
    assert dealt.agg(F.max("weight")).head()[0] == features.drawn


def test_rows_are_drawn_one_by_one_at_any_size(spark):
    n = 4_100_000
    df = spark.range(n).select(
        F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("kind"), F.when(F.col("id") % 3 == 0, "no").otherwise("yes").alias("answer")
    )
    features = op.fit_features(df, ["kind"], "answer")
    assert features.drawn == 1
    found = op.deal(op.apply_features(features, df), features).agg(F.count(F.lit(1)), F.min("weight"), F.max("weight")).head()
    assert tuple(found) == (n, 1.0, 1.0)


@pytest.mark.parametrize("unseen", ["keep", "error"])
def test_scaling_is_that_of_the_min_max_scaler(spark, unseen):
    df = mixed(spark).withColumn("flat", F.lit(7.5)).withColumn("whole", (F.col("id") % 17).cast("int"))
    if unseen == "keep":
        df = df.withColumn("kind", F.when(F.col("id") % 13 > 0, F.col("kind")))
    numbers = ["x", "flat", "whole"]
    order = ["x", "kind", "flat", "whole"]
    plain = op.fit_features(df, ["kind"], "answer", numeric=numbers, order=order, unseen=unseen)
    mine = op.fit_features(df, ["kind"], "answer", numeric=numbers, order=order, unseen=unseen, scale=True)
    packed = VectorAssembler(inputCols=["x", "kind_index", "flat", "whole"], outputCol="v").transform(op.apply_features(plain, df))
    model = MinMaxScaler(inputCol="v", outputCol="s").fit(packed)
    assert mine.scaler.low == tuple(model.originalMin.toArray()) and mine.scaler.high == tuple(model.originalMax.toArray())
    want = {r["id"]: r["s"] for r in model.transform(packed).select("id", vector_to_array("s").alias("s")).collect()}
    got = {r["id"]: r["s"] for r in op.apply_features(mine, df).select("id", vector_to_array("features").alias("s")).collect()}
    assert got == want


def test_scaling_leaves_out_what_is_skipped(spark):
    df = mixed(spark).withColumn("x", F.when(F.col("id") % 2 == 1, F.col("x") + F.col("id")))
    features = op.fit_features(df, ["kind"], "answer", numeric=["x"], scale=True, number_invalid="skip")
    vectors = np.array([r[0] for r in op.apply_features(features, df).select(vector_to_array("features")).collect()])
    assert len(vectors) == 450
    assert vectors.min(axis=0).tolist() == [0.0, 0.0] and vectors.max(axis=0).tolist() == [1.0, 1.0]


def test_a_fit_reads_the_table_once(spark, tmp_path, monkeypatch):
    mixed(spark).write.parquet(str(tmp_path / "t"))
    plans = []
    inner = forest.settle

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return inner(df)

    monkeypatch.setattr(forest, "settle", seen)
    df = spark.read.parquet(str(tmp_path / "t"))
    features = op.fit_features(df, ["kind"], "answer", numeric=["x"], scale=True)
    assert len(plans) == 1 and plans[0].count("FileScan") == 1
    plan = op.apply_features(features, df)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


@pytest.mark.parametrize(("scale", "max_bytes"), [(False, 1 << 26), (True, 1 << 26), (False, 10_000), (False, 0)])
def test_votes_and_importances_from_the_nodes(spark, scale, max_bytes):
    df = mixed(spark)
    train, test = op.split_by_key(df, ["id"])
    features = op.fit_features(train, ["kind"], "answer", numeric=["x"], scale=scale)
    model = op.train_forest(op.apply_features(features, train), features, op.ForestParams(5, 12, 7))
    scored = op.predict(model, features, test)
    nodes = op.forest_nodes(model)
    if max_bytes == 10_000:
        assert len(trees._blocks(nodes, max_bytes)) > 1
    votes = op.forest_votes(scored, nodes, model.numClasses, 7, ["id"], features.column, max_bytes)
    got = {r["id"]: (r["votes"], r["prediction"]) for r in votes.collect()}
    for r in scored.select("id", vector_to_array("rawPrediction").alias("raw"), "prediction").collect():
        assert np.allclose(got[r["id"]][0], r["raw"], atol=1e-9) and got[r["id"]][1] == r["prediction"]
    mine = {r["feature"]: r["importance"] for r in op.node_importances(nodes, features.names).collect()}
    assert mine == pytest.approx({r["feature"]: r["importance"] for r in op.importances(model, features).collect()})
    told = op.agreement(model, features, scored, ["id"], op.importances(model, features)).head().asDict()
    n = test.count()
    assert told == {"n_rows": n, "n_votes": n, "n_predictions": n, "n_features": 2, "n_importances": 2}


def test_agreement_sees_a_wrong_model(spark):
    """Answers of one forest held against the nodes of another."""
    df = mixed(spark)
    features = op.fit_features(df, ["kind"], "answer", numeric=["x"])
    ready = op.apply_features(features, df)
    one, other = (op.train_forest(ready, features, op.ForestParams(s, 3, 3)) for s in (1, 2))
    told = op.agreement(one, features, op.predict(other, features, df), ["id"], op.importances(other, features)).head()
    assert told["n_rows"] == 900 and told["n_votes"] < 900 and told["n_importances"] < 2


def test_a_forest_without_splits(spark):
    df = mixed(spark).withColumn("answer", F.lit("yes"))
    features = op.fit_features(df, ["kind"], "answer", numeric=["x"])
    model = op.train_forest(op.apply_features(features, df), features, op.ForestParams(1, 2, 3))
    scored = op.predict(model, features, df)
    told = op.agreement(model, features, scored, ["id"], op.importances(model, features)).head()
    assert told["n_votes"] == told["n_predictions"] == 900 and told["n_importances"] == 2


def test_forests_side_by_side_are_those_fitted_alone(spark):
    df = mixed(spark)
    train, test = op.split_by_key(df, ["id"])
    features = op.fit_features(train, ["kind"], "answer", numeric=["x"])
    params = [op.ForestParams(5, 3), op.ForestParams(5, 4, 11), op.ForestParams(6, 3)]
    tables, debug = [], []
    for at_once in (1, 3):
        began = time.time()
        table, models = op.sweep_models(train, test, features, params, at_once)
        tables.append(sorted(map(tuple, table.collect())))
        debug.append([m.toDebugString.split("\n", 1)[1] for m in models])
        assert time.time() - began < 120
    assert tables[0] == tables[1] and debug[0] == debug[1]
