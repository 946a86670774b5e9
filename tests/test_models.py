from __future__ import annotations

import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from catalogue.inputs import arrests, poverty
from tabkit import operators as op
from tabkit.plans import arrests as arrests_plan
from tabkit.plans import poverty as poverty_plan
from tabkit.sources import read_table
from tests.conftest import SMALL, rows


@pytest.fixture(scope="module")
def orders(spark):
    return read_table(spark, SMALL, "orders")


def test_random_split_is_complete_and_disjoint(orders):
    train, test = op.split_random(orders)
    assert train.intersect(test).count() == 0
    assert train.count() + test.count() == orders.count()


def test_key_split_survives_a_repartition(orders):
    train, test = op.split_by_key(orders, ["o_orderkey"])
    again, _ = op.split_by_key(orders.repartition(7), ["o_orderkey"])
    assert rows(train.select("o_orderkey")) == rows(again.select("o_orderkey"))
    assert train.count() + test.count() == orders.count()
    assert train.count() / orders.count() == pytest.approx(0.8, abs=0.05)


def judged(spark):
    """Three true classes, one never predicted, one predicted but never true."""
    cells = {(0.0, 0.0): 7, (0.0, 1.0): 2, (1.0, 1.0): 4, (1.0, 0.0): 3, (2.0, 0.0): 2, (2.0, 3.0): 1}
    data = [pair for pair, n in cells.items() for _ in range(n)]
    return spark.createDataFrame(data, "label double, prediction double")


def test_metrics_equal_the_evaluator(ansi, spark):
    df = judged(spark)
    got = {r["metric"]: r["value"] for r in op.classification_metrics(df).collect()}
    for name, value in got.items():
        want = MulticlassClassificationEvaluator(metricName=name).evaluate(df)
        assert value == pytest.approx(want), name
    assert got["weightedRecall"] == pytest.approx(got["accuracy"])


@pytest.mark.parametrize("kinds", [("int", "double"), ("bigint", "double"), ("double", "int"), ("decimal(5,1)", "float")])
def test_metrics_compare_numbers_as_numbers(spark, kinds):
    pairs = [(0, 0), (0, 1), (1, 1), (1, 1), (2, 0)]
    df = spark.createDataFrame(pairs, "l int, p int").selectExpr(
        f"cast(l as {kinds[0]}) as label", f"cast(p as {kinds[1]}) as prediction"
    )
    plain = df.selectExpr("cast(label as double) label", "cast(prediction as double) prediction")
    for r in op.classification_metrics(df).collect():
        want = MulticlassClassificationEvaluator(metricName=r["metric"]).evaluate(plain)
        assert r["value"] == pytest.approx(want), r["metric"]


def test_numbers_are_not_compared_with_texts(spark):
    with pytest.raises(ValueError, match="different types"):
        op.metrics_row(spark.createDataFrame([("1", 1.0)], "label string, prediction double"))


def test_metrics_read_the_predictions_once(spark, tmp_path):
    judged(spark).write.parquet(str(tmp_path / "p"))
    metrics = op.classification_metrics(spark.read.parquet(str(tmp_path / "p")))
    assert metrics._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def separable(spark):
    """The label is a function of one feature; the other one is noise."""
    return spark.range(600).select(
        "id",
        F.element_at(F.array(*[F.lit(x) for x in "abcdef"]), (F.col("id") % 6 + 1).cast("int")).alias("kind"),
        (F.xxhash64("id") % 100).cast("double").alias("noise"),
        F.when(F.col("id") % 6 < 2, "yes").otherwise("no").alias("answer"),
    )


@pytest.mark.parametrize("scale", [False, True])
def test_forest_learns_a_rule(spark, scale):
    train, test = op.split_by_key(separable(spark), ["id"])
    features = op.fit_features(train, ["kind"], "answer", numeric=["noise"], scale=scale)
    model = op.train_forest(op.apply_features(features, train), features, op.ForestParams(7, 20, 6))
    accuracy = op.metrics_row(op.predict(model, features, test)).head()["accuracy"]
    assert accuracy > 0.95
    found = [(r["feature"], r["importance"]) for r in op.importances(model, features).collect()]
    assert [n for n, _ in found] == ["kind_index", "noise"]
    assert sum(v for _, v in found) == pytest.approx(1.0)


def test_same_seed_same_forest(spark):
    train, _ = op.split_by_key(separable(spark), ["id"])
    features = op.fit_features(train, ["kind"], "answer", numeric=["noise"])
    ready = op.apply_features(features, train)
    trees = [op.train_forest(ready, features, op.ForestParams(3, 5, 12)).toDebugString for _ in "ab"]
    assert [t.split("\n", 1)[1] for t in trees][0] == trees[1].split("\n", 1)[1]


def test_many_categories_get_enough_bins(spark):
    df = spark.range(400).select("id", (F.col("id") % 40).alias("wide"), (F.col("id") % 2).alias("y"))
    features = op.fit_features(df, ["wide"], "y")
    assert features.max_bins == 41
    op.train_forest(op.apply_features(features, df), features, op.ForestParams(1, 2))


def test_as_many_classes_as_labels_and_no_null_class(spark):
    df = separable(spark)
    features = op.fit_features(df, ["kind"], "answer")
    model = op.train_forest(op.apply_features(features, df), features, op.ForestParams(1, 2))
    assert model.numClasses == 2
    holed = df.withColumn("answer", F.when(F.col("id") % 10 > 0, F.col("answer")))
    with pytest.raises(Exception, match="NULL in answer"):
        op.apply_features(op.fit_features(holed, ["kind"], "answer"), holed).collect()
    skipping = op.fit_features(holed, ["kind"], "answer", label_invalid="skip")
    assert op.apply_features(skipping, holed).count() == 540
    assert tuple(op.skipped_rows(skipping, holed).head()) == (600, 0, 60)
    with pytest.raises(Exception, match="a new value in answer"):
        op.predict(model, features, df.withColumn("answer", F.lit("perhaps"))).collect()


def test_bad_numbers_fail_or_are_counted(spark):
    df = separable(spark).withColumn("noise", F.when(F.col("id") % 5 > 0, F.col("noise")))
    strict = op.fit_features(df, ["kind"], "answer", numeric=["noise"])
    with pytest.raises(Exception):
        op.apply_features(strict, df).collect()
    loose = op.fit_features(df, ["kind"], "answer", numeric=["noise"], number_invalid="skip")
    assert op.apply_features(loose, df).count() == 480
    assert tuple(op.skipped_rows(loose, df).head()) == (600, 120, 0)


def test_tables_may_have_columns_of_the_usual_names(spark):
    df = separable(spark).withColumnsRenamed({"answer": "label", "noise": "features"})
    features = op.fit_features(df, ["kind"], "label", numeric=["features"])
    assert (features.column, features.label) == ("_features", "_label")
    model = op.train_forest(op.apply_features(features, df), features, op.ForestParams(1, 5, 4))
    assert op.metrics_row(op.predict(model, features, df), features.label).head()["accuracy"] > 0.9


def test_partitioning_does_not_change_a_forest(spark):
    df = separable(spark)
    features = op.fit_features(df, ["kind"], "answer", numeric=["noise"])
    found = [
        op.train_forest(op.apply_features(features, df.repartition(n)), features, op.ForestParams(3, 5, 6))
        for n in (4, 16)
    ]
    assert found[0].featureImportances == found[1].featureImportances


def test_label_seen_only_in_test(spark):
    df = separable(spark)
    train, test = df.where("kind != 'f'"), df.where("kind = 'f'")
    features = op.fit_features(train, ["kind"], "answer", numeric=["noise"])
    model = op.train_forest(op.apply_features(features, train), features, op.ForestParams(1, 3))
    assert op.predict(model, features, test).count() == test.count() > 0


def test_sweep_agrees_with_single_runs_and_frees_its_cache(spark):
    train, test = op.split_by_key(separable(spark), ["id"])
    features = op.fit_features(train, ["kind"], "answer", numeric=["noise"])
    params = [op.ForestParams(5, 3), op.ForestParams(5, 4, 11)]
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    table = op.sweep(train, test, features, params)
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) <= before
    for p in params:
        model = op.train_forest(op.apply_features(features, train), features, p)
        want = op.metrics_row(op.predict(model, features, test)).head()
        mine = table.where((F.col("num_trees") == p.num_trees) & (F.col("metric") == "f1")).head()
        assert mine["value"] == pytest.approx(want["f1"]) and mine["max_depth"] == p.max_depth


def test_arrests_plan(spark):
    raw = arrests(spark, SMALL)
    assert {t for _, t in raw.dtypes} == {"string"}
    ready = arrests_plan.prepared(raw)
    assert ready.where("LAW_CAT_CD is null or PERP_RACE is null").count() == 0
    assert ready.where("AGE_GROUP = '<18' or AGE_GROUP is null").count() == 0
    assert dict(ready.dtypes)["KY_CD"] == "int" and dict(ready.dtypes)["Latitude"] == "double"
    assert ready.agg(F.max("MONTH_ARREST")).head()[0] > 12
    months = arrests_plan.prepared(raw, month="calendar")
    assert months.agg(F.max("MONTH_ARREST")).head()[0] == 12
    train, test = arrests_plan.split(ready, ["ARREST_KEY"])
    table = arrests_plan.severity_sweep(train, test, seed=1, forests=[(3, 3), (2, 4)])
    assert table.count() == 8 and table.where("value < 0 or value > 1").count() == 0


@pytest.mark.parametrize("fit_on", ["train", "all"])
def test_poverty_plan(spark, fit_on):
    ready = poverty_plan.people(poverty(spark, SMALL))
    assert not set(poverty_plan.MOSTLY_MISSING) & set(ready.columns)
    assert not set(poverty_plan.UNUSED) & set(ready.columns)
    assert ready.agg(F.min("AGEP")).head()[0] >= 18
    model = poverty_plan.status_forest(ready, 1, ["PERSON_KEY"], forest=(3, 3), fit_on=fit_on)
    assert model.metrics.count() == 4
    assert {r["feature"] for r in model.importances.collect()} >= {"AGEP", "TEN_index", "TotalWorkHrs_PU"}
    assert model.predictions.count() > 0


def test_poverty_enrichment(spark):
    ready = poverty_plan.prepared(poverty(spark, SMALL))
    scaled = ready.agg(F.min("PreTaxIncome_PU_scaled"), F.max("PreTaxIncome_PU_scaled")).head()
    assert tuple(scaled) == (0.0, 1.0)
    means = ready.groupBy("EducAttain").agg(F.avg("NormalizedIncomeByEducation").alias("m"))
    assert all(r["m"] == pytest.approx(1.0) for r in means.collect())
    left = poverty_plan.without_leaks(ready)
    assert not set(poverty_plan.LEAKING) & set(left.columns)
