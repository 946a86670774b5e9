"""A fitted forest as a table of nodes, and what follows from that table alone.

The votes and the importances made here use none of the model's own code, so
they can be held against it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabkit.operators.forest import Features
from tabkit.operators.lookup import BROADCAST_BYTES
from tabkit.sources import settle, shared_path

# Rough bytes of a node that is broadcast.
NODE_BYTES = 256

# Votes that are closer than this are a tie to any order of adding them up.
CLOSE = 1e-9


def forest_nodes(model: RandomForestClassificationModel) -> DataFrame:
    """``(tree, node, feature, threshold, left_values, left, right, gain, stats)``.

    One row per node; the root of a tree is node 0.  A leaf has NULL from
    ``feature`` to ``gain``.  A row goes left if its value is at most
    ``threshold``, or for a nominal feature, where that is NULL, if it is among
    ``left_values``.  ``stats`` are the rows per class that the tree drew.  The
    model is saved in the shared folder and its node table read from there.
    """
    spark = SparkSession.active()
    path = shared_path(spark, "forest")
    model.save(path)
    node = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    inner = F.col("leftChild") >= 0
    nominal = F.col("split.numCategories") >= 0
    values = F.col("split.leftCategoriesOrThreshold")
    return node.select(
        "tree",
        F.col("id").alias("node"),
        F.when(inner, F.col("split.featureIndex")).alias("feature"),
        F.when(inner & ~nominal, F.try_element_at(values, F.lit(1))).alias("threshold"),
        F.when(inner & nominal, values).alias("left_values"),
        F.when(inner, F.col("leftChild")).alias("left"),
        F.when(inner, F.col("rightChild")).alias("right"),
        F.when(inner, F.col("gain")).alias("gain"),
        F.col("impurityStats").alias("stats"),
    )


def node_importances(nodes: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(feature, importance)`` of every feature, summed from the nodes.

    A split counts its gain times the rows it saw.  Each tree's sums are brought
    to a total of one before trees are added up, and so is the result.
    """
    rows = F.aggregate("stats", F.lit(0.0), lambda a, x: a + x)
    own = nodes.where(F.col("feature").isNotNull()).groupBy("tree", "feature").agg(F.sum(F.col("gain") * rows).alias("gained"))
    total = own.groupBy(F.col("tree").alias("of")).agg(F.sum("gained").alias("total"))
    shares = own.join(total, F.col("tree") == F.col("of")).select(
        "feature", F.try_divide("gained", "total").alias("share")
    )
    summed = shares.groupBy("feature").agg(F.sum("share").alias("share"))
    whole = summed.select(F.sum("share")).scalar()
    listed = nodes.sparkSession.createDataFrame(list(enumerate(names)), "feature int, name string")
    importance = F.coalesce(F.try_divide(F.col("share"), whole), F.lit(0.0))
    return listed.join(summed, "feature", "left").select(F.col("name").alias("feature"), importance.alias("importance"))


def _blocks(nodes: DataFrame, max_bytes: int) -> list[tuple[int, int]]:
    """Runs of trees (first, last) whose nodes together are measured below ``max_bytes``."""
    sizes = nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).orderBy("tree").collect()
    out: list[tuple[int, int]] = []
    held = 0
    for tree, n in sizes:
        if out and held + n * NODE_BYTES <= max_bytes:
            out[-1], held = (out[-1][0], tree), held + n * NODE_BYTES
        else:
            out.append((tree, tree))
            held = n * NODE_BYTES
    return out


def forest_votes(
    ready: DataFrame,
    nodes: DataFrame,
    classes: int,
    depth: int,
    keys: Sequence[str],
    features: str = "features",
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``(*keys, votes, prediction)``: rows walked through the trees, level by level.

    Each row stands at the root of each tree; a level is a join with the splits,
    whose children are the next places.  A leaf's class shares are a tree's vote,
    ``votes`` their sum and ``prediction`` the class with the largest, the lower
    of equal ones.  ``keys`` tell the rows apart.  The splits are broadcast: trees
    go in blocks that are measured to be below ``max_bytes``, the votes of the
    blocks are added up; a single larger tree is left to Spark's joins.
    """
    splits = nodes.where(F.col("feature").isNotNull()).select(
        F.col("tree").alias("t"), F.col("node").alias("p"), "feature", "threshold", "left_values", "left", "right"
    )
    total = F.aggregate("stats", F.lit(0.0), lambda a, x: a + x)
    leaves = nodes.where(F.col("feature").isNull()).select(
        F.col("tree").alias("t"),
        F.col("node").alias("p"),
        *[F.try_divide(F.col("stats")[k], total).alias(f"v{k}") for k in range(classes)],
    )
    value = F.element_at("x", F.col("feature") + 1)
    goes_left = F.coalesce(value <= F.col("threshold"), F.array_contains("left_values", value))
    rows = ready.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], vector_to_array(features).alias("x"))
    own = [f"k{i}" for i in range(len(keys))]
    parts = []
    for first, last in _blocks(nodes, max_bytes):
        few = F.col("t").between(first, last)
        # One tree alone may be over the bound: then the join is Spark's to choose.
        told = F.broadcast if first < last or _fits(nodes, first, max_bytes) else (lambda df: df)
        here = (F.col("tree") == F.col("t")) & (F.col("at") == F.col("p"))
        state = rows.select(*own, "x", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("tree"), F.lit(0).alias("at"))
        for _ in range(depth):
            step = F.when(F.col("p").isNull(), F.col("at")).when(goes_left, F.col("left")).otherwise(F.col("right"))
            state = state.join(told(splits.where(few)), here, "left").select(*own, "x", "tree", step.alias("at"))
        voted = state.join(told(leaves.where(few)), here)
        parts.append(voted.groupBy(*own).agg(*[F.sum(f"v{k}").alias(f"v{k}") for k in range(classes)]))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionAll(p)
    if len(parts) > 1:
        whole = whole.groupBy(*own).agg(*[F.sum(f"v{k}").alias(f"v{k}") for k in range(classes)])
    votes = F.array(*[F.col(f"v{k}") for k in range(classes)])
    return whole.select(
        *[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)],
        votes.alias("votes"),
        (F.array_position(votes, F.array_max(votes)) - 1).cast("double").alias("prediction"),
    )


def _fits(nodes: DataFrame, tree: int, max_bytes: int) -> bool:
    return nodes.where(F.col("tree") == tree).count() * NODE_BYTES <= max_bytes


def _clear(votes: str) -> Column:
    """Whether the largest vote is no tie."""
    ordered = F.reverse(F.array_sort(votes))
    second = F.try_element_at(ordered, F.lit(2))
    return second.isNull() | (ordered[0] - second > CLOSE)


def agreement(
    model: RandomForestClassificationModel,
    features: Features,
    df: DataFrame,
    keys: Sequence[str],
    importances: DataFrame,
) -> DataFrame:
    """One row: how far the model's answers are those of its node table.

    ``n_rows``; ``n_votes``, rows whose votes of all classes agree;
    ``n_predictions``, rows with the same prediction, or a tie; ``n_features``,
    and of those ``n_importances`` whose importance is that of ``importances``.
    ``df`` is what :func:`tabkit.operators.predict` returned.
    """
    nodes = settle(forest_nodes(model))
    depth = max((t.depth for t in model.trees), default=0)
    walked = forest_votes(df, nodes, model.numClasses, depth, keys, features.column)
    walked = walked.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], "votes", F.col("prediction").alias("walked"))
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    raw = vector_to_array("rawPrediction")
    told = df.select(*[F.col(f"`{k}`") for k in keys], raw.alias("_raw"), F.col("prediction").alias("_told"))
    apart = F.exists(F.arrays_zip(F.col("_raw").alias("a"), F.col("votes").alias("b")), lambda z: F.abs(z["a"] - z["b"]) > CLOSE)
    both = told.join(walked, same)
    rows = both.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~apart).alias("n_votes"),
        F.count_if((F.col("walked") == F.col("_told")) | ~_clear("votes")).alias("n_predictions"),
    )
    mine = node_importances(nodes, features.names).select(F.col("feature").alias("_of"), F.col("importance").alias("_own"))
    features_row = importances.join(mine, F.col("feature") == F.col("_of")).agg(
        F.count(F.lit(1)).alias("n_features"),
        F.count_if(F.abs(F.col("importance") - F.col("_own")) <= CLOSE).alias("n_importances"),
    )
    told_features = features_row.select(F.struct("*")).scalar()
    return rows.withColumn("_told", told_features).select("n_rows", "n_votes", "n_predictions", "_told.*")
