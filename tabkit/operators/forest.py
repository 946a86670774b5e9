"""Random forests: features, training, comparison, importances."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabkit.functions import is_complete
from tabkit.operators.counts import COLUMN, COUNT, ROWS, count_values, value_text
from tabkit.operators.indexing import Labels, apply_labels, labels_of
from tabkit.operators.metrics import classification_metrics
from tabkit.sources import settle, shared_dir

# Partitions that the rows of a forest are dealt into: at least these, and more
# with more rows, unless the caller says how many.
PARTS = 16
PART_ROWS = 1_000_000

# Rows are drawn one by one, however many they are.  Only who sets a number here has
# so many equal ones of more rows drawn together that about as many draws are left,
# which is another forest.
DRAWS: int | None = None

# Equal rows that stay together when rows are dealt, unless that made more pieces.
TOGETHER = 4096
MOST_PIECES = 4096

# Forests that are fitted at a time.
AT_ONCE = 3

# The default of Spark's trees; more categories in one feature need more bins.
DEFAULT_BINS = 32


@dataclass(frozen=True)
class ForestParams:
    """What distinguishes one forest from another.  The seed has no default.

    Deep trees keep the node of every row in the cache instead of sending the
    trees to every task.
    """

    seed: int
    num_trees: int = 20
    max_depth: int = 5
    cache_node_ids: bool | None = None
    max_memory_mb: int = 256

    @property
    def keeps_nodes(self) -> bool:
        """The choice made, or by depth where none was made."""
        return self.max_depth > 10 if self.cache_node_ids is None else self.cache_node_ids


@dataclass(frozen=True)
class Scaling:
    """Bounds per feature, in order; what Spark ML's min-max scaler would find."""

    low: tuple[float, ...]
    high: tuple[float, ...]

    def scaled(self, i: int, value: Column) -> Column:
        """Feature ``i`` on [0, 1]; a constant one is 0.5, NULL and NaN stay."""
        width = self.high[i] - self.low[i]
        if not width:
            return F.when(value.isNull() | F.isnan(value), value).otherwise(F.lit(0.5))
        return (value - F.lit(self.low[i])) * F.lit(1.0 / width)


@dataclass(frozen=True)
class Features:
    """A fitted feature preparation, and the names of what it adds."""

    labels: Labels
    categorical: tuple[str, ...]
    answer: str
    names: tuple[str, ...]
    max_bins: int
    scaler: Scaling | None
    unseen: str
    number_invalid: str
    label_invalid: str
    column: str = "features"
    label: str = "label"
    parts: int = PARTS
    drawn: int = 1

    @property
    def numbers(self) -> list[str]:
        indices = {_index_name(c) for c in self.categorical}
        return [c for c in self.names if c not in indices]


def _index_name(column: str) -> str:
    return column + "_index"


def _free(name: str, taken: Sequence[str]) -> str:
    """``name``, or one with as many underscores before it as it takes to be new."""
    while name in taken:
        name = "_" + name
    return name


def assemble(
    df: DataFrame,
    columns: Sequence[str],
    output: str = "features",
    handle_invalid: str = "skip",
) -> DataFrame:
    """Pack columns in a vector; rows with NULL or NaN are skipped, kept or refused."""
    return VectorAssembler(
        inputCols=list(columns), outputCol=output, handleInvalid=handle_invalid
    ).transform(df)


def assembly_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(n_rows, n_skipped)``: what ``handle_invalid="skip"`` leaves out."""
    whole = is_complete([df.schema[c] for c in columns])
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~whole).alias("n_skipped"))


def fit_features(
    df: DataFrame,
    categorical: Sequence[str],
    label: str,
    numeric: Sequence[str] = (),
    order: Sequence[str] | None = None,
    scale: bool = False,
    unseen: str = "keep",
    number_invalid: str = "error",
    label_invalid: str = "error",
    output: str | None = None,
    label_output: str | None = None,
    parts: int | None = None,
) -> Features:
    """Index categories and label, pack the features, optionally scale them.

    All indices, and the bounds of the features, come from one scan of ``df``,
    which should be the training part alone; there is no limit on the number of
    labels, and only short lists of them come to the driver.  ``order`` fixes the order of the features (by default categories,
    then numbers).  A category that is NULL or seen only later gets the index
    after the last one under ``unseen="keep"``.  The label has no such class: a
    NULL or new one fails the job, or under ``label_invalid="skip"`` its row is
    left out; so does a NULL or NaN number under ``number_invalid``.
    :func:`skipped_rows` counts what is left out.

    The new columns are ``output`` and ``label_output``, by default ``features``
    and ``label`` with underscores before them if the table has such columns.
    Unscaled features keep their nominal metadata, and ``max_bins`` is large
    enough for the widest of them; scaling makes every feature continuous.
    ``parts`` is the number of partitions of the training rows, part of what
    defines a forest: by default it follows from the number of rows of ``df``.
    Trees draw every row by itself, whatever that number is, unless DRAWS is set.
    """
    for choice in (number_invalid, label_invalid):
        if choice not in ("error", "skip"):
            raise ValueError("number_invalid and label_invalid are 'error' or 'skip'")
    order = list(order) if order is not None else [*categorical, *numeric]
    names = [_index_name(c) if c in categorical else c for c in order]
    columns = list(dict.fromkeys([*categorical, label]))
    bounded = [c for c in order if c not in categorical] if scale else []
    counts = settle(_counts_and_bounds(df, columns, bounded, categorical, unseen))
    known = counts.where(F.col("value").isNotNull()).select("column", "value", "n", "rows", "whole")
    labels = labels_of(known, columns)
    first = F.col("column") == columns[0]
    ends = [f(F.when(first, F.col(f"{f.__name__}{i}"))) for i in range(len(bounded)) for f in (F.min, F.max)]
    n_rows, *found = counts.agg(F.coalesce(F.sum(F.when(first, F.col("rows"))), F.lit(0)), *ends).head()
    drawn = 1 if DRAWS is None else max(1, -(-n_rows // DRAWS))
    widest = max((labels.count(c) for c in categorical), default=0) + 1
    scaler = None
    if scale:
        spans = {c: tuple(found[2 * i : 2 * i + 2]) for i, c in enumerate(bounded)}
        spans |= _index_bounds(counts, labels, categorical)
        low, high = zip(*[(spans[c] if spans.get(c, (None,))[0] is not None else (0.0, 0.0)) for c in order], strict=True)
        scaler = Scaling(tuple(map(float, low)), tuple(map(float, high)))
    return Features(
        labels,
        tuple(categorical),
        label,
        tuple(names),
        DEFAULT_BINS if scale else max(DEFAULT_BINS, widest),
        scaler,
        unseen,
        number_invalid,
        label_invalid,
        output or _free("features", df.columns),
        label_output or _free("label", df.columns),
        parts or max(PARTS, -(-n_rows // (drawn * PART_ROWS))),
        drawn,
    )


def _counts_and_bounds(
    df: DataFrame, columns: Sequence[str], numbers: Sequence[str], categorical: Sequence[str], unseen: str
) -> DataFrame:
    """``(column, value, n, rows, whole, min0, max0, ...)``, NULL a value; one scan.

    ``whole`` counts the value's rows that can become a vector, and the bounds of
    ``numbers`` are over those.
    """
    needed = [*numbers, *(categorical if unseen == "null" else [])]
    whole = is_complete([df.schema[c] for c in needed]) if needed else F.lit(True)
    carried = {"_whole": whole, **{f"_x{i}": F.when(whole, F.col(f"`{c}`").cast("double")) for i, c in enumerate(numbers)}}
    measures = {"whole": F.count_if("_whole")}
    for i in range(len(numbers)):
        measures |= {f"min{i}": F.min(f"_x{i}"), f"max{i}": F.max(f"_x{i}")}
    return count_values(df, columns, carried=carried, measures=measures).select(
        F.col(COLUMN).alias("column"),
        value_text(df, columns).alias("value"),
        F.col(COUNT).alias("n"),
        F.col(ROWS).alias("rows"),
        *measures,
    )


def _index_bounds(counts: DataFrame, labels: Labels, categorical: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Per category the smallest and the largest index among the rows that become vectors."""
    at = labels.table.where(F.col("whole") > 0).select("column", F.col("index").cast("double").alias("at"))
    null = counts.where(F.col("value").isNull() & (F.col("whole") > 0)).select("column", F.lit(None).cast("double").alias("at"))
    found = at.unionAll(null).groupBy("column").agg(F.min("at"), F.max("at"), F.count_if(F.col("at").isNull())).collect()
    out = {}
    for c, low, high, nulls in found:
        n = float(labels.count(c))
        out[c] = (n, n) if low is None else (low, n if nulls else high)
    return {c: span for c, span in out.items() if c in categorical}


def apply_features(features: Features, df: DataFrame) -> DataFrame:
    """Add the features, and the label's index where ``df`` has the label."""
    names = [_index_name(c) for c in features.categorical]
    out = apply_labels(df, features.labels, features.categorical, names, features.unseen)
    inputs = list(features.names)
    if features.scaler is not None:
        inputs = [f"_scaled{i}" for i in range(len(features.names))]
        values = [F.col(f"`{c}`").cast("double") for c in features.names]
        out = out.withColumns({s: features.scaler.scaled(i, values[i]) for i, s in enumerate(inputs)})
    out = assemble(out, inputs, features.column, features.number_invalid)
    if features.scaler is not None:
        out = out.drop(*inputs)
    if features.answer not in df.columns:
        return out
    null = "null" if features.label_invalid == "skip" else "error"
    out = apply_labels(out, features.labels, [features.answer], [features.label], null)
    return out.where(F.col(f"`{features.label}`").isNotNull()) if null == "null" else out


def skipped_rows(features: Features, df: DataFrame) -> DataFrame:
    """``(n_rows, n_bad_number, n_bad_label)``: what ``"skip"`` leaves out of ``df``."""
    whole = is_complete([df.schema[c] for c in features.numbers]) if features.numbers else F.lit(True)
    known = F.lit(True)
    seen = df
    if features.answer in df.columns:
        seen = apply_labels(df, features.labels, [features.answer], ["_known"])
        known = F.col("_known").isNotNull()
    return seen.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~whole).alias("n_bad_number"),
        F.count_if(~known).alias("n_bad_label"),
    )


def deal(ready: DataFrame, features: Features) -> DataFrame:
    """The columns a forest reads and a weight, dealt into ``features.parts`` partitions.

    A forest depends on how its rows are dealt and ordered.  Equal rows are
    counted, cut into pieces of TOGETHER rows (or into MOST_PIECES), and the
    pieces are dealt and sorted by their content and number, so that equal tables
    and an equal seed make an equal forest however the table was partitioned
    before, on any cluster, and a row that fills half of the table is spread as
    evenly as the others.

    Up to ``features.drawn`` equal rows of a piece come as one row with their
    number as its weight: a tree has each of them as often as it would alone, but
    all of them equally often.  With ``drawn`` at 1, as it is unless DRAWS is set,
    every row is its own.
    """
    target = {c: ready.schema[c].metadata for c in (features.column, features.label)}
    cells = ready.select(vector_to_array(features.column).alias("x"), F.col(f"`{features.label}`").alias("y"))
    counted = cells.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    size = F.greatest(F.lit(TOGETHER), F.ceil(F.col("n") / MOST_PIECES))
    pieces = counted.withColumn("size", size).withColumn(
        "piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / F.col("size"))))
    )
    marks = [F.xxhash64("x", "y", "piece").alias("mark"), F.xxhash64(F.lit(1), "x", "y", "piece").alias("again")]
    mine = F.least("size", F.col("n") - F.col("piece") * F.col("size")).cast("int").alias("mine")
    dealt = pieces.select("x", "y", mine, *marks).repartition(features.parts, "mark")
    drawn = F.lit(features.drawn)
    rows = dealt.sortWithinPartitions("mark", "again").select(
        "x", "y", "mine", F.explode(F.sequence(F.lit(0), F.col("mine") - 1, drawn)).alias("first")
    )
    return rows.select(
        array_to_vector("x").alias(features.column, metadata=target[features.column]),
        F.col("y").alias(features.label, metadata=target[features.label]),
        F.least(drawn, F.col("mine") - F.col("first")).cast("double").alias(_weight(features)),
    )


def _weight(features: Features) -> str:
    return _free("weight", (features.column, features.label))


@contextmanager
def _kept(rows: DataFrame) -> Iterator[DataFrame]:
    """Rows kept while forests are fitted; blocks that are lost are computed again."""
    kept = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


def train_forest(
    ready: DataFrame, features: Features, params: ForestParams
) -> RandomForestClassificationModel:
    """Fit one forest on rows that :func:`apply_features` prepared."""
    with _kept(deal(ready, features)) as kept:
        return _fit(kept, features, params)


def _fit(
    kept: DataFrame, features: Features, params: ForestParams
) -> RandomForestClassificationModel:
    shared_dir(kept.sparkSession)
    return RandomForestClassifier(
        featuresCol=features.column,
        labelCol=features.label,
        weightCol=_weight(features),
        numTrees=params.num_trees,
        maxDepth=params.max_depth,
        maxBins=features.max_bins,
        cacheNodeIds=params.keeps_nodes,
        maxMemoryInMB=params.max_memory_mb,
        seed=params.seed,
    ).fit(kept)


def predict(
    model: RandomForestClassificationModel, features: Features, df: DataFrame
) -> DataFrame:
    """Prepare ``df`` and add ``rawPrediction``, ``probability``, ``prediction``."""
    return model.transform(apply_features(features, df))


def importances(
    model: RandomForestClassificationModel, features: Features, ranked: bool = True
) -> DataFrame:
    """``(feature, importance)``, most important first unless ``ranked`` is off."""
    values = model.featureImportances.toArray()
    rows = [(n, float(v)) for n, v in zip(features.names, values, strict=True)]
    frame = SparkSession.active().createDataFrame(rows, "feature string, importance double")
    return frame.orderBy(F.desc("importance"), "feature") if ranked else frame


def sweep(
    train: DataFrame,
    test: DataFrame,
    features: Features,
    params: Sequence[ForestParams],
    at_once: int = AT_ONCE,
) -> DataFrame:
    """``(num_trees, max_depth, metric, value)`` for several forests.

    Both parts are prepared once and kept while the forests are fitted, up to
    ``at_once`` of them side by side, and scored.  Runs those jobs; the result is
    settled.
    """
    return sweep_models(train, test, features, params, at_once)[0]


def sweep_models(
    train: DataFrame,
    test: DataFrame,
    features: Features,
    params: Sequence[ForestParams],
    at_once: int = AT_ONCE,
) -> tuple[DataFrame, list[RandomForestClassificationModel]]:
    """:func:`sweep`, and the forests themselves in the order of ``params``."""
    narrow = apply_features(features, test).select(features.column, features.label)
    with _kept(deal(apply_features(features, train), features)) as ready, _kept(narrow) as unseen:
        models = _fit_all(ready, features, params, at_once)
        results = [
            classification_metrics(model.transform(unseen), features.label).select(
                F.lit(p.num_trees).alias("num_trees"), F.lit(p.max_depth).alias("max_depth"), "metric", "value"
            )
            for p, model in zip(params, models, strict=True)
        ]
        return settle(reduce(DataFrame.unionByName, results)), models


def _fit_all(
    kept: DataFrame, features: Features, params: Sequence[ForestParams], at_once: int
) -> list[RandomForestClassificationModel]:
    """Forests on one cache, side by side: one fills the cores while another plans its next level."""
    kept.count()
    fit = inheritable_thread_target(kept.sparkSession)(lambda p: _fit(kept, features, p))
    with ThreadPoolExecutor(max(1, min(at_once, len(params)))) as pool:
        return list(pool.map(fit, params))


def sweep_importances(
    models: Sequence[RandomForestClassificationModel], features: Features, params: Sequence[ForestParams]
) -> DataFrame:
    """``(num_trees, max_depth, feature, importance)`` of several forests."""
    parts = [
        importances(m, features, ranked=False).select(
            F.lit(p.num_trees).alias("num_trees"), F.lit(p.max_depth).alias("max_depth"), "feature", "importance"
        )
        for m, p in zip(models, params, strict=True)
    ]
    return reduce(DataFrame.unionByName, parts)
