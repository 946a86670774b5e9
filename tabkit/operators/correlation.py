"""Correlation of number columns and association of categories."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations, combinations_with_replacement
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.functions import is_complete
from tabkit.operators.ranking import number_rows
from tabkit.sources import settle

# Groups that the moments of all tasks are merged in before the driver gets them.
MERGED = 32

_PARTS = ("mean", "rest", "co", "low", "high")
_MOMENTS = ", ".join(["n bigint", *(f"{c} array<double>" for c in _PARTS)])
_MOMENTS_ARROW = pa.schema([("n", pa.int64()), *((c, pa.list_(pa.float64())) for c in _PARTS)])


def _complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as doubles, only rows without NULL and NaN."""
    chosen = df.where(is_complete([df.schema[c] for c in columns]))
    return chosen.select(
        *[F.col(f"`{c}`").cast("double").alias(f"_x{i}") for i, c in enumerate(columns)]
    )


class Moments:
    """Count, means, centred co-moments and bounds of some columns; two of them can be added up.

    A mean is ``mean + rest``, so that the distance of two means is exact enough
    where columns lie far from zero.  A column with an infinity spoils its own
    moments only, and its bounds say so.
    """

    def __init__(self, n: int, mean: np.ndarray, rest: np.ndarray, co: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.n, self.mean, self.rest, self.co, self.low, self.high = n, mean, rest, co, low, high

    @classmethod
    def of(cls, values: np.ndarray) -> Moments:
        """From one row per column."""
        with np.errstate(all="ignore"):
            mean = values.mean(axis=1)
            apart = values - mean[:, None]
            rest = apart.mean(axis=1)
            apart -= rest[:, None]
            return cls(values.shape[1], mean, rest, apart @ apart.T, values.min(axis=1), values.max(axis=1))

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        with np.errstate(all="ignore"):
            step = (other.mean - self.mean) + (other.rest - self.rest)
            co = self.co + other.co + np.outer(step, step) * (self.n * other.n / n)
            low = self.rest + step * (other.n / n)
            mean = self.mean + low
            back = mean - self.mean
            rest = (self.mean - (mean - back)) + (low - back)
        return Moments(n, mean, rest, co, np.minimum(self.low, other.low), np.maximum(self.high, other.high))

    def batch(self) -> pa.RecordBatch:
        cells = ([self.n], *([x.ravel()] for x in (self.mean, self.rest, self.co, self.low, self.high)))
        arrays = [pa.array(c, f.type) for c, f in zip(cells, _MOMENTS_ARROW, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, schema=_MOMENTS_ARROW)


def _moments(rows: list[tuple]) -> Moments | None:
    """The sum of stored moments."""
    found = []
    for n, *parts in rows:
        mean, rest, co, low, high = map(np.array, parts)
        found.append(Moments(n, mean, rest, co.reshape(len(mean), -1), low, high))
    return reduce(Moments.__add__, found) if found else None


def column_moments(data: DataFrame) -> Moments | None:
    """The moments of all columns, which are doubles without NULL and NaN; None without rows.

    One run of ``data``.  A task makes one row of d x d numbers, whatever its
    rows; those are merged in MERGED groups, and the driver adds up the groups.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                own = Moments.of(np.stack([c.to_numpy() for c in batch.columns]))
                held = own if held is None else held + own
        if held is not None:
            yield held.batch()

    def merge(table: pa.Table) -> pa.Table:
        whole = _moments(list(zip(*(table.column(f.name).to_pylist() for f in _MOMENTS_ARROW), strict=True)))
        return pa.Table.from_batches([whole.batch()])

    parts = data.mapInArrow(run, _MOMENTS).withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(MERGED)))
    return _moments([tuple(r) for r in parts.groupBy("_part").applyInArrow(merge, _MOMENTS).collect()])


def _pearson(data: DataFrame) -> dict[tuple[int, int], float]:
    """Pearson's r of every ordered pair whose columns vary and are finite."""
    m = column_moments(data)
    if m is None:
        return {}
    good = np.flatnonzero((m.low < m.high) & np.isfinite(m.low) & np.isfinite(m.high))
    spread = np.sqrt(np.diag(m.co)[good])
    with np.errstate(all="ignore"):
        r = np.clip(m.co[np.ix_(good, good)] / spread[:, None] / spread, -1.0, 1.0)
    np.fill_diagonal(r, 1.0)
    return {
        (int(i), int(j)): float(r[x, y])
        for x, i in enumerate(good)
        for y, j in enumerate(good)
        if not np.isnan(r[x, y])
    }


def corr_long(df: DataFrame, columns: Sequence[str], null: str = "skip") -> DataFrame:
    """``(col_a, col_b, corr)`` for every ordered pair; Pearson.

    Rows with NULL or NaN in any of the columns are left out, or fail the job
    with ``null="error"``.  A constant column, or one with an infinity, correlates
    with nothing, itself included: NULL.  Any number of columns takes the same
    path, :func:`column_moments`, which runs the input once.
    """
    found = _pearson(_complete(_checked(df, columns, null), columns))
    rows = [
        (a, b, found.get((i, j))) for i, a in enumerate(columns) for j, b in enumerate(columns)
    ]
    return df.sparkSession.createDataFrame(rows, "col_a string, col_b string, corr double")


def _checked(df: DataFrame, columns: Sequence[str], null: str) -> DataFrame:
    if null == "skip":
        return df
    if null != "error":
        raise ValueError("null is 'skip' or 'error'")
    whole = is_complete([df.schema[c] for c in columns])
    stop = F.raise_error(F.lit("NULL or NaN in a correlation column")).cast("boolean")
    return df.where(F.when(whole, F.lit(True)).otherwise(stop))


def corr_wide(long: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The square form of :func:`corr_long`: ``column`` and one per name."""
    return (
        long.groupBy(F.col("col_a").alias("column"))
        .pivot("col_b", list(columns))
        .agg(F.first("corr"))
    )


_CELLS = "_i int, _j int, _a string, _b string, _n bigint"
_CELLS_ARROW = pa.schema(
    [("_i", pa.int32()), ("_j", pa.int32()), ("_a", pa.string()), ("_b", pa.string()), ("_n", pa.int64())]
)


def _table_of(a: np.ndarray, b: np.ndarray, width: int, height: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cells ``(a, b, n)`` with rows of the table of two code columns; -1 is no value."""
    keys = a * height + b
    keys = keys[(a >= 0) & (b >= 0)]
    if width * height <= 4 * len(a):
        counts = np.bincount(keys, minlength=width * height)
        cells = np.flatnonzero(counts)
        counts = counts[cells]
    else:
        cells, counts = np.unique(keys, return_counts=True)
    return cells // height, cells % height, counts


def pair_counts(
    df: DataFrame, columns: Sequence[str], complete: bool, itself: bool = False
) -> DataFrame:
    """``(_i, _j, _a, _b, _n)``: rows per pair of values, for every pair of columns.

    Values are text.  ``_i`` and ``_j`` are positions in ``columns``, ``_i < _j``,
    with ``itself`` also each column paired with itself.  ``complete`` leaves out
    rows with a NULL in any of the columns, else those with a NULL in the pair.

    A batch of rows turns each column into codes of its own dictionary and makes
    the table of each pair from the codes, so that a row is never multiplied by
    the number of pairs: what leaves a batch is its tables' cells.  They are
    added up before the shuffle.  What moves, and what is stored, is bounded by
    the tables of the pairs; a column with a value per row is counted like any
    other, and its tables have as many cells as there are rows.
    """
    present = [F.col(f"`{c}`").isNotNull() for c in columns]
    data = df.where(reduce(and_, present)) if complete else df
    pick = combinations_with_replacement if itself else combinations
    pairs = list(pick(range(len(columns)), 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = [c.dictionary_encode() for c in batch.columns]
            codes = [c.indices.fill_null(-1).to_numpy().astype(np.int64) for c in coded]
            for i, j in pairs:
                values = coded[i].dictionary, coded[j].dictionary
                a, b, n = _table_of(codes[i], codes[j], len(values[0]), len(values[1]))
                if len(n):
                    cells = (
                        pa.array(np.full(len(n), i, np.int32)),
                        pa.array(np.full(len(n), j, np.int32)),
                        values[0].take(pa.array(a)).cast(pa.string()),
                        values[1].take(pa.array(b)).cast(pa.string()),
                        pa.array(n.astype(np.int64)),
                    )
                    yield pa.RecordBatch.from_arrays(list(cells), schema=_CELLS_ARROW)

    texts = data.select(*[F.col(f"`{c}`").cast("string").alias(f"_c{i}") for i, c in enumerate(columns)])
    cells = texts.mapInArrow(run, _CELLS) if pairs else df.sparkSession.createDataFrame([], _CELLS)
    return settle(cells.groupBy("_i", "_j", "_a", "_b").agg(F.sum("_n").alias("_n")))


def _pair_names(df: DataFrame, pairs: Sequence[tuple[int, int]], columns: Sequence[str]) -> DataFrame:
    rows = [(i, j, columns[i], columns[j]) for i, j in pairs]
    schema = "_i int, _j int, col_a string, col_b string"
    return df.sparkSession.createDataFrame(rows, schema)


def corr_categorical(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of frequency ranks, ``(col_a, col_b, corr)``.

    One scan counts the pairs of values; the label counts, the ranks and the
    moments are made from those.  Rows with a NULL category are left out.  Every
    ordered pair is there; a column with one value correlates with nothing: NULL.
    See :func:`cramers_v` for a measure that does not depend on the ranks.
    """
    cells = pair_counts(df, columns, complete=True, itself=True)
    labels = cells.where(F.col("_i") == F.col("_j")).select(
        F.col("_i").alias("column"), F.col("_a").alias("value"), F.col("_n").alias("n")
    )
    ranks = settle(number_rows(settle(labels), ["column"], [F.desc("n"), F.asc("value")], "index"))

    def side(i: str, value: str, name: str) -> DataFrame:
        return ranks.select(
            F.col("column").alias(i), F.col("value").alias(value), F.col("index").cast("double").alias(name)
        )

    ranked = cells.join(side("_i", "_a", "_x"), ["_i", "_a"]).join(side("_j", "_b", "_y"), ["_j", "_b"])
    n, x, y = (F.col(c) for c in ("_n", "_x", "_y"))
    # Around the middle of the ranks, so that the sums stay small.
    middle = ranked.groupBy("_i", "_j").agg(
        (F.sum(n * x) / F.sum(n)).alias("_mx"), (F.sum(n * y) / F.sum(n)).alias("_my")
    )
    dx, dy = x - F.col("_mx"), y - F.col("_my")
    moments = (
        ranked.join(middle, ["_i", "_j"])
        .groupBy("_i", "_j")
        .agg(F.sum(n * dx * dy).alias("_xy"), F.sum(n * dx * dx).alias("_xx"), F.sum(n * dy * dy).alias("_yy"))
    )
    r = F.try_divide(F.col("_xy"), F.sqrt("_xx") * F.sqrt("_yy"))
    bounded = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))
    one = F.when(r.isNotNull(), F.when(F.col("_i") == F.col("_j"), F.lit(1.0)).otherwise(bounded))
    found = moments.select("_i", "_j", one.alias("corr"))
    both = found.unionByName(
        found.where("_i < _j").select(F.col("_j").alias("_i"), F.col("_i").alias("_j"), "corr")
    )
    d = range(len(columns))
    names = _pair_names(df, [(i, j) for i in d for j in d], columns)
    return names.join(both, ["_i", "_j"], "left").select("col_a", "col_b", "corr")


def cramers_v(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(col_a, col_b, v)`` for every unordered pair of categories.

    Chi-squared over the contingency table of the pair; rows with NULL in
    either are left out of that pair.  NULL where a column has one value, or
    the pair no row.
    """
    cells = pair_counts(df, columns, complete=False)
    pair = ["_i", "_j"]
    side_a = cells.groupBy(*pair, "_a").agg(F.sum("_n").alias("_n_a"))
    side_b = cells.groupBy(*pair, "_b").agg(F.sum("_n").alias("_n_b"))
    shape = (
        side_a.groupBy(*pair)
        .agg(F.count(F.lit(1)).alias("_r"))
        .join(side_b.groupBy(*pair).agg(F.count(F.lit(1)).alias("_c")), pair)
    )
    share = F.col("_n").cast("double") * F.col("_n") / (F.col("_n_a").cast("double") * F.col("_n_b"))
    phi = (
        cells.join(side_a, [*pair, "_a"])
        .join(side_b, [*pair, "_b"])
        .groupBy(*pair)
        .agg((F.sum(share) - 1).alias("_phi2"))
    )
    degrees = F.least(F.col("_r"), F.col("_c")) - 1
    v = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("_phi2"), degrees.cast("double"))))
    found = phi.join(shape, pair).select(*pair, F.when(degrees > 0, v).alias("v"))
    names = _pair_names(df, list(combinations(range(len(columns)), 2)), columns)
    return names.join(found, pair, "left").select("col_a", "col_b", "v")
