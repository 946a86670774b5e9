"""Near-duplicate vectors by a subspace pigeonhole join.

Vectors are scaled to length one and rotated.  If two of them are near, their
squared distance, spread over blocks of coordinates, leaves at least one block with
no more than its share.  So in each block the vectors within that share of each
other are candidates: a range join in few dimensions, over a grid.  Candidates are
verified with the vectors themselves; each pair counts in the first of its blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabkit.llm.components import components
from tabkit.llm.texts import columns_batch, in_arrow
from tabkit.sources import store

#: Coordinates of a block.
BLOCK_DIMS = 16
#: Vectors that a grid cell should hold, and those above which it is dealt into parts
#: that are compared pair by pair of parts.
TARGET = 2048
PART = 4096
#: Leading coordinates of a block that the grid may cut.
GRID_DIMS = 5
#: Rows and pairs that are looked at together in a cell.
ROWS_AT_ONCE = 512
PAIRS_AT_ONCE = 1 << 16
#: A cell is this many radii wide.
WIDTH = 2.0
#: Rounding that a budget has to spare, in double and in single precision.
SLACK = 1e-9
SINGLE_SLACK = 1e-5


@lru_cache(maxsize=8)
def rotation(dims: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same on every machine."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dims]).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def blocks_of(dims: int) -> list[slice]:
    return [slice(a, min(a + BLOCK_DIMS, dims)) for a in range(0, dims, BLOCK_DIMS)]


def budgets(dims: int, cosine: float) -> np.ndarray:
    """Each block's share of the squared distance that ``cosine`` allows, by its coordinates."""
    sizes = np.array([b.stop - b.start for b in blocks_of(dims)])
    return 2 * (1 - cosine) * sizes / dims + SLACK


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; large and small numbers first brought near one."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def usable(vector: Column) -> Column:
    """No NULL in it, all finite, and not zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(
        (F.size(vector) > 0) & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False)
    )


def grid_cells(axes: np.ndarray, budget: float) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """``(vectors, cells, home)``: each vector's own cell, and the later neighbour
    cells that something within the budget of it can lie in.

    Of two vectors within the budget in different cells, the one in the earlier
    cell visits the other's: every pair meets in exactly one cell.
    """
    radius = float(np.sqrt(budget))
    width = WIDTH * radius
    own = np.floor(axes / width).astype(np.int32)
    low = axes - own * width
    yield np.arange(len(axes)), own, True
    gaps = {-1: low, 0: np.zeros_like(low), 1: width - low}
    for move in product((-1, 0, 1), repeat=axes.shape[1]):
        if move > (0,) * len(move):
            away = np.stack([gaps[m][:, k] for k, m in enumerate(move)])
            some = np.flatnonzero((away <= radius).all(axis=0) & ((away * away).sum(axis=0) <= budget))
            if len(some):
                yield some, own[some] + np.array(move, np.int32), False


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    n, width = values.shape
    ends = pa.array(np.arange(n + 1) * width, pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(values.ravel(), kind))


def _matrix(lists: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _placed(classes: DataFrame, cosine: float, seed: int) -> DataFrame:
    """A row per vector, block and cell.  Vectors of floats travel as floats."""
    number = "float" if classes.schema["vector"].dataType.simpleString() == "array<float>" else "double"
    kind = pa.float32() if number == "float" else pa.float64()
    arrow = pa.schema(
        [("label", pa.string()), ("dims", pa.int32()), ("block", pa.int32()), ("cell", pa.list_(pa.int32())),
         ("home", pa.bool_()), ("rep", pa.int64()), ("n", pa.int64()), ("vector", pa.list_(kind))]
    )

    def make():
        def step(batch) -> Iterator[pa.RecordBatch]:
            dims, grids = (batch.column(k).to_numpy() for k in (4, 5))
            for size, grid in sorted(set(zip(dims.tolist(), grids.tolist(), strict=True))):
                mine = batch.filter(pa.array((dims == size) & (grids == grid)))
                given = _matrix(mine.column(3))
                turned = unit(given) @ rotation(size, seed)
                for b, (block, budget) in enumerate(zip(blocks_of(size), budgets(size, cosine), strict=True)):
                    for which, cells, home in grid_cells(turned[:, block][:, :grid], budget):
                        n = len(which)
                        yield pa.RecordBatch.from_arrays(
                            [
                                mine.column(0).take(pa.array(which)),
                                pa.array(np.full(n, size, np.int32)),
                                pa.array(np.full(n, b, np.int32)),
                                _lists(cells, pa.int32()),
                                pa.array(np.full(n, home)),
                                mine.column(1).take(pa.array(which)),
                                mine.column(2).take(pa.array(which)),
                                _lists(given[which], kind),
                            ],
                            schema=arrow,
                        )

        return step

    return in_arrow(
        classes.select("label", "rep", "n", F.col("vector").cast(f"array<{number}>").alias("vector"), "dims", "grid"),
        make,
        f"label string, dims int, block int, cell array<int>, home boolean, rep bigint, n bigint, vector array<{number}>",
    )


def _near_in_block(turned: np.ndarray, budget: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs ``i < j`` within the budget, and some a little beyond it, for some i at a time."""
    x = turned.astype(np.float32)
    half = (x * x).sum(axis=1) / 2
    for at in range(0, len(x), ROWS_AT_ONCE):
        upper = x[at : at + ROWS_AT_ONCE] @ x[at:].T
        upper -= half[at : at + ROWS_AT_ONCE, None]
        upper -= half[None, at:]
        i, j = np.nonzero(upper >= -(budget + SINGLE_SLACK) / 2)
        later = j > i
        yield i[later] + at, j[later] + at


def _share_of(turned: np.ndarray, i: np.ndarray, j: np.ndarray, block: slice) -> np.ndarray:
    gap = turned[i, block] - turned[j, block]
    return (gap * gap).sum(axis=1)


class _Forest:
    """Joins numbers; tells which links join what was apart."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def joins(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _compare(cosine: float, seed: int):
    """A function for sorted rows of cells: links counted, and a spanning forest of them."""
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def compared(block, same, part, home, reps, counts, vectors) -> Iterator[pa.RecordBatch]:
        if len(reps) < 2 or not home.any():
            return
        v = unit(vectors)
        dims = v.shape[1]
        turned = v @ rotation(dims, seed)
        share, parts = budgets(dims, cosine), blocks_of(dims)
        links, tree, edges = np.zeros(len(reps), np.int64), _Forest(len(reps)), []
        for i, j in _near_in_block(turned[:, parts[block]], share[block]):
            good = home[i] | home[j]
            if not same:
                good &= part[i] != part[j]
            i, j = i[good], j[good]
            for at in range(0, len(i), PAIRS_AT_ONCE):
                a, b = i[at : at + PAIRS_AT_ONCE], j[at : at + PAIRS_AT_ONCE]
                near = _share_of(turned, a, b, parts[block]) <= share[block]
                near &= (v[a] * v[b]).sum(axis=1) >= cosine
                a, b = a[near], b[near]
                edges += [(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True) if tree.joins(x, y)]
                new = np.ones(len(a), bool)
                for k in range(block):  # a pair counts in the first block that has it
                    new &= _share_of(turned, a, b, parts[k]) > share[k]
                links += np.bincount(a[new], counts[b[new]], len(reps)).astype(np.int64)
                links += np.bincount(b[new], counts[a[new]], len(reps)).astype(np.int64)
        some = np.flatnonzero(links)
        ends = np.array(edges, np.int64).reshape(-1, 2)
        a = np.concatenate([reps[some], reps[ends[:, 0]]])
        other = [None] * len(some) + reps[ends[:, 1]].tolist()
        yield columns_batch((a, other, np.concatenate([links[some], np.zeros(len(ends), np.int64)])), arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def emit() -> Iterator[pa.RecordBatch]:
            if held:
                all_ = pa.Table.from_batches(held).combine_chunks()
                block, same = all_.column(1)[0].as_py(), all_.column(2)[0].as_py()
                part, home, reps, counts = (all_.column(k).to_numpy() for k in range(3, 7))
                vectors = _matrix(all_.column(7).combine_chunks())
                yield from compared(block, same, part, home, reps, counts, vectors)

        for batch in batches:
            names = batch.column(0).dictionary_encode()
            change = np.flatnonzero(np.diff(names.indices.to_numpy())) + 1
            for start, end in zip([0, *change], [*change, batch.num_rows], strict=True):
                name = batch.column(0)[int(start)].as_py()
                if name != now:
                    yield from emit()
                    held, now = [], name
                held.append(batch.slice(start, end - start))
        yield from emit()

    return run


def near_vectors(
    table: DataFrame,
    cosine: float = 0.98,
    seed: int = 7,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """One row per row: key, ``n_links``, ``component``, ``kept``.

    Rows with equal labels link if the cosine of their vectors is at least
    ``cosine``, which is above 0.  A row with a NULL key or label, or whose
    vector is NULL, empty, zero or holds NULL or anything not finite, links with
    nothing; vectors of different lengths do not link.  Equal vectors are one,
    with a count: copies cost nothing, and every one counts as a link.
    ``component`` is the smallest key reachable by links, ``kept`` says that it
    is the row's own; a NULL key is its own component and not kept.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine is above 0 and at most 1")
    rows = table.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{vector}`").alias("vector")
    )
    sound = F.col("key").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector"))
    classes = store(
        rows.where(sound)
        .groupBy("label", "vector")
        .agg(F.min(F.col("key").cast("bigint")).alias("rep"), F.count(F.lit(1)).alias("n")),
        "vectors",
    ).withColumn("dims", F.size("vector"))
    # The more vectors share a label, the more coordinates the grid cuts: a cell
    # then holds about TARGET of them, at some three cells to a coordinate.
    counts = store(classes.groupBy("label", "dims").agg(F.count(F.lit(1)).alias("many")), "many")
    grid = F.least(
        F.greatest(F.ceil(F.log(F.col("many") / TARGET) / F.log(F.lit(3.0))), F.lit(0)), F.lit(GRID_DIMS)
    ).cast("int")
    placed = _placed(classes.join(counts, ["label", "dims"]).withColumn("grid", grid), cosine, seed)
    where = ["label", "dims", "block", "cell"]
    placed = store(placed, "placed")
    full = store(
        placed.groupBy(*where).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > PART), "full"
    )
    parts = F.coalesce(F.ceil(F.col("rows") / PART), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    low, high = F.least("part", "other"), F.greatest("part", "other")
    name = F.concat_ws(":", F.col("dims"), F.col("block"), F.concat_ws(",", "cell"), low, high, F.col("label"))
    dealt = (
        placed.join(full, where, "left")
        .withColumn("parts", parts)
        .withColumn("part", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(name.alias("name"), "block", (low == high).alias("same"), "part", "home", "rep", "n", "vector")
    )
    found = store(
        dealt.repartition("name").sortWithinPartitions("name").mapInArrow(
            _compare(cosine, seed), "a bigint, b bigint, n bigint"
        ),
        "found",
    )
    links = found.where(F.col("b").isNull()).groupBy("a").agg(F.sum("n").alias("links"))
    roots = components(found.where(F.col("b").isNotNull()).select("a", "b"))
    known = store(
        classes.drop("dims")
        .join(links, F.col("rep") == F.col("a"), "left")
        .join(roots, F.col("rep") == F.col("node"), "left")
        .select(
            "label",
            "vector",
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("root", "rep").alias("component"),
        ),
        "known",
    )
    alone = rows.where(~sound).select("key", F.lit(0).cast("bigint").alias("n_links"), F.col("key").cast("bigint").alias("component"))
    joined = rows.where(sound).join(known, ["label", "vector"]).select("key", "n_links", "component")
    own_first = F.coalesce(F.col("key") == F.col("component"), F.lit(False))
    return joined.unionAll(alone).select(F.col("key").alias(key), "n_links", "component", own_first.alias("kept"))
