"""The best documents for each query text, by dense products of tiles.

A term's share in a document's score is a whole number, so scores are exact.
Items and documents are cut into tiles; per tile of items only the terms of its
items are numbered, and a tile of weights is multiplied with a tile of document
impacts by BLAS in double precision.  Terms are cut so that no sum in a product
reaches 2**53: products are exact, and are added up as 64-bit whole numbers.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabkit.llm.texts import columns_batch, in_arrow, terms_of
from tabkit.sources import store

#: Different terms of items that are held at once; more items take further passes.
ITEM_TERMS = 1_000_000
#: Rows and columns of a tile.
ITEM_TILE, TERM_TILE, DOC_TILE = 256, 2048, 1024
#: Groups of tasks whose best rows are compared before all are.
MERGE = 64
#: Impacts are below this, whatever the document.
IMPACT = 1_000_000


def term_weight(docs: int, holding: int) -> int:
    """``floor(1000 * ln((2 N + 2) / (2 df + 1)))``."""
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * holding + 1)))


def impacts(times: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Share of a term that comes ``times`` in a document of length scale ``scale``."""
    return 1000 * IMPACT * times // (1000 * times + 20 * scale)


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """``(item, key, term)``: the different terms of each row, numbered ``item``."""
    kind = items.schema[key].dataType.simpleString()

    def make():
        def step(batch):
            rows = []
            for item, k, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(item, k, w.decode()) for w in set(terms_of(t))]
            if rows:
                yield columns_batch(zip(*rows, strict=True), batch_schema(batch))

        return step

    def batch_schema(batch):
        return pa.schema([("item", pa.int64()), ("key", batch.schema.field(1).type), ("term", pa.string())])

    told = items.select(
        F.monotonically_increasing_id().alias("item"), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`")
    )
    return in_arrow(told, make, f"item bigint, key {kind}, term string")


def term_counts(docs: DataFrame, terms: list[str], key: str, text: str) -> DataFrame:
    """``(doc, n, terms, times)`` of documents with a term; ``terms`` numbers those listed."""
    told = docs.sparkSession.sparkContext.broadcast(terms)
    arrow = pa.schema(
        [("doc", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))]
    )

    def make():
        number = {w.encode(): i for i, w in enumerate(told.value)}

        def step(batch):
            rows = []
            for doc, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = terms_of(t)
                if words:
                    known = Counter(map(number.get, words))
                    known.pop(None, None)
                    rows.append((doc, len(words), list(known), list(known.values())))
            if rows:
                yield columns_batch(zip(*rows, strict=True), arrow)

        return step

    told_docs = docs.select(F.col(f"`{key}`").cast("bigint"), F.col(f"`{text}`"))
    return in_arrow(told_docs, make, "doc bigint, n bigint, terms array<int>, times array<int>")


class ItemTile:
    """Some items, the terms in them, and the weights: one matrix per tile of terms."""

    def __init__(self, items: list[tuple[int, list[int]]], weights: np.ndarray):
        self.names = np.array([i for i, _ in items], np.int64)
        terms = np.unique(np.concatenate([t for _, t in items]))
        heaviest = int(max(1, weights[terms].max()))
        self.width = max(1, min(TERM_TILE, (1 << 53) // (heaviest * IMPACT) - 1))
        self.place = np.full(len(weights), -1, np.int32)
        self.place[terms] = np.arange(len(terms))
        self.matrices = [np.zeros((len(items), min(self.width, len(terms) - a))) for a in range(0, len(terms), self.width)]
        for i, (_, own) in enumerate(items):
            for term in own:
                at = int(self.place[term])
                self.matrices[at // self.width][i, at % self.width] = weights[term]

    def scores(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int) -> np.ndarray:
        """The whole-number scores of all items (rows) in ``n_docs`` documents (columns)."""
        at = self.place[term]
        mine = at >= 0
        doc, at, impact = doc[mine], at[mine], impact[mine]
        total = np.zeros((len(self.names), n_docs), np.int64)
        for k, matrix in enumerate(self.matrices):
            here = at // self.width == k
            tile = np.zeros((matrix.shape[1], n_docs))
            tile[at[here] - k * self.width, doc[here]] = impact[here]
            total += (matrix @ tile).astype(np.int64)
        return total


class Best:
    """The best documents of each item so far; equal scores by the smaller document."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.least = np.ones(items, np.int64)
        self.rows = [np.zeros((4, 0), np.int64)]
        self.held = 0

    def add(self, scores: np.ndarray, docs: np.ndarray, known: np.ndarray) -> None:
        """``known`` is false for a document without a key, which comes after all others.

        What equals the worst row kept so far may still displace it.
        """
        item, at = np.nonzero(scores >= self.least[:, None])
        self.rows.append(np.stack([item, scores[item, at], docs[at], known[at].astype(np.int64)]))
        self.held += len(item)
        if self.held > 4 * self.top * len(self.least):
            self.settle()

    def settle(self) -> np.ndarray:
        """Rows ``(item, score, doc, known)``, at most ``top`` an item."""
        rows = np.concatenate(self.rows, axis=1)
        rows = rows[:, np.lexsort((rows[2], -rows[3], -rows[1], rows[0]))]
        first = np.searchsorted(rows[0], np.arange(len(self.least)))
        place = np.arange(rows.shape[1]) - first[rows[0]]
        rows = rows[:, place < self.top]
        last = rows[:, np.flatnonzero(place[place < self.top] == self.top - 1)]
        self.least[last[0]] = np.maximum(1, last[1])
        self.rows, self.held = [rows], rows.shape[1]
        return rows


def _best_of_tasks(counts: DataFrame, items: list[tuple[int, list[int]]], weights: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """``(item, doc, score)``: the best rows of every task."""
    told = counts.sparkSession.sparkContext.broadcast((items, weights))
    arrow = pa.schema([("item", pa.int64()), ("doc", pa.int64()), ("score", pa.int64())])

    def run(batches):
        held, weight = told.value
        tiles = [ItemTile(held[a : a + ITEM_TILE], weight) for a in range(0, len(held), ITEM_TILE)]
        best = [Best(len(t.names), top) for t in tiles]
        for batch in batches:
            for a in range(0, batch.num_rows, DOC_TILE):
                part = batch.slice(a, DOC_TILE)
                column = part.column(0)
                known = column.is_valid().to_numpy(zero_copy_only=False)
                docs = column.fill_null(0).to_numpy()
                scale = 50 + 50 * part.column(1).to_numpy() * n_docs // n_terms
                sizes = part.column(2).value_lengths().to_numpy()
                term, times = (part.column(c).flatten().to_numpy() for c in (2, 3))
                doc = np.repeat(np.arange(len(docs)), sizes)
                impact = impacts(times.astype(np.int64), scale[doc])
                for tile, kept in zip(tiles, best, strict=True):
                    kept.add(tile.scores(doc, term, impact, len(docs)), docs, known)
        for tile, kept in zip(tiles, best, strict=True):
            item, score, docs, known = kept.settle()
            if len(item):
                yield columns_batch((tile.names[item], pa.array(docs, mask=known == 0), score), arrow)

    return counts.mapInArrow(run, "item bigint, doc bigint, score bigint")


def _ranked(rows: DataFrame, top: int, *group: Column | str) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def ranked_documents(
    docs: DataFrame,
    items: DataFrame,
    top: int = 50,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``(item_key, rank, key, score)``: the ``top`` best documents of each item.

    Terms are runs of digits, letters and characters beyond ASCII, A-Z
    lower-cased.  N counts the documents with a term, L their terms, n those of
    one, df the documents that hold a term and tf its occurrences in one; ``div``
    rounds down.  A document's score for an item sums, over the item's different
    terms, ``w * ((10**9 * tf) div (1000 * tf + 20 * m))``, with ``w =
    floor(1000 * ln((2 N + 2) / (2 df + 1)))`` and ``m = 50 + (50 * n * N) div L``.
    Only scores above 0 are ranked; equal ones come by the smaller key, NULL last,
    and rows with equal keys both take a rank.

    NULL and empty texts, of documents or items, have no terms and appear
    nowhere; so does an empty table.  Every row of ``items`` is ranked by itself,
    also one whose key is NULL or comes twice.  Keys of documents are whole numbers.

    Items are dealt by hash into blocks of about ITEM_TERMS terms; a block is
    multiplied with all documents, whose counts of its terms are written once.
    Every task keeps the best ``top`` rows of each item, and those are merged in
    two steps, so that no task reads a row per task and item.
    """
    spark = docs.sparkSession
    pairs = store(item_terms(items, item_key, item_text), "items")
    blocks = max(1, -(-pairs.count() // ITEM_TERMS))
    kind = items.schema[item_key].dataType.simpleString()
    out = spark.createDataFrame([], f"key {kind}, rank int, doc bigint, score bigint")
    for block in range(blocks):
        mine = pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        held = mine.groupBy("item").agg(F.collect_list("term").alias("terms")).orderBy("item").collect()
        number: dict[str, int] = {}
        listed = [(r["item"], [number.setdefault(t, len(number)) for t in r["terms"]]) for r in held]
        if not listed:
            continue
        counts = store(term_counts(docs, list(number), key, text), "counts")
        n_docs, n_terms = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).head()
        if not n_docs:
            continue
        weights = np.full(len(number), term_weight(n_docs, 0), np.int64)
        holding = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        for term, df in holding.collect():
            weights[term] = term_weight(n_docs, df)
        best = _best_of_tasks(counts, listed, weights, n_docs, n_terms, top)
        group = F.pmod(F.spark_partition_id(), F.lit(MERGE))
        fewer = _ranked(best.withColumn("group", group), top, "item", "group").drop("rank", "group")
        ranked = _ranked(fewer, top, "item")
        keys = mine.select("item", "key").distinct()
        out = out.unionAll(ranked.join(keys, "item").select("key", F.col("rank").cast("int"), "doc", "score"))
    return out.select(F.col("key").alias(item_key), "rank", F.col("doc").alias(key), "score")
