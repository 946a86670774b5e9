"""Quality by compression: which labelled texts explain a text better?

One zstandard dictionary is built from good texts and one from bad ones.  A text
is cut into blocks, every block is compressed with both, and the difference of the
sizes over their sum says which dictionary knew it.  A logistic curve over that
difference and the size per byte turns it into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabkit.llm.quality import docs_key_type
from tabkit.llm.texts import columns_batch, crc_part, in_arrow
from tabkit.sources import store

#: Texts per label that a dictionary is built from, and how long one may be.
DICTIONARY_TEXTS = 400
DICTIONARY_TEXT_BYTES = 16_384
#: Texts per label that the curve is fitted on, and the share of a label's texts kept for it.
CURVE_TEXTS = 1_500
DEALT = 3
DICTIONARY_BYTES = 64 * 1024
BLOCK = 2048
LEVEL = 3
FEATURES = 6


@dataclass(frozen=True)
class Model:
    """Two dictionaries (none where too little text had the label) and the curve."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]


def build_dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; of few or tiny texts, the texts themselves."""
    blocks = [t[i : i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(texts)[-DICTIONARY_BYTES:]


class Measure:
    """Compressed sizes of texts under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self._by = [self._compressor(good), self._compressor(bad)]

    @staticmethod
    def _compressor(raw: bytes) -> zstandard.ZstdCompressor:
        options = {"level": LEVEL, "write_content_size": False, "write_checksum": False}
        if len(raw) < 8:
            return zstandard.ZstdCompressor(**options)
        data = zstandard.ZstdCompressionDict(raw)
        data.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=data, write_dict_id=False, **options)

    def sizes(self, text: str | None) -> tuple[int, int, int]:
        """Bytes of the text, and of its blocks compressed with either dictionary."""
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        good = bad = 0
        by_good, by_bad = (c.compress for c in self._by)
        for at in range(0, len(raw), BLOCK):
            block = raw[at : at + BLOCK]
            good += len(by_good(block))
            bad += len(by_bad(block))
        return len(raw), good, bad


def features(sizes: np.ndarray) -> np.ndarray:
    """Of rows of sizes: the normalised difference, the size per byte, and their products."""
    n, good, bad = sizes.astype(np.float64).T
    difference = 10 * (bad - good) / np.maximum(good + bad, 1)
    dense = np.where(n > 0, np.log((np.minimum(good, bad) + 8) / (n + 8)), 0.0)
    return np.stack([np.ones_like(n), difference, dense, difference**2, dense**2, difference * dense], axis=1)


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression with a small ridge, by Newton's method with halved steps.

    With one label only, the curve is the constant that this label suggests.
    """
    if not len(y):
        return (0.0,) * FEATURES
    if y.min() == y.max():
        return (4.0 if y[0] else -4.0, *(0.0,) * (FEATURES - 1))
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    ridge = np.full(FEATURES, 1e-4)
    ridge[0] = 0

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(weight @ (np.logaddexp(0, z) - y * z) + ridge @ w**2 / 2)

    w = np.zeros(FEATURES)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
        step, rate = np.linalg.solve(curve, slope), 1.0
        while rate > 1e-6 and loss(w - rate * step) > loss(w):
            rate /= 2
        w = w - rate * step
        if np.abs(rate * step).max() < 1e-7:
            break
    return tuple(w.tolist())


def scores(weights: tuple[float, ...], sizes: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(features(sizes) @ np.array(weights), -30, 30)))


def _measured(rows: DataFrame, good: bytes, bad: bytes, columns: int) -> DataFrame:
    """The first ``columns`` columns, then the sizes of the text in the next one."""
    spark = rows.sparkSession
    given = spark.sparkContext.broadcast((good, bad))
    arrow = pa.schema(
        [(c, docs_key_type(rows, c)) for c in rows.columns[:columns]]
        + [(c, pa.int64()) for c in ("_n", "_good", "_bad")]
    )

    def make():
        measure = Measure(*given.value)

        def step(batch) -> Iterator[pa.RecordBatch]:
            sizes = [measure.sizes(t) for t in batch.column(columns).to_pylist()]
            yield columns_batch((*batch.columns[:columns], *zip(*sizes, strict=True)), arrow)

        return step

    head = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in rows.columns[:columns])
    return in_arrow(rows, make, head + "_n bigint, _good bigint, _bad bigint")


def fit_compression(
    docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "quality"
) -> Model:
    """Learn from the labelled rows for which ``learn``, over the key, holds.

    Each label's texts are dealt by their hash: one in DEALT may serve the curve,
    the others the dictionaries, so that the curve never sees a text that a
    dictionary holds.  Of these the ones with the smallest
    hashes are used: for each label DICTIONARY_TEXTS texts of at most
    DICTIONARY_TEXT_BYTES for the dictionaries, and CURVE_TEXTS, whole and
    measured on executors, for the curve.  So at most 13 MB of text and 3,000 rows of numbers come to the
    driver.  Contradictory or NULL labels are left out.
    """
    known = (
        labels.where(F.col(f"`{label}`").isin(0, 1))
        .groupBy(F.col(f"`{key}`").alias("_key"))
        .agg(F.min(f"`{label}`").alias("_y"), F.max(f"`{label}`").alias("_z"))
        .where((F.col("_y") == F.col("_z")))
        .select("_key", "_y")
    )
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    texts_of = docs.where(learn).select(F.col(f"`{key}`").alias("_key"), body.alias("_text"))
    # Only names and lengths are joined with the labels; texts are fetched for the few chosen.
    named = store(
        texts_of.select("_key", F.xxhash64("_text").alias("_print"), F.octet_length("_text").alias("_bytes"))
        .distinct()
        .join(known, "_key")
        .withColumn("_order", F.xxhash64(F.lit("compression"), "_key", "_print")),
        "labelled",
    )

    def first(rows: DataFrame, n: int) -> list:
        return rows.orderBy("_order", "_key", "_print").limit(n).select("_key", "_print", "_y", "_order").collect()

    def fetched(rows: list) -> DataFrame:
        """The texts of the rows chosen; their names are few enough to send to every task."""
        schema = T.StructType([named.schema[c] for c in ("_key", "_print", "_y", "_order")])
        chosen = docs.sparkSession.createDataFrame(rows, schema).select("_key", "_print", "_y")
        there = texts_of.withColumn("_print", F.xxhash64("_text"))
        return (
            there.join(F.broadcast(chosen), ["_key", "_print"])
            .groupBy("_key", "_print", "_y")
            .agg(F.first("_text").alias("_text"))
            .select("_y", "_text")
        )

    built, curve = [], []
    for y in (1, 0):
        mine = named.where(F.col("_y") == y)
        # A text serves the dictionary or the curve, never both, however few there are.
        for_curve = F.pmod(F.xxhash64(F.lit("dealt"), "_print"), F.lit(DEALT)) == 0
        built += first(mine.where(~for_curve & (F.col("_bytes") <= DICTIONARY_TEXT_BYTES)), DICTIONARY_TEXTS)
        curve += first(mine.where(for_curve), CURVE_TEXTS)
    texts: dict[int, list[bytes]] = {0: [], 1: []}
    for r in fetched(built).collect():
        texts[r["_y"]].append(r["_text"].encode("utf-8", "surrogatepass"))
    good, bad = (build_dictionary(sorted(texts[y])) for y in (1, 0))
    points = [tuple(r) for r in _measured(fetched(curve), good, bad, 1).collect()]
    table = np.array(points, np.int64).reshape(-1, 4)
    weights = fit_curve(features(table[:, 1:]), table[:, 0].astype(np.float64))
    return Model(good, bad, weights)


def compression_scores(
    docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row: key, ``score`` in 0 to 1.  Whole texts; no shuffle.

    NULL and empty texts share one score, that of a text without bytes.
    """
    weights = model.weights
    sized = _measured(docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")), model.good, model.bad, 1)
    n, good, bad = (F.col(c).cast("double") for c in ("_n", "_good", "_bad"))
    d = 10 * (bad - good) / F.greatest(good + bad, F.lit(1.0))
    s = F.when(n > 0, F.ln((F.least(good, bad) + 8) / (n + 8))).otherwise(F.lit(0.0))
    z = sum((F.lit(w) * x for w, x in zip(weights, (F.lit(1.0), d, s, d * d, s * s, d * s), strict=True)), F.lit(0.0))
    z = F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))
    return sized.select(F.col(f"`{key}`"), (1 / (1 + F.exp(-z))).alias("score"))


def held_out(key: str, parts: int, part: int) -> Column:
    """Is the crc32 of the key's text, modulo ``parts``, equal to ``part``?  NULL: no."""
    return F.coalesce(crc_part(F.col(f"`{key}`"), parts) == part, F.lit(False))


