"""Words, hashes and Arrow batches: what the operators on texts share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Distinct words a task keeps the hashes of before it forgets them all.
KEPT_WORDS = 120_000


def words_of(text: str | None) -> list[bytes]:
    """The runs of characters other than space and U+0009 to U+000D, as UTF-8.

    ``bytes.split`` cuts at exactly these six characters.  NULL holds no word.
    """
    return text.encode("utf-8", "surrogatepass").split() if text else []


def crc_part(key: Column, parts: int) -> Column:
    """crc32 of the key's text, modulo ``parts``; NULL for a NULL key."""
    return F.crc32(key.cast("string").cast("binary")) % parts


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, seed: int = 0, most: int = KEPT_WORDS):
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def window_hashes(hashes: np.ndarray, size: int, base: int) -> np.ndarray:
    """One polynomial hash, modulo 2**64, per run of ``size`` word hashes."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    mask = (1 << 64) - 1
    # Horner by doubling: runs of 1, 2, 4, ... are joined to the runs asked for.
    run, width, power, done = hashes, 1, base | 1, 0
    while True:
        if size & width:
            out = out * np.uint64(power) + run[done : done + n]
            done += width
        if width * 2 > size:
            return out
        run = run[:-width] * np.uint64(power) + run[width:]
        power = power * power & mask
        width *= 2


def in_arrow(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]],
    schema: str | StructType,
) -> DataFrame:
    """``mapInArrow`` with a state per task: ``make()`` gives the batch function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield from step(batch)

    return df.mapInArrow(run, schema)


def same_columns(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]]
) -> DataFrame:
    """:func:`in_arrow` over whole rows that keep their columns, which may have any name."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return in_arrow(plain, make, plain.schema).toDF(*df.columns)


def each_row(
    df: DataFrame, make: Callable[[], Callable[..., tuple]], schema: str, arrow: pa.Schema
) -> DataFrame:
    """A row for each row; ``make()`` gives a function of the row's columns."""

    def build():
        one = make()

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            rows = [one(*r) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield columns_batch(zip(*rows, strict=True), arrow)

        return step

    return in_arrow(df, build, schema)


def columns_batch(columns: Iterable, arrow: pa.Schema) -> pa.RecordBatch:
    """A batch of Python or numpy columns."""
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type, from_pandas=False) for c, f in zip(columns, arrow, strict=True)],
        schema=arrow,
    )


# Digits, letters (A-Z as a-z) and all bytes of characters beyond ASCII; the rest are blanks.
_TERM_BYTES = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()


def terms_of(text: str | None) -> list[bytes]:
    """The runs of digits, letters and characters beyond ASCII, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split() if text else []
