"""Sets of 64-bit hashes as bits: small enough for every task, and never without a member."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a filter of hashes; with more hashes it lets more pass, and loses none.
FILTER_BITS = 26


def probes(bits: int) -> tuple[int, int, int]:
    """The shifts at which a hash's bits name places in a filter of ``2 ** bits``."""
    return 64 - bits, 0, (64 - bits) // 2


@dataclass(frozen=True)
class Filter:
    """Says of a hash that it may be in a set; never no of one that is."""

    bits: int
    words: np.ndarray

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        good = np.ones(len(hashes), bool)
        mask = np.uint64((1 << self.bits) - 1)
        for shift in probes(self.bits):
            place = hashes >> np.uint64(shift) & mask
            good &= (self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)) == 1
        return good


def filter_of(hashes: DataFrame, column: str, most: int = FILTER_BITS) -> Filter:
    """The filter of a column of hashes; its words are made in the cluster, at most ``2 ** (most - 6)``."""
    bits = min(most, max(10, 4 + int(hashes.count()).bit_length()))
    mask = (1 << bits) - 1
    places = F.array(*[F.expr(f"shiftrightunsigned({column}, {s}) & {mask}L") for s in probes(bits)])
    slots = hashes.select(F.explode(places).alias("p")).select(
        F.shiftright("p", 6).alias("slot"), F.expr("shiftleft(1L, cast(p & 63L as int))").alias("bit")
    )
    table = slots.groupBy("slot").agg(F.bit_or("bit").alias("word")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[table.column("slot").to_numpy()] = table.column("word").to_numpy().view(np.uint64)
    return Filter(bits, words)
