"""Connected components of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.sources import store


def _distinct(links: DataFrame) -> DataFrame:
    return links.where(F.col("hi") > F.col("lo")).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(
        links.agg(
            F.count(F.lit(1)),
            F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")),
            F.bit_xor(F.xxhash64("lo", "hi")),
        ).head()
    )


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node with a link; root: the smallest node reachable.

    Each round hangs the larger neighbours of every node under its smallest
    neighbour, then the smaller ones, until nothing moves; the number of rounds
    grows with the logarithm of the longest path.  The smallest neighbours are
    an aggregate with partial sums before the shuffle, written out before they
    are joined, so that a node with very many links is split by Spark's handling
    of skewed joins.  Every round's links are written to the shared folder.
    """
    ends = (F.col(f"`{a}`"), F.col(f"`{b}`"))
    links = store(
        _distinct(links.select(F.greatest(*ends).alias("hi"), F.least(*ends).alias("lo"))), "links"
    )
    state = _state(links)
    while state[0]:
        both = links.select(F.col("lo").alias("node"), F.col("lo").alias("low")).unionAll(
            links.select(F.col("hi").alias("node"), F.col("lo").alias("low"))
        )
        least = store(both.groupBy("node").agg(F.min("low").alias("low")), "least")
        large = links.join(least, links["lo"] == least["node"]).select("hi", F.col("low").alias("lo"))
        large = store(_distinct(large), "large")
        low = store(large.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("low")), "low")
        small = large.join(low, large["hi"] == low["node"])
        links = store(
            _distinct(
                small.select(F.greatest("lo", "low").alias("hi"), F.least("lo", "low").alias("lo")).unionAll(
                    low.select(F.col("node").alias("hi"), F.col("low").alias("lo"))
                )
            ),
            "links",
        )
        before, state = state, _state(links)
        if before == state:
            break
    roots = links.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return store(links.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(roots), "roots")
