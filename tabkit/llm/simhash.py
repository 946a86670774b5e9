"""SimHash near-duplicates, compared bit by bit over many fingerprints at once.

Fingerprints that differ in few bits agree on whole blocks of bits.  They are
grouped by such blocks, and inside a group their bits are stored in planes: plane
k holds bit k of all fingerprints, 64 to a machine word.  Distances to a
fingerprint are then counted for all of them at once by carry-save addition, and
a group is left as soon as all its distances are over the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.llm.components import components
from tabkit.llm.quality import docs_key_type
from tabkit.llm.texts import columns_batch, in_arrow, words_of
from tabkit.sources import store

#: Fingerprints compared with each other in one go.
BLOCK = 512
#: A group above this is split into parts, compared pair by pair of parts.
PART = 1024
#: Bit planes counted between two looks at whether all distances are too large.
LOOK = 8


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64 bits; each is set if it is set in over half of the shingles' hashes.

    A-Z are lower-cased.  Shingles are hashed as XXH64 of their words joined by
    one space; a text with fewer words is one shingle, one without words is 0.
    """
    words = words_of(text)
    if not words:
        return 0
    joined = b" ".join(words).lower()
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[s:e], seed) for s, e in zip(starts[:n].tolist(), last.tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        raw = np.array(hashes[at : at + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(
    docs: DataFrame, shingle: int = 3, seed: int = 42, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(key, bits)``: a fingerprint per row, as a signed 64-bit number."""
    arrow = pa.schema([(key, docs_key_type(docs, key)), ("bits", pa.int64())])

    def make():
        def step(batch):
            found = [fingerprint(t, shingle, seed) for t in batch.column(1).to_pylist()]
            yield columns_batch((batch.column(0), np.array(found, np.uint64).view(np.int64)), arrow)

        return step

    kind = docs.schema[key].dataType.simpleString()
    return in_arrow(
        docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")), make, f"`{key}` {kind}, bits bigint"
    )


def planes_of(bits: np.ndarray) -> np.ndarray:
    """Row k: bit k of all fingerprints, 64 to a word, the last word padded with 0."""
    width = -(-len(bits) // 64)
    cells = np.zeros((width * 64, 64), np.uint8)
    cells[: len(bits)] = np.unpackbits(
        bits.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"
    )
    packed = np.ascontiguousarray(np.packbits(cells.T, axis=1, bitorder="little"))
    return packed.view("<u8").reshape(64, width)


def within(queries: np.ndarray, bits: np.ndarray, radius: int, skip: np.ndarray | None = None) -> np.ndarray:
    """A truth value per query and fingerprint: do they differ in ``radius`` bits at most?

    Pairs marked in ``skip`` are not looked at and come out false.

    Distances are kept as binary counters, one word per digit for 64
    fingerprints; a digit's carry goes into the next, and what leaves the last
    digit marks a distance over the radius for good.
    """
    digits = max(1, radius.bit_length())
    planes = planes_of(bits)
    counter = np.zeros((digits, len(queries), planes.shape[1]), np.uint64)
    settled = np.ones((len(queries), planes.shape[1] * 64), bool)
    settled[:, : len(bits)] = False if skip is None else skip
    over = np.ascontiguousarray(np.packbits(settled, axis=1, bitorder="little")).view(np.uint64)
    ones = np.where((queries[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1), ~np.uint64(0), np.uint64(0))
    for k in range(64):
        carry = planes[k][None, :] ^ ones[:, k][:, None]
        for d in range(digits):
            full = counter[d] & carry
            counter[d] ^= carry
            carry = full
        over |= carry
        if k % LOOK == LOOK - 1 and (over == ~np.uint64(0)).all():
            break
    # Digit by digit from the highest, is the counter larger than the radius?
    same = np.full_like(over, ~np.uint64(0))
    for d in reversed(range(digits)):
        if radius >> d & 1:
            same &= counter[d]
        else:
            over |= same & counter[d]
            same &= ~counter[d]
    near = np.unpackbits(over.view(np.uint8), axis=1, bitorder="little") == 0
    return near[:, : len(bits)]


def near_pairs(bits: np.ndarray, radius: int) -> np.ndarray:
    """The symmetric matrix of :func:`within` among ``bits``, each pair looked at once."""
    found = within(bits, bits, radius, np.tri(len(bits), dtype=bool))
    return found | found.T


def forest(near: np.ndarray) -> Iterator[tuple[int, int]]:
    """A spanning forest of a symmetric matrix, as (first of the tree, other)."""
    free = np.ones(len(near), bool)
    for i in range(len(near)):
        if not free[i]:
            continue
        free[i] = False
        front = near[i] & free
        while front.any():
            free &= ~front
            for j in np.flatnonzero(front):
                yield i, int(j)
            front = near[front].any(axis=0) & free


def block_masks(blocks: int, agree: int) -> list[int]:
    """Masks of ``agree`` of ``blocks`` runs of bits, one for each choice."""
    cuts = np.linspace(0, 64, blocks + 1).round().astype(int)
    runs = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(runs, agree)]


def near_links(prints: DataFrame, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """``(a, b)``: links that join what is joined by fingerprints within ``radius``.

    ``prints`` holds ``(rep, bits)``, each fingerprint once.  Cut into
    ``radius + 2`` runs of bits, two fingerprints within the radius agree on two
    runs at least; each choice of two runs is a table of groups.  A group is
    compared whole in its bit planes; one above PART is dealt into parts, and
    every pair of parts is a group of its own.  Of the links found in one go only
    a spanning forest goes out, so the links never outnumber the rows compared.
    """
    blocks = radius + 2 if blocks is None else blocks
    masks = block_masks(blocks, blocks - radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = prints.select(
        "rep",
        "bits",
        F.posexplode(F.array(*[F.col("bits").bitwiseAND(F.lit(m).cast("bigint")) for m in signed])).alias(
            "tab", "run"
        ),
    )
    sizes = keyed.groupBy("tab", "run").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    sizes = store(sizes, "groups")
    dealt = keyed.join(sizes, ["tab", "run"]).withColumn("parts", F.ceil(F.col("n") / PART).cast("int"))
    own = F.pmod(F.xxhash64("bits"), F.col("parts")).cast("int")
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    cells = (
        dealt.withColumn("own", own)
        .withColumn("other", F.explode(others))
        .select(
            "rep", "bits", "tab", "run",
            F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"),
        )
    )
    grouped = cells.repartition("tab", "run", "p", "q").sortWithinPartitions("tab", "run", "p", "q", "bits")
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches):
        def emit(reps, bits):
            if len(reps) < 2:
                return
            pairs = list(forest(near_pairs(bits, radius)))
            if pairs:
                i, j = np.array(pairs).T
                yield columns_batch((reps[i], reps[j]), arrow)

        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            held.append((cols[0], cols[1].view(np.uint64), np.stack(cols[2:])))
            reps, bits = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            keys = np.concatenate([h[2] for h in held], axis=1)
            ends = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            at = 0
            while len(cut := ends[ends > at]):
                # Whole groups up to a block, or one group that is larger.
                fit = cut[cut <= at + BLOCK]
                to = int(fit[-1]) if len(fit) else int(cut[0])
                yield from emit(reps[at:to], bits[at:to])
                at = to
            held = [(reps[at:], bits[at:], keys[:, at:])]
        for reps, bits, _ in held:
            yield from emit(reps, bits)

    return grouped.mapInArrow(compare, "a bigint, b bigint")


def simhash_groups(
    docs: DataFrame, radius: int = 3, shingle: int = 3, seed: int = 42, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row: key, ``bits``, ``component`` (the smallest key reachable).

    Rows with equal fingerprints are linked through one of them, so copies cost
    one comparison whatever their number.  NULL and empty texts have fingerprint
    0 and are linked like any other.  A row with a NULL key gets the component
    of its fingerprint but never names one; if all keys of a component are NULL,
    it is NULL.  Keys are whole numbers.
    """
    prints = store(fingerprints(docs, shingle, seed, key, text), "prints")
    classes = store(
        prints.groupBy("bits").agg(F.min(F.col(f"`{key}`").cast("bigint")).alias("rep")), "classes"
    )
    named = classes.where(F.col("rep").isNotNull())
    roots = components(near_links(named.select("rep", "bits"), radius))
    known = store(
        classes.join(roots, classes["rep"] == roots["node"], "left").select(
            "bits", F.coalesce("root", "rep").alias("component")
        ),
        "known",
    )
    return prints.join(known, "bits").select(F.col(f"`{key}`"), "bits", "component")


def one_of_each(
    docs: DataFrame, radius: int = 3, shingle: int = 3, seed: int = 42, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of ``docs``, but of each group of :func:`simhash_groups` one row.

    It is the one with the smallest key, NULL last, and of those the first in the
    table; every row counts, whatever its key.  Other columns may have any name.
    ``docs`` is read twice and must give its rows in the same order each time, as
    a written table does.  What moves is two numbers a row; the texts move only if
    Spark finds the table of rows to leave out too large for a broadcast.
    """
    places = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(f"`{c}`").alias(p) for c, p in places.items()])
    plain = plain.withColumn("row", F.monotonically_increasing_id())
    groups = simhash_groups(plain, radius, shingle, seed, "row", places[text])
    keyed = plain.select("row", F.col(places[key]).alias("id"))
    members = store(groups.join(keyed, "row").select("row", "component", "id"), "members")
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))
    first = members.groupBy("component").agg(F.min_by("row", order).alias("first"))
    gone = store(members.join(first, members["row"] == first["first"], "left_anti").select("row"), "gone")
    return plain.join(gone, "row", "left_anti").select(*[F.col(p).alias(c) for c, p in places.items()])
