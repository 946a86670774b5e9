"""Substring dedup: passages that stand in an earlier document go.

A passage is a window of a number of words.  Windows are found level by level:
what is not repeated at one length cannot be repeated at twice that, so only
windows repeated at one length are extended to twice that length, until no
candidate survives or the length asked for is reached; longer windows cover no word
that those do not.

At a level below the last, one short window speaks for many long ones: that with
the smallest hash among the short windows inside a long one.  Equal long windows
choose equal short ones, so no repeat is lost, and a few in a hundred of all
windows are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabkit.llm.filters import Filter, filter_of
from tabkit.llm.quality import docs_key_type
from tabkit.llm.texts import WordHashes, columns_batch, in_arrow, window_hashes, words_of
from tabkit.sources import store

#: Windows of the first level have this many words or more, but for sizes below twice that.
SHORTEST = 12
_SHORT, _LONG, _LONG2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each run of ``width`` values."""
    n, run, span = len(values) - width + 1, values, 1
    while span * 2 <= width:
        run = np.minimum(run[:-span], run[span:])
        span *= 2
    return np.minimum(run[:n], run[width - span : width - span + n])


def levels(size: int) -> list[int]:
    """The lengths, each at most twice the one before, up to ``size``; two or more."""
    out = [size, -(-size // 2)]
    while out[-1] >= 2 * SHORTEST:
        out.append(-(-out[-1] // 2))
    return out[::-1]


def chosen(hashes: np.ndarray, size: int, part: int) -> np.ndarray:
    """For each window of ``size`` words the hash of the window of ``part`` words that speaks for it."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64)
    short = window_hashes(hashes, part, _SHORT)
    short = (short ^ (short >> np.uint64(29))) * _MIX
    return sliding_min(short, size - part + 1)


def long_hashes(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits per window, in two halves."""
    other = (hashes ^ (hashes >> np.uint64(31))) * _MIX
    return window_hashes(hashes, size, _LONG), window_hashes(other ^ (other >> np.uint64(33)), size, _LONG2)


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _given(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Key, the number it is compared by, a print of the text, and the text."""
    last = (1 << 63) - 1
    return docs.select(
        F.col(f"`{key}`").alias("key"),
        F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(last)).alias("did"),
        F.xxhash64(F.col(f"`{text}`")).alias("print"),
        F.col(f"`{text}`").alias("text"),
    )


def _looked_at(docs: DataFrame, size: int) -> DataFrame:
    """A row per row: its words' number and digests, and the chosen windows of the first level."""
    part = levels(size)[0]
    arrow = pa.schema(
        [("key", docs_key_type(docs, "key")), ("did", pa.int64()), ("print", pa.int64()), ("n_words", pa.int64()),
         ("whole", pa.string()), ("content", pa.binary()), ("short", pa.list_(pa.int64()))]
    )

    def make():
        hashes = WordHashes()

        def step(batch) -> Iterator[pa.RecordBatch]:
            rows = []
            for k, did, mark, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(t)
                found = np.unique(chosen(hashes.of(words), size, part)) if len(words) >= size else np.zeros(0, np.uint64)
                content = xxhash.xxh3_128_digest(b" ".join(words))
                rows.append((k, did, mark, len(words), _digest(words), content, found.view(np.int64)))
            yield columns_batch(zip(*rows, strict=True), arrow)

        return step

    kind = docs.schema["key"].dataType.simpleString()
    return in_arrow(
        docs,
        make,
        f"key {kind}, did bigint, print bigint, n_words bigint, whole string, content binary, short array<bigint>",
    )


def _windows(flagged: DataFrame, size: int) -> DataFrame:
    """Texts with the hashes of those long windows whose short one is repeated."""
    part = levels(size)[-2]
    arrow = pa.schema(
        [("did", pa.int64()), ("print", pa.int64()), ("text", pa.string()), ("high", pa.list_(pa.int64())),
         ("low", pa.list_(pa.int64())), ("start", pa.list_(pa.int32()))]
    )

    def make():
        hashes = WordHashes()

        def step(batch) -> Iterator[pa.RecordBatch]:
            rows = []
            for did, mark, t, short in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = hashes.of(words_of(t))
                good = np.flatnonzero(np.isin(chosen(words, size, part), np.array(short, np.int64).view(np.uint64)))
                high, low = (h[good].view(np.int64) for h in long_hashes(words, size))
                rows.append((did, mark, t, high, low, good.astype(np.int32)))
            yield columns_batch(zip(*rows, strict=True), arrow)

        return step

    return in_arrow(
        flagged.select("did", "print", "text", "short"),
        make,
        "did bigint, print bigint, text string, high array<bigint>, low array<bigint>, start array<int>",
    )


def _without(found: DataFrame, size: int) -> DataFrame:
    """``(did, print, n_removed, kept)`` from texts and the starts of windows to remove."""
    arrow = pa.schema([("did", pa.int64()), ("print", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def make():
        def step(batch) -> Iterator[pa.RecordBatch]:
            rows = []
            for did, mark, t, starts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(t)
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, starts, 1)
                np.add.at(change, np.array(starts) + size, -1)
                stays = np.cumsum(change)[:-1] == 0
                kept = [w for w, s in zip(words, stays.tolist(), strict=True) if s]
                rows.append((did, mark, len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")))
            yield columns_batch(zip(*rows, strict=True), arrow)

        return step

    return in_arrow(
        found.select("did", "print", "text", "starts"), make, "did bigint, print bigint, n_removed bigint, kept string"
    )


def _repeated(windows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The keys seen in two documents or more, with the smallest of these.

    Partial minima go into the shuffle, one row per key and task; the result is
    written, so that the join with it can be split where a key is hot.
    """
    seen = windows.groupBy(*keys).agg(F.min("did").alias("first"), F.max("did").alias("last"))
    return store(seen.where(F.col("first") < F.col("last")).drop("last"), name)


def _extended(given: DataFrame, known: Filter, size: int, part: int, longer: int) -> DataFrame:
    """``(did, print, short)``: chosen windows of ``longer`` words, where that of ``part`` words may be repeated."""
    arrow = pa.schema([("did", pa.int64()), ("print", pa.int64()), ("short", pa.list_(pa.int64()))])
    told = given.sparkSession.sparkContext.broadcast(known)

    def make():
        hashes, passing = WordHashes(), told.value

        def step(batch) -> Iterator[pa.RecordBatch]:
            rows = []
            for did, mark, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = hashes.of(words_of(t))
                good = passing.passes(chosen(words, size, part))
                if good.any():
                    rows.append((did, mark, np.unique(chosen(words, size, longer)[good]).view(np.int64)))
            if rows:
                yield columns_batch(zip(*rows, strict=True), arrow)

        return step

    return in_arrow(given.select("did", "print", "text"), make, "did bigint, print bigint, short array<bigint>")


def _candidates(given: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """The long windows of ``rows`` whose windows at all levels below are repeated, with their texts.

    A level is a pass over the texts that extends what the level before found
    repeated; which windows those are goes to the tasks as a filter, and what it
    lets pass beyond them is found out at the next level.
    """
    lengths, lists = levels(size), rows.select("did", "print", "short")
    for part, longer in zip(lengths, lengths[1:-1], strict=False):
        again = _repeated(lists.select("did", F.explode("short").alias("hash")), ["hash"], "short")
        longer_ones = _extended(given, filter_of(again, "hash"), size, part, longer)
        lists = store(longer_ones.join(rows.select("did", "print"), ["did", "print"], "left_semi"), "lists")
    short = lists.select("did", "print", F.explode("short").alias("hash"))
    again = _repeated(short, ["hash"], "short").select("hash")
    flagged = store(
        short.join(again, "hash").groupBy("did", "print").agg(F.collect_set("hash").alias("short")), "flagged"
    )
    return store(_windows(given.drop("key").join(flagged, ["did", "print"]), size), "windows")


def repeat_lengths(docs: DataFrame, size: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, length)`` for rows that share a window of ``size`` words with another key.

    ``length`` is the longest of ``size``, twice that, four times that, ... for
    which a window of the row is also in a row with another key.  A window is
    extended only if it and the one that starts where it ends are repeated, and
    the levels end when no candidate survives.  Later levels read hashes alone.
    Keys are one row each here: rows that repeat a key count as its windows.
    """
    given = _given(docs, key, text)
    windows = _candidates(given, store(_looked_at(given, size), "rows"), size)
    level = windows.select("did", F.inline(F.arrays_zip("high", "low", "start")), F.col("print").alias("of"))
    length, found = size, []
    while True:
        known = _repeated(level, ["high", "low"], "level").drop("first")
        level = store(level.join(known, ["high", "low"]).distinct(), "repeats")
        if level.isEmpty():
            break
        found.append(level.select("did", F.lit(length).alias("length")).distinct())
        here = [F.col(c) for c in ("did", "of", "start", "high", "low")]
        after = level.select(
            "did", "of", (F.col("start") - length).alias("start"), F.col("high").alias("_high"), F.col("low").alias("_low")
        )
        both = level.select(*here).join(after, ["did", "of", "start"])
        parts = ("high", "low", "_high", "_low")
        level = both.select(
            "did", "of", "start", F.xxhash64(F.lit(1), *parts).alias("high"), F.xxhash64(F.lit(2), *parts).alias("low")
        )
        length *= 2
    if not found:
        return docs.select(F.col(f"`{key}`"), F.lit(size).alias("length")).limit(0)
    longest = reduce(DataFrame.unionByName, found).groupBy("did").agg(F.max("length").alias("length"))
    last = F.lit((1 << 63) - 1)
    named = F.when(F.col("did") != last, F.col("did")).cast(docs.schema[key].dataType)
    return longest.select(named.alias(key), "length")


def remove_repeats(
    docs: DataFrame, size: int = 50, key: str = "doc_id", text: str = "text", texts: bool = True
) -> DataFrame:
    """One row per row: key, n_words, n_removed, kept_sha256 and, with ``texts``, kept_text.

    A word goes if a window of ``size`` words that covers it has a word sequence
    that also starts in a row with a smaller key.  Windows are those of the input.
    Words are compared as they are; what is kept is joined by single spaces.
    NULL texts have no words.  NULL keys come after all others and are equal to
    each other; rows with equal keys take nothing from each other.

    Rows that repeat the words of a row with a smaller key go as a whole and are
    not looked at further: what they hold, the first one holds.  ``kept_text``
    is NULL where nothing was removed, as the text itself says it.
    """
    if size < 2:
        raise ValueError("a window has two words or more")
    given = _given(docs, key, text)
    rows = store(_looked_at(given, size), "rows")
    firsts = store(rows.groupBy("content").agg(F.min("did").alias("first")), "contents")
    rows = store(
        rows.join(firsts, "content").withColumn("copy", F.col("did") > F.col("first")).drop("content", "first"),
        "judged",
    )
    windows = _candidates(given, rows.where(~F.col("copy")), size)
    each = windows.select("did", "print", F.inline(F.arrays_zip("high", "low", "start")))
    known = _repeated(each, ["high", "low"], "long")
    gone = (
        each.join(known, ["high", "low"])
        .where(F.col("did") > F.col("first"))
        .groupBy("did", "print")
        .agg(F.collect_set("start").alias("starts"))
    )
    cut = _without(windows.select("did", "print", "text").join(gone, ["did", "print"]), size)
    kept: list[Column] = [F.first("kept").alias("kept")] if texts else []
    changed = cut.groupBy("did", "print").agg(
        F.first("n_removed").alias("n_removed"), F.sha2(F.first("kept"), 256).alias("sha"), *kept
    )
    whole = F.col("copy") & (F.col("n_words") >= size)
    out = rows.drop("short").join(changed, ["did", "print"], "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(
        F.col("key").alias(key),
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(whole, F.lit(empty)).otherwise(F.coalesce("sha", "whole")).alias("kept_sha256"),
        *([F.when(whole, F.lit("")).otherwise(F.col("kept")).alias("kept_text")] if texts else []),
    )
