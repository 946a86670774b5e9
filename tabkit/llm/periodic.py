"""Periodic runs of words, from seeds that are extended along their diagonal.

A run of period q repeats itself q words on, over a stretch of a guaranteed
length.  Runs of words of that length are therefore indexed, and an occurrence
with the next one in the same text is a seed on the diagonal of their distance.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.llm.quality import docs_key_type
from tabkit.llm.texts import columns_batch, in_arrow, words_of

#: Words of several texts that are indexed in one go; a longer text goes alone.
CHUNK = 400_000


def overlaps(n: int, least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """``(low, high, size)``: lags from low to below high, and the run of words they share.

    A run of period q has ``max(least, times * q)`` words or more and agrees with
    itself, q words on, in all but q of them.  The sizes do not fall, and none is
    below its lags: a next occurrence that is nearer than the smallest period of
    the run would then be a smaller period.
    """

    def shared(low: int) -> int:
        # Falls with the period up to least / times, then rises.
        lags = {low, *(max(low, min(least // times + d, 2 * low - 1)) for d in (0, 1))}
        return min(max(least, times * q) - q for q in lags)

    lows = [1 << j for j in range(n.bit_length()) if max(least, times << j) <= n]
    for j, low in enumerate(lows):
        yield low, 2 * low, min(map(shared, lows[j:]))


def longer(names: np.ndarray, shift: int) -> np.ndarray:
    """Names of the runs of words that a run and the one ``shift`` on make up.

    ``names`` has a number per position, equal for equal runs, and -1 where the
    run comes once only: what is longer comes once too.
    """
    out = np.full(len(names), -1, np.int64)
    if shift >= len(names):
        return out
    at = np.flatnonzero((names[:-shift] >= 0) & (names[shift:] >= 0))
    if len(at):
        both = names[at] * (names.max() + 1) + names[at + shift]
        _, named, times = np.unique(both, return_inverse=True, return_counts=True)
        out[at] = np.where(times[named] > 1, named, -1)
    return out


def agreeing(words: np.ndarray, at: int, lag: int, step: int) -> int:
    """How many words from ``at`` on, in steps of 1 or -1, equal the word ``lag`` later."""
    found, look = 0, 16
    while True:
        if step > 0:
            a, b = at + found, min(at + found + look, len(words) - lag)
            same = words[a:b] == words[a + lag : b + lag]
        else:
            a, b = max(0, at - found - look + 1), at - found + 1
            same = (words[a:b] == words[a + lag : b + lag])[::-1]
        if not same.all():
            return found + int(np.argmin(same))
        if len(same) < look:
            return found + len(same)
        found, look = found + look, look * 2


def runs_of(words: np.ndarray, least: int = 6, times: int = 4, longest: int | None = None) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run, by start and period.

    Equal numbers are equal words.  ``longest`` bounds the length of a text in
    ``words``, where several stand side by side with a number of its own, found
    nowhere else, between them.

    Per size, an occurrence makes a seed with the next one only: inside a run
    that is one period on.  So there are no more seeds than words, whatever
    repeats.  Seeds in a row are one; a table of how far each lag is covered
    keeps a stretch from being extended again.
    """
    if times < 3:
        raise ValueError("runs of less than three periods have no seed of their own")
    found: list[tuple[int, int, int]] = []
    names, size = np.where(np.bincount(words)[words] > 1, words, -1) if len(words) else words, 1
    for low, high, wanted in overlaps(longest or len(words), least, times):
        while size < wanted:
            shift = min(size, wanted - size)
            names, size = longer(names, shift), size + shift
        at = np.flatnonzero(names >= 0)
        if not len(at):
            break
        at = at[np.argsort(names[at], kind="stable")]
        lag = np.where(names[at[1:]] == names[at[:-1]], at[1:] - at[:-1], 0)
        near = (lag >= low) & (lag < high)
        if not near.any():
            continue
        at, lag = at[:-1][near], lag[near]
        order = np.lexsort((at, lag))
        at, lag = at[order], lag[order]
        first = np.ones(len(at), bool)
        first[1:] = (lag[1:] != lag[:-1]) | (at[1:] != at[:-1] + 1)
        heads = np.flatnonzero(first)
        tails = np.append(heads[1:], len(at)) - 1
        covered: dict[int, int] = defaultdict(int)
        for i, j, q in zip(at[heads].tolist(), at[tails].tolist(), lag[heads].tolist(), strict=True):
            if i < covered[q]:
                continue
            start = i - agreeing(words, i - 1, q, -1) if i else 0
            end = j + wanted + agreeing(words, j + wanted, q, 1)
            covered[q] = end
            if end - start + q >= max(least, times * q):
                found.append((start, end - start + q, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words but for those after the first period of a run."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return [w for w, gone in zip(words, np.cumsum(edges[:-1]).tolist(), strict=True) if not gone]


def _runs_of_texts(texts: list[list[bytes]], least: int, times: int) -> list[list[tuple[int, int, int]]]:
    """:func:`runs_of` for each text, all indexed together."""
    numbers = count()
    parts, starts = [], np.zeros(len(texts) + 1, np.int64)
    for i, words in enumerate(texts):
        own = defaultdict(numbers.__next__)
        parts.append(np.fromiter(map(own.__getitem__, words), np.int64, len(words)))
        parts.append(np.array([next(numbers)]))
        starts[i + 1] = starts[i] + len(words) + 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    runs = runs_of(np.concatenate(parts), least, times, max(map(len, texts)))
    where = np.searchsorted(starts, [r[0] for r in runs], "right") - 1 if runs else []
    for i, (start, length, period) in zip(where, runs, strict=True):
        out[i].append((start - int(starts[i]), length, period))
    return out


def periodic_runs(
    docs: DataFrame, least: int = 6, times: int = 4, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row: key, ``n_words``, ``runs`` (start, length, period), ``collapsed``.

    A run is a stretch of words with a smallest period q and ``max(least,
    times * q)`` words or more that cannot be made longer on either side; runs
    come by start, then period.  ``collapsed`` is the text's words, joined by one
    space, without those that a run repeats after its first period.  ``times``
    is 3 or more.

    A NULL text, and one without words, has no run and collapses to the empty
    text.  Rows with equal or NULL keys are worked on one by one; an empty table
    gives none, and other columns are not read.  A text is worked on by the task
    that reads it, in time n log n whatever repeats; nothing is shuffled.
    """
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    arrow = pa.schema(
        [(key, docs_key_type(docs, key)), ("n_words", pa.int64()), ("runs", pa.list_(run)), ("collapsed", pa.string())]
    )

    def make():
        def chunk(keys, texts):
            runs = _runs_of_texts(texts, least, times)
            flat = [r for own in runs for r in own]
            fields = np.array(flat, np.int64).reshape(-1, 3).T
            lists = pa.ListArray.from_arrays(
                pa.array(np.cumsum([0, *map(len, runs)]), pa.int32()),
                pa.StructArray.from_arrays([pa.array(f, pa.int64()) for f in fields], fields=list(run)),
            )
            kept = (without_repeats(w, r) for w, r in zip(texts, runs, strict=True))
            columns = (keys, [len(w) for w in texts], lists, [b" ".join(k).decode("utf-8") for k in kept])
            return columns_batch(columns, arrow)

        def step(batch):
            at, held, n = 0, [], 0
            for i, t in enumerate(batch.column(1)):
                held.append(words_of(t.as_py()))
                n += len(held[-1]) + 1
                if n >= CHUNK or i + 1 == batch.num_rows:
                    yield chunk(batch.column(0).slice(at, len(held)), held)
                    at, held, n = i + 1, [], 0

        return step

    kind = docs.schema[key].dataType.simpleString()
    return in_arrow(
        docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")),
        make,
        f"`{key}` {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string",
    )
