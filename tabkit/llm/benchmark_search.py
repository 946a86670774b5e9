"""Passages of test items in documents, by a Wu-Manber search over words.

All windows of the items are looked for at once.  A table gives for the two words
at the end of the place looked at how far the nearest window can be, so most
words are never looked at; where a window may end, its last two words choose the
windows that end with them, and these are compared word by word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.llm.quality import docs_key_type
from tabkit.llm.texts import columns_batch, in_arrow, terms_of
from tabkit.sources import store

#: Distinct windows that are searched for in one pass; more take further passes.
WINDOWS = 500_000


class Search:
    """Shift and suffix tables of windows of one length."""

    def __init__(self, windows: dict[bytes, list[int]]):
        """``windows``: words joined by a space, and the items they stand in."""
        self.size = next(iter(windows)).count(b" ") + 1
        self.block = min(2, self.size)
        self.far = self.size - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.ending: dict[bytes, dict[bytes, list[int]]] = defaultdict(dict)
        for window, items in windows.items():
            words = window.split(b" ")
            for end in range(self.block, self.size + 1):
                pair = b" ".join(words[end - self.block : end])
                self.shift[pair] = min(self.size - end, self.shift.get(pair, self.far))
            self.ending[pair][window] = items

    def ends(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """``(end, items)`` wherever a window ends before word ``end``."""
        shift, far, size, block = self.shift, self.far, self.size, self.block
        end, n = size, len(words)
        while end <= n:
            pair = words[end - 2] + b" " + words[end - 1] if block == 2 else words[end - 1]
            skip = shift.get(pair, far)
            if skip:
                end += skip
                continue
            items = self.ending[pair].get(b" ".join(words[end - size : end]))
            if items is not None:
                yield end, items
            end += 1


def covered(words: list[bytes], searches: Iterable[Search]) -> tuple[list[tuple[int, int]], set[int]]:
    """Stretches ``(start, length)`` of words inside windows, and the items of those."""
    hits: list[tuple[int, int]] = []
    items: set[int] = set()
    for search in searches:
        for end, found in search.ends(words):
            hits.append((end - search.size, end))
            items.update(found)
    return merged(hits), items


def merged(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches ``(start, length)`` that cover what the ``(start, end)`` cover, apart from each other."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(hits):
        if out and start <= out[-1][0] + out[-1][1]:
            first, length = out[-1]
            out[-1] = (first, max(length, end - first))
        else:
            out.append((start, end - start))
    return out


def item_windows(items: DataFrame, size: int, key: str = "item_id", text: str = "text") -> DataFrame:
    """``(window, n, items)``: every run of ``size`` words, and the keys of its items as sorted texts.

    An item of fewer words is one window of its own length ``n``; one without
    words is none.  An item without a key has windows, but no key to list.
    """
    arrow = pa.schema([("item", pa.string()), ("window", pa.string()), ("n", pa.int32())])

    def make():
        def step(batch):
            for item, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = terms_of(t)
                n = min(size, len(words))
                windows = {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()
                if windows:
                    yield columns_batch(([item] * len(windows), [w.decode() for w in windows], [n] * len(windows)), arrow)

        return step

    told = items.select(F.col(f"`{key}`").cast("string"), F.col(f"`{text}`"))
    found = in_arrow(told, make, "item string, window string, n int")
    return found.groupBy("window", "n").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _searches(rows: list) -> tuple[list[Search], list[str]]:
    names: dict[str, int] = {}
    by_size: dict[int, dict[bytes, list[int]]] = defaultdict(dict)
    for window, n, items in rows:
        by_size[n][window.encode()] = [names.setdefault(i, len(names)) for i in items]
    return [Search(w) for _, w in sorted(by_size.items())], list(names)


def _pass(state: DataFrame, rows: list, kind: str, key_type: pa.DataType) -> DataFrame:
    """Look for the windows of ``rows``; adds to what earlier passes found."""
    told = state.sparkSession.sparkContext.broadcast([tuple(r) for r in rows])
    span = pa.struct([("start", pa.int64()), ("length", pa.int64())])
    arrow = pa.schema(
        [("key", key_type), ("text", pa.string()), ("n_words", pa.int64()), ("spans", pa.list_(span)), ("items", pa.list_(pa.string()))]
    )

    def make():
        searches, names = _searches(told.value)

        def step(batch):
            spans, items, n_words = [], [], []
            before = (batch.column(i).to_pylist() for i in (1, 3, 4))
            for t, old_spans, old_items in zip(*before, strict=True):
                words = terms_of(t)
                hits, own = covered(words, searches)
                if old_spans:
                    parts = [(s["start"], s["start"] + s["length"]) for s in old_spans]
                    hits = merged([*parts, *((s, s + n) for s, n in hits)])
                n_words.append(len(words))
                spans.append([{"start": s, "length": n} for s, n in hits])
                items.append(sorted({*old_items, *(names[i] for i in own)}))
            yield columns_batch((batch.column(0), batch.column(1), n_words, spans, items), arrow)

        return step

    return in_arrow(
        state, make, f"key {kind}, text string, n_words bigint, spans array<struct<start:bigint,length:bigint>>, items array<string>"
    )


def benchmark_hits(
    docs: DataFrame,
    items: DataFrame,
    size: int = 10,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per row: key, ``n_words``, ``spans`` (start, length), ``items``.

    Words are runs of digits, letters and characters beyond ASCII, with A-Z
    lower-cased.  ``spans`` are the stretches of words inside an occurrence of a
    window, apart and in order; ``items`` the keys, as sorted texts, of the items
    whose windows occur.  A window is ``size`` consecutive words of an item, or
    all of an item with fewer; windows of several items are listed under each.

    NULL texts have no words and no hits, items without words no windows; equal
    rows are looked at one by one, an empty table gives none, and without items
    nothing is hit.  An item without a key hits but is not listed.

    The items' windows are dealt by hash into blocks of about WINDOWS, each
    searched for in a pass of its own over all texts, so that the tables of a
    task and what reaches the driver at once are bounded; with more than one,
    what a pass found is written before the next.
    """
    kind, key_type = docs.schema[key].dataType.simpleString(), docs_key_type(docs, key)
    windows = store(item_windows(items, size, item_key, item_text), "windows")
    blocks = max(1, -(-windows.count() // WINDOWS))
    state = docs.select(
        F.col(f"`{key}`").alias("key"),
        F.col(f"`{text}`").alias("text"),
        F.lit(0).cast("bigint").alias("n_words"),
        F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    for block in range(blocks):
        mine = F.pmod(F.xxhash64("window"), F.lit(blocks)) == block
        state = _pass(state, windows.where(mine).select("window", "n", "items").collect(), kind, key_type)
        if block + 1 < blocks:
            state = store(state, "searched")
    return state.select(F.col("key").alias(key), "n_words", "spans", "items")
