"""Ranked documents against brute force."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from tabkit.llm import ranked_search
from tabkit.llm.texts import terms_of
from tests.llm.conftest import EDGE


def ranked_by_hand(docs, items, top):
    held = [(d, Counter(terms_of(t))) for d, t, *_ in docs]
    held = [(d, c) for d, c in held if c]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for key, text in items:
        found = []
        for d, c in held:
            m = 50 + 50 * c.total() * n_docs // n_terms
            score = 0
            for t in set(terms_of(text)):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
            if score > 0:
                found.append((d, score))
        found.sort(key=lambda x: (-x[1], x[0] is None, x[0] or 0))
        out += [(key, i + 1, d, s) for i, (d, s) in enumerate(found[:top])]
    return Counter(out)


def table_of(spark, items):
    return spark.createDataFrame([(*i, "odd", "odd") for i in items], "item_id bigint, text string, item string, doc string")


@pytest.mark.parametrize(
    ("terms", "tiles"), [(1_000_000, (256, 2048, 1024)), (1_000_000, (3, 2, 5)), (10, (2, 3, 4))]
)
def test_ranks_by_brute_force(spark, docs_of, monkeypatch, terms, tiles):
    monkeypatch.setattr(ranked_search, "ITEM_TERMS", terms)
    for name, value in zip(("ITEM_TILE", "TERM_TILE", "DOC_TILE"), tiles, strict=True):
        monkeypatch.setattr(ranked_search, name, value)
    rng = random.Random(5)
    vocabulary = ["a", "B", "c", "dé", "日本", "7", "the", "of", "x1", "y2"]
    say = lambda n: ", ".join(rng.choice(vocabulary) for _ in range(n))
    docs = [(i, say(rng.randint(0, 12))) for i in range(120)] + [(500 + i, "the of a") for i in range(40)]
    docs += [(None, "the of a"), (3, "the of a"), (3, "the of a"), *EDGE]
    items = [(k, say(rng.randint(1, 9))) for k in range(9)] + [(2, "a THE of"), (None, "of"), (20, None), (21, "?!"), (22, "nowhere")]
    got = ranked_search.ranked_documents(docs_of(docs, extra=True).repartition(5), table_of(spark, items), top=7)
    assert Counter(map(tuple, got.collect())) == ranked_by_hand(docs, items, 7)


def test_no_rows(spark, docs_of, no_docs):
    items = table_of(spark, [(1, "a river")])
    assert ranked_search.ranked_documents(no_docs, items).collect() == []
    assert ranked_search.ranked_documents(docs_of([(1, None), (2, "--")]), items).collect() == []
    assert ranked_search.ranked_documents(docs_of(EDGE), items.where("item_id > 1")).collect() == []


def test_products_stay_exact():
    """Tiles are cut so that no sum reaches 2**53, however heavy the terms."""
    heavy = 1 << 31
    weights = np.full(40, heavy, np.int64)
    tile = ranked_search.ItemTile([(0, list(range(40)))], weights)
    assert tile.width * heavy * ranked_search.IMPACT < 1 << 53 and len(tile.matrices) > 1
    impact = np.full(40, ranked_search.IMPACT - 1)
    got = tile.scores(np.zeros(40, np.int64), np.arange(40), impact, 1)
    assert got.tolist() == [[40 * heavy * (ranked_search.IMPACT - 1)]]


def test_ties_at_the_edge_go_to_the_smaller_key():
    best = ranked_search.Best(1, 3)
    known = np.ones(4, np.int64)
    for docs in ([9, 8, 7, 6], [5, 4, 3, 2]):
        best.add(np.full((1, 4), 10), np.array(docs), known)
        rows = best.settle()
    assert rows[2].tolist() == [2, 3, 4] and best.least.tolist() == [10]
