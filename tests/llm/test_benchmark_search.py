"""The search for windows of test items against brute force."""

from __future__ import annotations

import random

import pytest

from tabkit.llm import benchmark_search
from tabkit.llm.texts import terms_of
from tests.llm.conftest import EDGE


def hits_by_hand(words, items, size):
    hit, names = set(), set()
    for key, text in items:
        own = terms_of(text)
        n = min(size, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        at = [i for i in range(len(words) - n + 1) if tuple(words[i : i + n]) in windows] if windows else []
        hit |= {x for i in at for x in range(i, i + n)}
        if at and key is not None:
            names.add(str(key))
    return hit, sorted(names)


def spread(spans):
    out = [i for s in spans for i in range(s["start"], s["start"] + s["length"])]
    assert out == sorted(set(out))
    ends = [(s["start"], s["start"] + s["length"]) for s in spans]
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:], strict=False))
    return set(out)


@pytest.mark.parametrize("windows", [500_000, 40])
def test_hits_by_brute_force(spark, docs_of, monkeypatch, windows):
    monkeypatch.setattr(benchmark_search, "WINDOWS", windows)
    rng = random.Random(7)
    vocabulary = ["a", "B", "c", "Ünïcode", "日本", "7", "the"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, say(rng.choice([1, 3, 4, 5, 9, 12, 20]))) for k in range(12)]
    items += [(3, items[0][1].upper()), (100, items[5][1]), (None, "one of no key at all"), (9, None), (10, ""), (11, "--- !!")]
    table = spark.createDataFrame([(*i, "odd") for i in items], "item_id bigint, text string, window string")
    docs = [(i, say(rng.randint(0, 60))) for i in range(150)]
    docs += [(200 + i, "x, " + t.replace(" ", "-- ") + "!") for i, (_, t) in enumerate(items) if t]
    docs += [*EDGE, (300, "says one of NO key at all, twice: one of no key at all")]
    got = benchmark_search.benchmark_hits(docs_of(docs, extra=True), table, size=5).collect()
    assert len(got) == len(docs)
    left = [(d, t) for d, t, *_ in docs]
    for r in got:
        match = [x for x in left if x[0] == r["doc_id"] and len(terms_of(x[1])) == r["n_words"] and (
            hits_by_hand(terms_of(x[1]), items, 5) == (spread(r["spans"]), r["items"]))]
        assert match, r
        left.remove(match[0])
    assert not left


def test_nothing_to_find(spark, docs_of, no_docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    got = benchmark_search.benchmark_hits(docs_of(EDGE), none).collect()
    assert len(got) == len(EDGE) and all(r["spans"] == [] and r["items"] == [] for r in got)
    some = spark.createDataFrame([("b", "one two"), ("a", "one two")], "item_id string, text string")
    assert benchmark_search.benchmark_hits(no_docs, some).collect() == []
    both = benchmark_search.benchmark_hits(docs_of([(1, "say ONE,TWO")]), some).head()
    assert both["items"] == ["a", "b"] and [tuple(s) for s in both["spans"]] == [(1, 2)]


def test_most_words_are_not_looked_at():
    search = benchmark_search.Search({b"a b c d e f g h i j": [0]})
    looked = []

    class Seen(dict):
        def get(self, key, other=None):
            looked.append(key)
            return super().get(key, other)

    search.shift = Seen(search.shift)
    words = [b"x%d" % i for i in range(9000)] + [bytes([c]) for c in b"abcdefghij"]
    assert [e for e, _ in search.ends(words)] == [9010]
    assert len(looked) < 1100
