from __future__ import annotations

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabkit.llm.packing import plan_packs, slot_table
from tabkit.llm.simhash import fingerprint, forest, near_pairs, within
from tabkit.llm.substrings import sliding_min
from tabkit.llm.texts import WordHashes, window_hashes, words_of


@given(st.text())
def test_words_are_the_stated_runs(text):
    want = [w.encode("utf-8", "surrogatepass") for w in re.findall("[^\x20\x09-\x0d]+", text)]
    assert words_of(text) == want


@pytest.mark.parametrize("size", [1, 2, 3, 8, 25, 50])
def test_windows_hash_alike_where_words_do(size):
    rng = np.random.default_rng(size)
    words = [bytes([97 + x]) for x in rng.integers(0, 2, 300)]
    hashes = window_hashes(WordHashes().of(words), size, 12345)
    assert len(hashes) == 301 - size
    by_hash, by_words = {}, {}
    for i, h in enumerate(hashes.tolist()):
        by_hash.setdefault(h, set()).add(i)
        by_words.setdefault(tuple(words[i : i + size]), set()).add(i)
    assert sorted(map(sorted, by_hash.values())) == sorted(map(sorted, by_words.values()))
    assert len(window_hashes(WordHashes().of(words[: size - 1]), size, 3)) == 0


@given(st.lists(st.integers(0, 9), min_size=1, max_size=60), st.integers(1, 60))
def test_sliding_min(values, width):
    a = np.array(values, np.uint64)
    if width <= len(values):
        assert sliding_min(a, width).tolist() == [min(values[i : i + width]) for i in range(len(values) - width + 1)]


@settings(deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=150), st.integers(0, 6), st.randoms())
def test_bit_planes_count_distances(bits, radius, random):
    near = [b ^ sum(1 << random.randrange(64) for _ in range(random.randrange(8))) & (2**64 - 1) for b in bits[:40]]
    a = np.array(bits + near, np.uint64)
    want = np.bitwise_count(a[:, None] ^ a[None, :]) <= radius
    assert (within(a, a, radius) == want).all()
    np.fill_diagonal(want, False)
    assert (near_pairs(a, radius) == want).all()


def test_forest_joins_what_is_linked():
    rng = np.random.default_rng(1)
    near = rng.random((60, 60)) < 0.02
    near |= near.T
    edges = list(forest(near))
    name = list(range(60))

    def root(x):
        while name[x] != x:
            x = name[x]
        return x

    for a, b in edges:
        assert root(a) != root(b)  # a forest has no circle
        name[root(b)] = root(a)
    assert all(root(i) == root(j) for i, j in zip(*np.nonzero(near), strict=True))


def test_fingerprint_by_definition():
    import xxhash

    text = "The quick brown fox jumps over the lazy dog the quick brown fox"
    words = [w.lower() for w in text.encode().split()]
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert fingerprint(text) == want
    assert fingerprint(None) == fingerprint("") == fingerprint(" \n") == 0
    assert fingerprint("Two Words") == xxhash.xxh64_intdigest(b"two words", 42)


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_packs_hold_every_piece_once(histogram):
    plan = plan_packs(histogram, 64)
    assert all(sum(lengths) <= 64 for lengths, _ in plan)
    held = {}
    for lengths, count in plan:
        for n in lengths:
            held[n] = held.get(n, 0) + count
    assert held == histogram
    slots = slot_table(plan)
    for n, total in histogram.items():
        own = slots[slots[:, 0] == n]
        assert own[:, 1].tolist() == [0, *np.cumsum(own[:, 4])[:-1].tolist()] and own[:, 4].sum() == total


def test_a_piece_that_is_too_long_is_an_error():
    with pytest.raises(ValueError, match="does not fit"):
        plan_packs({65: 1}, 64)
