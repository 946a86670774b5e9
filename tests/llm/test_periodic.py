"""Runs of words against brute force."""

from __future__ import annotations

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from tabkit.llm import periodic
from tabkit.llm.queries import QUERIES, planted_cycles
from tabkit.sources import read_table
from tests.conftest import SMALL
from tests.llm.conftest import EDGE


def runs_by_hand(words, least=6, times=4):
    n, found = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            run = words[i : j + q]
            smaller = any(all(run[x] == run[x + p] for x in range(len(run) - p)) for p in range(1, q))
            if len(run) >= max(least, times * q) and not smaller:
                found.append((i, len(run), q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def some_words(rng):
    letters = rng.choice([1, 2, 2, 3, 4])
    if rng.random() < 0.4:
        return [rng.randrange(letters) for _ in range(rng.randint(0, 60))]
    words = []
    while len(words) < 50:
        block = [rng.randrange(letters + 1) for _ in range(rng.randint(1, 12))]
        words += (block * rng.randint(1, 7))[: rng.randint(1, 60)]
    return words


@pytest.mark.parametrize(("least", "times"), [(6, 4), (1, 3), (9, 5), (20, 4)])
def test_runs_by_brute_force(least, times):
    rng = random.Random(least)
    for _ in range(800):
        words = some_words(rng)
        assert periodic.runs_of(np.array(words, np.int64), least, times) == runs_by_hand(words, least, times), words


def test_texts_side_by_side_keep_apart(monkeypatch):
    rng = random.Random(3)
    texts = [[str(w).encode() for w in some_words(rng)] for _ in range(120)]
    found = periodic._runs_of_texts(texts, 6, 4)
    assert found == [runs_by_hand(t) for t in texts]


def test_two_periods_are_refused():
    with pytest.raises(ValueError, match="three periods"):
        periodic.runs_of(np.zeros(9, np.int64), 6, 2)


@pytest.mark.parametrize("make", ["one word", "two words at random", "a long period", "nested"])
def test_long_texts_take_no_quadratic_time(make):
    n, rng = 300_000, np.random.default_rng(2)
    nested = np.zeros(1, np.int64)
    while len(nested) < n:
        nested = np.concatenate([np.tile(nested, 5), [len(nested)]])
    words = {
        "one word": np.zeros(n, np.int64),
        "two words at random": rng.integers(0, 2, n),
        "a long period": np.tile(np.arange(n // 5), 5),
        "nested": nested,
    }[make]
    began = time.time()
    runs = periodic.runs_of(words)
    assert time.time() - began < 30
    if make == "one word":
        assert runs == [(0, n, 1)]
    if make == "a long period":
        assert runs == [(0, n, n // 5)]


def test_periodic_table(spark, docs_of, no_docs, monkeypatch):
    monkeypatch.setattr(periodic, "CHUNK", 40)
    data = [*EDGE, (20, "x a b a b a b a b y"), (20, "x a b a b a b a b y"), (21, "go " * 6), (22, "go " * 5)]
    got = periodic.periodic_runs(docs_of(data, extra=True)).collect()
    assert len(got) == len(data)
    by_key = {}
    for r in got:
        by_key.setdefault(r["doc_id"], []).append(r)
    for d, t, *_ in data:
        words = (t or "").encode().split()
        want = runs_by_hand(words) if len(words) < 2000 else None
        for r in by_key[d]:
            assert r["n_words"] == len(words)
            if want is not None:
                assert [tuple(x) for x in r["runs"]] == want
    assert {r["collapsed"] for r in by_key[20]} == {"x a b y"}
    assert by_key[21][0]["collapsed"] == "go" and by_key[22][0]["collapsed"] == "go go go go go"
    assert by_key[1][0]["collapsed"] == by_key[3][0]["collapsed"] == ""
    assert periodic.periodic_runs(no_docs).collect() == []


def test_planted_cycles_and_digests_by_hand(spark, docs_of):
    texts = {r["doc_id"]: r["text"] for r in read_table(spark, SMALL, "documents").collect()}
    planted = {r["doc_id"]: r["text"] for r in planted_cycles(read_table(spark, SMALL, "documents")).collect()}
    got = {r["doc_id"]: r for r in QUERIES["op11_periodic_runs"](spark, SMALL).collect()}
    changed = 0
    for d, text in texts.items():
        words = text.encode().split()
        h, n = zlib.crc32(str(d).encode()), len(words)
        if h % 10 == 0 and n:
            a = (h // 10) % n
            p = 1 + (n - a) // (3 + (h // 10) % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            changed += 1
            assert planted[d].encode().split() == words
        else:
            assert planted[d] == text
        if n > 1500:
            continue
        runs = runs_by_hand(words)
        mine = got[d]
        assert mine["n_runs"] == len(runs)
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        assert mine["runs_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        assert mine["collapsed_sha256"] == hashlib.sha256(kept).hexdigest()
        if runs:
            best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]))
            assert (mine["start"], mine["length"], mine["period"]) == best
            assert mine["exponent_milli"] == 1000 * best[1] // best[2]
        else:
            assert mine["start"] is mine["length"] is mine["period"] is mine["exponent_milli"] is None
    assert changed > 5
    odd = docs_of([(None, "a b"), (0, None), (0, ""), (0, " "), (19, "one")])
    assert [r["text"] for r in planted_cycles(odd).collect()][:2] == ["a b", None]
