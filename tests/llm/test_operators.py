"""Each operator against brute force, and on the edge table."""

from __future__ import annotations

import hashlib
import math
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from tabkit import sources
from tabkit.llm import (
    compression,
    filters,
    language,
    mixing,
    packing,
    quality,
    secret_scan,
    simhash,
    substrings,
    suffix_tree,
    vectors,
)
from tabkit.llm.components import components
from tests.conftest import rows
from tests.llm.conftest import EDGE, LONG, PROSE


def closure(n, linked):
    """Smallest reachable number of each of n items."""
    low = list(range(n))
    moved = True
    while moved:
        moved = False
        for i in range(n):
            for j in range(n):
                if linked(i, j) and low[j] < low[i]:
                    low[i], moved = low[j], True
    return low


# 1 ---------------------------------------------------------------------------


def vector_rows():
    rng = np.random.default_rng(4)
    base = rng.standard_normal((30, 20))
    near = base[:12] + 0.03 * rng.standard_normal((12, 20))
    chain = [base[20] + 0.03 * k * base[21] for k in range(12)]
    found = [(i, [float(x) for x in v], i % 2) for i, v in enumerate(np.concatenate([base, near]))]
    found += [(100 + k, [float(x) for x in v], 0) for k, v in enumerate(chain)]
    found += [(200 + k, [0.5] * 20, 1) for k in range(9)]
    return found


@pytest.mark.parametrize(("part", "target"), [(4096, 1024), (4, 1024), (4096, 3), (5, 2)])
def test_vectors_by_brute_force(spark, monkeypatch, part, target):
    monkeypatch.setattr(vectors, "PART", part)
    monkeypatch.setattr(vectors, "TARGET", target)
    data = vector_rows()
    table = spark.createDataFrame(data, "vec_id bigint, embedding array<double>, label int").repartition(5)
    x = np.array([v for _, v, _ in data])
    x /= np.linalg.norm(x, axis=1)[:, None]
    cosine, label = x @ x.T, np.array([y for _, _, y in data])
    linked = (cosine >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    low = closure(len(data), lambda i, j: linked[i, j])
    want = [(d[0], int(linked[i].sum()), data[low[i]][0], low[i] == i) for i, d in enumerate(data)]
    assert linked.sum() > 60
    assert rows(vectors.near_vectors(table)) == sorted(want, key=repr)


def test_vectors_that_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0, 0.0], [nan, 1.0], [inf, 1.0], [None, 1.0], [1.0, 0.0, 0.0]]
    data = [(i, v, 1, "x") for i, v in enumerate(odd)]
    data += [(10, [1.0, 0.0], 1, "x"), (11, [2.0, 0.0], 1, "x"), (12, [1.0, 0.0], None, "x"), (None, [1.0, 0.0], 1, "x")]
    data += [(10, [1.0, 0.0], 1, "x"), (13, [1e200, 0.0], 1, "x")]
    table = spark.createDataFrame(data, "vec_id bigint, embedding array<double>, label int, rep string")
    got = rows(vectors.near_vectors(table))
    assert got.count((10, 3, 10, True)) == 2
    assert (11, 3, 10, False) in got and (13, 3, 10, False) in got and (12, 0, 12, True) in got
    assert (None, 0, None, False) in got
    assert all((i, 0, i, True) in got for i in range(len(odd)))
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert rows(vectors.near_vectors(empty)) == []


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = dict(rows(components(spark.createDataFrame(edges, "a bigint, b bigint"))))
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)}


# 2 ---------------------------------------------------------------------------


def without_repeats(data, size):
    last = float("inf")
    key = lambda d: last if d is None else d
    first = {}
    words = [(t or "").encode().split() for _, t in data]
    for (d, _), w in zip(data, words, strict=True):
        for i in range(len(w) - size + 1):
            run = tuple(w[i : i + size])
            first[run] = min(first.get(run, last), key(d))
    for (d, _), w in zip(data, words, strict=True):
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < key(d):
                gone.update(range(i, i + size))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        yield d, len(w), len(gone), hashlib.sha256(kept).hexdigest()


def test_levels_double():
    assert substrings.levels(50) == [13, 25, 50]
    assert substrings.levels(200) == [13, 25, 50, 100, 200]
    assert substrings.levels(5) == [3, 5] and substrings.levels(2) == [1, 2]


@pytest.mark.parametrize(("size", "shortest"), [(2, 12), (5, 12), (8, 12), (8, 2), (9, 1)])
def test_substrings_by_brute_force(spark, size, shortest, monkeypatch):
    monkeypatch.setattr(substrings, "SHORTEST", shortest)
    rng = np.random.default_rng(size)
    passage = [f"p{i}" for i in range(20)]
    data = []
    for d in range(40):
        w = [f"w{x}" for x in rng.integers(0, 30, rng.integers(0, 40))]
        if d % 3 == 0:
            at = rng.integers(0, len(w) + 1)
            w[at:at] = passage[: rng.integers(1, 20)]
        data.append((d % 35, " ".join(w)))
    data += [(90, data[3][1]), (91, data[3][1]), (3, data[3][1]), (None, data[3][1]), (None, data[4][1] + " end")]
    table = spark.createDataFrame(data, "doc_id bigint, text string")
    want = sorted(without_repeats(data, size), key=repr)
    assert sum(w[2] for w in want) > 0
    assert rows(substrings.remove_repeats(table, size, texts=False)) == want


def test_substring_texts_and_edges(edge_docs, no_docs):
    got = substrings.remove_repeats(edge_docs, 50)
    assert rows(got.drop("kept_text")) == sorted(without_repeats([r[:2] for r in EDGE], 50), key=repr)
    assert {r["kept_text"] for r in got.where("doc_id = 5").collect()} == {""}
    assert rows(substrings.remove_repeats(no_docs, 50)) == []


def test_repeats_are_doubled_until_none_is_left(spark, no_docs):
    rng = np.random.default_rng(2)
    a, b, c, d = ([f"{x}{i}" for i in range(100)] for x in "abcd")
    noise = lambda n: [f"n{x}" for x in rng.integers(0, 10**9, n)]
    data = [a + noise(9), noise(7) + a, b[:35] + noise(3), noise(2) + b[:35], c, c[:20] + noise(2) + c[20:39], noise(50) + d[:15], None, d[:15]]
    table = spark.createDataFrame([(i, None if w is None else " ".join(w)) for i, w in enumerate(data)], "doc_id bigint, text string")
    words = [w or [] for w in data]

    def longest(i):
        n, best = 10, 0
        runs = lambda w: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        while any(runs(words[i]) & runs(words[j]) for j in range(len(words)) if j != i):
            n, best = 2 * n, n
        return best

    want = {i: longest(i) for i in range(len(words)) if longest(i)}
    assert set(want.values()) == {10, 20, 80} and len(want) == 8
    assert dict(rows(substrings.repeat_lengths(table, 10))) == want
    assert rows(substrings.repeat_lengths(no_docs, 10)) == []


# 3 ---------------------------------------------------------------------------


def test_compression_tells_noise_from_prose(spark, docs_of, edge_docs, no_docs):
    rng = np.random.default_rng(3)
    words = PROSE.split()
    good = [" ".join(rng.choice(words, 80)) for _ in range(60)]
    bad = ["".join(chr(33 + x) for x in rng.integers(0, 60, 400)) for _ in range(60)]
    docs = docs_of([(i, t, "en", "a") for i, t in enumerate(good + bad)])
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)] + [(5, 0), (7, None)], "doc_id bigint, quality int")
    held = compression.held_out("doc_id", 4, 2)
    model = compression.fit_compression(docs, labels, ~held)
    got = {r["doc_id"]: r["score"] for r in compression.compression_scores(docs, model).collect()}
    test = [i for i in range(120) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(test) > 15 and np.mean([(got[i] >= 0.7) == (i < 60) for i in test]) > 0.95
    edges = compression.compression_scores(edge_docs, model).collect()
    assert len(edges) == len(EDGE) and all(0 <= r["score"] <= 1 for r in edges)
    assert len({r["score"] for r in edges if r["doc_id"] in (1, 2)}) == 1
    # The scores in the cluster are those of the curve.
    measure = compression.Measure(model.good, model.bad)
    mine = compression.scores(model.weights, np.array([measure.sizes(t) for t in good + bad]))
    assert np.allclose(mine, [got[i] for i in range(120)])
    nothing = compression.fit_compression(no_docs, labels, ~held)
    assert {r["score"] for r in compression.compression_scores(edge_docs, nothing).collect()} == {0.5}
    one = compression.fit_compression(docs.where("doc_id < 60"), labels, ~held)
    assert all(r["score"] > 0.9 for r in compression.compression_scores(docs, one).collect())
    assert compression.compression_scores(no_docs, model).collect() == []


def score_by_hand(text, model):
    """Blocks of 2 KB under each dictionary, and the curve, with zstandard alone."""
    raw, sizes = (text or "").encode(), []
    for own in (model.good, model.bad):
        data = zstandard.ZstdCompressionDict(own)
        data.precompute_compress(level=3)
        packer = zstandard.ZstdCompressor(dict_data=data, level=3, write_content_size=False, write_checksum=False, write_dict_id=False)
        sizes.append(sum(len(packer.compress(raw[i : i + 2048])) for i in range(0, len(raw), 2048)))
    good, bad = sizes
    d = 10 * (bad - good) / max(good + bad, 1)
    s = math.log((min(sizes) + 8) / (len(raw) + 8)) if raw else 0.0
    z = sum(w * x for w, x in zip(model.weights, (1, d, s, d * d, s * s, d * s), strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def test_scores_and_calibration_on_held_out_labels(spark):
    """Scores by hand on every document; on labels that taught nothing they are near the truth."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    held = compression.held_out("doc_id", 4, 2)
    model = compression.fit_compression(docs, labels, ~held)
    got = {r["doc_id"]: r["score"] for r in compression.compression_scores(docs, model).collect()}
    for r in docs.collect():
        assert got[r["doc_id"]] == pytest.approx(score_by_hand(r["text"], model), abs=1e-9)
    test = [(got[r["doc_id"]], r["quality"]) for r in labels.where(held).collect()]
    right = [(score >= 0.7) == bool(y) for score, y in test]
    assert len(test) > 80 and np.mean(right) > 0.93
    assert np.mean([(score - y) ** 2 for score, y in test]) < 0.08
    sure = [y for score, y in test if score > 0.8]
    assert len(sure) > 50 and np.mean(sure) > 0.9


# 4 ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_packing_is_a_round_trip(edge_docs, no_docs, tokenizer):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer)
    size = 256
    got = packing.pack_documents(edge_docs, tokenizer, size).toPandas()
    texts = {}
    for d, group in got.groupby("doc_id", dropna=False):
        per = group.sort_values("start")
        texts[None if math.isnan(d) else int(d)] = per
    for d, t, *_ in EDGE:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        mine = texts[d]
        copies = sum(r[0] == d for r in EDGE)
        assert mine["length"].sum() == copies * len(ids) and set(mine["doc_tokens"]) == {len(ids)}
        for r in mine.itertuples():
            piece = ids[r.start : r.start + r.length]
            assert np.frombuffer(r.ids, "<u4").tolist() == piece and 0 < r.length <= size
    for _, pack in got.sort_values("offset").groupby("sequence_id"):
        assert pack["offset"].tolist() == [0, *np.cumsum(pack["length"])[:-1]] and pack["length"].sum() <= size
    used = got["sequence_id"].nunique()
    assert sorted(got["sequence_id"].unique()) == list(range(used))
    assert used <= math.ceil(got["length"].sum() / size) + 1
    assert packing.pack_documents(no_docs, tokenizer).collect() == []


ODD = [
    "İstanbul, Ǆ ß ẞ K ſ", "x y\x1cz\x85w\xa0v", "don't it's 'S we'll 12ab!!", "a<|endoftext|>b, <| x |>",
    "ΣΑΣ. ὈΔΥΣΣΕΎΣ", "日本語 テキスト。", "ÀÉÎÕÜ ×÷ ßÞþ aªbº µ a²b ¼", "The, THE. |||| ,,, _a_b_", "\x00 \x01a", "\xad soft\xad",
    "é ́ a", "ﬁne Ⅷ", "", None,
]


def test_remembered_ids_are_the_tokenizers(tokenizer, monkeypatch):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer)
    monkeypatch.setattr(packing, "KEPT_WORDS", 12)
    words = packing.WordIds(tokenizer)
    for texts in (ODD, ODD[::-1], [PROSE.upper(), LONG[:3000]]):
        for t, ids in zip(texts, words.ids(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == whole.encode(t or "", add_special_tokens=False).ids, t


def packs_by_hand(histogram, size):
    """One piece after the other, longest first, into the shortest pack if it fits."""
    packs = []
    for length in sorted((n for n, k in histogram.items() for _ in range(k)), reverse=True):
        shortest = min(packs, key=sum, default=None)
        if shortest is not None and sum(shortest) + length <= size:
            shortest.append(length)
        else:
            packs.append([length])
    return sorted(map(sum, packs))


def test_the_shortest_pack_comes_first():
    rng = np.random.default_rng(6)
    for _ in range(200):
        size = int(rng.integers(5, 60))
        histogram = {int(n): int(rng.integers(1, 9)) for n in rng.integers(1, size + 1, int(rng.integers(1, 12)))}
        plan = packing.plan_packs(histogram, size)
        assert sorted(sum(p) for p, n in plan for _ in range(n)) == packs_by_hand(histogram, size)
        used = Counter()
        for pattern, n in plan:
            for length in pattern:
                used[length] += n
        assert used == histogram


def test_other_tokenizers_encode_whole_texts(tokenizer):
    from pathlib import Path

    from tokenizers import Tokenizer

    assert not packing.WordIds(tokenizer).whole
    others = []
    for path in sorted(Path(tokenizer).parent.glob("*.json")):
        try:
            Tokenizer.from_file(str(path))
        except Exception:  # not every JSON file there is a tokenizer
            continue
        others.append(str(path))
    assert others
    for path in others:
        whole, words = Tokenizer.from_file(path), packing.WordIds(path)
        for texts in (ODD, [PROSE.upper(), LONG[:3000]]):
            for t, ids in zip(texts, words.ids(texts), strict=True):
                assert np.frombuffer(ids, "<u4").tolist() == whole.encode(t or "", add_special_tokens=False).ids, (path, t)


# 5 ---------------------------------------------------------------------------


def targets_by_hand(sizes, weights, share, most):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, target = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not full:
            target |= {s: left * weight[s] / total for s in open_}
            break
        target |= {s: most * sizes[s] for s in full}
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


def test_mixing_meets_its_targets(spark):
    rng = np.random.default_rng(5)
    data = [
        (i, "w " * int(rng.integers(0, 60)), [f"s{k}" for k in range(5)][k % 5] if k else None)
        for i, k in enumerate(rng.choice([0, 1, 1, 1, 2, 3, 4], 3000).tolist())
    ]
    table = spark.createDataFrame(data, "doc_id bigint, text string, source string")
    got = mixing.mix_sources(table).toPandas()
    source = {d: s for d, _, s in data}
    sizes = Counter()
    for d, t, s in data:
        sizes[s] += len(t.split())
    want = targets_by_hand(sizes, (3, 1, 2), 1.5, 2)
    got["source"] = got["doc_id"].map(source).fillna("-")
    assert (got["taken"] == got["copies"] * got["size"]).all() and (got["copies"] <= 2).all()
    for s, n in sizes.items():
        own = got[got["source"] == (s or "-")]
        assert (own["source_size"] == n).all() and np.allclose(own["target"], want[s])
        assert abs(own["taken"].sum() - want[s]) <= own["size"].max() / 2 + 1
    again = mixing.mix_sources(table.repartition(9)).toPandas()
    assert sorted(map(tuple, got.drop(columns="source").values)) == sorted(map(tuple, again.values))
    # Which documents are taken does not depend on their length.
    some = got[(got["target"] % got["source_size"] > 0) & (got["size"] > 0)]
    drawn = some["copies"] > np.floor(some["target"] / some["source_size"])
    assert abs(some["size"][drawn].mean() / some["size"].mean() - 1) < 0.15


def test_mixing_by_own_weights(spark):
    data = [(i, "w " * 10, "s", float(i % 4)) for i in range(2000)]
    table = spark.createDataFrame(data, "doc_id bigint, text string, source string, size double")
    got = mixing.mix_sources(table, weights=(1.0,), share=0.9, own=F.col("size")).toPandas()
    mean = got.groupby(got["doc_id"] % 4)["copies"].mean()
    assert mean[0] == 0 and got["taken"].sum() == pytest.approx(18_000, abs=10)
    assert mean[2] / mean[1] == pytest.approx(2, rel=0.15) and mean[3] / mean[1] == pytest.approx(3, rel=0.15)
    heavy = mixing.mix_sources(table, weights=(1.0,), share=1.4, own=F.col("size")).toPandas()
    assert heavy["taken"].sum() == pytest.approx(28_000, abs=10) and heavy["copies"].max() == 2


def test_mixing_edges(edge_docs, no_docs):
    got = mixing.mix_sources(edge_docs).collect()
    assert len(got) == len(EDGE) and {r["taken"] for r in got if r["doc_id"] in (1, 2, 3)} == {0}
    assert len({r["copies"] for r in got if r["doc_id"] == 4}) == 1
    assert mixing.mix_sources(no_docs).collect() == []
    assert mixing.mix_sources(edge_docs.where("doc_id < 4 and doc_id > 0")).count() == 3
    out = mixing.mixed_documents(edge_docs)
    assert out.columns == edge_docs.columns
    times = Counter(r["doc_id"] for r in out.collect())
    copies = Counter()
    for r in got:
        copies[r["doc_id"]] += r["copies"]
    assert +copies == times


# 6 ---------------------------------------------------------------------------


def phrases_by_hand(text, sample):
    at = n = 0
    while at < len(text):
        end = at
        while end < len(text) and text[at : end + 1] in sample:
            end += 1
        n, at = n + 1, max(end, at + 1)
    return n


def test_phrases_by_brute_force():
    rng = np.random.default_rng(6)
    sample = "".join(rng.choice(list("abc "), 300)) + PROSE.lower().replace(".", " ")
    automaton = language.Automaton(np.array([ord(c) for c in sample], np.uint32))
    texts = [PROSE, "abcabc zzz", "".join(rng.choice(list("abcz "), 3000)), "", None, "Ωmega 12"]
    bits, lengths = language.parse_bits(texts, [automaton])
    for t, b, n in zip(texts, bits[:, 0], lengths, strict=True):
        codes, _ = language.normalised([t])
        plain = "".join(map(chr, codes))
        assert len(plain) == n
        pieces = [plain[i : i + language.STRETCH] for i in range(0, len(plain), language.STRETCH)]
        assert round(b / automaton.bits) == sum(phrases_by_hand(p, sample) for p in pieces)


@pytest.mark.parametrize("symbols", [96, 3, 1])
def test_phrases_of_a_large_alphabet(monkeypatch, symbols):
    """Letters beyond the table are searched for, and none is unknown that the sample holds."""
    monkeypatch.setattr(language, "SYMBOLS", symbols)
    rng = np.random.default_rng(7)
    signs = [chr(0x4E00 + i) for i in range(1500)]
    common = np.array([1 / (i + 1) for i in range(1500)])
    say = lambda n: "".join(rng.choice(signs, n, p=common / common.sum()))
    sample = say(6000) + "".join(signs)
    automaton = language.Automaton(np.array([ord(c) for c in sample], np.uint32))
    texts = [say(1500), sample[100:1400], say(40) + "abc" + say(30)]
    bits, _ = language.parse_bits(texts, [automaton])
    for t, b in zip(texts, bits[:, 0], strict=True):
        plain = "".join(map(chr, language.normalised([t])[0]))
        pieces = [plain[i : i + language.STRETCH] for i in range(0, len(plain), language.STRETCH)]
        assert round(b / automaton.bits) == sum(phrases_by_hand(p, sample) for p in pieces)
    assert round(bits[1, 0] / automaton.bits) == 2  # two stretches of the sample itself


def test_equal_shares():
    assert language.equal_shares(np.array([5, 100, 50]), 60).tolist() == [5, 28, 27]
    assert language.equal_shares(np.array([1, 2]), 60).tolist() == [1, 2]


def test_a_common_opening_teaches_nothing(docs_of, monkeypatch):
    """Every document opens with the same long English notice; the languages are still told apart."""
    rng = np.random.default_rng(8)
    notice = " ".join(rng.permutation((PROSE * 30).split()))
    data = []
    for i in range(240):
        own = GERMAN if i % 2 else FRENCH
        data.append((i, notice + " " + " ".join(rng.choice(own.split(), 3000)), "de" if i % 2 else "fr", None))
    test = [(1000 + i, " ".join(rng.choice((GERMAN if i % 2 else FRENCH).split(), 20))) for i in range(40)]
    known = language.fit_languages(docs_of(data), F.lit(True))
    assert all(len(s) // 4 <= language.SAMPLE_CHARS for s in known.samples)
    found = {r["doc_id"]: r["lang_pred"] for r in language.detect_languages(docs_of(test), known).collect()}
    assert all(found[1000 + i] == ("de" if i % 2 else "fr") for i in range(40))


GERMAN = "Das Dorf sah dem Fluss zu wie er unter der alten steinernen Brücke stieg und wartete auf das Ende vom Regen. "
FRENCH = "Le village regardait la rivière monter sous le vieux pont de pierre et attendait que la pluie cesse enfin. "


def test_languages(docs_of, edge_docs, no_docs):
    rng = np.random.default_rng(6)
    data = [
        (i, " ".join(rng.choice((PROSE if i % 2 else FRENCH).split(), 30)), "en" if i % 2 else "fr", None) for i in range(200)
    ]
    held = compression.held_out("doc_id", 3, 1)
    docs = docs_of(data)
    known = language.fit_languages(docs, ~held)
    assert known.names == ("en", "fr")
    got = {r["doc_id"]: r for r in language.detect_languages(docs, known).collect()}
    assert all(got[d]["lang_pred"] == lang for d, _, lang, _ in data)
    assert all(0.5 < r["score"] <= 1 for r in got.values())
    edges = language.detect_languages(edge_docs, known).collect()
    assert len(edges) == len(EDGE)
    assert {(r["lang_pred"], r["score"]) for r in edges if r["doc_id"] in (1, 2, 3)} == {("und", 0.0)}
    unknown = language.fit_languages(no_docs, ~held)
    assert {r["lang_pred"] for r in language.detect_languages(docs, unknown).collect()} == {"und"}
    assert language.detect_languages(no_docs, known).collect() == []


# 7 ---------------------------------------------------------------------------


def measures_by_hand(text):
    t = text or ""
    words = t.encode().split()
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often, covered = Counter(runs), set()
    for i, r in enumerate(runs):
        if often[r] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in t.split("\n") if x.encode().split()]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    chars = sum(len(w.decode()) for w in words)
    return len(words), chars, sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def test_quality_measures_and_verdicts(docs_of, no_docs):
    shout = " ".join(f"WORD{i}!!" for i in range(60))
    odd = [
        (20, PROSE * 2 + "# $ | <b>", None, None), (21, "a b\na b\n\n \na b\nc d\r\n" * 6, None, None), (22, shout, None, None),
        (23, "x " * 40, None, None), (24, " ".join(f"{i}" for i in range(50)), None, None),
    ]
    data = [r for r in EDGE if r[0] != 7] + odd
    got = quality.quality_cascade(docs_of(data, extra=True)).collect()
    want = Counter((d, *measures_by_hand(t)) for d, t, *_ in data)
    assert Counter(tuple(r)[:6] for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert kept == {None}
    assert quality.keep_good(docs_of(data)).count() == 1
    assert quality.quality_cascade(no_docs).collect() == [] and quality.keep_good(no_docs).collect() == []


def test_long_texts_and_rule_order(docs_of):
    (row,) = quality.quality_cascade(docs_of([EDGE[8]])).collect()
    assert tuple(row)[1:6] == measures_by_hand(LONG)


def profile_of(rules, measures=(0, 0)):
    """Ten rows; a rule is (cost, needs, which rows it rejects)."""
    return [(list(measures), [c for c, _, _ in rules], [n for _, n, _ in rules], [f(i) for _, _, f in rules]) for i in range(10)]


def test_rules_are_ordered_by_rejections_per_cost():
    # Rule 1 rejects everything cheaply; rule 0 costs more than rule 2 and finds less.
    plain = profile_of([(90, 0, lambda i: i < 5), (10, 0, lambda i: True), (10, 0, lambda i: i < 6)])
    assert quality.cascade_order(plain, 3) == [1, 2, 0]
    rest = profile_of([(10, 0, lambda i: i < 6), (10, 0, lambda i: i < 5), (10, 0, lambda i: i >= 7)])
    assert quality.cascade_order(rest, 3) == [0, 2, 1]  # what rule 1 finds, rule 0 has found
    # A measure is paid for once, by the first rule that needs it: rule 2 then costs less than rule 0.
    shared = profile_of([(30, 0, lambda i: i in (4, 5)), (5, 1, lambda i: i < 4), (5, 1, lambda i: i in (6, 7))], (40, 0))
    assert quality.cascade_order(shared, 3) == [1, 2, 0]
    assert quality.cascade_order(shared, 3, paid=0b10) == [1, 2, 0]
    dear = profile_of([(30, 0, lambda i: i in (4, 5)), (5, 1, lambda i: i < 4), (5, 1, lambda i: i in (6, 7))], (400, 0))
    assert quality.cascade_order(dear, 3) == [0, 1, 2]
    assert quality.cascade_order(dear, 3, paid=1) == [1, 2, 0]
    assert quality.cascade_order([], 3) == [0, 1, 2]


def test_the_sample_comes_from_everywhere(spark, docs_of, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_ROWS", 200)
    table = docs_of([(i, PROSE * 2 if i % 2 else "too short") for i in range(3000)]).repartition(6)
    profile = quality.rule_profile(table, quality.RULES)
    assert 100 < len(profile) < 400
    assert {len(p[0]) for p in profile} == {len(quality.MEASURED)} and {len(p[1]) for p in profile} == {len(quality.RULES)}
    plan = quality.sampled(table, "text")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Limit" not in plan
    few = quality.rule_profile(docs_of([(1, "a b"), (2, None)]), quality.RULES)
    assert len(few) == 2


# 8 ---------------------------------------------------------------------------


@pytest.mark.parametrize(("part", "block"), [(1024, 512), (3, 4)])
def test_simhash_by_brute_force(spark, monkeypatch, part, block):
    monkeypatch.setattr(simhash, "PART", part)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(8)
    bits = rng.integers(0, 2**63, 60).tolist()
    for b in bits[:20]:
        bits += [b ^ sum(1 << int(k) for k in rng.choice(64, n, replace=False)) for n in (1, 3, 4)]
    chain = [0]
    for k in range(20):
        chain.append(chain[-1] ^ (7 << 3 * k))
    bits = list(dict.fromkeys(bits + chain))
    signed = [b - (1 << 64) if b >> 63 else b for b in bits]
    table = spark.createDataFrame(list(enumerate(signed)), "rep bigint, bits bigint").repartition(4)
    roots = dict(rows(components(simhash.near_links(table, 3))))
    low = closure(len(bits), lambda i, j: (bits[i] ^ bits[j]).bit_count() <= 3)
    assert [roots.get(i, i) for i in range(len(bits))] == low


def test_simhash_groups(docs_of, no_docs):
    near = PROSE * 6
    data = [r for r in EDGE if r[0] != 7] + [(30 + i, near + f" tail{i}", None, None) for i in range(5)]
    got = simhash.simhash_groups(docs_of(data, extra=True)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, *_ in data)
    prints = {d: simhash.fingerprint(t) for d, t, *_ in data}
    named = [d for d in prints if d is not None]
    order = sorted(named)
    low = closure(len(order), lambda i, j: (prints[order[i]] ^ prints[order[j]]).bit_count() <= 3)
    want = {d: order[low[i]] for i, d in enumerate(order)}
    for r in got:
        assert r["bits"] % 2**64 == prints[r["doc_id"]]
        if r["doc_id"] is not None:
            assert r["component"] == want[r["doc_id"]]
    assert {r["component"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert simhash.simhash_groups(no_docs).collect() == []


# 9 ---------------------------------------------------------------------------


def tree_by_hand(texts, least):
    """Kept contexts as (rest, listed log10 probabilities), and the root's price of a token."""
    runs, counts = Counter(), Counter()
    for t in texts:
        tokens = ["<s>", *(t or "").encode().lower().split(), b"\n"]
        counts.update(tokens[1:])
        for k in range(1, suffix_tree.DEPTH + 2):
            runs.update(tuple(tokens[i : i + k]) for i in range(len(tokens) - k + 1))
    total, kinds = sum(counts.values()), len(counts)
    price = lambda w: math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1)))
    follows = {}
    for run, n in runs.items():
        if len(run) > 1 and n >= least:
            follows.setdefault(run[:-1], {})[run[-1]] = n
    kept = {}

    def chance(context, w):
        for i in range(len(context)):
            if context[i:] in kept:
                rest, listed = kept[context[i:]]
                return listed[w] if w in listed else rest + chance(context[i + 1 :], w)
        return price(w)

    for context in sorted(follows, key=len):
        found, seen = follows[context], max(runs[context], sum(follows[context].values()))
        left = seen - sum(found.values())
        rest = math.log10((left + suffix_tree.SHORTER) / (seen + suffix_tree.SHORTER))
        saved, listed = left * rest, {}
        for w, n in found.items():
            below = chance(context[1:], w)
            listed[w] = math.log10(n / (seen + suffix_tree.SHORTER) + 10 ** (rest + below))
            saved += n * (listed[w] - below)
        bits = saved / math.log10(2)
        if bits >= suffix_tree.GAIN and bits >= suffix_tree.GAIN_EACH * seen:
            kept[context] = (rest, listed)
    return kept, price, chance, counts, total


def tree_texts():
    rng = np.random.default_rng(9)
    words = [f"v{i}" for i in range(60)]
    data = []
    for d in range(400):
        w = list(rng.choice(words, rng.integers(0, 30)))
        if d % 2:
            w += "All rights are reserved by the village of the old bridge".split()
        # What follows is told by the word three, four and five places before.
        x = d % 3
        w += f"p{x} a b q{x} r{x} c d e s{x} t{x} f g h i u{x}".split()
        data.append((d, " ".join(w + [f"rare{d}"])))
    return data + [(1001, None), (1002, ""), (1003, "All rights are v1 v2 unseen"), (1004, "all rights")]


@pytest.mark.parametrize(("least", "told"), [(8, 1_000_000), (8, 60), (8, 0), (4, 200)])
def test_suffix_tree_by_brute_force(spark, docs_of, least, told):
    """The divergence test, the chains and the joins, with all, some or none of the contexts told."""
    data = tree_texts()
    held = compression.held_out("doc_id", 5, 1)
    learned = [t for d, t in data if zlib.crc32(str(d).encode()) % 5 != 1]
    kept, price, chance, counts, total = tree_by_hand(learned, least)
    assert len({len(c) for c in kept}) == suffix_tree.DEPTH
    docs = docs_of(data, extra=True)
    got = {r["doc_id"]: r for r in suffix_tree.suffix_tree_scores(docs, held, least=least, told=told).collect()}
    assert len(got) == len(data)
    for d, t in data:
        tokens = [*(t or "").encode().lower().split(), b"\n"]
        before, score = ("<s>",), 0.0
        for w in tokens:
            score += chance(before[-suffix_tree.DEPTH :], w)
            before += (w,)
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(counts[w] > 0 for w in tokens), total)
        assert r["base_score"] == pytest.approx(sum(map(price, tokens))) and r["score"] == pytest.approx(score)
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 1)
    gain = [r["score"] - r["base_score"] for r in got.values() if r["held_out"] and r["doc_id"] % 2 and r["doc_id"] < 400]
    assert min(gain) > 5


def test_all_frequent_runs_are_found(spark, docs_of):
    data = tree_texts()
    docs = docs_of(data)
    words = suffix_tree.word_counts(docs).select(F.xxhash64("word").alias("h"), "c")
    runs = Counter()
    for _, t in data:
        tokens = [suffix_tree.START, *(t or "").encode().lower().split(), suffix_tree.END]
        for k in range(2, suffix_tree.DEPTH + 2):
            runs.update(tuple(tokens[i : i + k]) for i in range(len(tokens) - k + 1))

    def named(run):
        hashes = np.array([suffix_tree.token_hash(w) for w in run], np.uint64)
        return int(suffix_tree.window_hashes(hashes, len(run), suffix_tree._BASE).view(np.int64)[0])

    one = lambda w: int(np.uint64(suffix_tree.token_hash(w)).astype(np.int64))
    short = lambda run: named(run) if len(run) > 1 else one(run[0])
    want = {(len(r), named(r), n, short(r[:-1]), short(r[1:]), one(r[-1])) for r, n in runs.items() if n >= 6}
    assert set(map(tuple, suffix_tree.frequent_runs(docs, words, 6)[0].collect())) == want


def test_a_filter_loses_none(spark):
    rng = np.random.default_rng(1)
    hashes = rng.integers(-(1 << 63), 1 << 63, 5000)
    table = spark.createDataFrame([(int(h),) for h in hashes], "h bigint")
    other = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    for most in (26, 12):
        found = filters.filter_of(table, "h", most)
        assert found.passes(hashes.view(np.uint64)).all()
        assert found.passes(other).mean() < (0.02 if most == 26 else 1.0)
    assert not filters.filter_of(table.limit(0), "h").passes(other).any()


def test_contexts_share_out_all_mass(docs_of):
    """Under any context the probabilities of all known tokens and an unknown one add up to one."""
    texts = ["a b c a b d " * 3] * 60 + ["b a d c"] * 9
    kept, price, chance, counts, _ = tree_by_hand(texts, 8)
    unknown = price(b"never")
    for context in kept:
        assert sum(10 ** chance(context, w) for w in counts) + 10 ** chance(context, b"never") == pytest.approx(1)
    assert len(kept) > 3 and unknown < 0
    docs = docs_of(list(enumerate(texts)))
    got = suffix_tree.suffix_tree_scores(docs, F.lit(False), least=8).collect()
    tokens = [*texts[0].encode().split(), b"\n"]
    want = sum(chance(("<s>", *tokens[:i])[-suffix_tree.DEPTH :], w) for i, w in enumerate(tokens))
    assert got[0]["score"] == pytest.approx(want)


def test_runs_of_each_length_are_counted_once(spark, docs_of, monkeypatch):
    counted = []
    counter = suffix_tree._counted
    monkeypatch.setattr(suffix_tree, "_counted", lambda *a: counted.extend(a[4]) or counter(*a))
    suffix_tree.suffix_tree_scores(docs_of([(i, "a b c d a b c d") for i in range(20)]), F.lit(False), least=8)
    assert sorted(counted) == list(range(2, suffix_tree.DEPTH + 2))


def test_a_large_tree_stores_no_rows_of_tokens(spark, docs_of, monkeypatch):
    """A tree beyond ``told`` is looked up part by part, and scores are those of a whole one to the last bit."""
    stored = []
    plain = suffix_tree.store
    monkeypatch.setattr(suffix_tree, "store", lambda df, name: stored.append((name, plain(df, name))) or stored[-1][1])
    monkeypatch.setattr(suffix_tree, "TOGETHER", 2000)
    docs, got = docs_of(tree_texts()), {}
    for told, held in ((1_000_000, 1), (60, 1), (60, 1500)):
        monkeypatch.setattr(suffix_tree, "LOOKED_UP", held)
        got[told, held] = sorted(map(repr, suffix_tree.suffix_tree_scores(docs, F.lit(False), least=8, told=told).collect()))
    assert len({tuple(x) for x in got.values()}) == 1
    assert [name for name, _ in stored].count("told") == 4
    assert not {"open", "rests", "gains"} & {name for name, _ in stored}
    for name, table in stored:
        if name == "scored":
            assert table.columns == ["row", "key", "held_out", "n_tokens", "n_known", "base", "gain", "cold"]


def test_shuffle_files_go_with_each_step(spark):
    place = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(place.getAllFiles()) if f.getName().startswith("shuffle_")}

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, before = spark.conf.get(name, None), shuffles()
    with sources.shuffles_removed(spark):
        kept = sources.store(spark.range(5000).groupBy(F.xxhash64("id").alias("h")).count(), "counts")
        assert spark.conf.get(name) == "true"
    for _ in range(50):
        if not shuffles() - before:
            break
        time.sleep(0.1)
    assert not shuffles() - before and kept.count() == 5000
    assert spark.conf.get(name, None) == was


def test_words_of_a_column_are_those_of_each_text():
    rng = np.random.default_rng(4)
    letters = list(" \t\n\x0b\x0c\r\x1c\x85\xa0\u2028AZaz\x00\u00c4\u0130\u212a")
    texts = [None, "", "  ", "A", *("".join(rng.choice(letters, rng.integers(0, 25))) for _ in range(2000)), None]
    column = pa.array(texts)
    for part in (column, column.slice(3), column.slice(1, 2), column.slice(0, 1), column.slice(0, 0), column.cast(pa.large_string())):
        sizes, words = suffix_tree.words_lowered(part)
        want = [(t or "").encode().lower().split() for t in part.to_pylist()]
        assert sizes.tolist() == list(map(len, want)) and words.to_pylist() == [w for t in want for w in t]


def test_columns_are_cut_into_stretches(monkeypatch):
    monkeypatch.setattr(suffix_tree, "TOGETHER", 10)
    cut = lambda sizes: list(suffix_tree.stretches(pa.array([n if n is None else "x" * n for n in sizes], pa.string())))
    assert cut([]) == [] and cut([None, None]) == [(0, 2)] and cut([0, 50, 0]) == [(0, 2), (2, 1)]
    assert cut([4, 4, 4, None, 4, 4, 30, 1]) == [(0, 3), (3, 3), (6, 1), (7, 1)]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 5000])
def test_places_by_brute_force(n):
    rng = np.random.default_rng(n)
    own = rng.integers(0, 1 << 64, n, np.uint64)
    # Half of them in one bucket, and both ends.
    own[: n // 2] >>= np.uint64(40)
    own[n // 2 : n // 2 + 2] = [0, (1 << 64) - 1][: len(own[n // 2 : n // 2 + 2])]
    own = np.unique(own)
    asked = np.concatenate([own, own + np.uint64(1), rng.integers(0, 1 << 64, 3000, np.uint64)])
    at = {h: i for i, h in enumerate(own.tolist())}
    assert suffix_tree.Places(own).of(asked).tolist() == [at.get(h, -1) for h in asked.tolist()]
    assert not len(suffix_tree.Places(own).of(asked[:0]))


def test_a_told_token_is_looked_up_once():
    asked = []

    class Counted(suffix_tree.Places):
        def of(self, hashes):
            asked.extend(hashes.tolist())
            return super().of(hashes)

    base = suffix_tree._BASE
    tokens = suffix_tree.token_hashes([b"\r", b"a", b"b", b"\n"])
    pair, triple = (suffix_tree.window_hashes(tokens, k, base) for k in (2, 3))
    runs = sorted([(int(triple[0]), 0.5), (int(pair[1]), 0.25), (int(pair[0]), 0.125)])
    none = suffix_tree.Places(np.zeros(0, np.uint64))
    contexts = [suffix_tree.Places(np.sort(tokens[:2])), suffix_tree.Places(pair[:1].copy()), none, none, none]
    every = filters.Filter(10, np.full(16, (1 << 64) - 1, np.uint64))
    told = suffix_tree.Told(
        every, tuple(contexts), tuple(np.full(len(c.hashes), -1.0) for c in contexts),
        Counted(np.array([r for r, _ in runs], np.uint64)), np.array([g for _, g in runs]), None,
    )
    gain, parts = suffix_tree.context_gains(told, tokens, np.arange(4, 0, -1))
    # "b" is told after the start and "a": what "a" alone says of it is not asked.
    assert gain.tolist() == [0.0, 0.125, 0.5, 0.0] and parts == []
    assert sorted(asked) == sorted([int(triple[0]), int(pair[0])])


def test_suffix_tree_edges(edge_docs, no_docs):
    got = suffix_tree.suffix_tree_scores(edge_docs, F.lit(False)).collect()
    assert len(got) == len(EDGE)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert all(r["n_known"] == r["n_tokens"] for r in got)
    unlearned = suffix_tree.suffix_tree_scores(edge_docs, F.lit(True)).collect()
    assert {(r["base_score"], r["score"], r["n_known"]) for r in unlearned} == {(0.0, 0.0, 0)}
    assert suffix_tree.suffix_tree_scores(no_docs, F.lit(False)).collect() == []


# 10 --------------------------------------------------------------------------


def spans(text):
    return [(k, text[s:e]) for k, s, e, _ in secret_scan.spans_of(text)]


def test_base_spans():
    text = "é Token : 'abcdefghijkl' passwd=short api_key=ABCdef123456 AKIA1234567890ABCD AKIA12 0123456789abcdef0 tokenſ=abcdefghijklmn"
    got = spans(text)
    assert ("assign", "Token : 'abcdefghijkl") in got and ("assign", "api_key=ABCdef123456") in got
    assert ("access", "AKIA1234567890ABCD") in got and ("hex", "0123456789abcdef0") in got
    assert len([k for k, _ in got if k != "named"]) == 4
    hexed = 'token = "568081089e370ecd730e803638840f97"'
    assert [k for k, _ in spans(hexed)] == ["assign", "hex"]


def test_names_lead_to_literals():
    assert spans('k = "Zx9AbCdEf0123456789"\nclient_secret = k') == [("named", "Zx9AbCdEf0123456789")]
    assert spans('part = "Ab3dE6gH"\nDB_PWD = "Xy7zW8qR" + part') == [("named", "Ab3dE6gH"), ("named", "Xy7zW8qR")]
    assert spans("a = 'Qw3rTy7uIo9p'\nb = a\nc = b\nprivate_key = c") == [("named", "Qw3rTy7uIo9p")]
    assert spans("a = b\nb = a\nauth_credential = a") == []
    assert spans('password_hint = "Zx9AbCdEf012345"; credential = "change_me_please1"; pwd_length: 12345678') == []
    assert spans("<credentials>: the king said that the key to it all was patience") == []


def test_assignments_of_any_length():
    letters = "Ab3dE6gHk2Mn5pQr8sTu"
    key = "".join(letters[i * i % 19] for i in range(4500))
    parts = [f"{letters[:8]}{i:02}" for i in range(25)]
    assert spans(f'db_pwd{" " * 9}={chr(9) * 9}"Zx81kQpLm02rT"') == [("named", "Zx81kQpLm02rT")]
    for text in (f'private_key = "{key}"', f"private_key='{key}'", f"private_key={key}"):
        assert spans(text) == [("named", key)]
    assert spans("private_key = " + " + ".join(f'"{p}"' for p in parts)) == [("named", p) for p in parts]
    assert spans('private_key = "Ab3dE6gHk2"\n  + "Xy7zW8qR55" +\r\n "Qw3rTy7uIo"') == [
        ("named", p) for p in ("Ab3dE6gHk2", "Xy7zW8qR55", "Qw3rTy7uIo")
    ]
    assert spans("app." * 60 + 'db_pwd = "Zx81kQpLm02rT"') == [("named", "Zx81kQpLm02rT")]


@pytest.mark.parametrize(
    ("text", "secrets"),
    [
        ('os.environ["DB_PASSWORD"] = "Zx81kQpLm02rT"', ["Zx81kQpLm02rT"]),
        ("conf[ 'api'][\"auth_token\" ]='Zx81kQpLm02rT'", ["Zx81kQpLm02rT"]),
        ("<db><pwd type='x'> Zx81kQpLm02rT\n</pwd><user>Zx81kQpLm02rT</user></db>", ["Zx81kQpLm02rT"]),
        ('db_pwd = """\nZx81kQpLm02rT\n"""', ["Zx81kQpLm02rT"]),
        ("db_pwd = '''Zx81kQ\\'pLm02rT'''", ["Zx81kQ\\'pLm02rT"]),
        ('db_pwd = SecretStr("Zx81kQpLm02rT")', ["Zx81kQpLm02rT"]),
        ('db_pwd = decode( strip("Zx81kQpLm02rT"), "utf-8" )', ["Zx81kQpLm02rT"]),
        ('db_pwd = os.getenv("DB_PASSWORD_1", "Zx81kQpLm02rT")', ["Zx81kQpLm02rT"]),
        ('k = "Zx81kQpLm02rT"\ndb_pwd = f(k)', ["Zx81kQpLm02rT"]),
        ('made = config(db_pwd = "Zx81kQpLm02rT")', ["Zx81kQpLm02rT"]),
        ('db_pwd = ask("Zx81kQpLm02rT"', []),
        ("<pwd>Zx81kQpLm02rT</user>", []),
        ('db_pwd = ""', []),
    ],
)
def test_syntax_of_assignments(text, secrets):
    assert spans(text) == [("named", s) for s in secrets]


def pairs_by_hand(text):
    """Each name walked on its own."""
    literals, reads = {}, {}
    for line in text.split("\n"):
        name, value = line.split(" = ")
        if value[0] == '"':
            literals.setdefault(name, []).append(value[1:-1])
        else:
            literals.setdefault(name, []).append(value)
            reads.setdefault(name, []).append(value)
    found = {}
    for name in literals:
        seen, todo = {name}, [name]
        while todo:
            here = todo.pop()
            for v in literals[here]:
                if v not in literals:
                    found.setdefault(v, set()).add(name)
            for other in reads.get(here, ()):
                if other in literals and other not in seen:
                    seen.add(other)
                    todo.append(other)
    return found


def test_chains_lead_to_the_most_telling_name():
    rng = np.random.default_rng(3)
    names = ["a", "b", "c", "token", "salt", "db_pwd", "cookie", "d", "user_id"]
    for _ in range(300):
        lines = []
        for i in range(int(rng.integers(1, 12))):
            name = names[rng.integers(len(names))]
            lines.append(f'{name} = "lit{i}"' if rng.random() < 0.4 else f"{name} = {names[rng.integers(len(names))]}")
        text = "\n".join(lines)
        want = {v: max(map(secret_scan.name_weight, led)) for v, led in pairs_by_hand(text).items()}
        got = {}
        for p in secret_scan.assignments(text):
            got[p.value] = max(got.get(p.value, 0.0), secret_scan.name_weight(p.name))
        assert got == want, text


def base_by_hand(text):
    """Every start tried in turn, as the patterns are worded."""
    found = []
    i = 0
    while i < len(text):
        head = next((h for h in ("password", "passwd", "secret", "token", "api_key", "apikey") if text[i : i + len(h)].lower() == h), None)
        j = i + len(head or "")
        if head:
            j += text[j : j + 1] in ("'", '"') and text[j : j + 1] != ""
            while text[j : j + 1] == " ":
                j += 1
            ok = text[j : j + 1] in (":", "=") and text[j : j + 1] != ""
            j += 1
            while text[j : j + 1] == " ":
                j += 1
            j += text[j : j + 1] in ("'", '"') and text[j : j + 1] != ""
            k = j
            while k < len(text) and (text[k].isascii() and text[k].isalnum() or text[k] in "+/_.=-"):
                k += 1
            if ok and k > j:
                if k - j >= 12:
                    found.append(("assign", i, k))
                i = k
                continue
        i += 1
    for kind, head, allowed, least in (("access", "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 18), ("hex", "", "0123456789abcdef", 16)):
        i = 0
        while i < len(text):
            j = i + len(head)
            if text[i:j] == head:
                k = j
                while k < len(text) and text[k] in allowed:
                    k += 1
                if k > j:
                    if k - i >= least:
                        found.append((kind, i, k))
                    i = k
                    continue
            i += 1
    return sorted(found, key=lambda x: (x[1], secret_scan.KINDS.index(x[0])))


def test_base_spans_by_brute_force():
    rng = np.random.default_rng(8)
    parts = ["password", "Secret", "token", "api_key", "APIKEY", "AKIA", "0123456789abcdef", "abcdef", "Zz9+/_.=-", '"', "'", " ", ":", "=", "é", "ſ", "\n", "K", "7", "XYZ123"]
    for _ in range(4000):
        text = "".join(parts[k] for k in rng.integers(0, len(parts), int(rng.integers(1, 16))))
        got = sorted(secret_scan.base_spans(text), key=lambda x: (x[1], secret_scan.KINDS.index(x[0])))
        assert got == base_by_hand(text), text


@pytest.mark.parametrize("text", ["\n".join(f"pwd{i} = pwd{i + 1}" for i in range(25_000)), "\n".join(f'token{i} = "{i:032x}"' for i in range(9_000)), 'pwd = f("a", ' * 40_000, "<pwd>" * 80_000, 'pwd = """' + "\\a" * 200_000, "a=f(" * 100_000, 'pwd="' + "<" * 400_000 + '"', "a." * 400_000, 'pwd="' + "\\a" * 400_000, 'pwd="a"' + "\n" * 400_000, 'pwd="a' + '" + "b' * 200_000])
def test_long_assignments_take_linear_time(text):
    start = time.perf_counter()
    secret_scan.spans_of(text)
    assert time.perf_counter() - start < 5


def test_secrets_of_a_table(edge_docs, no_docs, docs_of):
    got = secret_scan.find_secrets(edge_docs)
    assert got.count() == len(EDGE) and got.where("size(spans) > 0").count() == 0
    assert secret_scan.find_secrets(no_docs).collect() == []
    text = 'x token = "568081089e370ecd730e803638840f97" y'
    out = secret_scan.mask_secrets(docs_of([(1, text, "en", "a"), (2, None, None, None), (3, "plain", "en", "a")], extra=True))
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[1]["text"] == 'x [secret]" y' and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] is None and got[3]["text"] == "plain" and got[3]["n_chars"] == 5
    assert secret_scan.mask_secrets(no_docs).collect() == []
