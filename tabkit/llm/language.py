"""Language by cross-parsing: into how few known phrases does a text fall apart?

A suffix automaton of labelled text knows every phrase of a language's sample.  A
text is parsed greedily into the longest phrases the automaton knows; the language
that needs the fewest, each priced at the bits of a place in the sample, wins.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabkit.llm.quality import docs_key_type
from tabkit.llm.texts import columns_batch, in_arrow

#: The labelled sample: documents and characters per language, and the stretch read of one document.
SAMPLE_DOCS = 64
SAMPLE_DOC_CHARS = 4_096
SAMPLE_CHARS = 40_000
#: Letters of a language whose next states stand in a table; those of rarer ones are searched for.
SYMBOLS = 96
#: Texts are parsed in stretches of this many characters; a stretch's end ends a phrase.
STRETCH = 1_024
#: Characters of a batch that are parsed side by side.
TOGETHER = 2_000_000
UNKNOWN = "und"

_SPACE = 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def normalised(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and how many are each text's.

    Lower-cased; a run of anything but letters is one space.
    """
    lowered = [(t or "").lower() for t in texts]
    lengths = np.fromiter(map(len, lowered), np.int64, len(lowered))
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    owner = np.repeat(np.arange(len(lowered)), lengths)[keep]
    return np.where(letter, codes, _SPACE)[keep], np.bincount(owner, minlength=len(lowered))


class Automaton:
    """The suffix automaton of a text, all its letters included.

    The commonest letters have a table of next states (-1: none); the moves by
    others are sorted codes of state and letter.
    """

    def __init__(self, codes: np.ndarray):
        letters = [c for c, _ in sorted(Counter(codes.tolist()).items(), key=lambda x: (-x[1], x[0]))]
        number = np.zeros(0x110000, np.int32)  # 0: a letter the sample does not know
        number[letters] = np.arange(1, len(letters) + 1)
        self.symbols = np.where(number <= SYMBOLS, number, 0).astype(np.uint8)
        self.width = min(SYMBOLS, len(letters)) + 1
        self.rare = np.where(number > SYMBOLS, number, 0) if len(letters) > SYMBOLS else None
        moves, link, length, last = [{}], [-1], [0], 0
        for s in number[codes].tolist():
            here, at = len(moves), last
            if s in moves[at] and length[moves[at][s]] == length[at] + 1:
                last = moves[at][s]
                continue
            moves.append({})
            link.append(0)
            length.append(length[at] + 1)
            while at >= 0 and s not in moves[at]:
                moves[at][s] = here
                at = link[at]
            if at >= 0:
                to = moves[at][s]
                if length[to] == length[at] + 1:
                    link[here] = to
                else:
                    copy = len(moves)
                    moves.append(dict(moves[to]))
                    link.append(link[to])
                    length.append(length[at] + 1)
                    while at >= 0 and moves[at].get(s) == to:
                        moves[at][s] = copy
                        at = link[at]
                    link[to] = link[here] = copy
            last = here
        self.table = np.full(len(moves) * self.width, -1, np.int32)
        sparse = []
        for state, found in enumerate(moves):
            for s, to in found.items():
                if s < self.width:
                    self.table[state * self.width + s] = to * self.width
                else:
                    sparse.append((state * self.width << 21 | s, to * self.width))
        keys, values = zip(*sorted(sparse), strict=True) if sparse else ((), ())
        self.keys, self.values = np.array(keys, np.int64), np.array(values, np.int32)
        self.bits = float(np.log2(max(2, len(codes))))

    def _searched(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Next states by rare letters; -1 where there is none, and for letter 0."""
        codes = state.astype(np.int64) << 21 | letter
        at = np.minimum(np.searchsorted(self.keys, codes), len(self.keys) - 1)
        return np.where(self.keys[at] == codes, self.values[at], -1)

    def phrases(self, steps: np.ndarray, active: np.ndarray) -> np.ndarray:
        """Phrases of stretches: row j of ``steps`` holds their j-th code points.

        Stretches come longest first; ``active[j]`` of them reach step j.
        """
        state = np.zeros(steps.shape[1], np.int32)
        count = np.zeros(steps.shape[1], np.int32)
        table, symbols = self.table, self.symbols
        for codes, n in zip(steps, active.tolist(), strict=True):
            s = symbols[codes[:n]]
            to = table[state[:n] + s]
            odd = np.flatnonzero(s == 0) if self.rare is not None else ()
            if len(odd):
                to[odd] = self._searched(state[odd], self.rare[codes[odd]])
            lost = np.flatnonzero(to < 0)
            if len(lost):
                count[lost] += state[lost] > 0
                again = table[s[lost]]
                if len(odd):
                    again = np.where(s[lost] == 0, self._searched(np.zeros(len(lost), np.int32), self.rare[codes[lost]]), again)
                count[lost] += again < 0
                to[lost] = np.maximum(again, 0)
            state[:n] = to
        return count + (state > 0)


@dataclass(frozen=True)
class Languages:
    """Names in order, and a normalised sample of each."""

    names: tuple[str, ...]
    samples: tuple[bytes, ...]


@lru_cache(maxsize=1)
def _automata(samples: tuple[bytes, ...]) -> list[Automaton]:
    """Built once per Python worker."""
    return [Automaton(np.frombuffer(s, "<u4")) for s in samples]


def parse_bits(texts: Sequence[str | None], automata: Sequence[Automaton]) -> tuple[np.ndarray, np.ndarray]:
    """Bits per text and language, and the texts' numbers of characters."""
    codes, lengths = normalised(texts)
    ends = np.cumsum(lengths)
    pieces = -(-lengths // STRETCH)
    owner = np.repeat(np.arange(len(lengths)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = (ends - lengths)[owner] + nth * STRETCH
    sizes = np.minimum(STRETCH, ends[owner] - starts)
    bits = np.zeros((len(lengths), len(automata)))
    if not len(owner):
        return bits, lengths
    order = np.argsort(-sizes, kind="stable")
    owner, starts, sizes = owner[order], starts[order], sizes[order]
    reach = np.arange(sizes[0])
    active = np.searchsorted(-sizes, -reach, "left")
    at = np.minimum(starts[None, :] + reach[:, None], len(codes) - 1)
    steps = codes[at]
    for k, automaton in enumerate(automata):
        bits[:, k] = np.bincount(owner, automaton.phrases(steps, active), len(lengths)) * automaton.bits
    return bits, lengths


def in_groups(texts: Sequence[str | None], most: int = TOGETHER) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``most`` characters each."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def equal_shares(lengths: np.ndarray, total: int) -> np.ndarray:
    """How much of each length to take so that all is ``total`` at most, and shares are equal where they can be."""
    out, left = np.zeros(len(lengths), np.int64), total
    for done, i in enumerate(np.argsort(lengths, kind="stable")):
        out[i] = min(int(lengths[i]), left // (len(lengths) - done))
        left -= out[i]
    return out


def fit_languages(
    docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang"
) -> Languages:
    """A sample of each language among the rows for which ``learn`` holds.

    Two passes: rows per language, then those whose hashed key falls below what
    makes about twice SAMPLE_DOCS of them.  Of a document a stretch is read whose
    place follows from its hash, so that how documents open teaches no more than
    the rest of them, and every document gives the same share of SAMPLE_CHARS as
    far as it can.  What reaches the driver is bounded by languages x SAMPLE_DOCS
    x SAMPLE_DOC_CHARS; no language is gathered in a task.  NULL languages and
    texts teach nothing.
    """
    body = F.col(f"`{text}`")
    mark = F.xxhash64(F.lit("language"), F.col(f"`{key}`"), body)
    room = F.greatest(F.lit(1), F.char_length(body) - SAMPLE_DOC_CHARS + 1)
    rows = docs.where(learn & F.col(f"`{lang}`").isNotNull() & body.isNotNull()).select(
        F.col(f"`{lang}`").alias("lang"),
        F.substr(body, F.pmod(F.xxhash64(F.lit("place"), mark), room).cast("int") + 1, F.lit(SAMPLE_DOC_CHARS)).alias("text"),
        F.pmod(mark, F.lit(1 << 40)).alias("order"),
    )
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Languages((), ())
    limit = F.lit(0).cast("bigint")
    for name, n in counts.items():
        share = min(1.0, 2 * SAMPLE_DOCS / n)
        limit = F.when(F.col("lang") == name, F.lit(int(share * (1 << 40)))).otherwise(limit)
    found: dict[str, list[tuple[int, str]]] = {name: [] for name in counts}
    for r in rows.where(F.col("order") < limit).collect():
        found[r["lang"]].append((r["order"], r["text"]))
    names, samples = [], []
    for name in sorted(found):
        chosen = [t for _, t in sorted(found[name])[:SAMPLE_DOCS]]
        codes, lengths = normalised(chosen)
        if len(codes):
            ends = np.cumsum(lengths)
            shares = equal_shares(lengths, SAMPLE_CHARS)
            parts = [codes[e - n : e - n + k] for e, n, k in zip(ends, lengths, shares, strict=True)]
            names.append(name)
            samples.append(np.concatenate(parts).astype("<u4").tobytes())
    return Languages(tuple(names), tuple(samples))


def detect_languages(
    docs: DataFrame, languages: Languages, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row: key, ``lang_pred``, ``score`` in 0 to 1.

    Whole texts; no shuffle.  ``und`` with score 0 where the text is NULL, empty
    or without letters, or no language is known.  Equal bits: the first name.
    """
    given = docs.sparkSession.sparkContext.broadcast(languages)
    arrow = pa.schema([("key", docs_key_type(docs, key)), ("lang_pred", pa.string()), ("score", pa.float64())])

    def make():
        names = given.value.names
        automata = _automata(given.value.samples)

        def judge(texts):
            bits, lengths = parse_bits(texts, automata)
            for row, n in zip(bits, lengths.tolist(), strict=True):
                if not n or not names:
                    yield UNKNOWN, 0.0
                    continue
                best = int(np.argmin(row))
                # Odds from the difference in bits per letter, as if of 100 letters at most.
                odds = np.exp2(-(row - row[best]) * min(1.0, 100 / n) / 4)
                yield names[best], float(1 / odds.sum())

        def step(batch):
            texts = batch.column(1).to_pylist()
            found = [x for a, b in in_groups(texts) for x in judge(texts[a:b])]
            yield columns_batch((batch.column(0), *zip(*found, strict=True)), arrow)

        return step

    kind = docs.schema[key].dataType.simpleString()
    out = in_arrow(
        docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")), make, f"key {kind}, lang_pred string, score double"
    )
    return out.withColumnRenamed("key", key)
