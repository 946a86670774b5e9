"""Quality rules as a short-circuit cascade.

Each rule says whether a text is rejected.  A sample shows what each rule costs,
less the measures that an earlier rule has taken, and what it rejects; the rules
then run in the order that rejects most per nanosecond, and the first rejection
ends the work on a text.  The verdict is the
same in any order, so measured times never change a result.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.llm.texts import WordHashes, columns_batch, each_row, in_arrow, same_columns, window_hashes, words_of

# Rows measured, about, for the order of the rules; the verdicts do not depend on it.
SAMPLE_ROWS = 512
WINDOW = 8
SYMBOLS = "#*$%&|<>"

_NOT_SYMBOL = re.compile(rf"[^{re.escape(SYMBOLS)}]+")
_BASE = 0x9E3779B97F4A7C15


class Page:
    """A text and its measures, each computed when it is first asked for."""

    def __init__(self, text: str | None, hashes: WordHashes):
        self.text, self._hashes = text or "", hashes

    @cached_property
    def words(self) -> list[bytes]:
        return words_of(self.text)

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        """Code points in words: all of the text's but the separators."""
        cut = sum(map(self.text.count, " \t\n\x0b\x0c\r"))
        return len(self.text) - cut

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def filled_lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(" \t\x0b\x0c\r")]

    @cached_property
    def n_dup_lines(self) -> int:
        """Lines with a word that equal an earlier line."""
        return len(self.filled_lines) - len(set(self.filled_lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in a window of eight that is found twice or more."""
        if self.n_words <= WINDOW:
            return 0
        keys = window_hashes(self._hashes.of(self.words), WINDOW, _BASE)
        _, back, count = np.unique(keys, return_inverse=True, return_counts=True)
        starts = np.flatnonzero(count[back] > 1)
        if not len(starts):
            return 0
        change = np.zeros(self.n_words + 1, np.int64)
        change[starts] += 1
        change[starts + WINDOW] -= 1
        return int(np.count_nonzero(np.cumsum(change)[:-1]))

    @cached_property
    def n_letters(self) -> int:
        return sum(map(str.isalpha, self.text))

    @cached_property
    def n_upper(self) -> int:
        return sum(map(str.isupper, self.text))

    @property
    def base_failed(self) -> bool:
        return self.n_words < 20 or 100 * self.n_repeat_words > 30 * self.n_words


@dataclass(frozen=True)
class Rule:
    """``rejects(page)`` is true for a text that is to go."""

    name: str
    rejects: Callable[[Page], bool]


RULES = (
    Rule("symbols", lambda p: 10 * p.n_symbols > p.n_words),
    Rule("exclamations", lambda p: 2 * p.text.count("!") > p.n_words),
    Rule("word_length", lambda p: not 2 * p.n_words <= p.word_chars <= 14 * p.n_words),
    Rule("repeated_lines", lambda p: 10 * p.n_dup_lines > 3 * max(10, len(p.filled_lines))),
    Rule("capitals", lambda p: 2 * p.n_upper > p.n_letters > 0),
    Rule("few_letters", lambda p: 4 * p.n_letters < p.word_chars),
    Rule("few_kinds_of_words", lambda p: 20 * len(set(p.words)) < p.n_words),
)


BASE = Rule("base", lambda p: p.base_failed)

#: Measures of a page that rules share, each after those it is made from.
MEASURED = (
    "words", "n_words", "word_chars", "n_symbols", "filled_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper"
)


def _mask(names: Iterable[str]) -> int:
    return sum(1 << MEASURED.index(n) for n in names if n in MEASURED)


def sampled(docs: DataFrame, text: str) -> DataFrame:
    """The text of about SAMPLE_ROWS rows, each as likely as any other, where they lie."""
    rows = docs.count()
    chosen = docs.select(F.col(f"`{text}`").alias("text"))
    return chosen if rows <= SAMPLE_ROWS else chosen.sample(SAMPLE_ROWS / rows, seed=7)


def rule_profile(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> list[tuple]:
    """``(measure_ns, rule_ns, needs, rejects)`` of each of about SAMPLE_ROWS rows.

    ``measure_ns`` is the time of each of MEASURED, ``rule_ns`` that of each rule
    when all measures are there, ``needs`` says by bits which measures the rule
    asked for.  Measured on executors; only these numbers come to the driver.
    """
    arrow = pa.schema([(c, pa.list_(pa.int64())) for c in ("measure_ns", "rule_ns", "needs", "rejects")])

    def make():
        hashes, clock = WordHashes(), time.perf_counter_ns

        def timed(f, *args):
            start = clock()
            found = f(*args)
            return found, clock() - start

        def step(batch):
            rows = []
            for t in batch.column(0).to_pylist():
                full = Page(t, hashes)
                measures = [timed(getattr, full, m)[1] for m in MEASURED]
                done = [timed(r.rejects, full) for r in rules]
                needs = []
                for r in rules:
                    fresh = Page(t, hashes)
                    r.rejects(fresh)
                    needs.append(_mask(vars(fresh)))
                rows.append((measures, [ns for _, ns in done], needs, [int(out) for out, _ in done]))
            yield columns_batch(zip(*rows, strict=True), arrow)

        return step

    schema = ", ".join(f"{f.name} array<bigint>" for f in arrow)
    return [tuple(r) for r in in_arrow(sampled(docs, text), make, schema).collect()]


def cascade_order(profile: Sequence[tuple], n_rules: int, paid: int = 0) -> list[int]:
    """Rules by rejections per cost, each judged on what earlier ones let pass.

    A rule costs its own time and that of the measures it needs which no earlier
    rule has paid for; the measures in ``paid`` cost nothing.
    """
    if not profile or not n_rules:
        return list(range(n_rules))
    measures, own = (np.array([p[k] for p in profile], float).mean(axis=0) for k in (0, 1))
    needs = np.bitwise_or.reduce([p[2] for p in profile])
    out = np.array([p[3] for p in profile], bool).T
    left, order, rest = np.ones(len(profile), bool), [], list(range(n_rules))

    def cost(k: int) -> float:
        new = int(needs[k]) & ~paid
        return 1 + own[k] + sum(m for i, m in enumerate(measures) if new >> i & 1)

    while rest:
        best = max(rest, key=lambda k: ((out[k] & left).sum() / cost(k), -cost(k), -k))
        order.append(best)
        rest.remove(best)
        left &= ~out[best]
        paid |= int(needs[best])
    return order


def quality_cascade(
    docs: DataFrame, rules: Sequence[Rule] = RULES, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row: key, the base measures, ``base_failed``, ``kept``.

    ``kept`` is false when the base test fails or a rule rejects the text.
    A NULL or empty text has no word and fails the base test.  Rows are judged
    one by one: repeated rows and NULL keys come out as often as they come in.
    The measures of the output are computed for every row, so the rules are
    ordered by what they cost beyond them.  The table is read once, plus the sample.
    """
    order = cascade_order(rule_profile(docs, rules, text), len(rules), _mask((*MEASURES, "words", "filled_lines")))
    ranked = [rules[k] for k in order]
    arrow = pa.schema(
        [("key", docs_key_type(docs, key))]
        + [(c, pa.int64()) for c in MEASURES]
        + [("base_failed", pa.bool_()), ("kept", pa.bool_())]
    )

    def make():
        hashes = WordHashes()

        def one(k, t):
            p = Page(t, hashes)
            failed = p.base_failed
            kept = not failed and not any(r.rejects(p) for r in ranked)
            return (k, *(getattr(p, m) for m in MEASURES), failed, kept)

        return one

    schema = f"key {docs.schema[key].dataType.simpleString()}, " + ", ".join(
        f"{m} bigint" for m in MEASURES
    )
    out = each_row(
        docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")),
        make,
        schema + ", base_failed boolean, kept boolean",
        arrow,
    )
    return out.withColumnRenamed("key", key)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def docs_key_type(docs: DataFrame, key: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema[key].dataType)


def keep_good(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns.

    The base test is one more rule of the cascade.  The judgement runs on the
    rows themselves, so no join is needed.
    """
    rules = (BASE, *rules)
    order = cascade_order(rule_profile(docs, rules, text), len(rules))
    ranked = [rules[k] for k in order]
    at = docs.columns.index(text)

    def make():
        hashes = WordHashes()

        def step(batch):
            good = []
            for t in batch.column(at).to_pylist():
                p = Page(t, hashes)
                good.append(not any(r.rejects(p) for r in ranked))
            yield batch.filter(pa.array(good))

        return step

    return same_columns(docs, make)
