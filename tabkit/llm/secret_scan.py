"""Secrets in texts: fixed patterns, and assignments read as name and literal.

The patterns find keys by their shape.  The lexer reads what looks like source or
configuration (``name = "x"``, ``name: x``, ``"name": "x"``, ``name := x``,
``name => x``, ``place["name"] = "x"``, ``name = call("x")``, ``<name>x</name>``,
and strings in three quotes), joins ``"a" + "b"``, follows names to the literals
they stand for, and scores each literal by the most telling of the names that
lead to it.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.llm.quality import docs_key_type
from tabkit.llm.texts import columns_batch, in_arrow, same_columns

#: The patterns of the base kinds, with the least length of each.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run of 16 or more is a run of any length that passes
KINDS = ("assign", "access", "hex", "named")

#: How much a word in a name says that its value is secret.
NAME_WEIGHTS = {
    "password": 3.0, "passwd": 3.0, "passphrase": 3.0, "pwd": 3.0, "secret": 3.0,
    "token": 2.5, "apikey": 3.0, "credential": 2.5, "credentials": 2.5, "privatekey": 3.0,
    "accesskey": 3.0, "secretkey": 3.0, "authorization": 2.0, "bearer": 2.0, "signature": 1.5,
    "auth": 1.5, "key": 1.0, "salt": 1.5, "cookie": 1.0, "session": 1.0,
}
#: Words in a name that say its value describes a secret and is none.
NAME_HARMLESS = {"id", "name", "hint", "label", "length", "file", "path", "url", "type", "count", "field"}
#: Values that stand for a secret to be filled in.
PLACEHOLDERS = re.compile(
    r"change_?me|your[_-]|example|placeholder|dummy|redacted|xxxx|\*\*\*\*|<[^<>]*+>|\$\{|\{\{|^(?:none|null|true|false)$",
    re.IGNORECASE,
)
THRESHOLD = 3.0
LEAST_LITERAL = 8

_HINT = re.compile("pass|pwd|secret|token|key|cred|auth|bearer|signature|salt|cookie|session", re.I | re.A)
#: Names, literals, blanks and joined parts have no bound; possessive repeats, which
#: never try again with less, keep the reading linear.
_NAME = r"[A-Za-z_][A-Za-z0-9_.\-]*+"
_STRING = (
    r"\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*+\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*+'''"
    r"|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'"
)
_ITEM = rf"(?:{_STRING}|[A-Za-z0-9_.\-]++)"
_PAIR = re.compile(
    rf"""(?:(?P<q>["'])(?P<quoted>{_NAME})(?P=q)(?:[\x20\t]*+\])?+|(?<![A-Za-z0-9_.\-])(?P<name>{_NAME}))
    [\x20\t]*+(?::=|=>|[=:])(?!=)[\x20\t]*+
    (?:(?P<strings>(?:{_STRING})(?:\s*+\+\s*+(?:{_STRING}|{_NAME}))*+)
      |(?P<calls>(?:{_NAME}\(\s*+)++)(?P<items>{_ITEM}(?:\s*+[+,]\s*+{_ITEM})*+)\s*+(?=\))
      |(?P<bare>[^\s"',;\#()\[\]{{}}<>]++))""",
    re.VERBOSE | re.ASCII,
)
_PART = re.compile(rf"{_STRING}|{_NAME}", re.ASCII)
_ELEMENT = re.compile(rf"<(?P<tag>{_NAME})(?:\s[^<>]*+)?>(?P<inner>[^<>]++)</(?P=tag)\s*+>", re.ASCII)
_CALLEE = re.compile(r"([A-Za-z0-9_\-]+)\(")
#: Calls whose first literal says where a value is kept, and is none.
_LOOKUPS = {"getenv", "get", "env", "environ", "input", "getpass", "prompt"}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


@dataclass(frozen=True)
class Pair:
    """``name`` is given the text ``value``, which stands at ``start:end``."""

    name: str
    value: str
    start: int
    end: int


def base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """The spans of the three fixed kinds, each leftmost and without overlap."""
    if "=" in text or ":" in text:
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 12:
                yield "assign", m.start(), m.end()
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if len(m[0]) >= 18:
                yield "access", m.start(), m.end()
    for m in HEX.finditer(text):
        yield "hex", m.start(), m.end()


def _inside(literal: str, start: int) -> tuple[str, int, int]:
    """A string's text and place without its quotes, and without blanks around it."""
    quotes = 3 if len(literal) >= 6 and literal[:3] == literal[-3:] and literal[:3] in ('"""', "'''") else 1
    return _bare(literal[quotes : len(literal) - quotes], start + quotes)


def _bare(value: str, start: int) -> tuple[str, int, int]:
    start += len(value) - len(value.lstrip())
    return value.strip(), start, start + len(value.strip())


def assignments(text: str) -> Iterator[Pair]:
    """Every literal that a name gets, once, under the most telling name that leads to it.

    A name given another name gets that name's literals, wherever they stand;
    a chain of names is followed to its end, and a circle ends it.  Names are
    visited from the heaviest on, each once, so that the time is linear in the
    pairs whatever their chains.
    """
    literals: dict[str, list[tuple[str, int, int]]] = {}
    reads: dict[str, list[str]] = {}
    for m in _PAIR.finditer(text):
        name = m["quoted"] or m["name"]
        if m["bare"]:
            value = m["bare"].rstrip(".:!?")
            literals.setdefault(name, []).append((value, m.start("bare"), m.start("bare") + len(value)))
            reads.setdefault(name, []).append(value)
            continue
        group = "strings" if m["strings"] else "items"
        looked_up = group == "items" and _CALLEE.findall(m["calls"])[-1].lower() in _LOOKUPS
        for p in _PART.finditer(m[group]):
            if p[0][0] not in "\"'":
                reads.setdefault(name, []).append(p[0])
            elif looked_up:
                looked_up = False
            else:
                literals.setdefault(name, []).append(_inside(p[0], m.start(group) + p.start()))
    if "</" in text:
        for m in _ELEMENT.finditer(text):
            literals.setdefault(m["tag"], []).append(_bare(m["inner"], m.start("inner")))
    best: dict[str, str] = {}
    for name in sorted(dict.fromkeys([*literals, *reads]), key=name_weight, reverse=True):
        todo = [name]
        while todo:
            here = todo.pop()
            if here not in best:
                best[here] = name
                todo += [other for other in reads.get(here, ()) if other in literals and other not in best]
    for name, found in literals.items():
        for value, start, end in found:
            if value not in literals:
                yield Pair(best[name], value, start, end)


def name_weight(name: str) -> float:
    """What the name says: its heaviest word, or nothing if it is harmless."""
    words = [w.lower() for w in _WORD.findall(name)]
    if not words or words[-1] in NAME_HARMLESS:
        return 0.0
    joined = [a + b for a, b in zip(words, words[1:], strict=False)]
    return max((NAME_WEIGHTS.get(w, 0.0) for w in [*words, *joined]), default=0.0)


def literal_score(name: str, value: str) -> float:
    """Name's weight plus what the literal looks like; 0 if it can be no secret."""
    weight = name_weight(name)
    if not weight or len(value) < LEAST_LITERAL or " " in value or PLACEHOLDERS.search(value):
        return 0.0
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(
        any(f(c) for c in value)
        for f in (str.isdigit, str.islower, str.isupper, lambda c: not c.isalnum())
    )
    return weight + (bits >= 3.0) * 0.75 + (kinds >= 2) * 0.75 + (n >= 16) * 0.5 - (kinds == 1) * 1.0


def spans_of(text: str | None, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    """``(kind, start, end, score)``: base spans, and literals under telling names.

    By start, then by kind as listed.  A literal inside a base span is not named
    again.  Offsets count code points; the end is exclusive.
    """
    if not text:
        return []
    found = [(k, s, e, 1.0) for k, s, e in base_spans(text)]
    if ("=" in text or ":" in text or "</" in text) and _HINT.search(text):
        taken = sorted((s, e) for _, s, e, _ in found)
        starts = [s for s, _ in taken]
        reach = list(accumulate((e for _, e in taken), max))
        best: dict[tuple[int, int], float] = {}
        for p in assignments(text):
            score = literal_score(p.name, p.value)
            before = bisect_right(starts, p.start)
            if score >= threshold and not (before and reach[before - 1] >= p.end):
                best[p.start, p.end] = max(score, best.get((p.start, p.end), 0.0))
        found += [("named", s, e, score) for (s, e), score in best.items()]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"
_ARROW = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
)


def _structs(found: list[tuple]) -> list[dict]:
    return [dict(zip(("kind", "start", "end", "score"), x, strict=True)) for x in found]


def find_secrets(
    docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """One row per row: the key and ``spans``, an array of kind, start, end, score.

    NULL and empty texts have no span.  Rows are read one by one, without a
    shuffle; repeated rows and NULL keys come out as often as they come in.
    """
    arrow = pa.schema([("key", docs_key_type(docs, key)), ("spans", _ARROW)])

    def make():
        def step(batch):
            found = [_structs(spans_of(t, threshold)) for t in batch.column(1).to_pylist()]
            yield columns_batch((batch.column(0), found), arrow)

        return step

    kind = docs.schema[key].dataType.simpleString()
    out = in_arrow(docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")), make, f"key {kind}, spans {SPANS}")
    return out.withColumnRenamed("key", key)


def mask(text: str, found: list[tuple], put: str) -> str:
    """``text`` with every span, overlapping ones together, replaced."""
    parts, at = [], 0
    for _, start, end, _ in found:
        if start >= at:
            parts += [text[at:start], put]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def mask_secrets(
    docs: DataFrame,
    text: str = "text",
    length: str | None = "n_chars",
    put: str = "[secret]",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """All rows and columns of ``docs``, with the secrets in ``text`` replaced.

    ``length``, if such a column is there, becomes the new number of code points
    of a text that changed.  All other rows stay as they are.
    """
    at = docs.columns.index(text)
    size = docs.columns.index(length) if length in docs.columns else None

    def make():
        def step(batch):
            old = batch.column(at).to_pylist()
            new = [mask(t, f, put) if (f := spans_of(t, threshold)) else t for t in old]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if size is not None:
                before = batch.column(size).to_pylist()
                counts = [n if a == b else len(b) for n, a, b in zip(before, old, new, strict=True)]
                columns[size] = pa.array(counts, batch.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

        return step

    return same_columns(docs, make)
