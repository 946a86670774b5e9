"""Packing documents into sequences: shortest pack first over the length histogram.

Texts become token ids once.  A document longer than a sequence is cut into whole
sequences and a rest; every other document stays in one piece.  The histogram of
piece lengths is small whatever the corpus, so the packing is planned on it:
lengths are placed longest first, each into the pattern that holds least, if it
takes it.  Pieces then find their place by their rank among the pieces of
their length.
"""

from __future__ import annotations

import re
from bisect import insort
from collections import defaultdict
from collections.abc import Sequence
from functools import lru_cache
from itertools import filterfalse, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabkit.llm.quality import docs_key_type
from tabkit.llm.texts import columns_batch, in_arrow
from tabkit.sources import shared_path

# Distinct words a Python worker keeps the ids of before it forgets the later two thirds.
KEPT_WORDS = 900_000
#: Texts whose new words are encoded together, and new words encoded in one go.
TOGETHER = 256
AT_ONCE = 2000

#: Latin-1: letters in lower case, and how upper case becomes it.
_LETTERS = rb"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_LOWER = bytes(c + 32 if 65 <= c <= 90 or 192 <= c <= 222 and c != 215 else c for c in range(256))
_PIECES = re.compile(rb"[" + _LETTERS + rb"]+|[0-9]|[^0-9\t-\r \x85\xa0" + _LETTERS + rb"]+")
#: Texts with one of these are left to the tokenizer as they are: contractions,
#: special tokens, numerals beyond 0-9, and four controls.
_PLAIN = re.compile(rb"['\xb2\xb3\xb9\xbc-\xbe\x1c-\x1f]|<\|")


#: Shows a tokenizer that does not cut a text as :class:`WordIds` does.
PROBE = "The  Quick\tbrown\nÉté ÿß-Fox, jumped 1234 times (a1b2)!! over_it... ~#x $5.00 \xa0 a/b THE the æØ"


class WordIds:
    """Token ids of whole texts, remembered word by word, as bytes.

    For a tokenizer that lower-cases, drops white space, and cuts a text into
    runs of letters, single digits and runs of other marks before it merges: no
    token reaches over such a cut, so each piece's ids can be kept.  Texts beyond
    Latin-1 are encoded whole, and with a tokenizer that gives other ids for
    PROBE so is every text.  Ids are little-endian unsigned 32-bit numbers.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[bytes, bytes] = {}
        self.whole = False
        self.whole = self._differs()
        self.words.clear()

    def _differs(self) -> bool:
        try:
            return self.ids([PROBE, PROBE[::-1]]) != [self._encoded(PROBE), self._encoded(PROBE[::-1])]
        except (KeyError, TypeError, ValueError):
            # No word numbers, or fewer than words: not a tokenizer of this kind.
            return True

    def _encoded(self, piece: str) -> bytes:
        ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def _learn(self, words: list[bytes]) -> None:
        """Encode runs of letters together: each is one word to the tokenizer."""
        found = self.tokenizer.encode(b" ".join(words).decode("latin-1"), add_special_tokens=False)
        ends = np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(words)), "right")
        raw, start = np.array(found.ids, "<u4").tobytes(), 0
        for word, end in zip(words, (4 * ends).tolist(), strict=True):
            self.words[word] = raw[start:end]
            start = end

    def _pieces(self, text: str | None) -> list[bytes] | None:
        if self.whole:
            return None
        try:
            raw = (text or "").encode("latin-1")
        except UnicodeEncodeError:
            return None
        return None if _PLAIN.search(raw) else _PIECES.findall(raw.translate(_LOWER))

    def ids(self, texts: Sequence[str | None]) -> list[bytes]:
        """The ids of each text; NULL has none."""
        cut = [self._pieces(t) for t in texts]
        new = set()
        for pieces in filter(None, cut):
            new.update(filterfalse(self.words.__contains__, pieces))
        if len(self.words) + len(new) > KEPT_WORDS:
            # What came first is what comes often.
            self.words = dict(islice(self.words.items(), KEPT_WORDS // 3))
            new = set().union(*filter(None, cut)).difference(self.words)
        letters = []
        for word in new:
            if word[0] in _LETTER_BYTES:
                letters.append(word)
            else:
                self.words[word] = self._encoded(word.decode("latin-1"))
        for at in range(0, len(letters), AT_ONCE):
            self._learn(letters[at : at + AT_ONCE])
        find = self.words.__getitem__
        return [
            self._encoded(t or "") if c is None else b"".join(map(find, c)) for t, c in zip(texts, cut, strict=True)
        ]


_LETTER_BYTES = frozenset(c for c in range(256) if re.fullmatch(rb"[" + _LETTERS + rb"]", bytes([c])))


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One per Python worker, so that its tasks share what is remembered."""
    return WordIds(path)


def plan_packs(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """``(lengths, count)``: so many sequences hold pieces of these lengths.

    Longest lengths first.  Patterns are kept by the room they have left; pieces
    of a length go to the shortest pack, the pattern with most room, as many at a
    time as there are such sequences, and open new sequences when it has no room.
    The work depends on the number of lengths, not on that of the pieces.
    """
    by_room: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    rooms: list[int] = []

    def put(pattern: tuple[int, ...], room: int, count: int) -> None:
        if room not in by_room:
            insort(rooms, room)
        by_room[room][pattern] += count

    def take(room: int, most: int) -> tuple[tuple[int, ...], int]:
        pattern, count = next(iter(by_room[room].items()))
        used = min(count, most)
        if used == count:
            del by_room[room][pattern]
            if not by_room[room]:
                del by_room[room]
                rooms.remove(room)
        else:
            by_room[room][pattern] -= used
        return pattern, used

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 0 < length <= size:
            raise ValueError(f"a piece of {length} does not fit into {size}")
        while left:
            if rooms and rooms[-1] >= length:
                room = rooms[-1]
                pattern, used = take(room, left)
                put((*pattern, length), room - length, used)
                left -= used
                continue
            each = min(size // length, left)
            count = left // each
            put((length,) * each, size - each * length, count)
            left -= count * each
    return sorted((p, n) for packs in by_room.values() for p, n in packs.items())


def slot_table(plan: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows ``length, first rank, first sequence, offset, sequences``, sorted.

    Pieces of a length with ranks from ``first rank`` on take one slot of the
    pattern in each of its sequences.
    """
    rows, used, sequence = [], defaultdict(int), 0
    for pattern, count in plan:
        offset = 0
        for length in pattern:
            rows.append((length, used[length], sequence, offset, count))
            used[length] += count
            offset += length
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def token_pieces(
    docs: DataFrame, tokenizer: str, size: int, end_id: int, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pieces of at most ``size`` ids: key, start, length, doc_tokens, ids, part, local.

    ``ids`` are little-endian unsigned 32-bit numbers.  ``local`` numbers the
    pieces of one length within their task, ``part``.
    """
    arrow = pa.schema(
        [("key", docs_key_type(docs, key)), ("start", pa.int64()), ("length", pa.int64()),
         ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("part", pa.int32()), ("local", pa.int64())]
    )

    def make():
        words, seen, part = word_ids(tokenizer), defaultdict(int), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()

        def step(batch):
            rows, keys, texts = [], batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(texts), TOGETHER):
                found = words.ids(texts[at : at + TOGETHER])
                for k, ids in zip(keys[at : at + TOGETHER], found, strict=True):
                    raw = ids + end
                    total = len(raw) // 4
                    for start in range(0, total, size):
                        length = min(size, total - start)
                        piece = raw[4 * start : 4 * (start + length)]
                        rows.append((k, start, length, total, piece, part, seen[length]))
                        seen[length] += 1
            yield columns_batch(zip(*rows, strict=True), arrow)

        return step

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, start bigint, length bigint, doc_tokens bigint, ids binary, part int, local bigint"
    return in_arrow(docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")), make, schema)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    size: int = 2048,
    end_id: int = 1,
    key: str = "doc_id",
    text: str = "text",
    payload: Column | None = None,
) -> DataFrame:
    """One row per piece: key, start, length, doc_tokens, ids, sequence_id, offset.

    A document is its ids and ``end_id``, so a NULL or empty text is one piece
    of one id; repeated rows are packed as often as they come.  Sequences are
    numbered from 0 and filled without gaps from offset 0.  ``payload``, an
    expression over ``ids``, replaces the ids in the result.

    The ids are written once to the shared folder.  At most ``size`` histogram
    rows come to the driver, and the plan made from them goes to the tasks.
    """
    spark = docs.sparkSession
    path = shared_path(spark, "pieces")
    token_pieces(docs, tokenizer, size, end_id, key, text).write.option(
        "compression", "zstd"
    ).parquet(path)
    pieces = spark.read.parquet(path)
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()
    slots = slot_table(plan_packs({r["length"]: r["n"] for r in histogram}, size))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))

    given = spark.sparkContext.broadcast(slots)
    places = pa.struct([("sequence_id", pa.int64()), ("offset", pa.int64())])

    @F.arrow_udf("sequence_id bigint, offset bigint")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        table = given.value
        span = np.int64(table[:, 1].max() + table[:, 4].max() + 1)
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        at = np.searchsorted(table[:, 0] * span + table[:, 1], lengths * span + ranks, "right") - 1
        row = table[at]
        ids = row[:, 2] + ranks - row[:, 1]
        return pa.StructArray.from_arrays([pa.array(ids), pa.array(row[:, 3])], fields=list(places))

    body = F.col("ids") if payload is None else payload.alias("ids")
    return (
        pieces.select("key", "start", "length", "doc_tokens", body, "part", "local")
        .join(first, ["length", "part"])
        .withColumn("_at", place(F.col("length"), F.col("first") + F.col("local")))
        .select(
            F.col("key").alias(key), "start", "length", "doc_tokens", "ids", "_at.sequence_id", "_at.offset"
        )
    )
