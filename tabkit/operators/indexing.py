"""Categories as indices: most frequent first, ties by text."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import StringIndexerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabkit.operators.counts import COLUMN, COUNT, ROWS, count_values, value_text
from tabkit.operators.lookup import BROADCAST_BYTES, join_lookup, row_bytes
from tabkit.operators.ranking import number_rows
from tabkit.sources import settle

# What the labels that travel as one code book with the tasks are measured to be below.
BOOK_LABELS = 4096
BOOK_BYTES = 4 * 1024 * 1024


def label_counts(
    df: DataFrame, columns: Sequence[str], weight: str | None = None
) -> DataFrame:
    """``(column, value, n, rows)``: every value but NULL, as text, counted.

    ``n`` is the sum of ``weight`` for a table whose rows carry a count.
    """
    return (
        count_values(df, columns, weight)
        .select(
            F.col(COLUMN).alias("column"),
            value_text(df, columns).alias("value"),
            F.col(COUNT).alias("n"),
            F.col(ROWS).alias("rows"),
        )
        .where(F.col("value").isNotNull())
    )


def _sizes(counts: DataFrame) -> dict[str, tuple[int, int]]:
    """Labels and bytes per column, from one job over the settled counts."""
    rows = (
        counts.groupBy("column")
        .agg(F.count(F.lit(1)).alias("labels"), F.sum(row_bytes(counts)).alias("bytes"))
        .collect()
    )
    return {r["column"]: (r["labels"], r["bytes"]) for r in rows}


def rank_labels(
    counts: DataFrame, max_bytes: int = BROADCAST_BYTES, size: int | None = None
) -> DataFrame:
    """``(column, value, n, rows, index)`` from settled :func:`label_counts`."""
    return number_rows(
        counts,
        ["column"],
        [F.col("n").desc(), F.col("value").asc()],
        "index",
        max_bytes,
        size,
    )


@dataclass(frozen=True)
class Labels:
    """Fitted indices: a settled table, and per column its labels and their bytes.

    ``table`` is ``(column, value, n, rows, index)``.  It stays in the cluster
    whatever the number of labels.  ``book`` holds the labels of the columns with
    few of them, in order of their index.
    """

    table: DataFrame
    sizes: dict[str, tuple[int, int]]
    max_bytes: int = BROADCAST_BYTES
    book: dict[str, list[str]] = field(default_factory=dict)

    def count(self, column: str) -> int:
        return self.sizes.get(column, (0, 0))[0]


def fit_labels(
    df: DataFrame, columns: Sequence[str], weight: str | None = None, max_bytes: int = BROADCAST_BYTES
) -> Labels:
    """Index the values of several columns, from one scan; any number of them."""
    return labels_of(settle(label_counts(df, columns, weight)), columns, max_bytes)


def labels_of(counts: DataFrame, columns: Sequence[str], max_bytes: int = BROADCAST_BYTES) -> Labels:
    """The indices that settled :func:`label_counts` lead to.

    Columns enter the code book from the smallest on, up to BOOK_LABELS and
    BOOK_BYTES in all (and ``max_bytes``); if all do, the table itself is not
    computed until it is asked for.
    """
    sizes = _sizes(counts)
    room, space, held = BOOK_LABELS, min(BOOK_BYTES, max_bytes), []
    for c in sorted(dict.fromkeys(columns), key=lambda c: sizes.get(c, (0, 0))):
        n, size = sizes.get(c, (0, 0))
        room, space = room - n, space - size
        if room < 0 or space < 0:
            break
        held.append(c)
    found: dict[str, list[tuple[int, str]]] = {c: [] for c in held}
    if held:
        listed = counts.where(F.col("column").isin(held)).select("column", "value", "n")
        for c, value, n in listed.collect():
            found[c].append((-n, value))
    book = {c: [value for _, value in sorted(pairs)] for c, pairs in found.items()}
    table = rank_labels(counts, max_bytes, sum(b for _, b in sizes.values()))
    whole = len(held) == len(set(columns))
    return Labels(table if whole else settle(table), sizes, max_bytes, book)


def apply_labels(
    df: DataFrame,
    labels: Labels,
    columns: Sequence[str],
    outputs: Sequence[str],
    null: str = "null",
    unseen: str | None = None,
) -> DataFrame:
    """Add the fitted index of each column as a double.

    ``null`` and ``unseen`` (by default the same) say what NULL and a value that
    was not there at the fit become: ``"null"``, with ``"keep"`` the index after
    the last label, with ``"error"`` a failure of the job.  The new columns are
    nominal to Spark ML and say how many values they can have.

    All columns of the code book are indexed in one projection, without a join;
    only a column with more labels is joined with the table.
    """
    unseen = null if unseen is None else unseen
    for choice in (null, unseen):
        if choice not in ("null", "keep", "error"):
            raise ValueError("null and unseen are 'null', 'keep' or 'error'")
    places = {c: i for i, c in enumerate(columns)}
    out = df.withColumns({f"_label{i}": F.col(f"`{c}`").cast("string") for c, i in places.items()})
    near = [c for c in places if c in labels.book]
    if near:
        model = StringIndexerModel.from_arrays_of_labels(
            [labels.book[c] for c in near],
            inputCols=[f"_label{places[c]}" for c in near],
            outputCols=[f"_index{places[c]}" for c in near],
            handleInvalid="keep",
        )
        out = model.transform(out)
    for c, i in places.items():
        if c in labels.book:
            continue
        own = labels.table.where(F.col("column") == c).select(
            F.col("value").alias(f"_label{i}"),
            F.col("index").cast("double").alias(f"_index{i}"),
            F.col("rows").alias("_rows"),
        )
        size = labels.sizes.get(c, (0, 0))[1]
        out = join_lookup(out, own, [f"_label{i}"], "_rows", max_bytes=labels.max_bytes, size=size)

    def index(c: str, name: str) -> Column:
        n, i = labels.count(c), places[c]

        def instead(choice: str, what: str) -> Column:
            if choice == "error":
                return F.raise_error(F.lit(f"{what} in {c}")).cast("double")
            return F.lit(float(n) if choice == "keep" else None).cast("double")

        known = F.col(f"_index{i}") < n
        other = F.when(F.col(f"_label{i}").isNull(), instead(null, "NULL")).otherwise(instead(unseen, "a new value"))
        values = n + ("keep" in (null, unseen))
        nominal = {"ml_attr": {"type": "nominal", "name": name, "num_vals": max(1, values)}}
        return F.when(known, F.col(f"_index{i}")).otherwise(other).alias(name, metadata=nominal)

    added = {name: index(c, name) for c, name in zip(columns, outputs, strict=True)}
    kept = [F.col(f"`{x}`") for x in df.columns if x not in added]
    return out.select(*kept, *added.values())


def index_labels(
    df: DataFrame,
    columns: Sequence[str],
    suffix: str = "_index",
    null: str = "null",
    weight: str | None = None,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """:func:`fit_labels` and :func:`apply_labels` on the same table.

    Numbers are ranked by their text among equal counts.  No label list comes
    to the driver.
    """
    if null not in ("null", "keep", "error"):
        raise ValueError("null is 'null', 'keep' or 'error'")
    labels = fit_labels(df, columns, weight, max_bytes)
    return apply_labels(df, labels, columns, [c + suffix for c in columns], null)
