"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words.  A document's expected number of copies is
its source's target over its source's size, or in proportion to a weight of its
own.  The whole copies are certain.  For the remaining fraction p, documents are
ranked by (u / (1 - u)) / (p / (1 - p)) with a random u of their own, and taken
in that order until the source's target is filled as closely as whole documents
allow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabkit.sources import store

#: Cells that each of two passes cuts the ranks of a source into.
CELLS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of characters other than space and U+0009 to U+000D; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(
    sizes: DataFrame, weights: Sequence[float], share: float, most: float
) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``.

    Sources in order of their code points, NULL last, get ``weights``, repeated.
    The targets share ``share`` times all sizes by weight and stop at ``most``
    times the source's size; what a source cannot take is shared again.  Sorted
    by the level at which a source is full, the full ones are a prefix, so one
    running sum finds them.  One row per source is all this sees.
    """
    place = Window.orderBy(F.col("source").isNull(), "source")
    full = Window.orderBy("level", "place")
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    behind = full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")
    )
    rate = (F.col("total") - F.col("filled")) / F.col("open")
    return (
        sizes.withColumn("place", F.row_number().over(place) - 1)
        .withColumn("weight", weight)
        .withColumn("roof", F.col("source_size") * F.lit(float(most)))
        .withColumn("level", F.col("roof") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(whole) * F.lit(float(share)))
        .withColumn("filled", F.coalesce(F.sum("roof").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(behind))
        .withColumn("rate", F.max(F.when(F.col("level") >= rate, rate)).over(whole))
        .select(
            "source",
            "source_size",
            F.least(F.col("roof"), F.col("rate") * F.col("weight")).alias("target"),
        )
    )


class Mix:
    """A fitted mix: one row per source, and how it applies to rows."""

    def __init__(self, cuts: DataFrame, columns: tuple[str, str, str], own: Column | None, most: float, seed: int):
        self.cuts, self.columns, self.own, self.most, self.seed = cuts, columns, own, most, seed


def _uniform(key: Column, text: Column, seed: int) -> Column:
    """A number in (0, 1) from the seed, the key and the text, by MD5."""
    empty = F.lit("")
    parts = (F.lit(str(seed)), F.coalesce(key.cast("string"), empty), F.md5(F.coalesce(text, empty)))
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(1 << 52))


def _measured(
    docs: DataFrame, columns: tuple[str, str, str], own: Column | None, seed: int
) -> dict[str, Column]:
    key, text, source = (F.col(f"`{c}`") for c in columns)
    weight = F.lit(1.0) if own is None else own.cast("double")
    good = weight.isNotNull() & ~F.isnan(weight) & (weight > 0)
    return {
        "_key": key,
        "_source": source,
        "_size": word_count(text),
        "_print": F.xxhash64(text),
        "_u": _uniform(key, text, seed),
        "_own": F.when(good, weight).otherwise(F.lit(0.0)),
    }


def _ranked(rows: DataFrame, most: float) -> DataFrame:
    """Adds the certain copies and the rank; needs the rows' source's ``_rate``."""
    u = F.col("_u")
    expected = F.least(F.lit(float(most)), F.col("_rate") * F.col("_own"))
    # q / (1 + q) orders as the odds ratio q does, and lies between 0 and 1.
    odds, inclusion = u / (1 - u), F.col("_p") / (1 - F.col("_p"))
    return (
        rows.withColumn("_expected", expected)
        .withColumn("_sure", F.floor("_expected"))
        .withColumn("_p", F.col("_expected") - F.col("_sure"))
        .withColumn("_v", F.when(F.col("_p") > 0, odds / (odds + inclusion)))
        .withColumn("_cell", F.floor(F.col("_v") * CELLS))
        .withColumn("_fine", F.floor((F.col("_v") * CELLS - F.col("_cell")) * CELLS))
    )


def _crossing(words: DataFrame, cell: str, name: str) -> DataFrame:
    """Per source the cell in which the running sum passes ``_gap``, and what is left there."""
    before = (
        Window.partitionBy("_source").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    )
    run = words.withColumn("_before", F.coalesce(F.sum("_words").over(before), F.lit(0)))
    return (
        run.where(F.col("_before") <= F.col("_gap"))
        .groupBy("_source")
        .agg(F.max_by(F.struct(F.col(cell).alias("at"), (F.col("_gap") - F.col("_before")).alias("left")), cell).alias("_x"))
        .select("_source", F.col("_x.at").alias(name), F.col("_x.left").alias("_gap"))
    )


def _by_source(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Join on the source, NULL with NULL.

    The table is a written one, so Spark knows its size: it is broadcast below
    the session's threshold and shuffled, with splitting of skew, beyond it.
    """
    return rows.join(
        table.withColumnRenamed("_source", "_of"), F.col("_source").eqNullSafe(F.col("_of"))
    ).drop("_of")


def fit_mix(
    docs: DataFrame,
    weights: Sequence[float] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 42,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    own: Column | None = None,
) -> Mix:
    """Targets of the sources, and where each source's sample ends.

    ``own`` is a weight of each document (default 1) to which its expected
    copies are in proportion, up to ``most``; NULL, NaN and negative ones count
    as 0.  No source is gathered in one task: ranks are summed in cells, and
    only documents of the cell in which a source's target falls are put in order.
    """
    columns = (key, text, source)
    measures = _measured(docs, columns, own, seed)
    rows = store(docs.select(*[c.alias(n) for n, c in measures.items()]), "sizes")
    sizes = rows.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size"))
    targets = store(
        source_targets(sizes, weights, share, most).withColumnRenamed("source", "_source"), "targets"
    )
    rates = _rates(rows, targets, most, equal=own is None)
    ranked = _ranked(_by_source(rows, rates), most)
    open_words = F.when(F.col("_v").isNotNull(), F.col("_size")).otherwise(F.lit(0))
    # The certain copies of all documents, and the words that can still be drawn, by cell.
    cells = store(
        ranked.groupBy("_source", "_cell").agg(
            F.sum(open_words).alias("_words"), F.sum(F.col("_sure") * F.col("_size")).alias("_sure_words")
        ),
        "cells",
    )
    gaps = _by_source(
        cells.groupBy("_source").agg(F.sum("_sure_words").alias("_sure_words")), targets
    ).select("_source", (F.col("target") - F.col("_sure_words")).alias("_gap"))
    coarse = store(
        _crossing(_by_source(cells.where(F.col("_cell").isNotNull()), gaps), "_cell", "_c1"), "coarse"
    )
    inside = _by_source(ranked, coarse).where(F.col("_cell") == F.col("_c1"))
    fine = store(
        _by_source(
            _crossing(
                inside.groupBy("_source", "_fine", "_gap").agg(F.sum("_size").alias("_words")), "_fine", "_c2"
            ),
            coarse.drop("_gap"),
        ),
        "fine",
    )
    # Equal rows are one unit: they are drawn together or not at all.
    units = (
        _by_source(ranked, fine)
        .where((F.col("_cell") == F.col("_c1")) & (F.col("_fine") == F.col("_c2")))
        .groupBy("_source", "_v", "_key", "_print", "_gap")
        .agg(F.sum("_size").alias("_words"))
    )
    order = Window.partitionBy("_source").orderBy("_v", "_key", "_print")
    done = F.coalesce(F.sum("_words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = (
        units.withColumn("_done", done)
        .where(F.col("_done") + F.col("_words") / 2 <= F.col("_gap"))
        .groupBy("_source")
        .agg(F.max(F.struct("_v", F.coalesce(F.col("_key"), F.lit(-1)).alias("_k"), "_print")).alias("_end"))
    )
    cuts = targets
    for table in (rates, fine.drop("_gap"), last):
        cuts = cuts.join(
            table.withColumnRenamed("_source", "_of"), F.col("_source").eqNullSafe(F.col("_of")), "left"
        ).drop("_of")
    return Mix(store(cuts, "mix"), columns, own, most, seed)


def _rates(rows: DataFrame, targets: DataFrame, most: float, equal: bool) -> DataFrame:
    """Per source the factor that turns a document's weight into expected copies.

    With unequal weights some documents reach ``most``; the factor then grows for
    the others until no further document does.  Each round is one aggregate.
    """
    if equal:
        rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
        return targets.select("_source", rate.alias("_rate"))
    rates = targets.select("_source", F.lit(0.0).alias("_rate"))
    while True:
        full = F.col("_rate") * F.col("_own") >= F.lit(float(most))
        mass = _by_source(rows, rates).groupBy("_source", F.col("_rate").alias("_old")).agg(
            F.sum(F.when(full, F.col("_size")).otherwise(0) * F.lit(float(most))).alias("_taken"),
            F.sum(F.when(full, 0.0).otherwise(F.col("_size") * F.col("_own"))).alias("_mass"),
        )
        new = F.greatest(
            F.col("_old"),
            F.coalesce(
                F.when(F.col("_mass") > 0, (F.col("target") - F.col("_taken")) / F.col("_mass")), F.col("_old")
            ),
        )
        step = store(_by_source(mass, targets).select("_source", "_old", new.alias("_rate")), "rates")
        rates = step.select("_source", "_rate")
        if step.where(F.col("_rate") > F.col("_old") * (1 + 1e-12)).isEmpty():
            return rates


def apply_mix(docs: DataFrame, mix: Mix) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken, in columns of those names
    with ``_mix_`` before them."""
    measures = _measured(docs, mix.columns, mix.own, mix.seed)
    rows = _ranked(_by_source(docs.withColumns(measures), mix.cuts), mix.most)
    cell = F.struct("_cell", "_fine")
    limit = F.struct(F.col("_c1").alias("_cell"), F.col("_c2").alias("_fine"))
    own_rank = F.struct("_v", F.coalesce(F.col("_key"), F.lit(-1)).alias("_k"), "_print")
    drawn = F.col("_v").isNotNull() & (
        (cell < limit) | ((cell == limit) & F.coalesce(own_rank <= F.col("_end"), F.lit(False)))
    )
    copies = (F.col("_sure") + F.coalesce(drawn, F.lit(False)).cast("bigint")).cast("bigint")
    out = rows.withColumns(
        {
            "_mix_size": F.col("_size"),
            "_mix_source_size": F.col("source_size"),
            "_mix_target": F.col("target"),
            "_mix_copies": copies,
            "_mix_taken": copies * F.col("_size"),
        }
    )
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *[c for c in out.columns if c.startswith("_mix_")])


def mix_sources(docs: DataFrame, **settings) -> DataFrame:
    """One row per row: key, size, source_size, target, copies, taken.

    See :func:`fit_mix` for the settings.  A text without words has size 0 and
    takes no words.  Sources may be NULL: they are one source, the last.  Equal
    rows (key and text) get equal copies.  Runs agree: the random number of a
    row follows from the seed, the key and the text.
    """
    key, text, source = (settings.get(n, d) for n, d in (("key", "doc_id"), ("text", "text"), ("source", "source")))
    own = settings.get("own")
    slim = docs.select(
        F.col(f"`{key}`"), F.col(f"`{text}`"), F.col(f"`{source}`"),
        *([] if own is None else [own.alias("_weight")]),
    )
    if own is not None:
        settings["own"] = F.col("_weight")
    mixed = apply_mix(slim, fit_mix(slim, **settings))
    return mixed.select(
        F.col(f"`{key}`"), *[F.col(f"_mix_{c}").alias(c) for c in ("size", "source_size", "target", "copies", "taken")]
    )


def mixed_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", own: Column | None = None, **settings
) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    Other columns may have any name: inside, all columns go by their place.
    See :func:`fit_mix` for the settings and :func:`mix_sources` for the cases.
    """
    places = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(
        *[F.col(f"`{c}`").alias(p) for c, p in places.items()], *([] if own is None else [own.alias("weight")])
    )
    settings |= {"key": places[key], "text": places[text], "source": places[source]}
    settings["own"] = None if own is None else F.col("weight")
    mixed = apply_mix(plain, fit_mix(plain, **settings))
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), "_mix_copies"))
    taken = mixed.where(F.col("_mix_copies") > 0).withColumn("_mix_copy", copies)
    return taken.select(*[F.col(p).alias(c) for c, p in places.items()])
