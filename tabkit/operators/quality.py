"""Finding, naming, filling and dropping missing values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabkit.functions import MISSING_TOKENS, is_complete, is_missing
from tabkit.operators.counts import COLUMN, COUNT, count_values, value_homes
from tabkit.sources import settle


def null_tokens(
    df: DataFrame,
    tokens: Sequence[str] = MISSING_TOKENS,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Sentinel texts become NULL in the string columns; the match is exact.

    ``columns`` narrows them down; a name the table does not have is an error,
    a column of another type stays as it is.
    """
    unknown = set(columns or ()) - set(df.columns)
    if unknown:
        raise ValueError(f"no such columns: {', '.join(sorted(unknown))}")
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    chosen = texts if columns is None else [c for c in columns if c in texts]
    if not chosen or not tokens:
        return df
    named = {c: F.when(~F.col(f"`{c}`").isin(*tokens), F.col(f"`{c}`")) for c in chosen}
    return df.select(*[named[c].alias(c) if c in named else F.col(f"`{c}`") for c in df.columns])


def missing_counts(
    df: DataFrame, tokens: Sequence[str] = MISSING_TOKENS, nan: bool = True
) -> DataFrame:
    """One row; per column the number of missing values.  One scan."""
    return df.agg(
        *[F.count_if(is_missing(f, tokens, nan)).alias(f.name) for f in df.schema.fields]
    )


def missing_profile(
    df: DataFrame, tokens: Sequence[str] = MISSING_TOKENS, nan: bool = True
) -> DataFrame:
    """``(column, n_rows, n_missing, pct)``, one row per column.  One scan."""
    fields = df.schema.fields
    counted = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(is_missing(f, tokens, nan)).alias(f"_{i}") for i, f in enumerate(fields)],
    )
    lines = F.array(
        *[
            F.struct(F.lit(f.name).alias("column"), F.col(f"_{i}").alias("n_missing"))
            for i, f in enumerate(fields)
        ]
    )
    return counted.select("n_rows", F.inline(lines)).select(
        "column",
        "n_rows",
        "n_missing",
        F.try_divide(F.col("n_missing") * 100.0, F.col("n_rows")).alias("pct"),
    )


def _floating(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType))


def _modes(df: DataFrame, columns: Sequence[str], include_null: bool) -> DataFrame:
    """One row; per column a struct of the negative count and the best value.

    Values are counted first and only the best one of each column is kept, so
    neither step gathers a column in one task.  NaN is missing, as NULL is.
    """
    maps = [c for c in columns if isinstance(df.schema[c].dataType, T.MapType)]
    if maps:
        raise ValueError(f"a map has no mode: {', '.join(maps)}")
    homes = value_homes(df, columns)
    if include_null:
        df = df.withColumns(
            {c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in columns if _floating(df, c)}
        )
    best = []
    for i, c in enumerate(columns):
        value = F.col(homes[c][0])
        lacking = is_missing(T.StructField(homes[c][0], df.schema[c].dataType), tokens=(), nan=_floating(df, c))
        mine = F.col(COLUMN) == c
        if not include_null:
            mine = mine & ~lacking
        typed = value.cast(df.schema[c].dataType).alias("v")
        best.append(
            F.min(F.when(mine, F.struct((-F.col(COUNT)).alias("k"), typed))).alias(f"_{i}")
        )
    return count_values(df, columns).agg(*best)


def mode_row(df: DataFrame, columns: Sequence[str], include_null: bool = False) -> DataFrame:
    """One row with the mode of each column, in the column's own type.

    Ties go to the smallest value.  NULL, and NaN in a floating column, are no
    candidates unless ``include_null`` is set; with it, both count as NULL, and
    NULL wins a tie.
    """
    best = _modes(df, columns, include_null)
    return best.select(*[F.col(f"_{i}.v").alias(c) for i, c in enumerate(columns)])


def column_modes(
    df: DataFrame, columns: Sequence[str], include_null: bool = False, cells: int | None = None
) -> DataFrame:
    """``(column, value, n)`` with the mode of each column as text.

    With ``cells`` the modes are found by :func:`narrowed`, which moves few rows
    where a column of very many values has some that stand out.
    """
    if cells is not None:
        if include_null:
            raise ValueError("NULL is no candidate in cells")
        df = narrowed(df, columns, cells)
    lines = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"_{i}.v").cast("string").alias("value"),
                (-F.col(f"_{i}.k")).alias("n"),
            )
            for i, c in enumerate(columns)
        ]
    )
    return _modes(df, columns, include_null).select(F.inline(lines))


def _cell_counts(df: DataFrame, columns: Sequence[str], cells: int) -> tuple[DataFrame, dict[str, dict[int, int]]]:
    """``df`` with the cell of each column's value, NULL for a missing one, and the rows per cell."""
    placed = {}
    for i, c in enumerate(columns):
        value = F.col(f"`{c}`")
        # Zero has one cell whatever its sign.
        whole = value + F.lit(0.0).cast(df.schema[c].dataType) if _floating(df, c) else value
        lacking = is_missing(df.schema[c], tokens=(), nan=_floating(df, c))
        placed[f"_cell{i}"] = F.when(~lacking, F.pmod(F.xxhash64(whole), F.lit(cells)))
    marked = df.select(*[F.col(f"`{c}`") for c in columns]).withColumns(placed)
    counts = marked.select(*placed).unpivot([], list(placed), "column", "cell").groupBy("column", "cell").agg(F.count(F.lit(1)).alias("n"))
    found: dict[str, dict[int, int]] = {c: {} for c in columns}
    for name, cell, n in counts.where(F.col("cell").isNotNull()).collect():
        found[columns[int(name.removeprefix("_cell"))]][cell] = n
    return marked, found


def _within(marked: DataFrame, columns: Sequence[str], chosen: dict[str, list[int]]) -> DataFrame:
    """The columns with only the values in the chosen cells; a row with none of them goes."""
    kept = [F.when(F.col(f"_cell{i}").isin(chosen[c]), F.col(f"`{c}`")).alias(c) for i, c in enumerate(columns)]
    return marked.select(*kept).where(reduce(or_, [F.col(f"`{c}`").isNotNull() for c in columns]))


def narrowed(df: DataFrame, columns: Sequence[str], cells: int = 4096, first: int = 4) -> DataFrame:
    """The columns, NULL where the value can be no mode.

    A first run counts the rows per cell of the values' hashes, at most ``cells``
    a column and task.  The ``first`` fullest cells of each column are then
    counted value by value: the best count there is a bound, and only cells with
    as many rows as that can hold a mode, or one that ties with it.  Where a value
    stands out those are few, and all other values never move; in a column of
    unique values they are all of them, and nothing is lost but the first runs.
    """
    marked, counts = _cell_counts(df, columns, cells)
    chosen = {c: sorted(own, key=lambda k: (-own[k], k))[:first] for c, own in counts.items()}
    best = _modes(_within(marked, columns, chosen), columns, include_null=False)
    found = best.select(*[(-F.col(f"_{i}.k")).alias(f"n{i}") for i in range(len(columns))]).head()
    open_ = {c: [k for k, n in counts[c].items() if found[i] is not None and n >= found[i]] for i, c in enumerate(columns)}
    return _within(marked, columns, open_)


def impute_modes(
    df: DataFrame,
    columns: Sequence[str],
    include_null: bool = False,
    modes: DataFrame | None = None,
) -> DataFrame:
    """Fill NULL, and NaN in floating columns, with the column's mode.

    The modes of all columns are counted together and enter as a one-row scalar
    subquery, named once and read by each column: no join, no round trip.  Pass ``modes`` (a settled
    :func:`mode_row`) when the result feeds several actions, so that they are
    not counted anew for each.  A column without any value stays NULL.
    """
    row = mode_row(df, columns, include_null) if modes is None else modes
    found = row.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in columns])).scalar()
    spread = df.withColumn("_modes", found)

    def filled(c: str):
        value = F.col(f"`{c}`")
        whole = ~is_missing(df.schema[c], tokens=(), nan=_floating(df, c))
        return F.when(whole, value).otherwise(F.col("_modes").getField(c)).alias(c)

    return spread.select(*[filled(c) if c in columns else F.col(f"`{c}`") for c in df.columns])


def settled_modes(df: DataFrame, columns: Sequence[str], include_null: bool = False) -> DataFrame:
    """:func:`mode_row` computed once, for use by several actions."""
    return settle(mode_row(df, columns, include_null))


def drop_missing(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """Drop rows with NULL (or, in a floating column, NaN) in any of the columns."""
    return df.where(is_complete([df.schema[c] for c in subset]))


def rows_before_after(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """``(n_before, n_after)`` of :func:`drop_missing`, from one scan."""
    whole = is_complete([df.schema[c] for c in subset])
    return df.agg(
        F.count(F.lit(1)).alias("n_before"), F.count_if(whole).alias("n_after")
    )


def sparse_columns(
    df: DataFrame,
    max_pct: float,
    tokens: Sequence[str] = MISSING_TOKENS,
    nan: bool = True,
) -> list[str]:
    """Names of the columns missing in more than ``max_pct`` percent of rows.

    Runs one job; only one number per column comes to the driver.
    """
    profile = missing_profile(df, tokens, nan).where(F.col("pct") > max_pct)
    found = {row["column"] for row in profile.select("column").collect()}
    return [c for c in df.columns if c in found]


def drop_sparse(
    df: DataFrame,
    max_pct: float,
    tokens: Sequence[str] = MISSING_TOKENS,
    nan: bool = True,
) -> DataFrame:
    """Drop the columns named by :func:`sparse_columns`."""
    return df.drop(*sparse_columns(df, max_pct, tokens, nan))
