"""Selecting, renaming and deriving columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select_as(df: DataFrame, columns: Mapping[str, str] | None = None, **renamed: str) -> DataFrame:
    """``select_as(df, new="old", ...)``."""
    wanted = {**(columns or {}), **renamed}
    return df.select(*[F.col(old).alias(new) for new, old in wanted.items()])


def column_range(df: DataFrame | Sequence[str], first: str, last: str) -> list[str]:
    """Names from ``first`` to ``last`` in column order, both included."""
    names = df.columns if isinstance(df, DataFrame) else list(df)
    lower = [n.lower() for n in names]
    a, b = lower.index(first.lower()), lower.index(last.lower())
    return names[a : b + 1] if a <= b else names[b : a + 1][::-1]


def columns_at(df: DataFrame, positions: Sequence[int]) -> list[str]:
    """Names at one-based positions."""
    return [df.columns[p - 1] for p in positions]


def names_in(table: DataFrame, column: str) -> list[str]:
    """The column names that a lookup table holds; a plan has to name them all, so they are few."""
    return [r[0] for r in table.select(column).where(F.col(column).isNotNull()).collect()]


def select_all_of(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Select by a name list; a missing name is an error."""
    have = {c.lower() for c in df.columns}
    missing = [n for n in names if n.lower() not in have]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    return df.select(*dict.fromkeys(names))


def across(df: DataFrame, prefix: str, fn: Callable[[Column], Column], suffix: str = "s") -> DataFrame:
    """Apply ``fn`` to the columns that start with ``prefix`` now; results are ``{name}_{suffix}``."""
    hit = [c for c in df.columns if c.lower().startswith(prefix.lower())]
    return df.withColumns({f"{c}_{suffix}": fn(F.col(c)) for c in hit})


def rename_all(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns])


def sibling_means(df: DataFrame, left: str, right: str, out: str, count: int = 10) -> DataFrame:
    """Mean of two sibling columns for each index; NULL if either is."""
    return df.withColumns(
        {f"{out}{i}": (F.col(f"{left}{i}") + F.col(f"{right}{i}")) / 2 for i in range(1, count + 1)}
    )


def row_slice(df: DataFrame, keys: Sequence[str], first: int, last: int) -> DataFrame:
    """Rows ``first`` to ``last`` (one-based, included) in key order, for inspection."""
    return df.orderBy(*[F.col(k).asc_nulls_last() for k in keys]).offset(first - 1).limit(last - first + 1)


def structure(df: DataFrame) -> DataFrame:
    """Column names and types as a frame."""
    rows = [(i + 1, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string")
