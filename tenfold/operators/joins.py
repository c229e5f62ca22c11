"""Joins in which missing keys match each other, and size-checked broadcasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 10_000


def pin_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Evaluate a table that should be small, once.

    A table of at most ``max_rows`` rows comes back as a local relation whose
    size Spark knows; a larger one comes back as it was.
    """
    table = df.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows:
        return df, False
    return df.sparkSession.createDataFrame(table, df.schema), True


def lookup_join(
    df: DataFrame,
    dim: DataFrame,
    left_key: str,
    right_key: str,
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
    unique: bool = False,
) -> DataFrame:
    """Left, semi or anti join to a lookup; NULL keys match, the right key is dropped.

    The lookup is broadcast only after its row count was checked; a larger
    lookup goes through a shuffled join, where adaptive execution splits hot
    keys.  ``unique`` makes duplicate lookup keys an error.
    """
    dim, small = pin_small(dim, max_rows)
    if unique:
        doubled = dim.groupBy(right_key).count().where("count > 1").limit(1).collect()
        if doubled:
            raise ValueError(f"lookup key {doubled[0][0]!r} is not unique")
    key = "__lookup_key"
    right = dim.withColumnRenamed(right_key, key)
    if small:
        right = F.broadcast(right)
    out = df.join(right, df[left_key].eqNullSafe(right[key]), how)
    return out if how in ("left_semi", "left_anti") else out.drop(key)


def keep_listed(df: DataFrame, column: str, table: DataFrame, table_column: str) -> DataFrame:
    """Rows whose value is among the values of a table column."""
    return lookup_join(df, table.select(table_column).distinct(), column, table_column, how="left_semi")


def drop_listed(df: DataFrame, column: str, table: DataFrame, table_column: str) -> DataFrame:
    """Rows whose value is not among the values of a table column; missing values stay
    unless the table lists a missing value itself."""
    return lookup_join(df, table.select(table_column).distinct(), column, table_column, how="left_anti")


def bind_columns(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Put two result frames side by side by their keys; missing keys match each other."""
    names = {k: f"__right_{k}" for k in keys}
    renamed = right.withColumnsRenamed(names)
    same = [left[k].eqNullSafe(renamed[n]) for k, n in names.items()]
    return left.join(renamed, same, "inner").drop(*names.values())
