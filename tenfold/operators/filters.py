"""Row filters on missingness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drop_all_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop rows where every listed column is missing."""
    return df.dropna(how="all", subset=list(columns))


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep rows where no listed column is missing."""
    return df.dropna(how="any", subset=list(columns))


def present(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull())
