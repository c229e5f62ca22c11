"""Long and wide forms, plausible values, standard scores, ordering."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenfold.functions.nulls import ratio


def widen(df: DataFrame, key: str, name: str, value: str, values: Mapping[str, str]) -> DataFrame:
    """Long to wide with explicit ``{name value: column}``; a doubled cell is an error."""
    counted = df.groupBy(key, name).agg(F.count(F.lit(1)).alias("__n"), F.first(value).alias("__v"))
    cell = F.when(F.col("__n") > 1, F.raise_error(F.lit("more than one value in a cell"))).otherwise(F.col("__v"))
    wide = counted.groupBy(key).pivot(name, list(values)).agg(F.first(cell))
    return wide.select(key, *[F.col(f"`{old}`").alias(new) for old, new in values.items()])


def lengthen(
    df: DataFrame, columns: Sequence[str], ids: Sequence[str] = (), name: str = "name", value: str = "value"
) -> DataFrame:
    """Wide to long; rows with a missing value are kept."""
    return df.unpivot(list(ids), list(columns), name, value)


def pv_rows(
    df: DataFrame, ids: Sequence[str], families: Mapping[str, str], count: int = 10, suffix: str = ""
) -> DataFrame:
    """One row per respondent and plausible value: ``{out: prefix}`` families side by side."""
    draws = F.array(
        *[
            F.struct(F.lit(i).alias("pv"), *[F.col(f"{p}{i}{suffix}").alias(out) for out, p in families.items()])
            for i in range(1, count + 1)
        ]
    )
    return df.select(*ids, F.explode(draws).alias("draw")).select(*ids, "draw.*")


def year_by_round(label: Column, years: Mapping[str, str]) -> Column:
    """The value of the year column that belongs to a collection round."""
    out = None
    for text, column in years.items():
        hit = F.when(label == text, F.col(column)) if out is None else out.when(label == text, F.col(column))
        out = hit
    return out


def nearest_year(label: Column, years: Mapping[str, int], columns: Mapping[int, str]) -> dict[str, Column]:
    """``value`` and ``year`` of the present year column closest to a collection round's year.

    ``columns`` maps years to their columns.  Of two years equally close the earlier
    is taken; without any present year, or with an unknown round, both are missing.
    Each round becomes one ``coalesce`` over its columns, so no row is moved.
    """
    value, year = F.lit(None), F.lit(None).cast("int")
    for text, target in years.items():
        order = sorted(columns, key=lambda y: (abs(y - target), y))
        value = F.when(label == text, F.coalesce(*[F.col(columns[y]) for y in order])).otherwise(value)
        chosen = F.coalesce(*[F.when(F.col(columns[y]).isNotNull(), F.lit(y)) for y in order])
        year = F.when(label == text, chosen).otherwise(year)
    return {"value": value, "year": year}


def z_scores(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Add ``{out: source}`` standard scores over all rows, ignoring missing values.

    Means and deviations of all columns come from one aggregate whose single
    row goes into the plan as constants; no row is moved.
    """
    stats = df.agg(
        *[F.avg(src).alias(f"m_{out}") for out, src in columns.items()],
        *[F.stddev_samp(src).alias(f"s_{out}") for out, src in columns.items()],
    ).first()

    def score(out: str, src: str) -> Column:
        mean, sd = stats[f"m_{out}"], stats[f"s_{out}"]
        return ratio(F.col(src) - F.lit(mean), F.lit(sd)) if mean is not None else F.lit(None).cast("double")

    return df.withColumns({out: score(out, src) for out, src in columns.items()})


def order_within(df: DataFrame, facet: str, value: str, key: str, out: str = "position") -> DataFrame:
    """Position of each row within its facet, by value."""
    w = Window.partitionBy(facet).orderBy(F.col(value).asc_nulls_last(), F.col(key))
    return df.withColumn(out, F.row_number().over(w).cast("bigint"))
