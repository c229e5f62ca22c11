"""Per-group cross-product sums, the one pass over rows that models need.

Rows are first compressed to one row per combination of category values (a
lossless compression for least squares: within a cell only counts, sums and
cross-products of the continuous variables matter).  The compression is a
plain map-side-combined aggregate: its output is bounded by groups times
category combinations however many rows there are, and a hot group costs
nothing extra.  All plausible values ride along in the same pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenfold.models.lmm import independent_columns
from tenfold.models.spec import INTERCEPT, PV, Design
from tenfold.operators.filters import complete_cases
from tenfold.session import ship_package


def gram_sums(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Sums of all pairwise products of ``columns`` per group, wide: ``n`` and ``a__b``."""
    sums = [
        F.sum(F.col(a) * F.col(b)).alias(f"{a}__{b}") for a, b in combinations_with_replacement(columns, 2)
    ]
    rows = complete_cases(df, list(columns))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in columns], *sums)


def design_rows(df: DataFrame, design: Design) -> DataFrame:
    """Rows complete in everything but the plausible values and group-level columns, with listed levels only."""
    needed = [design.response, *design.categories, *design.discrete, *design.continuous]
    if design.group:
        needed.append(design.group)
    rows = complete_cases(df, needed)
    for c, levels in design.categories.items():  # a value that is no level is a missing value
        rows = rows.where(F.col(c).cast("string").isin(list(levels)))
    return rows


def centres(df: DataFrame, design: Design) -> dict[str, float]:
    """Means of the response (``y``) and of the number columns, by design column; all draws share one.

    Sums of products are formed around them, so that columns which differ little
    for their size (a year and its square) keep their digits.
    """
    numbers = {c: F.avg(F.col(c).cast("double")) for c in [*design.discrete, *design.continuous, *design.group_level]}
    numbers["y"] = F.avg(F.col(design.response).cast("double"))
    draws = [F.avg(F.col(p).cast("double")) for p in design.pv]
    picked = [v.alias(f"m{i}") for i, v in enumerate([*numbers.values(), *draws])]
    row = design_rows(df, design).agg(*picked).first()
    found = [0.0 if v is None or not np.isfinite(v) else float(v) for v in row]
    out = dict(zip(numbers, found))
    if draws:
        out[PV] = float(np.mean(found[len(numbers) :]))
    return out


def centred_residuals(df: DataFrame, design: Design, shift: Mapping[str, float]) -> tuple[DataFrame, Design, np.ndarray]:
    """The continuous columns, each around its mean and less its regression on those before it.

    Columns that nearly depend on each other keep no digits in a sum of products.  The
    regressions need not be exact: what the columns are is kept in the unit triangular
    matrix returned, ``column - shift = matrix @ residuals``.  A column that depends on
    earlier ones altogether stays as it is.
    """
    names = design.continuous
    turn = np.eye(len(names))
    if len(names) < 2:
        return df, design, turn
    pairs = list(combinations_with_replacement(range(len(names)), 2))
    number = [F.col(f"`{c}`").cast("double") - F.lit(shift[c]) for c in names]
    row = design_rows(df, design).agg(*[F.covar_pop(number[a], number[b]).alias(f"v{i}") for i, (a, b) in enumerate(pairs)]).first()
    cov = np.zeros((len(names), len(names)))
    for v, (a, b) in zip(row, pairs):
        cov[a, b] = cov[b, a] = 0.0 if v is None or not np.isfinite(v) else v
    held = independent_columns(cov)
    for j in held:
        before = [i for i in held if i < j]
        if before:
            # Coefficients on the earlier columns, then on their residuals, which span the same.
            weights = np.linalg.solve(cov[np.ix_(before, before)], cov[before, j])
            turn[j, before] = weights @ turn[np.ix_(before, before)]
    renamed = [f"__residual{j}" for j in range(len(names))]
    for j, c in enumerate(renamed):
        value = number[j]
        for i in np.flatnonzero(turn[j, :j]):
            value = value - F.lit(float(turn[j, i])) * F.col(renamed[i])
        df = df.withColumn(c, value)
    return df, replace(design, continuous=tuple(renamed)), turn


def from_centred(columns: Sequence[str], shift: Mapping[str, float]) -> np.ndarray:
    """Coefficients of the columns as they are, from those of the columns around ``shift``."""
    out = np.eye(len(columns))
    if INTERCEPT in columns:
        out[list(columns).index(INTERCEPT)] -= [shift.get(c, 0.0) for c in columns]
    return out


def cells(df: DataFrame, design: Design, shift: Mapping[str, float] | None = None) -> DataFrame:
    """Counts, sums and cross-products per category cell, all draws in one pass.

    ``mask`` tells which draws are present in the rows of a cell, so sums that
    do not involve a draw are formed once and still only over its complete cases.
    """
    rows, shift = design_rows(df, design), shift or {}

    def number(column: str, name: str):
        return F.col(column).cast("double") - F.lit(shift.get(name, 0.0))

    values = {"y": number(design.response, "y")}
    values |= {f"c{j}": number(c, c) for j, c in enumerate(design.continuous)}
    mask = F.lit(0).cast("bigint")
    for i, p in enumerate(design.pv):
        mask = mask + F.when(F.col(p).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint")
    keys = [F.col(c).cast("string").alias(f"k{j}") for j, c in enumerate(design.categories)]
    keys += [number(c, c).alias(f"d{j}") for j, c in enumerate(design.discrete)]
    group = F.col(design.group).cast("string") if design.group else F.lit("all")
    picked = rows.select(
        group.alias("grp"),
        *keys,
        mask.alias("mask"),
        *[v.alias(n) for n, v in values.items()],
        *[number(p, PV).alias(f"p{i}") for i, p in enumerate(design.pv)],
        *[number(c, c).alias(f"g{j}") for j, c in enumerate(design.group_level)],
    )
    names = list(values)
    aggs = [F.count(F.lit(1)).cast("double").alias("n")]
    aggs += [F.sum(a).alias(f"s_{a}") for a in names]
    aggs += [F.sum(F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for a, b in combinations_with_replacement(names, 2)]
    for i in range(len(design.pv)):
        p = F.col(f"p{i}")
        aggs += [F.sum(p).alias(f"p{i}"), F.sum(p * p).alias(f"p{i}_p")]
        aggs += [F.sum(p * F.col(a)).alias(f"p{i}_{a}") for a in names]
    for j in range(len(design.group_level)):
        aggs += [F.min(f"g{j}").alias(f"g{j}"), F.max(f"g{j}").alias(f"g{j}_max")]
    by = ["grp", *[f"k{j}" for j in range(len(design.categories))], *[f"d{j}" for j in range(len(design.discrete))], "mask"]
    return picked.groupBy(*by).agg(*aggs)


def cell_draws(cell_frame: DataFrame, design: Design) -> DataFrame:
    """One row per cell and draw present in it."""
    names = ["y", *[f"c{j}" for j in range(len(design.continuous))]]
    shared = [c for c in cell_frame.columns if c != "mask" and not (c[0] == "p" and c[1].isdigit())]
    if not design.pv:
        return cell_frame.select(F.lit(0).alias("pv"), *shared)
    draws = [
        F.when(
            F.col("mask").bitwiseAND(F.lit(1 << i)) != 0,
            F.struct(
                F.lit(i + 1).alias("pv"),
                F.col(f"p{i}").alias("p"),
                F.col(f"p{i}_p").alias("p_p"),
                *[F.col(f"p{i}_{a}").alias(f"p_{a}") for a in names],
            ),
        )
        for i in range(len(design.pv))
    ]
    long = cell_frame.select(*shared, F.explode(F.array(*draws)).alias("draw")).where(F.col("draw").isNotNull())
    return long.select("draw.*", *shared)


def _cell_gram(pdf: pd.DataFrame, design: Design) -> np.ndarray:
    """Cross-products of all design columns and the response over the cells given.

    A design column is either constant within a cell (intercept, dummies,
    discrete) or one of the summed variables, so every product is a
    cell-level value times a stored sum.
    """
    n = pdf["n"].to_numpy()
    const = [np.ones(len(pdf))]
    for j, levels in enumerate(design.categories.values()):
        held = pdf[f"k{j}"].to_numpy()
        const += [(held == lv).astype(float) for lv in levels[1:]]
    const += [pdf[f"d{j}"].to_numpy() for j in range(len(design.discrete))]
    k = np.stack(const, 1)
    names = [f"c{j}" for j in range(len(design.continuous))] + ([PV] if design.pv else []) + ["y"]

    def first(a):
        return pdf["p"] if a == PV else pdf[f"s_{a}"]

    def second(a, b):
        if PV in (a, b):
            other = b if a == PV else a
            return pdf["p_p"] if other == PV else pdf[f"p_{other}"]
        return pdf[f"s_{a}_{b}"] if f"s_{a}_{b}" in pdf else pdf[f"s_{b}_{a}"]

    v = np.stack([first(a).to_numpy() for a in names], 1)
    kk = k.T @ (k * n[:, None])
    kv = k.T @ v
    vv = np.array([[second(a, b).sum() for b in names] for a in names])
    return np.block([[kk, kv], [kv.T, vv]])


GRAM_SCHEMA = "pv int, grp string, n double, gram array<double>, level array<double>"


def grams(df: DataFrame, design: Design, shift: Mapping[str, float] | None = None) -> DataFrame:
    """Per draw and group: the flattened Gram matrix of ``[row columns, PV, response]``.

    Group-level values come as the separate array ``level``: they multiply
    whole Gram rows later and never need to be summed over respondents.  Number
    columns and the response are taken around ``shift``.
    """
    ship_package(df.sparkSession)
    draws = cell_draws(cells(df, design, shift), design)
    levels = len(design.group_level)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        for j in range(levels):
            if pdf[f"g{j}"].min() != pdf[f"g{j}_max"].max() and pdf[f"g{j}"].notna().any():
                raise ValueError(f"{design.group_level[j]} varies within group {pdf['grp'].iloc[0]}")
        level = [float(pdf[f"g{j}"].iloc[0]) for j in range(levels)]
        g = _cell_gram(pdf, design)
        return pd.DataFrame(
            {
                "pv": [pdf["pv"].iloc[0]], "grp": [pdf["grp"].iloc[0]], "n": [pdf["n"].sum()],
                "gram": [g.ravel().tolist()], "level": [[None if np.isnan(x) else x for x in level]],
            }
        )

    return draws.groupBy("pv", "grp").applyInPandas(build, GRAM_SCHEMA)


def stacked_grams(pdf: pd.DataFrame, design: Design, needed_levels: Sequence[str]) -> tuple[list[str], np.ndarray, np.ndarray, list[str]]:
    """Gram matrices of the groups whose needed group-level values are present.

    Returns group labels, row counts, an array ``(groups, K, K)`` and the K
    column names (all design columns, then the response).
    """
    pdf = pdf.sort_values("grp")
    base = [*design.row_columns(), *([PV] if design.pv else [])]
    size = len(base) + 1
    raw = np.stack([np.asarray(g, dtype=float).reshape(size, size) for g in pdf["gram"]])
    if design.group_level:
        level = np.array([[np.nan if x is None else x for x in lv] for lv in pdf["level"]], dtype=float)
    else:
        level = np.zeros((len(pdf), 0))
    where = [design.group_level.index(c) for c in needed_levels]
    ok = ~np.isnan(level[:, where]).any(axis=1)
    raw, level, grp, n = raw[ok], np.nan_to_num(level[ok]), pdf["grp"].to_numpy()[ok], pdf["n"].to_numpy()[ok]
    # Each column is a base column times a factor per group: 1, or the group's level on the intercept.
    source = [*range(size - 1), *[base.index(INTERCEPT)] * level.shape[1], size - 1]
    factor = np.concatenate([np.ones((len(grp), size - 1)), level, np.ones((len(grp), 1))], 1)
    full = raw[:, source][:, :, source] * factor[:, :, None] * factor[:, None, :]
    return list(grp), n, full, [*base, *design.group_level, "y"]
