"""Ordinary least squares from Gram matrices: estimates, tests, intervals, nested models."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenfold.functions.tails import f_p, f_upper, t_quantile, t_two_sided
from tenfold.models.lmm import independent_columns
from tenfold.models.moments import centred_residuals, centres, from_centred, grams, stacked_grams
from tenfold.models.spec import INTERCEPT, Design, ModelSpec

OLS_SCHEMA = "spec string, pv int, term string, est double, se double, t double, p double, low double, high double, exp_est double"
OLS_FIT_SCHEMA = (
    "spec string, pv int, n double, rss double, df_model int, df_residual double, sigma double, r2 double, "
    "adj_r2 double, f double, f_p double, aic double, left_out int"
)


def _solve(pdf: pd.DataFrame, design: Design, spec: ModelSpec, shift: dict[str, float], turn: np.ndarray):
    _, n, full, names = stacked_grams(pdf, design, spec.group_level(design))
    cols = spec.fixed_columns(design)
    at = [names.index(c) for c in cols]
    total, y = full.sum(0), len(names) - 1
    back_turn = np.eye(len(names))
    own = [names.index(c) for c in design.continuous]
    back_turn[np.ix_(own, own)] = turn
    plain = back_turn @ total @ back_turn.T
    keep = independent_columns(plain[np.ix_(at, at)])
    cols, at = [cols[i] for i in keep], [at[i] for i in keep]
    used = np.flatnonzero(back_turn[at].any(0))
    if len(independent_columns(total[np.ix_(used, used)])) < len(used):
        total, back_turn, used = plain, np.eye(len(names)), np.array(at)
    # The columns are an orthonormal basis times this matrix; no product of it is formed, so close columns keep their digits.
    scale = np.sqrt(np.diag(total)[used])
    factor = np.linalg.cholesky(total[np.ix_(used, used)] / np.outer(scale, scale))
    basis, upper = np.linalg.qr(factor.T @ (scale[:, None] * back_turn[np.ix_(at, used)].T))
    along = basis.T @ np.linalg.solve(factor, total[used, y] / scale)
    beta, root = np.linalg.solve(upper, along), np.linalg.inv(upper)
    # By the triangular factor: the residual sum is what is left of y'y, not a difference of large products.
    yy, rows = total[y, y], float(n.sum())
    rss = max(0.0, float(yy - along @ along))
    back = from_centred(cols, shift)
    beta, root = back @ beta, back @ root
    beta[cols.index(INTERCEPT)] += shift["y"]
    return cols, beta, root @ root.T, rss, float(yy - total[0, y] ** 2 / rows), rows


def ols_tables(df: DataFrame, design: Design, specs: list[ModelSpec]) -> tuple[DataFrame, DataFrame]:
    """Coefficient table and fit table of each model and draw: passes for the means, for the
    regressions among several continuous columns, and for the sums around both.

    A column that depends on earlier ones is left out; ``left_out`` of the fit table counts them.
    """
    by_name = {s.name: s for s in specs}
    shift = centres(df, design)
    residuals, moved, turn = centred_residuals(df, design, shift)
    g = grams(residuals, moved, shift).withColumn("spec", F.explode(F.array(*[F.lit(s.name) for s in specs])))

    def coefficients(pdf: pd.DataFrame) -> pd.DataFrame:
        name, pv = pdf["spec"].iloc[0], int(pdf["pv"].iloc[0])
        cols, beta, inv, rss, _, n = _solve(pdf, design, by_name[name], shift, turn)
        dof = n - len(cols)
        se = np.sqrt(np.diag(inv) * rss / dof)
        q = t_quantile(0.975, dof)
        return pd.DataFrame(
            [
                (name, pv, c, b, s, b / s, t_two_sided(b / s, dof), b - q * s, b + q * s, math.exp(b) if b < 709 else math.inf)
                for c, b, s in zip(cols, beta, se)
            ],
            columns=[c.split()[0] for c in OLS_SCHEMA.split(", ")],
        )

    def fits(pdf: pd.DataFrame) -> pd.DataFrame:
        name, pv = pdf["spec"].iloc[0], int(pdf["pv"].iloc[0])
        cols, _, _, rss, tss, n = _solve(pdf, design, by_name[name], shift, turn)
        k, dof = len(cols) - 1, n - len(cols)
        f = (tss - rss) / k / (rss / dof) if k else float("nan")
        aic = n * (math.log(2 * math.pi * rss / n) + 1) + 2 * (k + 2)
        row = (
            name, pv, n, rss, k, dof, math.sqrt(rss / dof), 1 - rss / tss, 1 - rss / tss * (n - 1) / dof, f,
            f_upper(f, k, dof) if k else None, aic, len(by_name[name].fixed_columns(design)) - len(cols),
        )
        return pd.DataFrame([row], columns=[c.split()[0] for c in OLS_FIT_SCHEMA.split(", ")])

    keyed = g.groupBy("spec", "pv")
    return keyed.applyInPandas(coefficients, OLS_SCHEMA), keyed.applyInPandas(fits, OLS_FIT_SCHEMA)


def nested_f(fits: DataFrame, small: str, large: str) -> DataFrame:
    """F test of a model within a larger one fitted to the same rows."""
    a = fits.where(F.col("spec") == small).select("pv", F.col("rss").alias("rss_small"), F.col("df_residual").alias("df_small"), F.col("n").alias("n_small"))
    c = fits.where(F.col("spec") == large).select("pv", F.col("rss").alias("rss_large"), F.col("df_residual").alias("df_large"), F.col("n").alias("n_large"))
    both = a.join(c, "pv")
    same = F.when(F.col("n_small") == F.col("n_large"), F.col("rss_small") - F.col("rss_large")).otherwise(
        F.raise_error(F.lit("the models were fitted to different rows"))
    )
    df = F.col("df_small") - F.col("df_large")
    out = both.select(
        "pv", "df_small", "rss_small", "df_large", "rss_large", df.alias("df"), same.alias("sum_sq"),
        ((same / df) / (F.col("rss_large") / F.col("df_large"))).alias("f"),
    )
    return out.withColumn("p", f_p("f", F.col("df"), "df_large"))
