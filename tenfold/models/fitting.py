"""Fits whole grids of mixed models over all plausible values."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenfold.models import lmm
from tenfold.models.moments import GRAM_SCHEMA, centres, from_centred, grams, stacked_grams
from tenfold.models.spec import Design, ModelSpec
from tenfold.session import scratch_path

#: Groups of one draw that one task solves; beyond, the sums stay distributed.
GROUPS_PER_TASK = 20_000
RESULT_SCHEMA = (
    "spec string, pv int, part string, grp string, term string, term2 string, "
    "value double, spread double, df double, npar double, loglik double, aic double, p double"
)
_COLS = [c.split()[0] for c in RESULT_SCHEMA.split(", ")]


@dataclass
class Results:
    """Tidy frames of a fitted grid, keyed by model and draw."""

    fixed: DataFrame  # spec, pv, term, est, se, df
    random: DataFrame  # spec, pv, grp, term, term2, vcov, sdcor
    fits: DataFrame  # spec, pv, n, groups, deviance, loglik, npar, aic, sigma, iterations, left_out, converged, singular
    modes: DataFrame  # spec, pv, grp, term, condval, condsd
    tests: DataFrame  # spec, pv, term, npar, loglik, aic, lrt, df, p
    rows: DataFrame  # all of these as they were written


def split_results(table: DataFrame) -> Results:
    c = F.col

    def part(name):
        return table.where(c("part") == name)

    fits = part("fit").groupBy("spec", "pv").agg(
        *[
            F.max(F.when(c("term") == m, c("value"))).alias(m)
            for m in ("n", "groups", "deviance", "loglik", "npar", "aic", "sigma", "iterations", "left_out")
        ],
        *[(F.max(F.when(c("term") == m, c("value"))) == 1).alias(m) for m in ("converged", "singular")],
    )
    return Results(
        part("fixed").select("spec", "pv", "term", c("value").alias("est"), c("spread").alias("se"), "df"),
        part("random").select("spec", "pv", "grp", "term", "term2", c("value").alias("vcov"), c("spread").alias("sdcor")),
        fits,
        part("mode").select("spec", "pv", "grp", "term", c("value").alias("condval"), c("spread").alias("condsd")),
        part("test").select("spec", "pv", "term", "npar", "loglik", "aic", c("value").alias("lrt"), "df", "p"),
        table,
    )


def _row(spec, pv, part, grp=None, term=None, term2=None, value=None, spread=None, df=None, npar=None, loglik=None, aic=None, p=None):
    def num(x):
        return None if x is None or not np.isfinite(x) else float(x)

    return (spec, pv, part, grp, term, term2, num(value), num(spread), num(df), num(npar), num(loglik), num(aic), num(p))


def result_frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLS)


def fit_rows(spec: str, pv: int, values: dict) -> list[tuple]:
    return [_row(spec, pv, "fit", term=k, value=float(v)) for k, v in values.items()]


def model_blocks(pdf: pd.DataFrame, design: Design, spec: ModelSpec):
    """Group labels, solver blocks and column names of one model and draw."""
    groups, n, full, names = stacked_grams(pdf, design, spec.group_level(design))
    xcols, zcols = spec.fixed_columns(design), spec.random_columns(design)
    xi = [names.index(c) for c in xcols]
    total = full.sum(0)
    keep = lmm.independent_columns(total[np.ix_(xi, xi)])
    xcols, xi = [xcols[i] for i in keep], [xi[i] for i in keep]
    zi = [names.index(c) for c in zcols]
    y = len(names) - 1
    blocks = lmm.Blocks(
        full[:, zi][:, :, zi], full[:, zi][:, :, xi], full[:, zi, y], total[np.ix_(xi, xi)], total[xi, y], float(total[y, y]), float(n.sum())
    )
    return groups, blocks, xcols, zcols


def _slope_positions(design: Design, spec: ModelSpec, zcols: list[str]) -> dict[str, list[int]]:
    if not spec.slopes:
        return {"(Intercept)": [0]}
    return {t: [zcols.index(c) for c in design.expand([t])] for t in spec.slopes}


def _summary_rows(design, spec, pv, f: lmm.Fit, df, xcols, zcols, n, groups) -> list[tuple]:
    name = spec.name
    rows = [_row(name, pv, "fixed", term=t, value=b, spread=s, df=d) for t, b, s, d in zip(xcols, f.beta, f.se, df)]
    for grp, a, c, v, s in lmm.variance_rows(f.lam, zcols, design.group, f.sigma2):
        rows.append(_row(name, pv, "random", grp=grp, term=a, term2=c, value=v, spread=s))
    return rows + fit_rows(
        name, pv,
        {
            "n": n, "groups": groups, "deviance": f.deviance, "loglik": -f.deviance / 2, "npar": f.npar,
            "aic": f.deviance + 2 * f.npar, "sigma": np.sqrt(f.sigma2), "iterations": f.iterations,
            "converged": f.converged, "singular": f.singular, "left_out": len(spec.fixed_columns(design)) - len(xcols),
        },
    )


def linear_rows(pdf: pd.DataFrame, design: Design, spec: ModelSpec, tests: bool, modes: bool, shift: dict[str, float]) -> list[tuple]:
    name, pv = spec.name, int(pdf["pv"].iloc[0])
    groups, blocks, xcols, zcols = model_blocks(pdf, design, spec)
    f = lmm.fit(blocks)
    back = from_centred(xcols, shift)
    df = lmm.satterthwaite(lambda lam, sigma: lmm.evaluate(blocks, lam, sigma), f, blocks.n, back)
    shown = lmm.moved(f, back, from_centred(zcols, shift), shift["y"])
    rows = _summary_rows(design, spec, pv, shown, df, xcols, zcols, blocks.n, len(groups))
    if modes:
        val, sd = lmm.conditional_modes(shown.lam, f.state, f.sigma2)
        rows += [
            _row(name, pv, "mode", grp=g, term=z, value=val[j, i], spread=sd[j, i])
            for j, g in enumerate(groups)
            for i, z in enumerate(zcols)
        ]
    if tests:
        for t, npar, ll, aic, lrt, d, p in lmm.deletions(lambda keep: lmm.fit(blocks.slopes_kept(keep)), f, _slope_positions(design, spec, zcols)):
            rows.append(_row(name, pv, "test", term=t, npar=npar, loglik=ll, aic=aic, value=lrt, df=d, p=p))
    return rows


def fit_linear(
    df: DataFrame, design: Design, specs: list[ModelSpec], tests: bool = False, modes: bool = False, many_groups: bool | None = None,
    skip: Collection[tuple[str, int]] = (),
) -> Results:
    """Linear mixed models of every spec and draw, but those (model, draw) in ``skip``: one pass for the means, one for the sums around them.

    The Gram rows (groups x draws) are written once.  While the groups of a draw
    fit a task they are dealt out by model and draw, so each fit is a task of its
    own; with more groups no task sees them all, see :func:`fit_over_groups`.
    Both give the same results; ``many_groups`` forces one way, for tests.
    """
    spark = df.sparkSession
    by_name = {s.name: s for s in specs}
    path, held = scratch_path(spark, "fits"), scratch_path(spark, "grams")
    shift = centres(df, design)
    grams(df, design, shift).write.partitionBy("pv").parquet(held)
    table = spark.read.schema(GRAM_SCHEMA).parquet(held)
    if many_groups is None:
        widest = table.groupBy("pv").count().agg(F.max("count")).first()[0] or 0
        many_groups = widest > GROUPS_PER_TASK
    if many_groups:
        for s in specs:
            for pv in range(1, len(design.pv) + 1) if design.pv else [0]:
                if (s.name, pv) in skip:
                    continue
                part = fit_over_groups(table.where(F.col("pv") == pv), design, s, pv, shift, tests, modes)
                part.write.mode("append").parquet(path)
        return split_results(spark.read.schema(RESULT_SCHEMA).parquet(path))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        return result_frame(linear_rows(pdf, design, by_name[pdf["spec"].iloc[0]], tests, modes, shift))

    dealt = table.withColumn("spec", F.explode(F.array(*[F.lit(s.name) for s in specs])))
    if skip:
        left_out = F.array(*[F.lit(f"{pv} {name}") for name, pv in sorted(skip)])
        dealt = dealt.where(~F.array_contains(left_out, F.concat_ws(" ", "pv", "spec")))
    fits = max(1, len(specs) * max(1, len(design.pv)) - len(skip))
    # An explicit count keeps adaptive execution from merging the small partitions into one task.
    results = dealt.repartition(fits, "spec", "pv").groupBy("spec", "pv").applyInPandas(solve, RESULT_SCHEMA)
    results.write.parquet(path)
    return split_results(spark.read.parquet(path))


def fit_over_groups(
    table: DataFrame, design: Design, spec: ModelSpec, pv: int, shift: dict[str, float], tests: bool = False, modes: bool = False
) -> DataFrame:
    """One model and draw with any number of groups.

    The written Gram rows stay distributed; each evaluation sums over groups in
    Spark and only matrices of the size of the fixed effects reach the driver.
    """
    spark = table.sparkSession
    levels, zcols = spec.group_level(design), spec.random_columns(design)

    def total(fn, size: int) -> np.ndarray:
        """Sum over groups of ``fn(full Gram stack, names)``, a flat vector of ``size``."""

        def part(batches):
            out = np.zeros(size)
            for pdf in batches:
                _, n, full, names = stacked_grams(pdf, design, levels)
                if len(full):
                    out += fn(n, full, names)
            yield pd.DataFrame({"i": np.arange(size), "v": out})

        rows = table.mapInPandas(part, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(size)
        for r in rows:
            out[r["i"]] = r["v"]
        return out

    names = [*design.columns(), "y"]
    k, y = len(names), len(names) - 1
    sums = total(lambda n, full, _: np.r_[n.sum(), len(full), full.sum(0).ravel()], 2 + k * k)
    n, groups, gram = sums[0], int(sums[1]), sums[2:].reshape(k, k)
    xi = [names.index(c) for c in spec.fixed_columns(design)]
    xi = [xi[i] for i in lmm.independent_columns(gram[np.ix_(xi, xi)])]
    xcols, zi, p = [names[i] for i in xi], [names.index(c) for c in zcols], len(xi)

    def parts(full, zi):
        return full[:, zi][:, :, zi], full[:, zi][:, :, xi], full[:, zi, y]

    def over(zi):
        """The evaluator of the model with these random columns."""
        q = len(zi)

        def evaluator(lam, sigma=None):
            def terms(_, full, __):
                logdet, xx, xy, yy = lmm.group_terms(*parts(full, zi), lam)
                return np.r_[logdet, xx.ravel(), xy, yy]

            t = total(terms, 2 + p * p + p)

            def gradient(beta):
                def sums_at(_, full, __):
                    _, _, det, fit = lmm.group_gradient(*parts(full, zi), lam, beta)
                    return np.r_[det.ravel(), fit.ravel()]

                g = total(sums_at, 2 * q * q)
                return None, None, g[: q * q].reshape(q, q), g[q * q :].reshape(q, q)

            reduced = (t[0], t[1 : 1 + p * p].reshape(p, p), t[1 + p * p : -1], t[-1])
            return lmm.assemble(n, gram[np.ix_(xi, xi)], gram[xi, y], gram[y, y], reduced, gradient, lam, sigma)

        return evaluator

    f = lmm.fit_by(over(zi), len(zi), p, n)
    back = from_centred(xcols, shift)
    df = lmm.satterthwaite(over(zi), f, n, back)
    shown = lmm.moved(f, back, from_centred(zcols, shift), shift["y"])
    rows = _summary_rows(design, spec, pv, shown, df, xcols, zcols, n, groups)
    if tests:
        smaller = lambda keep: lmm.fit_by(over([zi[i] for i in keep]), len(keep), p, n)
        for t, npar, ll, aic, lrt, d, pr in lmm.deletions(smaller, f, _slope_positions(design, spec, zcols)):
            rows.append(_row(spec.name, pv, "test", term=t, npar=npar, loglik=ll, aic=aic, value=lrt, df=d, p=pr))
    out = spark.createDataFrame(result_frame(rows), RESULT_SCHEMA)
    if not modes:
        return out

    def mode_rows(batches):
        for pdf in batches:
            labels, _, full, _ = stacked_grams(pdf, design, levels)
            if len(full):
                u, m_inv, _, _ = lmm.group_gradient(*parts(full, zi), f.lam, f.beta)
                value = u @ shown.lam.T
                sd = np.sqrt(np.maximum(np.einsum("jqq->jq", f.sigma2 * shown.lam @ m_inv @ shown.lam.T), 0))
                yield result_frame(
                    [_row(spec.name, pv, "mode", grp=g, term=z, value=value[j, i], spread=sd[j, i]) for j, g in enumerate(labels) for i, z in enumerate(zcols)]
                )

    return out.unionByName(table.mapInPandas(mode_rows, RESULT_SCHEMA))
