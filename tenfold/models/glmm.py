"""Logistic mixed models by penalised iteratively reweighted least squares.

Fixed effects and modes come from the penalised weighted least squares fit and
only the covariance factor is optimised on the Laplace deviance.  One pass over
the rows returns, per model, draw and group, the weighted Gram matrix, the
score, the deviance and one leverage vector.  From these the driver improves
fixed effects, modes and covariance factor of every running fit at once: it
minimises the deviance of the working linear mixed model plus a linear term
that makes its gradient equal to that of the true Laplace deviance, so the
fixed point is the exact optimum.  All models and draws advance in step, so the
number of passes is that of the slowest fit, not the sum over fits.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenfold.models import glmm_blocks, glmm_groups, lmm
from tenfold.models.fitting import RESULT_SCHEMA, Results, _row, fit_rows, result_frame, split_results
from tenfold.models.moments import centres, design_rows, from_centred
from tenfold.models.runs import RunTable, State, by_nesting, nearest
from tenfold.models.spec import PV, Design, ModelSpec
from tenfold.operators.joins import lookup_join
from tenfold.session import batches_of, local_table, scratch_path, ship_package

#: Groups whose modes the driver holds; with more, no state per group leaves the tasks (:mod:`glmm_groups`).
MAX_GROUPS = 20_000
SUMS_PER_PASS = 40_000_000  # doubles formed per task and pass; more fits go in further waves
MAX_PASSES = 60
ROW_GROUP = 16 << 20  # bytes of a group of rows in the packed table
BATCH = 8 << 20  # bytes of packed rows that a Python worker gets at once


# ------------------------------------------------------------ rows on Spark


def coded_rows(df: DataFrame, design: Design, shift: dict[str, float]) -> tuple[DataFrame, list[str], np.ndarray]:
    """Complete cases by group and draw, packed for the passes and written to the shared folder.

    Returns the table (group index, draw, rows, packed rows), see :mod:`glmm_blocks`,
    the group labels and their group-level values (NaN where missing).
    """
    spark = df.sparkSession
    rows = design_rows(df, design)
    per_group = rows.groupBy(F.col(design.group).cast("string").alias("grp")).agg(
        *[F.min(c).cast("double").alias(f"lo{j}") for j, c in enumerate(design.group_level)],
        *[F.max(c).cast("double").alias(f"hi{j}") for j, c in enumerate(design.group_level)],
    )
    found = sorted(per_group.collect(), key=lambda r: r["grp"])  # at most MAX_GROUPS, see fit_logistic
    for j, c in enumerate(design.group_level):
        if any(r[f"lo{j}"] != r[f"hi{j}"] for r in found):
            raise ValueError(f"{c} varies within a group")
    groups = [r["grp"] for r in found]
    level = np.array(
        [[np.nan if r[f"lo{j}"] is None else r[f"lo{j}"] for j in range(len(design.group_level))] for r in found], dtype=float
    ).reshape(len(groups), len(design.group_level))
    level = level - np.array([shift[c] for c in design.group_level])
    index = local_table(spark, list(zip(groups, range(len(groups)))), "__key string, __g int")
    joined = lookup_join(rows.withColumn("__grp", F.col(design.group).cast("string")), index, "__grp", "__key", how="inner", max_rows=max(MAX_GROUPS, len(groups)))

    def code(c, levels):
        out = F.lit(0)
        for i, lv in enumerate(levels[1:], start=1):
            out = F.when(F.col(c) == lv, F.lit(i)).otherwise(out)
        return out.cast("int")

    table = joined.select(
        F.col("__g").alias("g"),
        F.col(design.response).cast("double").alias("y"),
        *[code(c, lv).alias(f"k{j}") for j, (c, lv) in enumerate(design.categories.items())],
        *[(F.col(c).cast("double") - F.lit(shift[c])).alias(f"x{j}") for j, c in enumerate([*design.discrete, *design.continuous])],
        *[(F.col(c).cast("double") - F.lit(shift[PV])).alias(f"p{i}") for i, c in enumerate(design.pv)],
    )
    # Few groups per task keep the partial sums of every later pass few, equal design
    # rows lie together; the last key lets a hot group spread over many tasks.
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    alike = ["g", *[c for c in table.columns if c[0] in "kx"]]
    table = table.repartitionByRange(parts, *alike, *(["p0"] if design.pv else [])).sortWithinPartitions(*alike)
    path = scratch_path(spark, "coded")

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            base, y, gcol = _matrix(pdf, design), pdf["y"].to_numpy(), pdf["g"].to_numpy()
            starts = np.flatnonzero(np.r_[True, gcol[1:] != gcol[:-1]])
            out = []
            for pv in range(1, max(1, len(design.pv)) + 1):
                score = pdf[f"p{pv - 1}"].to_numpy() if design.pv else np.zeros(len(pdf))
                ok = ~np.isnan(score)
                for a, z in zip(starts, np.r_[starts[1:], len(gcol)]):
                    here = ok[a:z]
                    if here.any():
                        block = glmm_blocks.block(base[a:z][here], y[a:z][here], score[a:z][here])
                        out.append((int(gcol[a]), pv, int(here.sum()), block.pack()))
            yield pd.DataFrame(out, columns=["g", "pv", "n", "block"])

    # Rows of the table are long: few go into a group of the file.
    table.mapInPandas(packed, "g int, pv int, n long, block binary").write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.parquet(path), groups, level


def _matrix(pdf: pd.DataFrame, design: Design) -> np.ndarray:
    """Intercept, dummies and numbers of a batch, in the order of ``design.row_columns()``."""
    out = [np.ones(len(pdf))]
    for j, levels in enumerate(design.categories.values()):
        held = pdf[f"k{j}"].to_numpy()
        out += [(held == i).astype(float) for i in range(1, len(levels))]
    out += [pdf[f"x{j}"].to_numpy() for j in range(len(design.discrete) + len(design.continuous))]
    return np.stack(out, 1)


def pass_sums(table: DataFrame, design: Design, requests: dict):
    """Per fit and group: weighted Gram (upper triangle), score, leverage vector, deviance.

    ``requests`` maps a draw to ``(fit ids, coefficients (F, J, k), leverage weights (F, J, pairs))``.
    Each task forms partial sums per group.  The table is range-partitioned by
    group, so a fit has about one partial row per group and task.
    """
    columns = len(design.row_columns())
    held = table.sparkSession.sparkContext.broadcast(requests)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = held.value
        sums: dict[int, dict[int, np.ndarray]] = {}

        def drain():
            ids, gs, blocks = [], [], []
            for g, by_pv in sums.items():
                for pv, block in by_pv.items():
                    ids += list(asked[pv][0])
                    gs += [g] * len(asked[pv][0])
                    blocks += [row.tobytes() for row in block]
            sums.clear()
            return pd.DataFrame({"fit": np.array(ids, dtype=np.int32), "g": np.array(gs, dtype=np.int32), "block": blocks})

        for pdf in batches:
            for g, pv, packed in zip(pdf["g"], pdf["pv"], pdf["block"]):
                _, coef, lever = asked[pv]
                block = glmm_blocks.block_sums(glmm_blocks.Block.unpack(packed, columns), coef[:, g], lever[:, g])
                here = sums.setdefault(g, {})
                here[pv] = here[pv] + block if pv in here else block
            if sum(b.size for d in sums.values() for b in d.values()) > 20_000_000:
                yield drain()
        yield drain()

    wanted = table.where(F.col("pv").isin(list(requests))).select("g", "pv", "block")
    return wanted.mapInPandas(partial, "fit int, g int, block binary"), held


def advance(table: DataFrame, design: Design, running: dict[int, LogisticFit]) -> dict[int, LogisticFit]:
    """One pass over the rows and one step of every running fit.

    The partial sums of a fit meet its state in a task of their own, which adds
    them; only the new states, a few numbers per group, reach the driver.
    """
    requests = {}
    for pv in sorted({f.pv for f in running.values()}):
        mine = [f for f in running.values() if f.pv == pv]
        asked = [f.request() for f in mine]
        requests[pv] = ([f.id for f in mine], np.stack([c for c, _ in asked]), np.stack([v for _, v in asked]))
    sums, held = pass_sums(table, design, requests)
    states = table.sparkSession.sparkContext.broadcast({i: pickle.dumps(f) for i, f in running.items()})

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        i = int(pdf["fit"].iloc[0])
        f = pickle.loads(states.value[i])
        f.update(pdf)
        return pd.DataFrame({"fit": [i], "state": [pickle.dumps(f)]})

    tasks = min(len(running), 4 * table.sparkSession.sparkContext.defaultParallelism)
    with batches_of(table.sparkSession, BATCH):
        moved = sums.repartition(tasks, "fit").groupBy("fit").applyInPandas(step, "fit int, state binary").collect()
    held.unpersist()
    states.unpersist()
    return {r["fit"]: pickle.loads(r["state"]) for r in moved}


# -------------------------------------------------------- one fit, one step


class LogisticFit:
    """State of one model and draw between passes."""

    def __init__(self, fit_id: int, spec: ModelSpec, pv: int, design: Design, level: np.ndarray, shift: dict[str, float]):
        self.shift = shift
        self.id, self.spec, self.pv, self.design = fit_id, spec, pv, design
        self.base = [*design.row_columns(), PV]
        self.names = [*self.base, *design.group_level]
        where = [design.group_level.index(c) for c in spec.group_level(design)]
        self.live = ~np.isnan(level[:, where]).any(axis=1)
        self.level = np.nan_to_num(level)
        self.xcols, self.zcols = spec.fixed_columns(design), spec.random_columns(design)
        self.xi = [self.names.index(c) for c in self.xcols]
        self.zi = [self.names.index(c) for c in self.zcols]
        self.q = len(self.zi)
        self.tri = np.tril_indices(self.q)
        self.theta = np.eye(self.q)[self.tri]
        self.beta = np.zeros(len(self.xi))
        self.u = np.zeros((len(level), self.q))
        self.m_inv = np.tile(np.eye(self.q), (len(level), 1, 1))
        self.passes, self.done, self.converged = 0, False, False
        self.deviance = math.inf
        self.kept = False
        self.bend = np.zeros((len(self.theta), len(self.theta)))  # secant estimate of the slope's own change
        self.memory: dict = {}
        self.last: tuple[np.ndarray, np.ndarray] | None = None
        k = len(self.base)
        self.pairs = list(combinations_with_replacement(range(k), 2))

    def begin(self, state: State | None) -> None:
        """Start from a smaller model's end."""
        if state is not None:
            self.theta = state.factor(self.zcols)
            self.beta = np.array([state.beta.get(c, 0.0) for c in self.xcols])

    def request(self) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients on the base columns and leverage weights on their pairs, per group."""
        k, j = len(self.base), len(self.level)
        lam = lmm.lower(self.theta, self.q)
        coef = np.zeros((j, len(self.names)))
        coef[:, self.xi] += self.beta
        coef[:, self.zi] += self.u @ lam.T
        out = coef[:, :k].copy()
        out[:, 0] += (coef[:, k:] * self.level).sum(1)
        m = lam @ self.m_inv @ lam.T
        full = np.zeros((j, k, k))
        full[np.ix_(range(j), self.zi, self.zi)] = m
        lever = np.stack([full[:, a, b] * (1.0 if a == b else 2.0) for a, b in self.pairs], 1)
        return out, lever

    def _unpack(self, frame: pd.DataFrame):
        """Sums per group on all columns; group-level columns scale the intercept's."""
        k, npair = len(self.base), len(self.pairs)
        raw = np.zeros((len(self.level), npair + 2 * k + 1))
        parts = np.stack([np.frombuffer(x) for x in frame["block"]])
        np.add.at(raw, frame["g"].to_numpy(), parts)
        raw[~self.live] = 0.0
        seen = np.zeros(len(self.level), dtype=bool)
        seen[frame["g"].to_numpy()] = True
        seen &= self.live
        gram = np.zeros((len(self.level), k, k))
        for i, (a, b) in enumerate(self.pairs):
            gram[:, a, b] = gram[:, b, a] = raw[:, i]
        source = [*range(k), *[0] * self.level.shape[1]]
        factor = np.concatenate([np.ones((len(self.level), k)), self.level], 1)
        gram = gram[:, source][:, :, source] * factor[:, :, None] * factor[:, None, :]
        score = raw[:, npair : npair + k][:, source] * factor
        lever = raw[:, npair + k : npair + 2 * k][:, source] * factor
        return seen, gram, score, lever, float(raw[:, -1].sum())

    def update(self, frame: pd.DataFrame) -> None:
        self.passes += 1
        seen, gram, score, lever, dev = self._unpack(frame)
        self.seen = seen
        g, r, lv = gram[seen], score[seen], lever[seen]
        if not self.kept:  # columns that depend on others are left out, once
            total = g.sum(0)
            keep = lmm.independent_columns(total[np.ix_(self.xi, self.xi)])
            self.xi, self.xcols = [self.xi[i] for i in keep], [self.xcols[i] for i in keep]
            self.beta, self.kept = self.beta[keep], True
        lam, u = lmm.lower(self.theta, self.q), self.u[seen]
        coef = np.zeros((len(g), len(self.names)))
        coef[:, self.xi] += self.beta
        coef[:, self.zi] += u @ lam.T
        rhs = np.einsum("jab,jb->ja", g, coef) + r
        a, b = g[:, self.zi][:, :, self.zi], g[:, self.zi][:, :, self.xi]
        xx = g.sum(0)[np.ix_(self.xi, self.xi)]
        eta2 = float(np.einsum("ja,jab,jb->", coef, g, coef) + 2 * (coef * r).sum())
        blocks = lmm.Blocks(a, b, rhs[:, self.zi], xx, rhs[:, self.xi].sum(0), eta2, 1.0)

        at = lmm.evaluate(blocks, lam, sigma=1.0)
        self.h, self.m_now = at.h, at.m_inv
        deviance = dev + float((u * u).sum()) + at.logdet
        slope = self._weight_term(blocks, lam, u, r, lv, at) if self.passes > 1 else np.zeros(len(self.theta))
        if self.last is not None and self.passes > 3:
            d = self.theta - self.last[0]
            miss = slope - self.last[1] - self.bend @ d
            if abs(miss @ d) > 1e-8 * np.linalg.norm(miss) * np.linalg.norm(d) and np.linalg.norm(d) > 1e-9:
                self.bend = self.bend + np.outer(miss, miss) / (miss @ d)
        self.last = (self.theta, slope)
        base_r2, bend = at.r2, self.bend

        def working(theta):
            # Column signs are free, so the added terms see the folded factor.
            raw = lmm.lower(theta, self.q)
            sign = np.broadcast_to(np.where(np.diag(raw) * np.diag(lam) < 0, -1.0, 1.0), raw.shape)[self.tri]
            d = sign * theta - self.theta
            s = lmm.evaluate(blocks, raw, sigma=1.0)
            return s.logdet + s.r2 - base_r2 + slope @ d + 0.5 * d @ bend @ d, s.gradient + sign * (slope + bend @ d)

        theta, value, _, _, _ = lmm.minimise(working, self.theta, gtol=1e-7, steps=100, memory=self.memory)
        if not np.isfinite(value) or value > working(self.theta)[0]:
            self.bend = np.zeros_like(self.bend)
            theta = self.theta.copy()
        flip = np.broadcast_to(np.where(np.diag(lmm.lower(theta, self.q)) * np.diag(lam) < 0, -1.0, 1.0), lam.shape)[self.tri]
        theta = theta * flip
        jump = np.abs(theta - self.theta).max(initial=0.0)
        limit = 0.7 if self.passes < 4 else 0.4
        if jump > limit:
            theta = self.theta + (theta - self.theta) * limit / jump
        s = lmm.evaluate(blocks, lmm.lower(theta, self.q), sigma=1.0)
        new_u = np.zeros_like(self.u)
        new_u[seen] = s.u
        new_b, old_b = new_u @ lmm.lower(theta, self.q).T, self.u @ lam.T
        moved = max(np.abs(s.beta - self.beta).max(), np.abs(new_b - old_b).max(initial=0.0))
        near = abs(deviance - self.deviance) < 1e-7 * max(1.0, abs(deviance))
        # At a boundary the factor may drift where the deviance is flat; settled deviance and effects decide then.
        if self.passes > 2 and near and moved < 1e-5 and (jump < 1e-5 or self.passes > 25):
            self.done = self.converged = True
            self.deviance, self.state_u, self.lam = deviance, u, lmm.fold(lam)
            self.lam_raw = lam
            return
        self.deviance = deviance
        self.theta, self.beta, self.u = theta, s.beta, new_u
        self.m_inv[seen] = s.m_inv
        if self.passes >= MAX_PASSES:
            self.done = True
            self.state_u, self.lam, self.lam_raw = u, lmm.fold(lam), lam

    def _weight_term(self, blocks, lam, u, r, lever, at) -> np.ndarray:
        """Gradient of the log-determinant through the weights, which the working model holds fixed."""
        h_inv = np.linalg.inv(at.h)
        lb = np.einsum("qr,jqp->jrp", lam, blocks.b)
        rz, lz, lx = r[:, self.zi], lever[:, self.zi], lever[:, self.xi].sum(0)
        out = np.zeros(len(self.theta))
        for i, (row, col) in enumerate(zip(*self.tri)):
            eu = np.zeros_like(u)
            eu[:, row] = u[:, col]
            f = -np.einsum("jqp,jq->p", blocks.b, eu)
            e = -np.einsum("jqr,jr->jq", blocks.a, eu) @ lam
            e[:, col] += rz[:, row]
            me = np.einsum("jqr,jr->jq", at.m_inv, e)
            d_beta = h_inv @ (f - np.einsum("jqp,jq->p", lb, me))
            d_u = me - np.einsum("jqr,jr->jq", at.m_inv, lb @ d_beta)
            out[i] = lx @ d_beta + (lz * (d_u @ lam.T + eu)).sum()
        return out

    def rows(self, groups: list[str], n: float, modes: bool) -> list[tuple]:
        name, pv = self.spec.name, self.pv
        back, turn = from_centred(self.xcols, self.shift), from_centred(self.zcols, self.shift)
        se = np.sqrt(np.maximum(np.diag(back @ np.linalg.inv(self.h) @ back.T), 0))
        out = [_row(name, pv, "fixed", term=t, value=b, spread=s) for t, b, s in zip(self.xcols, back @ self.beta, se)]
        for grp, a, c, v, s in lmm.variance_rows(turn @ self.lam, self.zcols, self.design.group, 1.0, residual=False):
            out.append(_row(name, pv, "random", grp=grp, term=a, term2=c, value=v, spread=s))
        npar = len(self.beta) + len(self.theta)
        singular = np.linalg.svd(self.lam, compute_uv=False).min() < 1e-4
        out += fit_rows(
            name, pv,
            {
                "n": n, "groups": int(self.seen.sum()), "deviance": self.deviance, "loglik": -self.deviance / 2, "npar": npar,
                "aic": self.deviance + 2 * npar, "sigma": 1.0, "iterations": self.passes, "converged": self.converged,
                "singular": singular, "left_out": len(self.spec.fixed_columns(self.design)) - len(self.xcols),
            },
        )
        if modes:
            lam = turn @ self.lam_raw
            b = self.state_u @ lam.T
            cov = lam @ self.m_now @ lam.T
            sd = np.sqrt(np.maximum(np.einsum("jqq->jq", cov), 0))
            out += [
                _row(name, pv, "mode", grp=groups[g], term=z, value=b[j, i], spread=sd[j, i])
                for j, g in enumerate(np.flatnonzero(self.seen))
                for i, z in enumerate(self.zcols)
            ]
        return out


def fit_logistic(
    df: DataFrame, design: Design, specs: list[ModelSpec], modes: bool = False, draws: list[int] | None = None, many_groups: bool | None = None,
    block_rows: int = glmm_groups.BLOCK_ROWS, run: RunTable | None = None, study: str = "",
) -> Results:
    """Logistic mixed models of every spec and draw, all advanced by the same passes.

    With a run table, fits that it has are not repeated; the others go from small
    to large random parts, each begins where the nearest smaller one ended, and
    their rows are appended as each size is done.

    With more groups than the driver should hold, the passes keep no state per
    group, see :mod:`glmm_groups`.  Both ways give the same results;
    ``many_groups`` forces one, for tests.
    """
    spark = df.sparkSession
    ship_package(spark)
    shift = centres(df, design)
    draws = draws or list(range(1, len(design.pv) + 1))
    if many_groups is None:
        names = design_rows(df, design).select(F.col(design.group).cast("string")).distinct()
        many_groups = names.limit(MAX_GROUPS + 1).count() > MAX_GROUPS
    if many_groups:
        return _fit_over_groups(df, design, specs, modes, draws, shift, block_rows, run, study)
    table, groups, level = coded_rows(df, design, shift)
    present = {(r["g"], r["pv"]): r["n"] for r in table.groupBy("g", "pv").agg(F.sum("n").alias("n")).collect()}
    path = scratch_path(spark, "fits")

    def solve(pending: list[tuple[ModelSpec, int]], known: dict) -> tuple[list[tuple], dict]:
        fits = [LogisticFit(i, s, pv, design, level, shift) for i, (s, pv) in enumerate(pending)]
        for f in fits:
            f.begin(nearest(known, f.spec, f.pv, design))
        width = len(fits[0].pairs) + 2 * len(fits[0].base) + 1
        wave = max(1, SUMS_PER_PASS // (max(1, len(groups)) * width))
        finished: dict[int, LogisticFit] = {}
        for at in range(0, len(fits), wave):
            running = {f.id: f for f in fits[at : at + wave]}
            while running:
                moved = advance(table, design, running)
                finished |= {i: f for i, f in moved.items() if f.done}
                running = {i: f for i, f in moved.items() if not f.done}
        rows, states = [], {}
        for f in (finished[i] for i in sorted(finished)):
            n = float(sum(present.get((g, f.pv), 0) for g in np.flatnonzero(f.seen)))
            states[f.spec.name, f.pv] = State.of(f.xcols, f.beta, f.zcols, f.lam_raw)
            rows += f.rows(groups, n, modes)
        return rows, states

    return _in_order(spark, design, specs, draws, run, study, path, solve)


def _in_order(spark, design, specs, draws, run, study, path, solve) -> Results:
    """All fits at once; with a run table those that are missing, by the size of their random part."""
    if run is None:
        rows, _ = solve([(s, pv) for s in specs for pv in draws], {})
        spark.createDataFrame(result_frame(rows), RESULT_SCHEMA).write.parquet(path)
        return split_results(spark.read.schema(RESULT_SCHEMA).parquet(path))
    done, known = run.finished(study), run.states(study)
    for size in by_nesting(specs, design):
        pending = [(s, pv) for s in size for pv in draws if (s.name, pv) not in done]
        if pending:
            rows, states = solve(pending, known)
            rows += [r for (name, pv), state in states.items() for r in state.rows(name, pv)]
            run.append(study, spark.createDataFrame(result_frame(rows), RESULT_SCHEMA))
            known |= states
    return run.results(study, specs)


def _fit_over_groups(df, design, specs, modes, draws, shift, block_rows, run, study) -> Results:
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "fits")
    blocks = glmm_groups.coded_blocks(df, design, shift, block_rows)
    mode_path = scratch_path(spark, "modes")
    try:

        def solve(pending, known):
            def start(spec, pv):
                state = nearest(known, spec, pv, design)
                return None if state is None else (state.factor(spec.random_columns(design)), state.beta)

            found = glmm_groups.solve_all(blocks, design, pending, start)
            for s in found if modes else ():
                glmm_groups.mode_rows(blocks, design, s, shift).write.mode("append").parquet(mode_path)
            states = {(s.spec.name, s.model.pv): State.of(s.xcols, s.point.beta, s.zcols, s.point.lam) for s in found}
            return [r for s in found for r in glmm_groups.solution_rows(s, design, shift)], states

        out = _in_order(spark, design, specs, draws, run, study, path, solve)
        if modes:
            out = split_results(out.rows.unionByName(spark.read.schema(RESULT_SCHEMA).parquet(mode_path)))
        return out
    finally:
        blocks.drop()


# --------------------------------------------------------------- null model


def null_counts(df: DataFrame, response: str, group: str) -> DataFrame:
    """Rows and successes per group: all the null model needs."""
    rows = df.where(F.col(response).isNotNull() & F.col(group).isNotNull())
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(response).cast("bigint").alias("successes"))


def fit_null(df: DataFrame, response: str, group: str, max_pairs: int = 1_000_000) -> DataFrame:
    """Intercept-only logistic mixed model; fixed effect and deviation both optimised on the Laplace deviance.

    Groups with equal counts are merged first, so what reaches the driver is
    bounded by the distinct count pairs.
    """
    pairs = null_counts(df, response, group).groupBy("n", "successes").agg(F.count(F.lit(1)).alias("times"))
    held = pairs.limit(max_pairs + 1).toPandas()
    if len(held) > max_pairs:
        raise ValueError("too many distinct group sizes")
    n, s, times = (held[c].to_numpy(float) for c in ("n", "successes", "times"))

    def deviance(v):
        sd, beta = v
        u = np.zeros(len(n))
        for _ in range(100):
            mu = 1 / (1 + np.exp(-(beta + sd * u)))
            step = (sd * (s - n * mu) - u) / (sd * sd * n * mu * (1 - mu) + 1)
            u += step
            if np.abs(step).max() < 1e-12:
                break
        eta = beta + sd * u
        w = n / (1 + np.exp(-eta)) / (1 + np.exp(eta))
        d = -2 * (s * eta - n * np.logaddexp(0, eta)) + u * u + np.log1p(sd * sd * w)
        return float((times * d).sum())

    def both(v):
        e = 1e-5
        grad = [(deviance(v + e * d) - deviance(v - e * d)) / (2 * e) for d in np.eye(2)]
        return deviance(v), np.array(grad)

    share = (times * s).sum() / (times * n).sum()
    best, dev, _, its, ok = lmm.minimise(both, np.array([1.0, math.log(share / (1 - share))]), gtol=1e-4)
    e = 1e-3
    hess = np.zeros((2, 2))
    for i in range(2):
        for j in range(2):
            di, dj = e * np.eye(2)[i], e * np.eye(2)[j]
            hess[i, j] = (
                deviance(best + di + dj) - deviance(best + di - dj) - deviance(best - di + dj) + deviance(best - di - dj)
            ) / (4 * e * e)
    se = math.sqrt(2 * np.linalg.inv(hess)[1, 1])
    row = (
        float((times * n).sum()), int(times.sum()), float(best[1]), se, float(best[0] ** 2), abs(float(best[0])), dev, -dev / 2, dev + 4, bool(ok)
    )
    return df.sparkSession.createDataFrame(
        [row],
        "n double, groups int, intercept double, se double, variance double, sd double, deviance double, loglik double, aic double, converged boolean",
    )
