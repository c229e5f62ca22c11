"""Logistic mixed models over any number of groups.

Only what has the size of the fixed effects and of the covariance factor reaches
the driver.  Rows are written once, bucketed by block: a block holds whole groups,
so the task that reads it finds the groups' modes itself, by Newton steps from
zero, at the fixed effects and factor it is given.  It adds up the groups'
contributions to the deviance, its gradient and the equations of the fixed
effects, and keeps nothing: no state per group is written, moved or lost, and a
pass repeated on another executor gives the same sums.

A group of more rows than a block is spread over several.  There are at most
(rows / block) such groups; their modes are unknowns of the driver, next to the
fixed effects, and their blocks return sums per group.

Fixed effects solve the penalised likelihood at a given factor by Newton steps,
one pass each; the factor minimises the Laplace deviance by its exact gradient.
The fits of all models and draws run at once and share every pass.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenfold.models import lmm
from tenfold.models.fitting import RESULT_SCHEMA, _row, fit_rows, result_frame
from tenfold.models.moments import design_rows, from_centred
from tenfold.models.spec import PV, Design, ModelSpec
from tenfold.session import local_table, scratch_path

#: Rows of a block; a group with more is spread over several blocks.
BLOCK_ROWS = 1 << 16
MAX_PASSES = 400


# ------------------------------------------------------------ rows on Spark


@dataclass
class Blocks:
    """The bucketed table of coded rows and the groups that are spread over blocks."""

    table: DataFrame
    name: str
    hot: list[str]
    groups: int

    def drop(self) -> None:
        self.table.sparkSession.sql(f"DROP TABLE IF EXISTS {self.name}")


def code(column: str, levels: tuple[str, ...]):
    out = F.lit(0)
    for i, lv in enumerate(levels[1:], start=1):
        out = F.when(F.col(column) == lv, F.lit(i)).otherwise(out)
    return out.cast("int")


def coded_blocks(df: DataFrame, design: Design, shift: dict[str, float], block_rows: int = BLOCK_ROWS) -> Blocks:
    """Complete rows with their block and, within it, the number of their group, bucketed by block."""
    spark = df.sparkSession
    rows = design_rows(df, design).withColumn("grp", F.col(design.group).cast("string"))
    levels = [F.col(c).cast("double") for c in design.group_level]
    counts = rows.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.min(c).alias(f"lo{j}") for j, c in enumerate(levels)], *[F.max(c).alias(f"hi{j}") for j, c in enumerate(levels)],
    )
    path = scratch_path(spark, "group-sizes")
    counts.write.parquet(path)
    counts = spark.read.schema(counts.schema).parquet(path)
    total, groups = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    for j, c in enumerate(design.group_level):
        if counts.where(~F.col(f"lo{j}").eqNullSafe(F.col(f"hi{j}"))).limit(1).count():
            raise ValueError(f"{c} varies within a group")
    whole = max(1, -(-(total or 0) // block_rows))
    spread, at = [], whole
    for i, r in enumerate(sorted(counts.where(F.col("n") > block_rows).select("grp", "n").collect())):
        pieces = -(-r["n"] // block_rows)
        spread.append((r["grp"], i, at, pieces))
        at += pieces
    hot = local_table(spark, spread, "__grp string, hot int, __at long, __pieces long")
    rows = rows.join(hot, F.col("grp") == F.col("__grp"), "left")
    numbers = [
        F.col(design.response).cast("double").alias("y"),
        *[code(c, lv).alias(f"k{j}") for j, (c, lv) in enumerate(design.categories.items())],
        *[(F.col(c).cast("double") - F.lit(shift[c])).alias(f"x{j}") for j, c in enumerate([*design.discrete, *design.continuous])],
        *[(F.col(c).cast("double") - F.lit(shift[PV])).alias(f"p{i}") for i, c in enumerate(design.pv)],
        *[(F.col(c).cast("double") - F.lit(shift[c])).alias(f"l{j}") for j, c in enumerate(design.group_level)],
    ]
    table = rows.select("grp", F.coalesce("hot", F.lit(-1)).alias("hot"), "__at", "__pieces", *numbers)
    salt = F.xxhash64(*[c for c in table.columns if c[0] in "ykxp"])  # rows alike in every number stay together
    block = F.when(F.col("hot") < 0, F.pmod(F.xxhash64("grp"), F.lit(whole))).otherwise(F.col("__at") + F.pmod(salt, F.col("__pieces")))
    buckets = min(at, max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    table = table.withColumn("block", block.cast("long")).drop("__at", "__pieces").repartition(buckets, "block")
    table = table.withColumn("g", F.dense_rank().over(Window.partitionBy("block").orderBy("grp")) - 1)
    name = f"tenfold_blocks_{uuid.uuid4().hex}"
    table.write.bucketBy(buckets, "block").sortBy("block", "g").option("path", scratch_path(spark, "blocks")).saveAsTable(name)
    return Blocks(spark.table(name), name, [s[0] for s in spread], groups)


# ------------------------------------------------------------ sums of a block


@dataclass
class Model:
    """The columns of one model and draw among those of a block."""

    fit: int
    pv: int
    x: list[int]
    z: list[int]
    needed: list[int]  # group-level columns that must be present

    def rows(self, pdf: pd.DataFrame, design: Design) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cols = [np.ones(len(pdf))]
        for j, lv in enumerate(design.categories.values()):
            held = pdf[f"k{j}"].to_numpy()
            cols += [(held == i).astype(float) for i in range(1, len(lv))]
        cols += [pdf[f"x{j}"].to_numpy() for j in range(len(design.discrete) + len(design.continuous))]
        cols.append(pdf[f"p{self.pv - 1}"].to_numpy() if design.pv else np.zeros(len(pdf)))
        cols += [pdf[f"l{j}"].to_numpy() for j in range(len(design.group_level))]
        full = np.stack(cols, 1)
        ok = ~np.isnan(full[:, [*self.needed, *self.x, *self.z]]).any(1)
        return full[ok], pdf["y"].to_numpy()[ok], pdf["g"].to_numpy()[ok]


@dataclass
class Point:
    """Where a pass evaluates a fit: fixed effects, factor, and the modes of spread groups with their leverage matrices."""

    beta: np.ndarray
    lam: np.ndarray
    modes: np.ndarray
    lever: np.ndarray


def _logistic(eta: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mu = 1.0 / (1.0 + np.exp(-eta))
    return mu, 2.0 * (np.logaddexp(0.0, eta) - y * eta)


def _outer(z: np.ndarray, w: np.ndarray, starts: np.ndarray) -> np.ndarray:
    q = z.shape[1]
    out = np.empty((len(starts), q, q))
    for a in range(q):
        for b in range(a + 1):
            out[:, a, b] = out[:, b, a] = np.add.reduceat(w * z[:, a] * z[:, b], starts)
    return out


def modes_at(z: np.ndarray, y: np.ndarray, fixed: np.ndarray, of: np.ndarray, starts: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """Modes of whole groups, by damped Newton steps from zero."""
    q, u = lam.shape[0], np.zeros((len(starts), lam.shape[0]))

    def value(u):
        mu, dev = _logistic(fixed + (z * (u @ lam.T)[of]).sum(1), y)
        return mu, np.add.reduceat(dev, starts) + (u * u).sum(1)

    mu, now = value(u)
    for _ in range(60):
        score = np.add.reduceat((y - mu)[:, None] * z, starts)
        m = lam.T @ _outer(z, mu * (1 - mu), starts) @ lam + np.eye(q)
        step = np.linalg.solve(m, (score @ lam - u)[:, :, None])[:, :, 0]
        if np.abs(step).max(initial=0.0) < 1e-10:
            break
        for _ in range(30):
            mu, new = value(u + step)
            worse = new > now + 1e-12 * np.abs(now)
            if not worse.any():
                break
            step[worse] *= 0.5
        u, now = u + step, new
    return u


def _theta(q: int) -> tuple[np.ndarray, np.ndarray]:
    return np.tril_indices(q)


def _finish(lam, u, a, b, rz, lz) -> dict[str, np.ndarray]:
    """What groups add to each sum, from their weighted products ``a`` = Z'WZ, ``b`` = Z'WX, scores and leverage sums."""
    q, p = lam.shape[0], b.shape[2]
    m = lam.T @ a @ lam + np.eye(q)
    m_inv = np.linalg.inv(m)
    lb = np.einsum("qr,jqp->jrp", lam, b)
    miss = rz @ lam - u
    mlb = m_inv @ lb
    rows, cols = _theta(q)
    s, f = np.zeros(len(rows)), np.zeros((len(rows), p))
    for i, (row, col) in enumerate(zip(rows, cols)):
        eu = np.zeros_like(u)
        eu[:, row] = u[:, col]
        e = -np.einsum("jqr,jr->jq", a, eu) @ lam
        e[:, col] += rz[:, row]
        me = np.einsum("jqr,jr->jq", m_inv, e)
        s[i] = (lz * (me @ lam.T + eu)).sum()
        f[i] = -np.einsum("jqp,jq->p", b, eu) - np.einsum("jqp,jq->p", lb, me)
    return {
        "penalty": np.array([(u * u).sum()]), "logdet": np.array([np.linalg.slogdet(m)[1].sum() if q else 0.0]),
        "h": -np.einsum("jqp,jqr->pr", lb, mlb), "gx": -np.einsum("jqp,jq->p", mlb, miss),
        "gdet": np.einsum("jqr,jrs->qs", a @ lam, m_inv), "gfit": np.einsum("jq,jr->qr", rz, u),
        "s": s, "f": f, "l": -np.einsum("jq,jqp->p", lz @ lam, mlb),
    }


def _shapes(p: int, q: int) -> dict[str, tuple[int, ...]]:
    t = q * (q + 1) // 2
    return {"dev": (1,), "n": (1,), "groups": (1,), "penalty": (1,), "logdet": (1,), "h": (p, p), "gx": (p,), "gdet": (q, q),
            "gfit": (q, q), "s": (t,), "f": (t, p), "l": (p,), "xx": (p, p)}


def _hot_shapes(p: int, q: int) -> dict[str, tuple[int, ...]]:
    return {"n": (1,), "a": (q, q), "b": (q, p), "rz": (q,), "lz": (q,)}


def _packed(parts: dict[str, np.ndarray], shapes: dict) -> np.ndarray:
    return np.concatenate([np.broadcast_to(parts.get(k, 0.0), s).ravel() for k, s in shapes.items()])


def _unpacked(flat: np.ndarray, shapes: dict) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in shapes.items():
        size = int(np.prod(s))
        out[k] = flat[at : at + size].reshape(s)
        at += size
    return out


def block_sums(full: np.ndarray, y: np.ndarray, g: np.ndarray, hot: int, model: Model, point: Point) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, sums) of one block: slot -1 for totals, else the spread group that the block is part of."""
    x, z, lam = full[:, model.x], full[:, model.z], point.lam
    order = np.argsort(g, kind="stable")
    x, z, y, g = x[order], z[order], y[order], g[order]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(g))))
    fixed = x @ point.beta
    u = point.modes[hot : hot + 1] if hot >= 0 else modes_at(z, y, fixed, of, starts, lam)
    mu, dev = _logistic(fixed + (z * (u @ lam.T)[of]).sum(1), y)
    w = mu * (1 - mu)
    a = _outer(z, w, starts)
    b = np.stack([np.add.reduceat((w * z[:, i])[:, None] * x, starts) for i in range(z.shape[1])], 1)
    rz = np.add.reduceat((y - mu)[:, None] * z, starts)
    if hot >= 0:
        spread = point.lever[hot : hot + 1]
    else:
        spread = lam @ np.linalg.inv(lam.T @ a @ lam + np.eye(len(lam))) @ lam.T
    turn = w * (1 - 2 * mu) * np.einsum("nq,nqr,nr->n", z, spread[of], z)
    lz = np.add.reduceat(turn[:, None] * z, starts)
    xx = (x * w[:, None]).T @ x
    parts = {"dev": dev.sum(), "n": len(y), "h": xx, "gx": x.T @ (y - mu), "l": turn @ x, "xx": xx}
    if hot < 0:
        parts["groups"] = len(starts)
        for k, v in _finish(lam, u, a, b, rz, lz).items():
            parts[k] = parts[k] + v if k in parts else v
    shapes = (x.shape[1], z.shape[1])
    yield -1, _packed(parts, _shapes(*shapes))
    if hot >= 0:
        yield hot, _packed({"n": len(y), "a": a[0], "b": b[0], "rz": rz[0], "lz": lz[0]}, _hot_shapes(*shapes))


def pass_over(blocks: Blocks, design: Design, asked: list[tuple[Model, Point]]) -> dict[int, dict[int, np.ndarray]]:
    """One pass for all fits that asked: sums by fit and slot."""
    spark = blocks.table.sparkSession
    held = spark.sparkContext.broadcast(asked)
    columns = [c for c in blocks.table.columns if c != "grp"]

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        out, hot = [], int(pdf["hot"].iloc[0])
        for model, point in held.value:
            full, y, g = model.rows(pdf, design)
            if len(y):
                out += [(model.fit, slot, v.tobytes()) for slot, v in block_sums(full, y, g, hot, model, point)]
        return pd.DataFrame(out, columns=["fit", "slot", "sums"])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for pdf in batches:
            for fit, slot, raw in pdf.itertuples(index=False):
                v = np.frombuffer(raw)
                sums[fit, slot] = sums[fit, slot] + v if (fit, slot) in sums else v
        for (fit, slot), v in sums.items():
            yield pd.DataFrame({"fit": fit, "slot": slot, "i": np.arange(len(v)), "v": v})

    each = blocks.table.select(*columns).groupBy("block").applyInPandas(block, "fit int, slot int, sums binary")
    parts = each.mapInPandas(add, "fit int, slot int, i int, v double")
    rows = parts.groupBy("fit", "slot", "i").agg(F.sum("v").alias("v")).toPandas()
    held.unpersist()
    out: dict[int, dict[int, np.ndarray]] = {}
    for (fit, slot), part in rows.groupby(["fit", "slot"]):
        out.setdefault(int(fit), {})[int(slot)] = part.sort_values("i")["v"].to_numpy()
    return out


# ------------------------------------------------------------ fits in step


class Together:
    """Fits in threads of their own whose passes are made together: one when all that still run have asked."""

    def __init__(self, run: Callable[[list], dict]):
        self.run, self.lock = run, threading.Condition()
        self.waiting: dict[int, tuple] = {}
        self.answers: dict[int, object] = {}
        self.live, self.failure = 0, None

    def ask(self, fit: int, request: tuple):
        with self.lock:
            self.waiting[fit] = request
            self.lock.notify_all()
            self.lock.wait_for(lambda: fit in self.answers or self.failure)
            if self.failure:
                raise RuntimeError("a pass failed") from self.failure
            return self.answers.pop(fit)

    def all(self, jobs: dict[int, Callable[[], object]]) -> dict[int, object]:
        done: dict[int, object] = {}

        def work(fit, job):
            try:
                done[fit] = job()
            except BaseException as e:  # handed on to the caller below
                with self.lock:
                    self.failure = self.failure or e
            finally:
                with self.lock:
                    self.live -= 1
                    self.lock.notify_all()

        self.live = len(jobs)
        threads = [threading.Thread(target=work, args=item, daemon=True) for item in jobs.items()]
        for t in threads:
            t.start()
        while True:
            with self.lock:
                self.lock.wait_for(lambda: self.failure or len(self.waiting) == self.live)
                if self.failure or not self.live:
                    break
                asked, self.waiting = self.waiting, {}
            try:
                answers = self.run([asked[k] for k in sorted(asked)])
            except BaseException as e:
                with self.lock:
                    self.failure = e
                    self.lock.notify_all()
                break
            with self.lock:
                self.answers.update({k: answers.get(k, {}) for k in asked})
                self.lock.notify_all()
        for t in threads:
            t.join()
        if self.failure:
            raise self.failure
        return done


@dataclass
class Solution:
    model: Model
    spec: ModelSpec
    xcols: list[str]
    zcols: list[str]
    point: Point
    sums: dict[str, np.ndarray]
    passes: int
    converged: bool
    spread: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 0)))  # inverse of M of spread groups

    @property
    def deviance(self) -> float:
        return float((self.sums["dev"] + self.sums["penalty"] + self.sums["logdet"])[0])


class Fit:
    """One model and draw: Newton steps for the fixed effects inside a descent for the factor."""

    def __init__(self, model: Model, spec: ModelSpec, design: Design, hot: int, ask: Callable, start: tuple | None = None):
        self.model, self.spec, self.ask = model, spec, ask
        self.xcols, self.zcols = spec.fixed_columns(design), spec.random_columns(design)
        self.q, self.passes = len(model.z), 0
        self.hot = hot
        self.beta = np.zeros(len(model.x))
        self.modes, self.lever = np.zeros((hot, self.q)), np.zeros((hot, self.q, self.q))
        self.theta0 = np.eye(self.q)[_theta(self.q)]
        if start is not None:
            self.theta0, known = start
            self.beta = np.array([known.get(c, 0.0) for c in self.xcols])
        self.at: dict | None = None

    def sums_at(self, lam: np.ndarray) -> dict[str, np.ndarray]:
        self.passes += 1
        if self.passes > MAX_PASSES:
            raise ArithmeticError(f"{self.spec.name}, draw {self.model.pv}: no end after {MAX_PASSES} passes")
        got = self.ask(self.model.fit, (self.model, Point(self.beta, lam, self.modes, self.lever)))
        p, q = len(self.model.x), self.q
        sums = _unpacked(got.get(-1, np.zeros(sum(int(np.prod(s)) for s in _shapes(p, q).values()))).copy(), _shapes(p, q))
        slots = sorted(k for k in got if k >= 0)
        if slots:
            hot = {k: _unpacked(got[k], _hot_shapes(p, q)) for k in slots}
            a, b, rz, lz = (np.stack([hot[k][c] for k in slots]) for c in ("a", "b", "rz", "lz"))
            for k, v in _finish(lam, self.modes[slots], a, b, rz, lz).items():
                sums[k] = sums[k] + v
            sums["groups"] = sums["groups"] + len(slots)
            m_inv = np.linalg.inv(lam.T @ a @ lam + np.eye(q))
            sums["hot"] = (slots, m_inv, rz @ lam - self.modes[slots], np.einsum("qr,jqp->jrp", lam, b))
        return sums

    def settle(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        """Laplace deviance and gradient at a factor, with fixed effects at their penalised optimum."""
        lam = lmm.lower(theta, self.q)
        last = None
        for step in range(60):
            sums = self.sums_at(lam)
            value = float((sums["dev"] + sums["penalty"])[0])
            if self.at is None and step == 0:
                self._independent(sums)
            move = np.linalg.solve(sums["h"], sums["gx"])
            turns = np.zeros((0, self.q))
            if "hot" in sums:
                slots, m_inv, miss, lb = sums["hot"]
                turns = np.einsum("jqr,jr->jq", m_inv, miss - lb @ move)
                self.lever[slots] = lam @ m_inv @ lam.T
            size = max(np.abs(move).max(initial=0.0), np.abs(turns).max(initial=0.0))
            scale = max(1.0, np.abs(self.beta).max(initial=0.0))
            if size < 1e-7 * scale and (step or "hot" not in sums):
                break
            if last is not None and value > last + 1e-9 * abs(last) and step < 40:  # too far: halfway back
                self.beta, self.modes = self.beta - self.moved[0] / 2, self.modes - self.moved[1] / 2
                self.moved = (self.moved[0] / 2, self.moved[1] / 2)
                continue
            last = value
            shift = np.zeros_like(self.modes)
            if len(turns):
                shift[slots] = turns
            self.moved = (move, shift)
            self.beta, self.modes = self.beta + move, self.modes + shift
        turn = np.linalg.solve(sums["h"], sums["f"].T)
        slope = sums["s"] + sums["l"] @ turn
        grad = 2.0 * (sums["gdet"] - sums["gfit"])[_theta(self.q)] + slope
        deviance = float((sums["dev"] + sums["penalty"] + sums["logdet"])[0])
        if self.at is None or deviance <= self.at["deviance"]:
            self.at = {"deviance": deviance, "sums": sums, "point": Point(self.beta.copy(), lam, self.modes.copy(), self.lever.copy())}
        return deviance, grad

    def _independent(self, sums: dict) -> None:
        """Columns that depend on others are left out, once."""
        keep = lmm.independent_columns(sums["xx"])
        if len(keep) < len(self.xcols):
            self.xcols = [self.xcols[i] for i in keep]
            self.model = Model(self.model.fit, self.model.pv, [self.model.x[i] for i in keep], self.model.z, self.model.needed)
            self.beta = self.beta[keep]
            for k in ("h", "xx"):
                sums[k] = sums[k][np.ix_(keep, keep)]
            sums["gx"], sums["l"], sums["f"] = sums["gx"][keep], sums["l"][keep], sums["f"][:, keep]
            if "hot" in sums:
                sums["hot"] = (*sums["hot"][:3], sums["hot"][3][:, :, keep])

    def solve(self) -> Solution:
        _, _, _, _, ok = lmm.minimise(self.settle, self.theta0, gtol=1e-4, steps=80)
        held = self.at
        spread = np.zeros((self.hot, self.q, self.q))
        if "hot" in held["sums"]:
            spread[held["sums"]["hot"][0]] = held["sums"]["hot"][1]
        return Solution(self.model, self.spec, self.xcols, self.zcols, held["point"], held["sums"], self.passes, bool(ok), spread)


def models_of(design: Design, pending: list[tuple[ModelSpec, int]]) -> list[tuple[Model, ModelSpec]]:
    names = [*design.row_columns(), PV, *design.group_level]
    out = []
    for spec, pv in pending:
        x, z = ([names.index(c) for c in cols] for cols in (spec.fixed_columns(design), spec.random_columns(design)))
        out.append((Model(len(out), pv, x, z, [names.index(c) for c in spec.group_level(design)]), spec))
    return out


def solve_all(
    blocks: Blocks, design: Design, pending: list[tuple[ModelSpec, int]], start: Callable[[ModelSpec, int], tuple | None] = lambda s, d: None
) -> list[Solution]:
    """The given models and draws; ``start`` may give a factor and fixed effects by name to begin with."""
    together = Together(lambda asked: pass_over(blocks, design, asked))
    fits = {m.fit: Fit(m, s, design, len(blocks.hot), together.ask, start(s, m.pv)) for m, s in models_of(design, pending)}
    done = together.all({k: f.solve for k, f in fits.items()})
    return [done[k] for k in sorted(done)]


# ------------------------------------------------------------ result rows


def solution_rows(s: Solution, design: Design, shift: dict[str, float]) -> list[tuple]:
    name, pv, point = s.spec.name, s.model.pv, s.point
    back, turn = from_centred(s.xcols, shift), from_centred(s.zcols, shift)
    se = np.sqrt(np.maximum(np.diag(back @ np.linalg.inv(s.sums["h"]) @ back.T), 0))
    out = [_row(name, pv, "fixed", term=t, value=b, spread=e) for t, b, e in zip(s.xcols, back @ point.beta, se)]
    lam = lmm.fold(point.lam)
    for grp, a, c, v, e in lmm.variance_rows(turn @ lam, s.zcols, design.group, 1.0, residual=False):
        out.append(_row(name, pv, "random", grp=grp, term=a, term2=c, value=v, spread=e))
    npar = len(point.beta) + len(lam) * (len(lam) + 1) // 2
    return out + fit_rows(
        name, pv,
        {
            "n": s.sums["n"][0], "groups": s.sums["groups"][0], "deviance": s.deviance, "loglik": -s.deviance / 2, "npar": npar,
            "aic": s.deviance + 2 * npar, "sigma": 1.0, "iterations": s.passes, "converged": s.converged,
            "singular": np.linalg.svd(lam, compute_uv=False).min() < 1e-4, "left_out": len(s.spec.fixed_columns(design)) - len(s.xcols),
        },
    )


def mode_rows(blocks: Blocks, design: Design, s: Solution, shift: dict[str, float]) -> DataFrame:
    """Modes and their deviations, written by the tasks that hold the groups; those of spread groups by the driver."""
    name, pv, point = s.spec.name, s.model.pv, s.point
    lam, turned, model, zcols = point.lam, from_centred(s.zcols, shift) @ point.lam, s.model, s.zcols

    def rows_of(labels, u, m_inv):
        value, sd = u @ turned.T, np.sqrt(np.maximum(np.einsum("jqq->jq", turned @ m_inv @ turned.T), 0))
        return [_row(name, pv, "mode", grp=g, term=t, value=value[j, i], spread=sd[j, i]) for j, g in enumerate(labels) for i, t in enumerate(zcols)]

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("g", kind="stable")
        full, y, g = model.rows(pdf, design)
        if not len(y):
            return result_frame([])
        label = pdf.drop_duplicates("g").set_index("g")["grp"]
        starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(g))))
        x, z = full[:, model.x], full[:, model.z]
        fixed = x @ point.beta
        u = modes_at(z, y, fixed, of, starts, lam)
        mu, _ = _logistic(fixed + (z * (u @ lam.T)[of]).sum(1), y)
        m_inv = np.linalg.inv(lam.T @ _outer(z, mu * (1 - mu), starts) @ lam + np.eye(len(lam)))
        return result_frame(rows_of(label.loc[g[starts]].tolist(), u, m_inv))

    spark = blocks.table.sparkSession
    found = blocks.table.where("hot < 0").groupBy("block").applyInPandas(block, RESULT_SCHEMA)
    if not blocks.hot or "hot" not in s.sums:
        return found
    slots = s.sums["hot"][0]
    hot = rows_of([blocks.hot[k] for k in slots], point.modes[slots], s.spread[slots])
    return found.unionByName(spark.createDataFrame(result_frame(hot), RESULT_SCHEMA))
