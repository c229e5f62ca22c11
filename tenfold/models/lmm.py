"""Linear mixed models by maximum likelihood, from per-group Gram matrices.

The deviance is profiled over the fixed effects and the residual variance
(Bates, Maechler, Bolker and Walker 2015); one pass over the rows serves every
evaluation.  Fits of different models and draws are independent Spark tasks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np

from tenfold.functions.tails import chi2_upper


@dataclass
class Blocks:
    """Sums of one model: ``a`` = Z'Z, ``b`` = Z'X, ``c`` = Z'y per group; totals for X and y."""

    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    xx: np.ndarray
    xy: np.ndarray
    yy: float
    n: float

    def slopes_kept(self, keep: list[int]) -> Blocks:
        return replace(self, a=self.a[:, keep][:, :, keep], b=self.b[:, keep], c=self.c[:, keep])


def independent_columns(xx: np.ndarray, tol: float = 1e-10) -> list[int]:
    """Columns kept when later ones that depend on earlier ones are dropped."""
    scale = np.sqrt(np.maximum(np.diag(xx), 1e-300))
    s = xx / scale[:, None] / scale[None, :]
    keep: list[int] = []
    for j in range(len(s)):
        if np.diag(xx)[j] <= 0:
            continue
        if keep:
            part = np.linalg.solve(s[np.ix_(keep, keep)], s[keep, j])
            if s[j, j] - part @ s[keep, j] < tol:
                continue
        keep.append(j)
    return keep


def lower(theta: np.ndarray, q: int) -> np.ndarray:
    out = np.zeros((q, q))
    out[np.tril_indices(q)] = theta
    return out


def fold(lam: np.ndarray) -> np.ndarray:
    """The deviance ignores column signs; make the diagonal non-negative."""
    return lam * np.where(np.diag(lam) < 0, -1.0, 1.0)[None, :]


@dataclass
class State:
    deviance: float
    gradient: np.ndarray
    beta: np.ndarray
    u: np.ndarray
    m_inv: np.ndarray
    h: np.ndarray
    r2: float
    logdet: float


def group_terms(a, b, c, lam):
    """Sums over groups that give the fixed effects: log-determinant and the reductions of X'X, X'y and y'y."""
    q = lam.shape[0]
    m = lam.T @ (a @ lam) + np.eye(q)
    logdet = float(np.linalg.slogdet(m)[1].sum()) if q else 0.0
    lb, lc = lam.T @ b, c @ lam
    m_inv = np.linalg.inv(m)
    mb = m_inv @ lb
    down_xx = np.einsum("jqp,jqr->pr", lb, mb)
    down_xy = np.einsum("jqp,jq->p", mb, lc)
    down_yy = float(np.einsum("jq,jqr,jr->", lc, m_inv, lc))
    return logdet, down_xx, down_xy, down_yy


def group_gradient(a, b, c, lam, beta):
    """Modes and the two gradient sums over groups, given the fixed effects."""
    al = a @ lam
    m_inv = np.linalg.inv(lam.T @ al + np.eye(lam.shape[0]))
    rest = c - b @ beta
    u = np.einsum("jqr,jr->jq", m_inv, rest @ lam)
    ze = rest - np.einsum("jqr,jr->jq", al, u)
    return u, m_inv, np.einsum("jqr,jrs->qs", al, m_inv), np.einsum("jq,jr->qr", ze, u)


def assemble(n, xx, xy, yy, terms, gradient_sums, lam, sigma=None) -> State:
    """Deviance and gradient from sums over groups; ``gradient_sums`` is called with the fixed effects."""
    logdet, down_xx, down_xy, down_yy = terms
    h, rhs = xx - down_xx, xy - down_xy
    beta = np.linalg.solve(h, rhs)
    r2 = max(yy - down_yy - float(beta @ rhs), 1e-300)
    u, m_inv, g_det, g_fit = gradient_sums(beta)
    scale = n / r2 if sigma is None else 1.0 / sigma**2
    grad = 2.0 * (g_det - scale * g_fit)
    if sigma is None:
        dev = logdet + n * (1.0 + math.log(2.0 * math.pi * r2 / n))
    else:
        dev = logdet + n * math.log(2.0 * math.pi * sigma**2) + r2 / sigma**2
    return State(dev, grad[np.tril_indices(lam.shape[0])], beta, u, m_inv, h, r2, logdet)


def evaluate(blocks: Blocks, lam: np.ndarray, sigma: float | None = None) -> State:
    """Deviance and gradient at a relative covariance factor; ``sigma`` fixes the residual scale."""
    held = (blocks.a, blocks.b, blocks.c, lam)
    return assemble(
        blocks.n, blocks.xx, blocks.xy, blocks.yy, group_terms(*held), lambda beta: group_gradient(*held, beta), lam, sigma
    )


def minimise(fun, start: np.ndarray, gtol: float = 1e-7, steps: int = 400, memory: dict | None = None):
    """Quasi-Newton descent with backtracking; ``fun`` gives (value, gradient).

    ``memory`` keeps the inverse curvature between related problems.
    """
    x = start.astype(float)
    f, g = fun(x)
    memory = {} if memory is None else memory
    fresh = "inv" not in memory
    inv = np.eye(len(x)) / max(1.0, np.abs(g).max()) if fresh else memory["inv"]
    stalled = 0
    for it in range(steps):
        if np.abs(g).max(initial=0.0) < gtol:
            return x, f, g, it, True
        d = -inv @ g
        if d @ g >= 0:
            inv = np.eye(len(x)) / max(1.0, np.abs(g).max())
            d = -inv @ g
        step = min(1.0, 2.0 / max(np.abs(d).max(), 1e-12))
        while True:
            nx = x + step * d
            nf, ng = fun(nx)
            # Where the value is flat to rounding, a smaller gradient decides.
            flat = abs(nf - f) <= 1e-12 * abs(f) and np.abs(ng).max() < np.abs(g).max()
            if nf <= f + 1e-4 * step * (d @ g) or flat or step < 1e-10:
                break
            step *= 0.5
        if step < 1e-10 or (f - nf <= 1e-13 * abs(f) and np.abs(ng).max() > 0.5 * np.abs(g).max()):
            stalled += 1
            if step < 1e-10 or stalled > 3:
                near = np.abs(g).max() < 1e-3
                better = np.abs(ng).max() < np.abs(g).max() and nf <= f + 1e-12 * abs(f)
                return (nx, nf, ng, it, near) if nf < f or better else (x, f, g, it, near)
        else:
            stalled = 0
        s, y = nx - x, ng - g
        sy = s @ y
        if sy > 1e-14 * np.linalg.norm(s) * np.linalg.norm(y):
            if it == 0 and fresh:
                inv = np.eye(len(x)) * (sy / (y @ y))
            rho = 1.0 / sy
            left = np.eye(len(x)) - rho * np.outer(s, y)
            inv = left @ inv @ left.T + rho * np.outer(s, s)
            memory["inv"] = inv
        x, f, g = nx, nf, ng
    return x, f, g, steps, False


@dataclass
class Fit:
    lam: np.ndarray
    beta: np.ndarray
    se: np.ndarray
    sigma2: float
    deviance: float
    npar: int
    converged: bool
    singular: bool
    iterations: int
    state: State


def fit(blocks: Blocks, start: np.ndarray | None = None) -> Fit:
    return fit_by(lambda lam, sigma=None: evaluate(blocks, lam, sigma), blocks.a.shape[1], len(blocks.xy), blocks.n, start)


def fit_by(evaluator, q: int, p: int, n: float, start: np.ndarray | None = None) -> Fit:
    """Maximum likelihood through any ``evaluator(lam, sigma)``."""

    def fun(theta):
        s = evaluator(lower(theta, q))
        return s.deviance, s.gradient

    if q:
        begin = np.eye(q)[np.tril_indices(q)] if start is None else start
        theta, _, _, its, ok = minimise(fun, begin, gtol=1e-9)
        lam = fold(lower(theta, q))
    else:
        lam, its, ok = np.zeros((0, 0)), 0, True
    s = evaluator(lam)
    sigma2 = s.r2 / n
    se = np.sqrt(np.maximum(np.diag(np.linalg.inv(s.h)) * sigma2, 0))
    small = bool(q) and (np.linalg.svd(lam, compute_uv=False).min() < 1e-4 or np.diag(lam).min() < 1e-4)
    return Fit(lam, s.beta, se, sigma2, s.deviance, p + q * (q + 1) // 2 + 1, ok, small, its, s)


def moved(f: Fit, fixed: np.ndarray, random: np.ndarray, lift: float) -> Fit:
    """The fit in other columns: ``fixed`` and ``random`` turn its coefficients into theirs; ``lift`` is added to the first."""
    beta = fixed @ f.beta
    beta[0] += lift
    se = np.sqrt(np.maximum(np.diag(fixed @ np.linalg.inv(f.state.h) @ fixed.T) * f.sigma2, 0))
    return replace(f, beta=beta, se=se, lam=random @ f.lam)


def satterthwaite(evaluator, f: Fit, n: float, back: np.ndarray | None = None) -> np.ndarray:
    """Approximate degrees of freedom of each fixed effect (NaN where undefined); ``back`` turns them into other columns."""
    back = np.eye(len(f.beta)) if back is None else back

    def variances(h, sigma2):
        return np.diag(back @ np.linalg.inv(h) @ back.T) * sigma2

    q = f.lam.shape[0]
    ix = np.tril_indices(q)
    point = np.append(f.lam[ix], math.sqrt(f.sigma2))

    def at(v):
        s = evaluator(lower(v[:-1], q), v[-1])
        grad = np.append(s.gradient, 2 * n / v[-1] - 2 * s.r2 / v[-1] ** 3)
        return grad, variances(s.h, v[-1] ** 2)

    k = len(point)
    hess, jac = np.zeros((k, k)), np.zeros((k, len(f.beta)))
    for i in range(k):
        e = np.zeros(k)
        e[i] = 1e-4 * max(1.0, abs(point[i])) if i < k - 1 else 1e-4 * point[i]
        (gu, vu), (gd, vd) = at(point + e), at(point - e)
        hess[i], jac[i] = (gu - gd) / (2 * e[i]), (vu - vd) / (2 * e[i])
    hess = 0.5 * (hess + hess.T)
    w, v = np.linalg.eigh(hess)
    good = w > 1e-8 * max(1.0, w.max())
    cov = 2.0 * (v[:, good] / w[good]) @ v[:, good].T
    spread = np.einsum("kp,kl,lp->p", jac, cov, jac)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(spread > 0, 2.0 * variances(f.state.h, f.sigma2) ** 2 / spread, np.nan)


def variance_rows(lam: np.ndarray, names: list[str], group: str, sigma2: float, residual: bool = True) -> list[tuple]:
    """(group, term, other term, variance or covariance, deviation or correlation)."""
    cov = sigma2 * lam @ lam.T
    sd = np.sqrt(np.diag(cov))
    rows = [(group, a, None, cov[i, i], sd[i]) for i, a in enumerate(names)]
    for i in range(len(names)):
        for j in range(i + 1, len(names)):
            size = sd[i] * sd[j]
            rows.append((group, names[i], names[j], cov[j, i], cov[j, i] / size if size > 0 else None))
    if residual:
        rows.append(("Residual", None, None, sigma2, math.sqrt(sigma2)))
    return rows


def conditional_modes(lam: np.ndarray, state: State, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Random effects per group and their conditional deviations."""
    b = state.u @ lam.T
    cov = scale * lam @ state.m_inv @ lam.T
    return b, np.sqrt(np.maximum(np.einsum("jqq->jq", cov), 0))


def deletions(smaller, f: Fit, terms: dict[str, list[int]]) -> list[tuple]:
    """Likelihood-ratio tests of single random terms: (term, npar, logLik, AIC, LRT, df, p).

    ``smaller`` fits the model with the random columns at the given places only.
    """
    out = [("<none>", f.npar, -f.deviance / 2, f.deviance + 2 * f.npar, None, None, None)]
    for term, drop in terms.items():
        keep = [i for i in range(f.lam.shape[0]) if i not in drop]
        g = smaller(keep)
        lrt, df = max(0.0, g.deviance - f.deviance), f.npar - g.npar
        out.append((term, g.npar, -g.deviance / 2, g.deviance + 2 * g.npar, lrt, df, chi2_upper(lrt, df)))
    return out
