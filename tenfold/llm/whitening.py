"""Whitening of embeddings by the leading eigenvectors of their covariance.

Entries become whole numbers, ``x = floor(64 c) + 1000000``, so counts, sums and
squared distances from the mean are exact.  Two passes give the covariance: sums,
then products of what is left after the mean is taken off.  Only the d x d sums
reach the driver, whatever the number of rows.

There the spectrum is sliced.  By Sylvester's law, the covariance less a shift has
as many positive pivots in its LDL' factors as eigenvalues above the shift.  Counts
at shifts halve intervals until each holds one eigenvalue, Rayleigh quotient
iteration converges inside the interval, and counts on both sides of the value
found certify its number.  Eigenvalues too close to be told apart are taken
together: one basis of their common space.

Defined cases: vectors that are missing, or hold missing or non-finite entries, take
no part; shorter vectors are filled up to the longest with zeros; entries beyond
2**40 count as 2**40; rows of equal or missing ids, and equal vectors, all
count and all return; components whose variance is below 1e-10 of the largest
cannot be whitened and are left out, so constant vectors, a single vector or none
give no rows; further columns are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenfold.llm import common

SCALE, SHIFT = 64, 1_000_000
#: Whole numbers stay below this, so that sums over a block fit 64 bits.
_MOST = 1 << 46
#: Entries that a task holds as a matrix at once.
BLOCK = 1 << 20
#: Components of less variance, as a share of the largest, are not whitened.
LEAST = 1e-10
_EPS = np.finfo(float).eps


# ------------------------------------------------------------ spectrum slicing


def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues are above ``shift``: positive pivots of LDL' with Bunch and Kaufman's pivoting."""
    a = matrix - shift * np.eye(len(matrix))
    positive, alpha = 0, (1 + math.sqrt(17)) / 8
    while len(a):
        column = np.abs(a[1:, 0])
        r = 1 + int(column.argmax()) if len(column) else 0
        largest = column[r - 1] if len(column) else 0.0
        two = False
        if largest and abs(a[0, 0]) < alpha * largest:
            row = np.abs(a[r]).copy()
            row[r] = 0
            if abs(a[0, 0]) * row.max() < alpha * largest * largest:
                two = abs(a[r, r]) < alpha * row.max()
                to = 1 if two else 0
                a[[to, r]] = a[[r, to]]
                a[:, [to, r]] = a[:, [r, to]]
        if two:  # a block with one positive and one negative eigenvalue
            positive += 1
            w = a[2:, :2]
            a = a[2:, 2:] - w @ np.linalg.solve(a[:2, :2], w.T)
        else:
            pivot = a[0, 0]
            positive += pivot >= 0
            w = a[1:, :1]
            a = a[1:, 1:] - (w / pivot) * w.T if pivot else a[1:, 1:].copy()
    return positive


def _solved(matrix: np.ndarray, shift: float, x: np.ndarray, size: float) -> np.ndarray:
    for k in range(3):
        try:
            y = np.linalg.solve(matrix - (shift + k * 4 * _EPS * size) * np.eye(len(matrix)), x)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(y).all() and np.abs(y).max():
            return y / np.abs(y).max()
    raise ArithmeticError("no shift near the eigenvalue could be solved")


def _apart(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """A unit vector along what is left of ``x`` beside the known vectors."""
    for _ in range(2):
        x = x - known.T @ (known @ x)
        x = x / np.linalg.norm(x)
    return x


def leading(matrix: np.ndarray, most: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues, falling, and their unit eigenvectors as rows; numbers certified by counts."""
    d = len(matrix)
    size = float(np.abs(matrix).sum(1).max()) if d else 0.0
    if not size:
        return np.zeros(0), np.zeros((0, d))
    fine, near = 4 * _EPS * d * size, 64 * _EPS * d * size
    rng = np.random.default_rng(seed)
    low = -2 * near
    todo, values, vectors = [(low, 1.01 * size, d, 0)], [], np.zeros((0, d))
    while todo and len(values) < most:
        lo, hi, at_lo, at_hi = todo.pop()  # eigenvalues number at_hi + 1 to at_lo lie between
        count = at_lo - at_hi
        if not count:
            continue
        middle = math.sqrt(lo * hi) if lo > 0 and hi > 4 * lo else (lo + hi) / 2
        if count > 1 and hi - lo > near:
            at = above(matrix, middle)
            todo += [(lo, middle, at_lo, at), (middle, hi, at, at_hi)]
            continue
        if count == 1:
            found = _iterated(matrix, lo, hi, middle, vectors, rng, fine, size)
            if found is None and hi - lo > near:
                at = above(matrix, middle)
                todo += [(lo, middle, at_lo, at), (middle, hi, at, at_hi)]
                continue
            if found is not None:
                value, vector = found
                margin = near
                if not (above(matrix, value - margin) >= at_lo and above(matrix, value + margin) <= at_hi):
                    raise ArithmeticError(f"eigenvalue {at_lo} could not be certified")
                values, vectors = [*values, value], np.vstack([vectors, vector])
                continue
        for _ in range(count):  # too close to be told apart: a basis of the common space
            x = _apart(rng.standard_normal(d), vectors)
            for _ in range(4):
                x = _apart(_solved(matrix, middle, x, size), vectors)
            values, vectors = [*values, float(x @ matrix @ x)], np.vstack([vectors, x])
    values = np.array(values[:most])
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:most][order]


def _iterated(matrix, lo, hi, shift, known, rng, fine, size):
    """Rayleigh quotient iteration from the middle of an interval; None if it leaves the interval or does not settle."""
    x = _apart(rng.standard_normal(len(matrix)), known)
    best = None
    for step in range(24):
        x = _apart(_solved(matrix, shift, x, size), known)
        image = matrix @ x
        value = float(x @ image)
        left = float(np.linalg.norm(image - value * x))
        inside = lo < value < hi
        if best is not None and left >= best[0] / 2 and best[0] <= fine:
            return best[1:] if lo < best[1] < hi else None
        if best is None or left < best[0]:
            best = (left, value, x)
        if step >= 2:  # inverse iteration first, at the middle
            if not inside and left <= fine:
                return None
            shift = value if inside else shift
    return best[1:] if best[0] <= fine and lo < best[1] < hi else None


# ------------------------------------------------------------ passes over the rows


def _matrices(column: pa.Array, dim: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers, entries and lengths of the rows that take part, a block at a time."""
    lengths = pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False)
    step = max(1, BLOCK // max(1, int(lengths.max(initial=1))))
    for lo in range(0, len(column), step):
        n = lengths[lo : lo + step]
        flat = column.slice(lo, step).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        held = np.maximum(n, 0)
        row = np.repeat(np.arange(len(n)), held)
        bad = np.bincount(row, ~np.isfinite(flat), len(n)) > 0
        rows = np.flatnonzero((n >= 0) & ~bad)
        width = int(held[rows].max(initial=0)) if dim is None else dim
        out = np.zeros((len(n), width))
        place = np.arange(len(flat)) - np.repeat(np.cumsum(held) - held, held)
        good = ~bad[row]
        out[row[good], place[good]] = flat[good]
        yield lo + rows, out[rows], held[rows]


def _whole(entries: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * entries), -_MOST, _MOST).astype(np.int64) + SHIFT


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum and count of the whole numbers at each place; place -1 counts the vectors."""
    for batch in batches:
        for _, entries, lengths in _matrices(batch.column(0), None):
            counts = [len(lengths), *(lengths > j for j in range(entries.shape[1]))]
            total = _whole(entries) * (np.arange(entries.shape[1]) < lengths[:, None])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(-1, entries.shape[1])), pa.array(np.append(0, total.sum(0))), pa.array([int(np.sum(c)) for c in counts], pa.int64())],
                names=["place", "total", "held"],
            )


def _products(dim: int, base: np.ndarray | None, rest: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of products of centred entries, once for each task."""
    sums = np.zeros((dim, dim))
    for batch in batches:
        for _, entries, _ in _matrices(batch.column(0), dim):
            centred = (entries if base is None else _whole(entries) - base) - rest
            sums += centred.T @ centred
    i, j = np.triu_indices(dim)
    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(sums[i, j])], names=["i", "j", "v"])


def covariance(rows: DataFrame, vector: str, n: int, dim: int, base: np.ndarray | None, rest: np.ndarray) -> np.ndarray:
    """Covariance with divisor n around ``base + rest``; only d x d sums reach the driver."""
    parts = common.map_arrow(rows.select(vector), partial(_products, dim, base, rest), "i long, j long, v double")
    sums = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    i, j, v = (sums.column(c).to_numpy() for c in ("i", "j", "v"))
    out = np.zeros((dim, dim))
    out[i, j] = out[j, i] = v / n
    return out


def _project(n: int, base: np.ndarray, off: list[int], axes: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whitened coordinates, and the exact sum of (n x - S) ** 2."""
    rest = np.array([o / n for o in off])
    for batch in batches:
        for rows, entries, _ in _matrices(batch.column(1), len(base)):
            if not len(rows):
                continue
            z = _whole(entries) - base
            far = n * int(np.abs(z).max(initial=0)) + max(map(abs, off), default=0)
            if far * far * len(base) < 1 << 63:
                y = n * z - np.array(off, np.int64)
                deviation = (y * y).sum(1).tolist()
            else:
                y = n * z.astype(object) - np.array(off, object)
                deviation = (y * y).sum(1).tolist()
            white = (z - rest) @ axes.T
            ends = np.arange(0, white.size + 1, white.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array([str(v) for v in deviation]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(white.ravel()))],
                names=["id", "deviation", "whitened"],
            )


@dataclass
class Whitening:
    """What the fit found: ``values`` fall, ``axes`` are eigenvectors over the root of their values."""

    n: int
    base: np.ndarray
    off: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float


def fit(rows: DataFrame, vector: str, components: int) -> Whitening:
    """Means, covariance and leading components of all vectors that take part."""
    places = common.map_arrow(rows.select(vector), _sums, "place long, total long, held long")
    got = places.groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("held").alias("held")).collect()
    held = {r["place"]: (int(r["total"]), r["held"]) for r in got}
    n, dim = held.get(-1, (0, 0))[1], max(held, default=-1) + 1
    if not n or not dim:
        return Whitening(n, np.zeros(dim, np.int64), [0] * dim, np.zeros(0), np.zeros((0, dim)), 0.0)
    sums = [held[j][0] + (n - held[j][1]) * SHIFT for j in range(dim)]
    base = [(2 * s + n) // (2 * n) for s in sums]
    off = [s - n * b for s, b in zip(sums, base)]
    base = np.array(base, np.int64)
    spread = covariance(rows, vector, n, dim, base, np.array([o / n for o in off]))
    values, vectors = leading(spread, min(components, dim))
    keep = values > LEAST * values.max(initial=0.0)
    values, vectors = values[keep], vectors[keep]
    sign = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)]) if len(vectors) else np.zeros(0)
    return Whitening(n, base, off, values, vectors * (sign / np.sqrt(values))[:, None], float(np.trace(spread)))


def whiten(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = 32) -> tuple[DataFrame, Whitening, float]:
    """id, deviation (decimal) and whitened (array of double) of every vector that takes part; the fit; the identity error.

    The rows are a written table.  The identity error is measured on it: the largest
    entry of the whitened vectors' covariance less the identity, in two more passes.
    """
    rows = df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    found = fit(rows, "vector", components)
    kind = rows.schema["id"].dataType.simpleString()
    if not len(found.values):
        none = rows.where("false").select("id", F.lit(None).cast("decimal(38,0)").alias("deviation"), "vector")
        return none.withColumnRenamed("vector", "whitened"), found, 0.0
    run = partial(_project, found.n, found.base, found.off, found.axes)
    white = common.map_arrow(rows, run, f"id {kind}, deviation string, whitened array<double>")
    white = common.written(white.withColumn("deviation", F.col("deviation").try_cast("decimal(38,0)")), "whitened")
    k = len(found.values)
    means = white.select(*[F.sum(F.col("whitened")[j]) for j in range(k)]).first()
    error = covariance(white, "whitened", found.n, k, None, np.array(means) / found.n) - np.eye(k)
    return white, found, float(np.abs(error).max())


def components_of(white: DataFrame, found: Whitening, error: float) -> DataFrame:
    """One row per vector and component: id, component, n, deviation, whitened, explained, identity_error."""
    shares = F.array(*[F.lit(float(v / found.trace)) for v in found.values]) if len(found.values) else F.array().cast("array<double>")
    rows = white.select("id", "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    return rows.select(
        "id", (F.col("_at") + 1).cast("int").alias("component"), F.lit(found.n).cast("long").alias("n"), "deviation",
        "whitened", F.get(shares, F.col("_at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
