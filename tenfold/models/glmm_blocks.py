"""Coded rows packed for the passes of logistic fits, and the sums one pass forms over them.

Rows that differ in nothing but response and draw share a design row, so what a
pass needs of them are sums of powers of the draw: a handful of numbers instead
of the products of all columns.  Rows of one group and draw are laid out as
``length`` layers of segments; a segment belongs to one design row, and its last
layers are filled up where the rows do not suffice.  Where design rows hardly
repeat, segments hold one row each and the work is that of the products.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Doubles in a temporary array of a pass, so that these stay near the processor.
HELD_AT_ONCE = 16_384
#: Work of a segment in that of a row (products with all columns against some twenty numbers).
SEGMENT_COST = 2.5
#: Up to this linear predictor sixteen factors ``1 + exp(-eta)`` can be multiplied before their logarithm is taken.
SAFE_PREDICTOR = 40.0


@dataclass
class Block:
    """Rows of one group and draw."""

    base: np.ndarray  # (segments, columns without the draw)
    count: np.ndarray  # rows per segment
    y: np.ndarray  # sum of the response per segment
    yp: np.ndarray  # sum of response times draw
    p: np.ndarray  # (length, segments), 0 where filled up

    def pack(self) -> bytes:
        length, segments = self.p.shape
        head = np.array([length, segments], dtype=float)
        return np.concatenate([head, self.base.ravel(), self.count, self.y, self.yp, self.p.ravel()]).tobytes()

    @classmethod
    def unpack(cls, held: bytes, columns: int) -> Block:
        a = np.frombuffer(held)
        length, segments = int(a[0]), int(a[1])
        ends = np.cumsum([2, segments * columns, segments, segments, segments, length * segments])
        base, count, y, yp, p = (a[i:j] for i, j in zip(ends, ends[1:]))
        return cls(base.reshape(segments, columns), count, y, yp, p.reshape(length, segments))


def _length(counts: np.ndarray) -> int:
    """Layers that cost least, given the rows per design row."""
    return min((2**i for i in range(7)), key=lambda n: np.ceil(counts / n).sum() * (n + SEGMENT_COST))


def block(base: np.ndarray, y: np.ndarray, p: np.ndarray) -> Block:
    """Rows of one group and draw; rows with equal ``base`` should lie together."""
    first = np.r_[True, (base[1:] != base[:-1]).any(axis=1)]
    starts = np.flatnonzero(first)
    counts = np.diff(np.r_[starts, len(y)])
    length = _length(counts)
    here = np.cumsum(first) - 1
    place = np.arange(len(y)) - starts[here]
    pieces = -(-counts // length)
    segment = (np.cumsum(pieces) - pieces)[here] + place // length
    total = int(pieces.sum())
    laid = np.zeros((length, total))
    laid[place % length, segment] = p
    sums = [np.bincount(segment, w, minlength=total).astype(float) for w in (None, y, y * p)]
    return Block(np.repeat(base[starts], pieces, axis=0), *sums, laid)


def block_sums(b: Block, coef: np.ndarray, lever: np.ndarray) -> np.ndarray:
    """Per fit: weighted Gram (upper triangle), score, leverage vector, deviance.

    ``coef`` holds the fits' coefficients, the draw's last; ``lever`` their weights on the pairs of columns.
    """
    k = b.base.shape[1] + 1
    left, right = np.triu_indices(k)  # the order of combinations_with_replacement
    inner, mixed = right < k - 1, (right == k - 1) & (left < k - 1)
    products = b.base[:, left[inner]] * b.base[:, right[inner]]
    length, segments = b.p.shape
    filled = length - b.count
    mask = (np.arange(length)[:, None] < b.count).astype(float) if filled.any() else None
    powers = [b.p, b.p * b.p]
    powers.append(powers[1] * b.p)
    p_sum, reach = b.p.sum(0), np.abs(b.p).max(0)
    together = min(length, 16)
    out = np.empty((len(coef), len(left) + 2 * k + 1))
    step = max(1, HELD_AT_ONCE // b.p.size)
    z, mu, rest, one = (np.empty((min(step, len(coef)), length, segments)) for _ in range(4))
    for at in range(0, len(coef), step):
        a, slope = coef[at : at + step, :-1] @ b.base.T, coef[at : at + step, -1]
        n = len(a)
        ez, em, er, eo = z[:n], mu[:n], rest[:n], one[:n]
        np.multiply(b.p, -slope[:, None, None], out=ez)
        ez -= a[:, None]
        far = (np.abs(a) + np.abs(slope)[:, None] * reach).max(initial=0.0) > SAFE_PREDICTOR
        if far:  # large predictors stay exact
            logs = np.logaddexp(0.0, ez)
            if mask is not None:
                logs *= mask
            np.minimum(ez, 700.0, out=ez)
        np.exp(ez, out=ez)
        if mask is not None:
            ez *= mask  # what is filled up has a probability of 1 and no weight
        np.add(ez, 1.0, out=eo)
        np.divide(1.0, eo, out=em)
        if far:
            log_sum = logs.sum(axis=(1, 2))
        else:
            log_sum = np.log(np.multiply.reduce(eo.reshape(n, length // together, together, segments), axis=2)).sum(axis=(1, 2))
        np.multiply(ez, em, out=er)  # 1 - mu
        w = np.multiply(er, em, out=eo)
        v = np.subtract(er, em, out=er)
        v *= w
        sums = "fls,ls->fs"
        w0, w1, w2 = w.sum(1), np.einsum(sums, w, powers[0]), np.einsum(sums, w, powers[1])
        m0, m1 = em.sum(1) - filled, np.einsum(sums, em, powers[0])
        v0, v1, v2, v3 = v.sum(1), *(np.einsum(sums, v, q) for q in powers)
        lv = lever[at : at + step]
        h0, h1, h2 = lv[:, inner] @ products.T, lv[:, mixed] @ b.base.T, lv[:, -1:]
        gram = np.empty((n, len(left)))
        gram[:, inner], gram[:, mixed], gram[:, -1] = w0 @ products, w1 @ b.base, w2.sum(1)
        score = np.concatenate([(b.y - m0) @ b.base, (b.yp - m1).sum(1, keepdims=True)], 1)
        reached = np.concatenate(
            [(h0 * v0 + h1 * v1 + h2 * v2) @ b.base, (h0 * v1 + h1 * v2 + h2 * v3).sum(1, keepdims=True)], 1
        )
        # -2 log p = 2 (log(1 + exp(-eta)) + (1 - y) eta)
        linear = a @ (b.count - b.y) + slope * (p_sum - b.yp).sum()
        out[at : at + step] = np.concatenate([gram, score, reached, 2.0 * (log_sum + linear)[:, None]], 1)
    return out
