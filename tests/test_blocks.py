"""Packed rows of logistic fits: sums of a pass against plain ones."""

from itertools import combinations_with_replacement

import numpy as np
import pytest

from tenfold.models import glmm, glmm_blocks
from tenfold.models.spec import Design


def plain_sums(base, y, p, coef, lever):
    x = np.concatenate([base, p[:, None]], 1)
    left, right = zip(*combinations_with_replacement(range(x.shape[1]), 2))
    products, eta = x[:, left] * x[:, right], x @ coef.T
    mu = 1 / (1 + np.exp(-eta))
    w = mu * (1 - mu)
    dev = 2 * (np.logaddexp(0, eta) - y[:, None] * eta).sum(0)
    return np.concatenate([w.T @ products, (y[:, None] - mu).T @ x, (w * (1 - 2 * mu) * (products @ lever.T)).T @ x, dev[:, None]], 1)


@pytest.mark.parametrize("rows, kinds, size", [(3000, 40, 0.4), (3000, 2900, 0.4), (700, 3, 40.0), (1, 1, 1.0)])
def test_sums_of_packed_rows_are_the_plain_ones(rows, kinds, size):
    rng = np.random.default_rng(rows + kinds)
    design_rows = np.c_[np.ones(kinds), rng.random((kinds, 3)) < 0.4, rng.normal(size=kinds)]
    base, p, y = design_rows[np.sort(rng.integers(0, kinds, rows))], rng.normal(size=rows), (rng.random(rows) < 0.6).astype(float)
    coef, lever = size * rng.normal(size=(5, 6)), rng.normal(size=(5, 21))
    held = glmm_blocks.block(base, y, p)
    assert held.count.sum() == rows and len(held.count) <= rows
    if rows > 50 * kinds:
        assert held.p.shape[0] >= 8 and held.p.size < 1.5 * rows  # equal design rows share a segment
    got = glmm_blocks.block_sums(glmm_blocks.Block.unpack(held.pack(), 5), coef, lever)
    want = plain_sums(base, y, p, coef, lever)
    assert np.abs(got - want).max() <= 1e-10 * np.abs(want).max()


def test_rows_far_out_stay_finite():
    base, y, p = np.ones((3, 1)), np.array([1.0, 0.0, 1.0]), np.array([-900.0, 900.0, 2.0])
    got = glmm_blocks.block_sums(glmm_blocks.block(base, y, p), np.array([[0.0, 1.0]]), np.zeros((1, 3)))
    assert np.isfinite(got).all() and got[0, -1] == pytest.approx(2 * (900 + 900 + np.log1p(np.exp(-2.0))))


def test_a_pass_goes_through_design_rows_not_rows(spark):
    """Rows alike but for response and draw share a segment, whatever their order; rows without a draw are left out of it."""
    rng = np.random.default_rng(6)
    rows = [
        (f"g{i % 2}", "FM"[i // 2 % 2], float(i // 4 % 3), 1.0 + i % 2, float(rng.random() < 0.6), None if i % 50 == 0 else float(rng.normal()))
        for i in rng.permutation(6000).tolist()
    ]
    df = spark.createDataFrame(rows, "g string, sex string, exper double, level double, y double, p1 double").repartition(7)
    design = Design("y", "g", ("p1",), {"sex": ("F", "M")}, (), ("exper",), ("level",))
    table, groups, _ = glmm.coded_rows(df, design, {"exper": 0.0, "level": 0.0, "PV": 0.0, "y": 0.0})
    held = [(r["n"], glmm_blocks.Block.unpack(r["block"], 3)) for r in table.collect()]
    assert groups == ["g0", "g1"] and sum(n for n, _ in held) == sum(b.count.sum() for _, b in held) == 6000 - 120
    assert sum(len(b.count) for _, b in held) < 6000 / 8
    assert sum(b.y.sum() for _, b in held) == sum(r[4] for r in rows if r[5] is not None)
