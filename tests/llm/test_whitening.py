"""Spectrum slicing and whitening against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenfold.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def symmetric(values, seed=0):
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    return (q * np.array(values)) @ q.T


@pytest.mark.parametrize("seed", range(5))
def test_inertia_counts(seed):
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((40, 40))
    a = a + a.T
    if seed == 1:
        a[np.diag_indices(40)] = 0  # needs blocks of two
    values = np.linalg.eigvalsh(a)
    for shift in [*((values[1:] + values[:-1]) / 2), values[0] - 1, values[-1] + 1, 0.0]:
        assert whitening.above(a, shift) == (values > shift).sum()


SPECTRA = {
    "falling": [2.0**-k for k in range(30)],
    "even": list(range(1, 51)),
    "close": [5, 5 - 1e-9, 5 - 1e-13, 3, 3, 3, 1, 1e-3],
    "equal": [1.0] * 12,
    "rank": [4.0, 2.0] + [0.0] * 20,
    "one": [7.0],
}


@pytest.mark.parametrize("name", SPECTRA)
def test_leading(name):
    values = sorted(SPECTRA[name], reverse=True)
    a = symmetric(values)
    a = (a + a.T) / 2
    found, vectors = whitening.leading(a, 8)
    assert np.allclose(found, values[:8], atol=1e-13 * len(values) * max(values))
    assert np.abs(vectors @ vectors.T - np.eye(len(found))).max() < 1e-12
    assert np.abs(vectors @ a - found[:, None] * vectors).max() < 1e-12 * max(values) * len(values)


def taking_part(vectors):
    return [v for v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def plain(vectors, most):
    x = np.floor(64 * np.array(vectors, np.float32).astype(np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    y = n * x - s
    centred = x - s / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    return n, (y.astype(object) ** 2).sum(1).tolist(), centred @ (axes / np.sqrt(values)), values / (centred**2).sum() * n


def checked(rows, ids, vectors, most=32):
    n, deviation, white, share = plain(vectors, most)
    by = {}
    for r in rows:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    k = len(share)
    assert len(rows) == n * k
    signs = {}
    for i, vec in enumerate(ids):
        for c in range(1, k + 1):
            [r] = by[(vec, c)]
            assert r["n"] == n and r["deviation"] == deviation[i]
            assert abs(r["explained"] - share[c - 1]) <= 1e-9 * share[c - 1] and r["identity_error"] < 1e-8
            sign = signs.setdefault(c, math.copysign(1, r["whitened"] * white[i, c - 1]) if abs(white[i, c - 1]) > 1e-3 else None) or 1
            if signs[c] is None:
                del signs[c]
                continue
            assert abs(sign * r["whitened"] - white[i, c - 1]) < 1e-8


def run(spark, data, **kw):
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    for c in ("id", "whitened", "n", "Deviation", "component"):
        df = df.withColumn(c, F.lit("own"))
    rows = whitening.components_of(*whitening.whiten(df, **kw))
    return rows.withColumnRenamed("id", "vec_id").collect()


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(3)
    base = (rng.standard_normal((600, 12)) * np.linspace(1, 4, 12)).astype(np.float32).tolist()
    base[5] = base[6]
    data = [(i, v, 0) for i, v in enumerate(base)]
    bad = [(900, None, 0), (901, [float("nan")] * 12, 0), (902, [None] + [1.0] * 11, 0), (903, [math.inf] * 12, 0)]
    rows = run(spark, data + bad, components=5)
    checked(rows, list(range(600)), base, 5)


def test_edges(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0, 2.0], 0)]) == []  # no variance
    assert run(spark, [(i, [1.0, 2.0], 0) for i in range(5)]) == []
    assert run(spark, [(i, [], 0) for i in range(5)]) == []
    rows = run(spark, [(1, [1.0, 0.0], 0), (2, [3.0], 0), (None, [2.0, 4.0], 0), (None, [2.0, 4.0], 0)])  # a short vector, missing and equal ids
    assert len(rows) == 8 and {r["n"] for r in rows} == {4}
    wide = run(spark, [(i, [float(i), 1e30 * (i == 3)], 0) for i in range(6)])  # beyond whole numbers of 64 bits
    assert len(wide) == 6 and {r["n"] for r in wide} == {6}  # the other component is below the least share
    assert all(r["deviation"] > 2**63 for r in wide)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    data = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    kept = [(i, v) for i, v in data if len(taking_part([v]))]
    found = queries.QUERIES["op11_spectrum_slicing"](spark, sf)
    types = dict(found.dtypes)
    assert (types["component"], types["n"], types["deviation"], types["whitened"]) == ("int", "bigint", "bigint", "double")
    checked(found.collect(), [i for i, _ in kept], [v for _, v in kept])
