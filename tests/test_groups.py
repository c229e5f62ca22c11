"""Logistic fits that keep no state per group, against the fits that do."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenfold.models import glmm_groups
from tenfold.models.glmm import fit_logistic
from tenfold.models.runs import RunTable, State, nearest
from tenfold.models.spec import Design, ModelSpec
from tests.test_models import DESIGN, FIXED, SCHEMA, laplace, sample

SPECS = [ModelSpec("a", FIXED), ModelSpec("b", FIXED, ("PV", "sex"))]


@pytest.fixture(scope="module")
def data(spark):
    df = spark.createDataFrame(sample(seed=11, logistic=True), SCHEMA).repartition(5).cache()
    return df, fit_logistic(df, DESIGN, SPECS, modes=True, many_groups=False)


def keyed(df, keys, values):
    return {tuple(r[k] for k in keys): [r[v] for v in values] for r in df.collect()}


def same(a, b, tolerance):
    assert set(a) == set(b)
    for k in a:
        for x, y in zip(a[k], b[k]):
            assert (x is None) == (y is None) and (x is None or abs(x - y) <= tolerance * max(1.0, abs(x))), (k, a[k], b[k])


@pytest.mark.parametrize("block_rows", [10_000, 64])  # groups whole, and most of them spread over blocks
def test_same_results_without_state(data, block_rows):
    df, want = data
    got = fit_logistic(df, DESIGN, SPECS, modes=True, many_groups=True, block_rows=block_rows)
    one = ("spec", "pv")
    same(keyed(want.fits, one, ["n", "groups", "npar", "left_out"]), keyed(got.fits, one, ["n", "groups", "npar", "left_out"]), 0)
    same(keyed(want.fits, one, ["deviance", "aic"]), keyed(got.fits, one, ["deviance", "aic"]), 1e-8)
    assert all(r["converged"] for r in got.fits.collect())
    same(keyed(want.fixed, (*one, "term"), ["est", "se"]), keyed(got.fixed, (*one, "term"), ["est", "se"]), 2e-4)
    parts = (*one, "grp", "term", "term2")
    same(keyed(want.random, parts, ["vcov", "sdcor"]), keyed(got.random, parts, ["vcov", "sdcor"]), 2e-3)
    modes = (*one, "grp", "term")
    same(keyed(want.modes, modes, ["condval", "condsd"]), keyed(got.modes, modes, ["condval", "condsd"]), 1e-3)


def test_passes_move_no_rows(data):
    """A pass reads the bucketed rows where they lie: nothing is exchanged but the sums."""
    df, _ = data
    shift = dict.fromkeys(["train", "exper", "level", "PV", "y"], 0.0)
    blocks = glmm_groups.coded_blocks(df, DESIGN, shift, 64)
    try:
        plan = blocks.table.groupBy("block").applyInPandas(lambda pdf: pdf[["block"]].head(1), "block long")
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
        sizes = [r["count"] for r in blocks.table.groupBy("block").count().collect()]
        assert max(sizes) < 4 * 64 and len(blocks.hot) >= 1  # the group of a third of all rows is in pieces
        assert blocks.table.where("hot < 0").groupBy("grp").agg(F.count_distinct("block").alias("b")).where("b > 1").count() == 0
    finally:
        blocks.drop()


def test_a_level_that_varies_within_a_group_is_refused(spark):
    rows = [("g1", 1.0, 0.5, 0.1), ("g1", 0.0, 0.6, 0.1), ("g2", 1.0, 0.5, 0.3)]
    design = Design("y", "g", ("p1",), {}, (), (), ("level",))
    with pytest.raises(ValueError, match="varies"):
        fit_logistic(spark.createDataFrame(rows, "g string, y double, level double, p1 double"), design, [ModelSpec("m", ("PV",))], many_groups=True)


def test_a_million_groups(spark):
    """Each group twice; the planted intercept, slope and deviation come back, and far more groups than the driver would hold take part."""
    n = 1_000_000
    rows = spark.range(0, 2 * n, 1, 16).select(
        (F.col("id") % n).cast("string").alias("g"), F.randn(5).alias("p1"), F.col("id").alias("id"),
        (F.sqrt(-2 * F.log((F.pmod(F.xxhash64((F.col("id") % n).cast("string")), F.lit(1 << 30)) + 0.5) / (1 << 30)))
         * F.cos(2 * math.pi * F.pmod(F.xxhash64((F.col("id") % n).cast("int")), F.lit(1 << 30)) / (1 << 30))).alias("b"),
    )
    eta = -0.4 + 0.8 * F.col("p1") + 1.2 * F.col("b")
    rows = rows.withColumn("y", (F.rand(9) < 1 / (1 + F.exp(-eta))).cast("double"))
    r = fit_logistic(rows, Design("y", "g", ("p1",)), [ModelSpec("m", ("PV",))])
    fit = r.fits.first()
    assert fit["groups"] == n and fit["n"] == 2 * n and fit["converged"]
    fixed = {x["term"]: x["est"] for x in r.fixed.collect()}
    # the Laplace approximation shrinks both with two rows a group; signs, order and rough size are what it can show
    assert -0.5 < fixed["(Intercept)"] < -0.25 and 0.6 < fixed["PV"] < 0.9


def test_laplace_of_small_groups(spark):
    rng = np.random.default_rng(8)
    rows = []
    for j in range(60):
        b = rng.normal()
        for _ in range(int(rng.integers(1, 6))):
            p = rng.normal()
            rows.append((f"g{j}", float(rng.random() < 1 / (1 + math.exp(-(0.2 + b + 0.6 * p)))), float(p)))
    r = fit_logistic(spark.createDataFrame(rows, "g string, y double, p1 double"), Design("y", "g", ("p1",)), [ModelSpec("m", ("PV",))], many_groups=True)
    x = np.array([[1.0, p] for _, _, p in rows])
    g = np.unique([k for k, _, _ in rows], return_inverse=True)[1]
    y = np.array([v for _, v, _ in rows])
    sd = math.sqrt(r.random.first()["vcov"])
    best = laplace(x, x[:, :1], g, y, np.array([[sd]]))
    assert r.fits.first()["deviance"] == pytest.approx(best[0], abs=1e-6)
    for step in (0.02, -0.02):
        assert laplace(x, x[:, :1], g, y, np.array([[sd + step]]))[0] > best[0] - 1e-9


NESTED = [ModelSpec("one", FIXED), ModelSpec("one_ref", FIXED[:-1]), ModelSpec("two", FIXED, ("PV",)), ModelSpec("three", FIXED, ("PV", "sex"))]


@pytest.mark.parametrize("many_groups", [False, True])
def test_a_lost_driver_goes_on_where_it_stopped(spark, data, many_groups, monkeypatch):
    df, _ = data
    want = fit_logistic(df, DESIGN, NESTED, many_groups=many_groups)
    run = RunTable(spark)
    append, calls = RunTable.append, []

    def lost(self, study, table):
        if len(calls) == 1:
            raise KeyboardInterrupt  # after the first size
        calls.append(study)
        append(self, study, table)

    monkeypatch.setattr(RunTable, "append", lost)
    with pytest.raises(KeyboardInterrupt):
        fit_logistic(df, DESIGN, NESTED, many_groups=many_groups, run=run, study="s")
    monkeypatch.setattr(RunTable, "append", append)
    assert run.finished("s") == {(n, pv) for n in ("one", "one_ref") for pv in (1, 2)} and run.finished("other") == set()
    before = run.rows().where("spec = 'one'").count()
    got = fit_logistic(df, DESIGN, NESTED, many_groups=many_groups, run=RunTable(spark, run.path), study="s")
    assert run.rows().where("spec = 'one'").count() == before  # not fitted again
    one = ("spec", "pv")
    same(keyed(want.fits, one, ["n", "groups", "npar"]), keyed(got.fits, one, ["n", "groups", "npar"]), 0)
    same(keyed(want.fits, one, ["deviance"]), keyed(got.fits, one, ["deviance"]), 1e-8)
    same(keyed(want.fixed, (*one, "term"), ["est", "se"]), keyed(got.fixed, (*one, "term"), ["est", "se"]), 5e-4)
    parts = (*one, "grp", "term", "term2")
    same(keyed(want.random, parts, ["vcov"]), keyed(got.random, parts, ["vcov"]), 3e-3)


def test_nearest_is_the_largest_nested_model():
    state = {("a", 1): State({"(Intercept)": 1.0}, {("(Intercept)", "(Intercept)"): 0.5}), ("b", 1): State({"(Intercept)": 1.0, "PV": 2.0}, {("(Intercept)", "(Intercept)"): 0.7, ("PV", "(Intercept)"): 0.1, ("PV", "PV"): 0.2})}
    assert nearest(state, NESTED[3], 1, DESIGN) is state["b", 1] and nearest(state, NESTED[0], 1, DESIGN) is state["a", 1]
    assert nearest(state, NESTED[3], 2, DESIGN) is None
    assert state["b", 1].factor(["(Intercept)", "PV", "sexM"]).tolist() == [0.7, 0.1, 0.2, 0.0, 0.0, 0.3]
