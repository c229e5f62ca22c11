"""Models against dense numpy: full covariance, dense Laplace, closed forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenfold.functions import tails
from tenfold.models import lmm, pool
from tenfold.models.fitting import fit_linear
from tenfold.models.glmm import fit_logistic, fit_null
from tenfold.models.ols import nested_f, ols_tables
from tenfold.models.spec import Design, ModelSpec

LEVELS = {"sex": ("F", "M"), "edu": ("high", "low", "mid")}


def sample(seed=3, groups=12, hot=True, logistic=False):
    """Groups of unequal size (one holds a third of all rows), two draws with gaps."""
    rng = np.random.default_rng(seed)
    sizes = rng.integers(25, 60, groups)
    if hot:
        sizes[0] = sizes[1:].sum() // 2
    rows = []
    for j, n in enumerate(sizes):
        level = rng.normal()
        b = rng.normal(size=3) * np.array([0.7, 0.4, 0.5])
        for _ in range(n):
            sex, edu = rng.choice(["F", "M"]), rng.choice(["high", "low", "mid"])
            th, exper, train = rng.normal(), float(rng.integers(0, 15)), float(rng.integers(0, 2))
            eta = 0.3 + b[0] + (0.5 + b[1]) * th + (0.2 + b[2]) * (sex == "M") + 0.3 * (edu == "low") + 0.05 * exper + 0.2 * train + 0.3 * level
            y = float(rng.random() < 1 / (1 + math.exp(-eta))) if logistic else eta + rng.normal() * 0.8
            p1, p2 = th + 0.2 * rng.normal(), th + 0.2 * rng.normal()
            draws = [None if rng.random() < 0.05 else float(p1), None if rng.random() < 0.03 else float(p2)]
            rows.append((f"G{j:02d}", str(sex), str(edu), train, exper, float(level), float(y), *draws))
    rows.append(("G00", None, "low", 1.0, 2.0, rows[0][5], 1.0, 0.1, 0.1))
    rows.append((None,) * 9)
    return rows


SCHEMA = "g string, sex string, edu string, train double, exper double, level double, y double, p1 double, p2 double"
DESIGN = Design("y", "g", ("p1", "p2"), LEVELS, ("train",), ("exper",), ("level",))
FIXED = ("PV", "sex", "edu", "train", "exper", "level")


def dense(rows, pv, slopes=()):
    keep = [r for r in rows if r[1] is not None and r[6 + pv] is not None]
    cols = {
        "(Intercept)": [1.0] * len(keep), "PV": [r[6 + pv] for r in keep], "sexM": [float(r[1] == "M") for r in keep],
        "edulow": [float(r[2] == "low") for r in keep], "edumid": [float(r[2] == "mid") for r in keep],
        "train": [r[3] for r in keep], "exper": [r[4] for r in keep], "level": [r[5] for r in keep],
    }
    x = np.array(list(cols.values())).T
    z = x[:, [0, *[list(cols).index(s) for s in slopes]]]
    g = np.unique([r[0] for r in keep], return_inverse=True)[1]
    return list(cols), x, z, g, np.array([r[6] for r in keep])


@pytest.fixture(scope="module")
def linear(spark):
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA)
    specs = [ModelSpec("a", FIXED), ModelSpec("b", FIXED, ("PV", "sex"))]
    return rows, df, fit_linear(df, DESIGN, specs, tests=True, modes=True)


def test_linear_mixed_against_full_covariance(linear):
    rows, _, r = linear
    slopes = ("PV", "sexM")
    for pv in (1, 2):
        names, x, z, g, y = dense(rows, pv, slopes)
        comp = {(c["term"], c["term2"]): c["vcov"] for c in r.random.where(f"spec = 'b' and pv = {pv}").collect()}
        s2 = comp[None, None]
        terms = ["(Intercept)", *slopes]
        cov = np.array([[comp[a, None] if a == c else comp.get((a, c), comp.get((c, a))) for c in terms] for a in terms])

        def loglik(cov, s2):
            h, rhs, total, parts = 0, 0, 0.0, []
            for j in np.unique(g):
                m = g == j
                v = s2 * np.eye(m.sum()) + z[m] @ cov @ z[m].T
                vi = np.linalg.inv(v)
                h, rhs = h + x[m].T @ vi @ x[m], rhs + x[m].T @ vi @ y[m]
                parts.append((m, vi))
                total += np.linalg.slogdet(v)[1]
            beta = np.linalg.solve(h, rhs)
            for m, vi in parts:
                e = y[m] - x[m] @ beta
                total += e @ vi @ e
            return -0.5 * (total + len(y) * math.log(2 * math.pi)), beta, np.sqrt(np.diag(np.linalg.inv(h)))

        ll, beta, se = loglik(cov, s2)
        fit = r.fits.where(f"spec = 'b' and pv = {pv}").first()
        assert fit["n"] == len(y) and fit["converged"]
        assert fit["loglik"] == pytest.approx(ll, abs=1e-7)
        assert fit["aic"] == pytest.approx(-2 * ll + 2 * (8 + 6 + 1), abs=1e-6)
        fixed = {c["term"]: c for c in r.fixed.where(f"spec = 'b' and pv = {pv}").collect()}
        for i, n in enumerate(names):
            assert fixed[n]["est"] == pytest.approx(beta[i], abs=1e-8)
            assert fixed[n]["se"] == pytest.approx(se[i], abs=1e-8)
            assert fixed[n]["df"] > 0
        # No direction of the variance parameters improves the likelihood.
        for scale in (0.98, 1.02):
            assert loglik(cov * scale, s2)[0] < ll and loglik(cov, s2 * scale)[0] < ll


def test_deletion_tests_and_modes(linear):
    rows, _, r = linear
    t = {x["term"]: x for x in r.tests.where("spec = 'b' and pv = 1").collect()}
    assert set(t) == {"<none>", "PV", "sex"}
    assert t["PV"]["df"] == 3 and t["PV"]["lrt"] == pytest.approx(2 * (t["<none>"]["loglik"] - t["PV"]["loglik"]))
    assert t["PV"]["p"] == pytest.approx(tails.chi2_upper(t["PV"]["lrt"], 3))
    names, x, z, g, y = dense(rows, 1, ())
    f = r.fits.where("spec = 'a' and pv = 1").first()
    beta = {c["term"]: c["est"] for c in r.fixed.where("spec = 'a' and pv = 1").collect()}
    v = r.random.where("spec = 'a' and pv = 1 and grp = 'g'").first()["vcov"]
    modes = {m["grp"]: m for m in r.modes.where("spec = 'a' and pv = 1").collect()}
    e = y - x @ np.array([beta[n] for n in names])
    for j in range(g.max() + 1):
        n, s2 = (g == j).sum(), f["sigma"] ** 2
        m = modes[f"G{j:02d}"]
        assert m["condval"] == pytest.approx(v * e[g == j].sum() / (s2 + n * v), abs=1e-6)
        assert m["condsd"] == pytest.approx(math.sqrt(v * s2 / (s2 + n * v)), abs=1e-6)


def test_many_partitions_and_row_order_do_not_matter(linear):
    _, df, r = linear
    again = fit_linear(df.repartition(13).orderBy(F.rand(1)), DESIGN, [ModelSpec("a", FIXED)])
    a = {(x["pv"], x["term"]): x["est"] for x in r.fixed.where("spec = 'a'").collect()}
    for x in again.fixed.collect():
        assert x["est"] == pytest.approx(a[x["pv"], x["term"]], abs=1e-8)


def test_groups_that_no_task_holds_together(spark):
    rows = sample(groups=8)
    df = spark.createDataFrame(rows, SCHEMA)
    one_draw = Design("y", "g", ("p1",), LEVELS, ("train",), ("exper",), ("level",))
    spec = [ModelSpec("b", FIXED, ("PV",))]
    near = fit_linear(df, one_draw, spec, tests=True, modes=True)
    far = fit_linear(df, one_draw, spec, tests=True, modes=True, many_groups=True)
    assert far.tests.count() == 2
    for x, z in zip(near.tests.orderBy("term").collect(), far.tests.orderBy("term").collect(), strict=True):
        assert x["aic"] == pytest.approx(z["aic"], abs=1e-5) and (x["p"] is None) == (z["p"] is None)
    for part, keys in (("fixed", ["term"]), ("random", ["grp", "term", "term2"]), ("modes", ["grp", "term"])):
        a = {tuple(r[k] for k in keys): r[-2] for r in getattr(near, part).collect()}
        c = {tuple(r[k] for k in keys): r[-2] for r in getattr(far, part).collect()}
        assert a.keys() == c.keys()
        for k in a:
            assert a[k] == pytest.approx(c[k], abs=1e-5)


def test_balanced_closed_form(spark):
    rng = np.random.default_rng(8)
    y = rng.normal(size=(15, 20)) + 0.8 * rng.normal(size=(15, 1))
    df = spark.createDataFrame([(f"g{j}", float(v)) for j in range(15) for v in y[j]], "g string, y double")
    r = fit_linear(df, Design("y", "g"), [ModelSpec("null", ())])
    msw = ((y - y.mean(1, keepdims=True)) ** 2).sum() / (15 * 19)
    between = ((y.mean(1) - y.mean()) ** 2).sum() * 20 / 15
    comp = {x["grp"]: x["vcov"] for x in r.random.collect()}
    assert comp["Residual"] == pytest.approx(msw, rel=1e-6)
    assert comp["g"] == pytest.approx(max(0, (between - msw) / 20), rel=1e-5)


def test_ols_against_numpy(spark):
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA)
    flat = Design("y", None, ("p1", "p2"), LEVELS, ("train",), ("exper", "level"))
    coef, fits = ols_tables(df, flat, [ModelSpec("big", FIXED), ModelSpec("small", ("PV", "sex"))])
    for pv in (1, 2):
        names, x, _, _, y = dense(rows, pv)
        beta, rss, _, _ = np.linalg.lstsq(x, y, rcond=None)
        got = {c["term"]: c for c in coef.where(f"spec = 'big' and pv = {pv}").collect()}
        se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * rss[0] / (len(y) - 8))
        for i, n in enumerate(names):
            assert got[n]["est"] == pytest.approx(beta[i], abs=1e-8) and got[n]["se"] == pytest.approx(se[i], abs=1e-8)
            assert got[n]["high"] - got[n]["est"] == pytest.approx(tails.t_quantile(0.975, len(y) - 8) * se[i], abs=1e-8)
    test = nested_f(fits, "small", "big").where("pv = 1").first()
    assert test["df"] == 5 and 0 <= test["p"] <= 1


def laplace(x, z, g, y, lam):
    q, groups = z.shape[1], g.max() + 1
    zl = z @ lam
    wide = np.zeros((len(y), groups * q))
    for k in range(q):
        wide[np.arange(len(y)), g * q + k] = zl[:, k]
    a = np.concatenate([x, wide], 1)
    pen = np.r_[np.zeros(x.shape[1]), np.ones(groups * q)]
    c = np.zeros(a.shape[1])
    for _ in range(50):
        mu = 1 / (1 + np.exp(-a @ c))
        c += np.linalg.solve(a.T @ (a * (mu * (1 - mu))[:, None]) + np.diag(pen), a.T @ (y - mu) - pen * c)
    eta = a @ c
    mu = 1 / (1 + np.exp(-eta))
    w = (mu * (1 - mu))[:, None]
    h = a.T @ (a * w) + np.diag(pen)
    logdet = np.linalg.slogdet(wide.T @ (wide * w) + np.eye(groups * q))[1]
    dev = 2 * (np.logaddexp(0, eta) - y * eta).sum() + (c[x.shape[1]:] ** 2).sum() + logdet
    return dev, c[: x.shape[1]], np.sqrt(np.diag(np.linalg.inv(h)))[: x.shape[1]]


def test_logistic_mixed_against_dense_laplace(spark):
    rows = sample(seed=11, logistic=True)
    df = spark.createDataFrame(rows, SCHEMA)
    r = fit_logistic(df, DESIGN, [ModelSpec("a", FIXED), ModelSpec("b", FIXED, ("PV", "sex"))], modes=True)
    for spec, slopes in (("a", ()), ("b", ("PV", "sexM"))):
        names, x, z, g, y = dense(rows, 2, slopes)
        comp = {(c["term"], c["term2"]): c["vcov"] for c in r.random.where(f"spec = '{spec}' and pv = 2").collect()}
        terms = ["(Intercept)", *slopes]
        cov = np.array([[comp[a, None] if a == c else comp.get((a, c), comp.get((c, a))) for c in terms] for a in terms])
        lam = np.linalg.cholesky(cov + 1e-13 * np.eye(len(terms)))
        dev, beta, se = laplace(x, z, g, y, lam)
        fit = r.fits.where(f"spec = '{spec}' and pv = 2").first()
        assert fit["converged"] and fit["n"] == len(y)
        assert fit["deviance"] == pytest.approx(dev, abs=1e-5)
        fixed = {c["term"]: c for c in r.fixed.where(f"spec = '{spec}' and pv = 2").collect()}
        for i, n in enumerate(names):
            assert fixed[n]["est"] == pytest.approx(beta[i], abs=1e-5) and fixed[n]["se"] == pytest.approx(se[i], abs=1e-5)
        ix = np.tril_indices(len(terms))
        for k in range(len(ix[0])):
            for step in (0.05, -0.05):
                moved = lam.copy()
                moved[ix[0][k], ix[1][k]] += step
                assert laplace(x, z, g, y, moved)[0] > dev - 1e-6


def test_logistic_null_model(spark):
    rng = np.random.default_rng(4)
    rows = [(f"g{j}", float(rng.random() < p)) for j, p in enumerate(1 / (1 + np.exp(-(0.5 + rng.normal(size=20))))) for _ in range(60)]
    r = fit_null(spark.createDataFrame(rows, "g string, y double"), "y", "g").first()
    g = np.unique([x[0] for x in rows], return_inverse=True)[1]
    y = np.array([x[1] for x in rows])

    def dev(sd, b):
        u = np.zeros(20)
        for _ in range(60):
            mu = 1 / (1 + np.exp(-(b + sd * u[g])))
            u -= (u - sd * np.bincount(g, y - mu, 20)) / (1 + sd * sd * np.bincount(g, mu * (1 - mu), 20))
        eta = b + sd * u[g]
        mu = 1 / (1 + np.exp(-eta))
        return 2 * (np.logaddexp(0, eta) - y * eta).sum() + (u * u).sum() + np.log1p(sd * sd * np.bincount(g, mu * (1 - mu), 20)).sum()

    best = dev(r["sd"], r["intercept"])
    assert r["deviance"] == pytest.approx(best, abs=1e-6)
    for a, b in ((0.02, 0), (-0.02, 0), (0, 0.02), (0, -0.02)):
        assert dev(r["sd"] + a, r["intercept"] + b) > best


def test_dependent_columns_are_left_out():
    x = np.array([[1.0, 2, 2, 0], [1, 3, 3, 0], [1, 5, 5, 0], [1, 1, 1, 0]])
    assert lmm.independent_columns(x.T @ x) == [0, 1]


def test_rubin_pooling(spark):
    est, se = [1.0, 1.2, 0.9], [0.1, 0.2, 0.15]
    df = spark.createDataFrame([("m", i + 1, "x", e, s, 30.0 + i) for i, (e, s) in enumerate(zip(est, se))], "spec string, pv int, term string, est double, se double, df double")
    r = pool.pool_fixed(df, "t").first()
    v = np.mean(np.square(se)) + (1 + 1 / 3) * np.var(est, ddof=1)
    assert r["v"] == pytest.approx(v) and r["df"] == 31 and r["t_value"] == pytest.approx(np.mean(est) / math.sqrt(v))
    assert r["p_value"] == pytest.approx(tails.t_two_sided(r["t_value"], 31), abs=1e-5)
    assert r["reported"] == f"1.033 ({round(math.sqrt(v), 3)})***"


def test_published_tail_values():
    # Likelihood-ratio statistics with 4 degrees of freedom and their printed p values.
    for lrt, p in ((11.031, 0.02622), (50.187, 3.300e-10), (69.749, 2.565e-14), (12.757, 0.01253)):
        assert tails.chi2_upper(lrt, 4) == pytest.approx(p, rel=1e-3)
    assert tails.t_two_sided(2.0, 10) == pytest.approx(0.0733880347707404)
    assert tails.f_upper(3.0, 2, 20) == pytest.approx(1.3**-10)
    assert tails.normal_two_sided(1.959963984540054) == pytest.approx(0.05)
    assert tails.t_quantile(0.975, 10) == pytest.approx(2.2281388519649385)


def test_more_groups_than_a_task_holds(spark):
    """Above GROUPS_PER_TASK the distributed way is taken by itself; a balanced design has a closed form."""
    from tenfold.models import fitting

    k, m = fitting.GROUPS_PER_TASK + 5, 3
    noise = lambda a, b: (F.pmod(F.xxhash64("g", F.lit(a), *b), F.lit(2001)) - 1000) / 1000.0
    df = spark.range(k * m).withColumn("g", (F.col("id") % k).cast("string"))
    df = df.withColumn("y", 5.0 + noise(1, []) + noise(2, ["id"]))
    r = fit_linear(df, Design("y", "g"), [ModelSpec("null", ())], tests=True)
    fit = r.fits.first()
    assert fit["groups"] == k and r.tests.count() == 2
    means = df.groupBy("g").agg(F.avg("y").alias("a"), F.sum(F.col("y") * F.col("y")).alias("s"))
    between, within, grand = means.select(F.var_pop("a"), F.sum(F.col("s") - m * F.col("a") ** 2) / (k * (m - 1)), F.avg("a")).first()
    assert fit["sigma"] ** 2 == pytest.approx(within, rel=1e-5)
    parts = {x["grp"]: x["vcov"] for x in r.random.collect()}
    assert parts["g"] == pytest.approx(between - within / m, rel=1e-4)
    assert r.fixed.first()["est"] == pytest.approx(grand, rel=1e-8)


def test_year_and_its_square_are_both_kept(spark):
    rng = np.random.default_rng(0)
    yr = rng.integers(2000, 2015, 3000).astype(float)
    y = 0.5 * (yr - 2007) ** 2 + rng.normal(size=3000)
    df = spark.createDataFrame([(float(a), float(a * a), float(2 * a), float(v)) for a, v in zip(yr, y)], "yr double, yr2 double, twice double, y double")
    design = Design("y", None, continuous=("yr", "yr2", "twice"))
    coef, fits = ols_tables(df, design, [ModelSpec("a", ("yr", "yr2")), ModelSpec("b", ("yr", "twice", "yr2"))])
    z = yr - 2007
    want, rss, _, _ = np.linalg.lstsq(np.stack([np.ones(3000), z, z * z], 1), y, rcond=None)
    for name, left_out in (("a", 0), ("b", 1)):
        est = {r["term"]: r["est"] for r in coef.where(F.col("spec") == name).collect()}
        assert set(est) == {"(Intercept)", "yr", "yr2"}
        assert est["yr2"] == pytest.approx(want[2], rel=1e-7)
        assert est["yr"] == pytest.approx(want[1] - 2 * 2007 * want[2], rel=1e-7)
        fit = fits.where(F.col("spec") == name).first()
        assert fit["left_out"] == left_out and fit["rss"] == pytest.approx(rss[0], rel=1e-6)


def test_a_value_that_is_no_level_is_missing(spark):
    rows = [("F", 1.0), ("M", 2.0), ("F", 1.5), ("M", 2.5), ("X", 99.0)]
    df = spark.createDataFrame(rows, "sex string, y double")
    _, fits = ols_tables(df, Design("y", None, categories={"sex": ("F", "M")}), [ModelSpec("a", ("sex",))])
    assert fits.first()["n"] == 4


def test_weak_trend_over_a_year_and_its_square_keeps_its_digits(spark):
    """Sums around the means alone leave five digits of the square here."""
    rows = spark.range(60_000).selectExpr("cast(1992 + id % 7 as double) as yr", "cast((id * 48611) % 100003 as double) as y")
    rows = rows.withColumn("yr2", F.col("yr") * F.col("yr"))
    coef, fits = ols_tables(rows, Design("y", None, continuous=("yr", "yr2")), [ModelSpec("a", ("yr", "yr2")), ModelSpec("b", ("yr2",))])
    got = {(r["spec"], r["term"]): r for r in coef.collect()}
    k = np.arange(60_000)
    t, y = (k % 7 - 3).astype(np.longdouble), ((k * 48611) % 100003).astype(np.longdouble)
    a, c = t - t.mean(), t * t - (t * t).mean()
    lean = (a @ c) / (a @ a)
    c -= a * lean
    square = float((c @ y) / (c @ c))
    rss = float(((y - y.mean()) ** 2).sum() - (a @ y) ** 2 / (a @ a) - (c @ y) ** 2 / (c @ c))
    assert got["a", "yr2"]["est"] == pytest.approx(square, rel=1e-8)
    assert got["a", "yr2"]["se"] == pytest.approx(math.sqrt(rss / (60_000 - 3) / float(c @ c)), rel=1e-8)
    assert got["a", "yr"]["est"] == pytest.approx(float((a @ y) / (a @ a) - lean * square) - 2 * 1995 * square, rel=1e-8)
    w = (t + 1995) ** 2
    w -= w.mean()
    assert got["b", "yr2"]["est"] == pytest.approx(float((w @ y) / (w @ w)), rel=1e-8)
    assert {r["left_out"] for r in fits.collect()} == {0}
