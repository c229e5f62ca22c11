"""Regression, pooling, linear and logistic mixed models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenfold.catalog import base as b
from tenfold.catalog import tails_sql
from tenfold.catalog.base import query, rounded
from tenfold.functions import tails
from tenfold.functions.recode import significance
from tenfold.models import pool
from tenfold.models.fitting import fit_linear
from tenfold.models.glmm import null_counts
from tenfold.models.moments import cell_draws, cells, gram_sums
from tenfold.models.ols import ols_tables
from tenfold.models.spec import Design, ModelSpec
from tenfold.operators.filters import complete_cases
from tenfold.plans import binding as bind
from tenfold.plans import jobs
from tenfold.plans import studies as st

PV = bind.PV
SCORES = tuple(jobs.pv_names("PVLITNUM", suffix="_s"))
ONE_SCORE = [ModelSpec("score", ("PV",))]

# Long form of the earnings study: one row per respondent and draw.
LONG = (
    "long AS MATERIALIZED ("
    + " UNION ALL ".join(f"SELECT {i} AS pv, Country AS g, PVLITNUM{i}_s AS x, ln(Earnings) AS y FROM study" for i in PV)
    + "), xy AS MATERIALIZED (SELECT * FROM long WHERE x IS NOT NULL AND y IS NOT NULL AND g IS NOT NULL)"
)


def recursive(body: str) -> str:
    return f"RECURSIVE {LONG}, {body}"


def score_design(group=None):
    return Design(response="LogEarnings", group=group, pv=SCORES)


# ---------------------------------------------------------- sums and designs


@query(
    "md_00_grouped_gram",
    "RECURSIVE " + LONG + " SELECT pv, g AS grp, count(*)::DOUBLE AS n, round(sum(x), 8) AS p, round(sum(x * x), 8) AS p_p, "
    "round(sum(x * y), 8) AS p_y, round(sum(y), 8) AS s_y, round(sum(y * y), 8) AS s_y_y FROM xy GROUP BY pv, g",
    ("study",),
)
def md_00(spark, sf_dir):
    # Per group and draw: merge the presence patterns of the cells.
    df = st.earnings_frame(b.study(spark, sf_dir))
    draws = cell_draws(cells(df, score_design("Country")), score_design("Country"))
    out = draws.groupBy("pv", "grp").agg(*[F.sum(c).alias(c) for c in ("n", "p", "p_p", "p_y", "s_y", "s_y_y")])
    return rounded(out, 8)


@query(
    "md_00_gram_sums",
    "SELECT Country, count(*) AS n, round(sum(Schooling), 8) AS Schooling, round(sum(Experience), 8) AS Experience, "
    "round(sum(PVLIT1), 6) AS PVLIT1, round(sum(Schooling * Schooling), 6) AS Schooling__Schooling, "
    "round(sum(Schooling * Experience), 6) AS Schooling__Experience, round(sum(Schooling * PVLIT1), 4) AS Schooling__PVLIT1, "
    "round(sum(Experience * Experience), 6) AS Experience__Experience, round(sum(Experience * PVLIT1), 4) AS Experience__PVLIT1, "
    "round(sum(PVLIT1 * PVLIT1), 3) AS PVLIT1__PVLIT1 FROM clean WHERE Schooling IS NOT NULL AND Experience IS NOT NULL AND "
    "PVLIT1 IS NOT NULL GROUP BY Country",
    ("clean",),
)
def md_00_sums(spark, sf_dir):
    digits = {"PVLIT1": 6, "Schooling__PVLIT1": 4, "Experience__PVLIT1": 4, "PVLIT1__PVLIT1": 3, "Schooling": 8, "Experience": 8}
    out = gram_sums(b.clean(spark, sf_dir), ["Country"], ["Schooling", "Experience", "PVLIT1"])
    return out.select(*[F.round(c, digits.get(c, 6)).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query(
    "md_01_design_matrix",
    "SELECT Country, CASE WHEN Gender = 'M' THEN 1 ELSE 0 END AS GenderM, CASE WHEN STEM = 'STEM' THEN 1 ELSE 0 END AS STEMSTEM, "
    "CASE WHEN Education LIKE 'Bachelor%' THEN 1 ELSE 0 END AS EducationBachelor, CASE WHEN Education LIKE 'High%' THEN 1 ELSE 0 END "
    "AS EducationHigh, CASE WHEN Education LIKE 'Some%' THEN 1 ELSE 0 END AS EducationSome, Experience, Experience * Experience "
    "AS Experience2 FROM study WHERE Gender IS NOT NULL AND STEM IS NOT NULL AND Education IS NOT NULL AND Experience IS NOT NULL",
    ("study",),
)
def md_01(spark, sf_dir):
    df = b.study(spark, sf_dir)
    design = st.study_design(df, "Earnings", "lnm")
    rows = complete_cases(df, ["Gender", "STEM", "Education", "Experience"])
    dummies = [
        F.when(F.col(c) == lv, 1).otherwise(0).alias(f"{c}{lv}".split()[0].replace("'s", ""))
        for c in ("Gender", "STEM", "Education")
        for lv in design.categories[c][1:]
    ]
    return rows.select("Country", *dummies, "Experience", (F.col("Experience") * F.col("Experience")).alias("Experience2"))


# -------------------------------------------------- least squares and pooling

# Centred sums of the three predictors, the inverse by cofactors.
_OLS3 = """WITH m AS (SELECT avg(x1) AS a1, avg(x2) AS a2, avg(x3) AS a3, avg(y) AS ay, count(*)::DOUBLE AS n FROM d),
    s AS (SELECT n, a1, a2, a3, ay, sum((x1-a1)*(x1-a1)) AS s11, sum((x1-a1)*(x2-a2)) AS s12, sum((x1-a1)*(x3-a3)) AS s13,
      sum((x2-a2)*(x2-a2)) AS s22, sum((x2-a2)*(x3-a3)) AS s23, sum((x3-a3)*(x3-a3)) AS s33, sum((x1-a1)*(y-ay)) AS t1,
      sum((x2-a2)*(y-ay)) AS t2, sum((x3-a3)*(y-ay)) AS t3, sum((y-ay)*(y-ay)) AS tss FROM d, m GROUP BY ALL),
    c AS (SELECT *, s22*s33-s23*s23 AS c11, s13*s23-s12*s33 AS c12, s12*s23-s13*s22 AS c13, s11*s33-s13*s13 AS c22,
      s12*s13-s11*s23 AS c23, s11*s22-s12*s12 AS c33 FROM s),
    e AS (SELECT *, s11*c11+s12*c12+s13*c13 AS det FROM c),
    f AS (SELECT *, (c11*t1+c12*t2+c13*t3)/det AS b1, (c12*t1+c22*t2+c23*t3)/det AS b2, (c13*t1+c23*t2+c33*t3)/det AS b3 FROM e),
    g AS (SELECT *, ay-b1*a1-b2*a2-b3*a3 AS b0, tss-b1*t1-b2*t2-b3*t3 AS rss FROM f),
    h AS (SELECT *, rss/(n-4) AS s2, (c11*a1*a1+c22*a2*a2+c33*a3*a3+2*c12*a1*a2+2*c13*a1*a3+2*c23*a2*a3)/det+1/n AS v0 FROM g)"""
_OLS3_ROWS = (
    "d AS MATERIALIZED (SELECT Schooling AS x1, Experience AS x2, Experience * Experience AS x3, ln(Earnings) AS y FROM study "
    "WHERE Earnings IS NOT NULL AND Schooling IS NOT NULL AND Experience IS NOT NULL), "
)
_OLS3 = "RECURSIVE " + _OLS3_ROWS + _OLS3[5:]


@query(
    "md_02_earnings_equation",
    _OLS3 + " SELECT term, round(est, 8) AS est, round(sqrt(var), 8) AS se, round(est / sqrt(var), 6) AS t FROM ("
    "SELECT '(Intercept)' AS term, b0 AS est, s2*v0 AS var FROM h UNION ALL SELECT 'Schooling', b1, s2*c11/det FROM h UNION ALL "
    "SELECT 'Experience', b2, s2*c22/det FROM h UNION ALL SELECT 'I(Experience^2)', b3, s2*c33/det FROM h)",
    ("study",),
)
def md_02(spark, sf_dir):
    coef, _, _ = st.earnings_equations(b.study(spark, sf_dir))
    c = coef.where("spec = 'quadratic'")
    return c.select("term", F.round("est", 8).alias("est"), F.round("se", 8).alias("se"), F.round("t", 6).alias("t"))


@query(
    "md_02_equation_fit",
    _OLS3 + " SELECT n, round(rss, 6) AS rss, round(sqrt(s2), 8) AS sigma, round(1-rss/tss, 8) AS r2, "
    "round(1-rss/tss*(n-1)/(n-4), 8) AS adj_r2, round((tss-rss)/3/s2, 6) AS f FROM h",
    ("study",),
)
def md_02_fit(spark, sf_dir):
    _, fits, _ = st.earnings_equations(b.study(spark, sf_dir))
    return fits.where("spec = 'quadratic'").select(
        "n", F.round("rss", 6).alias("rss"), F.round("sigma", 8).alias("sigma"), F.round("r2", 8).alias("r2"),
        F.round("adj_r2", 8).alias("adj_r2"), F.round("f", 6).alias("f"),
    )


@query(
    "md_03_exponentiated_aic",
    _OLS3 + " SELECT round(exp(b0), 7) AS e0, round(exp(b1), 7) AS e1, round(exp(b2), 7) AS e2, round(exp(b3), 7) AS e3, "
    "round(n*(ln(2*pi()*rss/n)+1)+10, 6) AS aic FROM h",
    ("study",),
)
def md_03(spark, sf_dir):
    coef, fits, _ = st.earnings_equations(b.study(spark, sf_dir))
    terms = ["(Intercept)", "Schooling", "Experience", "I(Experience^2)"]
    c = coef.where("spec = 'quadratic'").groupBy("pv").agg(
        *[F.round(F.max(F.when(F.col("term") == t, F.col("exp_est"))), 7).alias(f"e{i}") for i, t in enumerate(terms)]
    )
    aic = fits.where("spec = 'quadratic'").select("pv", F.round("aic", 6).alias("aic"))
    return c.join(aic, "pv").drop("pv")


@query(
    "md_02_year_and_square",
    "WITH d AS (SELECT year(o_orderdate)::DOUBLE AS yr, o_totalprice::DOUBLE AS y FROM orders), "
    "m AS (SELECT avg(yr) AS a, avg(y) AS ay, avg(power(yr - (SELECT avg(yr) FROM d), 2)) AS aw FROM d), "
    "s AS (SELECT a, ay, aw, count(*)::DOUBLE AS n, sum((yr-a)*(yr-a)) AS s11, sum((yr-a)*(power(yr-a, 2)-aw)) AS s12, "
    "sum(power(power(yr-a, 2)-aw, 2)) AS s22, sum((yr-a)*(y-ay)) AS t1, sum((power(yr-a, 2)-aw)*(y-ay)) AS t2, "
    "sum((y-ay)*(y-ay)) AS tss FROM d, m GROUP BY ALL), "
    "e AS (SELECT *, s11*s22-s12*s12 AS det, (t1*s22-t2*s12)/(s11*s22-s12*s12) AS b1, (t2*s11-t1*s12)/(s11*s22-s12*s12) AS b2 FROM s), "
    "f AS (SELECT *, (tss-b1*t1-b2*t2)/(n-3) AS s2 FROM e) "
    "SELECT round(b2, 1) AS square, round(sqrt(s2*s11/det), 1) AS square_se, round(b1-2*b2*a, -3) AS year, "
    "round((tss-(n-3)*s2)/tss, 8) AS r2, 0 AS left_out FROM f",
)
def md_02_year(spark, sf_dir):
    """A column and its square, far from zero: solvable only around the means."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    yr = F.year("o_orderdate").cast("double")
    rows = orders.select(yr.alias("yr"), (yr * yr).alias("yr2"), F.col("o_totalprice").cast("double").alias("y"))
    coef, fits = ols_tables(rows, Design("y", None, continuous=("yr", "yr2")), [ModelSpec("trend", ("yr", "yr2"))])
    of = lambda c, t: F.max(F.when(F.col("term") == t, F.col(c)))
    wide = coef.groupBy("spec").agg(of("est", "yr2").alias("b"), of("se", "yr2").alias("s"), of("est", "yr").alias("y"))
    return wide.join(fits, "spec").select(
        F.round("b", 1).alias("square"), F.round("s", 1).alias("square_se"), F.round("y", -3).alias("year"),
        F.round("r2", 8).alias("r2"), "left_out",
    )


# Both equations with their variances, then the t quantile by bisection on the two-sided tail.
_EQUATIONS = (
    _OLS3
    + """, two AS (SELECT *, s11*s22-s12*s12 AS det2, (t1*s22-t2*s12)/(s11*s22-s12*s12) AS q1, (t2*s11-t1*s12)/(s11*s22-s12*s12) AS q2 FROM h),
    two2 AS (SELECT *, (tss-q1*t1-q2*t2)/(n-3) AS v2 FROM two),
    eq AS MATERIALIZED (
      SELECT 'quadratic' AS spec, '(Intercept)' AS term, b0 AS est, s2*v0 AS var, n-4 AS df FROM h UNION ALL
      SELECT 'quadratic', 'Schooling', b1, s2*c11/det, n-4 FROM h UNION ALL SELECT 'quadratic', 'Experience', b2, s2*c22/det, n-4 FROM h UNION ALL
      SELECT 'quadratic', 'I(Experience^2)', b3, s2*c33/det, n-4 FROM h UNION ALL
      SELECT 'linear', '(Intercept)', ay-q1*a1-q2*a2, v2*((s22*a1*a1+s11*a2*a2-2*s12*a1*a2)/det2+1/n), n-3 FROM two2 UNION ALL
      SELECT 'linear', 'Schooling', q1, v2*s22/det2, n-3 FROM two2 UNION ALL SELECT 'linear', 'Experience', q2, v2*s11/det2, n-3 FROM two2),
    tq(df, lo, hi, it) AS (SELECT DISTINCT df, 0e0, 16e0, 0 FROM eq UNION ALL
      SELECT df, CASE WHEN p > 0.05e0 THEN mid ELSE lo END, CASE WHEN p > 0.05e0 THEN hi ELSE mid END, it + 1 FROM (
        SELECT df, lo, hi, mid, it, """
    + tails_sql.t_p("mid", "df")
    + """ AS p FROM (SELECT df, lo, hi, (lo+hi)/2 AS mid, it FROM tq WHERE it < 60)))"""
)


@query(
    "md_03_confidence_interval",
    _EQUATIONS + " SELECT spec, term, round(est-q*sqrt(var), 7) AS low, round(est+q*sqrt(var), 7) AS high, round("
    + tails_sql.t_p("t", "df") + ", 8) AS p FROM (SELECT eq.*, est/sqrt(var) AS t, (lo+hi)/2 AS q FROM eq JOIN tq ON tq.df = eq.df AND it = 60)",
    ("study",),
)
def md_03_interval(spark, sf_dir):
    coef, _, _ = st.earnings_equations(b.study(spark, sf_dir))
    return coef.select("spec", "term", F.round("low", 7).alias("low"), F.round("high", 7).alias("high"), F.round("p", 8).alias("p"))


@query(
    "md_04_nested_f",
    _OLS3 + ", r AS (SELECT (t1*s22-t2*s12)/(s11*s22-s12*s12) AS q1, (t2*s11-t1*s12)/(s11*s22-s12*s12) AS q2 FROM h) "
    "SELECT n-3 AS df_small, n-4 AS df_large, round(tss-q1*t1-q2*t2, 6) AS rss_small, round(rss, 6) AS rss_large, "
    "round((tss-q1*t1-q2*t2-rss)/s2, 5) AS f FROM h, r",
    ("study",),
)
def md_04(spark, sf_dir):
    _, _, test = st.earnings_equations(b.study(spark, sf_dir))
    return test.select(
        "df_small", "df_large", F.round("rss_small", 6).alias("rss_small"), F.round("rss_large", 6).alias("rss_large"),
        F.round("f", 5).alias("f"),
    )


@query(
    "md_04_nested_f_p",
    _EQUATIONS + " SELECT df_large + 1 AS df_small, df_large, 1e0 AS df, round(f, 5) AS f, round("
    + tails_sql.f_p("f", "1e0", "df_large") + ", 8) AS p FROM (SELECT n-4 AS df_large, (tss-q1*t1-q2*t2-rss)/s2 AS f FROM two)",
    ("study",),
)
def md_04_p(spark, sf_dir):
    _, _, test = st.earnings_equations(b.study(spark, sf_dir))
    return test.select("df_small", "df_large", F.col("df").cast("double").alias("df"), F.round("f", 5).alias("f"), F.round("p", 8).alias("p"))


_SLOPES = (
    "fit AS MATERIALIZED (SELECT pv, count(*)::DOUBLE AS n, regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0, regr_sxx(y, x) AS sxx, "
    "avg(x) AS mx, (regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x)) AS rss FROM xy GROUP BY pv), "
    "est AS MATERIALIZED (SELECT pv, '(Intercept)' AS term, b0 AS est, sqrt(rss/(n-2)*(1/n+mx*mx/sxx)) AS se FROM fit UNION ALL "
    "SELECT pv, 'PV', b1, sqrt(rss/(n-2)/sxx) FROM fit)"
)


def _score_tables(spark, sf_dir):
    return ols_tables(st.earnings_frame(complete_cases(b.study(spark, sf_dir), ["Country"])), score_design(), ONE_SCORE)


@query(
    "md_12_regression_per_draw",
    recursive(_SLOPES) + " SELECT pv, term, round(est, 8) AS est, round(se, 8) AS se FROM est",
    ("study",),
)
def md_12(spark, sf_dir):
    coef, _ = _score_tables(spark, sf_dir)
    return rounded(coef.select("pv", "term", "est", "se"), 8)


_RUBIN = (
    "SELECT term, avg(est) AS theta, var_samp(est) AS b, avg(se*se) AS u, avg(se*se) + 1.1e0*var_samp(est) AS v FROM est GROUP BY term"
)
_TEXT = "rtrim(rtrim(printf('%.3f', round({0}, 3)), '0'), '.')"


@query(
    "md_13_pooled_regression",
    recursive(_SLOPES) + " SELECT term, round(theta, 8) AS theta, round(b, 10) AS b, round(u, 10) AS u, round(v, 10) AS v, "
    f"round(sqrt(v), 8) AS se_new, round(theta/sqrt(v), 6) AS z_value FROM ({_RUBIN})",
    ("study",),
)
def md_13(spark, sf_dir):
    coef, _ = _score_tables(spark, sf_dir)
    p = pool.pool_fixed(coef.select("spec", "pv", "term", "est", "se"), "z")
    return p.select(
        "term", F.round("theta", 8).alias("theta"), F.round("b", 10).alias("b"), F.round("u", 10).alias("u"),
        F.round("v", 10).alias("v"), F.round("se_new", 8).alias("se_new"), F.round("z_value", 6).alias("z_value"),
    )


# The report string of the rounded estimate, its spread and the marks of the rounded p.
_NUMBER = "CASE WHEN {0} IN ('-0', '') THEN '0' ELSE {0} END"
_REPORT = (
    "round(theta, 6) AS theta, round(se_new, 6) AS se_new, p_value, "
    + tails_sql.stars("p_value") + " AS p_sign, " + _NUMBER.format(_TEXT.format("theta")) + " || ' (' || " + _NUMBER.format(_TEXT.format("se_new"))
    + " || ')' || " + tails_sql.stars("p_value") + " AS reported"
)


def _reported(pooled, stat: str, digits: int):
    return pooled.select(
        "term", F.round("theta", 6).alias("theta"), F.round("se_new", 6).alias("se_new"), "p_value", "p_sign", "reported",
        F.round(stat, digits).alias(stat), *(["df"] if "df" in pooled.columns else []),
    )


@query(
    "md_13_pooled_report",
    recursive(_SLOPES) + f" SELECT term, {_REPORT}, round(z_value, 5) AS z_value FROM (SELECT *, round(" + tails_sql.normal_p("z_value")
    + f", 5) AS p_value FROM (SELECT term, theta, sqrt(v) AS se_new, theta/sqrt(v) AS z_value FROM ({_RUBIN})))",
    ("study",),
)
def md_13_report(spark, sf_dir):
    coef, _ = _score_tables(spark, sf_dir)
    return _reported(pool.pool_fixed(coef.select("spec", "pv", "term", "est", "se"), "z"), "z_value", 5)


@query(
    "md_15_stars",
    "SELECT Country, Education, round(p, 5) AS p, CASE WHEN round(p, 5) <= 0.001e0 THEN '***' WHEN round(p, 5) <= 0.01e0 THEN '**' "
    "WHEN round(p, 5) <= 0.05e0 THEN '*' WHEN round(p, 5) <= 0.1e0 THEN '.' ELSE '' END AS p_sign FROM (SELECT Country, Education, "
    "(count(*) - count(Earnings)) / count(*) / 10 AS p FROM clean GROUP BY ALL)",
    ("clean",),
)
def md_15(spark, sf_dir):
    share = F.count_if(F.col("Earnings").isNull()) / F.count(F.lit(1)) / 10
    out = b.clean(spark, sf_dir).groupBy("Country", "Education").agg(F.round(share, 5).alias("p"))
    return out.withColumn("p_sign", significance(F.col("p")))


# ------------------------------------------- linear mixed models, random intercept
#
# With one score and a random intercept the deviance has one free parameter,
# lambda = variance ratio.  The SQL finds its root by bisection on log lambda:
# every group enters through six sums.

_GROUP_SUMS = (
    "gs AS MATERIALIZED (SELECT pv, g, count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x*x) AS sxx, sum(x*y) AS sxy, "
    "sum(y*y) AS syy FROM xy GROUP BY pv, g)"
)


def _solve_sql(lam: str, source: str) -> str:
    """GLS estimates at the ratio held in column ``lam`` of ``source`` (pv, lam)."""
    return f"""SELECT pv, lam, nn, (a22*h1-a12*h2)/(a11*a22-a12*a12) AS b0, (a11*h2-a12*h1)/(a11*a22-a12*a12) AS b1,
      a11, a12, a22, yy, h1, h2, ld FROM (SELECT gs.pv, lam, sum(n) AS nn, sum(n-w*n*n) AS a11, sum(sx-w*n*sx) AS a12,
      sum(sxx-w*sx*sx) AS a22, sum(sy-w*n*sy) AS h1, sum(sxy-w*sx*sy) AS h2, sum(syy-w*sy*sy) AS yy, sum(ln(1+lam*n)) AS ld
      FROM (SELECT gs.*, lam, lam/(1+lam*gs.n) AS w FROM gs JOIN {source} q ON q.pv = gs.pv) gs GROUP BY gs.pv, lam)"""


_BISECT = (
    _GROUP_SUMS
    + """, br(pv, lo, hi, it) AS (SELECT DISTINCT pv, ln(1e-8), ln(1e4), 0 FROM gs UNION ALL
    SELECT z.pv, CASE WHEN z.slope < 0 THEN (z.lo+z.hi)/2 ELSE z.lo END, CASE WHEN z.slope < 0 THEN z.hi ELSE (z.lo+z.hi)/2 END, z.it+1
    FROM (SELECT t.pv, t.lo, t.hi, t.it, sum(gs.n/(1+t.lam*gs.n)) - any_value(t.nn/t.r2) *
        sum(((gs.sy-t.b0*gs.n-t.b1*gs.sx)/(1+t.lam*gs.n))**2) AS slope
      FROM (SELECT s.*, s.yy-s.b0*s.h1-s.b1*s.h2 AS r2, q0.lo, q0.hi, q0.it FROM ("""
    + _solve_sql("lam", "(SELECT pv, exp((lo+hi)/2) AS lam FROM br WHERE it < 70)")
    + """) s JOIN br q0 ON q0.pv = s.pv) t JOIN gs ON gs.pv = t.pv GROUP BY t.pv, t.lo, t.hi, t.it) z),
    opt AS MATERIALIZED (SELECT s.*, yy-b0*h1-b1*h2 AS r2, (yy-b0*h1-b1*h2)/nn AS s2, a11*a22-a12*a12 AS det,
      ld+nn*(1+ln(2*pi()*(yy-b0*h1-b1*h2)/nn)) AS dev FROM ("""
    + _solve_sql("lam", "(SELECT pv, exp((lo+hi)/2) AS lam FROM br WHERE it = 70)")
    + """) s),
    est AS MATERIALIZED (SELECT pv, '(Intercept)' AS term, b0 AS est, sqrt(s2*a22/det) AS se FROM opt UNION ALL
      SELECT pv, 'PV', b1, sqrt(s2*a11/det) FROM opt)"""
)


def _intercept_models(spark, sf_dir, **options):
    df = st.earnings_frame(b.study(spark, sf_dir))
    return fit_linear(df, score_design("Country"), ONE_SCORE, **options)


@query(
    "md_06_mixed_random_intercept",
    recursive(_BISECT) + " SELECT pv, term, round(est, 6) AS est, round(se, 6) AS se FROM est",
    ("study",),
)
def md_06(spark, sf_dir):
    r = _intercept_models(spark, sf_dir)
    return rounded(r.fixed.select("pv", "term", "est", "se"), 6)


@query(
    "md_06_mixed_fit",
    recursive(_BISECT) + " SELECT pv, nn AS n, round(dev, 6) AS deviance, round(dev+8, 6) AS aic, round(sqrt(s2), 6) AS sigma FROM opt",
    ("study",),
)
def md_06_fit(spark, sf_dir):
    r = _intercept_models(spark, sf_dir)
    return rounded(r.fits.select("pv", "n", "deviance", "aic", "sigma"), 6)


_NULL_ROWS = (
    "xy AS MATERIALIZED (SELECT 0 AS pv, Country AS g, 0e0 AS x, ln(Earnings) AS y FROM study WHERE Earnings IS NOT NULL AND "
    "Country IS NOT NULL)"
)
_NULL_SOLVE = (
    "SELECT pv, lam, nn, h1/a11 AS b0, 0e0 AS b1, a11, yy, h1, 0e0 AS h2, ld FROM (SELECT gs.pv, lam, sum(n) AS nn, sum(n-w*n*n) AS a11, "
    "sum(sy-w*n*sy) AS h1, sum(syy-w*sy*sy) AS yy, sum(ln(1+lam*n)) AS ld FROM (SELECT gs.*, lam, lam/(1+lam*gs.n) AS w FROM gs "
    "JOIN {0} q ON q.pv = gs.pv) gs GROUP BY gs.pv, lam)"
)
_NULL_BISECT = (
    _GROUP_SUMS
    + """, br(pv, lo, hi, it) AS (SELECT DISTINCT pv, ln(1e-8), ln(1e4), 0 FROM gs UNION ALL
    SELECT z.pv, CASE WHEN z.slope < 0 THEN (z.lo+z.hi)/2 ELSE z.lo END, CASE WHEN z.slope < 0 THEN z.hi ELSE (z.lo+z.hi)/2 END, z.it+1
    FROM (SELECT t.pv, t.lo, t.hi, t.it, sum(gs.n/(1+t.lam*gs.n)) - any_value(t.nn/t.r2) *
        sum(((gs.sy-t.b0*gs.n)/(1+t.lam*gs.n))**2) AS slope
      FROM (SELECT s.*, s.yy-s.b0*s.h1 AS r2, q0.lo, q0.hi, q0.it FROM ("""
    + _NULL_SOLVE.format("(SELECT pv, exp((lo+hi)/2) AS lam FROM br WHERE it < 70)")
    + """) s JOIN br q0 ON q0.pv = s.pv) t JOIN gs ON gs.pv = t.pv GROUP BY t.pv, t.lo, t.hi, t.it) z),
    opt AS MATERIALIZED (SELECT s.*, (yy-b0*h1)/nn AS s2, ld+nn*(1+ln(2*pi()*(yy-b0*h1)/nn)) AS dev FROM ("""
    + _NULL_SOLVE.format("(SELECT pv, exp((lo+hi)/2) AS lam FROM br WHERE it = 70)")
    + ") s)"
)


@query(
    "md_05_mixed_null",
    f"RECURSIVE {_NULL_ROWS}, {_NULL_BISECT} SELECT nn AS n, round(b0, 6) AS est, round(sqrt(s2/a11), 6) AS se, round(lam*s2, 6) AS variance, "
    "round(s2, 6) AS residual, round(dev, 6) AS deviance, round(dev+6, 6) AS aic FROM opt",
    ("study",),
)
def md_05(spark, sf_dir):
    r = st.earnings_null_model(b.study(spark, sf_dir))
    parts = r.random.groupBy("pv").agg(
        F.max(F.when(F.col("grp") == "Country", F.col("vcov"))).alias("variance"),
        F.max(F.when(F.col("grp") == "Residual", F.col("vcov"))).alias("residual"),
    )
    out = r.fits.join(r.fixed.select("pv", "est", "se"), "pv").join(parts, "pv")
    return rounded(out.select("n", "est", "se", "variance", "residual", "deviance", "aic"), 6)


@query(
    "md_14_pooled_mixed",
    recursive(_BISECT) + " SELECT term, round(theta, 6) AS theta, round(b, 8) AS b, round(u, 8) AS u, round(v, 8) AS v, "
    f"round(sqrt(v), 6) AS se_new, round(theta/sqrt(v), 4) AS t_value FROM ({_RUBIN})",
    ("study",),
)
def md_14(spark, sf_dir):
    p = pool.pool_fixed(_intercept_models(spark, sf_dir).fixed, "t")
    return p.select(
        "term", F.round("theta", 6).alias("theta"), F.round("b", 8).alias("b"), F.round("u", 8).alias("u"), F.round("v", 8).alias("v"),
        F.round("se_new", 6).alias("se_new"), F.round("t_value", 4).alias("t_value"),
    )


# Approximate degrees of freedom: derivatives of the variances and of the deviance by the
# factor (the root of the ratio) and by the residual deviation, in closed form.
_DF = (
    _BISECT
    + """, ds AS (SELECT pv, sum(w1*n*n) AS k11, sum(w1*n*sx) AS k12, sum(w1*sx*sx) AS k22, sum(w1*n*e) AS q1, sum(w1*sx*e) AS q2,
      sum(w1*e*e) AS r1, sum(w2*e*e) AS r2, sum(l2) AS l2 FROM (
        SELECT gs.pv, n, sx, sy-b0*n-b1*sx AS e, 2*sqrt(lam)/(1+lam*n)**2 AS w1, 2/(1+lam*n)**2-8*lam*n/(1+lam*n)**3 AS w2,
          2*n/(1+lam*n)-4*lam*n*n/(1+lam*n)**2 AS l2 FROM gs JOIN opt USING (pv)) GROUP BY pv),
    dh AS (SELECT o.pv, a22/det AS i11, -a12/det AS i12, a11/det AS i22, s2, sqrt(s2) AS sg, nn, k11, k12, k22, q1, q2, d.r1 AS r1, d.r2 AS r2, l2
      FROM opt o JOIN ds d ON d.pv = o.pv),
    dv AS (SELECT *, l2+(-r2-2*(i11*q1*q1+2*i12*q1*q2+i22*q2*q2))/s2 AS g11, 2*r1/(s2*sg) AS g12, 4*nn/s2 AS g22,
      s2*(i11*i11*k11+2*i11*i12*k12+i12*i12*k22) AS j1, s2*(i12*i12*k11+2*i12*i22*k12+i22*i22*k22) AS j2 FROM dh),
    df AS MATERIALIZED (SELECT pv, '(Intercept)' AS term, 2*(s2*i11)**2 / (2*(g22*j1*j1-2*g12*j1*(2*sg*i11)+g11*(2*sg*i11)**2)/(g11*g22-g12*g12)) AS df FROM dv
      UNION ALL SELECT pv, 'PV', 2*(s2*i22)**2 / (2*(g22*j2*j2-2*g12*j2*(2*sg*i22)+g11*(2*sg*i22)**2)/(g11*g22-g12*g12)) FROM dv)"""
)


@query(
    "md_14_pooled_report",
    recursive(_DF) + f" SELECT term, {_REPORT}, round(t_value, 4) AS t_value, df FROM (SELECT *, round(" + tails_sql.t_p("t_value", "df")
    + ", 5) AS p_value FROM (SELECT term, theta, sqrt(v) AS se_new, theta/sqrt(v) AS t_value, df FROM "
    f"({_RUBIN}) JOIN (SELECT term, round_even(avg(df), 0) AS df FROM df GROUP BY term) USING (term)))",
    ("study",),
)
def md_14_report(spark, sf_dir):
    return _reported(pool.pool_fixed(_intercept_models(spark, sf_dir).fixed, "t"), "t_value", 4)


@query(
    "md_08_approximate_df",
    recursive(_DF) + " SELECT pv, term, round(est, 6) AS est, round(se, 6) AS se, round(df, 1) AS df FROM est JOIN df USING (pv, term)",
    ("study",),
)
def md_08(spark, sf_dir):
    r = _intercept_models(spark, sf_dir).fixed
    return rounded(r.select("pv", "term", "est", "se", F.round("df", 1).alias("df")), 6)


@query(
    "md_16_pooled_components",
    recursive(_BISECT) + " SELECT component, round(avg(v), 6) AS variance, round(avg(sqrt(v)), 6) AS std, "
    + _TEXT.format("avg(v)") + " || ' (' || " + _TEXT.format("avg(sqrt(v))") + " || ')' AS reported FROM ("
    "SELECT 'Country-(Intercept)-NA' AS component, lam*s2 AS v FROM opt UNION ALL SELECT 'Residual-NA-NA', s2 FROM opt) GROUP BY component",
    ("study",),
)
def md_16(spark, sf_dir):
    return rounded(pool.pool_random(_intercept_models(spark, sf_dir).random).drop("spec"), 6)


@query("md_17_pooled_aic", recursive(_BISECT) + " SELECT 'score' AS spec, round(avg(dev+8), 6) AS aic FROM opt", ("study",))
def md_17(spark, sf_dir):
    return rounded(pool.pool_aic(_intercept_models(spark, sf_dir).fits), 6)


@query(
    "md_19_aic_table",
    recursive(_BISECT) + ", o AS (SELECT avg(n*(ln(2*pi()*rss/n)+1)+6) AS aic FROM (SELECT pv, count(*)::DOUBLE AS n, regr_syy(y, x) - "
    "regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x) AS rss FROM xy GROUP BY pv)) SELECT spec, round(aic, 6) AS aic, "
    "row_number() OVER (ORDER BY aic) AS place FROM (SELECT 'random intercept' AS spec, avg(dev+8) AS aic FROM opt UNION ALL "
    "SELECT 'no random part', aic FROM o)",
    ("study",),
)
def md_19(spark, sf_dir):
    df = st.earnings_frame(complete_cases(b.study(spark, sf_dir), ["Country"]))
    _, flat = ols_tables(df, score_design(), ONE_SCORE)
    mixed = fit_linear(df, score_design("Country"), ONE_SCORE)
    both = pool.pool_aic(flat.withColumn("spec", F.lit("no random part"))).unionByName(
        pool.pool_aic(mixed.fits.withColumn("spec", F.lit("random intercept")))
    )
    rows = pool.aic_table(both).collect()  # one row per model
    return spark.createDataFrame([(r["spec"], round(r["aic"], 6), i + 1) for i, r in enumerate(rows)], "spec string, aic double, place long")


@query(
    "md_20_random_term_test",
    recursive(_BISECT) + ", o AS (SELECT pv, n*(ln(2*pi()*rss/n)+1) AS dev0 FROM (SELECT pv, count(*)::DOUBLE AS n, regr_syy(y, x) - "
    "regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x) AS rss FROM xy GROUP BY pv)) SELECT pv, '(Intercept)' AS term, 3e0 AS npar, "
    "round(-dev0/2, 6) AS loglik, round(dev0+6, 6) AS aic, round(dev0-dev, 6) AS lrt, 1e0 AS df FROM opt JOIN o USING (pv) UNION ALL "
    "SELECT pv, '<none>', 4e0, round(-dev/2, 6), round(dev+8, 6), NULL, NULL FROM opt",
    ("study",),
)
def md_20(spark, sf_dir):
    return rounded(_intercept_models(spark, sf_dir, tests=True).tests.drop("spec", "p"), 6)


_MODES = (
    recursive(_BISECT)
    + ", md AS (SELECT gs.pv, gs.g AS country, lam*(sy-b0*n-b1*sx)/(1+lam*n) AS condval, sqrt(s2*lam/(1+lam*n)) AS condsd FROM gs "
    "JOIN opt USING (pv))"
)


@query(
    "md_21_conditional_modes",
    _MODES + " SELECT pv, country AS grp, '(Intercept)' AS term, round(condval, 5) AS condval, round(condsd, 5) AS condsd FROM md",
    ("study",),
)
def md_21(spark, sf_dir):
    return rounded(_intercept_models(spark, sf_dir, modes=True).modes.drop("spec"), 5)


@query(
    "md_24_caterpillar",
    _MODES + " SELECT country, 'Country level' AS ranef, round(condval, 5) AS condval, round(condsd, 5) AS condsd, "
    "round(condval-1.39e0*condsd, 5) AS low, round(condval+1.39e0*condsd, 5) AS high, row_number() OVER (ORDER BY condval, country) "
    "AS position FROM md WHERE pv = 1",
    ("study",),
)
def md_24(spark, sf_dir):
    modes = _intercept_models(spark, sf_dir, modes=True).modes.where("pv = 1")
    return rounded(pool.caterpillar_frame(modes, {"(Intercept)": "Country level"}).drop("spec"), 5)


_INTERVALS = (
    "round(theta-1.96e0*sqrt(v), 6) AS conf_low, round(theta+1.96e0*sqrt(v), 6) AS conf_high, round(exp(theta), 6) AS est_exp, "
    "round(exp(theta-1.96e0*sqrt(v)), 6) AS l95_exp, round(exp(theta+1.96e0*sqrt(v)), 6) AS u95_exp"
)


@query("md_22_intervals", recursive(_BISECT) + f" SELECT term, {_INTERVALS} FROM ({_RUBIN})", ("study",))
def md_22(spark, sf_dir):
    p = pool.pool_fixed(_intercept_models(spark, sf_dir).fixed, "z")
    return rounded(pool.interval_frame(p).select("term", "conf_low", "conf_high", "est_exp", "l95_exp", "u95_exp"), 6)


@query(
    "md_23_relabelled_no_intercept",
    recursive(_BISECT) + f" SELECT 'Literacy + Numeracy' AS label, {_INTERVALS} FROM ({_RUBIN}) WHERE term = 'PV'",
    ("study",),
)
def md_23(spark, sf_dir):
    p = pool.pool_fixed(_intercept_models(spark, sf_dir).fixed, "z")
    out = pool.interval_frame(p, st.term_labels(spark, "lnm"), intercept=False)
    return rounded(out.select("label", "conf_low", "conf_high", "est_exp", "l95_exp", "u95_exp"), 6)


@query(
    "prj_12_drop_intercept_row",
    recursive(_BISECT) + " SELECT pv, term, round(est, 6) AS est FROM est WHERE term <> '(Intercept)'",
    ("study",),
)
def prj_12(spark, sf_dir):
    fixed = _intercept_models(spark, sf_dir).fixed
    return rounded(fixed.where(F.col("term") != "(Intercept)").select("pv", "term", "est"), 6)


@query(
    "rsh_04_draws_to_columns",
    recursive(_BISECT) + " SELECT term, " + ", ".join(
        f"round(max(CASE WHEN pv = {i} THEN {k} END), 6) AS {k}_pv{i}" for k in ("est", "se") for i in PV
    ) + " FROM est GROUP BY term",
    ("study",),
)
def rsh_04(spark, sf_dir):
    return rounded(pool.draws_wide(_intercept_models(spark, sf_dir).fixed).drop("spec"), 6)


@query(
    "set_02_rows_per_draw",
    recursive(_BISECT) + " SELECT pv, count(*) AS terms, round(sum(est), 6) AS total FROM est GROUP BY pv",
    ("study",),
)
def set_02(spark, sf_dir):
    fixed = _intercept_models(spark, sf_dir).fixed
    return rounded(fixed.groupBy("pv").agg(F.count(F.lit(1)).alias("terms"), F.sum("est").alias("total")), 6)


@query("md_25_single_fit_summary", recursive(_BISECT) + " SELECT term, round(est, 6) AS est, round(se, 6) AS se, round(-dev/2, 6) AS loglik, "
       "round(dev+8, 6) AS aic, round(lam*s2, 6) AS variance FROM est JOIN opt USING (pv) WHERE pv = 1", ("study",))
def md_25(spark, sf_dir):
    r = _intercept_models(spark, sf_dir)
    v = r.random.where("pv = 1 AND grp = 'Country'").select("pv", F.col("vcov").alias("variance"))
    out = r.fixed.where("pv = 1").join(r.fits.select("pv", "loglik", "aic"), "pv").join(v, "pv")
    return rounded(out.select("term", "est", "se", "loglik", "aic", "variance"), 6)


# --------------------------------------------------------- random slopes, grids


@query("md_07_mixed_random_slopes")
def md_07(spark, sf_dir):
    specs = [s for s in st.linear_specs("lnm") if s.name in ("lnm2_ref", "lnm3_ref", "lnm6_ref")]
    r = st.earnings_models(b.study(spark, sf_dir), "lnm", specs)
    return r.fixed.unionByName(
        r.random.select("spec", "pv", F.concat_ws("-", "grp", "term", "term2").alias("term"), F.col("vcov").alias("est"), F.col("sdcor").alias("se"), F.lit(None).cast("double").alias("df"))
    )


@query("md_18_linear_grid")
def md_18_linear(spark, sf_dir):
    study = b.study(spark, sf_dir)
    parts = [st.earnings_models(study, family) for family in st.FAMILIES]
    fits = parts[0].fits.unionByName(parts[1].fits)
    return pool.aic_table(pool.pool_aic(fits))


@query("md_19_trial_random_parts")
def md_19_trial(spark, sf_dir):
    r = st.earnings_models(b.study(spark, sf_dir), "lnm", st.trial_specs())
    return pool.aic_table(r.fits.groupBy("spec").agg(
        F.avg("aic").alias("aic"), *[F.max(F.when(F.col("pv") == i, F.col("aic"))).alias(f"aic_pv{i}") for i in (1, 5)],
        F.count_if("singular").alias("singular"),
    ))


@query("md_07_other_draw_in_random_part")
def md_07_other(spark, sf_dir):
    return st.other_draw_model(b.study(spark, sf_dir)).tests


@query("md_20_deletion_tests")
def md_20_full(spark, sf_dir):
    spec = [s for s in st.linear_specs("lnm") if s.name == "lnm6_ref"]
    return st.earnings_models(b.study(spark, sf_dir), "lnm", spec, tests=True).tests


@query("job_10_earnings_models")
def job_10(spark, sf_dir):
    return st.earnings_study(b.study(spark, sf_dir))


@query("job_11_effect_frames")
def job_11(spark, sf_dir):
    return st.effect_frames(b.clean(spark, sf_dir), b.study(spark, sf_dir))


# ----------------------------------------------------------- logistic models


@query(
    "md_09_null_counts",
    "SELECT Country, count(*) AS n, sum(CASE Employment WHEN 'Employed' THEN 1 ELSE 0 END)::BIGINT AS successes FROM clean WHERE "
    "Employment IS NOT NULL AND Country IS NOT NULL GROUP BY Country",
    ("clean",),
)
def md_09_counts(spark, sf_dir):
    return null_counts(st.employment_frame(b.clean(spark, sf_dir)), "Employed", "Country")


@query("md_09_logistic_null")
def md_09(spark, sf_dir):
    return st.employment_null_model(b.clean(spark, sf_dir))


@query("md_10_logistic_random_intercept")
def md_10(spark, sf_dir):
    spec = [s for s in st.logistic_specs("lnm") if s.name == "lnm1_ref"]
    return pool.pool_fixed(st.employment_models(b.clean(spark, sf_dir), "lnm", spec).fixed, "z")


@query("md_11_logistic_random_slopes")
def md_11(spark, sf_dir):
    spec = [s for s in st.logistic_specs("lnm") if s.name == "lnm7_ref"]
    return pool.pool_random(st.employment_models(b.clean(spark, sf_dir), "lnm", spec).random)


@query("md_18_logistic_grid")
def md_18_logistic(spark, sf_dir):
    clean = b.clean(spark, sf_dir)
    parts = [st.employment_models(clean, family) for family in st.FAMILIES]
    return pool.aic_table(pool.pool_aic(parts[0].fits.unionByName(parts[1].fits)))


@query("job_09_employment_models")
def job_09(spark, sf_dir):
    return st.employment_study(b.clean(spark, sf_dir))


@query("md_21_logistic_modes")
def md_21_logistic(spark, sf_dir):
    spec = [s for s in st.logistic_specs("psm") if s.name == "psm5_ref"]
    r = st.employment_models(b.clean(spark, sf_dir), "psm", spec, modes=True, draws=[1])
    return pool.caterpillar_frame(r.modes, st.MODE_LABELS["psm"])


# ---------------------------------------------------------------------- tails


def _tail_inputs(spark, sf_dir):
    return b.clean(spark, sf_dir).groupBy("Country").agg(
        (F.avg("PVLIT1") / 100).alias("t"), F.count(F.lit(1)).cast("double").alias("df")
    )


_TAIL_SQL = "(SELECT Country, avg(PVLIT1) / 100 AS t, count(*)::DOUBLE AS df FROM clean GROUP BY Country)"


@query("sc_11_normal_tail", f"SELECT Country, round(t, 8) AS t, round({tails_sql.normal_p('t')}, 9) AS p FROM {_TAIL_SQL}", ("clean",))
def sc_11(spark, sf_dir):
    return _tail_inputs(spark, sf_dir).select("Country", F.round("t", 8).alias("t"), F.round(tails.normal_p("t"), 9).alias("p"))


@query("sc_12_student_tail", f"SELECT Country, round(t, 8) AS t, df, round({tails_sql.t_p('t', 'df')}, 9) AS p FROM {_TAIL_SQL}", ("clean",))
def sc_12(spark, sf_dir):
    return _tail_inputs(spark, sf_dir).select("Country", F.round("t", 8).alias("t"), "df", F.round(tails.t_p("t", "df"), 9).alias("p"))


@query(
    "sc_12_small_df_tail",
    "SELECT Country, df, round(f, 6) AS f, round(" + tails_sql.t_p("t", "df") + ", 9) AS p_t, round(" + tails_sql.f_p("f", "3e0", "df")
    + ", 9) AS p_f, round(" + tails_sql.chi2_p("f", "df") + ", 9) AS p_chi2 FROM (SELECT Country, t, t * t AS f, 1 + df % 9 AS df FROM " + _TAIL_SQL + ")",
    ("clean",),
)
def sc_12_small(spark, sf_dir):
    """Few degrees of freedom, and the tails of the other two distributions."""
    x = _tail_inputs(spark, sf_dir).select("Country", "t", (F.col("t") * F.col("t")).alias("f"), (1 + F.col("df") % 9).alias("df"))
    nine = [F.round(p, 9).alias(n) for n, p in (("p_t", tails.t_p("t", "df")), ("p_f", tails.f_p("f", F.lit(3.0), "df")), ("p_chi2", tails.chi2_p("f", "df")))]
    return x.select("Country", "df", F.round("f", 6).alias("f"), *nine)
