"""Missingness profiles, tables, summaries, histograms, correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenfold.catalog import base as b
from tenfold.catalog.base import query, rounded
from tenfold.operators import describe as d
from tenfold.operators.filters import complete_cases
from tenfold.plans import binding as bind
from tenfold.plans import jobs

PV = bind.PV
FAMILY_NAMES = ("PVLIT", "PVNUM", "PVLITNUM", "PVPSL")


@query("ag_01_group_count", "SELECT CNTRYID, Country, count(*) AS N FROM merged GROUP BY ALL", ("merged",))
def ag_01(spark, sf_dir):
    return d.frequency(b.merged(spark, sf_dir), ["CNTRYID", "Country"], "N")


@query(
    "ag_02_missing_profile",
    "SELECT Country, count(*) AS N, count(*) - count(Earnings_raw) AS nas, round(avg(Earnings_raw), 8) AS avg, "
    "round((count(*) - count(Earnings_raw)) / count(*), 8) AS nas_p FROM base GROUP BY Country",
    ("base",),
)
def ag_02(spark, sf_dir):
    base = jobs.base_sample(b.sample(spark, sf_dir))
    return rounded(d.missing_profile(base, ["Country"], {"": "Earnings_raw"}, mean_of="Earnings_raw"), 8)


@query(
    "ag_03_two_variable_profile",
    "SELECT Country, N, nas0, nas, nas_diff, round(nas_p0, 8) AS nas_p0, round(nas_p, 8) AS nas_p FROM gaps "
    "ORDER BY nas_p DESC, Country",
    ("gaps",),
)
def ag_03(spark, sf_dir):
    return rounded(jobs.earnings_gaps(b.clean(spark, sf_dir)), 8)


@query(
    "ag_04_profile_two_keys",
    "SELECT Country, Employment, count(*) AS N, count(*) - count(Earnings) AS nas, "
    "round((count(*) - count(Earnings)) / count(*), 8) AS nas_p FROM study GROUP BY ALL ORDER BY Employment, nas_p DESC",
    ("study",),
)
def ag_04(spark, sf_dir):
    prof = d.missing_profile(b.study(spark, sf_dir), ["Country", "Employment"], {"": "Earnings"})
    return rounded(prof, 8).orderBy(F.col("Employment").asc_nulls_last(), F.col("nas_p").desc_nulls_last())


@query("ag_05_mean_sd", "SELECT round(avg(PVLIT7), 8) AS mean, round(stddev_samp(PVLIT1), 8) AS sd FROM clean", ("clean",))
def ag_05(spark, sf_dir):
    return rounded(b.clean(spark, sf_dir).agg(F.avg("PVLIT7").alias("mean"), F.stddev_samp("PVLIT1").alias("sd")), 8)


@query(
    "ag_06_mean_sd_by_draw",
    " UNION ALL ".join(
        f"SELECT '{f}{i}' AS name, round(avg({f}{i}), 8) AS mean, round(stddev_samp({f}{i}), 8) AS sd FROM clean"
        for f in FAMILY_NAMES
        for i in PV
    ),
    ("clean",),
)
def ag_06(spark, sf_dir):
    return rounded(d.mean_sd(b.clean(spark, sf_dir), [c for f in FAMILY_NAMES for c in jobs.pv_names(f)]), 8)


_POOLED = (
    "SELECT family, round(avg(m), 8) AS mean, round(avg(s), 8) AS sd FROM ("
    + " UNION ALL ".join(
        f"SELECT '{f}' AS family, avg({f}{i}) AS m, stddev_samp({f}{i}) AS s FROM {{src}}" for f in FAMILY_NAMES for i in PV
    )
    + ") GROUP BY family"
)


@query("ag_07_pooled_mean_sd", _POOLED.format(src="clean"), ("clean",))
def ag_07(spark, sf_dir):
    return rounded(jobs.pooled_descriptives(b.clean(spark, sf_dir)), 8)


@query("ag_08_frequency", "SELECT Occupation, count(*) AS n FROM clean GROUP BY Occupation", ("clean",))
def ag_08(spark, sf_dir):
    return d.frequency(b.clean(spark, sf_dir), ["Occupation"])


@query(
    "ag_09_crosstab",
    "SELECT EDCAT6, "
    + ", ".join(
        f"count(*) FILTER (WHERE Education_BQ1a = '{lab.replace(chr(39), chr(39) * 2)}') AS c{i}"
        for i, lab in enumerate(bind.EDUCATION_LABELS)
    )
    + ", count(*) FILTER (WHERE Education_BQ1a IS NULL) AS missing FROM recoded GROUP BY EDCAT6",
    ("recoded",),
)
def ag_09(spark, sf_dir):
    levels = {lab: f"c{i}" for i, lab in enumerate(bind.EDUCATION_LABELS)}
    return d.crosstab(b.recoded(spark, sf_dir), "EDCAT6", "Education_BQ1a", {**levels, None: "missing"})


@query(
    "ag_10_agreement",
    "SELECT B_Q01a_lable = B_Q01a3_lable AS agree, count(*) AS n FROM recoded WHERE B_Q01a_lable IS NOT NULL AND "
    "B_Q01a3_lable IS NOT NULL GROUP BY 1",
    ("recoded",),
)
def ag_10(spark, sf_dir):
    return d.agreement(b.recoded(spark, sf_dir), "B_Q01a_lable", "B_Q01a3_lable")


@query(
    "ag_11_distinct",
    "SELECT DISTINCT Employed_flag, OutOfLaborforce_flag, Employment FROM recoded",
    ("recoded",),
)
def ag_11(spark, sf_dir):
    return b.recoded(spark, sf_dir).select("Employed_flag", "OutOfLaborforce_flag", "Employment").distinct()


def _six_sql(cols, src):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS name, min({c}) AS min, round(quantile_cont({c}, 0.25e0), 8) AS q1, round(quantile_cont({c}, 0.5e0), 8) "
        f"AS median, round(avg({c}), 8) AS mean, round(quantile_cont({c}, 0.75e0), 8) AS q3, max({c}) AS max, "
        f"count(*) - count({c}) AS missing FROM {src}"
        for c in cols
    )


SIX = ["PVLIT1", "PVNUM1", "PVPSL1", "Earnings_raw", "Experience_raw", "Schooling"]


@query("ag_12_six_numbers", _six_sql(SIX, "base"), ("base",))
def ag_12(spark, sf_dir):
    return rounded(d.six_numbers(jobs.base_sample(b.sample(spark, sf_dir)), SIX), 8)


def _hist_sql(expr):
    return f"""SELECT i::INTEGER AS bin, round((f + i - 1) * step, 8) AS lo, round((f + i) * step, 8) AS hi,
    (SELECT count(*) FROM xs WHERE greatest(ceil((x - f * step) / step - 1e-7), 1) = i) AS n
    FROM (SELECT step, floor(a / step + 1e-7) AS f, ceil(z / step - 1e-7) AS l FROM (
      SELECT a, z, CASE WHEN 2 * p - w >= 1.5e0 * (w - p) THEN p WHEN 5 * p - w >= 2.75e0 * (w - 2 * p) THEN 2 * p
        WHEN 10 * p - w >= 1.5e0 * (w - 5 * p) THEN 5 * p ELSE 10 * p END AS step
      FROM (SELECT a, z, w, pow(10e0, floor(log10(w))) AS p FROM (
        SELECT min(x) AS a, max(x) AS z, (max(x) - min(x)) / ceil(log2(count(x)) + 1) AS w FROM xs)))),
    LATERAL (SELECT unnest(range(1, (l - f)::BIGINT + 1)) AS i)"""


def _hist_query(expr):
    return (
        "SELECT h.* FROM (" + _hist_sql(expr).replace("FROM xs", f"FROM (SELECT {expr} AS x FROM study WHERE Earnings IS NOT NULL)") + ") h"
    )


@query("ag_13_histogram", _hist_query("Earnings"), ("study",))
def ag_13(spark, sf_dir):
    return rounded(d.histogram(b.study(spark, sf_dir), "Earnings"), 8)


@query("ag_13_histogram_log", _hist_query("ln(Earnings)"), ("study",))
def ag_13_log(spark, sf_dir):
    return rounded(d.histogram(b.study(spark, sf_dir).withColumn("LogEarnings", F.ln("Earnings")), "LogEarnings"), 8)


_PAIRS = [("Schooling", "lit"), ("Schooling", "num"), ("Schooling", "psl"), ("lit", "num"), ("lit", "psl"), ("num", "psl")]


def _corr_sql(i):
    rows = (
        f"(SELECT Schooling, PVLIT{i} AS lit, PVNUM{i} AS num, PVPSL{i} AS psl FROM clean WHERE Schooling IS NOT NULL "
        f"AND PVLIT{i} IS NOT NULL AND PVNUM{i} IS NOT NULL AND PVPSL{i} IS NOT NULL)"
    )
    return " UNION ALL ".join(
        f"SELECT {i} AS pv, '{x}' AS \"left\", '{y}' AS \"right\", round(corr({x}, {y}), 2) AS r FROM {rows}" for x, y in _PAIRS
    )


@query("ag_14_correlations", " UNION ALL ".join(_corr_sql(i) for i in PV), ("clean",))
def ag_14(spark, sf_dir):
    return d.correlations_by_pv(b.clean(spark, sf_dir), ["Schooling"], {"lit": "PVLIT", "num": "PVNUM", "psl": "PVPSL"})


_POOLED_CORR = (
    'SELECT "left", "right", round(avg(r), 8) AS r FROM (' + " UNION ALL ".join(_corr_sql(i) for i in PV) + ") GROUP BY ALL"
)


@query("ag_15_pooled_correlations", _POOLED_CORR, ("clean",))
def ag_15(spark, sf_dir):
    return rounded(jobs.pooled_score_correlations(b.clean(spark, sf_dir)), 8)


_AUDIT = [
    ("stem", "B_Q01b", "STEM"), ("employed01", "Employed01", "NULL"), ("employed02", "Employed02", "NULL"),
    ("out_of_labour_force", "OutOfLaborforce_flag", "NULL"), ("flags", "Employed_flag", "OutOfLaborforce_flag"),
    ("employment", "Employment", "NULL"), ("b_q01a", "B_Q01a_lable", "B_Q01a"), ("b_q01a3", "B_Q01a3_lable", "B_Q01a3"),
    ("b_q01a_mapped", "B_Q01a_lable", "B_Q01a_mapped"), ("b_q01a3_mapped", "B_Q01a3_lable", "B_Q01a3_mapped"),
    ("education", "EDCAT6", "Education_BQ1a"), ("occupation", "ISCOSKIL4", "Occupation"), ("gender", "GENDER_R", "Gender"),
]


@query(
    "job_06_recode_audit",
    " UNION ALL ".join(
        f"SELECT '{n}' AS \"check\", CAST({a} AS VARCHAR) AS raw, CAST({c} AS VARCHAR) AS recoded, count(*) AS n FROM recoded GROUP BY ALL"
        for n, a, c in _AUDIT
    ),
    ("recoded",),
)
def job_06(spark, sf_dir):
    return jobs.recode_audit(b.recoded(spark, sf_dir))


@query("job_07_pooled_descriptives", _POOLED.format(src="(SELECT * FROM study WHERE Earnings IS NOT NULL)"), ("study",))
def job_07(spark, sf_dir):
    return rounded(jobs.pooled_descriptives(jobs.earnings_extract(b.study(spark, sf_dir))), 8)


@query("job_05_earnings_summary", _six_sql(["Earnings"], "(SELECT * FROM study WHERE Earnings IS NOT NULL)"), ("study",))
def job_05_summary(spark, sf_dir):
    return rounded(jobs.earnings_summary(b.study(spark, sf_dir)), 8)


@query("job_08_pooled_correlations_study", _POOLED_CORR.replace("FROM clean", "FROM study"), ("study",))
def job_08(spark, sf_dir):
    study = complete_cases(b.study(spark, sf_dir), ["Schooling"])
    return rounded(jobs.pooled_score_correlations(study), 8)
