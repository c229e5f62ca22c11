"""Shared pieces of the query catalog: registration, inputs, SQL stages.

Every query of the catalog sits next to the SQL that must give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenfold.plans import binding as bind
from tenfold.plans import jobs
from tenfold.session import local_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: tuple[str, ...] = ()):
    """Register a query and, where SQL can express it, its SQL.

    ``ctes`` names the stages the SQL reads; their own inputs follow.
    """

    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_stages(sql, ctes)
        return fn

    return wrap


# ------------------------------------------------------------ Spark stages


def respondents(spark, sf_dir):
    return bind.respondents(spark, sf_dir)


def merged(spark, sf_dir):
    return jobs.merge_survey(respondents(spark, sf_dir), bind.country_index(spark, sf_dir))


def recoded(spark, sf_dir):
    return jobs.recode_survey(merged(spark, sf_dir), bind.lookups(spark))


def sample(spark, sf_dir):
    return jobs.sample_respondents(recoded(spark, sf_dir), bind.SELECTED_COLUMNS)


def selected_series(spark):
    return local_table(spark, [(c,) for c in bind.INDICATORS], "SeriesCode string")


def year_values(spark, sf_dir):
    return jobs.country_year_values(
        bind.yearly_indicators(spark, sf_dir), bind.country_index(spark, sf_dir), selected_series(spark), bind.ROUND_YEARS
    )


def indicators(spark, sf_dir):
    return jobs.fill_indicators(year_values(spark, sf_dir))


def profile(spark, sf_dir):
    return jobs.country_profile(indicators(spark, sf_dir), bind.INDICATORS)


def derive_clean(spark, sf_dir):
    return jobs.clean_sample(sample(spark, sf_dir), profile(spark, sf_dir))


def clean(spark, sf_dir):
    """The clean sample file, which the later jobs read."""
    return bind.snapshot(spark, sf_dir, "clean", derive_clean)


def study(spark, sf_dir):
    return jobs.earnings_study(clean(spark, sf_dir))


def rounded(df: DataFrame, digits: int = 6, skip: tuple[str, ...] = ()) -> DataFrame:
    """Round the double columns of a result."""
    return df.select(
        *[
            F.round(F.col(f"`{n}`"), digits).alias(n) if t == "double" and n not in skip else F.col(f"`{n}`")
            for n, t in df.dtypes
        ]
    )


# -------------------------------------------------------------- SQL stages

_PVS = [f"{f}{i}" for f in jobs.FAMILIES for i in bind.PV]
_SCORED = [f"PVPSL{i}" for i in bind.PV] + [f"PVLITNUM{i}" for i in bind.PV]
_IND = list(bind.INDICATORS.values())

STAGES: dict[str, tuple[tuple[str, ...], str]] = {n: ((), s) for n, s in bind.input_ctes().items()}
STAGES["merged"] = (
    ("resp", "idx"),
    "SELECT resp.*, CountryCode, DataCollectedRound, DataCollected, Country, File FROM resp "
    "LEFT JOIN idx ON resp.CNTRYID IS NOT DISTINCT FROM idx.CountryID",
)
STAGES["flagged"] = (
    ("merged",),
    """SELECT *,
    CASE WHEN B_Q01b IN ('5','6','7') THEN 'STEM' WHEN B_Q01b IN ('1','2','3','4','8','9') THEN 'Non-STEM' END AS STEM,
    CASE coalesce(C_Q01a = '1', false) OR C_Q01b = '1' WHEN true THEN 1 WHEN false THEN 0 END AS Employed01,
    CASE C_Q02a = '2' AND C_Q02b = '1' AND C_Q02c = '1' WHEN true THEN 1 WHEN false THEN 0 END AS Employed02,
    CASE C_Q03_02 = '1' OR C_Q03_03 = '1' OR C_Q03_05 = '1' OR C_Q03_08 = '1' OR C_Q03_09 = '1'
      WHEN true THEN 1 WHEN false THEN 0 END AS OutOfLaborforce_flag
    FROM merged""",
)
STAGES["recoded"] = (
    ("flagged", "lux"),
    """SELECT f.*, CASE WHEN Employed01 + Employed02 >= 1 THEN 1 WHEN Employed01 + Employed02 < 1 THEN 0 END AS Employed_flag,
    CASE WHEN Employed01 + Employed02 >= 1 THEN 'Employed'
         WHEN Employed01 + Employed02 < 1 AND OutOfLaborforce_flag = 1 THEN 'Out of labor force'
         WHEN Employed01 + Employed02 < 1 AND OutOfLaborforce_flag = 0 THEN 'Unemployed' END AS Employment,
    a.Label AS B_Q01a_lable, a.Mapped AS B_Q01a_mapped, b.Label AS B_Q01a3_lable, b.Mapped AS B_Q01a3_mapped,
    c.Label AS EDCAT6_lable, c.Mapped AS EDCAT6_mapped,
    CASE WHEN a.Mapped = 'Foreign qualification' THEN b.Mapped ELSE a.Mapped END AS Education_BQ1a,
    CASE ISCOSKIL4 WHEN '1' THEN 'Skilled' WHEN '2' THEN 'White-collar' WHEN '3' THEN 'Blue-collar'
      WHEN '4' THEN 'Elementary' END AS Occupation,
    CASE GENDER_R WHEN '1' THEN 'M' WHEN '2' THEN 'F' END AS Gender
    FROM flagged f
    LEFT JOIN (SELECT * FROM lux WHERE Variable = 'B_Q01a') a ON f.B_Q01a IS NOT DISTINCT FROM a.Value
    LEFT JOIN (SELECT * FROM lux WHERE Variable = 'B_Q01a3') b ON f.B_Q01a3 IS NOT DISTINCT FROM b.Value
    LEFT JOIN (SELECT * FROM lux WHERE Variable = 'EDCAT6') c ON f.EDCAT6 IS NOT DISTINCT FROM c.Value""",
)
_KEEP = [c for c in jobs.DERIVED if c != "Age_group"] + bind.SELECTED_COLUMNS
STAGES["sample"] = (
    ("recoded",),
    f"SELECT {', '.join(_KEEP)}, CASE AGEG5LFS WHEN 3 THEN '25to29' ELSE '30to34' END AS Age_group "
    "FROM recoded WHERE AGEG5LFS IN (3, 4) AND Employment <> 'Out of labor force'",
)
STAGES["yearval"] = (
    ("wdi", "idx"),
    "SELECT w.CountryCode, CountryName AS Country, DataCollected, IndicatorName, IndicatorCode AS Indicator, "
    + ", ".join(f"X{y}" for y in bind.YEARS)
    + ", CASE DataCollected "
    + " ".join(f"WHEN '{t}' THEN {c}" for t, c in bind.ROUND_YEARS.items())
    + " END AS Value1 FROM wdi w JOIN idx ON w.CountryCode = idx.CountryCode WHERE IndicatorCode IN ("
    + ", ".join(f"'{c}'" for c in bind.INDICATORS)
    + ")",
)
STAGES["rawprof"] = (
    ("yearval",),
    "SELECT CountryCode, "
    + ", ".join(f"max(CASE WHEN Indicator = '{c}' THEN Value1 END) AS {n}_raw" for c, n in bind.INDICATORS.items())
    + " FROM yearval GROUP BY CountryCode",
)
STAGES["prof"] = (
    ("rawprof",),
    "SELECT *, "
    + ", ".join(f"({n}_raw - avg({n}_raw) OVER ()) / stddev_samp({n}_raw) OVER () AS {n}" for n in _IND)
    + " FROM rawprof",
)
STAGES["base"] = (
    ("sample",),
    "SELECT SPFWT0 AS Weight, CNTRYID, CountryCode, DataCollectedRound, DataCollected, Country, STEM, Employment, "
    "EDCAT6_mapped AS Education, Occupation, Gender, Age_group AS Age, "
    "TRY_CAST(EARNHRBONUSPPP AS DOUBLE) AS Earnings_raw, TRY_CAST(FNFAET12JR AS DOUBLE) AS Training, "
    "TRY_CAST(C_Q09_C AS DOUBLE) AS Experience_raw, TRY_CAST(YRSQUAL AS DOUBLE) AS Schooling, "
    f"{', '.join(_PVS)} FROM sample",
)
STAGES["kept"] = (
    ("base",),
    "SELECT * FROM base WHERE coalesce(STEM, Education, Occupation) IS NOT NULL OR "
    f"coalesce(Earnings_raw, Training, Experience_raw, Schooling, {', '.join(_PVS)}) IS NOT NULL",
)
STAGES["ruled"] = (
    ("kept",),
    """SELECT *, CASE WHEN Earnings_raw < 0.1 OR Earnings_raw > 500 OR Employment = 'Unemployed' THEN NULL
      WHEN Earnings_raw IS NULL OR Employment IS NULL THEN NULL ELSE Earnings_raw END AS Earnings,
    CASE WHEN Experience_raw = 0 AND Employment = 'Employed' THEN 'other'
      WHEN (Age = '25to29' AND Experience_raw <= 13) OR (Age = '30to34' AND Experience_raw <= 18) THEN 'Yes'
      ELSE 'other' END AS Experience_flag,
    CASE WHEN NOT (Experience_raw = 0 AND Employment = 'Employed') AND
      ((Age = '25to29' AND Experience_raw <= 13) OR (Age = '30to34' AND Experience_raw <= 18)) THEN Experience_raw END
      AS Experience, """
    + ", ".join(f"(PVLIT{i} + PVNUM{i}) / 2 AS PVLITNUM{i}" for i in bind.PV)
    + " FROM kept",
)
STAGES["clean"] = (
    ("ruled", "prof"),
    "SELECT s.*, p.* EXCLUDE (CountryCode) FROM (SELECT *, "
    + ", ".join(f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS {c}_s" for c in _SCORED)
    + " FROM ruled) s LEFT JOIN prof p ON s.CountryCode IS NOT DISTINCT FROM p.CountryCode",
)
STAGES["gaps"] = (
    ("clean",),
    "SELECT Country, N, nas0, nas, nas - nas0 AS nas_diff, nas0 / N AS nas_p0, nas / N AS nas_p FROM "
    "(SELECT Country, count(*) AS N, count(*) - count(Earnings_raw) AS nas0, count(*) - count(Earnings) AS nas "
    "FROM clean GROUP BY Country)",
)
STAGES["study"] = (
    ("clean", "gaps"),
    "SELECT * FROM clean WHERE Employment = 'Employed' AND NOT EXISTS "
    "(SELECT 1 FROM gaps g WHERE g.nas = g.N AND g.Country IS NOT DISTINCT FROM clean.Country)",
)


def with_stages(sql: str, stages: tuple[str, ...]) -> str:
    order: list[str] = []

    def add(name):
        if name in order:
            return
        for d in STAGES[name][0]:
            add(d)
        order.append(name)

    for s in stages:
        add(s)
    if not order:
        return sql
    parts = ", ".join(f"{n} AS MATERIALIZED ({STAGES[n][1]})" for n in order)
    return f"WITH {parts} {sql}" if not sql.startswith("RECURSIVE ") else f"WITH RECURSIVE {parts}, {sql[10:]}"
