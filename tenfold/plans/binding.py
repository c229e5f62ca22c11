"""Binds the given star-schema tables to the survey input schema.

An order is a respondent, its customer's nation the country.  The tables hold
no missing values and almost no between-nation effects, so both are planted by
integer arithmetic on the keys.  Column expressions are written in the SQL
common to Spark and other engines, as the correctness check evaluates the same
text elsewhere; everything downstream of these tables is separate code.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenfold.session import compiled_in_parts, local_table, scratch_path

PV = range(1, 11)

# ---- fixed values: multipliers of the ten draws, collection rounds, indicators ----
DRAWS = [
    (101, 211, 307), (103, 223, 311), (107, 227, 313), (109, 229, 317), (113, 233, 331),
    (127, 239, 337), (131, 241, 347), (137, 251, 349), (139, 257, 353), (149, 263, 359),
]
ROUNDS = {
    1: "Round 1(August 2011-March 2012)",
    2: "Round 2(April 2014-March 2015)",
    3: "Round 3(July 2017-Dec 2017)",
}
ROUND_YEARS = {ROUNDS[1]: "X2011", ROUNDS[2]: "X2014", ROUNDS[3]: "X2017"}
INDICATORS = {
    "COLLEGE": "CollegeCompletion", "HIGHSCHOOL": "HSCompletion", "GDP": "GDPPCAP",
    "NET": "Internet", "MOBILE": "Mobile", "POVERTY": "Poverty",
}
EDUCATION_LABELS = ["Below high school", "High school or equivalent", "Some college", "Bachelor's degree or beyond"]
# ------------------------------------------------------------------------------------


def noise(a: int, b: int, c: int) -> str:
    """Near-normal, standard deviation about 1, from the respondent key."""
    return f"(((k*{a})%1009 + (k*{b})%997 + (k*{c})%983 - 1491) / 499e0)"


def _code(value: str, missing: tuple[int, int], skipped: tuple[int, int] | None, all_missing: bool = True) -> str:
    """A coded answer as text, with missing rows and valid-skip rows ('V')."""
    out = "case "
    if all_missing:
        out += "when k%113=0 then null "
    out += f"when k%{missing[0]}={missing[1]} then null "
    if skipped:
        out += f"when k%{skipped[0]}={skipped[1]} then 'V' "
    return out + f"else {value} end"


def _int_text(expr: str) -> str:
    return f"cast(cast({expr} as int) as string)"


# Stage 1 on the joined tables, stage 2 on stage 1, and so on.
BASE = {
    "k": "o_orderkey",
    "n": "cast(n_nationkey as int)",
    "r": "n_regionkey",
    "cust": "o_custkey",
    "prio": "cast(substr(o_orderpriority, 1, 1) as int)",
}
EFFECTS = {
    "k": "k", "n": "n", "r": "r", "prio": "prio",
    "b0": "((n*7)%25-12)/30e0",
    "b1": "((n*11)%25-12)/100e0",
    "b2": "((n*13)%25-12)/60e0",
    "b3": "((n*17)%25-12)/80e0",
    "b4": "((n*19)%25-12)/40e0",
    "th": f"((n*3)%25-12)/40e0 + {noise(7919, 6007, 5003)}",
    "male": "case when cust%2=0 then 1 else 0 end",
    "field": "k%9+1",
    "stem": "case when k%9 in (4, 5, 6) then 1 else 0 end",
    "train": "case when (k*31)%101 < 38 then 1 else 0 end",
    "years": "(k*37)%23",
    "occ": "(k*29)%4+1",
}
ANSWERS = {
    **{c: c for c in ("k", "n", "r", "prio", "b0", "b1", "b2", "b3", "th", "male", "stem", "field", "train", "years", "occ")},
    "works": (
        "case when ((k*48611)%10007)/10007e0 < 1/(1+exp(-(1.2e0+2*b0+(0.5e0+b1)*th+male*(0.3e0+b2)"
        "+train*(0.3e0+b4)+0.05e0*years-0.3e0*stem))) then 1 else 0 end"
    ),
}
SURVEY = {
    "resp_id": "k",
    "region": "r",
    "CNTRYID": "case when k%997=1 then null else n end",
    "AGEG5LFS": "prio + 1",
    "GENDER_R": "case when k%389=1 then null when male=1 then '1' else '2' end",
    "B_Q01a": _code(_int_text("(k*7)%15+1"), (97, 3), (101, 5)),
    "B_Q01a3": _code(_int_text("(k*5)%6+1"), (103, 7), (107, 9)),
    "EDCAT6": _code(
        _int_text(f"least(6e0, greatest(1e0, floor(3.5e0+1.2e0*th+0.8e0*{noise(611, 617, 619)})))"), (79, 2), (83, 4)
    ),
    "B_Q01b": _code(_int_text("field"), (37, 5), (41, 7)),
    "C_Q01a": "case when k%131=6 then null when works=1 and k%17<>3 and k%19<>5 then '1' else '2' end",
    "C_Q01b": (
        "case when k%137=8 then null when works=1 and k%17=3 then '1' "
        "when works=1 and k%19<>5 then 'V' else '2' end"
    ),
    "C_Q02a": "case when k%139=10 then null when works=1 and k%17<>3 and k%19=5 then '2' when works=1 then 'V' else '1' end",
    "C_Q02b": "case when works=1 and k%17<>3 and k%19=5 then '1' else 'V' end",
    "C_Q02c": "case when k%149=12 then null when works=1 and k%17<>3 and k%19=5 then '1' else 'V' end",
    "C_Q03_02": "case when works=1 then 'V' when k%53=1 then '1' else '2' end",
    "C_Q03_03": "case when works=1 then 'V' when k%53=2 then '1' else '2' end",
    "C_Q03_05": "case when k%151=14 then null when works=1 then 'V' when k%53=3 then '1' else '2' end",
    "C_Q03_08": "case when works=1 then 'V' when k%53=4 then '1' else '2' end",
    "C_Q03_09": "case when works=1 then 'V' when k%53=5 then '1' else '2' end",
    "ISCOSKIL4": _code(_int_text("occ"), (89, 6), None),
    "SPFWT0": "cast(round(0.5e0 + ((k*17)%1000)/1000e0, 4) as double)",
    "EARNHRBONUSPPP": (
        "case when k%113=0 or n%9=4 or k%8=0 then null when k%211=0 then '0.05' when k%223=0 then '600' "
        "when k%227=0 then 'V' else cast(round(exp(2.3e0+b0+(0.12e0+b1)*th+male*(0.2e0+b2/2)+stem*(0.1e0+b3)"
        "+0.02e0*years+0.05e0*(4-occ)+0.5e0*" + noise(811, 821, 823) + "),4) as string) end"
    ),
    "FNFAET12JR": _code("case when train=1 then '1' else '0' end", (53, 11), (59, 13)),
    "C_Q09_C": _code("cast(years as string)", (61, 17), (67, 19)),
    "YRSQUAL": _code(
        _int_text(f"least(24e0, greatest(4e0, floor(13e0+1.3e0*th+1.5e0*{noise(701, 709, 719)})))"), (71, 3), (73, 5)
    ),
    **{f"PVLIT{i}": (
        f"case when k%113=0 or k%29=0{' or k%127=0' if i == 7 else ''} then null "
        f"else round(270+45*th+15*{noise(*DRAWS[i-1])},4) end") for i in PV},
    **{f"PVNUM{i}": (
        "case when k%113=0 or k%29=0 then null "
        f"else round(265+48*th+16*{noise(*[x + y for x, y in zip(DRAWS[i-1], (62, 66, 70))])},4) end") for i in PV},
    **{f"PVPSL{i}": (
        "case when k%113=0 or k%7=3 or n in (3, 11) then null "
        f"else round(280+40*th+18*{noise(*[x + y for x, y in zip(DRAWS[i-1], (400, 410, 420))])},4) end") for i in PV},
}
STAGES = [BASE, EFFECTS, ANSWERS, SURVEY]

#: Spark's decimal rounding costs more than all the rest of a score.  Scores are whole multiples of 1 / (499 * 8), so
#: times 10,000 none lies within 0.0002 of a half, and the nearest whole number gives the same double.
_ROUNDED = re.compile(r"else round\((2[67]\d|280)(.*),4\) end$")
SPARK_SURVEY = {c: _ROUNDED.sub(r"else rint((\1\2)*10000e0)/10000e0 end", e) if c.startswith("PV") else e for c, e in SURVEY.items()}

INDEX = {
    "CountryID": "cast(n_nationkey as int)",
    "CountryCode": "'C' || cast(n_nationkey as string)",
    "Country": "n_name",
    "DataCollectedRound": "n_regionkey%3+1",
    "DataCollected": "case n_regionkey%3 " + " ".join(f"when {i-1} then '{t}'" for i, t in ROUNDS.items()) + " end",
    "File": "'prg' || cast(n_nationkey as string) || '.csv'",
}
UNKNOWN_COUNTRY = {
    "CountryID": "cast(null as int)", "CountryCode": "'CX'", "Country": "'UNKNOWN'",
    "DataCollectedRound": "1", "DataCollected": f"'{ROUNDS[1]}'", "File": "'unknown.csv'",
}

# Indicator code: (name, aggregate of the country's orders in one year).
SERIES = {
    "COLLEGE": ("College completion", "round(sum(o_totalprice), 2) / count(*)"),
    "HIGHSCHOOL": ("High school completion", "round(min(o_totalprice), 2)"),
    "GDP": ("GDP per head", "round(sum(o_totalprice), 2)"),
    "NET": ("Internet users", "round(sum(c_acctbal), 2) / count(*)"),
    "MOBILE": ("Mobile subscriptions", "cast(count(*) as double)"),
    "POVERTY": ("Poverty headcount", "round(max(c_acctbal), 2)"),
    "OTHER": ("Not selected", "round(max(o_totalprice), 2)"),
}
YEARS = range(2010, 2021)
ORDERS_PER_TASK = 500_000
ORDER_YEAR_SHIFT = 16  # order years 1995 to 2001 stand for 2011 to 2017

LOOKUP_ROWS = (
    [("B_Q01a", str(i), f"Level {i}", EDUCATION_LABELS[min(3, (i - 1) // 4)]) for i in range(1, 15)]
    + [("B_Q01a", "15", "Foreign", "Foreign qualification")]
    + [("B_Q01a3", str(i), f"Level {2 * i}", EDUCATION_LABELS[min(3, (i - 1) // 2)]) for i in range(1, 7)]
    + [("EDCAT6", str(i), f"Category {i}", EDUCATION_LABELS[(0, 0, 1, 2, 3, 3)[i - 1]]) for i in range(1, 7)]
    + [("EDCAT6", None, "Not stated", None)]
)
SELECTED_COLUMNS = (
    ["AGEG5LFS", "SPFWT0", "EARNHRBONUSPPP", "FNFAET12JR", "C_Q09_C", "YRSQUAL", "resp_id"]
    + [f"{f}{i}" for f in ("PVLIT", "PVNUM", "PVPSL") for i in PV]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders_with_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders joined to their nation; only the columns in use are read."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    # The file's own splits are few for what is derived from a row: tasks grow with the rows instead.
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(o.count() / ORDERS_PER_TASK))
    if o.rdd.getNumPartitions() < tasks:
        o = o.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority").repartition(tasks)
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))


_SNAPSHOTS: dict[tuple[str, str, str], str] = {}


def snapshot(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A derived table written once per application to the shared folder, as the
    survey would lie there in files; lost executors re-read it, nothing is recomputed."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _SNAPSHOTS:
        path = scratch_path(spark, name)
        with compiled_in_parts(spark):
            build(spark, sf_dir).write.parquet(path)
        _SNAPSHOTS[key] = path
    return spark.read.parquet(_SNAPSHOTS[key])


def respondents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The survey file."""
    return snapshot(spark, sf_dir, "respondents", derive_respondents)


def yearly_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide yearly indicator file."""
    return snapshot(spark, sf_dir, "yearly", derive_yearly_indicators)


def derive_respondents(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _orders_with_nation(spark, sf_dir)
    for stage in [*STAGES[:-1], SPARK_SURVEY]:
        df = df.select(*[F.expr(e).alias(name) for name, e in stage.items()])
    return df


def country_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation")
    known = nations.select(*[F.expr(e).alias(c) for c, e in INDEX.items()])
    one = local_table(spark, [(0,)], "i int")
    return known.unionByName(one.select(*[F.expr(e).alias(c) for c, e in UNKNOWN_COUNTRY.items()]))


def lookups(spark: SparkSession) -> DataFrame:
    return local_table(spark, LOOKUP_ROWS, "Variable string, Value string, Label string, Mapped string")


def derive_yearly_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide yearly series per country and indicator, with some cells missing."""
    base = _orders_with_nation(spark, sf_dir).withColumn("y", F.year("o_orderdate") + ORDER_YEAR_SHIFT)
    per_year = base.groupBy("n_nationkey", "n_name", "y").agg(*[F.expr(e).alias(c) for c, (_, e) in SERIES.items()])
    long = per_year.unpivot(["n_nationkey", "n_name", "y"], list(SERIES), "code", "value").where(
        "not (n_nationkey = 6 and code = 'POVERTY')"
    )
    wide = long.groupBy("n_nationkey", "n_name", "code").pivot("y", list(YEARS)).agg(F.first("value"))
    names = F.create_map(*[F.lit(x) for c, (t, _) in SERIES.items() for x in (c, t)])
    return wide.select(
        F.col("n_name").alias("CountryName"),
        F.expr("'C' || cast(n_nationkey as string)").alias("CountryCode"),
        names[F.col("code")].alias("IndicatorName"),
        F.col("code").alias("IndicatorCode"),
        *[F.col(f"`{y}`").alias(f"X{y}") for y in YEARS],
    )


# ------------------------------------------------ the same tables as SQL text


def _stage_sql(columns: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {source}"


_JOINED = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"


def _quoted(v: str | None) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


def input_ctes() -> dict[str, str]:
    sql = _stage_sql(BASE, _JOINED)
    for stage in STAGES[1:]:
        sql = _stage_sql(stage, f"({sql})")
    series = " UNION ALL ".join(
        f"SELECT n_nationkey, n_name, year(o_orderdate) + {ORDER_YEAR_SHIFT} AS y, '{c}' AS code, "
        f"'{t}' AS IndicatorName, CAST({e} AS DOUBLE) AS value FROM {_JOINED} GROUP BY 1, 2, 3"
        for c, (t, e) in SERIES.items()
    )
    years = ", ".join(f"max(CASE WHEN y = {y} THEN value END) AS X{y}" for y in YEARS)
    return {
        "resp": sql,
        "idx": f"{_stage_sql(INDEX, 'nation')} UNION ALL {_stage_sql(UNKNOWN_COUNTRY, '(SELECT 1)')}",
        "lux": "SELECT * FROM (VALUES "
        + ", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in LOOKUP_ROWS)
        + ") AS t(Variable, Value, Label, Mapped)",
        "wdi": "SELECT n_name AS CountryName, 'C' || CAST(n_nationkey AS VARCHAR) AS CountryCode, IndicatorName, "
        f"code AS IndicatorCode, {years} FROM ({series}) WHERE NOT (n_nationkey = 6 AND code = 'POVERTY') "
        "GROUP BY n_name, n_nationkey, IndicatorName, code",
    }
