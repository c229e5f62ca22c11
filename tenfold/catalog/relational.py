"""Sources, projections, filters, joins, reshapes, sorts and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tenfold.catalog import base as b
from tenfold.catalog.base import query, rounded
from tenfold.functions import nulls
from tenfold.functions import recode as rc
from tenfold.functions.text import estimate_text, short_number
from tenfold.operators import columns as cols
from tenfold.operators import joins
from tenfold.operators.filters import complete_cases, drop_all_missing, present
from tenfold.operators.reshape import lengthen, nearest_year, order_within, pv_rows, widen, year_by_round, z_scores
from tenfold.plans import binding as bind
from tenfold.plans import jobs
from tenfold.session import scratch_path
from tenfold.sources import files

PV = bind.PV
FILE_COLUMNS = ["resp_id", "CNTRYID", "GENDER_R", "B_Q01b", "EARNHRBONUSPPP", "SPFWT0", "PVLIT1", "PVLIT7"]
FILE_NUMBERS = ["resp_id", "CNTRYID", "EARNHRBONUSPPP", "SPFWT0", "PVLIT1", "PVLIT7"]
FILE_SQL = (
    "SELECT CAST(resp_id AS DOUBLE) AS resp_id, CAST(CNTRYID AS DOUBLE) AS CNTRYID, GENDER_R, B_Q01b, "
    "TRY_CAST(EARNHRBONUSPPP AS DOUBLE) AS EARNHRBONUSPPP, SPFWT0, PVLIT1, PVLIT7 FROM resp"
)


def _write_waves(spark, sf_dir):
    """The respondents as five CSV folders, columns in a different order in each; every row is in one of them."""
    held = scratch_path(spark, "waves-rows")
    wave = F.coalesce(F.pmod("resp_id", F.lit(5)), F.lit(0)).alias("wave")
    b.respondents(spark, sf_dir).select(wave, *FILE_COLUMNS).write.partitionBy("wave").parquet(held)  # the survey is derived once
    resp, root = spark.read.parquet(held), scratch_path(spark, "waves")
    paths = []
    for r in range(5):
        order = FILE_COLUMNS[r:] + FILE_COLUMNS[:r]
        paths.append(f"{root}/wave{r}")
        files.export_csv(resp.where(F.col("wave") == r).select(*order), paths[-1], blank=False)
    return paths


@query("src_01_stack_survey_files", FILE_SQL, ("resp",))
def src_01(spark, sf_dir):
    stacked = files.read_survey_files(spark, _write_waves(spark, sf_dir))
    return nulls.numeric_columns(stacked, FILE_NUMBERS).select(*FILE_COLUMNS)


@query("src_02_csv_read", FILE_SQL, ("resp",))
def src_02(spark, sf_dir):
    path = scratch_path(spark, "csv")
    files.export_csv(b.respondents(spark, sf_dir).select(*FILE_COLUMNS), path, blank=False)
    return files.read_csv(spark, path, schema=files.text_schema(FILE_COLUMNS), numeric=FILE_NUMBERS)


@query(
    "src_03_csv_factors",
    "SELECT name, level, row_number() OVER (PARTITION BY name ORDER BY level <> 'Below high school', level) AS position, n "
    "FROM (SELECT 'Education' AS name, Education AS level, count(*) AS n FROM clean WHERE Education IS NOT NULL GROUP BY 2 "
    "UNION ALL SELECT 'Gender', Gender, count(*) FROM clean WHERE Gender IS NOT NULL GROUP BY 2)",
    ("clean",),
)
def src_03(spark, sf_dir):
    path = scratch_path(spark, "factors")
    files.export_csv(b.clean(spark, sf_dir).select("Education", "Gender", "Earnings"), path)
    df = files.read_csv_factors(spark, path, numeric=["Earnings"])
    levels = rc.factor_levels(df, ["Education", "Gender"], {"Education": rc.EDUCATION_REFERENCE})
    order = F.broadcast(
        spark.createDataFrame(
            [(c, v, i + 1) for c, vs in levels.items() for i, v in enumerate(vs)], "name string, level string, position long"
        )
    )
    seen = lengthen(df.select(*levels), list(levels), value="level").groupBy("name", "level").agg(F.count(F.lit(1)).alias("n"))
    return seen.join(order, ["name", "level"])


@query(
    "src_04_lookup_sheet",
    "SELECT Country, CountryCode, count(*) AS n FROM merged GROUP BY ALL",
    ("merged",),
)
def src_04(spark, sf_dir):
    root = scratch_path(spark, "sheets")
    sheets = [f"{root}/index.parquet", f"{root}/lookups.parquet"]
    files.write_snapshot(bind.country_index(spark, sf_dir), sheets[0])
    files.write_snapshot(bind.lookups(spark), sheets[1])
    index = files.read_lookup(spark, sheets, 1)
    return jobs.merge_survey(b.respondents(spark, sf_dir), index).groupBy("Country", "CountryCode").agg(F.count(F.lit(1)).alias("n"))


@query("src_05_snapshot", "SELECT CNTRYID, CountryCode, Country, count(*) AS n, sum(resp_id)::BIGINT AS ids FROM merged GROUP BY ALL", ("merged",))
def src_05(spark, sf_dir):
    path = scratch_path(spark, "snapshot")
    files.write_snapshot(b.merged(spark, sf_dir).select("resp_id", "CNTRYID", "CountryCode", "Country"), path, ["CountryCode"])
    return (
        files.read_snapshot(spark, path)
        .groupBy("CNTRYID", "CountryCode", "Country")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("resp_id").alias("ids"))
    )


EXTRACT = ["Weight", "Country", "STEM", "Employment", "Earnings_raw", "Training", "PVLIT1", "PVPSL10"]


@query("snk_01_csv_export", f"SELECT {', '.join(EXTRACT)} FROM base", ("base",))
def snk_01(spark, sf_dir):
    path = scratch_path(spark, "export")
    files.export_csv(jobs.base_sample(b.sample(spark, sf_dir)).select(*EXTRACT), path)
    return files.read_csv_factors(
        spark, path, numeric=["Weight", "Earnings_raw", "Training", "PVLIT1", "PVPSL10"], schema=files.text_schema(EXTRACT)
    )


@query(
    "snk_02_blank_nulls",
    "SELECT coalesce(Country, '') AS Country, coalesce(STEM, '') AS STEM, coalesce(Education, '') AS Education, "
    "coalesce(CAST(CNTRYID AS VARCHAR), '') AS CNTRYID, count(*) AS n FROM base GROUP BY ALL",
    ("base",),
)
def snk_02(spark, sf_dir):
    out = nulls.blank_nulls(jobs.base_sample(b.sample(spark, sf_dir)).select("Country", "STEM", "Education", "CNTRYID"))
    return out.groupBy(*out.columns).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- projections


@query("prj_01_select_rename", "SELECT Value, Label AS EDCAT6_lable, Mapped AS EDCAT6_mapped, n FROM lux LEFT JOIN "
       "(SELECT EDCAT6, count(*) AS n FROM resp GROUP BY 1) r ON r.EDCAT6 IS NOT DISTINCT FROM Value WHERE Variable = 'EDCAT6'",
       ("lux", "resp"))
def prj_01(spark, sf_dir):
    dim = cols.select_as(
        bind.lookups(spark).where("Variable = 'EDCAT6'"), {"Value": "Value", "EDCAT6_lable": "Label", "EDCAT6_mapped": "Mapped"}
    )
    counts = b.respondents(spark, sf_dir).groupBy(F.col("EDCAT6").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return joins.lookup_join(dim, counts, "Value", "code")


@query("prj_02_column_range", f"SELECT {', '.join(f'X{y}' for y in bind.YEARS)}, CountryCode FROM wdi", ("wdi",))
def prj_02(spark, sf_dir):
    wide = bind.yearly_indicators(spark, sf_dir)
    return wide.select(*cols.column_range(wide, "X2010", "X2020"), "CountryCode")


@query(
    "prj_03_positions",
    "SELECT " + ", ".join(f"count({f}{i}) AS {f}{i}" for f in jobs.FAMILIES for i in PV) + " FROM base",
    ("base",),
)
def prj_03(spark, sf_dir):
    base = jobs.base_sample(b.sample(spark, sf_dir))
    names = cols.columns_at(base, range(17, 47))
    return base.agg(*[F.count(n).alias(n) for n in names])


@query("prj_04_select_by_list", f"SELECT {', '.join(bind.SELECTED_COLUMNS)} FROM resp", ("resp",))
def prj_04(spark, sf_dir):
    listed = spark.createDataFrame([(n,) for n in bind.SELECTED_COLUMNS], "Name string")
    return cols.select_all_of(b.respondents(spark, sf_dir), cols.names_in(listed, "Name"))


@query(
    "prj_05_derived_columns",
    "SELECT resp_id, Employed01, Employed02, Employed_flag, OutOfLaborforce_flag, Employment FROM recoded",
    ("recoded",),
)
def prj_05(spark, sf_dir):
    return b.recoded(spark, sf_dir).select(
        "resp_id", "Employed01", "Employed02", "Employed_flag", "OutOfLaborforce_flag", "Employment"
    )


@query(
    "prj_06_across_prefix",
    "SELECT " + ", ".join(f"round(sum(PVPSL{i} / 100), 4) AS PVPSL{i}_s" for i in PV) + " FROM base",
    ("base",),
)
def prj_06(spark, sf_dir):
    out = cols.across(jobs.base_sample(b.sample(spark, sf_dir)), "PVPSL", lambda c: c / 100)
    return out.agg(*[F.round(F.sum(f"PVPSL{i}_s"), 4).alias(f"PVPSL{i}_s") for i in PV])


@query("prj_07_coerce_numbers", "SELECT Country, Earnings_raw, Training, Experience_raw, Schooling FROM base", ("base",))
def prj_07(spark, sf_dir):
    return jobs.base_sample(b.sample(spark, sf_dir)).select("Country", *jobs.COERCED)


@query("prj_08_rename_all", "SELECT CountryCode, " + ", ".join(f"{n}_raw" for n in bind.INDICATORS.values()) + " FROM rawprof", ("rawprof",))
def prj_08(spark, sf_dir):
    wide = widen(b.indicators(spark, sf_dir), "CountryCode", "Indicator", "Value", {c: c for c in bind.INDICATORS})
    return cols.rename_all(wide, {c: f"{n}_raw" for c, n in bind.INDICATORS.items()})


@query("prj_09_sibling_means", "SELECT Country, " + ", ".join(f"round(PVLITNUM{i}, 6) AS PVLITNUM{i}" for i in PV) + " FROM ruled", ("ruled",))
def prj_09(spark, sf_dir):
    base = drop_all_missing(
        jobs.base_sample(b.sample(spark, sf_dir)),
        ["STEM", "Education", "Occupation", *jobs.COERCED, *[c for f in jobs.FAMILIES for c in jobs.pv_names(f)]],
    )
    out = cols.sibling_means(base, "PVLIT", "PVNUM", "PVLITNUM")
    return rounded(out.select("Country", *jobs.pv_names("PVLITNUM")))


@query(
    "prj_10_row_slice",
    "SELECT resp_id, C_Q02a, C_Q02b, C_Q02c, Employed02 FROM recoded ORDER BY resp_id LIMIT 51 OFFSET 9",
    ("recoded",),
)
def prj_10(spark, sf_dir):
    return cols.row_slice(
        b.recoded(spark, sf_dir).select("resp_id", "C_Q02a", "C_Q02b", "C_Q02c", "Employed02"), ["resp_id"], 10, 60
    )


# -------------------------------------------------------------------- filters


@query("flt_01_member", "SELECT resp_id, AGEG5LFS FROM resp WHERE AGEG5LFS IN (3, 4)", ("resp",))
def flt_01(spark, sf_dir):
    return b.respondents(spark, sf_dir).where(F.col("AGEG5LFS").isin(3, 4)).select("resp_id", "AGEG5LFS")


@query("flt_02_not_equal", "SELECT resp_id, Employment FROM recoded WHERE Employment <> 'Out of labor force'", ("recoded",))
def flt_02(spark, sf_dir):
    return b.recoded(spark, sf_dir).where(F.col("Employment") != "Out of labor force").select("resp_id", "Employment")


@query(
    "flt_03_not_member_keeps_missing",
    "SELECT resp_id, B_Q01b FROM resp WHERE coalesce(B_Q01b NOT IN ('5', '6', '7', 'V'), true)",
    ("resp",),
)
def flt_03(spark, sf_dir):
    resp = b.respondents(spark, sf_dir)
    return resp.where(nulls.not_member(F.col("B_Q01b"), ["5", "6", "7", "V"])).select("resp_id", "B_Q01b")


@query("flt_04_present", "SELECT Country, Earnings FROM study WHERE Earnings IS NOT NULL", ("study",))
def flt_04(spark, sf_dir):
    return present(b.study(spark, sf_dir), "Earnings").select("Country", "Earnings")


@query("flt_05_drop_all_missing", "SELECT Country, STEM, Education, PVLIT1 FROM kept", ("kept",))
def flt_05(spark, sf_dir):
    keys = ["STEM", "Education", "Occupation", *jobs.COERCED, *[c for f in jobs.FAMILIES for c in jobs.pv_names(f)]]
    return drop_all_missing(jobs.base_sample(b.sample(spark, sf_dir)), keys).select("Country", "STEM", "Education", "PVLIT1")


@query("flt_06_filter_on_aggregate", "SELECT Country, N, nas FROM gaps WHERE nas = N", ("gaps",))
def flt_06(spark, sf_dir):
    return jobs.earnings_gaps(b.clean(spark, sf_dir)).where("nas_p = 1").select("Country", "N", "nas")


@query(
    "flt_07_complete_cases",
    " UNION ALL ".join(
        f"SELECT '{spec}' AS spec, {i} AS pv, count(*) AS n FROM study WHERE Earnings IS NOT NULL AND Gender IS NOT NULL "
        "AND Age IS NOT NULL AND STEM IS NOT NULL AND Education IS NOT NULL AND Training IS NOT NULL AND Experience "
        f"IS NOT NULL AND Occupation IS NOT NULL AND Country IS NOT NULL AND PVLITNUM{i}_s IS NOT NULL{extra}"
        for spec, extra in (
            ("full", "".join(f" AND {c} IS NOT NULL" for c in jobs.COUNTRY_COVARIATES)),
            ("refined", " AND GDPPCAP IS NOT NULL AND HSCompletion IS NOT NULL AND Internet IS NOT NULL"),
        )
        for i in PV
    ),
    ("study",),
)
def flt_07(spark, sf_dir):
    own = ["Earnings", "Gender", "Age", "STEM", "Education", "Training", "Experience", "Occupation", "Country"]
    cases = complete_cases(b.study(spark, sf_dir), own)
    parts = []
    for spec, extra in (("full", jobs.COUNTRY_COVARIATES), ("refined", ["GDPPCAP", "HSCompletion", "Internet"])):
        ok = complete_cases(cases, extra).agg(*[F.count(f"PVLITNUM{i}_s").alias(str(i)) for i in PV])
        parts.append(lengthen(ok, [str(i) for i in PV], name="pv", value="n").select(F.lit(spec).alias("spec"), F.col("pv").cast("int"), "n"))
    return reduce(lambda x, y: x.unionByName(y), parts)


@query(
    "flt_08_earnings_rule",
    "SELECT Country, Employment, Earnings_raw, Earnings FROM ruled",
    ("ruled",),
)
def flt_08(spark, sf_dir):
    return b.clean(spark, sf_dir).select("Country", "Employment", "Earnings_raw", "Earnings")


@query("flt_09_experience_rule", "SELECT Age, Employment, Experience_raw, Experience_flag, Experience FROM ruled", ("ruled",))
def flt_09(spark, sf_dir):
    return b.clean(spark, sf_dir).select("Age", "Employment", "Experience_raw", "Experience_flag", "Experience")


# ---------------------------------------------------------------------- joins


@query("jn_01_left_lookup", "SELECT resp_id, CNTRYID, CountryCode, Country, DataCollected FROM merged", ("merged",))
def jn_01(spark, sf_dir):
    return b.merged(spark, sf_dir).select("resp_id", "CNTRYID", "CountryCode", "Country", "DataCollected")


@query(
    "jn_02_left_same_key",
    "SELECT Country, CountryCode, count(*) AS n, count(Poverty) AS with_poverty, round(max(GDPPCAP), 6) AS gdp "
    "FROM clean GROUP BY ALL",
    ("clean",),
)
def jn_02(spark, sf_dir):
    return rounded(
        b.clean(spark, sf_dir)
        .groupBy("Country", "CountryCode")
        .agg(F.count(F.lit(1)).alias("n"), F.count("Poverty").alias("with_poverty"), F.max("GDPPCAP").alias("gdp"))
    )


@query(
    "jn_03_listed_in_tables",
    "SELECT CountryCode, IndicatorCode, X2011 FROM wdi WHERE CountryCode IN (SELECT CountryCode FROM idx) AND "
    f"IndicatorCode IN ({', '.join(repr(c) for c in bind.INDICATORS)})",
    ("wdi", "idx"),
)
def jn_03(spark, sf_dir):
    kept = joins.keep_listed(bind.yearly_indicators(spark, sf_dir), "CountryCode", bind.country_index(spark, sf_dir), "CountryCode")
    return joins.keep_listed(kept, "IndicatorCode", b.selected_series(spark), "SeriesCode").select(
        "CountryCode", "IndicatorCode", "X2011"
    )


@query(
    "jn_04_not_listed_in_table",
    "SELECT Country, Employment, count(*) AS n FROM clean WHERE NOT EXISTS (SELECT 1 FROM gaps g WHERE g.nas = g.N AND "
    "g.Country IS NOT DISTINCT FROM clean.Country) GROUP BY ALL",
    ("clean", "gaps"),
)
def jn_04(spark, sf_dir):
    clean = b.clean(spark, sf_dir)
    silent = jobs.earnings_gaps(clean).where("nas_p = 1")
    return joins.drop_listed(clean, "Country", silent, "Country").groupBy("Country", "Employment").agg(F.count(F.lit(1)).alias("n"))


@query(
    "jn_05_bind_columns",
    "SELECT Country, avg(PVLIT1) IS NOT NULL AS has_lit, round(avg(PVLIT1), 6) AS m, round(stddev_samp(PVLIT1), 6) AS s "
    "FROM clean GROUP BY Country",
    ("clean",),
)
def jn_05(spark, sf_dir):
    clean = b.clean(spark, sf_dir)
    means = clean.groupBy("Country").agg(F.avg("PVLIT1").alias("m"))
    spreads = clean.groupBy("Country").agg(F.stddev_samp("PVLIT1").alias("s"))
    return rounded(joins.bind_columns(means, spreads, ["Country"]).select("Country", F.col("m").isNotNull().alias("has_lit"), "m", "s"))


# -------------------------------------------------------------------- reshape


@query("rsh_01_long_to_wide", "SELECT * FROM rawprof", ("rawprof",))
def rsh_01(spark, sf_dir):
    return widen(b.indicators(spark, sf_dir), "CountryCode", "Indicator", "Value", {c: f"{n}_raw" for c, n in bind.INDICATORS.items()})


@query(
    "rsh_02_wide_to_long",
    " UNION ALL ".join(f"SELECT resp_id, 'PVLIT{i}' AS name, PVLIT{i} AS value FROM resp" for i in PV),
    ("resp",),
)
def rsh_02(spark, sf_dir):
    return lengthen(b.respondents(spark, sf_dir), jobs.pv_names("PVLIT"), ["resp_id"])


@query(
    "rsh_03_aligned_unpivot",
    " UNION ALL ".join(f"SELECT resp_id, {i} AS pv, PVLIT{i} AS lit, PVNUM{i} AS num, PVPSL{i} AS psl FROM resp" for i in PV),
    ("resp",),
)
def rsh_03(spark, sf_dir):
    return pv_rows(b.respondents(spark, sf_dir), ["resp_id"], {"lit": "PVLIT", "num": "PVNUM", "psl": "PVPSL"})


def _indicators_with_round(spark, sf_dir):
    wide = joins.keep_listed(bind.yearly_indicators(spark, sf_dir), "IndicatorCode", b.selected_series(spark), "SeriesCode")
    index = bind.country_index(spark, sf_dir).select(F.col("CountryCode").alias("code"), "DataCollected")
    return joins.lookup_join(wide, index, "CountryCode", "code")


@query(
    "rsh_05_year_by_round",
    "SELECT CountryCode, Indicator, DataCollected, Value1 FROM yearval",
    ("yearval",),
)
def rsh_05(spark, sf_dir):
    return _indicators_with_round(spark, sf_dir).select(
        "CountryCode", F.col("IndicatorCode").alias("Indicator"), "DataCollected",
        year_by_round(F.col("DataCollected"), bind.ROUND_YEARS).alias("Value1"),
    )


_TARGETS = {label: int(column[1:]) for label, column in bind.ROUND_YEARS.items()}


@query(
    "rsh_05_nearest_year",
    'SELECT CountryCode, Indicator, DataCollected, arg_min(v, k) FILTER (v IS NOT NULL) AS "Value1", '
    'CAST(arg_min(y, k) FILTER (v IS NOT NULL) AS INTEGER) AS "Year" FROM (SELECT *, 2 * abs(y - target) + CAST(y > target AS INTEGER) AS k '
    "FROM (SELECT CountryCode, Indicator, DataCollected, CASE DataCollected "
    + " ".join(f"WHEN '{label}' THEN {year}" for label, year in _TARGETS.items())
    + f" END AS target, unnest([{', '.join(f'X{y}' for y in bind.YEARS)}]) AS v, unnest([{', '.join(map(str, bind.YEARS))}]) AS y "
    "FROM yearval)) GROUP BY ALL",
    ("yearval",),
)
def rsh_05_nearest(spark, sf_dir):
    near = nearest_year(F.col("DataCollected"), _TARGETS, {y: f"X{y}" for y in bind.YEARS})
    return _indicators_with_round(spark, sf_dir).select(
        "CountryCode", F.col("IndicatorCode").alias("Indicator"), "DataCollected", near["value"].alias("Value1"), near["year"].alias("Year"),
    )


@query(
    "win_01_order_within_facet",
    "SELECT Education, Country, round(m, 8) AS m, row_number() OVER (PARTITION BY Education ORDER BY m NULLS LAST, Country) "
    "AS position FROM (SELECT Education, Country, avg(PVLIT1) AS m FROM clean WHERE Education IS NOT NULL GROUP BY ALL)",
    ("clean",),
)
def win_01(spark, sf_dir):
    means = b.clean(spark, sf_dir).where("Education IS NOT NULL").groupBy("Education", "Country").agg(F.avg("PVLIT1").alias("m"))
    return rounded(order_within(means, "Education", "m", "Country"), 8)


@query("srt_01_sort_desc", "SELECT Country, round(nas_p, 6) AS nas_p FROM gaps ORDER BY nas_p DESC NULLS LAST, Country", ("gaps",))
def srt_01(spark, sf_dir):
    return rounded(jobs.earnings_gaps(b.clean(spark, sf_dir)).select("Country", "nas_p"))


@query(
    "srt_02_sort_two_keys",
    "SELECT Employment, Country, round((count(*) - count(Earnings)) / count(*), 6) AS nas_p FROM clean GROUP BY ALL "
    "ORDER BY Employment, 3 DESC",
    ("clean",),
)
def srt_02(spark, sf_dir):
    prof = b.clean(spark, sf_dir).groupBy("Employment", "Country").agg(
        (F.count_if(F.col("Earnings").isNull()) / F.count(F.lit(1))).alias("nas_p")
    )
    return rounded(prof).orderBy(F.col("Employment").asc_nulls_last(), F.col("nas_p").desc_nulls_last())


@query("set_01_stack_by_name", "SELECT resp_id, GENDER_R, region FROM resp", ("resp",))
def set_01(spark, sf_dir):
    resp = b.respondents(spark, sf_dir)
    parts = []
    for r in range(5):
        part = resp.where(F.coalesce(F.pmod("resp_id", F.lit(5)), F.lit(0)) == r)
        parts.append(part.select("resp_id", "GENDER_R", "region") if r % 2 else part.select("region", "GENDER_R", "resp_id"))
    return reduce(lambda x, y: x.unionByName(y), parts).select("resp_id", "GENDER_R", "region")


# ----------------------------------------------------------- scalar functions


@query(
    "sc_01_unknown_condition",
    "SELECT Employed01, Employed02, OutOfLaborforce_flag, count(*) AS n FROM flagged GROUP BY ALL",
    ("flagged",),
)
def sc_01(spark, sf_dir):
    return b.recoded(spark, sf_dir).groupBy("Employed01", "Employed02", "OutOfLaborforce_flag").agg(F.count(F.lit(1)).alias("n"))


@query("sc_02_case_when", "SELECT B_Q01b, STEM, ISCOSKIL4, Occupation, count(*) AS n FROM recoded GROUP BY ALL", ("recoded",))
def sc_02(spark, sf_dir):
    return b.recoded(spark, sf_dir).groupBy("B_Q01b", "STEM", "ISCOSKIL4", "Occupation").agg(F.count(F.lit(1)).alias("n"))


@query(
    "sc_03_recode",
    "SELECT Employment, CASE Employment WHEN 'Employed' THEN 1 WHEN 'Unemployed' THEN 0 END AS Employed, "
    "CASE Employment WHEN 'Employed' THEN 'Works' ELSE Employment END AS label, count(*) AS n FROM recoded GROUP BY ALL",
    ("recoded",),
)
def sc_03(spark, sf_dir):
    e = F.col("Employment")
    out = b.recoded(spark, sf_dir).select(
        "Employment",
        rc.recode(e, {"Employed": 1, "Unemployed": 0}).alias("Employed"),
        rc.recode_text(e, {"Employed": "Works"}).alias("label"),
    )
    return out.groupBy("Employment", "Employed", "label").agg(F.count(F.lit(1)).alias("n"))


@query("sc_04_membership", "SELECT coalesce(EDCAT6 IN ('1', '2'), false) AS low, count(*) AS n FROM resp GROUP BY 1", ("resp",))
def sc_04(spark, sf_dir):
    low = nulls.is_member(F.col("EDCAT6"), ["1", "2"])
    return b.respondents(spark, sf_dir).groupBy(low.alias("low")).agg(F.count(F.lit(1)).alias("n"))


@query("sc_05_is_missing", "SELECT Training IS NULL AS no_training, Schooling IS NULL AS no_schooling, count(*) AS n FROM base GROUP BY ALL", ("base",))
def sc_05(spark, sf_dir):
    base = jobs.base_sample(b.sample(spark, sf_dir))
    keys = [F.col("Training").isNull().alias("no_training"), F.col("Schooling").isNull().alias("no_schooling")]
    return base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query("sc_06_log", "SELECT Country, round(ln(Earnings), 6) AS LogEarnings FROM study", ("study",))
def sc_06(spark, sf_dir):
    return b.study(spark, sf_dir).select("Country", F.round(F.ln("Earnings"), 6).alias("LogEarnings"))


@query(
    "sc_07_exp",
    "SELECT Country, round(exp(avg(ln(Earnings))), 6) AS geometric_mean FROM study GROUP BY Country",
    ("study",),
)
def sc_07(spark, sf_dir):
    return b.study(spark, sf_dir).groupBy("Country").agg(F.round(F.exp(F.avg(F.ln("Earnings"))), 6).alias("geometric_mean"))


@query(
    "sc_08_sqrt_abs_square",
    "SELECT Country, round(sqrt(avg(PVLIT1_z * PVLIT1_z)), 6) AS rms, round(max(abs(PVLIT1_z)), 6) AS widest FROM "
    "(SELECT Country, PVLIT1 - 270 AS PVLIT1_z FROM clean) GROUP BY Country",
    ("clean",),
)
def sc_08(spark, sf_dir):
    dev = F.col("PVLIT1") - 270
    return rounded(
        b.clean(spark, sf_dir).groupBy("Country").agg(F.sqrt(F.avg(dev * dev)).alias("rms"), F.max(F.abs(dev)).alias("widest"))
    )


@query(
    "sc_09_round",
    "SELECT Country, round(PVLIT1, 2) AS r2, round_even(PVLIT1, 0) AS r0 FROM clean",
    ("clean",),
)
def sc_09(spark, sf_dir):
    c = F.col("PVLIT1")
    return b.clean(spark, sf_dir).select("Country", F.round(c, 2).alias("r2"), F.bround(c, 0).alias("r0"))


@query(
    "sc_10_row_statistics",
    "SELECT resp_id, round(avg(v), 6) AS mean, round(var_samp(v), 5) AS var FROM ("
    + " UNION ALL ".join(f"SELECT resp_id, PVLIT{i} AS v FROM resp" for i in PV)
    + ") GROUP BY resp_id HAVING count(v) = 10",
    ("resp",),
)
def sc_10(spark, sf_dir):
    # Across the columns of one row: no shuffle is needed.
    parts = [F.col(c) for c in jobs.pv_names("PVLIT")]
    mean = sum(parts[1:], parts[0]) / len(parts)
    centred = [(p - F.col("mean")) * (p - F.col("mean")) for p in parts]
    rows = b.respondents(spark, sf_dir).select("resp_id", *jobs.pv_names("PVLIT"), mean.alias("mean")).where("mean IS NOT NULL")
    var = sum(centred[1:], centred[0]) / (len(parts) - 1)
    return rows.select("resp_id", F.round("mean", 6).alias("mean"), F.round(var, 5).alias("var"))


@query(
    "sc_13_report_text",
    "SELECT Country, coalesce(rtrim(rtrim(printf('%.3f', round(m, 3)), '0'), '.'), 'NA') || ' (' || "
    "coalesce(rtrim(rtrim(printf('%.3f', round(s, 3)), '0'), '.'), 'NA') || ')' AS reported, rtrim(rtrim(printf('%.3f', share), '0'), '.') AS share FROM (SELECT Country, 50 * avg(ln(PVLIT1)) AS m, "
    "stddev_samp(PVLIT1) AS s, CASE WHEN count(Earnings) = 0 THEN 0e0 ELSE 0.5e0 END AS share FROM clean GROUP BY Country)",
    ("clean",),
)
def sc_13(spark, sf_dir):
    stats = b.clean(spark, sf_dir).groupBy("Country").agg(
        (50 * F.avg(F.ln("PVLIT1"))).alias("m"),
        F.stddev_samp("PVLIT1").alias("s"),
        F.when(F.count("Earnings") == 0, 0.0).otherwise(0.5).alias("share"),
    )
    return stats.select("Country", estimate_text(F.col("m"), F.col("s")).alias("reported"), short_number(F.col("share")).alias("share"))


@query("sc_14_category_text", "SELECT DISTINCT Country AS country FROM clean", ("clean",))
def sc_14(spark, sf_dir):
    return b.clean(spark, sf_dir).select(F.col("Country").cast("string").alias("country")).distinct()


@query(
    "sc_15_code_comparison",
    "SELECT AGEG5LFS = 3 AS younger, CAST(AGEG5LFS AS VARCHAR) = '4' AS older, GENDER_R = '1' AS male, count(*) AS n "
    "FROM resp GROUP BY ALL",
    ("resp",),
)
def sc_15(spark, sf_dir):
    keys = [
        (F.col("AGEG5LFS") == 3).alias("younger"),
        (F.col("AGEG5LFS").cast("string") == "4").alias("older"),
        (F.col("GENDER_R") == "1").alias("male"),
    ]
    return b.respondents(spark, sf_dir).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def _levels_frame(spark, df, columns, reference=None):
    levels = rc.factor_levels(df, columns, reference)
    return spark.createDataFrame(
        [(c, i + 1, v) for c, vs in levels.items() for i, v in enumerate(vs)], "name string, position long, level string"
    )


_LEVEL_SQL = " UNION ALL ".join(f"SELECT '{c}' AS name, {c} AS level FROM clean WHERE {c} IS NOT NULL GROUP BY 2" for c in ("Education", "Occupation", "STEM"))


@query(
    "cat_01_levels",
    f"SELECT name, row_number() OVER (PARTITION BY name ORDER BY level) AS position, level FROM ({_LEVEL_SQL})",
    ("clean",),
)
def cat_01(spark, sf_dir):
    return _levels_frame(spark, b.clean(spark, sf_dir), ["Education", "Occupation", "STEM"])


@query(
    "cat_02_reference_level",
    "SELECT name, row_number() OVER (PARTITION BY name ORDER BY level NOT IN ('Below high school', 'White-collar'), level) "
    f"AS position, level FROM ({_LEVEL_SQL}) WHERE name <> 'STEM'",
    ("clean",),
)
def cat_02(spark, sf_dir):
    refs = {"Education": rc.EDUCATION_REFERENCE, "Occupation": "White-collar"}
    return _levels_frame(spark, b.clean(spark, sf_dir), ["Education", "Occupation"], refs)


# ------------------------------------------------------------- standard scores


@query(
    "ag_16_z_scores",
    "SELECT resp_id, " + ", ".join(f"round((PVLIT{i} - avg(PVLIT{i}) OVER ()) / stddev_samp(PVLIT{i}) OVER (), 6) AS z{i}" for i in PV) + " FROM resp",
    ("resp",),
)
def ag_16(spark, sf_dir):
    out = z_scores(b.respondents(spark, sf_dir), {f"z{i}": f"PVLIT{i}" for i in PV})
    return rounded(out.select("resp_id", *[f"z{i}" for i in PV]))


@query(
    "ag_17_country_z_scores",
    "SELECT CountryCode, " + ", ".join(f"round({n}, 6) AS {n}" for n in bind.INDICATORS.values()) + " FROM prof",
    ("prof",),
)
def ag_17(spark, sf_dir):
    return rounded(b.profile(spark, sf_dir).select("CountryCode", *bind.INDICATORS.values()))


# ----------------------------------------------------------------------- jobs


@query("job_01_merge", "SELECT resp_id, CNTRYID, CountryCode, DataCollectedRound, DataCollected, Country, File FROM merged", ("merged",))
def job_01(spark, sf_dir):
    return b.merged(spark, sf_dir).select("resp_id", "CNTRYID", *jobs.COUNTRY_COLUMNS, "File")


@query("job_02_recode_sample", "SELECT * FROM sample", ("sample",))
def job_02(spark, sf_dir):
    return b.sample(spark, sf_dir)


@query("job_03_country_values", "SELECT * FROM yearval", ("yearval",))
def job_03(spark, sf_dir):
    return b.year_values(spark, sf_dir)


_SCORES = [f"PVPSL{i}_s" for i in PV] + [f"PVLITNUM{i}_s" for i in PV] + list(bind.INDICATORS.values())
_CLEAN_SQL = f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in _SCORES)}) FROM "


@query("job_04_clean_sample", _CLEAN_SQL + "clean", ("clean",))
def job_04(spark, sf_dir):
    out = b.derive_clean(spark, sf_dir)
    return out.withColumns({c: F.round(c, 6) for c in _SCORES})


@query("job_05_earnings_study", _CLEAN_SQL + "study", ("study",))
def job_05(spark, sf_dir):
    out = b.study(spark, sf_dir)
    return out.withColumns({c: F.round(c, 6) for c in _SCORES})
