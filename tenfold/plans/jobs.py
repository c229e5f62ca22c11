"""The survey jobs: merge, recode, sample, clean, earnings subset, descriptives.

Each takes and returns DataFrames, so a chain of jobs is one lazy plan; a
snapshot between two of them is a cache, not a need.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenfold.functions import recode as rc
from tenfold.functions.nulls import flag, if_known, numeric_columns
from tenfold.operators.columns import column_range, select_all_of, select_as, sibling_means
from tenfold.operators.describe import (
    correlations_by_pv,
    frequency,
    mean_sd,
    missing_profile,
    pooled_correlations,
    pooled_mean_sd,
    six_numbers,
)
from tenfold.operators.filters import drop_all_missing, present
from tenfold.operators.joins import drop_listed, keep_listed, lookup_join, pin_small
from tenfold.operators.reshape import widen, year_by_round, z_scores

# ---- fixed values: the columns carried from job to job ----
COUNTRY_COLUMNS = ["CountryCode", "DataCollectedRound", "DataCollected", "Country"]
EDUCATION_VARIABLES = {"B_Q01a": "B_Q01a", "B_Q01a3": "B_Q01a3", "EDCAT6": "EDCAT6"}
DERIVED = [
    "CNTRYID", *COUNTRY_COLUMNS, "STEM", "Employed01", "Employed02", "Employed_flag", "OutOfLaborforce_flag",
    "Employment", "B_Q01a_lable", "B_Q01a_mapped", "B_Q01a3_lable", "B_Q01a3_mapped", "EDCAT6_lable",
    "EDCAT6_mapped", "Education_BQ1a", "Occupation", "Gender", "Age_group",
]
COERCED = ["Earnings_raw", "Training", "Experience_raw", "Schooling"]
FAMILIES = ["PVLIT", "PVNUM", "PVPSL"]
COUNTRY_COVARIATES = ["GDPPCAP", "Poverty", "HSCompletion", "CollegeCompletion", "Mobile", "Internet"]
# ------------------------------------------------------------


def pv_names(family: str, count: int = 10, suffix: str = "") -> list[str]:
    return [f"{family}{i}{suffix}" for i in range(1, count + 1)]


def merge_survey(respondents: DataFrame, index: DataFrame) -> DataFrame:
    """Attach country code, name and collection round to every respondent."""
    wanted = index.select("CountryID", *COUNTRY_COLUMNS, "File")
    return lookup_join(respondents, wanted, "CNTRYID", "CountryID")


def recode_survey(merged: DataFrame, lookups: DataFrame) -> DataFrame:
    """Derive field of study, employment, education, occupation and gender."""
    c = F.col
    df = merged.withColumns(
        {
            "STEM": rc.stem_field(c("B_Q01b")),
            "Employed01": rc.employed_by_work(c("C_Q01a"), c("C_Q01b")),
            "Employed02": rc.employed_by_job(c("C_Q02a"), c("C_Q02b"), c("C_Q02c")),
            "OutOfLaborforce_flag": rc.out_of_labour_force([c(v) for v in rc.OUT_OF_LABOUR_FORCE]),
        }
    )
    df = df.withColumn("Employed_flag", flag(c("Employed01") + c("Employed02") >= 1))
    df = df.withColumn("Employment", rc.employment_status(c("Employed_flag"), c("OutOfLaborforce_flag")))
    for variable, column in EDUCATION_VARIABLES.items():
        dim = select_as(
            lookups.where(c("Variable") == variable),
            {"Value": "Value", f"{variable}_lable": "Label", f"{variable}_mapped": "Mapped"},
        )
        df = lookup_join(df, dim, column, "Value")
    return df.withColumns(
        {
            "Education_BQ1a": if_known(
                c("B_Q01a_mapped") == "Foreign qualification", c("B_Q01a3_mapped"), c("B_Q01a_mapped")
            ),
            "Occupation": rc.recode(c("ISCOSKIL4"), rc.OCCUPATIONS),
            "Gender": rc.recode(c("GENDER_R"), rc.GENDERS),
        }
    )


def sample_respondents(recoded: DataFrame, selected: Sequence[str]) -> DataFrame:
    """Respondents aged 25 to 34 in the labour force, derived plus selected columns."""
    age = F.col("AGEG5LFS")
    df = recoded.where(age.isin(*rc.AGE_BANDS)).withColumn("Age_group", rc.recode(age, rc.AGE_BANDS))
    return select_all_of(df.where(F.col("Employment") != "Out of labor force"), [*DERIVED, *selected])


def country_year_values(
    yearly: DataFrame, index: DataFrame, selected: DataFrame, years: Mapping[str, str], code_column: str = "SeriesCode"
) -> DataFrame:
    """Indicators of the survey countries with the value of their collection year."""
    kept = keep_listed(keep_listed(yearly, "CountryCode", index, "CountryCode"), "IndicatorCode", selected, code_column)
    joined = lookup_join(
        kept, index.select(F.col("CountryCode").alias("__code"), "DataCollected"), "CountryCode", "__code"
    )
    span = column_range(yearly, "X2010", "X2020")
    out = joined.select(
        "CountryCode", F.col("CountryName").alias("Country"), "DataCollected", "IndicatorName",
        F.col("IndicatorCode").alias("Indicator"), *span,
    )
    return out.withColumn("Value1", year_by_round(F.col("DataCollected"), years))


def fill_indicators(values: DataFrame, fill: DataFrame | None = None) -> DataFrame:
    """Long clean indicators; ``fill`` (CountryCode, Indicator, Value[, IndicatorName]) replaces or adds values by hand.

    An added value takes the name that its indicator has in other countries, or that of ``fill``.
    """
    long = values.select("CountryCode", "IndicatorName", "Indicator", F.col("Value1").alias("Value"))
    if fill is None:
        return long
    keys = ["CountryCode", "Indicator"]
    given = F.col("IndicatorName") if "IndicatorName" in fill.columns else F.lit(None).cast("string")
    override = fill.select(*keys, F.col("Value").alias("__fill"), given.alias("__given"))
    named = long.groupBy("Indicator").agg(F.min("IndicatorName").alias("__known"))
    return long.join(override, keys, "full").join(named, "Indicator", "left").select(
        "CountryCode", F.coalesce("IndicatorName", "__given", "__known").alias("IndicatorName"), "Indicator",
        F.coalesce("__fill", "Value").alias("Value"),
    )


def country_profile(indicators: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """One row per country: raw indicators and their standard scores over countries."""
    wide = widen(indicators, "CountryCode", "Indicator", "Value", {k: f"{v}_raw" for k, v in names.items()})
    wide, _ = pin_small(wide)  # one row per country
    return z_scores(wide, {v: f"{v}_raw" for v in names.values()})


def base_sample(sample: DataFrame) -> DataFrame:
    """Named analysis columns with coerced numbers."""
    renamed = select_as(
        sample,
        {
            "Weight": "SPFWT0", "CNTRYID": "CNTRYID", **{c: c for c in COUNTRY_COLUMNS}, "STEM": "STEM",
            "Employment": "Employment", "Education": "EDCAT6_mapped", "Occupation": "Occupation", "Gender": "Gender",
            "Age": "Age_group", "Earnings_raw": "EARNHRBONUSPPP", "Training": "FNFAET12JR",
            "Experience_raw": "C_Q09_C", "Schooling": "YRSQUAL",
            **{c: c for f in FAMILIES for c in pv_names(f)},
        },
    )
    return numeric_columns(renamed, COERCED)


def clean_sample(sample: DataFrame, profile: DataFrame) -> DataFrame:
    """Drop empty rows, apply plausibility rules, standardise scores, join country values."""
    base = base_sample(sample)
    keys = ["STEM", "Education", "Occupation", *COERCED, *[c for f in FAMILIES for c in pv_names(f)]]
    df = drop_all_missing(base, keys)
    df = df.withColumns(
        {
            "Earnings": rc.plausible_earnings(F.col("Earnings_raw"), F.col("Employment")),
            "Experience_flag": rc.experience_flag(F.col("Experience_raw"), F.col("Employment"), F.col("Age")),
        }
    ).withColumn(
        "Experience", if_known(F.col("Experience_flag") == "Yes", F.col("Experience_raw"), F.lit(None).cast("double"))
    )
    df = sibling_means(df, "PVLIT", "PVNUM", "PVLITNUM")
    scored = [*pv_names("PVPSL"), *pv_names("PVLITNUM")]
    df = z_scores(df, {f"{c}_s": c for c in scored})
    return lookup_join(df, profile.withColumnRenamed("CountryCode", "__code"), "CountryCode", "__code")


def earnings_gaps(clean: DataFrame) -> DataFrame:
    """Missing earnings per country, raw and cleaned, largest share first."""
    prof = missing_profile(clean, ["Country"], {"0": "Earnings_raw", "": "Earnings"})
    return prof.select(
        "Country", "N", "nas0", "nas", (F.col("nas") - F.col("nas0")).alias("nas_diff"), "nas_p0", "nas_p"
    ).orderBy(F.col("nas_p").desc_nulls_last(), F.col("Country"))


def earnings_study(clean: DataFrame) -> DataFrame:
    """Employed respondents of countries that report any earnings."""
    silent = earnings_gaps(clean).where("nas_p = 1")
    return drop_listed(clean, "Country", silent, "Country").where("Employment = 'Employed'")


def earnings_extract(study: DataFrame) -> DataFrame:
    """Rows with earnings, columns from the weight to the last combined score."""
    return present(study, "Earnings").select(*column_range(study, "Weight", "PVLITNUM10"))


def earnings_summary(study: DataFrame) -> DataFrame:
    return six_numbers(earnings_extract(study), ["Earnings"])


def recode_audit(recoded: DataFrame) -> DataFrame:
    """Crosstabs of raw codes against recodes, stacked: ``(check, raw, recoded, n)``."""
    pairs = {
        "stem": ("B_Q01b", "STEM"),
        "employed01": ("Employed01", None),
        "employed02": ("Employed02", None),
        "out_of_labour_force": ("OutOfLaborforce_flag", None),
        "flags": ("Employed_flag", "OutOfLaborforce_flag"),
        "employment": ("Employment", None),
        "b_q01a": ("B_Q01a_lable", "B_Q01a"),
        "b_q01a3": ("B_Q01a3_lable", "B_Q01a3"),
        "b_q01a_mapped": ("B_Q01a_lable", "B_Q01a_mapped"),
        "b_q01a3_mapped": ("B_Q01a3_lable", "B_Q01a3_mapped"),
        "education": ("EDCAT6", "Education_BQ1a"),
        "occupation": ("ISCOSKIL4", "Occupation"),
        "gender": ("GENDER_R", "Gender"),
    }
    # All tables of one pass: rows fan out to (check, raw, recoded) and are
    # counted map-side before anything is shuffled.
    cells = F.array(
        *[
            F.struct(
                F.lit(name).alias("check"),
                F.col(a).cast("string").alias("raw"),
                (F.col(b).cast("string") if b else F.lit(None).cast("string")).alias("recoded"),
            )
            for name, (a, b) in pairs.items()
        ]
    )
    long = recoded.select(F.explode(cells).alias("c")).select("c.*")
    return frequency(long, ["check", "raw", "recoded"])


def pooled_descriptives(clean: DataFrame, families: Sequence[str] = ("PVLIT", "PVNUM", "PVLITNUM", "PVPSL")) -> DataFrame:
    """Mean and deviation pooled over plausible values, one row per score family."""
    per_pv = mean_sd(clean, [c for f in families for c in pv_names(f)])
    family = F.regexp_replace("name", r"\d+$", "")
    return pooled_mean_sd(per_pv.withColumn("family", family), ["family"])


def pooled_score_correlations(clean: DataFrame) -> DataFrame:
    return pooled_correlations(correlations_by_pv(clean, ["Schooling"], {"lit": "PVLIT", "num": "PVNUM", "psl": "PVPSL"}))


