"""Recodes of survey codes into analysis categories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenfold.functions.nulls import flag, if_known

# ---- fixed values: survey codes and the labels used in all results ----
STEM_FIELDS = ("5", "6", "7")
OTHER_FIELDS = ("1", "2", "3", "4", "8", "9")
OCCUPATIONS = {"1": "Skilled", "2": "White-collar", "3": "Blue-collar", "4": "Elementary"}
GENDERS = {"1": "M", "2": "F"}
AGE_BANDS = {3: "25to29", 4: "30to34"}
OUT_OF_LABOUR_FORCE = ("C_Q03_02", "C_Q03_03", "C_Q03_05", "C_Q03_08", "C_Q03_09")
EARNINGS_RANGE = (0.1, 500.0)
EXPERIENCE_CAP = {"25to29": 13, "30to34": 18}
EDUCATION_REFERENCE = "Below high school"
# ------------------------------------------------------------------------


def recode(col: Column, mapping: Mapping, default: Column | None = None) -> Column:
    """Replace listed values; others become ``default`` (NULL when absent)."""
    out = None
    for old, new in mapping.items():
        out = F.when(col == F.lit(old), F.lit(new)) if out is None else out.when(col == F.lit(old), F.lit(new))
    return out if default is None else out.otherwise(default)


def recode_text(col: Column, mapping: Mapping[str, str]) -> Column:
    """Text to text: values that are not listed stay as they are."""
    return recode(col, mapping, default=col)


def stem_field(field: Column) -> Column:
    return F.when(field.isin(*STEM_FIELDS), "STEM").when(field.isin(*OTHER_FIELDS), "Non-STEM")


def employed_by_work(c_q01a: Column, c_q01b: Column) -> Column:
    return flag(((c_q01a == "1") & c_q01a.isNotNull()) | (c_q01b == "1"))


def employed_by_job(c_q02a: Column, c_q02b: Column, c_q02c: Column) -> Column:
    return flag((c_q02a == "2") & (c_q02b == "1") & (c_q02c == "1"))


def out_of_labour_force(reasons: Sequence[Column]) -> Column:
    any_reason = reasons[0] == "1"
    for r in reasons[1:]:
        any_reason = any_reason | (r == "1")
    return flag(any_reason)


def employment_status(employed_flag: Column, out_flag: Column) -> Column:
    idle = if_known(out_flag == 1, F.lit("Out of labor force"), F.lit("Unemployed"))
    return if_known(employed_flag == 1, F.lit("Employed"), idle)


def plausible_earnings(raw: Column, employment: Column) -> Column:
    low, high = EARNINGS_RANGE
    wrong = (raw < low) | (raw > high) | (employment == "Unemployed")
    return if_known(wrong, F.lit(None).cast("double"), raw)


def experience_flag(raw: Column, employment: Column, age: Column) -> Column:
    out = F.when((raw == 0) & (employment == "Employed"), "other")
    for band, cap in EXPERIENCE_CAP.items():
        out = out.when((age == band) & (raw <= cap), "Yes")
    return out.otherwise("other")


def significance(p: Column) -> Column:
    """Stars from an already rounded p value."""
    return (
        F.when(p <= 0.001, "***").when(p <= 0.01, "**").when(p <= 0.05, "*").when(p <= 0.1, ".").otherwise("")
    )


def factor_levels(
    df: DataFrame, columns: Sequence[str], reference: Mapping[str, str] | None = None
) -> dict[str, list[str]]:
    """Sorted distinct values per column, the reference level moved to the front.

    One job for all columns: values are made distinct map-side, and only the
    levels themselves reach the driver.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("level")) for c in columns]))
    found = (
        df.select(pairs.alias("p")).select("p.name", "p.level").where(F.col("level").isNotNull()).distinct()
    )
    rows = found.collect()
    out: dict[str, list[str]] = {c: [] for c in columns}
    for r in rows:
        out[r["name"]].append(r["level"])
    for levels in out.values():
        levels.sort()
    for c, ref in (reference or {}).items():
        out[c] = relevel(out[c], ref)
    return out


def relevel(levels: Sequence[str], reference: str) -> list[str]:
    if reference not in levels:
        raise ValueError(f"reference level {reference!r} is not among {list(levels)}")
    return [reference] + [v for v in levels if v != reference]
