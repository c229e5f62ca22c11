"""The two model studies: earnings (linear) and employment (logistic)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenfold.functions.recode import EDUCATION_REFERENCE, factor_levels, recode
from tenfold.models.fitting import Results, fit_linear
from tenfold.models.glmm import fit_logistic, fit_null
from tenfold.models import pool
from tenfold.models.ols import nested_f, ols_tables
from tenfold.models.runs import RunTable
from tenfold.models.spec import Design, ModelSpec
from tenfold.plans.jobs import COUNTRY_COVARIATES, pv_names
from tenfold.session import local_table

# ---- fixed values: model vocabulary, random parts and labels ----
PERSON_TERMS = ("PV", "Gender", "Age", "STEM", "Education", "Training", "Experience", "Occupation")
REFINED_COUNTRY_TERMS = ("GDPPCAP", "HSCompletion", "Internet")
RANDOM_PARTS = {
    1: (),
    2: ("PV",),
    3: ("PV", "Gender"),
    4: ("PV", "STEM"),
    5: ("PV", "Training"),
    6: ("PV", "Gender", "STEM"),
    7: ("PV", "Gender", "Training"),
    8: ("PV", "STEM", "Training"),
}
TRIAL_PARTS = [
    ("PV",), ("PV", "Gender"), ("PV", "Age"), ("PV", "STEM"), ("PV", "Education"), ("PV", "Training"), ("PV", "Experience"),
    ("PV", "Occupation"), ("PV", "Gender", "STEM"), ("PV", "Gender", "Training"), ("PV", "Gender", "Experience"),
]
CATEGORIES = ("Gender", "Age", "STEM", "Education", "Occupation")
FAMILIES = {"lnm": "PVLITNUM", "psm": "PVPSL"}
TERM_LABELS = {
    "(Intercept)": "(Intercept)", "GenderM": "Male", "Age30to34": "Age (30to34)", "STEMSTEM": "STEM",
    "EducationBachelor's degree or beyond": "Education (Bachelor's degree or beyond)",
    "EducationHigh school or equivalent": "Education (High school or equivalent)",
    "EducationSome college": "Education (Some college)", "Training": "Training", "Experience": "Experience",
    "OccupationElementary": "Occupation (Elementary)", "OccupationSkilled": "Occupation (Skilled)",
    "OccupationWhite-collar": "Occupation (White-collar)", "GDPPCAP": "GDPPCAP", "HSCompletion": "HSCompletion",
    "Internet": "Internet",
}
SCORE_LABELS = {"lnm": "Literacy + Numeracy", "psm": "PSTRE"}
MODE_LABELS = {
    "lnm": {"PV": "LiteracyNumeracy", "GenderM": "Male", "STEMSTEM": "STEM"},
    "psm": {"PV": "PSTRE", "GenderM": "Male", "STEMSTEM": "STEM"},
}
# ------------------------------------------------------------------


def linear_specs(family: str, parts=range(1, 7)) -> list[ModelSpec]:
    full = PERSON_TERMS + tuple(COUNTRY_COVARIATES)
    refined = PERSON_TERMS + REFINED_COUNTRY_TERMS
    return [
        ModelSpec(f"{family}{i}{suffix}", terms, RANDOM_PARTS[i])
        for i in parts
        for suffix, terms in (("", full), ("_ref", refined))
    ]


def logistic_specs(family: str, parts=range(1, 9)) -> list[ModelSpec]:
    full = PERSON_TERMS + tuple(COUNTRY_COVARIATES)
    out = [
        ModelSpec(f"{family}{i}{suffix}", terms, RANDOM_PARTS[i])
        for i in parts
        for suffix, terms in (("", full), ("_ref", PERSON_TERMS))
    ]
    kept = {"lnm": (7, "HSCompletion"), "psm": (8, "Mobile")}[family]
    if kept[0] in parts:
        out.append(ModelSpec(f"{family}{kept[0]}_ref2", PERSON_TERMS + (kept[1],), RANDOM_PARTS[kept[0]]))
    return out


def trial_specs() -> list[ModelSpec]:
    """The full model with each candidate random part, for comparison by AIC."""
    full = PERSON_TERMS + tuple(COUNTRY_COVARIATES)
    return [ModelSpec(" + ".join(("1", *part)), full, part) for part in TRIAL_PARTS]


def study_design(df: DataFrame, response: str, family: str, group_level=tuple(COUNTRY_COVARIATES)) -> Design:
    """Levels come from all rows read; reference levels sort first unless set."""
    levels = factor_levels(df, CATEGORIES, {"Education": EDUCATION_REFERENCE})
    return Design(
        response=response,
        group="Country",
        pv=tuple(pv_names(FAMILIES[family], suffix="_s")),
        categories={c: tuple(v) for c, v in levels.items()},
        discrete=("Training",),
        continuous=("Experience",),
        group_level=tuple(group_level),
    )


def earnings_frame(study: DataFrame) -> DataFrame:
    return study.withColumn("LogEarnings", F.ln("Earnings"))


def employment_frame(clean: DataFrame) -> DataFrame:
    return clean.withColumn("Employed", recode(F.col("Employment"), {"Employed": 1.0, "Unemployed": 0.0}))


def earnings_equations(study: DataFrame):
    """Schooling and experience equations of log earnings, with and without the squared term."""
    df = earnings_frame(study).withColumn("I(Experience^2)", F.col("Experience") * F.col("Experience"))
    design = Design(response="LogEarnings", group=None, continuous=("Schooling", "Experience", "I(Experience^2)"))
    specs = [
        ModelSpec("quadratic", ("Schooling", "Experience", "I(Experience^2)")),
        ModelSpec("linear", ("Schooling", "Experience")),
    ]
    coef, fits = ols_tables(df, design, specs)
    return coef, fits, nested_f(fits, "linear", "quadratic")


def earnings_models(study: DataFrame, family: str, specs: list[ModelSpec] | None = None, run: RunTable | None = None, **options) -> Results:
    df = earnings_frame(study)
    design, specs = study_design(df, "LogEarnings", family), specs or linear_specs(family)
    if run is None:
        return fit_linear(df, design, specs, **options)
    name = f"earnings {family}"
    done = run.finished(name)
    if any((s.name, pv) not in done for s in specs for pv in range(1, len(design.pv) + 1)):
        run.append(name, fit_linear(df, design, specs, skip=done, **options).rows)
    return run.results(name, specs)


def null_design(response: str) -> Design:
    return Design(response=response, group="Country")


def earnings_null_model(study: DataFrame, **options) -> Results:
    return fit_linear(earnings_frame(study), null_design("LogEarnings"), [ModelSpec("null", ())], **options)


def term_labels(spark, family: str) -> DataFrame:
    labels = {**TERM_LABELS, "PV": SCORE_LABELS[family]}
    return local_table(spark, list(labels.items()), "term string, label string")


def employment_models(clean: DataFrame, family: str, specs: list[ModelSpec] | None = None, run: RunTable | None = None, **options) -> Results:
    df = employment_frame(clean)
    return fit_logistic(df, study_design(df, "Employed", family), specs or logistic_specs(family), run=run, study=f"employment {family}", **options)


def employment_null_model(clean: DataFrame) -> DataFrame:
    return fit_null(employment_frame(clean), "Employed", "Country")


# ------------------------------------------------------------ whole studies
#
# A study's result is one tidy table: ``part`` says which report a row is of.

STUDY_COLUMNS = {
    "part": "string", "family": "string", "spec": "string", "pv": "int", "term": "string", "label": "string", "est": "double", "se": "double",
    "stat": "double", "df": "double", "p_value": "double", "low": "double", "high": "double", "aic": "double", "place": "int", "reported": "string",
}
#: Models whose effects are drawn, by study and family.
DRAWN = {"employment": {"lnm": "lnm7_ref", "psm": "psm5_ref"}, "earnings": {"lnm": "lnm6_ref", "psm": "psm6_ref"}}
#: Models looked at by themselves: (name, draw).
SINGLE = {"lnm": [("lnm8", 1), ("lnm8_ref", 1)], "psm": [("psm5", 1), ("psm5_ref", 1)]}
#: Draws of the trial random parts, and of the refined earnings model whose random terms are deleted.
TRIAL_DRAWS, DELETED = (1, 5), ("psm5_ref", 3)
#: Random slope on another draw than the fixed part's.
OTHER_DRAW = (1, "PVPSL7_s")


def _part(part: str, df: DataFrame, family: str | None = None, /, **columns) -> DataFrame:
    given = {"part": F.lit(part), "family": F.lit(family), **columns}
    return df.select(*[F.coalesce(given[c], F.lit(None)).cast(t).alias(c) if c in given else F.lit(None).cast(t).alias(c) for c, t in STUDY_COLUMNS.items()])


def _fixed_part(family: str, fixed: DataFrame, test: str) -> DataFrame:
    p, c = pool.pool_fixed(fixed, test), F.col
    framed = pool.interval_frame(p, term_labels(fixed.sparkSession, family))
    extra = {"df": c("df")} if test == "t" else {}
    return _part("fixed", framed, family, spec=c("spec"), term=c("term"), label=c("label"), est=c("theta"), se=c("se_new"), stat=c(f"{test}_value"),
                 p_value=c("p_value"), low=c("conf_low"), high=c("conf_high"), reported=c("reported"), **extra)


def _random_part(family: str, random: DataFrame) -> DataFrame:
    c = F.col
    return _part("random", pool.pool_random(random), family, spec=c("spec"), term=c("component"), est=c("variance"), se=c("std"), reported=c("reported"))


def _aic_part(part: str, family: str, fits: DataFrame) -> DataFrame:
    """Mean AIC of each model and its place among those of its family (one row per model, so one window is enough)."""
    c, table = F.col, pool.pool_aic(fits)
    return _part(part, table, family, spec=c("spec"), aic=c("aic"), place=F.row_number().over(Window.orderBy(c("aic").asc_nulls_last(), "spec")))


def _single_part(part: str, family: str | None, r: Results, keep) -> DataFrame:
    """Fixed effects, variances and AIC of single fits."""
    c = F.col
    fixed = _part(part, r.fixed.where(keep), family, spec=c("spec"), pv=c("pv"), term=c("term"), est=c("est"), se=c("se"), df=c("df"))
    name = F.concat_ws("-", "grp", F.coalesce("term", F.lit("NA")), F.coalesce("term2", F.lit("NA")))
    random = _part(part, r.random.where(keep), family, spec=c("spec"), pv=c("pv"), term=name, est=c("vcov"), se=c("sdcor"))
    fit = _part(part, r.fits.where(keep), family, spec=c("spec"), pv=c("pv"), term=F.lit("logLik"), est=c("loglik"), df=c("npar"), aic=c("aic"))
    return fixed.unionByName(random).unionByName(fit)


def _test_part(family: str, spec: str, pv: int, tests: DataFrame) -> DataFrame:
    c = F.col
    rows = tests.where(c("pv") == pv)
    return _part("deletion", rows, family, spec=F.lit(spec), pv=c("pv"), term=c("term"), est=c("loglik"), stat=c("lrt"), df=c("df"), p_value=c("p"), aic=c("aic"))


def _of(specs: list[tuple[str, int]]):
    return F.struct("spec", "pv").isin(*[F.struct(F.lit(s).alias("spec"), F.lit(pv).alias("pv")) for s, pv in specs])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def employment_study(clean: DataFrame, run: RunTable | None = None, draws: list[int] | None = None) -> DataFrame:
    """The null model, all 34 models pooled (fixed and random effects, AIC), the trial random parts and the models looked at singly.

    With ``run``, finished fits are kept, so that a study that was stopped goes on;
    without, all fits of a family share their passes.  ``draws`` limits the pooled models to some draws.
    """
    c = F.col
    null = employment_null_model(clean)
    parts = [
        _part("null", null, spec=F.lit("null"), term=F.lit("(Intercept)"), est=c("intercept"), se=c("se"), stat=c("intercept") / c("se"), aic=c("aic")),
        _part("null", null, spec=F.lit("null"), term=F.lit("Country-(Intercept)-NA"), est=c("variance"), se=c("sd")),
    ]
    for family in FAMILIES:
        r = employment_models(clean, family, run=run, draws=draws)
        parts += [_fixed_part(family, r.fixed, "z"), _random_part(family, r.random), _aic_part("aic", family, r.fits)]
        parts.append(_single_part("single", family, r, _of(SINGLE[family])))
    trial = employment_models(clean, "lnm", trial_specs(), run=run, draws=list(TRIAL_DRAWS))
    parts.append(_part("trial", trial.fits, "lnm", spec=c("spec"), pv=c("pv"), aic=c("aic")))
    return _union(parts)


def earnings_study(study: DataFrame, run: RunTable | None = None) -> DataFrame:
    """Both earnings equations with their F test, the null model, all 24 models pooled, the trial random parts and the deletion tests."""
    c = F.col
    coef, fits, test = earnings_equations(study)
    ols = coef.join(fits.select("spec", "aic", c("df_residual").alias("dfr")), "spec")
    null = earnings_null_model(study)
    parts = [
        _part("equation", ols, spec=c("spec"), term=c("term"), est=c("est"), se=c("se"), stat=c("t"), df=c("dfr"), p_value=c("p"), low=c("low"), high=c("high"), aic=c("aic")),
        _part("nested F", test, spec=F.lit("linear in quadratic"), stat=c("f"), df=c("df"), p_value=c("p"), est=c("sum_sq")),
        _single_part("null", None, null, F.lit(True)),
    ]
    for family in FAMILIES:
        r = earnings_models(study, family, run=run)
        parts += [_fixed_part(family, r.fixed, "t"), _random_part(family, r.random), _aic_part("aic", family, r.fits)]
    trial = earnings_models(study, "lnm", trial_specs(), skip=_but(trial_specs(), *TRIAL_DRAWS))
    parts.append(_part("trial", trial.fits, "lnm", spec=c("spec"), pv=c("pv"), aic=c("aic")))
    name, pv = DELETED
    one = [s for s in linear_specs("psm") if s.name == name]
    refined = earnings_models(study, "psm", one, tests=True, skip=_but(one, pv))
    parts.append(_test_part("psm", name, pv, refined.tests))
    pv, other = OTHER_DRAW
    parts.append(_test_part("psm", f"psm, slope of {other}", pv, other_draw_model(study, pv).tests))
    return _union(parts)


def _but(specs: list[ModelSpec], *draws: int) -> set[tuple[str, int]]:
    """Every fit of the models but those of the given draws."""
    return {(s.name, pv) for s in specs for pv in range(1, len(pv_names("PV")) + 1) if pv not in draws}


def other_draw_model(study: DataFrame, *draws: int) -> Results:
    """The full model on each draw in turn (or the given ones), with the random slope on another draw, and its deletion tests."""
    df = earnings_frame(study)
    base = study_design(df, "LogEarnings", "psm")
    design = replace(base, continuous=(*base.continuous, OTHER_DRAW[1]))
    full = PERSON_TERMS + tuple(COUNTRY_COVARIATES)
    specs = [ModelSpec("trial", full, (OTHER_DRAW[1], "Gender"))]
    return fit_linear(df, design, specs, tests=True, skip=_but(specs, *draws) if draws else ())


def effect_frames(clean: DataFrame, study: DataFrame) -> DataFrame:
    """Interval frames of the four models that are drawn, their caterpillar frames (first draw) and the linear ones' deletion tests."""
    c, parts = F.col, []
    for kind, families in DRAWN.items():
        for family, name in families.items():
            of = {"employment": logistic_specs, "earnings": linear_specs}[kind](family)
            spec = [s for s in of if s.name == name]
            if kind == "employment":
                r = employment_models(clean, family, spec)
                modes = employment_models(clean, family, spec, modes=True, draws=[1]).modes
            else:
                r = earnings_models(study, family, spec)
                first = earnings_models(study, family, spec, modes=True, tests=True, skip=_but(spec, 1))
                modes = first.modes
            p = pool.pool_fixed(r.fixed, "z" if kind == "employment" else "t")
            frame = pool.interval_frame(p, term_labels(clean.sparkSession, family), intercept=kind == "employment")
            parts.append(_part(f"{kind} intervals", frame, family, spec=c("spec"), term=c("term"), label=c("label"), est=c("est_exp"), low=c("l95_exp"), high=c("u95_exp")))
            rows = pool.caterpillar_frame(modes, MODE_LABELS[family])
            parts.append(_part(f"{kind} modes", rows, family, spec=c("spec"), pv=F.lit(1), term=c("country"), label=c("ranef"), est=c("condval"), se=c("condsd"), low=c("low"), high=c("high"), place=c("position")))
            if kind == "earnings":
                parts.append(_test_part(family, name, 1, first.tests))
    return _union(parts)
