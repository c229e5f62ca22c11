"""Whole studies: every report of both studies, resumed runs, pooled rows against the fits."""

import pytest
from pyspark.sql import functions as F

from tenfold.catalog import base as b
from tenfold.models.runs import RunTable
from tenfold.plans import studies as st
from tests.conftest import SF


@pytest.fixture(scope="module")
def earnings(spark):
    return st.earnings_study(b.study(spark, SF)).toPandas()


def test_earnings_study_is_whole(earnings):
    assert list(earnings.columns) == list(st.STUDY_COLUMNS)
    specs = {s.name for f in st.FAMILIES for s in st.linear_specs(f)}
    for part in ("fixed", "random", "aic"):
        assert set(earnings[earnings.part == part].spec) == specs and len(specs) == 24
    trial = earnings[earnings.part == "trial"]
    assert len(trial) == 22 and set(trial.pv) == set(st.TRIAL_DRAWS) and trial.aic.notna().all()
    assert set(earnings[earnings.part == "equation"].spec) == {"quadratic", "linear"}
    tests = earnings[earnings.part == "deletion"]
    assert set(tests.spec) == {"psm5_ref", f"psm, slope of {st.OTHER_DRAW[1]}"} and tests.p_value.between(0, 1).sum() == 4
    places = earnings[(earnings.part == "aic") & (earnings.family == "lnm")].sort_values("place")
    assert places.place.tolist() == list(range(1, 13)) and places.aic.is_monotonic_increasing


def test_a_stopped_earnings_study_goes_on(spark, earnings):
    study, run = b.study(spark, SF), RunTable(spark)
    some = st.linear_specs("lnm")[:3]
    st.earnings_models(study, "lnm", some, run=run)
    before = run.rows().count()
    again = RunTable(spark, run.path)
    r = st.earnings_models(study, "lnm", run=again)
    assert again.finished("earnings lnm") == {(s.name, pv) for s in st.linear_specs("lnm") for pv in range(1, 11)}
    assert again.rows().where(F.col("spec").isin([s.name for s in some])).count() == before  # not fitted again
    aic = {x["spec"]: x["aic"] for x in r.fits.groupBy("spec").agg(F.avg("aic").alias("aic")).collect()}
    want = earnings[(earnings.part == "aic") & (earnings.family == "lnm")].set_index("spec").aic
    assert aic == pytest.approx(want.to_dict(), abs=1e-6)


def test_employment_study_is_whole(spark):
    clean = b.clean(spark, SF)
    got = st.employment_study(clean, draws=[1, 5]).toPandas()
    specs = {s.name for f in st.FAMILIES for s in st.logistic_specs(f)}
    assert len(specs) == 34
    for part in ("fixed", "random", "aic"):
        assert set(got[got.part == part].spec) == specs
    fixed = got[got.part == "fixed"]
    assert fixed.reported.notna().all() and fixed.p_value.between(0, 1).all() and fixed.label.notna().sum() > 300
    single = got[got.part == "single"]
    assert set(single.spec) == {n for v in st.SINGLE.values() for n, _ in v} and set(single.pv) == {1}
    assert len(got[got.part == "trial"]) == 22 and len(got[got.part == "null"]) == 2


def test_effect_frames_are_whole(spark):
    got = st.effect_frames(b.clean(spark, SF), b.study(spark, SF)).toPandas()
    for kind, families in st.DRAWN.items():
        for family, name in families.items():
            mine = got[(got.family == family) & (got.spec == name)]
            frame, modes = mine[mine.part == f"{kind} intervals"], mine[mine.part == f"{kind} modes"]
            assert ("(Intercept)" in set(frame.term)) == (kind == "employment")
            assert (frame.low < frame.est).all() and (frame.est < frame.high).all()
            assert modes.groupby("label").place.apply(lambda x: sorted(x) == list(range(1, len(x) + 1))).all()
            assert (mine.part == "deletion").sum() == (4 if kind == "earnings" else 0)
