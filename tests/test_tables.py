"""Sources, reshapes and descriptive operators on small and skewed frames."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenfold.functions.text import estimate_text, short_number
from tenfold.operators import columns as cols
from tenfold.operators import describe as d
from tenfold.operators import reshape as rs
from tenfold.plans import binding as bind
from tenfold.session import scratch_path
from tenfold.sources import files


def test_files_are_stacked_by_name(spark):
    root = scratch_path(spark, "test-stack")
    a = spark.createDataFrame([("1", "x"), ("2", "NA")], "k string, v string")
    files.export_csv(a, f"{root}/a", blank=False)
    files.export_csv(a.select("v", "k"), f"{root}/b", blank=False)
    got = files.read_survey_files(spark, [f"{root}/a", f"{root}/b"])
    assert sorted(tuple(r) for r in got.collect() if r["v"]) == [("1", "x"), ("1", "x")]
    assert got.where("v is null").count() == 2
    files.export_csv(a.withColumnRenamed("v", "w"), f"{root}/c", blank=False)
    with pytest.raises(ValueError):
        files.read_survey_files(spark, [f"{root}/a", f"{root}/c"])
    assert files.read_survey_files(spark, [f"{root}/a", f"{root}/c"], allow_missing=True).count() == 4


def test_blank_strings_with_and_without_token(spark):
    root = scratch_path(spark, "test-blank")
    spark.createDataFrame([("k,s,n",), ("1,,",), ("2,NA,3",), ('3,"a ""b""",NA',)], "v string").coalesce(1).write.text(root)
    plain = files.read_csv(spark, root, numeric=["n"]).orderBy("k").collect()
    assert [tuple(r) for r in plain] == [("1", "", None), ("2", None, 3.0), ("3", 'a "b"', None)]
    factors = files.read_csv_factors(spark, root, numeric=["n"]).orderBy("k").collect()
    assert [r["s"] for r in factors] == [None, None, 'a "b"']


def test_column_helpers(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert cols.column_range(df, "a", "b") == ["a", "b"]
    assert cols.columns_at(df, [1, 3]) == ["a", "c"]
    with pytest.raises(ValueError):
        cols.select_all_of(df, ["a", "zz"])
    assert cols.across(df, "a", lambda c: c * 2).columns == ["a", "b", "c", "a_s"]
    assert cols.structure(df).count() == 3


def test_widen_rejects_doubled_cells(spark):
    df = spark.createDataFrame([("k", "a", 1.0), ("k", "b", 2.0)], "k string, n string, v double")
    assert tuple(rs.widen(df, "k", "n", "v", {"a": "A", "b": "B"}).first()) == ("k", 1.0, 2.0)
    with pytest.raises(Exception, match="more than one value"):
        rs.widen(df.union(df), "k", "n", "v", {"a": "A", "b": "B"}).collect()


def test_z_scores(spark):
    x = [1.0, 2.0, None, 6.0]
    got = [r["z"] for r in rs.z_scores(spark.createDataFrame([(v,) for v in x], "x double"), {"z": "x"}).collect()]
    full = np.array([1.0, 2.0, 6.0])
    want = (full - full.mean()) / full.std(ddof=1)
    assert np.allclose([g for g in got if g is not None], want) and got[2] is None


@pytest.mark.parametrize("final_rows", [1_000_000, 40])
def test_exact_quantiles_with_a_hot_value(spark, final_rows):
    rng = random.Random(5)
    x = [7.0] * 1000 + [rng.gauss(7, 2) for _ in range(2000)]
    y = [float(v) for v in range(3000)]
    df = spark.createDataFrame(list(zip(x, y)), "x double, y double").repartition(8)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = {(r["name"], r["p"]): r["value"] for r in d.exact_quantiles(df, ["x", "y"], probs, final_rows=final_rows, accuracy=100).collect()}
    for name, data in (("x", x), ("y", y)):
        for p in probs:
            assert got[name, p] == pytest.approx(np.quantile(data, p), abs=1e-12), (name, p)


def test_round_edges():
    assert d.round_edges(0.3, 9.7, 5) == [0, 2, 4, 6, 8, 10]
    assert d.round_edges(0, 100, 14)[:3] == [0, 10, 20]
    assert d.round_edges(-1.2, 1.3, 10) == pytest.approx([-1.2 + 0.2 * i for i in range(14)])
    assert d.round_edges(3, 3, 5) == [2.5, 3.5]


def test_histogram_counts_are_right_closed(spark):
    df = spark.createDataFrame([(v,) for v in [0.0, 1.0, 1.0, 1.5, 2.0, 4.0]], "x double")
    got = {(r["lo"], r["hi"]): r["n"] for r in d.histogram(df, "x").collect()}
    assert got == {(0.0, 1.0): 3, (1.0, 2.0): 2, (2.0, 3.0): 0, (3.0, 4.0): 1}


def test_pooled_correlation_uses_rounded_cells(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=400)
    data = {"s": base + rng.normal(size=400)}
    for i in (1, 2):
        data[f"A{i}"] = base + rng.normal(size=400)
        data[f"B{i}"] = base + rng.normal(size=400)
    data["s"][3] = np.nan
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in zip(*data.values())], ", ".join(f"{k} double" for k in data))
    by_pv = d.correlations_by_pv(df, ["s"], {"a": "A", "b": "B"}, count=2)
    got = {(r["left"], r["right"]): r["r"] for r in d.pooled_correlations(by_pv).collect()}
    keep = ~np.isnan(data["s"])
    want = np.mean([round(float(np.corrcoef(data[f"A{i}"][keep], data[f"B{i}"][keep])[0, 1]), 2) for i in (1, 2)])
    assert got["a", "b"] == pytest.approx(want)


def test_crosstab_and_agreement(spark):
    df = spark.createDataFrame([("x", "1"), ("x", None), (None, "1"), ("1", "1")], "a string, b string")
    rows = {r["a"]: (r["one"], r["missing"]) for r in d.crosstab(df, "a", "b", {"1": "one", None: "missing"}).collect()}
    assert rows == {"x": (1, 1), None: (1, 0), "1": (1, 0)}
    assert {r["agree"]: r["n"] for r in d.agreement(df, "a", "b").collect()} == {False: 1, True: 1}


def test_report_text(spark):
    df = spark.createDataFrame([(0.5, 0.1234), (0.0, -0.0001), (-1.25, 10.0)], "a double, b double")
    assert [r[0] for r in df.select(estimate_text(F.col("a"), F.col("b"), F.lit("*"))).collect()] == ["0.5 (0.123)*", "0 (0)*", "-1.25 (10)*"]
    assert df.select(short_number(F.lit(100.0))).first()[0] == "100"
    assert df.select(short_number(F.lit(None).cast("double"))).first()[0] == "NA"


def test_bound_columns_keep_missing_keys(spark):
    from tenfold.operators.joins import bind_columns

    a = spark.createDataFrame([("x", 1), (None, 2)], "k string, a int")
    b = spark.createDataFrame([("x", 3), (None, 4)], "k string, b int")
    assert {tuple(r) for r in bind_columns(a, b, ["k"]).collect()} == {("x", 1, 3), (None, 2, 4)}


def test_fill_adds_and_replaces_indicators(spark):
    from tenfold.plans.jobs import fill_indicators

    values = spark.createDataFrame([("A", "Gross product", "GDP", 1.0), ("A", "People", "POP", None)], "CountryCode string, IndicatorName string, Indicator string, Value1 double")
    fill = spark.createDataFrame([("A", "POP", 7.0), ("B", "GDP", 8.0)], "CountryCode string, Indicator string, Value double")
    got = {tuple(r) for r in fill_indicators(values, fill).collect()}
    assert got == {("A", "Gross product", "GDP", 1.0), ("A", "People", "POP", 7.0), ("B", "Gross product", "GDP", 8.0)}


def test_cluster_needs_a_shared_folder():
    import pytest

    from tenfold.session import shared_folder

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())


def test_sketches_merge_within_their_rank_error(spark):
    """Sketches of parts, kept as a table and merged, give quantiles whose ranks are off by less than 0.5%."""
    rng = random.Random(5)
    data = [(i % 7, rng.lognormvariate(0, 2) if i % 3 else 1.0, None if i % 2 else float(i)) for i in range(60_000)]
    df = spark.createDataFrame(data, "part int, x double, y double").withColumn("z", F.lit(None).cast("double"))
    path = scratch_path(spark, "sketches")
    d.quantile_sketches(df, ["x", "y", "z"], by=["part"]).write.parquet(path)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {(r["name"], r["p"]): r["value"] for r in d.sketched_quantiles(spark.read.parquet(path), probs).collect()}
    exact = {(r["name"], r["p"]): r["value"] for r in d.exact_quantiles(df, ["x", "y"], probs).collect()}
    assert got.keys() == exact.keys()
    for at, name in ((1, "x"), (2, "y")):
        values = np.sort([r[at] for r in data if r[at] is not None])
        for p in probs:
            low, high = np.searchsorted(values, got[name, p], "left") / len(values), np.searchsorted(values, got[name, p], "right") / len(values)
            assert low - 0.005 <= p <= high + 0.005
    rows = {r["name"]: r for r in d.six_numbers(df, ["x", "z"], sketch_size=200).collect()}
    assert rows["x"]["q1"] <= rows["x"]["median"] <= rows["x"]["q3"] and rows["z"]["median"] is None and rows["z"]["missing"] == 60_000


def test_nearest_year(spark):
    rows = [("a", 1.0, None, 3.0), ("a", None, None, 3.0), ("a", None, None, None), ("b", 1.0, 2.0, None), ("?", 1.0, 2.0, 3.0), (None, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "round string, X1 double, X2 double, X3 double")
    near = rs.nearest_year(F.col("round"), {"a": 2, "b": 3}, {1: "X1", 2: "X2", 3: "X3"})
    got = [tuple(r) for r in df.select(near["value"], near["year"]).collect()]
    assert got == [(1.0, 1), (3.0, 3), (None, None), (2.0, 2), (None, None), (None, None)]


def test_derived_tables_are_written_in_short_methods(spark, tmp_path):
    """Whole-stage code too long for the JVM to compile was interpreted."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before, seen = spark.conf.get(name), []

    def build(session, sf_dir):
        seen.append(session.conf.get(name))
        return session.range(3).toDF("k")

    assert bind.snapshot(spark, str(tmp_path), "short methods", build).count() == 3
    assert int(seen[0]) <= 8000 and spark.conf.get(name) == before


def test_tasks_of_the_derivation_grow_with_the_orders(spark, monkeypatch):
    sf_dir = "/root/testdata/sf0.001"
    orders = bind.table(spark, sf_dir, "orders").count()
    monkeypatch.setattr(bind, "ORDERS_PER_TASK", orders // 40)
    assert bind.derive_respondents(spark, sf_dir).rdd.getNumPartitions() >= 40


def test_scores_rounded_by_whole_numbers_are_the_decimal_ones(spark):
    scores = [c for c in bind.SURVEY if c.startswith("PV")]
    assert all("rint" in bind.SPARK_SURVEY[c] for c in scores)
    # Keys of every residue class of each noise, with every country's shift.
    th = bind.EFFECTS["th"]
    rows = spark.range(40_000).selectExpr("id * 7919 + id % 25 as k", "cast(id % 25 as int) as n").selectExpr("k", "n", f"{th} as th")
    wrong = [F.count_if(~F.expr(bind.SURVEY[c]).eqNullSafe(F.expr(bind.SPARK_SURVEY[c]))).alias(c) for c in scores]
    assert set(rows.agg(*wrong).first()) == {0}
