"""Pooling over plausible values (Rubin's rules) and report frames."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenfold.functions.recode import recode_text, significance
from tenfold.functions.tails import normal_p, t_p
from tenfold.functions.text import estimate_text
from tenfold.models.spec import INTERCEPT
from tenfold.operators.reshape import order_within
from tenfold.session import ship_package


def pool_fixed(fixed: DataFrame, test: str = "z") -> DataFrame:
    """One row per model and term from ``(spec, pv, term, est, se[, df])``.

    theta is the mean estimate, b the variance between draws, u the mean
    sampling variance, v = u + (1 + 1/M) b.
    """
    ship_package(fixed.sparkSession)
    aggs = [
        F.avg("est").alias("theta"),
        F.var_samp("est").alias("b"),
        F.avg(F.col("se") * F.col("se")).alias("u"),
        F.count(F.lit(1)).alias("draws"),
    ]
    if test == "t":
        aggs.append(F.bround(F.avg("df"), 0).alias("df"))
    out = fixed.groupBy("spec", "term").agg(*aggs)
    out = out.withColumn("v", F.col("u") + (1 + 1 / F.col("draws")) * F.col("b"))
    out = out.withColumn("se_new", F.sqrt("v"))
    stat = f"{test}_value"
    out = out.withColumn(stat, F.col("theta") / F.col("se_new"))
    p = normal_p(stat) if test == "z" else t_p(stat, "df")
    out = out.withColumn("p_value", F.round(p, 5)).withColumn("p_sign", significance(F.col("p_value")))
    return out.withColumn("reported", estimate_text(F.col("theta"), F.col("se_new"), F.col("p_sign"))).drop("draws")


def pool_random(random: DataFrame) -> DataFrame:
    """Mean variance and mean deviation per variance component; components are named
    ``group-term-other`` with the text ``NA`` where a part is absent."""
    key = F.concat_ws("-", "grp", F.coalesce("term", F.lit("NA")), F.coalesce("term2", F.lit("NA")))
    out = random.groupBy("spec", key.alias("component")).agg(F.avg("vcov").alias("variance"), F.avg("sdcor").alias("std"))
    return out.withColumn("reported", estimate_text(F.col("variance"), F.col("std")))


def pool_aic(fits: DataFrame) -> DataFrame:
    return fits.groupBy("spec").agg(F.avg("aic").alias("aic"))


def aic_table(pooled: DataFrame) -> DataFrame:
    return pooled.orderBy(F.col("aic").asc_nulls_last(), "spec")


def draws_wide(fixed: DataFrame, draws: int = 10, df: bool = False) -> DataFrame:
    """Per-draw estimates side by side: ``est_pv1 .. se_pv1 .. [df_pv1 ..]``."""
    kinds = ["est", "se", *(["df"] if df else [])]
    cells = [F.max(F.when(F.col("pv") == i, F.col(k))).alias(f"{k}_pv{i}") for k in kinds for i in range(1, draws + 1)]
    return fixed.groupBy("spec", "term").agg(*cells)


def interval_frame(pooled: DataFrame, labels: DataFrame | None = None, intercept: bool = True) -> DataFrame:
    """95% normal intervals of pooled estimates, also exponentiated; labels join by term."""
    out = pooled if intercept else pooled.where(F.col("term") != INTERCEPT)
    out = out.withColumns(
        {"conf_low": F.col("theta") - 1.96 * F.col("se_new"), "conf_high": F.col("theta") + 1.96 * F.col("se_new")}
    ).withColumns({"est_exp": F.exp("theta"), "l95_exp": F.exp("conf_low"), "u95_exp": F.exp("conf_high")})
    if labels is not None:
        out = out.join(F.broadcast(labels.select("term", "label")), "term", "left")
    return out


def caterpillar_frame(modes: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """Modes with 1.39 deviations either side, relabelled, in order within each term."""
    out = modes.select(
        "spec",
        F.col("grp").alias("country"),
        recode_text(F.col("term"), labels).alias("ranef"),
        "condval",
        "condsd",
        (F.col("condval") - 1.39 * F.col("condsd")).alias("low"),
        (F.col("condval") + 1.39 * F.col("condsd")).alias("high"),
    )
    return order_within(out.withColumn("facet", F.concat_ws("/", "spec", "ranef")), "facet", "condval", "country").drop("facet")
