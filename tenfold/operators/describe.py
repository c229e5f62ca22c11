"""Missingness profiles, tables, summaries, correlations."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenfold.functions.nulls import ratio
from tenfold.operators.reshape import lengthen, pv_rows
from tenfold.session import local_table


def missing_profile(
    df: DataFrame, by: Sequence[str], values: Mapping[str, str], mean_of: str | None = None, total: str = "N"
) -> DataFrame:
    """Per group: row count, missing count and share of each ``{suffix: column}``."""
    aggs = [F.count(F.lit(1)).alias(total)]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"nas{s}") for s, c in values.items()]
    if mean_of:
        aggs.append(F.avg(mean_of).alias("avg"))
    out = df.groupBy(*by).agg(*aggs)
    return out.withColumns({f"nas_p{s}": ratio(F.col(f"nas{s}"), F.col(total)) for s in values})


def frequency(df: DataFrame, columns: Sequence[str], count: str = "n") -> DataFrame:
    """Counts per combination of values; missing values form a level."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias(count))


def crosstab(df: DataFrame, row: str, col: str, levels: Mapping[str | None, str]) -> DataFrame:
    """Wide two-way table; ``levels`` maps column values (None = missing) to names."""
    counts = frequency(df, [row, col], "__n")
    cells = [
        F.coalesce(F.sum(F.when(F.col(col).eqNullSafe(F.lit(v)), F.col("__n"))), F.lit(0)).cast("bigint").alias(name)
        for v, name in levels.items()
    ]
    return counts.groupBy(row).agg(*cells)


def agreement(df: DataFrame, left: str, right: str) -> DataFrame:
    """Counts of equal and unequal pairs; pairs with a missing value are left out."""
    same = F.col(left) == F.col(right)
    return df.select(same.alias("agree")).where(F.col("agree").isNotNull()).groupBy("agree").agg(
        F.count(F.lit(1)).alias("n")
    )


def _column_statistics(
    df: DataFrame, columns: Sequence[str], stats: Mapping[str, Callable[[Column], Column]], lanes: int = 8
) -> DataFrame:
    """One row per column.  Few columns are one wide aggregate; many are cut into
    strips of ``lanes`` columns, so neither the row count nor the aggregate grows large."""
    strips = [list(columns[i : i + lanes]) for i in range(0, len(columns), lanes)]
    width = len(strips[0])
    padded = [[*s, *[None] * (width - len(s))] for s in strips]
    if len(strips) > 1:
        values = F.array(
            *[
                F.struct(
                    F.lit(i).alias("strip"),
                    *[(F.col(c) if c else F.lit(None)).cast("double").alias(f"v{j}") for j, c in enumerate(s)],
                )
                for i, s in enumerate(padded)
            ]
        )
        data = df.select(F.explode(values).alias("x")).select("x.*")
    else:
        data = df.select(F.lit(0).alias("strip"), *[F.col(c).cast("double").alias(f"v{j}") for j, c in enumerate(columns)])
    wide = data.groupBy("strip").agg(*[fn(F.col(f"v{j}")).alias(f"{s}{j}") for j in range(width) for s, fn in stats.items()])
    names = [F.array(*[F.lit(s[j]) for s in padded])[F.col("strip")] for j in range(width)]
    rows = F.array(*[F.struct(names[j].alias("name"), *[F.col(f"{s}{j}").alias(s) for s in stats]) for j in range(width)])
    return wide.select(F.explode(rows).alias("r")).select("r.*").where(F.col("name").isNotNull())


def mean_sd(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and sample deviation of each column, one row per column."""
    return _column_statistics(df, columns, {"mean": F.avg, "sd": F.stddev_samp})


def pooled_mean_sd(per_pv: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Plain mean over plausible values of their means and deviations."""
    return per_pv.groupBy(*by).agg(F.avg("mean").alias("mean"), F.avg("sd").alias("sd"))


def correlations_by_pv(df: DataFrame, fixed: Sequence[str], families: Mapping[str, str], count: int = 10) -> DataFrame:
    """All pairwise correlations on listwise-complete rows, rounded to 2, per plausible value."""
    names = [*fixed, *families]
    rows = pv_rows(df, list(fixed), families, count).dropna(how="any", subset=names)
    pairs = list(combinations(names, 2))
    wide = rows.groupBy("pv").agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = F.explode(
        F.array(
            *[
                F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.round(F.col(f"{a}|{b}"), 2).alias("r"))
                for a, b in pairs
            ]
        )
    )
    return wide.select("pv", cells.alias("c")).select("pv", "c.left", "c.right", "c.r")


def pooled_correlations(by_pv: DataFrame) -> DataFrame:
    return by_pv.groupBy("left", "right").agg(F.avg("r").alias("r"))


# --------------------------------------------------------------- quantiles


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], final_rows: int = 1_000_000, accuracy: int = 10_000
) -> DataFrame:
    """Exact linearly interpolated quantiles of whole columns, at any size.

    Approximate percentiles only narrow the search: counts then prove that a
    bracket holds the wanted ranks, and brackets shrink until few enough
    distinct values remain to be ranked.  No task ever holds a whole column.
    """
    spark = df.sparkSession
    long = lengthen(df.select(*[F.col(c).cast("double").alias(c) for c in columns]), columns).where(
        F.col("value").isNotNull()
    )
    marks = sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-2.0 / accuracy, 2.0 / accuracy)})
    start = long.groupBy("name").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("value").alias("lo"),
        F.max("value").alias("hi"),
        F.percentile_approx("value", marks, accuracy).alias("marks"),
    )
    targets = []  # name, prob, rank (zero-based, of the lower neighbour), weight, n, lo, hi
    for r in start.collect():
        for p in probs:
            h = (r["n"] - 1) * p
            rank = math.floor(h + 1e-9)
            weight = max(0.0, h - rank)
            lo = r["lo"] if p - 2.0 / accuracy <= 0 else r["marks"][marks.index(p - 2.0 / accuracy)]
            hi = r["hi"] if p + 2.0 / accuracy >= 1 else r["marks"][marks.index(p + 2.0 / accuracy)]
            # The last two are a bracket known to hold the ranks, to go back to.
            targets.append((r["name"], float(p), rank, weight, r["n"], lo, hi, False, r["lo"], r["hi"]))
    found: list[tuple] = []
    while targets:
        frame = F.broadcast(
            local_table(spark, [(i, t[0], t[5], t[6]) for i, t in enumerate(targets)], "target int, t_name string, lo double, hi double"
            )
        )
        held = long.join(frame, F.col("name") == F.col("t_name"))
        inside = (F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi"))
        census = {
            r["target"]: r
            for r in held.groupBy("target")
            .agg(
                F.count_if(F.col("value") < F.col("lo")).alias("below"),
                F.count_if(inside).alias("inside"),
                F.approx_count_distinct(F.when(inside, F.col("value"))).alias("distinct"),
                F.percentile_approx(F.when(inside, F.col("value")), [i / 64 for i in range(65)], accuracy).alias("cuts"),
            )
            .collect()
        }
        ready, again = [], []
        for i, t in enumerate(targets):
            name, p, rank, weight, n, lo, hi, halve, safe_lo, safe_hi = t
            c = census[i]
            need = min(rank + 1, n - 1)
            if not (c["below"] <= rank and need < c["below"] + c["inside"]):
                again.append((name, p, rank, weight, n, safe_lo, safe_hi, True, safe_lo, safe_hi))
                continue
            if min(c["inside"], c["distinct"]) <= final_rows:
                ready.append((i, rank - c["below"], need - c["below"]))
                continue
            at, slack = (rank - c["below"]) / c["inside"] * 64, 128 / accuracy
            new_lo, new_hi = c["cuts"][max(0, math.floor(at - slack) - 1)], c["cuts"][min(64, math.ceil(at + slack) + 2)]
            if not halve and (new_lo, new_hi) != (lo, hi):
                again.append((name, p, rank, weight, n, new_lo, new_hi, False, lo, hi))
                continue
            # Cuts no longer narrow the bracket: halve the range of values.
            mid = lo + (hi - lo) / 2
            own = long.where(F.col("name") == name)
            split = own.agg(
                F.count_if(F.col("value") <= mid).alias("below"),
                F.max(F.when(F.col("value") <= mid, F.col("value"))).alias("last"),
                F.min(F.when(F.col("value") > mid, F.col("value"))).alias("next"),
            ).first()
            if rank < split["below"] <= need:
                found.append((name, p, split["last"] + weight * (split["next"] - split["last"])))
            elif need < split["below"]:
                again.append((name, p, rank, weight, n, lo, split["last"], True, lo, split["last"]))
            else:
                again.append((name, p, rank, weight, n, split["next"], hi, True, split["next"], hi))
        if ready:
            wanted = F.broadcast(local_table(spark, ready, "r_target int, a long, b long"))
            distinct = (
                held.where(inside)
                .join(wanted, F.col("target") == F.col("r_target"))
                .groupBy("target", "a", "b", "value")
                .agg(F.count(F.lit(1)).alias("c"))
            )
            upto = F.sum("c").over(Window.partitionBy("target").orderBy("value"))
            ranked = distinct.withColumn("upto", upto)
            picked = ranked.groupBy("target").agg(
                F.min(F.when(F.col("upto") > F.col("a"), F.col("value"))).alias("va"),
                F.min(F.when(F.col("upto") > F.col("b"), F.col("value"))).alias("vb"),
            )
            for r in picked.collect():
                name, p, _, weight, *_ = targets[r["target"]]
                found.append((name, p, r["va"] + weight * (r["vb"] - r["va"])))
        targets = again
    return local_table(spark, found, "name string, p double, value double")


#: Size of a quantile sketch; the rank error falls in proportion, to about 0.1% of all rows here.
SKETCH_SIZE = 4096


def quantile_sketches(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), size: int = SKETCH_SIZE) -> DataFrame:
    """One mergeable quantile sketch per column (and group): by, name, sketch.

    Every task sketches its own rows, so only sketches are shuffled.  The table can
    be kept and sketches of further files appended to it.  Columns (and groups)
    without a present value have no row.
    """
    values = lengthen(df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns]), columns, by)
    sketch = F.kll_sketch_agg_double("value", F.lit(size)).alias("sketch")
    return values.where(F.col("value").isNotNull()).groupBy(*by, "name").agg(sketch)


def sketched_quantiles(sketches: DataFrame, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Approximate quantiles (values that occur) of all sketches of a column (and group) together: by, name, p, value."""
    whole = sketches.groupBy(*by, "name").agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    read = [F.struct(F.lit(float(p)).alias("p"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias("value")) for p in probs]
    return whole.select(*by, "name", F.explode(F.array(*read)).alias("q")).select(*by, "name", "q.*")


def six_numbers(df: DataFrame, columns: Sequence[str], sketch_size: int | None = None) -> DataFrame:
    """Minimum, quartiles, mean, maximum and missing count, one row per column.

    Quartiles are exact; with ``sketch_size`` they are taken from sketches in one pass.
    """
    base = _column_statistics(
        df, columns, {"min": F.min, "mean": F.avg, "max": F.max, "missing": lambda c: F.count_if(c.isNull())}
    )
    probs = [0.25, 0.5, 0.75]
    q = sketched_quantiles(quantile_sketches(df, columns, size=sketch_size), probs) if sketch_size else exact_quantiles(df, columns, probs)
    quartiles = q.groupBy("name").agg(
        F.max(F.when(F.col("p") == 0.25, F.col("value"))).alias("q1"),
        F.max(F.when(F.col("p") == 0.5, F.col("value"))).alias("median"),
        F.max(F.when(F.col("p") == 0.75, F.col("value"))).alias("q3"),
    )
    return base.join(F.broadcast(quartiles), "name", "left").select(
        "name", "min", "q1", "median", "mean", "q3", "max", "missing"
    )


# --------------------------------------------------------------- histogram


def round_edges(low: float, high: float, bins: int) -> list[float]:
    """Equally spaced edges at 1, 2, 5 or 10 times a power of ten, near ``bins`` many."""
    if high == low:
        return [low - 0.5, high + 0.5]
    width = (high - low) / bins
    base = 10.0 ** math.floor(math.log10(width))
    step = base
    # A larger step is taken once it is nearer than the bias factors allow.
    for factor, bias in ((2, 1.5), (5, 2.75), (10, 1.5)):
        if factor * base - width < bias * (width - step):
            step = factor * base
    first = math.floor(low / step + 1e-7)
    last = math.ceil(high / step - 1e-7)
    return [round(i * step, 12) for i in range(first, last + 1)]


def histogram(df: DataFrame, column: str) -> DataFrame:
    """Counts in right-closed bins under the log2 bin rule; the lowest edge is included."""
    shape = df.agg(F.count(column).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    if not shape["n"]:
        return local_table(df.sparkSession, [], "bin int, lo double, hi double, n long")
    edges = round_edges(shape["lo"], shape["hi"], math.ceil(math.log2(shape["n"]) + 1))
    start, width = edges[0], (edges[-1] - edges[0]) / (len(edges) - 1)
    index = F.greatest(F.ceil((F.col(column) - start) / width - 1e-7), F.lit(1))
    counts = (
        df.where(F.col(column).isNotNull())
        .select(index.cast("int").alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    frame = local_table(
        df.sparkSession, [(i + 1, edges[i], edges[i + 1]) for i in range(len(edges) - 1)], "bin int, lo double, hi double"
    )
    return frame.join(counts, "bin", "left").select("bin", "lo", "hi", F.coalesce("c", F.lit(0)).alias("n"))


