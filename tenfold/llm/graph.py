"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenfold.llm import common


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable vertex of every vertex of ``edges`` (a long, b long): vertex, root."""
    e = stars(edges)
    return e.unionByName(e.select(F.col("root").alias("vertex"), "root").distinct())


def stars(edges: DataFrame) -> DataFrame:
    """The same without the roots themselves: vertex, root for every vertex that is not its own root.

    Each round links the larger neighbours of a vertex to its smallest one, then
    the smaller neighbours likewise, until every vertex has one smaller neighbour
    and that one has none, so each group is a star around its smallest vertex.
    Rounds are written tables; only a number per round reaches the driver, which
    still keeps what it knows of every task: a round shuffles as seldom as it can
    and drops repeated edges once.  A vertex with very many neighbours is
    aggregated, not collected.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = common.written(e, "edges")
    while not _stars(e):
        low = e.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))  # a vertex that is missing here is its own smallest one
        large = e.join(low, "b", "left").select("a", F.coalesce("m", "b").alias("b"))  # every edge still leads down
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        ends = F.explode(F.array("a", "b")).alias("a")
        e = common.written(large.join(down, "a").select(ends, F.col("m").alias("b")).where("a <> b").distinct(), "edges")
    return e.select(F.col("a").alias("vertex"), F.col("b").alias("root"))


def _stars(e: DataFrame) -> bool:
    """Whether every edge (a, b with b < a) leads to the only smaller neighbour of a, which has no smaller one itself."""
    up, down = F.lit(1).alias("up"), F.lit(0).alias("up")
    ends = e.select(F.col("a").alias("v"), up).unionByName(e.select(F.col("b").alias("v"), down))
    wrong = ends.groupBy("v").agg(F.sum("up").alias("ups"), F.min("up").alias("low")).where("ups > 1 or (ups = 1 and low = 0)")
    return not wrong.limit(1).collect()
