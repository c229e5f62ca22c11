"""Exact length histogram of encoded documents, and what its suffix sums answer.

A document is counted once under its encoded length.  Totals, quantiles and the
tokens left after truncation at any context limit follow from sums over the
histogram, whose size depends on the longest document and not on their number.

Defined cases: a missing or empty text has length 0 and is counted; repeated
rows count each; a missing group name counts as the empty name; an empty table
has an empty histogram; further columns are not carried.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenfold.llm import common
from tenfold.llm.tokens import encoder

#: Lengths that are summed together before the suffix sums run.
BLOCK = 1024


def _measure(batches, path: str):
    enc = encoder(path)
    for batch in common.blocks(batches, "text"):
        found = [len(enc.encode(t)) // enc.width for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.int64())], [*batch.schema.names[1:], "length"])


def histogram(docs: DataFrame, path: str, by: Sequence[str] = ()) -> DataFrame:
    """Documents per encoded length (and group): by, length, docs."""
    groups = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in by]
    measured = common.map_arrow(
        docs.select(common.text_column().alias("text"), *groups), partial(_measure, path=path),
        ", ".join([*[f"`{c}` string" for c in by], "length long"]),
    )
    return measured.groupBy(*by, "length").agg(F.count(F.lit(1)).alias("docs"))


def suffix_sums(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """For each length that occurs, taken as a context limit.

    by, context_limit, docs, docs_longer, docs_total, tokens_kept (each document
    cut at the limit), tokens_cut, tokens_total.  Sums run over blocks of lengths
    first and inside each block then.
    """
    cells = hist.withColumn("_block", F.expr(f"length div {BLOCK}")).withColumn("_tokens", F.col("length") * F.col("docs"))
    blocks = cells.groupBy(*by, "_block").agg(F.sum("docs").alias("_d"), F.sum("_tokens").alias("_t"))
    group = Window.partitionBy(*by)
    later = group.orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        *by, "_block",
        F.coalesce(F.sum("_d").over(later), F.lit(0)).alias("_docs_later"),
        F.coalesce(F.sum("_t").over(later), F.lit(0)).alias("_tokens_later"),
        F.sum("_d").over(group).alias("docs_total"),
        F.sum("_t").over(group).alias("tokens_total"),
    )
    inside = Window.partitionBy(*by, "_block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    out = cells.join(blocks, [*by, "_block"])
    out = out.withColumn("docs_longer", F.col("_docs_later") + F.coalesce(F.sum("docs").over(inside), F.lit(0)))
    out = out.withColumn("_longer", F.col("_tokens_later") + F.coalesce(F.sum("_tokens").over(inside), F.lit(0)))
    kept = F.col("tokens_total") - F.col("_longer") + F.col("length") * F.col("docs_longer")
    return out.select(
        *by, F.col("length").alias("context_limit"), "docs", "docs_longer", "docs_total",
        kept.alias("tokens_kept"), (F.col("tokens_total") - kept).alias("tokens_cut"), "tokens_total",
    )


def quantiles(sums: DataFrame, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Nearest-rank quantiles of the lengths: by, share, length."""
    each = sums.withColumn("share", F.explode(F.array(*[F.lit(float(q)) for q in shares])))
    reached = F.col("docs_total") - F.col("docs_longer") >= F.greatest(F.ceil(F.col("share") * F.col("docs_total")), F.lit(1))
    return each.where(reached).groupBy(*by, "share").agg(F.min("context_limit").alias("length"))


def at_limits(hist: DataFrame, limits: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Tokens kept and documents cut at any limits, also those that no document has as its length."""
    each = hist.withColumn("context_limit", F.explode(F.array(*[F.lit(int(n)).cast("long") for n in limits])))
    return each.groupBy(*by, "context_limit").agg(
        F.sum(F.least("length", "context_limit") * F.col("docs")).alias("tokens_kept"),
        F.sum(F.when(F.col("length") > F.col("context_limit"), F.col("docs")).otherwise(0)).alias("docs_longer"),
    )
