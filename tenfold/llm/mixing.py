"""Mixing sources to target weights by hierarchical budgeting.

A tree of levels (say domain, language, source) gets a token budget at its root.
A node's budget goes to its children by weight; a child that cannot use its
share is filled up and the rest goes to its siblings.  As a node never gets more
than its subtree can give, a shortage is settled among siblings before it
reaches an ancestor.  A leaf's budget is the prefix of a token stream of seeded
epochs: all its documents in one seeded order, then in the next.

Built from DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenfold.llm import common
from tenfold.operators.joins import pin_small

#: Documents of a leaf that are ordered together where its prefix ends.
BUCKET_DOCS = 2048
HASH_SPAN = 1 << 32


def word_count(text: str = "text") -> Column:
    """Words of the whole text; a missing text has none."""
    return F.regexp_count(common.text_column(text), F.lit(common.WORD)).cast("long")


def word_prefix(text: Column, words: Column) -> Column:
    """The text up to and with its n-th word."""
    parts = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + common.WORD), F.lit(0))
    return F.array_join(F.slice(parts, F.lit(1), words.cast("int")), "")


def seeded_hash(seed: int, epoch: Column, key: Column) -> Column:
    """32 bits of a hash of the seed, the epoch and the key."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def leaf_budgets(
    leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Column], budget_share: float, max_epochs: int
) -> DataFrame:
    """Target tokens per leaf: ``leaves`` (levels, docs, tokens) with ``target``.

    ``weights`` gives a node's weight from the names of its level and those
    above; a level without an entry weighs its nodes alike.  A node of missing,
    zero or negative weight, and all below it, gets nothing.  The budget is
    ``budget_share`` of all tokens, or what ``max_epochs`` of every leaf give.
    """
    weighed = leaves
    usable = F.lit(True)
    for level in levels:
        w = F.greatest(F.coalesce(weights.get(level, F.lit(1.0)).cast("double"), F.lit(0.0)), F.lit(0.0))
        weighed = weighed.withColumn(f"_w_{level}", w)
        usable = usable & (F.col(f"_w_{level}") > 0)
    weighed = weighed.withColumn("_cap", F.when(usable, F.col("tokens") * F.lit(max_epochs)).otherwise(F.lit(0)).cast("double"))
    parents = weighed.agg(
        F.least(F.floor(F.sum("tokens") * F.lit(budget_share)).cast("double"), F.sum("_cap")).alias("_budget")
    )
    for depth, level in enumerate(levels, 1):
        path, above = list(levels[:depth]), list(levels[: depth - 1])
        nodes = weighed.groupBy(*path).agg(F.sum("_cap").alias("_cap"), F.first(f"_w_{level}").alias("_w"))
        nodes = nodes.join(parents, above) if above else nodes.join(F.broadcast(parents))  # one row
        # Children in the order in which they fill up; the first that does not fill sets the level of all later ones.
        order = Window.partitionBy(*above).orderBy(F.when(F.col("_w") > 0, F.col("_cap") / F.col("_w")).asc_nulls_last(), level)
        filled = F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        open_weight = F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing))
        nodes = nodes.withColumn("_full", F.col("_cap") * open_weight <= F.col("_w") * (F.col("_budget") - filled))
        every = Window.partitionBy(*above)
        rest = F.col("_budget") - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(F.lit(0.0))).over(every)
        weight = F.sum(F.when(~F.col("_full"), F.col("_w")).otherwise(F.lit(0.0))).over(every)
        share = F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_w") * rest / weight)
        parents = nodes.select(*path, share.alias("_budget"))
    return leaves.join(parents, list(levels)).withColumn("target", F.floor(F.col("_budget")).cast("long")).drop("_budget")


def mix(
    docs: DataFrame,
    levels: Mapping[str, Column],
    weights: Mapping[str, Column],
    budget_share: float = 1.0,
    max_epochs: int = 4,
    seed: int = 23,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The documents of the mixture: all columns with the levels, ``epoch``, ``tokens`` and ``take_tokens``.

    A document comes once for each epoch that takes it; the last document of a
    leaf's prefix gives only its first ``take_tokens`` words.  Documents without
    words are never taken.  A missing level name counts as the empty name;
    repeated rows are taken each by itself, equal hashes are ordered by key and
    text; an empty table gives an empty mixture.  The columns of the levels and
    the three named above replace columns of those names.

    Counts are aggregated per leaf, then per leaf and slice of the seeded hash.
    Only the slice in which a prefix ends is sorted, so a leaf of any size is
    spread over many tasks.  The plan of the leaves is broadcast only after its
    size was checked, else joined by its keys.
    """
    names = list(levels)
    made = {n: F.coalesce(levels[n].cast("string"), F.lit("")) for n in names}
    rows = docs.drop("epoch", "tokens", "take_tokens", *[n for n in names if n not in docs.columns])
    rows = rows.withColumns(made).withColumn("tokens", word_count(text)).where("tokens > 0")
    leaves = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("_leaf_tokens"))
    leaves = common.written(leaves, "leaves").withColumnRenamed("_leaf_tokens", "tokens")
    plan = leaf_budgets(leaves, names, weights, budget_share, max_epochs)
    plan = plan.where("target > 0").select(
        *names,
        F.expr("target div tokens").alias("_whole"),
        F.expr("target % tokens").alias("_rest"),
        F.ceil(F.col("docs") / F.lit(BUCKET_DOCS)).cast("long").alias("_slices"),
    )
    plan = common.written(plan, "leaf-plan")
    plan, small = pin_small(plan)
    rows = rows.join(F.broadcast(plan) if small else plan, names)
    hashed = seeded_hash(seed, F.col("_whole"), F.col(key))
    rows = rows.withColumn("_hash", hashed).withColumn("_slice", F.expr(f"(_hash * _slices) div {HASH_SPAN}"))

    per_slice = rows.where("_rest > 0").groupBy(*names, "_slice").agg(F.sum("tokens").alias("_sum"), F.first("_rest").alias("_rest"))
    upto = Window.partitionBy(*names).orderBy("_slice")
    ends = per_slice.withColumn("_end", F.sum("_sum").over(upto)).where("_end >= _rest and _end - _sum < _rest")
    ends = common.written(ends.select(*names, F.col("_slice").alias("_last"), (F.col("_end") - F.col("_sum")).alias("_before")), "prefix-ends")
    ends, small = pin_small(ends)
    rows = rows.join(F.broadcast(ends) if small else ends, names, "left")

    whole = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_whole")))).withColumn("epoch", F.col("epoch").cast("long"))
    past = (F.col("epoch") == F.col("_whole")) & ~F.coalesce(F.col("_slice") < F.col("_last"), F.lit(False))
    given = [c for c in docs.columns if c not in ("epoch", "tokens", "take_tokens")]
    out = list(dict.fromkeys([*given, *names, "epoch", "tokens"]))
    complete = whole.where(~past).select(*out, F.col("tokens").alias("take_tokens"))
    order = Window.partitionBy(*names).orderBy("_hash", key, F.xxhash64(common.text_column(text))).rowsBetween(Window.unboundedPreceding, 0)
    last = rows.where("_slice = _last").withColumn("_upto", F.col("_before") + F.sum("tokens").over(order))
    last = last.withColumn("take_tokens", F.least(F.col("tokens"), F.col("_rest") - F.col("_upto") + F.col("tokens")))
    last = last.where("take_tokens > 0").withColumn("epoch", F.col("_whole"))
    return complete.unionByName(last.select(*out, "take_tokens"))
