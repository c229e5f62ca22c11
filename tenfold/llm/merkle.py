"""Merkle manifest of a dataset: a tree for each source, a tree over the sources.

Leaves of a source are in the order of their ids, a run of 16 nodes becomes one
node, and the roots of the sources, in the order of their names, are the leaves of
the last tree.

Leaves are numbered by a range sort: the sorted rows are written with increasing
numbers, and only the first number of each (partition, source) is needed to turn
these into places, so a source with a third of all rows is spread like any other.
A superblock of ``16 ** LEVELS`` neighbouring leaves is reduced in one task to its
top; tops are grouped into superblocks in turn, until each tree has one node.

Then the way back: each superblock is cogrouped with the outer nodes that it needs,
which are the siblings of its top on the way to the root, and finishes the local
reduction, joins local and outer proofs, and folds every leaf up to the root.  One
row of outer nodes serves a whole superblock; its length grows with the height.

Defined cases: missing values have their own encoding and missing sources form one
source, the first; missing ids come first; rows of equal id are ordered by their
leaf, rows of equal leaf are exchangeable; an empty text is not a missing one;
texts of any length are hashed whole, inside the JVM; an empty table gives no
rows; columns other than the five hashed ones do not matter and are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenfold.llm import common
from tenfold.session import ship_package

#: Nodes in a run.
FAN = 16
#: Levels that one task reduces: a superblock holds FAN ** LEVELS leaves.
LEVELS = 2

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(column: Column) -> Column:
    """``-`` for a missing value, else its length in bytes, a colon, and the value."""
    text = column.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*columns: Column) -> Column:
    return F.sha2(F.concat(*map(encoded, columns)).cast("binary"), 256)


def lowered(text: Column) -> Column:
    """A-Z in lower case, the rest as it is."""
    return F.translate(text, _UPPER, _UPPER.lower())


# ------------------------------------------------------------ places


def placed(df: DataFrame, group: list[str], order: list[str], label: str) -> DataFrame:
    """The rows with their place ``at`` (from 0) in the order of their group, the group's size ``n`` and its place ``tree`` among the groups.

    No task holds a group: rows are sorted by range, with a number of their own as
    the last key, and counted per partition.  What is known of a group is joined by
    (partition, group), so no key has more rows than a partition.
    """
    own = F.monotonically_increasing_id()
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    rows = df.withColumn("_own", own).repartitionByRange(*keys, "_own").sortWithinPartitions(*keys, "_own")
    rows = common.written(rows.drop("_own").withColumn("_number", own), label)
    part = F.shiftright("_number", 33)
    each = rows.groupBy(part.alias("_part"), *group).agg(F.min("_number").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    # a group lies in neighbouring partitions, so its windows hold at most one row per partition
    whole = Window.partitionBy(*group)
    before = F.sum("_rows").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    each = each.select(
        "_part", *[F.col(c).alias(f"_{c}") for c in group], "_first", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_rows").over(whole).alias("n")
    )
    each = common.written(each, f"{label}-parts")
    if group:
        names = [f"_{c}" for c in group]
        trees = placed(each.where("_before = 0").select(*names), [], names, f"{label}-groups")
        trees = trees.select(*[F.col(c).alias(f"_{c}") for c in names], F.col("at").alias("tree"))
        each = each.join(trees, _same(names)).drop(*[f"_{c}" for c in names])
    else:
        each = each.withColumn("tree", F.lit(0).cast("long"))
    joined = rows.withColumn("_at_part", part).join(each, (F.col("_at_part") == F.col("_part")) & _same(group))
    return joined.select(*df.columns, (F.col("_number") - F.col("_first") + F.col("_before")).alias("at"), "n", "tree")


def _same(columns: list[str]) -> Column:
    """Whether each column equals the one of the same name with a line before it, two missing values too."""
    out = F.lit(True)
    for c in columns:
        out &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return out


# ------------------------------------------------------------ reduction


def _levels(nodes: list[str], size: int, levels: int) -> list[list[str]]:
    """The nodes of a superblock and of the levels above, for a tree of ``size`` nodes."""
    out = [nodes]
    while size > 1 and len(out) <= levels:
        below = out[-1]
        out.append([digest(below[i : i + FAN]) for i in range(0, len(below), FAN)])
        size = -(-size // FAN)
    return out


def _smaller(size: int, levels: int) -> int:
    for _ in range(levels):
        size = -(-size // FAN)
    return size


def _top(levels: int, key: tuple, nodes: pd.DataFrame) -> pd.DataFrame:
    nodes = nodes.sort_values("at")
    size = int(nodes["n"].iloc[0])
    [top] = _levels(nodes["digest"].tolist(), size, levels)[-1]
    return pd.DataFrame({"tree": [key[0]], "at": [key[1]], "n": [_smaller(size, levels)], "digest": [top]})


def climb(nodes: DataFrame, levels: int, label: str) -> list[DataFrame]:
    """Nodes (tree, at, n, digest), their superblocks' tops, the tops of these, until one node is left of each tree."""
    block = F.floor(F.col("at") / F.lit(FAN**levels)).cast("long").alias("block")
    stages, most = [nodes], 2
    while most > 1:
        given = stages[-1].select("tree", block, "at", "n", "digest")
        tops = given.groupBy("tree", "block").applyInPandas(partial(_top, levels), "tree long, at long, n long, digest string")
        stages.append(common.written(tops, label))
        most = stages[-1].agg(F.max("n")).first()[0] or 1
    return stages


def _ways(nodes: list[str], size: int, levels: int) -> Iterator[tuple[list[str], list[str]]]:
    """For each node, what stands before and after it in its run, level by level."""
    rows = _levels(nodes, size, levels)[:-1]
    for k in range(len(nodes)):
        before, after, at = [], [], k
        for row in rows:
            start = at - at % FAN
            before.append("".join(row[start:at]))
            after.append("".join(row[at + 1 : start + FAN]))
            at //= FAN
        yield before, after


def fold(node: str, before: list[str], after: list[str]) -> str:
    """The root above a node, by its proof."""
    for b, a in zip(before, after):
        node = digest([b, node, a])
    return node


_PROOF = "before array<string>, after array<string>, subroot string, root string"


def _descend(levels: int, key: tuple, nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """Proofs of a superblock's nodes, from the local reduction and the outer nodes."""
    nodes = nodes.sort_values("at")
    up, size = outer.iloc[0], int(nodes["n"].iloc[0])
    ways = list(_ways(nodes["digest"].tolist(), size, levels))
    return pd.DataFrame({
        "tree": key[0], "at": nodes["at"].to_numpy(),
        "before": [[*b, *up["before"]] for b, _ in ways], "after": [[*a, *up["after"]] for _, a in ways],
        "subroot": up["subroot"], "root": up["root"],
    })


def _finish(levels: int, proofs: bool, key: tuple, nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """A superblock of leaves: local reduction, proofs, and every leaf as it is seen now folded up to the root."""
    nodes = nodes.sort_values("at")
    up, size = outer.iloc[0], int(nodes["n"].iloc[0])
    high_before, high_after = list(up["before"]), list(up["after"])
    high = "".join(b + a for b, a in zip(high_before, high_after))
    out = {c: [] for c in ("proof_sha256", "folded_root", "before", "after")}
    for seen, (before, after) in zip(nodes["seen"].tolist(), _ways(nodes["digest"].tolist(), size, levels)):
        out["proof_sha256"].append(digest([*(b + a for b, a in zip(before, after)), high]))
        out["folded_root"].append(fold(fold(seen, before, after), high_before, high_after))
        out["before"].append([*before, *high_before] if proofs else [])
        out["after"].append([*after, *high_after] if proofs else [])
    return pd.DataFrame({"id": nodes["id"].to_numpy(), "leaf": nodes["digest"].to_numpy(), "subroot": up["subroot"], "root": up["root"], **out})


def descend(stages: list[DataFrame], outer: DataFrame, levels: int, label: str, last: int = 0) -> DataFrame:
    """Proofs of the nodes of stage ``last``, from those of the highest stage."""
    block = F.floor(F.col("at") / F.lit(FAN**levels)).cast("long").alias("block")
    for nodes in stages[-2 : -len(stages) - 1 + last : -1]:
        inner = nodes.select("tree", block, "at", "n", "digest").groupBy("tree", "block")
        ways = outer.withColumnRenamed("at", "block").groupBy("tree", "block")
        rows = inner.cogroup(ways).applyInPandas(partial(_descend, levels), f"tree long, at long, {_PROOF}")
        outer = common.written(rows, label)
    return outer


def manifest(leaves: DataFrame, levels: int = LEVELS, proofs: bool = False) -> DataFrame:
    """Tree columns for every row of ``leaves`` (id, source, leaf, seen).

    ``leaf`` is the digest that the manifest holds, ``seen`` the one that the data
    give now.  Returns id, leaf, subroot, root, proof_sha256 (of all siblings, level
    by level), folded_root (from ``seen`` and the siblings) and verified; with
    ``proofs`` also ``before`` and ``after``, the siblings on either side by level.
    """
    ship_package(leaves.sparkSession)
    rows = common.written(leaves.select("id", "source", F.col("leaf").alias("digest"), "seen"), "leaves")
    rows = placed(rows, ["source"], ["id", "digest"], "leaves-sorted")
    rows = common.written(rows.select("tree", "at", "n", "digest", "seen", F.col("id").cast("string").alias("id")), "leaves-placed")

    forest = climb(rows, levels, "tops")
    count = F.lit(forest[-1].count()).cast("long")
    subroots = common.written(forest[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), count.alias("n"), "digest"), "subroots")
    upper = climb(subroots, levels, "upper")
    none = F.array().cast("array<string>")
    root = upper[-1].select("tree", "at", none.alias("before"), none.alias("after"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    proofs_up = descend(upper, root, levels, "upper-proofs")
    outer = proofs_up.drop("tree", "subroot").join(subroots.select("at", F.col("digest").alias("subroot")), "at")
    outer = outer.select(F.col("at").alias("tree"), F.lit(0).cast("long").alias("at"), "before", "after", "subroot", "root")
    outer = descend(forest, common.written(outer, "outer"), levels, "outer", last=1)

    block = F.floor(F.col("at") / F.lit(FAN**levels)).cast("long").alias("block")
    inner = rows.select("tree", block, "at", "n", "digest", "seen", "id").groupBy("tree", "block")
    ways = outer.withColumnRenamed("at", "block").groupBy("tree", "block")
    schema = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, before array<string>, after array<string>"
    done = inner.cogroup(ways).applyInPandas(partial(_finish, levels, proofs), schema)
    kind = leaves.schema["id"].dataType
    extra = ["before", "after"] if proofs else []
    return done.select(F.col("id").cast(kind).alias("id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), *extra)


def of_documents(docs: DataFrame, tampered: Column) -> DataFrame:
    """Leaves of documents; where ``tampered`` holds, the text seen now is the one in lower case."""
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    kept = leaf(*fields, F.col("text"))
    seen = F.when(F.coalesce(tampered, F.lit(False)), leaf(*fields, lowered(F.col("text")))).otherwise(kept)
    return docs.select(F.col("doc_id").alias("id"), "source", kept.alias("leaf"), seen.alias("seen"))
