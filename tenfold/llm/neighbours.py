"""Approximate nearest neighbours by cross-polytope hashing.

Unit vectors are turned by fast pseudo-rotations (three rounds of random signs
and a Hadamard transform) and belong to the nearest signed axis.  Several tables
hold every vector once; a query probes its nearest axes in each.  Queries and
members of a bucket meet in blocks, where exact inner products of the original
vectors rank them.

The number of buckets grows with the table, so a fixed number of probes would
visit less and less of it.  The probes are therefore set from the table itself:
the exact neighbours of some queries are found in one pass over the vectors, and
as many buckets are probed as these queries need to meet the wanted share of
them, all buckets if need be.  Queries that still met fewer than ``k`` vectors
visit the whole table.

For largest inner products over vectors of unequal length, a vector gets one
more coordinate that fills it up to the longest length, so nearest by angle is
largest by product.

Defined cases: vectors that are missing, empty, zero or hold missing or
non-finite components, and rows without an id, take no part; vectors of
different dimensions never meet; equal vectors are indexed once with their
smallest ids; repeated rows count once; ties go to the smaller id; an empty
table gives no rows; further columns are not carried.
"""

from __future__ import annotations

import math
from functools import partial
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenfold.llm import common

TABLES = 16
#: Buckets probed per table at least.
PROBES = 8
#: Share of the exact neighbours to meet, and queries per dimension to measure it on.
RECALL = 0.95
MEASURED = 200
#: Members per bucket to aim at, and members and queries that meet at once.
OCCUPANCY = 384
BLOCK = 1024
PLACED = 1 << 22


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthogonal Walsh-Hadamard transform of each row; the width is a power of two."""
    width, h = x.shape[1], 1
    while h < width:
        pairs = x.reshape(len(x), -1, 2, h)
        x = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(len(x), width)
        h *= 2
    return x / math.sqrt(width)


def signs(seed: int, table: int, part: int, width: int) -> np.ndarray:
    return np.random.default_rng([seed, table, part]).choice([-1.0, 1.0], (3, width))


def rotated(x: np.ndarray, seed: int, table: int, part: int) -> np.ndarray:
    for d in signs(seed, table, part, x.shape[1]):
        x = hadamard(x * d)
    return x


def axes_of(buckets: float, width: int) -> list[int]:
    """How many axes each of the concatenated functions uses, so that there are about ``buckets`` buckets."""
    left, parts = max(2.0, buckets), []
    while left > 2 * width:
        parts.append(width)
        left /= 2 * width
    parts.append(min(width, max(1, 2 ** math.ceil(math.log2(left) - 1))))
    return parts


def codes(x: np.ndarray, axes: list[int], seed: int, table: int, probes: int) -> np.ndarray:
    """The nearest buckets of each row, nearest first, ``probes`` of them at most.

    With several functions, a probe changes one or more of them to a further
    axis; probes are ranked by the inner products they give up.
    """
    best = np.zeros((len(x), 1), np.int64)
    loss = np.zeros((len(x), 1))
    for part, n in enumerate(axes):
        turned = rotated(x, seed, table, part)[:, :n]
        both = np.concatenate([turned, -turned], axis=1)
        take = min(probes, both.shape[1])
        order = np.argsort(-both, axis=1, kind="stable")[:, :take]
        value = np.take_along_axis(both, order, 1)
        given_up = value[:, :1] ** 2 - np.sign(value) * value**2
        joined = (loss[:, :, None] + given_up[:, None, :]).reshape(len(x), -1)
        coded = (best[:, :, None] * (2 * n) + order[:, None, :]).reshape(len(x), -1)
        pick = np.argsort(joined, axis=1, kind="stable")[:, :probes]
        best, loss = np.take_along_axis(coded, pick, 1), np.take_along_axis(joined, pick, 1)
    return best


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dim).astype(np.float64)


def lifted(x: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """Unit vectors whose angles order by inner product, padded to a power of two."""
    norm = np.linalg.norm(x, axis=1)
    width = 1 << max(1, math.ceil(math.log2(x.shape[1] + 1)))
    equal = bool(len(x)) and longest <= 0
    if equal:  # all of one length: no further coordinate is needed
        width = 1 << max(1, math.ceil(math.log2(x.shape[1])))
    out = np.zeros((len(x), width))
    if query or equal:
        out[:, : x.shape[1]] = x / norm[:, None]
    else:
        out[:, : x.shape[1]] = x / longest
        out[:, x.shape[1]] = np.sqrt(np.maximum(0.0, 1 - (norm / longest) ** 2))
    return out


def ranks(queries: np.ndarray, members: np.ndarray, which: np.ndarray, axes: list[int], seed: int, table: int) -> np.ndarray:
    """How many buckets the query ``which`` of each member probes before the member's own."""
    given_up, own = [], np.zeros(len(members))
    for part, n in enumerate(axes):
        asked, met = (rotated(x, seed, table, part)[:, :n] for x in (queries, members))
        asked, met = (np.concatenate([x, -x], axis=1) for x in (asked, met))
        given_up.append(asked.max(1, keepdims=True) ** 2 - np.sign(asked) * asked**2)
        own += given_up[-1][which, met.argmax(1)]
    out = np.zeros(len(members), np.int64)
    for i in np.unique(which):
        before, last = np.zeros(1), np.sort(given_up[-1][i])
        for loss in given_up[:-1]:
            before = (before[:, None] + loss[i][None, :]).ravel()
        for j in np.flatnonzero(which == i):
            out[j] = np.searchsorted(last, own[j] - before - 1e-12).sum()
    return out


def probes_for(recall: float, found: list[np.ndarray]) -> int:
    """Probes per table with which this share of members is met in some table, by their ``ranks`` in each."""
    best = np.sort(np.min(found, axis=0))
    return int(best[min(len(best), math.ceil(recall * len(best))) - 1]) + 1


def _truth(batches, shared: Broadcast, k: int):
    """The best ``k`` of a task's vectors for each of the shared queries, but themselves."""
    best = {dim: (np.empty((len(keys), 0)), np.empty((len(keys), 0), np.int64)) for dim, (keys, _) in shared.value.items()}
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims):
            if int(dim) not in best:
                continue
            part = batch.filter(pa.array(dims == dim))
            asked, q = shared.value[int(dim)]
            members = part.column("key").to_numpy()
            score = q @ _matrix(part.column("vector"), int(dim)).T
            score[asked[:, None] == members[None, :]] = -np.inf
            scores, keys = best[int(dim)]
            scores = np.concatenate([scores, score], axis=1)
            keys = np.concatenate([keys, np.broadcast_to(members, score.shape)], axis=1)
            pick = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            best[int(dim)] = np.take_along_axis(scores, pick, 1), np.take_along_axis(keys, pick, 1)
    for dim, (scores, keys) in best.items():
        near = [[{"score": s, "key": x} for s, x in zip(a, b, strict=True) if s > -np.inf] for a, b in zip(scores.tolist(), keys.tolist(), strict=True)]
        kind = pa.list_(pa.struct([("score", pa.float64()), ("key", pa.int64())]))
        yield pa.RecordBatch.from_arrays([pa.array(shared.value[dim][0]), pa.array(near, kind)], ["query", "near"])


def measured_probes(vectors: DataFrame, queries: DataFrame, k: int, longest: dict, buckets: dict, seed: int, tables: int, recall: float) -> dict:
    """Per dimension the probes with which a hash sample of the queries meets ``recall`` of its exact neighbours."""
    drawn = Window.partitionBy("dim").orderBy(F.xxhash64(F.lit(seed), "key"), "key")
    some = queries.withColumn("_n", F.row_number().over(drawn)).where(F.col("_n") <= MEASURED).select("dim", "key", "vector").toArrow().combine_chunks()
    asked = {}
    for dim in some.column("dim").unique().to_pylist():
        part = some.filter(pa.compute.equal(some.column("dim"), dim)).combine_chunks()
        asked[dim] = part.column("key").to_numpy(), _matrix(part.column("vector").combine_chunks(), dim)
    if not asked:
        return {}
    shared = vectors.sparkSession.sparkContext.broadcast(asked)  # MEASURED vectors per dimension
    near = common.map_arrow(vectors.select("dim", "key", "vector"), partial(_truth, shared=shared, k=k), "query long, near array<struct<score:double,key:long>>")
    near = near.groupBy("query").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near")), False), 1, k).alias("near"))
    near = near.select("query", F.explode("near.key").alias("key"))
    true = near.join(vectors.select("dim", "key", "vector"), "key").select("dim", "query", "vector").toArrow()
    out = {}
    for dim, (keys, q) in asked.items():
        part = true.filter(pa.compute.equal(true.column("dim"), dim)).combine_chunks()
        if not part.num_rows:
            continue
        order = np.argsort(keys)
        which = order[np.searchsorted(keys, part.column("query").to_numpy(), sorter=order)]
        unit, members = lifted(q, longest[dim], True), lifted(_matrix(part.column("vector").combine_chunks(), dim), longest[dim], False)
        axes = axes_of(buckets[dim], unit.shape[1])
        out[dim] = probes_for(recall, [ranks(unit, members, which, axes, seed, t) for t in range(tables)])
    return out


def _place(batches, longest: dict, buckets: dict, seed: int, tables: int, probes: dict, query: bool):
    """A row per table and probe: dim, table, bucket, vector key."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims):
            part = batch.filter(pa.array(dims == dim))
            x = _matrix(part.column("vector"), int(dim))
            unit = lifted(x, longest[int(dim)], query)
            axes = axes_of(buckets[int(dim)], unit.shape[1])
            take = probes[int(dim)]
            step = max(1, PLACED // (take * min(take, 2 * unit.shape[1])))  # rows whose probes are ranked at once
            for t, i in product(range(tables), range(0, len(x), step)):
                found = codes(unit[i : i + step], axes, seed, t, take)
                row = i + np.repeat(np.arange(len(found)), found.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(row), dim, np.int32)), pa.array(np.full(len(row), t, np.int32)),
                        pa.array(found.ravel()), part.column("key").take(pa.array(row)),
                    ],
                    ["dim", "tab", "bucket", "key"],
                )


def _meet(batches, k: int):
    """Exact inner products of the queries and members of one block; the best ``k`` of each query."""
    for batch in batches:
        out: list[list] = [[], [], []]
        for i in range(batch.num_rows):
            dim = batch.column("dim")[i].as_py()
            queries, members = batch.column("queries")[i].values, batch.column("members")[i].values
            q, m = _matrix(queries.field("vector"), dim), _matrix(members.field("vector"), dim)
            ids, first = members.field("key").to_numpy(), members.field("first").to_numpy()
            score = q @ m.T
            # ties go to the smaller id: members stand in that order and the sort is stable
            order = np.argsort(first, kind="stable")
            best = np.argsort(-score[:, order], axis=1, kind="stable")[:, :k]
            picked = order[best]
            out[0].append(np.repeat(queries.field("key").to_numpy(), picked.shape[1]))
            out[1].append(ids[picked].ravel())
            out[2].append(np.take_along_axis(score, picked, 1).ravel())
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["query", "key", "score"])


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows that take part: id, vector, dim, key (a hash of the vector)."""
    v = F.col("vector")
    kind = "float" if dict(vectors.dtypes)[vector_col] == "array<float>" else "double"
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(sound)
    plain = F.transform(v, lambda x: F.when(x == 0, F.lit(0).cast(kind)).otherwise(x))  # -0.0 is 0.0
    return rows.withColumn("vector", plain).withColumn("dim", F.size(v)).withColumn("key", F.xxhash64("vector"))


def search(
    vectors: DataFrame,
    is_query,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    tables: int = TABLES,
    probes: int = PROBES,
    occupancy: int = OCCUPANCY,
    seed: int = 5,
    recall: float = RECALL,
) -> DataFrame:
    """The ``k`` nearest found of each query, by inner product: query_id, rank, id, score.

    ``is_query`` is a condition on the column ``id``.  The candidates of a query
    are all rows but its own.  The number of buckets grows with the number of
    distinct vectors, so a bucket keeps its size; ``probes`` is raised to what
    ``recall`` takes (0 leaves it).  Full buckets are cut into
    blocks by a hash, and each block meets the bucket's queries in a task of its own.
    """
    rows = common.written(usable(vectors, id_col, vector_col).distinct(), "vectors")
    # Spark limits the rows of a group before the shuffle, so a vector that many rows share stays small.
    by_id = Window.partitionBy("dim", "key", "vector").orderBy("id")
    few = rows.withColumn("_n", F.row_number().over(by_id)).where(F.col("_n") <= k + 1)
    distinct = few.groupBy("dim", "key").agg(F.first("vector").alias("vector"), F.sort_array(F.collect_list("id")).alias("ids"))
    distinct = common.written(distinct, "distinct-vectors")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    facts = distinct.groupBy("dim").agg(F.count(F.lit(1)), F.max(norm), F.min(norm)).collect()  # a row per dimension
    longest = {d: (0.0 if low > 0 and high / low < 1 + 1e-5 else high) for d, _, high, low in facts}
    buckets = {d: n / occupancy for d, n, _, _ in facts}

    vectors_of = distinct.select("dim", "key", "vector", F.col("ids")[0].alias("first"))
    asked = rows.where(is_query).select("key").distinct()
    queries = vectors_of.join(asked, "key", "left_semi")
    needed = measured_probes(vectors_of, queries, k, longest, buckets, seed, tables, recall) if recall > 0 else {}
    needed = {d: max(probes, needed.get(d, 1)) for d in buckets}
    place = partial(_place, longest=longest, buckets=buckets, seed=seed, tables=tables)
    bucket = ["dim", "tab", "bucket"]

    def in_blocks(placed: DataFrame, name: str) -> DataFrame:
        """Lists of at most about BLOCK vectors per bucket and block."""
        full = placed.groupBy(*bucket).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_blocks"))
        placed = placed.join(full, bucket).withColumn("block", F.pmod(F.xxhash64("key"), F.col("_blocks")))
        placed = placed.select(*bucket, "block", "key").join(vectors_of.drop("dim"), "key")
        return placed.groupBy(*bucket, "block").agg(F.collect_list(F.struct("key", "first", "vector")).alias(name))

    schema = "dim int, tab int, bucket long, key long"
    homes = common.written(common.map_arrow(vectors_of, partial(place, probes=dict.fromkeys(buckets, 1), query=False), schema), "members")
    probed = common.written(common.map_arrow(queries, partial(place, probes=needed, query=True), schema), "queries")

    def best_met(homes: DataFrame, probed: DataFrame) -> DataFrame:
        pairs = in_blocks(homes, "members").join(in_blocks(probed, "queries").drop("block"), bucket)
        met = common.map_arrow(pairs.select("dim", "queries", "members"), partial(_meet, k=k + 1), "query long, key long, score double")
        found = met.groupBy("query", "key").agg(F.max("score").alias("score"))
        found = found.join(distinct.select("key", F.col("ids")[0].alias("first")), "key")
        ranked = Window.partitionBy("query").orderBy(F.col("score").desc(), "first")
        return found.withColumn("_n", F.row_number().over(ranked)).where(F.col("_n") <= k + 1).select("query", "key", "score")

    found = common.written(best_met(homes, probed), "met")
    wanted = F.least(F.element_at(F.create_map(*[F.lit(x) for d, n, _, _ in facts for x in (d, n)]), F.col("dim")), F.lit(k + 1)) if facts else F.lit(0)
    met = found.groupBy(F.col("query").alias("key")).agg(F.count(F.lit(1)).alias("_met"))
    short = queries.select("dim", "key").join(met, "key", "left").where(F.coalesce("_met", F.lit(0)) < wanted).select("dim", "key")
    short = common.written(short, "short-queries")
    if not short.isEmpty():  # these visit every bucket of one table
        first = homes.where("tab = 0")
        everywhere = first.select(*bucket).distinct().join(short, "dim").select(*bucket, "key")
        again = best_met(first, common.written(everywhere, "everywhere"))
        found = found.join(short.select(F.col("key").alias("query")), "query", "left_anti").unionByName(again)
    found = found.join(distinct.select("key", "ids"), "key")
    nearest = found.select("query", "score", F.explode("ids").alias("id"))
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    nearest = nearest.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1)
    lists = nearest.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("_n", "id", "score"))).alias("near"))
    own = rows.where(is_query).select(F.col("id").alias("query_id"), F.col("key").alias("query"))
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    out = own.join(lists, "query").select("query_id", F.posexplode(others).alias("pos", "near"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("near.id").alias("id"), F.col("near.score").alias("score"))
