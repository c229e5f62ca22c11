"""Two-pass external shuffle into shards.

Pass one scatters rows into buckets that fit a task's memory, by a seeded hash.
Pass two shuffles each bucket (Spark's ``shuffle`` on an array is a Fisher-Yates
shuffle) and writes it.  The buckets in order are then a random permutation of
all rows, which is cut into shards whose row counts are at most one apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenfold.llm import common
from tenfold.session import local_table

#: Hash slices that are counted at least, and how many per bucket at least, as powers of two.
FINE_BITS, SLICE_BITS = 14, 4
BUCKET_BYTES = 64 << 20
BUCKET_ROWS = 500_000


def permuted(rows: DataFrame, keys: Sequence[str], size: Column, seed: int = 11, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows, each as the struct ``row``, with ``bucket`` and ``place``, a uniformly random place in the bucket.

    ``keys`` tell rows apart; ``size`` is a row's bytes.  A first pass sums sizes, which
    gives the number of buckets, and counts slices of the hash, at least 16 a bucket; a
    bucket is one partition of the second pass.  Where repeated rows make a slice larger
    than a bucket, its rows are scattered by their position instead; only these slices
    reach the driver, at most two per bucket's worth of rows.  The same rows and seed
    give the same permutation in any layout, but for such slices.
    """
    keyed = F.xxhash64(F.lit(seed), *keys)
    size_sum, row_sum = rows.agg(F.coalesce(F.sum(size), F.lit(0)), F.count(F.lit(1))).first()
    buckets = int(max(1, -(-size_sum // bucket_bytes), -(-row_sum // BUCKET_ROWS)))
    bits = max(FINE_BITS, (buckets - 1).bit_length() + SLICE_BITS)
    fine = F.shiftrightunsigned(keyed, 64 - bits)
    slices = rows.groupBy(fine.alias("f")).agg(F.sum(F.coalesce(size, F.lit(0))).alias("b"), F.count(F.lit(1)).alias("n"))
    full = slices.where((F.col("n") > 1) & ((F.col("b") > bucket_bytes) | (F.col("n") > BUCKET_ROWS))).select("f").collect()
    bucket = F.floor(fine * F.lit(buckets) / F.lit(1 << bits))
    columns = [F.col(f"`{c}`") for c in rows.columns]
    spread = rows.select(
        F.struct(*columns).alias("row"), F.xxhash64(F.lit(seed + 2), *keys).alias("order"), fine.alias("f"), bucket.alias("home")
    )
    if full:
        hot = F.broadcast(local_table(rows.sparkSession, [(r["f"], True) for r in full], "f long, hot boolean"))
        anywhere = F.pmod(F.xxhash64(F.lit(seed + 1), F.monotonically_increasing_id()), F.lit(buckets))
        spread = spread.withColumn("away", anywhere).join(hot, "f", "left")
        spread = spread.withColumn("home", F.when(F.col("hot"), F.col("away")).otherwise(F.col("home")))
    spread = spread.select(F.col("home").cast("int").alias("bucket"), F.struct("order", "row").alias("whole"))
    grouped = spread.repartitionById(buckets, F.col("bucket")).groupBy("bucket").agg(F.sort_array(F.collect_list("whole")).alias("all"))
    dealt = grouped.select("bucket", F.posexplode(F.shuffle("all", F.lit(seed))).alias("place", "whole"))
    return dealt.select(F.col("whole.row").alias("row"), "bucket", F.col("place").cast("long").alias("place"))


def dealt(rows: DataFrame, keys: Sequence[str], size: Column, shards: int = 16, seed: int = 11, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows, each as the struct ``row``, with ``shard`` (0 to shards - 1) and ``slot``, gapless from 0 in each shard.

    Law: row counts of shards are at most one apart.  Missing keys, ties and repeated
    rows count like others; a very long text fills a bucket of its own size; an empty
    table gives no rows; columns of any name travel inside the struct.  The permuted
    table is written once; a running count per bucket is joined to it.
    """
    table = common.written(permuted(rows, keys, size, seed, bucket_bytes), "permuted")
    counts = sorted(map(tuple, table.groupBy("bucket").count().collect()))
    before, at = [], 0
    for bucket, n in counts:
        before.append((bucket, at))
        at += n
    first = local_table(table.sparkSession, before, "bucket int, before long")
    placed = table.join(F.broadcast(first), "bucket").withColumn("position", F.col("before") + F.col("place"))
    placed = placed.withColumn("shard", F.expr(f"cast((position * {shards}) div {max(at, 1)} as int)"))
    opening = F.expr(f"(cast(shard as bigint) * {at} + {shards - 1}) div {shards}")  # first position of the shard
    return placed.select("row", "shard", (F.col("position") - opening).alias("slot"))


def write_shards(dealt_rows: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order within each file."""
    dealt_rows.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
