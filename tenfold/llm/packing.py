"""Packing along a space-filling curve.

Each document becomes a hashed token vector, projected to a few dimensions and
placed on a Hilbert curve.  A range sort by the curve's key puts neighbours next
to each other; the sorted token stream is then cut into sequences.

Defined cases: a missing text is empty; an empty text is the end token alone;
repeated rows are packed each by itself; ties on the curve are ordered by a hash
of the row; an empty table gives no pieces; further columns are not carried.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenfold.llm import common
from tenfold.llm.tokens import encoder
from tenfold.session import local_table

HASHED = 256
DIMENSIONS = 3
BITS = 20


def projection(seed: int = 7, hashed: int = HASHED, dimensions: int = DIMENSIONS) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((hashed, dimensions))


def hashed_vector(ids: np.ndarray, hashed: int = HASHED) -> np.ndarray:
    """Square roots of token counts in hashed places, of length 1 (all zero without tokens)."""
    places = common.mix64(ids.astype(np.uint64)) % np.uint64(hashed)
    v = np.sqrt(np.bincount(places.astype(np.int64), minlength=hashed))
    norm = np.linalg.norm(v)
    return v / norm if norm else v


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions on the Hilbert curve of unsigned grid points, one row each."""
    x = points.astype(np.uint64).T.copy()
    dims = len(x)
    one = np.uint64(1)
    q = one << np.uint64(bits - 1)
    while q > one:  # undo excess rotations, from the coarsest cell to the finest
        low = q - one
        for i in range(dims):
            hit = (x[i] & q) != 0
            swap = np.where(hit, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(hit, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= one
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = one << np.uint64(bits - 1)
    while q > one:
        flip = np.where((x[-1] & q) != 0, flip ^ (q - one), flip)
        q >>= one
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key.astype(np.int64)


def curve_keys(vectors: np.ndarray, matrix: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of document vectors; each projected coordinate is squashed into the grid."""
    squashed = 0.5 + 0.5 * np.tanh(2.0 * (vectors @ matrix))
    grid = np.minimum(squashed * 2.0**bits, 2.0**bits - 1).astype(np.uint64)
    return hilbert_keys(grid, bits)


def _encode(batches, path: str, end_id: int, seed: int):
    enc, matrix = encoder(path), projection(seed)
    end = enc.packed([end_id])
    for batch in common.blocks(batches, "text"):
        packed = [enc.encode(t) + end for t in batch.column("text").to_pylist()]
        vectors = np.stack([hashed_vector(enc.ids(p)[:-1]) for p in packed])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("row"),
                pa.array(curve_keys(vectors, matrix), pa.int64()),
                pa.array([len(p) // enc.width for p in packed], pa.int64()),
                pa.array(packed, pa.binary()),
            ],
            ["doc_id", "row", "curve", "tokens", "ids"],
        )


def _running(batches):
    """Number the tokens of one sorted partition."""
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column("tokens").to_numpy()
        ends = at + np.cumsum(n)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("tokens"), batch.column("ids"),
                pa.array(np.full(len(n), part, np.int64)), pa.array(ends - n, pa.int64()),
            ],
            ["doc_id", "tokens", "ids", "part", "place"],
        )
        at = int(ends[-1]) if len(n) else at


def token_stream(docs: DataFrame, path: str, end_id: int = 1, seed: int = 7) -> DataFrame:
    """All documents in curve order: doc_id, tokens, ids (packed), and ``at``, the place of the first token in the stream.

    The encoded table is written once; the range sort reads it twice (bounds,
    rows) and splits equal keys by a hash of the row, so no group of copies has
    to fit one task.  Only one count per sorted partition reaches the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_column().alias("text"))
    rows = rows.withColumn("row", F.xxhash64("doc_id", F.monotonically_increasing_id()))
    encoded = common.written(
        common.map_arrow(
            rows, partial(_encode, path=path, end_id=end_id, seed=seed),
            "doc_id long, row long, curve long, tokens long, ids binary",
        ),
        "encoded",
    )
    ordered = encoded.repartitionByRange("curve", "row").sortWithinPartitions("curve", "row")
    placed = common.written(
        common.map_arrow(ordered.select("doc_id", "tokens", "ids"), _running, "doc_id long, tokens long, ids binary, part long, place long"),
        "placed",
    )
    totals = sorted(map(tuple, placed.groupBy("part").agg(F.sum("tokens")).collect()))  # a row per partition
    starts, at = [], 0
    for part, n in totals:
        starts.append((part, at))
        at += n
    first = local_table(spark, starts, "part long, before long")
    return placed.join(F.broadcast(first), "part").select("doc_id", "tokens", "ids", (F.col("before") + F.col("place")).alias("at"))


def _cut(batches, path: str, length: int, with_ids: bool):
    enc = encoder(path)
    for batch in batches:
        docs, ats = batch.column("doc_id").to_pylist(), batch.column("at").to_pylist()
        out: list[list] = [[] for _ in range(8)]
        for doc, at, packed in zip(docs, ats, batch.column("ids").to_pylist(), strict=True):
            ids = enc.ids(packed).astype("<u4")
            start = 0
            while start < len(ids):
                place = at + start
                offset = place % length
                stop = min(len(ids), start + length - offset)
                piece = ids[start:stop]
                for values, v in zip(
                    out,
                    (doc, start, stop - start, zlib.crc32(piece.tobytes()), len(ids), place // length, offset, piece.astype(np.int32) if with_ids else None),
                    strict=True,
                ):
                    values.append(v)
                start = stop
        arrays = [pa.array(v, pa.int64()) for v in out[:7]]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            arrays.append(pa.array(out[7], pa.list_(pa.int32())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(arrays, names)


def pack(docs: DataFrame, path: str, length: int = 2048, end_id: int = 1, seed: int = 7, with_ids: bool = False) -> DataFrame:
    """Pieces of documents in sequences of ``length`` tokens, neighbours on the curve side by side.

    One row per piece: doc_id, start (the document's ids before it), length,
    ids_crc32, doc_tokens, sequence_id, offset; ``with_ids`` adds the ids.  The
    stream is cut at every ``length``-th token, so only the last sequence is short.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    stream = token_stream(docs, path, end_id, seed)
    return common.map_arrow(
        stream.select("doc_id", "at", "ids"), partial(_cut, path=path, length=length, with_ids=with_ids),
        schema + (", ids array<int>" if with_ids else ""),
    )


def sequences(pieces: DataFrame) -> DataFrame:
    """One row per sequence with its ids in order; a group holds one sequence, never more than ``length`` ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
