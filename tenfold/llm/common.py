"""What the operators of this subpackage share: scratch tables, text batches, hashes, words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenfold.session import scratch_path, ship_package

#: A word is a maximal run of bytes other than these, in SQL and in tasks alike.
WORD = r"[^\x20\x09-\x0D]+"

BLOCK_BYTES = 2 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: evaluated once, lineage cut, readable by every executor."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{label}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_column(name: str = "text") -> Column:
    """The text, with a missing one read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` with this package shipped to the workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(function, schema)


def blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold about ``limit`` bytes; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(_lengths(batch.column(batch.schema.get_field_index(text))))
        start, done = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start, done = stop, int(ends[stop - 1])


def _lengths(column: pa.Array) -> np.ndarray:
    offsets = _offsets(column)
    return offsets[1:] - offsets[:-1]


def _offsets(column: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    return raw[column.offset : column.offset + len(column) + 1].astype(np.int64)


def joined_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts without missing ones, and where each text starts (with the end)."""
    offsets = _offsets(column)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, count: int) -> np.ndarray:
    """base**0 .. base**(count - 1), modulo 2**64."""
    out = np.full(max(count, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Prints:
    """Fingerprints of any stretch of a byte array, from running sums.

    ``of(start, length)`` is equal for equal stretches; two 64-bit values of
    different stretches agree with a chance of about 2**-60.
    """

    def __init__(self, data: np.ndarray, seed: int = 1):
        values = mix64(np.arange(256, dtype=np.uint64) + np.uint64(seed * int(_ODD) % (1 << 64)))
        self.base = np.uint64(int(_ODD) * (2 * seed + 1) % (1 << 64) | 1)
        n = len(data)
        # sums of value * base**i; a stretch at s is brought to power 0 by base**-s (an odd base has an inverse)
        self.down = powers(np.uint64(pow(int(self.base), -1, 1 << 64)), n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values[data] * powers(self.base, n + 1)[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        end = start + length
        return mix64((self.sums[end] - self.sums[start]) * self.down[start])


def word_bounds(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and where the words of each text begin in that list (with the end)."""
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    inside = ~space
    first = inside.copy()
    first[1:] &= space[:-1]
    cuts = starts[:-1][starts[:-1] < len(data)]
    first[cuts] = inside[cuts]  # a text never goes on with a word of the one before
    last = inside.copy()
    last[:-1] &= space[1:]
    ends = starts[1:][(starts[1:] > 0)] - 1
    last[ends] = inside[ends]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(begin, starts)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, every other byte as it is."""
    return np.where((data >= 65) & (data <= 90), data + 32, data)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
