"""Toxicity by a factorization machine over hashed terms.

A document's terms are its distinct words, hashed.  Besides a weight per term
the model has a short vector per term, and the products of these vectors weigh
pairs: an insult together with the mention of a group scores higher than the two
weights alone.  Every term of the labelled rows takes part in training; none is
chosen beforehand by count or by what it tells alone.  Shrinkage decides instead:
a weight stays 0 unless the rows pull at it more than chance does (``LASSO``), and
vectors are held back by ``SHRINK`` (see ``fit``).  The labelled rows are the only
bound.  The model has at most 2**HASH_BITS terms.

Defined cases: a missing or empty text has no terms and scores as a text of
unknown words; a very long text has at most 2**HASH_BITS terms; repeated rows
score alike; labels that are missing or neither 0 nor 1, or whose doc_id is
missing, are not learned from; of contradicting labels of one doc_id the higher
counts, and of labelled rows beyond the bound those of the smallest hash, ties by
doc_id, are learned from; without any label, or with one class only, every score
is the base rate; an empty table gives no rows; further columns are carried by
``score``, where ``score`` and ``predicted`` replace columns of those names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tenfold.llm import common
from tenfold.session import local_table

HASH_BITS = 20
#: Labelled rows to learn from at most, taken by a seeded hash of doc_id.
MAX_LABELLED = 40_000
#: Pull at a weight, in standard deviations of what chance makes, from which on it leaves 0.
#: A word seen once, in a toxic row, passes where less than half of the rows are toxic.
LASSO = 1.0
RIDGE = 0.1
#: Pull on a vector towards 0, times the mean number of terms of a row.
SHRINK = 2.5
#: Steps over the weights, first and last, and between the turns of the vectors.
STEPS, REFIT = 100, 30
#: (row, term) cells worked on at once.
CELLS = 1 << 20
FACTORS = 8
THRESHOLD = 0.3


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed words: the text each belongs to and the term, sorted by both.

    A word is a run of letters, where any byte of a character beyond ASCII counts
    as a letter; A-Z and the capitals of Latin-1 are read as small letters.
    """
    data, starts = common.joined_bytes(texts)
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    small = common.lower_ascii(data)
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    capital = after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    small = np.where(capital, small + 0x20, small)
    letter = ((small >= 97) & (small <= 122)) | (small >= 0x80)
    spaced = np.where(letter, small, 0x20).astype(np.uint8)
    begin, end, first = common.word_bounds(spaced, starts)
    term = (common.Prints(spaced, 3).of(begin, end - begin) >> np.uint64(64 - HASH_BITS)).astype(np.int64)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(first))
    pairs = np.unique(owner << HASH_BITS | term)
    return pairs >> HASH_BITS, pairs & ((1 << HASH_BITS) - 1)


def held_out(doc_id) -> object:
    """Rows kept for judging: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Machine:
    """Terms in ascending order with their weights and factors."""

    bias: float
    terms: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def lookup(self) -> np.ndarray:
        """Place of each hashed term, or -1."""
        out = np.full(1 << HASH_BITS, -1, np.int32)
        out[self.terms] = np.arange(len(self.terms), dtype=np.int32)
        return out

    def logits(self, owner: np.ndarray, place: np.ndarray, count: int) -> np.ndarray:
        """Values of ``count`` documents from their (document, term place) pairs."""
        out = self.bias + np.bincount(owner, weights=self.weights[place], minlength=count)
        for f in self.factors.T:
            v = f[place]
            sums, squares = np.bincount(owner, weights=v, minlength=count), np.bincount(owner, weights=v * v, minlength=count)
            out += 0.5 * (sums * sums - squares)
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


class Rows:
    """Terms of the labelled rows: those of row i are ``place[bounds[i] : bounds[i + 1]]``."""

    def __init__(self, place: np.ndarray, bounds: np.ndarray):
        self.place, self.bounds, self.count = place, bounds, len(bounds) - 1

    def pieces(self):
        """(first row, end, row of each cell counted from the first, place of each cell) for stretches of rows."""
        lo = 0
        while lo < self.count:
            hi = max(lo + 1, int(np.searchsorted(self.bounds, self.bounds[lo] + CELLS, side="right")) - 1)
            own = np.repeat(np.arange(hi - lo), np.diff(self.bounds[lo : hi + 1]))
            yield lo, hi, own, self.place[self.bounds[lo] : self.bounds[hi]]
            lo = hi

    def drawn(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cells of some rows: position in ``rows`` and place."""
        sizes = self.bounds[rows + 1] - self.bounds[rows]
        own = np.repeat(np.arange(len(rows)), sizes)
        return own, self.place[np.repeat(self.bounds[rows] - np.cumsum(sizes) + sizes, sizes) + np.arange(len(own))]


def _fit_weights(rows: Rows, labels: np.ndarray, pairs: np.ndarray, machine: Machine, steps: int) -> None:
    """Bias and all weights by accelerated proximal steps, beside what the pairs give each row.

    A step is the gradient over a bound of the curvature, so the loss plus
    penalties (``lasso`` for the size, RIDGE for the square of a weight) settles.
    """
    m, size = len(machine.weights), np.diff(rows.bounds) + 1.0
    share = labels.mean()
    lasso = LASSO * np.sqrt(np.bincount(rows.place, minlength=m) * share * (1 - share))
    bound = np.full(m, RIDGE)
    for lo, hi, own, at in rows.pieces():
        bound += np.bincount(at, weights=0.25 * size[lo:hi][own], minlength=m)
    w, b, pace = machine.weights, machine.bias, 1.0
    ahead, ahead_b = w, b
    for _ in range(steps):
        pull, total = RIDGE * ahead, 0.0
        for lo, hi, own, at in rows.pieces():
            error = sigmoid(ahead_b + pairs[lo:hi] + np.bincount(own, weights=ahead[at], minlength=hi - lo)) - labels[lo:hi]
            pull = pull + np.bincount(at, weights=error[own], minlength=m)
            total += error.sum()
        x = ahead - pull / bound
        new = np.sign(x) * np.maximum(np.abs(x) - lasso / bound, 0.0)
        new_b = ahead_b - total / (0.25 * size.sum())
        if ((ahead - new) * (new - w) * bound).sum() > 0:
            pace = 1.0  # overshot: the pace starts anew
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead, ahead_b = new + (pace - 1) / faster * (new - w), new_b + (pace - 1) / faster * (new_b - b)
        moved = max(np.abs(new - w).max(), abs(new_b - b))
        w, b, pace = new, new_b, faster
        if moved < 1e-4:
            break
    machine.weights, machine.bias = w, float(b)


def _fit_vectors(rows: Rows, labels: np.ndarray, fixed: np.ndarray, factors: np.ndarray, hold: float, rng, epochs: int, batch: int = 256, rate: float = 0.02) -> None:
    """Adam on the vectors, beside what bias and weights give each row."""
    n, m = rows.count, len(factors)
    mean, square, step = np.zeros_like(factors), np.zeros_like(factors), 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for i in range(0, n, batch):
            drawn = order[i : i + batch]
            own, at = rows.drawn(drawn)
            sums = np.stack([np.bincount(own, weights=c[at], minlength=len(drawn)) for c in factors.T], 1)
            squares = np.bincount(own, weights=(factors * factors).sum(1)[at], minlength=len(drawn))
            error = (sigmoid(fixed[drawn] + 0.5 * ((sums * sums).sum(1) - squares)) - labels[drawn]) / len(drawn)
            each = np.bincount(at, weights=error[own], minlength=m)
            pull = np.stack([np.bincount(at, weights=(error * c)[own], minlength=m) for c in sums.T], 1) - each[:, None] * factors
            pull += hold / n * factors
            step += 1
            mean, square = 0.9 * mean + 0.1 * pull, 0.999 * square + 0.001 * pull * pull
            factors -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-6)


def _linear(rows: Rows, weights: np.ndarray) -> np.ndarray:
    """What the weights of its terms give each row."""
    return np.concatenate([np.bincount(own, weights=weights[at], minlength=hi - lo) for lo, hi, own, at in rows.pieces()])


def _pairs(rows: Rows, factors: np.ndarray) -> np.ndarray:
    """What the pairs of its terms give each row."""
    out = np.zeros(rows.count)
    for lo, hi, own, at in rows.pieces():
        for f in factors.T:
            sums = np.bincount(own, weights=f[at], minlength=hi - lo)
            out[lo:hi] += 0.5 * (sums * sums - np.bincount(own, weights=(f * f)[at], minlength=hi - lo))
    return out


def fit(labels: np.ndarray, owner: np.ndarray, place: np.ndarray, vocabulary: np.ndarray, turns: int = 3, epochs: int = 5, seed: int = 17) -> Machine:
    """Weights of all terms, then in turns the vectors beside them and the weights beside the pairs.

    ``owner`` is sorted, ``place`` indexes the vocabulary.  Vectors are pulled
    to 0 by SHRINK times the mean number of terms of a row: less would let the
    terms of one row learn that row by heart.  A pair in fewer rows than that
    stays at 0, so terms of fewer rows have no vector.
    """
    rng = np.random.default_rng(seed)
    n, m = len(labels), len(vocabulary)
    share = (labels.sum() + 0.5) / (n + 1.0)
    machine = Machine(float(np.log(share / (1 - share))), vocabulary, np.zeros(m), np.zeros((m, FACTORS)))
    if not m or labels.min() == labels.max():
        return machine
    rows = Rows(place, np.searchsorted(owner, np.arange(n + 1)))
    hold = SHRINK * len(place) / n
    often = np.flatnonzero(np.bincount(place, minlength=m) >= hold)
    known = np.full(m, -1, np.int32)
    known[often] = np.arange(len(often), dtype=np.int32)
    kept = known[place] >= 0
    few = Rows(known[place[kept]], np.searchsorted(owner[kept], np.arange(n + 1)))
    vectors = rng.normal(0, 0.01, (len(often), FACTORS))
    pairs = np.zeros(n)
    _fit_weights(rows, labels, pairs, machine, STEPS)
    for turn in range(turns if len(often) else 0):
        _fit_vectors(few, labels, machine.bias + _linear(rows, machine.weights), vectors, hold, rng, epochs)
        pairs = _pairs(few, vectors)
        _fit_weights(rows, labels, pairs, machine, STEPS if turn == turns - 1 else REFIT)
    if len(often):
        machine.factors[often] = vectors
    return machine


def _gather(batches):
    for batch in common.blocks(batches, "text"):
        owner, term = terms(batch.column("text"))
        cuts = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(term.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), lists], ["toxic", "terms"])


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Machine:
    """The machine learned from rows that are not held out.

    At most ``max_labelled`` labels are drawn, so their table is small enough to
    be broadcast to the texts, and the terms of their rows to be fitted in one place.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).toArrow()
    small = spark.createDataFrame(drawn) if drawn.num_rows else local_table(spark, [], "doc_id long, toxic int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_column().alias("text"))
    rows = rows.join(F.broadcast(small), "doc_id").select("text", "toxic")
    seen = common.written(common.map_arrow(rows, _gather, "toxic int, terms array<int>"), "labelled-terms")

    held = seen.toArrow().combine_chunks()  # bounded by max_labelled
    if not held.num_rows:
        return fit(np.empty(0), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64))
    lists = held.column("terms").combine_chunks()
    known_terms = lists.flatten().to_numpy()
    vocabulary = np.flatnonzero(np.bincount(known_terms, minlength=1 << HASH_BITS))
    lookup = np.zeros(1 << HASH_BITS, np.int32)
    lookup[vocabulary] = np.arange(len(vocabulary), dtype=np.int32)
    owner = np.repeat(np.arange(held.num_rows, dtype=np.int32), lists.value_lengths().to_numpy())
    return fit(held.column("toxic").to_numpy().astype(np.float64), owner, lookup[known_terms], vocabulary)


def _score(batches, shared: Broadcast):
    machine: Machine = shared.value
    lookup = machine.lookup()
    for batch in common.blocks(batches, "_text"):
        owner, term = terms(batch.column("_text"))
        place = lookup[term]
        hit = place >= 0
        score = sigmoid(machine.logits(owner[hit], place[hit], batch.num_rows))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))],
            [*batch.schema.names[:-1], "score", "predicted"],
        )


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """All documents with ``score`` (0 to 1) and ``predicted`` (1 from the threshold on).  No row moves."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # at most 2**HASH_BITS terms, 76 MB
    rows = docs.drop("score", "predicted").withColumn("_text", common.text_column())
    schema = StructType([*rows.schema.fields[:-1], StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return common.map_arrow(rows, partial(_score, shared=shared), schema)
