"""Removal of repeated substrings by distributed prefix doubling over sampled positions.

A byte goes if it lies in a string of ``length`` bytes that also starts anywhere
else.  Ranking the suffixes at all positions round by round would move every
position of the corpus several times; this keeps the rounds but leaves out
positions as soon as their rank is known to be unique.

Round 1 ranks samples.  Each window of ``length`` bytes is represented by the
place of its smallest 64-byte gram; equal windows have it at the same place, and
consecutive windows mostly share it, which gives one sample per run of about 60
windows.  The pair (rank of the gram, rank of the run's whole stretch) is sorted.
A gram seen once ends its run; a stretch seen twice settles all its windows.

Round 2 ranks the windows of runs whose gram is met again in another stretch: the
pair (rank of the first half, rank of the second half) of each is sorted.

Texts travel in blocks.  A block sends one entry per distinct pair, so a string
that a third of all texts hold arrives once per block, and gets back one code or
bit per entry.  No text, group of copies or list of positions meets in one task.

Defined cases: a missing text is empty; texts shorter than ``length`` stay whole;
repeated rows are copies of each other, so all of their bytes go; matches never
cross texts and may overlap; an empty table gives no rows; further columns are
not carried.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenfold.llm import common

LENGTH = 200
GRAM = 64
#: Windows looked at together inside a block; 20 bits hold a place among them.
SLICE = 1 << 19
#: Text of a block, which travels and is looked at as one.
BLOCK_BYTES = 4 << 20
#: Text per range of ranks, so that a range's entries fit a task many times over.
RANGE_BYTES = 16 << 20
_PLACE = np.uint64((1 << 20) - 1)
_CODEC = "zstd"


def runs(data: np.ndarray, starts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one smallest gram: first window, number, rank of the gram, rank of the stretch."""
    grams = length - gram + 1
    found: list[list[np.ndarray]] = [[], [], [], []]
    for base in range(0, max(0, len(data) - length + 1), SLICE):
        part = data[base : base + SLICE + length - 1]
        prints = common.Prints(part, 7)
        rank = prints.of(np.arange(len(part) - gram + 1), gram)
        low = (rank & ~_PLACE) | np.arange(len(rank), dtype=np.uint64)  # of equal grams the first
        span = 1
        while span * 2 <= grams:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if grams > span:
            low = np.minimum(low[: span - grams], low[grams - span :])
        place = (low & _PLACE).astype(np.int64)
        text = np.searchsorted(starts, np.arange(base, base + len(place)), side="right") - 1
        inside = np.flatnonzero(np.arange(base, base + len(place)) + length <= starts[text + 1])
        if not len(inside):
            continue
        at, own = place[inside], text[inside]
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (own[1:] != own[:-1]) | (np.diff(inside) > 1)]))
        count = np.diff(np.append(new, len(inside)))
        first = inside[new]
        found[0].append(first + base)
        found[1].append(count)
        found[2].append(rank[at[new]])
        found[3].append(common.mix64(prints.of(first, count + length - 1) ^ count.astype(np.uint64)))
    empty = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)]
    return tuple(np.concatenate(x) if x else e for x, e in zip(found, empty, strict=True))


class Block:
    """What a block knows by itself; the same whenever it is read."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, length: int, gram: int):
        self.data, self.length = data, length
        self.first, self.count, g, x = runs(data, starts, length, gram)
        pair = common.mix64(g) ^ x
        # One entry for runs of equal stretches; a stretch met twice here is settled.
        _, self.lead, self.entry, times = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
        self.g, self.x = g[self.lead], x[self.lead]
        self.settled = times > 1
        order = np.argsort(self.g, kind="stable")
        new = np.concatenate([[True], self.g[order][1:] != self.g[order][:-1]]) if len(order) else np.empty(0, bool)
        group = np.cumsum(new) - 1
        size = np.bincount(group) if len(group) else np.empty(0, np.int64)
        self.mixed = np.zeros(len(self.g), bool)  # its gram has another stretch in this block
        self.mixed[order] = size[group] > 1 if len(group) else False
        within = np.arange(len(order)) - np.flatnonzero(new)[group] if len(group) else order
        self.sent = np.sort(order[within < 2])  # two stretches of a gram tell others that it is mixed

    def windows(self, mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The windows of the mixed entries: their place, rank, and the distinct ranks with those met twice here."""
        lead = self.lead[np.flatnonzero(mixed)]
        count = self.count[lead]
        ends = np.cumsum(count)
        place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count) + np.repeat(self.first[lead], count)
        rank = np.empty(len(place), np.uint64)
        for base in range(0, len(self.data), SLICE):
            here = slice(*np.searchsorted(place, [base, base + SLICE])) if np.all(place[1:] >= place[:-1]) else (place >= base) & (place < base + SLICE)
            if len(place[here]):
                half = self.length // 2
                prints = common.Prints(self.data[base : base + SLICE + self.length], 9)
                a, b = prints.of(place[here] - base, half), prints.of(place[here] - base + half, self.length - half)
                rank[here] = common.mix64(a + common.mix64(b))  # the pair of ranks at the two offsets
        distinct, inverse, times = np.unique(rank, return_inverse=True, return_counts=True)
        return place, inverse, distinct, times > 1


def in_ranges(value: np.ndarray, ranges: int) -> list[np.ndarray]:
    """Places of the values of each range, ascending."""
    rng = (value % np.uint64(ranges)).astype(np.int64)
    order = np.argsort(rng, kind="stable")
    bounds = np.searchsorted(rng[order], np.arange(ranges + 1))
    return [order[bounds[r] : bounds[r + 1]] for r in range(ranges)]


def _bytes_of(value: np.ndarray, ranges: int, size: int) -> np.ndarray:
    """``size`` low bytes of what the range does not tell."""
    return (value // np.uint64(ranges)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]


def _values(raw: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, : raw.shape[1]] = raw
    return wide.view("<u8").ravel()


_SENT = "array<struct<rng: int, packed: binary>>"


def _sent_array(rows: list[list[tuple[int, bytes]]]) -> pa.Array:
    kind = pa.list_(pa.struct([("rng", pa.int32()), ("packed", pa.binary())]))
    return pa.array([[{"rng": r, "packed": b} for r, b in row] for row in rows], kind)


def _first_round(batches, length: int, gram: int, ranges: int):
    part, seq = TaskContext.get().partitionId(), 0
    for batch in common.blocks(batches, "text", BLOCK_BYTES):
        data, starts = common.joined_bytes(batch.column("text"))
        block = Block(data, starts, length, gram)
        g, x = block.g[block.sent], block.x[block.sent]
        known = block.mixed[block.sent].astype(np.uint8)[:, None]
        sent = [
            (r, np.hstack([_bytes_of(g[o], ranges, 6), _bytes_of(x[o], 1, 6), known[o]]).tobytes())
            for r, o in enumerate(in_ranges(g, ranges)) if len(o)
        ]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([part << 32 | seq], pa.int64()),
                pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                pa.array([np.diff(starts)], pa.list_(pa.int64())),
                pa.array([pa.compress(data.tobytes(), _CODEC, asbytes=True)], pa.binary()),
                _sent_array([sent]),
            ],
            ["block", "doc_ids", "sizes", "data", "sent"],
        )
        seq += 1


def _split(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, list]:
    """All entries of a range, which block each is from, and the blocks."""
    blocks = table.column("block").to_pylist()
    raw = [np.frombuffer(b, np.uint8).reshape(-1, width) for b in table.column("packed").to_pylist()]
    return np.concatenate(raw), np.repeat(np.arange(len(raw)), [len(r) for r in raw]), blocks


def _answers(table: pa.Table, blocks: list, owner: np.ndarray, code: np.ndarray) -> pa.Table:
    cuts = np.searchsorted(owner, np.arange(len(blocks) + 1))
    some = [i for i in range(len(blocks)) if code[cuts[i] : cuts[i + 1]].any()]
    rng = table.column("rng")[0].as_py()
    return pa.table(
        {
            "block": pa.array([blocks[i] for i in some], pa.int64()),
            "rng": pa.array([rng] * len(some), pa.int32()),
            "packed": pa.array([code[cuts[i] : cuts[i + 1]].tobytes() for i in some], pa.binary()),
        }
    )


def _rank_samples(table: pa.Table) -> pa.Table:
    """Code of each entry: 1 its stretch is met again, 2 its gram is met with another stretch; both may hold."""
    raw, owner, blocks = _split(table, 13)
    g, x, known = _values(raw[:, :6]), _values(raw[:, 6:12]), raw[:, 12] > 0
    order = np.lexsort((x, g))
    g, x = g[order], x[order]
    new_g = np.concatenate([[True], g[1:] != g[:-1]])
    new_x = new_g | np.concatenate([[True], x[1:] != x[:-1]])
    group_g, group_x = np.cumsum(new_g) - 1, np.cumsum(new_x) - 1
    kinds = np.bincount(group_g[new_x])
    again = np.bincount(group_x)[group_x] > 1
    mixed = (kinds[group_g] > 1) & ~known[order]
    code = np.zeros(len(raw), np.uint8)
    code[order] = again + 2 * mixed.astype(np.uint8)
    return _answers(table, blocks, owner, code)


def _rank_windows(table: pa.Table) -> pa.Table:
    """Code of each window: 1 if it is met again."""
    raw, owner, blocks = _split(table, 7)
    value = _values(raw)
    order = np.argsort(value, kind="stable")
    same = value[order][1:] == value[order][:-1]
    code = np.zeros(len(value), np.uint8)
    code[order[1:][same]] = 1
    code[order[:-1][same]] = 1
    return _answers(table, blocks, owner, code)


def _restored(row: dict, length: int, gram: int) -> tuple[Block, np.ndarray]:
    data = np.frombuffer(pa.decompress(row["data"], sum(row["sizes"]), _CODEC, asbytes=True), np.uint8) if row["sizes"] else np.empty(0, np.uint8)
    starts = np.concatenate([[0], np.cumsum(row["sizes"])]).astype(np.int64)
    return Block(data, starts, length, gram), starts


def _apply(values: np.ndarray, ranges: int, answers: list | None) -> np.ndarray:
    """The codes that came back for entries, in their order."""
    code = np.zeros(len(values), np.uint8)
    if answers:
        places = in_ranges(values, ranges)
        for a in answers:
            code[places[a["rng"]]] = np.frombuffer(a["packed"], np.uint8)
    return code


def _after_samples(block: Block, ranges: int, answers: list | None) -> tuple[np.ndarray, np.ndarray]:
    """Settled and mixed entries of a block, with what other blocks told."""
    code = _apply(block.g[block.sent], ranges, answers)
    settled, mixed = block.settled.copy(), block.mixed.copy()
    settled[block.sent] |= (code & 1) > 0
    mixed[block.sent] |= (code & 2) > 0
    return settled, mixed


def _second_round(batches, length: int, gram: int, ranges: int):
    for batch in batches:
        for row in batch.to_pylist():
            block, _ = _restored(row, length, gram)
            _, mixed = _after_samples(block, ranges, row["codes"])
            _, _, distinct, _ = block.windows(mixed)
            sent = [(r, _bytes_of(distinct[o], ranges, 7).tobytes()) for r, o in enumerate(in_ranges(distinct, ranges)) if len(o)]
            yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), _sent_array([sent])], ["block", "sent"])


def _remove(batches, length: int, gram: int, ranges: int, with_text: bool):
    for batch in batches:
        for row in batch.to_pylist():
            block, starts = _restored(row, length, gram)
            settled, mixed = _after_samples(block, ranges, row["codes"])
            place, inverse, distinct, twice = block.windows(mixed)
            again = twice | (_apply(distinct, ranges, row["windows"]) > 0)
            change = np.zeros(len(block.data) + 1, np.int32)
            whole = settled[block.entry]
            np.add.at(change, block.first[whole], 1)
            np.add.at(change, block.first[whole] + block.count[whole] + length - 1, -1)
            single = place[again[inverse]] if len(place) else place
            np.add.at(change, single, 1)
            np.add.at(change, single + length, -1)
            gone = np.cumsum(change[:-1]) > 0
            out: list[list] = [[] for _ in range(6)]
            for i, doc in enumerate(row["doc_ids"]):
                data, lost = block.data[starts[i] : starts[i + 1]], gone[starts[i] : starts[i + 1]]
                kept = data[~lost].tobytes()
                spans = int(lost[:1].sum() + (lost[1:] & ~lost[:-1]).sum())
                for values, v in zip(out, (doc, len(data), int(lost.sum()), spans, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    values.append(v)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            k = 6 if with_text else 5
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out[:k], kinds, strict=False)], names[:k])


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """What is left of every text: doc_id, n_bytes, n_removed, n_spans, kept_sha256; ``with_text`` adds the bytes kept.

    ``gram`` is shorter than ``length``.  The blocks are written once and read by
    both rounds and the removal, each next to the answers for the block.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_column().alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    settings = {"length": length, "gram": min(gram, length), "ranges": max(16, size // RANGE_BYTES)}
    schema = f"block long, doc_ids array<long>, sizes array<long>, data binary, sent {_SENT}"
    blocks = common.written(common.map_arrow(rows, partial(_first_round, **settings), schema), "blocks")

    def answered(sent: DataFrame, ranker, name: str) -> DataFrame:
        entries = sent.select("block", F.explode("sent").alias("e")).select("block", "e.rng", "e.packed")
        codes = entries.groupBy("rng").applyInArrow(ranker, "block long, rng int, packed binary")
        return codes.groupBy("block").agg(F.collect_list(F.struct("rng", "packed")).alias(name))

    codes = common.written(answered(blocks.select("block", "sent"), _rank_samples, "codes"), "sample-codes")
    texts = blocks.select("block", "doc_ids", "sizes", "data").join(codes, "block", "left")
    second = common.map_arrow(texts, partial(_second_round, **settings), f"block long, sent {_SENT}")
    windows = answered(second, _rank_windows, "windows")
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return common.map_arrow(texts.join(windows, "block", "left"), partial(_remove, with_text=with_text, **settings), out)
