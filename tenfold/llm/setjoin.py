"""N-gram Jaccard join: a size-aware join with a heavy and a light part.

Each text is the set of its distinct word shingles; texts of equal sets form a
class.  The join runs in four steps.

1. Exclusion.  In the order of the shingles' hashes, two similar sets share many
   of their first shingles.  A set most of whose first shingles occur nowhere
   else has no partner and leaves.  This reads every text and moves five bytes
   and a place per first shingle.
2. Keys.  Among the sets left, shingles are ordered by their number of sets.
   Small sets enumerate the two-element subsets of their rarest shingles (any
   partner has one of them); large sets enter the inverted lists of their rarest
   shingles.  Sets near the boundary do both.  The boundary is the one of least cost.
3. Links.  In rounds, each set is compared with one partner of another group, the
   one it shares most keys with or any that leads one of its keys, which joins most
   of each group.  Then only sets of groups still different that share a key are
   compared, by outlines first, which rule out a pair only if it is not similar; so a
   large group does not meet itself pair by pair.
4. Groups are the connected components; every link between different groups has
   been tested exactly on whole sets.

Defined cases: texts without words have no set and stand alone; a missing text is
empty; repeated rows share a class; ties need no order; a missing doc_id takes
part, but is never a group's name while another id is there; an empty table gives
no rows; further columns are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenfold.llm import common, graph
from tenfold.operators.joins import pin_small

WORDS = 5
PERCENT = 75
#: First shingles of a set are those that any partner must meet, and an eighth of the set more.
MARGIN = 8
#: First shingles per group of the exclusion step.
RANGE_ROWS = 1_000_000
#: Ids of sets left that may be broadcast to the texts; beyond, the texts are shuffled.
BROADCAST_IDS = 1_000_000
#: Sets that share a key, looked at together with as many others.
MEMBERS = 1024
#: Bits of a set's outline.
BITS = 2048
#: Sets that lead a key in a round of stars, and leads that a set is compared with after the first round.
LEADS, PARTNERS = 3, 4
_NOWHERE = 0xFFFF


def least_overlap(n, percent: int = PERCENT):
    """Shingles that a set of n shares with any partner at least."""
    return -(-percent * n // 100)


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Distinct hashed shingles of each text, ascending; fewer words than a shingle count as one."""
    data, starts = common.joined_bytes(texts)
    small = common.lower_ascii(data)
    begin, end, first = common.word_bounds(small, starts)
    word = common.Prints(small, 5).of(begin, end - begin) if len(begin) else np.empty(0, np.uint64)
    rolled = word.copy()
    for j in range(1, words):
        rolled[: len(word) - j] = common.mix64(rolled[: len(word) - j] + np.uint64(j)) ^ word[j:]
    rolled = common.mix64(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            h = word[a : a + 1]
            for j in range(a + 1, b):
                h = common.mix64(h + np.uint64(99)) ^ word[j : j + 1]
            out.append(common.mix64(h + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def class_of(shingles: np.ndarray) -> int:
    """A 64-bit name of a set."""
    spread = common.mix64(shingles + np.uint64(0x5851F42D4C957F2D))
    return int(common.mix64(np.array([np.bitwise_xor.reduce(spread)]) + spread.sum(dtype=np.uint64) + np.uint64(len(shingles)))[0].view(np.int64))


def _scan(batches, words: int, percent: int, ranges: int):
    """Rows about texts (block, place, doc_id, n, class, met) and packed first shingles (block, rng, packed)."""
    part, seq = TaskContext.get().partitionId(), 0
    for batch in common.blocks(batches, "text"):
        for cut in range(0, batch.num_rows, 50_000):
            piece = batch.slice(cut, 50_000)
            block, seq = part << 32 | seq, seq + 1
            sets = shingle_sets(piece.column("text"), words)
            n = np.array([len(s) for s in sets])
            take = np.where(n > 0, n - least_overlap(n, percent) + 1 + n // MARGIN, 0)
            first = np.concatenate([s[:k] for s, k in zip(sets, take.tolist(), strict=True)])
            place = np.repeat(np.arange(len(sets)), np.minimum(take, n))
            _, inverse, count = np.unique(first, return_inverse=True, return_counts=True)
            met_here = count[inverse] > 1
            met = np.bincount(place[met_here], minlength=len(sets))
            order = np.argsort(inverse, kind="stable")
            lead = order[np.concatenate([[True], inverse[order][1:] != inverse[order][:-1]])] if len(order) else order
            value, at = common.mix64(first[lead]), np.where(met_here[lead], _NOWHERE, place[lead]).astype("<u2")
            rng = (value % np.uint64(ranges)).astype(np.int64)
            short = (value >> np.uint64(24)).astype("<u8")
            order = np.argsort(rng, kind="stable")
            bounds = np.searchsorted(rng[order], np.arange(ranges + 1))
            packed, where = [], []
            for r in np.flatnonzero(np.diff(bounds)).tolist():
                o = order[bounds[r] : bounds[r + 1]]
                packed.append(short[o].view(np.uint8).reshape(-1, 8)[:, :5].tobytes() + at[o].tobytes())
                where.append(r)
            m, k = len(sets), len(packed)
            names = [class_of(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block] * (m + k), pa.int64()),
                    pa.array(list(range(m)) + [None] * k, pa.int32()),
                    pa.array(piece.column("doc_id").to_pylist() + [None] * k, pa.int64()),
                    pa.array(n.tolist() + [None] * k, pa.int64()),
                    pa.array(names + [None] * k, pa.int64()),
                    pa.array(piece.column("text_hash").to_pylist() + [None] * k, pa.int64()),
                    pa.array(met.tolist() + [None] * k, pa.int64()),
                    pa.array([None] * m + where, pa.int32()),
                    pa.array([None] * m + packed, pa.binary()),
                ],
                ["block", "place", "doc_id", "n", "class", "text_hash", "met", "rng", "packed"],
            )


def _meet(table: pa.Table) -> pa.Table:
    """Of one range of hashes: the texts of each block whose first shingles occur in other blocks too, once per shingle."""
    values, places, blocks = [], [], []
    for block, packed in zip(table.column("block").to_pylist(), table.column("packed").to_pylist(), strict=True):
        k = len(packed) // 7
        raw = np.zeros((k, 8), np.uint8)
        raw[:, :5] = np.frombuffer(packed, np.uint8, 5 * k).reshape(k, 5)
        values.append(raw.view("<u8").ravel())
        places.append(np.frombuffer(packed, "<u2", k, 5 * k))
        blocks.append(np.full(k, block, np.int64))
    value, place, block = np.concatenate(values), np.concatenate(places), np.concatenate(blocks)
    order = np.argsort(value, kind="stable")
    same = value[order][1:] == value[order][:-1]
    met = np.zeros(len(value), bool)
    met[order[1:][same]] = True
    met[order[:-1][same]] = True
    met &= place != _NOWHERE
    order = np.argsort(block[met], kind="stable")
    block, place = block[met][order], place[met][order]
    at = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.empty(0, np.int64)
    ends = np.append(at[1:], len(block))[: len(at)]
    return pa.table({"block": pa.array(block[at]), "places": pa.array([place[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary())})


def _add_up(table: pa.Table) -> pa.Table:
    """First shingles met elsewhere per text of one block, over all ranges."""
    places = np.concatenate([np.frombuffer(p, "<u2") for p in table.column("places").to_pylist()])
    more = np.bincount(places)
    some = np.flatnonzero(more)
    block = table.column("block")[0].as_py()
    return pa.table({"block": pa.array([block] * len(some), pa.int64()), "place": pa.array(some.astype(np.int32)), "more": pa.array(more[some].astype(np.int64))})


def _sets(batches, words: int):
    for batch in common.blocks(batches, "text"):
        sets = shingle_sets(batch.column("text"), words)
        keep = [s for s in sets if len(s) > 2]
        yield pa.RecordBatch.from_arrays(
            [pa.array([class_of(s) for s in keep], pa.int64()), pa.array([common.signed(s) for s in keep], pa.list_(pa.int64()))], ["class", "shingles"]
        )


def boundary(sizes: Sequence[tuple[int, int]], mean_list: float, percent: int = PERCENT) -> int:
    """The size from which on sets are large, of least cost.

    ``sizes`` has sizes and their numbers of sets.  A small set costs its subsets,
    which are about as rare as the sets; a large one, and any small one that may
    meet a large one, costs the lists of its rarest shingles.  A list is joined by
    its star first, so a set meets few of a long list: its length counts by its logarithm.
    """
    entry = 1 + math.log2(max(mean_list, 1.0))
    best, at = None, 0
    steps = [0, *sorted({m for n, _ in sizes for m in (n + 1, 100 * n // percent + 1)})]
    for x in steps:
        cost = 0.0
        for n, number in sizes:
            rare = n - least_overlap(n, percent) + 1
            if n < x:
                cost += number * (rare + 1) * rare / 2
            if 100 * n >= percent * x:
                cost += number * rare * entry
        if best is None or cost < best:
            best, at = cost, x
    return at


def scan(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The written result of step 1's pass over the texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_column().alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(16, -(-size // (16 * RANGE_ROWS)))
    made = common.map_arrow(
        rows, partial(_scan, words=words, percent=percent, ranges=ranges),
        "block long, place int, doc_id long, n long, class long, text_hash long, met long, rng int, packed binary",
    )
    return common.written(made, "first-shingles")


def candidates(docs: DataFrame, scanned: DataFrame, words: int, percent: int) -> DataFrame:
    """Whole sets that may have a partner: class, n, shingles."""
    packed = scanned.where("packed is not null").select("block", "rng", "packed")
    more = packed.groupBy("rng").applyInArrow(_meet, "block long, places binary")
    more = more.groupBy("block").applyInArrow(_add_up, "block long, place int, more long")
    texts = scanned.where("place is not null").select("block", "place", "doc_id", "n", "class", "met")
    met = F.col("met") + F.coalesce(F.col("more"), F.lit(0))
    partner = F.ceil(F.col("n") * percent / 100)
    left = texts.where("n > 2").join(more, ["block", "place"], "left").where(met >= 1 + F.floor(partner / MARGIN))
    ids = common.written(left.groupBy("class").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct(), "sets-left")
    ids, small = pin_small(ids, BROADCAST_IDS)
    ids = ids.withColumnRenamed("doc_id", "_id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_column().alias("text"))
    rows = rows.join(F.broadcast(ids) if small else ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text")
    sets = common.map_arrow(rows, partial(_sets, words=words), "class long, shingles array<long>").dropDuplicates(["class"])
    return common.written(sets.withColumn("n", F.size("shingles").cast("long")), "sets")


def keys(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Step 2: key, class, n, left.  Similar sets share a key.

    ``left`` counts the set's shingles from the key's (first) one on, in the order
    by rarity.  At the first key that two sets share, they have no more than the
    smaller ``left`` in common; a pair that this rules out at some key either
    passes at its first one or is not similar.
    """
    each = sets.select("class", F.explode("shingles").alias("s"))
    often = each.groupBy("s").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    shared = each.join(often, "s").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("f", "s"))).alias("shared"))
    sets = sets.select("class", "n").join(shared, "class")
    # Shingles of one set only come first in the order and meet nothing; what is left of the rarest ones counts.
    rare = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("shared"))
    sets = sets.withColumn("rare", rare.cast("int")).where("rare > 0")
    sets = sets.withColumn("meets", F.size("shared")).withColumn("shared", F.slice("shared", F.lit(1), F.col("rare") + 1))
    sets = common.written(sets, "rare-shingles")
    sizes = [(r["n"], r["count"]) for r in sets.groupBy("n").count().collect()]  # a row per size
    mean = sets.agg(F.avg(F.aggregate("shared", F.lit(0.0), lambda a, x: a + x["f"]) / F.size("shared"))).first()[0] or 1.0
    large = boundary(sizes, mean, percent)
    names = F.transform("shared", lambda x: x["s"])
    single = F.transform(F.slice(names, F.lit(1), F.col("rare")), lambda x, i: F.struct(x.alias("key"), (F.col("meets") - i).alias("left")))
    rest = lambda i: F.slice(names, i + 2, F.size(names))
    pair = lambda x, y, i: F.struct(F.xxhash64(F.least(x, y), F.greatest(x, y)).alias("key"), (F.col("meets") - i).alias("left"))
    double = F.flatten(F.transform(names, lambda x, i: F.transform(rest(i), lambda y: pair(x, y, i))))
    lists = sets.where(F.col("n") * 100 >= percent * large).select("class", "n", F.explode(single).alias("k"))
    subsets = sets.where(F.col("n") < large).select("class", "n", F.explode(double).alias("k"))
    return common.written(lists.unionByName(subsets).select("k.key", "class", "n", "k.left"), "keys")


def links(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of the pairs (a, b and any further columns) whose whole sets are similar."""
    a = sets.select(F.col("class").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("class").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    found = pairs.join(a, "a").join(b, "b").withColumn("both", both)
    return found.where(F.col("both") * 100 >= percent * (F.size("sa") + F.size("sb") - F.col("both"))).select(*pairs.columns)


def _may_link(n, left, m, left2, least, percent):
    """Whether sets of n and m shingles, with what is left of both at a shared key, may be similar."""
    sized = (n * 100 >= percent * m) & (m * 100 >= percent * n)
    return sized & (percent * (n + m) <= (100 + percent) * least(left, left2))


def _outlines(batches):
    """BITS bits of each set: a bit is set if a shingle falls on it."""
    for batch in batches:
        out = []
        for s in batch.column("shingles"):
            bits = np.zeros(BITS, np.uint8)
            bits[common.mix64(s.values.to_numpy().view(np.uint64)) % np.uint64(BITS)] = 1
            out.append(np.packbits(bits).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array(out, pa.binary())], ["class", "bits"])


def _alike(x, y, i, j, percent: int) -> np.ndarray:
    """Which of the pairs may be similar by their outlines: each bit that only one set has is a shingle that only one set has."""
    out = np.zeros(len(i), bool)
    for lo in range(0, len(i), 1 << 16):
        a, b = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
        apart = np.bitwise_count(x["bits"][a] ^ y["bits"][b]).sum(1, dtype=np.int64)
        out[lo : lo + len(a)] = apart * (100 + percent) <= (100 - percent) * (x["n"][a] + y["n"][b])
    return out


def _across(batches, percent: int):
    """Pairs of sets of different groups that share a key and may be similar."""
    for batch in batches:
        a, b = [], []
        for row in zip(*[batch.column(c) for c in ("part", "part2", "m", "m2")], strict=True):
            x, y = ({k: row[i].values.field(k).to_numpy() for k in ("class", "n", "left", "root")} for i in (2, 3))
            for i, held in ((2, x), (3, y)):
                held["bits"] = np.frombuffer(b"".join(row[i].values.field("bits").to_pylist()), np.uint64).reshape(-1, BITS // 64)
            may = _may_link(x["n"][:, None], x["left"][:, None], y["n"], y["left"], np.minimum, percent) & (x["root"][:, None] != y["root"])
            if row[0].as_py() == row[1].as_py():
                may &= x["class"][:, None] < y["class"]
            i, j = np.nonzero(may)
            keep = _alike(x, y, i, j, percent)
            a.append(x["class"][i[keep]])
            b.append(y["class"][j[keep]])
        if a:
            pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])


def _mixed(named: DataFrame) -> DataFrame:
    """Keys whose sets are in more than one group so far; only these can still link anything."""
    mixed = named.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("key")
    return common.written(named.join(mixed, "key"), "mixed-keys")


def _renamed(named: DataFrame, found: DataFrame) -> DataFrame:
    """Mixed keys after the found links (ra, rb between groups) have joined groups.

    Only the graph of groups is solved, which shrinks from round to round; a key
    that is no longer mixed has left for good.
    """
    roots = graph.stars(found.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    roots = roots.select(F.col("vertex").alias("root"), F.col("root").alias("_root"))
    named = named.join(roots, "root", "left").withColumn("root", F.coalesce("_root", "root")).drop("_root")
    return _mixed(common.written(named, "named-keys"))


def _stars(named: DataFrame, sets: DataFrame, percent: int, turn: int) -> DataFrame:
    """Links of each set to partners of other groups that lead its keys: at first the one it shares most keys with, then any few.

    The leads of a key are drawn anew each turn.  Sets that are linked to
    many others soon draw one of these, whichever sets their keys hold besides.
    """
    draws = [F.min(F.struct(F.xxhash64("class", "key", F.lit(LEADS * turn + j)).alias("draw"), "root", "class", "n", "left")) for j in range(LEADS)]
    ends = named.groupBy("key").agg(F.array(*draws).alias("leads"))
    both = named.join(ends, "key").select("class", "root", "n", "left", F.explode(F.array_distinct("leads")).alias("to"))
    may = (F.col("to.root") != F.col("root")) & _may_link(F.col("n"), F.col("left"), F.col("to.n"), F.col("to.left"), F.least, percent)
    ends = [F.col("class").alias("a"), F.col("to.class").alias("b"), F.col("root").alias("ra"), F.col("to.root").alias("rb")]
    star = both.where(may).groupBy(*ends).agg(F.count(F.lit(1)).alias("c"))
    drawn = F.xxhash64("a", "b", F.lit(turn))
    order = [F.col("c"), drawn] if turn == 0 else [drawn, F.col("c")]
    best = F.slice(F.sort_array(F.collect_list(F.struct(*order, "b", "rb")), asc=False), 1, 1 if turn == 0 else PARTNERS)  # a set has few leads
    best = star.groupBy("a", "ra").agg(best.alias("x"))
    best = best.select("a", "ra", F.explode("x").alias("x")).select("a", "x.b", "ra", "x.rb")
    return links(best, sets, percent)


def groups(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Steps 2 to 4: class, root (the smallest class of its group) of all sets with a partner.

    Rounds of stars join groups while they find links for a fiftieth of the sets
    that are still open; a key's star is a map-side-combined minimum, so it stays
    small for any number of sets.  What the last round leaves is compared pair by
    pair, across groups only.
    """
    named = _mixed(keys(sets, percent).withColumn("root", F.col("class")))
    near, turn = [], 0
    while True:
        found = common.written(_stars(named, sets, percent, turn), "links")
        n, turn = found.count(), turn + 1
        still = named.agg(F.approx_count_distinct("class")).first()[0]  # when to end is a matter of cost only
        if n:
            near.append(found.select("a", "b"))
            named = _renamed(named, found)
        if 50 * n <= still:
            break
    full = named.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("parts"))
    part = F.pmod(F.xxhash64("class"), F.col("parts")).alias("part")
    open_ = named.select("class").distinct()
    outlines = common.map_arrow(sets.join(open_, "class", "left_semi").select("class", "shingles"), _outlines, "class long, bits binary")
    cells = named.join(common.written(outlines, "outlines"), "class").join(full, "key")
    cells = cells.groupBy("key", part).agg(F.collect_list(F.struct("class", "n", "left", "root", "bits")).alias("m"))
    cells = common.written(cells, "key-groups")
    other = cells.select("key", F.col("part").alias("part2"), F.col("m").alias("m2"))
    met = cells.join(other, "key").where("part <= part2").select("part", "part2", "m", "m2")
    met = common.map_arrow(met, partial(_across, percent=percent), "a long, b long").distinct()
    across = links(met, sets, percent)
    return graph.components(reduce(DataFrame.unionByName, near, across)).withColumnRenamed("vertex", "class")


def _joined(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, class, component_id, group (a class; missing for an empty set)."""
    scanned = scan(docs, words, percent)
    rows = scanned.where("place is not null").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "class")
    roots = common.written(groups(candidates(docs, scanned, words, percent), percent), "groups")
    lowest = rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("low"))
    lowest = lowest.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = lowest.groupBy("root").agg(F.min("low").alias("component_id"))
    named = common.written(lowest.join(least, "root").select("class", "component_id", F.col("root").alias("group")), "group-names")
    # An empty set has no class: it joins nothing and stands alone.
    return rows.join(named, "class", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Every document with its group: doc_id, n_shingles, component_id (the smallest doc_id of the group)."""
    return _joined(docs, words, percent).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """All columns of one document of each group: that of the smallest doc_id, and of its texts that of the smallest hash.

    Texts without words all stay.  The documents that stay are named by doc_id
    and a hash of the text; their names are broadcast only below BROADCAST_IDS.
    """
    rows = common.written(_joined(docs, words, percent), "joined")
    first = rows.where("group is not null").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("x"))
    names = first.select(F.col("x.doc_id").alias("_id"), F.col("x.text_hash").alias("_hash"))
    empty = rows.where("group is null").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    names, small = pin_small(common.written(names.unionByName(empty), "names-that-stay"), BROADCAST_IDS)
    named = docs.withColumn("_text_hash", F.xxhash64(common.text_column()))
    key = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash"))
    stay = named.join(F.broadcast(names) if small else names, key, "left_semi")
    repeated = rows.where("group is not null").groupBy("doc_id", "text_hash").count().where("count > 1")
    if not repeated.limit(1).collect():
        return stay.drop("_text_hash")
    again = repeated.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    single = stay.join(again, key, "left_anti")
    return single.unionByName(stay.join(again, key, "left_semi").dropDuplicates(["doc_id", "_text_hash"])).drop("_text_hash")
