"""Operators whose result has one right value, against plain Python."""

import collections
import hashlib
import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tenfold.llm import graph, lengths, neighbours, packing, setjoin, sharding, substrings, tokens
from tests.llm import fixtures as fx

PATH = tokens.word_bpe_path()


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


ODD_TEXTS = ["", "Don't stop!! 's 't", "<|endoftext|> a<|startoftext|>b", "ΑΣ ΣΑΣ İstanbul ǅ ǆ", "été É́", "a b c\x1cd\x85e", "12 3.5 x²", "日本語 текст", "a\tb\r\nc\x0bd", "��", "ß ẞ ﬁ"]


@pytest.mark.parametrize("text", ODD_TEXTS)
def test_pieces_give_the_ids_of_the_library(tokenizer, text):
    enc = tokens.encoder(PATH)
    for _ in range(2):  # fresh and remembered
        assert enc.ids(enc.encode(text)).tolist() == ids_of(tokenizer, text)


def test_packing_holds_every_id_once(spark, tokenizer):
    data = fx.rows()
    found = packing.pack(fx.clashing(fx.documents(spark, data), "tokens", "ids", "part", "curve"), PATH, length=256, with_ids=True).collect()
    want = collections.Counter()
    for doc, text, *_ in data:
        want[(doc, tuple([*ids_of(tokenizer, text), 1]))] += 1
    stream = [i for r in sorted(found, key=lambda r: (r["sequence_id"], r["offset"])) for i in r["ids"]]
    got, at = collections.Counter(), 0
    pieces = sorted(found, key=lambda r: (r["sequence_id"], r["offset"]))
    for _, group in itertools.groupby(pieces, key=lambda r: r["sequence_id"]):
        end = 0
        for r in group:
            assert r["offset"] == end and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
            end += r["length"]
        assert end == 256 or r["sequence_id"] == pieces[-1]["sequence_id"]
    while at < len(stream):  # documents lie whole in the stream, one after the other
        r = next(p for p in pieces if p["sequence_id"] * 256 + p["offset"] == at)
        assert r["start"] == 0
        got[(r["doc_id"], tuple(stream[at : at + r["doc_tokens"]]))] += 1
        at += r["doc_tokens"]
    assert got == want
    whole = packing.sequences(packing.pack(fx.documents(spark, data), PATH, length=256, with_ids=True)).collect()
    assert sum(len(r["ids"]) for r in whole) == len(stream)
    assert packing.pack(fx.empty(spark), PATH).count() == 0


def test_hilbert_keys_visit_neighbours():
    grid = np.array(list(itertools.product(range(8), repeat=3)))
    keys = packing.hilbert_keys(grid, bits=3)
    assert sorted(keys) == list(range(512))
    path = grid[np.argsort(keys)]
    assert np.all(np.abs(np.diff(path, axis=0)).sum(1) == 1)


def test_length_histogram(spark, tokenizer):
    data = fx.rows()
    docs = fx.clashing(fx.documents(spark, data), "length", "docs")
    by_lang = collections.defaultdict(list)
    for _, text, lang, *_ in data:
        by_lang[lang or ""].append(len(ids_of(tokenizer, text)))
    hist = lengths.histogram(docs, PATH, ["lang"])
    sums = lengths.suffix_sums(hist, ["lang"])
    got = {(r["lang"], r["context_limit"]): r for r in sums.collect()}
    assert set(got) == {(k, n) for k, v in by_lang.items() for n in v}
    for (lang, limit), r in got.items():
        v = by_lang[lang]
        assert r["docs"] == v.count(limit) and r["docs_longer"] == sum(n > limit for n in v)
        assert r["docs_total"] == len(v) and r["tokens_total"] == sum(v)
        assert r["tokens_kept"] == sum(min(n, limit) for n in v) == sum(v) - r["tokens_cut"]
    for r in lengths.quantiles(sums, [0.5, 0.9], ["lang"]).collect():
        v = sorted(by_lang[r["lang"]])
        assert r["length"] == v[max(1, int(np.ceil(r["share"] * len(v)))) - 1]
    for r in lengths.at_limits(hist, [0, 77, 10**6], ["lang"]).collect():
        v = by_lang[r["lang"]]
        assert r["tokens_kept"] == sum(min(n, r["context_limit"]) for n in v) and r["docs_longer"] == sum(n > r["context_limit"] for n in v)
    assert lengths.suffix_sums(lengths.histogram(fx.empty(spark), PATH)).count() == 0


def test_shards(spark):
    docs = fx.clashing(fx.documents(spark), "shard", "Slot", "slot", "bucket", "_order", "_rows", "_size", "row", "order", "place")
    n = F.col("n_chars")
    found = [sharding.dealt(docs, ["doc_id", "text"], n, 7, bucket_bytes=4000).select("row.doc_id", "row.text", "row.order", "shard", "slot").collect() for _ in range(2)]
    rows = found[0]
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in rows))) == sorted(map(repr, (r[:2] for r in fx.rows())))
    assert {r["order"] for r in rows} == {"own"}
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(7)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    key = lambda r: (r["shard"], r["slot"], r["doc_id"] or -1)
    assert sorted(map(key, found[0])) == sorted(map(key, found[1]))
    assert sharding.dealt(fx.empty(spark), ["doc_id"], n).count() == 0


def test_shards_with_more_buckets_than_the_smallest_number_of_slices(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FINE_BITS", 2)
    docs = fx.documents(spark, [(i, "a" * 50, "en", "s", 50) for i in range(600)])
    table = sharding.permuted(docs, ["doc_id", "text"], F.col("n_chars"), bucket_bytes=100)
    per = [r["count"] for r in table.groupBy("bucket").count().collect()]
    assert sum(per) == 600 and max(per) <= 12 and len(per) > 200


def test_sharding_query_writes_whole_documents(spark, monkeypatch):
    """The shards hold every document with its text, and the query's digests are those of the rows in them."""
    from tenfold.llm import queries
    from tests.conftest import SF

    paths = []
    write = sharding.write_shards
    monkeypatch.setattr(sharding, "write_shards", lambda rows, path: (paths.append(path), write(rows, path)))
    found = queries.QUERIES["op9_sharding"](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    shards = spark.read.parquet(paths[0]).select("row.*", "shard", "slot")
    content = lambda df: sorted(map(tuple, df.select(*docs.columns).collect()), key=repr)
    assert content(shards) == content(docs)
    row = lambda r: (r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode()), r["shard"], r["slot"])
    assert sorted(map(row, shards.collect()), key=repr) == sorted(((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in found), key=repr)
    counts = collections.Counter(r["shard"] for r in found)
    assert len(counts) == 16 and max(counts.values()) - min(counts.values()) <= 1


def test_shards_of_repeated_rows(spark):
    same = [(1, "a" * 90, "en", "s", 90)] * 400
    rows = sharding.dealt(fx.documents(spark, same), ["doc_id", "text"], F.col("n_chars"), 4, bucket_bytes=3000).collect()
    assert collections.Counter(r["shard"] for r in rows) == {s: 100 for s in range(4)}


def brute_groups(data, percent=75):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = []
    for _, text, *_ in data:
        w = (text or "").encode().translate(lower).split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(data)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(data)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(data):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), low.get(find(i))) for i, r in enumerate(data)), key=repr), len({find(i) for i in range(len(data)) if sets[i]}), sum(not s for s in sets)


def test_jaccard_groups(spark):
    data = fx.rows()
    docs = fx.clashing(fx.documents(spark, data), "class", "n", "key", "block", "shingles")
    want, groups, empties = brute_groups(data)
    assert sorted(fx.collected(setjoin.join(docs)), key=repr) == want
    one = setjoin.one_of_each(fx.documents(spark, data)).collect()
    assert len(one) == groups + empties
    assert setjoin.join(fx.empty(spark)).count() == 0


def test_jaccard_groups_of_short_and_long_sets(spark):
    """Many sizes around the threshold, so that both parts of the join and their boundary are met."""
    rng = __import__("random").Random(5)
    data, vocabulary = [], [f"w{i}" for i in range(4000)]
    for i in range(60):
        n = rng.choice([5, 6, 7, 8, 9, 12, 16, 40, 150])
        base = [rng.choice(vocabulary) for _ in range(n + 4)]
        for k in range(rng.randint(1, 5)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, n // 12))):
                w[rng.choice([0, 1, len(w) - 1, len(w) - 2, rng.randrange(len(w))])] = rng.choice(vocabulary)
            data.append((len(data), " ".join(w[: len(w) - rng.randint(0, 1)]), "en", "s", 0))
    assert sorted(fx.collected(setjoin.join(fx.documents(spark, data))), key=repr) == brute_groups(data)[0]


def test_boundary_follows_cost():
    assert setjoin.boundary([(10, 100), (500, 100)], 50.0) in range(11, 501)
    assert setjoin.boundary([(500, 100)], 1.0) == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (5, 5), (3, 9), (2, 1)] + [(100 + i, 101 + i) for i in range(40)]
    got = dict(fx.collected(graph.components(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {**{1: 1, 2: 1, 3: 1, 9: 1, 10: 10, 11: 10}, **{100 + i: 100 for i in range(41)}}


def test_components_shuffle_seldom(spark, monkeypatch):
    """The driver keeps what it knows of every task, so rounds must not make more of them than they need."""
    rounds, written = [], graph.common.written
    monkeypatch.setattr(graph.common, "written", lambda df, label: rounds.append(label) or written(df, label))
    context, parts = spark.sparkContext, spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    edges = [(i, i + 1) for i in range(60)] + [(1000, 2000 + i) for i in range(300)] + [(4000, 2200 + i) for i in range(300)]
    try:
        context.setJobGroup("components", "rounds of stars")
        got = dict(fx.collected(graph.components(spark.createDataFrame(edges, "a long, b long"))))
        tracker = context.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup("components") for s in tracker.getJobInfo(j).stageIds}
        tasks = sum(tracker.getStageInfo(s).numCompletedTasks for s in stages)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", parts)
    assert got == {**{i: 0 for i in range(61)}, **{1000: 1000, 4000: 1000}, **{2000 + i: 1000 for i in range(500)}}
    assert tasks < 10 * int(spark.conf.get("spark.sql.shuffle.partitions")) * len(rounds), (tasks, len(rounds))


def brute_repeats(data, length):
    seen = collections.Counter()
    raw = [(r[0], (r[1] or "").encode()) for r in data]
    for _, b in raw:
        seen.update(b[p : p + length] for p in range(len(b) - length + 1))
    out = []
    for doc, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        out.append((doc, len(b), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("length", "gram"), [(200, 64), (50, 16), (33, 33)])
def test_repeated_strings(spark, monkeypatch, length, gram):
    data = fx.rows()
    docs = fx.clashing(fx.documents(spark, data).repartition(5), "block", "data", "sent", "codes")
    assert sorted(fx.collected(substrings.remove_repeats(docs, length, gram)), key=repr) == brute_repeats(data, length)


def test_repeated_strings_of_an_empty_table(spark):
    assert substrings.remove_repeats(fx.empty(spark)).count() == 0


def test_runs_do_not_depend_on_slices(monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    starts = np.array([0, 40, 40, 2500, 5000])
    whole = substrings.Block(data, starts, 60, 20)
    monkeypatch.setattr(substrings, "SLICE", 512)
    cut = substrings.Block(data, starts, 60, 20)
    cover = lambda b: np.concatenate([np.arange(f, f + c) for f, c in zip(b.first, b.count, strict=True)])
    assert np.array_equal(cover(whole), cover(cut))
    want = [p for a, e in itertools.pairwise(starts) for p in range(a, e - 60 + 1)]
    assert cover(whole).tolist() == want


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 24)) * rng.uniform(0.5, 2.0, (3000, 1))
    rows = [(i, v.tolist(), "own") for i, v in enumerate(x)]
    rows += [(5000 + i, x[7].tolist(), "own") for i in range(40)] + [rows[3], rows[3]]
    rows += [(9000, None, ""), (9001, [0.0] * 24, ""), (9002, [float("nan")] * 24, ""), (9003, [None, 1.0], ""), (9004, [], ""), (None, x[0].tolist(), ""), (9005, [float("inf")] * 24, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, bucket string")
    found = collections.defaultdict(list)
    for r in sorted(neighbours.search(df, "pmod(id, 20) = 0" and __import__("pyspark.sql.functions", fromlist=["expr"]).expr("pmod(id, 20) = 0")).collect(), key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append((r["id"], r["score"]))
    ids = np.array([*range(3000), *range(5000, 5040)])
    all_x = np.concatenate([x, np.repeat(x[7:8], 40, 0)])
    hits = 0
    queries = [i for i in ids if i % 20 == 0]
    assert set(found) == set(queries)
    for q in queries:
        scores = all_x @ all_x[np.flatnonzero(ids == q)[0]]
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:20]
        assert len(found[q]) == 20 and q not in [i for i, _ in found[q]]
        assert all(abs(s - scores[np.flatnonzero(ids == i)[0]]) < 1e-9 for i, s in found[q])
        hits += len({i for i, _ in found[q]} & set(ids[order]))
    assert hits / (20 * len(queries)) >= 0.9


def test_few_neighbours(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0]), (20, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["id"]) for r in sorted(neighbours.search(df, F.expr("pmod(id, 20) = 0")).collect())]
    assert got == [(0, 20), (0, 1), (0, 2), (20, 0), (20, 1), (20, 2)]
    assert neighbours.search(df.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize(("rows", "occupancy"), [(60_000, neighbours.OCCUPANCY), (20_000, 8)])
def test_recall_holds_with_many_buckets(spark, rows, occupancy):
    """The shipped setting on a large table, and 4,096 buckets, as a table of a million and more has."""
    from pyspark.sql import functions as F

    x = np.random.default_rng(3).normal(size=(rows, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame(__import__("pandas").DataFrame({"vec_id": np.arange(len(x)), "embedding": list(x)}))
    found = collections.defaultdict(set)
    for r in neighbours.search(df, F.expr("pmod(id, 400) = 0"), occupancy=occupancy).collect():
        found[r["query_id"]].add(r["id"])
    queries = np.arange(0, len(x), 400)
    score = x[queries] @ x.T
    score[np.arange(len(queries)), queries] = -1
    best = np.argsort(-score, axis=1)[:, :20]
    assert all(len(found[q]) == 20 for q in queries)
    share = np.mean([len(found[q] & set(b.tolist())) / 20 for q, b in zip(queries.tolist(), best, strict=True)])
    assert share >= 0.93


def test_queries_that_meet_too_few_visit_all(spark):
    from pyspark.sql import functions as F

    x = np.random.default_rng(4).normal(size=(400, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = neighbours.search(df, F.expr("pmod(id, 20) = 0"), tables=1, probes=1, occupancy=4, recall=0.0).collect()
    counts = collections.Counter(r["query_id"] for r in rows)
    assert counts == dict.fromkeys(range(0, 400, 20), 20)


def test_ranks_follow_the_probes():
    x = np.random.default_rng(5).normal(size=(50, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for axes in ([4], [8, 2]):
        which = np.arange(50) % 7
        own = neighbours.codes(x, axes, 1, 0, 1)[:, 0]
        probed = neighbours.codes(x[:7], axes, 1, 0, 1000)
        want = [probed[q].tolist().index(c) for q, c in zip(which, own, strict=True)]
        assert neighbours.ranks(x[:7], x, which, axes, 1, 0).tolist() == want
