"""Encoding and decoding against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tenfold.llm import bpe, queries
from tests.llm import fixtures as fx
from tests.llm.test_exact import ODD_TEXTS

PATHS = [public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")]
LIBRARY = {p: Tokenizer.from_file(p) for p in PATHS}


def ids_of(path, text):
    return LIBRARY[path].encode(text, add_special_tokens=False).ids


def encoded(path, text):
    return np.frombuffer(bpe.vocabulary(path).encode([text])[0], "<i4").tolist()


ALPHABETS = ["ab", "aeinrst", "abcdefghijklmnopqrstuvwxyz", "!?.,-", "😂😍🇺🇸", "日本語中文", "éàüß", "ab c\n\t'st"]


@pytest.mark.parametrize("path", PATHS)
@pytest.mark.parametrize("text", [*ODD_TEXTS, "a" * 33, "x" * 500, "😂" * 40, "🇺🇸" * 9, "</w>", "a</w>b"])
def test_odd_texts(path, text):
    ids = ids_of(path, text)
    assert encoded(path, text) == ids
    assert bpe.decoder(path).decode(np.array(ids, np.int64)) == LIBRARY[path].decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("path", PATHS)
@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.text(max_size=80), *[st.text(a, max_size=60) for a in ALPHABETS]))
def test_any_text(path, text):
    ids = ids_of(path, text)
    assert encoded(path, text) == ids
    assert bpe.decoder(path).decode(np.array(ids, np.int64)) == LIBRARY[path].decode(ids, skip_special_tokens=False)


def test_pairs_are_verified_and_failing_words_merged():
    """The check alone tells words that longest match gets right from those it gets wrong."""
    vocab = bpe.Vocabulary(PATHS[0])
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("aeinrstlo") for _ in range(rng.randint(1, 14))) for _ in range(3000)})
    raw = [w.encode() + bytes([bpe.END]) for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8)
    bounds = np.cumsum([0, *map(len, raw)])
    at, ids, good = vocab.propose(data, bounds)
    assert good.all()
    right = wrong = 0
    for k, w in enumerate(words):
        mine = ids[(at >= bounds[k]) & (at < bounds[k + 1])]
        bad = vocab.joined(mine[:-1], mine[1:])[0].any() if len(mine) > 1 else False
        assert bad == (mine.tolist() != ids_of(PATHS[0], w))
        right, wrong = right + (not bad), wrong + bool(bad)
    assert right > 300 and wrong > 300
    for way in (vocab.merge, vocab.merge_short):
        assert [m.tolist() for m in way(raw)] == [ids_of(PATHS[0], w) for w in words]


def test_a_word_of_a_megabyte():
    rng = random.Random(2)
    text = "".join(rng.choice("aeinrstlo") for _ in range(1 << 20))
    assert encoded(PATHS[0], text) == ids_of(PATHS[0], text)


@pytest.mark.parametrize("path", PATHS)
def test_tables(spark, path):
    data = fx.rows() + [(150, "word " * 2_000_000, "en", "s", 1)]
    docs = fx.clashing(fx.documents(spark, data), "ids", "Decoded", "__text")
    coded = bpe.encode(docs.withColumnRenamed("ids", "other"), path, carry=["doc_id", "other"])
    assert coded.columns == ["doc_id", "other", "ids"]
    back = bpe.decode(coded.drop("other"), path, carry=["doc_id", "ids"])
    got = sorted(((r[0] is not None, r[0] or 0), list(r[1]), r[2]) for r in back.collect())
    want = []
    for doc, text, *_ in data:
        ids = ids_of(path, text or "")
        want.append(((doc is not None, doc or 0), ids, LIBRARY[path].decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)
    assert bpe.encode(fx.empty(spark), path, carry=["doc_id"]).count() == 0


def test_ids_that_decode_to_nothing(spark):
    rows = spark.createDataFrame([(1, [320, None, 10**8, -5, 1125]), (2, None), (3, [])], "k int, ids array<int>")
    got = dict(bpe.decode(rows, PATHS[0], carry=["k"]).collect())
    assert got == {1: LIBRARY[PATHS[0]].decode([320, 1125], skip_special_tokens=False), 2: "", 3: ""}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    want = set()
    for doc, text in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = ids_of(PATHS[0], text or "")
        back = LIBRARY[PATHS[0]].decode(ids, skip_special_tokens=False)
        want.add((doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    found = queries.QUERIES["op12_bpe_round_trip"](spark, sf)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert dict(found.dtypes)["n_tokens"] == "bigint"
    assert {tuple(r) for r in found.collect()} == want
    assert found.where(F.col("n_tokens") < 0).count() == 0
