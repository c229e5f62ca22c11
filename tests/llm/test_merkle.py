"""The dataset manifest against a plain tree."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tenfold.llm import merkle, queries
from tests.llm import fixtures as fx


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    if v is None:
        return "-"
    return f"{len(str(v).encode())}:{v}"


def leaf_of(row, text):
    doc, _, lang, source, n = row
    return h([enc(doc), enc(source), enc(lang), enc(n), enc(text)])


def climbed(nodes):
    """Levels of a tree, lowest first."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def way(levels, k):
    out = []
    for row in levels[:-1]:
        start = k - k % 16
        out.append((row[start:k], row[k + 1 : start + 16]))
        k //= 16
    return out


def lower(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(data):
    by = {}
    for r in data:
        by.setdefault(r[3], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in names:
        rows = sorted(((r, leaf_of(r, r[1])) for r in by[s]), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees.append((rows, climbed([d for _, d in rows])))
    top = climbed([t[-1][0] for _, t in trees])
    out = []
    for k, (rows, levels) in enumerate(trees):
        for i, (r, digest) in enumerate(rows):
            steps = way(levels, i) + way(top, k)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node = leaf_of(r, lower(r[1]) if tampered else r[1])
            for b, a in steps:
                node = h([*b, node, *a])
            root = top[-1][0]
            out.append((r[0], digest, levels[-1][0], root, h([x for b, a in steps for x in b + a]), node, node == root))
    return out


COLUMNS = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def found(docs, levels, proofs=False):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return merkle.manifest(merkle.of_documents(docs, tampered), levels, proofs)


def key(r):
    return tuple((x is not None, x) for x in r)


@pytest.mark.parametrize("levels", [1, 2])
def test_manifest_equals_a_plain_tree(spark, levels):
    many = [(1000 + i, f"Text {i} Ä", "en", "hot", 5) for i in range(700)]
    data = fx.rows() + many + [(5, "É" * 10, None, "", None), (9_007_199_254_740_993, "big", "en", "é", 3)]
    docs = fx.clashing(fx.documents(spark, data), "at", "n", "tree", "leaf", "digest", "Block", "_own")
    got = sorted((tuple(r) for r in found(docs, levels).select(*COLUMNS).collect()), key=key)
    assert got == sorted(plain(data), key=key)
    assert not all(r[-1] for r in got)


def test_one_leaf_many_sources_and_nothing(spark):
    one = [(7, "only", "en", None, 4)]
    assert [tuple(r) for r in found(fx.documents(spark, one), 2).select(*COLUMNS).collect()] == plain(one)
    each = [(i, f"t{i}", "en", f"s{i}", 2) for i in range(40)]
    assert sorted(tuple(r) for r in found(fx.documents(spark, each), 1).select(*COLUMNS).collect()) == sorted(plain(each))
    assert found(fx.empty(spark), 2).count() == 0


def test_proofs_fold_to_the_root(spark):
    data = [(i, f"Text {i}", "en", "a" if i % 3 else "b", 5) for i in range(300)]
    rows = found(fx.documents(spark, data), 2, proofs=True).collect()
    for r in rows:
        assert merkle.fold(r["leaf"], r["before"], r["after"]) == r["root"]
        siblings = "".join(b + a for b, a in zip(r["before"], r["after"]))
        assert hashlib.sha256(siblings.encode()).hexdigest() == r["proof_sha256"]


def test_long_text(spark):
    data = [(i, "Abc é " * 4_000_000 if i == 3 else "short", "en", "s", 1) for i in range(20)]
    got = sorted(tuple(r) for r in found(fx.documents(spark, data), 2).select(*COLUMNS).collect())
    assert got == sorted(plain(data))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.QUERIES["op13_merkle_manifest"](spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()
    assert sorted(tuple(r) for r in got.collect()) == sorted(plain([tuple(r) for r in docs]))
