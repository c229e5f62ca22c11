"""Mixing, pseudonyms, perplexity bands, toxicity and the pipeline."""

import collections
import datetime
import math
import random
import re
import tracemalloc
import types
from functools import partial

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tenfold.llm import mixing, perplexity, pii, toxicity
from tenfold.session import batches_of
from tests.llm import fixtures as fx

LEVELS = {"lang": F.col, "source": F.col}


def mixed(docs, share, epochs=3, weights=None):
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    return mixing.mix(docs, levels, weights or {}, share, epochs, 3)


def by_leaf(rows):
    out = collections.Counter()
    for r in rows:
        out[(r["lang"], r["source"])] += r["take_tokens"]
    return out


def test_mixture_of_equal_weights(spark):
    data = fx.rows()
    tokens = collections.Counter()
    for _, text, lang, source, _ in data:
        tokens[(lang or "", source or "")] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    rows = mixed(fx.clashing(fx.documents(spark, data), "epoch", "tokens", "take_tokens", "keep_me"), 0.5).collect()
    assert {r["keep_me"] for r in rows} == {"own"}
    got, total = by_leaf(rows), sum(tokens.values())
    assert all(got[k] <= 3 * tokens[k] for k in got)
    assert total * 0.5 - len(tokens) - 1 <= sum(got.values()) <= total * 0.5
    # A leaf below its capacity gets no less than its full siblings.
    for lang in {k[0] for k in tokens}:
        own = {k: got[k] for k in tokens if k[0] == lang and tokens[k]}
        open_leaves = [v for k, v in own.items() if v < 3 * tokens[k] - 1]
        assert not open_leaves or max(own.values()) <= max(open_leaves) + 1
    copies = collections.Counter((r["lang"], r["source"], r["epoch"]) for r in rows)
    assert max(k[2] for k in copies) <= 2
    for (lang, source), want in got.items():  # whole epochs first
        last = max(r["epoch"] for r in rows if (r["lang"], r["source"]) == (lang, source))
        full = sum(r["take_tokens"] for r in rows if (r["lang"], r["source"]) == (lang, source) and r["epoch"] < last)
        assert full == last * tokens[(lang, source)] and want > full


def test_shortage_goes_to_siblings_first(spark):
    text = lambda n: "w " * n
    data = [(1, text(10), "a", "x", 0), (2, text(1000), "a", "y", 0), (3, text(1000), "b", "z", 0)]
    got = by_leaf(mixed(fx.documents(spark, data), 0.2, epochs=1).collect())
    assert got == {("a", "x"): 10, ("a", "y"): 191, ("b", "z"): 201}
    none = by_leaf(mixed(fx.documents(spark, data), 0.2, 1, {"lang": F.when(F.col("lang") == "a", 0).otherwise(1)}).collect())
    assert none == {("b", "z"): 402}
    assert mixed(fx.empty(spark), 0.5).count() == 0


def test_word_prefix(spark):
    df = spark.createDataFrame([(" a  b\nc d", 2), ("x", 1), ("", 3)], "t string, n long")
    assert [r[0] for r in df.select(mixing.word_prefix(F.col("t"), F.col("n"))).collect()] == [" a  b", "x", ""]


# ------------------------------------------------------------ pseudonyms

KEY = b"k"
VALID = {
    "card": ["4111 1111 1111 1111", "5500005555555559", "378282246310005"],
    "date": ["1984-02-29", "31.12.1999", "04/07/2011"],
    "ipv4": ["192.168.0.1", "8.8.8.8"],
    "phone": ["+1 (017) 555-7713", "(212) 555-0187"],
    "insured": ["123-45-6789"],
    "account": ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"],
    "mail": ["Anna.99@mail7.example.com"],
}
INVALID = ["4111 1111 1111 1112", "1983-02-29", "32.01.2001", "300.1.1.1", "000-12-3456", "DE88 3704 0044 0532 0130 00", "version 12345", "a@b"]


@pytest.mark.parametrize(("kind", "value"), [(k, v) for k, vs in VALID.items() for v in vs])
def test_valid_values_change_within_their_format(kind, value):
    made, n = pii.replace(f"see {value}, and", KEY)
    assert n == 1 and made != f"see {value}, and" and value not in made
    fresh = made[4:-5]
    assert kind == "ipv4" or re.sub(r"\d", "9", re.sub(r"[a-z]", "a", re.sub("[A-Z]", "A", fresh))) == re.sub(r"\d", "9", re.sub(r"[a-z]", "a", re.sub("[A-Z]", "A", value)))
    assert pii.replace(made, KEY)[1] == 1  # still valid
    assert pii.replace(made, KEY, back=True)[0] == f"see {value}, and"
    assert pii.replace(f"see {value}, and", b"another")[0] != made


@pytest.mark.parametrize("value", INVALID)
def test_invalid_values_stay(value):
    assert pii.replace(f"see {value} here", KEY) == (f"see {value} here", 0)


def test_spellings_stay_linked():
    plain, spaced, dashed = (pii.replace(v, KEY)[0] for v in ("4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111"))
    assert plain == spaced.replace(" ", "") == dashed.replace("-", "")
    both = pii.replace("4111111111111111 5500005555555559", KEY)
    assert both[1] == 2 and both[0].split()[0] == plain
    assert pii.replace("ANNA.1@x.org", KEY)[0].lower() == pii.replace("anna.1@x.org", KEY)[0]


def test_dates_keep_their_reading():
    """Every date of some years in every spelling: one pseudonym per date, the same in all of them, and a way back."""
    first = datetime.date(2018, 1, 1)
    seen = {}
    for n in range(0, 1200):
        day = first + datetime.timedelta(n)
        for form in ("%Y-%m-%d", "%d.%m.%Y", *(["%m/%d/%Y"] if day.day > 12 else [])):
            made, count = pii.replace(day.strftime(form), KEY)
            assert count == 1 and pii.replace(made, KEY, back=True)[0] == day.strftime(form)
            moved = datetime.datetime.strptime(made, form).date()
            assert seen.setdefault(day, moved) == moved != day
    assert len(set(seen.values())) == len(seen)


def test_phones_in_any_spelling():
    for spellings in (["+1 (017) 555-7713", "+10175557713", "+1 017 555 7713"], ["+49301234567", "+49 30 123 4567"], ["+351 21 123 4567", "+351211234567"]):
        made = {re.sub(r"[^+0-9]", "", pii.replace(v, KEY)[0]) for v in spellings}
        assert len(made) == 1 and made != {re.sub(r"[^+0-9]", "", spellings[0])}
        assert all(pii.replace(pii.replace(v, KEY)[0], KEY, back=True)[0] == v for v in spellings)
    assert pii.replace("+49301234567", KEY)[0].startswith("+49")


@pytest.mark.parametrize("tail", ["", " EUR", " 2024", " A1 B2", " TOTALS", ", 17", "\nX9"])
def test_account_numbers_end_where_their_country_says(tail):
    for number in ("BE68 5390 0754 7034", "ES9121000418450200051332", "DE89 3704 0044 0532 0130 00", "NO9386011117947"):
        made, count = pii.replace(number + tail, KEY)
        assert count == 1 and made.endswith(tail) and number not in made and made[:2] == number[:2]
        assert pii.replace(number.replace(" ", ""), KEY)[0] == made.removesuffix(tail).replace(" ", "")
        assert pii.replace(made, KEY, back=True)[0] == number + tail


def test_values_behind_a_failed_reading():
    text = "AB12 4111 1111 1111 1111 and 4111111111111111@x.org, 4111111111111111"
    made, count = pii.replace(text, KEY)
    assert count == 3 and "4111111111111111" not in made and "4111 1111 1111 1111" not in made
    assert pii.replace(made, KEY, back=True)[0] == text


@pytest.mark.parametrize("n", [2, 3, 10, 26, 1000, 73049])
def test_feistel_permutes_without_fixed_points(n):
    f = pii.Feistel(KEY, "t", n)
    image = [f.permute(x) for x in range(min(n, 2000))]
    assert len(set(image)) == len(image) and all(0 <= y < n and y != x for x, y in enumerate(image))
    assert [f.restore(y) for y in image] == list(range(len(image)))


def test_pseudonymised_table(spark):
    data = [*fx.rows(), (200, "call +1 (017) 555-7713 or 192.168.0.1", "en", "s", 1)]
    docs = fx.clashing(fx.documents(spark, data), "n_replaced")
    got = pii.pseudonymise(docs, KEY).collect()
    want = sorted(((r[0], r[1] if not r[1] else pii.replace(r[1], KEY)[0]) for r in data), key=repr)
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == want
    assert [r["n_replaced"] for r in got if r["doc_id"] == 200] == [2]
    assert pii.pseudonymise(fx.empty(spark), KEY).count() == 0


# ------------------------------------------------------------ perplexity


def brute_kneser_ney(texts, order):
    """log p of each n-gram of the highest order, by dictionaries."""
    pad = "\x00" * (order - 1)
    grams = collections.Counter()
    for t in texts:
        s = pad.replace("\x00", " ") + re.sub(r"[ \t-\r]+", " ", t).removeprefix(" ")
        grams.update(s[i : i + order] for i in range(len(s) - order + 1))
    levels = {order: grams}
    for k in range(order - 1, 0, -1):
        levels[k] = collections.Counter(g[1:] for g in levels[k + 1])
    p = {}
    for k in range(1, order + 1):
        c = levels[k]
        n = [sum(v == i for v in c.values()) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        d = [min(max((i - (i + 1) * y * n[i] / n[i - 1]) if n[i - 1] else y, 0.05), i - 0.05) for i in (1, 2, 3)]
        total, freed = collections.Counter(), collections.Counter()
        for g, v in c.items():
            total[g[:-1]] += v
            freed[g[:-1]] += d[min(v, 3) - 1]
        low = p
        p = {g: (v - d[min(v, 3) - 1] + freed[g[:-1]] * (low[g[1:]] if k > 1 else 1 / len(c))) / total[g[:-1]] for g, v in c.items()}
    return {g: math.log(v) for g, v in p.items()}


def test_kneser_ney_equals_dictionaries(spark):
    data = [r for r in fx.rows() if r[2] == "en" and r[1] and r[1].isascii()]
    model = perplexity.kneser_ney(perplexity.gram_counts(fx.documents(spark, data)))
    want = brute_kneser_ney([r[1] for r in data], perplexity.ORDER)
    key = lambda g: sum(ord(c) << (perplexity.CHAR_BITS * i) for i, c in enumerate(reversed(g)))
    got = {r["gram"]: r["logp"] for r in model.collect()}
    assert got.keys() == {key(g) for g in want}
    assert all(abs(got[key(g)] - v) < 1e-9 for g, v in want.items())


def test_grams_follow_the_text():
    ids, owner = perplexity.grams([" ab  c", "", "\n", "x"], 3)
    letters = lambda x: "".join(chr(int(x) >> (10 * i) & 1023) for i in (2, 1, 0))
    assert [letters(x) for x in ids] == ["  a", " ab", "ab ", "b c", "  x"]
    assert owner.tolist() == [0, 0, 0, 0, 3]


def brute_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


@pytest.mark.parametrize("text", ["", "a b c a b c d", "x\nx\n\n \nx", "a a a a", "é ü # <|>\x1c $", "a b c x a b c x a b c", *[r[1] or "" for r in fx.rows()][:12]])
def test_base_counts(text):
    assert perplexity.base_counts(text) == brute_counts(text)


def test_quality_verdicts(spark):
    rng = random.Random(4)
    data = [(i, fx.prose(rng, 120), "en", "s", 0) for i in range(200)]
    data += [(900 + i, " ".join(w + "&&&$$$%%%" for w in fx.prose(rng, 120).split()), "en", "s", 0) for i in range(3)]
    data += [(910, "short text", "en", "s", 0), (911, "a b c " * 60, "en", "s", 0), (912, None, None, None, None), data[0], (None, fx.prose(rng, 120), "en", "s", 0)]
    docs = fx.clashing(fx.documents(spark, data), "kept", "n_words", "entropy")
    got = perplexity.judge(docs, ["doc_id", "kept"]).collect()
    assert len(got) == len(data)
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert all(kept[i] for i in [*range(200), None]) and not any(kept[i] for i in (900, 901, 902, 910, 911, 912))
    assert {r["doc_id"] for r in got if r["base_failed"]} == {910, 911, 912}
    assert perplexity.judge(fx.empty(spark), ["doc_id"]).count() == 0


def test_grams_keep_whole_code_points(spark):
    """No two code points and no two n-grams share a probability, whatever the script."""
    alphabet = [*map(chr, range(0x430, 0x450)), *map(chr, range(0x4E00, 0x4F00)), *map(chr, range(0xAC00, 0xAD00)), *map(chr, range(0x1F600, 0x1F640))]
    rng = random.Random(12)
    texts = ["".join(rng.choice(alphabet) for _ in range(300)) for _ in range(30)]
    data = [(i, t, "xx", "s", 0) for i, t in enumerate(texts)]
    model = perplexity.kneser_ney(perplexity.gram_counts(fx.documents(spark, data)))
    want = brute_kneser_ney(texts, perplexity.ORDER)
    key = lambda g: tuple(sum(f(ord(c)) << (b * i) for i, c in enumerate(reversed(g))) for f, b in ((lambda x: x & 1023, 10), (lambda x: x >> 10, 11)))
    got = {(r["gram"], r["high"]): r["logp"] for r in model.collect()}
    assert got.keys() == {key(g) for g in want} and all(abs(got[key(g)] - v) < 1e-9 for g, v in want.items())
    keys, logp = perplexity.sorted_arrays(model)
    assert len(np.unique(keys)) == len(want)


def test_joined_model_judges_as_the_shared_one(spark):
    docs = fx.documents(spark)
    shared, joined = (sorted(fx.collected(perplexity.judge(docs, ["doc_id"], max_shared=m)), key=repr) for m in (perplexity.MAX_SHARED, 0))
    assert len(shared) == len(joined) == docs.count()
    for a, b in zip(shared, joined, strict=True):
        assert a[:7] == b[:7] and a[8] == b[8] and (a[7] == b[7] or abs(a[7] / b[7] - 1) < 1e-4)


def _batches(columns, size=10_000):
    texts = [fx.prose(random.Random(i), 400) for i in range(2500)]  # about 5 MB
    langs = ["en" if i % 3 else "de" for i in range(len(texts))]
    return pa.Table.from_arrays([pa.array(langs), pa.array(texts)], columns).to_batches(max_chunksize=size)


def test_tasks_hold_little_at_once():
    """Two tasks of an executor take apart many texts within tens of MB each."""
    counted = pa.Table.from_batches(perplexity._count(_batches(["lang", "text"]), perplexity.ORDER))
    codes = dict(zip(["de", "en"], perplexity.language_codes(["de", "en"]), strict=True))
    ids, high = (counted.column(c).to_numpy().view(np.uint64) for c in ("gram", "high"))
    keys = np.unique(perplexity.keys_of(np.array([codes[x] for x in counted.column("lang").to_pylist()]), ids, high))
    model = types.SimpleNamespace(value=(keys, np.zeros(len(keys))))
    for run, columns in ((partial(perplexity._count, order=4), ["lang", "text"]), (partial(perplexity._score, shared=model, order=4), ["_lang", "_text"])):
        batches = _batches(columns)
        tracemalloc.start()
        rows = sum(b.num_rows for b in run(batches))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows and most < 80e6


def test_counts_are_those_of_any_cut(monkeypatch):
    def counts():
        found = pa.Table.from_batches(perplexity._count(_batches(["lang", "text"], 300)[:2], 4))
        return found.group_by(["lang", "gram", "high"]).aggregate([("n", "sum")]).sort_by([("lang", "ascending"), ("gram", "ascending"), ("high", "ascending")])

    want = counts()
    for name, value in (("TASK_BYTES", 5000), ("HELD", 3000), ("GIVEN_OUT", 700)):
        monkeypatch.setattr(perplexity, name, value)
    assert counts().equals(want)


def test_workers_get_small_batches(spark):
    """The bound on batches holds inside, and the session's setting comes back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    docs = spark.range(2000).coalesce(1).select(F.repeat(F.lit("x"), 1000).alias("text"))
    sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long")
    with batches_of(spark, 100_000):
        assert max(r.n for r in sizes.collect()) < 200_000
    assert spark.conf.get(name) == before


# ------------------------------------------------------------ toxicity


def test_terms_are_words():
    owner, term = toxicity.terms(pa.array(["You, YOU é É", "", "you!", "é"]))
    sets = [set(term[owner == i].tolist()) for i in range(4)]
    assert len(sets[0]) == 2 and sets[0] == sets[2] | sets[3] and not sets[1]


def test_machine_learns_pairs():
    """Neither of two terms is toxic, both together are."""
    rng = np.random.default_rng(1)
    owner, place, labels = [], [], []
    for i in range(4000):
        have = {t for t in (0, 1) if rng.random() < 0.5} | set(rng.integers(2, 12, 3).tolist())
        labels.append(float({0, 1} <= have))
        owner += [i] * len(have)
        place += sorted(have)
    owner, place, labels = np.array(owner), np.array(place), np.array(labels)
    machine = toxicity.fit(labels, owner, place, np.arange(12), epochs=40)
    scores = toxicity.sigmoid(machine.logits(owner, place, len(labels)))
    assert np.mean((scores > 0.5) == labels) > 0.99


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(6)
    bad = ["vilewordone", "vilewordtwo", "vilewordthree"]
    data, labels = [], []
    for i in range(1500):
        toxic = rng.random() < 0.2
        w = fx.words(rng, rng.randint(5, 60))
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(bad) + "!"
        data.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    data += [(5000, None, "en", "s", 0), (5001, "", "en", "s", 0), (None, "vilewordone", "en", "s", 0)]
    docs = fx.clashing(fx.documents(spark, data), "score", "toxic", "terms")
    table = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None), labels[0]], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.train(docs, table)).collect()}
    assert len(got) == len(data) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    import zlib

    held = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i]["predicted"] == labels[i][2] for i in held]) > 0.97
    assert got[5000]["score"] == got[5001]["score"] and got[None]["predicted"] == 1
    bare = toxicity.train(docs, table.limit(0))
    assert {r["score"] for r in toxicity.score(docs, bare).collect()} == {0.5}


def learned(spark, make, n):
    """Precision and recall on held-out rows; ``make(i)`` gives a text and whether it is toxic.

    Recall is over toxic rows of which every word occurs in a row that is learned from.
    """
    made = [make(i) for i in range(n)]
    docs = fx.documents(spark, [(i, text, "en", "s", 0) for i, (text, _) in enumerate(made)])
    table = spark.createDataFrame([(i, int(bad)) for i, (_, bad) in enumerate(made)], "doc_id long, toxic int")
    machine = toxicity.train(docs, table)
    rows = toxicity.score(docs.withColumn("held", toxicity.held_out(F.col("doc_id"))), machine).where("held").collect()
    flagged = {r["doc_id"] for r in rows if r["predicted"]}
    known = {w for i in set(range(n)) - {r["doc_id"] for r in rows} for w in made[i][0].split()}
    bad = {r["doc_id"] for r in rows if made[r["doc_id"]][1]}
    precision = len(flagged & bad) / max(len(flagged), 1)
    bad = {i for i in bad if known.issuperset(made[i][0].split())}
    return precision, len(flagged & bad) / len(bad)


def test_machine_learns_terms_that_tell_only_together(spark):
    """Toxic with just one of two words, harmless with both or neither: each word alone tells nothing."""
    rng = random.Random(21)

    def make(_):
        one, two = rng.random() < 0.5, rng.random() < 0.5
        return " ".join([f"w{rng.choice('abcdefghij') * rng.randint(1, 30)}" for _ in range(25)] + ["alpha"] * one + ["beta"] * two), one != two

    precision, recall = learned(spark, make, 4000)
    assert precision > 0.9 and recall > 0.9


def test_machine_learns_rare_words(spark):
    """250 insults, each in one or two of the labelled rows; those seen there are known again."""
    rng = random.Random(22)
    word = lambda k, i: k + "".join(chr(97 + int(c)) for c in str(i))

    def make(_):
        bad = rng.random() < 0.11
        return " ".join([word("w", rng.randrange(1000)) for _ in range(40)] + [word("insult", rng.randrange(250))] * bad), bad

    precision, recall = learned(spark, make, 5000)
    assert precision > 0.95 and recall > 0.95


# ------------------------------------------------------------ pipeline


def test_quality_rules_pass_whole_rows(spark):
    """The text goes beside the row through the workers; every kept row comes back as it was."""
    rng = random.Random(9)
    data = [(i, fx.prose(rng, 80) + " é\n文字\t ", None if i % 7 == 0 else "en", None if i % 5 == 0 else "s", i) for i in range(60)]
    docs = fx.clashing(fx.documents(spark, [*data, data[3], (99, None, "en", "s", None)]), "_text", "_row", "_lang")
    docs = docs.select("source", "text", *[c for c in docs.columns if c not in ("source", "text")])
    kept = corpus_pipeline.quality_rules(spark, docs, None)
    assert kept.schema.simpleString() == docs.schema.simpleString()
    assert sorted(fx.collected(kept), key=repr) == sorted((r for r in fx.collected(docs) if r[1] is not None), key=repr)


def test_pipeline_stages(spark):
    rng = random.Random(8)
    data = [(i, fx.prose(rng, 150), "en", f"s{i % 3}", 0) for i in range(120)]
    data += [(200 + k, data[0][1] + " tail", "en", "s0", 0) for k in range(3)] + [(300, data[1][1] + " 192.168.0.1", "en", "s1", 0)]
    data += [(301, None, None, None, None), (302, "short", "en", "s1", 5), data[2]]
    docs = fx.clashing(fx.documents(spark, data), "kept", "n_replaced", "epoch", "_text", "class")
    names, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, None)
        if name != "packing":
            assert docs.columns == names
            docs = docs.cache()
        seen.append(docs.collect())
    quality, single, private, mixture, packed = seen
    ids = lambda rows: {r["doc_id"] for r in rows}
    assert ids(quality) == ids([{"doc_id": r[0]} for r in data]) - {301, 302}
    assert ids(single) == set(range(120)) and len(single) == 120
    assert all("192.168.0.1" not in r["text"] for r in private)
    texts = {r["doc_id"]: r["text"] for r in private}
    assert all(texts[r["doc_id"]].startswith(r["text"]) for r in mixture)
    assert {r["doc_id"] for r in packed} == ids(mixture)
