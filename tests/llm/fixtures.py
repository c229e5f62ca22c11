"""Small tables for the operators of the training-data subpackage."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

SYLLABLES = "on er an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()


def words(rng, n):
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n)]


def prose(rng, n):
    w = words(rng, n)
    for i in range(9, n, 10):
        w[i] += "."
    return " ".join(w)


def rows(seed=1, count=40):
    """Prose with exact copies, near copies, a shared passage, missing and empty values, one long text and repeated rows."""
    rng = random.Random(seed)
    out = [(i, prose(rng, rng.randint(60, 200)), rng.choice(["en", "de"]), f"s{rng.randint(0, 3)}") for i in range(count)]
    base = out[0][1].split()
    for k in range(6):  # near copies
        w = list(base)
        for _ in range(k % 3 + 1):
            w[rng.randrange(len(w))] = f"edit{k}{rng.random()}"
        out.append((100 + k, " ".join(w), "en", "s0"))
    out += [(110 + k, out[1][1], "en", "s0") for k in range(5)]  # exact copies
    passage = prose(rng, 60)
    out += [(120 + k, prose(rng, 40) + " " + passage + " " + prose(rng, 40), "en", "s1") for k in range(5)]
    out += [(130, None, "en", "s1"), (131, "", "de", "s2"), (132, " \n\t ", None, None), (133, "one two", "en", None), (134, "one two", "en", "s1")]
    out += [(135, prose(rng, 6000), "en", "s1"), (None, prose(rng, 80), "en", "s0"), (None, None, None, None)]
    out += [out[2], out[2]]
    out += [(140, "É Ünïcode ça va 文字 🙂 " * 30, "fr", "s1"), (141, "x" * 500, "en", "s1")]
    return [(*r, None if r[1] is None else len(r[1])) for r in out]


def documents(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(docs, *names):
    """The documents with further columns of the names that an operator uses itself."""
    from pyspark.sql import functions as F

    for n in names:
        docs = docs.withColumn(n, F.lit("own"))
    return docs


def collected(df):
    return [tuple(r) for r in df.collect()]
