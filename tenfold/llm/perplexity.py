"""Quality rules: perplexity under an n-gram model counted from the corpus itself.

Spark counts the character n-grams of all documents per language and smooths
them by modified Kneser-Ney.  Every n-gram keeps its whole code points and its own
probability.  The probabilities go to the tasks as sorted arrays of 64-bit keys;
a model of more n-grams than a task should hold stays a table, which the n-grams
of the texts are joined with.  Each language gets an
upper and a lower band from the exact distribution of its perplexities, and a
document outside its band is rejected, as is one that fails the base rules.

Defined cases: a missing text is empty; a text of white space alone has no
perplexity and fails the base rules; a missing language counts as the empty
name; repeated rows are counted and judged each; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField, StructType

from tenfold.llm import common, tokens
from tenfold.session import batches_of

ORDER = 4
#: A code point is kept in two parts, these low bits in ``gram`` and the others in ``high``.
CHAR_BITS = 10
HIGH_BITS = 11
#: N-grams of a model that is broadcast; a larger one is joined.
MAX_SHARED = 8_000_000
#: Width of a histogram cell of log perplexities per word; quantiles are exact to it.
CELL = 1e-3
#: Bands reach this many robust deviations from the language's median, the deviation being at least FLOOR.
REACH = 8.0
FLOOR = 0.05
#: Bytes of texts that a task takes apart at once; each takes about a hundred bytes of arrays.
TASK_BYTES = 256 << 10
#: Most bytes of rows that go to a Python worker at once.
BATCH_BYTES = 4 << 20
#: Counts that a task sums up before it gives them out, and the most in one batch.
HELD = 1 << 19
GIVEN_OUT = 1 << 16
SYMBOLS = b"#*$%&|<>"
_SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def characters(texts: Sequence[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Character codes of texts in one array, and where each text starts (with the end).

    Runs of white space count as one space.  Each text is led by ``order - 1``
    spaces, the context of its first characters.
    """
    pad = " " * (order - 1)
    codes = np.frombuffer((pad + pad.join(texts)).encode("utf-32-le", "surrogatepass"), "<u4")
    lengths = np.fromiter((len(t) + order - 1 for t in texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(lengths)])
    space = (codes == 0x20) | ((codes >= 9) & (codes <= 13))
    keep = ~space
    keep[1:] |= ~space[:-1]
    lead = (starts[:-1, None] + np.arange(order - 1)).ravel()
    keep[lead] = True
    after = starts[:-1] + order - 1  # a text's own leading space follows its padding
    after = after[after < starts[1:]]
    keep[after[space[after]]] = False
    whole = codes.astype(np.uint64)
    whole[space] = 0x20
    kept = np.concatenate([[0], np.cumsum(keep)])
    return whole[keep], kept[starts]


def _packed(codes: np.ndarray, count: int, bits: int, order: int) -> np.ndarray:
    ids = np.zeros(count, np.uint64)
    for i in range(order):
        ids = (ids << np.uint64(bits)) | codes[i : i + count]
    return ids


def whole_grams(texts: Sequence[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One n-gram per character after the padding, low and high bits apart, and the text each belongs to."""
    codes, starts = characters(texts, order)
    count = max(0, len(codes) - order + 1)
    ids = _packed(codes & np.uint64((1 << CHAR_BITS) - 1), count, CHAR_BITS, order)
    upper = codes >> np.uint64(CHAR_BITS)
    high = _packed(upper, count, HIGH_BITS, order) if upper.any() else np.zeros(count, np.uint64)
    lengths = np.diff(starts) - (order - 1)
    owner = np.repeat(np.arange(len(texts)), lengths)
    first = starts[:-1] - (order - 1) * np.arange(len(texts))
    place = np.arange(len(owner)) - np.repeat(first, lengths) + np.repeat(starts[:-1], lengths)
    return ids[place], high[place], owner


def grams(texts: Sequence[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The low bits of each n-gram, and the text it belongs to."""
    ids, _, owner = whole_grams(texts, order)
    return ids, owner


def _distinct(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of some columns, and how often each occurs."""
    varied = [c for c in columns if len(c) and c.min() != c.max()]
    order = np.argsort(varied[0], kind="stable") if len(varied) == 1 else np.lexsort(varied) if varied else np.arange(len(columns[0]))
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    first = np.flatnonzero(new)
    return [c[first] for c in columns], np.diff(np.append(first, len(order)))


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of some parts, low and high bits, and the sums of their counts."""
    ids, high, counts = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((high, ids)) if high.any() else np.argsort(ids, kind="stable")
    ids, high = ids[order], high[order]
    first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (high[1:] != high[:-1])])) if len(ids) else np.zeros(0, np.int64)
    return ids[first], high[first], np.add.reduceat(counts[order], first) if len(first) else counts


def _count(batches, order: int):
    tokens.forget()
    held: dict[str, list] = {}
    pending = 0
    for batch in common.blocks(batches, "text", TASK_BYTES):
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        texts = batch.column("text").to_pylist()
        for lang in set(langs):
            ids, high, _ = whole_grams([texts[i] for i in np.flatnonzero(langs == lang)], order)
            (ids, high), counts = _distinct(ids, high)
            held.setdefault(lang, []).append((ids, high, counts))
            pending += len(ids)
        if pending > HELD:
            yield from _given_out(held)
            held, pending = {}, 0
    yield from _given_out(held)


def _given_out(held: dict[str, list]):
    for lang, parts in held.items():
        ids, high, counts = _merged(parts)
        rows = [pa.repeat(pa.scalar(lang, pa.string()), len(ids)), *[pa.array(x, pa.int64()) for x in (common.signed(ids), common.signed(high), counts)]]
        yield from pa.Table.from_arrays(rows, ["lang", "gram", "high", "n"]).to_batches(max_chunksize=GIVEN_OUT)


def gram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Occurrences of every n-gram of all texts: lang, gram, high, n."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), common.text_column().alias("text"))
    counted = common.map_arrow(rows, partial(_count, order=order), "lang string, gram long, high long, n long")
    return counted.groupBy("lang", "gram", "high").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """Interpolated modified Kneser-Ney: lang, gram, high, n and ``logp`` of its last character after the others.

    Below the highest order an n-gram counts the different characters seen
    before it.  Discounts come from the counts of counts of each order and language.
    """
    levels = {order: counts}

    def last(k: int, names: Sequence[str]) -> list:
        """The last k characters."""
        parts = zip(("gram", "high"), (CHAR_BITS, HIGH_BITS), names, strict=True)
        return [F.col(c).bitwiseAND(F.lit((1 << (bits * k)) - 1)).alias(name) for c, bits, name in parts]

    for k in range(order - 1, 0, -1):
        levels[k] = common.written(levels[k + 1].groupBy("lang", *last(k, ("gram", "high"))).agg(F.count(F.lit(1)).alias("n")), f"grams-{k}")
    below = None
    for k in range(1, order + 1):
        level = levels[k]
        some = [F.count(F.when(F.col("n") == i, 1)).cast("double") for i in range(1, 5)]
        found = level.groupBy("lang").agg(*[c.alias(f"n{i}") for i, c in enumerate(some, 1)], F.count(F.lit(1)).alias("kinds"))
        base = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(F.lit(0.5))
        for i in (1, 2, 3):  # a discount lies between 0 and its count
            rate = F.when(F.col(f"n{i}") > 0, i - (i + 1) * base * F.col(f"n{i + 1}") / F.col(f"n{i}")).otherwise(base)
            found = found.withColumn(f"d{i}", F.least(F.greatest(rate, F.lit(0.05)), F.lit(i - 0.05)))
        found = F.broadcast(found.select("lang", "d1", "d2", "d3", "kinds"))  # one row per language
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        level = level.join(found, "lang").withColumn("cut", cut)
        level = level.withColumn("context", F.shiftrightunsigned("gram", CHAR_BITS) if k > 1 else F.lit(0).cast("long"))
        level = level.withColumn("context_high", F.shiftrightunsigned("high", HIGH_BITS) if k > 1 else F.lit(0).cast("long"))
        context = level.groupBy("lang", "context", "context_high").agg(F.sum("n").alias("total"), F.sum("cut").alias("freed"))
        level = level.join(context, ["lang", "context", "context_high"])
        if below is None:
            lower = F.lit(1.0) / F.col("kinds")
        else:
            level = level.select("*", *last(k - 1, ("tail", "tail_high")))
            level = level.join(below, ["lang", "tail", "tail_high"])
            lower = F.col("p_below")
        p = (F.col("n") - F.col("cut") + F.col("freed") * lower) / F.col("total")
        level = common.written(level.select("lang", "gram", "high", "n", p.alias("p")), f"smoothed-{k}")
        below = level.select("lang", F.col("gram").alias("tail"), F.col("high").alias("tail_high"), F.col("p").alias("p_below"))
    return level.select("lang", "gram", "high", "n", F.log("p").alias("logp"))


def language_codes(langs: Sequence[str]) -> np.ndarray:
    """A 64-bit value per language name."""
    import hashlib

    return np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs], np.uint64)


def keys_of(lang_codes: np.ndarray, ids: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A 64-bit value per language and n-gram."""
    return common.mix64(ids ^ common.mix64(high ^ lang_codes))


def _to_keys(batches):
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        known = dict(zip(set(langs), language_codes(list(set(langs))), strict=True))
        codes = np.array([known[x] for x in langs], np.uint64)
        ids, high = (batch.column(c).to_numpy().view(np.uint64) for c in ("gram", "high"))
        yield pa.RecordBatch.from_arrays([pa.array(common.signed(keys_of(codes, ids, high))), batch.column("logp")], ["key", "logp"])


def sorted_arrays(model: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all n-grams in ascending order and their log probabilities."""
    table = common.map_arrow(model, _to_keys, "key long, logp double").toArrow()  # at most MAX_SHARED rows
    key, logp = table.column("key").to_numpy().view(np.uint64), table.column("logp").to_numpy()
    order = np.argsort(key)
    return key[order], logp[order]


_INDEX: dict[str, object] = {}


def lookup(shared: tuple[np.ndarray, np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """Log probabilities of keys, each found among the few of its leading bits and compared whole."""
    keys, logp = shared
    bits = max(8, len(keys).bit_length() + 1)
    shift = np.uint64(64 - bits)
    if _INDEX.get("of") is not shared:
        first = np.empty(1 << bits, np.int32)
        for at in range(0, 1 << bits, 1 << 16):
            leads = np.arange(at, min(at + (1 << 16), 1 << bits), dtype=np.uint64) << shift
            first[at : at + len(leads)] = np.minimum(np.searchsorted(keys, leads), len(keys) - 1)
        _INDEX.update(of=shared, first=first)
    place = _INDEX["first"][wanted >> shift]
    late = np.flatnonzero(keys[place] < wanted)
    while len(late):
        place[late] += 1
        late = late[place[late] < len(keys) - 1]
        late = late[keys[place[late]] < wanted[late]]
    if not np.array_equal(keys[place], wanted):
        raise KeyError("an n-gram of the texts is not in the model")
    return logp[place]


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """Words, their characters, symbols, repeated lines, words in repeated windows of three."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(text) - sum(text.count(chr(c)) for c in _SPACES)
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen = Counter(windows)
        upto = 0
        for i, w in enumerate(windows):
            if seen[w] > 1:
                repeated += i + 3 - max(i, upto)
                upto = i + 3
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def _score(batches, shared: Broadcast | None, order: int, with_text: bool = False):
    """Counts and entropy of each text; without a shared model its n-grams instead of the entropy."""
    tokens.forget()
    try:
        yield from _scored(batches, shared, order, with_text)
    finally:
        _INDEX.clear()  # workers outlive the task


def _scored(batches, shared: Broadcast | None, order: int, with_text: bool):
    carried = None if with_text else -1  # the text comes last
    for batch in common.blocks(batches, "_text", TASK_BYTES):
        texts, langs = batch.column("_text").to_pylist(), batch.column("_lang").to_pylist()
        ids, high, owner = whole_grams(texts, order)
        found = np.array([base_counts(t) for t in texts], np.int64).reshape(-1, 5)
        if shared is None:
            (ids, high, owner), counts = _distinct(ids, high, owner.astype(np.uint64))
            cuts = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
            parts = [pa.array(common.signed(ids)), pa.array(common.signed(high)), pa.array(counts, pa.int64())]
            last = pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays(parts, ["gram", "high", "n"]))
        else:
            logs = lookup(shared.value, keys_of(language_codes(langs)[owner], ids, high)) if len(ids) else np.zeros(0)
            summed = np.bincount(owner, weights=logs, minlength=len(texts))
            missing = found[:, 0] == 0
            # per word: decoration of words costs, too
            last = pa.array(np.where(missing, 0.0, -summed / np.maximum(found[:, 0], 1)), mask=missing)
        failed = [base_failed(n, r) for n, r in found[:, [0, 4]].tolist()]
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns[:carried],
                *[pa.array(found[:, i]) for i in range(5)],
                pa.array(failed), last,
            ],
            [*batch.schema.names[:carried], *COUNTS, "base_failed", "entropy" if shared else "_grams"],
        )


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def bands(scored: DataFrame, reach: float = REACH, floor: float = FLOOR) -> DataFrame:
    """Per language the lowest and highest entropy that is kept: median and quartiles of documents that pass the base rules.

    The upper band uses the spread above the median, the lower one that below.
    """
    cells = scored.where("not base_failed and entropy is not null")
    cells = cells.groupBy("_lang", F.floor(F.col("entropy") / CELL).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("_lang").orderBy("cell"))
    total = F.sum("n").over(Window.partitionBy("_lang"))
    cells = cells.select("_lang", "cell", upto.alias("upto"), total.alias("total"))
    at = [F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("cell"))) * CELL for q in (0.25, 0.5, 0.75)]
    found = cells.groupBy("_lang").agg(at[0].alias("q1"), at[1].alias("q2"), at[2].alias("q3"))
    spread = lambda a, b: F.greatest((F.col(b) - F.col(a)) * 1.4826, F.lit(floor)) * reach
    return found.select("_lang", (F.col("q2") - spread("q1", "q2")).alias("_low"), (F.col("q2") + spread("q2", "q3")).alias("_high"))


def judge(
    docs: DataFrame, carry: Sequence[str], order: int = ORDER, reach: float = REACH, floor: float = FLOOR, max_shared: int = MAX_SHARED, with_text: bool = False
) -> DataFrame:
    """The carried columns of every document with its counts, ``base_failed``, ``perplexity``, ``kept``.

    Two passes over the texts: counting and scoring.  The scored rows are written
    once; bands come from a histogram of one row per language and cell.  The
    columns named here replace carried columns of those names.  ``with_text`` adds
    the text as it was judged as ``_text``, so that it need not be carried besides.
    """
    spark = docs.sparkSession
    with batches_of(spark, BATCH_BYTES):
        counts = common.written(gram_counts(docs, order), "grams")
    model = kneser_ney(counts, order)
    shared = spark.sparkContext.broadcast(sorted_arrays(model)) if model.count() <= max_shared else None
    made = [*COUNTS, "base_failed", "entropy", "perplexity", "kept"]
    carry = [c for c in carry if c not in made]
    rows = docs.select(*carry, F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("_lang"), common.text_column().alias("_text"))
    counted = ArrayType(StructType([StructField(c, LongType()) for c in ("gram", "high", "n")]))
    last = StructField("entropy", DoubleType()) if shared else StructField("_grams", counted)
    schema = StructType([*rows.schema.fields[: None if with_text else -1], *[StructField(c, LongType()) for c in COUNTS], StructField("base_failed", BooleanType()), last])
    scored = common.map_arrow(rows, partial(_score, shared=shared, order=order, with_text=with_text), schema)
    with batches_of(spark, BATCH_BYTES):
        scored = common.written(scored if shared else scored.withColumn("_doc", F.monotonically_increasing_id()), "scored")
    if shared:
        shared.destroy()  # the scored rows are a table now
    if not shared:
        every = scored.select("_doc", F.col("_lang").alias("lang"), F.inline("_grams").alias("gram", "high", "times"))
        summed = every.join(model.drop("n"), ["lang", "gram", "high"]).groupBy("_doc").agg(F.sum(F.col("times") * F.col("logp")).alias("_sum"))
        scored = scored.drop("_grams").join(summed, "_doc", "left")
        entropy = F.when(F.col("n_words") > 0, -F.col("_sum") / F.col("n_words"))
        scored = common.written(scored.withColumn("entropy", entropy).drop("_doc", "_sum"), "scored-joined")
    limits = bands(scored, reach, floor)
    inside = F.coalesce(F.col("entropy").between(F.col("_low"), F.col("_high")), F.lit(False))
    return scored.join(F.broadcast(limits), "_lang", "left").select(
        *carry, *["_text"] * with_text, *COUNTS, "base_failed", F.exp("entropy").alias("perplexity"), (~F.col("base_failed") & inside).alias("kept")
    )
