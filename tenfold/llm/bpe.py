"""BPE encoding and decoding by speculation and verification.

A sequence of tokens is the encoding of a word exactly if each token encodes to
itself and no merge ever happens across the border of two neighbours.  So tokens
are proposed by longest match, every adjacent pair is tested, and only words with
a pair that fails are merged symbol by symbol, in the order of the merges.

* Propose: fingerprints of all stretches up to the longest token are looked up in
  sorted arrays, for all new words of a block at once.
* Verify: two neighbours evolve on their own until a merge joins the last symbol
  of the left one with the first of the right one.  The states of both borders
  are walked in the order of the ranks that change them; the pair fails if the
  two symbols merge before either is used up inside its own token (at equal ranks
  the leftmost merge comes first).
* Merge: all failing words together, each word's lowest rank first, leftmost
  first; long words rank by rank, with neighbours held in linked arrays.

Normalisation, splitting into words and added tokens follow the tokenizer's file.
The words of a block are encoded once and remembered by the worker.

Defined cases: a missing or empty text has no ids; missing ids, and ids that the
vocabulary does not have, decode to nothing; texts of any length are encoded
whole (a block holds one long text, a word of any length is matched in strips);
equal texts have equal ids; repeated rows stay; an empty table gives no rows; only
columns named in ``carry`` are returned, under their names, so others never clash.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenfold.llm import common, tokens

#: Words, and stretches between white space, that a worker remembers; a full memory starts anew.
REMEMBER = 250_000
#: Bytes of a word up to which words are merged round by round, all together.
SHORT = 128
#: Ends a word where the vocabulary marks word ends; no UTF-8 text holds this byte.
END = 0xFF
#: Positions of new words that are matched at once.
STRIP = 1 << 18
#: Ids that are decoded at once.
DECODED = 1 << 20

_NEVER, _LATER = np.iinfo(np.int64).max, np.iinfo(np.int32).max


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a tokenizer file, kept for the life of the worker."""
    return Vocabulary(path)


@lru_cache(maxsize=4)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def _spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    if model["type"] != "BPE" or odd or spec.get("post_processor"):
        raise ValueError(f"only plain byte-level BPE is known here: {model['type']}, {odd}")
    return spec


class Decoder:
    """What each id decodes to, and what stands between ids."""

    def __init__(self, path: str):
        spec = _spec(path)
        kind = (spec.get("decoder") or {}).get("type")
        if kind not in (None, "ByteLevel"):
            raise ValueError(f"unknown decoder {kind}")
        self.between = b" " if kind is None else b""
        self.texts = {i: t.encode() for t, i in spec["model"]["vocab"].items()}
        if kind == "ByteLevel":
            to_byte = {chr(c): b for b, c in tokens._byte_letters().items()}
            for t, i in spec["model"]["vocab"].items():
                if all(c in to_byte for c in t):
                    self.texts[i] = bytes(to_byte[c] for c in t)
        self.texts |= {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}

    def decode(self, ids: np.ndarray) -> str:
        get, parts = self.texts.get, []
        for lo in range(0, len(ids), DECODED):
            known = [t for t in map(get, ids[lo : lo + DECODED].tolist()) if t is not None]
            if known:
                parts.append(self.between.join(known))
        return self.between.join(parts).decode("utf-8", "replace")


class Vocabulary:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        spec = _spec(path)
        model = spec["model"]
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.added = _added(spec.get("added_tokens", []))
        self.added_ids = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        #: White space always parts words, so the words between it are remembered as well.
        self.pattern = None if any(c.split() != [c] for c in self.added_ids) else tokens._split_pattern(path)
        self.marked = bool(model.get("end_of_word_suffix"))
        self._symbols(model)
        self._merges(model)
        self._borders()
        self._candidates()
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.proposed = self.failed = 0

    # ------------------------------------------------------------ tables

    def _symbols(self, model: dict) -> None:
        """Bytes of each token; ids of the tokens that are one symbol."""
        to_byte = {chr(c): b for b, c in tokens._byte_letters().items()}
        suffix = model.get("end_of_word_suffix") or ""
        self.letters = {ord(c): b for c, b in to_byte.items()}
        self.size = 1 + max([*model["vocab"].values(), *self.added_ids.values()], default=0)
        self.raw: list[bytes | None] = [None] * self.size
        for token, i in model["vocab"].items():
            ended = bool(suffix) and token.endswith(suffix) and token != suffix
            plain = token[: -len(suffix)] if ended else token
            if plain and all(c in to_byte for c in plain):
                self.raw[i] = bytes(to_byte[c] for c in plain) + (bytes([END]) if ended else b"")
        self.single = np.full((2, 256), -2, np.int64)  # within a word, at its marked end
        for i, raw in enumerate(self.raw):
            if raw and len(raw) == 1:
                self.single[0, raw[0]] = i
            elif raw and self.marked and len(raw) == 2 and raw[1] == END:
                self.single[1, raw[0]] = i

    def _merges(self, model: dict) -> None:
        """Sorted keys of the pairs that merge, with their rank and the token made."""
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = self.left * self.size + self.right
        self.keys, first = np.unique(keys, return_index=True)
        self.ranks = first.astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank at which each pair merges, or never."""
        if not len(self.keys):
            return np.full(len(a), _NEVER)
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], _NEVER)

    def _borders(self) -> None:
        """For each token, the symbols at its first and last border in the order they arise, and the rank that uses each up."""
        split: dict[int, list[int]] = {}
        for r, t in enumerate(self.made.tolist()):
            split.setdefault(t, []).append(r)
        #: A token with several splits is never proposed; words that need it are merged.
        self.sure = np.array([raw is not None and len(split.get(i, ())) <= 1 for i, raw in enumerate(self.raw)])
        chains = []
        for side in (self.left, self.right):
            rows = []
            for i in range(self.size):
                chain, at = [(i, _LATER)], i
                while at in split:
                    r = split[at][0]
                    at = int(side[r])
                    if len(chain) > 4 * STRIP or chain[-1][1] <= r:  # a merge list out of order
                        self.sure[i] = False
                        break
                    chain.append((at, r))
                rows.append(chain[::-1])
            depth = max(map(len, rows))
            symbol, used = np.zeros((self.size, depth), np.int32), np.full((self.size, depth), _LATER, np.int32)
            for i, chain in enumerate(rows):
                symbol[i, : len(chain)], used[i, : len(chain)] = zip(*chain)
            chains.append((symbol, used, np.array([len(c) - 1 for c in rows])))
        self.first_border, self.last_border = chains
        # a token encodes to itself if its halves do and nothing joins them before their own merge
        whole = self.sure.copy()
        order, inner = np.arange(len(self.made)), self.sure[self.made]
        early, _ = self.joined(self.left[inner], self.right[inner], below_top=True)
        kept = np.zeros(len(order), bool)
        kept[inner] = ~early
        ok = np.zeros(len(order), bool)
        for r in order.tolist():  # halves come first
            ok[r] = kept[r] and whole[self.left[r]] and whole[self.right[r]]
            whole[self.made[r]] &= ok[r]
        self.whole = whole

    def joined(self, a: np.ndarray, b: np.ndarray, below_top: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Whether a merge across the border of each pair happens; with ``below_top``, before both are complete."""
        (ls, lu, ltop), (rs, ru, rtop) = self.last_border, self.first_border
        i, j = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        found, live = np.zeros(len(a), bool), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            top = (i[live] == ltop[x]) & (j[live] == rtop[y])
            used_l, used_r = lu[x, i[live]], ru[y, j[live]]
            r = self.rank(ls[x, i[live]].astype(np.int64), rs[y, j[live]])
            hit = (r != _NEVER) & (r < used_l) & (r <= used_r)
            if below_top:
                hit &= ~top
            found[live] |= hit
            step_left = used_l <= used_r
            i[live] += step_left & ~top
            j[live] += ~step_left & ~top
            live = live[~(hit | top)]
        return found, ~found

    def _candidates(self) -> None:
        """Fingerprints of the tokens that encode to themselves, sorted, for each length."""
        self.tables = {}
        by_length: dict[int, list[int]] = {}
        for i in np.flatnonzero(self.whole).tolist():
            by_length.setdefault(len(self.raw[i]), []).append(i)
        self.flat = np.frombuffer(b"".join(r or b"" for r in self.raw), np.uint8)
        self.lengths = np.array([len(r or b"") for r in self.raw])
        self.starts = np.cumsum(self.lengths) - self.lengths
        for n, ids in sorted(by_length.items()):
            data = np.frombuffer(b"".join(self.raw[i] for i in ids), np.uint8)
            keys = np.array([common.Prints(data[k : k + n]).of(np.zeros(1, np.int64), n)[0] for k in range(0, len(data), n)], np.uint64) if len(ids) < 8 else _prints(data, n)
            order = np.argsort(keys)
            self.tables[n] = keys[order], np.array(ids)[order]

    # ------------------------------------------------------------ words

    def pieces(self, text: str) -> list[str | int]:
        """Words in the vocabulary's letters, and ids of added tokens, in their order."""
        if self.pattern is not None and text.isascii() and text.isprintable() and " " not in text and not any(map(text.__contains__, self.added_ids)):
            return self.pattern.findall(text.lower())  # printable bytes stand for themselves
        parts = [text] if self.added is None else self.added.split(text)
        out: list[str | int] = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.added_ids[part])
            elif part:
                plain = self.normalizer.normalize_str(part) if self.normalizer else part
                out.extend(w for w, _ in self.splitter.pre_tokenize_str(plain))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit numbers."""
        if len(self.words) > REMEMBER:
            self.words.clear()
        if len(self.chunks) > REMEMBER:
            self.chunks.clear()
        if self.pattern is None:
            cut = [self.pieces(t) for t in texts]
            self._learn({w for ws in cut for w in ws if isinstance(w, str)})
            return [b"".join(map(self._bytes, ws)) for ws in cut]
        split = [t.replace("\n", " ").split(" ") for t in texts]
        new = {w: self.pieces(w) for w in set().union(*split).difference(self.chunks)}
        self._learn({p for ps in new.values() for p in ps if isinstance(p, str)})
        for w, ps in new.items():
            self.chunks[w] = b"".join(map(self._bytes, ps))
        return [b"".join(map(self.chunks.__getitem__, ws)) for ws in split]

    def _bytes(self, piece: str | int) -> bytes:
        return self.words[piece] if isinstance(piece, str) else piece.to_bytes(4, "little")

    def _learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.words]
        if not new:
            return
        end = bytes([END]) if self.marked else b""
        raw = [p.translate(self.letters).encode("latin-1") + end for p in new]
        for p, ids in zip(new, self.encode_words(raw)):
            self.words[p] = ids.astype("<u4").tobytes()

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of words given as bytes (with their end mark): proposed, verified, merged where that fails."""
        data = np.frombuffer(b"".join(words), np.uint8)
        bounds = np.zeros(len(words) + 1, np.int64)
        np.cumsum([len(w) for w in words], out=bounds[1:])
        at, ids, good = self.propose(data, bounds)
        word = np.searchsorted(bounds, at, side="right") - 1
        same = word[1:] == word[:-1]
        a, b = ids[:-1][same], ids[1:][same]
        pair, back = np.unique(a * self.size + b, return_inverse=True)
        bad = self.joined(pair // self.size, pair % self.size)[0][back] if len(pair) else np.zeros(0, bool)
        good[word[1:][same][bad]] = False
        cuts = np.searchsorted(at, bounds)
        out: list[np.ndarray | None] = [ids[cuts[k] : cuts[k + 1]] if good[k] else None for k in range(len(words))]
        failing = np.flatnonzero(~good)
        self.proposed += len(words)
        self.failed += len(failing)
        short = np.diff(bounds)[failing] <= SHORT
        for some, way in ((failing[short], self.merge_short), (failing[~short], self.merge)):
            for k, merged in zip(some.tolist(), way([words[k] for k in some.tolist()])):
                out[k] = merged
        return out

    def propose(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places and ids of the longest matches from each word's start on, and which words they cover exactly."""
        n = len(data)
        ends = np.repeat(bounds[1:], np.diff(bounds))
        length, best = np.zeros(n, np.int64), np.full(n, -1)
        longest = max(self.tables, default=1)
        for lo in range(0, n, STRIP):
            hi = min(n, lo + STRIP)
            prints = common.Prints(data[lo : min(n, hi + longest)])
            places = np.arange(lo, hi)
            room = ends[lo:hi] - places
            for size, (keys, ids) in self.tables.items():  # shorter first, so the longest stays
                fits = room >= size
                if self.marked:
                    fits &= room != size + 1  # the end mark belongs to the last symbol
                p = places[fits]
                if not len(p):
                    continue
                key = prints.of(p - lo, size)
                k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = keys[k] == key
                length[p[hit]], best[p[hit]] = size, ids[k[hit]]
        good = np.ones(len(bounds) - 1, bool)
        reached = np.zeros(n, bool)
        word, now = np.arange(len(bounds) - 1), bounds[:-1]
        while len(now):
            inside = now < bounds[word + 1]
            word, now = word[inside], now[inside]
            stuck = length[now] == 0
            good[word[stuck]] = False
            word, now = word[~stuck], now[~stuck]
            reached[now] = True
            now = now + length[now]
        at = np.flatnonzero(reached)
        ids = best[at]
        # fingerprints propose, bytes decide
        size = length[at]
        offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        wrong = self.flat[np.repeat(self.starts[ids], size) + offset] != data[np.repeat(at, size) + offset]
        if wrong.any():
            good[np.searchsorted(bounds, np.repeat(at, size)[wrong], side="right") - 1] = False
        return at, ids, good

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of the words, and where each word starts among them (with the end)."""
        data = np.frombuffer(b"".join(words), np.uint8)
        bounds = np.zeros(len(words) + 1, np.int64)
        np.cumsum([len(w) for w in words], out=bounds[1:])
        kind = np.zeros(len(data), np.int64)
        keep = np.ones(len(data), bool)
        if self.marked:
            kind[bounds[1:] - 2], keep[bounds[1:] - 1] = 1, False
            bounds = bounds - np.arange(len(bounds))
        return self.single[kind[keep], data[keep]], bounds

    def merge_short(self, words: list[bytes]) -> list[np.ndarray]:
        """Exact merging of many short words: in each round, every word merges its lowest rank."""
        if not words:
            return []
        token, bounds = self.symbols(words)
        out: list[np.ndarray | None] = [None] * len(words)
        number, size = np.arange(len(words)), np.diff(bounds)
        while len(number):
            start = np.cumsum(size) - size
            r = np.append(self.rank(token[:-1], token[1:]), _NEVER)
            r[start + size - 1] = _NEVER
            lowest = np.minimum.reduceat(r, start)
            done = lowest == _NEVER
            for k, a, z in zip(number[done].tolist(), start[done].tolist(), (start + size)[done].tolist()):
                out[k] = token[a:z][token[a:z] >= 0]
            hit = (r == np.repeat(lowest, size)) & (r != _NEVER)
            at = np.flatnonzero(hit)
            begin = np.flatnonzero(np.append(True, at[1:] != at[:-1] + 1)) if len(at) else at
            run = np.repeat(begin, np.diff(np.append(begin, len(at))))
            at = at[(np.arange(len(at)) - run) % 2 == 0]  # of a run of equal symbols, the first two, the next two ...
            stay = np.repeat(~done, size)
            token[at] = self.made[r[at]]
            stay[at + 1] = False
            word = np.repeat(np.arange(len(number)), size)
            size = np.bincount(word[stay], minlength=len(number))[~done]
            token, number = token[stay], number[~done]
        return out

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Exact merging of words of any length together, rank by rank, in linked arrays."""
        if not words:
            return []
        token, bounds = self.symbols(words)
        token = np.append(token, -1)
        n = len(token) - 1
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[bounds[1:] - 1] = n
        before = np.append(before, n)[: n + 1]
        before[bounds[:-1]] = -1
        pending: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def queue(at: np.ndarray) -> None:
            r = self.rank(token[at], token[after[at]])
            at, r = at[r != _NEVER], r[r != _NEVER]
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            for part in np.split(at, np.flatnonzero(np.diff(r)) + 1) if len(at) else ():
                value = int(self.rank(token[part[:1]], token[after[part[:1]]])[0])
                if value not in pending:
                    pending[value] = []
                    heapq.heappush(heap, value)
                pending[value].append(part)

        queue(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(pending.pop(r)))
            a, b = self.left[r], self.right[r]
            at = at[(token[at] == a) & (token[after[at]] == b)]
            if a == b and len(at) > 1:  # of a run of equal symbols, the first two, the next two ...
                linked = np.append(False, at[1:] == after[at[:-1]])
                begin = np.flatnonzero(~linked)
                at = at[(np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))) % 2 == 0]
            gone = after[at]
            behind = after[gone]
            token[at], token[gone] = self.made[r], -1
            after[at] = behind
            before[behind] = at
            left = before[at]
            queue(np.unique(np.concatenate([left[left >= 0], at])))
        alive = np.flatnonzero(token[:n] >= 0)
        cuts = np.searchsorted(alive, bounds)
        return [token[alive[cuts[k] : cuts[k + 1]]] for k in range(len(words))]


def _added(added: list[dict]):
    """Splits a text at its added tokens, which stand at the odd places."""
    if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens that take their surroundings are not known here")
    if not added:
        return None
    longest = sorted((t["content"] for t in added), key=len, reverse=True)
    return regex.compile("(" + "|".join(map(regex.escape, longest)) + ")")


def _prints(data: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of consecutive stretches of ``size`` bytes."""
    out = []
    step = max(1, STRIP // size) * size
    for lo in range(0, len(data), step):
        part = data[lo : lo + step]
        out.append(common.Prints(part).of(np.arange(0, len(part), size), size))
    return np.concatenate(out)


def _encode(path: str, text: str, carry: list[str], into: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    vocab = vocabulary(path)
    for batch in common.blocks(batches, text):
        packed = vocab.encode(batch.column(batch.schema.get_field_index(text)).to_pylist())
        ends = np.cumsum([0, *(len(p) // 4 for p in packed)])
        flat = np.frombuffer(b"".join(packed), "<i4")
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(carry))), ids], names=[*carry, into])


def _decode(path: str, carry: list[str], into: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    vocab = decoder(path)
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        ends = np.cumsum(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False))
        start, done = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, done + DECODED, side="right")))
            texts = [vocab.decode(column[k].values.drop_null().to_numpy(zero_copy_only=False)) for k in range(start, stop)]
            kept = batch.slice(start, stop - start)
            yield pa.RecordBatch.from_arrays([*(kept.column(i) for i in range(len(carry))), pa.array(texts, pa.string())], names=[*carry, into])
            start, done = stop, int(ends[stop - 1])


def _fields(df: DataFrame, carry: list[str]) -> str:
    return ", ".join(f"`{c}` {df.select(f'`{c}`').schema[0].dataType.simpleString()}" for c in carry)


def encode(df: DataFrame, path: str, text: str = "text", carry: list[str] | None = None, into: str = "ids") -> DataFrame:
    """The columns ``carry`` and the ids of each whole text as ``into`` (array of int)."""
    carry = carry or []
    rows = df.select(*[F.col(f"`{c}`") for c in carry], common.text_column(text).alias("__text"))
    fields = ", ".join([*([_fields(df, carry)] if carry else []), f"`{into}` array<int>"])
    return common.map_arrow(rows, partial(_encode, path, "__text", carry, into), fields)


def decode(df: DataFrame, path: str, ids: str = "ids", carry: list[str] | None = None, into: str = "decoded") -> DataFrame:
    """The columns ``carry`` and the text of each row's ids as ``into``."""
    carry = carry or []
    given = F.coalesce(F.col(f"`{ids}`").cast("array<int>"), F.array().cast("array<int>"))
    rows = df.select(*[F.col(f"`{c}`") for c in carry], given.alias("__ids"))
    fields = ", ".join([*([_fields(df, carry)] if carry else []), f"`{into}` string"])
    return common.map_arrow(rows, partial(_decode, path, carry, into), fields)
