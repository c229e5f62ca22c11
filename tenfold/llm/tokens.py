"""Token ids of whole texts, by the tokenizers library, with pieces remembered.

The word tokenizer never joins characters across white space, and encodes each
match of its split pattern by itself.  So a text's ids are those of its pieces
in order, and each piece has to be encoded once per task only.  A tokenizer of
another shape, or a chunk outside the Latin letters, goes to the library whole.
"""

from __future__ import annotations

import json
import os
import unicodedata
from functools import lru_cache

import numpy as np
import regex

#: Chunks and pieces that a worker remembers, about 100 MB each; a full memory starts anew.
REMEMBER = 1_000_000


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file, kept for the life of the worker."""
    return Encoder(path)


def forget() -> None:
    """Drop what the worker remembers: for tasks of other operators that need the memory."""
    encoder.cache_clear()


class Encoder:
    """``encode(text)`` gives the ids as little-endian bytes of ``width`` each."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.pattern = _split_pattern(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.chunks: dict[str, bytes] = {"": b""}
        self.pieces: dict[str, bytes] = {}

    def packed(self, ids) -> bytes:
        return np.asarray(ids, dtype=self.dtype).tobytes()

    def whole(self, text: str) -> bytes:
        return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        if self.pattern is None:
            return self.whole(text)
        words = text.replace("\n", " ").split(" ")
        known = self.chunks
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            if len(known) > REMEMBER:
                known.clear()
                known[""] = b""
            if len(self.pieces) > REMEMBER:
                self.pieces.clear()
            for w in words:
                if w not in known:
                    known[w] = self.chunk(w)
            return b"".join(map(known.__getitem__, words))

    def chunk(self, chunk: str) -> bytes:
        if chunk.isascii():
            text = chunk.lower()
        else:
            text = unicodedata.normalize("NFC", chunk)
            if max(text) > "ɏ":
                return self.whole(chunk)
            text = "".join(c.lower() for c in text)
        if any(s in chunk for s in self.special):
            return self.whole(chunk)
        out = []
        for piece in self.pattern.findall(text):
            ids = self.pieces.get(piece)
            if ids is None:
                letters = piece.encode().decode("latin-1").translate(self.letters)
                ids = self.pieces[piece] = self.packed([t.id for t in self.tokenizer.model.tokenize(letters)])
            out.append(ids)
        return b"".join(out)

    def ids(self, packed: bytes) -> np.ndarray:
        return np.frombuffer(packed, dtype=self.dtype)


def _split_pattern(path: str):
    """The pattern whose matches are encoded one by one; None for a tokenizer of another shape."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if (
        kinds != ["NFC", "Replace", "Lowercase"]
        or [s.get("type") for s in steps] != ["Split", "ByteLevel"]
        or not (steps[0].get("invert") and steps[0].get("behavior") == "Removed")
        or steps[1].get("use_regex") or steps[1].get("add_prefix_space")
        or spec.get("post_processor") or spec["model"].get("dropout")
    ):
        return None
    return regex.compile(steps[0]["pattern"]["Regex"], regex.VERSION1)


def _byte_letters() -> dict[int, int]:
    """Byte-level vocabularies name each byte by a printable character: itself, or the next free one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return {b: b if b in printable else next(free) for b in range(256)}


def word_bpe_path() -> str:
    """The word tokenizer of the installed public files."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
