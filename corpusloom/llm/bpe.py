"""Exact byte-pair encoding by dynamic programming over prefixes, and decoding.

A piece of text (what the pre-tokenizer's pattern cuts) is encoded from its prefixes: an automaton
over all tokens gives those that end at a prefix's end, longest first, and the token t is the last
token of that prefix exactly if it stands unmerged beside the last token of the prefix before t.
That pair test undoes merges from the later one back and looks for an earlier merge over the
border. Each prefix keeps its one last token; back-pointers from the end give the ids.

Pieces repeat, so every Python process keeps a bounded table of pieces already encoded.

Cases: a null or empty text has no ids and decodes to an empty text; special tokens' strings inside
a text become their ids, as the library does by default; texts of any length are read whole; ids
that don't form UTF-8 decode with replacement characters. Extra columns stay.
"""

from __future__ import annotations

import json
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import held

#: The byte-level pre-tokenizer's pattern, with \s written as the Unicode property.
_WS = r"\p{White_Space}"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|{_WS}+(?!\P{{White_Space}})|{_WS}+"
_CACHE, _PAIRS = 80_000, 250_000
_BASE = -1  # the rank of a single byte


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1
    characters stand for themselves, the others for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        out[b] = chr(b) if b in plain else chr(extra)
        extra += b not in plain
    return out


class Recent(dict):
    """A bounded table of what was met lately: when it is full, it becomes ``old`` and begins anew;
    what is asked for again comes back from ``old``."""

    def __init__(self):
        super().__init__()
        self.old: dict = {}

    def keep(self, key, value):
        if len(self) >= _CACHE:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_characters()
        to_byte = {c: b for b, c in enumerate(letters)}
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank_of_pair: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {vocab[c]: _BASE for c in letters if c in vocab}
        self.halves: dict[int, tuple[int, int]] = {}
        for r, (x, y) in enumerate(merges):
            a, b, both = vocab[x], vocab[y], vocab[x + y]
            self.rank_of_pair[a, b] = r
            if both not in self.rank:
                self.rank[both], self.halves[both] = r, (a, b)
        self.automaton = ahocorasick.Automaton()
        for text, i in vocab.items():
            if i in self.rank:
                self.automaton.add_word(text, (len(text), i))
        self.automaton.make_automaton()
        self.letters = str.maketrans({chr(b): c for b, c in enumerate(letters)})
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for text, i in vocab.items():
            if i in self.rank:
                self.bytes[i] = bytes(to_byte[c] for c in text)
        for text, i in self.special.items():
            self.bytes[i] = text.encode()
        names = sorted(self.special, key=len, reverse=True)  # of two that begin at one place, the longer
        self.special_names = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.pairs: dict[int, bool] = {}
        self.wholes: dict[int, bool] = {}
        self.spaced, self.bare, self.words = Recent(), Recent(), Recent()
        self.pattern = regex.compile(PATTERN)
        self.odd = regex.compile(rf"{_WS}{_WS}|^{_WS}|{_WS}\Z|[^\P{{White_Space}} \n]")

    def stands(self, a: int, b: int) -> bool:
        """Whether tokens ``a`` and ``b`` side by side stay unmerged over their border."""
        key = a << 24 | b
        found = self.pairs.get(key)
        if found is None:
            rank, pairs, limit = self.rank, self.rank_of_pair, len(self.rank_of_pair) + 1
            while True:
                if pairs.get((a, b), limit) < limit:
                    found = False
                    break
                ra, rb = rank[a], rank[b]
                if ra == rb == _BASE:
                    found = True
                    break
                if ra > rb:
                    limit, a = ra, self.halves[a][1]
                else:  # of equal merges the left one comes first
                    limit, b = rb + 1, self.halves[b][0]
            if len(self.pairs) >= _PAIRS:
                self.pairs.clear()
            self.pairs[key] = found
        return found

    def whole(self, t: int) -> bool:
        """Whether a token's own bytes are encoded as that token."""
        found = self.wholes.get(t)
        if found is None:
            found = t not in self.halves
            if not found:
                a, b = self.halves[t]
                found = self.whole(a) and self.whole(b) and self._until(a, b, self.rank[t])
            self.wholes[t] = found
        return found

    def _until(self, a: int, b: int, last: int) -> bool:
        """Whether no merge over the border of ``a`` and ``b`` comes before the merge ``last``."""
        rank, limit = self.rank, last
        while True:
            if self.rank_of_pair.get((a, b), limit) < limit:
                return False
            ra, rb = rank[a], rank[b]
            if ra == rb == _BASE:
                return True
            if ra > rb:
                limit, a = min(ra, limit), self.halves[a][1]
            else:
                limit, b = min(rb + 1, limit), self.halves[b][0]

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token by the last token of every prefix."""
        text = word.encode().decode("latin-1").translate(self.letters)
        n = len(text)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        wholes, pairs = self.wholes.get, self.pairs.get
        for end, (size, token) in self.automaton.iter(text):
            i = end + 1
            if last[i] >= 0:
                continue  # longer tokens come first, and only one can be right
            j = i - size
            if j:
                before = last[j]
                if before < 0:
                    continue
                own = wholes(token)
                if not (self.whole(token) if own is None else own):
                    continue
                fits = pairs(before << 24 | token)
                if not (self.stands(before, token) if fits is None else fits):
                    continue
            elif not self.whole(token):
                continue
            last[i], back[i] = token, j
        out, i = [], n
        while i:
            out.append(last[i])
            i = back[i]
        return out[::-1]

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            found = self.words.old.get(word) or array("I", self.encode_word(word)).tobytes()
            self.words.keep(word, found)
        return found

    def _pieces(self, text: str) -> bytes:
        return b"".join([self._word(w) for w in self.pattern.findall(text)])

    def _plain(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        if not text:
            return b""
        if self.odd.search(text):
            return self._pieces(text)
        # single spaces and line ends only: what a blank or line end parts is encoded on its own
        first, *rest = text.replace("\n", " \n").split(" ")
        spaced = self.spaced
        out = [self.bare.get(first) or self._learn(self.bare, first, first)]
        for piece in rest:
            out.append(spaced.get(piece) or self._learn(spaced, piece, piece if piece[0] == "\n" else " " + piece))
        return b"".join(out)

    def _learn(self, table: Recent, key: str, text: str) -> bytes:
        return table.keep(key, table.old.get(key) or self._pieces(text))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not any(name in text for name in self.special):
            return self._plain(text)
        cut = self.special_names.split(text)  # texts and special names by turns
        out = [np.array([self.special[x]], "<u4").tobytes() if i % 2 else self._plain(x) for i, x in enumerate(cut)]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file (a path that every executor has)."""
    return held(("bpe", path), lambda: Encoder(path))


def round_trip(text: Column, path: str) -> Column:
    """Ids (binary, little-endian unsigned 32-bit), their number, and the text decoded from them."""

    @F.arrow_udf("struct<ids:binary,n_tokens:bigint,decoded:string>")
    def run(texts: pa.Array) -> pa.Array:
        own = encoder(path)
        ids = [own.encode(x) for x in pc.fill_null(texts, "").to_pylist()]
        decoded = [own.decode(x) for x in ids]
        return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(decoded, pa.string())], names=["ids", "n_tokens", "decoded"])

    return run(text)


def decode_ids(ids: Column, path: str) -> Column:
    """The text of ids as ``round_trip`` writes them."""

    @F.arrow_udf("string")
    def run(rows: pa.Array) -> pa.Array:
        own = encoder(path)
        return pa.array([own.decode(x) for x in pc.fill_null(rows, b"").to_pylist()], pa.string())

    return run(ids)
