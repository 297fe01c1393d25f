"""Marks in a text (rate, pitch, focus, pauses): read off by word, and laid on another writing of it.

``{prosody:90:110}`` sets rate and pitch in percent from there on, ``{pause:300}`` a pause in milliseconds at the
word before it (at most ten seconds; those before the first word are lost), ``*some words*`` the focus. A pause
between two words leaves a comma behind, so that there is a sign to pause at. The text without marks is
tracked (``functions.offsets``): every place of it leads back to the source.

Normalising may turn a word into several, so the words of the spoken text are matched in order, each
within a window of marked words from the last match on. Words without a match take the mark of the word
that comes next. A word's pause is given once, at the first word from there on that a sign follows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.batches import slices
from ..functions.offsets import Map

_LIMIT_MS = 10_000
_SIGNS = ".,:;!?…"
_TOKEN = re.compile(
    r"\{prosody:(?P<rate>\d{1,4}):(?P<pitch>\d{1,4})\}|\s*\{pause:(?P<pause>\d{1,6})\}|(?P<open>(?<![\w*])\*(?=[^\s*][^*\n]*[^\s*]?\*))|(?P<shut>(?<=[^\s*])\*(?![\w*]))"
    r"|(?P<word>[^\W_]+(?:[+'’-]+[^\W_]+)*)"
)
_WORD = re.compile(r"[^\W_]+(?:[+'’-]+[^\W_]+)*")
MARKED = (
    "struct<text: string, pieces: array<struct<at: int, src: int, kept: boolean>>, "
    "words: array<struct<word: string, at: int, src: int, rate: double, pitch: double, focus: boolean, pause_ms: int>>>"
)
_PIECE = {"at": pa.int32(), "src": pa.int32(), "kept": pa.bool_()}
_MARK = {"word": pa.string(), "at": pa.int32(), "src": pa.int32(), "rate": pa.float64(), "pitch": pa.float64(), "focus": pa.bool_(), "pause_ms": pa.int32()}
LAID = "array<struct<word: string, at: int, mark: int, rate: double, pitch: double, focus: boolean, pause_ms: int>>"


def key(word: str) -> str:
    return word.replace("+", "").lower().replace("ё", "е")


def parse(text: str) -> tuple[str, Map, list[dict]]:
    """The text without marks, its map and its words."""
    out, pieces, words = [], [], []
    n = done = 0
    rate = pitch = 1.0
    focus = False

    def add(piece: str, source: int, kept: bool) -> None:
        nonlocal n
        if piece:
            out.append(piece)
            pieces.append((n, source, kept))
            n += len(piece)

    for m in _TOKEN.finditer(text):
        if m["word"] is not None:
            add(text[done : m.start()], done, True)
            words.append({"word": m[0], "at": n, "src": m.start(), "rate": rate, "pitch": pitch, "focus": focus, "pause_ms": 0})
            add(m[0], m.start(), True)
            done = m.end()
            continue
        add(text[done : m.start()], done, True)
        done = m.end()
        if m["rate"] is not None:
            rate, pitch = (int(m[g]) / 100 or 1.0 for g in ("rate", "pitch"))
        elif m["pause"] is not None:
            if words:
                words[-1]["pause_ms"] = min(words[-1]["pause_ms"] + int(m["pause"]), _LIMIT_MS)
                if out[-1][-1] not in _SIGNS:
                    add(",", m.start(), False)
                if done < len(text) and not text[done].isspace() and text[done] not in "{" + _SIGNS:
                    add(" ", done, False)
        else:
            focus = m["open"] is not None
    add(text[done:], done, True)
    at, src, kept = zip(*pieces, (n, len(text), True), strict=True)
    return "".join(out), Map(np.array(at), np.array(src), np.array(kept)), words


def _lists(kinds: dict[str, pa.DataType], offsets: list[int], columns: list) -> pa.ListArray:
    values = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _marked_rows(texts: list[str | None]) -> pa.StructArray:
    """``parse`` of every text in flat columns."""
    plain, maps, words, piece_ends, word_ends = [], [], [], [0], [0]
    for text in texts:
        shown, m, own = parse(text) if text is not None else (None, None, [])
        plain.append(shown)
        if m is not None:
            maps.append(m)
        words += own
        piece_ends.append(piece_ends[-1] + (len(m.at) if m is not None else 0))
        word_ends.append(len(words))
    pieces = [np.concatenate([getattr(m, c) for m in maps]) if maps else [] for c in _PIECE]
    rows = [pa.array(plain, pa.string()), _lists(_PIECE, piece_ends, pieces), _lists(_MARK, word_ends, [[w[c] for w in words] for c in _MARK])]
    return pa.StructArray.from_arrays(rows, names=["text", "pieces", "words"])


def marked(text: Column) -> Column:
    """text (without marks), pieces (its map) and words of every text."""

    @F.arrow_udf(MARKED)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in slices(batch):
                yield _marked_rows(part.to_pylist())

    return F.when(text.isNotNull(), run(text))


def lay(words: list[dict], spoken: str, window: int = 8) -> list[dict]:
    """The words of ``spoken`` with the marks of ``words``."""
    if not words:
        return []
    keys = [key(w["word"]) for w in words]
    out, pos, pending, given = [], 0, 0, -1
    for m in _WORD.finditer(spoken):
        k = key(m[0])
        found = next((j for j in range(pos, min(pos + window, len(keys))) if keys[j] == k), None)
        at = min(pos, len(words) - 1) if found is None else found
        pos = pos if found is None else found + 1
        mark = words[at]
        if at > given:
            given, pending = at, pending + mark["pause_ms"]
        sign = m.end() < len(spoken) and spoken[m.end()] in _SIGNS
        out.append({"word": m[0], "at": m.start(), "mark": at, "rate": mark["rate"], "pitch": mark["pitch"], "focus": mark["focus"], "pause_ms": pending if sign else 0})
        pending = 0 if sign else pending
    return out


def laid(words: Column, spoken: Column, window: int = 8) -> Column:
    """The words of the spoken text with the marks of ``words`` (as ``marked`` gives them)."""

    @F.pandas_udf(LAID)
    def run(given: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([lay(list(w), t, window) if w is not None and t is not None else None for w, t in zip(given, texts, strict=True)])

    return F.when(words.isNotNull() & spoken.isNotNull(), run(words, spoken))
