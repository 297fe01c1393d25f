"""Texts that remember where their characters come from.

A tracked text is a struct of ``text`` and ``pieces``, an array of (at, src, kept): from place ``at`` of the
text on, up to the next piece, characters come from place ``src`` of the source on (``kept``) or all stand
for the one place ``src`` (inserted). The last piece begins at the text's end and gives the source's end.
Rewriting a tracked text composes the maps, so the pieces always lead to the first source, through however
many rules. A rule's matches are found one after another, so the rules run in one Arrow-batched function;
looking places up is native, on a tracked text that has a column of its own.

A null text stays null. Places count characters (code points) from 0.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .regexmap import let

TRACKED = "struct<text: string, pieces: array<struct<at: int, src: int, kept: boolean>>>"


@dataclass(frozen=True)
class Map:
    """Pieces as arrays; the last one is the end."""

    at: np.ndarray
    src: np.ndarray
    kept: np.ndarray

    @classmethod
    def identity(cls, n: int) -> Map:
        return cls(np.array([0, n] if n else [0]), np.array([0, n] if n else [0]), np.ones(2 if n else 1, bool))

    def source(self, places: np.ndarray) -> np.ndarray:
        i = np.searchsorted(self.at, places, "right") - 1
        return self.src[i] + np.where(self.kept[i], places - self.at[i], 0)

    def after(self, first: Map) -> Map:
        """This map's sources, which are places of ``first``'s text, led on to ``first``'s sources. A kept
        piece is cut where ``first`` has a piece of its own."""
        inner = first.at[1:-1]
        ends = np.append(self.at[1:], self.at[-1])
        last = self.src + (ends - self.at)
        low, high = np.searchsorted(inner, self.src, "right"), np.searchsorted(inner, last, "left")
        n = np.where(self.kept & (ends > self.at), np.maximum(high - low, 0), 0)
        owner = np.repeat(np.arange(len(self.at)), 1 + n)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(1 + n) - (1 + n), 1 + n)
        local = self.src[owner].copy()
        cut = step > 0
        local[cut] = inner[(low[owner] + step - 1)[cut]]
        at = self.at[owner] + local - self.src[owner]
        piece = np.searchsorted(first.at, local, "right") - 1
        kept = self.kept[owner] & first.kept[piece]
        return Map(at, first.source(local), kept)


Replacement = str | Callable[[re.Match], str]


def rewrite(text: str, pattern: re.Pattern, replacement: Replacement) -> tuple[str, Map]:
    """The text with every match replaced, and its map. What replaces a match stands for its beginning."""
    out, at, src, kept = [], [], [], []
    n = done = 0

    def add(piece: str, source: int, keep: bool) -> None:
        nonlocal n
        if piece:
            out.append(piece)
            at.append(n)
            src.append(source)
            kept.append(keep)
            n += len(piece)

    for m in pattern.finditer(text):
        add(text[done : m.start()], done, True)
        add(m.expand(replacement) if isinstance(replacement, str) else replacement(m), m.start(), False)
        done = m.end()
    add(text[done:], done, True)
    return "".join(out), Map(np.array([*at, n]), np.array([*src, len(text)]), np.array([*kept, True]))


def substitute(text: str, spans: list[tuple[int, int, str]]) -> tuple[str, Map]:
    """Spans (start, end, what to say) said in their places, set off by spaces; of spans that overlap the
    one that begins first counts, and spans that reach beyond the text are left out."""
    out, at, src, kept = [], [], [], []
    n = done = 0

    def add(piece: str, source: int, keep: bool) -> None:
        nonlocal n
        if piece:
            out.append(piece)
            at.append(n)
            src.append(source)
            kept.append(keep)
            n += len(piece)

    for start, end, say in sorted(spans, key=lambda s: s[0]):
        if not done <= start < end <= len(text):
            continue
        add(text[done:start], done, True)
        if out and not out[-1][-1].isspace():
            add(" ", start, False)
        add(say.strip(), start, False)
        if end < len(text) and not text[end].isspace():
            add(" ", end, False)
        done = end
    add(text[done:], done, True)
    return "".join(out), Map(np.array([*at, n]), np.array([*src, len(text)]), np.array([*kept, True]))


def _row(text: str, m: Map) -> dict:
    return {"text": text, "pieces": [{"at": a, "src": s, "kept": k} for a, s, k in zip(m.at.tolist(), m.src.tolist(), m.kept.tolist(), strict=True)]}


def _map_of(pieces) -> Map:
    return Map(*(np.array([p[c] for p in pieces]) for c in ("at", "src", "kept")))


def track(text: Column) -> Column:
    """A text as its own source."""
    end = F.length(text)
    piece = lambda at: F.struct(at.cast("int").alias("at"), at.cast("int").alias("src"), F.lit(True).alias("kept"))
    return F.when(text.isNotNull(), F.struct(text.alias("text"), F.when(end > 0, F.array(piece(F.lit(0)), piece(end))).otherwise(F.array(piece(F.lit(0)))).alias("pieces")))


def apply(tracked: Column, rules: list[tuple[str, Replacement]]) -> Column:
    """The rules (a pattern, and a template or a function of the match) one after another."""
    compiled = [(re.compile(p), r) for p, r in rules]

    @F.pandas_udf(TRACKED)
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for text, pieces in zip(rows["text"], rows["pieces"], strict=True):
            if text is None:
                out.append({"text": None, "pieces": None})
                continue
            whole = _map_of(pieces)
            for pattern, replacement in compiled:
                text, step = rewrite(text, pattern, replacement)
                whole = step.after(whole)
            out.append(_row(text, whole))
        return pd.DataFrame(out, columns=["text", "pieces"])

    return F.when(tracked.isNotNull(), run(tracked))


def substituted(tracked: Column, spans: Column) -> Column:
    """Spans (start, end, say) said in the places of the tracked text that they name."""

    @F.pandas_udf(TRACKED)
    def run(rows: pd.DataFrame, given: pd.Series) -> pd.DataFrame:
        out = []
        for text, pieces, own in zip(rows["text"], rows["pieces"], given, strict=True):
            if text is None:
                out.append({"text": None, "pieces": None})
                continue
            text, step = substitute(text, [(s["start"], s["end"], s["say"]) for s in own] if own is not None else [])
            out.append(_row(text, step.after(_map_of(pieces))))
        return pd.DataFrame(out, columns=["text", "pieces"])

    return F.when(tracked.isNotNull(), run(tracked, spans))


def source_of(tracked: Column, place: Column) -> Column:
    """The place in the source of a place in the text, between 0 and its length."""
    at = F.least(F.greatest(place, F.lit(0)), F.length(tracked["text"]))

    def look(p: Column) -> Column:
        last = F.aggregate(tracked["pieces"], F.lit(0), lambda n, x: n + (x["at"] <= p).cast("int"))
        return let(F.get(tracked["pieces"], last - 1), lambda x: x["src"] + F.when(x["kept"], p - x["at"]).otherwise(0))

    return let(at, look)


def sources(tracked: Column) -> Column:
    """The source of every place of the text, in order, without its end."""

    def spread(pieces: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            n = F.get(pieces, i + 1)["at"] - x["at"]
            return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: x["src"] + F.when(x["kept"], k).otherwise(0))).otherwise(F.array().cast("array<int>"))

        return F.flatten(F.transform(pieces, one))

    return let(tracked["pieces"], spread)


def source_sum(tracked: Column) -> Column:
    """The sum of ``sources``, each weighted by its place from 1, piece by piece and without the single places."""

    def spread(pieces: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            n = (F.coalesce(F.get(pieces, i + 1)["at"], x["at"]) - x["at"]).cast("long")
            at, src, step = x["at"].cast("long") + 1, x["src"].cast("long"), x["kept"].cast("long")
            first, second = n * (n - 1), n * (n - 1) * (2 * n - 1)  # twice the sum of k, six times that of its squares, for k below n
            return n * src * at + (src + step * at) * F.shiftright(first, 1) + step * (second / 6).cast("long")

        return F.aggregate(F.transform(pieces, one), F.lit(0).cast("long"), lambda a, b: a + b)

    return let(tracked["pieces"], spread)
