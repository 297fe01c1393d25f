"""Alignment and marks: SSML, word marks, subsequence anchors, edits, offset maps, tokenisation.

These are sequential within one text, so they run as Arrow-batched functions per row; rows are
independent, and Spark partitions them. Null gives null; empty gives an empty list.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.batches import slices

_RATES = {"x-slow": 0.5, "slow": 0.75, "medium": 1.0, "fast": 1.25, "x-fast": 1.5}
_TAG = re.compile(r"<(/?)(\w+)([^>]*?)(/?)>")


def _ratio(value: str) -> float:
    if value in _RATES:
        return _RATES[value]
    m = re.fullmatch(r"([+-]?)(\d+(?:\.\d+)?)%", value)
    if not m:
        return 1.0
    x = float(m[2]) / 100
    return 1 + x if m[1] == "+" else 1 - x if m[1] == "-" else x


def read_ssml(text: str) -> list[dict]:
    """Segments with the pause before them and the rate that holds there."""
    if not re.match(r"\s*<(\?xml|speak)", text):
        return [{"text": text, "pause_ms": 0, "rate": 1.0}] if text.strip() else []
    out: list[dict] = []
    stack, pause, at = [1.0], 0, 0

    def add(piece: str) -> None:
        nonlocal pause
        piece = " ".join(unescape(piece).split())
        if piece:
            out.append({"text": piece, "pause_ms": pause, "rate": stack[-1]})
            pause = 0

    for m in _TAG.finditer(text := re.sub(r"<\?.*?\?>", "", text)):
        add(text[at : m.start()])
        at = m.end()
        closing, name, attrs = m[1], m[2].lower(), dict(re.findall(r"(\w+)\s*=\s*[\"']([^\"']*)[\"']", m[3]))
        if name == "break":
            t = re.fullmatch(r"(\d+(?:\.\d+)?)(ms|s)", attrs.get("time", ""))
            pause += int(float(t[1]) * (1000 if t[2] == "s" else 1)) if t else 250
        elif name == "prosody" and not m[4]:
            if closing:
                stack[1:] = stack[1:-1]
            else:
                stack.append(stack[-1] * _ratio(attrs.get("rate", "100%")))
        elif name in ("p", "s") and closing:
            pause += 500 if name == "p" else 250
    add(text[at:])
    return out


def ssml(text: Column) -> Column:
    kind = pa.list_(pa.struct([("text", pa.string()), ("pause_ms", pa.int32()), ("rate", pa.float64())]))

    @F.arrow_udf("array<struct<text:string,pause_ms:int,rate:double>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in slices(batch):
                yield pa.array([None if t is None else read_ssml(t) for t in part.to_pylist()], kind)

    return run(text)


def anchors(source: list[str], other: list[str], reach: int = 8) -> list[tuple[int, int]]:
    """Greedy forward matches in order, each within ``reach`` words of the last one."""
    out, j = [], 0
    for i, word in enumerate(source):
        for k in range(j, min(j + reach, len(other))):
            if other[k] == word:
                out.append((i, k))
                j = k + 1
                break
    return out


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a`` with every beginning of ``b``."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(b == x, row[:-1] + 1, 0)))
    return row


def subsequence(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence as index pairs. Equal ends are matched first; what is between is
    halved where the two halves' lengths add up best, so memory stays linear at any size."""
    number: dict[str, int] = {}
    x, y = (np.array([number.setdefault(w, len(number)) for w in words], np.int64) for words in (a, b))
    out: list[tuple[int, int]] = []
    work = [(0, len(x), 0, len(y))]
    while work:
        i, k, j, m = work.pop()
        while i < k and j < m and x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < k and j < m and x[k - 1] == y[m - 1]:
            k, m = k - 1, m - 1
            out.append((k, m))
        if i == k or j == m:
            continue
        if k - i == 1:
            at = np.flatnonzero(y[j:m] == x[i])
            if len(at):
                out.append((i, j + int(at[0])))
            continue
        half = (i + k) // 2
        best = int(np.argmax(_lengths(x[i:half], y[j:m]) + _lengths(x[half:k][::-1], y[j:m][::-1])[::-1]))
        work += [(i, half, j, j + best), (half, k, j + best, m)]
    return sorted(out)


_TOKEN = re.compile(r"\w[\w+́-]*", re.UNICODE)


def edits_between(source: str, accented: str) -> list[dict]:
    """Edits (start, end, text) that bring the accented words of one text into another: aligned
    words take the accented form, everything else stays."""
    a, b = list(_TOKEN.finditer(source)), list(_TOKEN.finditer(accented))
    bare = [re.sub("[+́]", "", m[0]).lower() for m in b]
    pairs = subsequence([m[0].lower() for m in a], bare)
    return [{"start": a[i].start(), "end": a[i].end(), "text": b[j][0]} for i, j in pairs if a[i][0] != b[j][0]]


def edits(source: Column, accented: Column) -> Column:
    @F.pandas_udf("array<struct<start:int,end:int,text:string>>")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or a is None else edits_between(s, a) for s, a in zip(x, y, strict=True)])

    return run(source, accented)


def apply_edits(source: Column, changes: Column) -> Column:
    """Splices edits in order of their start, natively."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    done = F.aggregate(
        F.array_sort(changes),
        start,
        lambda s, e: F.struct(F.concat(s["out"], source.substr(s["at"] + 1, e["start"] - s["at"]), e["text"]).alias("out"), e["end"].alias("at")),
        lambda s: F.concat(s["out"], source.substr(s["at"] + 1, F.length(source))),
    )
    return F.when(F.size(changes) > 0, done).otherwise(source)


def wordpiece(tokens: list[str], vocabulary: frozenset[str], longest: int = 100, unknown: str = "[UNK]") -> list[str]:
    """Greedy longest beginnings; continuations carry ``##``."""
    out: list[str] = []
    for token in tokens:
        parts, at = [], 0
        while at < len(token) and len(token) <= longest:
            end = next((e for e in range(len(token), at, -1) if ("##" if at else "") + token[at:e] in vocabulary), at)
            if end == at:
                parts = []
                break
            parts.append(("##" if at else "") + token[at:end])
            at = end
        out += parts if at == len(token) and token else [unknown]
    return out


def basic_tokens(text: Column) -> Column:
    """Lower case, control characters dropped, punctuation on its own."""
    clean = F.regexp_replace(F.lower(text), r"[\p{Cc}&&[^\t\n\r]]", "")
    return F.filter(F.split(F.regexp_replace(clean, r"(\p{P}|\p{S})", " $1 "), r"\s+"), lambda t: t != "")


def wordpieces(tokens: Column, vocabulary: list[str]) -> Column:
    words = frozenset(vocabulary)

    @F.arrow_udf("array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in slices(batch):
                yield pa.array([None if t is None else wordpiece(t, words) for t in part.to_pylist()], pa.list_(pa.string()))

    return run(tokens)


def symbol_ids(text: Column, symbols: dict[str, int], start: int, end: int) -> Column:
    """Start, the ids of known characters, end."""
    table = F.create_map(*[x for k, v in symbols.items() for x in (F.lit(k), F.lit(v).cast("long"))])
    known = F.filter(F.transform(F.split(text, ""), lambda c: table[c]), lambda x: x.isNotNull())
    return F.concat(F.array(F.lit(start).cast("long")), known, F.array(F.lit(end).cast("long")))
