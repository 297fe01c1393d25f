"""Vectorised text primitives over Arrow string batches.

A batch of texts is one byte buffer plus offsets. Words, lines and their 64-bit hashes are found
with whole-buffer numpy operations, so no Python code runs per word. Batches are cut into pieces
of about a megabyte, which bounds memory however many or long the texts are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1_000_000
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that are no part of an alphanumeric word: ASCII other than letters and digits.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

_powers: list[np.ndarray] = []


def _pow_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE_BYTES + 1024)
        with np.errstate(over="ignore"):
            tables = []
            for base in (_BASE, _INVERSE):
                t = np.full(size, base, _U)
                t[0] = 1
                tables.append(np.cumprod(t, dtype=_U))
        _powers[:] = tables
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> _U(33))
        h = h * _U(0xFF51AFD7ED558CCD)
        h = h ^ (h >> _U(33))
        h = h * _U(0xC4CEB9FE1A85EC53)
        return h ^ (h >> _U(33))


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, "Texts"]]:
    """Consecutive runs of rows with at most ``limit`` bytes (or one row): (first, past last, texts)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if n == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b, Texts(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        a = b


class Texts:
    """The bytes of some texts and where each begins."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.buf, self.offsets, self.n = buf, offsets, len(offsets) - 1
        self._prefix: np.ndarray | None = None

    def lowered(self) -> "Texts":
        """With A-Z lower-cased."""
        return Texts(LOWER[self.buf], self.offsets)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte range; equal bytes give equal hashes in any batch."""
        power, inverse = _pow_tables(len(self.buf) + 1)
        with np.errstate(over="ignore"):
            if self._prefix is None:
                p = np.zeros(len(self.buf) + 1, _U)
                np.cumsum((self.buf.astype(_U) + _U(1)) * power[: len(self.buf)], out=p[1:])
                self._prefix = p
            h = (self._prefix[ends] - self._prefix[starts]) * inverse[starts]
            return mix(h + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))

    def spans(self, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of bytes that ``breaks`` (256 flags) doesn't mark."""
        if not len(self.buf):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        gap = breaks[self.buf]
        inside = ~gap
        before = np.empty(len(gap), bool)
        before[0], before[1:] = True, gap[:-1]
        after = np.empty(len(gap), bool)
        after[-1], after[:-1] = True, gap[1:]
        edges = self.offsets[:-1][self.offsets[:-1] < len(gap)]
        before[edges] = True
        edges = self.offsets[1:][self.offsets[1:] > 0]
        after[edges - 1] = True
        return np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1

    def per_text(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of each text's spans in ``starts``, and each span's text."""
        bounds = np.searchsorted(starts, self.offsets)
        return bounds, np.repeat(np.arange(self.n), np.diff(bounds))

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of every line that ``\\n`` parts, empty ones included."""
        cuts = np.flatnonzero(self.buf == 10)
        starts = np.concatenate([self.offsets[:-1], cuts + 1])
        text = np.concatenate([np.arange(self.n), np.searchsorted(self.offsets[1:], cuts, "right")])
        order = np.lexsort((starts, text))
        starts, text = starts[order], text[order]
        ends = np.append(starts[1:] - 1, 0)
        last = np.append(text[1:] != text[:-1], True)
        ends[last] = self.offsets[1:][text[last]]
        return starts, ends, text


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """The hash of every ``size`` consecutive hashes; windows may run over a text's end."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        out = np.zeros(n, _U)
        for k in range(size):
            out = out * _U(0x9E3779B97F4A7C15) + h[k : k + n]
        return mix(out)


def per_text_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between successive bounds."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "biu" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def salted(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hashes that are equal only within one text."""
    with np.errstate(over="ignore"):
        return mix(h ^ ((text.astype(_U) + _U(1)) * _U(0xA0761D6478BD642F)))


def counts_of_equal(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element how many equal it, and whether it is the first of its kind."""
    code, kinds = pd.factorize(h)
    size = np.bincount(code, minlength=len(kinds))
    where = np.empty(len(kinds), np.int64)
    where[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    first = np.zeros(len(h), bool)
    first[where] = True
    return size[code], first


#: Character classes of the histograms, by the first byte of a character.
CLASSES = ("lower", "upper", "digit", "symbol", "space", "stop", "other", "wide")
_SYMBOLS = b"#*$%&|<>"
_STOPS = b".,;:!?"


def _class_table() -> np.ndarray:
    t = np.full(256, 6, np.uint8)
    t[97:123], t[65:91], t[48:58] = 0, 1, 2
    t[list(_SYMBOLS)], t[list(_STOPS)] = 3, 5
    t[SPACE] = 4
    t[128:192], t[192:] = len(CLASSES), 7  # continuation bytes count for nothing
    return t


_CLASS = _class_table()


def class_counts(t: Texts) -> np.ndarray:
    """Characters of each class in each text: an array of (texts, classes)."""
    k = len(CLASSES) + 1
    row = np.repeat(np.arange(t.n, dtype=np.int64) * k, np.diff(t.offsets))
    return np.bincount(row + _CLASS[t.buf], minlength=t.n * k).reshape(t.n, k)[:, :-1]


def basic_counts(t: Texts) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Word, symbol, line and repetition counts of each text; also the class counts, the word
    hashes and the bounds of each text's words."""
    starts, ends = t.spans(SPACE)
    bounds, owner = t.per_text(starts)
    h = t.hashes(starts, ends)
    chars = class_counts(t)
    n = np.diff(bounds)
    line_start, line_end, line_text = t.lines()
    wordy = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    ls, le, lt = line_start[wordy], line_end[wordy], line_text[wordy]
    _, first = counts_of_equal(salted(t.hashes(ls, le), lt))
    dup = np.bincount(lt[~first], minlength=t.n)
    repeat = np.zeros(len(h), bool)
    if len(h) >= 3:
        whole = owner[:-2] == owner[2:]
        at = np.flatnonzero(whole)
        count, _ = counts_of_equal(salted(window_hashes(h, 3)[at], owner[at]))
        hit = at[count > 1]
        for k in range(3):
            repeat[hit + k] = True
    _, new = counts_of_equal(salted(h, owner))
    return (
        {
            "n_words": n,
            "word_chars": chars.sum(1) - chars[:, 4],
            "n_symbols": chars[:, 3],
            "n_dup_lines": dup,
            "n_repeat_words": per_text_sum(repeat, bounds),
            "n_distinct_words": per_text_sum(new, bounds),
            "n_lines": np.bincount(lt, minlength=t.n),
        },
        chars,
        h,
        bounds,
    )
