"""Induced sorting of the suffixes of many short strings, with common-prefix values, on disk where
memory ends.

A suffix is of type S if it is smaller than the one after it, else of type L. The suffixes of type S
that follow one of type L are sorted first: their substrings up to the next such place get names,
and the shorter string of names is sorted in its turn, by ranks of pairs that cover twice as many
names in each round. All other suffixes are induced: taken in ascending order, a suffix tells the place
of the one before it if that is of type L; in descending order, if it is of type S. What is induced
waits in a priority queue of tuples (place, common prefix with the tuple before), keyed by first symbol
and then by order of arrival: one first-in-first-out file for each symbol, in memory until all of them
take ``memory`` bytes. The common prefix of two induced neighbours is one more than the least common
prefix of what lies between those that induced them.

Symbols are bytes plus 1; 0 ends a string. Bytes from 253 on, which UTF-8 never has, count as equal.
Order and common prefixes hold for the first ``depth`` symbols, and no prefix goes past a string's end.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

_PIECE = 1 << 20
_SYMBOLS = 256
_FILL = np.uint64(0xFFFFFFFFFFFFFFFF)


def encode(strings: list[bytes]) -> np.ndarray:
    """The strings' symbols, one after another, each string ended by 0."""
    raw = np.frombuffer(b"\xff".join([*strings, b""]), np.uint8)
    out = np.minimum(raw, 253) + np.uint8(1)
    ends = np.cumsum([len(s) + 1 for s in strings]) - 1
    out[ends] = 0
    return out


class Queues:
    """Tuples by symbol, in order of arrival; beyond ``memory`` bytes they wait in an unnamed file."""

    def __init__(self, memory: int):
        self.memory, self.size, self.file, self.spilled = memory, 0, None, 0
        self.parts: list[list] = [[] for _ in range(_SYMBOLS)]

    def push(self, symbol: int, places: np.ndarray, common: np.ndarray) -> None:
        self.parts[symbol].append((places, common))
        self.size += places.nbytes + common.nbytes
        if self.size > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for parts in self.parts:
            held = [i for i, p in enumerate(parts) if len(p) == 2]
            if held:
                places, common = (np.concatenate([parts[i][j] for i in held]) for j in range(2))
                at = self.file.tell()
                self.file.write(places.tobytes())
                self.file.write(common.tobytes())
                self.spilled += places.nbytes + common.nbytes
                # only the newest parts are in memory, so the order of arrival stays
                parts[held[0] :] = [(at, len(places), places.dtype)]
        self.size = 0

    def _load(self, part: tuple) -> tuple[np.ndarray, np.ndarray]:
        if len(part) == 2:
            self.size -= part[0].nbytes + part[1].nbytes
            return part
        at, n, kind = part
        self.file.seek(at)
        places = np.frombuffer(self.file.read(n * kind.itemsize), kind)
        return places, np.frombuffer(self.file.read(n), np.uint8)

    def take(self, symbol: int, last_first: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All tuples of ``symbol`` in large pieces, also those that arrive meanwhile."""
        parts = self.parts[symbol]
        while parts:
            n = cut = 0
            for part in reversed(parts) if last_first else parts:
                n += part[1] if len(part) == 3 else len(part[0])
                cut += 1
                if n >= _PIECE:
                    break
            got = parts[-cut:] if last_first else parts[:cut]
            parts[:] = parts[:-cut] if last_first else parts[cut:]
            loaded = [self._load(p) for p in got]
            yield loaded[0] if cut == 1 else tuple(np.concatenate(x) for x in zip(*loaded, strict=True))

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _words(text: np.ndarray) -> np.ndarray:
    """The eight symbols from each place on, as a number; ``text`` has seven more symbols at its end."""
    return np.ndarray((len(text) - 7,), np.dtype(">u8"), buffer=text, strides=(1,))


def _ranks(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by ``keys`` (the first one leads), dense ranks, and where a new rank begins in the order."""
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        ordered = key[order]
        new[1:] |= ordered[1:] != ordered[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    return order, rank, new


def _sort_seeds(words: np.ndarray, text: np.ndarray, seeds: np.ndarray, depth: int) -> np.ndarray:
    """Seeds in the order of their suffixes: substrings are named, names ranked in pairs."""
    length = np.diff(seeds, append=seeds[-1] + 1) + 1
    length[text[seeds] == 0] = 1
    shift = (8 * (8 - np.clip(length, 0, 8))).astype(np.uint64)
    fill = np.where(shift > 0, ~(_FILL << np.minimum(shift, np.uint64(63))), np.uint64(0))
    _, rank, _ = _ranks(words[seeds].astype(np.uint64) | fill)
    at = 8
    while (longer := length > at).any():
        touched = np.flatnonzero(np.isin(rank, rank[longer]))
        left = length[touched] - at
        shift = (8 * (8 - np.clip(left, 0, 8))).astype(np.uint64)
        fill = np.where(shift >= 64, _FILL, np.where(shift > 0, ~(_FILL << np.minimum(shift, np.uint64(63))), np.uint64(0)))
        more = np.zeros(len(seeds), np.uint64)
        more[touched] = words[np.minimum(seeds[touched] + at, len(words) - 1)].astype(np.uint64) | fill
        _, rank, _ = _ranks(rank, more)
        at += 8
    # the string of names: a name's successor is the next seed, until the string ends
    order, rank, new = _ranks(rank)
    ends = np.flatnonzero(text[seeds] == 0)
    last = ends[np.searchsorted(ends, np.arange(len(seeds)))]
    covered = 1
    while not new.all() and covered < depth:
        ahead = np.arange(len(seeds)) + covered
        follower = np.where(ahead <= last, rank[np.minimum(ahead, len(seeds) - 1)] + 1, 0)
        order, rank, new = _ranks(rank * (len(seeds) + 2) + follower)
        covered *= 2
    return seeds[order]


def _common(words: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """How many symbols the suffixes at ``a`` and ``b`` share at most, up to ``depth``."""
    out = np.full(len(a), depth, np.int64)
    open_ = np.arange(len(a))
    for at in range(0, depth, 8):
        top = len(words) - 1
        x = words[np.minimum(a[open_] + at, top)].astype(np.uint64) ^ words[np.minimum(b[open_] + at, top)].astype(np.uint64)
        differ = x != 0
        d = x[differ]
        same = np.zeros(len(d), np.int64)
        for byte in range(7, 0, -1):  # leading bytes that are zero
            same += (d >> np.uint64(8 * byte)) == 0
        out[open_[differ]] = np.minimum(at + same, depth)
        open_ = open_[~differ]
    return out


class _Least:
    """Least value of any range of ``values``."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        step = 1
        while step * 2 <= len(values):
            low = self.levels[-1]
            self.levels.append(np.minimum(low[:-step], low[step:]))
            step *= 2

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        out = np.empty(len(first), np.uint8)
        for k in np.unique(level):
            on = level == k
            values = self.levels[k]
            out[on] = np.minimum(values[first[on]], values[last[on] - (1 << int(k)) + 1])
        return out


class _Inducer:
    """Takes suffixes in order and queues those before them that are of the wanted type."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, depth: int, memory: int):
        self.text, self.wanted, self.depth, self.queues = text, wanted, depth, Queues(memory)
        self.least = np.full(_SYMBOLS, -1, np.int16)  # since the symbol's last tuple; -1: it has none yet

    def feed(self, places: np.ndarray, common: np.ndarray) -> None:
        for a in range(0, len(places), _PIECE):
            self._feed(places[a : a + _PIECE], common[a : a + _PIECE])

    def _feed(self, places: np.ndarray, common: np.ndarray) -> None:
        before = places - 1
        at = np.flatnonzero((places > 0) & self.wanted[before])
        n = len(common)
        whole = int(common.min(initial=255))
        if not len(at):
            self.least = np.where(self.least >= 0, np.minimum(self.least, whole), self.least).astype(np.int16)
            return
        symbols = self.text[before[at]]
        order = np.argsort(symbols, kind="stable")
        at, symbols = at[order], symbols[order]
        begins = np.flatnonzero(np.concatenate(([True], symbols[1:] != symbols[:-1])))
        ends = np.append(begins[1:], len(at))
        first = np.empty(len(at), np.int64)
        first[1:] = at[:-1] + 1
        first[begins] = 0
        least = _Least(common)
        shared = least(first, at).astype(np.int16)
        heads = symbols[begins]
        shared[begins] = np.minimum(shared[begins], self.least[heads])
        shared = np.minimum(shared + 1, self.depth).astype(np.uint8)
        self.least = np.where(self.least >= 0, np.minimum(self.least, whole), self.least).astype(np.int16)
        tail = at[ends - 1] + 1
        self.least[heads] = self.depth
        inside = tail < n
        self.least[heads[inside]] = least(tail[inside], np.full(int(inside.sum()), n - 1))
        queued = before[at]
        for symbol, a, b in zip(heads.tolist(), begins.tolist(), ends.tolist(), strict=True):
            self.queues.push(symbol, queued[a:b], shared[a:b])


def suffixes(text: np.ndarray, depth: int, memory: int = 64 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all suffixes (but the empty ones) in descending order, in pieces, each with the number
    of symbols that it shares with the suffix given before it, up to ``depth``. ``text`` ends with 0."""
    n = len(text)
    place = np.int32 if n < 1 << 31 else np.int64
    step = np.diff(text.astype(np.int16), append=np.int16(256))
    run_end = np.where(step != 0, np.arange(n, dtype=place), place(n - 1))
    run_end = np.minimum.accumulate(run_end[::-1])[::-1]
    small = step[run_end] > 0
    run = np.minimum(run_end - np.arange(n, dtype=place) + 1, depth).astype(np.uint8)
    del step, run_end
    large = ~small
    seeds = np.flatnonzero(small[1:] & large[:-1]) + 1
    padded = np.concatenate((text, np.zeros(7, np.uint8)))
    words = _words(padded)
    ends = np.flatnonzero(text == 0)
    seeds = _sort_seeds(words, text, seeds, depth)
    left = ends[np.searchsorted(ends, seeds)] - seeds
    common = np.zeros(len(seeds), np.int64)
    common[1:] = np.minimum(_common(words, seeds[1:], seeds[:-1], depth), np.minimum(left[1:], left[:-1]))
    seeds, common = seeds.astype(place), common.astype(np.uint8)
    starts = np.searchsorted(text[seeds], np.arange(_SYMBOLS + 1))
    del words, padded, left
    # ascending: type L
    induced, kept = _Inducer(text, large, depth, memory // 2), Queues(memory // 2)
    last = [-1] * _SYMBOLS
    for symbol in range(_SYMBOLS):
        for places, shared in induced.queues.take(symbol):
            kept.push(symbol, places, shared)
            last[symbol] = int(places[-1])
            induced.feed(places, shared)
        a, b = starts[symbol], starts[symbol + 1]
        if a < b:
            own = common[a:b].copy()
            own[0] = 0 if last[symbol] < 0 else min(run[last[symbol]], run[seeds[a]])
            induced.feed(seeds[a:b], own)
    induced.queues.close()
    # descending: type S, and the kept ones of type L below them
    wanted = small & (text > 0)
    induced = _Inducer(text, wanted, depth, memory // 2)
    for symbol in range(_SYMBOLS - 1, 0, -1):
        above = -1
        for places, shared in induced.queues.take(symbol):
            yield places, shared
            above = int(places[-1])
            induced.feed(places, shared)
        carried = None
        for places, shared in kept.take(symbol, last_first=True):
            down = places[::-1]
            if carried is None:
                carried = 0 if above < 0 else min(run[above], run[down[0]])
            own = np.concatenate((np.array([carried], np.uint8), shared[:0:-1]))
            carried = shared[0]
            yield down, own
            induced.feed(down, own)
    induced.queues.close()
    kept.close()
