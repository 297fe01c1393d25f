"""Token counts by a compiled finite-state transducer.

The tokenizer is a byte-pair encoder whose merges go by piece score (a .model file). Every prefix
of a text has one last token, so reading one more character decides the count of the longer
prefix from a bounded window: the automaton node of the pieces that may still grow, and the last
token and relative count of each prefix at which such a piece would begin. These windows are the
states of a deterministic transducer; every transition carries the tokens that it adds (or takes
back). States are compiled when first met and kept in a bounded table.

A text is cut into chunks. A word start always leads to the same state, so a chunk's state map is
constant from its first word start on: the chunk's body runs from that state, all bodies of a
batch in step, and the head before it runs from the state in which the chunk before ends. Chunks
without a word start have maps that depend on the state they are entered in. Each is run, all in
step, from the state that its last characters before suggest, which gives its map at one entry;
neighbouring maps are then composed pairwise, level by level, into the map of the whole stretch, and
a map is extended by running its chunk where a composition enters it in another state.

Memory is bounded: the transitions of common characters stand in a table, those of others in a
dictionary, and beyond ``MAX_STATES`` states, even in the middle of a run, all but the states in use
are forgotten.

Cases: a null or empty text has no tokens; special strings inside a text are ordinary characters;
characters that no piece holds count one token for each UTF-8 byte; texts of any length are read
whole; repeated rows are counted alike. Extra columns stay.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import textkernel as K
from .common import held

SPACE_MARK = "▁"
CHUNK = 256
MAX_STATES = 200_000
_COMMON, _LOOK_BACK, _PAIRS = 128, 64, 200_000
_SHIFT, _MIDDLE = 6, 32


class Pieces:
    """Pieces and scores of a model, its merges on small strings, and a suffix automaton of them."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.text = [sp.id_to_piece(i) for i in ids]
        self.score = {t: sp.get_score(i) for t, i in zip(self.text, ids, strict=True)}
        self.number = {t: k for k, t in enumerate(self.text)}
        if any(SPACE_MARK in t.lstrip(SPACE_MARK) for t in self.text):
            raise ValueError("a piece runs over a word start")
        # goto trie, failure links and the pieces that end at each node, longest first
        self.next: list[dict[str, int]] = [{}]
        self.depth, self.piece = [0], [-1]
        for k, t in enumerate(self.text):
            node = 0
            for c in t:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.depth.append(self.depth[node] + 1)
                    self.piece.append(-1)
                node = self.next[node][c]
            self.piece[node] = k
        self.fail = [0] * len(self.next)
        self.ends: list[tuple[int, ...]] = [()] * len(self.next)
        #: How far back a piece may begin that is still growing at a node; ends with 0.
        self.depths: list[tuple[int, ...]] = [(0,)] * len(self.next)
        queue = [0]
        for node in queue:
            for c, child in self.next[node].items():
                back = self.fail[node]
                while back and c not in self.next[back]:
                    back = self.fail[back]
                self.fail[child] = self.next[back].get(c, 0) if node else 0
                own = (self.piece[child],) if self.piece[child] >= 0 else ()
                self.ends[child] = own + self.ends[self.fail[child]]
                self.depths[child] = (self.depth[child], *self.depths[self.fail[child]])
                queue.append(child)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.made: dict[str, tuple[str, str] | None] = {}
        self.odd: set[str] = set()  # pieces that don't score below their parts

    def step(self, node: int, c: str) -> int:
        while node and c not in self.next[node]:
            node = self.fail[node]
        return self.next[node].get(c, 0)

    def merge(self, text: str, steps: list[tuple[str, str]] | None = None) -> list[str]:
        """The pieces of a short string: best score first, leftmost among equals. ``steps`` gets
        the merges in their order."""
        parts: list[str | None] = list(text)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(parts):
                both = parts[i] + parts[after[i]]
                if both in self.score:
                    heapq.heappush(heap, (-self.score[both], i, both))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            if parts[i] is None or after[i] >= len(parts) or parts[i] + parts[after[i]] != both:
                continue
            j = after[i]
            if steps is not None:
                steps.append((parts[i], parts[j]))
            parts[i], parts[j], after[i] = both, None, after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p is not None]

    def parts(self, piece: str) -> tuple[str, str] | None:
        """The two pieces whose merge makes ``piece``; none if its own text doesn't make it."""
        if piece not in self.made:
            steps: list[tuple[str, str]] = []
            whole = self.merge(piece, steps) == [piece]
            self.made[piece] = steps[-1] if whole and steps else None
            if whole and any(len(x) > 1 and (self.score[x] <= self.score[piece] or x in self.odd) for x in steps[-1]):
                self.odd.add(piece)
        return self.made[piece]

    def stays(self, a: str, b: str) -> bool:
        """Whether two tokens side by side see no merge over their border. Undoes, step by step,
        the later merge of the two (a piece scores below its parts, so the lower score is the
        later one) and looks for a merge over the border that would have come before it."""
        score, least = self.score, -np.inf
        while True:
            if score.get(a + b, -np.inf) > least:
                return False
            sa = score[a] if len(a) > 1 else np.inf
            sb = score[b] if len(b) > 1 else np.inf
            if sa == sb == np.inf:
                return True
            if sa < sb:
                least, a = sa, self.parts(a)[1]
            else:  # of equal merges the left one comes first, so one over the border precedes b's
                least, b = np.nextafter(sb, -np.inf), self.parts(b)[0]

    def valid(self, piece: str) -> bool:
        """Whether the piece's own text becomes that piece."""
        return len(piece) == 1 or self.parts(piece) is not None

    def fits(self, last: int, piece: int) -> bool:
        """Whether ``piece`` stays one token after the token ``last`` (-1: at a text's start)."""
        key = (last, piece)
        found = self.pairs.get(key)
        if found is None:
            own = self.text[piece]
            found = self.valid(own)
            if found and last >= 0:
                left = self.text[last]
                self.valid(left)
                found = self.merge(left + own) == [left, own] if {left, own} & self.odd else self.stays(left, own)
            if len(self.pairs) >= _PAIRS:
                self.pairs.clear()
            self.pairs[key] = found
        return found


def _key(*numbers: int) -> bytes:
    return array("i", numbers).tobytes()


class _Map:
    """The map of a chunk (``chunk``) or of two neighbouring stretches: state entered in to state
    left in and tokens, for the entries met so far. States stand by their keys."""

    def __init__(self, chunk: int, left: _Map | None = None, right: _Map | None = None):
        self.chunk, self.left, self.right = chunk, left, right
        self.at: dict[bytes, tuple[bytes, int]] = {}

    def value(self, entry: bytes, run: Callable[[int, bytes], tuple[bytes, int]]) -> tuple[bytes, int]:
        found = self.at.get(entry)
        if found is None:
            if self.left is None:
                found = run(self.chunk, entry)
            else:
                middle, n = self.left.value(entry, run)
                end, m = self.right.value(middle, run)
                found = end, n + m
            self.at[entry] = found
        return found


class Transducer:
    """Lazily compiled states. ``table[state, class]`` holds the next state and the count change of
    the first classes, its last column nothing; ``rare`` holds those of the others."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        chars = sorted({c for t in self.pieces.text for c in t})
        known = np.zeros(0x110000, bool)
        known[[ord(c) for c in chars]] = True
        #: Classes 0 to 3 are unknown characters of one to four bytes; others follow as met.
        self.class_of = np.full(0x110000, -1, np.int16)
        for low, high, k in ((0, 0x80, 0), (0x80, 0x800, 1), (0x800, 0x10000, 2), (0x10000, 0x110000, 3)):
            self.class_of[low:high][~known[low:high]] = k
        # the mark comes fifth: reading it leads to the same state wherever a word starts
        self.class_of[ord(SPACE_MARK)] = 4
        self.chars = [""] * 4 + [SPACE_MARK]
        self.reset()

    def reset(self) -> None:
        self.table = np.full((1024, _COMMON), -1, np.int32)
        self.rare: dict[int, int] = {}
        #: A state's key: automaton node, then last token and relative count for each of its depths.
        self.keys: list[bytes] = [_key(0, -1, 0)]
        self.number = {self.keys[0]: 0}
        self.word_start = self._next(0, 4)[0]

    def _make_room(self, *states: np.ndarray) -> None:
        """Forgets all states but those in the arrays, which get the new numbers (-1 stays)."""
        used = np.unique(np.concatenate(states))
        used = used[used >= 0]
        keys = [self.keys[i] for i in used.tolist()]
        self.reset()
        new = np.array([self._state(k) for k in keys], np.int64)
        for own in states:
            some = own >= 0
            own[some] = new[np.searchsorted(used, own[some])]

    def classes(self, codes: np.ndarray) -> np.ndarray:
        out = self.class_of[codes]
        if len(out) and out.min() < 0:
            for c in np.unique(codes[out < 0]).tolist():
                self.class_of[c] = len(self.chars)
                self.chars.append(chr(c))
            out = self.class_of[codes]
        return out

    def _state(self, key: bytes) -> int:
        found = self.number.get(key)
        if found is None:
            found = self.number[key] = len(self.keys)
            self.keys.append(key)
            if found >= len(self.table):
                tall = np.full((len(self.table) * 5 // 4, _COMMON), -1, np.int32)
                tall[: len(self.table)] = self.table
                self.table = tall
        return found

    def _next(self, state: int, kind: int) -> tuple[int, int]:
        """Compiles one transition: the state it leads to and what it adds to the count."""
        if kind < 4:
            out = (0, kind + 1)
        else:
            p, c = self.pieces, self.chars[kind]
            node, *window = array("i", self.keys[state])
            to = p.step(node, c)
            at = dict(zip(p.depths[node], zip(window[::2], window[1::2], strict=True), strict=True))
            for piece in p.ends[to]:
                last, count = at[len(p.text[piece]) - 1]
                if p.fits(last, piece):
                    break
            else:
                raise AssertionError("no token ends here")
            add = count + 1
            before = at[0][0]
            if c == SPACE_MARK and (before < 0 or not p.text[before].endswith(SPACE_MARK)):
                # no piece runs over a word start, so what stood before it is forgotten
                kept = [-1, -1] * (len(p.depths[to]) - 1)
            else:
                kept = [x for d in p.depths[to][:-1] for x in (at[d - 1][0], at[d - 1][1] - add)]
            out = (self._state(_key(to, *kept, piece, 0)), add)
        packed = (out[0] << _SHIFT) | (out[1] + _MIDDLE)
        if kind < _COMMON - 1:
            self.table[state, kind] = packed
        else:
            self.rare[state << 16 | kind] = packed
        return out

    def _packed(self, key: int) -> int:
        found = self.rare.get(key)
        if found is None:
            to, add = self._next(key >> 16, key & 65535)
            found = (to << _SHIFT) | (add + _MIDDLE)
        return found

    def run(self, classes: np.ndarray, starts: np.ndarray, ends: np.ndarray, states: np.ndarray, *kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs many stretches in step; the tokens each adds and the state each ends in. The arrays
        ``kept`` hold further states in use."""
        order = np.argsort(starts - ends, kind="stable")
        pos, length, state = starts[order], (ends - starts)[order], states[order].astype(np.int64)
        count = np.zeros(len(order), np.int64)
        live = len(order)
        for k in range(int(length[0]) if len(length) else 0):
            if max(len(self.keys), len(self.rare) >> 1) > MAX_STATES:
                self._make_room(state, *kept)
            live = int(np.searchsorted(-length[:live], -k, "left"))
            s, c = state[:live], classes[pos[:live] + k]
            v = self.table[s, np.minimum(c, _COMMON - 1)]
            if (missing := v < 0).any():
                at = np.flatnonzero(missing)
                keys, which = np.unique(s[at] << 16 | c[at], return_inverse=True)
                v[at] = np.array([self._packed(x) for x in keys.tolist()], np.int64)[which]
            state[:live] = v >> _SHIFT
            count[:live] += (v & (2 * _MIDDLE - 1)) - _MIDDLE
        out_count, out_state = np.empty_like(count), np.empty_like(state)
        out_count[order], out_state[order] = count, state
        return out_count, out_state

    def _stretch(self, maps: list[_Map], entry: bytes, run: Callable) -> tuple[bytes, int]:
        """Composes the maps of neighbouring chunks pairwise, level by level; their value at ``entry``."""
        while len(maps) > 1:
            above = []
            for left, right in zip(maps[::2], maps[1::2], strict=False):
                both = _Map(-1, left, right)
                for known in list(left.at):
                    both.value(known, run)
                above.append(both)
            maps = above + maps[len(above) * 2 :]
        return maps[0].value(entry, run)

    def count(self, t: K.Texts) -> np.ndarray:
        """Tokens of each text."""
        raw = t.buf.tobytes()
        lead = np.concatenate([[0], np.cumsum((t.buf & 0xC0) != 0x80)])
        codes = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        codes = np.where(codes == 32, ord(SPACE_MARK), codes)
        bounds = lead[t.offsets]
        # every text that isn't empty begins with one more mark
        some = np.flatnonzero(np.diff(bounds))
        codes = np.insert(codes, bounds[some], ord(SPACE_MARK))
        filled = np.diff(bounds) > 0
        bounds = bounds + np.append(0, np.cumsum(filled))
        classes = self.classes(codes)
        if not len(classes):
            return np.zeros(t.n, np.int64)
        # chunks: at every text's start and every CHUNK characters
        first = np.zeros(len(codes), bool)
        first[bounds[:-1][filled]] = True
        text_start = first.copy()
        first[::CHUNK] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(codes))
        # word starts: a mark after anything but a mark (or at a text's start)
        mark = classes == 4
        begins = mark.copy()
        begins[1:] &= ~mark[:-1] | text_start[1:]
        places = np.append(np.flatnonzero(begins), len(codes))
        body = np.minimum(places[np.searchsorted(places, starts)], ends)
        owner = np.searchsorted(bounds, starts, "right") - 1
        total = np.zeros(t.n, np.int64)
        inside = np.flatnonzero(body < ends)
        exit_ = np.full(len(starts), -1, np.int64)
        n, left = self.run(classes, body[inside] + 1, ends[inside], np.full(len(inside), self.word_start))
        exit_[inside] = left
        np.add.at(total, owner[inside], n + 1)
        alone = np.flatnonzero(body == ends)  # chunks without a word start; never a text's first
        if len(alone):
            self._alone(classes, starts, ends, np.maximum(starts - _LOOK_BACK, bounds[owner]), alone, owner, exit_, total)
        heads = np.flatnonzero((body > starts) & (body < ends))
        n, _ = self.run(classes, starts[heads], body[heads], exit_[heads - 1])
        np.add.at(total, owner[heads], n)
        return total

    def _alone(self, classes, starts, ends, back, alone, owner, exit_, total) -> None:
        """Counts the stretches of chunks without a word start, and sets the states they end in."""
        _, guess = self.run(classes, back[alone], starts[alone], np.zeros(len(alone), np.int64), exit_)
        entries = [self.keys[s] for s in guess.tolist()]
        n, left = self.run(classes, starts[alone], ends[alone], guess, exit_)
        maps = []
        for chunk, entry, state, tokens in zip(alone.tolist(), entries, left.tolist(), n.tolist(), strict=True):
            maps.append(_Map(chunk))
            maps[-1].at[entry] = (self.keys[state], tokens)

        def run(chunk: int, entry: bytes) -> tuple[bytes, int]:
            tokens, state = self.run(classes, starts[chunk : chunk + 1], ends[chunk : chunk + 1], np.array([self._state(entry)]), exit_)
            return self.keys[int(state[0])], int(tokens[0])

        cuts = np.flatnonzero(np.append(True, (np.diff(alone) > 1) | (np.diff(owner[alone]) > 0)))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(alone)], strict=True):
            state, tokens = self._stretch(maps[a:b], self.keys[int(exit_[alone[a] - 1])], run)
            total[owner[alone[a]]] += tokens
            exit_[alone[b - 1]] = self._state(state)


def token_count(text: Column, path: str) -> Column:
    """Tokens of each text under the model at ``path`` (a path that every executor has)."""

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        own = held(("counts", path), lambda: Transducer(path))
        parts = [own.count(t) for _, _, t in K.pieces(texts)]
        return pa.array(np.concatenate(parts) if parts else [], pa.int64())

    return count(text)
