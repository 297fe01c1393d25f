"""Removal of byte strings that documents with smaller ids hold, by induced suffix sorting.

A byte goes if a string of ``width`` bytes that covers it also starts in a document with a smaller
doc_id. Sorting all suffixes of the corpus would move every byte about ``width`` times, so the work
is dealt in three steps, none of which loses a string:

1. Every window of ``width`` bytes has a marker, the smallest hash of the 20-byte strings in it; equal
   windows have equal markers. Hashes of markers are grouped, and those that only one document holds
   drop out. Within a batch of documents a marker is sent once, so a passage that a third of all
   documents share sends a row for each batch and not for each document.
2. Documents take the lists of their markers that others hold too, and cut out the stretches of
   windows with such a marker. Equal stretches of a batch are sent once, for its smallest doc_id; the
   others are larger for certain, and so removed.
3. Stretches are dealt by marker, so equal windows meet in one shard. There, too, equal stretches are
   settled at once, and those whose marker no other stretch has share nothing. Of all others the
   suffixes are sorted by induction with their common prefixes (``inducedsort``), on disk where memory
   ends; neighbours that share ``width`` symbols are one group, whose smallest doc_id keeps its bytes.

Of equal texts only the one with the smallest doc_id takes part; the others are removed whole if they
have ``width`` bytes. What remains is cut from the texts in a last pass, in which only documents with
removed bytes go through Python.

Cases: null and empty texts have no bytes and the hash of nothing; a row without an id removes nothing
and loses nothing; rows with equal ids don't remove each other, also if their texts are equal; texts
shorter than ``width`` stay whole; very long texts are read in pieces that overlap; an empty table
gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, forget, materialise
from .inducedsort import encode, suffixes

_GRAM = 20
_PIECE = 1 << 18  # windows that are hashed at once
_STRETCH = 128  # windows of a stretch, at most
_BATCH = 24 << 20  # bytes of texts that are compared within a task
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_LISTED, _SEVERAL = 2, 1  # in a marker's low bits: already known as shared; sent for several documents

_SENT = pa.schema([("shard", pa.int64()), ("markers", pa.binary())])
_LISTS = pa.schema([("doc_id", pa.int64()), ("marker", pa.int32())])
_PARTS = pa.schema([("shard", pa.int64()), ("stretches", pa.binary()), ("spans", pa.binary())])
_SPANS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])
_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
_BROADCAST = 48 << 20


def pack(*columns: np.ndarray) -> bytes:
    """Columns of non-negative integers of one length, each in as few bytes a number as its greatest needs,
    byte by byte (first all lowest bytes)."""
    out = [len(columns[0]).to_bytes(4, "little")]
    for column in columns:
        width = max(1, (int(column.max(initial=0)).bit_length() + 7) // 8)
        planes = column.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
        out += [bytes([width]), planes.tobytes()]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    n, at, out = int.from_bytes(data[:4], "little"), 4, []
    while at < len(data):
        width = data[at]
        planes = np.zeros((n, 8), np.uint8)
        planes[:, :width] = np.frombuffer(data, np.uint8, n * width, at + 1).reshape(width, n).T
        out.append(planes.reshape(-1).view("<u8").astype(np.int64))
        at += 1 + n * width
    return out


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places of its rows in their order)."""
    order = np.argsort(shard, kind="stable")
    ordered = shard[order]
    begins = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))[: len(shard)]
    for a, b in zip(begins.tolist(), np.append(begins[1:], len(shard)).tolist(), strict=False):
        yield int(ordered[a]), order[a:b]


class Markers:
    """Marker hashes of a text's windows: rolling hashes by prefix sums of powers modulo 2**64, then the
    least of each window: 46 bits, as different strings with one marker only cost work, and two free ones."""

    def __init__(self, width: int, gram: int = _GRAM):
        self.width, self.gram = width, min(gram, width)
        n = _PIECE + width
        with np.errstate(over="ignore"):
            self.up = np.cumprod(np.full(n, _MULTIPLIER, np.uint64))
            self.down = np.cumprod(np.full(n, _INVERSE, np.uint64))
        self.values = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64)

    def pieces(self, text: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(first window, markers of the windows from there on)."""
        for at in range(0, len(text) - self.width + 1, _PIECE):
            yield at, self._markers(text[at : at + _PIECE + self.width - 1])

    def _markers(self, x: np.ndarray) -> np.ndarray:
        n = len(x)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[x] * self.up[:n], out=sums[1:])
        h = (sums[self.gram :] - sums[: -self.gram]) * self.down[: n - self.gram + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        span, step = self.width - self.gram + 1, 1
        while step * 2 <= span:
            h = np.minimum(h[:-step], h[step:])
            step *= 2
        if step < span:
            h = np.minimum(h[: step - span], h[span - step :])
        return (h >> np.uint64(18)) << np.uint64(2)


def _batches(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[list[tuple]]:
    """Rows of about ``_BATCH`` bytes of texts: the other columns' values, with the text as bytes."""
    rows, size = [], 0
    for batch in batches:
        forget()
        columns = [batch.column(i) if i == text else batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for row in zip(*columns, strict=True):
            data = row[text].as_buffer().to_pybytes()
            rows.append((*row[:text], data, *row[text + 1 :]))
            size += len(data)
            if size >= _BATCH:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def _mark(width: int, shards: int):
    """(doc_id, text) to the markers that a batch sends to each shard, in ascending order, with a kind in
    their low bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        markers = Markers(width)
        for rows in _batches(batches, 1):
            least: dict[bytes, int] = {}
            for doc_id, text in rows:  # equal texts of a batch are marked once
                least[text] = min(doc_id, least.get(text, doc_id))
            found, owner = [], []
            for text, doc_id in least.items():
                own = [np.unique(m) for _, m in markers.pieces(np.frombuffer(text, np.uint8))]
                own = np.unique(np.concatenate(own)) if len(own) > 1 else own[0]
                found.append(own)
                owner.append(np.full(len(own), doc_id, np.int64))
            marker, doc = np.concatenate(found), np.concatenate(owner)
            order = np.argsort(marker)
            marker, doc = marker[order], doc[order]
            begins = np.flatnonzero(np.concatenate(([True], marker[1:] != marker[:-1])))
            n = np.diff(np.append(begins, len(marker)))
            mixed = np.minimum.reduceat(doc, begins) != np.maximum.reduceat(doc, begins)
            of_several = np.repeat(mixed, n)
            sent, docs = marker[begins] | mixed.astype(np.uint64) * np.uint64(_SEVERAL), doc[begins]
            out = [(k, _sealed(sent[at], docs[at])) for k, at in _by_shard((sent >> np.uint64(2)) % np.uint64(shards))]
            if of_several.any():  # these only pass, so any shard will do
                out.append((int(sent[0] >> np.uint64(2)) % shards, _sealed(marker[of_several] | np.uint64(_LISTED), doc[of_several])))
            for a in range(0, len(out), 256):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[a : a + 256], strict=True), _SENT, strict=True)], schema=_SENT)

    return run


def _sealed(marker: np.ndarray, doc: np.ndarray) -> bytes:
    return pack(np.diff(marker, prepend=np.uint64(0)), _unsigned(doc))


def _unsigned(doc: np.ndarray) -> np.ndarray:
    """Zigzag: small numbers of either sign stay small."""
    return ((doc << 1) ^ (doc >> 63)).view(np.uint64)


def _signed(number: np.ndarray) -> np.ndarray:
    u = number.view(np.uint64)
    return (u >> np.uint64(1)).astype(np.int64) ^ -(u & np.uint64(1)).astype(np.int64)


def _low(marker: np.ndarray) -> np.ndarray:
    """The 32 bits of a marker by which a document's list holds it."""
    return ((marker >> np.uint64(2)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a part of the markers, dealt by hash: each document's markers that several documents hold."""
    markers, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for batch in batches:
        for data in batch.column(1).to_pylist():
            gaps, doc = unpack(data)
            markers.append(np.cumsum(gaps).view(np.uint64))
            docs.append(_signed(doc))
    sent, doc = np.concatenate(markers), np.concatenate(docs)
    if not len(sent):
        return
    del markers, docs
    order = np.argsort(sent)
    sent, doc = sent[order], doc[order]
    kind = sent & np.uint64(3)
    marker = sent ^ kind
    begins = np.flatnonzero(np.concatenate(([True], marker[1:] != marker[:-1])))
    n = np.diff(np.append(begins, len(marker)))
    known = np.logical_or.reduceat(kind == _SEVERAL, begins) | (np.minimum.reduceat(doc, begins) != np.maximum.reduceat(doc, begins))
    out = np.flatnonzero((np.repeat(known, n) & (kind == 0)) | (kind == _LISTED))  # of a marker that stands for several, all are listed
    low, doc = _low(marker[out]).view(np.int32), doc[out]
    for a in range(0, len(out), 1 << 17):
        yield pa.RecordBatch.from_arrays([pa.array(doc[a : a + (1 << 17)]), pa.array(low[a : a + (1 << 17)])], schema=_LISTS)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(start, end) pairs as the maximal runs that they cover together."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            if end > out[-1][1]:
                out[-1] = out[-1][0], end
        else:
            out.append((start, end))
    return out


def _seal_stretches(parts: list[tuple]) -> bytes:
    """(marker, doc_id, key, starts, stretch) rows: numbers packed, stretches compressed together."""
    marker, doc, key, starts, stretch = zip(*parts, strict=True)
    numbers = pack(
        np.array(marker, np.uint64), _unsigned(np.array(doc, np.int64)), np.array([0 if k is None else k + 1 for k in key], np.uint64),
        np.array([len(s) for s in starts], np.uint64), np.array([len(s) for s in stretch], np.uint64),
    )
    places = pack(np.array([a for s in starts for a in s], np.uint64))
    return b"".join([len(numbers).to_bytes(4, "little"), len(places).to_bytes(4, "little"), numbers, places, zlib.compress(b"".join(stretch), 1)])


def _open_stretches(data: bytes) -> Iterator[tuple]:
    a = 8 + int.from_bytes(data[:4], "little")
    b = a + int.from_bytes(data[4:8], "little")
    marker, doc, key, n, size = unpack(data[8:a])
    (places,) = unpack(data[a:b])
    places, text, p, t = places.tolist(), zlib.decompress(data[b:]), 0, 0
    for m, d, k, i, j in zip(marker.tolist(), _signed(doc).tolist(), key.tolist(), n.tolist(), size.tolist(), strict=True):
        yield m, d, k - 1 if k else None, places[p : p + i], text[t : t + j]
        p, t = p + i, t + j


def _cut(width: int, shards: int):
    """(doc_id, key, text, markers) to a batch's stretches, each once, by shard, and to the spans of its
    repeats."""

    def stretches(markers: Markers, text: bytes, wanted: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(marker, start, end) of runs of windows with one wanted marker."""
        for at, m in markers.pieces(np.frombuffer(text, np.uint8)):
            begins = np.flatnonzero(np.concatenate(([True], m[1:] != m[:-1])))
            ends = np.append(begins[1:], len(m))
            low = _low(m[begins])
            keep = wanted[np.minimum(np.searchsorted(wanted, low), len(wanted) - 1)] == low
            for marker, a, b in zip(m[begins][keep].view(np.int64).tolist(), begins[keep].tolist(), ends[keep].tolist(), strict=True):
                for c in range(a, b, _STRETCH):
                    yield marker, at + c, at + min(c + _STRETCH, b) + width - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        markers = Markers(width)
        for rows in _batches(batches, 2):
            rows.sort(key=lambda r: r[0])
            seen: dict[bytes, tuple[int, int, list[int], int]] = {}
            repeats: dict[tuple[int, int], list[tuple[int, int]]] = {}
            parts: list[tuple] = []
            for doc_id, key, text, listed in rows:
                for marker, a, b in stretches(markers, text, np.unique(np.array(listed, np.int32).view(np.uint32))):
                    part = text[a:b]
                    if (known := seen.get(part)) is None:
                        seen[part] = doc_id, key, [a], marker
                    elif known[:2] == (doc_id, key):
                        known[2].append(a)
                    elif known[0] < doc_id:
                        repeats.setdefault((doc_id, key), []).append((a, b))
                    else:  # another text with the smallest id: it is judged like the first
                        parts.append((marker, doc_id, key, [a], part))
            parts += [(marker, d, k, starts, part) for part, (d, k, starts, marker) in seen.items()]
            known = [(d, 0 if k is None else k + 1, *span) for (d, k), spans in repeats.items() for span in _merged(spans)]
            del seen, repeats
            if known:  # these only pass, so any shard will do
                d, k, a, b = (np.array(c, np.int64) for c in zip(*known, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([known[0][2] % shards]), pa.array([None], pa.binary()), pa.array([pack(_unsigned(d), k, a, b)])], schema=_PARTS)
            if parts:
                for shard, at in _by_shard((np.array([p[0] for p in parts], np.int64) >> 2) % shards):
                    sealed = _seal_stretches([parts[i] for i in at.tolist()])
                    yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([sealed]), pa.array([None], pa.binary())], schema=_PARTS)

    return run


def groups(pieces: Iterator[tuple[np.ndarray, np.ndarray]], width: int) -> Iterator[np.ndarray]:
    """Of suffixes with common prefixes: the places of each maximal run that shares ``width`` symbols."""
    open_: list[np.ndarray] = []
    for places, common in pieces:
        same = common >= width
        cuts = np.flatnonzero(~same)
        if not len(cuts):
            open_.append(places)
            continue
        if cuts[0] or open_:
            open_.append(places[: cuts[0]])
            if sum(map(len, open_)) > 1:
                yield np.concatenate(open_)
        ends = np.append(cuts[1:], len(places))
        runs = ends - cuts > 1
        for a, b in zip(cuts[:-1][runs[:-1]].tolist(), ends[:-1][runs[:-1]].tolist(), strict=True):
            yield places[a:b]
        open_ = [places[cuts[-1] :]]
    if sum(map(len, open_)) > 1:
        yield np.concatenate(open_)


def _removed(width: int, memory: int):
    """Stretches of a shard to the spans that go; spans of repeats pass."""

    def settle(batches: Iterator[pa.RecordBatch], out: _Spans) -> dict[bytes, list[tuple]]:
        """Each different stretch with its occurrences in the smallest document."""
        own: dict[bytes, list[tuple]] = {}
        rows = ((sealed, spans) for batch in batches for sealed, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
        for sealed, spans in rows:
            if spans is not None:
                doc, *rest = unpack(spans)
                for d, k, a, b in zip(_signed(doc).tolist(), *[c.tolist() for c in rest], strict=True):
                    out.add(d, k - 1 if k else None, a, b)
                continue
            for marker, doc, key, starts, part in _open_stretches(sealed):
                known = own.get(part)
                if known is None or doc < known[0][1]:
                    own[part] = [(marker, doc, key, starts)]
                    gone = known or ()
                elif doc == known[0][1]:
                    known.append((marker, doc, key, starts))
                    continue
                else:
                    gone = [(marker, doc, key, starts)]
                for _, d, k, at in gone:
                    for a in at:
                        out.add(d, k, a, a + len(part))
        return own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        out = _Spans()
        own = settle(batches, out)
        several = Counter(rows[0][0] for rows in own.values())
        strings = _sharing([part for part, rows in own.items() if several[rows[0][0]] > 1], width)
        if strings:
            doc = np.array([own[s][0][1] for s in strings], np.int64)
            begin = np.cumsum([0, *[len(s) + 1 for s in strings]])[:-1]
            text = encode(strings)
            gone = np.zeros(len(text), bool)  # windows, by the place of their first byte
            for places, first in _grouped(suffixes(text, width, memory), width):
                of = doc[np.searchsorted(begin, places, "right") - 1]
                n = np.diff(np.append(first, len(places)))
                gone[places[of > np.repeat(np.minimum.reduceat(of, first), n)]] = True
            at = np.flatnonzero(gone)
            in_ = np.searchsorted(begin, at, "right") - 1
            a = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (in_[1:] != in_[:-1]))))[: len(at)]
            b = np.append(a[1:], len(at))[: len(a)] - 1
            for i, start, end in zip(in_[a].tolist(), (at[a] - begin[in_[a]]).tolist(), (at[b] - begin[in_[b]]).tolist(), strict=True):
                for _, d, k, starts in own[strings[i]]:
                    for s in starts:
                        out.add(d, k, s + start, s + end + width)
        yield from out.batches()

    return run


def _sharing(strings: list[bytes], width: int) -> list[bytes]:
    """Those with a window whose hash another of their windows or strings has; the rest share nothing."""
    if len(strings) < 2:
        return strings
    hashes = Markers(width, width)
    found, owner = [], []
    some, begins, size = [], [], 0
    for i, s in enumerate(strings):
        some.append(s)
        begins.append(i)
        size += len(s)
        if size >= _PIECE or i == len(strings) - 1:
            lengths = np.array([len(x) for x in some])
            string = np.repeat(np.array(begins), lengths)
            left = np.cumsum(lengths)[string - begins[0]] - np.arange(size)  # symbols from here to the string's end
            whole = np.concatenate([h for _, h in hashes.pieces(np.frombuffer(b"".join(some), np.uint8))])
            inside = np.flatnonzero(left[: len(whole)] >= width)
            found.append(whole[inside])
            owner.append(string[inside])
            some, begins, size = [], [], 0
    h, of = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(h)
    h = h[order]
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = h[1:] == h[:-1]
    keep = np.unique(of[order[same[1:] | same[:-1]]])
    return [strings[i] for i in keep.tolist()]


class _Spans:
    """Spans by document, merged before they leave the task."""

    def __init__(self):
        self.of: dict[tuple, list[tuple[int, int]]] = {}

    def add(self, doc: int, key: int | None, start: int, end: int) -> None:
        self.of.setdefault((doc, key), []).append((start, end))

    def batches(self) -> Iterator[pa.RecordBatch]:
        rows = ((*d, *span) for d, spans in self.of.items() for span in _merged(spans))
        while some := list(islice(rows, 1 << 16)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), _SPANS, strict=True)], schema=_SPANS)


def _grouped(pieces: Iterator[tuple[np.ndarray, np.ndarray]], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups in large pieces: places, and where each group begins in them."""
    held: list[np.ndarray] = []
    size = 0
    for places in groups(pieces, width):
        held.append(places)
        size += len(places)
        if size >= 1 << 18:
            yield np.concatenate(held), np.cumsum([0, *map(len, held)])[:-1]
            held, size = [], 0
    if held:
        yield np.concatenate(held), np.cumsum([0, *map(len, held)])[:-1]


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans) to what remains."""
    for batch in batches:
        forget()
        rows = []
        for doc_id, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            data = text.as_buffer()
            cut = _merged(list(zip(*[spans.values.field(i).to_pylist() for i in range(2)], strict=True)))
            rest, at = hashlib.sha256(), 0
            for a, b in cut:
                rest.update(data[at:a])
                at = b
            rest.update(data[at : data.size])
            rows.append((doc_id, data.size, sum(b - a for a, b in cut), len(cut), rest.hexdigest()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _KEPT, strict=True)], schema=_KEPT)


def _key(text: Column) -> Column:
    """Tells the texts of one doc_id apart."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _with_keys(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).withColumn("key", _key(F.col("text")))


def removed_spans(rows: DataFrame, owners: DataFrame, parts: int, width: int, memory: int) -> DataFrame:
    """doc_id, key and spans (start and end in bytes, maximal) of every text of ``owners``
    (doc_id, key, several: other texts have the id too) that loses bytes; key is null unless ``several``."""
    shards = 4 * parts
    sent = rows.select("doc_id", "text").mapInArrow(_mark(width, shards), "shard long, markers binary")
    shared = sent.repartition(parts, "shard").mapInArrow(_shared, "doc_id long, marker int")
    lists = shared.groupBy("doc_id").agg(F.collect_list("marker").alias("markers")).join(owners, "doc_id")
    key = F.when(F.col("several"), F.col("key")).alias("key")
    cut = rows.join(lists, ["doc_id", "key"]).select("doc_id", key, "text", "markers").mapInArrow(_cut(width, shards), "shard long, stretches binary, spans binary")
    spans = cut.repartition(parts, "shard").mapInArrow(_removed(width, memory), "doc_id long, key long, start int, end int")
    grouped = spans.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return grouped.mapInArrow(_join_spans, grouped.schema)


def _join_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's spans as maximal runs."""
    for batch in batches:
        spans = [[{"start": a, "end": b} for a, b in _merged([(x["start"], x["end"]) for x in one])] for one in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, batch.schema.field(2).type)], schema=batch.schema)


def remove_repeats(docs: DataFrame, width: int = 50, memory: int = 64 << 20, part_bytes: int = 12 << 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 (hex, of the remaining
    bytes) of every row of ``docs`` (doc_id, text). ``memory``: bytes of a shard's queues before they
    go to disk. ``part_bytes``: bytes of texts for each shard."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = _with_keys(docs)
    long_enough = rows.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= width))
    ids = materialise(long_enough.select("doc_id", "key", F.unhex(F.md5("text")).alias("whole"), F.octet_length("text").cast("long").alias("size")))
    n_bytes = ids.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // part_bytes))
    texts = materialise(ids.groupBy("whole").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last"), F.first("key").alias("key")))
    several = ids.groupBy("doc_id").agg((F.min("key") != F.max("key")).alias("several"))
    owners = texts.select("doc_id", "key").join(several, "doc_id")
    copied = texts.where("last > doc_id").select("whole", F.col("doc_id").alias("first"))
    copies = ids.join(copied, "whole").where("doc_id > first").select("doc_id", "key").distinct()
    spans = removed_spans(long_enough, owners, parts, width, memory)
    touched = materialise(spans.union(copies.withColumn("spans", F.lit(None).cast("array<struct<start: int, end: int>>"))))
    # how much of it would be broadcast is summed, not guessed
    size = touched.agg(F.coalesce(F.sum(F.greatest(F.size("spans"), F.lit(0)) * 16 + 64), F.lit(0))).first()[0]
    side = F.broadcast if size <= _BROADCAST else (lambda df: df)
    found = touched.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "spans", F.col("spans").isNotNull().alias("cut"))
    same = (F.col("doc_id") == F.col("_id")) & (F.octet_length("text") >= width) & (F.col("_key").isNull() | (F.col("_key") == F.col("key")))
    whole = rows.join(side(found.drop("spans")), same, "left").where("cut is null or not cut")
    n, gone = F.octet_length("text").cast("long"), F.col("cut").isNotNull()
    hash_ = F.when(gone, F.sha2(F.lit(b""), 256)).otherwise(F.sha2("text", 256))
    native = whole.select("doc_id", n.alias("n_bytes"), F.when(gone, n).otherwise(0).alias("n_removed"), gone.cast("long").alias("n_spans"), hash_.alias("kept_sha256"))
    partly = rows.join(side(found.where("cut")), same).select("doc_id", "text", "spans")
    return native.union(partly.mapInArrow(_keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
