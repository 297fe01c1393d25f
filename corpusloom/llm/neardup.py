"""Near-duplicate detection by BagMinHash signatures of word shingles.

A text is the multiset of its five-word shingles. The weights that a shingle may have are laid out
in dyadic ranges (0,1], (1,2], (2,4], ...; over each range runs a Poisson process with a rate equal
to the range's width, and each of its points has an arrival time and a register. A shingle of weight
w takes the points below w: a range that lies below w gives its first point as it is; a range that
w cuts is halved, one half (by a hash) inheriting the first point and the other drawing a later
one, until the halves lie on one side of w. Later points of a range come from its halves in the
same way, down to single weights. So the points of a weight are the same whatever the shingle's
own weight is. Each register keeps the earliest arrival, and two texts agree in a register with a
probability equal to their weighted Jaccard similarity. A range is left as soon as its next point is
later than every register, which is after one or two points for most shingles.

Registers are banded; texts that share a band are compared with a few leads of the band (its least
texts in several hashed orders), so a band costs a number of comparisons in proportion to its
size. A comparison looks at one byte of every register first, then, if the estimate isn't
``margin`` below the threshold (six deviations), at the exact multisets. Components of the
links are found by star contraction. Where a band then still spans several components, every
member outside its largest component is compared with blocks of all its members from other
components, by an upper bound of the similarity from 16-bit shingle hashes and then exactly, so no
link between band mates is lost.

Equal texts are one node from the start, counted before any shuffle, so large groups of copies
cost no pairs. Texts are fetched only for nodes that share a band.

Cases: a text of one to four words is one shingle; texts without a word (empty or white space)
match exact copies only; a null text is alone; repeated rows fall into one class; an empty table
gives no rows. The class id is its smallest doc_id, or null where all its ids are; rows that share
an id and not a text may stand in different classes of that same id, which ``classes`` tells apart
by ``root``. Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import bound_batches, forget, join_counted, materialise, small, text_key


@dataclass(frozen=True)
class Settings:
    words: int = 5
    similarity: float = 0.8
    bands: int = 24
    band_rows: int = 6
    leads: int = 4
    margin: float = 0.2
    block: int = 64


_U = np.uint64


def shingles(t: K.Texts, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: text, hash and count, ordered by text."""
    starts, ends = t.spans(K.SPACE)
    bounds, owner = t.per_text(starts)
    h = t.hashes(starts, ends)
    n = np.diff(bounds)
    texts, found = [], []
    if len(h) >= words:
        at = np.flatnonzero(owner[: len(h) - words + 1] == owner[words - 1 :])
        texts.append(owner[at])
        found.append(K.window_hashes(h, words)[at])
    for k in range(1, words):
        short = np.flatnonzero(n == k)
        if len(short):
            texts.append(short)
            found.append(K.window_hashes(h, k)[bounds[short]])
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64)
    text, h = np.concatenate(texts), np.concatenate(found)
    count, first = K.counts_of_equal(K.salted(h, text))
    text, h, count = text[first], h[first], count[first]
    order = np.argsort(text, kind="stable")
    return text[order], h[order], count[order]


def bag_signatures(text: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """Earliest arrivals (texts, registers); infinite for texts without a shingle."""
    best = np.full(n * registers, np.inf)
    parts = [(text, h, weight, np.zeros(len(h), np.int64))]
    level = 1
    while True:  # the ranges (2^(level-1), 2^level] that a weight reaches into
        at = np.flatnonzero(weight > (1 << (level - 1)))
        if not len(at):
            break
        parts.append((text[at], h[at], weight[at], np.full(len(at), level)))
        level += 1
    text, h, weight, level = (np.concatenate(x) for x in zip(*parts, strict=True))
    width = np.maximum(1, 1 << np.maximum(level - 1, 0))
    low = np.where(level > 0, width, 0)
    with np.errstate(over="ignore"):
        seed = K.mix(h + level.astype(_U) * _U(0xBF58476D1CE4E5B9))
    wide = np.flatnonzero(width > 1)
    if len(wide):  # down to single weights, which join those of the ranges of width 1
        leaves = _split(best, registers, n, *(v[wide] for v in (text, weight, low, width, seed)))
    one = np.flatnonzero(width == 1)
    text, seed, x = text[one], seed[one], np.zeros(len(one))
    if len(wide):
        text, seed, x = (np.concatenate(v) for v in zip((text, seed, x), leaves, strict=True))
    step = np.zeros(len(text), np.int64)
    while len(text):
        points = int(np.clip(100_000 // len(text), 1, 64))
        t = (step[:, None] + np.arange(points)).astype(_U)
        with np.errstate(over="ignore"):
            r = K.mix(seed[:, None] + t * _U(0x9E3779B97F4A7C15))
        arrival = x[:, None] + np.cumsum(_exponential(r), axis=1)
        np.minimum.at(best, (text[:, None] * registers + _register(r, registers)).ravel(), arrival.ravel())
        x, step = arrival[:, -1], step + points
        live = x < best.reshape(n, registers).max(1)[text]
        text, seed, x, step = (v[live] for v in (text, seed, x, step))
    return best.reshape(n, registers)


def _exponential(r: np.ndarray) -> np.ndarray:
    """Exponential waiting times of rate 1 from random words."""
    return -np.log(((r >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53)


def _register(r: np.ndarray, registers: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (K.mix(r + _U(0xD1B54A32D192ED03)) & _U(0xFFFFFFFF)).astype(np.int64) % registers


def _split(best: np.ndarray, registers: int, n: int, text: np.ndarray, weight: np.ndarray, low: np.ndarray, width: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Halves ranges level by level; puts the first points of those below the weight into ``best``.
    Returns the single weights left: their text, seed and latest point."""
    x, place = _exponential(seed) / width, _register(seed, registers)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(text):
        inside = low + width <= weight
        np.minimum.at(best, text[inside] * registers + place[inside], x[inside])
        live = x < best.reshape(n, registers).max(1)[text]
        text, weight, low, width, seed, x, place = (v[live] for v in (text, weight, low, width, seed, x, place))
        single = width == 1
        out.append((text[single], seed[single], x[single]))
        text, weight, low, width, seed, x, place = (v[~single] for v in (text, weight, low, width, seed, x, place))
        half = width >> 1
        with np.errstate(over="ignore"):
            upper = (K.mix(seed ^ _U(0xA0761D6478BD642F)) >> _U(63)).astype(bool)  # the half that inherits the point
            seeds = [K.mix(seed + _U(0x9E3779B97F4A7C15)), K.mix(seed + _U(0xE7037ED1A0B428DB))]
        halves = []
        for k in range(2):
            heir = upper if k else ~upper
            start = np.where(heir, x, x + _exponential(seeds[k]) / half)
            halves.append((text, weight, low + k * half, half, seeds[k], start, np.where(heir, place, _register(seeds[k], registers))))
        text, weight, low, width, seed, x, place = (np.concatenate(v) for v in zip(*halves, strict=True))
        reach = low < weight
        text, weight, low, width, seed, x, place = (v[reach] for v in (text, weight, low, width, seed, x, place))
    return tuple(np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0))


def band_hashes(signatures: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit hash per band: (texts, bands)."""
    bits = np.ascontiguousarray(signatures).view(_U).reshape(len(signatures), bands, -1)
    with np.errstate(over="ignore"):
        h = np.broadcast_to(np.arange(bands, dtype=_U) * _U(0x9E3779B97F4A7C15), bits.shape[:2]).copy()
        for k in range(bits.shape[2]):
            h = K.mix(h * _U(0x100000001B3) + bits[:, :, k])
    return h.view(np.int64)


def register_bytes(signatures: np.ndarray) -> np.ndarray:
    """One byte of each register: equal registers have equal bytes, others by chance 1 in 256."""
    return (K.mix(np.ascontiguousarray(signatures).view(_U)) & _U(255)).astype(np.uint8)


def agreement(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Estimated similarity from register bytes, along the last axis."""
    return ((left == right).mean(-1) - 1 / 256) / (1 - 1 / 256)


def _sketch_column(settings: Settings):
    @F.arrow_udf("struct<bands:array<bigint>,sketch:binary>")
    def sketch(texts: pa.Array) -> pa.Array:
        forget()
        values, lengths, sketches = [], [], []
        for _, _, t in K.pieces(texts):
            text, h, count = shingles(t, settings.words)
            some = np.zeros(t.n, bool)
            some[text] = True
            row = np.cumsum(some) - 1
            n = int(some.sum())
            if n:
                sig = bag_signatures(row[text], h, count, n, settings.bands * settings.band_rows)
                values.append(band_hashes(sig, settings.bands).ravel())
                own = iter(register_bytes(sig))
                sketches += [next(own).tobytes() if x else b"" for x in some]
            else:
                sketches += [b""] * t.n
            lengths.append(np.where(some, settings.bands, 0))
        offsets = np.append(0, np.cumsum(np.concatenate(lengths) if lengths else []))
        bands = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(values) if values else [], pa.int64()))
        return pa.StructArray.from_arrays([bands, pa.array(sketches, pa.binary())], names=["bands", "sketch"])

    return sketch


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _likely_column(settings: Settings):
    width, least = settings.bands * settings.band_rows, settings.similarity - settings.margin

    @F.arrow_udf("boolean")
    def likely(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array(agreement(_matrix(left, width), _matrix(right, width)) >= least)

    return likely


def _short_hashes(words: int):
    """A text's shingles as 16-bit hashes; equal shingles of one text are told apart by a number."""

    @F.arrow_udf("binary")
    def short(texts: pa.Array) -> pa.Array:
        out: list[bytes] = []
        for _, _, t in K.pieces(texts):
            text, h, count = shingles(t, words)
            at = np.repeat(np.arange(len(h)), count)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
            with np.errstate(over="ignore"):
                own = (K.mix(h[at] + nth.astype(_U) * _U(0xD6E8FEB86659FD93)) >> _U(48)).astype(np.uint16)
            bounds = np.searchsorted(text[at], np.arange(t.n + 1))
            out += [own[i:j].tobytes() for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        return pa.array(out, pa.binary())

    return short


def _block_column(similarity: float):
    """Pairs from two blocks of members, in different components, that may be similar enough."""

    @F.arrow_udf("array<struct<a:binary,b:binary>>")
    def mates(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left, right, strict=True):
            found = []
            keys, roots = y.values.field("key").to_pylist(), np.array(y.values.field("root").to_pylist(), object)
            sets = y.values.field("short").to_pylist()
            size = np.array([len(v) // 2 for v in sets])
            ids, starts = np.frombuffer(b"".join(sets), np.uint16), np.cumsum(size) - size
            for key, root, own in zip(x.values.field("key").to_pylist(), x.values.field("root").to_pylist(), x.values.field("short").to_pylist(), strict=True):
                flag = np.zeros(65536, bool)
                flag[np.frombuffer(own, np.uint16)] = True
                n = len(own) // 2
                most = np.minimum(np.add.reduceat(flag[ids], starts, dtype=np.int64), n)
                for i in np.flatnonzero((most >= similarity * (n + size - most) - 1e-9) & (roots != root)).tolist():
                    found.append({"a": min(key, keys[i]), "b": max(key, keys[i])})
            out.append(found)
        return pa.array(out, pa.list_(pa.struct([("a", pa.binary()), ("b", pa.binary())])))

    return mates


def _similarity_column(words: int):
    @F.arrow_udf("double")
    def similarity(left: pa.Array, right: pa.Array) -> pa.Array:
        forget()
        out: list[np.ndarray] = []
        n = len(left)
        for a in range(0, n, 256):
            both = [shingle_table(x.slice(a, 256), words) for x in (left, right)]
            out.append(bag_jaccard(both[0], both[1], min(256, n - a)))
        return pa.array(np.concatenate(out) if out else [], pa.float64())

    return similarity


def shingle_table(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = [(a + text, h, count) for a, _, t in K.pieces(texts) for text, h, count in [shingles(t, words)]]
    return tuple(np.concatenate(x) for x in zip(*rows, strict=True))


def bag_jaccard(left, right, n: int) -> np.ndarray:
    """Sum of the lesser counts over sum of the greater ones, for each of ``n`` pairs of texts."""
    text = np.concatenate([left[0], right[0]])
    code, kinds = pd.factorize(K.salted(np.concatenate([left[1], right[1]]), text))
    cut = len(left[0])
    a, b = np.zeros(len(kinds), np.int64), np.zeros(len(kinds), np.int64)
    a[code[:cut]], b[code[cut:]] = left[2], right[2]
    owner = np.zeros(len(kinds), np.int64)
    owner[code] = text
    low, high = np.bincount(owner, np.minimum(a, b), n), np.bincount(owner, np.maximum(a, b), n)
    return np.divide(low, high, out=np.zeros(n), where=high > 0)


def components(edges: DataFrame) -> DataFrame:
    """Star contraction: ``edges`` (a, b) to (node, root) for every node of an edge; the root is
    the component's least node. Neighbours are never gathered, only their minimum is."""
    e = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e = materialise(large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct())
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())


def _texts_of(keys: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """One text for each key: that of its smallest doc_id, once even if rows repeat."""
    wanted = materialise(keys.join(nodes.select("key", "doc_id"), "key").select(F.col("key").alias("of"), F.col("doc_id").alias("first")))
    own = docs.select(text_key(F.col("text")).alias("key"), "doc_id", "text")
    same = (F.col("key") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("first"))
    return materialise(own.join(small(wanted, wanted.count()), same).select("key", "text").dropDuplicates(["key"]))


def _linked(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) of nodes whose exact multisets are similar enough."""
    texts = _texts_of(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), docs, nodes)
    left = texts.select(F.col("key").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("key").alias("b"), F.col("text").alias("right"))
    compared = pairs.join(left, "a").join(right, "b").select("a", "b", _similarity_column(settings.words)("left", "right").alias("similarity"))
    return materialise(compared.where(F.col("similarity") >= settings.similarity).select("a", "b"))


def _across(open_: DataFrame, docs: DataFrame, nodes: DataFrame, known: DataFrame, settings: Settings) -> DataFrame:
    """Pairs (a, b) of members of one band in different components that may be similar enough and
    aren't ``known``: whoever is outside the band's largest component, with all its members."""
    texts = _texts_of(open_.select("key").distinct(), docs, nodes)
    open_ = open_.join(texts.select("key", _short_hashes(settings.words)("text").alias("short")), "key")
    part = F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / settings.block)).alias("part")
    blocks = [
        rows.groupBy("band", part).agg(F.collect_list(F.struct("key", "root", "short")).alias(name)).drop("part")
        for rows, name in ((open_.where("root <> largest"), "left"), (open_, "right"))
    ]
    pairs = blocks[0].join(blocks[1], "band").select(F.explode(_block_column(settings.similarity)("left", "right")).alias("p")).select("p.*").distinct()
    return materialise(pairs.join(known, ["a", "b"], "left_anti"))


def _rerooted(placed: DataFrame, links: DataFrame) -> DataFrame:
    """``placed`` (key, root and others) after ``links`` (a, b) between keys of different components:
    only the roots that they join are contracted, not all links again. A root is its component's
    least key, so the least of joined roots is the least key of all."""
    if links.isEmpty():
        return placed
    at = placed.select("key", "root")
    ends = links.join(at.toDF("a", "x"), "a").join(at.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    higher = materialise(components(ends).select(F.col("node").alias("root"), F.col("root").alias("higher")))
    moved = placed.join(small(higher, higher.count()), "root", "left")
    return materialise(moved.select(*[F.coalesce("higher", "root").alias("root") if c == "root" else c for c in placed.columns]))


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id and class_id of every row of ``docs`` (doc_id, text)."""
    return classes(docs, settings).select("doc_id", "class_id")


def classes(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, key (of the text; null for null), root (the least key of the row's class), class_id
    and best (doc_id and key of the row that stands for the class: the smallest id, nulls last)."""
    bound_batches(docs.sparkSession)
    text = F.col("text")
    rows = materialise(docs.select("doc_id", text_key(text).alias("key"), _sketch_column(settings)(text).alias("s")).select("doc_id", "key", "s.*"))
    nodes = rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first(F.struct("bands", "sketch")).alias("s"), F.count("*").alias("copies"))
    nodes = materialise(nodes.select("key", "doc_id", "copies", "s.*"))
    sketches = nodes.select("key", "sketch")
    placed = nodes.select("key", F.explode("bands").alias("band"))
    leads = F.array(*[F.min_by("key", F.xxhash64("key", F.lit(i))) for i in range(settings.leads)])
    shared = placed.groupBy("band").agg(F.array_distinct(leads).alias("leads"), F.count("*").alias("n")).where("n > 1")
    members = materialise(placed.join(shared, "band"))
    stars = members.select("key", F.explode("leads").alias("lead")).where("key <> lead").select(F.least("key", "lead").alias("a"), F.greatest("key", "lead").alias("b")).distinct()
    stars = stars.join(sketches.select(F.col("key").alias("a"), F.col("sketch").alias("left")), "a").join(sketches.select(F.col("key").alias("b"), F.col("sketch").alias("right")), "b")
    stars = materialise(stars.where(_likely_column(settings)("left", "right")).select("a", "b"))
    links = _linked(stars, docs, nodes, settings)
    roots = components(links).select(F.col("node").alias("key"), "root")
    placed = nodes.select("key", "doc_id", "copies").join(roots, "key", "left")
    placed = materialise(placed.select("key", "doc_id", "copies", F.coalesce("root", "key").alias("root")))
    # bands that still span several components: whoever is outside the largest is compared in blocks
    at = materialise(members.select("band", "key", "n").join(placed.select("key", "root"), "key").select("band", "key", "n", "root"))
    sizes = at.groupBy("band", "root").agg(F.count("*").alias("size"))
    split = sizes.groupBy("band").agg(F.max_by("root", F.struct("size", "root")).alias("largest"), F.count("*").alias("roots")).where("roots > 1").select("band", "largest")
    open_ = materialise(at.join(split, "band"))
    if not open_.isEmpty():
        across = _across(open_, docs, nodes, stars, settings)
        if not across.isEmpty():
            placed = _rerooted(placed, _linked(across, docs, nodes, settings))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "key")).alias("best")
    of = placed.join(placed.groupBy("root").agg(best), "root").select("key", F.col("copies").alias("n"), "root", F.struct("best.doc_id", "best.key").alias("best"))
    of = materialise(of)
    out = join_counted(rows.select("doc_id", "key"), of, nodes.agg(F.sum("copies")).first()[0] or 0)
    return out.select("doc_id", "key", "root", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("class_id"), "best")


def deduplicate(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest doc_id (nulls last), of equal ids
    that of the least text key, of repeated rows any one; rows without a text all stay."""
    found = materialise(classes(docs, settings))
    alike = found.where("key is not null").groupBy("doc_id", "key").agg(F.count("*").alias("n"), F.first("best").alias("best"))
    alike = alike.select("doc_id", "key", "n", (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("key") == F.col("best.key"))).alias("stays"))
    alike = materialise(alike.where("not stays or n > 1").select(F.col("doc_id").alias("id"), F.col("key").alias("of"), "stays"))
    same = F.col("d.doc_id").eqNullSafe(F.col("id")) & (F.col("k") == F.col("of"))
    own = docs.select(F.struct(*docs.columns).alias("d"), text_key(F.col("text")).alias("k"))
    kept = own.join(small(gone := alike.where("not stays"), gone.count()), same, "left_anti")
    many = alike.where("stays")
    if (n := many.count()) > 0:  # repeated rows of one id and text
        repeated = kept.join(small(many, n), same, "left_semi").dropDuplicates(["k"])
        kept = kept.join(small(many, n), same, "left_anti").union(repeated)
    return kept.select("d.*")
