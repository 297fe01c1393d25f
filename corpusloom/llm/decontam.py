"""Benchmark decontamination by latent semantic retrieval.

1. Terms are the alphanumeric words of the benchmark, lower-cased. Every document is written once as
   its words' term numbers, which all later passes read. Document frequencies are counted over all
   documents, for all items in one pass.
2. A randomised singular value decomposition of the TF-IDF passages gives a latent space: a
   Gaussian sketch of ``rank`` and ``oversample`` columns is multiplied by the passages and their
   transpose, on the executors, for a few power iterations, between which the driver
   orthogonalises it; the eigenvectors of the small matrix that the last product leaves turn it
   into the ``rank`` strongest right singular vectors. The passages are the benchmark's and those of
   all documents, of the lesser weight ``sample_weight``, and together of no more than ``fit_docs``
   documents have on average, so that the items shape the space however many documents there are.
3. Every passage (a window of ``window`` words, one every half window) of every document is embedded
   and compared with every item by cosine. Passages whose benchmark terms weigh too little to
   cover any item are skipped first.
4. A candidate region that holds enough of the item's terms is checked word by word: the longest
   common subsequence with the item, by words and by IDF weight, must cover most of the item; where
   it covers less (a paraphrase), the item's answer (its last sentence) must be covered too.

Items are handled in blocks of at most ``items_per_rank`` times ``rank``, so that the space has room
for a block's items. Items of which it holds less than the share ``held`` of their norm are searched
in further blocks of at most ``rank`` items, whose own span is the space and holds them whole. One
pass over the documents fits or searches as many blocks as ``pass_bytes`` of broadcast hold.

Cases: null or empty texts hold no passage; items of fewer than ``least_words`` words are no
evidence and never match; repeated items each give a row; an empty benchmark gives no rows; columns
other than doc_id, item_id and text play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import bound_batches, forget, materialise, small


@dataclass(frozen=True)
class Settings:
    window: int = 32
    rank: int = 128
    oversample: int = 16
    sample_weight: float = 0.1
    iterations: int = 2
    fit_docs: int = 500
    least_words: int = 8
    cosine: float = 0.35
    cover: float = 0.7
    paraphrase: float = 0.5
    answer: float = 0.4
    pass_bytes: int = 64 << 20
    items_per_rank: int = 4
    held: float = 0.4
    seed: int = 11


def terms_of(t: K.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the alphanumeric words, their text bounds, and where each begins and ends."""
    low = t.lowered()
    starts, ends = low.spans(K.NOT_ALNUM)
    bounds, _ = low.per_text(starts)
    return low.hashes(starts, ends), bounds, starts, ends


@dataclass
class Items:
    """A block of the benchmark: term ids of every item, and where its answer begins."""

    ids: list[int]
    words: list[np.ndarray]
    answers: list[int]
    vocabulary: np.ndarray  # sorted hashes
    idf: np.ndarray | None = None
    basis: np.ndarray | None = None  # terms x rank
    among: np.ndarray | None = None  # the terms' ids in the whole benchmark, sorted, if this is a block of it

    def part(self, at: np.ndarray) -> Items:
        """The items at these places, with the same terms and the same space."""
        return replace(self, ids=[self.ids[i] for i in at], words=[self.words[i] for i in at], answers=[self.answers[i] for i in at])

    def own(self, at: np.ndarray) -> np.ndarray:
        """This block's term ids for those of the whole benchmark, -1 for terms of other blocks."""
        if self.among is None:
            return at
        ids = np.full(max(int(at.max(initial=-1)), int(self.among[-1])) + 2, -1)
        ids[self.among] = np.arange(len(self.among))
        return ids[at]  # -1 takes the last place

    def find(self, h: np.ndarray) -> np.ndarray:
        """Term ids of word hashes, -1 for words that are no term."""
        if not len(self.vocabulary):
            return np.full(len(h), -1)
        bits = np.zeros(1 << 16, bool)
        bits[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
        out = np.full(len(h), -1)
        at = np.flatnonzero(bits[(h & np.uint64(0xFFFF)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.vocabulary, h[at]), len(self.vocabulary) - 1)
        hit = self.vocabulary[place] == h[at]
        out[at[hit]] = place[hit]
        return out


def read_items(rows: list[tuple[int, str]], least: int) -> Items:
    ids, hashes, answers = [], [], []
    for item, text in rows:
        if not text:
            continue
        raw = np.frombuffer(text.encode(), np.uint8)
        h, _, starts, _ = terms_of(K.Texts(raw, np.array([0, len(raw)])))
        if len(h) < least:
            continue
        # the answer: what follows the last sentence end that has words behind it
        stops = [i for i, b in enumerate(raw.tolist()) if b in b".!?" and (starts > i).sum() >= 3]
        answers.append(int(np.searchsorted(starts, stops[-1])) if stops else 0)
        ids.append(item)
        hashes.append(h)
    vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
    return Items(ids, [np.searchsorted(vocabulary, h) for h in hashes], answers, vocabulary)


def _encode(shared, kind: str):
    """Every document's words as term ids (-1 for words that are no term), integers of type ``kind``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.dtype(kind).itemsize
        for batch in batches:
            forget()
            out: list[bytes] = []
            for _, _, t in K.pieces(batch.column("text")):
                h, bounds, _, _ = terms_of(t)
                data = shared.value.find(h).astype(kind).tobytes()
                out += [data[a:b] for a, b in pairwise((bounds * width).tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "terms"])

    return run


def _decoded(batch: pa.RecordBatch, kind: str, limit: int = 1 << 17) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Consecutive runs of encoded rows with at most ``limit`` words (or one row): the first row, the
    term ids, and their bounds by row."""
    terms = batch.column("terms").cast(pa.large_binary())
    if not len(terms):
        return
    width = np.dtype(kind).itemsize
    offsets = np.frombuffer(terms.buffers()[1], np.int64)[terms.offset : terms.offset + len(terms) + 1]
    data = terms.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < len(terms):
        b = int(np.searchsorted(offsets, offsets[a] + limit * width, "right")) - 1
        b = min(max(b, a + 1), len(terms))
        yield a, raw[offsets[a] : offsets[b]].view(kind).astype(np.int64), (offsets[a : b + 1] - offsets[a]) // width
        a = b


def _frequencies(n: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs = np.zeros(n, np.int64), 0
        for batch in batches:
            forget()
            for _, at, bounds in _decoded(batch, kind):
                owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                hit = at >= 0
                pairs = pd.unique(owner[hit] * n + at[hit])
                df += np.bincount(pairs % n, minlength=n)
                docs += len(bounds) - 1
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int64()), pa.array(np.append(df[some], docs), pa.int64())], names=["term", "n"])

    return run


def _windows(at: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and past-last word of the windows of every text, and their text. A text's last window
    reaches back so that it is full; a shorter text is one window."""
    n = np.diff(bounds)
    half = max(size // 2, 1)
    per = np.where(n > 0, np.maximum(1, -(-(n - size) // half) + 1), 0)
    text = np.repeat(np.arange(len(n)), per)
    k = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    first = np.minimum(k * half, np.maximum(n[text] - size, 0)) + bounds[text]
    return first, np.minimum(first + size, bounds[text + 1]), text


def _multiply(passages: list[tuple[np.ndarray, np.ndarray]], sketch: np.ndarray) -> np.ndarray:
    """The passages' transpose times the passages times ``sketch``."""
    out = np.zeros_like(sketch)
    for terms, weights in passages:
        out[terms] += weights[:, None] * (weights @ sketch[terms])
    return out


def _row(ids: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Unit TF-IDF weights of a passage's terms."""
    term, count = np.unique(ids[ids >= 0], return_counts=True)
    w = count * idf[term]
    norm = np.sqrt((w * w).sum())
    return (term, w / norm) if norm > 0 else None


def _product(at: np.ndarray, bounds: np.ndarray, idf: np.ndarray, sketch: np.ndarray, size: int) -> np.ndarray:
    """What ``_multiply`` gives for all windows of some texts: few windows at a time, which share
    most of their terms, as a dense matrix."""
    out = np.zeros_like(sketch)
    first, last, _ = _windows(at, bounds, size)
    hit = np.flatnonzero(at >= 0)
    start = np.searchsorted(hit, first)
    n = np.searchsorted(hit, last) - start
    window = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(window)) - np.repeat(np.cumsum(n) - n - start, n)
    key, count = np.unique(window * len(idf) + at[hit[place]], return_counts=True)
    window, term = np.divmod(key, len(idf))
    weight = count * idf[term]
    weight = (weight / np.sqrt(np.bincount(window, weight * weight))[window]).astype(sketch.dtype)
    some, column = np.zeros(len(idf), bool), np.zeros(len(idf), np.int64)
    height = 64
    for a, b in pairwise(np.searchsorted(window, np.arange(0, len(n) + height, height)).tolist()):
        some[term[a:b]] = True
        used = np.flatnonzero(some)
        some[used] = False
        column[used] = np.arange(len(used))
        dense = np.zeros((height, len(used)), sketch.dtype)
        dense[window[a:b] % height, column[term[a:b]]] = weight[a:b]
        out[used] += dense.T @ (dense @ sketch[used])
    return out


def _partial_products(shared, kind: str, size: int, slice_: int):
    """The products of a task's passages with the sketches of several blocks, in numbered slices of
    ``slice_`` terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(sketch.shape) for _, sketch in shared.value]
        for batch in batches:
            forget()
            for _, at, bounds in _decoded(batch, kind):
                for (block, sketch), sums in zip(shared.value, total, strict=True):
                    sums += _product(block.own(at), bounds, block.idf, sketch, size)
        for k, sums in enumerate(sums[a : a + slice_] for sums in total for a in range(0, len(sums), slice_)):
            if sums.any():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([sums.astype(np.float32).tobytes()])], names=["slice", "sums"])

    return run


def randomised_svds(encoded: DataFrame, blocks: list[Items], settings: Settings, weight: float = 1.0, kind: str = "int64") -> list[tuple[np.ndarray, np.ndarray]]:
    """For each block, the strongest right singular vectors (terms, rank) and their singular values
    of its items' passages and, times the square root of ``weight``, those of all documents."""
    spark = encoded.sparkSession
    slice_ = 64
    sketches = [np.linalg.qr(np.random.default_rng(settings.seed).standard_normal((n, min(settings.rank + settings.oversample, n))))[0] for n in (len(b.vocabulary) for b in blocks)]
    own = [[r for r in (_row(w, b.idf) for w in b.words) if r] for b in blocks]
    slices = [(block, a) for block, sketch in enumerate(sketches) for a in range(0, len(sketch), slice_)]
    parts = min(len(slices), int(spark.conf.get("spark.sql.shuffle.partitions")))
    for k in range(settings.iterations + 1):
        products = [_multiply(rows, sketch) for rows, sketch in zip(own, sketches, strict=True)]
        bare = [replace(b, ids=[], words=[], answers=[]) for b in blocks]
        shared = spark.sparkContext.broadcast([(b, sketch.astype(np.float32)) for b, sketch in zip(bare, sketches, strict=True)])
        sums = encoded.mapInArrow(_partial_products(shared, kind, settings.window, slice_), "slice long, sums binary").rdd
        for at, x in sums.map(lambda r: (r.slice, np.frombuffer(r.sums, np.float32).astype(float))).reduceByKey(np.add, parts).collect():  # terms x width numbers
            block, a = slices[at]
            product = products[block][a : a + slice_]
            product += weight * x.reshape(product.shape)
        shared.destroy()
        if k < settings.iterations:
            sketches = [np.linalg.qr(product)[0] for product in products]
    out = []
    for sketch, product in zip(sketches, products, strict=True):
        small_, turn = np.linalg.eigh(sketch.T @ product)  # the passages' product within the sketch's span
        strongest = np.argsort(-small_)[: min(settings.rank, len(sketch))]
        out.append((sketch @ turn[:, strongest], np.sqrt(np.maximum(small_[strongest], 0))))
    return out


def randomised_svd(encoded: DataFrame, items: Items, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """``randomised_svds`` for one block."""
    return randomised_svds(encoded, [items], settings)[0]


def spaces(items: Items, basis: np.ndarray, settings: Settings) -> list[Items]:
    """``items`` in parts, each with a basis that holds at least the share ``held`` of each item's norm."""
    items = replace(items, basis=basis)
    rows = [_row(w, items.idf) for w in items.words]
    share = np.array([np.linalg.norm(w @ items.basis[term]) for term, w in rows])
    strong, weak = np.flatnonzero(share >= settings.held), np.flatnonzero(share < settings.held)
    parts = [items.part(strong)] if len(strong) else []
    for k in range(0, len(weak), settings.rank):
        at = weak[k : k + settings.rank]
        own = np.zeros((len(items.vocabulary), len(at)))
        for column, i in enumerate(at):
            own[rows[i][0], column] = rows[i][1]
        parts.append(replace(items.part(at), basis=np.linalg.qr(own)[0]))
    return parts


def lcs_members(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which places of ``a`` are in a longest common subsequence with ``b`` (one of the longest)."""
    table = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    same = a[:, None] == b[None, :]
    for i in range(len(a)):
        diagonal = np.where(same[i], table[i, :-1] + 1, table[i, 1:])
        np.maximum.accumulate(np.append(0, diagonal), out=table[i + 1])
    used, i, j = np.zeros(len(a), bool), len(a), len(b)
    while i and j:
        if table[i, j] == table[i - 1, j]:
            i -= 1
        elif table[i, j] == table[i, j - 1]:
            j -= 1
        else:
            used[i - 1] = True
            i, j = i - 1, j - 1
    return used


def verify(item: np.ndarray, answer: int, region: np.ndarray, idf: np.ndarray, settings: Settings) -> tuple[bool, float]:
    """Whether a region of a document (term ids, -1 for other words) holds an item, and the share
    of the item's weight that their longest common subsequence covers."""
    used = lcs_members(item, region)
    w = idf[item]
    cover = float((w * used).sum() / w.sum())
    plain = used.mean()
    if min(cover, plain) >= settings.cover:
        return True, cover
    own = w[answer:].sum()
    answered = float((w[answer:] * used[answer:]).sum() / own) if own > 0 else 0.0
    return bool(min(cover, plain) >= settings.paraphrase and answered >= settings.answer), cover


class _Finder:
    """What a task prepares once for a block of items."""

    def __init__(self, items: Items, settings: Settings):
        self.items, self.settings = items, settings
        idf = items.idf
        self.square = np.append(idf**2, 0)  # the last place is for words that are no term
        self.space = np.vstack([idf[:, None] * items.basis, np.zeros((1, items.basis.shape[1]))]).astype(np.float32)
        # an item's share outside the latent space can't be told apart there, so cosines go by its part inside
        vectors = np.stack([self.space[w].sum(0) for w in items.words])
        self.vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        self.weight = [idf[w] for w in items.words]
        # the windows' best overlap with an item, and what a covered item must weigh in that window
        step, size = max(settings.window // 2, 1), np.array([len(w) for w in items.words])
        inside = np.maximum(np.minimum(size, settings.window - step + 1), np.minimum(settings.window, size - step + 1)) / size
        mass = np.array([self.square[np.unique(w)].sum() for w in items.words])
        self.least_of = 0.9 * settings.paraphrase * mass * np.where(inside >= 1, 1.0, 0.7 * inside)
        self.least = float(self.least_of.min())
        self.step = step
        self.flag = np.zeros(len(idf) + 1, bool)

    def find(self, at: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """Text, item and cover of what the texts of these term ids hold."""
        items, settings, step, space = self.items, self.settings, self.step, self.space
        idf = items.idf
        # words in blocks of half a window, each text padded to whole blocks
        n = np.diff(bounds)
        per = -(-n // step)
        start = np.cumsum(per) - per
        blocks = np.full((int(per.sum()), step), len(idf))
        owner = np.repeat(np.arange(len(n)), n)
        blocks.reshape(-1)[start[owner] * step + np.arange(len(at)) - bounds[owner]] = np.where(at >= 0, at, len(idf))
        text = np.repeat(np.arange(len(n)), per)
        mass = np.append(self.square[blocks].sum(1), 0)
        # a window is a block and the next one of its text; a lone block is one too
        alone = per[text] == 1
        window = np.flatnonzero((np.append(text[1:], -1) == text) | alone)
        mate = np.where(alone[window], len(blocks), window + 1)
        first = bounds[text] + (np.arange(len(text)) - start[text]) * step
        last = np.minimum(first + settings.window, bounds[text + 1])
        weigh = mass[window] + mass[mate]
        keep = np.flatnonzero(weigh >= self.least)
        found: dict[tuple[int, int], list[int]] = {}
        for part in range(0, len(keep), 512):
            own, other, heavy = window[keep[part : part + 512]], mate[keep[part : part + 512]], weigh[keep[part : part + 512]]
            used = np.unique(np.concatenate([own, other]))
            real = used[used < len(blocks)]
            sums = np.vstack([space[blocks[real]].sum(1), np.zeros((1, space.shape[1]), np.float32)])
            latent = sums[np.searchsorted(used, own)] + sums[np.searchsorted(used, other)]
            latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
            for p, i in zip(*np.nonzero((latent @ self.vectors.T >= settings.cosine) & (heavy[:, None] >= self.least_of)), strict=True):
                found.setdefault((int(text[own[p]]), int(i)), []).append(int(own[p]))
        for (doc, item), windows in found.items():
            size = len(items.words[item])
            ok, best = False, 0.0
            # neighbouring windows make one region, widened by the item's length
            a = b = -1
            regions: list[tuple[int, int]] = []
            for w in windows:
                lo, hi = max(int(first[w]) - size, int(bounds[doc])), min(int(last[w]) + size, int(bounds[doc + 1]))
                if regions and lo <= b and hi - a <= 8 * (size + settings.window):
                    b = max(b, hi)
                    regions[-1] = (a, b)
                else:
                    a, b = lo, hi
                    regions.append((a, b))
            for lo, hi in regions:
                self.flag[:] = False
                self.flag[at[lo:hi]] = True
                self.flag[-1] = False
                w = self.weight[item]
                if w[self.flag[items.words[item]]].sum() < settings.paraphrase * w.sum():
                    continue  # no subsequence can cover more
                good, cover = verify(items.words[item], items.answers[item], at[lo:hi], idf, settings)
                ok, best = ok or good, max(best, cover)
            if ok:
                yield doc, items.ids[item], best


def _search(shared, kind: str, settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = [_Finder(part, settings) for part in shared.value]
        for batch in batches:
            forget()
            ids = batch.column("doc_id").to_pylist()
            out: list[tuple[int, int, float]] = []
            for base, at, bounds in _decoded(batch, kind):
                for finder in finders:
                    out += [(ids[base + doc], item, cover) for doc, item, cover in finder.find(finder.items.own(at), bounds)]
            cols = list(zip(*out, strict=True)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["doc_id", "item_id", "cover"])

    return run


def _blocks(items: Items, most: int, seed: int) -> Iterator[Items]:
    """The items in blocks of at most ``most``, dealt at random, each with its own terms only."""
    order = np.random.default_rng(seed).permutation(len(items.ids))
    for k in range(0, len(order), most):
        part = items.part(order[k : k + most])
        used = np.unique(np.concatenate(part.words))
        yield replace(part, words=[np.searchsorted(used, w) for w in part.words], vocabulary=items.vocabulary[used], idf=items.idf[used], among=used)


def _within(parts: Iterable[Items], size: Callable[[Items], int], most: int) -> Iterator[list[Items]]:
    """``parts`` in runs of at most ``most`` bytes, or of one."""
    run: list[Items] = []
    room = most
    for part in parts:
        if run and room < size(part):
            yield run
            run, room = [], most
        run.append(part)
        room -= size(part)
    if run:
        yield run


def find_leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, item_id and cover of every benchmark item that a row of ``docs`` holds."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    listed = benchmark.where("text is not null").select("item_id", "text").orderBy("item_id", "text").toLocalIterator()
    items = read_items([(r.item_id, r.text) for r in listed], settings.least_words)
    total = spark.createDataFrame([], "doc_id long, item_id long, cover double")
    if not items.ids:
        return total
    n_terms = len(items.vocabulary)
    kind = np.min_scalar_type(-n_terms).name
    shared = spark.sparkContext.broadcast(replace(items, ids=[], words=[], answers=[]))
    encoded = materialise(rows.mapInArrow(_encode(shared, kind), "doc_id long, terms binary"))
    shared.destroy()
    tasks = spark.sparkContext.defaultParallelism
    if encoded.rdd.getNumPartitions() < tasks:  # few large row groups: small enough to be dealt out
        encoded = materialise(encoded.repartition(tasks))
    counted = {r.term: r.n for r in encoded.mapInArrow(_frequencies(n_terms, kind), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator()}
    n = counted.get(-1, 0)
    items.idf = np.log((n + 1) / (np.array([counted.get(i, 0) for i in range(n_terms)]) + 1)) + 0.05
    weight = settings.sample_weight**2 * min(1.0, settings.fit_docs / max(n, 1))
    width = 8 * (settings.rank + settings.oversample)
    fitted = (
        part
        for run in _within(_blocks(items, max(1, settings.items_per_rank * settings.rank), settings.seed), lambda b: len(b.vocabulary) * width, settings.pass_bytes)
        for block, (basis, _) in zip(run, randomised_svds(encoded, run, settings, weight, kind), strict=True)
        for part in spaces(block, basis, settings)
    )
    for run in _within(fitted, lambda p: p.basis.nbytes, settings.pass_bytes):
        shared = spark.sparkContext.broadcast(run)
        total = total.union(encoded.mapInArrow(_search(shared, kind, settings), "doc_id long, item_id long, cover double"))
    return total


def decontaminate(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; rows without an id stay."""
    gone = materialise(find_leaks(docs, benchmark, settings).select("doc_id").where("doc_id is not null").distinct())
    return docs.join(small(gone, gone.count()), "doc_id", "left_anti")
