"""Ranked lexical search: document-at-a-time merge over compressed postings.

The documents of a task are cut into shards of about ``shard_docs``. In a shard, documents are
numbered in order of doc_id, and a term's postings are the gaps between those numbers and the
term's occurrences, as variable-length integers. A shard is one row of a written table, so search
reads the texts only once, and nothing but a shard's own postings is in memory.

A query's terms each have a cursor; a heap of the cursors' documents yields one document after
another, whose score is summed over all cursors that stand on it. The best ``k`` are in a bounded
heap keyed by score and then doc_id, which goes from shard to shard of a task. Cursors of terms that
even together can't lift a document into the full heap leave the merge (they are only looked up for
documents that others bring), which changes no result. Tasks' heaps are merged in two steps by
windows, so no query's rows meet in one task unreduced.

Queries are searched in blocks of at most ``block_bytes``, each broadcast. Only the queries' terms
get postings if these terms take at most ``vocabulary_bytes`` (then they are broadcast); else all
terms get them, with the same result.

Cases: null and empty texts hold no term and don't count in N; a document without an id counts in
N, L and df, is found like others, and comes last among equal scores; repeated rows are documents of
their own; every row of the queries is a query of its own, also with a repeated or null id; a query
without terms or matches gives no rows; empty tables give none. Other columns aren't read.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, forget, materialise, small

#: Of texts as UTF-8 bytes with A-Z lower-cased: digits, letters a-z and all that isn't ASCII.
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_SHARD = pa.schema([("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("terms", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64())), ("postings", pa.list_(pa.binary()))])
_FOUND = pa.schema([("query", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
_INDEX = "ids array<long>, lengths array<long>, terms array<binary>, counts array<long>, postings array<binary>"
_LAST = 1 << 63  # stands for a missing id: after all others


def pack(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Non-negative integers as variable-length bytes (seven bits each, the high bit set on all but
    a value's last byte), and each value's end."""
    values = values.astype(np.uint64)
    width = np.ones(len(values), np.int64)
    for bits in range(7, 64, 7):
        width += values >= np.uint64(1) << np.uint64(bits)
    ends = np.cumsum(width)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    start = ends - width
    for i in range(int(width.max(initial=0))):
        on = width > i
        more = np.where(width[on] > i + 1, 128, 0).astype(np.uint8)
        out[start[on] + i] = ((values[on] >> np.uint64(7 * i)) & np.uint64(127)).astype(np.uint8) | more
    return out.tobytes(), ends


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate(([0], ends[:-1] + 1))
    out = np.zeros(len(ends), np.int64)
    for i in range(int((ends - starts).max(initial=-1)) + 1):
        on = starts + i <= ends
        out[on] |= (raw[starts[on] + i] & 127).astype(np.int64) << (7 * i)
    return out


class _Shard:
    """Documents of a task until they are enough for a row."""

    def __init__(self, wanted: frozenset[bytes] | None):
        self.wanted, self.number = wanted, {}
        self.ids, self.lengths, self.term, self.doc, self.times = [], [], [], [], []

    def add(self, doc_id: int | None, words: list[bytes]) -> None:
        at, number = len(self.ids), self.number
        self.ids.append(doc_id)
        self.lengths.append(len(words))
        counts = Counter(words)
        if self.wanted is not None:
            counts = {w: n for w, n in counts.items() if w in self.wanted}
        self.term.extend([number.setdefault(w, len(number)) for w in counts])
        self.times.extend(counts.values())
        self.doc.extend([at] * len(counts))

    def row(self) -> pa.RecordBatch:
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        term, doc, times = np.array(self.term, np.int64), place[np.array(self.doc, np.int64)], np.array(self.times, np.int64)
        by = np.lexsort((doc, term))
        term, doc, times = term[by], doc[by], times[by]
        counts = np.bincount(term, minlength=len(self.number))
        first = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64) if len(counts) else np.zeros(0, np.int64)
        gaps = np.diff(doc, prepend=0)
        gaps[first] = doc[first]
        data, ends = pack(np.column_stack((gaps, times)).ravel())
        cut = [0, *ends[2 * np.cumsum(counts) - 1].tolist()]
        one = {
            "ids": [self.ids[i] for i in order], "lengths": [self.lengths[i] for i in order], "terms": list(self.number), "counts": counts.tolist(),
            "postings": [data[a:b] for a, b in zip(cut, cut[1:], strict=False)],
        }
        return pa.RecordBatch.from_pylist([one], _SHARD)


def _index(wanted, shard_docs: int, shard_postings: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(wanted.value if wanted else None)
        for batch in batches:
            forget()
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if (data := text.as_buffer()) is not None and (words := _TERM.findall(data.to_pybytes().lower())):
                    shard.add(doc_id, words)
                    if len(shard.ids) >= shard_docs or len(shard.term) >= shard_postings:
                        yield shard.row()
                        shard = _Shard(shard.wanted)
        if shard.ids:
            yield shard.row()

    return run


def build_index(docs: DataFrame, wanted: frozenset[bytes] | None = None, shard_docs: int = 16384, shard_postings: int = 4_000_000) -> DataFrame:
    """One row for each shard, written in the shared folder: ids (ascending, null last), lengths in
    terms, terms, how many documents hold each, and their postings. ``wanted``: terms to keep."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(wanted) if wanted is not None else None
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return materialise(rows.mapInArrow(_index(shared, shard_docs, shard_postings), _INDEX))


class Top:
    """The best ``k`` documents of a query: a heap whose first entry is the worst."""

    def __init__(self, k: int):
        self.k, self.heap, self.least = k, [], 0

    def offer(self, score: int, key: int) -> None:
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, (score, -key))
        else:
            heapq.heappushpop(self.heap, (score, -key))
        if len(self.heap) == self.k:
            self.least = self.heap[0][0]


def merge(lists: list[tuple[int, list[int], list[int]]], keys: list[int], top: Top) -> None:
    """Offers every document of ``lists`` that may enter ``top``. A list: the greatest of its scores,
    document numbers (ascending), their scores."""
    lists = sorted((x for x in lists if x[0] > 0), key=lambda x: -x[0])
    rest = [0] * (len(lists) + 1)  # what lists from here on can add at most
    for i in range(len(lists) - 1, -1, -1):
        rest[i] = rest[i + 1] + lists[i][0]
    driving = len(lists)
    while driving and rest[driving - 1] < top.least:
        driving -= 1
    heap = [(x[1][0], i, 0) for i, x in enumerate(lists[:driving])]
    heapq.heapify(heap)
    looked_up: dict[int, dict[int, int]] = {}
    while heap:
        doc, score = heap[0][0], 0
        while heap and heap[0][0] == doc:
            _, i, at = heap[0]
            _, docs, scores = lists[i]
            score += scores[at]
            at += 1
            if at < len(docs) and i < driving:
                heapq.heapreplace(heap, (docs[at], i, at))
            else:
                heapq.heappop(heap)
        for i in range(driving, len(lists)):
            if score + rest[i] < top.least:
                break
            if i not in looked_up:
                looked_up[i] = dict(zip(lists[i][1], lists[i][2], strict=True))
            score += looked_up[i].get(doc, 0)
        else:
            if score > 0 and score >= top.least:
                top.offer(score, keys[doc])
                was = driving
                while driving and rest[driving - 1] < top.least:
                    driving -= 1
                if driving < was:
                    heap = [x for x in heap if x[1] < driving]
                    heapq.heapify(heap)


def _search(queries, k: int, b: int, n: int, total: int):
    """``queries``: broadcast list of (number, [(term, weight)])."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = {q: Top(k) for q, _ in queries.value}
        needed = {t: w for _, terms in queries.value for t, w in terms}
        for batch in batches:
            forget()
            for row in range(batch.num_rows):
                ids, lengths, terms, _, postings = (batch.column(i)[row].values for i in range(5))
                keys = [_LAST if x is None else x for x in ids.to_pylist()]
                m = 100 - b + (b * np.asarray(lengths) * n) // total
                lists: dict[bytes, tuple[int, list[int], list[int]]] = {}
                for at, term in enumerate(terms.to_pylist()):
                    if term in needed:
                        pairs = unpack(postings[at].as_buffer())
                        doc, times = np.cumsum(pairs[::2]), pairs[1::2]
                        scores = needed[term] * ((1_000_000_000 * times) // (1000 * times + 8 * m[doc]))
                        lists[term] = int(scores.max()), doc.tolist(), scores.tolist()
                for q, own in queries.value:
                    merge([lists[t] for t, _ in own if t in lists], keys, tops[q])
        found = [(q, None if key == -_LAST else -key, score) for q, top in tops.items() for score, key in top.heap]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), _FOUND, strict=True)], schema=_FOUND)

    return run


def _terms(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.regexp_extract_all(lower, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0)))


def search(docs: DataFrame, queries: DataFrame, k: int = 10, b: int = 90, block_bytes: int = 16 << 20, vocabulary_bytes: int = 32 << 20) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` best documents (doc_id, text) of each query
    (item_id, text). ``b``: how much a document's length counts, of 100."""
    spark = docs.sparkSession
    asked = materialise(queries.select("item_id", _terms(F.col("text")).alias("terms")).where(F.size("terms") > 0).withColumn("query", F.monotonically_increasing_id()))
    terms = asked.select("query", F.explode("terms").alias("term"))
    size = F.octet_length("term") + 64
    distinct = materialise(terms.select("term").distinct())
    vocabulary = distinct.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    wanted = frozenset(r.term.encode() for r in distinct.toLocalIterator()) if vocabulary <= vocabulary_bytes else None
    index = build_index(docs, wanted)
    n, total = index.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)), F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda x, y: x + y)), F.lit(0))).first()
    held = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy(F.col("x.terms").cast("string").alias("term")).agg(F.sum("x.counts").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n).cast("double") + 2) / (2 * F.col("df") + 1))).cast("long").alias("weight")
    weighted = materialise(held.join(small(distinct, distinct.count()), "term").select("term", weight))
    own = materialise(terms.join(weighted, "term").groupBy("query").agg(F.collect_list(F.struct("term", "weight")).alias("terms"), F.sum(size).alias("bytes")))
    blocks = max(1, -(-(own.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]) // block_bytes))
    found = None
    for block in range(blocks):
        listed = own.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).select("query", "terms").collect()
        block_queries = spark.sparkContext.broadcast([(r.query, [(t.term.encode(), t.weight) for t in r.terms]) for r in listed])
        part = index.mapInArrow(_search(block_queries, k, b, n, total), "query long, doc_id long, score long")
        found = part if found is None else found.union(part)
    best = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    salted = found.withColumn("salt", F.spark_partition_id() % 64)
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("query", "salt").orderBy(*best))).where(F.col("rank") <= k)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*best))).where(F.col("rank") <= k).drop("salt")
    items = asked.select("query", "item_id")
    return ranked.join(small(items, items.count()), "query").select("item_id", "rank", "doc_id", "score")
