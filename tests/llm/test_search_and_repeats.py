"""Ranked search, resampling and removal of repeats against plain versions, on odd input too."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import lexsearch, queries, resample, suffixdedup
from corpusloom.llm.inducedsort import Queues, encode, suffixes

from ..conftest import SF

DOCS = "doc_id long, text string, extra string, row long, n long, rank string"
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def lowered(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


@pytest.fixture(scope="module")
def given(spark):
    """Nulls, empty and long texts, ties, repeated rows, columns named like ours."""
    random.seed(3)
    words = ["Alpha", "beta", "gamma", "étè", "ñ1", "日本", "x" * 90, "z" * 70, "one", "two", "three"]
    rows = [(i, " ".join(random.choices(words, k=random.randint(1, 60)))) for i in range(80)]
    rows += [rows[3], rows[3], (3, "alpha"), (None, rows[5][1]), (None, None), (200, None), (201, ""), (202, "... !!"), (203, "beta " * 20_000), (204, rows[7][1]), (205, rows[7][1])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "e", 7, 8, "r") for d, t in rows], DOCS)


def plain_search(rows, items, k=10):
    docs = [(d, Counter(lowered(t))) for d, t in rows]
    docs = [(d, c) for d, c in docs if c]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(w for _, c in docs for w in c)
    out = []
    for item, text in items:
        found = []
        for d, c in docs:
            m = 10 + (90 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in set(lowered(text)) if w in c)
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, rank, None if null else d, -s) for rank, (s, null, d) in enumerate(heapq.nsmallest(k, found), 1)]
    return out


def key(row):
    return tuple((x is None, x or 0) for x in row)


def test_search_equals_plain_search(spark, given):
    items = [(1, "alpha beta"), (2, "Étè ñ1 日本 gamma"), (2, "one two three one"), (None, "z" * 70), (4, None), (5, ""), (6, "unheard of")]
    asked = spark.createDataFrame([(i, t, "c") for i, t in items], "item_id long, text string, query string")
    want = sorted(plain_search(given, items), key=key)
    for options in ({}, {"block_bytes": 400}, {"vocabulary_bytes": 0}):
        got = sorted(map(tuple, lexsearch.search(frame(spark, given), asked, **options).collect()), key=key)
        assert got == want
    assert lexsearch.search(frame(spark, given).where("false"), asked).count() == 0
    assert lexsearch.search(frame(spark, given), asked.where("false")).count() == 0


def test_small_shards_give_the_same(spark, given):
    index = lexsearch.build_index(frame(spark, given).coalesce(1), None, shard_docs=7)
    assert index.count() > 10
    for row in index.collect():
        ids = [x for x in row.ids if x is not None]
        assert ids == sorted(ids) and row.ids[: len(ids)] == ids
        for n, postings in zip(row.counts, row.postings, strict=True):
            assert len(lexsearch.unpack(postings)) == 2 * n


def test_merge_leaves_no_document_out():
    random.seed(5)
    for _ in range(300):
        n = random.randint(1, 40)
        lists = []
        for _ in range(random.randint(1, 8)):
            docs = sorted(random.sample(range(n), random.randint(1, n)))
            scores = [random.randint(0, 6) for _ in docs]
            lists.append((max(scores), docs, scores))
        k = random.randint(1, 6)
        top = lexsearch.Top(k)
        for half in (0, 1):  # two shards, one after the other
            own = [(b, [d for d in docs if d % 2 == half], [s for d, s in zip(docs, scores, strict=True) if d % 2 == half]) for b, docs, scores in lists]
            lexsearch.merge([x for x in own if x[1]], list(range(n)), top)
        total = Counter()
        for _, docs, scores in lists:
            for d, s in zip(docs, scores, strict=True):
                total[d] += s
        want = sorted(((s, -d) for d, s in total.items() if s > 0), reverse=True)[:k]
        assert sorted(top.heap, reverse=True) == want


def test_packed_integers_return():
    values = np.array([0, 1, 127, 128, 16383, 16384, 1 << 40, (1 << 62) + 5, 3])
    data, ends = lexsearch.pack(values)
    assert lexsearch.unpack(data).tolist() == values.tolist() and ends[-1] == len(data)
    assert lexsearch.unpack(lexsearch.pack(values[:0])[0]).tolist() == []


def plain_resample(rows, target, n, buckets, percent, least, seed):
    def features(text):
        w = lowered(text)
        return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    own = [Counter(features(t)) for _, t in rows]
    s, t = Counter(), Counter()
    for c in own:
        for f, x in c.items():
            s[bucket(f)] += x
    for text in target:
        for f in features(text):
            t[bucket(f)] += 1
    S, T = sum(s.values()), sum(t.values())
    out = []
    for (d, text), c in zip(rows, own, strict=True):
        weight = sum(x * math.floor(1000 * math.log((t[bucket(f)] + 1) * (S + buckets) / ((s[bucket(f)] + 1) * (T + buckets)))) for f, x in c.items())
        h = int(hashlib.sha256(f"{seed}:{d}".encode()).hexdigest()[:8], 16)
        score = None if d is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([d, sum(c.values()), weight, score, None, len(lowered(text)) >= least and d is not None])
    drawn = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0]))
    for rank, r in enumerate(drawn[: len(drawn) * percent // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in out]


@pytest.mark.parametrize(("n", "hot"), [(1, 1 << 19), (2, 20), (1, 1)])
def test_resampling_equals_the_formula(spark, given, monkeypatch, n, hot):
    monkeypatch.setattr(resample, "_HOT", hot)  # all, some or none of the features by broadcast
    target = ["alpha beta ñ1", None, "", "one " + "x" * 90]
    to = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resample(frame(spark, given), to, n=n, buckets=50, percent=30, least_words=5, seed=9)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = plain_resample(given, target, n, 50, 30, 5, 9)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_resampling_of_nothing(spark, given):
    none = frame(spark, given).where("false")
    assert resample.resample(none, none).count() == 0
    assert resample.resample(none, frame(spark, given)).count() == 0
    assert resample.resample(frame(spark, given), none).count() == len(given)


def plain_removal(rows, width=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - width + 1) if d is not None else ():
            first[b[i : i + width]] = min(d, first.get(b[i : i + width], d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b) + 1)
        for i in range(len(b) - width + 1) if d is not None else ():
            if first[b[i : i + width]] < d:
                gone[i : i + width] = b"\1" * width
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(b)))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=False) if not g)).hexdigest()))
    return out


def test_repeats_equal_plain_removal(spark, given):
    base = "the quick brown fox jumps over the lazy dog and runs far away from here to there "
    rows = [(d, (t or "")[:3000] if t else t) for d, t in given]
    rows += [(1001, base * 2 + "x"), (1001, "y" + base * 2), (1002, base), (1002, base), (1005, "a" * 4000), (1006, "b" + "a" * 300 + "c"), (1007, "a" * 49), (1008, "a" * 50)]
    rows += [(1009, base * 2 + "x"), (1010, "é" * 60), (1011, "z" + "é" * 60), (1012, base[:60]), (1013, base[:49]), (None, base * 3), (1014, base[10:] + base[:70])]
    want = sorted(plain_removal(rows), key=str)
    for memory in (64 << 20, 200):  # in memory, and with queues on disk
        assert sorted(map(tuple, suffixdedup.remove_repeats(frame(spark, rows), memory=memory).collect()), key=str) == want
    assert suffixdedup.remove_repeats(frame(spark, rows).where("false")).count() == 0


def test_repeats_meet_across_tasks(spark, given):
    """A task for nearly every text: nothing is settled within a batch."""
    rows = [(d, (t or "")[:500]) for d, t in given]
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = suffixdedup.remove_repeats(frame(spark, rows).repartition(60), width=20).collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert sorted(map(tuple, got), key=str) == sorted(plain_removal(rows, 20), key=str)


def test_suffixes_are_sorted_with_their_common_prefixes():
    random.seed(1)
    for trial in range(150):
        depth, letters = random.choice([5, 8, 17, 50]), random.choice([b"a", b"ab", b"abc", bytes(range(253))])
        strings = [bytes(random.choices(letters, k=random.randint(1, random.choice([3, 20, 90])))) for _ in range(random.randint(1, 12))]
        strings += strings[: trial % 3]
        begin = np.cumsum([0, *[len(s) + 1 for s in strings]])
        got, shared = [], []
        for places, common in suffixes(encode(strings), depth, memory=random.choice([64, 1 << 20])):
            for p in places.tolist():
                k = int(np.searchsorted(begin, p, "right")) - 1
                got.append(strings[k][p - begin[k] :][:depth])
            shared += common.tolist()
        assert got == sorted((s[i:][:depth] for s in strings for i in range(len(s))), reverse=True)
        for a, b, c in zip(got, got[1:], shared[1:], strict=False):
            assert c == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_queues_keep_the_order_on_disk():
    q = Queues(40)
    for i in range(0, 30, 3):
        q.push(7, np.arange(i, i + 3), np.arange(i, i + 3).astype(np.uint8))
        q.push(9, np.arange(i, i + 3) * 2, np.zeros(3, np.uint8))
    assert q.spilled > 0
    assert np.concatenate([p for p, _ in q.take(7)]).tolist() == list(range(30))
    down = [p for p, _ in q.take(9, last_first=True)]
    assert np.concatenate([p[::-1] for p in down]).tolist() == list(range(58, -1, -2))
    q.close()


def test_shares_of_hot_passages_stay_small():
    """A passage that every text of a batch holds is sent once for the batch."""
    import pyarrow as pa

    text = "a passage of more than fifty bytes that every single document holds, word by word"
    ids = list(range(500))
    batch = pa.record_batch([pa.array(ids), pa.array([(f"{i} " * 20 + text).encode() for i in ids])], names=["doc_id", "text"])
    sent = [suffixdedup.unpack(data)[0] for b in suffixdedup._mark(50, 8)(iter([batch])) for data in b.column(1).to_pylist()]
    sent = np.concatenate([np.cumsum(gaps) for gaps in sent])
    several = sent[(sent & 3) == 1]
    assert len(several) and len(np.unique(several)) == len(several)


def test_packed_columns_return():
    columns = [np.array([0, 5, 1 << 45]), np.array([0, 0, 0]), suffixdedup._unsigned(np.array([-3, 7, -(1 << 62)])).view(np.int64)]
    got = suffixdedup.unpack(suffixdedup.pack(*columns))
    assert [c.tolist() for c in got] == [c.tolist() for c in columns] and suffixdedup._signed(got[2]).tolist() == [-3, 7, -(1 << 62)]
    rows = [(8, -4, None, [1, 2], b"abc"), (12, 9, 0, [0], b"")]
    assert list(suffixdedup._open_stretches(suffixdedup._seal_stretches(rows))) == rows


def test_queries_have_the_contracts_columns(spark):
    assert queries.op11_resample(spark, SF).dtypes == [("doc_id", "bigint"), ("n_features", "bigint"), ("weight", "bigint"), ("score", "bigint"), ("rank", "bigint")]
    assert queries.op12_suffix_dedup(spark, SF).dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")]
    assert queries.op13_ranked_search(spark, SF).dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
