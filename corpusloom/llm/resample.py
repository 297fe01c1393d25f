"""Importance resampling towards a target by a dictionary of distinct features.

Features are all runs of 1 to ``n`` consecutive words. Their strings are counted over both corpora
(each batch's counts, then Spark's partial and final sums), so each distinct string is hashed to its
bucket once, in the dictionary. Counts are summed by bucket, buckets get gains, and gains return to
the documents' own feature counts by way of the dictionary: features with more than a 2**19th of all
occurrences, of which there are fewer than 2**19, by a broadcast, the others by a join on the
feature, in which no key is hot. Keys longer than 64 bytes are joined by their 128-bit hash, which
bounds the broadcast to 2**19 * 72 bytes. A document's weight is the sum of its gains; the draw adds
Gumbel noise that its id decides and takes the highest scores. Ranks are numbered by the parts of a
written, range-sorted table, so no task holds the order of all documents.

Cases: null and empty texts have no feature, weight 0 and are never drawn unless ``least_words`` is
0; a row without an id has a null score, doesn't count among those drawn from, and is never drawn;
repeated rows each count and are drawn as rows of their own, with equal scores in any order of
ranks; very long texts and words are read whole; with an empty target or no documents at all gains
are as the formula says, and no documents give no rows. Other columns aren't read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import md5

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, forget, materialise, small

#: Of texts as UTF-8 bytes with A-Z lower-cased: digits, letters a-z and all that isn't ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_KEY_BYTES = 64
_HOT = 1 << 19
_COUNTS = pa.schema([("feature", pa.binary()), ("n", pa.int64())])
_ROWS = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64()),
    ("cold", pa.list_(pa.struct([("key", pa.binary()), ("n", pa.int64())]))),
])


def words_of(text: pa.Scalar) -> list[bytes]:
    data = text.as_buffer()
    return _WORD.findall(data.to_pybytes().lower()) if data is not None else []


def features_of(words: list[bytes], n: int) -> list[bytes]:
    """All runs of 1 to ``n`` words, joined by one space."""
    return words if n == 1 else [b" ".join(words[i : i + size]) for size in range(1, n + 1) for i in range(len(words) - size + 1)]


def key_of(feature: bytes) -> bytes:
    """As ``_key`` in Spark: the zero byte, which no feature holds, marks a hash."""
    return feature if len(feature) <= _KEY_BYTES else b"\0" + md5(feature).digest()


def _key(feature: Column) -> Column:
    return F.when(F.octet_length(feature) <= _KEY_BYTES, feature).otherwise(F.concat(F.lit(b"\0"), F.unhex(F.md5(feature))))


def _count(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forget()
            counts: Counter[bytes] = Counter()
            for text in batch.column(0):
                counts.update(features_of(words_of(text), n))
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], schema=_COUNTS)

    return run


def feature_counts(texts: DataFrame, n: int) -> DataFrame:
    """feature, n for each batch of ``text``: a partial count."""
    return texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(_count(n), "feature binary, n long")


def dictionary(docs: DataFrame, target: DataFrame, n: int, buckets: int) -> DataFrame:
    """key, bucket, s and t (how often ``docs`` and ``target`` hold the feature), a row per feature."""
    zero = F.lit(0).cast("long")
    both = feature_counts(docs, n).select("feature", F.col("n").alias("s"), zero.alias("t")).union(feature_counts(target, n).select("feature", zero, F.col("n")))
    sums = both.groupBy("feature").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    return materialise(sums.select(_key(F.col("feature")).alias("key"), F.pmod(F.crc32("feature"), F.lit(buckets)).cast("long").alias("bucket"), "s", "t"))


def bucket_gains(features: DataFrame, buckets: int) -> tuple[DataFrame, int]:
    """bucket, gain: how much likelier the target makes the bucket, in thousandths of a natural
    logarithm, rounded down; and how many features the documents hold in all."""
    sums = materialise(features.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")))
    s, t = sums.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    up, down = (F.col("t") + 1).cast("double") * float(s + buckets), (F.col("s") + 1).cast("double") * float(t + buckets)
    return sums.select("bucket", F.floor(1000 * F.log(up / down)).cast("long").alias("gain")), s


def _weigh(hot, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = hot.value
        for batch in batches:
            forget()
            rows: list[tuple] = []
            for text in batch.column(1):
                words = words_of(text)
                counts = Counter(features_of(words, n))
                weight, cold = 0, []
                for feature, times in counts.items():
                    if (gain := gains.get(key := key_of(feature))) is None:
                        cold.append((key, times))
                    else:
                        weight += gain * times
                rows.append((len(words), sum(counts.values()), weight, [{"key": k, "n": c} for k, c in cold]))
            values = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, f.type) for v, f in zip(values, list(_ROWS)[1:], strict=True)]], schema=_ROWS)

    return run


def weights(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000) -> DataFrame:
    """row (a number of its own), doc_id, n_words, n_features and weight of every row."""
    bound_batches(docs.sparkSession)
    features = dictionary(docs, target, n, buckets)
    gains, total = bucket_gains(features, buckets)
    gained = features.join(small(gains, buckets), "bucket").select("key", "gain", "s")
    hot = docs.sparkSession.sparkContext.broadcast({bytes(r.key): r.gain for r in gained.where(F.col("s") * _HOT > total).toLocalIterator()})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    counted = materialise(
        rows.mapInArrow(_weigh(hot, n), "doc_id long, n_words long, n_features long, weight long, cold array<struct<key: binary, n: long>>").withColumn("row", F.monotonically_increasing_id())
    )
    cold = counted.select("row", F.explode("cold").alias("c")).select("row", F.col("c.key").alias("key"), F.col("c.n").alias("n"))
    rest = cold.join(gained.select("key", "gain"), "key").groupBy("row").agg(F.sum(F.col("gain") * F.col("n")).alias("rest"))
    weight = (F.col("weight") + F.coalesce("rest", F.lit(0))).alias("weight")
    return counted.drop("cold").join(rest, "row", "left").select("row", "doc_id", "n_words", "n_features", weight)


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise of the id, in thousandths, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score and rank (from 1; null: not drawn) of every row of ``docs``
    (doc_id, text), drawn towards ``target`` (text)."""
    scored = weights(docs, target, n, buckets).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = materialise(scored.withColumn("eligible", (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()))
    drawn = scored.where("eligible").count() * percent // 100
    order = [F.desc("score"), F.asc("doc_id")]
    placed = scored.where("eligible").repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialise(placed.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}))
    parts = materialise(placed.groupBy("part").agg(F.count("*").alias("n")))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    first = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("part").orderBy("at")
    rank = (F.row_number().over(own) + F.col("first")).cast("long")
    ranked = placed.join(small(first, parts.count()), "part").withColumn("rank", F.when(rank <= drawn, rank))
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*out).union(scored.where("not eligible").withColumn("rank", F.lit(None).cast("long")).select(*out))
