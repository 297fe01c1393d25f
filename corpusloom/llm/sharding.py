"""Byte-balanced shards by Karmarkar-Karp differencing.

Groups of equal texts are indivisible. A partial partition holds one byte sum for each shard; the
two partial partitions with the largest spread are combined again and again, one in ascending and
one in descending order, so that their differences cancel.

At scale this runs as a tree: groups are dealt by hash into buckets of about ``bucket_groups``,
each bucket is differenced in one task, and its partial partition (one row per shard) goes up;
``fan_in`` partial partitions are differenced in a task of the next level until one is left. No
task holds more than one bucket, and texts are never shuffled, only their 128-bit keys. A hot
group is counted before the shuffle; the shards of the few largest groups are broadcast to the
rows, the others joined. Slots are numbered within the parts of a written table, so a hot group or
an id on very many rows is spread over as many parts as the table has.

Cases: null texts have size ``overhead`` and form one group, apart from empty texts; repeated
rows each take a slot; ties in spread go by order of the keys; an empty table gives no rows.
Extra columns are dropped.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_counted, materialise, small, text_key


def differencing(sizes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Combines partial partitions (rows of ``sizes``, one column per bin, ascending) into one.
    Returns, for each row and bin, the bin of the outcome, and the outcome's sums, ascending."""
    rows, bins = sizes.shape
    parent = np.arange(rows * bins)  # a forest: each bin of each row, joined as bins are merged
    state = {i: (sizes[i].astype(np.int64), np.arange(i * bins, (i + 1) * bins)) for i in range(rows)}
    heap = [(-int(sizes[i, -1] - sizes[i, 0]), i) for i in range(rows)]
    heapq.heapify(heap)
    while len(heap) > 1:
        i, j = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        (a, x), (b, y) = state[i], state.pop(j)
        total, y = a + b[::-1], y[::-1]
        parent[y] = x
        order = np.argsort(total, kind="stable")
        state[i] = total[order], x[order]
        heapq.heappush(heap, (-int(total[order[-1]] - total[order[0]]), i))
    total, roots = state[heap[0][1]]
    bin_of = np.empty(rows * bins, np.int64)
    bin_of[roots] = np.arange(bins)
    while True:  # path halving until every bin points at a root
        above = parent[parent]
        if (above == parent).all():
            break
        parent = above
    return bin_of[parent].reshape(rows, bins), total


def _spread_groups(shards: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key", kind="stable")
        sizes = np.zeros((len(rows), shards), np.int64)
        sizes[:, -1] = rows["bytes"]
        bins, _ = differencing(sizes, shards)
        return pd.DataFrame({"bucket": rows["bucket"], "key": rows["key"], "bytes": rows["bytes"], "bin": bins[:, -1]})

    return run


def _spread_partials(shards: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        nodes = np.sort(rows["node"].unique())
        sizes = np.zeros((len(nodes), shards), np.int64)
        sizes[np.searchsorted(nodes, rows["node"]), rows["bin"]] = rows["bytes"]
        order = np.argsort(sizes, axis=1, kind="stable")
        bins, _ = differencing(np.take_along_axis(sizes, order, 1), shards)
        out = np.empty_like(bins)
        np.put_along_axis(out, order, bins, 1)
        return pd.DataFrame({"node": np.repeat(nodes, shards), "bin": np.tile(np.arange(shards), len(nodes)), "up": out.ravel(), "bytes": sizes.ravel()})

    return run


def shard_documents(docs: DataFrame, shards: int = 40, overhead: int = 16, bucket_groups: int = 8192, fan_in: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard) of every row."""
    text = F.col("text")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + overhead
    rows = docs.select(
        "doc_id", size.alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.coalesce(text_key(text), F.lit(b"")).alias("key")
    )
    rows = materialise(rows)
    groups = materialise(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    n, total = groups.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    buckets = max(1, -(-n // bucket_groups))
    dealt = materialise(
        groups.select("key", "bytes").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).groupBy("bucket").applyInPandas(_spread_groups(shards), "bucket long, key binary, bytes long, bin long")
    )
    # the tree above the buckets: `node` at this level, `bin` as its tasks number them
    place = dealt.groupBy(F.col("bucket").alias("node"), "bin").agg(F.sum("bytes").alias("bytes"))
    where = place.select(F.col("node").alias("bucket"), "node", "bin", F.col("bin").alias("start"))
    level = buckets
    while level > 1:
        moved = materialise(
            place.withColumn("group", F.floor(F.col("node") / fan_in)).groupBy("group").applyInPandas(_spread_partials(shards), "node long, bin long, up long, bytes long")
        )
        step = moved.select("node", "bin", "up")
        where = where.join(step, ["node", "bin"]).select("bucket", F.floor(F.col("node") / fan_in).alias("node"), F.col("up").alias("bin"), "start")
        place = moved.groupBy(F.floor(F.col("node") / fan_in).alias("node"), F.col("up").alias("bin")).agg(F.sum("bytes").alias("bytes"))
        level = -(-level // fan_in)
    where = where.select("bucket", F.col("start").alias("bin"), F.col("bin").cast("int").alias("shard"))
    assigned = dealt.select("bucket", "bin", "key").join(where, ["bucket", "bin"]).select("key", "shard").join(groups.select("key", "n"), "key")
    placed = join_counted(rows, materialise(assigned), total).select("doc_id", "size", "text_crc32", "shard")
    placed = materialise(placed.withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}))
    # slots: rows are numbered within the parts of the written table, after the rows of the parts before
    parts = materialise(placed.groupBy("shard", "part").agg(F.count("*").alias("n")))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = parts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("shard", "part").orderBy("row")
    numbered = placed.withColumn("at", F.row_number().over(own) - 1)
    slot = (F.col("first") + F.col("at")).cast("long").alias("slot")
    return numbered.join(small(first, parts.count()), ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", slot)
