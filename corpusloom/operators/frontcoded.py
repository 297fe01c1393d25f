"""Sorted word tables in blocks: front-coded keys, small values, and a sparse index of first keys.

A block holds some 64 entries: the first key is whole, every later one says how many bytes it shares with
the one before and brings the rest. Blocks are written by range-sorted tasks, so a table of any size is
built without the driver. Look-up joins distinct words with the blocks that may hold them: if all
blocks take at most ``limit`` bytes they are broadcast, and a batch's sorted words and the blocks are
read side by side, each block at most once and never further than the last word asked of it. A larger
table is unpacked by its tasks and joined by key.

Keys are compared as UTF-8 bytes, as Spark does. Repeated keys: the one with the smallest value stays. Null
keys are left out; an empty table finds nothing.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LIMIT = 48 << 20
_BLOCK = pa.schema([("first", pa.binary()), ("n", pa.int32()), ("data", pa.binary())])
_ENTRY = pa.schema([("key", pa.string()), ("value", pa.binary())])


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_number(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at += 1
        if b < 128:
            return n, at
        shift += 7


def encode_block(entries: list[tuple[bytes, bytes]]) -> bytes:
    """Shared bytes, length of the rest, the rest, length of the value, the value; for each entry."""
    out, before = [], b""
    for key, value in entries:
        shared = 0
        for a, b in zip(before, key, strict=False):
            if a != b:
                break
            shared += 1
        rest = key[shared:]
        out += [_number(shared), _number(len(rest)), rest, _number(len(value)), value]
        before = key
    return b"".join(out)


def entries_of(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at, key = 0, b""
    while at < len(data):
        shared, at = _read_number(data, at)
        n, at = _read_number(data, at)
        key = key[:shared] + data[at : at + n]
        at += n
        n, at = _read_number(data, at)
        yield key, data[at : at + n]
        at += n


def find_sorted(words: list[bytes], firsts: list[bytes], blocks: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """(word, value) of the ascending ``words`` that the blocks hold."""
    i = 0
    while i < len(words):
        block = bisect_right(firsts, words[i]) - 1
        if block < 0:
            i += 1
            continue
        end = firsts[block + 1] if block + 1 < len(firsts) else None
        for key, value in entries_of(blocks[block]):
            while i < len(words) and words[i] < key:
                i += 1
            if i == len(words) or (end is not None and words[i] >= end):
                break
            if words[i] == key:
                yield key, value
                i += 1
        while i < len(words) and (end is None or words[i] < end):
            i += 1


def build(entries: DataFrame, block: int = 64) -> DataFrame:
    """first, n and data of the blocks of ``entries`` (key string, value binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes]] = []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([held[0][0]], pa.binary()), pa.array([len(held)], pa.int32()), pa.array([encode_block(held)], pa.binary())], schema=_BLOCK)

        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((key.encode(), value))
                if len(held) == block:
                    yield row()
                    held.clear()
        if held:
            yield row()

    single = entries.where("key is not null").groupBy("key").agg(F.min("value").alias("value"))
    return single.repartitionByRange("key").sortWithinPartitions("key").select("key", "value").mapInArrow(run, "first binary, n int, data binary")


def expand(blocks: DataFrame) -> DataFrame:
    """key and value of every entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k.decode(), v) for data in batch.column(0).to_pylist() for k, v in entries_of(data)]
            keys, values = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(values, pa.binary())], schema=_ENTRY)

    return blocks.select("data").mapInArrow(run, "key string, value binary")


def lookup(words: DataFrame, blocks: DataFrame, limit: int = _LIMIT) -> DataFrame:
    """key and value of the distinct words (column ``key``) that the table holds."""
    asked = words.select("key").where("key is not null").distinct()
    size = blocks.agg(F.coalesce(F.sum(F.octet_length("data") + F.octet_length("first") + 100), F.lit(0))).first()[0]
    if size > limit:
        return asked.join(expand(blocks), "key")
    rows = sorted((bytes(r["first"]), bytes(r["data"])) for r in blocks.select("first", "data").collect())
    shared = words.sparkSession.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, data = shared.value
        for batch in batches:
            own = sorted(w.encode() for w in batch.column(0).to_pylist())
            found = [(k.decode(), v) for k, v in find_sorted(own, firsts, data)]
            keys, values = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(values, pa.binary())], schema=_ENTRY)

    return asked.mapInArrow(run, "key string, value binary")
