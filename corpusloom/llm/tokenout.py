"""Token ids in ORC files.

Documents are dealt into ranges of doc_id, sorted, encoded, and written one file per range, so the
files in the order of their names hold ascending ids. ORC encodes the integers by run length, keeps
row indexes with minima and maxima, and a Bloom filter over doc_id: a look-up of some documents
reads only the stripes and row groups that may hold them, and stripes are read in parallel.

Encoding is the tokenizers library's. Its word-level models never join text over white space or
over the pieces that their pattern cuts, so each distinct piece of a batch is encoded once and the
ids of a text are gathered by the numbers of its pieces.

Cases: a null or empty text holds the end id alone; null ids come first; repeated ids follow each
other in the order of their texts' hashes, and each row's place stands in the file beside its ids;
special tokens' strings in a text become their ids, as in the library; an empty table gives no
rows. Extra columns are dropped.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkernel as K
from .bpe import byte_characters
from .common import bound_batches, held, materialise, shared_dir, small

#: ``row`` ascends over all files in the order of the documents.
SCHEMA = "doc_id bigint, row bigint, ids array<int>"
_KNOWN, _SLICE = 500_000, 4 << 20

#: The pattern that the vectorised cut follows: letter runs, single digits, runs of other characters,
#: and endings after an apostrophe (texts with one go the library's way).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_KIND = np.full(256, 3, np.uint8)
_KIND[K.SPACE] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 192), 0xC3]] = 1  # 0xC3 leads most Latin-1 letters
_KIND[48:58] = 2
#: Bytes that send their chunk the library's way: controls, apostrophe, less-than, other leads.
_ODD = np.array([(b < 33 and not K.SPACE[b]) or b in (0x27, 0x3C, 0x7F) or (b >= 0xC0 and b != 0xC3) for b in range(256)])


class ChunkEncoder:
    """The library's ids of texts. For models that drop white space and split by ``PATTERN``, whole
    batches are cut into pieces by array operations, and each distinct piece is encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.known: dict[str, bytes] = {}
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.by_pieces = (
            steps == ["NFC", "Replace", "Lowercase"] and [c["type"] for c in cuts] == ["Split", "ByteLevel"] and cuts[0]["behavior"] == "Removed"
            and cuts[0]["pattern"].get("Regex") == PATTERN and all(t["content"].startswith("<") for t in spec["added_tokens"])
        )
        self.letters = str.maketrans({chr(b): c for b, c in enumerate(byte_characters())})
        self.odd = re.compile("[^!-&(-;=-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]")

    def _learn(self, piece: str) -> bytes:
        if not (piece.isascii() and piece.isalnum()) and self.odd.search(piece):  # a whole chunk
            ids = self.library.encode(piece, add_special_tokens=False).ids
        else:
            own = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.library.model.tokenize(own)]
        if len(self.known) >= _KNOWN:
            self.known.clear()
        found = self.known[piece] = array("i", ids).tobytes()
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each text has; none for null."""
        ids, sizes = [np.zeros(0, "<i4")], [np.zeros(0, np.int64)]
        if self.by_pieces:
            parts = (self._pieces(t) for _, _, t in K.pieces(texts, _SLICE))
        else:
            rows = (np.array(self.library.encode(x or "", add_special_tokens=False).ids, "<i4") for x in texts.to_pylist())
            parts = ((r, np.array([len(r)])) for r in rows)
        for own, n in parts:
            ids.append(own)
            sizes.append(n)
        return np.concatenate(ids), np.concatenate(sizes)

    def _pieces(self, t: K.Texts) -> tuple[np.ndarray, np.ndarray]:
        starts, ends = t.spans(K.SPACE)
        if not len(starts):
            return np.zeros(0, "<i4"), np.zeros(t.n, np.int64)
        kind, low = _KIND[t.buf], K.LOWER[t.buf]
        lead = np.flatnonzero(t.buf == 0xC3)
        second = t.buf[lead + 1]
        upper = lead[(second <= 0x9E) & (second != 0x97)] + 1
        low[upper] += 32
        # chunks with an odd character stay whole
        hits = np.concatenate([np.flatnonzero(_ODD[t.buf]), lead[(second == 0x97) | (second == 0xB7)]])
        odd = np.unique(np.searchsorted(starts, hits, "right") - 1)
        edge = np.zeros(len(kind) + 1, np.int8)
        edge[starts[odd]] += 1
        edge[ends[odd]] -= 1
        whole = np.cumsum(edge[:-1], dtype=np.int8) > 0
        kind[whole], low[whole] = 4, t.buf[whole]
        begin = kind == 2
        begin[1:] |= kind[1:] != kind[:-1]
        begin[starts] = True
        filled = kind != 0
        begin &= filled
        at = np.flatnonzero(begin)
        bounds = np.append(np.cumsum(filled, dtype=np.int32)[at] - 1, np.count_nonzero(filled)).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(at), pa.py_buffer(bounds), pa.py_buffer(low[filled])).dictionary_encode()
        known = self.known.get
        ids = [self._learn(p) if (x := known(p)) is None else x for p in coded.dictionary.to_pylist()]
        size = np.array([len(x) >> 2 for x in ids], np.int32)
        pool, first = np.frombuffer(b"".join(ids), "<i4"), np.cumsum(size) - size
        which = coded.indices.to_numpy()
        n = size[which]
        done = np.append(0, np.cumsum(n))
        out = pool[np.arange(done[-1]) + np.repeat(first[which] - done[:-1], n)]
        return out, np.diff(done[np.searchsorted(at, t.offsets)])


def token_ids(text: Column, path: str, end_id: int | None) -> Column:
    """Ids of each text, ``end_id`` appended, as an array of integers."""

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        own = held(("ids", path), lambda: ChunkEncoder(path))
        ids, n = own.encode(texts)
        if end_id is not None:
            ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(ids, pa.int32()))

    return run(text)


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int | None = 1, files: int | None = None) -> None:
    """Writes doc_id, row and ids of every row of ``docs`` to ORC files under ``path``."""
    bound_batches(docs.sparkSession)
    files = files or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_tie"))
    rows = rows.repartitionByRange(files, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    encoded = rows.select("doc_id", F.monotonically_increasing_id().alias("row"), token_ids(F.col("text"), tokenizer, end_id).alias("ids"))
    writer = encoded.write.option("compression", "zstd").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
    writer.option("orc.row.index.stride", "1000").option("orc.stripe.size", str(16 << 20)).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).orc(path)


def look_up(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of some documents; other stripes and row groups are skipped by index and filter."""
    return read_tokens(spark, path).where(F.col("doc_id").isin(doc_ids))


def _digest(ids: Column) -> Column:
    @F.arrow_udf("struct<n:bigint,crc:bigint>")
    def run(rows: pa.Array) -> pa.Array:
        values, offsets = rows.values.to_numpy(zero_copy_only=False).astype("<u4"), rows.offsets.to_numpy()
        raw = memoryview(values.tobytes())
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64())], names=["n", "crc"])

    return run(ids)


def positions(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens and ids_crc32."""
    bound_batches(spark)
    rows = read_tokens(spark, path).select("doc_id", "row", F.col("_metadata.file_name").alias("file"), _digest(F.col("ids")).alias("d"))
    rows = materialise(rows.select("doc_id", "row", "file", F.col("d.n").alias("n"), F.col("d.crc").alias("crc")))
    # one row per file; rows ascend from file to file
    before = Window.orderBy("least").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("file").agg(F.sum("n").alias("n"), F.min("row").alias("least"))
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("at", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(small(files, rows.select("file").distinct().count()), "file")
    return placed.select("doc_id", (F.col("first") + F.col("at")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def scratch_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/corpusloom/tokens-{uuid.uuid4().hex}"
