"""Readers and writers. Binary formats go through ``binaryFile`` and an Arrow-batched function;
line formats are plain Spark readers with native parsing."""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import strip_markup


def decode_bytes(raw: bytes) -> str:
    """Strict UTF-8 without a byte-order mark, else windows-1251."""
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return raw.decode("cp1251", "replace")


def book_text(raw: bytes) -> str:
    """A book's markup or plain text: zip archives give their documents in archive order, fb2 loses
    its description and binaries; control characters go, NUL is a line end."""
    if raw[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            names = [n for n in z.namelist() if n.lower().endswith((".html", ".xhtml", ".htm", ".fb2"))]
            text = "\n".join(decode_bytes(z.read(n)) for n in names)
    else:
        declared = re.match(rb"\s*<\?xml[^>]*encoding=[\"']([A-Za-z0-9_-]+)", raw[:200])
        try:
            text = raw.decode(declared[1].decode()) if declared else decode_bytes(raw)
        except (LookupError, UnicodeDecodeError):
            text = decode_bytes(raw)
    if "<FictionBook" in text[:2000]:
        text = re.sub(r"(?s)<(description|binary)\b.*?</\1>", "", text)
        text = re.sub(r"(?s)<body\s+name=\"notes\".*?</body>", "", text)
    text = text.replace("\0", "\n")
    return re.sub(r"[\x01-\x08\x0b\x0c\x0e-\x1f]", "", text)


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """path and text of each file, whatever of the two encodings it has."""

    @F.pandas_udf("string")
    def decode(raw: pd.Series) -> pd.Series:
        return raw.map(decode_bytes)

    return spark.read.format("binaryFile").load(path).select("path", decode("content").alias("text"))


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """path and readable text of txt, html, fb2 and epub files; markup is stripped natively."""

    @F.pandas_udf("string")
    def body(raw: pd.Series) -> pd.Series:
        return raw.map(book_text)

    return spark.read.format("binaryFile").load(path).select("path", strip_markup(body("content")).alias("text"))


def stress_lines(lines: Column) -> Column:
    """``word variant`` (a plus sign before the stressed vowel); comments and blanks give null."""
    word = F.regexp_extract(lines, r"^\s*([^#\s]\S*)\s+(\S+)\s*(?:#.*)?$", 1)
    return F.when(word != "", F.struct(F.lower(word).alias("word"), F.regexp_extract(lines, r"^\s*([^#\s]\S*)\s+(\S+)\s*(?:#.*)?$", 2).alias("variant")))


def read_stress_list(spark: SparkSession, path: str, priority: int = 0) -> DataFrame:
    rows = spark.read.text(path).select(stress_lines(F.col("value")).alias("r"), F.lit(priority).alias("priority"), F.monotonically_increasing_id().alias("line_no"))
    return rows.where("r is not null").select("r.*", "priority", "line_no")


def replacement_line(key: Column, value: Column) -> Column:
    """The line that ``parse_rule`` reads back; literal number signs are doubled."""
    return F.concat(F.regexp_replace(key, "#", "##"), F.when(key.startswith("~"), " = ").otherwise("="), F.regexp_replace(value, "#", "##"))


def imported_lines(text: Column) -> Column:
    """Lines of a foreign dictionary: CR LF to LF, ``word=variant`` to ``word variant``."""
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")
    return F.transform(lines, lambda x: F.regexp_replace(x, r"^([^=#~\s]+)=(\S+)$", "$1 $2"))


def exportable(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Lines that another program can take, and the regex rules that it can't; comments go."""
    rows = lines.where(~F.col(column).rlike(r"^\s*(#(?!#)|$)"))
    return rows.where(~F.col(column).startswith("~")), rows.where(F.col(column).startswith("~"))


def read_treebank(spark: SparkSession, path: str) -> DataFrame:
    """Blank-line separated ten-column blocks: sentence number in the file, token number, columns."""
    names = ["id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc"]
    blocks = spark.read.option("lineSep", "\n\n").text(path).select(F.monotonically_increasing_id().alias("sentence"), F.posexplode(F.split("value", "\n")).alias("row", "line"))
    cells = F.split("line", "\t")
    kept = blocks.where(~F.col("line").startswith("#") & (F.size(cells) == len(names)))
    return kept.select("sentence", "row", *[F.get(cells, F.lit(i)).alias(n) for i, n in enumerate(names)])


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per line with tagged forms: word, form, tags."""
    schema = "word string, pos string, forms array<struct<form:string,tags:array<string>>>"
    return spark.read.schema(schema).json(path).select("word", "pos", F.explode("forms").alias("f")).select("word", "pos", "f.form", "f.tags")


def read_dump_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of an XML dump: title and text."""
    schema = "title string, revision struct<text:struct<_VALUE:string>>"
    rows = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    return rows.select("title", F.col("revision.text._VALUE").alias("text"))


def read_wav(raw: bytes) -> tuple[list[float], int] | None:
    """Samples (mono; channels are averaged) and rate of PCM 8/16 bit or 32-bit float."""
    import numpy as np

    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        return None
    at, kind, channels, rate, bits, data = 12, 0, 1, 0, 0, b""
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], int.from_bytes(raw[at + 4 : at + 8], "little")
        body = raw[at + 8 : at + 8 + size]
        if name == b"fmt ":
            kind, channels, rate, bits = (int.from_bytes(body[a:b], "little") for a, b in ((0, 2), (2, 4), (4, 8), (14, 16)))
        elif name == b"data":
            data = body
        at += 8 + size + size % 2
    if (kind, bits) == (1, 16):
        x = np.frombuffer(data[: len(data) // 2 * 2], "<i2") / 32768.0
    elif (kind, bits) == (1, 8):
        x = (np.frombuffer(data, np.uint8) - 128.0) / 128.0
    elif (kind, bits) == (3, 32):
        x = np.frombuffer(data[: len(data) // 4 * 4], "<f4").astype(float)
    else:
        return None
    x = x[: len(x) // channels * channels].reshape(-1, channels).mean(axis=1)
    return x.tolist(), rate


def read_waves(spark: SparkSession, path: str) -> DataFrame:
    @F.pandas_udf("struct<pcm:array<double>,rate:int>")
    def run(raw: pd.Series) -> pd.DataFrame:
        rows = [read_wav(r) or (None, None) for r in raw]
        return pd.DataFrame({"pcm": [r[0] for r in rows], "rate": pd.array([r[1] for r in rows], "Int32")})

    return spark.read.format("binaryFile").load(path).select("path", run("content").alias("w")).select("path", "w.*")


def write_sorted_table(df: DataFrame, key: str, path: str, files: int | None = None) -> None:
    """A dimension as Parquet in the order of its key, so look-ups prune files and row groups."""
    rows = df.repartitionByRange(files, key) if files else df.repartitionByRange(key)
    rows.sortWithinPartitions(key).write.mode("overwrite").parquet(path)
