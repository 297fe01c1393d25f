"""Small helpers shared by the operators: reading tables, cutting lineage, memory of workers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Only where driver and executors are
    one process (as in tests) may it be unset; then a temporary folder takes its place."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="corpusloom-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: lineage ends there, so
    a lost executor costs only the tasks that were running."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with as many underscores behind it as it takes to differ from all columns of ``df``:
    the caller's columns stay."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_key(text: Column) -> Column:
    """128-bit identity of a text; null stays null."""
    return F.unhex(F.md5(text))


def in_learning_part(doc_id: Column) -> Column:
    """Rows that models may learn from: crc32 of the id written as text, modulo 3, is not 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def _width(kind: T.DataType) -> int:
    """Bytes that a value takes in a broadcast table, at most, for types of bounded size."""
    if isinstance(kind, T.StructType):
        return 16 + sum(_width(f.dataType) for f in kind.fields)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return 48  # keys of 16 bytes, short names
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return 1 << 20  # of no known size: practically never broadcast
    return 8


def small(df: DataFrame, rows: int, limit: int = 48 << 20) -> DataFrame:
    """``df`` to be broadcast if its counted ``rows`` take at most ``limit`` bytes; beyond that Spark
    shuffles as usual."""
    return F.broadcast(df) if rows * (16 + _width(df.schema)) <= limit else df


def join_counted(rows: DataFrame, by_key: DataFrame, total: int, parts: int = 256) -> DataFrame:
    """Left join of ``rows`` to ``by_key`` (one row for each non-null ``key``, ``n`` of how many of the
    ``total`` rows have it). Keys with more than 1 / ``parts`` of the rows, of which there are fewer
    than ``parts``, are broadcast, so no task gets all the rows of a hot key; null keys aren't moved."""
    hot = by_key.where(F.col("n") * parts > total)
    values = [c for c in by_key.columns if c not in ("key", "n")]
    marked = rows.join(F.broadcast(hot.select("key", F.struct(*values).alias("_hot"))), "key", "left")
    own = [c for c in rows.columns if c != "key"]
    at_once = marked.where("_hot is not null or key is null").select("key", *own, *[F.col("_hot")[c].alias(c) for c in values])
    cold = by_key.where(F.col("n") * parts <= total).drop("n")
    return at_once.union(marked.where("_hot is null and key is not null").drop("_hot").join(cold, "key", "left").select("key", *own, *values))


def bound_batches(spark: SparkSession, rows: int = 1000, size: str = "4m") -> None:
    """Keeps Arrow batches small: texts are long, and a batch is in memory on both sides of the
    pipe to Python. Smaller settings of the caller's stay."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


_held: dict[Any, list] = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def _task() -> int | None:
    context = TaskContext.get()
    return context.taskAttemptId() if context else None


def forget() -> None:
    """Drops what earlier tasks of this process have held, and gives free memory back to the system,
    which allocators otherwise keep. Operators call it, or ``held``, once for every batch."""
    task = _task()
    old = [k for k, (_, at) in _held.items() if at != task]
    for k in old:
        del _held[k]
    if old:
        gc.collect()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def held(key: Any, build: Callable[[], Any]) -> Any:
    """``build()``, kept in this process under ``key`` for tasks to come. Spark reuses its Python
    workers for all operators of a session, so a worker holds one task's models at a time: those
    of other operators go when the next task asks for its own."""
    if key in _held:
        _held[key][1] = _task()
    forget()
    if key not in _held:
        _held[key] = [build(), _task()]
    return _held[key][0]
