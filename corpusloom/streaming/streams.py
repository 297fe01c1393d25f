"""Streaming twins: the native rules are stateless, so the same expressions run on a stream; keyed
counts, windows and sessions use watermarks, and a moving level keeps its own state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.rules import Switches, normalise
from ..operators.segment import WORD


def read_table_stream(spark: SparkSession, path: str, files_per_trigger: int = 1, pattern: str | None = None) -> DataFrame:
    """A Parquet folder as a stream; the schema is that of the files there now."""
    source = f"{path}/{pattern}" if pattern else path
    reader = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", files_per_trigger)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).parquet(path)


def normalised(stream: DataFrame, column: str = "text", switches: Switches = Switches()) -> DataFrame:
    return normalise(stream.withColumn("normalised", F.col(column)), "normalised", switches)


def word_counts(stream: DataFrame, column: str = "text") -> DataFrame:
    """Running counts of words (update or complete mode)."""
    words = stream.select(F.explode(F.transform(F.regexp_extract_all(F.col(column), F.lit(WORD), F.lit(0)), F.lower)).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def _timed(events: DataFrame) -> DataFrame:
    """Watermarks want an instant; a stored time without a zone is read in the session's."""
    local = dict(events.dtypes)["ts"] == "timestamp_ntz" and events.isStreaming
    return events.withColumn("ts", F.col("ts").cast("timestamp")) if local else events


def tumbling(events: DataFrame, size: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts and sums of events by type in tumbling or sliding windows of event time."""
    span = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = _timed(events).withWatermark("ts", late).groupBy(span.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("starts"), F.col("w.end").alias("ends"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    out = _timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select("user_id", F.col("w.start").alias("starts"), F.col("w.end").alias("ends"), "n", "total")


def first_seen(stream: DataFrame, keys: list[str], late: str) -> DataFrame:
    """One row for each key within the watermark."""
    return _timed(stream).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def moving_level(stream: DataFrame, key: str, value: str, keep: float = 0.8) -> DataFrame:
    """An exponential moving average per key, kept as state: level = keep * level + (1 - keep) * x,
    over each batch's rows in order of ``ts``."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values("ts")
        for x in rows[value]:
            level = float(x) if level is None else keep * level + (1 - keep) * float(x)
            n += 1
        state.update((level, n))
        yield pd.DataFrame({key: [k[0]], "level": [level], "n": [n]})

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, level double, n long", "level double, n long", "update", GroupStateTimeout.NoTimeout)


def run_to_memory(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns the result table (for tests and small runs)."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
