"""Streams give what the batch forms give."""

import pandas as pd
from pyspark.sql import functions as F

from corpusloom.streaming import streams as T

from .conftest import SF


def test_word_counts_match_batch(spark):
    batch = T.word_counts(spark.read.parquet(f"{SF}/benchmark.parquet"))
    stream = T.word_counts(T.read_table_stream(spark, SF, pattern="benchmark.parquet"))
    got = T.run_to_memory(stream, "word_counts_out", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_tumbling_in_update_mode(spark):
    events = T.read_table_stream(spark, SF, pattern="events.parquet")
    got = T.run_to_memory(T.tumbling(events, "1 hour", "1 hour"), "tumbling_out", "complete")
    assert got.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{SF}/events.parquet").count()


def test_moving_level_keeps_state(spark):
    events = T.read_table_stream(spark, SF, pattern="events.parquet")
    got = {r.user_id: r.level for r in T.run_to_memory(T.moving_level(events, "user_id", "value"), "level_out", "update").collect()}
    rows: pd.DataFrame = spark.read.parquet(f"{SF}/events.parquet").toPandas().sort_values("ts")
    user, own = next(iter(rows.groupby("user_id")))
    level = None
    for x in own["value"]:
        level = x if level is None else 0.8 * level + 0.2 * x
    assert abs(got[user] - level) < 1e-9
