"""A cache of phrases with a budget of bytes: the least recently used ones go first.

Requests (owner, phrase, size, ts) meet one cache for each owner. A phrase that is there is a hit and becomes
the most recent; another one is put in and the oldest leave until all fit; one above ``share`` of the
budget isn't kept at all. ``replay`` runs over a table, ``cached`` over a stream with the cache as keyed
state; both give the same for requests in the same order. Only caches are in memory, never an owner's
requests: a batch is read in sorted order, so one owner may have any number of them.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class Cache:
    """Phrases with their sizes, the most recent last."""

    def __init__(self, budget: int, share: float):
        self.budget, self.limit = budget, budget * share
        self.held: OrderedDict[str, int] = OrderedDict()
        self.bytes = 0

    def ask(self, phrase: str, size: int) -> tuple[bool, list[str]]:
        """Whether it is a hit, and the phrases that leave."""
        if phrase in self.held:
            self.held.move_to_end(phrase)
            return True, []
        gone = []
        if size <= self.limit:
            self.held[phrase] = size
            self.bytes += size
            while self.bytes > self.budget:
                old, n = self.held.popitem(last=False)
                self.bytes -= n
                gone.append(old)
        return False, gone


_OUT = "owner {kind}, phrase string, ts timestamp, hit boolean, evicted int"


def replay(requests: DataFrame, budget: int, share: float = 0.25) -> DataFrame:
    """owner, phrase, ts, hit and evicted (how many phrases left) of every request, in order of ts and
    phrase within an owner."""
    kind = dict(requests.dtypes)["owner"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, cache = None, None
        for frame in frames:
            hits, gone = [], []
            for o, phrase, size in zip(frame["owner"], frame["phrase"], frame["size"], strict=True):
                if cache is None or o != owner:
                    owner, cache = o, Cache(budget, share)
                hit, left = cache.ask(phrase, size)
                hits.append(hit)
                gone.append(len(left))
            yield frame[["owner", "phrase", "ts"]].assign(hit=hits, evicted=pd.Series(gone, dtype="int32"))

    rows = requests.select("owner", "phrase", F.col("size").cast("long").alias("size"), F.col("ts").cast("timestamp").alias("ts")).where("owner is not null and phrase is not null")
    ordered = rows.repartition("owner").sortWithinPartitions("owner", "ts", "phrase")
    return ordered.mapInPandas(run, _OUT.format(kind=kind))


class _Owner(StatefulProcessor):
    """The cache of an owner as a map of phrase to (size, turn) and the number of turns so far; an owner
    who is silent for ``silence_ms`` loses it (never, if that is None)."""

    def __init__(self, budget: int, share: float, silence_ms: int | None):
        self.budget, self.share, self.silence_ms = budget, share, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.phrases = handle.getMapState("phrases", "phrase string", "size long, turn long")
        self.turns = handle.getValueState("turns", "turn long, timer long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["ts", "phrase"], kind="stable")
        turn, timer = self.turns.get() if self.turns.exists() else (0, 0)
        cache = Cache(self.budget, self.share)
        for (phrase,), (size, _) in sorted(self.phrases.iterator(), key=lambda x: x[1][1]):
            cache.held[phrase] = size
            cache.bytes += size
        before, hits, gone, last = dict(cache.held), [], [], {}
        for phrase, size in zip(frame["phrase"], frame["size"], strict=True):
            turn += 1
            last[phrase] = turn
            hit, left = cache.ask(phrase, int(size))
            hits.append(hit)
            gone.append(len(left))
        for phrase in before.keys() - cache.held.keys():
            self.phrases.removeKey((phrase,))
        for phrase in last.keys() & cache.held.keys():
            self.phrases.updateValue((phrase,), (cache.held[phrase], last[phrase]))
        if self.silence_ms is not None:
            if timer:
                self.handle.deleteTimer(timer)
            timer = timerValues.getCurrentProcessingTimeInMs() + self.silence_ms
            self.handle.registerTimer(timer)
        self.turns.update((turn, timer))
        yield pd.DataFrame({"owner": key[0], "phrase": frame["phrase"], "ts": frame["ts"], "hit": hits, "evicted": pd.Series(gone, index=frame.index, dtype="int32")})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.phrases.clear()
        self.turns.clear()
        return iter([])

    def close(self) -> None:
        pass


def cached(requests: DataFrame, budget: int, share: float = 0.25, silence_ms: int | None = None) -> DataFrame:
    """``replay`` on a stream: each batch's requests of an owner in order of ts and phrase, batches in the
    order they come. Needs a state store that keeps maps (RocksDB). With ``silence_ms`` the query watches
    the clock, so it never ends by itself, not even with a trigger that takes what is there."""
    kind = dict(requests.dtypes)["owner"]
    rows = requests.select("owner", "phrase", F.col("size").cast("long").alias("size"), F.col("ts").cast("timestamp").alias("ts")).where("owner is not null and phrase is not null")
    return rows.groupBy("owner").transformWithStateInPandas(
        statefulProcessor=_Owner(budget, share, silence_ms), outputStructType=_OUT.format(kind=kind), outputMode="Append", timeMode="None" if silence_ms is None else "ProcessingTime"
    )
