"""Streams with keyed state and timers: the index retry queue, and messages put back into order.

They need the RocksDB state store (:func:`state_store`), which keeps state on disk and in the checkpoint; a restart
goes on with what it holds.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quaywise.operators import dispatch

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_store(spark: SparkSession) -> None:
    """Chooses the state store that timers and time to live need; to be called before a stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


# --------------------------------------------------------------------------- retry queue

OUTCOME = "doc_key string, catalog_id string, payload string, reason string, failed boolean"
RETRY = "doc_key string, catalog_id string, payload string, reason string, attempt int, action string"


class IndexRetries(StatefulProcessor):
    """Counts the failures of a document. Each but the last waits and is then handed out again (``RETRY``); the last one
    allowed becomes a final letter (``DEAD``) and leaves nothing behind. A success ends the count. A document that is
    not heard of for the time to live is forgotten."""

    def __init__(self, most: int, first_ms: int, factor: float, longest_ms: int, ttl_ms: int) -> None:
        self.most, self.first_ms, self.factor, self.longest_ms, self.ttl_ms = most, first_ms, factor, longest_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("failure", "attempt int, catalog_id string, payload string, reason string", self.ttl_ms)

    def wait_ms(self, attempt: int) -> int:
        return int(min(self.longest_ms, self.first_ms * self.factor ** (attempt - 1)))

    def end(self) -> None:
        self.state.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        dead = []
        for frame in rows:
            for r in frame.itertuples():
                if not r.failed:
                    self.end()
                    continue
                attempt = (self.state.get()[0] if self.state.exists() else 0) + 1
                if attempt >= self.most:
                    self.end()
                    dead.append((key[0], r.catalog_id, r.payload, r.reason, attempt, "DEAD"))
                else:
                    self.state.update((attempt, r.catalog_id, r.payload, r.reason))
                    self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms(attempt))
        yield pd.DataFrame(dead, columns=["doc_key", "catalog_id", "payload", "reason", "attempt", "action"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        again = []
        if self.state.exists():
            attempt, catalog, payload, reason = self.state.get()
            again.append((key[0], catalog, payload, reason, attempt, "RETRY"))
        yield pd.DataFrame(again, columns=["doc_key", "catalog_id", "payload", "reason", "attempt", "action"])

    def close(self) -> None:
        pass


def retry_queue(
    outcomes: DataFrame, most: int = dispatch.INDEX_ATTEMPTS, first_ms: int = 1000, factor: float = 2.0, longest_ms: int = 30_000, ttl_ms: int = 24 * 3600 * 1000
) -> DataFrame:
    """Outcomes of index writes (:data:`OUTCOME`) as retries that are due and final letters (:data:`RETRY`). Waits are
    timers of processing time, so a retry comes with the first batch after it is due."""
    processor = IndexRetries(most, first_ms, factor, longest_ms, ttl_ms)
    return outcomes.groupBy("doc_key").transformWithStateInPandas(processor, RETRY, "Append", "ProcessingTime")


# --------------------------------------------------------------------------- order of a key's messages

ORDERED = "key string, value string, place long, turn long, state string"


class KeyOrder(StatefulProcessor):
    """Messages of a key carry their place (1, 2, 3 ...). What comes in its turn passes; what comes early is held until the
    gap before it closes or has stood for too long; what comes after its turn is marked as late."""

    def __init__(self, gap_ms: int, first: int) -> None:
        self.gap_ms, self.first = gap_ms, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "place long, turn long")
        self.held = handle.getMapState("held", "place long", "value string")

    def _passed(self, key, place: int, turn: int, out: list) -> tuple[int, int]:
        """Hands out what is held from ``place`` on, as far as it goes without a gap."""
        while self.held.containsKey((place,)):
            turn += 1
            out.append((key[0], self.held.getValue((place,))[0], place, turn, "in turn"))
            self.held.removeKey((place,))
            place += 1
        return place, turn

    def _waiting(self) -> list[int]:
        return sorted(k[0] for k in self.held.keys())

    def _stopped(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        place, turn = self.next.get() if self.next.exists() else (self.first, 0)
        began, out = place, []
        for frame in rows:
            for r in frame.itertuples():
                if r.place < place:
                    turn += 1
                    out.append((key[0], r.value, int(r.place), turn, "late"))
                else:
                    self.held.updateValue((int(r.place),), (r.value,))
                    place, turn = self._passed(key, place, turn, out)
        self.next.update((place, turn))
        timers = list(self.handle.listTimers())
        if not self._waiting():
            self._stopped()
        elif place != began or not timers:  # a new gap stands at the front: its time begins now
            self._stopped()
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.gap_ms)
        yield pd.DataFrame(out, columns=["key", "value", "place", "turn", "state"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out: list = []
        waiting = self._waiting()
        if waiting:
            place, turn = self._passed(key, waiting[0], self.next.get()[1], out)
            self.next.update((place, turn))
            if self._waiting():
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.gap_ms)
        yield pd.DataFrame(out, columns=["key", "value", "place", "turn", "state"])

    def close(self) -> None:
        pass


def in_key_order(messages: DataFrame, gap_ms: int = 30_000, first: int = 1) -> DataFrame:
    """``key, value, place, turn, state`` of messages (``key, value, place``): ``turn`` counts what a key has handed out, so
    that sorting by it gives the order of the places, whatever the order of arrival. A message that comes twice is
    late the second time."""
    asked = messages.select("key", "value", "place")
    return asked.groupBy("key").transformWithStateInPandas(KeyOrder(gap_ms, first), ORDERED, "Append", "ProcessingTime")


# --------------------------------------------------------------------------- a table that is read again


class Reread:
    """A table beside a stream that is loaded again once it is older than some seconds. A batch calls it once and keeps
    what it gets, so that all of a batch meets one version; ``load`` should resolve a version when it is called."""

    def __init__(self, load: Callable[[], DataFrame], seconds: float = 60.0, clock: Callable[[], float] = time.monotonic) -> None:
        self.load, self.seconds, self.clock = load, seconds, clock
        self.loaded_at: float | None = None
        self.loads = 0

    def __call__(self) -> DataFrame:
        now = self.clock()
        if self.loaded_at is None or now - self.loaded_at >= self.seconds:
            self.table, self.loaded_at = self.load(), now
            self.loads += 1
        return self.table
