"""Keyed state with expiry: a ledger of lookups and hints of what was opened, as stateful stream operators with event-time timers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.tables import shared_folder

CAPACITY, LEAST_CAPACITY, RESERVE = 2000, 512, 64
TTL_MS = 7 * 24 * 3600 * 1000
HINTS = 256
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _rows(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A key's rows of one micro-batch, in the order of time and number."""
    return pd.concat(list(frames)).sort_values(["at_ms", "event"], kind="stable")


class Ledger(StatefulProcessor):
    """One lookup a key: when it was opened, its capacity and what is used of it, and the sources that its searches gave.

    A search opens a lookup where none is alive. A request that does not fit what is left, less a reserve, is refused; so is
    a read of a source that no search of the lookup has given, and one without a lookup. A lookup lives for `ttl_ms` after it was opened:
    a later row finds none, and a timer then takes it out of the state.
    """

    def __init__(self, ttl_ms: int = TTL_MS, reserve: int = RESERVE):
        self.ttl_ms, self.reserve = ttl_ms, reserve

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lookup = handle.getValueState("lookup", "opened long, capacity long, used long")
        self.sources = handle.getMapState("sources", "source string", "given boolean")

    def _forget(self) -> None:
        self.lookup.clear()
        self.sources.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.lookup.get() if self.lookup.exists() else None
        given = set() if state is None else {source for (source,) in self.sources.keys()}  # read once, as each call goes over a socket
        changed, fresh, out = False, set(), []
        for event, at, search, source, cost, capacity in _rows(rows)[["event", "at_ms", "search", "source", "cost", "capacity"]].itertuples(index=False):
            if state is not None and at > state[0] + self.ttl_ms:
                self._forget()
                state, changed, given, fresh = None, True, set(), set()
            if state is None and search:
                state, changed = (int(at), int(min(CAPACITY, max(LEAST_CAPACITY, capacity))), 0), True
                self.handle.registerTimer(int(at) + self.ttl_ms + 1)
            if state is None:
                status = "unknown_lookup"
            elif not search and source not in given:
                status = "outside_lookup"
            elif cost > state[1] - state[2] - self.reserve:
                status = "over_budget"
            else:
                status, state, changed = "admitted", (*state[:2], state[2] + int(cost)), True
                if search and source not in given:
                    given.add(source)
                    fresh.add(source)
            out.append((key[0], int(event), status, None if state is None else state[2]))
        if changed and state is not None:
            self.lookup.update(state)
        for source in fresh:
            self.sources.updateValue((source,), (True,))
        yield pd.DataFrame(out, columns=["lookup", "event", "status", "used"]).astype({"used": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.lookup.exists() and self.lookup.get()[0] + self.ttl_ms < expiredTimerInfo.getExpiryTimeInMs():
            self._forget()
        return iter(())

    def close(self) -> None:
        pass


class Hints(StatefulProcessor):
    """When each source was opened last, forgotten after `ttl_ms`; gives (source, opened_ms), null where a hint has gone."""

    def __init__(self, ttl_ms: int = TTL_MS):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.opened = handle.getValueState("opened", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at = max(int(frame["at_ms"].max()) for frame in rows)
        old = self.opened.get()[0] if self.opened.exists() else None
        if old is None or at > old:
            if old is not None:
                self.handle.deleteTimer(old + self.ttl_ms + 1)
            self.opened.update((at,))
            self.handle.registerTimer(at + self.ttl_ms + 1)
        yield pd.DataFrame({"source": [key[0]], "opened_ms": pd.array([max(at, old or at)], "Int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.opened.clear()
        yield pd.DataFrame({"source": [key[0]], "opened_ms": pd.array([None], "Int64")})

    def close(self) -> None:
        pass


def admissions(requests: DataFrame, delay: str = "1 hour", ttl_ms: int = TTL_MS) -> DataFrame:
    """(lookup, event, status, used) for a stream of (lookup, event, at, search, source, cost, capacity).

    Rows of a key are taken in the order of time and number within a micro-batch, so the batches' own order decides beyond
    it; rows later than `delay` are dropped by the watermark. Rows without a key or time give no row. What a task holds at
    once is a key's rows of one micro-batch, without texts: bound it by the source's limit for a trigger.
    """
    rows = requests.where("lookup is not null and at is not null").withWatermark("at", delay).withColumn("at_ms", F.unix_millis("at"))
    return rows.groupBy("lookup").transformWithStateInPandas(Ledger(ttl_ms), f"lookup {requests.schema['lookup'].dataType.simpleString()}, event long, status string, used long", "Update", "EventTime")


def hints(opened: DataFrame, delay: str = "1 hour", ttl_ms: int = TTL_MS) -> DataFrame:
    """(source, opened_ms) changes for a stream of (source, at)."""
    rows = opened.where("source is not null and at is not null").withWatermark("at", delay).withColumn("at_ms", F.unix_millis("at"))
    return rows.groupBy("source").transformWithStateInPandas(Hints(ttl_ms), f"source {opened.schema['source'].dataType.simpleString()}, opened_ms long", "Update", "EventTime")


def drained(flow: DataFrame, at: str) -> None:
    """Run a stateful stream over what is there now; each micro-batch replaces the folder of its number below `at`."""
    spark = flow.sparkSession
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)  # keyed state with timers lives in RocksDB

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    try:
        flow.writeStream.outputMode("update").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
    finally:
        spark.conf.set(_STORE, before)


def run_ledger(spark: SparkSession, path: str, requests) -> DataFrame:
    """The admissions of a table of requests, read as a stream over what is there now; `requests` makes them of its rows."""
    at = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
    drained(admissions(requests(rows)), at)
    return spark.read.option("basePath", f"{at}/out").parquet(f"{at}/out").drop("batch")


def recent(opened: DataFrame, now=None, ttl_ms: int = TTL_MS, most: int = HINTS) -> DataFrame:
    """(source, opened): the sources opened within the time to live before `now` (the newest of all by default), the newest first."""
    last = opened.where("source is not null and at is not null").groupBy("source").agg(F.max("at").alias("opened"))
    newest = opened.agg(F.max("at").alias("now")) if now is None else opened.sparkSession.range(1).select(F.lit(now).alias("now"))
    alive = last.join(F.broadcast(newest), F.col("opened") >= F.col("now") - F.make_dt_interval(secs=F.lit(ttl_ms / 1000)))  # one row
    return alive.select("source", "opened").orderBy(F.desc("opened"), "source").limit(most)
