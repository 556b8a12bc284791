"""Mappings from synthetic values back to originals, per key, that expire 30 minutes after the last write.

Events have a key, a time and a kind: 'write' (fake, original), 'clear' (of the key) and 'clear_all'.
A key's whole map goes when more than the time to live has passed since its last write; reads don't
touch it.  The batch plan gives the state at a moment; the stream keeps it in a state store.
"""

from __future__ import annotations

import json
import math
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.patterns import TTL_MINUTES
from ..functions.validators import micros

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
OUT = "key string, ts timestamp, action string, n int, mappings string"
# As they leave Python: a row for each key, since a frame costs more than its rows.
_PACKED = "key string, changes array<struct<ms:bigint,action:string,n:int,mappings:string>>"
#: Such a row ends with this many changes, or characters of mappings.
PACK, PACK_CHARS = 10_000, 4_000_000


def sessions(events: DataFrame, key: str, ts: str, minutes: int = TTL_MINUTES) -> DataFrame:
    """One row per unbroken use of a key: a gap of more than `minutes` begins a new one; one of exactly that doesn't."""
    w = session_bounds(events, key, ts, minutes)
    return w.groupBy(key, "session").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n_events"))


def session_bounds(events: DataFrame, key: str, ts: str, minutes: int = TTL_MINUTES) -> DataFrame:
    """events with the number of their session within the key."""
    order = Window.partitionBy(key).orderBy(ts)
    gap = micros(ts) - micros(F.lag(ts).over(order))
    new = F.when(gap > minutes * 60_000_000, 1).otherwise(0)
    return events.withColumn("_new", new).withColumn("session", F.sum("_new").over(order)).drop("_new")


def state_at(events: DataFrame, moment: Column, minutes: int = TTL_MINUTES) -> DataFrame:
    """key, fake, original, touched_at: the mappings that live at a moment, from events (key, ts, kind, fake, original).

    Only writes since the key's last expiry or clearing count; later writes of a synthetic value win.
    """
    past = events.filter(F.col("ts") <= moment)
    cleared = past.filter("kind = 'clear_all'").agg(F.max("ts").alias("_all"))
    keyed = past.filter("kind <> 'clear_all'")
    clear = keyed.filter("kind = 'clear'").groupBy("key").agg(F.max("ts").alias("_clear"))
    writes = session_bounds(keyed.filter("kind = 'write'"), "key", "ts", minutes)
    last = Window.partitionBy("key")
    live = writes.withColumn("_last", F.max("session").over(last)).withColumn("touched_at", F.max("ts").over(last)).filter("session = _last")
    live = live.filter(micros(moment) - micros("touched_at") <= minutes * 60_000_000)
    # One row: the last time that everything was cleared.
    live = live.join(clear, "key", "left").join(F.broadcast(cleared), F.lit(True), "left")
    live = live.filter((F.col("_clear").isNull() | (F.col("ts") > F.col("_clear"))) & (F.col("_all").isNull() | (F.col("ts") > F.col("_all"))))
    return live.groupBy("key", "fake").agg(F.max_by("original", "ts").alias("original"), F.max("touched_at").alias("touched_at"))


def orphans(store: DataFrame, live: DataFrame, key: str, live_key: str) -> DataFrame:
    """Mappings of keys that don't live any more."""
    return store.join(live.select(F.col(live_key).alias("_live")), store[key] == F.col("_live"), "left_anti")


def kept(store: DataFrame, live: DataFrame, key: str, live_key: str) -> DataFrame:
    """Mappings of keys that do."""
    return store.join(live.select(F.col(live_key).alias("_live")), store[key] == F.col("_live"), "left_semi")


class MappingStore(StatefulProcessor):
    """State of one key: its map, and a timer that empties it when the time to live has passed since the last write.

    A key's state is one value, read and written once for each batch: every call to the store is a round trip to the JVM.
    """

    def __init__(self, minutes: int = TTL_MINUTES):
        self.ttl_ms = minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # The map as JSON: a list of its pairs.
        self.state = handle.getValueState("state", "ms bigint, pairs string")

    @staticmethod
    def _row(key: str, changes: list[dict]) -> pd.DataFrame:
        return pd.DataFrame({"key": [key], "changes": [changes]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = [e for part in rows for e in zip(*(part[c].tolist() for c in ("us", "kind", "fake", "original")))]
        # Where a time is missing, pandas has floats and NaN; those events are the last, as in SQL.
        events.sort(key=lambda e: e[0] if e[0] == e[0] else math.inf)
        before = self.state.get()
        own, touched = (dict(json.loads(before[1])), before[0]) if before else ({}, None)
        timer, shown, out, size = touched, _shown(own), [], 0
        for us, kind, fake, original in events:
            ms = int(us) // 1000 if us == us else None
            if None not in (ms, touched) and ms - touched > self.ttl_ms:
                own, touched, shown = {}, None, "{}"
                out.append({"ms": ms, "action": "expired", "n": 0, "mappings": shown})
            if kind == "write":
                if fake not in own or own[fake] != original:
                    own[fake] = original
                    shown = _shown(own)
                touched = touched if ms is None else ms
            elif kind == "clear":
                own, touched, shown = {}, None, "{}"
            out.append({"ms": ms, "action": kind, "n": len(own), "mappings": shown})
            size += len(shown)
            if len(out) >= PACK or size >= PACK_CHARS:
                yield self._row(key[0], out)
                out, size = [], 0
        if own:
            self.state.update((touched, json.dumps(list(own.items()))))
        else:
            self.state.clear()
        if timer != touched:
            if timer is not None:
                self.handle.deleteTimer(self._end(timer))
            if touched is not None:
                self.handle.registerTimer(self._end(touched))
        if out:
            yield self._row(key[0], out)

    def _end(self, ms: int) -> int:
        """A millisecond later: a pause of exactly the time to live keeps the map."""
        return ms + self.ttl_ms + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield self._row(key[0], [{"ms": expiredTimerInfo.getExpiryTimeInMs(), "action": "expired", "n": 0, "mappings": "{}"}])

    def close(self) -> None:
        pass


def _shown(own: dict[str, str]) -> str:
    return json.dumps(own, sort_keys=True, ensure_ascii=False)


def stream(events: DataFrame, minutes: int = TTL_MINUTES, late: str = "10 minutes") -> DataFrame:
    """A streaming plan over events (key, ts, kind, fake, original): one row per change of a key's state, in the order of ts.

    The watermark only bounds how long a silent key's state waits for its expiry.  Needs the RocksDB state store.
    """
    own = events.withWatermark("ts", late).select("key", "ts", "kind", "fake", "original", F.unix_micros("ts").alias("us"))
    out = own.groupBy("key").transformWithStateInPandas(MappingStore(minutes), outputStructType=_PACKED, outputMode="Update", timeMode="EventTime")
    return out.select("key", F.inline("changes")).select("key", F.timestamp_millis("ms").alias("ts"), "action", "n", "mappings")


def run_to_end(changes: DataFrame) -> DataFrame:
    """The rows of a streaming plan once it has read all there is, from a folder that all machines share.

    The state store is RocksDB for the time of the run, which map state and timers need.
    """
    spark = changes.sparkSession
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="stream-")
    folder = f"{shared}/stream-{uuid.uuid4().hex}"
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    try:
        changes.writeStream.option("checkpointLocation", f"{folder}/state").outputMode("update").trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before)
    return spark.read.schema(OUT).parquet(f"{folder}/rows")
