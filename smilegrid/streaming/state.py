"""Keyed state with its own variables and timers: newest values by event time, whatever the order of arrival, and reading state back.

These need the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``); ``use_rocksdb`` sets it for a session.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _Recent(StatefulProcessor):
    """A map from event time to the (last) value of that time, at most ``most`` of them, and the time of the timer that is set."""

    def __init__(self, key: str, ts: str, value: str, most: int, keep_ms: int) -> None:
        self.key, self.ts, self.value, self.most, self.keep_ms = key, ts, value, most, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getMapState("kept", "at long", "v double")
        self.timer = handle.getValueState("timer", "at long")

    def _row(self, key: tuple, kept: dict, expired: bool) -> pd.DataFrame:
        at = sorted(kept)
        vs = [kept[a] for a in at]
        last = pd.Timestamp(at[-1], unit="us") if at else pd.NaT
        return pd.DataFrame({self.key: [key[0]], self.ts: [last], "n": [len(vs)], "mean": [sum(vs) / len(vs) if vs else None], "change": [vs[-1] - vs[0] if vs else None], "expired": [expired]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803  (Spark's names)
        old = {k[0]: v[0] for k, v in self.kept.iterator()}
        kept = dict(old)
        for part in rows:
            part = part.dropna(subset=[self.ts, self.value])
            part = part.sort_values([self.ts, self.value]).tail(self.most)
            kept |= dict(zip(part[self.ts].astype("datetime64[us]").astype("int64").tolist(), part[self.value].tolist(), strict=True))
            kept = {a: kept[a] for a in sorted(kept)[-self.most :]}
        for a in old.keys() - kept.keys():
            self.kept.removeKey((a,))
        for a, v in kept.items():
            if old.get(a) != v:
                self.kept.updateValue((a,), (v,))
        if not kept:
            return
        if self.keep_ms:
            due = max(kept) // 1000 + self.keep_ms
            set_ = self.timer.get()[0] if self.timer.exists() else None
            if set_ != due:  # one timer a key: it follows the newest value
                if set_ is not None:
                    self.handle.deleteTimer(set_)
                self.handle.registerTimer(due)
                self.timer.update((due,))
        if kept != old:
            yield self._row(key, kept, expired=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        kept = {k[0]: v[0] for k, v in self.kept.iterator()}
        self.kept.clear()
        self.timer.clear()
        yield self._row(key, kept, expired=True)

    def close(self) -> None:
        pass


def recent_values(events: DataFrame, key: str, ts: str, value: str, *, most: int = 22, late: str = "1 hour", keep_ms: int = 86_400_000) -> DataFrame:
    """With each batch that changes a key's newest values: how many are kept (at most ``most``), their mean and the change over them.

    Values are placed by event time, so late ones fall where they belong; a second value of one time replaces the first. Once the
    watermark (``late`` behind the newest event of all keys) is ``keep_ms`` past a key's newest value, a last row with expired
    is given and the key is forgotten. Rows without a time or a value are left out.
    """
    kind = events.schema[key].dataType.simpleString()
    rows = events.select(F.col(key), F.col(ts).cast("timestamp").alias(ts), F.col(value).cast("double").alias(value)).where(F.col(ts).isNotNull() & F.col(value).isNotNull())
    schema = f"`{key}` {kind}, `{ts}` timestamp, n int, mean double, change double, expired boolean"
    return rows.withWatermark(ts, late).groupBy(key).transformWithStateInPandas(_Recent(key, ts, value, most, keep_ms), schema, "Update", "EventTime")


class _Latest(StatefulProcessor):
    def __init__(self, key: str, ts: str, names: list[str], ttl_ms: int | None) -> None:
        self.key, self.ts, self.names, self.ttl_ms = key, ts, names, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "at long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        best, at = None, self.at.get()[0] if self.at.exists() else None
        for part in rows:
            part = part.dropna(subset=[self.ts])
            if not part.empty:
                row = part.loc[[part[self.ts].idxmax()]]
                micros = int(row[self.ts].astype("datetime64[us]").astype("int64").iloc[0])
                if at is None or micros > at:
                    best, at = row, micros
        if best is not None:
            self.at.update((at,))
            yield best[[self.key, self.ts, *self.names]]

    def close(self) -> None:
        pass


def latest_quotes(quotes: DataFrame, key: str, ts: str, *, ttl_ms: int | None = None) -> DataFrame:
    """A key's whole newest row (by event time, whatever the order of arrival) with each batch that brings a newer one.

    The state is one instant a key; with ``ttl_ms`` a key that is silent for so long (of processing time) is forgotten; Spark then
    runs batches without data too, so such a query is never idle."""
    names = [c for c in quotes.columns if c not in (key, ts)]
    rows = quotes.select(key, F.col(ts).cast("timestamp").alias(ts), *names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.groupBy(key).transformWithStateInPandas(_Latest(key, ts, names, ttl_ms), schema, "Update", "None" if ttl_ms is None else "ProcessingTime")


def read_state(spark: SparkSession, checkpoint: str, name: str, *, batch: int | None = None) -> DataFrame:
    """The rows of one state variable of a query, from its checkpoint: as of the last batch, or of an earlier one that is still kept."""
    rows = spark.read.format("statestore").option("stateVarName", name)
    return (rows if batch is None else rows.option("batchId", batch)).load(checkpoint)
