"""Structured Streaming forms: windows with watermarks, and the latest quote of each key by event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, ts: str, size: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.withWatermark(ts, late) if events.isStreaming else rows
    return rows.groupBy(F.window(ts, size), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sliding(events: DataFrame, ts: str, size: str, step: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.withWatermark(ts, late) if events.isStreaming else rows
    return rows.groupBy(F.window(ts, size, step), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, ts: str, gap: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.withWatermark(ts, late) if events.isStreaming else rows
    return rows.groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), *keys, "n")


def latest_by_key(events: DataFrame, key: str, ts: str, value: str, late: str | None = None, keep_ms: int = 86_400_000) -> DataFrame:
    """Emits a key's newest value (by event time, whatever the order of arrival) with each batch that changes it.

    Values without a time are left out. With ``late`` given, values further behind are left out too, and a key is forgotten once
    the watermark is ``keep_ms`` past its newest value; without it every key is kept."""
    schema = f"{key} long, {ts} timestamp, {value} double"

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, v = state.get if state.exists and not state.hasTimedOut else (None, None)
        for pdf in batches:
            pdf = pdf.dropna(subset=[ts])
            if pdf.empty:
                continue
            row = pdf.loc[pdf[ts].idxmax()]
            micros = int(pd.Timestamp(row[ts]).value // 1000)
            if at is None or micros > at:
                at, v = micros, float(row[value])
        if state.hasTimedOut:
            state.remove()
            return
        if at is None:
            return
        state.update((at, v))
        if late:
            state.setTimeoutTimestamp(max(at // 1000 + keep_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]], ts: [pd.Timestamp(at, unit="us")], value: [v]})

    rows = events.select(F.col(key).cast("long").alias(key), F.col(ts).cast("timestamp").alias(ts), F.col(value).cast("double").alias(value))
    rows = rows.withWatermark(ts, late) if late else rows
    return rows.groupBy(key).applyInPandasWithState(step, schema, "at long, v double", "update", GroupStateTimeout.EventTimeTimeout if late else GroupStateTimeout.NoTimeout)


def recent_by_key(events: DataFrame, key: str, ts: str, value: str, most: int = 22, late: str | None = None, keep_ms: int = 86_400_000) -> DataFrame:
    """With each batch that brings a key rows: how many of its newest values are kept (at most ``most``), their mean, and the change from the
    oldest of them to the newest. The state is that list, in order of event time, whatever the order of arrival; rows without time or value are left out.
    With ``late`` given, a key is forgotten once the watermark is ``keep_ms`` past its newest value; without it every key is kept."""
    schema = f"{key} long, {ts} timestamp, n int, mean double, change double"

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(zip(*state.get)) if state.exists else []
        for pdf in batches:
            pdf = pdf.dropna(subset=[ts, value]).nlargest(most, [ts, value])
            kept = sorted([*kept, *zip((pdf[ts].astype("datetime64[us]").astype("int64")).tolist(), pdf[value].tolist())])[-most:]
        if not kept:
            return
        at, vs = (list(x) for x in zip(*kept))
        state.update((at, vs))
        if late:
            state.setTimeoutTimestamp(max(at[-1] // 1000 + keep_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]], ts: [pd.Timestamp(at[-1], unit="us")], "n": [len(vs)], "mean": [sum(vs) / len(vs)], "change": [vs[-1] - vs[0]]})

    rows = events.select(F.col(key).cast("long").alias(key), F.col(ts).cast("timestamp").alias(ts), F.col(value).cast("double").alias(value))
    rows = rows.withWatermark(ts, late) if late else rows
    return rows.groupBy(key).applyInPandasWithState(step, schema, "at array<long>, v array<double>", "update", GroupStateTimeout.EventTimeTimeout if late else GroupStateTimeout.NoTimeout)


def fresh(quotes: DataFrame, ts: str, now: object, seconds: int = 60) -> DataFrame:
    """Quotes at most so many seconds older than ``now`` (a column or an instant)."""
    return quotes.where(F.col(ts).cast("timestamp") >= F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(seconds)))


def alerts(portfolio: DataFrame, *, most_delta: float = 500.0, least_pnl: float = -1000.0) -> DataFrame:
    """A row for each limit that a portfolio row breaks; works on streams and tables."""
    tests = F.array(F.when(F.abs("delta") > most_delta, "delta"), F.when(F.col("pnl") < least_pnl, "pnl"))
    rows = portfolio.withColumn("alert", F.explode(F.filter(tests, lambda x: x.isNotNull())))
    return rows.withColumn("level", F.lit("WARNING"))


def joined_streams(left: DataFrame, right: DataFrame, key: str, ts: str, within: str, late: str = "1 hour") -> DataFrame:
    """Rows of two streams (or tables) with the same key whose times differ by at most ``within``; watermarks bound the state of streams.

    Tables are cut into cells of that length: a right row goes to its own cell and both neighbours, and meets the left rows of one
    cell only, not all those of its key."""
    a, b = (f.withColumn(ts, F.col(ts).cast("timestamp")) for f in (left, right))
    a, b = ((f.withWatermark(ts, late) if f.isStreaming else f) for f in (a, b))
    b = b.select(*[F.col(c).alias(f"r_{c}") for c in b.columns])
    gap = F.expr(f"INTERVAL {within}")
    near = (F.col(key) == F.col(f"r_{key}")) & F.col(f"r_{ts}").between(F.col(ts) - gap, F.col(ts) + gap)
    if a.isStreaming or b.isStreaming:
        return a.join(b, near)
    width = F.greatest(F.unix_micros(F.timestamp_micros(F.lit(0)) + gap), F.lit(1))
    cell = lambda x: F.call_function("div", F.unix_micros(x) - F.pmod(F.unix_micros(x), width), width)
    b = b.withColumn("_r_cell", F.explode(F.transform(F.array(*[F.lit(i) for i in (-1, 0, 1)]), lambda i: cell(F.col(f"r_{ts}")) + i)))
    return a.withColumn("_cell", cell(F.col(ts))).join(b, near & (F.col("_cell") == F.col("_r_cell"))).drop("_cell", "_r_cell")


def each_batch(quotes: DataFrame, build, path: str, seconds: int = 5):  # noqa: ANN001, ANN201
    """Runs a batch operator on what each trigger brings and appends its rows with version "live"; the checkpoint lets it resume."""

    def write(batch: DataFrame, _: int) -> None:
        build(batch).withColumn("version", F.lit("live")).write.mode("append").parquet(path)

    return quotes.writeStream.foreachBatch(write).trigger(processingTime=f"{seconds} seconds").option("checkpointLocation", f"{path}/_checkpoint")
