"""Providers as data sources: the rows of the Parquet scan, pushed filters, streams; keyed state: late values, expiry, restart, reading back."""

import datetime as dt
import json
import shutil
import uuid
from dataclasses import dataclass
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from smilegrid.sources import provider as P
from smilegrid.streaming import state as S

SF = "/root/testdata/sf0.001"
EVENTS = P.Table("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double", "ts", "event_type")


def logged(*args):
    """A provider that notes each fetch in a folder (its class is made here, so that workers get it by value)."""

    @dataclass(frozen=True)
    class Logged(P.ParquetProvider):
        log: str = ""

        def fetch(self, table, symbols, start, end):
            Path(self.log, uuid.uuid4().hex).write_text(json.dumps([symbols, str(start), str(end)]))
            return P.ParquetProvider.fetch(self, table, symbols, start, end)

    return Logged(*args)


@pytest.fixture
def pushing(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield spark
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_provider_reads_what_the_scan_reads(pushing, tmp_path):
    spark = pushing
    P.register(spark, "logged", logged(SF, {"events": EVENTS}, 0.5, str(tmp_path)))
    plain = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    source = spark.read.format("logged").option("table", "events").option("hours", 48).load()
    assert rows_of(source) == rows_of(plain)
    calls = [json.loads(p.read_text()) for p in tmp_path.iterdir()]
    assert len(calls) > 5 and all(c[0] is None for c in calls)
    bounds = plain.agg(F.min("ts"), F.max("ts")).first()
    a, b = bounds[0] + (bounds[1] - bounds[0]) / 4, bounds[0] + (bounds[1] - bounds[0]) / 2
    tests = [
        lambda f: f.where((F.col("ts") >= a) & (F.col("ts") < b) & F.col("event_type").isin("click", "view")),
        lambda f: f.where((F.col("ts") > bounds[0]) & (F.col("ts") <= bounds[0]) | F.col("event_type").isNull()),
        lambda f: f.where((F.col("ts") > a) & (F.col("ts") <= b) & (F.col("event_type") == "click") & (F.col("value") > 20)),
        lambda f: f.where((F.col("event_type") == "click") & (F.col("event_type") == "view")),
        lambda f: f.where(F.col("ts") == bounds[1]), lambda f: f.where(F.col("ts") > dt.datetime(2100, 1, 1)),
    ]
    for test in tests:
        for p in tmp_path.iterdir():
            p.unlink()
        assert rows_of(test(source)) == rows_of(test(plain))
        if test is tests[0]:
            calls = [json.loads(p.read_text()) for p in tmp_path.iterdir()]
            assert calls and all(c[0] == ["click", "view"] and str(a) <= c[1] < c[2] <= str(b) for c in calls)
    cost = P.ParquetProvider(SF, {"events": EVENTS}, 0.5).cost("events", ["click"], a, b)
    assert cost == 0.5 * plain.where((F.col("ts") >= a) & (F.col("ts") < b) & (F.col("event_type") == "click")).count()


def test_provider_streams_by_time(spark, tmp_path):
    plain = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value").orderBy("ts")
    half = plain.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), 0.5)).first()[0]
    early = F.unix_micros(F.col("ts").cast("timestamp")) <= half
    (tmp_path / "events.parquet").mkdir()
    def add(frame, name):  # noqa: E306
        frame.coalesce(1).write.parquet(str(tmp_path / name))
        shutil.copy(next((tmp_path / name).glob("*.parquet")), tmp_path / "events.parquet" / f"{name}.parquet")

    add(plain.where(early), "one")
    P.register(spark, "growing", P.ParquetProvider(str(tmp_path), {"events": EVENTS}))

    def run():
        stream = spark.readStream.format("growing").option("table", "events").option("hours", 100).load()
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).start()
        query.processAllAvailable()
        query.stop()

    run()
    assert rows_of(spark.read.parquet(str(tmp_path / "out"))) == rows_of(plain.where(early))
    add(plain.where(~early), "two")
    run()  # goes on after the committed offset
    assert rows_of(spark.read.parquet(str(tmp_path / "out"))) == rows_of(plain)


@pytest.fixture
def rocks(spark):
    S.use_rocksdb(spark)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def test_recent_values_late_expiry_restart(rocks, tmp_path):
    spark, seen = rocks, []

    def feed(rows):
        spark.createDataFrame(rows, "k string, ts timestamp, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        seen.clear()
        stream = spark.readStream.schema("k string, ts timestamp, v double").parquet(str(tmp_path / "in"))
        out = S.recent_values(stream, "k", "ts", "v", most=3, late="10 minutes", keep_ms=3_600_000)
        query = out.writeStream.outputMode("update").foreachBatch(lambda b, _: seen.extend(b.collect())).option("checkpointLocation", str(tmp_path / "check")).start()
        query.processAllAvailable()  # each call is a restart from the checkpoint
        query.stop()
        return {(r.k, r.expired): (r.n, None if r.mean is None else round(r.mean, 6), r.change, r.ts) for r in seen}

    got = feed([("a", at(0), 1.0), ("a", at(5), 3.0), ("b", at(1), 7.0), ("a", None, 9.0), ("b", at(2), None)])
    assert got == {("a", False): (2, 2.0, 2.0, at(5)), ("b", False): (1, 7.0, 0.0, at(1))}
    got = feed([("a", at(3), 8.0), ("a", at(6), 4.0)])  # the first belongs between those kept; the oldest goes
    assert got == {("a", False): (3, 5.0, -4.0, at(6))}
    state = S.read_state(spark, str(tmp_path / "check"), "kept")
    have = sorted((r.key.k, r.user_map_key.at, r.user_map_value.v) for r in state.collect())
    micros = lambda m: m * 60_000_000 + int(dt.datetime(2024, 1, 1, tzinfo=dt.UTC).timestamp()) * 1_000_000
    assert have == [("a", micros(3), 8.0), ("a", micros(5), 3.0), ("a", micros(6), 4.0), ("b", micros(1), 7.0)]
    assert feed([("a", at(65), 5.0)])[("a", False)] == (3, 4.0, 2.0, at(65))
    got = feed([("c", at(73), 1.0)])  # the watermark is at 63 minutes: b's hour is over
    assert ("b", True) in got and got[("b", True)][0] == 1 and ("a", True) not in got
    left = {r.key.k for r in S.read_state(spark, str(tmp_path / "check"), "kept").collect()}
    assert left == {"a", "c"}


def test_latest_quotes(rocks, tmp_path):
    spark, seen = rocks, []

    def feed(rows):
        spark.createDataFrame(rows, "k long, ts timestamp, bid double, ask double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        seen.clear()
        stream = spark.readStream.schema("k long, ts timestamp, bid double, ask double").parquet(str(tmp_path / "in"))
        query = S.latest_quotes(stream, "k", "ts").writeStream.outputMode("update").foreachBatch(lambda b, _: seen.extend(b.collect())).option("checkpointLocation", str(tmp_path / "check")).start()
        query.processAllAvailable()
        query.stop()
        return sorted(tuple(r) for r in seen)

    assert feed([(1, at(5), 1.0, None), (1, at(2), 9.0, 9.5), (2, at(1), 2.0, 2.5), (3, None, 1.0, 1.0)]) == [(1, at(5), 1.0, None), (2, at(1), 2.0, 2.5)]
    assert feed([(1, at(4), 8.0, 8.5), (2, at(3), 3.0, 3.5)]) == [(2, at(3), 3.0, 3.5)]


def test_latest_quotes_forgets_silent_keys(rocks, tmp_path):
    spark, seen = rocks, []
    spark.createDataFrame([(1, at(5), 1.0)], "k long, ts timestamp, bid double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, ts timestamp, bid double").parquet(str(tmp_path / "in"))
    query = S.latest_quotes(stream, "k", "ts", ttl_ms=1).writeStream.outputMode("update").foreachBatch(lambda b, _: seen.extend(b.collect())).option("checkpointLocation", str(tmp_path / "check")).start()
    for _ in range(60):
        if seen and len(query.recentProgress) > 3:
            break
        query.awaitTermination(0.5)
    spark.createDataFrame([(1, at(2), 7.0)], "k long, ts timestamp, bid double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(60):
        if len(seen) > 1:
            break
        query.awaitTermination(0.5)
    query.stop()
    assert [(r.k, r.bid) for r in seen] == [(1, 1.0), (1, 7.0)]  # an older quote counts again once the newer one is forgotten
