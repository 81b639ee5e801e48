"""Samples, Gramian covariance, correlated signals, manifests, checked sinks, compaction, monitors: against plain versions."""

import datetime as dt
import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from smilegrid.operators import linalg, samples, tables
from smilegrid.sources import manifest, store
from smilegrid.streaming import live, monitor


@pytest.mark.parametrize("block", [1, 6, 1000])
def test_dense_samples(spark, block):
    rng, start = np.random.default_rng(1), dt.datetime(2024, 1, 1)
    hours = [h for h in range(60) if h % 7]
    rows = [(start + dt.timedelta(hours=h), int(n), *[None if rng.random() < 0.2 else float("nan") if rng.random() < 0.1 else float(rng.integers(1, 9)) for _ in range(3)], bool(rng.random() < 0.2)) for h in hours for n in rng.choice(6, 4, replace=False)]
    rows.append((None, 1, 1.0, 1.0, 1.0, False))
    frame = spark.createDataFrame(rows, "ts timestamp_ntz, n int, f double, g double, y double, m boolean")
    kwargs = dict(lookback=4, cell=F.date_trunc("day", "_ts"), min_end="2024-01-01T10:00:00", masked="m", stats={"g": (2.0, 4.0), "y": (1.0, 2.0)}, block=block)
    got = {r.end_ts: r for r in samples.dense_samples(frame, "ts", F.when(F.col("n") < 5, F.col("n")), 5, ["f", "g"], ["y"], **kwargs).collect()}
    times = sorted({r[0] for r in rows if r[0]})
    fine = lambda v: v is not None and np.isfinite(v)
    assert sorted(got) == [t for t in times[4:] if t >= start + dt.timedelta(hours=10)]
    for end, r in got.items():
        at = times.index(end)
        x, y, mask = np.zeros((5, 5, 2), np.float32), np.zeros((5, 1), np.float32), np.zeros(5, bool)
        for ts, n, f, g, lab, m in rows:
            if ts is None or n >= 5 or not at - 4 <= times.index(ts) <= at:
                continue
            row = times.index(ts) - at + 4
            x[row, n, 0], x[row, n, 1] = f if fine(f) else 0, (g - 2) / 4 if fine(g) else 0
            if row == 4 and not m and fine(lab):
                y[n, 0], mask[n] = (lab - 1) / 2, True
        assert r.start_ts == times[at - 4] and np.allclose(np.array(r.x).reshape(x.shape), x) and np.allclose(np.array(r.y).reshape(y.shape), y)
        assert r.mask == mask.tolist() == r.label_mask
    assert samples.dense_samples(frame.limit(0), "ts", F.col("n"), 5, ["f"], ["y"], lookback=4, cell=F.date_trunc("day", "_ts")).count() == 0


def test_gramian_is_the_pairwise_covariance(spark):
    rng = np.random.default_rng(4)
    rows = [(t, f"n{i}", None if rng.random() < 0.2 else float(1e7 + rng.standard_normal() + i * t / 50)) for t in range(80) for i in range(6)] + [(1, None, 2.0), (None, "n1", 3.0), (3, "n1", float("nan"))]
    frame = spark.createDataFrame(rows, "t int, node string, v double").repartition(3)
    clean = frame.where("v IS NOT NULL AND NOT isnan(v) AND node IS NOT NULL AND t IS NOT NULL")
    want = {(r.a, r.b): r for r in linalg.covariance_pairs(clean, "t", "node", "v").collect()}
    got = {(r.a, r.b): r for r in linalg.gramian_pairs(frame, "t", "node", "v").collect()}
    assert got.keys() == want.keys()
    for k, r in got.items():
        assert r.n == want[k].n and np.isclose(r["cov"], want[k]["cov"], rtol=1e-6, atol=1e-7) and np.isclose(r["corr"], want[k]["corr"], atol=1e-6)
    assert linalg.gramian_pairs(frame.limit(0), "t", "node", "v").count() == 0


def test_uncorrelated_signals(spark):
    pairs = spark.createDataFrame([("a", "a", 1.0), ("a", "b", -0.9), ("a", "c", 0.5), ("b", "c", 0.85), ("c", "c", 1.0), ("b", "b", 1.0)], "a string, b string, corr double")
    rows = [(1, "a", 0.5), (2, "a", 0.4), (3, "b", 0.45), (4, "c", 0.3), (5, "zz", 0.1), (6, "zz", 0.2), (7, "a", 0.5)]
    out = linalg.uncorrelated_signals(spark.createDataFrame(rows, "id long, node string, score double"), pairs, node="node", score="score", id_="id")
    assert sorted(r.id for r in out.collect()) == [1, 4, 5, 6]
    assert linalg.uncorrelated_signals(spark.createDataFrame(rows, "id long, node string, score double"), pairs.limit(0), node="node", score="score", id_="id").count() == 7


def test_manifests(spark, tmp_path):
    rows = [("spy", "S2", dt.date(2024, 2, 1)), ("spy", "S1", dt.date(2024, 1, 1)), ("spy", "S1", dt.date(2024, 1, 1)), ("spy", None, None), ("qqq", "Q1", None)]
    settings = {"underlying": "x", "min_dte": 5, "max_dte": 120}
    built = manifest.build(spark.createDataFrame(rows, "u string, symbol string, expiry date"), ["u"], settings)
    manifest.save(built, str(tmp_path / "m"))
    back = manifest.load(spark, str(tmp_path / "m"), "u string")
    told = {r.u: json.loads(r.manifest) for r in back.collect()}
    assert told["spy"]["symbols"] == ["S1", "S2"] and told["spy"]["symbols_by_expiry"] == {"2024-01-01": ["S1"], "2024-02-01": ["S2"]}
    assert told["spy"]["metadata"]["config_hash"] == manifest.config_hash(dict(reversed(settings.items()))) and told["spy"]["metadata"]["symbols_count"] == 2
    odd = spark.createDataFrame([("list", '["A", "B", "A", null]'), ("dict", '{"symbols": ["C"], "underlying": "q"}'), ("bad", "{"), ("num", "3"), ("none", None), ("empty", "[]"), ("day", '{"symbols": ["D"], "symbols_by_expiry": {"soon": ["D"]}}')], "u string, manifest string")
    got = {(r.u, r.symbol, r.expiry) for r in manifest.symbols_of(back.union(odd)).collect()}
    assert got == {("spy", "S1", dt.date(2024, 1, 1)), ("spy", "S2", dt.date(2024, 2, 1)), ("qqq", "Q1", None), ("list", "A", None), ("list", "B", None), ("dict", "C", None), ("day", "D", None)}


def test_checks_while_writing(spark, tmp_path):
    rows = [("A", 1.0, None, 2.0, 1.0), ("A", 9.0, None, 1.0, 3.0), ("B", float("nan"), None, -1.0, 5.0), ("C", None, None, None, 5.0)]
    frame = spark.createDataFrame(rows, "s string, v double, e double, bid double, ask double")
    checks = [*tables.column_checks(["v", "e"]), *tables.series_checks("s", "v", {"A": (0, 5), "B": (0, 5)}), tables.check("crossed", "WARNING", F.col("bid") > F.col("ask")), tables.check("negative", "ERROR", (F.col("bid") < 0) | (F.col("ask") < 0))]
    issues, total = store.write_checked(frame, str(tmp_path / "t"), checks)
    want = {("empty_e", "ERROR", 4), ("nan_v", "WARNING", 1), ("range_A", "ERROR", 1), ("range_B", "ERROR", 1), ("unknown_series", "WARNING", 1), ("crossed", "WARNING", 1), ("negative", "ERROR", 1)}
    assert {tuple(r) for r in issues.collect()} == want == {tuple(r) for r in tables.one_pass_issues(frame, checks).collect()}
    assert total == 4 == spark.read.parquet(str(tmp_path / "t")).count()
    assert {r.check for r in issues.collect()} >= {r.check for r in tables.quote_issues(frame).collect()}
    issues, total = store.write_checked(frame.limit(0), str(tmp_path / "none"), checks)
    assert total == 0 and issues.count() == 0


def test_vacuum_and_clear(spark, tmp_path):
    path = str(tmp_path / "root" / "t")
    rows = spark.range(4_000).select("id", F.concat(F.lit("v"), F.col("id")).alias("v"), F.when(F.col("id") % 4 != 0, (F.col("id") % 4).cast("string")).alias("p"))
    rows.where("p IS NULL OR p <> '3'").repartition(9).write.partitionBy("p").parquet(path)
    rows.where("p = '3'").coalesce(1).write.mode("append").partitionBy("p").parquet(path)
    before = {r.value: r.files for r in store.file_sizes(spark, path, "p").collect()}
    assert sum(before.values()) == 28 and store.vacuum(spark, path, "p") == 3
    after = {r.value: r.files for r in store.file_sizes(spark, path, "p").collect()}
    assert set(after.values()) == {1} and after.keys() == before.keys()
    assert sorted(map(str, spark.read.parquet(path).select("id", "v", "p").collect())) == sorted(map(str, rows.select("id", "v", F.col("p").cast("int").alias("p")).collect()))
    assert store.vacuum(spark, path, "p") == 0
    with pytest.raises(ValueError, match="unknown groups"):
        store.clear_groups(spark, str(tmp_path / "root"), {"raw": ["t"]}, ["raw", "x"])
    assert store.clear_groups(spark, str(tmp_path / "root"), {"raw": ["t", "u"], "other": ["w"]}, ["raw"]) == ["t"] and not (tmp_path / "root" / "t").exists()


def test_monitor_stops_a_stream(spark, tmp_path):
    rows = spark.range(40).select("id", (F.col("id") * 10 - 100).cast("double").alias("pnl"))
    for i in range(8):
        rows.where(f"id >= {5 * i} AND id < {5 * i + 5}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.02)
    stream = spark.readStream.schema("id long, pnl double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    watch = monitor.Monitor(spark, {"low": (lambda m: (m.get("worst") or 0) < -80, False), "high": (lambda m: (m.get("best") or 0) >= 100, True)}, most_metrics=3, most_alerts=2)
    spark.streams.addListener(watch)
    try:
        query = monitor.watched(stream, worst=F.min("pnl"), best=F.max("pnl")).writeStream.format("noop").trigger(processingTime="300 milliseconds").option("checkpointLocation", str(tmp_path / "c")).start()
        assert query.awaitTermination(40) and query.exception() is None
    finally:
        spark.streams.removeListener(watch)
    assert list(watch.stopped.values()) == ["high"] and len(watch.metrics) <= 3 and len(watch.alerts) <= 2
    assert any(a["alert"] == "high" and a["level"] == "CRITICAL" for a in watch.alerts)
    assert json.loads(watch.table("alerts").first()[0])["alert"] in ("low", "high")


def test_recent_by_key_forgets(spark, tmp_path):
    def feed(minutes, k):
        spark.createDataFrame([(k, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m), float(m)) for m in minutes], "k long, ts timestamp, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("k long, ts timestamp, v double").parquet(str(tmp_path / "in"))
        query = live.recent_by_key(stream, "k", "ts", "v", late="1 minute", keep_ms=600_000).writeStream.outputMode("update").format("noop").option("checkpointLocation", str(tmp_path / "c")).start()
        query.processAllAvailable()
        query.stop()
        return sum(o.numRowsTotal for o in query.recentProgress[-1].stateOperators)

    assert feed([0, 1], 1) == 1
    assert feed([30], 2) == 1  # key 1 is gone


def test_csv_appends_under_one_header(spark, tmp_path):
    path = str(tmp_path / "c")
    store.write_csv(spark.createDataFrame([(1, "a,b")], "id int, v string"), path, append=True)
    store.write_csv(spark.createDataFrame([("c", 2)], "v string, id int"), path, append=True)
    assert sorted(map(tuple, store.read_csv(spark, path, "id int, v string").collect())) == [(1, "a,b"), (2, "c")]
    with pytest.raises(ValueError, match="has the columns"):
        store.write_csv(spark.createDataFrame([(1,)], "id int"), path, append=True)


def test_results_are_saved_and_loaded(spark, tmp_path):
    root, at = str(tmp_path / "r"), dt.datetime(2024, 1, 1)
    one, two = (spark.createDataFrame([(i,)], "x int") for i in (1, 2))
    store.save_result(spark, root, "a", {"metrics": one, "trades": two}, created_at=at, tags=["M1"], info={"k": 1})
    store.save_result(spark, root, "b", {"metrics": two}, created_at=at + dt.timedelta(days=1), tags=["M2"])
    assert store.latest_result(spark, root) == "b" and store.latest_result(spark, root, ["M1"]) == "a" and store.latest_result(spark, root, ["none"]) is None
    assert {k: v.first().x for k, v in store.load_result(spark, root, "a").items()} == {"metrics": 1, "trades": 2}
    store.save_result(spark, root, "a", {"metrics": two}, created_at=at + dt.timedelta(days=2))
    assert store.latest_result(spark, root) == "a" and {k: v.first().x for k, v in store.load_result(spark, root, "a").items()} == {"metrics": 2}
    with pytest.raises(ValueError, match="no run"):
        store.load_result(spark, root, "zzz")
