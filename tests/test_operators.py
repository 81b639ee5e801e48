"""Closed forms, hand-made rows and properties of the operators."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from smilegrid.functions import pricing, scalars
from smilegrid.operators import asof, frames, labels, linalg, risk, structures, tables
from smilegrid.plans import more_queries, queries, surface  # noqa: F401
from smilegrid.sources import store
from smilegrid.streaming import live


def rows(frame):
    return sorted(map(tuple, frame.collect()))


def test_put_call_parity_and_bumped_delta(spark):
    f = spark.createDataFrame([(100.0, k, 0.5, 0.03, 0.3) for k in (80.0, 100.0, 125.0)], "s double, k double, t double, r double, v double")
    c = [F.col(x) for x in "sktrv"]
    call, put = (pricing.bs_price(*c, F.lit(x)) for x in "CP")
    up = pricing.bs_price(c[0] + 0.01, *c[1:], F.lit("C"))
    out = f.select((call - put - (c[0] - c[1] * F.exp(-c[3] * c[2]))).alias("gap"), ((up - call) / 0.01 - pricing.greeks(*c, F.lit("C"))["delta"]).alias("bump")).collect()
    assert all(abs(r.gap) < 1e-10 and abs(r.bump) < 0.01 for r in out)


def test_norm_cdf_against_erfc(spark):
    xs = [i / 10 for i in range(-90, 91)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", pricing.norm_cdf(F.col("x")).alias("p")).collect()
    assert max(abs(r.p - math.erfc(-r.x / math.sqrt(2)) / 2) for r in got) < 1e-14


def test_iv_round_trip_and_failures():
    s, k, t, r = np.full(4, 100.0), np.array([95.0, 100.0, 105.0, 100.0]), np.full(4, 0.25), np.full(4, 0.02)
    v = np.array([0.2, 0.3, 0.4, 0.3])
    d1 = (np.log(s / k) + (r + v * v / 2) * t) / (v * np.sqrt(t))
    price = s * pricing._cdf(d1) - k * np.exp(-r * t) * pricing._cdf(d1 - v * np.sqrt(t))
    price[3] = np.nan
    got = pricing.solve_iv(price, s, k, t, r, np.full(4, True))
    assert np.abs(got[:3] - v[:3]).max() < 1e-6 and np.isnan(got[3])


def test_asof_matches_pandas_and_never_looks_ahead(spark):
    rng = np.random.default_rng(1)
    base = pd.Timestamp("2024-01-01")
    left = pd.DataFrame({"id": range(60), "k": rng.integers(0, 3, 60), "ts": base + pd.to_timedelta(rng.integers(0, 5 * 86400, 60), "s")})
    right = pd.DataFrame({"k": rng.integers(0, 3, 40), "ts": base + pd.to_timedelta(rng.choice(5 * 86400, 40, replace=False), "s"), "v": rng.random(40)})
    want = pd.merge_asof(left.sort_values("ts"), right.sort_values("ts"), on="ts", by="k").set_index("id").v
    sl, sr = spark.createDataFrame(left), spark.createDataFrame(right)
    got = {r.id: r.r_v for r in asof.asof_join(sl, sr, by=("k",)).collect()}
    assert all(got[i] == v or (got[i] is None and math.isnan(v)) for i, v in want.items())
    later = right[right.ts > base + pd.Timedelta(days=2)].assign(v=-1.0)
    changed = pd.concat([right[right.ts <= base + pd.Timedelta(days=2)], later])
    again = {r.id: r.r_v for r in asof.asof_join(sl, spark.createDataFrame(changed), by=("k",)).collect()}
    early = left[left.ts <= base + pd.Timedelta(days=2)].id
    assert all(again[i] == got[i] for i in early)


def test_asof_strict_nulls_and_empty_right(spark):
    t0 = dt.datetime(2024, 1, 1)
    left = spark.createDataFrame([(1, t0), (2, t0 + dt.timedelta(days=3))], "id int, ts timestamp")
    right = spark.createDataFrame([(t0, 1.0), (t0 + dt.timedelta(days=1), None)], "ts timestamp, v double")
    assert rows(asof.asof_join(left, right).select("id", "r_v")) == [(1, 1.0), (2, None)]  # a row of NULLs is a row
    assert asof.asof_join(left, right, strict=True).where("id = 1").first().r_v is None
    assert asof.asof_join(left, right.limit(0)).where("r_v is null").count() == 2


def test_prior_windows_exclude_the_current_row(spark):
    f = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate([1, 2, 3, 4, 100])], "k int, i int, x double")
    w = frames.node(["k"], ["i"])
    got = [r.m for r in f.withColumn("m", frames.prior_mean(F.col("x"), w, 3)).orderBy("i").collect()]
    assert got == [None, None, None, 2.0, 3.0]


def test_sinks_are_idempotent(spark, tmp_path):
    path = f"file://{tmp_path}/raw"
    new = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    store.append_new(new, path, ["k"], ["v"])
    store.append_new(new.withColumn("v", F.lit("z")), path, ["k"], ["v"])
    assert store.count(spark, path) == 2 and store.count(spark, f"{path}-none") == 0
    path = f"file://{tmp_path}/derived"
    old = spark.createDataFrame([(1, "d1", 1.0), (2, "d2", 2.0)], "k int, day string, v double")
    store.replace_rows(old, path, ["k"], ["v"], "day")
    store.replace_rows(spark.createDataFrame([(1, "d1", 9.0), (3, "d1", 3.0)], old.schema), path, ["k"], ["v"], "day")
    assert rows(spark.read.parquet(path).select("k", "v")) == [(1, 9.0), (2, 2.0), (3, 3.0)]


def test_surface_picks_one_quote_a_node(spark):
    ts, day = dt.datetime(2024, 1, 15, 16), dt.date(2024, 2, 14)
    quotes = [(ts, f"S{k}{r}", day, float(k), r, *[p * 0.99, p * 1.01], 100, 500) for k, r, p in ((470, "C", 14.0), (480, "C", 8.2), (480, "P", 7.3), (490, "P", 12.5), (480, "C", 8.3))]
    q = spark.createDataFrame(quotes, "ts timestamp, option_symbol string, exp_date date, strike double, right string, bid double, ask double, volume int, open_interest int")
    bars = spark.createDataFrame([(ts - dt.timedelta(hours=1), 478.5), (ts, 479.0)], "ts timestamp, close double")
    rates = spark.createDataFrame([], "ts timestamp, value double")
    nodes = surface.build_surface(q, bars, rates)
    got = nodes.collect()
    assert {r.spot for r in got} == {479.0} and {r.rf_rate for r in got} == {0.05} and {r.tenor_days for r in got} == {30}
    assert len({r.delta_bucket for r in got}) == len(got)
    assert surface.surface_features(spark.createDataFrame(got, nodes.schema)).where("delta_bucket = 'ATM' and atm_spread <> 0").count() == 0


def test_flags_buckets_symbols(spark):
    one = spark.range(1)
    assert one.select(scalars.quality_flags(F.lit(2.0), F.lit(1.0), F.lit(None).cast("int"), F.lit(50))).first()[0] == 1 + 8 + 16
    assert one.select(scalars.parse_symbol(F.lit("SPY   240119C00480000"))).first()[0].strike == 480.0
    assert one.select(scalars.parse_symbol(F.lit("SPY241319C00480000"))).first()[0] is None
    assert [one.select(scalars.nearest_bin(F.lit(x))).first()[0] for x in (-1, 0, 22, 23, 400)] == [None, 7, 14, 30, 120]


def test_cleaning_finds_a_planted_factor():
    rng = np.random.default_rng(42)
    f = rng.standard_normal((300, 1))
    x = f @ rng.standard_normal((1, 20)) + rng.standard_normal((300, 20))
    clean = linalg.clean_correlation(np.corrcoef(x.T), 300)
    assert np.allclose(np.diag(clean), 1) and np.linalg.eigvalsh(clean).min() > 0
    assert np.linalg.eigvalsh(clean).max() > 2
    cov, a = linalg.shrunk_covariance(x)
    assert 0 <= a <= 1 and np.linalg.eigvalsh(cov).min() > 0


def test_upsert_and_replay(spark):
    old = spark.createDataFrame([(1, 1), (2, 1)], "k int, v int")
    new = spark.createDataFrame([(2, 5), (2, 7), (3, 1)], "k int, v int")
    assert rows(tables.upsert(old, new, ["k"], [F.desc("v")])) == [(1, 1), (2, 7), (3, 1)]
    orders = spark.createDataFrame([("a", 1, 60.0, 1.0), ("a", 2, 60.0, 0.0), ("a", 3, 40.0, 0.5)], "run string, n int, cost double, delta double")
    assert [r.accepted for r in risk.replay(orders, "run", ["n"], cash=100.0, most_delta=2.0).orderBy("n").collect()] == [True, False, True]


def test_backtest_expires_marks_exits_enters_and_stops(spark):
    day = lambda n: dt.date(2024, 1, n)
    orders = [
        ("a", day(1), 1, 60.0, 1.0, 0.5, 1.0, 0.10, day(2)), ("a", day(1), 2, 60.0, 1.0, 0.5, 0.0, 0.10, day(30)),
        ("a", day(2), 3, 30.0, 1.0, 0.5, 0.5, 0.10, day(30)), ("a", day(3), 4, 20.0, 1.0, 0.5, 0.5, 0.10, day(30)),
        ("b", day(1), 5, 80.0, 1.0, 0.5, 0.5, 0.10, day(30)), ("b", day(3), 6, 1.0, 1.0, 0.5, 0.5, 0.10, day(30)),
    ]
    quotes = [(day(2), 3, 99.0, 0.1), (day(2), 1, 70.0, 0.1), (day(4), 4, 60.0, 0.1), (day(2), 5, 5.0, 0.1)]
    orders = spark.createDataFrame(orders, "run string, date date, key long, price double, fees double, slippage double, delta double, edge double, expiry date")
    quotes = spark.createDataFrame(quotes, "date date, key long, price double, edge double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    ledger = risk.backtest(orders, quotes, cash=100.0, most_delta=2.0, most_loss=50.0).cache()
    got = [(r.run, r.date.day, r.kind, r.key, r.reason) for r in ledger.orderBy("run", "seq").collect()]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [
        ("a", 1, "ENTRY", 1, None), ("a", 1, "REJECT", 2, "CASH"), ("a", 1, "SNAPSHOT", None, None),
        ("a", 2, "EXIT", 1, "TIME"), ("a", 2, "ENTRY", 3, None), ("a", 2, "SNAPSHOT", None, None),
        ("a", 3, "ENTRY", 4, None), ("a", 3, "SNAPSHOT", None, None), ("a", 4, "EXIT", 4, "TAKE_PROFIT"), ("a", 4, "SNAPSHOT", None, None),
        ("b", 1, "ENTRY", 5, None), ("b", 1, "SNAPSHOT", None, None), ("b", 2, "EXIT", 5, "STOP_LOSS"), ("b", 2, "SNAPSHOT", None, None), ("b", 2, "KILL", None, "DAILY_LOSS"),
    ]
    m = {r.run: r for r in risk.trade_metrics(ledger, 100.0).collect()}
    assert len(m["a"]) == 33 and (m["a"].total_trades, m["a"].winning_trades, m["a"].profit_factor) == (2, 2, math.inf)
    # 70 - 1.5 - 61.5 and 60 - 1.5 - 21.5; order 3 counts at its entry price, 31.5, at the end
    assert m["a"].avg_win == pytest.approx((7.0 + 37.0) / 2) and m["a"].total_return_pct == pytest.approx(44.0)
    assert m["b"].max_daily_loss == pytest.approx(5.0 - 1.5 - 81.5) and m["b"].max_drawdown_duration_days == 1 and m["b"].total_fees == 2.0
    assert len(risk.compare_runs(risk.trade_metrics(ledger, 100.0)).columns) == 12


def test_windows_of_days_follow_each_nodes_rows_a_day(spark):
    data = [(k, dt.datetime(2024, 1, 1 + i // n, i % n), float(i * i % 17)) for k, n in ((None, 2), ("daily", 1), ("hourly", 7), ("uneven", 3)) for i in range(6 * n)]
    f = spark.createDataFrame([*data, ("uneven", dt.datetime(2024, 1, 6, 20), 3.0)], "k string, ts timestamp, x double")
    by = ["k"]
    got = frames.by_days(f, "ts", by, ["ts"]).withColumns({"ago": frames.days_ago(F.col("x"), by, 2), "m": frames.full(F.col("x"), F.avg("x"), frames.prior_days(by, 2), 2), "top": F.max("x").over(frames.last_days(by, 2))}).fillna("none", "k").toPandas().sort_values(["k", "ts"])
    assert len(got) == f.count()
    for k, g in got.groupby("k"):
        n = {"none": 2, "daily": 1, "hourly": 7, "uneven": 3}[k]
        assert set(g.steps) == {n}
        pd.testing.assert_series_equal(g.ago, g.x.shift(2 * n), check_names=False)
        pd.testing.assert_series_equal(g.m, g.x.shift(1).rolling(2 * n).mean(), check_names=False)
        pd.testing.assert_series_equal(g.top, g.x.rolling(2 * n, min_periods=1).max(), check_names=False)


def test_winsorize_holds_no_column_in_a_task(spark):
    x = np.random.default_rng(4).standard_normal(30_000) ** 3
    x[:9_000] = x[0]
    f = spark.createDataFrame(pd.DataFrame({"i": range(30_000), "x": x})).withColumn("x", F.when(F.col("i") != 29_999, F.col("x")))
    for share in (0.0, 0.01, 0.5, 0.99, 1.0):
        assert labels.exact_percentiles(f, "x", (share,), few=50) == pytest.approx([np.quantile(x[:-1], share)], rel=1e-12)
    out = labels.winsorize(f, "x")
    assert "percentile" not in out._jdf.queryExecution().toString()
    lo, hi = np.quantile(x[:-1], [0.01, 0.99])
    got = out.orderBy("i").toPandas().x.to_numpy()
    assert np.isnan(got[-1]) and np.allclose(got[:-1], np.clip(x[:-1], lo, hi), rtol=1e-12)
    assert labels.exact_percentiles(f.where("i < 0"), "x", (0.5,)) == [None]


def test_matrix_refuses_what_it_cannot_hold(spark, monkeypatch):
    monkeypatch.setattr(linalg, "MOST_NODES", 3)
    pairs = lambda n: spark.createDataFrame([(a, b, float(a * b)) for a in range(n) for b in range(a, n)], "a long, b long, corr double")
    assert linalg.matrix(pairs(3), "corr")[1][2, 2] == 4.0
    with pytest.raises(ValueError, match="more than 3 nodes"):
        linalg.matrix(pairs(4), "corr")


def test_backtest_lets_positions_expire(spark):
    day = lambda n: dt.date(2024, 1, n)
    orders = spark.createDataFrame([("a", day(1), 1, 60.0, 0.0, 0.0, 1.0, 0.1, day(20)), ("a", day(21), 2, 60.0, 0.0, 0.0, 1.5, 0.1, day(30))], "run string, date date, key long, price double, fees double, slippage double, delta double, edge double, expiry date")
    quotes = spark.createDataFrame([], "date date, key long, price double, edge double")
    got = [(r.kind, r.key, r.cash, r.realized) for r in risk.backtest(orders, quotes, cash=100.0, most_delta=2.0, most_loss=50.0).orderBy("seq").collect()]
    assert got == [("ENTRY", 1, 40.0, 0.0), ("SNAPSHOT", None, 40.0, 0.0), ("EXPIRE", 1, 40.0, -60.0), ("REJECT", 2, 40.0, -60.0), ("SNAPSHOT", None, 40.0, -60.0)]


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("cell", ["minute", "hour", "day"])
def test_keyless_asof_on_repeated_times(spark, strict, cell):
    rng = np.random.default_rng(3)
    base = pd.Timestamp("2024-01-01")
    left = pd.DataFrame({"id": range(400), "ts": base + pd.to_timedelta(60 * rng.integers(0, 90, 400), "s")})
    right = pd.DataFrame({"ts": base + pd.to_timedelta(60 * rng.choice(np.arange(20, 80), 25, replace=False), "s"), "v": rng.random(25)})
    want = pd.merge_asof(left.sort_values("ts"), right.sort_values("ts"), on="ts", allow_exact_matches=not strict).set_index("id").v
    odd = spark.createDataFrame([(-1, None)], "id long, ts timestamp")
    got = {r.id: r.r_v for r in asof.asof_join(spark.createDataFrame(left).union(odd), spark.createDataFrame(right), strict=strict, cell=cell).collect()}
    assert len(got) == 401 and got.pop(-1) is None
    assert all(got[i] == v or (got[i] is None and math.isnan(v)) for i, v in want.items())


def test_nearest_row_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    left = [(i, int(rng.integers(0, 4)), float(rng.integers(0, 30))) for i in range(120)] + [(900, None, 3.0), (901, 1, None)]
    right = [(i, int(rng.integers(0, 3)), float(rng.integers(0, 30))) for i in range(60)] + [(800, None, 3.0), (801, 1, None)]
    sl, sr = spark.createDataFrame(left, "id long, g int, x double"), spark.createDataFrame(right, "q long, g int, k double")
    got = {r.id: r.q for r in asof.nearest_row(sl, sr, ["g"], target=F.col("x") + 2, value="k", over=F.col("x"), tie="q").collect()}
    want = {}
    for i, g, x in left:
        near = [(abs(k - x - 2), q) for q, h, k in right if None not in (g, h, x, k) and g == h and k > x]
        if near:
            want[i] = min(near)[1]
    assert got == want
    assert asof.nearest_row(sl, sr.limit(0), ["g"], target=F.col("x"), value="k", over=F.col("x"), tie="q").count() == 0


def test_scans_push_their_filters_and_join_long_lists(spark, monkeypatch):
    path = "/root/testdata/sf0.001/events.parquet"
    chosen = store.scan(spark, path, ts="ts", start="2024-01-02", end="2024-01-04", equal={"event_type": "click"}, within={"user_id": [1, 2, 3]}, order=["ts"])
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters") :]
    assert all(x in pushed for x in ("GreaterThanOrEqual(ts", "LessThan(ts", "EqualTo(event_type,click)", "In(user_id"))
    few = rows(chosen)
    monkeypatch.setattr(store, "MOST_IN_FILTER", 2)
    assert rows(store.scan(spark, path, ts="ts", start="2024-01-02", end="2024-01-04", equal={"event_type": "click"}, within={"user_id": [1, 2, 3]}).select(*chosen.columns)) == few
    assert store.scan(spark, path, within={"user_id": []}).count() == 0


def test_admin_of_tables(spark, tmp_path):
    one, two = f"file://{tmp_path}/one", f"file://{tmp_path}/two"
    store.append_log(spark, one, {"run": "a", "n": 1}, "run string, n long")
    store.append_log(spark, one, {"run": "b", "n": 2}, "run string, n long")
    assert store.copy_table(spark, one, two) == 2
    assert rows(store.table_counts(spark, {"one": one, "two": two, "none": f"{one}-none"})) == [("none", 0), ("one", 2), ("two", 2)]
    store.remove(spark, two)
    store.remove(spark, two)
    assert not store.exists(spark, two)
    results = spark.createDataFrame([("x", ["p", "q"], 1), ("y", ["q"], 3), ("z", None, 2)], "run_id string, tags array<string>, created_at int")
    assert [r.run_id for r in store.find_results(results).collect()] == ["y", "z", "x"]
    assert [r.run_id for r in store.find_results(results, ["q", "none"]).collect()] == ["y", "x"]
    assert [r.run_id for r in store.find_results(results, ["p"], 1).collect()] == ["x"]
    store.write_csv(spark.read.parquet(one), f"file://{tmp_path}/csv")
    store.write_json(spark.read.parquet(one), f"file://{tmp_path}/json")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/csv").count() == spark.read.json(f"file://{tmp_path}/json").count() == 2


def streamed(spark, tmp_path, name, frame):
    frame.repartition(3).write.parquet(f"{tmp_path}/{name}")
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")


def drained(spark, tmp_path, frame, mode, name):
    q = frame.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_sliding_and_session_streams_agree_with_batches(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(120).withColumn("ts", F.col("ts").cast("timestamp"))
    stream = streamed(spark, tmp_path, "in", source)
    for name, form in (("slid", lambda f: live.sliding(f, "ts", "2 days", "1 day", ["event_type"], "400 days")), ("sess", lambda f: live.sessions(f, "ts", "1 hour", ["user_id"], "400 days"))):
        got = drained(spark, tmp_path / name, form(stream), "complete", name)
        assert rows(got) == rows(form(source))


def test_joined_streams_agree_with_a_batch_join(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    kinds = [source.where(F.col("event_type") == k).drop("event_type") for k in ("click", "view")]
    form = lambda a, b: live.joined_streams(a, b, "user_id", "ts", "6 HOURS", "400 days").select("event_id", "r_event_id")
    want = rows(form(*kinds))
    got = drained(spark, tmp_path, form(*[streamed(spark, tmp_path, n, f) for n, f in zip("ab", kinds)]), "append", "joined")
    assert want and rows(got) == want


def test_recent_values_as_a_stream(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(150).selectExpr("user_id % 5 AS k", "CAST(ts AS TIMESTAMP) AS ts", "value")
    odd = spark.createDataFrame([(1, None, 5.0), (2, dt.datetime(2030, 1, 1), None)], "k long, ts timestamp, value double")
    frame = live.recent_by_key(streamed(spark, tmp_path, "in", source.union(odd)), "k", "ts", "value", most=7)
    last = {}
    for r in drained(spark, tmp_path, frame, "update", "recent").collect():
        last[r.k] = r if r.k not in last or (r.ts, r.n) >= (last[r.k].ts, last[r.k].n) else last[r.k]
    for k, g in source.toPandas().groupby("k"):
        v = g.sort_values(["ts", "value"]).value.to_numpy()[-7:]
        assert last[k].n == len(v)
        if len(v) < 7:
            assert last[k].mean == pytest.approx(v.mean()) and last[k].change == pytest.approx(v[-1] - v[0])


def test_each_batch_appends_live_rows_and_resumes(spark, tmp_path):
    source = spark.range(60).selectExpr("id AS k", "id % 4 AS v")
    stream = streamed(spark, tmp_path, "in", source)
    out = f"{tmp_path}/out"
    for _ in range(2):  # the second start finds nothing new
        q = live.each_batch(stream, lambda b: b.where("v = 1"), out, 0).start()
        q.processAllAvailable()
        q.stop()
    got = spark.read.parquet(out)
    assert got.count() == 15 and {r.version for r in got.collect()} == {"live"}


def test_alerts_name_each_broken_limit(spark):
    f = spark.createDataFrame([(1, 501.0, -1001.0), (2, -501.0, 0.0), (3, 500.0, -1000.0), (4, None, None)], "id int, delta double, pnl double")
    assert rows(live.alerts(f).select("id", "alert", "level")) == [(1, "delta", "WARNING"), (1, "pnl", "WARNING"), (2, "delta", "WARNING")]


@pytest.mark.parametrize("form", ["tumbling", "latest"])
def test_streams_agree_with_batches(spark, tmp_path, form):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(200).withColumn("ts", F.col("ts").cast("timestamp"))
    source.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    if form == "tumbling":
        frame, mode = live.tumbling(stream, "ts", "1 day", ["event_type"], late="400 days"), "complete"
    else:
        frame, mode = live.latest_by_key(stream, "user_id", "ts", "value"), "update"
    q = frame.writeStream.outputMode(mode).format("memory").queryName(f"out_{form}").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table(f"out_{form}")
    if form == "tumbling":
        assert got.agg(F.sum("n")).first()[0] == 200
    else:
        want = source.groupBy("user_id").agg(F.max_by("value", "ts").alias("v"))
        assert rows(got.groupBy("user_id").agg(F.max_by("value", "ts"))) == rows(want)


def test_labels_on_repeated_times(spark):
    """Bars of one time don't multiply panel rows; a key tells them apart, else the last of them counts."""
    day = lambda d: f"2024-01-0{d} 10:00:00"
    bars = spark.createDataFrame([(10 * d + i, day(d), 100.0 * d + i) for d in (1, 2) for i in range(3)], "id long, ts string, close double").withColumn("ts", F.col("ts").cast("timestamp"))
    panel = spark.createDataFrame([(10 * d + i, f"n{i}", day(d), 5.0 * d, 0.5) for d in (1, 2) for i in range(2)], "id long, node string, ts string, mid double, delta double").withColumn("ts", F.col("ts").cast("timestamp"))
    keyed = labels.hedged_labels(panel, bars, (1,), node=["node"], key=["id"])
    assert sorted((r.id, r.spot, r.y_1) for r in keyed.collect()) == [(10, 100.0, -45.0), (11, 101.0, -45.0), (20, 200.0, None), (21, 201.0, None)]
    assert sorted((r.id, r.spot) for r in labels.hedged_labels(panel, bars.drop("id"), (1,), node=["node"]).collect()) == [(10, 102.0), (11, 102.0), (20, 202.0), (21, 202.0)]


def test_sums_in_order(spark):
    """Of doubles the order decides the sum: 1e17 - 1e17 + 1 is 1, 1 + 1e17 - 1e17 is 0."""
    legs = spark.createDataFrame([(1, 3, 1, 0.01), (1, 1, 1, 1e15), (1, 2, -1, 1e15), (2, 1, 1, 0.5)], "id long, at int, qty int, delta double").withColumns({"price": F.col("delta"), "strike": F.lit(1.0), "right": F.lit("C")})
    assert rows(risk.position_greeks(legs, ["id"], ("delta",), ["at"])) == [(1, 1.0), (2, 50.0)]
    assert [r.net_premium for r in structures.premium_and_loss(legs, ["id"], ["at"]).orderBy("id").collect()] == [-1.0, -50.0]
    held = spark.createDataFrame([(1, 0, 3, 1.0), (1, 1, 1, 1e17), (1, 2, 2, -1e17)], "id long, position long, at int, delta double")
    assert [(r.position, r.greek) for r in risk.rebalance(held, ["id"], {"delta": (0.0, 0.5)}, order=["at"]).collect()] == [(1, "delta"), (0, "delta")]
    assert risk.rebalance(held.withColumn("at", -F.col("at")), ["id"], {"delta": (0.0, 0.5)}, order=["at"]).count() == 0


def test_first_line_of_an_order_is_by_place(spark, tmp_path):
    """Of lines with one number the first in the files counts, though Spark reads the larger file first."""
    line = "l_orderkey long, l_linenumber int, l_quantity double, l_note string"
    for name, data in (("a", [(1, 2, 5.0, "")]), ("b", [(1, 2, 7.0 + i, "x" * 999) for i in range(50)])):
        spark.createDataFrame(data, line).coalesce(1).toPandas().to_parquet(tmp_path / f"{name}.parquet")
    (tmp_path / "lineitem.parquet").mkdir()
    for name in "ab":
        (tmp_path / f"{name}.parquet").rename(tmp_path / "lineitem.parquet" / f"{name}.parquet")
    spark.createDataFrame([(9, "F")], "o_orderkey long, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    assert rows(queries.QUERIES["anti_insert_ignore"](spark, str(tmp_path))) == [(1, 5.0)]


def test_strict_release_leaves_out_only_orders_without_a_release(spark):
    sf = "/root/testdata/sf0.001"
    orders, lines = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("orders", "lineitem"))
    want = {r[0] for r in orders.select("o_orderkey").collect()} & {r[0] for r in lines.select("l_orderkey").collect()}
    assert {r.o_orderkey for r in queries.QUERIES["strict_release"](spark, sf).collect()} == want


def test_ranks_are_dealt_by_the_number_of_rows(spark, monkeypatch):
    """A task sorts so many rows at most, and ranks stay whole within a key."""
    monkeypatch.setattr(frames, "TASK_ROWS", 100)
    pairs = spark.range(2_000).selectExpr("id % 50 AS k", "id % 7 AS t", "double(id * 37 % 101) AS x", "double(id * 53 % 97) AS y")
    assert frames.dealt(pairs, ["k"]).rdd.getNumPartitions() == 20
    plan = labels.demeaned_spearman(pairs, "x", "y", "k", "t")._jdf.queryExecution().toString()
    assert plan.count("hashpartitioning(k") and "20), REPARTITION_BY_NUM" in plan
    got = {r.k: r.ic for r in labels.spearman(pairs, "x", "y", ["k"], 3).collect()}
    want = pairs.toPandas().groupby("k").apply(lambda g: g.x.rank().corr(g.y.rank()))
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got) and len(got) == 50


def test_metrics_run_a_backtest_once_and_quotes_travel_with_their_order(spark, monkeypatch):
    day = lambda n: dt.date(2024, 1, n)
    orders = spark.createDataFrame([("a", day(1), k, 60.0 if k % 50 else 10.0, 0.0, 0.0, 0.5, 0.1, day(30)) for k in range(1, 200)], "run string, date date, key long, price double, fees double, slippage double, delta double, edge double, expiry date")
    quotes = spark.createDataFrame([(day(d), 1, 60.0 + d, 0.1) for d in (2, 5)], "date date, key long, price double, edge double")
    monkeypatch.setattr(risk, "AT_ONCE", 7)
    ledger = risk.backtest(orders, quotes, cash=100.0, most_delta=2.0, most_loss=50.0)
    got = ledger.orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(1, len(got) + 1)) and [r.key for r in got if r.kind == "ENTRY"] == [1, 50, 100, 150]
    assert {(r.reason, r.key > 150) for r in got if r.kind == "REJECT"} == {("CASH", False), ("DELTA", True)} and sum(r.kind == "REJECT" for r in got) == 195
    assert [r.positions_value for r in got if r.kind == "SNAPSHOT"] == [90.0, 92.0, 95.0]
    text = lambda f: f._jdf.queryExecution().executedPlan().toString()
    assert text(risk.trade_metrics(ledger, 100.0)).count("MapInArrow") == 1


def test_first_line_and_new_orders_with_missing_keys(spark, tmp_path):
    """A line without a number comes after its order's others; without its key it isn't known to be new, and nothing is if an old order has no key."""
    line = "l_orderkey long, l_linenumber int, l_quantity double"
    spark.createDataFrame([(1, None, 5.0), (1, 2, 7.0), (None, 1, 3.0), (2, None, 4.0), (3, 1, 6.0)], line).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = []
    for old in ([(3, "F")], [(3, "O")], [(3, "F"), (None, "F")], [(3, "F"), (None, "O")]):
        spark.createDataFrame(old, "o_orderkey long, o_orderstatus string").write.mode("overwrite").parquet(str(tmp_path / "orders.parquet"))
        got.append({r.l_orderkey: r.l_quantity for r in queries.QUERIES["anti_insert_ignore"](spark, str(tmp_path)).collect()})
    assert got == [{1: 7.0, 2: 4.0}, {1: 7.0, 2: 4.0, 3: 6.0, None: 3.0}, {}, {1: 7.0, 2: 4.0}]


def test_rebalance_takes_positions_without_a_number_last(spark):
    held = spark.createDataFrame([(1, None, 1.0), (1, 7, 1.0), (1, 8, 1.0)], "id long, position long, delta double")
    assert [r.position for r in risk.rebalance(held, ["id"], {"delta": (0.0, 0.5)}, most=2).orderBy("place").collect()] == [7, 8]
    assert [r.position for r in risk.rebalance(held, ["id"], {"delta": (0.0, 0.5)}).orderBy("place").collect()] == [7, 8, None]


def test_a_trade_with_unknown_figures_is_not_approved(spark):
    trades = spark.createDataFrame([(1, 1.0, 1.0), (2, None, 1.0), (3, None, 9.0), (4, 9.0, 1.0)], "id int, max_loss double, with_delta double").withColumns({"contracts": F.lit(1), "worst_loss": F.lit(0.0)})
    got = risk.trade_issues(trades, most_loss=5, most_contracts=5, caps={"delta": 5}, most_stress=5)
    assert sorted((r.id, r.issues, r.approved) for r in got.collect()) == [(1, [], True), (2, [], None), (3, ["delta"], False), (4, ["max_loss"], False)]
