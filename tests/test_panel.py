"""Prefix scans and blocks against plain windows, the linear model against NumPy, vintages and release modes."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from smilegrid.operators import frames, linalg, linear, scan, tables

ORDER = ["ts", "id"]


@pytest.fixture(scope="module")
def uneven(spark):
    """A node that holds half of all rows, one of a single row, a NULL node; NULL values, NULL times, equal times."""
    rng = np.random.default_rng(7)
    rows, start = [], dt.datetime(2024, 1, 1)
    for i in range(600):
        key = ("hot", "mid", "one" if i == 5 else "mid", None)[0 if i % 2 else int(rng.integers(1, 4))]
        ts = None if i % 97 == 0 else start + dt.timedelta(minutes=int(rng.integers(0, 600)) // 7 * 7)
        rows.append((i, key, ts, None if rng.random() < 0.15 else float(rng.integers(0, 50))))
    return spark.createDataFrame(rows, "id long, k string, ts timestamp_ntz, v double")


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    key = lambda r: tuple("~" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r)
    assert sorted(map(key, a.collect())) == sorted(map(key, b.select(*a.columns).collect()))


def test_prefix_scan(uneven):
    w = Window.partitionBy("k").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    v = F.when(F.col("v") > 30, F.col("v"))
    kinds = {"hi": ("max", F.col("v")), "lo": ("min", F.col("v")), "all": ("sum", F.col("v")), "one": ("first", v), "new": ("last", v)}
    plain = uneven.withColumns({"hi": F.max("v").over(w), "lo": F.min("v").over(w), "all": F.sum("v").over(w), "one": F.first(v, True).over(w), "new": F.last(v, True).over(w)})
    for unit in ("minute", "hour", "year"):
        same(scan.prefix_scan(uneven, ["k"], ORDER, F.date_trunc(unit, "ts"), kinds), plain)
    again = scan.prefix_scan(uneven.withColumn("hi", F.lit("mine")), ["k"], ORDER, F.date_trunc("hour", "ts"), kinds)
    same(again, plain)
    assert scan.prefix_scan(uneven.limit(0), ["k"], ORDER, F.date_trunc("hour", "ts"), kinds).count() == 0


def test_spells_and_latch(uneven):
    w = Window.partitionBy("k").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    rows = uneven.where("v IS NOT NULL")
    down = rows.withColumn("d", F.col("v") < F.max("v").over(w)).withColumn("i", F.sum(F.when(F.col("d"), 0).otherwise(1)).over(w))
    plain = down.where("d").groupBy("k", "i").agg(F.count("*").alias("length"), F.min("ts").alias("start")).drop("i")
    same(scan.spells(rows, "v", ["k"], ORDER, F.date_trunc("hour", "ts")), plain)
    reason = F.when(F.col("v") > 45, "high").when(F.col("v") < 1, "low")
    same(scan.latched(uneven, reason, ["k"], ORDER, F.date_trunc("hour", "ts")), uneven.withColumn("kill_reason", F.first(reason, True).over(w)))


def test_latch(uneven):
    w = Window.partitionBy("k").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    plain = uneven.withColumn("killed", F.max(F.coalesce(F.col("v") > 45, F.lit(False))).over(w))
    same(scan.latch(uneven, F.col("v") > 45, ["k"], ORDER, F.date_trunc("hour", "ts")), plain)


@pytest.mark.parametrize("size", [1, 50, 10_000])
def test_day_blocks_equal_plain_day_frames(uneven, size):
    """Nodes of very different numbers of rows a day, of one row, without a key or without times; a column of theirs is named steps."""
    days = uneven.withColumn("ts", F.col("ts") + F.make_dt_interval(F.lit(0), F.minute("ts") * 7)).withColumn("steps", F.lit(-1))

    def build(rows, by):
        rows = rows.withColumns({"ago": frames.days_ago(F.col("v"), by, 2), "std": frames.full(F.col("v"), F.stddev_samp("v"), frames.prior_days(by, 1), 1)})
        return rows.withColumns({"top": F.max("ago").over(frames.last_days(by, 2)), "steps_": F.col("steps")}).drop("steps")

    plain = build(frames.by_days(days.drop("steps"), "ts", ["k"], ORDER), ["k"]).drop("_at")
    same(scan.day_windowed(days, "ts", ["k"], ORDER, 4, build, size), plain)
    blocks = scan.day_blocks(days, "ts", ["k"], ORDER, 4, size)
    long = blocks.groupBy("k", "_block").agg(F.count("*").alias("n"), F.max("steps").alias("s")).where(F.col("n") > F.greatest(F.lit(size), F.col("s") * 4) + F.col("s") * 4)
    assert long.count() == 0 and blocks.where("NOT _halo").count() == 600
    assert size > 1 or blocks.where("k = 'hot'").select("_block").distinct().count() > 1
    assert scan.day_blocks(days.limit(0), "ts", ["k"], ORDER, 4).count() == 0


@pytest.mark.parametrize("size", [1, 7, 64, 10_000])
def test_blocks_with_halo(uneven, size):
    def build(rows, by):
        w = Window.partitionBy(*by).orderBy(*ORDER)
        return rows.withColumns({"lag": F.lag("v", 6).over(w), "mean": F.avg("v").over(w.rowsBetween(-6, -1)), "n": F.count("v").over(w.rowsBetween(-6, 0))})

    cell = F.date_trunc("hour", "ts")
    same(scan.windowed(uneven, ["k"], ORDER, cell, 6, build, size), build(uneven, ["k"]))
    blocks = scan.in_blocks(uneven, ["k"], ORDER, cell, 6, size).groupBy("k", "_block").count().agg(F.max("count")).first()[0]
    assert blocks <= max(size, 6) + 6
    assert scan.in_blocks(uneven, ["k"], ORDER, cell, 6, size).where("NOT _halo").count() == 600


@pytest.mark.parametrize(("size", "stride"), [(5, 3), (3, 5), (4, 4), (1, 1), (700, 2)])
def test_unfolded(uneven, size, stride):
    got = {}
    for r in scan.unfolded(uneven, ["k"], ORDER, F.date_trunc("hour", "ts"), size, stride).collect():
        got.setdefault((r.k, r.patch), {})[r.place] = r.id
    by = {}
    for r in sorted(uneven.collect(), key=lambda r: (r.ts is not None, r.ts or dt.datetime.min, r.id)):
        by.setdefault(r.k, []).append(r.id)
    want = {(k, i // stride): dict(enumerate(ids[i : i + size])) for k, ids in by.items() for i in range(0, len(ids) - size + 1, stride)}
    assert got == want


def test_linear_model(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((500, 4)) * [1, 1e6, 1e-4, 1] + [0, 5e6, 0, 3]
    y = np.stack([2 + x @ [1, 2e-6, 3e4, 0] + 0.01 * rng.standard_normal(500), -1 + x @ [0, 0, 0, 2]], 1)
    rows = [[*map(float, a), *map(float, b)] for a, b in zip(x, y, strict=True)]
    for i in range(0, 500, 10):
        rows[i][i % 4] = None if i % 20 else float("nan")
    for i in range(3, 500, 25):
        rows[i][5] = None
    frame = spark.createDataFrame([(i, *r, i % 3 == 0) for i, r in enumerate(rows)], "id long, a double, b double, c double, d double, y5 double, y10 double, ok boolean").repartition(5)
    names, targets = ["a", "b", "c", "d"], ["y5", "y10"]
    model = linear.fit_linear(frame, names, targets)
    got = {(r.target, r.term): r.value for r in model.collect()}
    m = np.array([[np.nan if v is None else v for v in r] for r in rows])
    for j, t in enumerate(targets):
        full = m[~np.isnan(m[:, [0, 1, 2, 3, 4 + j]]).any(1)]
        want = np.linalg.lstsq(np.c_[np.ones(len(full)), full[:, :4]], full[:, 4 + j], rcond=None)[0]
        assert np.allclose([got[t, k] for k in ("intercept", *names)], want, rtol=1e-6, atol=1e-8)
    out = {r.id: r for r in linear.forecast(frame, model, names, targets, mask=F.col("ok")).collect()}
    assert len(out) == 500 and out[1].pred_y5 == 0 and abs(out[3].pred_y10 - (got["y10", "intercept"] + sum(got["y10", k] * v for k, v in zip(names, rows[3], strict=False)))) < 1e-6
    assert linear.forecast(frame, model, names, targets).where("id = 10").first().pred_y5 is None
    # shrunk to nothing but the mean; equal features share; no rows, no terms
    flat = {(r.target, r.term): r.value for r in linear.fit_linear(frame, names, ["y10"], ridge=1e12).collect()}
    assert abs(flat["y10", "a"]) < 1e-6
    twin = {r.term: r.value for r in linear.fit_linear(frame.withColumn("e", F.col("d")), ["d", "e"], ["y10"]).collect()}
    assert np.isclose(twin["d"], twin["e"]) and np.isclose(twin["d"] + twin["e"], 2, atol=1e-6)
    assert linear.fit_linear(frame.limit(0), names, targets).count() == 0
    assert linear.forecast(frame, linear.fit_linear(frame.limit(0), names, targets), names, targets).where("pred_y5 IS NOT NULL").count() == 0


def test_known_values_follow_revisions(spark):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    at = lambda n, h=21: dt.datetime(2024, 1, 1, h) + dt.timedelta(days=n)
    vintages = [("gdp", day(0), at(0), 1, 10.0), ("gdp", day(0), at(5), 2, 11.0), ("gdp", day(1), at(9), 3, 20.0), ("gdp", day(1), at(9), 4, 21.0), ("cpi", day(0), None, 5, 9.0), (None, day(0), at(0), 6, 1.0)]
    asks = [("gdp", at(n)) for n in (-1, 0, 4, 5, 8, 9, 91, 92, 400)] + [("cpi", at(3)), ("gdp", None)]
    out = tables.known_values(spark.createDataFrame(asks, "series string, asked timestamp_ntz"), spark.createDataFrame(vintages, "series string, observed date, known timestamp_ntz, id long, value double"), ["series"], asked="asked", known="known", observed="observed", tie="id", value="value")
    got = {r.asked: r.value for r in out.collect()}
    assert got == {at(0): 10.0, at(4): 10.0, at(5): 11.0, at(8): 11.0, at(9): 21.0, at(91): 21.0}


def test_release_modes(spark):
    rows = spark.createDataFrame([(1, dt.date(2024, 1, 5), dt.datetime(2024, 1, 9, 8)), (2, dt.date(2024, 1, 5), None)], "id long, observed date, release timestamp_ntz")
    assert [(r.id, str(r.ts)) for r in tables.aligned(rows, "strict").collect()] == [(1, "2024-01-09 08:00:00")]
    assert [str(r.ts) for r in tables.aligned(rows, "conservative").collect()] == ["2024-01-07 00:00:00"] * 2
    with pytest.raises(ValueError, match="unknown mode"):
        tables.aligned(rows, "lenient")


def test_options_of_unknown_right(spark):
    from smilegrid.functions import pricing

    rows = [(s, k, 0.5, 0.03, right, vol) for s, k in ((100.0, 90.0), (100.0, 120.0), (100.0, 100.0)) for right in ("C", "P") for vol in (0.15, 0.6)]
    frame = spark.createDataFrame(rows, "s double, k double, t double, r double, right string, v double")
    known = F.when(F.col("s") > F.col("k"), "C").otherwise("P")
    frame = frame.where(F.col("right") == known).withColumn("mid", pricing.bs_price(*[F.col(c) for c in ("s", "k", "t", "r", "v", "right")]))
    terms = ("s", "k", "t", "r")
    none = F.lit(None).cast("string")
    out = frame.select(pricing.implied_vol("mid", *terms, "right").alias("a"), pricing.implied_vol("mid", *terms, none).alias("b"), pricing.solved("mid", *terms, "right").alias("x"), pricing.solved_sides((F.col("mid") * 0.98).alias("bid"), F.col("mid") * 1.02, "mid", *terms, none).alias("y"),
                       pricing.implied_vol(F.col("mid") * 0.98, *terms, "right").alias("bid"), pricing.implied_vol(F.col("mid") * 1.02, *terms, "right").alias("ask")).collect()
    assert out and all(r.a == r.b for r in out)
    for r in out:
        assert [r.x[c] for c in ("iv", "delta", "gamma", "vega", "theta")] == [r.y[c] for c in ("iv", "delta", "gamma", "vega", "theta")] and (r.y.iv_bid, r.y.iv_ask) == (r.bid, r.ask)


def test_shrunk_pairs_equal_the_matrix_form(spark):
    """Times without a node, NULL and NaN values and a repeat beside 40 complete times; one node; no rows."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(40, 4)) @ rng.normal(size=(4, 4)) + 1000
    rows = [(t, n, float(x[t, n])) for t in range(40) for n in range(4)]
    rows += [(40, 0, 5.0), (41, 0, 1.0), (41, 1, None), (41, 2, 3.0), (41, 3, 4.0), (42, 0, 1.0), (42, 1, float("nan")), (42, 2, 1.0), (42, 3, 2.0), (3, 1, float(x[3, 1]) - 7), (None, 1, 2.0)]
    panel = spark.createDataFrame(rows, "t long, n long, v double")
    for last, want in ((None, x), (25, x[-25:])):
        cov, a = linalg.shrunk_covariance(want)
        got = {(r.a, r.b): r for r in linalg.shrunk_pairs(panel, "t", "n", "v", last).collect()}
        assert len(got) == 10 and all(abs(r.cov - cov[i, j]) < 1e-8 and abs(r.shrinkage - a) < 1e-8 for (i, j), r in got.items())
    one = linalg.shrunk_pairs(panel.where("n = 2"), "t", "n", "v").collect()
    assert len(one) == 1 and one[0].shrinkage == 0
    assert linalg.shrunk_pairs(panel.limit(0), "t", "n", "v").count() == 0
