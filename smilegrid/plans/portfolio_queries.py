"""Panel, label, metric, risk, backtest and streaming operators on the test tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalars as S
from ..operators import asof, frames, labels, linalg, risk, scan
from ..streaming import live
from .queries import _DAILY, NODE, c, daily, kind, query, r6

# panel

_G = "SELECT CAST(ts AS DATE) AS day, max(ts) AS ts, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1"
_M = "SELECT CAST(ts AS DATE) AS day, arg_max(value, ts) AS macro FROM events WHERE event_type = 'error' GROUP BY 1"


@query("SELECT l.event_id, g.value AS spot, m.value AS macro FROM (SELECT * FROM events WHERE event_type = 'click') l ASOF LEFT JOIN (SELECT ts, value FROM events WHERE event_type = 'view') g ON l.ts >= g.ts ASOF LEFT JOIN (SELECT ts + INTERVAL 2 DAY AS ts, value FROM events WHERE event_type = 'error') m ON l.ts >= m.ts")
def panel_merge(t):
    rows = kind(t, "click").select("event_id", "ts")
    rows = asof.asof_join(rows, kind(t, "view").select("ts", "value"), prefix="g_")
    macro = kind(t, "error").select((c("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts"), "value")  # known two days later
    return asof.asof_join(rows, macro, prefix="m_").select("event_id", c("g_value").alias("spot"), c("m_value").alias("macro"))


@query("SELECT 'a' AS feature, count(*) FILTER (WHERE event_type <> 'view') / count(*) AS missing FROM events UNION ALL SELECT 'value', CAST(0 AS DOUBLE) FROM events HAVING count(*) > 0")
def completeness(t):
    rows = t("events").withColumn("a", F.when(c("event_type") == "view", c("value")))
    parts = F.array(*[F.struct(F.lit(x).alias("feature"), (F.count_if(c(x).isNull()) / F.count("*")).alias("missing")) for x in ("a", "value")])
    return rows.agg(parts.alias("p")).select(F.explode("p").alias("p")).select("p.*")


@query("SELECT user_id, count(*) FILTER (WHERE n <= 5 AND z IS NULL) AS early_missing FROM (SELECT user_id, row_number() OVER w AS n, lag(value, 5) OVER w AS z FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY 1")
def warm_up_check(t):
    w = frames.node(["user_id"], ["ts", "event_id"])
    rows = t("events").withColumns({"n": F.row_number().over(w), "z": F.lag("value", 5).over(w)})
    return rows.groupBy("user_id").agg(F.count_if((c("n") <= 5) & c("z").isNull()).alias("early_missing"))


# labels and metrics

_LAB = """WITH days AS (SELECT day, row_number() OVER (ORDER BY day) AS d FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)),
bars AS (SELECT e.ts, e.event_id, e.user_id, e.event_type, e.value, days.d, row_number() OVER (PARTITION BY days.d ORDER BY e.ts) AS place FROM events e JOIN days ON CAST(e.ts AS DATE) = days.day),
sizes AS (SELECT d, max(place) AS places FROM bars GROUP BY 1),
panel AS (SELECT event_id, user_id AS node, ts, value AS mid, (event_id % 100) / 100.0 AS delta, d, place, value + 100 AS spot FROM bars WHERE event_type = 'click'),
ends AS (SELECT node, d, arg_max(mid, ts) AS end_mid FROM panel GROUP BY 1, 2),
lab AS (SELECT p.event_id, p.node, p.ts, p.mid, p.d, e.end_mid - p.mid - p.delta * (b.value + 100 - p.spot) AS y_2 FROM panel p LEFT JOIN sizes s ON s.d = p.d + 2 LEFT JOIN bars b ON b.d = p.d + 2 AND b.place = least(p.place, s.places) LEFT JOIN ends e ON e.node = p.node AND e.d = p.d + 2)
"""


def labelled(t) -> DataFrame:
    bars = t("events").select("event_id", "ts", (c("value") + 100).alias("close"))
    panel = kind(t, "click").select("event_id", c("user_id").alias("node"), "ts", c("value").alias("mid"), ((c("event_id") % 100) / 100.0).alias("delta"))
    return labels.hedged_labels(panel, bars, (2,), node=["node"], key=["event_id"])


@query(_LAB + "SELECT event_id, round(y_2, 6) AS y_2 FROM lab")
def dhr_label(t):
    return labelled(t).select("event_id", *r6(y_2=c("y_2")))


@query(_LAB + ", p AS (SELECT quantile_cont(y_2, 0.01) AS lo, quantile_cont(y_2, 0.99) AS hi FROM lab) SELECT event_id, round(CASE WHEN y_2 < lo THEN lo WHEN y_2 > hi THEN hi ELSE y_2 END, 6) AS y_2 FROM lab, p")
def winsorize(t):
    return labels.winsorize(labelled(t), "y_2").select("event_id", *r6(y_2=c("y_2")))


@query(_LAB + "SELECT event_id, round(CASE WHEN d + 2 < 20 THEN y_2 END, 6) AS y_2 FROM lab")
def boundary_nullify(t):
    return labelled(t).select("event_id", *r6(y_2=labels.null_past("y_2", c("day_no"), 2, F.lit(20))))


@query("SELECT event_id, round(coalesce((value - avg(value) OVER w) / CASE WHEN stddev_samp(value) OVER w >= 1e-10 THEN stddev_samp(value) OVER w ELSE 1 END, 0), 5) AS z FROM events WINDOW w AS (PARTITION BY user_id)")
def node_zscore(t):
    return labels.node_normalise(t("events"), "value", ["user_id"]).select("event_id", F.round("z", 5).alias("z"))


@query("SELECT day, n.event_type, v, v IS NULL AS is_missing FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events) d CROSS JOIN (SELECT unnest(['view', 'click', 'signup', 'error', 'purchase']) AS event_type) n LEFT JOIN (SELECT CAST(ts AS DATE) AS day, event_type, max(value) AS v FROM events GROUP BY 1, 2) f USING (day, event_type)")
def dense_grid(t):
    e = t("events").withColumn("day", F.to_date("ts"))
    nodes = e.sparkSession.createDataFrame([(k,) for k in ("view", "click", "signup", "error", "purchase")], "event_type string")
    have = e.groupBy("day", "event_type").agg(F.max("value").alias("v"))
    return labels.dense_grid(have, e.select("day").distinct(), nodes, ["day", "event_type"]).select("day", "event_type", "v", c("v").isNull().alias("is_missing"))


@query("SELECT day, n.event_type, v, v IS NULL AS is_missing FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events) d CROSS JOIN (SELECT unnest(['view', 'click', 'signup', 'error', 'purchase', 'refund']) AS event_type) n LEFT JOIN (SELECT CAST(ts AS DATE) AS day, event_type, max(value) AS v FROM events GROUP BY 1, 2) f USING (day, event_type)")
def dense_grid_all(t):
    """Over the events of all users; no event is a refund, so its cells are missing."""
    e = t("events").withColumn("day", F.to_date("ts"))
    nodes = e.sparkSession.createDataFrame([(k,) for k in ("view", "click", "signup", "error", "purchase", "refund")], "event_type string")
    have = e.groupBy("day", "event_type").agg(F.max("value").alias("v"))
    return labels.dense_grid(have, e.select("day").distinct(), nodes, ["day", "event_type"]).select("day", "event_type", "v", c("v").isNull().alias("is_missing"))


@query("SELECT end_ts, start_ts FROM (SELECT day AS end_ts, lag(day, 5) OVER (ORDER BY day) AS start_ts FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)) WHERE start_ts IS NOT NULL")
def sample_windows(t):
    return frames.sample_windows(t("events").select(F.to_date("ts").alias("day")), "day", 5)


_XY = "SELECT l_suppkey, l_linenumber, l_orderkey, l_quantity AS x, l_extendedprice + l_discount * 100000 AS y FROM lineitem"


def pairs(t) -> DataFrame:
    return t("lineitem").select("l_suppkey", "l_linenumber", "l_orderkey", c("l_quantity").alias("x"), (c("l_extendedprice") + c("l_discount") * 100000).alias("y"))


@query(f"SELECT l_suppkey, round(CASE WHEN count(*) >= 2 AND stddev_pop(x) >= 1e-10 AND stddev_pop(y) >= 1e-10 THEN corr(x, y) END, 6) AS ic FROM ({_XY}) GROUP BY 1")
def pearson_ic(t):
    return labels.pearson(pairs(t), "x", "y", ["l_suppkey"]).select("l_suppkey", *r6(ic=c("ic")))


@query(f"SELECT l_suppkey, round(CASE WHEN count(*) >= 5 THEN corr(rx, ry) END, 6) AS ic FROM (SELECT l_suppkey, rank() OVER (PARTITION BY l_suppkey ORDER BY x) + (count(*) OVER (PARTITION BY l_suppkey, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY l_suppkey ORDER BY y) + (count(*) OVER (PARTITION BY l_suppkey, y) - 1) / 2.0 AS ry FROM ({_XY})) GROUP BY 1")
def spearman_ic(t):
    return labels.spearman(pairs(t), "x", "y", ["l_suppkey"], 5).select("l_suppkey", *r6(ic=c("ic")))


@query(f"SELECT l_orderkey, round(CASE WHEN count(*) >= 3 AND stddev_pop(rx) >= 1e-10 AND stddev_pop(ry) >= 1e-10 THEN corr(rx, ry) END, 6) AS ic FROM (SELECT l_orderkey, rank() OVER (PARTITION BY l_orderkey ORDER BY dx) + (count(*) OVER (PARTITION BY l_orderkey, dx) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY l_orderkey ORDER BY dy) + (count(*) OVER (PARTITION BY l_orderkey, dy) - 1) / 2.0 AS ry FROM (SELECT l_orderkey, count(*) OVER w AS n, round(x - avg(x) OVER w, 9) AS dx, round(y - avg(y) OVER w, 9) AS dy FROM ({_XY}) WINDOW w AS (PARTITION BY l_suppkey)) WHERE n >= 2) GROUP BY 1")
def xs_demeaned_ic(t):
    return labels.demeaned_spearman(pairs(t), "x", "y", "l_suppkey", "l_orderkey").select("l_orderkey", *r6(ic=c("ic")))


@query("SELECT l_returnflag, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae, round(avg(CASE WHEN abs(e) <= 1 THEN e * e / 2 ELSE abs(e) - 0.5 END), 6) AS huber, round(avg(greatest(0.5 * e, -0.5 * e)), 6) AS quantile FROM (SELECT l_returnflag, l_quantity / 10 - l_tax * 50 AS e FROM lineitem) GROUP BY 1")
def forecast_losses(t):
    loss = labels.losses(c("l_tax") * 50, c("l_quantity") / 10)
    return t("lineitem").groupBy("l_returnflag").agg(*r6(**loss))


@query("SELECT l_returnflag, round(sum(abs(l_tax - l_discount) * ln(1 + exp(l_quantity / 50))) / sum(ln(1 + exp(l_quantity / 50))), 6) AS loss FROM lineitem GROUP BY 1")
def volume_weights(t):
    return t("lineitem").groupBy("l_returnflag").agg(*r6(loss=labels.weighted_loss(F.abs(c("l_tax") - c("l_discount")), F.log1p(F.exp(c("l_quantity") / 50)))))


@query(f"SELECT day, p1, p2, p3 FROM (SELECT CAST(ts AS DATE) AS day, max(value) FILTER (WHERE series LIKE '1%') AS p1, max(value) FILTER (WHERE series LIKE '2%') AS p2, max(value) FILTER (WHERE series LIKE '3%') AS p3 FROM ({_DAILY}) GROUP BY 1) WHERE p1 IS NOT NULL AND p2 IS NOT NULL AND p3 IS NOT NULL")
def pivot_wide(t):
    rows = daily(t).withColumns({"day": F.to_date("ts"), "p": F.concat(F.lit("p"), F.substring("series", 1, 1))})
    return linalg.wide(rows, "day", "p", "value", ["p1", "p2", "p3"])


@query(f"SELECT a.series AS a, b.series AS b, round(covar_samp(a.value, b.value) / 1e6, 4) AS cov, round(corr(a.value, b.value), 6) AS corr, count(*) AS n FROM ({_DAILY}) a JOIN ({_DAILY}) b ON a.ts = b.ts AND a.series <= b.series GROUP BY 1, 2")
def cov_pairs(t):
    rows = linalg.covariance_pairs(daily(t), "ts", "series", "value")
    return rows.select("a", "b", F.round(c("cov") / 1e6, 4).alias("cov"), F.round("corr", 6).alias("corr"), "n")


@query()
def mp_clean(t):
    pairs_ = linalg.covariance_pairs(daily(t), "ts", "series", "value")
    names, corr = linalg.matrix(pairs_, "corr")
    rows = pairs_.agg(F.min("n")).first()[0]
    clean = linalg.clean_correlation(corr, rows)
    if clean is None:  # all noise
        cov = linalg.matrix(pairs_, "cov")[1]
        clean = linalg.shrunk_correlation(cov)
    return pairs_.sparkSession.createDataFrame([(a, b, float(clean[i, j])) for i, a in enumerate(names) for j, b in enumerate(names) if i <= j], "a string, b string, corr double")


@query()
def ledoit_wolf(t):
    wide = linalg.wide(daily(t).withColumn("p", F.concat(F.lit("p"), F.substring("series", 1, 1))), "ts", "p", "value", ["p1", "p2", "p3"])
    x = np.array([list(r)[1:] for r in wide.orderBy(F.desc("ts")).limit(252).collect()])  # the last 252 days of a fixed grid
    cov, a = linalg.shrunk_covariance(x)
    return wide.sparkSession.createDataFrame([(i, j, float(cov[i, j]), float(a)) for i in range(len(cov)) for j in range(i, len(cov))], "i int, j int, cov double, shrinkage double")


@query()
def corr_filter(t):
    names, corr = linalg.matrix(linalg.covariance_pairs(daily(t), "ts", "series", "value"), "corr")
    kept = linalg.keep_uncorrelated(names, {n: float(i) for i, n in enumerate(names)}, corr, 0.05)
    return t("orders").sparkSession.createDataFrame([(n, i) for i, n in enumerate(kept)], "series string, place int")


# signals, risk, execution

_SIG = "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 'ATM' WHEN l_linenumber % 3 = 1 THEN 'P25' ELSE 'C40' END AS bucket, CASE WHEN l_suppkey % 2 = 0 THEN 7 ELSE 60 END AS tenor, l_discount - 0.05 AS edge, l_tax * 8 AS iv FROM lineitem"


def signals(t) -> DataFrame:
    n = c("l_linenumber") % 3
    return t("lineitem").select("l_orderkey", "l_linenumber", F.when(n == 0, "ATM").when(n == 1, "P25").otherwise("C40").alias("bucket"), F.when(c("l_suppkey") % 2 == 0, 7).otherwise(60).alias("tenor"), (c("l_discount") - 0.05).alias("edge"), (c("l_tax") * 8).alias("iv"))


@query(f"SELECT *, CASE WHEN kind = 'TERM' THEN 'calendar' WHEN kind = 'DIRECTIONAL' AND confidence >= 0.5 THEN 'vertical' WHEN kind = 'SKEW' THEN 'skew' WHEN kind = 'ELEVATED' THEN 'condor' END AS structure FROM (SELECT l_orderkey, l_linenumber, round(least(1.0, abs(edge) / 0.1), 6) AS confidence, CASE WHEN bucket = 'ATM' THEN CASE WHEN tenor <= 14 THEN 'TERM' ELSE 'DIRECTIONAL' END WHEN bucket IN ('P25', 'P10', 'C10', 'C25') THEN 'SKEW' WHEN coalesce(iv, 0.2) > 0.3 AND abs(edge) < 0.03 THEN 'ELEVATED' ELSE 'DIRECTIONAL' END AS kind FROM ({_SIG}) WHERE abs(edge) >= 0.015)")
def signal_classify(t):
    rows = signals(t).where(F.abs("edge") >= 0.015)
    rows = rows.select("l_orderkey", "l_linenumber", F.round(risk.confidence(c("edge")), 6).alias("confidence"), S.signal_class(c("tenor"), c("bucket"), c("edge"), c("iv")).alias("kind"))
    return rows.withColumn("structure", S.structure_of(c("kind"), c("confidence")))


@query("SELECT event_id, CASE WHEN z > 2 THEN 'ELEVATED' ELSE 'DIRECTIONAL' END AS kind, CAST(CASE WHEN z > 2 THEN -0.05 ELSE 0.05 END AS DOUBLE) AS edge, round(least(0.9, abs(z) / 3), 5) AS confidence FROM (SELECT event_id, (value - m) / s AS z FROM (SELECT event_id, value, count(value) OVER w AS n, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) WHERE n >= 5 AND s >= 1e-12) WHERE abs(z) > 2")
def rule_signals(t):
    rows = t("events").withColumn("z", frames.prior_zscore(c("value"), frames.node(["user_id"], ["ts", "event_id"]), 5)).where(F.abs("z") > 2)
    return rows.select("event_id", F.when(c("z") > 2, "ELEVATED").otherwise("DIRECTIONAL").alias("kind"), F.when(c("z") > 2, -0.05).otherwise(0.05).alias("edge"), F.round(F.least(F.lit(0.9), F.abs("z") / 3), 5).alias("confidence"))


_LEGS = "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END * CAST(l_quantity AS INT) AS qty, l_extendedprice / 1000 AS price, l_discount AS delta, l_tax / 10 AS gamma, l_quantity / 100 AS vega FROM lineitem"


def legs(t, *more: Column) -> DataFrame:
    return t("lineitem").select(*more, "l_orderkey", "l_linenumber", (F.when(c("l_linenumber") % 2 == 0, -1).otherwise(1) * c("l_quantity").cast("int")).alias("qty"), (c("l_extendedprice") / 1000).alias("price"), c("l_discount").alias("delta"), (c("l_tax") / 10).alias("gamma"), (c("l_quantity") / 100).alias("vega"))


@query(f"SELECT l_orderkey, round(-sum(qty * price * 100), 4) AS net_premium FROM ({_LEGS}) GROUP BY 1")
def net_premium(t):
    return risk.net_premium(legs(t), ["l_orderkey"]).select("l_orderkey", F.round("net_premium", 4).alias("net_premium"))


@query(f"SELECT l_orderkey, round(sum(delta * qty * 100), 4) AS delta, round(sum(gamma * qty * 100), 4) AS gamma, round(sum(vega * qty * 100), 4) AS vega FROM ({_LEGS}) GROUP BY 1")
def portfolio_greeks(t):
    return risk.position_greeks(legs(t), ["l_orderkey"], ("delta", "gamma", "vega")).select("l_orderkey", *[F.round(x, 4).alias(x) for x in ("delta", "gamma", "vega")])


@query("SELECT l_orderkey, l_linenumber, CAST(CASE WHEN x < 1 THEN 1 WHEN x > 10 THEN 10 ELSE x END AS INT) AS size FROM (SELECT l_orderkey, l_linenumber, round_even(4 * (l_discount * 10 + 0.5) * least(1.0, greatest(0.1, l_quantity / 32)) * 0.75, 0) AS x FROM lineitem)")
def sizing(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", risk.contracts(F.lit(4), c("l_discount") * 10, c("l_quantity"), 32, F.lit(0.75), 10).alias("size"))


#: The reference's scenarios: six spot shocks, five volatility shocks, and the deepest fall with the highest rise.
_SCENARIOS = "SELECT unnest([-0.2, -0.1, -0.05, 0.05, 0.1, 0.2, 0.0, 0.0, 0.0, 0.0, 0.0, -0.2]) AS s, unnest([0.0, 0.0, 0.0, 0.0, 0.0, 0.0, -10.0, -5.0, 5.0, 10.0, 20.0, 20.0]) AS v"


@query(f"SELECT l_orderkey, round(min(pnl), 4) AS worst_pnl, round(abs(least(min(pnl), 0)), 4) AS worst_loss FROM (SELECT l_orderkey, delta * 100 * s + gamma * 100 * s * 100 * s / 2 + vega * v / 100 AS pnl FROM (SELECT l_orderkey, sum(delta * qty * 100) AS delta, sum(gamma * qty * 100) AS gamma, sum(vega * qty * 100) AS vega FROM ({_LEGS}) GROUP BY 1) CROSS JOIN ({_SCENARIOS})) GROUP BY 1")
def stress_grid(t):
    rows = risk.position_greeks(legs(t), ["l_orderkey"], ("delta", "gamma", "vega")).withColumn("spot", F.lit(100.0))
    return risk.stress(rows, "l_orderkey").select("l_orderkey", F.round("worst_pnl", 4).alias("worst_pnl"), F.round("worst_loss", 4).alias("worst_loss"))


@query("SELECT event_id, max(value > 99) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS killed FROM events")
def kill_latch(t):
    return scan.latch(t("events"), c("value") > 99, *NODE, cell=F.date_trunc("hour", "ts")).select("event_id", "killed")


@query(f"SELECT l_orderkey, l_linenumber, round(p, 6) AS fill_price, fees, round(qty * p * 100 + fees, 4) AS net FROM (SELECT *, coalesce(CASE WHEN qty > 0 THEN CASE WHEN l_linenumber <> 3 THEN price * 1.01 * 1.0005 END ELSE price * 0.99 * 0.9995 END, price) AS p, CAST(greatest(abs(qty) * 0.65, 1.0) AS DOUBLE) AS fees FROM ({_LEGS}))")
def fill_sim(t):
    rows = legs(t).withColumns({"ask": F.when(c("l_linenumber") != 3, c("price") * 1.01), "bid": c("price") * 0.99, "entry_price": c("price")})
    return risk.fills(rows).select("l_orderkey", "l_linenumber", F.round("fill_price", 6).alias("fill_price"), "fees", F.round("net", 4).alias("net"))


@query("SELECT l.l_orderkey, round(sum(l.qty * (coalesce(p.p_retailprice / 50, l.price) - l.price) * 100), 4) AS unrealized FROM (SELECT l_partkey, l_orderkey, CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END * CAST(l_quantity AS INT) AS qty, l_extendedprice / 1000 AS price FROM lineitem) l LEFT JOIN (SELECT * FROM part WHERE p_size < 30) p ON l.l_partkey = p.p_partkey GROUP BY 1")
def mark_to_market(t):
    rows = t("lineitem").select("l_partkey", "l_orderkey", (F.when(c("l_linenumber") % 2 == 0, -1).otherwise(1) * c("l_quantity").cast("int")).alias("qty"), (c("l_extendedprice") / 1000).alias("entry"))
    rows = rows.join(t("part").where("p_size < 30").select(c("p_partkey").alias("l_partkey"), (c("p_retailprice") / 50).alias("quote")), "l_partkey", "left")
    rows = asof.cascade(rows, [("surface", c("quote")), ("entry", c("entry"))])
    return rows.groupBy("l_orderkey").agg(F.round(F.sum(c("qty") * (c("price") - c("entry")) * S.MULTIPLIER), 4).alias("unrealized"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN pnl <= -0.8 * abs(prem) THEN 'STOP_LOSS' WHEN edge * e0 < 0 AND abs(edge) >= 0.5 * abs(e0) THEN 'REVERSAL' WHEN abs(edge) < 0.3 * abs(e0) THEN 'EDGE_DECAY' WHEN pnl >= 0.5 * abs(prem) THEN 'TAKE_PROFIT' WHEN dte <= 3 THEN 'TIME' END AS reason FROM (SELECT l_orderkey, l_linenumber, (l_quantity - 25) * 4 AS pnl, 100.0 AS prem, l_tax - 0.03 AS edge, l_discount - 0.045 AS e0, l_partkey % 30 AS dte FROM lineitem)")
def exit_priority(t):
    reason = risk.exit_signal((c("l_quantity") - 25) * 4, F.lit(100.0), c("l_tax") - 0.03, c("l_discount") - 0.045, c("l_partkey") % 30, F.lit(0))
    return t("lineitem").select("l_orderkey", "l_linenumber", reason.alias("reason"))


@query("SELECT user_id, event_id, place FROM (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY abs(value - 50) DESC, event_id) AS INT) AS place FROM events WHERE abs(value - 50) > 30) WHERE place <= 3")
def drift_bands(t):
    rows = t("events").where(F.abs(c("value") - 50) > 30)
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc(F.abs(c("value") - 50)), "event_id"))
    return rows.withColumn("place", place).where("place <= 3").select("user_id", "event_id", "place")


_EQ = "SELECT series, CAST(ts AS DATE) AS day, ts, 1e6 + sum(value - 150000) OVER (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING) / 100 AS equity FROM (" + _DAILY + ")"


def equity(t) -> DataFrame:
    w = Window.partitionBy("series").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return daily(t).withColumn("equity", 1e6 + F.sum(c("value") - 150000).over(w) / 100)


@query(f"SELECT series, round(arg_max(equity, ts) / arg_min(equity, ts) - 1, 6) AS total_return, round(avg(r) / stddev_samp(r) * sqrt(252), 4) AS sharpe, round(avg(r) / stddev_samp(CASE WHEN r < 0 THEN r END) * sqrt(252), 4) AS sortino, round(min(dd), 6) AS max_drawdown, round(min(var), 8) AS var_5, round(avg(CASE WHEN r <= var THEN r END), 8) AS cvar_5, round(count(*) FILTER (WHERE r > 0) / count(r), 6) AS win_rate FROM (SELECT *, quantile_cont(r, 0.05) OVER (PARTITION BY series) AS var FROM (SELECT *, equity / lag(equity) OVER (PARTITION BY series ORDER BY ts) - 1 AS r, equity / max(equity) OVER (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM ({_EQ}))) GROUP BY 1")
def backtest_metrics(t):
    rows = risk.run_metrics(equity(t), "series", "ts", "equity")
    return rows.select("series", F.round("total_return", 6).alias("total_return"), F.round("sharpe", 4).alias("sharpe"), F.round("sortino", 4).alias("sortino"), F.round("max_drawdown", 6).alias("max_drawdown"), F.round("var_5", 8).alias("var_5"), F.round("cvar_5", 8).alias("cvar_5"), F.round("win_rate", 6).alias("win_rate"))


@query("SELECT o_orderpriority AS structure, count(*) AS trades, round(sum(pnl), 2) AS pnl, count(*) FILTER (WHERE pnl > 0) AS wins FROM (SELECT o_orderpriority, o_totalprice - 150000 AS pnl FROM orders) GROUP BY 1")
def pnl_by_structure(t):
    pnl = c("o_totalprice") - 150000
    return t("orders").groupBy(c("o_orderpriority").alias("structure")).agg(F.count("*").alias("trades"), F.round(F.sum(pnl), 2).alias("pnl"), F.count_if(pnl > 0).alias("wins"))


def ledger(t) -> DataFrame:
    """Orders bought at their total and marked, on the ship date of a line, at a share of it that the line's discount sets."""
    total, key = c("o_totalprice"), c("o_orderkey")
    day = F.to_date("o_orderdate")
    orders = t("orders").select(c("o_orderpriority").alias("run"), day.alias("date"), key.alias("key"), total.alias("price"), F.lit(1.0).alias("fees"), (total * 5e-4).alias("slippage"), ((key % 21 - 10) / 10.0).alias("delta"), ((key % 7 - 3) / 100.0).alias("edge"), F.date_add(day, (key % 120).cast("int")).alias("expiry"))
    lines = t("lineitem").select(c("l_orderkey").alias("key"), F.to_date("l_shipdate").alias("date"), "l_linenumber", "l_discount", (c("l_tax") - 0.04).alias("edge"))
    marks = frames.first_rows(lines, ["key", "date"], ["l_linenumber", "l_discount", "edge"]).join(orders.select("key", c("price").alias("total")), "key")
    marks = marks.select("date", "key", (c("total") * (0.1 + c("l_discount") * 20)).alias("price"), "edge")
    return risk.backtest(orders, marks, cash=3e6, most_delta=2.0, most_loss=1e6)


@query()
def backtest_run(t):
    return ledger(t)


@query()
def backtest_report(t):
    return risk.trade_metrics(ledger(t), 3e6)


@query()
def run_comparison(t):
    return risk.compare_runs(risk.trade_metrics(ledger(t), 3e6))


_NODES = "SELECT i, j, i * 7 + j AS node FROM (SELECT unnest(range(6)) AS i) CROSS JOIN (SELECT unnest(range(7)) AS j)"


def grid(t) -> DataFrame:
    spark = t("region").sparkSession
    return spark.createDataFrame([(i, j, i * 7 + j) for i in range(len(S.TENORS)) for j in range(len(S.BUCKET_DELTA))], "i long, j long, node long")


@query(f"SELECT a.node AS src, b.node AS dst FROM ({_NODES}) a JOIN ({_NODES}) b ON abs(a.i - b.i) + abs(a.j - b.j) = 1")
def grid_edges(t):
    return linalg.grid_edges(grid(t)).select(c("src_node").alias("src"), c("dst_node").alias("dst"))


@query(f"SELECT a.node AS src, b.node AS dst, round(abs(ln(1 + x.v) - ln(1 + y.v)), 6) AS gap FROM ({_NODES}) a JOIN ({_NODES}) b ON abs(a.i - b.i) + abs(a.j - b.j) = 1 JOIN (SELECT p_partkey % 42 AS node, sum(p_retailprice) AS v FROM part GROUP BY 1) x ON x.node = a.node JOIN (SELECT p_partkey % 42 AS node, sum(p_retailprice) AS v FROM part GROUP BY 1) y ON y.node = b.node")
def edge_volume_gap(t):
    volume = t("part").groupBy((c("p_partkey") % 42).alias("node")).agg(F.sum("p_retailprice").alias("v"))
    e = linalg.grid_edges(grid(t).join(volume, "node"))
    return e.select(c("src_node").alias("src"), c("dst_node").alias("dst"), F.round(F.abs(F.log1p("src_v") - F.log1p("dst_v")), 6).alias("gap"))


# streaming forms, run as batches here

@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling(t):
    return live.tumbling(t("events"), "ts", "1 hour", ["event_type"]).select(c("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY 1, 2")
def sliding(t):
    return live.sliding(t("events"), "ts", "2 hours", "1 hour", ["event_type"]).select(c("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT min(ts) AS start, user_id, count(*) AS n FROM (SELECT *, sum(CASE WHEN last IS NULL OR ts - last > INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS last FROM events)) GROUP BY user_id, s")
def session(t):
    return live.sessions(t("events"), "ts", "6 hours", ["user_id"]).select(c("start").cast("timestamp_ntz").alias("start"), "user_id", "n")
