"""Structures, risk checks, validation, splits and live features on the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars as S
from ..operators import frames, labels, linalg, risk, scan, structures, tables
from ..sources import store
from ..streaming import live
from .portfolio_queries import _LEGS, legs
from .queries import _DAILY, _STEPS, NODE, c, daily, last_rows, over, over_days, place, query, quotes, r6, stepped

# structures: a snapshot is a twentieth of the parts, a signal an order

_SURFACE = """SELECT p_partkey % 20 AS snap, [7, 14, 30, 60, 90, 120][CAST(p_size % 6 AS INT) + 1] AS tenor, ['P10', 'P25', 'P40', 'ATM', 'C40', 'C25', 'C10'][CAST(p_partkey % 7 AS INT) + 1] AS bucket,
CASE WHEN p_partkey % 7 < 3 OR (p_partkey % 7 = 3 AND p_size % 2 = 0) THEN 'P' ELSE 'C' END AS "right", p_retailprice AS strike, CASE WHEN p_size > 5 THEN 1500.0 END AS spot, p_retailprice / 40 AS price, p_partkey AS symbol, p_partkey AS place, p_size AS expiry FROM part"""
_ASKED = """SELECT o_orderkey AS id, o_orderkey % 20 AS snap, [7, 14, 30, 60, 90, 120][CAST(o_custkey % 6 AS INT) + 1] AS tenor, ['P10', 'P25', 'P40', 'ATM', 'C40', 'C25', 'C10'][CAST(o_custkey % 7 AS INT) + 1] AS bucket, (o_orderkey % 13 - 6) / 100.0 AS edge FROM orders"""


def surface(t) -> DataFrame:
    bucket = F.element_at(F.array(*[F.lit(x) for x in S.BUCKET_DELTA]), (c("p_partkey") % 7 + 1).cast("int"))
    tenor = F.element_at(F.array(*[F.lit(x) for x in S.TENORS]), (c("p_size") % 6 + 1).cast("int"))
    put = (c("p_partkey") % 7 < 3) | ((c("p_partkey") % 7 == 3) & (c("p_size") % 2 == 0))
    return t("part").select((c("p_partkey") % 20).alias("snap"), tenor.alias("tenor"), bucket.alias("bucket"), F.when(put, "P").otherwise("C").alias("right"), c("p_retailprice").alias("strike"), F.when(c("p_size") > 5, 1500.0).alias("spot"), (c("p_retailprice") / 40).alias("price"), c("p_partkey").alias("symbol"), c("p_partkey").alias("place"), c("p_size").alias("expiry"))


def asked(t) -> DataFrame:
    bucket = F.element_at(F.array(*[F.lit(x) for x in S.BUCKET_DELTA]), (c("o_custkey") % 7 + 1).cast("int"))
    tenor = F.element_at(F.array(*[F.lit(x) for x in S.TENORS]), (c("o_custkey") % 6 + 1).cast("int"))
    return t("orders").select(c("o_orderkey").alias("id"), (c("o_orderkey") % 20).alias("snap"), tenor.alias("tenor"), bucket.alias("bucket"), ((c("o_orderkey") % 13 - 6) / 100.0).alias("edge"))


_FIRSTS = f"""s AS ({_SURFACE}), q AS ({_ASKED}), node AS (SELECT snap, tenor, bucket, arg_min(symbol, place) AS symbol, arg_min(strike, place) AS strike, arg_min(coalesce(spot, strike), place) AS spot FROM s GROUP BY 1, 2, 3)"""


@query(f"""WITH {_FIRSTS}, far AS (SELECT *, row_number() OVER (PARTITION BY n.snap, n.tenor, n.bucket ORDER BY abs(f.strike - n.strike), f.tenor, f.place) AS r, f.symbol AS far_symbol, abs(f.strike - n.strike) <= n.spot * 0.01 AS ok
FROM node n JOIN s f ON f.snap = n.snap AND f.bucket = n.bucket AND f.tenor > n.tenor + 30),
both_ AS (SELECT q.id, far.symbol AS near, far.far_symbol AS far, CASE WHEN q.edge > 0 THEN 1 ELSE -1 END AS up FROM q JOIN far ON q.snap = far.snap AND q.tenor = far.tenor AND q.bucket = far.bucket WHERE r = 1 AND ok)
SELECT id, 0 AS leg, near AS symbol, -up AS qty FROM both_ UNION ALL SELECT id, 1, far, up FROM both_""")
def calendar_legs(t):
    return structures.calendar_legs(asked(t), surface(t)).select("id", "leg", "symbol", "qty")


@query(f"""WITH {_FIRSTS}, pick AS (SELECT q.id, n.symbol, n.strike, n.spot, n.snap, n.tenor, CASE WHEN q.edge > 0 THEN 'C' ELSE 'P' END AS side, CASE WHEN q.edge > 0 THEN 1 ELSE -1 END AS up FROM q JOIN node n USING (snap, tenor, bucket)),
buy AS (SELECT id, arg_min(o.symbol, o.place) AS symbol FROM pick p JOIN s o ON o.snap = p.snap AND o.tenor = p.tenor AND o."right" = p.side AND o.strike = p.strike GROUP BY id),
sell AS (SELECT id, symbol FROM (SELECT p.id, o.symbol, row_number() OVER (PARTITION BY p.id ORDER BY abs(o.strike - (p.strike + up * 0.02 * p.spot)), o.place) AS r FROM pick p JOIN s o ON o.snap = p.snap AND o.tenor = p.tenor AND o."right" = p.side AND (o.strike - p.strike) * up > 0) WHERE r = 1)
SELECT id, 0 AS leg, buy.symbol, 1 AS qty FROM buy JOIN sell USING (id) UNION ALL SELECT id, 1, sell.symbol, -1 FROM buy JOIN sell USING (id)""")
def vertical_legs(t):
    return structures.vertical_legs(asked(t), surface(t)).select("id", "leg", "symbol", "qty")


def _winged_sql(width: float) -> str:
    def wing(name: str, right: str, step: int) -> str:
        return f"""{name}_wing AS (SELECT snap, tenor, symbol FROM (SELECT k.snap, k.tenor, o.symbol, row_number() OVER (PARTITION BY k.snap, k.tenor ORDER BY abs(o.strike - (k.strike + {step} * {width} * k.spot)), o.place) AS r
FROM (SELECT * FROM {name} JOIN slice USING (snap, tenor)) k JOIN s o ON o.snap = k.snap AND o.tenor = k.tenor AND o."right" = '{right}' AND (o.strike - k.strike) * {step} > 0) WHERE r = 1)"""

    short = lambda name, bucket, right: f"""{name} AS (SELECT snap, tenor, arg_min(symbol, place) AS symbol, arg_min(strike, place) AS strike FROM s WHERE bucket = '{bucket}' AND "right" = '{right}' GROUP BY 1, 2)"""
    return f"""WITH s AS ({_SURFACE}), q AS ({_ASKED}), slice AS (SELECT snap, tenor, arg_min(coalesce(spot, strike), place) AS spot FROM s GROUP BY 1, 2), {short("put", "P25", "P")}, {short("call", "C25", "C")}, {wing("put", "P", -1)}, {wing("call", "C", 1)},
legs4 AS (SELECT q.id, q.edge, [put.symbol, put_wing.symbol, call.symbol, call_wing.symbol] AS symbols FROM q JOIN put USING (snap, tenor) JOIN put_wing USING (snap, tenor) JOIN call USING (snap, tenor) JOIN call_wing USING (snap, tenor))"""


@query(f"{_winged_sql(0.02)} SELECT id, CAST(i AS INT) AS leg, symbols[i + 1] AS symbol, [-1, 1, -1, 1][i + 1] AS qty FROM legs4, range(4) AS t(i)")
def condor_legs(t):
    return structures.condor_legs(asked(t), surface(t)).select("id", "leg", "symbol", "qty")


@query(f"{_winged_sql(0.03)} SELECT id, CAST(i AS INT) AS leg, symbols[i + 1] AS symbol, [-1, 1, 1, -1][i + 1] * CASE WHEN edge > 0 THEN 1 ELSE -1 END AS qty FROM legs4, range(4) AS t(i)")
def skew_legs(t):
    return structures.skew_legs(asked(t), surface(t)).select("id", "leg", "symbol", "qty")


# premium, checks, kill switch

_TRADE = "SELECT l_orderkey, CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END * CAST(l_quantity AS INT) AS qty, l_extendedprice / 1000 AS price, CAST(l_partkey % 3 AS DOUBLE) AS strike, CASE WHEN l_suppkey % 2 = 0 THEN 'P' ELSE 'C' END AS side FROM lineitem"
_LOSS = f"""SELECT *, CASE WHEN net < 0 THEN -net WHEN strikes = 2 THEN greatest(0, width - net) WHEN strikes = 1 THEN abs(longs) ELSE greatest(0, greatest(puts, calls) - net) END AS max_loss FROM (
SELECT l_orderkey, -sum(qty * price * 100) AS net, CAST(sum(abs(qty)) AS BIGINT) AS contracts, count(DISTINCT strike) AS strikes, (max(strike) - min(strike)) * 100 AS width, coalesce(sum(CASE WHEN qty > 0 THEN qty * price * 100 END), 0) AS longs,
CASE WHEN count(*) FILTER (WHERE side = 'P') >= 2 THEN (max(strike) FILTER (WHERE side = 'P') - min(strike) FILTER (WHERE side = 'P')) * 100 ELSE 0 END AS puts,
CASE WHEN count(*) FILTER (WHERE side = 'C') >= 2 THEN (max(strike) FILTER (WHERE side = 'C') - min(strike) FILTER (WHERE side = 'C')) * 100 ELSE 0 END AS calls FROM ({_TRADE}) GROUP BY 1)"""


def trades(t, *more: Column) -> DataFrame:
    qty = F.when(c("l_linenumber") % 2 == 0, -1).otherwise(1) * c("l_quantity").cast("int")
    return t("lineitem").select(*more, "l_orderkey", qty.alias("qty"), (c("l_extendedprice") / 1000).alias("price"), (c("l_partkey") % 3).cast("double").alias("strike"), F.when(c("l_suppkey") % 2 == 0, "P").otherwise("C").alias("right"))


@query(f"SELECT l_orderkey, round(net, 4) AS net_premium, net < 0 AS is_debit, contracts, round(max_loss, 4) AS max_loss FROM ({_LOSS})")
def premium_and_loss(t):
    return structures.premium_and_loss(trades(t), ["l_orderkey"]).select("l_orderkey", F.round("net_premium", 4).alias("net_premium"), "is_debit", "contracts", F.round("max_loss", 4).alias("max_loss"))


@query(f"""WITH g AS (SELECT l_orderkey, 200 + sum(delta * qty * 100) AS d, 1 + sum(gamma * qty * 100) AS g, 500 + sum(vega * qty * 100) AS v FROM ({_LEGS}) GROUP BY 1),
x AS (SELECT g.l_orderkey, d, g, v, max_loss, contracts FROM g JOIN ({_LOSS}) l USING (l_orderkey)),
y AS (SELECT *, (SELECT abs(least(min(d * 100 * s + g * 100 * s * 100 * s / 2 + v * p / 100), 0)) FROM (SELECT unnest([-0.2, -0.1, -0.05, 0.05, 0.1, 0.2, 0.0, 0.0, 0.0, 0.0, 0.0, -0.2]) AS s, unnest([0.0, 0.0, 0.0, 0.0, 0.0, 0.0, -10.0, -5.0, 5.0, 10.0, 20.0, 20.0]) AS p)) AS stress FROM x)
SELECT l_orderkey, array_to_string(list_filter([CASE WHEN max_loss > 5000 THEN 'max_loss' END, CASE WHEN contracts > 150 THEN 'contracts' END, CASE WHEN abs(d) > 400 THEN 'delta' END, CASE WHEN abs(g) > 20 THEN 'gamma' END, CASE WHEN abs(v) > 3000 THEN 'vega' END, CASE WHEN stress > 9000.5 THEN 'stress' END], lambda x: x IS NOT NULL), ',') AS issues,
NOT (max_loss > 5000 OR contracts > 150 OR abs(d) > 400 OR abs(g) > 20 OR abs(v) > 3000 OR stress > 9000.5) AS approved FROM y""")
def trade_check(t):
    greeks = risk.position_greeks(legs(t, place()), ["l_orderkey"], ("delta", "gamma", "vega"), ["place"])
    held = {"delta": 200.0, "gamma": 1.0, "vega": 500.0}
    rows = greeks.select("l_orderkey", *[(c(g) + F.lit(v)).alias(g) for g, v in held.items()], F.lit(100.0).alias("spot"))
    rows = rows.join(risk.stress(rows, "l_orderkey"), "l_orderkey").join(structures.premium_and_loss(trades(t, place()), ["l_orderkey"], ["place"]), "l_orderkey").withColumnsRenamed({g: f"with_{g}" for g in held})
    rows = risk.trade_issues(rows, most_loss=5000, most_contracts=150, caps={"delta": 400, "gamma": 20, "vega": 3000}, most_stress=9000.5)
    return rows.select("l_orderkey", F.array_join("issues", ",").alias("issues"), "approved")


_CLOSE = "SELECT l_orderkey AS position, l_partkey AS symbol, -l_linenumber + CASE WHEN l_suppkey % 9 = 0 THEN 1 ELSE 0 END AS qty, CASE WHEN l_orderkey % 10 = 0 THEN 'STOP_LOSS' ELSE 'TIME' END AS exit_type FROM lineitem"


@query(f"WITH held AS (SELECT l_orderkey AS position, l_partkey AS symbol, max(l_linenumber) AS held FROM lineitem WHERE l_orderkey % 7 <> 0 GROUP BY 1, 2), known AS (SELECT DISTINCT position FROM held) SELECT x.position, count(*) FILTER (WHERE held IS NULL OR qty <> -held) AS wrong_legs, bool_or(known.position IS NOT NULL) AND (bool_or(exit_type = 'STOP_LOSS') OR count(*) FILTER (WHERE held IS NULL OR qty <> -held) = 0) AS approved FROM ({_CLOSE}) x LEFT JOIN held USING (position, symbol) LEFT JOIN known ON known.position = x.position GROUP BY 1")
def exit_check(t):
    rows = t("lineitem").select(c("l_orderkey").alias("position"), c("l_partkey").alias("symbol"), "l_linenumber", "l_suppkey")
    held = rows.where("position % 7 <> 0").groupBy("position", "symbol").agg(F.max("l_linenumber").alias("qty"))
    closing = rows.select("position", "symbol", (-c("l_linenumber") + F.when(c("l_suppkey") % 9 == 0, 1).otherwise(0)).alias("qty"), F.when(c("position") % 10 == 0, "STOP_LOSS").otherwise("TIME").alias("exit_type"))
    return risk.exit_issues(closing, held)


@query("SELECT event_id, first_value(reason IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS kill_reason FROM (SELECT *, CASE WHEN value - 50 < -49 THEN 'DAILY_LOSS' WHEN value > 99 THEN 'STRESS_BREACH' WHEN value / 500 > 0.197 THEN 'LIQUIDITY_COLLAPSE' END AS reason FROM events)")
def kill_triggers(t):
    reason = risk.kill_reason(c("value") - 50, c("value"), F.lit(99.0), c("value") / 500, most_loss=49, most_spread=0.197)
    return scan.latched(t("events"), reason, *NODE, cell=F.date_trunc("hour", "ts")).select("event_id", "kill_reason")


_POS = "SELECT l_suppkey AS portfolio, l_orderkey * 10 + l_linenumber AS position, l_discount * 100 - 4 AS delta, l_tax * 100 - 4 AS vega, l_quantity / 100 - 0.2 AS gamma FROM lineitem"


@query(f"""WITH p AS (SELECT *, sum(delta) OVER w AS sd, sum(vega) OVER w AS sv, sum(gamma) OVER w AS sg FROM ({_POS}) WINDOW w AS (PARTITION BY portfolio)),
x AS (SELECT portfolio, position, 0 AS i, 'delta' AS greek, sd - 5 AS off, 50.0 AS allowed, delta AS g FROM p UNION ALL SELECT portfolio, position, 1, 'vega', sv, 20.0, vega FROM p UNION ALL SELECT portfolio, position, 2, 'gamma', sg, 1.0, gamma FROM p),
y AS (SELECT *, abs(off) / allowed AS severity, g * CASE WHEN off > 0 THEN 1 ELSE -1 END AS push FROM x), z AS (SELECT * FROM y WHERE abs(off) > allowed AND push > 0 AND push >= 0.01 * abs(off)),
own AS (SELECT *, row_number() OVER (PARTITION BY portfolio, position ORDER BY severity DESC, i, push DESC) AS n FROM z)
SELECT portfolio, position, greek, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY portfolio ORDER BY severity DESC, i, push DESC, position) AS INT) AS place FROM own WHERE n = 1) WHERE place <= 3""")
def rebalance_signals(t):
    rows = t("lineitem").select(c("l_suppkey").alias("portfolio"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("position"), (c("l_discount") * 100 - 4).alias("delta"), (c("l_tax") * 100 - 4).alias("vega"), (c("l_quantity") / 100 - 0.2).alias("gamma"), place())
    return risk.rebalance(rows, ["portfolio"], {"delta": (5.0, 50.0), "vega": (0.0, 20.0), "gamma": (0.0, 1.0)}, least_gain=0.01, order=["place"])


@query("SELECT l_orderkey, l_linenumber, CAST(greatest(1, least(10, round_even(b1 * rf, 0))) AS INT) AS risk_parity, CAST(greatest(1, least(10, round_even(b2 * rf, 0))) AS INT) AS kelly FROM (SELECT *, CASE WHEN m <= 0 THEN 2 ELSE greatest(1, floor(1000 / m)) END AS b1, CASE WHEN e = 0 OR m <= 0 THEN 2 ELSE greatest(1, floor(least(1.0, abs(e) / 0.1) * abs(e) * 0.25 * 1000 * 10 / m)) END AS b2, CASE WHEN m > 1000 THEN 1000 / m ELSE 1.0 END AS rf FROM (SELECT l_orderkey, l_linenumber, l_extendedprice / 40 - 50 AS m, l_discount - 0.05 AS e FROM lineitem))")
def sizing_methods(t):
    m, e = c("l_extendedprice") / 40 - 50, c("l_discount") - 0.05
    size = lambda base: S.clip(F.bround(base * risk.risk_factor(m, 1000), 0), 1, 10).cast("int")
    return t("lineitem").select("l_orderkey", "l_linenumber", size(risk.base_size("risk_parity", max_loss=m, most_loss=1000, base=2)).alias("risk_parity"), size(risk.base_size("kelly", max_loss=m, most_loss=1000, base=2, edge=e, conf=risk.confidence(e))).alias("kelly"))


@query(f"SELECT l_orderkey, round(coalesce(sum(CASE WHEN qty > 0 THEN CASE WHEN l_linenumber <> 3 THEN price * 1.01 END ELSE price * 0.99 END * 5e-4 * abs(qty) * 100), 0), 4) AS slippage, round(greatest(sum(abs(qty)) * 0.65, 1.0), 4) AS fees FROM ({_LEGS}) GROUP BY 1")
def cost_estimate(t):
    rows = legs(t).withColumns({"ask": F.when(c("l_linenumber") != 3, c("price") * 1.01), "bid": c("price") * 0.99})
    return risk.cost_estimate(rows, ["l_orderkey"]).select("l_orderkey", F.round("slippage", 4).alias("slippage"), F.round("fees", 4).alias("fees"))


@query("SELECT l.l_orderkey, l.l_linenumber, -l.qty AS qty, round(coalesce(CASE WHEN l.qty > 0 THEN p.p_retailprice * 0.99 ELSE p.p_retailprice * 1.01 END / 50, l.price), 6) AS price, CASE WHEN p.p_partkey IS NULL THEN 'entry' ELSE 'surface' END AS source FROM (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END * CAST(l_quantity AS INT) AS qty, l_extendedprice / 1000 AS price FROM lineitem) l LEFT JOIN (SELECT * FROM part WHERE p_size < 30) p ON l.l_partkey = p.p_partkey")
def exit_orders(t):
    """Open legs reversed: longs are sold at the bid, shorts bought at the ask, at the entry price where there is no quote."""
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.when(c("l_linenumber") % 2 == 0, -1).otherwise(1) * c("l_quantity").cast("int")).alias("qty"), (c("l_extendedprice") / 1000).alias("entry"))
    rows = rows.join(t("part").where("p_size < 30").select(c("p_partkey").alias("l_partkey"), "p_retailprice"), "l_partkey", "left")
    quote = F.when(c("qty") > 0, c("p_retailprice") * 0.99).otherwise(c("p_retailprice") * 1.01) / 50
    return rows.select("l_orderkey", "l_linenumber", (-c("qty")).alias("qty"), F.round(F.coalesce(quote, c("entry")), 6).alias("price"), F.when(quote.isNull(), "entry").otherwise("surface").alias("source"))


@query("SELECT l_orderkey, CASE WHEN max(l_shipdate) < DATE '1996-01-01' THEN 'EXPIRED' ELSE 'OPEN' END AS state, round(CASE WHEN max(l_shipdate) < DATE '1996-01-01' THEN -sum(l_extendedprice) END, 2) AS realized FROM lineitem GROUP BY 1")
def expirations(t):
    """A position expires on the day after the last of its legs; it then gives back what it cost."""
    out = F.max(F.to_date("l_shipdate")) < F.lit("1996-01-01").cast("date")
    return t("lineitem").groupBy("l_orderkey").agg(F.when(out, "EXPIRED").otherwise("OPEN").alias("state"), F.round(F.when(out, -F.sum("l_extendedprice")), 2).alias("realized"))


@query("SELECT o_orderstatus AS state, count(*) AS positions, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice - 1e5 ELSE 0 END), 2) AS realized, round(sum(CASE WHEN o_orderstatus <> 'F' THEN o_totalprice - 1e5 ELSE 0 END), 2) AS unrealized FROM orders GROUP BY 1")
def portfolio_pnl(t):
    done, pnl = c("o_orderstatus") == "F", c("o_totalprice") - 1e5
    return t("orders").groupBy(c("o_orderstatus").alias("state")).agg(F.count("*").alias("positions"), F.round(F.sum(F.when(done, pnl).otherwise(0)), 2).alias("realized"), F.round(F.sum(F.when(~done, pnl).otherwise(0)), 2).alias("unrealized"))


@query("SELECT l_returnflag, round(max((ask - bid) / nullif((ask + bid) / 2, 0)), 8) AS max_spread FROM (SELECT l_returnflag, CASE WHEN l_linenumber = 7 THEN 0 ELSE l_extendedprice * (1 - l_discount) END AS bid, CASE WHEN l_linenumber = 7 THEN 0 ELSE l_extendedprice * (1 + l_tax) END AS ask FROM lineitem) GROUP BY 1")
def max_spread(t):
    flat = c("l_linenumber") == 7
    bid, ask = F.when(flat, 0.0).otherwise(c("l_extendedprice") * (1 - c("l_discount"))), F.when(flat, 0.0).otherwise(c("l_extendedprice") * (1 + c("l_tax")))
    return t("lineitem").select("l_returnflag", bid.alias("bid"), ask.alias("ask")).groupBy("l_returnflag").agg(F.round(F.max(F.try_divide(c("ask") - c("bid"), S.mid(c("bid"), c("ask")))), 8).alias("max_spread"))


@query("SELECT alert, level, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN abs(value * 10) > 700 THEN 'delta' END, CASE WHEN (value - 50) * 30 < -1000 THEN 'pnl' END], lambda x: x IS NOT NULL)) AS alert, 'WARNING' AS level FROM events) GROUP BY 1, 2")
def alert_counts(t):
    rows = t("events").select((c("value") * 10).alias("delta"), ((c("value") - 50) * 30).alias("pnl"))
    return live.alerts(rows, most_delta=700.0).groupBy("alert", "level").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, round(avg(CASE WHEN p_size < 30 THEN p_size END), 6) AS liquidity FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1")
def leg_liquidity(t):
    volume = t("part").select(c("p_partkey").alias("l_partkey"), F.when(c("p_size") < 30, c("p_size")).alias("volume"))
    return t("lineitem").join(volume, "l_partkey", "left").groupBy("l_orderkey").agg(F.round(F.avg("volume"), 6).alias("liquidity"))


@query(f"SELECT round(sum(cov * a_w * b_w) / 1e6, 4) AS variance FROM (SELECT covar_samp(a.value, b.value) AS cov, any_value(CAST(substring(a.series, 1, 1) AS INT)) / 10.0 AS a_w, any_value(CAST(substring(b.series, 1, 1) AS INT)) / 10.0 AS b_w FROM ({_DAILY}) a JOIN ({_DAILY}) b ON a.ts = b.ts GROUP BY a.series, b.series)")
def portfolio_variance(t):
    rows = daily(t)
    weights = rows.select(c("series").alias("node")).distinct().withColumn("w", F.substring("node", 1, 1).cast("int") / 10.0)
    return linalg.portfolio_variance(linalg.covariance_pairs(rows, "ts", "series", "value"), weights).select(F.round(c("variance") / 1e6, 4).alias("variance"))


@query(f"WITH x AS (SELECT a.series AS a, b.series AS b, covar_samp(a.value, b.value) AS cov, any_value(CAST(substring(a.series, 1, 1) AS INT)) / 10.0 AS wa, any_value(CAST(substring(b.series, 1, 1) AS INT)) / 10.0 AS wb FROM ({_DAILY}) a JOIN ({_DAILY}) b ON a.ts = b.ts GROUP BY a.series, b.series) SELECT a AS node, round(sum(cov * wb) / (SELECT sqrt(sum(cov * wa * wb)) FROM x), 4) AS marginal FROM x GROUP BY 1")
def marginal_risk(t):
    rows = daily(t)
    weights = rows.select(c("series").alias("node")).distinct().withColumn("w", F.substring("node", 1, 1).cast("int") / 10.0)
    return linalg.marginal_risk(linalg.covariance_pairs(rows, "ts", "series", "value"), weights).select("node", F.round("marginal", 4).alias("marginal"))


# validation, splits, statistics

_Q = "SELECT l_extendedprice * (1 - l_discount) - CASE WHEN l_linenumber = 6 THEN 2e5 ELSE 0 END AS bid, l_extendedprice * (1 + l_tax - l_discount * 1.5) AS ask, CASE WHEN l_linenumber = 5 THEN NULL ELSE l_orderkey END AS symbol FROM lineitem"


@query(f"SELECT 'quotes' AS data, 'crossed' AS \"check\", 'WARNING' AS severity, count(*) AS rows FROM ({_Q}) WHERE bid > ask HAVING count(*) > 0 UNION ALL SELECT 'quotes', 'negative', 'ERROR', count(*) FROM ({_Q}) WHERE bid < 0 OR ask < 0 HAVING count(*) > 0 UNION ALL SELECT 'quotes', 'null_symbol', 'ERROR', count(*) FROM ({_Q}) WHERE symbol IS NULL HAVING count(*) > 0 UNION ALL SELECT 'bars', 'missing_ts', 'ERROR', 0")
def validation_issues(t):
    return issues(t)


def issues(t) -> DataFrame:
    rows = quotes(t).select(*["l_linenumber", "bid", "ask", "l_orderkey"])
    rows = rows.select((c("bid") - F.when(c("l_linenumber") == 6, 2e5).otherwise(0)).alias("bid"), "ask", F.when(c("l_linenumber") != 5, c("l_orderkey")).alias("symbol"))
    bars = t("region")
    return tables.validate({"quotes": (rows, [tables.missing_columns(rows, ["bid", "ask"]), tables.quote_issues(rows), tables.null_issues(rows, ["symbol"])]), "bars": (bars, [tables.missing_columns(bars, ["r_name", "ts"])])})


@query(f"SELECT 'quotes' AS data, NOT bool_or(bid < 0 OR ask < 0 OR symbol IS NULL) AS passed, CAST(CASE WHEN bool_or(bid > ask) THEN 1 ELSE 0 END + CASE WHEN bool_or(bid < 0 OR ask < 0) THEN 1 ELSE 0 END + CASE WHEN bool_or(symbol IS NULL) THEN 1 ELSE 0 END AS BIGINT) AS issues, count(*) AS total_rows FROM ({_Q}) UNION ALL SELECT 'bars', false, 1, count(*) FROM region UNION ALL SELECT 'macro', true, 0, count(*) FROM nation")
def validation_rollup(t):
    total = lambda name, data: t(name).groupBy().agg(F.count("*").alias("total_rows")).select(F.lit(data).alias("data"), "total_rows")
    return tables.rollup(issues(t), total("lineitem", "quotes").union(total("region", "bars")).union(total("nation", "macro")))


_CUTS = ("2024-01-03", "2024-01-10", "2024-01-15", "2024-01-20")


@query("SELECT split, count(*) AS rows, count(*) FILTER (WHERE ts >= first) AS targets, round(avg(value), 6) AS mean FROM events JOIN (SELECT unnest(['train', 'val', 'test']) AS split, unnest([TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-15', TIMESTAMP '2024-01-20']) AS until, unnest([TIMESTAMP '2024-01-03', TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-15']) AS first) s ON ts < until GROUP BY 1")
def split_panel(t):
    rows = labels.splits(t("events"), "ts", *[F.lit(x).cast("timestamp_ntz") for x in _CUTS])
    return rows.groupBy("split").agg(F.count("*").alias("rows"), F.count_if("target").alias("targets"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT split, count(*) FILTER (WHERE ts >= first) AS rows, count(*) FILTER (WHERE ts >= first AND event_type <> 'view') AS labels, count(*) FILTER (WHERE ts >= first AND event_type <> 'view') > 0 AS usable FROM events JOIN (SELECT unnest(['train', 'val', 'test']) AS split, unnest([TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-15', TIMESTAMP '2024-01-20']) AS until, unnest([TIMESTAMP '2024-01-03', TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-15']) AS first) s ON ts < until GROUP BY 1")
def split_checks(t):
    rows = t("events").withColumn("y", F.when(c("event_type") != "view", c("value")))
    return labels.split_issues(labels.splits(rows, "ts", *[F.lit(x).cast("timestamp_ntz") for x in _CUTS]), "y")


@query("SELECT 'value' AS label, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM events UNION ALL SELECT 'same', 3.0, 1.0 UNION ALL SELECT 'none', 0.0, 1.0")
def label_stats(t):
    rows = t("events").withColumns({"same": F.lit(3.0), "none": F.lit(None).cast("double")})
    return labels.global_stats(rows, ["value", "same", "none"]).select("label", *r6(mean=c("mean"), std=c("std")))


@query("WITH s AS (SELECT user_id, avg(v) AS m, CASE WHEN stddev_samp(v) >= 1e-10 THEN stddev_samp(v) ELSE 1 END AS d FROM (SELECT user_id, CASE WHEN event_type <> 'error' THEN value END AS v FROM events WHERE ts < TIMESTAMP '2024-01-15') GROUP BY 1) SELECT event_id, round((value - coalesce(m, 0)) / coalesce(d, 1), 5) AS z FROM events LEFT JOIN s USING (user_id)")
def train_normalise(t):
    rows = t("events").withColumn("masked", c("event_type") == "error")
    stats = labels.node_stats(rows.where(c("ts") < F.lit("2024-01-15").cast("timestamp_ntz")), "value", ["user_id"], "masked")
    return labels.normalise_with(rows, "value", stats, ["user_id"]).select("event_id", F.round("z", 5).alias("z"))


@query("SELECT event_id, round(z * s + m, 5) AS value FROM (SELECT event_id, (value - avg(value) OVER ()) / stddev_samp(value) OVER () AS z FROM events), (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)")
def denormalise(t):
    stats = F.broadcast(labels.global_stats(t("events"), ["value"]))  # one row
    rows = t("events").crossJoin(stats).withColumn("z", (c("value") - c("mean")) / c("std"))
    return rows.select("event_id", F.round(labels.denormalised(c("z"), c("mean"), c("std")), 5).alias("value"))


@query("SELECT l_returnflag, round(sqrt(avg(pow(l_quantity - x, 2))), 6) AS rmse, round(avg(abs(l_quantity - x)), 6) AS mae FROM (SELECT *, lag(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS x FROM lineitem) GROUP BY 1")
def naive_baseline(t):
    """The last value of a node as its forecast."""
    rows = t("lineitem").withColumn("x", F.lag("l_quantity").over(frames.node(["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"])))
    loss = labels.losses(c("x"), c("l_quantity"))
    return rows.groupBy("l_returnflag").agg(*r6(rmse=loss["rmse"], mae=loss["mae"]))


@query("SELECT user_id, i AS patch, round(list_sum(v[i * 3 + 1 : i * 3 + 5]), 6) AS total FROM (SELECT user_id, v, unnest(range((len(v) - 5) // 3 + 1)) AS i FROM (SELECT user_id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY 1) WHERE len(v) >= 5)")
def patch_unfold(t):
    rows = scan.unfolded(t("events"), *NODE, cell=F.date_trunc("hour", "ts"), size=5, stride=3)
    return rows.groupBy("user_id", "patch").agg(F.round(F.sum("value"), 6).alias("total"))


# features, snapshots, chains

@query(f"SELECT event_id, round(CASE WHEN count(r) OVER {over_days(5)} >= 2 THEN sqrt(var_samp(r) OVER {over_days(5)} * 252) END, 4) AS realized_vol FROM (SELECT *, (value + 100) / lag(value + 100, CAST(steps AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS r FROM ({_STEPS}))")
def realized_vol(t):
    returns = lambda by: {"r": S.ratio(c("p"), frames.days_ago(c("p"), by, 1)) - 1}
    rows = stepped(t, 6, returns, lambda by: {"v": frames.at_least(c("r"), F.var_samp("r"), frames.prior_days(by, 5), 2)})
    return rows.select("event_id", F.round(F.sqrt(c("v") * 252), 4).alias("realized_vol"))


@query(f"SELECT event_id, round(vol, 6) AS vol, round(CASE WHEN n < 2 THEN NULL WHEN vol > 1e-10 THEN (value - m) / vol ELSE 0 END, 5) AS z FROM (SELECT *, CASE WHEN n >= 2 THEN s END AS vol FROM (SELECT event_id, value, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place, count(value) OVER {over(10)} AS n, avg(value) OVER {over(10)} AS m, stddev_samp(value) OVER {over(10)} AS s FROM events) WHERE place > 5)")
def live_features(t):
    """Partial windows from two values on, once five rows are known; a flat window scores 0; the current row is left out."""
    w = frames.node(*NODE)
    prior = frames.prior(w, 10)
    vol, n = frames.at_least(c("value"), F.stddev_samp("value"), prior, 2), F.count("value").over(prior)
    rows = t("events").withColumns({"place": F.row_number().over(w), "vol": vol, "m": F.avg("value").over(prior), "n": n}).where("place > 5")
    return rows.select("event_id", F.round("vol", 6).alias("vol"), F.round(F.when(c("n") < 2, None).when(c("vol") > 1e-10, (c("value") - c("m")) / c("vol")).otherwise(0.0), 5).alias("z"))


@query("SELECT event_id, user_id FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events WHERE CAST(ts AS DATE) <= DATE '2024-01-12')")
def latest_snapshot(t):
    rows = t("events").withColumn("day", F.to_date("ts"))
    return tables.latest_snapshot(rows, "day", F.lit("2024-01-12").cast("date")).select("event_id", "user_id")


@query("SELECT CAST(ts AS DATE) AS day, user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def eod_quote(t):
    return t("events").groupBy(F.to_date("ts").alias("day"), "user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


_CHAIN = "SELECT o_orderkey AS symbol, CAST(o_orderdate AS DATE) AS expiry, CASE WHEN o_orderkey % 2 = 0 THEN 'C' ELSE 'P' END AS \"right\", o_totalprice / 1000 AS strike FROM orders"


@query(f"SELECT symbol, expiry FROM (SELECT *, row_number() OVER (PARTITION BY expiry, \"right\" ORDER BY abs(strike - 150), symbol) AS n FROM ({_CHAIN}) WHERE date_diff('day', DATE '1995-01-01', expiry) BETWEEN 7 AND 400 AND strike / 150 BETWEEN 0.8 AND 1.2) WHERE n <= 2")
def chain_filter(t):
    rows = t("orders").select(c("o_orderkey").alias("symbol"), F.to_date("o_orderdate").alias("expiry"), F.when(c("o_orderkey") % 2 == 0, "C").otherwise("P").alias("right"), (c("o_totalprice") / 1000).alias("strike"))
    return tables.chain_filter(rows, F.lit(150.0), F.lit("1995-01-01").cast("date"), dte=(7, 400), moneyness=(0.8, 1.2), most=2).select("symbol", "expiry")


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS expiry, string_agg(o_orderkey, ',' ORDER BY CAST(o_orderkey AS VARCHAR)) AS symbols FROM orders WHERE o_orderdate >= DATE '1998-01-01' GROUP BY 1")
def active_symbols(t):
    rows = t("orders").where(c("o_orderdate") >= F.lit("1998-01-01")).groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("expiry"))
    return rows.agg(F.array_join(F.array_sort(F.collect_list(c("o_orderkey").cast("string"))), ",").alias("symbols"))


@query("SELECT l.l_orderkey, l.l_linenumber, f.flags FROM lineitem l LEFT JOIN (SELECT l_suppkey, l_returnflag, arg_min(l_linenumber, (l_orderkey, l_linenumber)) AS flags FROM lineitem WHERE l_tax > 0.02 GROUP BY 1, 2) f USING (l_suppkey, l_returnflag)")
def flag_lookup(t):
    """The first flags of a row's node."""
    first = t("lineitem").where("l_tax > 0.02").groupBy("l_suppkey", "l_returnflag").agg(F.min_by("l_linenumber", F.struct("l_orderkey", "l_linenumber")).alias("flags"))
    return t("lineitem").join(first, ["l_suppkey", "l_returnflag"], "left").select("l_orderkey", "l_linenumber", "flags")


@query("SELECT e.event_id, d.close FROM events e JOIN (SELECT CAST(ts AS DATE) AS day, arg_max(value, (ts, event_id)) AS close FROM events WHERE event_type = 'view' GROUP BY 1) d ON CAST(e.ts AS DATE) = d.day WHERE e.event_type = 'click'")
def last_close_of_day(t):
    close = t("events").where("event_type = 'view'").groupBy(F.to_date("ts").alias("day")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("close"))
    return t("events").where("event_type = 'click'").withColumn("day", F.to_date("ts")).join(close, "day").select("event_id", "close")


@query("SELECT count(DISTINCT (l_suppkey, l_returnflag)) AS nodes FROM lineitem")
def node_count(t):
    return t("lineitem").agg(F.count_distinct("l_suppkey", "l_returnflag").alias("nodes"))


@query("SELECT symbol, ts_ref, stat_type, place FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts_ref, stat_type ORDER BY place DESC) AS n FROM (SELECT l_partkey AS symbol, CAST(l_linenumber AS INT) AS stat_type, CAST(coalesce(CASE WHEN l_suppkey % 2 = 0 THEN l_shipdate END, DATE '1999-01-01') AS DATE) AS ts_ref, l_orderkey * 10 + l_linenumber AS place FROM lineitem WHERE l_linenumber IN (3, 6))) WHERE n = 1")
def statistics_rows(t):
    rows = t("lineitem").select(c("l_partkey").alias("symbol"), c("l_linenumber").cast("int").alias("stat_type"), F.when(c("l_suppkey") % 2 == 0, F.to_date("l_shipdate")).alias("ts_ref"), F.lit("1999-01-01").cast("date").alias("ts_event"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("place"))
    return tables.statistics_rows(rows, [3, 6]).select("symbol", "ts_ref", "stat_type", "place")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderpriority LIKE '1%' THEN o_totalprice / 100 ELSE o_totalprice END AS value, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 21 HOUR AS release FROM orders WHERE o_orderkey % 9 <> 0")
def macro_reader(t):
    """Text values as they arrive: "." is no value; per cent becomes a share; released at 21:00 on the day observed."""
    rows = t("orders").select("o_orderkey", "o_orderpriority", F.to_date("o_orderdate").alias("observed"), F.when(c("o_orderkey") % 9 == 0, ".").otherwise(c("o_totalprice").cast("string")).alias("text"))
    rows = rows.where("text <> '.'").withColumn("value", c("text").cast("double"))
    return rows.select("o_orderkey", S.percent_to_decimal(c("o_orderpriority"), c("value"), ("1",)).alias("value"), S.release_key(c("observed"), F.lit(None).cast("timestamp")).cast("timestamp_ntz").alias("release"))


@query("SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS value FROM orders WHERE CAST(o_orderdate AS TIMESTAMP) + INTERVAL 21 HOUR <= TIMESTAMP '1996-06-30 12:00:00' AND o_orderdate >= DATE '1996-04-01' GROUP BY 1")
def latest_released(t):
    """The last value released by an instant, from observations of the ninety days before it."""
    asof_ = F.lit("1996-06-30 12:00:00").cast("timestamp")
    seen = (S.release_key(F.to_date("o_orderdate"), F.lit(None).cast("timestamp")) <= asof_) & (F.to_date("o_orderdate") >= F.date_sub(F.lit("1996-06-30").cast("date"), 90))
    return t("orders").where(seen).groupBy("o_custkey").agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("value"))


@query("SELECT o_orderkey, CAST(release AS DATE) AS ts FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS release FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE release IS NOT NULL")
def strict_release(t):
    """Strict alignment keeps every observation with a release, an order's first ship date, and dates it by it; only orders without a line have none."""
    release = t("lineitem").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("release"))
    rows = t("orders").select("o_orderkey").join(release, "o_orderkey", "left")
    return tables.aligned(rows, "strict").select("o_orderkey", F.to_date("ts").alias("ts"))


@query("SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN isnan(s) THEN NULL ELSE s END, l_tax) AS delta FROM (SELECT *, CASE WHEN l_linenumber = 1 THEN CAST('NaN' AS DOUBLE) WHEN l_linenumber = 2 THEN NULL ELSE l_discount END AS s FROM lineitem)")
def greeks_or_entry(t):
    seen = F.when(c("l_linenumber") == 1, float("nan")).when(c("l_linenumber") != 2, c("l_discount"))
    return t("lineitem").select("l_orderkey", "l_linenumber", F.coalesce(S.finite(seen), c("l_tax")).alias("delta"))


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 12 HOUR")
def fresh_quotes(t):
    rows = t("events").crossJoin(F.broadcast(t("events").agg(F.max("ts").alias("now"))))  # one row
    return live.fresh(rows, "ts", c("now"), 12 * 3600).select("event_id")


@query("SELECT a.event_id, b.event_id AS view_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 2 HOUR AND a.ts + INTERVAL 2 HOUR WHERE a.event_type = 'click' AND b.event_type = 'view'")
def interval_join(t):
    part = lambda k: t("events").where(c("event_type") == k).select("event_id", "user_id", "ts")
    return live.joined_streams(part("click"), part("view"), "user_id", "ts", "2 HOURS").select("event_id", c("r_event_id").alias("view_id"))


@query(f"SELECT event_id, drawdown FROM (SELECT event_id, ts, round((value + 100) / max(value + 100) OVER {last_rows(21)} - 1, 6) AS drawdown FROM ({_STEPS})) WHERE ts >= TIMESTAMP '2024-01-02'")
def trimmed_panel(t):
    """A panel cut at its start date after its features are built, so that frames reach back into the rows before it."""
    rows = stepped(t, 21, lambda by: {"drawdown": S.ratio(c("p"), F.max("p").over(frames.last_days(by, 21))) - 1})
    return rows.where(c("ts") >= F.lit("2024-01-02").cast("timestamp_ntz")).select("event_id", *r6(drawdown=c("drawdown")))


# scans: the readers' columns from the test tables

@query("SELECT event_id, ts, value AS close FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-05 06:00:00'")
def scan_bars(t):
    rows = t("events").select("event_id", "ts", c("event_type").alias("symbol"), F.lit("1m").alias("timeframe"), c("value").alias("close"))
    return store.bars(rows, "click", "2024-01-02", "2024-01-05 06:00:00").select("event_id", "ts", "close")


@query("SELECT event_id, ts, user_id AS symbol FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-09' AND user_id IN (3, 5, 8, 13, 21, 34)")
def scan_quotes(t):
    rows = t("events").select("event_id", "ts", c("user_id").alias("symbol"))
    return store.option_quotes(rows, "2024-01-02", "2024-01-09", [3, 5, 8, 13, 21, 34])


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS obs_date, o_totalprice AS value FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01'")
def scan_macro(t):
    rows = t("orders").select("o_orderkey", c("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("obs_date"), c("o_totalprice").alias("value"))
    return store.macro_series(rows, "1-URGENT", "1996-01-01", "1997-01-01").select("o_orderkey", "obs_date", "value")


@query("SELECT o_orderkey, o_orderdate AS ts, o_custkey AS symbol FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1998-01-01' AND o_custkey BETWEEN 1 AND 1500")
def scan_option_bars(t):
    """A list of more symbols than a filter should hold: it is joined."""
    rows = t("orders").select("o_orderkey", c("o_orderdate").alias("ts"), c("o_custkey").alias("symbol"), c("o_orderstatus").alias("timeframe"))
    return store.option_bars(rows, "1995-01-01", "1998-01-01", list(range(1, 1501)), "F").select("o_orderkey", "ts", "symbol")


@query("SELECT l_orderkey, l_partkey AS symbol, l_shipdate AS ts_ref FROM lineitem WHERE l_linenumber = 3 AND l_shipdate >= DATE '1995-01-01' AND l_shipdate < DATE '1996-01-01'")
def scan_statistics(t):
    rows = t("lineitem").select("l_orderkey", c("l_partkey").alias("symbol"), c("l_linenumber").alias("stat_type"), c("l_shipdate").alias("ts_ref"))
    return store.option_statistics(rows, "1995-01-01", "1996-01-01", 3).select("l_orderkey", "symbol", "ts_ref")


_LOG = "SELECT o_custkey AS dataset, min(o_orderdate) AS min_ts, max(o_orderdate) AS max_ts, count(*) AS n FROM orders GROUP BY 1"


@query(f"SELECT * FROM ({_LOG}) WHERE max_ts >= TIMESTAMP '1995-03-01' AND min_ts < TIMESTAMP '1995-09-01'")
def scan_log(t):
    rows = t("orders").groupBy(c("o_custkey").alias("dataset")).agg(F.min("o_orderdate").alias("min_ts"), F.max("o_orderdate").alias("max_ts"), F.count("*").alias("n"))
    return store.overlapping(rows, "1995-03-01", "1995-09-01")


def _nodes(t) -> DataFrame:
    return t("lineitem").select("l_orderkey", c("l_shipdate").alias("ts"), c("l_linenumber").alias("tenor"), c("l_returnflag").alias("bucket"), c("l_linestatus").alias("version"))


@query("SELECT l_orderkey, l_shipdate AS ts, l_linenumber AS tenor, l_returnflag AS bucket FROM lineitem WHERE l_linestatus = 'F' AND l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-07-01' AND l_returnflag IN ('A', 'N')")
def scan_surfaces(t):
    return store.surface_rows(_nodes(t), "F", "1997-01-01", "1998-07-01", ["A", "N"]).drop("version")


@query("SELECT l_orderkey, l_shipdate AS ts, l_linenumber AS tenor, l_returnflag AS bucket FROM lineitem WHERE l_linestatus = 'O' AND l_shipdate < DATE '1998-01-01'")
def scan_panel(t):
    return store.surface_rows(_nodes(t), "O", end="1998-01-01").drop("version")


@query("SELECT o_orderkey AS id, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN true END, false) AS is_masked, CAST(NULL AS VARCHAR) AS mask_reason, CAST(o_totalprice AS DOUBLE) AS value FROM orders")
def panel_columns(t):
    """Only a panel's columns, in order, with their defaults."""
    rows = t("orders").select("o_custkey", c("o_totalprice").alias("value"), c("o_orderkey").alias("id"), F.when(c("o_orderkey") % 3 == 0, True).alias("is_masked"))
    return store.known_columns(rows, {"id": "long", "is_masked": "boolean", "mask_reason": "string", "value": "double"}, {"is_masked": False})
