"""Scans, blocks, the linear baseline, macro vintages and hypothetical portfolios on the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import asof, frames, labels, linalg, linear, risk, samples, scan, structures, tables
from ..sources import manifest
from .queries import _DAILY, NODE, c, daily, kind, over, query, r6

_ALL = "(PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"

# running values and windows of long nodes

@query(f"SELECT event_id, round(p, 6) AS peak, round((p - value) / nullif(p, 0), 6) AS drawdown_pct FROM (SELECT *, max(value) OVER {_ALL} AS p FROM events)")
def running_peaks(t):
    rows = scan.peaks(t("events"), "value", *NODE, cell=F.date_trunc("hour", "ts"))
    return rows.select("event_id", *r6(peak=c("peak"), drawdown_pct=c("drawdown_pct")))


_RETURNS = "SELECT *, (p - lag(p) OVER w) / nullif(lag(p) OVER w, 0) AS r, CASE WHEN count(value) OVER b >= 5 THEN stddev_samp(value) OVER b END AS s FROM (SELECT *, value + 100 AS p FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), b AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"


@query(f"""SELECT event_id, round(value - lag(value, 5) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS iv_change_5, round(s, 6) AS vol_5, round(CASE WHEN s >= 1e-12 THEN (value - avg(value) OVER {over(5)}) / s END, 5) AS z,
round(CASE WHEN count(r) OVER {over(10)} >= 2 THEN var_samp(r) OVER {over(10)} * 252 END, 4) AS rv_10, round(CASE WHEN count(s) OVER {over(4, "CURRENT ROW")} >= 5 THEN stddev_samp(s) OVER {over(4, "CURRENT ROW")} END, 5) AS vol_of_vol,
round(p / max(p) OVER {over(251, "CURRENT ROW")} - 1, 6) AS drawdown FROM ({_RETURNS})""")
def node_features_blocks(t):
    """The node features of one panel, built in blocks with a halo of 252 rows: no task holds a node."""

    def build(rows, by):
        w = frames.node(by, NODE[1])
        rows = rows.withColumns({"iv_change_5": frames.change(c("value"), w, 5), "vol_5": frames.prior_std(c("value"), w, 5), "z": frames.prior_zscore(c("value"), w, 5)})
        rows = frames.realized_variance(rows, "p", by, NODE[1], windows=(10,))
        rows = frames.vol_of_vol(rows, "value", by, NODE[1], 5)
        return rows.withColumn("drawdown", S.ratio(c("p"), F.max("p").over(w.rowsBetween(-251, 0))) - 1)

    rows = scan.windowed(t("events").withColumn("p", c("value") + 100), *NODE, cell=F.date_trunc("hour", "ts"), halo=252, build=build)
    return rows.select("event_id", *r6(iv_change_5=c("iv_change_5"), vol_5=c("vol_5")), F.round("z", 5).alias("z"), F.round("rv_10", 4).alias("rv_10"), F.round("vol_of_vol", 5).alias("vol_of_vol"), *r6(drawdown=c("drawdown")))


# the linear baseline: lines until 1996 train it, the others get forecasts

_LINES = "SELECT l_orderkey, l_linenumber, l_shipdate, l_quantity AS x1, CASE WHEN l_linenumber <> 7 THEN l_discount * 100 END AS x2, l_extendedprice / 1000 AS y1, CASE WHEN l_linenumber <> 6 THEN l_tax * 100 + l_quantity / 10 END AS y2 FROM lineitem"
_LONG = f"SELECT 'y1' AS target, x1, x2, y1 AS y FROM ({_LINES}) WHERE l_shipdate < TIMESTAMP '1996-01-01' UNION ALL SELECT 'y2', x1, x2, y2 FROM ({_LINES}) WHERE l_shipdate < TIMESTAMP '1996-01-01'"
_COVS = f"SELECT target, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, var_pop(x1) AS c11, var_pop(x2) AS c22, covar_pop(x1, x2) AS c12, covar_pop(x1, y) AS c1y, covar_pop(x2, y) AS c2y FROM ({_LONG}) WHERE x1 IS NOT NULL AND x2 IS NOT NULL AND y IS NOT NULL GROUP BY target"
_FIT = f"SELECT target, b1, b2, my - b1 * m1 - b2 * m2 AS b0 FROM (SELECT *, (c22 * c1y - c12 * c2y) / (c11 * c22 - c12 * c12) AS b1, (c11 * c2y - c12 * c1y) / (c11 * c22 - c12 * c12) AS b2 FROM ({_COVS}))"
_X, _Y = ["x1", "x2"], ["y1", "y2"]


def lines(t):
    x2, y2 = F.when(c("l_linenumber") != 7, c("l_discount") * 100), F.when(c("l_linenumber") != 6, c("l_tax") * 100 + c("l_quantity") / 10)
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", c("l_quantity").alias("x1"), x2.alias("x2"), (c("l_extendedprice") / 1000).alias("y1"), y2.alias("y2"))


def _trained(t):
    return linear.fit_linear(lines(t).where(c("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz")), _X, _Y)


@query(f"SELECT target, term, round(value, 6) AS value FROM (SELECT target, unnest(['intercept', 'x1', 'x2']) AS term, unnest([b0, b1, b2]) AS value FROM ({_FIT}))")
def linear_fit(t):
    return _trained(t).select("target", "term", F.round("value", 6).alias("value"))


@query(f"""SELECT l_orderkey, l_linenumber, round(CASE WHEN x2 IS NULL THEN 0 ELSE a.b0 + a.b1 * x1 + a.b2 * x2 END, 5) AS pred_y1, round(CASE WHEN x2 IS NULL THEN 0 ELSE b.b0 + b.b1 * x1 + b.b2 * x2 END, 5) AS pred_y2
FROM ({_LINES}) l, (SELECT * FROM ({_FIT}) WHERE target = 'y1') a, (SELECT * FROM ({_FIT}) WHERE target = 'y2') b WHERE l_shipdate >= TIMESTAMP '1996-01-01'""")
def linear_forecast(t):
    rows = lines(t).where(c("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))
    rows = linear.forecast(rows, _trained(t), _X, _Y, mask=c("x2").isNotNull())
    return rows.select("l_orderkey", "l_linenumber", F.round("pred_y1", 5).alias("pred_y1"), F.round("pred_y2", 5).alias("pred_y2"))


# macro releases: two modes, plausible releases, revisions

_SEEN = "SELECT o_orderkey, o_custkey AS series, CAST(o_orderdate AS DATE) AS observed, o_totalprice AS value, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + to_hours(21) + to_days(CAST(o_orderkey % 11 - 2 AS INT)) END AS release FROM orders"


def seen(t):
    """Observations with a release from two days before to eight days after 21:00 on the day observed; a fifth have none."""
    day = F.to_date("o_orderdate")
    release = F.when(c("o_orderkey") % 5 != 0, day.cast("timestamp") + F.make_dt_interval((c("o_orderkey") % 11 - 2).cast("int"), F.lit(21)))
    return t("orders").select("o_orderkey", c("o_custkey").alias("series"), day.alias("observed"), c("o_totalprice").alias("value"), release.alias("release"))


@query(f"SELECT o_orderkey, 'strict' AS mode, release AS ts FROM ({_SEEN}) WHERE release IS NOT NULL UNION ALL SELECT o_orderkey, 'conservative', CAST(observed + 2 AS TIMESTAMP) FROM ({_SEEN})")
def release_modes(t):
    out = [tables.aligned(seen(t), mode).select("o_orderkey", F.lit(mode).alias("mode"), c("ts").cast("timestamp_ntz").alias("ts")) for mode in ("strict", "conservative")]
    return out[0].union(out[1])


_KEYED = f"SELECT *, CASE WHEN release BETWEEN proxy - INTERVAL 1 DAY AND proxy + INTERVAL 7 DAY THEN release ELSE proxy END AS known FROM (SELECT *, CAST(observed AS TIMESTAMP) + INTERVAL 21 HOUR AS proxy FROM ({_SEEN}))"


@query(f"SELECT o_orderkey, known, CASE WHEN release IS NULL THEN 'none' WHEN release = known THEN 'inside' ELSE 'outside' END AS window_ FROM ({_KEYED})")
def plausible_release(t):
    rows = seen(t).withColumn("known", S.release_key(c("observed"), c("release")))
    where = F.when(c("release").isNull(), "none").when(c("release") == c("known"), "inside").otherwise("outside")
    return rows.select("o_orderkey", c("known").cast("timestamp_ntz").alias("known"), where.alias("window_"))


@query(f"""WITH v AS ({_KEYED}), a AS (SELECT DISTINCT o_custkey AS series, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 12 HOUR AS asked FROM orders)
SELECT series, asked, arg_max(value, (observed, known, o_orderkey)) AS value, max(observed) AS observed FROM a JOIN v USING (series) WHERE known <= asked AND observed >= CAST(asked AS DATE) - 90 GROUP BY 1, 2""")
def vintage_values(t):
    """For each asked instant the value of the latest day observed that was released by then, by its last release: what was known, not what is."""
    asked = t("orders").select(c("o_custkey").alias("series"), (F.to_date("o_orderdate").cast("timestamp") + F.expr("INTERVAL 12 HOURS")).alias("asked")).distinct()
    rows = seen(t).withColumn("known", S.release_key(c("observed"), c("release")))
    out = tables.known_values(asked, rows, ["series"], asked="asked", known="known", observed="observed", tie="o_orderkey", value="value")
    return out.select("series", c("asked").cast("timestamp_ntz").alias("asked"), "value", "observed")


# hypothetical portfolios: a supplier's lines are its portfolio, an order of it a position

_BOOK = "SELECT l_suppkey AS portfolio, l_orderkey AS position, qty, delta, gamma, vega FROM (SELECT l_suppkey, l_orderkey, CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END * CAST(l_quantity AS INT) AS qty, l_discount AS delta, l_tax / 10 AS gamma, l_quantity / 100 AS vega FROM lineitem)"
_GREEKS = "count(DISTINCT position) AS positions, round(sum(delta * qty * 100), 4) AS delta, round(sum(gamma * qty * 100), 4) AS gamma, round(sum(vega * qty * 100), 4) AS vega"


@query(f"""WITH b AS ({_BOOK}), asks AS (SELECT portfolio, CASE WHEN portfolio % 3 = 0 THEN -1 ELSE min(position) END AS position FROM b GROUP BY 1),
new AS (SELECT b.portfolio + 1 AS portfolio, -b.position AS position, qty, delta, gamma, vega FROM b JOIN asks USING (portfolio, position) WHERE b.portfolio + 1 IN (SELECT portfolio FROM b))
SELECT 'with_trade' AS scenario, portfolio, {_GREEKS} FROM (SELECT * FROM b UNION ALL SELECT * FROM new) GROUP BY portfolio
UNION ALL SELECT 'without_position', portfolio, {_GREEKS} FROM b ANTI JOIN asks USING (portfolio, position) GROUP BY portfolio""")
def hypothetical_portfolio(t):
    """Each portfolio with its neighbour's first position traded, and without its own first position (an unknown one changes nothing)."""
    qty = F.when(c("l_linenumber") % 2 == 0, -1).otherwise(1) * c("l_quantity").cast("int")
    book = t("lineitem").select(c("l_suppkey").alias("portfolio"), c("l_orderkey").alias("position"), qty.alias("qty"), c("l_discount").alias("delta"), (c("l_tax") / 10).alias("gamma"), (c("l_quantity") / 100).alias("vega"))
    asks = book.groupBy("portfolio").agg(F.when(c("portfolio") % 3 == 0, -1).otherwise(F.min("position")).alias("position"))
    trade = book.join(asks, ["portfolio", "position"], "left_semi").withColumns({"portfolio": c("portfolio") + 1, "position": -c("position")})
    trade = trade.join(book.select("portfolio").distinct(), "portfolio", "left_semi")
    out = None
    for name, rows in (("with_trade", risk.with_trades(book, trade)), ("without_position", risk.without_positions(book, asks, ["portfolio"]))):
        greeks = rows.groupBy("portfolio").agg(F.count_distinct("position").alias("positions"), *[F.round(F.sum(c(g) * c("qty") * 100), 4).alias(g) for g in ("delta", "gamma", "vega")])
        greeks = greeks.select(F.lit(name).alias("scenario"), "portfolio", "positions", "delta", "gamma", "vega")
        out = greeks if out is None else out.union(greeks)
    return out


# samples: a node is a user's last digit, features a value and its square root, times are quarter hours

_PANEL = "SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS t, user_id % 7 AS node, max(CASE WHEN event_id % 11 <> 0 THEN value END) AS f, max(value * 2) AS g, max(CASE WHEN event_type = 'click' THEN value END) AS y, bool_or(event_type = 'purchase') AS masked FROM events GROUP BY 1, 2"


@query(f"""WITH p AS ({_PANEL}), times AS (SELECT t, row_number() OVER (ORDER BY t) AS r FROM (SELECT DISTINCT t FROM p)), ends AS (SELECT t AS end_ts, r FROM times WHERE r > 5 AND t >= TIMESTAMP '2024-01-02 12:00:00'),
cells AS (SELECT end_ts, e.r, p.*, (s.r - e.r + 5) * 7 + node AS pos, s.r = e.r AS last FROM ends e JOIN times s ON s.r BETWEEN e.r - 5 AND e.r JOIN p ON p.t = s.t WHERE node < 5)
SELECT end_ts, (SELECT t FROM times s WHERE s.r = max(c.r) - 5) AS start_ts, round(coalesce(sum(f * (1 + (pos % 13))), 0) + coalesce(sum((g - 50) / 10 * (2 + (pos % 13))), 0), 3) AS x_sum, round(coalesce(sum(y * (1 + node)) FILTER (WHERE last AND NOT masked), 0), 3) AS y_sum,
count(y) FILTER (WHERE last AND NOT masked) AS nodes FROM cells c GROUP BY end_ts""")
def sample_tensors(t):
    """Samples of six times by seven places by two features, as sums over their cells (g is normalised; places 5 and 6 are no nodes of the grid)."""
    rows = t("events").groupBy(F.window(F.col("ts").cast("timestamp"), "15 minutes").start.cast("timestamp_ntz").alias("t"), (c("user_id") % 7).alias("node"))
    rows = rows.agg(F.max(F.when(c("event_id") % 11 != 0, c("value"))).alias("f"), F.max(c("value") * 2).alias("g"), F.max(F.when(c("event_type") == "click", c("value"))).alias("y"), F.bool_or(c("event_type") == "purchase").alias("masked"))
    out = samples.dense_samples(rows, "t", F.when(c("node") < 5, c("node")), 7, ["f", "g"], ["y"], lookback=5, cell=F.date_trunc("day", "_ts"), min_end="2024-01-02T12:00:00", masked="masked", stats={"g": (50.0, 10.0)})
    at = lambda i: F.floor(i / 2) % 13
    x_sum = F.aggregate(F.transform("x", lambda v, i: F.when(i % 2 == 0, v * (1 + at(i))).otherwise(F.when(v != 0, v * (2 + at(i))).otherwise(0)).cast("double")), F.lit(0.0), lambda a, b: a + b)
    y_sum = F.aggregate(F.transform("y", lambda v, i: (v * (1 + i)).cast("double")), F.lit(0.0), lambda a, b: a + b)
    return out.select("end_ts", "start_ts", F.round(x_sum, 3).alias("x_sum"), F.round(y_sum, 3).alias("y_sum"), F.size(F.filter("mask", lambda m: m)).cast("long").alias("nodes"))


# covariance by one Gramian, correlated signals

@query(f"SELECT a.series AS a, b.series AS b, round(covar_samp(a.value, b.value) / 1e6, 4) AS cov, round(corr(a.value, b.value), 6) AS corr, count(*) AS n FROM ({_DAILY}) a JOIN ({_DAILY}) b ON a.ts = b.ts AND a.series <= b.series GROUP BY 1, 2")
def cov_gramian(t):
    rows = linalg.gramian_pairs(daily(t), "ts", "series", "value")
    return rows.select("a", "b", F.round(c("cov") / 1e6, 4).alias("cov"), F.round("corr", 6).alias("corr"), "n")


@query(f"""WITH w AS (SELECT ts, series, value, count(*) OVER (PARTITION BY ts) AS k FROM ({_DAILY})), t AS (SELECT DISTINCT ts FROM w WHERE k = (SELECT count(DISTINCT series) FROM w) ORDER BY ts DESC LIMIT 252),
x AS (SELECT ts, series, value / 1000 - avg(value / 1000) OVER (PARTITION BY series) AS v FROM w JOIN t USING (ts)),
p AS (SELECT a.series AS a, b.series AS b, avg(a.v * b.v) AS s, avg(a.v * a.v * b.v * b.v) AS q, count(*) AS n FROM x a JOIN x b USING (ts) GROUP BY 1, 2),
m AS (SELECT avg(s) FILTER (WHERE a = b) AS mu FROM p), d AS (SELECT sum((s - CASE WHEN a = b THEN mu ELSE 0 END) ** 2) AS d2, sum(q - s * s) / max(n) AS b2 FROM p, m), r AS (SELECT CASE WHEN d2 > 0 THEN least(b2, d2) / d2 ELSE 0 END AS h FROM d)
SELECT a, b, round((1 - h) * s + CASE WHEN a = b THEN h * mu ELSE 0 END, 4) AS cov, round(h, 6) AS shrinkage FROM p, m, r WHERE a <= b""")
def shrunk_gramian(t):
    """Ledoit-Wolf over the last 252 days on which every series has a value, from two Gramians."""
    rows = linalg.shrunk_pairs(daily(t).withColumn("value", c("value") / 1000), "ts", "series", "value", last=252)
    return rows.select("a", "b", F.round("cov", 4).alias("cov"), F.round("shrinkage", 6).alias("shrinkage"))


_NODES = "SELECT CAST(ts AS DATE) AS d, user_id % 12 AS node, avg(value + CASE WHEN user_id % 12 >= 6 THEN 400 * (hash_ % 7) / 7 ELSE 0 END) AS value FROM (SELECT *, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS hash_ FROM events) WHERE user_id % 12 < 10 GROUP BY 1, 2"


@query(f"""WITH RECURSIVE n AS ({_NODES}), pairs AS (SELECT a.node AS a, b.node AS b, corr(a.value, b.value) AS corr FROM n a JOIN n b USING (d) WHERE a.node <> b.node GROUP BY 1, 2),
s AS (SELECT o_orderkey AS id, o_custkey % 12 AS node, abs((o_orderkey % 41 - 20) / 100.0) * (o_custkey % 9 / 8.0) AS score FROM orders),
best AS (SELECT node, -min(-score) AS score, arg_min(id, (-score, id)) AS id FROM s WHERE node < 10 GROUP BY node), ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, CAST(id AS VARCHAR)) AS r FROM best),
bad AS (SELECT x.r, list(y.node) AS near FROM ranked x JOIN pairs p ON p.a = x.node JOIN ranked y ON y.node = p.b WHERE abs(corr) >= 0.85 GROUP BY x.r),
greedy AS (SELECT 0::BIGINT AS r, []::BIGINT[] AS kept UNION ALL SELECT x.r, CASE WHEN list_has_any(coalesce(near, []), kept) THEN kept ELSE list_append(kept, node) END FROM greedy g JOIN ranked x ON x.r = g.r + 1 LEFT JOIN bad ON bad.r = x.r)
SELECT id, node FROM s WHERE node >= 10 UNION ALL SELECT id, node FROM ranked WHERE list_contains((SELECT kept FROM greedy ORDER BY r DESC LIMIT 1), node)""")
def correlated_signals(t):
    """Signals scored by edge and confidence, kept where no better one's node correlates by 0.85; two of twelve nodes have no history."""
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    n = t("events").withColumn("node", c("user_id") % 12).where("node < 10").groupBy(F.to_date("ts").alias("d"), "node").agg(F.avg(c("value") + F.when(c("node") >= 6, 400 * (day % 7) / 7).otherwise(0)).alias("value"))
    s = t("orders").select(c("o_orderkey").alias("id"), (c("o_custkey") % 12).alias("node"), (F.abs((c("o_orderkey") % 41 - 20) / 100.0) * (c("o_custkey") % 9 / 8.0)).alias("score"))
    return linalg.uncorrelated_signals(s, linalg.gramian_pairs(n, "d", "node", "value"), node="node", score="score", id_="id").select("id", "node")


# manifests: a customer segment's chain, read back from nested JSON; a third of them are plain lists

_PICK = "SELECT o_custkey % 40 AS underlying, CAST(o_orderkey AS VARCHAR) AS symbol, CAST(o_orderdate AS DATE) AS expiry FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-01'"


@query(f"SELECT underlying, symbol, CASE WHEN underlying % 3 <> 0 THEN expiry END AS expiry FROM ({_PICK})")
def manifest_symbols(t):
    picked = t("orders").where(c("o_orderdate") >= F.lit("1997-06-01").cast("timestamp_ntz")).select((c("o_custkey") % 40).alias("underlying"), c("o_orderkey").alias("symbol"), F.to_date("o_orderdate").alias("expiry"))
    built = manifest.build(picked, ["underlying"], {"min_dte": 5, "max_dte": 120})
    plain = F.to_json(F.from_json(F.get_json_object("manifest", "$.symbols"), "array<string>"))
    return manifest.symbols_of(built.withColumn("manifest", F.when(c("underlying") % 3 == 0, plain).otherwise(c("manifest"))))


# returns over 1, 5, 10 and 21 rows

_DAYS = (1, 5, 10, 21)


@query("SELECT event_id, " + ", ".join(f"round((p - lag(p, {n}) OVER w) / nullif(lag(p, {n}) OVER w, 0), 6) AS ret_{n}, round(ln(p / lag(p, {n}) OVER w), 6) AS log_{n}" for n in _DAYS) + " FROM (SELECT *, value + 100 AS p FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def returns_multi(t):
    """Returns and log returns over 1, 5, 10 and 21 rows, in blocks."""

    def build(rows, by):
        w = frames.node(by, NODE[1])
        return rows.withColumns({f"{k}_{n}": f(c("p"), w, n) for n in _DAYS for k, f in (("ret", frames.growth), ("log", frames.log_return))})

    rows = scan.windowed(t("events").withColumn("p", c("value") + 100), *NODE, cell=F.date_trunc("hour", "ts"), halo=21, build=build)
    return rows.select("event_id", *r6(**{f"{k}_{n}": c(f"{k}_{n}") for n in _DAYS for k in ("ret", "log")}))


# checks of macro series and of whole columns, in one aggregate

_MACRO = "SELECT left(o_orderpriority, 1) AS series, CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 10 = 1 THEN CAST('NaN' AS DOUBLE) ELSE o_totalprice / 1000 END AS value, CAST(NULL AS DOUBLE) AS revised FROM orders"


@query(f"""WITH m AS ({_MACRO}) SELECT 'nan_value' AS "check", 'WARNING' AS severity, count(*) AS rows FROM m WHERE isnan(value) UNION ALL SELECT 'empty_revised', 'ERROR', count(*) FROM m
UNION ALL SELECT 'range_' || series, 'ERROR', count(*) FROM m WHERE (series = '1' AND NOT value BETWEEN 5 AND 300) OR (series = '2' AND NOT value BETWEEN 0 AND 200) GROUP BY series UNION ALL SELECT 'unknown_series', 'WARNING', count(*) FROM m WHERE series NOT IN ('1', '2', '9')""")
def macro_checks(t):
    value = F.when(c("o_orderkey") % 10 == 0, None).when(c("o_orderkey") % 10 == 1, float("nan")).otherwise(c("o_totalprice") / 1000)
    rows = t("orders").select(F.left("o_orderpriority", F.lit(1)).alias("series"), value.alias("value"), F.lit(None).cast("double").alias("revised"))
    return tables.one_pass_issues(rows, [*tables.column_checks(["value", "revised"]), *tables.series_checks("series", "value", {"1": (5, 300), "2": (0, 200), "9": (0, 1)})])


# largest loss by structure, prices in three tiers, skew on bucket centres

_TRADES = """SELECT l_orderkey, ['calendar', 'vertical', 'condor', 'skew', 'other'][CAST(l_orderkey % 5 AS INT) + 1] AS structure, CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END * CAST(l_quantity AS INT) AS qty, l_extendedprice / 1000 AS price,
CAST(l_partkey % 50 AS DOUBLE) AS strike, CASE WHEN l_suppkey % 2 = 0 THEN 'P' ELSE 'C' END AS "right", CAST(l_shipdate AS DATE) AS expiry FROM lineitem"""


@query(f"""SELECT l_orderkey, structure, round(net, 4) AS net_premium, round(CASE WHEN structure IN ('condor', 'skew') THEN greatest(puts, calls) - net WHEN structure = 'other' THEN NULL WHEN net < 0 THEN -net WHEN structure = 'calendar' THEN far ELSE coalesce(strikes[2] - strikes[1], 0) * 100 - net END, 4) AS max_loss FROM (
SELECT l_orderkey, structure, -sum(qty * price * 100) AS net, list(strike ORDER BY strike) AS strikes, abs(arg_min(price, (-date_diff('day', DATE '1970-01-01', expiry), strike, price)) * 100) AS far,
CASE WHEN count(*) FILTER (WHERE "right" = 'P') >= 2 THEN (max(strike) FILTER (WHERE "right" = 'P') - min(strike) FILTER (WHERE "right" = 'P')) * 100 ELSE 0 END AS puts,
CASE WHEN count(*) FILTER (WHERE "right" = 'C') >= 2 THEN (max(strike) FILTER (WHERE "right" = 'C') - min(strike) FILTER (WHERE "right" = 'C')) * 100 ELSE 0 END AS calls FROM ({_TRADES}) GROUP BY 1, 2)""")
def loss_by_structure(t):
    kinds = F.array(*[F.lit(k) for k in ("calendar", "vertical", "condor", "skew", "other")])
    rows = t("lineitem").select("l_orderkey", F.element_at(kinds, (c("l_orderkey") % 5 + 1).cast("int")).alias("structure"), (F.when(c("l_linenumber") % 2 == 0, -1).otherwise(1) * c("l_quantity").cast("int")).alias("qty"), (c("l_extendedprice") / 1000).alias("price"), (c("l_partkey") % 50).cast("double").alias("strike"), F.when(c("l_suppkey") % 2 == 0, "P").otherwise("C").alias("right"), F.to_date("l_shipdate").alias("expiry"))
    return structures.largest_loss(rows, ["l_orderkey"]).select("l_orderkey", "structure", F.round("net_premium", 4).alias("net_premium"), F.round("max_loss", 4).alias("max_loss"))


_LEG = "SELECT l_orderkey, l_linenumber, l_partkey AS symbol, l_suppkey % 30 AS day, CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END AS qty, l_extendedprice AS entry_price, l_discount AS delta FROM lineitem"
_SURF = "SELECT p_partkey AS symbol, p_partkey % 30 AS day, p_retailprice * 0.99 AS bid, CASE WHEN p_size % 5 <> 0 THEN p_retailprice * 1.01 END AS ask, CASE WHEN p_size % 4 = 0 THEN CAST('NaN' AS DOUBLE) WHEN p_size % 4 = 1 THEN NULL ELSE p_size / 100.0 END AS delta FROM part"
_TICK = "SELECT l_partkey AS symbol, (l_suppkey + 1) % 30 AS day, l_orderkey * 10 + l_linenumber AS ts, CASE WHEN l_linenumber <> 3 THEN l_quantity END AS bid, CASE WHEN l_linenumber < 5 THEN l_quantity * 2 END AS ask FROM lineitem"


@query(f"""WITH q AS (SELECT symbol, day, arg_max(bid, (ts, bid)) FILTER (WHERE bid IS NOT NULL) AS bid, arg_max(ask, (ts, ask)) FILTER (WHERE ask IS NOT NULL) AS ask FROM ({_TICK}) GROUP BY 1, 2 HAVING bid IS NOT NULL AND ask IS NOT NULL)
SELECT l_orderkey, l_linenumber, round(CASE WHEN s.symbol IS NOT NULL THEN CASE WHEN qty > 0 THEN s.bid ELSE s.ask END WHEN q.symbol IS NOT NULL THEN CASE WHEN qty > 0 THEN q.bid ELSE q.ask END ELSE entry_price END, 4) AS price,
CASE WHEN s.symbol IS NOT NULL THEN 'surface' WHEN q.symbol IS NOT NULL THEN 'market' ELSE 'entry' END AS source, round(CASE WHEN s.delta IS NOT NULL AND NOT isnan(s.delta) THEN s.delta ELSE l.delta END, 6) AS delta
FROM ({_LEG}) l LEFT JOIN ({_SURF}) s ON s.symbol = l.symbol AND s.day = l.day LEFT JOIN q ON q.symbol = l.symbol AND q.day = l.day""".replace("HAVING bid IS NOT NULL AND ask IS NOT NULL", "HAVING count(bid) > 0 AND count(ask) > 0"))
def pricing_tiers(t):
    legs_ = t("lineitem").select("l_orderkey", "l_linenumber", c("l_partkey").alias("symbol"), (c("l_suppkey") % 30).alias("day"), F.when(c("l_linenumber") % 2 == 0, -1).otherwise(1).alias("qty"), c("l_extendedprice").alias("entry_price"), c("l_discount").alias("delta"))
    delta = F.when(c("p_size") % 4 == 0, float("nan")).when(c("p_size") % 4 != 1, c("p_size") / 100.0)
    surface = t("part").select(c("p_partkey").alias("symbol"), (c("p_partkey") % 30).alias("day"), (c("p_retailprice") * 0.99).alias("bid"), F.when(c("p_size") % 5 != 0, c("p_retailprice") * 1.01).alias("ask"), delta.alias("delta"))
    ticks = t("lineitem").select(c("l_partkey").alias("symbol"), ((c("l_suppkey") + 1) % 30).alias("day"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("ts"), F.when(c("l_linenumber") != 3, c("l_quantity")).alias("bid"), F.when(c("l_linenumber") < 5, c("l_quantity") * 2).alias("ask"))
    return risk.priced_legs(legs_, surface, ticks).select("l_orderkey", "l_linenumber", F.round("price", 4).alias("price"), "source", F.round("delta", 6).alias("delta"))


_CENTRES = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in S.BUCKET_DELTA.items()) + "}"
_NAMES = list(S.BUCKET_DELTA)


@query(f"""SELECT snap, tenor, round(CASE WHEN count(*) >= 3 THEN regr_slope(iv, x) END, 6) AS slope, round(CASE WHEN count(*) >= 3 THEN regr_intercept(iv, x) END, 6) AS level FROM (
SELECT snap, tenor, iv, CASE WHEN count(delta) OVER (PARTITION BY snap, tenor) > 0 THEN delta ELSE {_CENTRES}[bucket] END AS x FROM (SELECT p_partkey % 20 AS snap, p_size % 6 AS tenor, {_NAMES}[CAST(p_partkey % 7 AS INT) + 1] AS bucket,
CASE WHEN p_partkey % 11 <> 0 THEN p_retailprice / 3987 END AS iv, CASE WHEN p_size % 6 < 3 AND p_partkey % 5 <> 0 THEN (p_partkey % 100) / 100.0 - 0.5 END AS delta FROM part)) WHERE iv IS NOT NULL AND x IS NOT NULL GROUP BY 1, 2""")
def skew_slope_buckets(t):
    """The skew of a slice on its deltas, or on its buckets' centres where the slice has no delta at all."""
    bucket = F.element_at(F.array(*[F.lit(x) for x in _NAMES]), (c("p_partkey") % 7 + 1).cast("int"))
    rows = t("part").select((c("p_partkey") % 20).alias("snap"), (c("p_size") % 6).alias("tenor"), bucket.alias("bucket"), F.when(c("p_partkey") % 11 != 0, c("p_retailprice") / 3987).alias("iv"), F.when((c("p_size") % 6 < 3) & (c("p_partkey") % 5 != 0), (c("p_partkey") % 100) / 100.0 - 0.5).alias("delta"))
    rows = frames.delta_or_centre(rows, ["snap", "tenor"]).where("iv IS NOT NULL AND x IS NOT NULL")
    fit = rows.groupBy("snap", "tenor").agg(frames.slope(c("iv"), c("x"), 3).alias("slope"), F.when(F.count("*") >= 3, F.regr_intercept("iv", "x")).alias("level"))
    return fit.select("snap", "tenor", F.round("slope", 6).alias("slope"), F.round("level", 6).alias("level"))


# a backtest's report from a plain ledger: an order status is a run, its days are snapshots, its orders entries (odd keys) and exits (even keys)

_PNL = "(o_totalprice - 150000) / 100"
_SNAPS = f"SELECT *, 1e6 + sum(daily_pnl) OVER (PARTITION BY run ORDER BY date) AS equity FROM (SELECT o_orderstatus AS run, CAST(o_orderdate AS DATE) AS date, sum({_PNL}) AS daily_pnl, count(*) AS open_positions FROM orders GROUP BY 1, 2)"
_DEALS = f"SELECT o_orderstatus AS run, o_orderkey % 2 = 0 AS out_, {_PNL} AS pnl, (o_orderkey % 7) * 0.65 AS fees, (o_orderkey % 3) * 0.5 AS slippage FROM orders"
_REPORT = f"""WITH s AS ({_SNAPS}), d AS (SELECT *, (equity - top) / CASE WHEN top = 0 THEN 1e-10 ELSE top END * 100 AS dd FROM (SELECT *, max(equity) OVER (PARTITION BY run ORDER BY date) AS top FROM s)),
v AS (SELECT run, quantile_cont(daily_pnl, 0.05) AS var_95 FROM s GROUP BY run), spells AS (SELECT run, max(n) AS longest FROM (SELECT run, island, count(*) FILTER (WHERE dd < 0) AS n FROM (SELECT *, sum(CASE WHEN dd < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY run ORDER BY date) AS island FROM d) GROUP BY 1, 2) GROUP BY run),
b AS (SELECT run, min(date) AS start_date, max(date) AS end_date, count(*) AS n_days, arg_max(equity, date) AS final, abs(min(dd)) AS max_drawdown_pct, coalesce(abs(avg(dd) FILTER (WHERE dd < 0)), 0) AS avg_drawdown_pct, max(open_positions) AS max_concurrent_positions, avg(open_positions) AS avg_concurrent_positions,
  avg(daily_pnl) AS avg_daily_pnl, coalesce(stddev_samp(daily_pnl), 0) AS daily_pnl_std, stddev_samp(daily_pnl) FILTER (WHERE daily_pnl < 0) AS down, max(daily_pnl) AS max_daily_gain, min(daily_pnl) AS max_daily_loss, any_value(var_95) AS var_95, avg(daily_pnl) FILTER (WHERE daily_pnl <= var_95) AS cvar_95 FROM d JOIN v USING (run) GROUP BY run),
t AS (SELECT run, count(*) FILTER (WHERE out_) AS total_trades, count(*) FILTER (WHERE out_ AND pnl > 0) AS winning_trades, count(*) FILTER (WHERE out_ AND pnl < 0) AS losing_trades, coalesce(avg(pnl) FILTER (WHERE out_ AND pnl > 0), 0) AS avg_win, coalesce(abs(avg(pnl) FILTER (WHERE out_ AND pnl < 0)), 0) AS avg_loss,
  coalesce(sum(pnl) FILTER (WHERE out_ AND pnl > 0), 0) AS gain, coalesce(abs(sum(pnl) FILTER (WHERE out_ AND pnl < 0)), 0) AS lost, avg(pnl) FILTER (WHERE out_) AS avg_trade_pnl, max(pnl) FILTER (WHERE out_) AS max_win, min(pnl) FILTER (WHERE out_) AS max_loss, sum(fees) AS total_fees, sum(slippage) AS total_slippage FROM ({_DEALS}) GROUP BY run),
r AS (SELECT *, (final / 1e6 - 1) * 100 AS total_return_pct FROM b JOIN t USING (run) JOIN spells USING (run)), a AS (SELECT *, CASE WHEN n_days * 12 >= 252 THEN (pow(final / 1e6, 252.0 / n_days) - 1) * 100 ELSE total_return_pct END AS annualized_return_pct, total_fees + total_slippage AS cost FROM r),
m AS (SELECT *, CASE WHEN daily_pnl_std > 0 THEN avg_daily_pnl / daily_pnl_std ELSE 0 END * sqrt(252) AS sharpe_ratio, CASE WHEN down > 0 THEN avg_daily_pnl / down ELSE 0 END * sqrt(252) AS sortino_ratio, CASE WHEN max_drawdown_pct > 0 THEN annualized_return_pct / max_drawdown_pct ELSE 0 END AS calmar_ratio, longest AS max_drawdown_duration_days,
  CASE WHEN total_trades > 0 THEN winning_trades / total_trades * 100 ELSE 0 END AS win_rate, CASE WHEN total_trades = 0 THEN 0 WHEN lost > 0 THEN gain / lost ELSE 'inf'::DOUBLE END AS profit_factor, CASE WHEN total_trades > 0 THEN n_days / total_trades ELSE 0 END AS avg_holding_period_days, CASE WHEN final - 1e6 + cost <> 0 THEN cost / abs(final - 1e6 + cost) * 100 ELSE 0 END AS total_commission_pct FROM a)"""


def plain_ledger(t):
    pnl = (c("o_totalprice") - 150000) / 100
    orders = t("orders").withColumnRenamed("o_orderstatus", "run").withColumn("date", F.to_date("o_orderdate"))
    days = orders.groupBy("run", "date").agg(F.sum(pnl).alias("daily_pnl"), F.count("*").alias("open_positions"))
    days = scan.prefix_scan(days, ["run"], ["date"], F.date_trunc("year", "date"), {"_sum": ("sum", c("daily_pnl"))})
    days = days.select("run", "date", F.lit("SNAPSHOT").alias("kind"), "daily_pnl", "open_positions", (c("_sum") + 1e6).alias("equity"))
    out = c("o_orderkey") % 2 == 0
    deals = orders.select("run", "date", F.when(out, "EXIT").otherwise("ENTRY").alias("kind"), F.when(out, pnl).alias("pnl"), ((c("o_orderkey") % 7) * 0.65).alias("fees"), ((c("o_orderkey") % 3) * 0.5).alias("slippage"))
    return days.unionByName(deals, allowMissingColumns=True)


_ROUNDED = ", ".join(f"round({k}, 5) AS {k}" for k in risk.METRICS)


@query(f"{_REPORT} SELECT run, start_date, end_date, {_ROUNDED} FROM m")
def ledger_report(t):
    """The thirty metrics of each run of a plain ledger."""
    rows = risk.trade_metrics(plain_ledger(t), 1e6)
    return rows.select("run", "start_date", "end_date", *[F.round(k, 5).alias(k) for k in risk.METRICS])


_TWELVE = ("total_return_pct", "sharpe_ratio", "sortino_ratio", "max_drawdown_pct", "total_trades", "win_rate", "profit_factor", "avg_trade_pnl", "total_fees")


@query(f"{_REPORT} SELECT run AS run_id, start_date, end_date, {', '.join(f'round({k}, 5) AS {k}' for k in _TWELVE)} FROM m")
def ledger_comparison(t):
    rows = risk.compare_runs(risk.trade_metrics(plain_ledger(t), 1e6))
    return rows.select("run_id", "start_date", "end_date", *[F.round(k, 5).alias(k) for k in _TWELVE])


# row rules, reports, states

@query("SELECT l_suppkey, l_partkey, CASE WHEN l_linenumber <> 2 THEN l_shipdate END AS ts, l_orderkey FROM lineitem WHERE l_linenumber <> 2 QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) = 1")
def first_known_rows(t):
    rows = t("lineitem").withColumn("ts", F.when(c("l_linenumber") != 2, c("l_shipdate")))
    return tables.first_known(rows, ["l_suppkey", "l_partkey"], ["ts", "l_orderkey", "l_linenumber"], "ts").select("l_suppkey", "l_partkey", "ts", "l_orderkey")


@query("SELECT column_name, count(*) AS nulls, array_to_string(list(event_id ORDER BY event_id)[1:5], ',') AS samples FROM (SELECT event_id, 'price' AS column_name FROM events WHERE event_type <> 'purchase' UNION ALL SELECT event_id, 'low' FROM events WHERE value < 1) GROUP BY 1")
def null_sample_rows(t):
    rows = t("events").select("event_id", F.when(c("event_type") == "purchase", c("value")).alias("price"), F.when(c("value") >= 1, c("value")).alias("low"), "user_id")
    return tables.null_samples(rows, ["price", "low", "user_id"], "event_id").select("column_name", "nulls", F.array_join(F.transform("samples", lambda x: x.cast("string")), ",").alias("samples"))


@query("""WITH s AS (SELECT ts, CASE WHEN ts < TIMESTAMP '2024-01-10' THEN 'train' WHEN ts < TIMESTAMP '2024-01-15' THEN 'val' WHEN ts < TIMESTAMP '2024-01-20' THEN 'test' END AS split FROM events WHERE ts >= TIMESTAMP '2024-01-03'), e AS (SELECT split, min(ts) AS a, max(ts) AS b FROM s GROUP BY 1)
SELECT x.split AS earlier, y.split AS later, x.b AS ends, y.a AS starts, x.b < y.a AS in_order FROM e x JOIN e y ON (x.split, y.split) IN (('train', 'val'), ('val', 'test'))""")
def split_order(t):
    cuts = [F.lit(x).cast("timestamp_ntz") for x in ("2024-01-03", "2024-01-10", "2024-01-15", "2024-01-20")]
    return labels.split_order(labels.splits(t("events"), "ts", *cuts), "ts")


@query("SELECT bool_and(CAST(v AS DATE) < CAST(c AS DATE)) AS safe, count(v) AS matched FROM (SELECT a.ts AS c, (SELECT max(b.ts) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'view' AND b.ts <= a.ts) AS v FROM events a WHERE a.event_type = 'click')")
def leakage_verdict(t):
    """One verdict for all matched views: each made before its click's day."""
    rows = asof.asof_join(kind(t, "click").select("event_id", "user_id", "ts"), kind(t, "view").select("user_id", "ts", "value"), by=("user_id",))
    return rows.agg(F.bool_and(F.to_date("r_ts") < F.to_date("ts")).alias("safe"), F.count("r_ts").alias("matched"))


@query("SELECT structure, day, round(pnl, 2) AS pnl, trades, round(sum(pnl) OVER (PARTITION BY structure ORDER BY day), 2) AS cumulative FROM (SELECT o_orderpriority AS structure, CAST(o_orderdate AS DATE) AS day, sum(o_totalprice - 150000) AS pnl, count(*) AS trades FROM orders GROUP BY 1, 2)")
def pnl_cumulative(t):
    rows = t("orders").select(c("o_orderpriority").alias("structure"), F.to_date("o_orderdate").alias("day"), (c("o_totalprice") - 150000).alias("pnl"))
    out = risk.cumulative_pnl(rows, ["structure"], "day", "pnl", F.date_trunc("year", "day"))
    return out.select("structure", "day", F.round("pnl", 2).alias("pnl"), "trades", F.round("cumulative", 2).alias("cumulative"))


@query("""SELECT p.position, CASE WHEN filled THEN 'CLOSED' WHEN expiry < DATE '1996-01-01' THEN 'EXPIRED' WHEN filled IS NOT NULL THEN 'CLOSING' ELSE 'OPEN' END AS state FROM (SELECT l_orderkey AS position, CAST(max(l_shipdate) AS DATE) AS expiry FROM lineitem GROUP BY 1) p
LEFT JOIN (SELECT l_orderkey AS position, bool_or(l_linenumber = 5) AS filled FROM lineitem WHERE l_linenumber >= 4 GROUP BY 1) x USING (position)""")
def position_states(t):
    rows = t("lineitem").groupBy(c("l_orderkey").alias("position")).agg(F.to_date(F.max("l_shipdate")).alias("expiry"))
    exits = t("lineitem").where("l_linenumber >= 4").select(c("l_orderkey").alias("position"), (c("l_linenumber") == 5).alias("filled"))
    return risk.position_states(rows, exits, F.lit("1996-01-01").cast("date")).select("position", "state")
