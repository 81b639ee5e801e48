"""Every operator on the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import pricing, scalars as S
from ..operators import asof, frames, scan, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
c = F.col


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(**columns: object) -> list:
    return [F.round(v, 6).alias(k) for k, v in columns.items()]


def place() -> Column:
    """A row's place in its table's files: what the SQL, run in one thread, takes for the order of rows that its ORDER BY leaves open, and of sums."""
    return F.struct("_metadata.file_path", "_metadata.row_index").alias("place")


# scalars and quality

_QUOTES = "SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag, l_shipdate, l_extendedprice * (1 - l_discount) AS bid, l_extendedprice * (1 + l_tax - l_discount * 1.5) AS ask, CAST(l_quantity AS INT) AS volume, CAST(l_partkey % 300 AS INT) AS oi FROM lineitem"


def quotes(t: Callable) -> DataFrame:
    price = c("l_extendedprice")
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_shipdate", (price * (1 - c("l_discount"))).alias("bid"), (price * (1 + c("l_tax") - c("l_discount") * 1.5)).alias("ask"), c("l_quantity").cast("int").alias("volume"), (c("l_partkey") % 300).cast("int").alias("oi"))


@query(f"SELECT l_orderkey, l_linenumber, round((bid + ask) / 2, 6) AS mid, round((ask - bid) / greatest((bid + ask) / 2, 1e-10), 6) AS spread_pct FROM ({_QUOTES})")
def spread_pct(t):
    return quotes(t).select("l_orderkey", "l_linenumber", *r6(mid=S.mid(c("bid"), c("ask")), spread_pct=S.spread_pct(c("bid"), c("ask"))))


@query("SELECT date_trunc('minute', ts) AS minute, count(*) AS n FROM events GROUP BY 1")
def minute_floor(t):
    return t("events").groupBy(F.date_trunc("minute", "ts").alias("minute")).agg(F.count("*").alias("n"))


@query("SELECT event_id, round(greatest((epoch(CAST(ts AS DATE) + CAST(event_id % 90 AS INT)) + 75600 - epoch(ts)) / 86400 / 365, 1e-6), 9) AS tte FROM events")
def time_to_expiry(t):
    expiry = F.date_add(F.to_date("ts"), (c("event_id") % 90).cast("int"))
    return t("events").select("event_id", F.round(S.years_to_expiry(expiry, c("ts")), 9).alias("tte"))


@query("SELECT o_orderkey, CASE WHEN d < 0 THEN NULL WHEN d <= 10 THEN 7 WHEN d <= 22 THEN 14 WHEN d <= 45 THEN 30 WHEN d <= 75 THEN 60 WHEN d <= 105 THEN 90 ELSE 120 END AS tenor FROM (SELECT o_orderkey, o_orderkey % 150 - 5 AS d FROM orders)")
def nearest_bin(t):
    return t("orders").select("o_orderkey", S.nearest_bin((c("o_orderkey") % 150 - 5).cast("int")).alias("tenor"))


@query("SELECT p_partkey, CASE WHEN abs(d) BETWEEN 0.45 AND 0.55 THEN 'ATM' WHEN d BETWEEN -0.45 AND -0.35 THEN 'P40' WHEN d BETWEEN -0.35 AND -0.15 THEN 'P25' WHEN d BETWEEN -0.15 AND 0 THEN 'P10' WHEN d BETWEEN 0 AND 0.15 THEN 'C10' WHEN d BETWEEN 0.15 AND 0.35 THEN 'C25' WHEN d BETWEEN 0.35 AND 0.45 THEN 'C40' END AS bucket FROM (SELECT p_partkey, CAST(p_partkey % 120 - 60 AS DOUBLE) / 100 AS d FROM part)")
def bucket_first_match(t):
    return t("part").select("p_partkey", S.delta_bucket((c("p_partkey") % 120 - 60).cast("double") / 100).alias("bucket"))


_FLAGS = f"SELECT *, (CASE WHEN ask < bid THEN 1 ELSE 0 END) + (CASE WHEN CAST(l_shipdate AS DATE) < (SELECT max(CAST(l_shipdate AS DATE)) - 2000 FROM lineitem) THEN 2 ELSE 0 END) + (CASE WHEN (ask - bid) / greatest((bid + ask) / 2, 1e-10) > 0.05 THEN 4 ELSE 0 END) + (CASE WHEN coalesce(volume, 0) < 10 THEN 8 ELSE 0 END) + (CASE WHEN coalesce(oi, 0) < 100 THEN 16 ELSE 0 END) AS flags FROM ({_QUOTES})"


def flagged(t: Callable) -> DataFrame:
    last = t("lineitem").agg(F.date_sub(F.max(F.to_date("l_shipdate")), 2000).alias("ref"))
    rows = quotes(t).crossJoin(F.broadcast(last))  # one row
    return rows.withColumn("flags", S.quality_flags(c("bid"), c("ask"), c("volume"), c("oi"), F.to_date("l_shipdate"), c("ref"), wide=0.05))


@query(f"SELECT l_orderkey, l_linenumber, flags FROM ({_FLAGS})")
def quality_flags(t):
    return flagged(t).select("l_orderkey", "l_linenumber", "flags")


@query(f"SELECT flag, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN flags & 1 > 0 THEN 'crossed' END, CASE WHEN flags & 2 > 0 THEN 'stale' END, CASE WHEN flags & 4 > 0 THEN 'wide_spread' END, CASE WHEN flags & 8 > 0 THEN 'low_volume' END, CASE WHEN flags & 16 > 0 THEN 'low_oi' END], lambda x: x IS NOT NULL)) AS flag FROM ({_FLAGS})) GROUP BY flag")
def flag_decode(t):
    return flagged(t).select(F.explode(S.flag_names(c("flags"))).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


@query(f"SELECT l_orderkey, l_linenumber, flags > 0 AS is_masked, CASE WHEN flags & 8 > 0 THEN 'low_volume' WHEN flags & 1 > 0 THEN 'crossed' WHEN flags & 4 > 0 THEN 'wide_spread' WHEN flags & 2 > 0 THEN 'stale' WHEN flags & 16 > 0 THEN 'low_oi' END AS mask_reason FROM ({_FLAGS})")
def mask_first_reason(t):
    return flagged(t).select("l_orderkey", "l_linenumber", (c("flags") > 0).alias("is_masked"), S.first_reason(c("flags")).alias("mask_reason"))


@query("SELECT o_orderkey, 'SPY' || strftime(o_orderdate + INTERVAL 20 YEAR, '%y%m%d') || CASE WHEN o_orderkey % 2 = 0 THEN 'C' ELSE 'P' END || lpad(CAST(CAST(round((o_orderkey % 900) * 0.5 * 1000) AS BIGINT) AS VARCHAR), 8, '0') AS symbol, 'SPY' AS root, CAST(o_orderdate + INTERVAL 20 YEAR AS DATE) AS expiry, CASE WHEN o_orderkey % 2 = 0 THEN 'C' ELSE 'P' END AS \"right\", CAST((o_orderkey % 900) * 0.5 AS DOUBLE) AS strike FROM orders")
def symbol_round_trip(t):
    right = F.when(c("o_orderkey") % 2 == 0, "C").otherwise("P")
    rows = t("orders").select("o_orderkey", S.format_symbol(F.lit("SPY"), F.add_months("o_orderdate", 240), right, (c("o_orderkey") % 900) * 0.5).alias("symbol"))
    return rows.withColumn("x", S.parse_symbol(c("symbol"))).select("o_orderkey", "symbol", "x.*")


@query("SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN o_totalprice / 100 ELSE o_totalprice END AS value FROM orders")
def percent_to_decimal(t):
    return t("orders").select("o_orderkey", S.percent_to_decimal(c("o_orderpriority"), c("o_totalprice"), ("1", "2")).alias("value"))


@query("SELECT 'user_id' AS column_name, count(*) FILTER (WHERE user_id IS NULL) AS nulls, CAST(0 AS DOUBLE) AS ratio, 'WARNING' AS severity FROM events HAVING count(*) FILTER (WHERE user_id IS NULL) > 0 UNION ALL SELECT 'v', count(*) FILTER (WHERE event_type = 'error'), count(*) FILTER (WHERE event_type = 'error') / count(*), CASE WHEN count(*) FILTER (WHERE event_type = 'error') / count(*) <= 0.01 THEN 'WARNING' ELSE 'ERROR' END FROM events")
def null_report(t):
    return tables.null_report(t("events").withColumn("v", F.when(c("event_type") != "error", c("value"))), ["user_id", "v"], 0.01)


@query("SELECT count(*) AS groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(*) > 1)")
def duplicate_report(t):
    return tables.duplicate_report(t("lineitem"), ["l_partkey", "l_suppkey"])


@query("SELECT 'l_quantity' AS column_name, min(l_quantity) AS least, max(l_quantity) AS greatest, count(*) FILTER (WHERE l_quantity < 5 OR l_quantity > 40) AS outside FROM lineitem UNION ALL SELECT 'l_discount', min(l_discount), max(l_discount), count(*) FILTER (WHERE l_discount < 0 OR l_discount > 0.05) FROM lineitem")
def range_report(t):
    return tables.range_report(t("lineitem"), {"l_quantity": (5, 40), "l_discount": (0, 0.05)})


@query("SELECT l_suppkey, count(*) FILTER (WHERE l_shipdate < last) AS backward FROM (SELECT l_suppkey, l_shipdate, lag(l_shipdate) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_shipdate) AS last FROM lineitem) GROUP BY 1")
def monotonic_report(t):
    return tables.backward_steps(t("lineitem"), "l_shipdate", ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_shipdate"])


_BARS = "SELECT CAST(ts AS DATE) AS day, event_type, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, sum(user_id) AS volume FROM events GROUP BY 1, 2"


def bars(t: Callable) -> DataFrame:
    return tables.bars(t("events").withColumn("day", F.to_date("ts")), ["day", "event_type"], "value", "user_id", ["ts", "event_id"])


@query(f"SELECT day, event_type, open, high, low, close, CAST(volume AS BIGINT) AS volume FROM ({_BARS})")
def ohlcv_collapse(t):
    return bars(t)


@query(f"SELECT count(*) AS n, count(*) FILTER (WHERE low > open + 1) AS bad FROM ({_BARS})")
def bar_relations(t):
    return bars(t).agg(F.count("*").alias("n"), F.count_if(tables.bad_bars() | (c("low") > c("open") + 1)).alias("bad"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events")
def nan_to_null(t):
    odd = F.when(c("event_id") % 14 == 0, F.lit(float("nan"))).when(c("event_id") % 7 == 0, F.lit(float("inf"))).otherwise(c("value"))
    return S.clean(t("events").select("event_id", odd.alias("v")))


# joins and dedupe

@query("SELECT o.o_orderkey, v.volume FROM orders o LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS volume FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) v ON o.o_orderkey = v.l_orderkey")
def left_agg_join(t):
    v = t("lineitem").where("l_returnflag = 'R'").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("volume"))
    return t("orders").select("o_orderkey").join(v, "o_orderkey", "left")


@query("SELECT user_id, arg_max(value, ts) FILTER (WHERE event_type <> 'error') AS last_value FROM events GROUP BY 1")
def last_known(t):
    return t("events").groupBy("user_id").agg(F.max_by("value", "ts").alias("x"), F.max_by(F.when(c("event_type") != "error", c("value")), F.when(c("event_type") != "error", c("ts"))).alias("last_value")).drop("x")


_CLICK = "SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'click'"
_VIEW = "SELECT user_id, ts, value FROM events WHERE event_type = 'view'"


def kind(t: Callable, name: str) -> DataFrame:
    return t("events").where(c("event_type") == name)


@query(f"SELECT l.event_id, r.ts AS view_ts, r.value AS view_value FROM ({_CLICK}) l ASOF LEFT JOIN ({_VIEW}) r ON l.user_id = r.user_id AND l.ts >= r.ts")
def asof_backward(t):
    rows = asof.asof_join(kind(t, "click").select("event_id", "user_id", "ts"), kind(t, "view").select("user_id", "ts", "value"), by=("user_id",), prefix="view_")
    return rows.select("event_id", c("view_ts").cast("timestamp_ntz").alias("view_ts"), "view_value")


@query(f"SELECT l.event_id, coalesce(r.value, 0.05) AS rate FROM ({_CLICK}) l ASOF LEFT JOIN (SELECT ts, value FROM events WHERE event_type = 'purchase') r ON l.ts >= r.ts")
def asof_with_default(t):
    rows = asof.asof_join(kind(t, "click").select("event_id", "ts"), kind(t, "purchase").select("ts", "value"))
    return rows.select("event_id", F.coalesce("r_value", F.lit(S.DEFAULT_RATE)).alias("rate"))


@query(f"SELECT l.event_id, r.a, r.b FROM ({_CLICK}) l ASOF LEFT JOIN (SELECT ts, CASE WHEN event_type = 'view' THEN value END AS a, CASE WHEN event_type = 'error' THEN value END AS b FROM events WHERE event_type IN ('view', 'error')) r ON l.ts >= r.ts")
def asof_whole_row(t):
    right = t("events").where(c("event_type").isin("view", "error")).select("ts", F.when(c("event_type") == "view", c("value")).alias("a"), F.when(c("event_type") == "error", c("value")).alias("b"))
    return asof.asof_join(kind(t, "click").select("event_id", "ts"), right, prefix="").select("event_id", "a", "b")


@query(f"SELECT l.event_id, CAST(r.ts AS DATE) < CAST(l.ts AS DATE) AS safe FROM ({_CLICK}) l ASOF LEFT JOIN ({_VIEW}) r ON l.user_id = r.user_id AND l.ts >= r.ts")
def leakage_check(t):
    """Whether the matched view was made before the click's day; one of the same day leaks."""
    rows = asof.asof_join(kind(t, "click").select("event_id", "user_id", "ts"), kind(t, "view").select("user_id", "ts", "value"), by=("user_id",))
    return rows.select("event_id", (F.to_date("r_ts") < F.to_date("ts")).alias("safe"))


@query("SELECT user_id, coalesce(arg_max(value, ts) FILTER (WHERE ts <= TIMESTAMP '2024-01-03 00:00:00'), arg_min(value, ts)) AS price FROM events GROUP BY 1")
def asof_point_fallback(t):
    old = c("ts") <= F.lit("2024-01-03").cast("timestamp_ntz")
    return t("events").groupBy("user_id").agg(F.coalesce(F.max_by(F.when(old, c("value")), F.when(old, c("ts"))), F.min_by("value", "ts")).alias("price"))


@query("SELECT day, max(v) FILTER (WHERE event_type = 'view') AS view, max(v) FILTER (WHERE event_type = 'click') AS click, max(v) FILTER (WHERE event_type = 'error') AS error FROM (SELECT CAST(ts AS DATE) AS day, event_type, max(value) AS v FROM events WHERE event_type IN ('view', 'click', 'error') GROUP BY 1, 2) GROUP BY day")
def outer_merge(t):
    parts = [kind(t, k).groupBy(F.to_date("ts").alias("day")).agg(F.max("value").alias(k)) for k in ("view", "click", "error")]
    return asof.outer_merge(parts, ["day"])


_SLICE = "SELECT l_suppkey, l_returnflag, l_linestatus, l_linenumber, avg(l_extendedprice) AS iv, avg(l_discount) AS delta FROM lineitem GROUP BY 1, 2, 3, 4"


def slices(t: Callable) -> DataFrame:
    return t("lineitem").groupBy("l_suppkey", "l_returnflag", "l_linestatus", "l_linenumber").agg(F.avg("l_extendedprice").alias("iv"), F.avg("l_discount").alias("delta"))


@query(f"SELECT l_suppkey, l_returnflag, l_linestatus, l_linenumber, round(iv - max(CASE WHEN l_linenumber = 1 THEN iv END) OVER (PARTITION BY l_suppkey, l_returnflag, l_linestatus), 2) AS atm_spread FROM ({_SLICE})")
def atm_spread(t):
    w = Window.partitionBy("l_suppkey", "l_returnflag", "l_linestatus")
    return slices(t).select(*w_keys, F.round(c("iv") - F.max(F.when(c("l_linenumber") == 1, c("iv"))).over(w), 2).alias("atm_spread"))


w_keys = ["l_suppkey", "l_returnflag", "l_linestatus", "l_linenumber"]
_DAILY = "SELECT CAST(o_orderdate AS TIMESTAMP) AS ts, o_orderpriority AS series, avg(o_totalprice) AS value FROM orders GROUP BY 1, 2"


def daily(t: Callable) -> DataFrame:
    return t("orders").groupBy(c("o_orderdate").cast("timestamp").alias("ts"), c("o_orderpriority").alias("series")).agg(F.avg("o_totalprice").alias("value"))


@query(f"SELECT series, CAST(ts AS DATE) AS day, round(value - last_value(value) OVER (PARTITION BY series ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 7 DAYS PRECEDING), 4) AS change_1w, round(value - last_value(value) OVER (PARTITION BY series ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 30 DAYS PRECEDING), 4) AS change_1m FROM ({_DAILY})")
def calendar_lag(t):
    return daily(t).select("series", F.to_date("ts").alias("day"), *[F.round(c("value") - asof.calendar_lag("value", "ts", n, ("series",)), 4).alias(k) for k, n in (("change_1w", 7), ("change_1m", 30))])


@query("SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)")
def semi_nodes(t):
    return t("supplier").select("s_suppkey", "s_nationkey").join(t("customer").where("c_acctbal > 9000").select(c("c_nationkey").alias("s_nationkey")), "s_nationkey", "left_semi").select("s_suppkey", "s_nationkey")


@query("SELECT l_orderkey, l_quantity FROM (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM lineitem) WHERE n = 1 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def anti_insert_ignore(t):
    old = t("orders").where("o_orderstatus = 'F'").select(c("o_orderkey").alias("l_orderkey"))
    new = tables.insert_ignore(old, t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", place()), ["l_orderkey"], [F.asc_nulls_last("l_linenumber"), "place"])
    return tables.surely_new(new, old, "l_orderkey").select("l_orderkey", "l_quantity")


@query("SELECT l_partkey, l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_returnflag = 'R' DESC, l_orderkey DESC, l_linenumber DESC) AS n FROM lineitem) WHERE n = 1")
def upsert_latest(t):
    rows = t("lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    order = [F.desc("l_orderkey"), F.desc("l_linenumber")]
    return tables.upsert(rows.where("l_returnflag <> 'R'"), rows.where("l_returnflag = 'R'"), ["l_partkey"], order).drop("l_returnflag")


@query("SELECT l.l_orderkey, l.l_linenumber, coalesce(o.o_totalprice, p.p_retailprice, l.l_extendedprice) AS price, CASE WHEN o.o_totalprice IS NOT NULL THEN 'surface' WHEN p.p_retailprice IS NOT NULL THEN 'eod' ELSE 'entry' END AS source FROM lineitem l LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') o ON l.l_orderkey = o.o_orderkey LEFT JOIN (SELECT * FROM part WHERE p_size < 20) p ON l.l_partkey = p.p_partkey")
def cascade_lookup(t):
    rows = t("lineitem").join(t("orders").where("o_orderstatus = 'P'").select(c("o_orderkey").alias("l_orderkey"), "o_totalprice"), "l_orderkey", "left")
    rows = rows.join(t("part").where("p_size < 20").select(c("p_partkey").alias("l_partkey"), "p_retailprice"), "l_partkey", "left")
    rows = asof.cascade(rows, [("surface", c("o_totalprice")), ("eod", c("p_retailprice")), ("entry", c("l_extendedprice"))])
    return rows.select("l_orderkey", "l_linenumber", "price", "source")


@query("SELECT p_partkey, q, round(gap, 6) AS gap FROM (SELECT a.p_partkey, b.p_partkey AS q, abs(b.p_retailprice - a.p_retailprice * 1.02) AS gap, row_number() OVER (PARTITION BY a.p_partkey ORDER BY abs(b.p_retailprice - a.p_retailprice * 1.02), b.p_partkey) AS n FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND b.p_retailprice > a.p_retailprice) WHERE n = 1")
def nearest_strike(t):
    a = t("part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    b = t("part").select(c("p_partkey").alias("q"), "p_brand", "p_size", c("p_retailprice").alias("k"))
    gap = F.abs(c("k") - c("p_retailprice") * 1.02)
    rows = asof.nearest_row(a, b, ["p_brand", "p_size"], target=c("p_retailprice") * 1.02, value="k", over=c("p_retailprice"), tie="q")
    return rows.select("p_partkey", "q", F.round(gap, 6).alias("gap"))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def keep_first(t):
    return frames.first_rows(t("events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def keep_last(t):
    return frames.first_rows(t("events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


@query("SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY abs(p_retailprice - 1200), p_partkey) AS n FROM part) WHERE n <= 3")
def capped_topn(t):
    return frames.first_rows(t("part"), ["p_brand"], [F.abs(c("p_retailprice") - 1200), "p_partkey"], 3).select("p_brand", "p_partkey")


@query("SELECT l_suppkey, l_returnflag, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY abs(l_discount - 0.05) + CASE WHEN l_quantity < 10 THEN 100.0 ELSE 0.0 END, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1")
def top1_per_group(t):
    score = F.abs(c("l_discount") - 0.05) + F.when(c("l_quantity") < 10, 100.0).otherwise(0.0)
    return frames.first_rows(t("lineitem"), ["l_suppkey", "l_returnflag"], [score, "l_orderkey", "l_linenumber"]).select("l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber")


@query("SELECT event_id, user_id FROM (SELECT *, max(ts) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS m FROM events) WHERE ts = m")
def latest_per_day(t):
    return t("events").withColumn("m", F.max("ts").over(Window.partitionBy("user_id", F.to_date("ts")))).where("ts = m").select("event_id", "user_id")


@query("SELECT l_shipmonth, count(*) AS n FROM (SELECT DISTINCT l_suppkey, strftime(l_shipdate, '%Y-%m') AS l_shipmonth FROM lineitem WHERE l_returnflag = 'A' UNION SELECT DISTINCT l_suppkey, strftime(l_shipdate, '%Y-%m') FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1")
def union_distinct(t):
    part = lambda f: t("lineitem").where(c("l_returnflag") == f).select("l_suppkey", F.date_format("l_shipdate", "yyyy-MM").alias("l_shipmonth"))
    return part("A").union(part("R")).distinct().groupBy("l_shipmonth").agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_difference(t):
    old = t("orders").where("o_orderstatus = 'F'").select(c("o_custkey").alias("c_custkey"))
    return t("customer").select("c_custkey").distinct().join(old, "c_custkey", "left_anti")


# windows

_W = "(PARTITION BY user_id ORDER BY ts, event_id)"
NODE = (["user_id"], ["ts", "event_id"])


def over(n: int, end: str = "1 PRECEDING") -> str:
    return f"(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {n} PRECEDING AND {end})"


@query(f"SELECT event_id, round(value - lag(value, 1) OVER {_W}, 6) AS iv_change_1, round(value - lag(value, 5) OVER {_W}, 6) AS iv_change_5 FROM events")
def iv_change(t):
    w = frames.node(*NODE)
    return t("events").select("event_id", *r6(iv_change_1=frames.change(c("value"), w, 1), iv_change_5=frames.change(c("value"), w, 5)))


@query(f"SELECT event_id, round(CASE WHEN count(value) OVER {over(5)} >= 5 THEN stddev_samp(value) OVER {over(5)} END, 6) AS vol_5, round(CASE WHEN count(value) OVER {over(10)} >= 10 THEN stddev_samp(value) OVER {over(10)} END, 6) AS vol_10 FROM events")
def rolling_std_prior(t):
    w = frames.node(*NODE)
    return t("events").select("event_id", *r6(vol_5=frames.prior_std(c("value"), w, 5), vol_10=frames.prior_std(c("value"), w, 10)))


@query(f"SELECT event_id, round(CASE WHEN n >= 5 AND s >= 1e-12 THEN (value - m) / s END, 5) AS z FROM (SELECT event_id, value, count(value) OVER {over(5)} AS n, avg(value) OVER {over(5)} AS m, stddev_samp(value) OVER {over(5)} AS s FROM events)")
def zscore_prior5(t):
    return t("events").select("event_id", F.round(frames.prior_zscore(c("value"), frames.node(*NODE), 5), 5).alias("z"))


@query(f"SELECT event_id, round(CASE WHEN count(value) OVER {over(5)} >= 5 THEN value / nullif(avg(value) OVER {over(5)}, 0) END, 6) AS volume_ratio FROM events")
def volume_ratio(t):
    return t("events").select("event_id", *r6(volume_ratio=S.ratio(c("value"), frames.prior_mean(c("value"), frames.node(*NODE), 5))))


@query(f"SELECT event_id, round(CASE WHEN g < -1 THEN -1 WHEN g > 10 THEN 10 ELSE g END, 6) AS oi_change FROM (SELECT event_id, (value - lag(value, 5) OVER {_W}) / nullif(lag(value, 5) OVER {_W}, 0) AS g FROM events)")
def oi_change_clip(t):
    return t("events").select("event_id", *r6(oi_change=frames.clipped_growth(c("value"), frames.node(*NODE), 5)))


@query(f"SELECT event_id, round(value / nullif(lag(value) OVER {_W}, 0) - 1, 6) AS ret_1, round(CASE WHEN value / nullif(lag(value) OVER {_W}, 0) > 0 THEN ln(value / lag(value) OVER {_W}) END, 6) AS log_ret FROM events")
def returns_log(t):
    w = frames.node(*NODE)
    return t("events").select("event_id", *r6(ret_1=S.ratio(c("value"), F.lag("value", 1).over(w)) - 1, log_ret=frames.log_return(c("value"), w, 1)))


_RET = f"SELECT event_id, user_id, ts, (value + 100 - lag(value + 100) OVER {_W}) / lag(value + 100) OVER {_W} AS r FROM events"


@query(f"SELECT event_id, round(CASE WHEN count(r) OVER {over(5)} >= 2 THEN var_samp(r) OVER {over(5)} * 252 END, 4) AS rv_5, round(CASE WHEN count(r) OVER {over(10)} >= 2 THEN var_samp(r) OVER {over(10)} * 252 END, 4) AS rv_10 FROM ({_RET})")
def realized_var(t):
    rows = frames.realized_variance(t("events").withColumn("p", c("value") + 100), "p", *NODE, windows=(5, 10))
    return rows.select("event_id", F.round("rv_5", 4).alias("rv_5"), F.round("rv_10", 4).alias("rv_10"))


@query(f"SELECT event_id, round(CASE WHEN count(s) OVER {over(4, 'CURRENT ROW')} >= 5 THEN stddev_samp(s) OVER {over(4, 'CURRENT ROW')} END, 5) AS vol_of_vol FROM (SELECT *, CASE WHEN count(value) OVER {over(5)} >= 5 THEN stddev_samp(value) OVER {over(5)} END AS s FROM events)")
def vol_of_vol(t):
    return frames.vol_of_vol(t("events"), "value", *NODE, 5).select("event_id", F.round("vol_of_vol", 5).alias("vol_of_vol"))


@query(f"SELECT event_id, round(d, 6) AS drawdown, round(min(d) OVER {over(251, 'CURRENT ROW')}, 6) AS max_drawdown FROM (SELECT *, (value + 100) / max(value + 100) OVER {over(251, 'CURRENT ROW')} - 1 AS d FROM events)")
def drawdown(t):
    rows = frames.drawdowns(t("events").withColumn("p", c("value") + 100), "p", *NODE)
    return rows.select("event_id", *r6(drawdown=c("drawdown"), max_drawdown=c("max_drawdown")))


# The same with windows of days: each node's frames are as many rows as its median day has, times the days.

_STEPS = "SELECT e.*, s.steps FROM events e JOIN (SELECT user_id, CAST(greatest(floor(quantile_cont(n, 0.5)), 1) AS BIGINT) AS steps FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id, CAST(ts AS DATE)) GROUP BY user_id) s USING (user_id)"


def ago(x: str, n: int) -> str:
    return f"lag({x}, CAST({n} * steps AS INT)) OVER {_W}"


def over_days(n: int) -> str:
    return over(f"{n} * steps")  # type: ignore[arg-type]


def last_rows(n: int) -> str:
    return over(f"({n} * steps - 1)", "CURRENT ROW")  # type: ignore[arg-type]


def stepped(t: Callable, days: int, *columns: Callable[[list[str]], dict]) -> DataFrame:
    """The events, p = value + 100, and columns over frames of days, each built from those before, in blocks with a halo of so many days."""

    def build(rows: DataFrame, by: list[str]) -> DataFrame:
        for of in columns:
            rows = rows.withColumns(of(by))
        return rows

    return scan.day_windowed(t("events").withColumn("p", c("value") + 100), "ts", *NODE, days=days, build=build)


@query(f"SELECT event_id, round(value - {ago('value', 1)}, 6) AS iv_change_1, round(value - {ago('value', 5)}, 6) AS iv_change_5 FROM ({_STEPS})")
def iv_change_days(t):
    rows = stepped(t, 5, lambda by: {f"iv_change_{n}": c("value") - frames.days_ago(c("value"), by, n) for n in (1, 5)})
    return rows.select("event_id", *r6(iv_change_1=c("iv_change_1"), iv_change_5=c("iv_change_5")))


@query(f"SELECT event_id, round(CASE WHEN count(value) OVER {over_days(5)} >= 5 * steps THEN stddev_samp(value) OVER {over_days(5)} END, 6) AS vol_5, round(CASE WHEN count(value) OVER {over_days(10)} >= 10 * steps THEN stddev_samp(value) OVER {over_days(10)} END, 6) AS vol_10 FROM ({_STEPS})")
def rolling_std_prior_days(t):
    rows = stepped(t, 10, lambda by: {f"vol_{n}": frames.full(c("value"), F.stddev_samp("value"), frames.prior_days(by, n), n) for n in (5, 10)})
    return rows.select("event_id", *r6(vol_5=c("vol_5"), vol_10=c("vol_10")))


@query(f"SELECT event_id, round(CASE WHEN n >= 5 * steps AND s >= 1e-12 THEN (value - m) / s END, 5) AS z FROM (SELECT event_id, value, steps, count(value) OVER {over_days(5)} AS n, avg(value) OVER {over_days(5)} AS m, stddev_samp(value) OVER {over_days(5)} AS s FROM ({_STEPS}))")
def zscore_prior5_days(t):
    def z(by: list[str]) -> dict:
        w = frames.prior_days(by, 5)
        std = frames.full(c("value"), F.stddev_samp("value"), w, 5)
        return {"z": S.ratio(c("value") - F.avg("value").over(w), F.when(std >= 1e-12, std))}

    return stepped(t, 5, z).select("event_id", F.round("z", 5).alias("z"))


@query(f"SELECT event_id, round(CASE WHEN count(value) OVER {over_days(5)} >= 5 * steps THEN value / nullif(avg(value) OVER {over_days(5)}, 0) END, 6) AS volume_ratio FROM ({_STEPS})")
def volume_ratio_days(t):
    rows = stepped(t, 5, lambda by: {"volume_ratio": S.ratio(c("value"), frames.full(c("value"), F.avg("value"), frames.prior_days(by, 5), 5))})
    return rows.select("event_id", *r6(volume_ratio=c("volume_ratio")))


@query(f"SELECT event_id, round(CASE WHEN g < -1 THEN -1 WHEN g > 10 THEN 10 ELSE g END, 6) AS oi_change FROM (SELECT event_id, (value - {ago('value', 5)}) / nullif({ago('value', 5)}, 0) AS g FROM ({_STEPS}))")
def oi_change_clip_days(t):
    rows = stepped(t, 5, lambda by: {"before": frames.days_ago(c("value"), by, 5)})
    return rows.select("event_id", *r6(oi_change=S.clip(S.ratio(c("value") - c("before"), c("before")), -1.0, 10.0)))


@query(f"SELECT event_id, round(value / nullif({ago('value', 1)}, 0) - 1, 6) AS ret_1, round(CASE WHEN value / nullif({ago('value', 1)}, 0) > 0 THEN ln(value / {ago('value', 1)}) END, 6) AS log_ret FROM ({_STEPS})")
def returns_log_days(t):
    rows = stepped(t, 1, lambda by: {"r": S.ratio(c("value"), frames.days_ago(c("value"), by, 1))})
    return rows.select("event_id", *r6(ret_1=c("r") - 1, log_ret=F.when(c("r") > 0, F.ln(c("r")))))


@query(f"SELECT event_id, round(CASE WHEN count(r) OVER {over_days(5)} >= 2 THEN var_samp(r) OVER {over_days(5)} * 252 END, 4) AS rv_5, round(CASE WHEN count(r) OVER {over_days(10)} >= 2 THEN var_samp(r) OVER {over_days(10)} * 252 END, 4) AS rv_10 FROM (SELECT *, (value + 100) / {ago('value + 100', 1)} - 1 AS r FROM ({_STEPS}))")
def realized_var_days(t):
    returns = lambda by: {"r": S.ratio(c("p"), frames.days_ago(c("p"), by, 1)) - 1}
    rows = stepped(t, 11, returns, lambda by: {f"rv_{n}": frames.at_least(c("r"), F.var_samp("r"), frames.prior_days(by, n), 2) * 252 for n in (5, 10)})
    return rows.select("event_id", *[F.round(f"rv_{n}", 4).alias(f"rv_{n}") for n in (5, 10)])


@query(f"SELECT event_id, round(CASE WHEN count(s) OVER {last_rows(5)} >= 5 * steps THEN stddev_samp(s) OVER {last_rows(5)} END, 5) AS vol_of_vol FROM (SELECT *, CASE WHEN count(value) OVER {over_days(5)} >= 5 * steps THEN stddev_samp(value) OVER {over_days(5)} END AS s FROM ({_STEPS}))")
def vol_of_vol_days(t):
    vol = lambda by: {"s": frames.full(c("value"), F.stddev_samp("value"), frames.prior_days(by, 5), 5)}
    rows = stepped(t, 10, vol, lambda by: {"vol_of_vol": frames.full(c("s"), F.stddev_samp("s"), frames.last_days(by, 5), 5)})
    return rows.select("event_id", F.round("vol_of_vol", 5).alias("vol_of_vol"))


@query(f"SELECT event_id, round(d, 6) AS drawdown, round(min(d) OVER {last_rows(252)}, 6) AS max_drawdown FROM (SELECT *, (value + 100) / max(value + 100) OVER {last_rows(252)} - 1 AS d FROM ({_STEPS}))")
def drawdown_days(t):
    loss = lambda by: {"d": S.ratio(c("p"), F.max("p").over(frames.last_days(by, 252))) - 1}
    rows = stepped(t, 504, loss, lambda by: {"worst": F.min("d").over(frames.last_days(by, 252))})
    return rows.select("event_id", *r6(drawdown=c("d"), max_drawdown=c("worst")))


@query(f"SELECT series, CAST(ts AS DATE) AS day, round(CASE WHEN n >= 25 AND s >= 1e-12 THEN (value - m) / s END, 5) AS z FROM (SELECT *, count(value) OVER w AS n, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s FROM ({_DAILY}) WINDOW w AS (PARTITION BY series ORDER BY ts ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING))")
def macro_zscore(t):
    return daily(t).select("series", F.to_date("ts").alias("day"), F.round(frames.prior_zscore(c("value"), frames.node(["series"], ["ts"]), 252, 25), 5).alias("z"))


@query(f"SELECT user_id, length, start FROM (SELECT user_id, count(*) AS length, min(ts) AS start FROM (SELECT *, sum(CASE WHEN down THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, value < max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS down FROM events)) WHERE down GROUP BY user_id, island)")
def drawdown_islands(t):
    return scan.spells(t("events"), "value", *NODE, cell=F.date_trunc("hour", "ts"))


@query(f"SELECT event_id, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) OVER {over(9, 'CURRENT ROW')}, 6) AS win_rate FROM events")
def rolling_win_rate(t):
    w = frames.node(*NODE).rowsBetween(-9, 0)
    return t("events").select("event_id", *r6(win_rate=F.avg(F.when(c("value") > 50, 1.0).otherwise(0.0)).over(w)))


@query("SELECT user_id, CAST(greatest(floor(quantile_cont(n, 0.5)), 1) AS BIGINT) AS steps FROM (SELECT user_id, CAST(ts AS DATE) AS d, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def steps_per_day(t):
    return frames.steps_per_day(t("events"), "ts", ["user_id"])


@query(f"SELECT l_suppkey, l_returnflag, l_linestatus, round(CASE WHEN count(*) >= 3 THEN regr_slope(iv, delta) END, 1) AS slope FROM ({_SLICE}) GROUP BY 1, 2, 3")
def skew_slope(t):
    return slices(t).groupBy("l_suppkey", "l_returnflag", "l_linestatus").agg(F.round(frames.slope(c("iv"), c("delta"), 3), 1).alias("slope"))


@query(f"SELECT l_suppkey, l_returnflag, round(CASE WHEN count(*) >= 2 THEN regr_slope(iv, ln(l_linenumber + 6)) END, 3) AS slope FROM ({_SLICE}) GROUP BY 1, 2")
def term_slope(t):
    return slices(t).groupBy("l_suppkey", "l_returnflag").agg(F.round(frames.slope(c("iv"), F.ln(c("l_linenumber") + 6), 2), 3).alias("slope"))


@query("SELECT l_suppkey, round(CASE WHEN n >= 4 THEN (t2 * s2 - t1 * s3) / nullif(s2 * (s4 - s2 * s2 / n) - s3 * s3, 0) END, 4) AS curvature FROM (SELECT l_suppkey, count(*) AS n, sum(u * u) AS s2, sum(u * u * u) AS s3, sum(u * u * u * u) AS s4, sum(u * v) AS t1, sum(u * u * v) AS t2 FROM (SELECT l_suppkey, l_quantity - avg(l_quantity) OVER (PARTITION BY l_suppkey) AS u, l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_suppkey) AS v FROM lineitem) GROUP BY 1)")
def quad_curvature(t):
    return frames.curvature(t("lineitem"), "l_extendedprice", "l_quantity", ["l_suppkey"]).select("l_suppkey", F.round("curvature", 4).alias("curvature"))


# options

_OPT = "SELECT p_partkey, s, s * (0.96 + p_size / 625.0) AS k, (p_size + 30) / 365.0 AS tt, 0.03 AS r, 0.3 + (p_partkey % 40) / 100.0 AS v, p_partkey % 2 = 0 AS is_call FROM (SELECT *, p_retailprice AS s FROM part)"
_D1 = "(ln(s / k) + (r + v * v / 2) * tt) / (v * sqrt(tt))"
_CALL = f"(s * {pricing.norm_cdf_sql('d1')} - k * exp(-r * tt) * {pricing.norm_cdf_sql('d2')})"
_OPT2 = f"SELECT *, d1 - v * sqrt(tt) AS d2 FROM (SELECT *, {_D1} AS d1 FROM ({_OPT}))"
_PDF = "exp(-d1 * d1 / 2) / 2.5066282746310002"


def options(t: Callable) -> DataFrame:
    return t("part").select("p_partkey", c("p_retailprice").alias("s"), (c("p_retailprice") * (0.96 + c("p_size") / 625.0)).alias("k"), ((c("p_size") + 30) / 365.0).alias("tt"), F.lit(0.03).alias("r"), (0.3 + (c("p_partkey") % 40) / 100.0).alias("v"), F.when(c("p_partkey") % 2 == 0, "C").otherwise("P").alias("right"))


@query(f"SELECT event_id, round({pricing.norm_cdf_sql('x')}, 9) AS phi FROM (SELECT event_id, (event_id % 801) / 100.0 - 4 AS x FROM events)")
def norm_cdf(t):
    return t("events").select("event_id", F.round(pricing.norm_cdf((c("event_id") % 801) / 100.0 - 4), 9).alias("phi"))


@query(f"SELECT p_partkey, round(CASE WHEN is_call THEN call ELSE call - s + k * exp(-r * tt) END, 6) AS price FROM (SELECT *, {_CALL} AS call FROM ({_OPT2}))")
def bs_price(t):
    return options(t).select("p_partkey", *r6(price=pricing.bs_price(c("s"), c("k"), c("tt"), c("r"), c("v"), c("right"))))


@query(f"SELECT p_partkey, round(CASE WHEN is_call THEN {pricing.norm_cdf_sql('d1')} ELSE {pricing.norm_cdf_sql('d1')} - 1 END, 6) AS delta, round({_PDF} / (s * v * sqrt(tt)), 6) AS gamma, round(s * {_PDF} * sqrt(tt), 6) AS vega, round(CASE WHEN is_call THEN -s * {_PDF} * v / (2 * sqrt(tt)) - r * k * exp(-r * tt) * {pricing.norm_cdf_sql('d2')} ELSE -s * {_PDF} * v / (2 * sqrt(tt)) + r * k * exp(-r * tt) * {pricing.norm_cdf_sql('(-d2)')} END, 6) AS theta FROM ({_OPT2})")
def greeks(t):
    rows = options(t).select("p_partkey", pricing.greeks_struct(c("s"), c("k"), c("tt"), c("r"), c("v"), c("right")).alias("x"))
    return rows.select("p_partkey", *r6(**{n: c(f"x.{n}") for n in ("delta", "gamma", "vega", "theta")}))


@query(f"SELECT p_partkey, round(v, 4) AS iv FROM ({_OPT})")
def iv_roundtrip(t):
    rows = options(t).withColumn("price", pricing.bs_price(c("s"), c("k"), c("tt"), c("r"), c("v"), c("right")))
    return rows.select("p_partkey", F.round(pricing.implied_vol("price", "s", "k", "tt", "r", "right"), 4).alias("iv"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every click the latest earlier view of its user, and that view's z-score against the five clicks before."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    rows = asof.asof_join(kind(t, "click").select("event_id", "user_id", "ts"), kind(t, "view").select("user_id", "ts", "value"), by=("user_id",), prefix="view_")
    return rows.select("event_id", "user_id", "view_value", F.round(frames.prior_zscore(c("view_value"), frames.node(["user_id"], ["ts", "event_id"]), 5), 5).alias("z"))
