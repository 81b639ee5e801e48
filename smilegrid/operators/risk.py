"""Signals, sizing, fills, stress, metrics of runs, and the sequential parts of a backtest."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.scalars import MULTIPLIER, clip, ratio
from .frames import sums_in_order
from .scan import prefix_scan

SPOT_SHOCKS = (-0.2, -0.1, -0.05, 0.05, 0.1, 0.2)
VOL_SHOCKS = (-10.0, -5.0, 5.0, 10.0, 20.0)


def confidence(edge: Column) -> Column:
    return F.least(F.lit(1.0), F.abs(edge) / 0.1)


def position_greeks(legs: DataFrame, by: list[str], greeks: tuple[str, ...], order: list[str] | None = None) -> DataFrame:
    """The Greeks of each group of legs, added in ``order`` if there is one."""
    if order:
        rows = sums_in_order(legs, by, order, {f"_{g}": F.col(g) * F.col("qty") * MULTIPLIER for g in greeks})
        return rows.groupBy(*by).agg(*[F.max_by(f"_{g}", F.struct(*order)).alias(g) for g in greeks])
    return legs.groupBy(*by).agg(*[F.sum(F.col(g) * F.col("qty") * MULTIPLIER).alias(g) for g in greeks])


def with_trades(legs: DataFrame, trades: DataFrame) -> DataFrame:
    """A portfolio's legs with those of trades that are not made yet, as positions of their own."""
    return legs.unionByName(trades)


def without_positions(legs: DataFrame, closed: DataFrame, by: list[str], position: str = "position") -> DataFrame:
    """A portfolio's legs without those of ``closed`` positions; an unknown position changes nothing."""
    return legs.join(closed.select(*by, position), [*by, position], "left_anti")


def net_premium(legs: DataFrame, by: list[str]) -> DataFrame:
    return legs.groupBy(*by).agg((-F.sum(F.col("qty") * F.col("price") * MULTIPLIER)).alias("net_premium"))


def contracts(base: Column, conf: Column, liquidity: Column, least_liquidity: float, risk: Column, most: int) -> Column:
    """Base size times confidence, liquidity and risk factors, rounded half to even, within 1 and ``most``."""
    size = base * (conf + 0.5) * F.least(F.lit(1.0), F.greatest(F.lit(0.1), liquidity / least_liquidity)) * risk
    return clip(F.bround(size, 0), 1, most).cast("int")


def fills(orders: DataFrame, *, slippage_bps: float = 5.0, fee: float = 0.65, least_fee: float = 1.0) -> DataFrame:
    """Buys at the ask and sells at the bid, both slipped; without a quote at the entry price. Fees always cost."""
    buy = F.col("qty") > 0
    slip = slippage_bps / 1e4
    price = F.coalesce(F.when(buy, F.col("ask") * (1 + slip)).otherwise(F.col("bid") * (1 - slip)), F.col("entry_price"))
    fees = F.greatest(F.abs("qty") * fee, F.lit(least_fee))
    out = orders.withColumns({"fill_price": price, "fees": fees})
    return out.withColumn("net", F.col("qty") * F.col("fill_price") * MULTIPLIER + F.col("fees"))


def stress(portfolio: DataFrame, key: str) -> DataFrame:
    """The worst scenario: a spot shock (by delta and gamma), a volatility shock (by vega), or the worst fall and rise together."""
    spots = [(s, 0.0) for s in SPOT_SHOCKS]
    vols = [(0.0, v) for v in VOL_SHOCKS]
    move = lambda s: F.col("spot") * s
    cells = [*spots, *vols, (min(SPOT_SHOCKS), max(VOL_SHOCKS))]
    grid = F.array(*[F.struct((F.col("delta") * move(s) + F.col("gamma") * move(s) * move(s) / 2 + F.col("vega") * v / 100).alias("pnl"), F.lit(s).alias("spot_shock"), F.lit(v).alias("vol_shock")) for s, v in cells])
    return portfolio.select(key, F.array_min(grid).alias("w")).select(key, F.col("w.pnl").alias("worst_pnl"), F.abs(F.least("w.pnl", F.lit(0.0))).alias("worst_loss"), F.col("w.spot_shock"), F.col("w.vol_shock"))


def trade_issues(rows: DataFrame, *, most_loss: float, most_contracts: int, caps: dict[str, float], most_stress: float) -> DataFrame:
    """Adds issues and approved: what a trade breaks. A row holds max_loss and contracts of the trade, the Greeks of the
    portfolio with it (``with_delta`` and so on), and its worst_loss under stress. Unknown figures break nothing; a trade that
    breaks nothing known but has an unknown one is neither approved nor rejected (null)."""
    tests = {"max_loss": F.col("max_loss") > most_loss, "contracts": F.col("contracts") > most_contracts}
    tests |= {g: F.abs(f"with_{g}") > cap for g, cap in caps.items()} | {"stress": F.col("worst_loss") > most_stress}
    issues = F.filter(F.array(*[F.when(test, name) for name, test in tests.items()]), lambda x: x.isNotNull())
    return rows.withColumns({"issues": issues, "approved": ~reduce(or_, tests.values())})


def exit_issues(closing: DataFrame, positions: DataFrame) -> DataFrame:
    """approved for each position id of closing legs (position, symbol, qty, exit_type): stops and manual exits of known positions
    always, others if every leg is the inverse of a leg held (positions: position, symbol, qty)."""
    held = positions.select("position", "symbol", F.col("qty").alias("_held"))
    known = positions.select("position").distinct().withColumn("_known", F.lit(True))
    rows = closing.join(held, ["position", "symbol"], "left").join(known, "position", "left")
    bad = F.coalesce(F.col("qty") != -F.col("_held"), F.lit(True))
    urgent = F.bool_or(F.coalesce(F.col("exit_type").isin("STOP_LOSS", "MANUAL"), F.lit(False)))
    return rows.groupBy("position").agg(F.count_if(bad).alias("wrong_legs"), (F.coalesce(F.bool_or("_known"), F.lit(False)) & (urgent | (F.count_if(bad) == 0))).alias("approved"))


def kill_reason(daily_pnl: Column, stress_loss: Column, acceptable: Column, spread: Column, *, most_loss: float, most_spread: float = 0.10) -> Column:
    """The first trigger that holds: daily loss, stress breach, liquidity collapse."""
    return F.when(daily_pnl < -most_loss, "DAILY_LOSS").when(stress_loss > acceptable, "STRESS_BREACH").when(spread > most_spread, "LIQUIDITY_COLLAPSE")


def rebalance(positions: DataFrame, by: list[str], bands: dict[str, tuple[float, float]], *, most: int = 3, least_gain: float = 0.1, order: list[str] | None = None) -> DataFrame:
    """Positions to close: for each Greek outside its band (target, drift allowed), worst first, those that push it further, the
    greatest first, if closing saves a tenth of the drift; a position once, ``most`` in all. With ``order`` the Greeks are added in
    it, so that a sum near a limit doesn't depend on how the rows arrive."""
    sums = Window.partitionBy(*by)
    if order:
        sums = sums.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = positions.withColumns({f"_sum_{g}": F.sum(g).over(sums) for g in bands})
    parts = []
    for i, (g, (target, allowed)) in enumerate(bands.items()):
        off = F.col(f"_sum_{g}") - target
        push = F.col(g) * F.when(off > 0, 1).otherwise(-1)
        parts.append(F.struct(F.when((F.abs(off) > allowed) & (push > 0) & (push >= least_gain * F.abs(off)), F.lit(True)).alias("on"), (F.abs(off) / allowed).alias("severity"), F.lit(i).alias("i"), F.lit(g).alias("greek"), push.alias("push")))
    rows = rows.select(*by, "position", F.explode(F.array(*parts)).alias("x")).where("x.on").select(*by, "position", "x.*")
    order = [F.desc("severity"), "i", F.desc("push"), F.asc_nulls_last("position")]
    own = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "position").orderBy(*order))).where("_n = 1")
    return own.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= most).select(*by, "position", "greek", "place")


def base_size(method: str, *, max_loss: Column, most_loss: float, base: int, edge: Column | None = None, conf: Column | None = None, kelly: float = 0.25) -> Column:
    """Contracts before scaling: fixed, by risk parity (loss limit over loss), or a fraction of Kelly (confidence times edge)."""
    if method == "fixed":
        return F.lit(base)
    if method == "risk_parity":
        return F.when(max_loss <= 0, base).otherwise(F.greatest(F.lit(1), F.floor(most_loss / max_loss)))
    stake = conf * F.abs(edge) * kelly * most_loss * 10
    return F.when((F.abs(edge) <= 0) | (max_loss <= 0), base).otherwise(F.greatest(F.lit(1), F.floor(stake / max_loss)))


def risk_factor(max_loss: Column, most_loss: float) -> Column:
    return F.when(max_loss > most_loss, most_loss / max_loss).otherwise(1.0)


def cost_estimate(legs: DataFrame, by: list[str], *, slippage_bps: float = 5.0, fee: float = 0.65, least_fee: float = 1.0) -> DataFrame:
    """slippage (of legs with a quote), fees and their total, without executing."""
    side = F.when(F.col("qty") > 0, F.col("ask")).otherwise(F.col("bid"))
    rows = legs.groupBy(*by).agg(F.coalesce(F.sum(side * (slippage_bps / 1e4) * F.abs("qty") * MULTIPLIER), F.lit(0.0)).alias("slippage"), F.greatest(F.sum(F.abs("qty")) * fee, F.lit(least_fee)).cast("double").alias("fees"))
    return rows.withColumn("total", F.col("slippage") + F.col("fees"))


def exit_signal(pnl: Column, premium: Column, edge: Column, entry_edge: Column, dte: Column, held: Column) -> Column:
    """The first that holds: stop, reversal, decay, take profit, time."""
    return (
        F.when(pnl <= -0.8 * F.abs(premium), "STOP_LOSS")
        .when((edge * entry_edge < 0) & (F.abs(edge) >= 0.5 * F.abs(entry_edge)), "REVERSAL")
        .when(F.abs(edge) < 0.3 * F.abs(entry_edge), "EDGE_DECAY")
        .when(pnl >= 0.5 * F.abs(premium), "TAKE_PROFIT")
        .when(dte <= 3, "TIME")
    )


def run_metrics(history: DataFrame, run: str, order: str, equity: str, days: int = 252) -> DataFrame:
    """Return, Sharpe, Sortino, drawdown, VaR and CVaR of each run's equity."""
    spec = Window.partitionBy(run).orderBy(order)
    rows = history.withColumns({"_r": ratio(F.col(equity), F.lag(equity).over(spec)) - 1, "_top": F.max(equity).over(spec.rowsBetween(Window.unboundedPreceding, 0))})
    rows = rows.withColumns({"_dd": F.col(equity) / F.col("_top") - 1, "_var": F.percentile("_r", F.lit(0.05)).over(Window.partitionBy(run))})
    r = F.col("_r")
    return rows.groupBy(run).agg(
        (F.max_by(equity, order) / F.min_by(equity, order) - 1).alias("total_return"),
        (ratio(F.avg(r), F.stddev_samp(r)) * days**0.5).alias("sharpe"),
        (ratio(F.avg(r), F.stddev_samp(F.when(r < 0, r))) * days**0.5).alias("sortino"),
        F.min("_dd").alias("max_drawdown"),
        F.first("_var").alias("var_5"),
        F.avg(F.when(r <= F.col("_var"), r)).alias("cvar_5"),
        ratio(F.count_if(r > 0), F.count(r)).alias("win_rate"),
    )


def trade_metrics(ledger: DataFrame, capital: float, days: int = 252) -> DataFrame:
    """The 30 metrics of each run of a backtest's ledger; without trades or losses a ratio is 0 (profit factor: infinity)."""
    rows = ledger.where("kind IN ('SNAPSHOT', 'ENTRY', 'EXIT')").withColumn("_snap", F.col("kind") == "SNAPSHOT")  # read once: a ledger is a whole backtest
    own = ["run", "_snap"]
    upto = Window.partitionBy(*own).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    snap = lambda v: F.when(F.col("_snap"), v)
    top, dd = F.max("equity").over(upto), F.col("_dd")
    rows = rows.withColumn("var_95", F.percentile("daily_pnl", F.lit(0.05)).over(Window.partitionBy(*own)))  # one value a day of a run
    rows = rows.withColumn("_dd", snap((F.col("equity") - top) / F.when(top == 0, 1e-10).otherwise(top) * 100))
    rows = rows.withColumn("_spell", F.sum(F.when(dd < 0, 0).otherwise(1)).over(upto))
    rows = rows.withColumn("_length", F.count_if(dd < 0).over(Window.partitionBy(*own, "_spell")))
    x, var = snap(F.col("daily_pnl")), F.col("var_95")
    pnl, out = F.col("pnl"), F.col("kind") == "EXIT"
    win, loss = out & (pnl > 0), out & (pnl < 0)
    rows = rows.groupBy("run").agg(
        F.min(snap(F.col("date"))).alias("start_date"), F.max(snap(F.col("date"))).alias("end_date"), F.count_if("_snap").alias("_days"), F.max_by("equity", snap(F.col("date"))).alias("_final"),
        F.abs(F.min("_dd")).alias("max_drawdown_pct"), F.max(snap(F.col("_length"))).alias("max_drawdown_duration_days"), F.coalesce(F.abs(F.avg(F.when(dd < 0, dd))), F.lit(0.0)).alias("avg_drawdown_pct"),
        F.max(snap(F.col("open_positions"))).alias("max_concurrent_positions"), F.avg(snap(F.col("open_positions"))).alias("avg_concurrent_positions"),
        F.avg(x).alias("avg_daily_pnl"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("daily_pnl_std"), F.stddev_samp(F.when(x < 0, x)).alias("_down"), F.max(x).alias("max_daily_gain"), F.min(x).alias("max_daily_loss"),
        F.max(snap(var)).alias("var_95"), F.avg(F.when(x <= var, x)).alias("cvar_95"),
        F.count_if(out).alias("total_trades"), F.count_if(win).alias("winning_trades"), F.count_if(loss).alias("losing_trades"),
        F.avg(F.when(win, pnl)).alias("avg_win"), F.abs(F.avg(F.when(loss, pnl))).alias("avg_loss"), F.sum(F.when(win, pnl)).alias("_gain"), F.abs(F.sum(F.when(loss, pnl))).alias("_lost"),
        F.avg(F.when(out, pnl)).alias("avg_trade_pnl"), F.max(F.when(out, pnl)).alias("max_win"), F.min(F.when(out, pnl)).alias("max_loss"), F.sum(F.when(~F.col("_snap"), F.col("fees"))).alias("total_fees"), F.sum(F.when(~F.col("_snap"), F.col("slippage"))).alias("total_slippage"),
    ).where("_days > 0")
    rows = rows.fillna(0, ["avg_win", "avg_loss", "_gain", "_lost", "avg_trade_pnl", "max_win", "max_loss", "total_fees", "total_slippage"])
    n, final, zero = F.col("total_trades"), F.col("_final"), F.lit(0.0)
    part = lambda a, b: F.coalesce(F.when(b > 0, a / b), zero)
    rows = rows.withColumn("total_return_pct", (final / capital - 1) * 100)
    rows = rows.withColumn("annualized_return_pct", F.when(F.col("_days") * 12 >= days, (F.pow(final / capital, days / F.col("_days")) - 1) * 100).otherwise(F.col("total_return_pct")))
    cost = F.col("total_fees") + F.col("total_slippage")
    gross = final - capital + cost
    rows = rows.withColumns({
        "sharpe_ratio": part(F.col("avg_daily_pnl"), F.col("daily_pnl_std")) * days**0.5,
        "sortino_ratio": part(F.col("avg_daily_pnl"), F.col("_down")) * days**0.5,
        "calmar_ratio": part(F.col("annualized_return_pct"), F.col("max_drawdown_pct")),
        "win_rate": part(F.col("winning_trades"), n) * 100,
        "profit_factor": F.when(n == 0, zero).when(F.col("_lost") > 0, F.col("_gain") / F.col("_lost")).otherwise(float("inf")),
        "avg_holding_period_days": part(F.col("_days"), n),
        "total_commission_pct": F.when(gross != 0, cost / F.abs(gross) * 100).otherwise(zero),
    })
    return rows.select("run", "start_date", "end_date", *METRICS)


METRICS = (
    "total_return_pct", "annualized_return_pct", "sharpe_ratio", "sortino_ratio", "calmar_ratio", "max_drawdown_pct", "max_drawdown_duration_days", "avg_drawdown_pct",
    "total_trades", "winning_trades", "losing_trades", "win_rate", "avg_win", "avg_loss", "profit_factor", "avg_trade_pnl", "max_win", "max_loss", "avg_holding_period_days",
    "max_concurrent_positions", "avg_concurrent_positions", "avg_daily_pnl", "daily_pnl_std", "max_daily_gain", "max_daily_loss", "var_95", "cvar_95", "total_fees", "total_slippage", "total_commission_pct",
)


def compare_runs(metrics: DataFrame) -> DataFrame:
    """One row a run with the twelve columns of the comparison report."""
    return metrics.select(F.col("run").alias("run_id"), "start_date", "end_date", "total_return_pct", "sharpe_ratio", "sortino_ratio", "max_drawdown_pct", "total_trades", "win_rate", "profit_factor", "avg_trade_pnl", "total_fees")


def in_order(frame: DataFrame, run: str, order: list[str], start: Callable, schema: str) -> DataFrame:
    """``start(run)`` makes a run's state, whose feed(row) gives the rows out for each row in order, and end() the last ones.

    Runs come sorted and in batches: a task holds a batch and one run's state, however long the run."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, names = None, [f.name for f in kinds]
        rows = lambda out: pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], kinds)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if state is None or state.run != r[run]:
                    out += state.end() if state else []
                    state = start(r[run])
                out += state.feed(r)
            if out:
                yield rows(out)
        if state and (out := state.end()):
            yield rows(out)

    kinds = to_arrow_schema(StructType.fromDDL(schema))
    return frame.repartition(run).sortWithinPartitions(run, *order).mapInArrow(scan, schema)


class Acceptance:
    def __init__(self, run: object, names: list[str], cash: float, most_delta: float):
        self.run, self.names, self.cash, self.most_delta, self.delta = run, names, cash, most_delta, 0.0

    def feed(self, r: dict) -> list[tuple]:
        ok = r["cost"] <= self.cash and abs(self.delta + r["delta"]) <= self.most_delta
        if ok:
            self.cash, self.delta = self.cash - r["cost"], self.delta + r["delta"]
        return [(*[r[c] for c in self.names], ok, self.cash, self.delta)]

    def end(self) -> list[tuple]:
        return []


def replay(orders: DataFrame, run: str, order: list[str], *, cash: float, most_delta: float) -> DataFrame:
    """Accept each run's orders one after the other while cash and the delta cap allow; nothing is held of a run but its state."""
    names = [run, *order]
    kinds = ", ".join(f"{c} {orders.schema[c].dataType.simpleString()}" for c in names)
    return in_order(orders.select(*names, "cost", "delta"), run, order, lambda r: Acceptance(r, names, cash, most_delta), f"{kinds}, accepted boolean, cash double, net_delta double")


class Rows:
    """Rows and whole batches in order, given out as batches."""

    def __init__(self, kinds: pa.Schema):
        self.kinds, self.batches, self.rows = kinds, [], []

    def add(self, rows: list[tuple]) -> None:
        self.rows += rows

    def whole(self, batch: pa.RecordBatch) -> None:
        self.batches += [*self.taken(), batch]

    def taken(self) -> list[pa.RecordBatch]:
        rows, self.rows = self.rows, []
        return [pa.RecordBatch.from_pylist([dict(zip(self.kinds.names, r, strict=True)) for r in rows], self.kinds)] if rows else []

    def all(self) -> list[pa.RecordBatch]:
        batches, self.batches = [*self.batches, *self.taken()], []
        return [pa.Table.from_batches(batches, self.kinds).combine_chunks().to_batches()[0]] if batches else []


#: Orders that a run looks at together.
AT_ONCE = 4_096


class Book:
    """One run's cash and open positions; of a position: net entry price, fees, slippage, delta, entry edge, expiry, quotes, and today's price and edge."""

    def __init__(self, run: object, cash: float, most_delta: float, most_loss: float):
        self.run, self.cash, self.most_delta, self.most_loss = run, cash, most_delta, most_loss
        self.open: dict = {}
        self.date, self.seq, self.realized, self.daily, self.exited, self.killed = None, 0, 0.0, 0.0, False, False

    def row(self, kind: str, key: object = None, net: float = 0.0, pnl: float = 0.0, fees: float = 0.0, slippage: float = 0.0, reason: str | None = None) -> tuple:
        self.seq += 1
        value = math.fsum(p["price"] for p in self.open.values()) if kind == "SNAPSHOT" else None
        unrealized = math.fsum(p["price"] - p["entry"] for p in self.open.values()) if kind == "SNAPSHOT" else None
        equity = self.cash + value if kind == "SNAPSHOT" else None
        return (self.run, self.date, self.seq, kind, key, net, pnl, fees, slippage, reason, self.cash, value, equity, unrealized, self.realized, self.daily, self.delta(), len(self.open))

    def delta(self) -> float:
        return math.fsum(p["delta"] for p in self.open.values())

    def orders(self, batch: pa.RecordBatch, out: Rows) -> None:
        """Some of the day's orders. All up to the first that can be made are rejected at once, as nothing changes before it."""
        if self.killed:
            return
        out.add(self.exits())
        net = sum(batch.column(c).to_numpy() for c in ("price", "fees", "slippage"))
        delta, at = batch.column("delta").to_numpy(), 0
        while at < len(net):
            upto = at + AT_ONCE
            far, dear = np.abs(self.delta() + delta[at:upto]) > self.most_delta, (net[at:upto] > 0) & (net[at:upto] > self.cash)
            good = np.flatnonzero(~(far | dear))
            n = int(good[0]) if len(good) else len(far)
            if n:
                self.reject(batch.column("key").slice(at, n), net[at : at + n], far[:n], out)
            at += n
            if len(good):
                out.add(self.enter(batch.slice(at, 1).to_pylist()[0]))
                at += 1

    def reject(self, keys: pa.Array, net: np.ndarray, far: np.ndarray, out: Rows) -> None:
        one = dict(zip(out.kinds.names, self.row("REJECT"), strict=True))
        columns = {c: pa.nulls(len(net), out.kinds.field(c).type) if v is None else pa.repeat(pa.scalar(v, out.kinds.field(c).type), len(net)) for c, v in one.items()}
        columns |= {"seq": pa.array(np.arange(self.seq, self.seq + len(net))), "key": keys, "net": pa.array(net), "reason": pa.array(np.where(far, "DELTA", "CASH"), pa.string())}
        self.seq += len(net) - 1
        out.whole(pa.RecordBatch.from_arrays([columns[c] for c in out.kinds.names], schema=out.kinds))

    def begin(self, date: object) -> list[tuple]:
        """The counters start anew, positions expire on the day after their expiry, the others take today's quote, or without one the entry price."""
        self.date, self.daily, self.exited, out = date, 0.0, False, []
        for key, p in list(self.open.items()):
            if p["expiry"] < date:
                del self.open[key]
                self.realized -= p["entry"]
                out.append(self.row("EXPIRE", key, pnl=-p["entry"]))
            else:
                price, p["edge"] = p["marks"].get(date, (None, None))
                p["price"] = p["entry"] if price is None else price
        return out

    def exits(self) -> list[tuple]:
        out = []
        if not self.exited:
            self.exited = True
            for key, p in list(self.open.items()):
                if reason := exit_reason(p["price"] - p["entry"], p["entry"], p["edge"], p["entry_edge"], (p["expiry"] - self.date).days):
                    net = p["fees"] + p["slippage"] - p["price"]
                    pnl = -net - p["entry"]
                    del self.open[key]
                    self.cash, self.daily, self.realized = self.cash - net, self.daily + pnl, self.realized + pnl
                    out.append(self.row("EXIT", key, net, pnl, p["fees"], p["slippage"], reason))
        return out

    def enter(self, r: dict) -> list[tuple]:
        net = r["price"] + r["fees"] + r["slippage"]
        self.cash -= net
        self.open[r["key"]] = {"entry": net, "price": r["price"], "fees": r["fees"], "slippage": r["slippage"], "delta": r["delta"], "edge": r["edge"], "entry_edge": r["edge"], "expiry": r["expiry"], "marks": {m["date"]: (m["price"], m["edge"]) for m in r["marks"] or []}}
        return [self.row("ENTRY", r["key"], net, 0.0, r["fees"], r["slippage"])]

    def end(self) -> list[tuple]:
        """A day ends with its exits, if no order came, a snapshot and the kill switch, after which the run stops."""
        if self.date is None or self.killed:
            return []
        out = [*self.exits(), self.row("SNAPSHOT")]
        if self.daily < -self.most_loss:
            self.killed = True
            out.append(self.row("KILL", reason="DAILY_LOSS"))
        return out


def exit_reason(pnl: float, premium: float, edge: float | None, entry_edge: float | None, dte: int) -> str | None:
    """exit_signal for one position; without an edge its tests do not hold."""
    known = edge is not None and entry_edge is not None
    if pnl <= -0.8 * abs(premium):
        return "STOP_LOSS"
    if known and edge * entry_edge < 0 and abs(edge) >= 0.5 * abs(entry_edge):
        return "REVERSAL"
    if known and abs(edge) < 0.3 * abs(entry_edge):
        return "EDGE_DECAY"
    if pnl >= 0.5 * abs(premium):
        return "TAKE_PROFIT"
    return "TIME" if dte <= 3 else None


def backtest(orders: DataFrame, quotes: DataFrame, *, cash: float, most_delta: float, most_loss: float) -> DataFrame:
    """The ledger of each run, day by day: expire, mark, exits, entries, snapshot, kill; cash -= net.

    ``orders``: run, date, key, price, fees, slippage, delta, edge, expiry. ``quotes``: date, key, price, edge; without one a
    position counts at its entry price. Every run has every day of both sides. A run is one task, as each
    decision depends on all before, but it gets only its days and orders, each with the quotes from the next day to its expiry, and holds
    a batch and the run's open positions."""
    days = orders.select("date").unionByName(quotes.select("date")).distinct()
    calendar = orders.select("run").distinct().crossJoin(days).withColumn("_kind", F.lit(0))
    own = ["key", "_from", "_until"]
    lives = orders.select("key", F.col("date").alias("_from"), F.col("expiry").alias("_until"))
    marks = quotes.join(lives, "key").where((F.col("date") > F.col("_from")) & (F.col("date") <= F.col("_until")))
    marks = marks.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("date", "price", "edge"))).alias("marks"))
    held = orders.withColumns({"_from": F.col("date"), "_until": F.col("expiry"), "_kind": F.lit(1)}).join(marks, own, "left").drop("_from", "_until")
    rows = calendar.unionByName(held, allowMissingColumns=True)
    kinds = {c: orders.schema[c].dataType.simpleString() for c in ("run", "date", "key")}
    schema = f"run {kinds['run']}, date {kinds['date']}, seq long, kind string, key {kinds['key']}, net double, pnl double, fees double, slippage double, reason string, cash double, positions_value double, equity double, unrealized double, realized double, daily_pnl double, net_delta double, open_positions long"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, out = None, Rows(arrow)
        for batch in batches:
            at = 0
            for day in [*np.flatnonzero(batch.column("_kind").to_numpy() == 0).tolist(), batch.num_rows]:
                if day > at:
                    book.orders(batch.slice(at, day - at), out)
                if day < batch.num_rows:
                    run = batch.column("run")[day].as_py()
                    out.add(book.end() if book else [])
                    if book is None or book.run != run:
                        book = Book(run, cash, most_delta, most_loss)
                    if not book.killed:
                        out.add(book.begin(batch.column("date")[day].as_py()))
                at = day + 1
            yield from out.all()
        out.add(book.end() if book else [])
        yield from out.all()

    return rows.repartition("run").sortWithinPartitions("run", "date", "_kind", "key").mapInArrow(scan, schema)


def priced_legs(legs: DataFrame, surface: DataFrame, quotes: DataFrame, *, day: str = "day", symbol: str = "symbol", ts: str = "ts", greeks: tuple[str, ...] = ("delta",)) -> DataFrame:
    """``legs`` with price and source: the day's surface, else the day's last quote, else the price at entry; longs at the bid, shorts at the ask.

    ``surface`` has one row a (day, symbol) with bid, ask and Greeks, which replace the legs' own where they are finite; ``quotes`` are rows in time,
    of which the last bid and the last ask of the day (of one time the greatest) count, each by itself, if both are there. A surface row's missing side stays missing (it is the
    surface's price); legs keep their own Greeks elsewhere.
    """
    keys = [day, symbol]
    last = quotes.groupBy(*keys).agg(*[F.max_by(s, F.when(F.col(s).isNotNull(), F.struct(ts, s))).alias(f"_q{s}") for s in ("bid", "ask")])
    last = last.where("_qbid IS NOT NULL AND _qask IS NOT NULL").withColumn("_quoted", F.lit(True))
    seen = surface.select(*keys, *[F.col(c).alias(f"_s{c}") for c in ("bid", "ask", *greeks)], F.lit(True).alias("_seen"))
    rows = legs.join(seen, keys, "left").join(last, keys, "left")
    long = F.col("qty") > 0
    side = lambda p: F.when(long, F.col(f"_{p}bid")).otherwise(F.col(f"_{p}ask"))
    rows = rows.withColumns({
        "price": F.when(F.col("_seen"), side("s")).when(F.col("_quoted"), side("q")).otherwise(F.col("entry_price")),
        "source": F.when(F.col("_seen"), "surface").when(F.col("_quoted"), "market").otherwise("entry"),
        **{g: F.when(F.col("_seen") & F.col(f"_s{g}").isNotNull() & ~F.isnan(f"_s{g}"), F.col(f"_s{g}")).otherwise(F.col(g)) for g in greeks},
    })
    return rows.drop("_seen", "_quoted", "_qbid", "_qask", "_sbid", "_sask", *[f"_s{g}" for g in greeks])


def position_states(positions: DataFrame, exits: DataFrame, today: Column, *, position: str = "position", expiry: str = "expiry") -> DataFrame:
    """``positions`` with state: CLOSED once an exit was filled, CLOSING while one is submitted, EXPIRED after the last expiry, else OPEN.

    ``exits`` are orders (position, filled); a closed position doesn't expire, one that is closing does."""
    orders = exits.groupBy(position).agg(F.bool_or(F.coalesce("filled", F.lit(False))).alias("_filled"))
    rows = positions.join(orders, position, "left")
    state = F.when(F.col("_filled"), "CLOSED").when(F.col(expiry) < today, "EXPIRED").when(F.col("_filled").isNotNull(), "CLOSING").otherwise("OPEN")
    return rows.withColumn("state", state).drop("_filled")


def cumulative_pnl(closed: DataFrame, by: list[str], day: str, pnl: str, cell: Column) -> DataFrame:
    """P&L and trades of each group and day, and the sum so far."""
    days = closed.groupBy(*by, day).agg(F.sum(pnl).alias("pnl"), F.count("*").alias("trades"))
    return prefix_scan(days, by, [day], cell, {"cumulative": ("sum", F.col("pnl"))})
