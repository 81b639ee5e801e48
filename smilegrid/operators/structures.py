"""Multi-leg option structures from signals and one surface a snapshot, with their premium and greatest loss.

Legs depend on a signal's node and the sign of its edge only, so they are found once for each of the few nodes of a
snapshot and then joined to the signals. A surface has columns snap, tenor, bucket, right, strike, spot, price, symbol, expiry
and place (its row order); a signal has id, snap, tenor, bucket and edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import MULTIPLIER
from .frames import sums_in_order

#: Least gap between tenors of a calendar, its strike tolerance, and widths of the wings, as shares of the spot.
TENOR_GAP, TOLERANCE = 30, 0.01
WIDTH = {"vertical": 0.02, "condor": 0.02, "skew": 0.03}
_OPTION = ("symbol", "strike", "right", "price", "expiry")


def _option(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in _OPTION])


def _first(surface: DataFrame, by: list[str], name: str) -> DataFrame:
    """The first row, by place, of each group: its option and spot."""
    return surface.groupBy(*by).agg(F.min_by(F.struct(_option().alias("option"), F.coalesce("spot", "strike").alias("spot")), "place").alias(name))


def _nearest(nodes: DataFrame, surface: DataFrame, on: list[str], keys: list[str], condition: Column, target: Column, ties: list[str], name: str) -> DataFrame:
    """For each node the option of its slice that meets the condition nearest the target; nodes without one go."""
    other = surface.select(*on, *[F.col(c).alias(f"o_{c}") for c in surface.columns])
    pairs = nodes.join(other, on).where(condition)
    rank = F.struct(F.abs(F.col("o_strike") - target), *[F.col(f"o_{c}") for c in ties])
    return pairs.groupBy(*keys).agg(F.min_by(_option("o_"), rank).alias(name))


def _legs(signals: DataFrame, nodes: DataFrame, on: list[str], legs: list[tuple[str, Column]]) -> DataFrame:
    rows = signals.join(nodes, on)
    parts = F.array(*[F.struct(F.lit(i).alias("leg"), q.cast("int").alias("qty"), F.col(n).alias("option")) for i, (n, q) in enumerate(legs)])
    return rows.select("id", "edge", F.explode(parts).alias("x")).select("id", "edge", "x.leg", "x.qty", *[F.col(f"x.option.{c}") for c in _OPTION])


def calendar_legs(signals: DataFrame, surface: DataFrame) -> DataFrame:
    """Near option against the far one (over TENOR_GAP days later) of the nearest strike, the earlier tenor where two are as near;
    nothing beyond the tolerance. A positive edge sells the near one."""
    node = ["snap", "tenor", "bucket"]
    near = _first(surface, node, "near")
    far = _nearest(near, surface.withColumnRenamed("tenor", "far_tenor"), ["snap", "bucket"], node, F.col("o_far_tenor") > F.col("tenor") + TENOR_GAP, F.col("near.option.strike"), ["far_tenor", "place"], "far")
    both = near.join(far, node).where(F.abs(F.col("far.strike") - F.col("near.option.strike")) <= F.col("near.spot") * TOLERANCE)
    up = F.when(F.col("edge") > 0, 1).otherwise(-1)
    return _legs(signals, both.select(*node, F.col("near.option").alias("near"), "far"), node, [("near", -up), ("far", up)])


def vertical_legs(signals: DataFrame, surface: DataFrame, width: float = WIDTH["vertical"]) -> DataFrame:
    """A positive edge buys the call at the node's strike and sells the one above nearest to a width higher; else puts, downwards."""
    node = ["snap", "tenor", "bucket", "right"]
    anchor = _first(surface, node[:3], "anchor").withColumn("right", F.explode(F.array(F.lit("C"), F.lit("P"))))
    strike, up = F.col("anchor.option.strike"), F.col("right") == "C"
    step = F.when(up, 1).otherwise(-1)
    buy = _nearest(anchor, surface, ["snap", "tenor", "right"], node, F.col("o_strike") == strike, strike, ["place"], "buy")
    sell = _nearest(anchor, surface, ["snap", "tenor", "right"], node, (F.col("o_strike") - strike) * step > 0, strike + step * width * F.col("anchor.spot"), ["place"], "sell")
    rows = signals.withColumn("right", F.when(F.col("edge") > 0, "C").otherwise("P"))
    return _legs(rows, buy.join(sell, node), node, [("buy", F.lit(1)), ("sell", F.lit(-1))])


def _winged(surface: DataFrame, width: float) -> DataFrame:
    """For each slice the 25-delta put and call and the wing beyond each."""
    own = ["snap", "tenor"]
    spot = _first(surface, own, "any").select(*own, F.col("any.spot").alias("spot"))
    parts = spot
    for name, bucket, right, step in (("put", "P25", "P", -1), ("call", "C25", "C", 1)):
        side = surface.where(F.col("right") == right)
        short = _first(side.where(F.col("bucket") == bucket), own, name).select(*own, F.col(f"{name}.option").alias(name))
        strike = F.col(f"{name}.strike")
        wing = _nearest(short.join(spot, own), side.drop("right").withColumn("right", F.lit(right)), own, own, (F.col("o_strike") - strike) * step > 0, strike + step * width * F.col("spot"), ["place"], f"{name}_wing")
        parts = parts.join(short, own).join(wing, own)
    return parts.drop("spot")


def condor_legs(signals: DataFrame, surface: DataFrame, width: float = WIDTH["condor"]) -> DataFrame:
    """Sells the 25-delta put and call, buys a wing beyond each."""
    one = F.lit(1)
    return _legs(signals, _winged(surface, width), ["snap", "tenor"], [("put", -one), ("put_wing", one), ("call", -one), ("call_wing", one)])


def skew_legs(signals: DataFrame, surface: DataFrame, width: float = WIDTH["skew"]) -> DataFrame:
    """A positive edge sells the put spread and buys the call spread; else the other way round."""
    up = F.when(F.col("edge") > 0, 1).otherwise(-1)
    return _legs(signals, _winged(surface, width), ["snap", "tenor"], [("put", -up), ("put_wing", up), ("call", up), ("call_wing", -up)])


def premium_and_loss(legs: DataFrame, by: list[str], order: list[str] | None = None) -> DataFrame:
    """net_premium (negative: a debit), is_debit, contracts and max_loss of each group of legs.

    A debit can lose itself. A credit can lose the distance of its strikes less the credit where there are two, the price of its
    long legs where there is one, else the wider of the put and call widths less the credit; never under 0. With ``order`` money is
    added in it."""
    money = F.col("qty") * F.col("price") * MULTIPLIER
    paid = F.when(F.col("qty") > 0, money)
    net_sum, paid_sum = F.sum(money), F.sum(paid)
    if order:
        legs = sums_in_order(legs, by, order, {"_net": money, "_paid": paid})
        net_sum, paid_sum = (F.max_by(x, F.struct(*order)) for x in ("_net", "_paid"))
    side = lambda r: F.when(F.count_if(F.col("right") == r) >= 2, (F.max(F.when(F.col("right") == r, F.col("strike"))) - F.min(F.when(F.col("right") == r, F.col("strike")))) * MULTIPLIER).otherwise(0.0)
    rows = legs.groupBy(*by).agg(
        (-net_sum).alias("net_premium"), F.sum(F.abs("qty")).alias("contracts"), F.count_distinct("strike").alias("_strikes"), ((F.max("strike") - F.min("strike")) * MULTIPLIER).alias("_width"),
        F.coalesce(paid_sum, F.lit(0.0)).alias("_long"), side("P").alias("_puts"), side("C").alias("_calls"),
    )
    net, zero = F.col("net_premium"), F.lit(0.0)
    loss = F.when(net < 0, -net).when(F.col("_strikes") == 2, F.greatest(zero, F.col("_width") - net)).when(F.col("_strikes") == 1, F.abs("_long")).otherwise(F.greatest(zero, F.greatest("_puts", "_calls") - net))
    return rows.select(*by, "net_premium", (net < 0).alias("is_debit"), "contracts", loss.alias("max_loss"))


def largest_loss(legs: DataFrame, by: list[str], structure: str = "structure") -> DataFrame:
    """net_premium and max_loss of each group of legs by its structure's own rule, from one grouping.

    calendar: a debit loses itself, a credit the price of one leg of the latest expiry (of several the first by strike); vertical: a debit loses
    itself, a credit the distance of its two least strikes less the credit; condor and skew: the wider of the put and call widths, less a credit
    or plus a debit. Other structures get NULL; a single strike has no width.
    """
    side = lambda r: F.when(F.count_if(F.col("right") == r) >= 2, F.max(F.when(F.col("right") == r, F.col("strike"))) - F.min(F.when(F.col("right") == r, F.col("strike")))).otherwise(0.0) * MULTIPLIER
    rows = legs.groupBy(*by, structure).agg(
        (-F.sum(F.col("qty") * F.col("price") * MULTIPLIER)).alias("net_premium"), side("P").alias("_puts"), side("C").alias("_calls"), F.array_sort(F.collect_list("strike")).alias("_strikes"),
        F.abs(F.min(F.struct((-F.unix_date(F.col("expiry").cast("date"))).alias("e"), "strike", "price"))["price"] * MULTIPLIER).alias("_far"),
    )
    net = F.col("net_premium")
    width = F.try_element_at("_strikes", F.lit(2)) - F.try_element_at("_strikes", F.lit(1))
    loss = F.when(F.col(structure).isin("condor", "skew"), F.greatest("_puts", "_calls") - net)
    loss = loss.when(F.col(structure).isin("calendar", "vertical") & (net < 0), -net).when(F.col(structure) == "calendar", F.col("_far")).when(F.col(structure) == "vertical", F.coalesce(width, F.lit(0.0)) * MULTIPLIER - net)
    return rows.select(*by, structure, "net_premium", loss.alias("max_loss"))
