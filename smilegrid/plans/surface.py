"""From raw quotes, bars and rates to one representative quote for each node of the surface, and to the panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import pricing, scalars
from ..operators.asof import asof_join
from ..operators.frames import first_rows, slope


def build_surface(quotes: DataFrame, bars: DataFrame, rates: DataFrame, *, bounds: dict | None = None, tenors: tuple[int, ...] = scalars.TENORS) -> DataFrame:
    """Quotes (ts, option_symbol, exp_date, strike, right, bid, ask, volume, open_interest), bars (ts, close) and rates (ts, value)
    to surface nodes: as-of spot and rate, implied volatilities, Greeks, tenor, bucket, flags, then the best quote a node."""
    rows = quotes.withColumn("ts", F.date_trunc("minute", "ts"))
    rows = asof_join(rows, bars.select("ts", "close"), prefix="spot_")
    rows = asof_join(rows, rates.select("ts", "value"), prefix="rate_")
    c = F.col
    rows = rows.withColumns({"spot": c("spot_close"), "rf_rate": F.coalesce("rate_value", F.lit(scalars.DEFAULT_RATE)), "tte_years": scalars.years_to_expiry(c("exp_date"), c("ts")), "mid": scalars.mid(c("bid"), c("ask"))})
    terms = ("spot", "strike", "tte_years", "rf_rate", "right")
    rows = rows.withColumn("_x", pricing.solved_sides("bid", "ask", "mid", *terms))
    rows = rows.withColumns({"iv_mid": c("_x.iv")} | {g: c(f"_x.{g}") for g in ("iv_bid", "iv_ask", "delta", "gamma", "vega", "theta")}).drop("_x")
    rows = rows.withColumns({"tenor_days": scalars.nearest_bin(F.date_diff("exp_date", F.to_date("ts")), tenors), "delta_bucket": scalars.delta_bucket(c("delta"), bounds), "flags": scalars.quality_flags(c("bid"), c("ask"), c("volume"), c("open_interest"))})
    return representatives(rows.drop("spot_ts", "spot_close", "rate_ts", "rate_value"), bounds)


def representatives(rows: DataFrame, bounds: dict | None = None) -> DataFrame:
    """The quote nearest its bucket's centre at each time and node; any flag costs 100; ties by symbol."""
    centre = F.create_map(*[F.lit(x) for k, v in (bounds or scalars.BUCKET_BOUNDS).items() for x in (k, (v[0] + v[1]) / 2)])
    seen = F.when(F.col("delta_bucket") == "ATM", F.abs("delta")).otherwise(F.col("delta"))
    score = F.abs(seen - centre[F.col("delta_bucket")]) + F.when(F.col("flags") > 0, 100.0).otherwise(0.0)
    return first_rows(rows.where("delta_bucket is not null and tenor_days is not null and iv_mid is not null").withColumn("_score", score), ["ts", "tenor_days", "delta_bucket"], ["_score", "option_symbol"]).drop("_score")


def surface_features(nodes: DataFrame) -> DataFrame:
    """ATM spread, skew slope by delta, and slope by log tenor, all as windows over the slice: nothing is joined back."""
    slice_, term = Window.partitionBy("ts", "tenor_days"), Window.partitionBy("ts", "delta_bucket")
    atm = F.max(F.when(F.col("delta_bucket") == "ATM", F.col("iv_mid"))).over(slice_)
    return nodes.withColumns({"atm_spread": F.col("iv_mid") - atm, "skew_slope": slope(F.col("iv_mid"), F.col("delta"), 3, slice_), "term_slope": slope(F.col("iv_mid"), F.ln("tenor_days"), 2, term)})
