"""Column expressions: null-safe arithmetic, quote measures, bins, buckets, flags and option symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Fixed values of the data model.
TENORS = (7, 14, 30, 60, 90, 120)
BUCKET_DELTA = {"P10": -0.10, "P25": -0.25, "P40": -0.40, "ATM": 0.50, "C40": 0.40, "C25": 0.25, "C10": 0.10}
#: First match wins; ATM looks at the absolute delta; both ends belong to a bucket.
BUCKET_BOUNDS = {
    "ATM": (0.45, 0.55), "P40": (-0.45, -0.35), "P25": (-0.35, -0.15), "P10": (-0.15, 0.0),
    "C10": (0.0, 0.15), "C25": (0.15, 0.35), "C40": (0.35, 0.45),
}
FLAGS = {"crossed": 1, "stale": 2, "wide_spread": 4, "low_volume": 8, "low_oi": 16}
MULTIPLIER, CLOSE_HOUR, DEFAULT_RATE = 100, 21, 0.05


def finite(x: Column) -> Column:
    """NULL in place of NaN and infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def clean(frame: DataFrame) -> DataFrame:
    """``finite`` on every floating column: missing is NULL and nothing else from here on."""
    return frame.withColumns({c: finite(F.col(f"`{c}`")) for c, t in frame.dtypes if t in ("double", "float")})


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def mid(bid: Column, ask: Column) -> Column:
    return (bid + ask) / 2


def spread_pct(bid: Column, ask: Column) -> Column:
    return (ask - bid) / F.greatest(mid(bid, ask), F.lit(1e-10))


def years_to_expiry(expiry: Column, ts: Column) -> Column:
    """From ts to 21:00 UTC on the expiry day in 365-day years, at least 1e-6."""
    close = F.unix_micros(expiry.cast("date").cast("timestamp")) / 1e6 + CLOSE_HOUR * 3600
    return F.greatest((close - F.unix_micros(ts.cast("timestamp")) / 1e6) / 86400 / 365, F.lit(1e-6))


def nearest_bin(dte: Column, bins: tuple[int, ...] = TENORS) -> Column:
    """The nearest bin, the earlier of two equally near; NULL for negative or missing days."""
    best = F.array_min(F.array(*[F.struct(F.abs(dte - b).alias("gap"), F.lit(i).alias("i"), F.lit(b).alias("bin")) for i, b in enumerate(bins)]))
    return F.when(dte >= 0, best["bin"])


def delta_bucket(delta: Column, bounds: dict[str, tuple[float, float]] | None = None) -> Column:
    """The first bucket, in the given order, that holds the delta."""
    out = None
    for name, ends in (bounds or BUCKET_BOUNDS).items():
        test = (F.abs(delta) if name == "ATM" else delta).between(min(ends), max(ends))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def quality_flags(bid: Column, ask: Column, volume: Column, interest: Column, day: Column | None = None, reference: Column | None = None, *, wide: float | None = 0.5, least_volume: int | None = 10, least_interest: int | None = 100) -> Column:
    """The sum of all flags that hold; a threshold of None switches its flag off, unknown comparisons are false."""
    tests = {"crossed": ask < bid}
    if reference is not None:
        tests["stale"] = day < reference
    if wide is not None:
        tests["wide_spread"] = spread_pct(bid, ask) > wide
    if least_volume is not None:
        tests["low_volume"] = F.coalesce(volume, F.lit(0)) < least_volume
    if least_interest is not None:
        tests["low_oi"] = F.coalesce(interest, F.lit(0)) < least_interest
    out = F.lit(0)
    for name, test in tests.items():
        out = out.bitwiseOR(F.when(F.coalesce(test, F.lit(False)), FLAGS[name]).otherwise(0))
    return out


def flag_names(flags: Column) -> Column:
    return F.filter(F.array(*[F.when(flags.bitwiseAND(v) > 0, k) for k, v in FLAGS.items()]), lambda x: x.isNotNull())


def first_reason(flags: Column, order: tuple[str, ...] = ("low_volume", "crossed", "wide_spread", "stale", "low_oi")) -> Column:
    return F.coalesce(*[F.when(flags.bitwiseAND(FLAGS[k]) > 0, k) for k in order])


def format_symbol(root: Column, expiry: Column, right: Column, strike: Column) -> Column:
    return F.concat(root, F.date_format(expiry, "yyMMdd"), right, F.lpad(F.round(strike * 1000).cast("long").cast("string"), 8, "0"))


def parse_symbol(symbol: Column) -> Column:
    """struct(root, expiry, right, strike) of an option symbol; NULL unless it is well formed."""
    plain = F.upper(F.regexp_replace(symbol, " ", ""))
    shape = r"^([A-Z]{1,6})(\d{6})([CP])(\d{8})$"
    part = lambda i: F.regexp_extract(plain, shape, i)
    expiry = F.try_to_timestamp(F.concat(F.lit("20"), part(2)), F.lit("yyyyMMdd")).cast("date")
    return F.when(plain.rlike(shape) & expiry.isNotNull(), F.struct(part(1).alias("root"), expiry.alias("expiry"), part(3).alias("right"), (part(4).cast("double") / 1000).alias("strike")))


def percent_to_decimal(series: Column, value: Column, prefixes: tuple[str, ...] = ("DGS", "DFII", "DFF", "EFFR", "FEDFUNDS", "MORTGAGE", "CORESTICKM")) -> Column:
    return F.when(series.rlike("^(" + "|".join(prefixes) + ")"), value / 100).otherwise(value)


def release_key(observed: Column, release: Column) -> Column:
    """The release time where it is plausible (a day before to seven days after 21:00 on the observation day), else that time."""
    proxy = observed.cast("date").cast("timestamp") + F.expr(f"INTERVAL {CLOSE_HOUR} HOURS")
    ok = release.between(proxy - F.expr("INTERVAL 1 DAY"), proxy + F.expr("INTERVAL 7 DAYS"))
    return F.when(ok, release).otherwise(proxy)


def signal_class(tenor: Column, bucket: Column, edge: Column, iv: Column) -> Column:
    return (
        F.when(bucket == "ATM", F.when(tenor <= 14, "TERM").otherwise("DIRECTIONAL"))
        .when(bucket.isin("P25", "P10", "C10", "C25"), "SKEW")
        .when((F.coalesce(iv, F.lit(0.2)) > 0.30) & (F.abs(edge) < 0.03), "ELEVATED")
        .otherwise("DIRECTIONAL")
    )


def structure_of(kind: Column, confidence: Column) -> Column:
    return F.when(kind == "TERM", "calendar").when((kind == "DIRECTIONAL") & (confidence >= 0.5), "vertical").when(kind == "SKEW", "skew").when(kind == "ELEVATED", "condor")


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x < low, low).when(x > high, high).otherwise(x)
