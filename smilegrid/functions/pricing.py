"""Black-Scholes prices, Greeks and implied volatility with a continuous dividend yield.

The normal distribution follows the published double-precision rational approximation (Hart 1968, West 2005).
Prices and Greeks are column expressions; only the inversion needs Python, on Arrow batches.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

#: Coefficients of the published approximation, highest power first.
_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_LOW = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
_ROOT_2PI = math.sqrt(2 * math.pi)


def norm_cdf_sql(x: str) -> str:
    """The distribution function as SQL text that Spark and other engines share."""
    z = f"abs({x})"
    poly = lambda cs: "(" * (len(cs) - 1) + f"{cs[0]!r}" + "".join(f" * {z} + {c!r})" for c in cs[1:])
    near = f"{poly(_TOP)} / {poly(_LOW)}"
    far = f"1.0 / (({z} + 1.0 / ({z} + 2.0 / ({z} + 3.0 / ({z} + 4.0 / ({z} + 0.65))))) * 2.506628274631)"
    tail = f"CASE WHEN {z} > 37.0 THEN 0.0 WHEN {z} < 7.07106781186547 THEN exp(-{z} * {z} / 2.0) * {near} ELSE exp(-{z} * {z} / 2.0) * {far} END"
    return f"(CASE WHEN {x} > 0 THEN 1.0 - ({tail}) ELSE {tail} END)"


def _poly(z: Column, cs: tuple[float, ...]) -> Column:
    out = F.lit(cs[0])
    for c in cs[1:]:
        out = out * z + c
    return out


def norm_cdf(x: Column) -> Column:
    z = F.abs(x)
    e = F.exp(-z * z / 2)
    far = e / ((z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + 0.65))))) * 2.506628274631)
    tail = F.when(z > 37, F.lit(0.0)).when(z < 7.07106781186547, e * _poly(z, _TOP) / _poly(z, _LOW)).otherwise(far)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / _ROOT_2PI


def _d(s: Column, k: Column, t: Column, r: Column, v: Column, q: Column) -> tuple[Column, Column, Column, Column]:
    t, v = F.greatest(t, F.lit(1e-10)), F.greatest(v, F.lit(1e-10))
    root = v * F.sqrt(t)
    d1 = (F.ln(s / k) + (r - q + v * v / 2) * t) / root
    return d1, d1 - root, t, v


def bs_price(s: Column, k: Column, t: Column, r: Column, v: Column, right: Column, q: Column | None = None) -> Column:
    q = F.lit(0.0) if q is None else q
    d1, d2, t, _ = _d(s, k, t, r, v, q)
    spot, cash = s * F.exp(-q * t), k * F.exp(-r * t)
    call = spot * norm_cdf(d1) - cash * norm_cdf(d2)
    return F.when(right == "C", call).otherwise(call - spot + cash)


def greeks(s: Column, k: Column, t: Column, r: Column, v: Column, right: Column, q: Column | None = None) -> dict[str, Column]:
    """delta, gamma, vega (a unit of volatility) and theta (a year); NULL without a positive volatility."""
    x = greeks_struct(s, k, t, r, v, right, q)
    return {n: x[n] for n in ("delta", "gamma", "vega", "theta")}


def greeks_struct(s: Column, k: Column, t: Column, r: Column, v: Column, right: Column, q: Column | None = None) -> Column:
    """All Greeks as one struct. Lists of one bind d1 and the distribution's values once, which keeps the generated code small."""
    q = F.lit(0.0) if q is None else q
    d1, d2, t, vol = _d(s, k, t, r, v, q)
    parts = F.array(F.struct(d1.alias("d1"), d2.alias("d2"), F.sqrt(t).alias("root"), vol.alias("vol"), F.exp(-q * t).alias("eq"), F.exp(-r * t).alias("er"), s.alias("s"), k.alias("k"), r.alias("r"), q.alias("q"), (right == "C").alias("call"), (v > 0).alias("ok")))

    def values(x: Column) -> Column:
        return F.struct(x.alias("x"), norm_cdf(x["d1"]).alias("n1"), norm_cdf(x["d2"]).alias("n2"), norm_pdf(x["d1"]).alias("pdf"))

    def all_greeks(y: Column) -> Column:
        x, n1, n2, pdf = y["x"], y["n1"], y["n2"], y["pdf"]
        decay = -x["s"] * x["eq"] * pdf * x["vol"] / (2 * x["root"])
        cash, carry = x["r"] * x["k"] * x["er"], x["q"] * x["s"] * x["eq"]
        out = {
            "delta": F.when(x["call"], x["eq"] * n1).otherwise(x["eq"] * (n1 - 1)),
            "gamma": x["eq"] * pdf / (x["s"] * x["vol"] * x["root"]),
            "vega": x["s"] * x["eq"] * pdf * x["root"],
            "theta": F.when(x["call"], decay - cash * n2 + carry * n1).otherwise(decay + cash * (1 - n2) - carry * (1 - n1)),
        }
        return F.struct(*[F.when(x["ok"], c).alias(n) for n, c in out.items()])

    return F.transform(F.transform(parts, values), all_greeks)[0]


def _cdf(x: np.ndarray) -> np.ndarray:
    z = np.abs(x)
    e = np.exp(-z * z / 2)
    tail = np.where(z < 7.07106781186547, e * np.polyval(_TOP, z) / np.polyval(_LOW, z), e / ((z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + 0.65))))) * 2.506628274631))
    tail = np.where(z > 37, 0.0, tail)
    return np.where(x > 0, 1 - tail, tail)


def solve_iv(price: np.ndarray, s: np.ndarray, k: np.ndarray, t: np.ndarray, r: np.ndarray, call: np.ndarray | None = None, *, q: np.ndarray | float = 0.0, steps: int = 100, tolerance: float = 1e-6) -> np.ndarray:
    """Newton's method for all rows at once; a row stops when it is within tolerance. NaN unless 0 < iv < 10, and where any
    argument is missing. Without ``call`` an option is a call where the spot is above the strike."""
    t = np.maximum(t, 1e-10)
    call = s > k if call is None else call
    fs, fk = s * np.exp(-q * t), k * np.exp(-r * t)
    guess = np.clip(np.sqrt(2 * np.pi / t) * price / s, 0.05, 3.0)
    v = np.where((s / k > 0.8) & (s / k < 1.2), guess, 0.25)
    live = np.isfinite(price) & np.isfinite(s) & np.isfinite(k) & np.isfinite(t) & np.isfinite(r) & np.isfinite(q)
    v = np.where(live, v, np.nan)
    for _ in range(steps):
        root = np.maximum(v, 1e-10) * np.sqrt(t)
        d1 = (np.log(s / k) + (r - q + v * v / 2) * t) / root
        c = fs * _cdf(d1) - fk * _cdf(d1 - root)
        gap = np.where(call, c, c - fs + fk) - price
        live = live & (np.abs(gap) >= tolerance)
        if not live.any():
            break
        vega = fs * np.exp(-d1 * d1 / 2) / _ROOT_2PI * np.sqrt(t)
        v = np.where(live, v - gap / np.maximum(vega, 1e-10), v)
    return np.where(np.isfinite(v) & (v > 0) & (v < 10), v, np.nan)


def _calls(right: pd.Series, s: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Which options are calls; one of unknown right is a call where the spot is above the strike."""
    return np.where(right.isna(), s > k, right == "C")


def _implied_vol(price: pd.Series, s: pd.Series, k: pd.Series, t: pd.Series, r: pd.Series, right: pd.Series) -> pd.Series:
    with np.errstate(all="ignore"):
        p, s, k, t, r = (c.to_numpy(dtype=float, na_value=np.nan) for c in (price, s, k, t, r))
        x = solve_iv(p, s, k, t, r, _calls(right, s, k))
    return pd.Series(x).astype("Float64").mask(np.isnan(x))


def implied_vol(*columns: Column | str) -> Column:
    """Price, spot, strike, years, rate and right (NULL: inferred) to the volatility; NULL where there is none."""
    return F.pandas_udf(_implied_vol, "double", 200)(*columns)


def _solved(price: pd.Series, s: pd.Series, k: pd.Series, t: pd.Series, r: pd.Series, right: pd.Series) -> pd.DataFrame:
    with np.errstate(all="ignore"):
        p, s, k, t, r = (c.to_numpy(dtype=float, na_value=np.nan) for c in (price, s, k, t, r))
        call = _calls(right, s, k)
        v, t = solve_iv(p, s, k, t, r, call), np.maximum(t, 1e-10)
        root = v * np.sqrt(t)
        d1 = (np.log(s / k) + (r + v * v / 2) * t) / root
        pdf, cash = np.exp(-d1 * d1 / 2) / _ROOT_2PI, r * k * np.exp(-r * t)
        n1, n2 = _cdf(d1), _cdf(d1 - root)
        out = {"iv": v, "delta": np.where(call, n1, n1 - 1), "gamma": pdf / (s * root), "vega": s * pdf * np.sqrt(t), "theta": -s * pdf * v / (2 * np.sqrt(t)) - cash * np.where(call, n2, n2 - 1)}
        out = {n: np.where(np.isfinite(v), x, np.nan) for n, x in out.items()}
    return pd.DataFrame({n: pd.Series(x).astype("Float64").mask(np.isnan(x)) for n, x in out.items()})


def solved(*columns: Column | str) -> Column:
    """struct(iv, delta, gamma, vega, theta) in one Arrow pass. Marked non-deterministic, so that Spark runs
    the solver once a row and no filter on its result is copied below it."""
    return F.pandas_udf(_solved, "iv double, delta double, gamma double, vega double, theta double", 200).asNondeterministic()(*columns)


def _solved_sides(bid: pd.Series, ask: pd.Series, mid: pd.Series, s: pd.Series, k: pd.Series, t: pd.Series, r: pd.Series, right: pd.Series) -> pd.DataFrame:
    return pd.concat([_solved(mid, s, k, t, r, right), _implied_vol(bid, s, k, t, r, right).rename("iv_bid"), _implied_vol(ask, s, k, t, r, right).rename("iv_ask")], axis=1)


def solved_sides(*columns: Column | str) -> Column:
    """Bid, ask, mid, spot, strike, years, rate and right to struct(iv, Greeks at the mid, iv_bid, iv_ask), in one Arrow pass."""
    return F.pandas_udf(_solved_sides, "iv double, delta double, gamma double, vega double, theta double, iv_bid double, iv_ask double", 200).asNondeterministic()(*columns)
