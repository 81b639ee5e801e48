"""The shared linear baseline: one least-squares model over all nodes' rows, a column of coefficients for each horizon.

Fitting is one aggregate with partial sums (counts, means and covariances of complete rows), whose single row of
bounded width is solved in one small task; forecasts are plain column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def _good(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x)


def moments(frame: DataFrame, features: list[str], targets: list[str]) -> DataFrame:
    """One row a target: n, means and covariances over the rows in which it and all features have a value."""
    known = F.lit(True)
    for f in features:
        known &= _good(F.col(f).cast("double"))
    aggs = []
    for t in targets:
        ok = known & _good(F.col(t).cast("double"))
        x = [F.when(ok, F.col(c).cast("double")) for c in [*features, t]]
        pairs = [F.covar_pop(x[i], x[j]) for i in range(len(x)) for j in range(min(i, len(features) - 1) + 1)]
        aggs.append(F.struct(F.lit(t).alias("target"), F.count_if(ok).alias("n"), F.array(*[F.avg(c) for c in x]).alias("means"), F.array(*pairs).alias("covs")))
    return frame.agg(F.array(*aggs).alias("m")).select(F.explode("m").alias("m")).select("m.*")


def fit_linear(frame: DataFrame, features: list[str], targets: list[str], *, ridge: float = 0.0) -> DataFrame:
    """target, term ("intercept" or a feature), value: least squares with an intercept that ``ridge`` (times the mean variance) doesn't shrink.

    Rows without a feature or the target are left out for that target only. Features that others determine share their weight (the least
    solution); a target without a row gets no terms.
    """
    p = len(features)

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for target, n, means, covs in zip(part["target"], part["n"], part["means"], part["covs"], strict=True):
                if not n:
                    continue
                low, flat, at = np.zeros((p, p)), np.asarray(covs, dtype=float), 0
                for i in range(p):
                    low[i, : i + 1] = flat[at : at + i + 1]
                    at += i + 1
                full = low + np.tril(low, -1).T
                full += np.eye(p) * ridge * (np.trace(full) / p if p else 0)
                scale = np.sqrt(np.where(np.diag(full) > 0, np.diag(full), 1.0))  # solve for scaled features: units don't matter
                b = np.linalg.lstsq(full / np.outer(scale, scale), flat[at : at + p] / scale, rcond=1e-10)[0] / scale
                out += [(target, "intercept", float(means[p] - b @ np.asarray(means[:p], dtype=float)))] + [(target, f, float(v)) for f, v in zip(features, b, strict=True)]
            yield pd.DataFrame(out, columns=["target", "term", "value"])

    return moments(frame, features, targets).mapInPandas(solve, "target string, term string, value double")


def forecast(frame: DataFrame, model: DataFrame, features: list[str], targets: list[str], *, mask: Column | None = None, prefix: str = "pred_") -> DataFrame:
    """``frame`` with pred_<target>: NULL without a feature or a model, 0 where ``mask`` isn't true.

    The model is brought along as one row of (features + 1) x targets numbers."""
    row = model.groupBy().agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x00", "target", "term"), "value"))).alias("_model"))
    out = frame.crossJoin(F.broadcast(row))  # one row, of a size that the lists of names fix
    weight = lambda t, f: F.try_element_at("_model", F.lit(f"{t}\x00{f}"))
    for t in targets:
        y = weight(t, "intercept")
        for f in features:
            y = y + weight(t, f) * F.col(f).cast("double")
        out = out.withColumn(f"{prefix}{t}", y if mask is None else F.when(mask, y).otherwise(0.0))
    return out.drop("_model")
