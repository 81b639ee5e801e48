"""Covariance of a wide panel: pairs in Spark, eigenvalue cleaning on the small matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MOST_NODES = 512


def wide(panel: DataFrame, ts: str, node: str, value: str, nodes: list) -> DataFrame:
    """A column for each node, complete rows only."""
    return panel.groupBy(ts).pivot(node, nodes).agg(F.max_by(value, ts)).dropna()


def covariance_pairs(panel: DataFrame, ts: str, node: str, value: str) -> DataFrame:
    """Sample covariance and correlation of every pair of nodes (a <= b) over their common times."""
    a = panel.select(F.col(ts), F.col(node).alias("a"), F.col(value).alias("x"))
    b = panel.select(F.col(ts), F.col(node).alias("b"), F.col(value).alias("y"))
    return a.join(b, ts).where("a <= b").groupBy("a", "b").agg(F.covar_samp("x", "y").alias("cov"), F.corr("x", "y").alias("corr"), F.count("*").alias("n"))


def gramian_pairs(panel: DataFrame, ts: str, node: str, value: str) -> DataFrame:
    """What ``covariance_pairs`` gives, from sums of products of wide rows instead of a join of all pairs a time.

    A time's rows are one array of at most MOST_NODES numbers (more nodes raise an error); a task adds up its times' products in
    matrices and gives one row a pair, and the rows are added up. Values are taken off their node's mean first, so large levels
    don't swallow the covariance. A node's second row of one time is left out (the greatest value stays); NULL and NaN are missing.
    """
    rows = panel.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & F.col(node).isNotNull() & F.col(ts).isNotNull())
    means = rows.groupBy(F.col(node).alias("_node")).agg(F.avg(value).alias("_mean"))
    listed = means.orderBy("_node").limit(MOST_NODES + 1).collect()
    if len(listed) > MOST_NODES:
        raise ValueError(f"a matrix of more than {MOST_NODES} nodes is too large for a task")
    names, mean = [r["_node"] for r in listed], np.array([r["_mean"] for r in listed])
    place = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)]) if names else F.create_map().cast(f"map<{panel.schema[node].dataType.simpleString()},int>")
    cells = rows.groupBy(F.col(ts).alias("_ts"), place[F.col(node)].alias("_i")).agg(F.max(F.col(value).cast("double")).alias("_v"))
    wide_ = cells.groupBy("_ts").agg(F.collect_list("_i").alias("_i"), F.collect_list("_v").alias("_v"))

    def add(batches):  # noqa: ANN001, ANN202
        n = len(names)
        count, left, square, both = (np.zeros((n, n)) for _ in range(4))
        for batch in batches:
            x, there = np.zeros((len(batch), n)), np.zeros((len(batch), n))
            r = batch.column("_i").value_parent_indices().to_numpy()
            i, v = (batch.column(c).flatten().to_numpy() for c in ("_i", "_v"))
            x[r, i], there[r, i] = v - mean[i], 1
            count += there.T @ there
            left += x.T @ there
            square += (x * x).T @ there
            both += x.T @ x
        a, b = np.nonzero(np.triu(count))
        columns = [a, b, count[a, b].astype(np.int64), left[a, b], left[b, a], square[a, b], square[b, a], both[a, b]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"])

    sums = wide_.mapInArrow(add, "i long, j long, n long, sx double, sy double, sxx double, syy double, sxy double")
    sums = sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    dev = lambda p, a, b: F.col(p) - F.col(a) * F.col(b) / F.col("n")
    cov = F.when(F.col("n") > 1, dev("sxy", "sx", "sy") / (F.col("n") - 1))
    corr = F.try_divide(dev("sxy", "sx", "sy"), F.sqrt(F.greatest(dev("sxx", "sx", "sx") * dev("syy", "sy", "sy"), F.lit(0.0))))
    back = lambda c: F.element_at(F.array(*[F.lit(n) for n in names]) if names else F.array(F.lit(None).cast(panel.schema[node].dataType)), (F.col(c) + 1).cast("int"))
    return sums.select(back("i").alias("a"), back("j").alias("b"), cov.alias("cov"), corr.alias("corr"), "n")


def shrunk_pairs(panel: DataFrame, ts: str, node: str, value: str, last: int | None = None) -> DataFrame:
    """Ledoit-Wolf shrinkage to a scaled identity (2004): cov of every pair of nodes (a <= b) and the shrinkage, without a matrix on the driver.

    Of the times at which every node has a value (the ``last`` ones, where given) the products come from one Gramian of the centred values, their spread from
    another of their squares; the rest are sums over pairs. Missing values and repeats are treated as in ``gramian_pairs``; without complete times there are no rows.
    """
    x = F.col(value).cast("double")
    cells = panel.where(x.isNotNull() & ~F.isnan(x)).dropna(subset=[ts, node]).groupBy(F.col(ts).alias("_ts"), F.col(node).alias("_node")).agg(F.max(x).alias("_x"))
    width = cells.agg(F.count_distinct("_node").alias("_p"))  # one row
    times = cells.groupBy("_ts").agg(F.count("*").alias("_k")).join(F.broadcast(width), F.col("_k") == F.col("_p")).select("_ts")
    times = times.orderBy(F.desc("_ts")).limit(last) if last else times
    rows = cells.join(times, "_ts")
    rows = rows.join(rows.groupBy("_node").agg(F.avg("_x").alias("_mean")), "_node").select("_ts", "_node", (F.col("_x") - F.col("_mean")).alias("_x"))
    population = F.col("cov") * (F.col("n") - 1) / F.col("n")
    products = gramian_pairs(rows, "_ts", "_node", "_x").select("a", "b", F.coalesce(population, F.lit(0.0)).alias("s"), "n")
    spread = gramian_pairs(rows.withColumn("_x", F.col("_x") * F.col("_x")), "_ts", "_node", "_x").select("a", "b", F.coalesce(population, F.lit(0.0)).alias("q"))
    pairs = products.join(spread, ["a", "b"])
    own, twice = F.col("a") == F.col("b"), F.when(F.col("a") == F.col("b"), 1.0).otherwise(2.0)
    sums = pairs.agg(F.max("n").alias("_n"), F.count_if(own).alias("_p"), F.avg(F.when(own, F.col("s"))).alias("_mu"), F.sum(twice * F.col("s") * F.col("s")).alias("_ss"), F.sum(twice * F.col("q")).alias("_q"))
    square = F.col("_p") * F.col("_mu") * F.col("_mu")
    far, noise = F.col("_ss") - square, (F.col("_q") + F.col("_p") * square - F.col("_ss")) / F.col("_n")
    sums = sums.select("_mu", F.when(far > 0, F.least(noise, far) / far).otherwise(0.0).alias("shrinkage"))  # one row
    towards = F.when(own, F.col("shrinkage") * F.col("_mu")).otherwise(0.0)
    return pairs.crossJoin(F.broadcast(sums)).select("a", "b", ((1 - F.col("shrinkage")) * F.col("s") + towards).alias("cov"), "shrinkage")


def uncorrelated_signals(signals: DataFrame, pairs: DataFrame, *, node: str, score: str, id_: str, limit: float = 0.85) -> DataFrame:
    """Signals that stay: greedily by score (then the least id), one stays unless its node's correlation with the node of one that stayed reaches ``limit``.

    Only the best signal of each known node can stay, so one task sees at most MOST_NODES nodes with their pairs; signals of
    nodes without pairs all stay. ``score`` is the absolute edge times the confidence, or another number.
    """
    known = pairs.select(F.col("a").alias(node)).union(pairs.select(F.col("b").alias(node))).distinct()
    free = signals.join(known, node, "left_anti")
    best = signals.join(known, node, "left_semi").groupBy(node).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(id_).alias("i"))).alias("_b"))
    best = best.select(F.lit(1).alias("_g"), F.col(node).cast("string").alias("a"), F.col("_b.s").alias("s"), F.col("_b.i").cast("string").alias("i"), F.lit(None).cast("string").alias("b"), F.lit(None).cast("double").alias("c"))
    close = pairs.where((F.col("a") != F.col("b")) & (F.abs("corr") >= limit)).select(F.lit(1).alias("_g"), F.col("a").cast("string").alias("a"), F.lit(None).cast("double").alias("s"), F.lit(None).cast("string").alias("i"), F.col("b").cast("string").alias("b"), F.col("corr").alias("c"))

    def greedy(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        near: dict[str, set] = {}
        for r in rows:
            if r["b"] is not None:
                near.setdefault(r["a"], set()).add(r["b"])
                near.setdefault(r["b"], set()).add(r["a"])
        nodes = sorted((r for r in rows if r["b"] is None), key=lambda r: (r["s"], r["i"]))
        if len(nodes) > MOST_NODES:
            raise ValueError(f"more than {MOST_NODES} nodes")
        kept: set = set()
        out = [r["i"] for r in nodes if not (near.get(r["a"], set()) & kept) and not kept.add(r["a"])]
        return pa.table({"_i": pa.array(out, pa.string())})

    stays = best.unionByName(close).groupBy("_g").applyInArrow(greedy, "_i string")
    return signals.join(stays, signals[id_].cast("string") == F.col("_i"), "left_semi").unionByName(free)


def matrix(pairs: DataFrame, value: str) -> tuple[list, np.ndarray]:
    """The symmetric matrix of at most MOST_NODES nodes; more raise an error before any pair is read."""
    nodes = pairs.select("a").union(pairs.select("b")).distinct().limit(MOST_NODES + 1).count()
    if nodes > MOST_NODES:
        raise ValueError(f"a matrix of more than {MOST_NODES} nodes does not fit the driver")
    rows = pairs.select("a", "b", value).collect()
    names = sorted({r.a for r in rows} | {r.b for r in rows})
    at, m = {n: i for i, n in enumerate(names)}, np.zeros((len(names), len(names)))
    for r in rows:
        m[at[r.a], at[r.b]] = m[at[r.b], at[r.a]] = r[value] or 0.0
    return names, m


def clean_correlation(corr: np.ndarray, rows: int, *, cap: float = 100.0, method: str = "clip_to_mean") -> np.ndarray | None:
    """Eigenvalues inside the Marchenko-Pastur band (both edges) become their mean, zero, or half way to one; then a floor, a ridge
    of the largest over ``cap`` where the condition exceeds it, and a unit diagonal. None where all are noise: shrink instead."""
    values, vectors = np.linalg.eigh(corr)
    gamma = len(corr) / rows
    noise = (values >= (1 - np.sqrt(gamma)) ** 2) & (values <= (1 + np.sqrt(gamma)) ** 2)
    if noise.all():
        return None
    if noise.any():
        mean = values[noise].mean()
        values = np.where(noise, {"clip_to_mean": mean, "clip_to_zero": 0.0, "shrink_toward_identity": 0.5 + 0.5 * mean}[method], values)
    values = np.maximum(values, 1e-10)
    out = vectors @ np.diag(values) @ vectors.T
    if values.max() / values.min() > cap:
        out = out + values.max() / cap * np.eye(len(out))
    scale = np.maximum(np.sqrt(np.diag(out)), 1e-12)
    return out / np.outer(scale, scale)


def shrunk_correlation(cov: np.ndarray) -> np.ndarray:
    scale = np.maximum(np.sqrt(np.diag(cov)), 1e-12)
    return cov / np.outer(scale, scale)


def portfolio_variance(cov: DataFrame, weights: DataFrame) -> DataFrame:
    """w' S w from covariance pairs (a <= b) and weights (node, w): one row."""
    rows = cov.join(F.broadcast(weights.select(F.col("node").alias("a"), F.col("w").alias("wa"))), "a").join(F.broadcast(weights.select(F.col("node").alias("b"), F.col("w").alias("wb"))), "b")  # at most MOST_NODES
    return rows.agg(F.sum(F.col("cov") * F.col("wa") * F.col("wb") * F.when(F.col("a") == F.col("b"), 1).otherwise(2)).alias("variance"))


def marginal_risk(cov: DataFrame, weights: DataFrame) -> DataFrame:
    """S w over the portfolio's deviation, for each node; 0 under a deviation of 1e-12."""
    both = cov.select("a", "b", "cov").union(cov.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "cov"))
    rows = both.join(F.broadcast(weights.select(F.col("node").alias("b"), F.col("w").alias("wb"))), "b").groupBy(F.col("a").alias("node")).agg(F.sum(F.col("cov") * F.col("wb")).alias("sw"))
    sigma = F.broadcast(portfolio_variance(cov, weights).select(F.sqrt("variance").alias("s")))  # one row
    return rows.crossJoin(sigma).select("node", F.when(F.col("s") < 1e-12, 0.0).otherwise(F.col("sw") / F.col("s")).alias("marginal"))


def shrunk_covariance(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Ledoit-Wolf shrinkage to a scaled identity (2004); without rows, an empty matrix."""
    if not len(x):
        return np.zeros((0, 0)), 0.0
    n, p = x.shape
    x = x - x.mean(0)
    s = x.T @ x / n
    mu = np.trace(s) / p
    d2 = ((s - mu * np.eye(p)) ** 2).sum() / p
    b2 = min(d2, (((x**2).T @ (x**2)) / n - s**2).sum() / (n * p))
    a = b2 / d2 if d2 > 0 else 0.0
    return (1 - a) * s + a * mu * np.eye(p), a


def keep_uncorrelated(names: list, score: dict, corr: np.ndarray, limit: float = 0.85) -> list:
    """Greedy by score: a name stays unless it is too correlated with one that stayed; names without a row stay."""
    at, kept = {n: i for i, n in enumerate(names)}, []
    for n in sorted(score, key=lambda n: (-score[n], n)):
        if n not in at or all(k not in at or abs(corr[at[n], at[k]]) < limit for k in kept):
            kept.append(n)
    return kept


def grid_edges(nodes: DataFrame) -> DataFrame:
    """Edges, both ways, between neighbours of the fixed tenor-by-bucket grid (columns i, j of each node)."""
    a, b = (nodes.select(*[F.col(c).alias(f"{x}_{c}") for c in nodes.columns]) for x in ("src", "dst"))
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj")) for i, j in ((0, 1), (0, -1), (1, 0), (-1, 0))]))
    moved = a.withColumn("_s", steps).withColumns({"dst_i": F.col("src_i") + F.col("_s.di"), "dst_j": F.col("src_j") + F.col("_s.dj")}).drop("_s")
    return moved.join(b, ["dst_i", "dst_j"])
