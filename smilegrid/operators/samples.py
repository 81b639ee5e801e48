"""Dense training samples: runs of consecutive times over a fixed list of nodes, packed into arrays, missing values 0.

Distinct times are numbered in two levels and cut into blocks of times, each with a halo of the lookback before it; a panel
row is sent to its block and at most one other. A task holds one block (times x nodes x features numbers, all of them given) and slides
over it; no key's history is collected and no row is copied once for each sample that it is in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .scan import in_blocks


def dense_samples(
    panel: DataFrame, ts: str, node: Column, n_nodes: int, features: list[str], labels: list[str], *, lookback: int, cell: Column, min_end: object = None, masked: str | None = None,
    stats: dict[str, tuple[float, float]] | None = None, block: int = 256,
) -> DataFrame:
    """One row for each time that has ``lookback`` distinct times before it: end_ts, start_ts, x, y, mask, label_mask.

    x: (lookback + 1) x nodes x features float32, in that order; y and label_mask: nodes x labels, mask: nodes, at the sample's end. ``node`` gives a row's
    place from 0 (rows with another place count for their time only). Values that are NULL, NaN or infinite are 0, before which features and labels
    with ``stats`` (mean, deviation) are normalised; labels of rows whose ``masked`` is true are left out. mask: the node has an
    unmasked row there with some label (any row, without labels). A node's second row of one time overwrites values, in an unspecified order.
    Samples that end before ``min_end`` are left out, but their times still fill later ones. Rows without a time are left out.
    """
    rows = panel.where(F.col(ts).isNotNull())
    times = in_blocks(rows.select(F.col(ts).alias("_ts")).distinct(), [], ["_ts"], cell, lookback, max(block, lookback + 1))
    value = lambda c: F.col(c).cast("double")
    packed = rows.select(F.col(ts).alias("_ts"), F.coalesce(node.cast("int"), F.lit(-1)).alias("_node"), F.array(*[value(f) for f in features]).alias("_x"), F.array(*[value(y) for y in labels]).cast("array<double>").alias("_y"), (F.coalesce(F.col(masked), F.lit(False)) if masked else F.lit(False)).alias("_masked"))
    sent = packed.join(times, "_ts").withColumn("_at", F.unix_micros(F.col("_ts").cast("timestamp")))
    n_x, n_y = len(features), len(labels)
    scale = [np.array([(stats or {}).get(c, (0.0, 1.0)) for c in names], dtype=np.float64).reshape(-1, 2) for names in (features, labels)]
    least = None if min_end is None else int(np.datetime64(min_end, "us").astype("int64"))
    names = ["end_at", "start_at", "x", "y", "mask", "label_mask"]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.float32()), pa.list_(pa.float32()), pa.list_(pa.bool_()), pa.list_(pa.bool_())]

    def filled(table: pa.Table, column: str, width: int, bounds: np.ndarray) -> np.ndarray:
        x = np.full((len(table), width), np.nan)
        if width:
            x[:] = table.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        x[~np.isfinite(x)] = np.nan
        return np.nan_to_num((x - bounds[:, 0]) / bounds[:, 1], nan=np.nan, posinf=np.nan, neginf=np.nan)

    def build(table: pa.Table) -> pa.Table:
        at, halo = table.column("_at").to_numpy(), table.column("_halo").to_numpy()
        order, t = np.unique(at, return_inverse=True)
        own = np.zeros(len(order), dtype=bool)
        own[t[~halo]] = True
        n, ok = table.column("_node").to_numpy(), ~table.column("_masked").to_numpy()
        x, y = filled(table, "_x", n_x, scale[0]), filled(table, "_y", n_y, scale[1])
        dense, given = np.zeros((len(order), n_nodes, n_x), np.float32), np.zeros((len(order), n_nodes), bool)
        target, known = np.zeros((len(order), n_nodes, n_y), np.float32), np.zeros((len(order), n_nodes, n_y), bool)
        here = (n >= 0) & (n < n_nodes)
        for k in range(n_x):
            good = here & ~np.isnan(x[:, k])
            dense[t[good], n[good], k] = x[good, k]
        for k in range(n_y):
            good = here & ok & ~np.isnan(y[:, k])
            target[t[good], n[good], k], known[t[good], n[good], k] = y[good, k], True
        good = here & ok & (~np.isnan(y).all(1) if n_y else True)
        given[t[good], n[good]] = True
        ends = [e for e in range(lookback, len(order)) if own[e] and (least is None or order[e] >= least)]
        columns = [[order[e] for e in ends], [order[e - lookback] for e in ends], [dense[e - lookback : e + 1].ravel() for e in ends], [target[e].ravel() for e in ends], [given[e] for e in ends], [known[e].ravel() for e in ends]]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    out = sent.groupBy("_block").applyInArrow(build, "end_at long, start_at long, x array<float>, y array<float>, mask array<boolean>, label_mask array<boolean>")
    kind = panel.schema[ts].dataType
    return out.select(*[F.timestamp_micros(a).cast(kind).alias(b) for a, b in (("end_at", "end_ts"), ("start_at", "start_ts"))], "x", "y", "mask", "label_mask")
