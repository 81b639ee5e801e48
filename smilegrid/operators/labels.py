"""Forward labels, splits, normalisation, dense grids and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import ratio
from .frames import average_rank, dealt, first_rows


def trading_days(bars: DataFrame, ts: str) -> DataFrame:
    """day and its number; there is one row a calendar day, so one task may number them."""
    return bars.select(F.to_date(ts).alias("day")).distinct().withColumn("day_no", F.row_number().over(Window.orderBy("day")))


def hedged_labels(panel: DataFrame, bars: DataFrame, horizons: tuple[int, ...], *, node: list[str], ts: str = "ts", price: str = "close", mid: str = "mid", delta: str = "delta", key: list[str] | None = None) -> DataFrame:
    """y_H = change of the node's mid minus delta times change of the spot, over H trading days.

    ``key``: columns of both sides that tell the bars of one time apart and order them; without it a panel row takes the last of its time's.
    The spot at the end is the bar at the same place within its day, or that day's last; the mid at the end is the
    node's last of that day. NULL where any of them is missing."""
    days = trading_days(bars, ts)
    at = [ts, *(key or [])]
    place = F.row_number().over(Window.partitionBy("day").orderBy(*at))
    spots = bars.withColumn("day", F.to_date(ts)).join(days, "day").withColumn("place", place).withColumn("places", F.count("*").over(Window.partitionBy("day")))
    spots = spots.select(*at, "day_no", "place", "places", F.col(price).alias("spot"))
    steps = F.explode(F.array(*[F.lit(h) for h in horizons])).alias("_h")
    each = lambda v, name: [F.max(F.when(F.col("_h") == h, F.col(v))).alias(f"{name}_{h}") for h in horizons]
    # bars and nodes' days are few beside panel rows: their ends are found for all horizons first, and each panel row is joined to them once
    sizes = spots.groupBy(F.col("day_no").alias("_to")).agg(F.max("place").alias("_size"))
    ends = spots.select("day_no", "place", steps).withColumn("_to", F.col("day_no") + F.col("_h")).join(sizes, "_to").withColumn("_place", F.least("place", "_size"))
    ends = ends.join(spots.select(F.col("day_no").alias("_to"), F.col("place").alias("_place"), F.col("spot").alias("_spot")), ["_to", "_place"]).groupBy("day_no", "place").agg(*each("_spot", "_end_spot"))
    own = spots if key else first_rows(spots, [ts], [F.desc("place")])
    rows = panel.join(own.join(ends, ["day_no", "place"], "left").drop("places"), at, "left")
    last = rows.where(F.col(mid).isNotNull() & F.col("day_no").isNotNull()).groupBy(*node, "day_no").agg(F.max_by(mid, ts).alias("_mid"))
    last = last.select(*node, "day_no", "_mid", steps).withColumn("day_no", F.col("day_no") - F.col("_h")).groupBy(*node, "day_no").agg(*each("_mid", "_end_mid"))
    rows = rows.join(last, [*node, "day_no"], "left")
    out = {f"y_{h}": F.col(f"_end_mid_{h}") - F.col(mid) - F.col(delta) * (F.col(f"_end_spot_{h}") - F.col("spot")) for h in horizons}
    return rows.withColumns(out).drop(*[f"_end_{k}_{h}" for k in ("mid", "spot") for h in horizons])


def exact_percentiles(frame: DataFrame, column: str, shares: tuple[float, ...], few: int = 10_000) -> list[float | None]:
    """Interpolated percentiles of the whole column, NULLs left out and NaN greatest; of none, None.

    Values and their counts are dealt by value. Cut points narrow them to the interval around each rank, with exact
    counts below, until it has at most ``few`` distinct values; only those are read, so no task holds the column."""
    values = frame.select(F.col(column).cast("double").alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n")).persist()
    try:
        known = values.where(~F.isnan("v"))
        total, rows, kinds = values.agg(F.sum("n"), F.sum(F.when(~F.isnan("v"), F.col("n"))), F.count_if(~F.isnan("v"))).first()
        return [_at_rank(known, share * (total - 1), rows or 0, kinds, few) if total else None for share in shares]
    finally:
        values.unpersist()


def _at_rank(part: DataFrame, place: float, rows: int, kinds: int, few: int) -> float:
    first, below = int(place), 0
    last = min(first + (place > first), rows - 1)
    if first + (place > first) >= rows:  # a NaN is part of it
        return float("nan")
    while kinds > few:
        cuts = sorted(set(part.agg(F.percentile_approx("v", [i / 200 for i in range(1, 200)], F.lit(10_000))).first()[0]))
        part = part.withColumn("_b", F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda x: x < F.col("v"))))
        counts, upto, own = sorted(part.groupBy("_b").agg(F.sum("n"), F.count("*")).collect()), below, []
        for b, n, k in counts:  # at most 200
            if upto <= last and upto + n > first:
                own.append((b, upto, k))
            upto += n
        if sum(k for _, _, k in own) >= kinds:
            raise RuntimeError("the cut points of a percentile do not part its values")
        below, kinds = own[0][1], sum(k for _, _, k in own)
        part = part.where(F.col("_b").between(own[0][0], own[-1][0])).drop("_b")
    found = []
    for v, n in sorted(part.select("v", "n").collect()):  # at most ``few``
        found += [v] * sum(below <= r < below + n for r in range(first, last + 1))
        below += n
    return (first + 1 - place) * found[0] + (place - first) * found[-1]


def winsorize(frame: DataFrame, column: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Clip to exact percentiles of the whole column."""
    x = F.col(column)
    lo, hi = (F.lit(v).cast("double") for v in exact_percentiles(frame, column, (low, high)))
    return frame.withColumn(column, F.when(x < lo, lo).when(x > hi, hi).otherwise(x))


def null_past(label: str, day_no: Column, horizon: int, boundary: Column) -> Column:
    """A label that looks over a split's boundary is unknown."""
    return F.when(day_no + horizon < boundary, F.col(label))


def node_normalise(frame: DataFrame, column: str, by: list[str]) -> DataFrame:
    """(x - mean) / deviation for each node, 0 where unknown; a tiny or unknown deviation counts as 1."""
    own = Window.partitionBy(*by)
    std = F.stddev_samp(column).over(own)
    return frame.withColumn("z", F.coalesce((F.col(column) - F.avg(column).over(own)) / F.when(std >= 1e-10, std).otherwise(1.0), F.lit(0.0)))


def dense_grid(frame: DataFrame, times: DataFrame, nodes: DataFrame, on: list[str]) -> DataFrame:
    """Every time with every node (a small fixed grid), and whatever the frame has for it."""
    return times.join(F.broadcast(nodes), how="cross").join(frame, on, "left")


def pearson(frame: DataFrame, x: str, y: str, by: list[str], least: int = 2) -> DataFrame:
    """Correlation of complete pairs; groups that are short or constant give none."""
    pairs = frame.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    flat = (F.stddev_pop(x) < 1e-10) | (F.stddev_pop(y) < 1e-10)
    return pairs.groupBy(*by).agg(F.when((F.count("*") >= least) & ~flat, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))).alias("ic"))


def spearman(frame: DataFrame, x: str, y: str, by: list[str], least: int) -> DataFrame:
    pairs = dealt(frame.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y), by).withColumns({"_x": average_rank(x, by), "_y": average_rank(y, by)})
    return pearson(pairs, "_x", "_y", by, least)


def demeaned_spearman(frame: DataFrame, x: str, y: str, node: str, ts: str) -> DataFrame:
    """Rank correlation across nodes at each time (three at least), after each node's mean is taken off (two rows at least)."""
    own = Window.partitionBy(node)
    known = frame.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(node, ts, x, y)
    pairs = dealt(known, [node]).withColumns({"_n": F.count("*").over(own), "_dx": F.round(F.col(x) - F.avg(x).over(own), 9), "_dy": F.round(F.col(y) - F.avg(y).over(own), 9)})
    return spearman(pairs.where("_n >= 2"), "_dx", "_dy", [ts], 3)


def losses(x: Column, y: Column, delta: float = 1.0, q: float = 0.5) -> dict[str, Column]:
    e = y - x
    huber = F.when(F.abs(e) <= delta, e * e / 2).otherwise(delta * (F.abs(e) - delta / 2))
    return {"rmse": F.sqrt(F.avg(e * e)), "mae": F.avg(F.abs(e)), "huber": F.avg(huber), "quantile": F.avg(F.greatest(q * e, (q - 1) * e))}


def weighted_loss(error: Column, weight: Column) -> Column:
    return ratio(F.sum(error * weight), F.sum(weight))


def splits(panel: DataFrame, ts: str, train_start: Column, val_start: Column, test_start: Column, test_end: Column) -> DataFrame:
    """A row for each split that a panel row belongs to (each keeps the history before it), and whether a sample may end there."""
    t = F.col(ts)
    ends = (("train", val_start, train_start), ("val", test_start, val_start), ("test", test_end, test_start))
    own = F.filter(F.array(*[F.when(t < end, F.struct(F.lit(n).alias("split"), (t >= first).alias("target"))) for n, end, first in ends]), lambda x: x.isNotNull())
    return panel.withColumn("_s", F.explode(own)).select(*panel.columns, "_s.split", "_s.target")


def split_issues(split_rows: DataFrame, label: str) -> DataFrame:
    """rows and labels (of rows that a sample may end at) of each split, and whether it can be used: at least one label."""
    counts = split_rows.groupBy("split").agg(F.count_if("target").alias("rows"), F.count_if(F.col("target") & F.col(label).isNotNull()).alias("labels"))
    return counts.withColumn("usable", F.col("labels") > 0)


def node_stats(frame: DataFrame, column: str, by: list[str], masked: str | None = None) -> DataFrame:
    """mean and deviation of each node over unmasked values: (value, 1) where there is one, (0, 1) where there is none."""
    ok = F.lit(True) if masked is None else ~F.coalesce(F.col(masked), F.lit(False))
    x = F.when(ok, F.col(column))
    return frame.groupBy(*by).agg(F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"), F.when(F.stddev_samp(x) >= 1e-10, F.stddev_samp(x)).otherwise(1.0).alias("std"))


def global_stats(frame: DataFrame, columns: list[str]) -> DataFrame:
    """mean and deviation of each label over the whole frame: (0, 1) under two values."""
    parts = [F.struct(F.lit(c).alias("label"), F.when(F.count(c) > 1, F.avg(c)).otherwise(0.0).alias("mean"), F.when((F.count(c) > 1) & (F.stddev_samp(c) >= 1e-10), F.stddev_samp(c)).otherwise(1.0).alias("std")) for c in columns]
    return frame.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def normalise_with(frame: DataFrame, column: str, stats: DataFrame, by: list[str]) -> DataFrame:
    """z by statistics of another frame (train's); unknown is 0, and a node without statistics counts as (0, 1)."""
    rows = frame.join(stats, by, "left")
    return rows.withColumn("z", F.coalesce((F.col(column) - F.coalesce("mean", F.lit(0.0))) / F.coalesce("std", F.lit(1.0)), F.lit(0.0))).drop("mean", "std")


def denormalised(value: Column, mean: Column, std: Column) -> Column:
    return value * std + mean


def unfolded(values: Column, length: int, stride: int) -> Column:
    """Overlapping windows of a list: ``length`` long, ``stride`` apart; a list that is too short has none."""
    n = F.floor((F.size(values) - length) / stride).cast("int")
    return F.when(F.size(values) >= length, F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(values, i * stride + 1, length))).otherwise(F.array().cast("array<array<double>>"))


def split_order(split_rows: DataFrame, ts: str, names: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """One row for each split and the next: the end of the one, the start of the other, and whether they are in order (a missing split is)."""
    ends = split_rows.where("target").groupBy().agg(*[f(F.when(F.col("split") == n, F.col(ts))).alias(f"_{k}_{n}") for n in names for k, f in (("min", F.min), ("max", F.max))])
    pairs = [F.struct(F.lit(a).alias("earlier"), F.lit(b).alias("later"), F.col(f"_max_{a}").alias("ends"), F.col(f"_min_{b}").alias("starts")) for a, b in zip(names, names[1:])]
    rows = ends.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
    return rows.withColumn("in_order", F.coalesce(F.col("ends") < F.col("starts"), F.lit(True)))
