"""As-of and lagged joins, without a task that holds a key's whole history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def asof_join(left: DataFrame, right: DataFrame, *, left_on: str = "ts", right_on: str = "ts", by: tuple[str, ...] = (), strict: bool = False, prefix: str = "r_", cell: str = "hour") -> DataFrame:
    """``left`` with the latest ``right`` row at or before each time (``strict``: before), whole rows, NULLs kept.

    Both sides are cut into cells of time (``cell``: a unit of ``date_trunc``). Each cell begins with the last right row of earlier
    cells, found from one row a cell, so a partition is a key's cell however long its history, and no key is needed. Without a
    key only the distinct left times are matched, and the rows are joined to them by time: a minute's million quotes are one time.
    Among right rows of one time the greatest by all its columns counts; a left row without a time matches nothing.
    """
    own = [c for c in right.columns if c not in (right_on, *by)]
    row = F.struct(F.col(right_on).alias("_at"), *[F.col(c) for c in own])
    keys = [F.col(c) for c in by]
    cut = F.date_trunc(cell, "_t")
    points = right.where(F.col(right_on).isNotNull()).select(*keys, F.col(right_on).cast("timestamp").alias("_t"), row.alias("_row"))
    asked = left.select(*keys, F.col(left_on).cast("timestamp").alias("_t"), F.struct(*left.columns).alias("_left"))
    if by:
        times = asked
    else:
        points = points.groupBy("_t").agg(F.max("_row").alias("_row"))
        times = asked.where("_t is not null").select("_t").distinct().withColumn("_left", F.lit(True))
    points, times = points.withColumn("_cell", cut), times.withColumn("_cell", cut)
    ends = points.groupBy(*by, "_cell").agg(F.max(F.struct("_t", "_row")).alias("_last"))
    cells = ends.unionByName(times.select(*by, "_cell").distinct(), allowMissingColumns=True).groupBy(*by, "_cell").agg(F.first("_last", ignorenulls=True).alias("_last"))
    before = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = cells.withColumn("_carry", F.last("_last", ignorenulls=True).over(before)).where("_carry is not null")
    carried = carried.select(*by, F.col("_cell").alias("_t"), F.col("_carry._row").alias("_row"), "_cell", F.lit(0).alias("_side"))
    right_side, left_side = (3, 2) if strict else (1, 2)
    both = carried.unionByName(points.withColumn("_side", F.lit(right_side)), allowMissingColumns=True).unionByName(times.withColumn("_side", F.lit(left_side)), allowMissingColumns=True)
    upto = Window.partitionBy(*by, "_cell").orderBy("_t", "_side", "_row").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_row", F.last("_row", ignorenulls=True).over(upto)).where("_left is not null")
    if not by:
        found = asked.join(found.where("_row is not null").select("_t", "_row"), "_t", "left")
    return found.select("_left.*", F.col("_row._at").alias(f"{prefix}{right_on}"), *[F.col(f"_row.{c}").alias(f"{prefix}{c}") for c in own])


def calendar_lag(value: str, ts: str, days: int, by: tuple[str, ...] = ()) -> Column:
    """The latest value at or before ``days`` days ago; rows of one key and time should be unique."""
    part = f"PARTITION BY {', '.join(by)} " if by else ""
    return F.expr(f"last({value}, true) OVER ({part}ORDER BY {ts} RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL {days} DAYS PRECEDING)")


def outer_merge(frames: list[DataFrame], on: list[str]) -> DataFrame:
    """Full outer join of many frames with one shuffle: their rows are stacked and grouped."""
    stacked = frames[0]
    for f in frames[1:]:
        stacked = stacked.unionByName(f, allowMissingColumns=True)
    return stacked.groupBy(*on).agg(*[F.max(c).alias(c) for c in stacked.columns if c not in on])


def cascade(frame: DataFrame, sources: list[tuple[str, Column]]) -> DataFrame:
    """price and source: the first source that has a value."""
    price = F.coalesce(*[c for _, c in sources])
    name = F.coalesce(*[F.when(c.isNotNull(), n) for n, c in sources])
    return frame.withColumns({"price": price, "source": name})


def nearest_row(left: DataFrame, right: DataFrame, on: list[str], *, target: Column, value: str, over: Column, tie: str) -> DataFrame:
    """For each left row the right row of the same ``on`` whose ``value`` is above ``over`` and nearest to ``target``, which must not be below ``over``.

    One sorted pass over both sides: the nearest row at or below the target and the nearest above it are the only two candidates, so no
    pairs are made. Equal distances and equal values go to the least ``tie``. Left rows without such a row, without a target or
    with a NULL in ``on`` are left out; the right columns (but ``on``) are added to the left ones.
    """
    own = [c for c in right.columns if c not in on]
    known = F.lit(True)
    for c in on:
        known = known & F.col(c).isNotNull()
    points = right.where(known & F.col(value).isNotNull()).groupBy(*on, F.col(value).alias("_x")).agg(F.min(F.struct(F.col(tie).alias("_tie"), F.struct(*own).alias("_all"))).alias("_best"))
    points = points.select(*on, "_x", F.struct("_x", "_best._tie", "_best._all").alias("_row"), F.lit(0).alias("_side"))
    asked = left.where(known & target.isNotNull()).select(*on, target.alias("_x"), F.lit(1).alias("_side"), over.alias("_over"), F.struct(*left.columns).alias("_left"))
    both = points.unionByName(asked, allowMissingColumns=True)
    upto = Window.partitionBy(*on).orderBy("_x", "_side")
    down = F.last("_row", ignorenulls=True).over(upto.rowsBetween(Window.unboundedPreceding, 0))
    up = F.last("_row", ignorenulls=True).over(Window.partitionBy(*on).orderBy(F.desc("_x"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumns({"_down": down, "_up": up}).where("_left is not null")
    gap = lambda r: F.when(F.col(f"{r}._x") > F.col("_over"), F.struct(F.abs(F.col(f"{r}._x") - F.col("_x")).alias("_gap"), F.col(f"{r}._tie").alias("_tie"), F.col(f"{r}._all").alias("_all")))
    both = both.withColumn("_got", F.least(gap("_down"), gap("_up"))).where("_got is not null")
    return both.select("_left.*", *[F.col(f"_got._all.{c}").alias(c) for c in own])
