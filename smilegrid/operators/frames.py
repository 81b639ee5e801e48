"""Windows over node time series: prior frames with a least number of values, returns, drawdowns, islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ..functions.scalars import BUCKET_DELTA, clip, ratio

DAY = 1 << 30


def node(by: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def prior(spec: WindowSpec, n: int) -> WindowSpec:
    """The n rows before the current one."""
    return spec.rowsBetween(-n, -1)


def at_least(x: Column, agg: Column, spec: WindowSpec, n: int) -> Column:
    """An aggregate over a frame, NULL unless the frame has n values."""
    return F.when(F.count(x).over(spec) >= n, agg.over(spec))


def prior_mean(x: Column, spec: WindowSpec, n: int, least: int | None = None) -> Column:
    return at_least(x, F.avg(x), prior(spec, n), least or n)


def prior_std(x: Column, spec: WindowSpec, n: int, least: int | None = None) -> Column:
    return at_least(x, F.stddev_samp(x), prior(spec, n), least or n)


def prior_zscore(x: Column, spec: WindowSpec, n: int, least: int | None = None) -> Column:
    """Against the mean and deviation of the rows before; a deviation under 1e-12 gives NULL."""
    std = prior_std(x, spec, n, least)
    return ratio(x - prior_mean(x, spec, n, least), F.when(std >= 1e-12, std))


def change(x: Column, spec: WindowSpec, n: int) -> Column:
    return x - F.lag(x, n).over(spec)


def growth(x: Column, spec: WindowSpec, n: int) -> Column:
    return ratio(x - F.lag(x, n).over(spec), F.lag(x, n).over(spec))


def clipped_growth(x: Column, spec: WindowSpec, n: int) -> Column:
    return clip(growth(x, spec, n), -1.0, 10.0)


def log_return(x: Column, spec: WindowSpec, n: int) -> Column:
    r = ratio(x, F.lag(x, n).over(spec))
    return F.when(r > 0, F.ln(r))


def realized_variance(frame: DataFrame, price: str, by: list[str], order: list[str], windows: tuple[int, ...] = (5, 10, 21), days: int = 252) -> DataFrame:
    """rv_N: annualised variance of the N one-row returns before the current row (two at least)."""
    spec = node(by, order)
    frame = frame.withColumn("_r", growth(F.col(price), spec, 1))
    return frame.withColumns({f"rv_{n}": at_least(F.col("_r"), F.var_samp("_r"), prior(spec, n), 2) * days for n in windows}).drop("_r")


def vol_of_vol(frame: DataFrame, x: str, by: list[str], order: list[str], n: int) -> DataFrame:
    """Deviation over n rows, the current one included, of the prior deviation over n rows."""
    spec = node(by, order)
    frame = frame.withColumn("_s", prior_std(F.col(x), spec, n))
    return frame.withColumn("vol_of_vol", at_least(F.col("_s"), F.stddev_samp("_s"), spec.rowsBetween(1 - n, 0), n)).drop("_s")


def drawdowns(frame: DataFrame, price: str, by: list[str], order: list[str], n: int = 252) -> DataFrame:
    """drawdown against the greatest of the last n rows, and the worst drawdown of the last n rows."""
    spec = node(by, order).rowsBetween(1 - n, 0)
    frame = frame.withColumn("drawdown", ratio(F.col(price), F.max(price).over(spec)) - 1)
    return frame.withColumn("max_drawdown", F.min("drawdown").over(spec))


def drawdown_spells(frame: DataFrame, equity: str, by: list[str], order: list[str]) -> DataFrame:
    """One row for each run of rows below the highest equity so far: its first row's order, and length."""
    spec = node(by, order).rowsBetween(Window.unboundedPreceding, 0)
    frame = frame.withColumn("_down", F.col(equity) < F.max(equity).over(spec))
    frame = frame.withColumn("_island", F.sum(F.when(F.col("_down"), 0).otherwise(1)).over(spec))
    return frame.where("_down").groupBy(*by, "_island").agg(F.count("*").alias("length"), F.min(order[0]).alias("start")).drop("_island")


def steps_per_day(frame: DataFrame, ts: str, by: list[str]) -> DataFrame:
    """The median number of rows a day of each node, cut to a whole number, one at least."""
    daily = frame.groupBy(*by, F.to_date(ts).alias("_day")).agg(F.count("*").alias("_n"))
    return daily.groupBy(*by).agg(F.greatest(F.floor(F.percentile("_n", F.lit(0.5))), F.lit(1)).cast("long").alias("steps"))


def by_days(frame: DataFrame, ts: str, by: list[str], order: list[str]) -> DataFrame:
    """``frame`` with steps, its node's median rows a day, and _at: the row's place in its node, in days of ``steps`` rows, times DAY.

    A shift by a whole number of days moves _at by exactly that many DAYs, so one range frame covers n days' rows of
    every node, whatever its steps; no distinct steps have to be known. Exact while a node has under DAY rows a day."""
    steps = steps_per_day(frame, ts, by).withColumnsRenamed({k: f"_{k}" for k in by})
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by]
    rows = frame.join(steps, same).drop(*[f"_{k}" for k in by])
    return rows.withColumn("_at", place_in_days(F.row_number().over(node(by, order))))


def place_in_days(place: Column) -> Column:
    """A row's place in its node, in days of steps rows, times DAY."""
    return F.floor(place.cast("decimal(20,0)") * DAY / F.col("steps").cast("decimal(20,0)")).cast("long")


def prior_days(by: list[str], n: int) -> WindowSpec:
    """The n days' rows before the current one, of a frame from ``by_days``."""
    return node(by, ["_at"]).rangeBetween(-n * DAY, -1)


def last_days(by: list[str], n: int) -> WindowSpec:
    """The last n days' rows, the current one included."""
    return node(by, ["_at"]).rangeBetween(1 - n * DAY, 0)


def days_ago(x: Column, by: list[str], n: int) -> Column:
    """The value n days' rows before."""
    return F.first(x).over(node(by, ["_at"]).rangeBetween(-n * DAY, -n * DAY))


def full(x: Column, agg: Column, spec: WindowSpec, n: int) -> Column:
    """An aggregate over a frame of n days, NULL unless each of its rows has a value."""
    return F.when(F.count(x).over(spec) >= n * F.col("steps"), agg.over(spec))


def average_rank(x: str, by: list[str]) -> Column:
    """Rank with ties at their mean."""
    return F.rank().over(Window.partitionBy(*by).orderBy(x)) + (F.count("*").over(Window.partitionBy(*by, x)) - 1) / 2


def sums_in_order(frame: DataFrame, by: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``frame`` with running sums of each group, added in ``order``: of doubles every run then gives the same."""
    spec = node(by, order).rowsBetween(Window.unboundedPreceding, 0)
    return frame.withColumns({k: F.sum(v).over(spec) for k, v in sums.items()})


#: Rows that a task sorts at most, if its keys allow.
TASK_ROWS = 500_000


def dealt(frame: DataFrame, by: list[str]) -> DataFrame:
    """``frame`` dealt by its keys to as many tasks as its rows ask for, so that a task's windows sort no more as the input grows."""
    least = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(max(least, -(-frame.count() // TASK_ROWS)), *by)


def first_rows(frame: DataFrame, by: list[str], order: list, n: int = 1) -> DataFrame:
    return frame.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def slope(y: Column, x: Column, least: int, spec: WindowSpec | None = None) -> Column:
    """Least-squares slope over complete pairs, NULL under ``least`` of them."""
    both = y.isNotNull() & x.isNotNull()
    fit, n = F.regr_slope(y, x), F.count(F.when(both, 1))
    return F.when((n.over(spec) if spec else n) >= least, fit.over(spec) if spec else fit)


def delta_or_centre(frame: DataFrame, by: list[str], delta: str = "delta", bucket: str = "bucket") -> DataFrame:
    """``frame`` with x for a slope: a slice's deltas where it has any (rows without one then have no x), else its buckets' centres."""
    centre = F.create_map(*[F.lit(v) for kv in BUCKET_DELTA.items() for v in kv])
    some = F.count(F.when(~F.isnan(delta), F.col(delta))).over(Window.partitionBy(*by)) > 0
    return frame.withColumn("x", F.when(some, F.nanvl(delta, F.lit(None).cast("double"))).otherwise(F.try_element_at(centre, F.col(bucket))))


def curvature(frame: DataFrame, y: str, x: str, by: list[str], least: int = 4) -> DataFrame:
    """Leading coefficient of a quadratic fit for each group, from power sums of centred x."""
    pairs = frame.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    pairs = pairs.withColumn("_u", F.col(x) - F.avg(x).over(Window.partitionBy(*by))).withColumn("_v", F.col(y) - F.avg(y).over(Window.partitionBy(*by)))
    u, v = F.col("_u"), F.col("_v")
    sums = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.sum(u * u).alias("s2"), F.sum(u * u * u).alias("s3"), F.sum(u * u * u * u).alias("s4"), F.sum(u * v).alias("t1"), F.sum(u * u * v).alias("t2"))
    det = F.col("s2") * (F.col("s4") - F.col("s2") * F.col("s2") / F.col("n")) - F.col("s3") * F.col("s3")
    return sums.select(*by, F.when(F.col("n") >= least, ratio(F.col("t2") * F.col("s2") - F.col("t1") * F.col("s3"), det)).alias("curvature"))


def sample_windows(frame: DataFrame, ts: str, lookback: int) -> DataFrame:
    """Start and end of every run of lookback+1 consecutive distinct times."""
    times = frame.select(F.col(ts).alias("end_ts")).distinct()
    spec = Window.orderBy("end_ts")
    return times.withColumn("start_ts", F.lag("end_ts", lookback).over(spec)).where("start_ts is not null")
