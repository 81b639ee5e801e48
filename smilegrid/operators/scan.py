"""Running values and bounded windows of long keys, without a task that holds a key's history.

``prefix_scan`` works on two levels: a key is cut into cells of its order (an hour, a day), each cell is summed up in one row,
a window over those rows gives what each cell begins with, and the values inside a cell start from it. ``in_blocks`` deals a
key's numbered rows into blocks of a fixed size, each with a halo of rows before it, so that any window over so many rows
gives the same result inside a block as over the whole key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from . import frames

_SUMS = {
    "max": lambda x, at: F.max(x), "min": lambda x, at: F.min(x), "sum": lambda x, at: F.sum(x),
    "first": lambda x, at: F.min_by(x, F.when(x.isNotNull(), at)), "last": lambda x, at: F.max_by(x, F.when(x.isNotNull(), at)),
}
_OVER = {"max": F.max, "min": F.min, "sum": F.sum, "first": lambda x: F.first(x, ignorenulls=True), "last": lambda x: F.last(x, ignorenulls=True)}


def prefix_scan(
    frame: DataFrame, by: list[str], order: list[str], cell: Column, scans: dict[str, tuple[str, Column]], whole: dict[str, Callable[[WindowSpec], Column]] | None = None
) -> DataFrame:
    """``frame`` with running values: for each name a kind (max, min, sum, first or last value that isn't NULL) and an expression.

    ``cell`` must not fall along ``order``; a task holds a key's cell, or one row for each of a key's cells. NULLs are skipped,
    a row before the first value gets NULL; NULL keys are a key of their own, rows of a NULL cell come first; columns with the new names are replaced.
    ``whole`` adds values of a whole key: functions of a window over its cells, in which a scan's value of the cell is _x_<name>;
    they come to the rows with the carried values, so no row is joined by its key.
    """
    whole = whole or {}
    rows = frame.drop(*scans, *whole).withColumns({"_cell": cell, "_side": F.lit(1)}).withColumns({f"_x_{k}": x for k, (_, x) in scans.items()})
    at = F.struct(*order)
    sums = rows.groupBy(*by, "_cell").agg(*[_SUMS[kind](F.col(f"_x_{k}"), at).alias(f"_x_{k}") for k, (kind, _) in scans.items()])
    before = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*by, "_cell", F.lit(0).alias("_side"), *[_OVER[kind](F.col(f"_x_{k}")).over(before).alias(f"_x_{k}") for k, (kind, _) in scans.items()], *[f(Window.partitionBy(*by)).alias(k) for k, f in whole.items()])
    upto = Window.partitionBy(*by, "_cell").orderBy("_side", *order).rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(carried, allowMissingColumns=True).withColumns({k: _OVER[kind](F.col(f"_x_{k}")).over(upto) for k, (kind, _) in scans.items()} | {k: F.first(k).over(upto) for k in whole})
    return both.where("_side = 1").drop("_cell", "_side", *[f"_x_{k}" for k in scans])


def numbered(frame: DataFrame, by: list[str], order: list[str], cell: Column, name: str = "_rn") -> DataFrame:
    """Each row's place in its key, from 1."""
    return prefix_scan(frame, by, order, cell, {name: ("sum", F.lit(1).cast("long"))})


def _dealt(rows: DataFrame, halo: Column, size: int) -> DataFrame:
    """Rows with their place _rn, once in their own block and, among its last ``halo``, once more before the next."""
    place, width = F.col("_rn") - 1, F.greatest(F.lit(size).cast("long"), halo)
    own = F.struct(F.call_function("div", place, width).alias("_block"), F.lit(False).alias("_halo"))
    next_ = F.struct((F.call_function("div", place, width) + 1).alias("_block"), F.lit(True).alias("_halo"))
    rows = rows.withColumn("_in", F.explode(F.when(place % width >= width - halo, F.array(own, next_)).otherwise(F.array(own))))
    return rows.select("*", "_in.*").drop("_in", "_rn")


def in_blocks(frame: DataFrame, by: list[str], order: list[str], cell: Column, halo: int, size: int = 10_000) -> DataFrame:
    """``frame`` with _block and _halo: a key's rows in blocks of ``size``, each preceded by copies of the ``halo`` rows before it."""
    return _dealt(numbered(frame, by, order, cell), F.lit(halo).cast("long"), size)


def windowed(frame: DataFrame, by: list[str], order: list[str], cell: Column, halo: int, build: Callable[[DataFrame, list[str]], DataFrame], size: int = 10_000) -> DataFrame:
    """What ``build(rows, keys)`` gives for windows that look at most ``halo`` rows back (all its windows together), built block by block."""
    return build(in_blocks(frame, by, order, cell, halo, size), [*by, "_block"]).where("NOT _halo").drop("_block", "_halo")


def day_blocks(frame: DataFrame, ts: str, by: list[str], order: list[str], days: int, size: int = 10_000) -> DataFrame:
    """``frame`` with steps and _at of ``frames.by_days``, and _block and _halo: each node's rows in blocks of ``size`` (or of the halo,
    where that is longer), preceded by copies of its last ``days`` days' rows.

    ``order`` begins with ``ts``. Cells are a node's days: their counts give the node's steps and its rows' places, so
    no row is joined or sorted by its node alone; a task holds a node's day, or a block with its halo.
    """
    median = lambda node: F.greatest(F.floor(F.percentile("_x__rn", F.lit(0.5)).over(node)), F.lit(1)).cast("long")
    rows = prefix_scan(frame, by, order, F.to_date(ts), {"_rn": ("sum", F.lit(1).cast("long"))}, {"steps": median})
    return _dealt(rows.withColumn("_at", frames.place_in_days(F.col("_rn"))), F.col("steps") * days, size)


def day_windowed(frame: DataFrame, ts: str, by: list[str], order: list[str], days: int, build: Callable[[DataFrame, list[str]], DataFrame], size: int = 10_000) -> DataFrame:
    """What ``build(rows, keys)`` gives for frames of ``frames.prior_days`` and its like that look at most ``days`` days back (all together), block by block."""
    rows = build(day_blocks(frame, ts, by, order, days, size), [*by, "_block"])
    return rows.where("NOT _halo").drop("_block", "_halo", "_at")


def peaks(frame: DataFrame, equity: str, by: list[str], order: list[str], cell: Column) -> DataFrame:
    """peak, the highest equity so far, and drawdown_pct, the share of it that is lost."""
    rows = prefix_scan(frame, by, order, cell, {"peak": ("max", F.col(equity))})
    return rows.withColumn("drawdown_pct", F.try_divide(F.col("peak") - F.col(equity), F.col("peak")))


def spells(frame: DataFrame, equity: str, by: list[str], order: list[str], cell: Column) -> DataFrame:
    """One row for each run of rows below the highest equity so far: length and first time; two scans, then a count by run."""
    rows = peaks(frame, equity, by, order, cell).withColumn("_down", F.col(equity) < F.col("peak"))
    rows = prefix_scan(rows, by, order, cell, {"_island": ("sum", F.when(F.col("_down"), 0).otherwise(1).cast("long"))})
    return rows.where("_down").groupBy(*by, "_island").agg(F.count("*").alias("length"), F.min(order[0]).alias("start")).drop("_island")


def latched(frame: DataFrame, reason: Column, by: list[str], order: list[str], cell: Column) -> DataFrame:
    """kill_reason: the first reason that was given, from its row on."""
    return prefix_scan(frame, by, order, cell, {"kill_reason": ("first", reason)})


def latch(frame: DataFrame, condition: Column, by: list[str], order: list[str], cell: Column) -> DataFrame:
    """killed: the condition has held on this row or any before."""
    return prefix_scan(frame, by, order, cell, {"killed": ("max", F.coalesce(condition, F.lit(False)))})


def unfolded(frame: DataFrame, by: list[str], order: list[str], cell: Column, size: int, stride: int) -> DataFrame:
    """Each row once for every whole patch of ``size`` rows, a ``stride`` apart, that holds it: the columns, patch and place (both from 0).

    Rows are dealt to patches by their number, so no key's history is one row. Patches that a key's end cuts short are left out.
    """
    rows = numbered(frame, by, order, cell).withColumn("_r", F.col("_rn") - 1)
    first = F.greatest(F.ceil((F.col("_r") - size + 1) / stride), F.lit(0)).cast("long")
    last = F.call_function("div", F.col("_r"), F.lit(stride))
    rows = rows.where(first <= last).withColumn("patch", F.explode(F.sequence(first, last)))
    whole = Window.partitionBy(*by, "patch")
    return rows.withColumns({"place": F.col("_r") - F.col("patch") * stride, "_n": F.count("*").over(whole)}).where(F.col("_n") == size).drop("_n", "_r", "_rn")
