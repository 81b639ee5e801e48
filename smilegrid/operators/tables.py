"""Sinks' row rules, dedupe and reports on the quality of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .frames import first_rows


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str], order: list) -> DataFrame:
    """Rows of ``new`` whose key is not in ``old``; of equal keys in ``new`` the first counts."""
    return first_rows(new, key, order).join(old.select(*key), key, "left_anti")


def surely_new(rows: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Of rows whose key isn't found in ``old`` those that NOT IN keeps: one without a key only if ``old`` is empty, and none if a row of ``old`` has no key."""
    keys = old.agg(F.count("*").alias("_n"), F.count(key).alias("_known"))  # one row
    safe = (F.col("_n") == 0) | (F.col(key).isNotNull() & (F.col("_n") == F.col("_known")))
    return rows.crossJoin(F.broadcast(keys)).where(safe).drop("_n", "_known")


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: list) -> DataFrame:
    """Both, with the later row of each key; any row of ``new`` is later than all of ``old``."""
    both = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    return first_rows(both, key, [F.desc("_age"), *order]).drop("_age")


def bars(ticks: DataFrame, by: list[str], price: str, volume: str, order: list[str]) -> DataFrame:
    """Open, high, low, close and volume of each group, open and close by order."""
    at = F.struct(*order)
    return ticks.groupBy(*by).agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.sum(volume).alias("volume"))


def null_report(frame: DataFrame, columns: list[str], most: float) -> DataFrame:
    """column_name, nulls, ratio and severity of each column with nulls: WARNING up to ``most``, else ERROR."""
    counts = frame.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    rows = counts.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in columns])).alias("x")).select("n", "x.*")
    share = F.try_divide("nulls", "n")
    return rows.where("nulls > 0").select("column_name", "nulls", share.alias("ratio"), F.when(share <= most, "WARNING").otherwise("ERROR").alias("severity"))


def duplicate_report(frame: DataFrame, key: list[str]) -> DataFrame:
    """Groups that share a key, and all rows in them."""
    return frame.groupBy(*key).count().where("count > 1").agg(F.count("*").alias("groups"), F.coalesce(F.sum("count"), F.lit(0)).alias("rows"))


def range_report(frame: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """For each column its least and greatest value and how many lie outside the bounds."""
    flat = [F.struct(F.lit(c).alias("column_name"), F.min(c).cast("double").alias("least"), F.max(c).cast("double").alias("greatest"), F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias("outside")) for c, (lo, hi) in bounds.items()]
    return frame.agg(F.array(*flat).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def backward_steps(frame: DataFrame, ts: str, by: list[str], order: list[str]) -> DataFrame:
    """How often time runs backwards in each group, in order of arrival."""
    last = F.lag(ts).over(Window.partitionBy(*by).orderBy(*order))
    return frame.withColumn("_last", last).groupBy(*by).agg(F.count_if(F.col(ts) < F.col("_last")).alias("backward"))


def bad_bars() -> Column:
    """Whether a complete bar breaks an inequality of open, high, low and close."""
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return (h < low) | (h < o) | (h < c) | (low > o) | (low > c)


def missing_columns(frame: DataFrame, required: list[str]) -> DataFrame:
    """An ERROR row for each required column that the frame lacks."""
    lacks = [(f"missing_{c}", "ERROR", 0) for c in required if c not in frame.columns]
    return frame.sparkSession.createDataFrame(lacks, "check string, severity string, rows long")


def quote_issues(quotes: DataFrame) -> DataFrame:
    """check, severity and rows: crossed quotes warn, negative prices are errors; nothing where there are none."""
    counts = quotes.agg(F.count_if(F.col("bid") > F.col("ask")).alias("crossed"), F.count_if((F.col("bid") < 0) | (F.col("ask") < 0)).alias("negative"))
    parts = F.array(*[F.struct(F.lit(k).alias("check"), F.lit(v).alias("severity"), F.col(k).alias("rows")) for k, v in (("crossed", "WARNING"), ("negative", "ERROR"))])
    return counts.select(F.explode(parts).alias("x")).select("x.*").where("rows > 0")


def null_issues(frame: DataFrame, columns: list[str], most: float = 0.0) -> DataFrame:
    return null_report(frame, columns, most).select(F.concat(F.lit("null_"), "column_name").alias("check"), "severity", F.col("nulls").alias("rows"))


def validate(frames: dict[str, tuple[DataFrame, list[DataFrame]]]) -> DataFrame:
    """Every table's issues: data, check, severity, rows."""
    parts = [issues.select(F.lit(name).alias("data"), "check", "severity", "rows") for name, (_, checks) in frames.items() for issues in checks]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def rollup(issues: DataFrame, totals: DataFrame) -> DataFrame:
    """passed (no ERROR), issues and total_rows of each table; totals: data, total_rows."""
    own = issues.groupBy("data").agg(F.count("*").alias("issues"), F.bool_and(F.col("severity") != "ERROR").alias("passed"))
    rows = totals.groupBy("data").agg(F.sum("total_rows").alias("total_rows")).join(own, "data", "left")
    return rows.select("data", F.coalesce("passed", F.lit(True)).alias("passed"), F.coalesce("issues", F.lit(0)).alias("issues"), "total_rows")


def statistics_rows(frame: DataFrame, kinds: list[int]) -> DataFrame:
    """Statistics of the wanted types, their time coalesced from ts_event, the last of each (symbol, time, type) by place."""
    rows = frame.where(F.col("stat_type").isin(kinds)).withColumn("ts_ref", F.coalesce("ts_ref", "ts_event"))
    return first_rows(rows, ["symbol", "ts_ref", "stat_type"], [F.desc("place")])


def chain_filter(symbols: DataFrame, spot: Column, as_of: Column, *, dte: tuple[int, int], moneyness: tuple[float, float], most: int) -> DataFrame:
    """Options (symbol, expiry, right, strike) within days to expiry and moneyness, both ends included, and of each expiry and
    right the ``most`` nearest the spot; ties by symbol."""
    rows = symbols.where(F.date_diff("expiry", as_of).between(*dte) & (F.col("strike") / spot).between(*moneyness))
    return first_rows(rows, ["expiry", "right"], [F.abs(F.col("strike") - spot), "symbol"], most)


def latest_snapshot(frame: DataFrame, ts: str, upto: Column | None = None) -> DataFrame:
    """The rows of the latest time (at or before ``upto``)."""
    rows = frame if upto is None else frame.where(F.col(ts) <= upto)
    last = rows.agg(F.max(ts).alias(ts))  # one row
    return rows.join(F.broadcast(last), ts, "left_semi")


def aligned(observations: DataFrame, mode: str, *, observed: str = "observed", release: str = "release", delay_days: int = 2) -> DataFrame:
    """``observations`` with ts, when they may be used: "strict" keeps those with a release and takes it, "conservative" takes the day observed plus a delay, whatever the release."""
    if mode == "strict":
        return observations.where(F.col(release).isNotNull()).withColumn("ts", F.col(release).cast("timestamp"))
    if mode != "conservative":
        raise ValueError(f"unknown mode {mode}")
    return observations.withColumn("ts", F.date_add(F.col(observed).cast("date"), delay_days).cast("timestamp"))


def known_values(asks: DataFrame, vintages: DataFrame, by: list[str], *, asked: str, known: str, observed: str, tie: str, value: str, days: int = 90) -> DataFrame:
    """As-of in two times: for each ask the value of the latest day ``observed`` among vintages ``known`` by then, no more than ``days`` before it.

    Of one day's revisions the last known counts (then the greatest ``tie``). Both sides are cut into cells of ``days``, a vintage
    is sent to its own cell and the next, so a key's whole history never meets all its asks; asks without a vintage are left out.
    """
    width = days + 1
    cell = lambda x: F.floor(F.datediff(F.col(x).cast("date"), F.lit("1970-01-01").cast("date")) / width)
    left = asks.withColumn("_cell", cell(asked))
    right = vintages.select(*by, F.col(known).alias("_known"), F.struct(F.col(observed).alias("o"), F.col(known).alias("k"), F.col(tie).alias("t"), F.col(value).alias("v")).alias("_row"), F.explode(F.array(cell(observed), cell(observed) + 1)).alias("_cell"))
    both = left.join(right, [*by, "_cell"]).where((F.col("_known") <= F.col(asked)) & (F.col("_row.o") >= F.date_sub(F.col(asked).cast("date"), days)) & (F.col("_row.o") <= F.col(asked).cast("date")))
    return both.groupBy(*by, asked).agg(F.max("_row").alias("_row")).select(*by, asked, F.col("_row.v").alias("value"), F.col("_row.o").alias("observed"))


def check(name: str, severity: str, broken: Column, *, all_rows: bool = False) -> tuple[str, str, Column]:
    """An issue's name and severity, and how many rows break it; with ``all_rows`` it is one only if each row does (then all count)."""
    count = F.count_if(F.coalesce(broken, F.lit(False)))
    return name, severity, F.when(count == F.count("*"), count).otherwise(0) if all_rows else count


def column_checks(columns: list[str]) -> list[tuple[str, str, Column]]:
    """Columns without any value are errors, NaNs warn."""
    nan = lambda c: F.coalesce(F.isnan(F.col(c).try_cast("double")), F.lit(False))
    return [x for c in columns for x in (check(f"empty_{c}", "ERROR", F.col(c).isNull() | nan(c), all_rows=True), check(f"nan_{c}", "WARNING", nan(c)))]


def series_checks(series: str, value: str, bounds: dict[str, tuple[float, float]]) -> list[tuple[str, str, Column]]:
    """For each named series its values outside their bounds; series that nobody named warn together."""
    own = [check(f"range_{s}", "ERROR", (F.col(series) == s) & ~F.col(value).between(low, high)) for s, (low, high) in bounds.items()]
    return [*own, check("unknown_series", "WARNING", ~F.col(series).isin(list(bounds)))]


def one_pass_issues(frame: DataFrame, checks: list[tuple[str, str, Column]]) -> DataFrame:
    """check, severity and rows of all checks that some row breaks, from one aggregate."""
    counts = frame.agg(*[c.alias(f"_{i}") for i, (_, _, c) in enumerate(checks)])
    parts = F.array(*[F.struct(F.lit(n).alias("check"), F.lit(s).alias("severity"), F.col(f"_{i}").cast("long").alias("rows")) for i, (n, s, _) in enumerate(checks)])
    return counts.select(F.explode(parts).alias("x")).select("x.*").where("rows > 0")


def first_known(frame: DataFrame, key: list[str], order: list, ts: str) -> DataFrame:
    """Rows with a time, the first of each key."""
    return first_rows(frame.where(F.col(ts).isNotNull()), key, order)


def null_samples(frame: DataFrame, columns: list[str], key: str, most: int = 5) -> DataFrame:
    """column_name, nulls and the least ``most`` keys of the rows where a column has no value; columns without such rows are left out."""
    empty = F.explode(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]))).alias("column_name")
    rows = frame.select(F.col(key).alias("_key"), empty)
    first = first_rows(rows, ["column_name"], ["_key"], most)  # kept in each task before they are shuffled
    named = first.groupBy("column_name").agg(F.array_sort(F.collect_list("_key")).alias("samples"))
    return rows.groupBy("column_name").agg(F.count("*").alias("nulls")).join(named, "column_name")
