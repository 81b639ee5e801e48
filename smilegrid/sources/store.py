"""Parquet tables with range scans and idempotent writes, and small CSV and JSON sinks."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ..operators.frames import first_rows
from ..operators.tables import insert_ignore, upsert


#: A list of values longer than this is joined instead of becoming one long filter.
MOST_IN_FILTER = 1000


def select_rows(rows: DataFrame, *, ts: str | None = None, start: str | None = None, end: str | None = None, equal: dict | None = None, within: dict | None = None, order: list | None = None) -> DataFrame:
    """Rows of [start, end) with the given values, in order if one is named. Bounds and values reach a Parquet scan as pushed filters;
    of a long list of values only the joined ones do not. A None among ``within`` means any value; an empty list gives no rows."""
    if start is not None:
        rows = rows.where(F.col(ts) >= F.lit(start).cast(rows.schema[ts].dataType))
    if end is not None:
        rows = rows.where(F.col(ts) < F.lit(end).cast(rows.schema[ts].dataType))
    for c, v in (equal or {}).items():
        rows = rows.where(F.col(c) == v)
    for c, vs in (within or {}).items():
        if vs is None:
            continue
        vs = list(vs)
        if len(vs) <= MOST_IN_FILTER:
            rows = rows.where(F.col(c).isin(vs))
        else:
            kind = rows.schema[c].dataType.simpleString()
            rows = rows.join(rows.sparkSession.createDataFrame([(v,) for v in set(vs)], f"{c} {kind}"), c, "left_semi")
    return rows.orderBy(*order) if order else rows


def scan(spark: SparkSession, path: str, **chosen: object) -> DataFrame:
    """``select_rows`` of a Parquet table."""
    return select_rows(spark.read.parquet(path), **chosen)


def bars(rows: DataFrame, symbol: str, start: str, end: str, timeframe: str = "1m") -> DataFrame:
    return select_rows(rows, ts="ts", start=start, end=end, equal={"symbol": symbol, "timeframe": timeframe}, order=["ts"])


def option_quotes(rows: DataFrame, start: str, end: str, symbols: list | None = None) -> DataFrame:
    return select_rows(rows, ts="ts", start=start, end=end, within={"symbol": symbols}, order=["ts", "symbol"])


def macro_series(rows: DataFrame, series: str, start: str, end: str) -> DataFrame:
    return select_rows(rows, ts="obs_date", start=start, end=end, equal={"series": series}, order=["obs_date"])


def option_bars(rows: DataFrame, start: str, end: str, symbols: list | None = None, timeframe: str = "1d") -> DataFrame:
    return select_rows(rows, ts="ts", start=start, end=end, equal={"timeframe": timeframe}, within={"symbol": symbols}, order=["ts", "symbol"])


def option_statistics(rows: DataFrame, start: str, end: str, stat_type: int = 9, symbols: list | None = None) -> DataFrame:
    """By the reference time ``ts_ref``; 9 is open interest."""
    return select_rows(rows, ts="ts_ref", start=start, end=end, equal={"stat_type": stat_type}, within={"symbol": symbols}, order=["ts_ref", "symbol"])


def surface_rows(rows: DataFrame, version: str, start: str | None = None, end: str | None = None, buckets: list | None = None) -> DataFrame:
    """Surface snapshots and node panels: one version, optional bounds and buckets; prunes a table partitioned by version."""
    return select_rows(rows, ts="ts", start=start, end=end, equal={"version": version}, within={"bucket": buckets}, order=["ts", "tenor", "bucket"])


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def count(spark: SparkSession, path: str, **scan_args: object) -> int:
    """Rows of a scan; a table that isn't there has none."""
    return scan(spark, path, **scan_args).count() if exists(spark, path) else 0


def append_new(frame: DataFrame, path: str, key: list[str], order: list, partition: str | None = None) -> None:
    """Append rows whose key the table lacks: existing rows win, a repeated write changes nothing."""
    spark = frame.sparkSession
    new = insert_ignore(spark.read.parquet(path), frame, key, order) if exists(spark, path) else first_rows(frame, key, order)
    writer = new.withColumn("ingested_at", F.current_timestamp()).write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def replace_rows(frame: DataFrame, path: str, key: list[str], order: list, partition: str) -> None:
    """Upsert: later rows replace those of their key. Only partitions that ``frame`` touches are rewritten, from a staged copy,
    which stays beside the table if that fails half way: it then holds all rows of those partitions."""
    spark = frame.sparkSession
    if exists(spark, path):
        touched = frame.select(partition).distinct()  # Spark broadcasts it if it is small
        frame = upsert(spark.read.parquet(path).join(touched, partition, "left_semi").select(*frame.columns), frame, key, order)
    else:
        frame = upsert(frame.limit(0), frame, key, order)
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    frame.write.parquet(staged)
    spark.read.parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    remove(spark, staged)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table's folder; one that isn't there is no error."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def write_csv(frame: DataFrame, path: str, *, append: bool = False) -> None:
    """CSV files with a header each, which ``read_csv`` takes as one table. Appended rows must have the columns that are there, in any order."""
    if append and exists(frame.sparkSession, path):
        have = frame.sparkSession.read.option("header", True).csv(path).columns
        if sorted(have) != sorted(frame.columns):
            raise ValueError(f"{path} has the columns {', '.join(have)}")
        frame = frame.select(*[F.col(f"`{c}`") for c in have])
    frame.write.mode("append" if append else "overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def write_json(frame: DataFrame, path: str) -> None:
    frame.write.mode("append").json(path)


def overlapping(rows: DataFrame, start: str, end: str, **equal: object) -> DataFrame:
    """Rows whose interval [min_ts, max_ts] meets [start, end), newest first."""
    bound = lambda x, c: F.lit(x).cast(rows.schema[c].dataType)
    rows = rows.where((F.col("max_ts") >= bound(start, "max_ts")) & (F.col("min_ts") < bound(end, "min_ts")))
    return select_rows(rows, equal=equal, order=[F.desc("min_ts")])


def known_columns(frame: DataFrame, columns: dict[str, str], defaults: dict[str, object] | None = None) -> DataFrame:
    """Only the columns that a table has, in its order; a missing one gets its default, or NULL."""
    have, defaults = set(frame.columns), defaults or {}
    return frame.select(*[(F.coalesce(F.col(c), F.lit(defaults.get(c))) if c in have else F.lit(defaults.get(c))).cast(t).alias(c) for c, t in columns.items()])


def append_log(spark: SparkSession, path: str, row: dict, schema: str) -> None:
    spark.createDataFrame([row], schema).write.mode("append").parquet(path)


def copy_table(spark: SparkSession, source: str, target: str) -> int:
    """Replaces target by source; raises unless both then have as many rows."""
    spark.read.parquet(source).write.mode("overwrite").parquet(target)
    n, m = spark.read.parquet(source).count(), spark.read.parquet(target).count()
    if n != m:
        raise RuntimeError(f"{m} of {n} rows were copied to {target}")
    return n


def table_counts(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """Rows of each named table; 0 where it isn't there."""
    return spark.createDataFrame([(k, count(spark, p)) for k, p in tables.items()], "name string, rows long")


def find_results(results: DataFrame, tags: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Stored results, newest first, that have any of the tags."""
    rows = results if tags is None else results.where(F.arrays_overlap("tags", F.array(*[F.lit(x) for x in tags])))
    rows = rows.orderBy(F.desc("created_at"), "run_id")
    return rows if limit is None else rows.limit(limit)


def write_checked(frame: DataFrame, path: str, checks: list[tuple[str, str, Column]], *, mode: str = "append") -> tuple[DataFrame, int]:
    """Writes ``frame`` and gives the issues (check, severity, rows) that ``tables.one_pass_issues`` would, and its rows: counted while it is written, the source is read once."""
    seen = Observation()
    frame.observe(seen, F.count("*").alias("_rows"), *[c.alias(f"_{i}") for i, (_, _, c) in enumerate(checks)]).write.mode(mode).parquet(path)
    counts = seen.get
    broken = [(n, s, int(counts[f"_{i}"])) for i, (n, s, _) in enumerate(checks) if counts.get(f"_{i}")]
    return frame.sparkSession.createDataFrame(broken, "check string, severity string, rows long"), int(counts["_rows"])


def file_sizes(spark: SparkSession, path: str, partition: str) -> DataFrame:
    """files and bytes of each value of a table's partition column, from the listing: no file is opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path).select("path", "length")
    value = F.url_decode(F.regexp_extract("path", f"/{partition}=([^/]+)/", 1))
    return files.groupBy(value.alias("value")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def vacuum(spark: SparkSession, path: str, partition: str, target_bytes: int = 128 << 20) -> int:
    """Rewrites the partitions that have more files than their bytes need at ``target_bytes`` a file; how many they were.

    Their rows are dealt by a hash into as many files as are needed and staged beside the table first; the staged copy is
    removed only when they are in place. Nobody should write to those partitions meanwhile."""
    sizes = file_sizes(spark, path, partition).withColumn("need", F.greatest(F.ceil(F.col("bytes") / target_bytes), F.lit(1)).cast("int")).where("files > need")
    todo = sizes.agg(F.count("*").alias("n"), F.sum("need").alias("files")).first()
    if not todo["n"]:
        return 0
    table = spark.read.parquet(path)
    same = F.coalesce(table[partition].cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")) == sizes["value"]
    rows = table.join(sizes.select("value", "need"), same).withColumn("_file", F.pmod(F.xxhash64(*table.columns), F.col("need")))
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    rows.repartition(int(min(todo["files"], 100_000)), partition, "_file").select(*table.columns).write.partitionBy(partition).parquet(staged)
    spark.read.schema(table.schema).parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    remove(spark, staged)
    return int(todo["n"])


def clear_groups(spark: SparkSession, root: str, groups: dict[str, list[str]], names: list[str]) -> list[str]:
    """Deletes the tables of some named groups under ``root``; the tables that were there. An unknown group is an error, and nothing is deleted then."""
    unknown = sorted(set(names) - set(groups))
    if unknown:
        raise ValueError(f"unknown groups: {', '.join(unknown)}")
    there = [t for t in dict.fromkeys(t for n in names for t in groups[n]) if exists(spark, f"{root}/{t}")]
    for t in there:
        remove(spark, f"{root}/{t}")
    return there


_RUN = "run_id string, created_at timestamp, tags array<string>, tables array<string>, info string"


def save_result(spark: SparkSession, root: str, run_id: str, tables: dict[str, DataFrame], *, created_at: object, tags: list[str] | None = None, info: dict | None = None) -> None:
    """Writes a run's tables and then its row of the index; a run of that name is replaced. A run without an index row was not finished."""
    for name, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{root}/runs/{run_id}/{name}")
    spark.createDataFrame([(run_id, created_at, tags or [], sorted(tables), json.dumps(info or {}, sort_keys=True))], _RUN).write.mode("append").json(f"{root}/index")


def results(spark: SparkSession, root: str) -> DataFrame:
    """The index: the latest row of each run."""
    return first_rows(spark.read.schema(_RUN).json(f"{root}/index"), ["run_id"], [F.desc("created_at"), "info"])


def load_result(spark: SparkSession, root: str, run_id: str) -> dict[str, DataFrame]:
    """A run's tables."""
    found = results(spark, root).where(F.col("run_id") == run_id).first()
    if found is None:
        raise ValueError(f"no run {run_id}")
    return {t: spark.read.parquet(f"{root}/runs/{run_id}/{t}") for t in found["tables"]}


def latest_result(spark: SparkSession, root: str, tags: list[str] | None = None) -> str | None:
    """The newest run (with any of the tags)."""
    found = find_results(results(spark, root), tags, 1).first()
    return found and found["run_id"]
