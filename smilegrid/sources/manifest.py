"""Symbol manifests: nested JSON with a map by expiry and a hash of its settings; lists and objects are read alike."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, functions as F


def config_hash(settings: dict) -> str:
    """The first 16 hex digits of the SHA-256 of the settings as JSON with sorted names."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()[:16]


def build(symbols: DataFrame, by: list[str], settings: dict, *, symbol: str = "symbol", expiry: str = "expiry") -> DataFrame:
    """(by, manifest): one JSON object for each group of chosen symbols: sorted symbols, count, those by expiry, settings and their hash.

    A manifest is as small as what was chosen for it (``tables.chain_filter`` caps it by expiry and side); repeated and NULL symbols count once and not at all.
    """
    rows = symbols.where(F.col(symbol).isNotNull()).select(*by, F.col(symbol).cast("string").alias("_s"), F.coalesce(F.date_format(expiry, "yyyy-MM-dd"), F.lit("")).alias("_e")).distinct()
    days = rows.groupBy(*by, "_e").agg(F.array_sort(F.collect_set("_s")).alias("_s"))
    out = days.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_e", "_s"))).alias("_d"))
    names = F.array_sort(F.array_distinct(F.flatten(F.transform("_d", lambda d: d["_s"]))))
    meta = F.struct(F.size(names).alias("symbols_count"), F.size("_d").alias("expiries_count"), F.lit(config_hash(settings)).alias("config_hash"), *[F.lit(v).alias(k) for k, v in sorted(settings.items())])
    return out.select(*by, F.to_json(F.struct(names.alias("symbols"), meta.alias("metadata"), F.map_from_entries("_d").alias("symbols_by_expiry"))).alias("manifest"))


def symbols_of(manifests: DataFrame, column: str = "manifest") -> DataFrame:
    """A row for each symbol: the other columns, symbol, and expiry (the first) where the manifest groups by it.

    A manifest is a list of symbols or an object with ``symbols``; anything else, broken JSON included, holds none. A symbol that is
    repeated, or in two manifests with the same other columns, comes once; NULL symbols don't count.
    """
    rest = [F.col(f"`{c}`") for c in manifests.columns if c != column]
    rows = manifests.withColumn("_v", F.try_parse_json(column))
    listed = F.coalesce(F.try_variant_get("_v", "$", "array<string>"), F.try_variant_get("_v", "$.symbols", "array<string>"))
    grouped = F.map_entries(F.try_variant_get("_v", "$.symbols_by_expiry", "map<string, array<string>>"))
    own = F.transform(listed, lambda s: F.struct(s.alias("s"), F.lit(None).cast("string").alias("e"), F.lit(True).alias("listed")))
    of = F.flatten(F.transform(grouped, lambda g: F.transform(g["value"], lambda s: F.struct(s.alias("s"), g["key"].alias("e"), F.lit(False).alias("listed")))))
    none = F.array().cast("array<struct<s:string,e:string,listed:boolean>>")
    rows = rows.select(*rest, F.explode(F.concat(F.coalesce(own, none), F.coalesce(of, none))).alias("_x"))
    rows = rows.where("_x.s IS NOT NULL").groupBy(*rest, F.col("_x.s").alias("symbol")).agg(F.min(F.nullif("_x.e", F.lit(""))).alias("_e"), F.bool_or("_x.listed").alias("_listed"))
    return rows.where("_listed").select(*rest, "symbol", F.expr("try_cast(_e AS date)").alias("expiry"))


def save(manifests: DataFrame, path: str, column: str = "manifest") -> None:
    """One manifest a line, under the other columns' names; an existing folder is replaced."""
    manifests.write.mode("overwrite").json(path)


def load(spark: SparkSession, path: str, by: str) -> DataFrame:
    """What ``save`` wrote."""
    return spark.read.schema(f"{by}, manifest string").json(path)
