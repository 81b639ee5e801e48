"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .words import written

MOST_ROUNDS = 40


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links every neighbour (large: of greater id) of a vertex to the least vertex around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = both.join(least, "u")
    if large:
        pairs = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        pairs = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return pairs.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex that has a link; component is the least id reachable.

    ``edges`` has long columns u and v. No group is gathered: each step is a minimum with partial
    aggregation and a join that may be split. Each round is written to the shared folder.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    for _ in range(MOST_ROUNDS):
        now = written(_star(_star(now, True), False), "links")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    roots = now.groupBy("v").agg(F.count("*").alias("n")).select(F.col("v").alias("id"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
