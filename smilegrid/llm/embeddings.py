"""Near-duplicate vectors: Euclidean p-stable hashing, then exact cosines inside buckets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .components import components
from .words import join_back, mix, runs_of, signed, written

COSINE, WIDTH, MISS, BLOCK, SEED = 0.9, 2.0, 0.005, 512, 11


def _same_cell(distance: float, width: float) -> float:
    """The chance that one quantised Gaussian projection is equal for vectors this far apart."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, cosine: float = COSINE, width: float = WIDTH, miss: float = MISS) -> tuple[int, int]:
    """Projections a table and tables: unrelated vectors should meet a few dozen others in a table,
    and a pair right at the threshold is missed by all tables with chance ``miss`` (nearer pairs far less)."""
    near, far = _same_cell(math.sqrt(2 - 2 * cosine), width), _same_cell(math.sqrt(2), width)
    k = min(16, max(6, math.ceil(math.log(max(n, 64) / 64) / -math.log(far))))
    return k, math.ceil(math.log(miss) / math.log1p(-(near**k)))


def unit(vectors: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows that can link, by length of vector: their places and unit vectors in double precision."""
    sizes = pc.list_value_length(vectors).fill_null(0).to_numpy(zero_copy_only=False)
    out = {}
    for size in np.unique(sizes[sizes > 0]):
        places = np.flatnonzero(sizes == size)
        x = vectors.take(pa.array(places)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(places), size)  # nulls become NaN
        top = np.abs(x).max(axis=1)
        good = np.isfinite(x).all(axis=1) & (top > 0)
        if good.any():
            x = x[good] / top[good, None]
            out[int(size)] = places[good], x / np.linalg.norm(x, axis=1, keepdims=True)
    return out


def table_keys(x: np.ndarray, k: int, tables: int, width: float) -> np.ndarray:
    """A 64-bit bucket key for each vector and table."""
    rng = np.random.default_rng([SEED, x.shape[1]])
    cells = np.floor((x @ rng.standard_normal((x.shape[1], tables * k)) + rng.uniform(0, width, tables * k)) / width).astype(np.int64).astype(np.uint64)
    key = np.broadcast_to(np.arange(tables, dtype=np.uint64) + np.uint64(x.shape[1] << 32), (len(x), tables)).copy()
    for i in range(k):
        key = mix(key * np.uint64(0xC2B2AE3D27D4EB4F) + cells.reshape(len(x), tables, k)[:, :, i])
    return key


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place reachable from each place by the links a-b."""
    label = np.arange(n)
    while True:
        old = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == old).all():
            return label


def near_vectors(frame: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Equal vectors form one class, which is compared once and counts as often as it has members. Classes that share a
    bucket in any table are compared exactly, in double precision, each pair in
    the first table that brings it together. A bucket is cut into blocks of about BLOCK classes and every pair of blocks is
    its own group, so no task holds a bucket; groups give counts and a spanning forest, never their pairs.

    Null, empty or zero vectors, and those with null or non-finite components, link with nothing, nor do vectors of
    different lengths. A row with a null id has no links, a null component and isn't kept; rows that
    repeat an id are one vector, the least of theirs. A table without rows gives none.
    """
    rows = frame.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v"))
    known = rows.where("id is not null").groupBy("id").agg(F.min("v").alias("v"))
    # the text of a vector tells equal ones: numbers are written so that they read back as they were
    known = written(known.withColumn("same", F.sha2(F.col("v").cast("string"), 256)), "vectors")
    classes = written(known.groupBy("same").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "vector-classes")
    k, tables = plan(classes.count(), cosine)
    firsts = classes.select("same", F.col("rep").alias("id"), "n")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, x in unit(batch.column("v")).values():
                key = table_keys(x, k, tables, WIDTH)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * tables), pa.array(signed(key.ravel())))
                part = batch.take(pa.array(places))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n"), part.column("v"), lists], ["id", "n", "v", "keys"])

    reps = known.join(firsts, ["same", "id"]).select("id", "n", "v")  # dealt by both: no key is hot
    reps = written(reps.mapInArrow(keys, f"id long, n long, v {dict(known.dtypes)['v']}, keys array<long>"), "vector-keys")
    keyed = reps.select("id", F.posexplode("keys").alias("t", "key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = keyed.join(sizes, "key").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("id", "t", F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("g"), F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).cast("int").alias("side"))
    dealt = dealt.join(reps, "id").repartition("g").sortWithinPartitions("g")

    def compare(t: int, ids: np.ndarray, n: np.ndarray, side: np.ndarray, x: np.ndarray, own: np.ndarray) -> Iterator[tuple]:
        first = np.flatnonzero(side != 2)
        second = first if side[0] == 0 else np.flatnonzero(side == 2)
        if not len(first) or not len(second):
            return
        a, b = np.nonzero(x[first] @ x[second].T >= cosine)
        a, b = first[a], second[b]
        new = ids[a] < ids[b] if second is first else ids[a] != ids[b]
        a, b = a[new], b[new]
        if t and len(a):  # an earlier table has brought the pair together
            seen = np.concatenate([(own[a[i : i + 100_000], :t] == own[b[i : i + 100_000], :t]).any(1) for i in range(0, len(a), 100_000)])
            a, b = a[~seen], b[~seen]
        if len(a):
            root = _forest(len(ids), a, b)
            yield ids, ids[root], np.bincount(a, n[b], len(ids)) + np.bincount(b, n[a], len(ids))

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs_of(batches, "g"):
            yield from work(table)

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        g, ids, side, t, n = (table.column(c).to_numpy() for c in ("g", "id", "side", "t", "n"))
        own = table.column("keys").chunk(0).flatten().to_numpy().reshape(len(g), tables)
        out: list[tuple] = []
        for places, x in unit(table.column("v").chunk(0)).values():
            for cut in np.split(np.arange(len(places)), np.flatnonzero(np.diff(g[places])) + 1):
                if len(cut) > 1:
                    p = places[cut]
                    out += compare(int(t[p[0]]), ids[p], n[p], side[p], x[cut], own[p])
        if out:
            u, v, links = (np.concatenate(c) for c in zip(*out, strict=True))
            some = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(u[some]), pa.array(v[some]), pa.array(links[some].astype(np.int64))], ["u", "v", "n"])

    found = written(dealt.select("g", "id", "t", "side", "n", "v", "keys").mapInArrow(groups, "u long, v long, n long"), "vector-links")
    counts = found.groupBy("u").agg(F.sum("n").alias("links"))
    linked = components(found.select("u", "v"))
    able = reps.select("id", F.lit(True).alias("able"))  # the classes that can link: their members link with each other
    parts = firsts.join(able, "id", "left").join(counts.withColumnRenamed("u", "id"), "id", "left").join(linked, "id", "left")
    parts = parts.select("same", "n", F.when(F.col("able"), F.coalesce("links", F.lit(0)) + F.col("n") - 1).otherwise(F.lit(0)).alias("n_links"), F.when(F.col("able"), F.coalesce("component", "id")).alias("component"))
    member = join_back(known.select("id", "same"), written(parts, "vector-classes"), "same")
    # rows that repeat an id each get its answer; none of them is hot in the join by id unless one id is
    out = rows.select("id").join(member.select("id", "n_links", "component"), "id", "left")
    own_id = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).alias("n_links"), own_id.alias("component_id"), F.coalesce(F.col("id") == own_id, F.lit(False)).alias("kept"))
