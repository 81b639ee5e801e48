"""Vectorised word hashing shared by the text operators.

Everything works on slices of Arrow string arrays of a bounded number of bytes
(a single longer text is a slice of its own), so a worker's memory follows the
longest text and never the batch.
"""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SLICE_BYTES = 2_000_000
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INV = _U(pow(int(_BASE), -1, 1 << 64))

#: Which bytes separate words.
WHITE_BREAKS = np.zeros(256, dtype=bool)
WHITE_BREAKS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Letters a-z, digits and everything beyond ASCII make words; A-Z are lower-cased first.
ALNUM_BREAKS = np.ones(256, dtype=bool)
ALNUM_BREAKS[0x30:0x3A] = False
ALNUM_BREAKS[0x41:0x5B] = False
ALNUM_BREAKS[0x61:0x7B] = False
ALNUM_BREAKS[0x80:] = False

_powers = {"up": np.ones(1, dtype=_U), "down": np.ones(1, dtype=_U)}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), _BASE if kind == "up" else _INV, dtype=_U)
        steps[0] = 1
        have = _powers[kind] = np.cumprod(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold at most ``limit`` bytes (a longer text comes alone)."""
    texts = batch.column(column)
    sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array in one array, and each text's bounds in it; null counts as empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if len(texts) == 0 or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


def word_spans(data: np.ndarray, bounds: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word, and the bounds of each text in the list of words."""
    inside = ~breaks[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]  # words end where texts end
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, the same in every process."""
    if not len(starts):
        return np.zeros(0, _U)
    sums = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum((data.astype(_U) + _U(1)) * _power("up", len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power("down", len(data))[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def gram_hashes(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """The hash of the n words that start at each word; texts' bounds are the caller's to respect."""
    if len(words) < n:
        return np.zeros(0, _U)
    out = np.full(len(words) - n + 1, _U(seed), dtype=_U)
    for i in range(n):
        out = out * _U(0xC2B2AE3D27D4EB4F) + words[i : len(words) - n + 1 + i]
    return mix(out)


def owner_of_words(bounds: np.ndarray) -> np.ndarray:
    """The text's number for each word."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def runs_of(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Batches sorted by a column, cut anew so that all rows of a value are in one table."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        values = batch.column(column).to_numpy(zero_copy_only=False)
        if rest and rest[-1].column(column)[0].as_py() != values[0]:
            yield pa.Table.from_batches(rest).combine_chunks()
            rest = []
        last = int(np.searchsorted(values, values[-1]))
        if last:
            yield pa.Table.from_batches([*rest, batch.slice(0, last)]).combine_chunks()
            rest = []
        rest.append(batch.slice(last))
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir, set only where unset)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not root:  # one machine, as in tests
        root = f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return os.path.join(root, f"{name}-{uuid.uuid4().hex}")


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read again: it survives lost executors and cuts lineage."""
    path = shared_folder(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that no frame needs any more, before a long job ends."""
    for _ in range(2):  # the first may come before Spark's listeners have let go of the last plan
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.7)


def own_rows(docs: DataFrame, added: tuple[str, ...], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``docs`` that ``keep`` lets through, with the documents' own columns even where it adds ones of their names."""
    aside = {c: f"_own_{c}" for c in docs.columns if c in added}
    return keep(docs.withColumnsRenamed(aside)).select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


#: A key with more than this share (one in so many) of all rows is hot; there are fewer of them than this.
HOT_SHARE = 1_000


def join_back(rows: DataFrame, found: DataFrame, key: str, *, narrow: Column | None = None, blanks: bool = True, most_rows: int | None = None) -> DataFrame:
    """``rows`` left-joined to what was ``found`` for each key, where one key may hold a third of all rows.

    ``found`` has one row a key and the number ``n`` of rows that hold it. Keys with more than one in HOT_SHARE of
    all rows, fewer than HOT_SHARE of them, are broadcast (``narrow`` must hold, where their columns have no fixed size)
    and their rows stay where they are; all other rows are dealt by key. With ``most_rows`` keys of more rows are broadcast too,
    at most one for each so many rows. Rows without a key get NULLs (with ``blanks`` False there are none).
    """
    total = found.agg(F.sum("n")).first()[0] or 0
    large = F.col("n") * HOT_SHARE > total
    if most_rows is not None:
        large |= F.col("n") > most_rows
    hot = F.coalesce(large & (F.lit(True) if narrow is None else narrow), F.lit(False))
    few, rest = found.where(hot).drop("n"), found.where(~hot).drop("n")
    keyed = rows.where(F.col(key).isNotNull()) if blanks else rows
    near = keyed.join(F.broadcast(few), key)
    far = keyed.join(F.broadcast(few.select(key)), key, "left_anti").join(rest, key, "left")
    if not blanks:
        return near.unionByName(far)
    none = rows.where(F.col(key).isNull()).withColumns({c: F.lit(None).cast(t) for c, t in rest.dtypes if c != key})
    return near.unionByName(far).unionByName(none)
