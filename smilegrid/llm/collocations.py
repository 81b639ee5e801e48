"""Collocations: phrases of two to five words that occur together more often than their parts suggest.

1. Shards of texts become arrays of word ids (zeros between pieces) with their own vocabularies; they are written once.
2. Every shard counts its pairs of words. Pairs are dealt by ranges of their hash, as packed arrays, and added up; a shard
   gets back those of its pairs that reach the least count anywhere. A hash shared by two pairs only keeps one too many.
   What other pairs join can't hold a candidate and is cut away; on the rest the same is done with three words.
3. What is left of a shard is sorted as a suffix array by prefix doubling; the intervals of its LCP array are the phrases
   with their counts. They too are dealt by ranges of their hash, packed, and added up by phrase: words, not hashes, are
   compared here. A phrase comes at most once from each shard, and all shards' phrases are at most the phrases of the text.
4. Parts, cuts and longer phrases are joined to the phrases that reach the least count.

No step holds more than a shard, a range of hashes or a row, and nothing is broadcast unless Spark finds it small.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from .words import LOWER, mix, owner_of_words, text_bytes, word_hashes, word_spans, written

MOST_WORDS = 5
LEAST_COUNT = 100
SHARD_BYTES = 6_000_000
RANGE_GRAMS = 2_000_000
#: Phrases of up to this many words are counted by hash first; reaches are told up to the second number.
FILTERED, DEEPEST = 3, 255
SALTS = 64
_U = np.uint64
PIECE_BREAKS = np.zeros(256, dtype=bool)
PIECE_BREAKS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
BREAKS = PIECE_BREAKS.copy()
BREAKS[[0x20, 0x09]] = True
_SHARD = "lang string, n_words long, ids binary, vocabulary binary"
_REST = "shard long, lang string, ids binary, reach binary, vocabulary binary"
_PACKED = "range long, lang string, phrases array<string>, counts array<long>"
_ZSTD = pa.Codec("zstd", compression_level=1)


def packed_bytes(data: bytes) -> bytes:
    """Bytes compressed, behind their number: a shard is moved a few times."""
    return len(data).to_bytes(8, "little") + _ZSTD.compress(data, asbytes=True)


def unpacked_bytes(data: memoryview) -> pa.Buffer:
    return _ZSTD.decompress(data[8:], int.from_bytes(data[:8], "little"))


def _shard_row(named: dict[str, object], ids: np.ndarray, words: pa.Array, **more: np.ndarray) -> pa.RecordBatch:
    """A row with ids, vocabulary (one word a line: no word holds a line end) and more arrays, all packed."""
    packed = {"ids": ids.tobytes()} | {k: v.tobytes() for k, v in more.items()} | {"vocabulary": "\n".join(words.to_pylist()).encode()}
    return pa.RecordBatch.from_pydict({k: [v] for k, v in named.items()} | {k: pa.array([packed_bytes(v)], pa.binary()) for k, v in packed.items()})


def encoded(texts: pa.Array, langs: pa.Array) -> Iterator[tuple[str, int, np.ndarray, pa.Array]]:
    """For each language of some texts: it, its number of words, word ids from 1 with a 0 between pieces, and the words by id."""
    data, bounds = text_bytes(texts)
    data = LOWER[data]
    starts, ends, word_bounds = word_spans(data, bounds, BREAKS)
    if not len(starts):
        return
    owner = owner_of_words(word_bounds)
    piece = np.cumsum(PIECE_BREAKS[data], dtype=np.int32 if len(data) < 1 << 31 else np.int64)[starts]
    fresh = np.ones(len(starts), dtype=bool)
    fresh[1:] = (piece[1:] != piece[:-1]) | (owner[1:] != owner[:-1])
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    letters = np.ascontiguousarray(data[~BREAKS[data]])
    coded = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(letters)).dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False)
    known = langs.fill_null("und").dictionary_encode()
    which = known.indices.to_numpy(zero_copy_only=False)[owner]
    piece = np.cumsum(fresh)
    for i, lang in enumerate(known.dictionary):
        mine = np.flatnonzero(which == i)
        if not len(mine):
            continue
        own, ranked = np.unique(ids[mine], return_inverse=True)  # numbers follow first places, so common words get small ones
        cut = np.zeros(len(mine), dtype=np.int64)
        cut[1:] = piece[mine][1:] != piece[mine][:-1]
        out = np.zeros(len(mine) + int(cut.sum()), dtype=np.int32)
        out[np.arange(len(mine)) + np.cumsum(cut)] = ranked + 1
        yield lang.as_py(), len(mine), out, coded.dictionary.take(pa.array(own)).cast(pa.string())


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts).combine_chunks()
        texts, langs = (table.column(c).combine_chunks() if table.column(c).num_chunks != 1 else table.column(c).chunk(0) for c in ("text", "lang"))
        for lang, n, ids, vocabulary in encoded(texts, langs):
            yield _shard_row({"lang": lang, "n_words": n}, ids, vocabulary)

    parts, size = [], 0
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(batch):
            upto = max(at + 1, int(np.searchsorted(sizes, SHARD_BYTES - size + (sizes[at - 1] if at else 0), "right")))
            parts.append(batch.slice(at, upto - at))
            size += int(sizes[min(upto, len(batch)) - 1] - (sizes[at - 1] if at else 0))
            at = upto
            if at < len(batch):
                yield from done(parts)
                parts, size = [], 0
    if parts:
        yield from done(parts)


def _hashed(lang: str, words: pa.Array) -> np.ndarray:
    """A hash of every word by its id, another one in each language."""
    data, bounds = text_bytes(words)
    return mix(np.append(_U(0), word_hashes(data, bounds[:-1], bounds[1:])) + _U((zlib.crc32(lang.encode()) + 1) * 0x9FB21C651E98DF25 % (1 << 64)))


def _gram_keys(hashes: np.ndarray, ids: np.ndarray, at: np.ndarray, d: int, bits: int) -> np.ndarray:
    """The leading ``bits`` + 32 bits of the hash of the ``d`` words from each of some places."""
    key = np.zeros(len(at), dtype=_U)
    for j in range(d):
        key = key * _U(0xC2B2AE3D27D4EB4F) + hashes[ids[at + j]]
    return mix(key) >> _U(32 - bits)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, str, np.ndarray, np.ndarray, pa.Array]]:
    """Shard, language, ids, how many words a phrase from each place may have, vocabulary."""
    reaches = batch.column("reach") if "reach" in batch.schema.names else [None] * len(batch)
    for shard, lang, ids, reach, words in zip(*(batch.column(c) for c in ("shard", "lang", "ids")), reaches, batch.column("vocabulary"), strict=True):
        ids, *reach = (np.frombuffer(unpacked_bytes(memoryview(x.as_buffer())), k) for x, k in ((ids, np.int32), (reach, np.uint8)) if x is not None)
        words = pa.array(unpacked_bytes(memoryview(words.as_buffer())).to_pybytes().decode().split("\n"), pa.string())
        yield shard.as_py(), lang.as_py(), ids, reach[0] if reach else to_next(ids == 0), words


def to_next(marks: np.ndarray) -> np.ndarray:
    """From each place the distance to the next mark or the end, at most 255."""
    ends = np.append(np.flatnonzero(marks), len(marks))
    places = np.arange(len(marks))
    return np.minimum(ends[np.searchsorted(ends, places)] - places, DEEPEST).astype(np.uint8)


def _grams(d: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, lang, ids, reach, words in _rows(batch):
                keys, counts = np.unique(_gram_keys(_hashed(lang, words), ids, np.flatnonzero(reach >= d), d, bits), return_counts=True)
                if not len(keys):
                    continue
                ranges = (keys >> _U(32)).astype(np.int64)
                cuts = np.flatnonzero(np.diff(ranges, prepend=-1))
                bounds = list(zip(cuts, [*cuts[1:], len(keys)], strict=True))
                low, counts = keys.astype(np.uint32), counts.astype(np.uint32)
                packed = [pa.array([x[a:b].tobytes() for a, b in bounds], pa.binary()) for x in (low, counts)]
                yield pa.RecordBatch.from_arrays([pa.array(ranges[cuts]), pa.array([shard] * len(cuts), pa.int64()), *packed], ["range", "shard", "grams", "counts"])

    return run


def _frequent(least: int):
    """Of one range's phrases, those of each shard that reach ``least`` over all shards."""

    def run(table: pa.Table) -> pa.Table:
        blobs = table.column("grams").to_pylist()
        grams = np.frombuffer(b"".join(blobs), np.uint32)
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint32)
        distinct, of = np.unique(grams, return_inverse=True)
        total = np.bincount(of, counts, len(distinct))  # doubles are whole far beyond any count here
        good = total[of] >= least
        at = np.concatenate([[0], np.cumsum([len(b) // 4 for b in blobs])])
        kept = [grams[a:b][good[a:b]].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        out = pa.table({"range": table.column("range"), "shard": table.column("shard"), "grams": pa.array(kept, pa.binary())})
        return out.filter(pa.array([len(k) > 0 for k in kept]))

    return run


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``ids`` (zeros are marks between pieces) in the order of at least their first ``depth`` ids, by prefix doubling."""
    rank = ids.astype(np.int64)
    order, known = np.argsort(rank, kind="stable"), 1
    while known < depth and len(ids):
        after = np.zeros_like(rank)
        after[:-known or None] = rank[known:] if known < len(rank) else 0
        key = rank * (rank.max() + 1) + after
        order = np.argsort(key, kind="stable")
        fresh = np.ones(len(key), dtype=np.int64)
        fresh[1:] = key[order][1:] != key[order][:-1]
        rank[order] = np.cumsum(fresh)
        known *= 2
    return order


def lcp_intervals(ids: np.ndarray, reach: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For 2 to ``depth`` words: a first place and the number of places of every phrase within its places' reach."""
    order = suffix_array(ids, depth)
    padded, reach = np.append(ids, np.zeros(depth, ids.dtype)), reach[order]
    same = np.ones(max(len(order) - 1, 0), dtype=bool)  # the LCP with the suffix before is at least d
    for d in range(1, depth + 1):
        at = padded[order + d - 1]
        same &= at[1:] == at[:-1]
        whole = reach >= d
        if d > 1 and whole.any():
            opens = np.flatnonzero(whole & ~np.append(False, same))
            places = np.cumsum(whole)
            yield d, order[opens], np.diff(np.append(places[opens], places[-1] + 1))


def _reaching(d: int, bits: int):
    """Shards cut to what may lie in a phrase of frequent pairs, with what the kept phrases of ``d`` words leave of their reach."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (shard, lang, ids, reach, words), kept in zip(_rows(batch), batch.column("kept"), strict=True):
                found = zip(kept.values.field("range").to_pylist(), kept.values.field("grams").to_pylist(), strict=True) if kept.is_valid else ()
                good = np.sort(np.concatenate([np.zeros(0, _U), *[(_U(r) << _U(32)) | np.frombuffer(b, np.uint32).astype(_U) for r, b in found]]))
                at = np.flatnonzero(reach >= d)
                keys = _gram_keys(_hashed(lang, words), ids, at, d, bits)
                spot = np.searchsorted(good, keys)
                whole = np.zeros(len(ids), dtype=bool)
                whole[at[(spot < len(good)) & (np.append(good, _U(0))[spot] == keys)]] = True
                run = to_next(~whole).astype(np.int64)  # kept phrases that start one after the other
                new = np.where(whole, np.minimum(run + d - 1, DEEPEST), np.minimum(reach, d - 1)).astype(np.uint8)
                used = (new > 1) | np.append(False, new[:-1] > 1)
                mine = np.flatnonzero(used)
                own, ranked = np.unique(ids[mine], return_inverse=True)
                gap = np.append(np.diff(mine) > 1, True)  # a mark between what was not side by side
                place = np.arange(len(mine)) + np.append(0, np.cumsum(gap))[:-1]
                out, far = np.zeros(len(mine) + int(gap.sum()), dtype=np.int32), np.zeros(len(mine) + int(gap.sum()), dtype=np.uint8)
                out[place], far[place] = ranked + 1, new[mine]
                yield _shard_row({"shard": shard, "lang": lang}, out, words.take(pa.array(own - 1)), reach=far)

    return cut


def _packed(lang: str, keys: np.ndarray, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    """One row for each range of ``keys``, with its phrases and their counts."""
    order = np.argsort(keys, kind="stable")
    ranges = (keys[order] >> _U(32)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(ranges, prepend=-1))
    offsets = pa.array(np.append(cuts, len(order)), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, x.take(pa.array(order))) for x in (phrases, pa.array(counts, pa.int64()))]
    return pa.RecordBatch.from_arrays([pa.array(ranges[cuts]), pa.array([lang] * len(cuts), pa.string()), *lists], ["range", "lang", "phrases", "counts"])


def _words(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, lang, ids, _, words in _rows(batch):
                yield _packed(lang, _hashed(lang, words)[1:] >> _U(32 - bits), words, np.bincount(ids, minlength=len(words) + 1)[1:])

    return run


def _phrases(depth: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, lang, ids, reach, words in _rows(batch):
                hashes, parts = _hashed(lang, words), []
                for d, first, counts in lcp_intervals(ids, reach, depth):
                    text = pc.binary_join_element_wise(*[words.take(pa.array(ids[first + j] - 1)) for j in range(d)], " ")
                    parts.append((_gram_keys(hashes, ids, first, d, bits), text, counts))
                if parts:
                    keys, texts, counts = zip(*parts, strict=True)
                    yield _packed(lang, np.concatenate(keys), pa.concat_arrays(texts), np.concatenate(counts))

    return run


def _added(least: int):
    """Of one range's phrases, those that reach ``least`` in their language, with their counts over all shards."""

    def run(table: pa.Table) -> pa.Table:
        lists = [c.combine_chunks() for c in (table.column("phrases"), table.column("counts"))]
        lists = [pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x for x in lists]
        langs = table.column("lang").combine_chunks().take(pc.list_parent_indices(lists[0]))
        rows = pa.table({"lang": langs, "phrase": lists[0].flatten(), "n": lists[1].flatten()}).group_by(["lang", "phrase"]).aggregate([("n", "sum")])
        rows = rows.select(["lang", "phrase", "n_sum"]).rename_columns(["lang", "phrase", "f"])
        return rows.filter(pc.field("f") >= least)

    return run


def phrase_counts(docs: DataFrame, *, least: int = LEAST_COUNT, most_words: int = MOST_WORDS) -> tuple[DataFrame, DataFrame]:
    """Every phrase of up to ``most_words`` words that occurs ``least`` times in a language (lang, phrase, f), and the languages' words (lang, n).

    ``docs`` needs text and lang; null texts hold nothing, null languages are ``und``, other columns are not read.
    """
    shards = written(docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).mapInArrow(_shards, _SHARD).withColumn("shard", F.monotonically_increasing_id()), "collocation-shards")
    totals = shards.groupBy("lang").agg(F.sum("n_words").alias("n"))
    size = shards.agg(F.sum("n_words")).first()[0] or 0
    bits = min(max(0, int(size // RANGE_GRAMS).bit_length()), 31)
    rest = shards.drop("n_words")
    for d in range(2, min(FILTERED, most_words) + 1):
        grams = rest.mapInArrow(_grams(d, bits), "range long, shard long, grams binary, counts binary")
        kept = grams.groupBy("range").applyInArrow(_frequent(least), "range long, shard long, grams binary")
        lists = kept.groupBy("shard").agg(F.collect_list(F.struct("range", "grams")).alias("kept"))  # no more than the shard's own phrases
        rest = rest.join(lists, "shard", "inner" if d == 2 else "left")
        rest = written(rest.mapInArrow(_reaching(d, bits), _REST), "collocation-rest")
    packed = shards.drop("n_words").mapInArrow(_words(bits), _PACKED).unionByName(rest.mapInArrow(_phrases(most_words, bits), _PACKED))
    counts = packed.groupBy("range").applyInArrow(_added(least), "lang string, phrase string, f long")
    return written(counts, "collocation-counts"), totals


def _exact(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def collocations(docs: DataFrame, *, least: int = LEAST_COUNT, most_words: int = MOST_WORDS, top: int = 2_000) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    Phrases lie within pieces between sentence marks and line ends. The score is 1000 a n / (l r), rounded down, at the
    cut that makes it least (ties: the earliest cut). A phrase inside a longer one that occurs as often is left out.
    Ties of scores go by count, then by the phrase's bytes. Null texts hold nothing, null languages are ``und``, repeated
    rows count again, a table without rows gives none, texts may be of any length (one above SHARD_BYTES is a shard).
    """
    counts, totals = phrase_counts(docs, least=least, most_words=most_words)
    phrases = counts.withColumn("w", F.split("phrase", " ")).where(F.size("w") > 1)
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    cuts = cuts.join(totals, "lang").select("*", F.call_function("div", _exact(F.col("a")) * _exact(F.col("n")) * F.lit(1000).cast("decimal(4,0)"), _exact(F.col("l")) * _exact(F.col("r"))).alias("score"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("x")).select("lang", "phrase", "x.*")

    spans = F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda d: F.transform(F.sequence(F.lit(1), F.size("w") - d + 1), lambda s: F.array_join(F.slice("w", s, d), " ")))
    inner = phrases.where(F.size("w") > 2).select("lang", "f", F.explode(F.flatten(spans)).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longest"))
    best = best.join(longer, ["lang", "phrase"], "left").where("longest IS NULL OR longest < a").drop("longest")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    for keys in (["lang", "salt"], ["lang"]):  # the first of each salt, then the first of all: no task sorts a whole language
        salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    return salted.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *[F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")])
