"""MinHash near-duplicates with sequential Bayesian verification."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .components import components
from .words import LOWER, WHITE_BREAKS, gram_hashes, join_back, mix, runs_of, signed, slices, text_bytes, word_hashes, word_spans, written

SHINGLE, SIMILARITY = 5, 80
HASHES, ROWS, STEP, MISS, BLOCK = 128, 4, 16, 1e-4, 256
BANDS = HASHES // ROWS
_RNG = np.random.default_rng(20240229)
_A = (_RNG.integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text; one of fewer words is one shingle, without words none."""
    data, bounds = text_bytes(texts)
    data = LOWER[data]
    starts, ends, words = word_spans(data, bounds, WHITE_BREAKS)
    hashes = word_hashes(data, starts, ends)
    grams = gram_hashes(hashes, size)
    out = []
    for a, b in zip(words[:-1], words[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        else:
            out.append(gram_hashes(hashes[a:b], int(b - a), 1) if b > a else np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of HASHES minima for each non-empty set."""
    flat = np.concatenate(sets)
    flat = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), HASHES), dtype=np.uint32)
    for i in range(HASHES):
        out[:, i] = np.minimum.reduceat(flat * _A[i] + _B[i], at)
    return out


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, its number included."""
    parts = sigs.reshape(len(sigs), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(ROWS):
        key = mix(key * np.uint64(0xC2B2AE3D27D4EB4F) + parts[:, :, i])
    return key


def posterior_cuts(similarity: float, miss: float) -> list[int]:
    """For 16, 32, ... compared minima: the fewest matches at which the posterior chance of at least
    ``similarity`` (Beta, from a uniform prior) is still ``miss`` or more; with fewer a pair is pruned."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            like = np.exp(log - log.max())
            if like[grid >= similarity].sum() / like.sum() >= miss:
                break
        out.append(m)
    return out


def lost(cuts: list[int], similarity: float) -> float:
    """The chance that a pair at ``similarity`` is pruned at any look, its minima being independent."""
    step = np.array([math.comb(STEP, i) * similarity**i * (1 - similarity) ** (STEP - i) for i in range(STEP + 1)])
    alive, gone = np.ones(1), 0.0
    for cut in cuts:
        alive = np.convolve(alive, step)
        gone += alive[:cut].sum()
        alive[:cut] = 0
    return float(gone)


def least_matches(similarity: float, miss: float = MISS) -> list[int]:
    """The tightest posterior cuts with which a pair at the threshold is lost with a chance of at most ``miss`` over all looks."""
    level = miss
    while lost(cuts := posterior_cuts(similarity, level), similarity) > miss:
        level *= 0.8
    return cuts


def fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, set_id (a digest of the set) and signature of every document."""
    schema = "doc_id long, n_shingles long, set_id binary, signature binary"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), size)
                full = [i for i, s in enumerate(sets) if len(s)]
                sigs = signatures([sets[i] for i in full]) if full else None
                digests, rows = [None] * len(sets), [None] * len(sets)
                for k, i in enumerate(full):
                    digests[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                    rows[i] = sigs[k].tobytes()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(rows, pa.binary())], ["doc_id", "n_shingles", "set_id", "signature"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, schema)


def _bands(reps: DataFrame) -> DataFrame:
    """(band, its number k, id) of every class."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = np.array([np.frombuffer(x.as_py(), np.uint32) for x in batch.column("signature")], dtype=np.uint32).reshape(-1, HASHES)
            if len(sigs):
                yield pa.RecordBatch.from_arrays([pa.array(signed(band_keys(sigs).ravel())), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(sigs))), pa.array(np.repeat(batch.column("id").to_numpy(), BANDS))], ["band", "k", "id"])

    return reps.select("id", "signature").mapInArrow(keys, "band long, k int, id long")


def _likely(pairs: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """The pairs that no batch of minima prunes."""
    least = least_matches(similarity)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.array([np.frombuffer(x.as_py(), np.uint32) for x in batch.column(c)], dtype=np.uint32).reshape(-1, HASHES) for c in ("sa", "sb"))
            alive, matches = np.arange(len(a)), np.zeros(len(a), int)
            for k, fewest in enumerate(least):
                cut = slice(k * STEP, (k + 1) * STEP)
                matches[alive] += (a[alive, cut] == b[alive, cut]).sum(1)
                alive = alive[matches[alive] >= fewest]
            yield batch.select(["u", "v"]).take(pa.array(alive))

    sigs = reps.select("id", "signature")
    both = pairs.join(sigs.withColumnsRenamed({"id": "v", "signature": "sb"}), "v").join(sigs.withColumnsRenamed({"id": "u", "signature": "sa"}), "u")
    return both.select("u", "v", "sa", "sb").mapInArrow(prune, "u long, v long")


def _dealt(several: DataFrame, reps: DataFrame) -> DataFrame:
    """The members of bands that hold several components, dealt into groups g of bounded size.

    Members outside a band's largest component (side 2) meet all its members: those of the largest
    component (side 0) and, once, each other (side 1). Both are cut into blocks of about BLOCK rows and
    every two blocks are a group."""
    parts = several.groupBy("band", "c").agg(F.count("*").alias("n"))
    bands = parts.groupBy("band").agg(F.max_by("c", F.struct("n", "c")).alias("big"), F.sum("n").alias("all"), F.max("n").alias("most"), F.count("*").alias("parts"))
    bands = bands.where("parts > 1").select("band", "big", *[F.ceil(n / BLOCK).cast("int").alias(c) for c, n in (("lefts", F.col("all") - F.col("most")), ("rights", F.col("all")))])
    rows = several.join(bands, "band").withColumn("outer", F.col("c") != F.col("big"))

    def block(own: str) -> Column:
        return F.pmod(F.xxhash64("id"), own).cast("int")

    right = rows.select("*", F.col("outer").cast("int").alias("side"), F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("i"), block("rights").alias("j"))
    left = rows.where("outer").select("*", F.lit(2).alias("side"), block("lefts").alias("i"), F.explode(F.sequence(F.lit(0), F.col("rights") - 1)).alias("j"))
    dealt = right.unionByName(left).select(F.xxhash64("band", "i", "j").alias("g"), "k", "id", "c", "side")
    return dealt.join(reps.select("id", "signature"), "id").select("g", "k", "id", "c", "side", "signature")


def _alive(group: pa.Table, least: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of different components that no batch of minima prunes, group by group.

    A pair counts only in the first band that it shares, so that other bands don't repeat it."""
    g, k, ids, comp, side = (group.column(c).to_numpy() for c in ("g", "k", "id", "c", "side"))
    sigs = np.array([np.frombuffer(x.as_py(), np.uint32) for x in group.column("signature")], dtype=np.uint32).reshape(-1, HASHES)
    for cut in np.split(np.arange(len(g)), np.flatnonzero(np.diff(g)) + 1):
        first, second = cut[side[cut] == 2], cut[side[cut] < 2]
        if not len(first) or not len(second):
            continue
        for at in range(0, len(first), 32):  # a few rows at a time, so that memory stays small
            rows = first[at : at + 32]
            wanted = (comp[rows][:, None] != comp[second]) & ((side[second] == 0) | (ids[rows][:, None] < ids[second]))
            x, y = np.nonzero(wanted)
            x, y, hits = rows[x], second[y], 0
            for n, fewest in enumerate(least):
                part = slice(n * STEP, (n + 1) * STEP)
                hits = hits + (sigs[x, part] == sigs[y, part]).sum(1)
                on = hits >= fewest
                x, y, hits = x[on], y[on], hits[on]
            same = (sigs[x] == sigs[y]).reshape(-1, BANDS, ROWS).all(2)
            on = same.any(1) & (same.argmax(1) == k[cut[0]])
            yield x[on], y[on]


def _by_group(rows: DataFrame) -> DataFrame:
    return rows.repartition("g").sortWithinPartitions("g")


def _unmet(several: DataFrame, reps: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (u, v), confirmed on full sets, that join components which share bands.

    A first pass keeps the members of groups that have a pair which isn't pruned; a second one brings
    their sets and confirms pairs. Pairs never leave their task, and those of components that a task has
    already joined need no test, so links stay fewer than components."""
    least = least_matches(percent / 100)
    dealt = _dealt(several, reps)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs_of(batches, "g"):
            seen = np.zeros(len(group), dtype=bool)
            for x, y in _alive(group, least):
                seen[x] = seen[y] = True
            yield from group.filter(pa.array(seen)).to_batches()

    likely = written(_by_group(dealt).mapInArrow(prune, dealt.schema), "likely")
    sets = written(_sets(docs, likely.select("id").distinct(), size), "shingles")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined: dict[int, int] = {}

        def root(c: int) -> int:
            while c in joined:
                c = joined[c]
            return c

        for group in runs_of(batches, "g"):
            ids, comp, lists = group.column("id").to_numpy(), group.column("c").to_numpy(), group.column("shingles").chunk(0)
            values, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
            us, vs = [], []
            for x, y in _alive(group, least):
                for a, b in zip(x, y, strict=True):
                    ca, cb = root(comp[a]), root(comp[b])
                    if ca == cb:
                        continue
                    sa, sb = (values[ends[i - 1] if i else 0 : ends[i]] for i in (a, b))
                    if len(sa) > len(sb):
                        sa, sb = sb, sa
                    if 100 * len(sa) < percent * len(sb):
                        continue
                    at = np.searchsorted(sb, sa)
                    both = int((sb[np.minimum(at, len(sb) - 1)] == sa).sum())
                    if 100 * both >= percent * (len(sa) + len(sb) - both):
                        joined[max(ca, cb)] = min(ca, cb)
                        us.append(min(ids[a], ids[b]))
                        vs.append(max(ids[a], ids[b]))
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return _by_group(likely.join(sets, "id").select(*likely.columns, "shingles")).mapInArrow(confirm, "u long, v long")


def _sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, shingles) of the named documents, from their whole texts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [np.sort(signed(s)) for s in shingle_sets(part.column("text"), size)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids.hint("shuffle_hash"), "id", "left_semi")
    return texts.mapInArrow(scan, "id long, shingles array<long>")


def _confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    ids = pairs.select(F.col("u").alias("id")).union(pairs.select(F.col("v").alias("id"))).distinct()
    sets = written(_sets(docs, ids, size), "shingles")
    a, b = (sets.withColumnsRenamed({"id": x, "shingles": f"s{x}"}) for x in "uv")
    both = F.size(F.array_intersect("su", "sv")).cast("long")
    return pairs.join(b, "v").join(a, "u").where(100 * both >= percent * (F.size("su") + F.size("sv") - both)).select("u", "v")


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, percent: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Documents whose sets of word shingles have a Jaccard index of ``percent``/100 or more are linked;
    component_id is the least doc_id reachable, kept marks that document. Equal sets form classes that
    are compared once. Candidates share a band of minima. First each class meets the least member of
    all its bands; then, where a band still holds several components, members outside its largest
    component meet all others, so that no candidate pair that could join two components stays untested.

    Null, empty and blank texts have no shingles and link with nothing (component_id is their own id);
    a row with a null id gets a null component and is not kept; repeated ids share a component.
    """
    prints = written(fingerprints(docs, shingle), "minhash")
    some = prints.where("set_id is not null and doc_id is not null")
    classes = written(some.groupBy("set_id").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")), "classes")
    # a doc_id may repeat with other texts: its rows are one vertex, so classes that share an id are linked below
    first = some.join(classes.select("set_id", F.col("id").alias("doc_id")), ["doc_id", "set_id"], "left_semi")  # dealt by both: no key is hot
    reps = written(first.groupBy("doc_id", "set_id").agg(F.first("signature").alias("signature")).select(F.col("doc_id").alias("id"), "signature"), "classes")
    bands = written(_bands(reps), "bands")
    shared = bands.groupBy("band").agg(F.min("id").alias("u"), F.max("id").alias("top")).where("u < top")
    several = bands.join(shared.select("band", "u"), "band")
    pairs = written(several.where("u <> id").groupBy(F.col("id").alias("v")).agg(F.min("u").alias("u")).select("u", "v"), "candidates")
    links = written(_confirmed(written(_likely(pairs, reps, percent / 100), "likely"), docs, shingle, percent), "links")
    comps = components(links)

    several = written(several.join(comps, "id", "left").select("band", "k", "id", F.coalesce("component", "id").alias("c")), "bands")
    more = written(_unmet(several, reps, docs, shingle, percent), "links")
    member = join_back(prints.select("doc_id", "n_shingles", "set_id"), classes, "set_id").select("doc_id", "n_shingles", F.col("id").alias("rep"))
    # repeated ids: every row's class belongs to that id's component
    ties = member.where("rep is not null and rep <> doc_id").select(F.col("rep").alias("u"), F.col("doc_id").alias("v"))
    repeated = prints.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select(F.col("doc_id").alias("v"))
    ties = ties.join(repeated, "v", "left_semi").select("u", "v")
    final = components(links.union(more).union(ties))
    out = member.join(final.withColumnRenamed("id", "rep"), "rep", "left")
    own: Column = F.coalesce("component", "rep", "doc_id")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document (the least id) of each group of near-duplicates; rows without an id can't be compared and stay."""
    kept = near_duplicates(docs).where("kept").select("doc_id").distinct()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    one = docs.join(kept.hint("shuffle_hash"), "doc_id", "left_semi").select(*columns)
    return one.unionByName(docs.where("doc_id is null").select(*columns))
