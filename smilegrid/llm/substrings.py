"""Substring dedup: recurring passages are confirmed, compiled into sharded Aho-Corasick automata, and located in all documents."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import WHITE_BREAKS, gram_hashes, owner_of_words, released, signed, slices, text_bytes, word_hashes, word_spans, written

WINDOW, ANCHOR = 13, 5


def _windows(texts: pa.Array, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each window: its hash, its anchor (the least hash of the anchors inside it), its text's number and first word; then each text's number of words.

    Equal windows have equal anchors, and neighbours mostly share theirs: a fifth of the words are anchors.
    """
    data, bounds = text_bytes(texts)
    starts, ends, words = word_spans(data, bounds, WHITE_BREAKS)
    hashes = word_hashes(data, starts, ends)
    n = len(hashes) - window + 1
    if n <= 0:
        none = np.zeros(0, np.uint64)
        return none, none, np.zeros(0, np.int64), np.zeros(0, np.int64), np.diff(words)
    grams = gram_hashes(hashes, anchor)
    least, have, wide = grams, 1, window - anchor + 1
    while have * 2 <= wide:
        least, have = np.minimum(least[:-have], least[have:]), have * 2
    least = np.minimum(least[:n], least[wide - have : wide - have + n])
    owner = owner_of_words(words)
    inside = owner[:n] == owner[window - 1 :]
    return gram_hashes(hashes, window, 7)[inside], least[inside], owner[:n][inside], np.flatnonzero(inside), np.diff(words)


def _runs(places: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Word bounds of maximal runs of consecutive windows."""
    cut = np.flatnonzero(np.diff(places) > 1) + 1
    return [(int(r[0]), int(r[-1]) + window) for r in np.split(places, cut)] if len(places) else []


class Shard:
    """An automaton over the passages of one shard of documents; words are single code points."""

    def __init__(self) -> None:
        self.codes: dict[bytes, str] = {}
        self.passages: dict[str, int] = {}

    def add(self, words: list[bytes], owner: int) -> None:
        codes = self.codes
        key = "".join(codes.setdefault(w, _letter(len(codes))) for w in words)
        self.passages[key] = owner  # equal passages have equal owners

    def compile(self) -> None:
        self.automaton = ahocorasick.Automaton()
        for key, owner in self.passages.items():
            self.automaton.add_word(key, (len(key), owner))
        self.automaton.make_automaton()

    def covered(self, words: list[bytes], doc_id: int) -> bytearray:
        """Marks of the words inside passages that all start in documents with smaller ids."""
        mask, codes = bytearray(len(words)), self.codes
        if self.passages:
            for end, (size, owner) in self.automaton.iter("".join([codes.get(w, "\0") for w in words])):
                if owner < doc_id:
                    mask[end - size + 1 : end + 1] = b"\1" * size
        return mask


def _letter(i: int) -> str:
    """The i-th code point above zero that is no surrogate; a shard of SLICE_BYTES has far fewer words than there are."""
    return chr(i + 1 if i + 1 < 0xD800 else i + 1 + 0x800)


def _anchors(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                _, least, owner, _, _ = _windows(part.column("text"), window, anchor)
                if len(least):
                    order = np.lexsort((least, owner))
                    least, owner = least[order], owner[order]
                    new = np.concatenate([[True], (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])])
                    yield pa.RecordBatch.from_arrays([pa.array(signed(least[new])), part.column("doc_id").take(pa.array(owner[new]))], ["anchor", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(scan, "anchor long, doc_id long")


def _candidates(docs: DataFrame, recurring: DataFrame, window: int, anchor: int) -> DataFrame:
    """(window, doc_id) of windows whose anchor recurs; each once a document."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, least, owner, _, _ = _windows(part.column("text"), window, anchor)
                anchors, keep = part.column("anchors"), np.zeros(len(hashes), bool)
                cuts = np.searchsorted(owner, np.arange(len(part) + 1))
                for i in range(len(part)):
                    a, b = cuts[i], cuts[i + 1]
                    keep[a:b] = np.isin(signed(least[a:b]), anchors[i].values.to_numpy(zero_copy_only=False))
                pairs = np.unique(np.stack([owner[keep].astype(np.int64), signed(hashes[keep])]), axis=1) if keep.any() else np.zeros((2, 0), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[1]), part.column("doc_id").take(pa.array(pairs[0]))], ["window", "doc_id"])

    joined = docs.join(recurring.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "anchors")
    return joined.mapInArrow(scan, "window long, doc_id long")


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``docs`` with n_words, n_removed and kept_text: words in windows that also start in a document with a smaller id go.

    Windows are sequences of ``window`` words, judged on the input. Anchors that several documents share
    find candidates; windows of those are confirmed by their least document (by a 64-bit hash of the
    words). Runs of confirmed windows are passages. Documents are dealt out in shards of bounded size;
    each compiles the passages it needs into an automaton and streams its documents through it.

    Null texts have no words and stay null, texts without words become empty. A row with a null id keeps
    all its words and gives none away. Rows that repeat an id are one document that doesn't repeat itself.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    anchors = _anchors(rows, window, anchor)
    shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")
    recurring = written(anchors.join(shared, "anchor").groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors")), "anchors")
    released(spark)
    windows = written(_candidates(rows, recurring, window, anchor), "windows")
    released(spark)
    owners = windows.groupBy("window").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("hi")).where("owner < hi").select("window", "owner")
    confirmed = windows.join(owners, "window").where("owner < doc_id").groupBy("doc_id").agg(F.collect_list(F.struct("window", "owner")).alias("_found"))
    confirmed = written(confirmed, "passages")
    released(spark)
    out = docs.drop("n_words", "n_removed", "kept_text", "_found", "_key").withColumn("_key", F.col("doc_id").cast("long"))
    out = out.join(confirmed.withColumnRenamed("doc_id", "_key").hint("shuffle_hash"), "_key", "left")
    names = [c for c in out.columns if c not in ("_key", "_found")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.select(*[F.col(f"`{c}`") for c in names]).schema) + ", n_words long, n_removed long, kept_text string"

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, _, owner, places, counts = _windows(part.column("text"), window, anchor)
                firsts = np.concatenate([[0], np.cumsum(counts)])
                cuts = np.searchsorted(owner, np.arange(len(part) + 1))
                texts, ids, found = part.column("text").to_pylist(), part.column("_key").to_pylist(), part.column("_found")
                words = [[] if t is None else t.encode("utf-8").split() for t in texts]
                shard = Shard()
                for i in range(len(part)):
                    if not found[i].is_valid:
                        continue
                    mine, at = signed(hashes[cuts[i] : cuts[i + 1]]), places[cuts[i] : cuts[i + 1]] - firsts[i]
                    keys, owners = (found[i].values.field(k).to_numpy(zero_copy_only=False) for k in ("window", "owner"))
                    order = np.argsort(keys)
                    keys, owners = keys[order], owners[order]
                    slot = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
                    hit = keys[slot] == mine
                    by_place = dict(zip(at[hit].tolist(), owners[slot[hit]].tolist(), strict=True))
                    for a, b in _runs(at[hit], window):
                        shard.add(words[i][a:b], max(by_place[p] for p in range(a, b - window + 1)))
                shard.compile()
                removed, kept = [], []
                for text, doc, own in zip(texts, ids, words, strict=True):
                    mask = shard.covered(own, doc) if doc is not None else bytearray(len(own))
                    removed.append(mask.count(1))
                    kept.append(None if text is None else b" ".join([w for w, m in zip(own, mask, strict=True) if not m] if removed[-1] else own).decode("utf-8"))
                columns = [part.column(c) for c in names] + [pa.array(counts.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*names, "n_words", "n_removed", "kept_text"])

    return out.mapInArrow(stream, schema)


def digest(frame: DataFrame) -> DataFrame:
    """The contract's columns of documents without their repeats."""
    return frame.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))
