"""Benchmark decontamination by a prefix-filtered containment join."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .words import ALNUM_BREAKS, LOWER, join_back, own_rows, written

WINDOW = 10
#: About how much benchmark text one block holds (its index takes some ten times that); a larger benchmark is joined block by
#: block. Items are cut into pieces of PIECE words first, so that no item is larger than a block.
BLOCK_BYTES, PIECE = 8_000_000, 4_000
_TABLE = bytes(0x20 if ALNUM_BREAKS[i] else int(LOWER[i]) for i in range(256))
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SPANS = "array<struct<start:int,end:int>>"


def words_of(text: str | None) -> list[bytes]:
    """Words of a-z, 0-9 and all that lies beyond ASCII, A-Z lower-cased; null has none."""
    return [] if text is None else text.encode("utf-8", "replace").translate(_TABLE).split()


class Index:
    """The distinct windows of a block of items as rows of word numbers, found by the rarest word of each.

    Full containment asks for every token of a window, so a prefix of one token, the rarest in the corpus, is
    enough; windows with a token that the corpus lacks go."""

    def __init__(self, pieces: list[tuple[str | None, str]], size: int = WINDOW) -> None:
        self.size, self.numbers, self.items = size, {}, []
        rows: dict[bytes, set[int]] = {}
        places: dict[str | None, int] = {}
        for item, text in pieces:
            own = places.setdefault(item, len(places))
            codes = np.array([self.numbers.setdefault(w, len(self.numbers)) for w in words_of(text)], dtype=np.int32).tobytes()
            for i in range(0, max(4, len(codes) - 4 * size + 4) if codes else 0, 4):
                rows.setdefault(codes[i : i + 4 * size], set()).add(own)
        self.items = list(places)
        self.windows = list(rows)
        self.owners = [tuple(v) for v in rows.values()]

    def rarest_first(self, counts: dict[bytes, int]) -> None:
        """Orders the windows by prefix token; ``self.at`` holds the token's place in its window."""
        often = np.zeros(len(self.numbers), dtype=np.int64)
        for word, n in counts.items():
            often[self.numbers[word]] = n
        chosen, at, keep = [], [], []
        for row, window in enumerate(self.windows):
            codes = np.frombuffer(window, np.int32)
            i = int(np.argmin(often[codes]))
            if often[codes[i]]:
                chosen.append(int(codes[i]))
                at.append(i)
                keep.append(row)
        order = np.argsort(np.array(chosen, dtype=np.int64), kind="stable")
        self.windows, self.owners = [self.windows[keep[i]] for i in order], [self.owners[keep[i]] for i in order]
        self.at = [at[i] for i in order]
        self.bounds = np.searchsorted(np.array(chosen, dtype=np.int64)[order], np.arange(len(self.numbers) + 1)).tolist()

    def marks(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Bounds of all windows that occur, and the items they belong to."""
        numbers, bounds = self.numbers, self.bounds
        codes = [numbers.get(w, -1) for w in words]
        flat, spans, items = np.array(codes, dtype=np.int32).tobytes(), [], set()
        for p, code in enumerate(codes):
            if code < 0:
                continue
            for k in range(bounds[code], bounds[code + 1]):
                start, window = p - self.at[k], self.windows[k]
                size = len(window) // 4
                # positional and length bounds, then the exact test
                if start >= 0 and start + size <= len(codes) and flat[4 * start : 4 * (start + size)] == window:
                    spans.append((start, start + size))
                    items.update(self.owners[k])
        return spans, {self.items[i] for i in items if self.items[i] is not None}


def corpus_counts(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """How often each benchmark word occurs in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                total.update(filter(vocabulary.__contains__, words_of(text.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.binary()), pa.array(total.values(), pa.int64())], ["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in rows.collect()}  # as many rows as the block has words


def pieces_of(benchmark: DataFrame, size: int) -> DataFrame:
    """(item_id, text) of pieces of at most PIECE words that share size - 1 words, so that every window is in one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_py())
                parts = [b" ".join(words[i : i + PIECE + size - 1]).decode("utf-8", "replace") for i in range(0, max(1, len(words) - size + 1), PIECE)] if words else []
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(parts), pa.string()), pa.array(parts, pa.string())], ["item_id", "text"])

    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null").mapInArrow(cut, "item_id string, text string")


def _index(pieces: DataFrame, docs: DataFrame, window: int) -> Index:
    index = Index([(r.item_id, r.text) for r in pieces.collect()], window)  # a block
    index.rarest_first(corpus_counts(docs, set(index.numbers)) if index.numbers else {})
    return index


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, hits (bounds of occurring windows, in words) and items (their sorted ids).

    A benchmark of one block is matched in one pass. Blocks of a larger one are matched side by side over the texts alone; what
    they find, by digest of the text, is joined back once, so the corpus is never rewritten.

    Null texts have no words, null item ids mark words but are listed nowhere, repeated items count
    once, an empty benchmark hits nothing. Columns of ``docs`` stay, except those three names, which are replaced. Repeated rows
    repeat, texts of any length are read whole, a table without rows gives none.
    """
    pieces = written(pieces_of(benchmark, window), "benchmark-pieces")
    size = pieces.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + int(size // block_bytes)
    out = docs.drop("n_words", "hits", "items")
    hit_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    if blocks == 1:
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in out.schema]).add("n_words", "long").add("hits", T.ArrayType(T.StructType.fromDDL("start int, end int"))).add("items", T.ArrayType(T.StringType()))
        index = _index(pieces, docs, window)

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n_words, hits, found = [], [], []
                for text in batch.column(batch.schema.get_field_index("text")):
                    words = words_of(text.as_py())
                    spans, items = index.marks(words)
                    n_words.append(len(words))
                    hits.append([{"start": s, "end": e} for s, e in spans])
                    found.append(sorted(items))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n_words, pa.int64()), pa.array(hits, hit_type), pa.array(found, pa.list_(pa.string()))], schema.names)

        return out.mapInArrow(join, schema)

    parts = []
    digest_of = F.sha2(F.coalesce("text", F.lit("")), 256)
    for block in range(blocks):
        index = _index(pieces.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block), docs, window)

        def find(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, hits, found = [], [], []
                for text, key in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                    spans, items = index.marks(words_of(text.as_py()))
                    if spans:
                        keys.append(key)
                        hits.append([{"start": s, "end": e} for s, e in spans])
                        found.append(sorted(items))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(hits, hit_type), pa.array(found, pa.list_(pa.string()))], ["_text", "hits", "items"])

        found = docs.select("text", digest_of.alias("_text")).mapInArrow(find, f"_text string, hits {SPANS}, items array<string>")
        found = found.groupBy("_text").agg(F.first("hits").alias("hits"), F.first("items").alias("items"), F.count("*").alias("n"))  # equal texts have equal hits
        parts.append(written(found, "benchmark-hits"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    every = every.groupBy("_text").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("n").alias("n"))
    every = written(every, "benchmark-hits")
    out = out.withColumn("_text", digest_of)
    joined = join_back(out, every, "_text", narrow=F.size("hits") <= 1_000, blanks=False)
    names = [F.col(f"`{c}`") for c in docs.drop("n_words", "hits", "items").columns]
    return joined.select(*names, F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long").alias("n_words"), F.coalesce("hits", F.array().cast(SPANS)).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def digest(frame: DataFrame) -> DataFrame:
    """The contract's columns of a decontaminated frame."""
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit, n_items, sha = [], [], []
            for n, hits, items in zip(batch.column("n_words").to_pylist(), batch.column("hits").to_pylist(), batch.column("items").to_pylist(), strict=True):
                mask = bytearray(n)
                for h in hits or []:
                    mask[h["start"] : h["end"]] = b"\1" * (h["end"] - h["start"])
                hit.append(mask.count(1))
                n_items.append(len(items or []))
                sha.append(hashlib.sha256(",".join(items or []).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(sha), pa.array([x > 0 for x in hit])], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return frame.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", "hits", "items").mapInArrow(fold, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, unchanged, in which no benchmark window occurs; null and empty texts hold none and stay, repeated rows
    go or stay together, a table without rows stays so. Columns named like those of ``decontaminate`` stay the documents' own."""
    return own_rows(docs, ("n_words", "hits", "items"), lambda rows: decontaminate(rows, benchmark).where(F.size("hits") == 0))
