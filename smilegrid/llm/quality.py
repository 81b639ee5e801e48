"""Quality scores by nearest-neighbour voting in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .words import ALNUM_BREAKS, LOWER, own_rows, owner_of_words, slices, text_bytes, word_hashes, word_spans

#: Most labelled rows that are fitted on; all statistics cover all documents.
SAMPLE_ROWS = 2_000
RANK, NEIGHBOURS, CUT, ROUNDS = 48, 15, 0.7, 12
#: Most texts that are counted at once.
ROWS = 256

#: Terms are hashed words, runs of three byte classes, and steps of four repetition shares.
_CLASSES = np.full(256, 15, dtype=np.uint16)
_CLASSES[0x21:0x7F] = 14
_CLASSES[0x61:0x7B], _CLASSES[0x41:0x5B], _CLASSES[0x30:0x3A] = 0, 1, 2
_CLASSES[[0x20, 0x09]] = 3
_CLASSES[[0x0A, 0x0D]] = 4
for _i, _c in enumerate(b".,!|#$%&*"):
    _CLASSES[_c] = 5 + _i
_GRAMS, _WORDS, _STEPS = 16**3, 4096, 8
TERMS = _GRAMS + _WORDS + 4 * _STEPS


def _shares(text: str) -> list[float]:
    """Shares of words that repeat the one before, of repeated words, of repeated lines, and of one-word lines."""
    words, lines = text.split(), [x for x in text.split("\n") if x]
    n, m = max(1, len(words)), max(1, len(lines))
    return [sum(map(str.__eq__, words, words[1:])) / n, 1 - len(set(words)) / n if words else 0.0, 1 - len(set(lines)) / m if lines else 0.0, sum(" " not in x for x in lines) / m]


@dataclass
class Counts:
    """Term counts of a few texts, row by row: the terms and counts of row i lie between ends[i] and ends[i + 1]."""

    ends: np.ndarray
    terms: np.ndarray
    counts: np.ndarray

    def __len__(self) -> int:
        return len(self.ends) - 1

    def row(self, i: int) -> bytes:
        part = slice(self.ends[i], self.ends[i + 1])
        return self.terms[part].astype(np.uint16).tobytes() + self.counts[part].astype(np.float32).tobytes()

    @staticmethod
    def of_rows(rows: list[bytes]) -> Counts:
        sizes = np.array([len(r) // 6 for r in rows], dtype=np.int64)
        terms = [np.frombuffer(r, np.uint16, n) for r, n in zip(rows, sizes, strict=True)]
        counts = [np.frombuffer(r, np.float32, n, 2 * n) for r, n in zip(rows, sizes, strict=True)]
        return Counts(np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([*terms, np.zeros(0, np.uint16)]).astype(np.int64), np.concatenate([*counts, np.zeros(0, np.float32)]))


def term_counts(texts: pa.Array) -> Counts:
    """Term counts of at most ROWS texts; null and empty texts have none."""
    data, bounds = text_bytes(texts)
    n = len(bounds) - 1
    table = np.zeros((n, TERMS), dtype=np.float32)
    if len(data) > 2:
        c = _CLASSES[data].astype(np.int32)
        owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(bounds))
        code = owner[:-2] * np.int32(_GRAMS) + c[:-2] * 256 + c[1:-1] * 16 + c[2:]
        table[:, :_GRAMS] = np.bincount(code[owner[:-2] == owner[2:]], minlength=n * _GRAMS).reshape(n, _GRAMS)
    data = LOWER[data]
    starts, ends, words = word_spans(data, bounds, ALNUM_BREAKS)
    code = owner_of_words(words) * _WORDS + (word_hashes(data, starts, ends) % np.uint64(_WORDS)).astype(np.int64)
    table[:, _GRAMS : _GRAMS + _WORDS] = np.bincount(code, minlength=n * _WORDS).reshape(n, _WORDS)
    for i, text in enumerate(texts):
        if text := text.as_py():
            scale = 1 + len(text) / 10
            for k, share in enumerate(_shares(text)):
                at = share * _STEPS
                for s in range(_STEPS):
                    table[i, _GRAMS + _WORDS + k * _STEPS + s] = scale * min(1.0, max(0.0, at - s))
    row, term = np.nonzero(table)
    return Counts(np.searchsorted(row, np.arange(n + 1)), term, table[row, term])


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of bounded bytes and of bounded rows."""
    for part in slices(batch, "text"):
        for at in range(0, len(part), ROWS):
            yield part.slice(at, ROWS)


@dataclass
class LatentVotes:
    """Inverse document frequencies, the projection, and the labelled vectors: all of bounded size."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def latent(self, x: Counts) -> np.ndarray:
        """Unit rows of the latent space; a text without terms is the zero row."""
        weight, out = _weights(x, self.idf), np.zeros((len(x), self.basis.shape[1]), np.float32)
        some = np.flatnonzero(np.diff(x.ends))
        if len(some):
            out[some] = np.add.reduceat(weight[:, None] * self.basis[x.terms], x.ends[some], axis=0)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def score(self, x: Counts) -> np.ndarray:
        """Exact cosine products with every labelled vector, then a vote weighted by similarity."""
        if not len(self.labels):
            return np.full(len(x), self.prior)
        cos = self.latent(x) @ self.vectors.T
        k = min(NEIGHBOURS, cos.shape[1])
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cos, near, 1), 0).astype(np.float64) ** 8
        votes = (weight * self.labels[near]).sum(1) + 1e-3 * self.prior
        return np.clip(votes / (weight.sum(1) + 1e-3), 0, 1)


def _weights(x: Counts, idf: np.ndarray) -> np.ndarray:
    """log(1 + count) times inverse document frequency, each row of unit length."""
    weight = (np.log1p(x.counts) * idf[x.terms]).astype(np.float32)
    some = np.flatnonzero(np.diff(x.ends))
    if len(some):
        norms = np.sqrt(np.add.reduceat(weight * weight, x.ends[some]))
        weight /= np.repeat(np.maximum(norms, 1e-9), np.diff(x.ends)[some])
    return weight


def _basis(x: Counts, weight: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular vectors by subspace iteration over blocks of rows, so that no dense matrix is held."""
    q = np.linalg.qr(np.random.default_rng(5).standard_normal((TERMS, min(rank + 8, max(1, len(x))))))[0].astype(np.float32)
    for _ in range(ROUNDS):
        z = np.zeros_like(q)
        for at in range(0, len(x), ROWS):
            ends = x.ends[at : at + ROWS + 1]
            block = np.zeros((len(ends) - 1, TERMS), np.float32)
            part = slice(ends[0], ends[-1])
            block[np.repeat(np.arange(len(ends) - 1), np.diff(ends)), x.terms[part]] = weight[part]
            z += block.T @ (block @ q)
        values = np.linalg.norm(z, axis=0)
        if not values.max() > 0:
            return np.zeros((TERMS, 1), np.float32)
        q = np.linalg.qr(z)[0].astype(np.float32)
    return q[:, :rank]


def _document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TERMS + 1, dtype=np.int64)
        for batch in batches:
            for part in _parts(batch):
                total[:TERMS] += np.bincount(term_counts(part.column("text")).terms, minlength=TERMS)
                total[TERMS] += len(part)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total), pa.int32()), pa.array(total[total > 0])], ["term", "n"])

    rows = docs.select("text").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row a term
    df = np.zeros(TERMS + 1)
    for r in rows:
        df[r.term] = r.n
    return df[:TERMS], int(df[TERMS])


def fit(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> LatentVotes:
    """Fit on at most ``sample_rows`` labelled documents, chosen by a hash of their ids. Of rows that repeat an id
    one counts, whichever their order."""
    df, n = _document_frequencies(docs)
    idf = np.where(df > 0, np.log((1 + n) / (1 + df)) + 0.1, 0).astype(np.float32)
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample_rows)
    schema = "doc_id long, quality int, terms binary"

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                x = term_counts(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.array([x.row(i) for i in range(len(x))], pa.binary())], ["doc_id", "quality", "terms"])

    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))), "doc_id")
    rows = sample.select("doc_id", "quality", "text").mapInArrow(vectors, schema).groupBy("doc_id", "quality").agg(F.min("terms").alias("terms")).collect()  # at most sample_rows
    if not rows:
        return LatentVotes(idf, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    rows.sort(key=lambda r: r.doc_id)
    quality, x = np.array([float(r.quality) for r in rows]), Counts.of_rows([bytes(r.terms) for r in rows])
    del rows
    basis = _basis(x, _weights(x, idf), RANK)
    model = LatentVotes(idf, basis, np.zeros((0, 1), np.float32), quality, float(quality.mean()))
    model.vectors = model.latent(x)
    return model


def score_quality(docs: DataFrame, labels: DataFrame, *, cut: float = CUT, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with held_out, score and predicted.

    Labels are learnt only from ids whose crc32 (of the id as text) mod 4 is not 2; the score sees
    nothing but the text. Null and empty texts get the labelled share of quality 1, all rows 0.5 where
    no label can be learnt; repeated rows get equal scores, a null id is not held out. Texts of any length are
    counted whole. Columns named held_out, score or predicted are replaced; a table without rows gives none.
    """
    part = F.crc32(F.col("doc_id").cast("string")) % 4
    model = fit(docs, labels.where(part != 2), sample_rows=sample_rows)
    out = docs.drop("held_out", "score", "predicted")
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in out.schema]).add("score", "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _parts(batch):
                scores = model.score(term_counts(rows.column("text")))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(scores.astype(np.float64))], [*rows.schema.names, "score"])

    out = out.mapInArrow(score, schema)
    return out.withColumn("held_out", F.coalesce(part == 2, F.lit(False))).withColumn("predicted", (F.col("score") >= cut).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject, with their own columns.

    Texts that are null or empty follow the labelled share, as in ``score_quality``; repeated rows go or stay
    together; the table without rows stays so. Columns named like those of ``score_quality`` stay the documents' own."""
    return own_rows(docs, ("held_out", "score", "predicted"), lambda rows: score_quality(rows, labels).where("predicted = 1"))
