"""Collocations against brute force: counts, cuts, dropped phrases, ranks; suffix arrays; odd rows."""

import re
from collections import Counter

import numpy as np
from hypothesis import given, settings, strategies as st

import __spark_entry__ as entry
from smilegrid.llm import collocations as C

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, most=5, top=2_000):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(w)
            counts.update((lang or "und", tuple(w[i : i + d])) for d in range(1, most + 1) for i in range(len(w) - d + 1))
    out = {}
    phrases = [(g, p, a) for (g, p), a in counts.items() if a >= least and len(p) > 1]
    inside = Counter()
    for g, p, a in phrases:
        for d in range(2, len(p)):
            for i in range(len(p) - d + 1):
                inside[g, p[i : i + d]] = max(inside[g, p[i : i + d]], a)
    for g, p, a in phrases:
        if inside[g, p] < a:
            n = totals[g]
            score, k = min((1000 * a * n // (counts[g, p[:k]] * counts[g, p[k:]]), k) for k in range(1, len(p)))
            out.setdefault(g, []).append((-score, -a, " ".join(p).encode(), counts[g, p[:k]], counts[g, p[k:]], n))
    return {(g, i + 1, p.decode(), -a, lft, rgt, n, -s) for g, rows in out.items() for i, (s, a, p, lft, rgt, n) in enumerate(sorted(rows)[:top])}


def odd_rows():
    rng = np.random.default_rng(5)
    rows = [(" ".join(rng.choice(["the", "Cat", "sat", "on", "é"], 40)) + ". X\ty z, x y\rz", "en") for _ in range(12)]
    rows += [(None, "en"), ("", None), (" \t\n", "fr"), ("a a a a a a a", None), ("a a a a a a a", None), ("solo", "de"), ("b " * 30_000, "xx"), ("A" * 100_000, "und")]
    return rows


def test_op13_registered(spark):
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = entry.queries()["op13_phrase_suffixes"](spark, SF).collect()
    assert {tuple(r) for r in got} == plain(rows, 100) and len(got) == len(set(got))


def test_op13_odd_and_many_shards(spark, monkeypatch):
    rows = odd_rows()
    frame = spark.createDataFrame([(t, g, 1, "x") for t, g in rows], "text string, lang string, n long, rank string")
    want = plain(rows, 4)
    assert {tuple(r) for r in C.collocations(frame, least=4).collect()} == want
    # ranges and shards of a few words each (the limits are read where the job is built; workers get small batches by partitions)
    monkeypatch.setattr(C, "RANGE_GRAMS", 3)
    monkeypatch.setattr(C, "FILTERED", 4)
    assert {tuple(r) for r in C.collocations(frame.repartition(7), least=4).collect()} == want
    assert {tuple(r) for r in C.collocations(frame, least=4, top=3).collect()} == plain(rows, 4, top=3)
    assert C.collocations(frame.limit(0)).count() == 0


def test_shards_split_batches(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(C, "SHARD_BYTES", 20)
    batch = pa.RecordBatch.from_arrays([pa.array(["a b c d", "e" * 50, None, "f g. h", "i j k l m n o p q r s t"]), pa.array(["en"] * 5)], ["text", "lang"])
    rows = [r for out in C._shards(iter([batch, batch])) for r in out.to_pylist()]
    assert sum(r["n_words"] for r in rows) == 40 // 2 * 2 and len(rows) > 4


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_lcp_intervals(ids):
    x = np.array(ids, dtype=np.int32)
    got = {(tuple(x[p : p + d]), n) for d, first, counts in C.lcp_intervals(x, C.to_next(x == 0), 5) for p, n in zip(first, counts, strict=True)}
    want = Counter(tuple(x[i : i + d]) for d in range(2, 6) for i in range(len(x) - d + 1) if (x[i : i + d] > 0).all())
    assert got == set(want.items())
