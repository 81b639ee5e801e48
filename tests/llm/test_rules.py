"""Adaptive quality rules against a plain version; sketches against exact quantiles; odd rows and tables."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from smilegrid.llm import rules

SF = "/root/testdata/sf0.001"


def plain_metrics(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(hit)


def plain_cell(v):
    low = max(v.bit_length() - 6, 0)
    return v >> low << low


def plain_rules(rows):
    """{index: (metrics, base failed, failed)} of rows (text, lang, source)."""
    out, values = {}, defaultdict(lambda: defaultdict(list))
    for i, (text, lang, source) in enumerate(rows):
        n, chars, symbols, lines, dup, rep = plain_metrics(text)
        bad = n < 20 or 100 * rep > 30 * n
        v = {"word_length": 1000 * chars // max(n, 1), "symbols": 1000 * symbols // max(n, 1), "dup_lines": 1000 * dup // max(lines, 1), "repeats": 1000 * rep // max(n, 1)}
        out[i] = ((n, chars, symbols, dup, rep), bad, v)
        for group in [] if bad else [(lang, source), (lang,), ()]:
            for m, x in v.items():
                values[group][m].append(plain_cell(x))
    for i, (text, lang, source) in enumerate(rows):
        metrics, bad, v = out[i]
        failed = []
        if not bad:
            group = next((g for g in [(lang, source), (lang,)] if len(values[g]["symbols"]) >= rules.LEAST_ROWS), ())
            for m, x in v.items():
                s = sorted(values[group][m])
                q1, q3 = s[-(-len(s) // 4) - 1], s[-(-3 * len(s) // 4) - 1]
                wide = 3 * (q3 - q1) + rules.SLACK[m]
                if x > q3 + wide or m == "word_length" and x < q1 - wide:
                    failed.append(m)
        out[i] = (metrics, bad, sorted(failed))
    return out


def got_rules(frame):
    return {r.doc_id: ((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words), r.base_failed, sorted(r.failed)) for r in rules.quality_rules(frame).collect()}


def test_op12_registered(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    want = plain_rules([(r.text, r.lang, r.source) for r in rows])
    got = {r.doc_id: r for r in entry.queries()["op12_adaptive_rules"](spark, SF).collect()}
    assert len(got) == len(rows)
    for i, r in enumerate(rows):
        x = got[r.doc_id]
        assert ((x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words), x.base_failed, x.failed) == (want[i][0], want[i][1], ",".join(want[i][2]))
        assert x.kept == (not x.base_failed and not x.failed)


def test_op12_groups_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(rules, "LEAST_ROWS", 12)
    body = "the cat sat on a mat while dogs ran over hills and far away beyond all the rivers of old"
    rows = [(body + " x" * (i % 5) + "\n" + "y" * i, "en", "hot") for i in range(40)] + [(body + " #$%&" * 8, "en", "hot"), (body, "en", "small"), (body + " " + "w" * 900, "en", "small"), (body, None, "a"), (body + "|" * 90, None, None)]
    rows += [(None, "en", "hot"), ("", "en", "hot"), (" \t\n\r", None, None), ("# " * 20_000, "en", "hot"), (" ".join(f"w{i}" for i in range(20_000)), "en", "hot"), ((body + "\n") * 3, "xx", "only"), ("a" * 50_000, "en", "hot")]
    rows += [("one two three four five six seven eight nine " * 2 + " ".join(f"z{i}" for i in range(60)), "en", "hot")] * 2
    frame = spark.createDataFrame([(i, *r, 1.5, ["x"], 3) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, failed double, bounds array<string>, n_words int")
    want = plain_rules(rows)
    assert got_rules(frame) == want and any(f for _, _, f in want.values()) and not all(f for _, b, f in want.values() if not b)
    assert rules.quality_rules(frame.limit(0)).count() == 0
    kept = rules.keep_by_rules(frame)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, b, f) in want.items() if not b and not f)
    # thresholds reach hot groups by broadcast, others by a shuffle: the same rows
    monkeypatch.setattr(rules, "HOT_ROWS", 1)
    assert got_rules(frame) == want


@pytest.mark.parametrize("shift", [0, 1, 900])
def test_sketch_merges_to_the_same_quantiles(spark, shift):
    rows = spark.range(3_000).select((F.col("id") % 3).alias("g"), (F.col("id") * F.col("id") % 7_919 + shift).alias("v"))
    whole = rules.merged(rules.quantile_sketches(rows, ["g"], ["v"]).withColumn("all", F.lit(1)), ["all"])
    parts = rules.quantile_sketches(rows.withColumn("all", F.lit(1)).repartition(5), ["all"], ["v"])
    assert sorted(whole.collect()) == sorted(parts.collect())
    q = rules.quantiles(whole, ["all"], {"half": (1, 2), "most": (99, 100)}).first()
    exact = sorted(r.v for r in rows.collect())
    for have, want in ((q.half, exact[1_499]), (q.most, exact[2_969])):
        assert have <= want < have + max(1, have / 32 + 1)
