"""The training-data operators against brute force, and on nulls, ties, repeats, and empty or odd tables."""

import hashlib
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from smilegrid.llm import chat, decontaminate, embeddings, licenses, minhash, mixing, pii, quality, secrets, substrings

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, n_words int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, blanks, a long text, repeated rows, and columns with clashing names."""
    long = " ".join(f"w{i}" for i in range(40_000))
    body = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, long), (5, body), (6, body), (6, body), (None, body), (7, "a" * 100_000), (8, long)]
    return spark.createDataFrame([(i, t, None, None, None, "x", 1) for i, t in rows], DOCS)


def words(text):
    return (text or "").encode().split()


def least(links, ids):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_op1(spark, texts):
    first = {}
    for i in sorted(texts):
        w = words(texts[i])
        for s in range(len(w) - 12):
            first.setdefault(tuple(w[s : s + 13]), i)
    for r in entry.queries()["op1_substring_automata"](spark, SF).collect():
        w = words(texts[r.doc_id])
        gone = {j for s in range(len(w) - 12) if first[tuple(w[s : s + 13])] < r.doc_id for j in range(s, s + 13)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), len(gone), hashlib.sha256(kept).hexdigest())


def test_op1_odd(odd):
    got = substrings.remove_repeats(odd).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 10 and by[1].kept_text is None and by[2].kept_text == "" and by[5].n_removed == 0 and by[6].n_removed == 14
    assert by[None].n_removed == 0 and by[4].n_removed == 0 and by[8].n_removed == 40_000 and by[5].spans == "x"
    assert substrings.remove_repeats(odd.limit(0)).count() == 0


def test_op2(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 16))
    x = np.concatenate([base, base[:20] + 0.05 * rng.standard_normal((20, 16)), np.repeat(base[:1], 30, 0) + 0.02 * rng.standard_normal((30, 16)), base[1:2], base[1:2]])
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [None] + [1.0] * 15), (905, [1.0, 2.0]), (None, [1.0] * 16)]
    got = {r.vec_id: r for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    comp = least(list(zip(*np.nonzero(link), strict=True)), range(len(x)))
    assert len(got) == len(rows)
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (link[i].sum(), comp[i], comp[i] == i)
    assert all((got[i].n_links, got[i].component_id) == (0, i) for i in range(900, 906)) and not got[None].kept


def test_op2_odd(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.near_vectors(none).count() == 0
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(700)] + [(5, [1.0, 2.0, 3.0]), (1000, [0.0, 0.0, 0.0]), (1001, [0.0, 0.0, 0.0])]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(got) == 703 and all((r.n_links, r.component_id) == ((699, 0) if r.vec_id < 1000 else (0, r.vec_id)) for r in got)


def test_op2_recall_on_the_table(spark):
    """The share of pairs at 0.9 or more that the tables bring together, on vectors close to the threshold."""
    rng = np.random.default_rng(12)
    x = rng.standard_normal((150, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal(x.shape)
    y -= (y * x).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    both = np.concatenate([x, 0.905 * x + np.sqrt(1 - 0.905**2) * y])
    got = embeddings.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(both)], "vec_id long, embedding array<double>")).collect()
    u = both / np.linalg.norm(both, axis=1, keepdims=True)
    links = ((u @ u.T >= 0.9) & ~np.eye(300, dtype=bool)).sum()
    assert 0.97 * links <= sum(r.n_links for r in got) <= links


def test_op3(spark, docs):
    got = {r.doc_id: r for r in entry.queries()["op3_quality_votes"](spark, "/root/testdata/sf0.01").collect()}
    truth = [(got[r.doc_id], r.quality) for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()]
    held = [(p, q) for p, q in truth if p.held_out]
    assert len(held) > 50 and sum(p.predicted == q for p, q in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def vote(model, text):
    """A text's score from dense terms, cosines and votes."""
    x = quality.term_counts(pa.array([text], pa.string()))
    dense = np.zeros(quality.TERMS)
    dense[x.terms] = np.log1p(x.counts) * model.idf[x.terms]
    dense = dense / (np.linalg.norm(dense) or 1) @ model.basis
    cos = dense / (np.linalg.norm(dense) or 1) @ model.vectors.T
    near = np.argsort(-cos, kind="stable")[: quality.NEIGHBOURS]
    weight = np.maximum(cos[near], 0) ** 8
    return (weight @ model.labels[near] + 1e-3 * model.prior) / (weight.sum() + 1e-3)


def test_op3_scores_are_votes_of_the_nearest(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs.select("doc_id", "text"), labels.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    got = {r.doc_id: r.score for r in entry.queries()["op3_quality_votes"](spark, SF).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == pytest.approx(vote(model, r.text), abs=2e-3)


def test_op3_counts_bounded_rows(spark):
    rows = spark.createDataFrame([(i, "two words") for i in range(3000)], "doc_id long, text string").coalesce(1)
    one = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert len({r.score for r in quality.score_quality(rows, one).collect()}) == 1


def test_op3_odd(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score_quality(odd, none).collect()} == {0.5}
    one = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.score_quality(odd, one).count() == 10 and quality.score_quality(odd.limit(0), one).count() == 0


def test_op4_meets_marginals(spark, docs):
    targets = {"source": {"src0": 0.5, "src1": 0.5}, "lang": {"en": 0.6, "fr": 0.4}, "topic": {"prose": 1.0}}
    rows = mixing.mix_sources(docs, targets).collect()
    total = sum(r.mix_tokens for r in rows)
    spare = sum(r.mix_tokens for r in rows if r.mix_lang == mixing.OTHER) / total
    for lang, share in (("en", 0.6), ("fr", 0.4)):
        assert abs(sum(r.mix_tokens * r.mix_weight for r in rows if r.mix_lang == lang) / total - share * (1 - spare)) < 0.01
    assert abs(sum(r.mix_tokens * r.mix_prob for r in rows) / total - 0.5) < 0.02
    assert all(abs(r.mix_weight * rows[0].mix_prob * rows[0].mix_repeat / rows[0].mix_weight - r.mix_prob * r.mix_repeat) < 1e-6 for r in rows)


def raked(cells, targets, rounds=60):
    """Token weights of cells {(categories): tokens} fitted to shares, in NumPy."""
    keys, total = sorted(cells), sum(cells.values())
    w = np.array([float(cells[k]) for k in keys])
    goals = []
    for n, wanted in enumerate(targets.values()):
        have = Counter()
        for k in keys:
            have[k[n]] += cells[k]
        spare = have.get(mixing.OTHER, 0) / total
        known = sum(v for k, v in wanted.items() if have.get(k, 0) > 0)
        goals.append({k: have[k] if k == mixing.OTHER else wanted[k] / known * (1 - spare) * total for k in have})
    for _ in range(rounds):
        for n, goal in enumerate(goals):
            now = Counter()
            for k, x in zip(keys, w, strict=True):
                now[k[n]] += x
            w = np.array([x * goal[k[n]] / now[k[n]] if now[k[n]] else 0 for k, x in zip(keys, w, strict=True)])
    return dict(zip(keys, w, strict=True))


def mixed(rows):
    """The weight of each cell and the factor of the draws, from (categories, tokens) of all documents."""
    cells = Counter()
    for key, n in rows:
        cells[key] += n
    fitted = raked(cells, mixing.TARGETS, mixing.ROUNDS)
    weight = {k: fitted[k] / n if n else 0.0 for k, n in cells.items()}
    total, factor = sum(cells.values()), 0.5
    for _ in range(100):
        factor *= 0.5 * total / sum(n * min(1, factor * weight[k]) for k, n in cells.items())
    return weight, factor


def cell(*categories):
    return tuple(v if v in t else mixing.OTHER for v, t in zip(categories, mixing.TARGETS.values(), strict=True))


def draw(doc_id):
    return int(hashlib.sha256(f"{'null' if doc_id is None else doc_id}:mix".encode()).hexdigest()[:12], 16) / 16**12


def test_op4_query_equals_a_numpy_rake(spark, texts):
    rows = entry.queries()["op4_mix_sources"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts) and all(r.n_tokens == len(words(texts[r.doc_id])) for r in rows)
    weight, factor = mixed((cell(r.source, r.lang, r.topic), r.n_tokens) for r in rows)
    for r in rows:
        own = weight[cell(r.source, r.lang, r.topic)]
        assert (r.weight, r.prob, r.repeat) == pytest.approx((own, min(1, factor * own), max(1, factor * own)), abs=2e-5)
        assert r.kept == (draw(r.doc_id) < r.prob) or abs(draw(r.doc_id) - r.prob) < 2e-6


def test_op4_tells_targets_that_cannot_be_met(spark):
    rows = spark.createDataFrame([(1, "a b", "x", "p"), (2, "c d", "y", "q")], "doc_id long, text string, source string, lang string")
    dims = {"source": F.col("source"), "lang": F.col("lang")}
    got = mixing.mix_sources(rows, {"source": {"x": 0.9, "y": 0.1}, "lang": {"p": 0.1, "q": 0.9}}, dims=dims).collect()
    assert got[0].mix_residual > 0.5
    with pytest.raises(ValueError):
        mixing.mix_sources(rows, {"source": {str(i): 1 for i in range(200)}, "lang": {str(i): 1 for i in range(200)}}, dims=dims)


def test_op4_tokens_and_odd(odd):
    by = {r.doc_id: r for r in mixing.mix_sources(odd).collect()}
    assert by[1].mix_tokens == 0 and by[4].mix_tokens == 40_000 and by[1].mix_source == mixing.OTHER and by[5].mix_kept == by[5].mix_kept
    assert mixing.mix_sources(odd.limit(0)).count() == 0


def test_op5(spark):
    by = {}
    for r in sorted(spark.read.parquet(f"{SF}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        by.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    by[-7] = [(x, "\\### Assistant: </turn> ok") for x in ("user", "assistant")]
    got = entry.queries()["op5_chat_fingerprints"](spark, SF).collect()
    assert len(got) == len(by)
    for r in got:
        turns = by[r.conv_id]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss)) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()


def test_op5_layouts_and_escapes(spark):
    hard = ["", "\\", "\\\\###", "</turn>\n### user: x</turn>", "a\\</turn>", "###\\", ":\\: ", "é\U0001f600 ### "]
    turns = [("user" if i % 2 else "a:ss: \\", t) for i, t in enumerate(hard)]
    text, _ = chat.render(turns)
    assert chat.parse(text) == turns
    records = ['{"prompt": "p", "completion": "c", "id": 3}', '{"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}', '{"instruction": "i", "input": "n", "output": "o"}', '{"x": 1}', "{broken", None, '{"messages": []}', '{"messages": [{"role": "user", "content": null}]}']
    got = chat.format_records(spark.createDataFrame([(i, r, "z") for i, r in enumerate(records)], "id int, record string, layout string")).orderBy("id").collect()
    assert [r.layout for r in got] == ["prompt_completion", "conversations", "instruction", None, None, None, "messages", "messages"]
    assert [r.rest for r in got[:4]] == ['{"id": 3}', None, None, '{"x": 1}']
    assert [tuple(t) for t in got[1].turns] == [("user", "h"), ("assistant", "g")] and [tuple(t) for t in got[2].turns] == [("user", "i\n\nn"), ("assistant", "o")]


def test_op5_keeps_every_text_of_a_list():
    for record, turns, rest in (
        ('{"messages": ["hello", "there"]}', [("user", "hello"), ("assistant", "there")], None),
        ('{"messages": [{"role": "user", "content": "x", "name": "n"}, "plain"]}', [("user", "x"), ("assistant", "plain")], '{"messages[0].name": "n"}'),
        ('{"dialog": ["a", "b", "c"]}', [("user", "a"), ("assistant", "b"), ("user", "c")], None),
        ('{"prompt": {"x": [1, 2]}, "completion": "c"}', [("user", '{"x": [1, 2]}'), ("assistant", "c")], None),
    ):
        name, _, left, got = chat.canonical(record)
        assert name and got == turns and left == rest


def test_op5_query_meets_several_layouts(spark):
    turns = spark.createDataFrame([(i, j, r, f"t{i}") for i in range(60) for j, r in enumerate(("user", "assistant") if i % 2 else ("human", "assistant", "user"))], "conv_id long, turn long, role string, text string")
    rows = chat.format_records(chat.records_of(turns)).collect()
    assert len({r.layout for r in rows}) >= 5
    assert all([t.role for t in r.turns] == (["user", "assistant"] if r.conv_id % 2 else ["human", "assistant", "user"]) for r in rows)
    assert chat.format_records(chat.records_of(turns.limit(0))).count() == 0


def test_op5_long_texts_of_escapes():
    turns = [("user", "</turn>\\" * 50_000)]
    assert chat.parse(chat.render(turns)[0]) == turns


def test_op6_query_equals_brute_force(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    held = {}
    for r in items.collect():
        w = decontaminate.words_of(r.text)
        for i in range(max(1, len(w) - 9) if w else 0):
            held.setdefault(tuple(w[i : i + 10]), set()).add(str(r.item_id))
    sizes = {len(k) for k in held}
    plain = entry.queries()["op6_prefix_decontaminate"](spark, SF).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    blocks = {r.doc_id: tuple(r) for r in decontaminate.digest(decontaminate.decontaminate(docs, items, block_bytes=5_000)).collect()}
    for r in plain:
        w, mask, ids = decontaminate.words_of(text[r.doc_id]), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in held:
                    mask |= set(range(i, i + n))
                    ids |= held[tuple(w[i : i + n])]
        assert tuple(r)[1:] == (len(w), len(mask), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(mask)) and blocks[r.doc_id] == tuple(r)


def test_op6_cuts_long_items_into_pieces(spark):
    long = " ".join(f"w{i}" for i in range(3 * decontaminate.PIECE))
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i, i + 12))) for i in range(decontaminate.PIECE - 14, decontaminate.PIECE + 4)], "doc_id long, text string")
    got = decontaminate.digest(decontaminate.decontaminate(docs, spark.createDataFrame([("x", long)], "item_id string, text string"))).collect()
    assert all(r.n_hit == 12 and r.n_items == 1 for r in got)


def test_op6_small_items_and_blocks(spark, odd):
    items = spark.createDataFrame([("b", "Two THREE"), ("a", "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), ("c", ""), (None, "fourteen"), ("d", None), ("b", "two three")], "item_id string, text string")
    for size in (32_000_000, 10):
        out = decontaminate.decontaminate(odd, items, block_bytes=size)
        got = {r.doc_id: r for r in decontaminate.digest(out).collect()}
        assert (got[5].n_hit, got[5].n_items, got[4].n_hit, got[1].n_words, got[2].contaminated) == (3, 1, 11, 0, False)
        assert got[5].items_sha256 == hashlib.sha256(b"b").hexdigest()
    assert decontaminate.decontaminate(odd, items.limit(0)).where(F.size("hits") > 0).count() == 0


def test_op7_alignment():
    a, b = "x the licensed under zz the apache license y".encode().split(), "licensed under the apache license".encode().split()
    assert [j for _, j in licenses.align(a, b)] == [0, 1, 2, 3, 4]
    found = licenses.Scanner(licenses.TEMPLATES, 0.8).find(licenses.words_of("foo. Released under the MIT License.\nbar All rights reserved. " + licenses.TEMPLATES["MIT"].replace("free of charge", "gratis")))
    assert [f[0] for f in found] == ["MIT-notice", "all-rights-reserved", "MIT"]


def naive_align(a, b):
    """Patience by definition, recursively: common ends, then the longest increasing chain of words unique to both sides."""
    if not a or not b:
        return []
    if a[0][1] == b[0][1]:
        return [(a[0][0], b[0][0]), *naive_align(a[1:], b[1:])]
    if a[-1][1] == b[-1][1]:
        return [*naive_align(a[:-1], b[:-1]), (a[-1][0], b[-1][0])]
    once = lambda x: {w for w, n in Counter(w for _, w in x).items() if n == 1}
    both = once(a) & once(b)
    where = {w: j for j, w in b if w in both}
    pairs = [(i, where[w]) for i, w in a if w in both]
    best, longest = [], lambda c: (len(c), -c[-1][1])  # of equally long chains the one that ends first
    for i, (x, y) in enumerate(pairs):
        best.append(max((best[k] for k in range(i) if pairs[k][1] < y), key=longest, default=[]) + [(x, y)])
    chain = max(best, key=longest, default=[])
    if not chain:
        return []
    out, last = [], (a[0][0] - 1, b[0][0] - 1)
    for x, y in [*chain, (a[-1][0] + 1, b[-1][0] + 1)]:
        out += naive_align([p for p in a if last[0] < p[0] < x], [p for p in b if last[1] < p[0] < y])
        if (x, y) in chain:
            out.append((x, y))
        last = (x, y)
    return out


def test_op7_alignment_has_the_length_of_a_naive_one():
    rng = np.random.default_rng(8)
    for _ in range(200):
        a, b = ([f"w{i}" for i in rng.integers(0, 25, n)] for n in rng.integers(0, 30, 2))
        got = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in got) and got == sorted(got) and len({j for _, j in got}) == len(got) == len(naive_align(list(enumerate(a)), list(enumerate(b))))


def test_op7_odd_and_full_texts(spark, odd):
    got = licenses.digest(licenses.scan_licenses(odd)).collect()
    assert len(got) == 10 and all(r.n_notices == 0 for r in got)
    assert licenses.scan_licenses(odd.limit(0)).count() == 0 and licenses.scan_licenses(odd, {}).where(F.size("licenses") > 0).count() == 0
    found = licenses.Scanner(licenses.TEMPLATES, 0.8)
    for name, body in licenses.TEMPLATES.items():
        assert name in [x[0] for x in found.find(licenses.words_of(f"int main() {{}} {body} more"))]
    assert [x[0] for x in found.find(licenses.words_of(licenses.TEMPLATES["LGPL-2.1-or-later"]))] == ["LGPL-2.1-or-later"]


def plain_licenses(text, templates, coverage=0.8, spread=1.5):
    """By definition: every start at a template's word, in order, aligned naively; then all pairs of regions."""
    body, out, size = licenses.words_of(text), [], {}
    for name, template in templates.items():
        template = licenses.words_of(template)
        size[name], wide, taken = len(template), int(len(template) * spread) + 2, 0
        need = -(-len(template) * round(coverage * 100) // 100)
        for i, w in enumerate(body):
            window = list(enumerate(body[i : i + wide], i))
            if i < taken or w not in template or sum(x in template for _, x in window) < need:
                continue
            got = sorted(naive_align(window, list(enumerate(template))))
            if len(got) >= need:
                taken = got[-1][0] + 1
                out.append((name, got[0][0], taken, len(got)))
    beaten = [any(n != k and min(e, y) - max(s, x) >= coverage * (y - x) and m * size[k] > j * size[n] for n, s, e, m in out) for k, x, y, j in out]
    return sorted((x for x, b in zip(out, beaten, strict=True) if not b), key=lambda x: (x[1], x[0]))


def test_op7_query_equals_brute_force(spark, docs, tmp_path):
    """The registered query on the table and on planted licences: damaged, spread, cut, nested, twice, in other orders, beside one another."""
    rng = np.random.default_rng(77)
    names, planted = list(licenses.TEMPLATES), []
    for k in range(40):
        parts = []
        for name in rng.choice(names, rng.integers(1, 4)):
            body = licenses.TEMPLATES[name].split()
            kind = rng.integers(0, 6)
            if kind == 0:
                body = [w if rng.random() > 0.15 else "gap" for w in body]
            elif kind == 1:
                body = [x for w in body for x in ([w, "filler"] if rng.random() < 0.4 else [w])]
            elif kind == 2:
                body = body[: max(1, int(len(body) * rng.uniform(0.6, 1)))]
            elif kind == 3:
                body = body + body
            elif kind == 4:
                body = list(rng.permutation(body))
            parts += ["some", "text", *body]
        planted.append(" ".join(parts))
    base = docs.select("doc_id", "text").limit(60).collect()
    rows = [(r.doc_id, r.text) for r in base] + [(10**6 + i, t) for i, t in enumerate(planted)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in entry.queries()["op7_license_patience"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want = plain_licenses(t, licenses.TEMPLATES)
        assert got[i].n_notices == len(want)
        assert got[i].notices == ",".join(f"{k}:{s}:{e}" for k, s, e, _ in want)
    assert sum(got[10**6 + i].n_notices > 0 for i in range(40)) > 30


def test_op7_long_texts_take_time_in_proportion():
    """A template's words in other orders, and very many notices: both were aligned or compared over and over."""
    rng, found = np.random.default_rng(3), licenses.Scanner(licenses.TEMPLATES, 0.8)
    words = licenses.words_of(licenses.TEMPLATES["MIT"])
    mixed = [w for _ in range(100_000 // len(words)) for w in rng.permutation(words).tolist()]
    start = time.time()
    assert found.find(mixed) == []
    assert len(found.find(licenses.words_of("All rights reserved. " * 30_000))) == 30_000
    assert time.time() - start < 20


def test_op7_finds_every_notice(spark, texts):
    got = {r.doc_id: r.notices for r in entry.queries()["op7_license_patience"](spark, SF).collect()}
    for name in list(licenses.TEMPLATES)[:5]:
        for i, t in texts.items():
            if licenses.TEMPLATES[name] in t:
                assert f"{name}:" in got[i]


def test_op8(spark, texts):
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub("[ -]", "", m[0])) <= 19 and pii.luhn(re.sub("[ -]", "", m[0]))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15),
    ]
    more = {-1: "a@b.c x@@y.z@q.r a@b a.b@c..d +1 (23) 456-7890 1.2.3.4.5.6 4111 1111 1111 1111"}
    find = lambda t: sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(kinds) for m in re.finditer(p, t) if ok(m))
    assert pii.base_spans(more[-1]) == find(more[-1])
    for r in entry.queries()["op8_pii_boosted"](spark, SF).collect():
        spans = [f"{kinds[k][0]}:{s}:{e}" for s, k, e in find(texts[r.doc_id])]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest() and set(spans) <= set(r.spans.split(",")) | {""}


def test_op8_odd_and_long(spark, odd):
    got = pii.digest(pii.find_personal_data(odd)).collect()
    assert len(got) == 10 and all(r.spans == "" for r in got)
    assert pii.find_personal_data(odd.limit(0)).count() == 0
    clean = spark.createDataFrame([(1, "nothing here"), (2, None)], "doc_id long, text string")
    assert [r.pii for r in pii.find_personal_data(clean).collect()] == [[], []]
    for text in ("a" * 100_000, "1" * 100_000, "1.1." * 25_000, "@" * 100_000, "a at b " * 14_000, "1" + "-" * 100_000, "1.2.3." + "0" * 5_000 + "1"):
        began = time.process_time()
        pii.base_spans(text), pii.outside(text)
        assert time.process_time() - began < 5
    assert pii.base_spans("1.2.3." + "0" * 5_000 + "1") == [(0, 1, 5_007)]


def test_op8_finds_and_redacts_forms_that_the_base_detectors_miss(spark):
    rng = np.random.default_rng(6)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    card = lambda: next(d for d in iter(lambda: "4" + digits(15), None) if pii.luhn(d))
    word = lambda: "".join(rng.choice(list("abdeghiklmnorstuvw"), int(rng.integers(3, 8))))
    docs = []
    for i in range(600):
        docs += [f"please mail {word()}.{word()}@{word()}.{('com', 'org', 'net')[i % 3]} today", f"pay by card {card()} now", f"call +44 20 {digits(4)} {digits(4)} soon", f"we meet at the.Next door at {i}.Then go", f"order 1{digits(15)} shipped", f"part 10-{digits(4)}-{digits(5)} in stock"]
    hidden = {-3: ("call 44 20 7946 0958 soon", "call [PHONE] soon")}
    for i in range(40):
        number = card()
        hidden |= {-3 * i - 1: (f"please mail {word()}.{word()} (at) {word()} (dot) org today", "please mail [EMAIL] today"), -3 * i - 2: (f"pay by card {number[:4]}.{number[4:8]}.{number[8:12]}.{number[12:]} now", "pay by card [CARD] now")}
    rows = [*enumerate(docs), *[(i, t) for i, (t, _) in hidden.items()], (-1000, None), (-1001, "mail a@b.com")]
    out = {r.doc_id: r.text for r in pii.redact_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(out) == len(rows) and out[-1000] is None and out[-1001] == "mail [EMAIL]"
    assert out[-3] == hidden[-3][1]
    for k in (1, 2):
        assert sum(out[i] == t for i, (_, t) in hidden.items() if -i % 3 == k) >= 32, k
    assert all(out[i] == t for i, t in enumerate(docs) if "meet at" in t)


def test_op8_is_fitted_on_every_text(spark):
    """Each text's examples are there with their number, equal texts once; trees are grown on all of them as on their repeats."""
    texts = [f"mail u{i}@host{i % 7}.com or 10,{i % 250},3,{i % 9}" for i in range(6_000)]
    rows = pii.all_examples(spark.createDataFrame([(t,) for t in [*texts, *texts[:50], None]], "text string")).collect()
    want = {}
    for t in texts:
        for y, x, k in pii.examples(t):
            key = (tuple(map(float, x)), int(y), k, zlib.crc32(t.encode()) % 5 == 4)
            want[key] = want.get(key, 0) + 1
    assert {(tuple(r.x), r.y, r.k, r.h): r.w for r in rows} == want and sum(want.values()) > 24_000
    x = [[float(i % 5), float(i % 3), *[0.0] * 18] for i in range(60)]
    many = spark.createDataFrame([(v, int(v[0] > 2), 0, False, 1) for v in x], "x array<double>, y long, k int, h boolean, w long")
    tree = pii._tree(many, pii.Boosted([], 0.0, ()))
    assert tree[0][:2] == (0, 2.5) and tree == pii._tree(many.groupBy("x", "y", "k", "h").agg(F.sum("w").alias("w")), pii.Boosted([], 0.0, ()))
    assert tree[tree[0][2]][4] < 0 < tree[tree[0][3]][4]


def test_op9_cuts_meet_their_chance_over_all_looks():
    for similarity in (0.7, 0.8, 0.9):
        cuts, rng = minhash.least_matches(similarity), np.random.default_rng(1)
        assert 0 < minhash.lost(cuts, similarity) <= minhash.MISS
    seen = np.cumsum(rng.random((200_000, minhash.HASHES)) < 0.8, axis=1)[:, minhash.STEP - 1 :: minhash.STEP]
    loose = [c + 4 for c in minhash.least_matches(0.8)]
    assert (seen < loose).any(axis=1).mean() == pytest.approx(minhash.lost(loose, 0.8), rel=0.1)
    assert minhash.lost([7, 17, 28, 39, 50, 62, 73, 85], 0.8) == pytest.approx(7.6e-4, rel=0.02)


def test_op9(spark, texts):
    sets = {}
    for i, t in texts.items():
        w = [x.lower() for x in words(t)]
        sets[i] = {tuple(w[j : j + 2]) for j in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = least(links, sets)
    for r in entry.queries()["op9_minhash_bayes"](spark, SF).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), comp[r.doc_id], comp[r.doc_id] == r.doc_id)


def test_op9_chain_through_a_crowded_band(spark):
    """Texts that drift: each links with the next, the ends don't; all are one component."""
    base = [f"w{i}" for i in range(300)]
    rows = [(n, " ".join(base[8 * n :] + [f"v{i}" for i in range(8 * n)])) for n in range(12)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_op9_odd(odd):
    got = Counter((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(odd).collect())
    assert got == Counter([(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 5, True), (6, 5, False), (6, 5, False), (None, None, False), (7, 7, True), (8, 4, False)])
    assert minhash.near_duplicates(odd.limit(0)).count() == 0


def test_op10(spark, texts):
    kinds = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]

    def base(t):
        found = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(kinds) for m in p.finditer(t) if ok(m))
        return ",".join(f"{kinds[k][0]}:{s}:{e}" for s, k, e in found)

    for r in entry.queries()["op10_secret_ledger"](spark, SF).collect():
        assert r.base_sha256 == hashlib.sha256(base(texts[r.doc_id]).encode()).hexdigest()
    hard = ["é\U0001f600 Token='abcdef' secret=token:xabcdef", "secret=abc token: AKIA" + "A" * 20, "deadbeef" * 4 + "g" + "0" * 24, None]
    got = {r.doc_id: r for r in secrets.digest(secrets.scan_versions(spark.createDataFrame(list(enumerate(hard)), "doc_id long, text string"))).collect()}
    assert all(got[i].base_sha256 == hashlib.sha256(base(t or "").encode()).hexdigest() for i, t in enumerate(hard))


def test_op10_ledger_scans_only_what_is_new(spark, odd, tmp_path):
    path = f"file://{tmp_path}/ledger"
    secrets.scan_versions(odd, path)
    before = spark.read.parquet(path).count()
    assert before == len({(r.text or "") for r in odd.collect()})
    new = odd.select("doc_id", "text").union(spark.createDataFrame([(99, "password=hunter22")], "doc_id long, text string"))
    got = {r.doc_id: r.spans for r in secrets.scan_versions(new, path).collect()}
    assert spark.read.parquet(path).count() == before + 1 and len(got[99]) == 1
    secrets.scan_versions(new, path, rule_version="next")
    assert spark.read.parquet(path).count() == 2 * (before + 1)


def test_redaction(spark, docs):
    rows = spark.createDataFrame([(1, "é token=abcdef12 end", "en", "s", 1), (2, "plain", None, None, None)], docs.schema)
    got = {r.doc_id: r for r in secrets.redact_secrets(rows).collect()}
    assert got[1].text == "é [SECRET] end" and got[1].n_chars == 14 and got[2].text == "plain"


def test_pipeline_equals_brute_force(spark, docs, tmp_path, monkeypatch):
    """What each stage of run() writes, against a plain version over all that the stage before kept."""
    labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    long = [r for r in docs.orderBy("doc_id").collect() if r.doc_id in good and len(words(r.text)) > 100]
    items_of = [r.text for r in items.collect() if len(decontaminate.words_of(r.text)) >= 12]
    back = [" ".join(r.text.split()[::-1]) for r in long]
    extra = [(1000 + i, r.text, r.lang, r.source) for i, r in enumerate(long[:4])]  # copies
    extra += [(1100 + i, f"{r.text} tail{i}", r.lang, r.source) for i, r in enumerate(long[2:8])]  # near copies
    extra += [(1200 + i, f"{t} {items_of[i]} end", "en", "src1") for i, t in enumerate(back[:4])]
    extra += [(1300 + i, f"{t} é token=abcdef123456 AKIA{'A' * 20} gh{'p_'}{'b' * 36}", "fr", "src2") for i, t in enumerate(back[4:8])]
    extra += [(1400, None, None, None), (1401, "", "en", "src0"), (1402, " \n", "xx", None), (None, long[9].text, "de", "src3"), (None, back[9], None, "src4")]
    extra += [(1500, back[10], "es", "src5")] * 2
    table = docs.union(spark.createDataFrame([(*r, len(r[1] or "")) for r in extra], docs.schema))
    folder = f"file://{tmp_path}"
    for name, frame in {"documents": table, "labels": labels, "benchmark": items}.items():
        frame.write.parquet(f"{folder}/{name}.parquet")
    stages, real = {}, corpus_pipeline.written
    monkeypatch.setattr(corpus_pipeline, "written", lambda frame, name: stages.setdefault(name, real(frame, name)))
    last = corpus_pipeline.run(spark, folder).collect()
    rows = {name: [tuple(r) for r in frame.select("doc_id", "text", "lang", "source", "n_chars").collect()] for name, frame in stages.items()}
    before = [tuple(r) for r in table.collect()]

    model = quality.fit(table, labels.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    scores = {r: vote(model, r[1]) for r in set(before)}
    clear = {r for r, x in scores.items() if abs(x - quality.CUT) > 2e-3}
    now = rows["pipeline-quality"]
    assert Counter(r for r in now if r in clear) == Counter(r for r in before if r in clear and scores[r] >= quality.CUT)
    assert not Counter(now) - Counter(before) and 50 < len(now) < len(before)

    sets, before = {}, now
    for i, text, *_ in before:
        w = [bytes(x).lower() for x in words(text)]
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    sets.pop(None, None)
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp, now = least(links, sets), rows["pipeline-near_duplicates"]
    assert Counter(now) == Counter(r for r in before if r[0] is None or comp[r[0]] == r[0]) and len(now) < len(before)

    held, before = set(), now
    for r in items.collect():
        w = decontaminate.words_of(r.text)
        held |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9) if w else 0)}
    sizes, now = {len(k) for k in held}, rows["pipeline-benchmark"]
    hit = lambda w: any(tuple(w[i : i + n]) in held for n in sizes for i in range(len(w) - n + 1))
    assert Counter(now) == Counter(r for r in before if not hit(decontaminate.words_of(r[1]))) and len(now) < len(before)

    def redacted(text):
        merged = []
        for a, b in sorted((m.start(), m.end()) for _, p, group, n, _ in secrets.RULES for m in re.finditer(p, text or "", re.A) if len(m[group]) >= n):
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        for a, b in reversed(merged):
            text = text[:a] + "[SECRET]" + text[b:]
        return text

    before, now = now, rows["pipeline-secrets"]
    assert Counter(now) == Counter((i, redacted(t), lang, source, n if redacted(t) == t else len(redacted(t))) for i, t, lang, source, n in before) and Counter(now) != Counter(before)

    def topic(text):
        return "legal" if "License" in (text or "") else "contact" if "@" in (text or "") else "prose"

    weight, factor = mixed((cell(r[3], r[2], topic(r[1])), len(words(r[1]))) for r in now)
    want = Counter()
    for r in now:
        own = weight[cell(r[3], r[2], topic(r[1]))]
        assert abs(draw(r[0]) - factor * own) > 2e-6
        if draw(r[0]) < factor * own:
            want[r] += 1
            got = next(x for x in last if tuple(x)[:5] == r)
            assert (got.weight, got.prob, got.repeat) == pytest.approx((own, min(1, factor * own), max(1, factor * own)), abs=2e-5), (r[0], own, factor, weight)
    assert Counter(tuple(r)[:5] for r in last) == want and all((r.topic, r.n_tokens) == (topic(r.text), len(words(r.text))) for r in last)


def test_stages_on_odd_tables(spark, odd):
    """Odd rows, no rows, and columns named like those that a stage adds: the documents' own columns come back."""
    names = ["held_out", "score", "predicted", "hits", "n_words", "spans", "blob_id", "topic", "weight", "prob", "repeat", "n_tokens"]
    wide = odd.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(f"own {c}").alias(c) for c in names])
    want = Counter(tuple(r) for r in wide.collect())
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, wide, SF)
        rows = [r for r in out.collect() if name != "secrets" or r.doc_id != 7]  # its run of hex digits is a secret
        assert stage(spark, wide.limit(0), SF).count() == 0 and len(set(out.columns)) == len(out.columns)
        if name != "mixing":
            assert out.columns == wide.columns and not Counter(tuple(r) for r in rows) - want
        else:
            assert set(wide.columns) <= set(out.columns) and all(r.score == "own score" and r.topic != "own topic" for r in rows)


@pytest.mark.parametrize("name", sorted(entry.llm_queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    cursor = con.execute(entry.oracle_sql()[name])
    names = sorted(d[0] for d in cursor.description)
    want = sorted(tuple(dict(zip([d[0] for d in cursor.description], r, strict=True))[c] for c in names) for r in cursor.fetchall())
    frame = entry.queries()[name](spark, SF)
    assert sorted(frame.columns) == names and sorted(tuple(r[c] for c in names) for r in frame.collect()) == want
