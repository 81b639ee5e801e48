"""Personal data: exact base detectors, and boosted trees over high-recall candidates around them."""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import slices, written

KINDS = ("email", "ip", "card", "phone")
#: Precision that a kind's cut must reach on held-out candidates.
PRECISION = 0.995
TREES, DEPTH, RATE = 40, 3, 0.3
#: Sums over examples are whole multiples of 1 / UNIT, so that they are the same in every order.
UNIT = 1 << 24

_EMAIL_AT = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Runs of digits are tried from their first digit only and never given back, so that long runs take linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: High-recall generators; they may overlap each other and the base spans. Addresses are led by their sign, as ``_wide_emails`` says.
_SIGN = re.compile(r"@|\(at\)|\[at\]|(?<=\x20)at(?=\x20)")
_HOST = re.compile(r"\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z0-9-]++)++")
WIDE = {
    "ip": re.compile(r"[0-9]{1,3}(?:[.,][0-9]{1,3}){2,4}"),
    "card": re.compile(r"[0-9](?:[\x20.-]{0,2}[0-9]){11,}"),
    "phone": re.compile(r"(?:\+|\(?[0-9])[\x20()./0-9-]{7,}[0-9]"),
}
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
CUES = {
    "email": ("mail", "contact", "write", "@"),
    "ip": ("ip", "host", "server", "addr"),
    "card": ("card", "visa", "pay", "credit"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
}


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the base pattern finds them, but led by the @ signs, so that texts without any cost nothing."""
    at, done = text.find("@"), 0
    while at >= 0:
        tail = _EMAIL_AT.match(text, at + 1)
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if tail and start < at:
            yield start, tail.end()
            done = tail.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of the base detectors, by start, then kind."""
    out = [(s, 0, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0") or "0") <= 3 and int(p) <= 255 for part in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(map(str.isdigit, m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def _wide_emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses with any sign: a host after it, a name before it. The walk back ends at the sign before."""
    last = 0
    for m in _SIGN.finditer(text):
        host = _HOST.match(text, m.end())
        start = low = m.start() - (m.start() > last and text[m.start() - 1] == " ")
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if host and start < low:
            yield start, host.end()
        last = m.end()


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, rank, end) of everything that could be personal data."""
    return [(s, 0, e) for s, e in _wide_emails(text)] + [(m.start(), KINDS.index(kind), m.end()) for kind, wide in WIDE.items() for m in wide.finditer(text)]


class Covered:
    """Disjoint intervals; touching tests and inserts by bisection."""

    def __init__(self, spans: list[tuple[int, int]] = []) -> None:  # noqa: B006
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def touches(self, a: int, b: int) -> bool:
        i = bisect.bisect_right(self.ends, a)
        return i < len(self.starts) and self.starts[i] < b

    def add(self, a: int, b: int) -> None:
        """An interval that touches none."""
        i = bisect.bisect_left(self.starts, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)


FEATURES = 20


def features(text: str, start: int, rank: int, end: int) -> list[float]:
    """Format and context of a candidate; none of them is the base detectors' own test."""
    span, before, after = text[start:end], text[max(0, start - 24) : start].lower(), text[end : end + 2]
    digits = [c for c in span if "0" <= c <= "9"]
    parts = re.split(r"[^0-9A-Za-z]+", span)
    last = parts[-1] if parts else ""
    return [
        len(span), len(digits), sum(c.isalpha() for c in span), len(parts), max(map(len, parts)), min(map(len, parts)),
        span.count("."), span.count("-"), span.count(" "), span.count("@"), float(span[0] == "+"), span.count("("),
        float(last.isalpha()) * len(last), max([int(p) for p in parts if p.isdigit() and len(p) < 5], default=0),
        float(bool(digits) and luhn("".join(digits))), float(any(c in before for c in CUES[KINDS[rank]])),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:] in ".-@"), float(after[:1] in "-@"),
    ]


def outside(text: str) -> list[tuple[int, int, int]]:
    """The candidates that touch no base span."""
    base = Covered([(a, b) for a, _, b in base_spans(text)])
    return [(s, k, e) for s, k, e in candidates(text) if not base.touches(s, e)]


def rewritten(span: str, rank: int) -> list[str]:
    """Forms of a base span that people write and the base detectors miss."""
    if rank == 0:
        name, _, host = span.partition("@")
        return [f"{name}{at}{host.replace('.', dot)}" for at, dot in ((" (at) ", " (dot) "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" at ", " dot "), (" @ ", "."))]
    if rank == 1:
        return [span.replace(".", ",")]
    if rank == 2:
        digits = re.sub("[^0-9]", "", span)
        return [gap.join(digits[i : i + 4] for i in range(0, len(digits), 4)) for gap in (".", "  ", "--")]
    return [span[1:], span[1:].replace(" ", ".").replace("-", "."), span[1:].replace(" ", "/").replace("-", "/")]


def unlabelled(span: str, rank: int) -> bool:
    """Whether a candidate is so like a rewritten span that it must not count as false: a bracketed (at), a card's check digit."""
    if rank == 0:
        return "(at)" in span or "[at]" in span
    digits = re.sub("[^0-9]", "", span)
    return rank == 2 and 14 <= len(digits) <= 19 and luhn(digits)


def examples(text: str) -> list[tuple[bool, list[float], int]]:
    """(true, features, rank): the text's own candidates, and those of each base span rewritten in its context."""
    out = [(False, features(text, s, k, e), k) for s, k, e in outside(text) if not unlabelled(text[s:e], k)]
    for a, rank, b in base_spans(text):
        lead = text[max(0, a - 64) : a]
        for form in rewritten(text[a:b], rank):
            part, start = lead + form + text[b : b + 64], len(lead)
            out += [(True, features(part, s, k, e), k) for s, k, e in outside(part) if k == rank and s < start + len(form) and start < e]
    return out


def _leaves(tree: list[tuple], x: np.ndarray) -> np.ndarray:
    """The node of a tree that each row ends in."""
    node = np.zeros(len(x), int)
    column, split, left, right = (np.array(c) for c in list(zip(*tree, strict=True))[:4])
    for _ in range(DEPTH):
        goes = x[np.arange(len(x)), column[node]] <= split[node]
        node = np.where(left[node] > 0, np.where(goes, left[node], right[node]), node)
    return node


@dataclass
class Boosted:
    """Gradient-boosted regression trees for the logistic loss, as arrays; kind-wise cuts."""

    trees: list[list[tuple]]
    bias: float
    cuts: tuple[float, ...]

    def chance(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.bias)
        for tree in self.trees:
            margin += RATE * np.array([n[4] for n in tree])[_leaves(tree, x)]
        return 1 / (1 + np.exp(-margin))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The chance in four decimals, so that few scores are distinct however many candidates are scored."""
        return np.round(self.chance(x), 4)


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """x, y, k and w of a batch of examples."""
    return (batch.column("x").flatten().to_numpy().reshape(batch.num_rows, FEATURES), *[batch.column(c).to_numpy() for c in ("y", "k", "w")])


def _sums(found: DataFrame, model: Boosted, tree: list[tuple]) -> dict[int, dict[int, list[tuple]]]:
    """For each leaf of the growing tree and each feature its values, with gradient, weight and examples at each.

    Every example is read; the driver gets one row for each distinct value of a feature (counts within a candidate)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, _, w = _columns(batch)
            p, node = model.chance(x), _leaves(tree, x)
            parts = (np.rint(w * (y - p) * UNIT), np.rint(w * p * (1 - p) * UNIT), w)
            for c in range(FEATURES):
                values, at = np.unique(x[:, c], return_inverse=True)
                cell = node * len(values) + at
                g, h, n = (np.bincount(cell, part) for part in parts)
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(some // len(values)), pa.array(np.full(len(some), c)), pa.array(values[some % len(values)]), *[pa.array(part[some].astype(np.int64)) for part in (g, h, n)]], ["node", "c", "v", "g", "h", "n"])

    sums = found.mapInArrow(run, "node long, c long, v double, g long, h long, n long").groupBy("node", "c", "v").agg(*[F.sum(s).alias(s) for s in "ghn"])
    out: dict[int, dict[int, list[tuple]]] = {}
    for r in sums.collect():
        out.setdefault(r.node, {}).setdefault(r.c, []).append((r.v, r.g / UNIT, r.h / UNIT, r.n))
    return out


def _tree(found: DataFrame, model: Boosted) -> list[tuple]:
    """One tree, grown a level a pass over all examples."""
    nodes: list[list] = [[0, 0.0, 0, 0, 0.0]]
    level = [0]
    for _ in range(DEPTH):
        sums, level = _sums(found, model, [tuple(n) for n in nodes]) if level else {}, []
        for me, features_ in sorted(sums.items()):
            best = (1e-3, 0, 0.0, (), ())
            for c, cells in sorted(features_.items()):
                v, g, h, n = (np.array(x) for x in zip(*sorted(cells), strict=True))
                if nodes[me][2] or n.sum() < 10:
                    break
                nodes[0][4] = nodes[0][4] if me else g.sum() / (h.sum() + 1.0)
                gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
                gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - g.sum() ** 2 / (h.sum() + 1)
                if len(gain) and gain.max() > best[0]:
                    i = int(gain.argmax())
                    best = (float(gain[i]), c, float((v[i] + v[i + 1]) / 2), (gl[i], g.sum() - gl[i]), (hl[i], h.sum() - hl[i]))
            if best[0] > 1e-3 and not nodes[me][2]:
                nodes[me][:4] = [best[1], best[2], len(nodes), len(nodes) + 1]
                level += [len(nodes), len(nodes) + 1]
                nodes += [[0, 0.0, 0, 0, float(g / (h + 1.0))] for g, h in zip(*best[3:], strict=True)]
    return [tuple(n) for n in nodes]


def boost(found: DataFrame) -> Boosted:
    """Fit on every example that is not held out; those that are set each kind's cut: the least score above
    which at least PRECISION of them are true (a kind for which there is none adds no spans)."""
    known = found.where("not h")
    true, n = known.agg(F.sum(F.col("w") * F.col("y")), F.sum("w")).first()
    if not n or true in (0, n):
        return Boosted([], -9.0, (2.0,) * len(KINDS))
    rate = min(max(true / n, 1e-3), 1 - 1e-3)
    model = Boosted([], float(np.log(rate / (1 - rate))), ())
    for _ in range(TREES):
        model.trees.append(_tree(known, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, k, w = _columns(batch)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(model.score(x)), pa.array(w * y), pa.array(w)], ["k", "s", "t", "n"])

    scored = found.where("h").mapInArrow(run, "k int, s double, t long, n long").groupBy("k", "s").agg(F.sum("t"), F.sum("n")).collect()  # 10,001 scores a kind at most
    cuts = []
    for k in range(len(KINDS)):
        own = np.array(sorted((tuple(r)[1:] for r in scored if r.k == k), reverse=True)).reshape(-1, 3)
        good = np.flatnonzero(np.cumsum(own[:, 1]) / np.cumsum(own[:, 2]) >= PRECISION) if own[:, 2].sum() >= 20 else []
        cuts.append(max(0.5, float(own[good[-1], 0])) if len(good) else 2.0)
    model.cuts = tuple(cuts)
    return model


def all_examples(docs: DataFrame) -> DataFrame:
    """The examples of all distinct texts: x, y, k, h (held out: a text's are fitted or held out together) and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, text in zip(batch.column("t").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if found := Counter((tuple(map(float, x)), int(y), k) for y, x, k in examples(text)):
                    held = zlib.crc32(text.encode("utf-8", "replace")) % 5 == 4
                    x, y, k = zip(*found, strict=True)
                    n = len(found)
                    yield pa.RecordBatch.from_arrays([pa.array([t] * n, pa.int64()), pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.int64()), pa.array(k, pa.int32()), pa.array([held] * n, pa.bool_()), pa.array(list(found.values()), pa.int64())], ["t", "x", "y", "k", "h", "w"])

    rows = docs.where("text is not null").select(F.xxhash64("text", F.lit(5)).alias("t"), "text").mapInArrow(run, "t long, x array<double>, y long, k int, h boolean, w long")
    once = rows.groupBy("t", "x", "y", "k", "h").agg(F.max("w").alias("w"))  # equal texts count once
    return once.groupBy("x", "y", "k", "h").agg(F.sum("w").alias("w"))


def fit(docs: DataFrame) -> Boosted:
    """Fitted on the candidates of all texts outside base spans, as only those are scored: false as they stand in the text, true
    where a base span is rewritten to a form that the base detectors miss, in its own context."""
    return boost(written(all_examples(docs), "pii-examples"))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` with pii: spans (kind, start, end, base), in code points, by start, then kind.

    Base spans always stay. A candidate that touches no base span joins them if its calibrated score
    passes its kind's cut; of overlapping ones the best scored stays (ties: the first). Null texts are empty; repeated rows get
    equal spans; an empty table, or one without candidates of both labels, adds nothing to the base. Texts of any
    length are scanned whole, in linear time. A column named pii is replaced.
    """
    model = fit(docs.select("text"))
    adds = min(model.cuts) <= 1
    out = docs.drop("pii")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema) + ", pii array<struct<kind:string,start:int,end:int,base:boolean>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = found(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([[{"kind": KINDS[r], "start": s, "end": e, "base": b} for s, r, e, b in row] for row in rows], kind)], [*part.schema.names, "pii"])

    def found(texts: list[str | None]) -> list[list[tuple]]:
        spans, more, x = [], [], []
        for i, text in enumerate(texts):
            text = text or ""
            spans.append(base_spans(text))
            if adds:
                base = Covered([(a, b) for a, _, b in spans[-1]])
                for s, rank, e in candidates(text):
                    if model.cuts[rank] <= 1 and not base.touches(s, e):
                        more.append((i, s, rank, e))
                        x.append(features(text, s, rank, e))
        added, taken = [[] for _ in spans], [Covered() for _ in spans]
        if more:
            scores = model.score(np.array(x))
            for n in np.argsort(-scores, kind="stable"):
                i, s, rank, e = more[n]
                if scores[n] >= model.cuts[rank] and not taken[i].touches(s, e):
                    taken[i].add(s, e)
                    added[i].append((s, rank, e))
        return [sorted([(*a, True) for a in own] + [(*a, False) for a in new]) for own, new in zip(spans, added, strict=True)]

    return out.mapInArrow(run, schema)


def redacted(text: str, spans: list[dict]) -> str:
    """The text with each span, overlapping ones as one, replaced by the first one's kind in brackets."""
    out, done = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
        if s["start"] >= done:
            out += [text[done : s["start"]], f"[{s['kind'].upper()}]"]
        done = max(done, s["end"])
    return "".join([*out, text[done:]])


def redact_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``find_personal_data`` replaced in their text; NULL texts stay NULL, repeated rows
    repeat, overlapping spans make one mark, a table without rows gives none; a column named pii goes."""
    found = find_personal_data(docs)
    schema = docs.drop("pii").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else redacted(t, p) for t, p in zip(batch.column("text").to_pylist(), batch.column("pii").to_pylist(), strict=True)]
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in schema.names]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return found.mapInArrow(run, schema)


def digest(frame: DataFrame) -> DataFrame:
    """The contract's columns of documents with their spans."""
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sha, all_spans = [[] for _ in KINDS], [], []
            for row in batch.column("pii").to_pylist():
                base = [s for s in row if s["base"]]
                for k, kind in enumerate(KINDS):
                    counts[k].append(sum(s["kind"] == kind for s in base))
                text = lambda spans: ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)
                sha.append(hashlib.sha256(text(base).encode()).hexdigest())
                all_spans.append(text(row))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(sha, pa.string()), pa.array(all_spans, pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return frame.select(F.col("doc_id").cast("long").alias("doc_id"), "pii").mapInArrow(run, schema)
