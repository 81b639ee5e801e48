"""Conversation repair against an exhaustive search, plain counts, and conversations cut into many segments."""

import hashlib
import heapq
import re
import zlib

import numpy as np
from hypothesis import given, settings, strategies as st

import __spark_entry__ as entry
from smilegrid.llm import repair as R

SF = "/root/testdata/sf0.001"
NOTHING = hashlib.sha256(b"").hexdigest()


def cheapest(rows):
    """Least (cost, letters, repaired) over all edits, by Dijkstra over (cost, letters); rows: (role, text, fault)."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, letters, i, roles, out = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, letters, out
        state = (i, roles[-1:], len(roles) == 1)
        if state in seen:
            continue
        seen.add(state)
        options = [(5, "I", r, "", 0) for r in ("user", "assistant")]
        if i < len(rows):
            role, text, fault = rows[i]
            options.append((2, "D", None, None, 1))
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                options += [(extra, "K", role, text, 1)] + [(1 + extra, "R", r, text, 1) for r in ("user", "assistant")]
        for c, letter, role, text, step in options:
            new = roles + (role[:1] or "?") if role is not None else roles
            if re.fullmatch("(s?(ua)*u?)?", new):
                heapq.heappush(heap, (cost + c, letters + letter, i + step, new, (*out, f"{role}:{text}") if role is not None else out))


def plain(rows):
    """The contract's row of one conversation's damaged (turn, role, text), in any order."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else None if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, letters, out = cheapest([(r, t, f) for (_, r, t), f in zip(rows, faults)])
    return (gaps, *[faults.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, letters, hashlib.sha256("\n".join(out).encode()).hexdigest())


def damaged(rows):
    by = {}
    for conv, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        what, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        out = by.setdefault(conv, [])
        if what == 0:
            continue
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        out += [(turn, "user" if what == 4 else role, text)] * (2 if what == 3 else 1)
    return by


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def told(frame):
    rows = frame.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in rows}


def test_op11_registered(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert told(entry.queries()["op11_repair_arcs"](spark, SF)) == {c: plain(x) for c, x in damaged(rows).items()}


def test_op11_odd_and_segments(spark):
    rng = np.random.default_rng(3)
    said = ["hello.", "what?", "cut off", "", " \n", "bye!", "same.", "same."]
    roles = ["user", "assistant", "system", "tool", "", "User", "admin"]
    rows = [(c, int(t) if rng.random() > 0.1 else None, str(rng.choice(roles, p=[0.35, 0.35, 0.1, 0.1, 0.02, 0.03, 0.05])), str(rng.choice(said))) for c in range(12) for t in rng.integers(0, 25, 20)]
    rows += [(50, 1, None, None), (50, None, "user", None), (None, 1, "user", "a."), (None, 2, "assistant", "b."), (60, 3, "user", "x" * 100_000), (60, 3, "user", "x" * 100_000), (70, 1, "assistant", "only.")]
    rows += [(99, t, ("user", "assistant")[t % 2 if t % 7 else 0], f"t{t // 3}.") for t in range(700)]  # a third of all rows
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, _key string, block int")
    want = {c: plain(x) for c, x in damaged(rows).items()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        edits, counts = R.repair(R.damage(frame), present="present")
        assert len({r.edit_id >> 33 for r in edits.where("conv_id = 99").collect()}) > 2
        assert told(R.digest(edits, counts)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    edits, counts = R.repair(frame.limit(0))
    assert edits.count() == 0 and R.digest(edits, counts).count() == 0
    dropped = spark.createDataFrame([(1, 1, "user", "a.", False), (1, 2, "user", "b.", None)], "conv_id long, turn long, role string, text string, there boolean")
    assert told(R.digest(*R.repair(dropped, present="there"))) == {1: (0, 0, 0, 0, 0, 0, "", NOTHING)}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 15), max_size=9), st.lists(st.integers(0, 9), max_size=3))
def test_walks_over_any_cuts(codes, cuts):
    rows = [(["system", "user", "assistant", "tool"][c % 4], str(i), [None, "truncated", "blank", "duplicate"][c // 4]) for i, c in enumerate(codes)]
    cost, letters, _ = cheapest(rows)
    bounds = sorted({0, len(codes), *[c for c in cuts if c < len(codes)]})
    x = np.array(codes, dtype=np.int64)
    starts, lengths = np.array(bounds[:-1] or [0]), np.diff(bounds) if len(bounds) > 1 else np.array([0])
    m = R.matrices(x, starts, lengths)
    before, behind = [np.array([0, R._FAR, R._FAR, R._FAR])], [R._END]
    for a in m:
        before.append(R._times(before[-1][None], a)[0])
    for a in m[::-1]:
        behind.insert(0, R._times(a, behind[0][:, None])[:, 0])
    assert behind[0][0] == cost
    got, state = "", 0
    for i in range(len(starts)):
        part = x[starts[i] : starts[i] + lengths[i]]
        ins, let, end = R.walks(part, np.array([0]), np.array([len(part)]), before[i][None], behind[i + 1][None], np.array([cost]), np.array([state]))
        got, state = got + R.spelled(ins, let), int(end[0])
    assert got + R._TAIL[state] == letters
