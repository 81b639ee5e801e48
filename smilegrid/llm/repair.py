"""Repair of conversations with the fewest edits, so that roles run as an optional system turn, then user and assistant in turn.

Turns are put in order once (a range sort, so that a long conversation is cut into segments of a partition each) and written.
A segment is a chain of rows over four states (nothing yet, after system, after user, after assistant); its least costs
from state to state are a 4 x 4 matrix, and matrices of segments are multiplied (least sums), so no task holds a conversation.
From the costs before and behind each segment, forward and backward least costs inside it tell all arcs that lie on some
cheapest path. A walk over them takes the least letter at each step. A sequence of letters leads to one state only, so the
frontier of a walk is a single state: each segment is walked from every state that a cheapest path may enter it in, and the
walks are put together afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import runs_of, written

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
_FAR = 1 << 40  # more than any cost
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
#: A row's code: its role's initial (s, u, a, other), plus 4 if truncated, 8 if blank, 12 if repeated.
_SPACES = " \t\n\x0b\x0c\r"
_NEXT = np.array([_USER, _USER, _ASSISTANT, _USER])  # the only user or assistant turn that may follow
_TAIL = {_START: "", _SYSTEM: "II", _USER: "I", _ASSISTANT: ""}


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least costs of inserts from state to state; of one row by code, from state to state; the state that keeping a row leads to (-1: none)."""
    closure = np.full((4, 4), _FAR)
    for q in range(4):
        closure[q, q] = 0
        closure[q, _NEXT[q]] = min(closure[q, _NEXT[q]], INSERT)
        two = _NEXT[_NEXT[q]]
        closure[q, two] = min(closure[q, two], 2 * INSERT)
    rows, keeps = np.full((16, 4, 4), _FAR), np.full((16, 4), -1)
    for code in range(16):
        initial, fault = code % 4, code // 4
        for q in range(4):
            rows[code, q, q] = DELETE
            if fault >= 2:
                continue
            extra = TRUNCATED * fault
            if (initial, q) == (0, _START):
                keeps[code, q] = _SYSTEM
            elif initial == (1 if _NEXT[q] == _USER else 2):
                keeps[code, q] = _NEXT[q]
            if keeps[code, q] >= 0:
                rows[code, q, keeps[code, q]] = min(rows[code, q, keeps[code, q]], extra)
            rows[code, q, _NEXT[q]] = min(rows[code, q, _NEXT[q]], REROLE + extra)
    return closure, rows, keeps


_CLOSURE, _ROW, _KEEPS = _tables()
_STEP = (_CLOSURE[None, :, :, None] + _ROW[:, None, :, :]).min(2)  # inserts, then a row
_END = _CLOSURE[:, [_START, _ASSISTANT]].min(1)  # inserts, then the end


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[..., :, :, None] + b[..., None, :, :]).min(-2), _FAR)


def _by_place(lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Place by place, the numbers of the chains that are that long."""
    order = np.argsort(-lengths, kind="stable")
    for p in range(int(lengths.max(initial=0))):
        yield p, order[: int(np.searchsorted(-lengths[order], -p, "left"))]


def matrices(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Least costs from state to state of each chain of rows."""
    out = np.tile(np.where(np.eye(4, dtype=bool), 0, _FAR), (len(starts), 1, 1))
    for p, chains in _by_place(lengths):
        out[chains] = _times(out[chains], _STEP[codes[starts[chains] + p]])
    return out


def walks(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, before: np.ndarray, behind: np.ndarray, total: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least letters of each chain from its ``entry`` state along arcs of cost ``total``: inserts before each row, its letter, last states.

    ``before`` holds the least costs of each state ahead of the chain, ``behind`` those from each state after it to the end.
    """
    n = len(codes)
    ahead, back = np.full((n, 4), _FAR), np.full((n, 4), _FAR)  # least costs of being before a row, and of all from there
    at = before.copy()
    for p, chains in _by_place(lengths):
        rows = starts[chains] + p
        ahead[rows] = _times(at[chains][:, None, :], _CLOSURE[None])[:, 0]
        at[chains] = _times(ahead[rows][:, None, :], _ROW[codes[rows]])[:, 0]
    at = behind.copy()
    for p, chains in reversed(list(_by_place(lengths))):
        rows = starts[chains] + p
        back[rows] = _times(_STEP[codes[rows]], at[chains][:, :, None])[:, :, 0]
        at[chains] = back[rows]
    after = np.empty((n, 4), dtype=np.int64)
    for i in range(len(starts)):
        s, e = starts[i], starts[i] + lengths[i]
        if e > s:
            after[s : e - 1], after[e - 1] = back[s + 1 : e], behind[i]
    inserts, letters, state = np.zeros(n, dtype=np.int8), np.zeros(n, dtype="S1"), entry.copy()
    for p, chains in _by_place(lengths):
        rows, q = starts[chains] + p, state[chains]
        code, want = codes[rows], total[chains]
        left = np.ones(len(chains), dtype=bool)
        for _ in range(3):
            spent = ahead[rows, q]
            delete = left & (spent + DELETE + after[rows, q] == want)
            follow = _NEXT[q]
            insert = left & ~delete & (spent + INSERT + back[rows, follow] == want)
            keep_to = _KEEPS[code, q]
            extra = np.where(code >= 8, _FAR, TRUNCATED * (code // 4))
            keep = left & ~delete & ~insert & (keep_to >= 0) & (spent + extra + after[rows, keep_to] == want)
            other = left & ~delete & ~insert & ~keep
            letters[rows[delete]], letters[rows[keep]], letters[rows[other]] = b"D", b"K", b"R"
            inserts[rows[insert]] += 1
            q = np.where(delete | ~left, q, np.where(keep, keep_to, follow))
            left &= insert
        state[chains] = q
    return inserts, letters, state


def spelled(inserts: np.ndarray, letters: np.ndarray) -> str:
    out = np.full(len(letters) + int(inserts.sum()), b"I", dtype="S1")
    out[np.arange(len(letters)) + np.cumsum(inserts)] = letters
    return out.tobytes().decode()


def _cuts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of runs of equal values."""
    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, int)
    return starts, np.diff(np.append(starts, len(values)))


_SEGMENT = "_key string, block long, codes binary, costs array<long>, blank long, duplicate long, truncated long, illegal long, first int, last int, turns long, low long, high long"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in runs_of(batches, "_seg"):
        starts, lengths = _cuts(table.column("_seg").to_numpy())
        there = table.column("present").to_numpy()
        codes = table.column("code").to_numpy()[there].astype(np.int64)
        raw = table.column("turn").combine_chunks()
        known = raw.is_valid().to_numpy(zero_copy_only=False)[there]
        turns = raw.fill_null(0).to_numpy(zero_copy_only=False)[there]
        sums = np.append(0, np.cumsum(there))
        heads, sizes = sums[starts], sums[starts + lengths] - sums[starts]
        costs = matrices(codes, heads, sizes)
        rows = []
        for i, (h, n) in enumerate(zip(heads, sizes, strict=True)):
            c, t = codes[h : h + n], turns[h : h + n][known[h : h + n]]
            x, fault = c % 4, c // 4
            legal = ((x[1:] == 1) & ((x[:-1] == 0) | (x[:-1] == 2))) | ((x[1:] == 2) & (x[:-1] == 1))
            rows.append((c.astype(np.uint8).tobytes(), costs[i].ravel(), *[int((fault == k).sum()) for k in (2, 3, 1)], int((~legal).sum()), int(x[0]) if n else -1, int(x[-1]) if n else -1, len(np.unique(t)), *((int(t.min()), int(t.max())) if len(t) else (None, None))))
        kinds = (pa.binary(), pa.list_(pa.int64()), *[pa.int64()] * 4, pa.int32(), pa.int32(), *[pa.int64()] * 3)
        at = pa.array(starts)
        out = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([table.column("_key").combine_chunks().take(at), table.column("block").combine_chunks().take(at), *out], ["_key", "block", "codes", "costs", "blank", "duplicate", "truncated", "illegal", "first", "last", "turns", "low", "high"])


_CARRY = "_key string, block long, before array<long>, behind array<long>, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every segment the least costs ahead of it and behind it; for its conversation the counts and the cost."""
    for table in runs_of(batches, "_key"):
        starts, lengths = _cuts(table.column("_key").to_numpy())
        costs = np.array(table.column("costs").combine_chunks().flatten()).reshape(-1, 4, 4)
        col = {c: table.column(c).to_pylist() for c in ("blank", "duplicate", "truncated", "illegal", "first", "last", "turns", "low", "high")}
        before, behind, whole = np.empty((len(table), 4), int), np.empty((len(table), 4), int), []
        for s, n in zip(starts, lengths, strict=True):
            at = np.array([0, _FAR, _FAR, _FAR])
            for i in range(s, s + n):
                before[i] = at
                at = _times(at[None], costs[i])[0]
            cost = int((at + _END).min())
            at = _END
            for i in reversed(range(s, s + n)):
                behind[i] = at
                at = _times(costs[i], at[:, None])[:, 0]
            illegal, distinct, last, low, high = sum(col["illegal"][s : s + n]), sum(col["turns"][s : s + n]), -1, None, None
            for i in range(s, s + n):
                if col["first"][i] >= 0:
                    illegal += last >= 0 and (last, col["first"][i]) not in ((0, 1), (1, 2), (2, 1))
                    last = col["last"][i]
                if col["low"][i] is not None:
                    distinct -= high is not None and high == col["low"][i]
                    low, high = col["low"][i] if low is None else low, col["high"][i]
            gaps = 0 if low is None else high - low + 1 - distinct
            whole += [(gaps, *[sum(col[c][s : s + n]) for c in ("blank", "duplicate", "truncated")], illegal, cost)] * n
        lists = [pa.array(list(x), pa.list_(pa.int64())) for x in (before, behind)]
        yield pa.RecordBatch.from_arrays([table.column("_key").combine_chunks(), table.column("block").combine_chunks(), *lists, *[pa.array(c, pa.int64()) for c in zip(*whole, strict=True)]], ["_key", "block", "before", "behind", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"])


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every segment the letters and the last state from each state that a cheapest path may enter it in."""
    for batch in batches:
        if not len(batch):
            continue
        before, behind = (np.array(batch.column(c).flatten()).reshape(-1, 4) for c in ("before", "behind"))
        costs, cost = np.array(batch.column("costs").flatten()).reshape(-1, 4, 4), batch.column("cost").to_numpy()
        inside = _times(costs, behind[:, :, None])[:, :, 0]
        seg, entry = np.nonzero(before + inside == cost[:, None])
        each = [np.frombuffer(c.as_buffer(), np.uint8).astype(np.int64) for c in batch.column("codes")]
        lengths = np.array([len(each[s]) for s in seg])
        heads = np.append(0, np.cumsum(lengths))[:-1]
        codes = np.concatenate([each[s] for s in seg])
        inserts, letters, state = walks(codes, heads, lengths, before[seg], behind[seg], cost[seg], entry)
        ways, ends = [[None] * 4 for _ in range(len(batch))], [[None] * 4 for _ in range(len(batch))]
        for s, q, h, n, last in zip(seg, entry, heads, lengths, state, strict=True):
            ways[s][q], ends[s][q] = spelled(inserts[h : h + n], letters[h : h + n]), int(last)
        yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("block"), pa.array(ways, pa.list_(pa.string())), pa.array(ends, pa.list_(pa.int32()))], ["_key", "block", "ways", "ends"])


def _picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The letters of every segment, with the state before it, segment after segment."""
    key, held = None, None  # held: the last segment seen, whose conversation may go on

    def row(last: bool) -> tuple:
        k, block, state, letters, end = held
        return k, block, state, letters + (_TAIL[end] if last else "")

    for batch in batches:
        rows = []
        for k, block, ways, ends in zip(*(batch.column(c).to_pylist() for c in ("_key", "block", "ways", "ends")), strict=True):
            if held is not None:
                rows.append(row(k != key))
            state = held[4] if held is not None and k == key else _START
            key, held = k, (k, block, state, ways[state], ends[state])
        yield _letters(rows)
    if held is not None:
        yield _letters([row(True)])


def _letters(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.string()), strict=True)], ["_key", "block", "state", "letters"])


def _edited(schema: pa.Schema):
    names = ["_key", "edit_id", "edit", "turn", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, place, state, letters = None, 0, 0, ""
        rows: list[tuple] = []

        def inserted(key, block):
            nonlocal place, state
            state = int(_NEXT[state])
            rows.append((key, (block << 33) + place, "I", None, "user" if state == _USER else "assistant", ""))
            place += 1

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 6, schema.types, strict=True)], names)

        for batch in batches:
            for key, block, first, all_, turn, role, text, present in zip(*(batch.column(c).to_pylist() for c in ("_key", "block", "state", "letters", "turn", "role", "text", "present")), strict=True):
                if (key, block) != seg:
                    while place < len(letters):  # what is inserted after the last turn
                        inserted(*seg)
                    seg, place, state, letters = (key, block), 0, first, all_
                if not present:
                    continue
                while letters[place] == "I":
                    inserted(key, block)
                letter = letters[place]
                if letter == "R":
                    state = int(_NEXT[state])
                    role = "user" if state == _USER else "assistant"
                elif letter == "K":
                    state = _SYSTEM if role[:1] == "s" else int(_NEXT[state])
                rows.append((key, (block << 33) + place, letter, turn, role, text))
                place += 1
                if len(rows) >= 1_000:
                    yield batch_of()
                    rows.clear()
        while place < len(letters):
            inserted(*seg)
        yield batch_of()

    return run


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and present (false: the row is dropped) of ``turns``, damaged by crc32 of ``conv_id:turn``; nulls count as one space, but turns stay null."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    what = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])) % 20
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), what.alias("_what"), role.alias("role"), text.alias("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("_what") == 4, "user").otherwise(F.col("role")).alias("role"),
                       F.when(F.col("_what") == 1, "").when(F.col("_what") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
                       (F.col("_what") != 0).alias("present"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("_what") == 3, 2).otherwise(1))).alias("_copy"))
    return rows.drop("_copy")


def repair(turns: DataFrame, present: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The edits of all conversations and a row of counts for each.

    Edits: conv_id, edit_id (their order within a conversation), edit (D delete, I insert, K keep, R rerole), turn, role, text (for
    what stays: as repaired; for D: as it was). Conversations: conv_id, gaps, blank, duplicate, truncated, illegal, cost.
    ``turns`` needs conv_id, turn, role and text; other columns are not read. With ``present`` rows where that column is not
    true are left out, but their conversations are not. Turns are ordered by turn (nulls first), then role, then text; null roles and texts
    count as one space, a null conv_id is a conversation of its own, repeated rows are duplicates, texts of any length are kept
    whole, a table without rows gives none.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    rows = turns.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit("\x00")).alias("_key"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (F.coalesce(F.col(present), F.lit(False)) if present else F.lit(True)).alias("present"))
    near = F.substring(F.concat_ws("\x00", "role", "text"), 1, 64)  # a short key: the bounds of ranges are sampled into the driver
    rows = rows.repartitionByRange("_key", "turn", near).sortWithinPartitions("_key", "turn", "role", "text").withColumn("seq", F.monotonically_increasing_id())
    last = F.right(F.rtrim("text", F.lit(_SPACES)), F.lit(1))
    initial = F.when(F.startswith("role", F.lit("s")), 0).when(F.startswith("role", F.lit("u")), 1).when(F.startswith("role", F.lit("a")), 2).otherwise(3)
    fault = F.when(last == "", 8).when(last.isin(".", "!", "?"), 0).otherwise(4)
    digest = F.unhex(F.sha2(F.concat_ws("\x00", F.length("role"), "role", "text"), 256))
    rows = rows.withColumns({"block": F.shiftright("seq", 33), "code": initial + fault, "digest": digest})
    rows = rows.withColumn("_seg", F.concat_ws("\x01", "_key", F.lpad(F.col("block").cast("string"), 10, "0")))
    rows = written(rows, "repair-turns")

    few = rows.select("_key", "_seg", "block", "seq", "turn", "present", "code", "digest")
    again = few.where("present").groupBy("_key", "digest").agg(F.min("seq").alias("first_seq"), F.count("*").alias("n")).where("n > 1").drop("n")
    few = few.join(again, ["_key", "digest"], "left")
    few = few.withColumn("code", F.when((F.col("code") < 8) & (F.col("seq") > F.col("first_seq")), F.col("code") % 4 + 12).otherwise(F.col("code")))
    few = few.select("_key", "_seg", "block", "seq", "turn", "present", "code").repartition("_seg").sortWithinPartitions("_seg", "seq")
    segments = written(few.mapInArrow(_segments, _SEGMENT), "repair-segments")

    carried = segments.drop("codes").repartition("_key").sortWithinPartitions("_key", "block").mapInArrow(_carried, _CARRY)
    carried = written(carried, "repair-costs")
    walked = segments.select("_key", "block", "codes", "costs").join(carried.select("_key", "block", "before", "behind", "cost"), ["_key", "block"])
    walked = walked.mapInArrow(_walked, "_key string, block long, ways array<string>, ends array<int>")
    letters = walked.repartition("_key").sortWithinPartitions("_key", "block").mapInArrow(_picked, "_key string, block long, state int, letters string")

    joined = rows.select("_key", "block", "seq", "turn", "role", "text", "present").join(letters, ["_key", "block"])
    joined = joined.repartition("_key", "block").sortWithinPartitions("_key", "block", "seq")
    kinds = pa.schema([("_key", pa.string()), ("edit_id", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    edits = joined.mapInArrow(_edited(kinds), "_key string, edit_id long, edit string, turn long, role string, text string")
    counts = carried.groupBy("_key").agg(*[F.first(c).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")])
    kind = turns.schema["conv_id"].dataType
    back = F.when(F.col("_key") != "\x00", F.col("_key")).cast(kind).alias("conv_id")
    return edits.select(back, *edits.columns[1:]), counts.select(back, *counts.columns[1:])


def digest(edits: DataFrame, counts: DataFrame) -> DataFrame:
    """The contract's columns: a conversation's audit and hash are built in one pass over its sorted edits, which holds only the letters."""
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("\x00")).alias("_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, audit, sha, empty = None, [], hashlib.sha256(), True

        for batch in batches:
            rows = []
            for k, edit, role, text in zip(*(batch.column(c).to_pylist() for c in ("_key", "edit", "role", "text")), strict=True):
                if k != now:
                    if now is not None:
                        rows.append((now, "".join(audit), sha.hexdigest()))
                    now, audit, sha, empty = k, [], hashlib.sha256(), True
                audit.append(edit)
                if edit != "D":
                    sha.update((f"{role}:{text}" if empty else f"\n{role}:{text}").encode())
                    empty = False
            yield _strings(rows)
        if now is not None:
            yield _strings([(now, "".join(audit), sha.hexdigest())])

    def _strings(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows, strict=True) if rows else [[]] * 3)], ["_key", "audit", "repaired_sha256"])

    told = edits.select(key, "edit_id", "edit", F.when(F.col("edit") != "D", F.col("role")).alias("role"), F.when(F.col("edit") != "D", F.col("text")).alias("text"))
    told = told.repartition("_key").sortWithinPartitions("_key", "edit_id").mapInArrow(run, "_key string, audit string, repaired_sha256 string")
    out = counts.withColumn("_key", key).join(told, "_key", "left")
    nothing = hashlib.sha256().hexdigest()
    return out.select(*counts.columns, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
