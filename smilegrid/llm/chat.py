"""Chat formatting: schema fingerprints select declarative mappings to canonical turns; one reversible template."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Layouts by name: (list of turns, role field, text field, their names for canonical roles), a list of plain texts whose roles
#: alternate, or the fields of single-turn records with their roles.
LAYOUTS = {
    "messages": {"list": "messages", "role": "role", "text": "content", "roles": {}},
    "conversations": {"list": "conversations", "role": "from", "text": "value", "roles": {"human": "user", "gpt": "assistant"}},
    "turns": {"list": "turns", "role": "speaker", "text": "text", "roles": {"human": "user", "bot": "assistant", "model": "assistant"}},
    "dialog": {"list": "dialog", "alternate": ("user", "assistant")},
    "instruction": {"fields": [("system", "system"), ("instruction", "user"), ("input", "user"), ("output", "assistant")]},
    "prompt_completion": {"fields": [("system", "system"), ("prompt", "user"), ("completion", "assistant")]},
    "prompt_response": {"fields": [("system", "system"), ("prompt", "user"), ("response", "assistant")]},
    "question_answer": {"fields": [("question", "user"), ("answer", "assistant")]},
    "chosen": {"fields": [("prompt", "user"), ("chosen", "assistant")]},
}
#: Fields that a record of a layout may lack.
OPTIONAL = {"system", "input"}
END = "</turn>"
SCHEMA = "layout string, fingerprint string, rest string, turns array<struct<role:string,text:string>>, formatted string, loss_spans array<struct<start:long,end:long>>"


def paths_of(value: object, at: str = "") -> set[str]:
    """Nested field paths of a parsed JSON value."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in (paths_of(v, f"{at}.{k}" if at else k) or {f"{at}.{k}" if at else k})}
    if isinstance(value, list):
        return {p for v in value for p in paths_of(v, f"{at}[]")} or {f"{at}[]"}
    return {at}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def _registry() -> dict[str, str]:
    out = {}
    for name, spec in LAYOUTS.items():
        if "fields" in spec:
            need, may = [f for f, _ in spec["fields"] if f not in OPTIONAL], [f for f, _ in spec["fields"] if f in OPTIONAL]
            shapes = [[*need, *[f for i, f in enumerate(may) if bits >> i & 1]] for bits in range(1 << len(may))]
        else:  # elements may lack a field, and some may be plain texts
            own, plain = [f"{spec['list']}[].{spec[k]}" for k in ("role", "text") if k in spec], f"{spec['list']}[]"
            shapes = [x for some in ([], own[:1], own[1:], own) for x in (some, [*some, plain]) if x]
        for shape in shapes:
            out.setdefault(fingerprint(set(shape)), name)
    return out


REGISTRY = _registry()
_KNOWN = {p for s in LAYOUTS.values() for p in ([f for f, _ in s["fields"]] if "fields" in s else [f"{s['list']}[]", *[f"{s['list']}[].{s[k]}" for k in ("role", "text") if k in s]])}

#: Fields whose value is one text, whatever is inside it.
_FIELDS = sorted({f for s in LAYOUTS.values() for f, _ in s.get("fields", [])})


def _text(value: object) -> str:
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


def canonical(record: str | None) -> tuple[str | None, str | None, str | None, list[tuple[str, str]]]:
    """A JSON record's layout, fingerprint, what its mapping leaves over (as JSON by path, or None), and turns.

    Paths that no layout knows are left out of the fingerprint and kept in the rest. An element of a list of turns that is no
    object is a text, the user's at even places and the assistant's at odd ones."""
    try:
        value = json.loads(record) if record is not None else None
    except ValueError:
        value = None
    if not isinstance(value, dict):
        return None, None, None, []
    known = {p for p in paths_of(value) if p in _KNOWN or any(p.startswith(f"{f}.") or p.startswith(f"{f}[]") for f in _FIELDS)}
    mark = fingerprint({next((f for f in _FIELDS if p not in _KNOWN and (p.startswith(f"{f}.") or p.startswith(f"{f}[]"))), p) for p in known})
    name = REGISTRY.get(mark)
    if name is None:
        return None, mark, json.dumps(value, ensure_ascii=False), []
    spec, turns = LAYOUTS[name], []
    if "fields" in spec:
        rest = {k: v for k, v in value.items() if k not in dict(spec["fields"])}
        for field, role in spec["fields"]:
            if field in value and not (field in OPTIONAL and not value[field]):
                if turns and turns[-1][0] == role:
                    turns[-1] = (role, f"{turns[-1][1]}\n\n{_text(value[field])}")
                else:
                    turns.append((role, _text(value[field])))
    else:
        rest = {k: v for k, v in value.items() if k != spec["list"]}
        for i, t in enumerate(value[spec["list"]] or []):
            if isinstance(t, dict) and "role" in spec:
                role = _text(t.get(spec["role"]))
                turns.append((spec["roles"].get(role, role), _text(t.get(spec["text"]))))
                rest |= {f"{spec['list']}[{i}].{k}": v for k, v in t.items() if k not in (spec["role"], spec["text"])}
            else:
                turns.append((spec.get("alternate", ("user", "assistant"))[i % 2], _text(t)))
    return name, mark, json.dumps(rest, ensure_ascii=False) if rest else None, turns


def escape(text: str) -> str:
    """Backslashes, turn heads and turn ends inside a text get a backslash before them."""
    return text.replace("\\", "\\\\").replace("###", "\\###").replace(END, "\\" + END)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\|###|:|</turn>)", r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[dict]]:
    """The formatted conversation, and the bounds (in code points) of each assistant text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"### {escape(role).replace(':', chr(92) + ':')}: ", escape(text)
        if role == "assistant":
            spans.append({"start": at + len(head), "end": at + len(head) + len(body)})
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


_HEAD = re.compile(r"### ((?:[^\\:]|\\.)*): ", re.S)


def _slashes(text: str, low: int, at: int) -> int:
    """How many backslashes stand right before a place, back to ``low``."""
    n = 0
    while at - n > low and text[at - n - 1] == "\\":
        n += 1
    return n


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns, read back."""
    turns, at = [], 0
    while at < len(formatted):
        head = _HEAD.match(formatted, at)
        end = formatted.index(END, head.end())
        while _slashes(formatted, head.end(), end) % 2:  # an escaped end
            end = formatted.index(END, end + 1)
        turns.append((unescape(head[1]), unescape(formatted[head.end() : end])))
        at = end + len(END) + 1
    return turns


def format_records(records: DataFrame, column: str = "record") -> DataFrame:
    """``records`` with layout, fingerprint, rest, turns, formatted and loss_spans in place of their JSON column.

    A layout's hash selects its mapping; unknown layouts, null or broken JSON get no layout and no turns (an
    empty formatted text). What a mapping leaves over is kept as JSON in rest, an unknown record whole. Null roles and texts are
    empty, missing optional fields give no turn, repeated rows repeat, texts of any length are kept whole, columns with those
    names are replaced, a table without rows gives none.
    """
    out = records.drop("layout", "fingerprint", "rest", "turns", "formatted", "loss_spans")
    rest = [c for c in out.columns if c != column]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.select(*[F.col(f"`{c}`") for c in rest]).schema)
    turn, span = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                read = [canonical(x.as_py()) for x in part.column(column)]
                done = [render(r[3]) for r in read]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in rest], pa.array([r[0] for r in read], pa.string()), pa.array([r[1] for r in read], pa.string()), pa.array([r[2] for r in read], pa.string()), pa.array([[{"role": a, "text": b} for a, b in r[3]] for r in read], turn), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], span)],
                    [*rest, "layout", "fingerprint", "rest", "turns", "formatted", "loss_spans"],
                )

    return out.mapInArrow(run, f"{schema}, {SCHEMA}" if schema else SCHEMA)


def records_of(turns: DataFrame) -> DataFrame:
    """One JSON record for each conversation, its turns in the order of turn, then role, then text; null texts are empty.

    Conversations are dealt by a hash of their id over layouts that can hold them: any over lists of messages, those whose
    roles have other names there over two more lists, those of one question and one answer over pairs of fields.
    """
    message = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(message)).alias("_m"))
    roles = F.transform("_m", lambda m: m["role"])

    def listed(layout: str) -> Column:
        spec = LAYOUTS[layout]
        back = {v: k for k, v in spec["roles"].items()}

        def named(role: Column) -> Column:
            out = role
            for ours, theirs in back.items():
                out = F.when(role == ours, theirs).otherwise(out)
            return out

        return F.to_json(F.struct(F.transform("_m", lambda m: F.struct(named(m["role"]).alias(spec["role"]), m["content"].alias(spec["text"]))).alias(spec["list"])))

    def paired(layout: str) -> Column:
        (_, question), (_, answer) = [f for f in LAYOUTS[layout]["fields"] if f[0] not in OPTIONAL]
        names = [f for f, _ in LAYOUTS[layout]["fields"] if f not in OPTIONAL]
        assert (question, answer) == ("user", "assistant")
        return F.to_json(F.struct(*[F.col("_m")[i]["content"].alias(n) for i, n in enumerate(names)]))

    plain = F.size(F.array_intersect(roles, F.array(*[F.lit(r) for r in sorted({r for s in LAYOUTS.values() for r in s.get("roles", {})})]))) == 0
    pair = roles == F.array(F.lit("user"), F.lit("assistant"))
    deal = F.pmod(F.xxhash64("conv_id"), F.lit(6))
    record = F.when(plain & (deal == 0), listed("conversations")).when(plain & (deal == 1), listed("turns"))
    for i, layout in enumerate(("instruction", "prompt_completion", "question_answer")):
        record = record.when(pair & (deal == i + 2), paired(layout))
    return rows.select("conv_id", record.otherwise(listed("messages")).alias("record"))


def digest(frame: DataFrame) -> DataFrame:
    """The contract's columns, read back from the formatted texts and their loss spans."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("formatted"), batch.column("loss_spans"), strict=True):
                text = text.as_py()
                turns = parse(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans.as_py())
                sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                rows.append((len(turns), sha, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)] if rows else [pa.array([], k) for k in (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return frame.select(F.col("conv_id").cast("long").alias("conv_id"), "formatted", "loss_spans").mapInArrow(run, schema)
