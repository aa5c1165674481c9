"""Chat formatting from event logs.

An event has conv_id, turn, seq, kind, role and text. Events of one turn are folded in order of seq into final messages:

* ``message`` begins a new message with its role and text
* ``delta`` adds its text to the turn's latest message, ``edit`` replaces that message's text
* ``regenerate`` empties the latest message's text, for the deltas that follow; a role given by any event replaces the message's role
* ``delete`` drops the latest message
* an event other than ``delete`` that finds no message begins one

Logs are partitioned by conversation and turn, so a conversation of any length is spread over many tasks; a task holds one message at a
time. Ties in seq go by kind, role and text, so repeated rows are repeated events. Null text is empty, a null role the empty role, a null
turn or seq comes first, null conversations are one conversation. Unknown kinds are errors.

Each message is rendered to a segment that marks its turn, with control strings inside texts escaped by a backslash after their first
letter, which ``restore`` takes out again; the loss mask is the place of an assistant's text in its segment. The formatted conversation is
the segments in order of (turn, number). An empty log gives no segments. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Strings that have a meaning to the template or to tokenizers; none appears inside a rendered text.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE", "[/ROLE]", "<|im_start|>", "<|im_end|>", "<|startoftext|>", "<|endoftext|>")
_PLAIN = re.compile("|".join(rf"{re.escape(c[0])}(\\*){re.escape(c[1:])}" for c in CONTROL))
_ESCAPED = re.compile("|".join(rf"{re.escape(c[0])}\\(\\*){re.escape(c[1:])}" for c in CONTROL))
#: What stands before and after a text, by role; other roles name themselves.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>"), "system": ("<<SYS>>\n", "\n<</SYS>>\n\n")}
KINDS = ("message", "delta", "edit", "regenerate", "delete")
_SEGMENT = re.compile(r"\[INST\] (?P<user>.*) \[/INST\]|<<SYS>>\n(?P<system>.*)\n<</SYS>>\n\n|\[ROLE (?P<length>\d+) (?P<other>.*) \[/ROLE\]| (?P<assistant>.*) </s>", re.S)


def protect(text: str) -> str:
    """Escape control strings, already escaped ones too."""
    return _PLAIN.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def restore(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def render(role: str, text: str) -> tuple[str, int | None, int | None]:
    """The segment, and where its loss mask begins and ends."""
    body = protect(text)
    if role in MARKS:
        before, after = MARKS[role]
        return before + body + after, len(before) if role == "assistant" else None, len(before) + len(body) if role == "assistant" else None
    name = protect(role)
    return f"[ROLE {len(name)} {name}{body} [/ROLE]", None, None


def parse(segment: str) -> tuple[str, str]:
    """Role and text of a segment."""
    m = _SEGMENT.fullmatch(segment)
    if m is None:
        raise ValueError("not a segment")
    for role in MARKS:
        if m[role] is not None:
            return role, restore(m[role])
    size = int(m["length"])
    return restore(m["other"][:size]), restore(m["other"][size:])


def formatted(events: DataFrame) -> DataFrame:
    """conv_id, turn, number (message of the turn, from 0), segment, loss_from and loss_to (code points of the segment; null without loss)."""
    conv, turn = (events.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    log = events.select("conv_id", "turn", "seq", "kind", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.col("text").cast("string").alias("text"))
    log = log.repartition("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "seq", "kind", "role", "text")

    def fold(batches):
        key, number, role, parts = None, 0, None, None
        for batch in batches:
            out = []

            def close():
                nonlocal number, parts
                if parts is not None:
                    out.append((*key, number, *render(role, "".join(parts))))
                    number += 1
                parts = None

            for row in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "kind", "role", "text"))):
                if key != row[:2]:
                    if key is not None:
                        close()
                    key, number, role, parts = row[:2], 0, None, None
                kind, said, text = row[2], row[3], row[4] or ""
                if kind not in KINDS:
                    raise ValueError(f"unknown kind of event: {kind}")
                if kind == "delete":
                    parts = None
                    continue
                if kind == "message":
                    close()
                if parts is None:
                    role, parts = said, []
                if kind in ("message", "delta"):
                    parts.append(text)
                else:
                    parts = [text] if kind == "edit" else []
                role = said or role
            yield _segments(out, schema)
        if parts is not None:
            yield _segments([(*key, number, *render(role, "".join(parts)))], schema)

    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "smallint": pa.int16()}
    schema = pa.schema([("conv_id", kinds[conv]), ("turn", kinds[turn]), ("number", pa.int64()), ("segment", pa.string()), ("loss_from", pa.int64()), ("loss_to", pa.int64())])
    return log.mapInArrow(fold, f"conv_id {conv}, turn {turn}, number bigint, segment string, loss_from bigint, loss_to bigint")


def _segments(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def read_back(segments: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from its segments in a stream: a digest runs over the whole of a conversation in order, so one
    task reads it, but holds one segment at a time."""
    conv = segments.schema["conv_id"].dataType.simpleString()
    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "number")

    def run(batches):
        key = state = None
        for batch in batches:
            out = []
            for conv_id, segment, low, high in zip(*(batch[c].to_pylist() for c in ("conv_id", "segment", "loss_from", "loss_to"))):
                if state is None or key != conv_id:
                    if state is not None:
                        out.append((key, *finish(state)))
                    key, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse(segment)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if low is not None:
                    under = restore(segment[low:high])
                    state[2] += len(under)
                    state[3].update(under.encode())
                state[4] += len(segment)
            yield table(out)
        if state is not None:
            yield table([(key, *finish(state))])

    def finish(state):
        return state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

    def table(rows):
        names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
        kinds = ({"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "smallint": pa.int16()}[conv], pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], list(names))

    return ordered.mapInArrow(run, f"conv_id {conv}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
