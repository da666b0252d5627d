"""Conversations as training texts: columnar byte assembly with a loss mask.

Rows are brought together by conversation and sorted by turn inside Spark; a task then streams over
them and holds one slice of rows and the conversation that it is building.  In a slice the segments
(header, escaped content, footer of every turn) get their lengths and cumulative offsets in numpy,
and headers, contents and footers are scattered into one preallocated buffer that becomes the
Arrow column.

Template: every turn stands between two control strings of its role, each on a line of its own.
A control string inside a text gets a backslash in front, backslashes before it are doubled; so a
control string of the template is never preceded by a backslash and reading back is exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from seriesmill.llm.memo import slices, spans

# Control strings around the text of a role; other roles write their name between two more.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER, NAMED, OTHER_END = "[ROLE]", "[TEXT]", "[/ROLE]"
CONTROL = r"\[/?INST\]|</?s>|<</?SYS>>|\[/?ROLE\]|\[TEXT\]"
LEARNT = "assistant"
SLICE_BYTES = 4 << 20

_escaped = re.compile(rf"(\\+)({CONTROL})")
_mark = re.compile(rf"(?<!\\)(?:{CONTROL})")


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, pattern=rf"(\\*)({CONTROL})", replacement=r"\1\1\\\2")


def unescape(text: str) -> str:
    return _escaped.sub(lambda m: m[1][: len(m[1]) // 2] + m[2], text)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    opening = {begin: (role, end) for role, (begin, end) in MARKS.items()}
    turns, at = [], 0
    while at < len(formatted):
        begin = _mark.match(formatted, at)
        start = begin.end() + 1
        if begin[0] == OTHER:
            name = _mark.search(formatted, start)
            role, start, last = unescape(formatted[start:name.start() - 1]), name.end() + 1, OTHER_END
        else:
            role, last = opening[begin[0]]
        end = _mark.search(formatted, start)
        if end[0] != last:
            raise ValueError(f"{last} expected, {end[0]} found")
        turns.append((role, unescape(formatted[start:end.start() - 1])))
        at = end.end() + 1
    return turns


def header(role: str) -> str:
    if role in MARKS:
        return MARKS[role][0] + "\n"
    return f"{OTHER}\n{escape(pa.array([role], pa.string()))[0].as_py()}\n{NAMED}\n"


def footer(role: str) -> str:
    return f"\n{MARKS[role][1] if role in MARKS else OTHER_END}\n"


def assemble(roles: list[str], texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all turns in one buffer, with each turn's end in bytes, and in code points its
    length and where its content begins and ends in it."""
    texts = escape(texts)
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kinds = {r: i for i, r in enumerate(dict.fromkeys(roles))}
    kind = np.array([kinds[r] for r in roles], np.int64)
    parts = [[f(r) for r in kinds] for f in (header, footer)]
    sizes = [np.array([len(x.encode()) for x in p], np.int64)[kind] for p in parts]
    points = [np.array([len(x) for x in p], np.int64)[kind] for p in parts]
    content = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes[0] + content + sizes[1])
    out = np.empty(int(ends[-1]), np.uint8)
    starts = ends - sizes[0] - content - sizes[1]
    for part, size, at in ((parts[0], sizes[0], starts), (parts[1], sizes[1], ends - sizes[1])):
        flat = np.frombuffer("".join(part).encode(), np.uint8)
        lengths = np.array([len(x.encode()) for x in part], np.int64)
        out[spans(at, size)] = flat[spans((np.cumsum(lengths) - lengths)[kind], size)]
    offsets = np.frombuffer(texts.buffers()[1], np.int32 if texts.type == pa.string() else np.int64)[texts.offset:texts.offset + len(texts) + 1]
    body = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    if len(texts) == 1:  # a very long text needs no scatter indices
        out[starts[0] + sizes[0][0]:ends[0] - sizes[1][0]] = body[offsets[0]:offsets[1]]
    else:
        out[spans(starts + sizes[0], content)] = body[offsets[0]:offsets[-1]]
    return out, ends, points[0] + chars + points[1], np.stack([points[0], points[0] + chars])


SCHEMA = "formatted string, loss array<struct<start: long, end: long>>, turns long"


def format_conversations(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss (spans in code points), turns.

    Turns are ordered by turn, equal turns by role, then text; a null turn comes first.  A null text
    or role is empty, a null conversation is one of its own; repeated rows are turns of their own;
    other columns are ignored; an empty table gives an empty result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, length, loss, turns = None, [], 0, [], 0
        done: list[list] = [[], [], [], []]

        def flush(kind: pa.DataType) -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([
                pa.array(done[0], kind), pa.array(done[1], pa.string()),
                pa.array(done[2], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(done[3], pa.int64()),
            ], names=["conv_id", "formatted", "loss", "turns"])
            for column in done:
                column.clear()
            return batch

        def finish() -> None:
            for column, value in zip(done, (current[0], b"".join(held).decode(), loss, turns), strict=True):
                column.append(value)

        kind = pa.int64()
        for batch in batches:
            kind = batch.column("conv_id").type
            texts = batch.column("text")
            for low, high in slices(pc.binary_length(texts).to_numpy(zero_copy_only=False), SLICE_BYTES):
                roles = batch.column("role").slice(low, high - low).to_pylist()
                ids = batch.column("conv_id").slice(low, high - low).to_pylist()
                out, ends, chars, content = assemble(roles, texts.slice(low, high - low))
                begin = 0
                for i, name in enumerate(ids):
                    if current is None or current[0] != name:
                        if current is not None:
                            finish()
                        current, held, length, loss, turns = (name,), [], 0, [], 0
                        begin = int(ends[i - 1]) if i else 0
                    if roles[i] == LEARNT:
                        loss.append({"start": length + int(content[0][i]), "end": length + int(content[1][i])})
                    length += int(chars[i])
                    turns += 1
                    if i + 1 == len(ids) or ids[i + 1] != name:
                        held.append(out[begin:int(ends[i])].tobytes())
                        begin = int(ends[i])
                if done[0]:
                    yield flush(kind)
        if current is not None:
            finish()
            yield flush(kind)

    plain = rows.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = plain.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, f"conv_id {plain.schema['conv_id'].dataType.simpleString()}, {SCHEMA}")
