"""Chat template by columnar byte assembly: lengths, offsets and scatter indices, one buffer."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from teleloom.llm.common import small_batches

# The template of one turn: BEGIN role MIDDLE text END.
BEGIN, MIDDLE, END = b"<s>[INST] ", b" [/INST] ", b"</s>"
# A control string gets a backslash behind its first character; one that has backslashes there already
# gets one more. So no control string is left in a text, and taking one away gives the text again.
CONTROL = r"([<\[])(\\*)(/?s>|/?INST\])"
ESCAPED = re.compile(r"([<\[])\\(\\*)(/?s>|/?INST\])")
TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\] (.*?)</s>", re.S)
TRAINED_ROLE = "assistant"
#: A conversation is cut into parts of at most so many input bytes, so that none has to fit into memory.
PART_BYTES = 8 << 20
PARTS = "part int, last boolean, n_turns bigint, formatted string, loss_starts array<bigint>, loss_ends array<bigint>"


def escape(values: pa.Array) -> pa.Array:
    """Texts with every control string broken up; reversible."""
    return pc.replace_substring_regex(values, pattern=CONTROL, replacement=r"\1\\\2\3")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def _bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its offsets into them."""
    values = values.cast(pa.large_string())
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(values) + 1, values.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _scatter(buffer: np.ndarray, at: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> None:
    """Copy value i of (raw, offsets) to position at[i] of the buffer."""
    if len(raw):
        buffer[np.repeat(at - offsets[:-1], np.diff(offsets)) + np.arange(len(raw))] = raw


def _constant(buffer: np.ndarray, at: np.ndarray, value: bytes) -> None:
    buffer[at[:, None] + np.arange(len(value))] = np.frombuffer(value, np.uint8)


def assemble(roles: pa.Array, texts: pa.Array, groups: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Formatted strings of the groups (first turn of each given), and each turn's text span in bytes.

    Spans count from the start of the turn's string.
    """
    role_raw, role_at = _bytes(escape(roles))
    text_raw, text_at = _bytes(escape(texts))
    role_len, text_len = np.diff(role_at), np.diff(text_at)
    turn_at = np.concatenate([[0], np.cumsum(role_len + text_len + len(BEGIN) + len(MIDDLE) + len(END))])
    buffer = np.empty(turn_at[-1], np.uint8)
    role_to = turn_at[:-1] + len(BEGIN)
    middle_to = role_to + role_len
    text_to = middle_to + len(MIDDLE)
    _constant(buffer, turn_at[:-1], BEGIN)
    _scatter(buffer, role_to, role_raw, role_at)
    _constant(buffer, middle_to, MIDDLE)
    _scatter(buffer, text_to, text_raw, text_at)
    _constant(buffer, text_to + text_len, END)
    bounds = np.concatenate([turn_at[groups], turn_at[-1:]])
    strings = pa.LargeStringArray.from_buffers(len(groups), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(buffer))
    base = np.repeat(bounds[:-1], np.diff(np.concatenate([groups, [len(roles)]])))
    return strings, text_to - base, text_to + text_len - base


def _parts(ids: list, sizes: np.ndarray, part: int, seen: int) -> tuple[list[int], list[int], int, int]:
    """First rows and part numbers of the output rows; the state of the last one goes on to the next batch."""
    firsts, numbers = [], []
    for i, key in enumerate(ids):
        if i == 0 or key != ids[i - 1]:
            part, seen = (part, seen) if i == 0 else (0, 0)
            firsts.append(i)
            numbers.append(part)
        elif seen + sizes[i] > PART_BYTES:
            part, seen = part + 1, 0
            firsts.append(i)
            numbers.append(part)
        seen += int(sizes[i])
    return firsts, numbers, part, seen


def format_conversations(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Formatted conversations: (conv, part, last, n_turns, formatted, loss_starts, loss_ends).

    Rows are dealt by conversation, sorted by turn (ties by role, then text) and streamed, so that a task
    holds a batch and not a conversation. A conversation gives one row; one of more than ``PART_BYTES``, or
    that goes over a batch, gives several in order within one partition, the last one marked. The loss spans
    are the byte ranges of the assistant's escaped texts in ``formatted``.

    Null roles and texts are empty; a null conversation key is a key of its own. Turns without a number come
    first. Repeated rows are turns of their own. Other columns are not read. No rows give no rows.
    """
    small_batches(turns.sparkSession)
    key = turns.select(F.col(conv)).schema[0]
    rows = turns.select(
        F.col(conv), F.col(turn), F.coalesce(F.col(role), F.lit("")).alias("_role"), F.coalesce(F.col(text), F.lit("")).alias("_text")
    )
    rows = rows.repartition(conv).sortWithinPartitions(conv, turn, "_role", "_text").select(conv, "_role", "_text")
    names = [conv, "part", "last", "n_turns", "formatted", "loss_starts", "loss_ends"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # its last part may be the last of its conversation
        part = -1
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_pylist()
            goes_on = held is not None and held.column(0)[-1].as_py() == ids[0]
            if held is not None:
                yield _marked(held, goes_on)
            part = part + 1 if goes_on else 0
            sizes = pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False)
            firsts, numbers, part, _ = _parts(ids, sizes, part, 0)
            strings, starts, ends = assemble(batch.column(1), batch.column(2), np.asarray(firsts))
            trained = np.flatnonzero(pc.equal(batch.column(1), TRAINED_ROLE).to_numpy(zero_copy_only=False))
            bounds = np.searchsorted(trained, [*firsts, batch.num_rows]).astype(np.int32)
            held = pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(firsts)),
                    pa.array(numbers, pa.int32()),
                    pa.array([True] * len(firsts)),
                    pa.array(np.diff([*firsts, batch.num_rows]), pa.int64()),
                    strings.cast(pa.string()),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(starts[trained], pa.int64())),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(ends[trained], pa.int64())),
                ],
                names,
            )
        if held is not None:
            yield _marked(held, False)

    def _marked(done: pa.RecordBatch, goes_on: bool) -> pa.RecordBatch:
        ids = done.column(0).to_pylist()
        last = [a != b for a, b in zip(ids, ids[1:], strict=False)] + [not goes_on]
        return done.set_column(2, "last", pa.array(last))

    return rows.mapInArrow(run, f"{key.simpleString().replace(':', ' ', 1)}, {PARTS}")


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Digests of conversations, read from the output of ``format_conversations`` alone.

    (conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), one row a conversation; must
    follow the formatting directly, as it streams the parts in their order.
    """
    key = formatted.select(F.col(conv)).schema[0]
    names = [conv, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    columns = [conv, "last", "formatted", "loss_starts", "loss_ends"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = lambda: [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
        state = fresh()
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                whole = row["formatted"]
                for role, text in TURN.findall(whole):
                    state[0] += 1
                    state[1].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                raw = whole.encode()
                for a, b in zip(row["loss_starts"], row["loss_ends"], strict=True):
                    said = unescape(raw[a:b].decode())
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(whole)
                if row["last"]:
                    out.append([row[conv], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]])
                    state = fresh()
            types = [batch.schema.field(conv).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    kinds = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return formatted.select(*columns).mapInArrow(run, f"{key.simpleString().replace(':', ' ', 1)}, {kinds}")
