"""Chat formatting by columnar byte assembly.

Each turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n``.  A batch of turns is
written in one go: segment lengths, their running sums and scatter indices are
numpy arrays, and headers and contents are copied into one preallocated buffer
that the Arrow result column wraps without a further copy.

Control strings inside roles and texts are broken up reversibly: a backslash is
doubled, ``\\.`` is put after the first character of a control string, and a line
feed in a role is ``\\n``.  ``read_back`` undoes this from the formatted bytes.

Turns stay one row each, in order, so a conversation of any length streams
through a task.

Defined results: a NULL role or text is empty; turns are ordered by turn (NULL
first), then role and text; repeated rows are repeated turns; a NULL conv_id is a
conversation of its own; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.llm.common import ship_with_tasks

ship_with_tasks(__name__)

OPEN, HEAD_END, CLOSE = b"<|im_start|>", b"\n", b"<|im_end|>\n"
# Strings that mark structure in common chat templates.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LOSS_ROLE = "assistant"

_SPECIAL = re.compile(rb"\\|" + b"|".join(b"(?<=" + re.escape(c[:1].encode()) + b")(?=" + re.escape(c[1:].encode()) + b")" for c in CONTROLS))
_ESCAPED = re.compile(rb"\\(\\|\.|n)")
_PLAIN = {b"\\": b"\\", b".": b"", b"n": b"\n"}


def escape(text: bytes) -> bytes:
    return _SPECIAL.sub(lambda m: b"\\\\" if m[0] else b"\\.", text)


def unescape(text: bytes) -> bytes:
    return _ESCAPED.sub(lambda m: _PLAIN[m[1]], text)


def _column(values: pa.Array, role: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column one after another, and the length of each; controls escaped."""
    arr = pc.fill_null(values.cast(pa.large_string()), "").cast(pa.large_binary())
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset:arr.offset + len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]] if len(arr) else np.empty(0, np.uint8)
    if _SPECIAL.search(data) or role and (data == 10).any():
        texts = [escape(x.as_py()) for x in arr]
        if role:
            texts = [x.replace(b"\n", b"\\n") for x in texts]
        return np.frombuffer(b"".join(texts), np.uint8), np.array([len(x) for x in texts], np.int64)
    return data, np.diff(offsets)


#: Bytes whose scatter indices are made at a time, and bytes of texts that are formatted at a time.
SLICE_BYTES, BATCH_BYTES = 1 << 20, 32 << 20


def _scatter(out: np.ndarray, at: np.ndarray, lens: np.ndarray, data: np.ndarray) -> None:
    """Copy consecutive pieces of ``data`` to their places in ``out``; index memory is bounded, a long piece is one copy."""
    ends = np.cumsum(lens)
    first, low = ends - lens, 0
    while low < len(lens):
        high = max(low + 1, int(np.searchsorted(ends, first[low] + SLICE_BYTES, "right")))
        if high == low + 1:
            out[at[low]:at[low] + lens[low]] = data[first[low]:ends[low]]
        else:
            part = slice(low, high)
            out[np.repeat(at[part] - first[part], lens[part]) + np.arange(first[low], ends[high - 1])] = data[first[low]:ends[high - 1]]
        low = high


def _byte_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``BATCH_BYTES`` of text."""
    ends = np.cumsum(np.array(pc.fill_null(pc.binary_length(batch.column(2)), 0), np.int64))
    low = 0
    while low < batch.num_rows:
        before = int(ends[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + BATCH_BYTES, "right")))
        yield batch.slice(low, high - low)
        low = high


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Formatted turns, and where each turn's content starts and ends in it (bytes)."""
    n = len(texts)
    role_bytes, role_len = _column(roles, True)
    text_bytes, text_len = _column(texts)
    lens = np.empty((n, 5), np.int64)
    lens[:, 0], lens[:, 2], lens[:, 4] = len(OPEN), len(HEAD_END), len(CLOSE)
    lens[:, 1], lens[:, 3] = role_len, text_len
    ends = np.cumsum(lens.ravel()).reshape(n, 5)
    starts = ends - lens
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for k, mark in ((0, OPEN), (2, HEAD_END), (4, CLOSE)):
        out[starts[:, k, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)
    for k, data in ((1, role_bytes), (3, text_bytes)):
        _scatter(out, starts[:, k], lens[:, k], data)
    offsets = np.append(starts[:, 0], len(out)).astype(np.int64)
    formatted = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(offsets), pa.py_buffer(out)])
    return formatted, starts[:, 3] - starts[:, 0], ends[:, 3] - starts[:, 0]


def _format_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in _byte_slices(whole)):
        formatted, start, end = assemble(batch.column(1), batch.column(2))
        loss = np.array(pc.fill_null(pc.equal(batch.column(1), LOSS_ROLE), False))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), formatted, pa.array(np.where(loss, start, 0)), pa.array(np.where(loss, end, 0))],
            ["conv_id", "formatted", "loss_start", "loss_end"])


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_start, loss_end for every turn, in order within a partition.

    Input: conv_id, turn, role, text.  The loss span holds the assistant's text (bytes; empty else).
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    ordered = turns.select("conv_id", "role", "text", "turn").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    rows = ordered.select("conv_id", "role", "text")
    return rows.mapInArrow(_format_batches, f"conv_id {kind}, formatted string, loss_start long, loss_end long")


class _Reader:
    """Digests of one conversation, fed with formatted turns."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def feed(self, piece: bytes, start: int, end: int) -> None:
        if not (piece.startswith(OPEN) and piece.endswith(CLOSE)):
            raise ValueError("not a formatted turn")
        role, _, text = piece[len(OPEN):-len(CLOSE)].partition(HEAD_END)
        self.turns.update(unescape(role) + b"\n" + unescape(text) + b"\n")
        masked = unescape(piece[start:end])
        self.loss.update(masked)
        self.loss_chars += len(masked.decode())
        self.chars += len(piece.decode())
        self.n += 1


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state, at = None, None
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    for batch in batches:
        done = []
        for conv, piece, start, end in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
            if state is None or conv != at:
                if state is not None:
                    done.append((at, state))
                state, at = _Reader(), conv
            state.feed(piece.encode(), start, end)
        yield _summary(done, batch.schema.field(0).type, names)
        kind = batch.schema.field(0).type
    if state is not None:
        yield _summary([(at, state)], kind, names)


def _summary(done: list, kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
    rows = [(c, s.n, s.turns.hexdigest(), s.loss_chars, s.loss.hexdigest(), s.chars) for c, s in done]
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from formatted turns as ``format_turns`` leaves them (grouped and in order):
    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(_read_batches, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def planted_conversation(spark) -> DataFrame:
    """Conversation -7: control strings typed by the user and said by the assistant."""
    said = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string").select(
        "conv_id", "turn", F.col("role"), F.col("text"))
