"""Conversation structure repair by Four-Russians block tables.

A conversation is a string of symbols, one a row: its role's initial (s, u, a or
another) and whether the row must go, is truncated or is sound.  The cheapest
edits that make the role initials ``(s?(ua)+)?`` are a shortest path through four
states (nothing yet, after s, after u, after a).  The vector of the four costs to
come, less its least entry, takes only a few dozen values, so what a block of
``BLOCK`` symbols does to each of them (next vector, cost added) is computed once
for all blocks.  A conversation is then read from its end to its front with one
lookup a block; only the vectors at block boundaries are kept.  The edits are
traced against that direction: block after block is expanded again from its kept
vector, and at each step the ASCII-least of all edits that stay cheapest is
taken, so ties are decided exactly.  (A state has one target per edit: the role
that Rerole and Insert give follows from the state.)

Only symbols, one byte a row, are gathered per conversation, since the audit is
one string; texts stream past it in order.  Repeats are found by a grouped
aggregate before that, whatever a conversation's size.

Defined results: a NULL role, text, conv_id or turn reads as one space where a
text is asked for; rows go by turn (NULL first), then by the first 32 characters
of role and text and a hash of both; repeated rows are duplicates of the first;
a NULL conv_id is a conversation of its own; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnos.llm.common import SPACE_CHARS, ship_with_tasks

ship_with_tasks(__name__)

# What the edits cost, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
BLOCK = 4
# States: nothing yet, after s, after u, after a.  Classes: s, u, a, other.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = {(START, 0): AFTER_S, (START, 1): AFTER_U, (AFTER_S, 1): AFTER_U, (AFTER_U, 2): AFTER_A, (AFTER_A, 1): AFTER_U}
FORCED = [AFTER_U, AFTER_U, AFTER_A, AFTER_U]  # the state after the one turn that Rerole or Insert can give
GIVEN = ["user", "user", "assistant", "user"]
AT_END = (0, 2 * INSERT, INSERT, 0)
N_SYMBOLS = 9  # 8: must go; else 2 * class + truncated
#: Of class * 4 + status (0 sound, 1 truncated, 2 duplicate, 3 blank).
SYMBOL_OF = bytes(8 if code % 4 > 1 else code // 4 * 2 + code % 4 for code in range(16))


def _edits(to_come: tuple, symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost with all that comes, next state) of the edits that take one row."""
    out = [("D", DELETE + to_come[state], state)]
    if symbol < 8:
        extra = TRUNCATED * (symbol & 1)
        kept = NEXT.get((state, symbol >> 1))
        if kept is not None:
            out.append(("K", extra + to_come[kept], kept))
        out.append(("R", REROLE + extra + to_come[FORCED[state]], FORCED[state]))
    return out


def _before(to_come: tuple, symbol: int) -> tuple:
    """Costs to come before a row, inserts included."""
    act = [min(c for _, c, _ in _edits(to_come, symbol, q)) for q in range(4)]
    once = [min(act[q], INSERT + act[FORCED[q]]) for q in range(4)]
    return tuple(min(act[q], INSERT + once[FORCED[q]]) for q in range(4))


class BlockTables:
    """Normalised cost vectors, and what one symbol and what a block does to each."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        self.vectors, self.step_to, self.step_cost = [AT_END], [], []
        index = {AT_END: 0}
        for v in self.vectors:
            to, cost = [], []
            for symbol in range(N_SYMBOLS):
                raw = _before(v, symbol)
                least = min(raw)
                norm = tuple(x - least for x in raw)
                if norm not in index:
                    index[norm] = len(self.vectors)
                    self.vectors.append(norm)
                to.append(index[norm])
                cost.append(least)
            self.step_to.append(to)
            self.step_cost.append(cost)
        one_to, one_cost = np.array(self.step_to, np.int16).T, np.array(self.step_cost, np.int16).T
        to, cost = one_to, one_cost
        for _ in range(block - 1):  # one more symbol in front of every block so far
            cost = (cost[None] + one_cost[np.arange(N_SYMBOLS)[:, None, None], to[None]]).reshape(-1, len(self.vectors))
            to = one_to[np.arange(N_SYMBOLS)[:, None, None], to[None]].reshape(-1, len(self.vectors))
        self.block_to, self.block_cost = to.tolist(), cost.tolist()
        self._traced: dict = {}

    def _trace(self, vector: int, symbol: int, state: int) -> tuple[str, int]:
        """Least cheapest edits of one row from ``state``, and the state after it; ``vector`` is what comes."""
        key = (vector, symbol, state)
        if key not in self._traced:
            to_come, edits, at = self.vectors[vector], "", state
            here = _before(to_come, symbol)
            while not edits or edits[-1] == "I":
                options = [(e, q) for e, c, q in _edits(to_come, symbol, at) if c == here[at]]
                if INSERT + here[FORCED[at]] == here[at]:
                    options.append(("I", FORCED[at]))
                edit, at = min(options)
                edits += edit
            self._traced[key] = edits, at
        return self._traced[key]

    def solve(self, symbols: bytes) -> tuple[int, str]:
        """Least cost and the ASCII-least cheapest edits of a conversation."""
        n, width = len(symbols), self.block
        blocks = n // width
        vector, total = 0, 0
        for symbol in reversed(symbols[blocks * width:]):
            total += self.step_cost[vector][symbol]
            vector = self.step_to[vector][symbol]
        packed = np.frombuffer(symbols, np.uint8)[:blocks * width].reshape(blocks, width) @ (N_SYMBOLS ** np.arange(width - 1, -1, -1))
        kept = np.empty(blocks + 1, np.int16)
        kept[blocks] = vector
        for k in range(blocks - 1, -1, -1):
            code = packed[k]
            total += self.block_cost[code][vector]
            vector = self.block_to[code][vector]
            kept[k] = vector
        total += self.vectors[vector][START]
        audit, state = [], START
        for k in range(blocks + 1):
            part = symbols[k * width:(k + 1) * width]
            inner = [int(kept[k + 1]) if k < blocks else 0]
            for symbol in reversed(part[1:]):
                inner.append(self.step_to[inner[-1]][symbol])
            for symbol, to_come in zip(part, reversed(inner), strict=False):
                edits, state = self._trace(to_come, symbol, state)
                audit.append(edits)
        audit.append("I" * (AT_END[state] // INSERT))
        return total, "".join(audit)


def apply_edits(audit: str) -> Iterator[tuple[str, str | None]]:
    """(edit, role) of each edit that leaves a turn; (edit, None) of Keep and Delete.

    A generator that is sent the class (0 to 3) of the row an edit takes.
    """
    state = START
    for edit in audit:
        given = GIVEN[state] if edit in "RI" else None
        cls = yield edit, given
        if edit == "K":
            state = NEXT[state, cls]
        elif edit in "RI":
            state = FORCED[state]


# ---------------------------------------------------------------- Spark
def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damage(turns: DataFrame) -> DataFrame:
    """Rows of ``turns`` (conv_id, turn, role, text) after the damage that crc32(conv_id:turn) % 20 names.

    Dropped rows stay, marked ``gone``, so that no conversation is lost.
    """
    kind = F.crc32(F.concat_ws(":", _text("conv_id"), _text("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", _text("role").alias("role"), _text("text").alias("text"), kind.alias("kind"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") == 0).alias("gone"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


ORDER = ["turn", "r32", "t32", "h1", "h2"]


def _ordered(rows: DataFrame) -> DataFrame:
    """``rows`` with the columns that put a conversation in order; equal ones mean equal rows."""
    return rows.select(
        "conv_id", "turn", "role", "text", F.substring("role", 1, 32).alias("r32"), F.substring("text", 1, 32).alias("t32"),
        F.xxhash64("role", "text").alias("h1"), F.xxhash64("text", F.lit(7), "role").alias("h2"),
        *([F.col("gone")] if "gone" in rows.columns else [F.lit(False).alias("gone")]))


def _role_class(role: str | Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)


def _faults(rows: DataFrame) -> DataFrame:
    """conv_id, ORDER, gone and code (class * 4 + status but duplicates), without the texts."""
    bare = F.rtrim(F.col("text"), F.lit(SPACE_CHARS))
    status = F.when(bare == "", 3).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), 1).otherwise(0)
    slim = rows.select("conv_id", *ORDER, "gone", (_role_class("role") * 4 + status).cast("int").alias("code"))
    seen = slim.where(~F.col("gone")).groupBy("conv_id", "h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("turn")).alias("first"))
    again = seen.where("n > 1").select(F.col("conv_id").alias("_c"), F.col("h1").alias("_1"), F.col("h2").alias("_2"), F.col("first.turn").alias("_first"), F.lit(True).alias("_again"))
    met = slim.join(again, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("h1") == F.col("_1")) & (F.col("h2") == F.col("_2")), "left")
    return met.select("conv_id", *ORDER, "gone", "code",
                      (F.coalesce(F.col("_again"), F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("_first"))).alias("later"))


class _Symbols:
    """Symbols and counts of one conversation, fed row by row in order."""

    LEGAL = {(0, 1), (1, 2), (2, 1)}

    def __init__(self) -> None:
        self.symbols, self.blank, self.duplicate, self.truncated, self.illegal = bytearray(), 0, 0, 0, 0
        self.turns, self.low, self.high, self.at, self.last, self.cls = 0, None, None, None, None, None

    def feed(self, turn, h1, h2, code, later) -> None:
        if turn is not None and turn != self.at:
            self.turns, self.low, self.high, self.at = self.turns + 1, turn if self.low is None else self.low, turn, turn
        cls, status = divmod(code, 4)
        if status != 3 and (later or self.last == (turn, h1, h2)):
            status = 2
        self.blank += status == 3
        self.duplicate += status == 2
        self.truncated += status == 1
        if self.cls is not None and (self.cls, cls) not in self.LEGAL:
            self.illegal += 1
        self.last, self.cls = (turn, h1, h2), cls
        self.symbols.append(SYMBOL_OF[cls * 4 + status])

    def report(self, tables: BlockTables) -> tuple[list[int], str]:
        cost, audit = tables.solve(bytes(self.symbols))
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return [gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost], audit


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _judge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables, state, at, kind = BlockTables(), None, None, None
    out = lambda done: pa.RecordBatch.from_arrays(
        [pa.array([c for c, _ in done], kind), pa.array([r[0] for _, r in done], pa.list_(pa.int64())), pa.array([r[1] for _, r in done], pa.string())],
        ["conv_id", "counts", "audit"])
    for batch in batches:
        kind, done = batch.schema.field(0).type, []
        for conv, turn, h1, h2, gone, code, later in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if state is None or conv != at:
                if state is not None:
                    done.append((at, state.report(tables)))
                state, at = _Symbols(), conv
            if not gone:
                state.feed(turn, h1, h2, code, later)
        yield out(done)
    if state is not None:
        yield out([(at, state.report(tables))])


def repair_plans(rows: DataFrame) -> DataFrame:
    """conv_id, counts (as ``COUNTS``) and audit of every conversation.

    ``rows``: conv_id, turn, role, text and, if some only keep their conversation listed, gone.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    slim = _faults(_ordered(rows)).repartition("conv_id").sortWithinPartitions("conv_id", *ORDER)
    return slim.select("conv_id", "turn", "h1", "h2", "gone", "code", "later").mapInArrow(_judge_batches, f"conv_id {kind}, counts array<long>, audit string")


class _Edits:
    """Edits of one conversation, applied to its rows as they stream past."""

    def __init__(self, audit: str):
        self.todo = apply_edits(audit)
        self.now = next(self.todo, None)

    def _advance(self, cls=None) -> None:
        try:
            self.now = self.todo.send(cls)
        except StopIteration:
            self.now = None

    def inserts(self) -> Iterator[tuple[str, str, str]]:
        while self.now is not None and self.now[0] == "I":
            given = self.now[1]
            self._advance()
            yield "I", given, ""

    def take(self, role: str, text: str, cls: int) -> Iterator[tuple[str, str, str]]:
        yield from self.inserts()
        edit, given = self.now
        self._advance(cls)
        if edit != "D":
            yield edit, role if edit == "K" else given, text
        yield from self.inserts()


def _edit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    edits = None
    for batch in batches:
        out = []
        for conv, counts, role, text, cls in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if counts is not None:
                edits = _Edits(text)
                out.append((conv, None, None, text, counts))
                out += [(conv, *turn, None) for turn in edits.inserts()]
            else:
                out += [(conv, *turn, None) for turn in edits.take(role, text, cls)]
        kinds = [batch.schema.field(0).type, pa.string(), pa.string(), pa.string(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["conv_id", "edit", "role", "text", "counts"])


def _repaired_stream(rows: DataFrame) -> DataFrame:
    """Repaired turns in order within a partition; before each conversation a row that holds its counts and audit."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    body = _ordered(rows).where(~F.col("gone")).select(
        "conv_id", F.lit(1).alias("k"), *ORDER, F.lit(None).cast("array<long>").alias("counts"), "role", "text", _role_class("role").alias("cls"))
    head = repair_plans(rows).select("conv_id", F.lit(0).alias("k"), *[F.lit(None).cast(body.schema[c].dataType).alias(c) for c in ORDER], "counts",
                                     F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"), F.lit(None).cast("int").alias("cls"))
    stream = body.unionByName(head).repartition("conv_id").sortWithinPartitions("conv_id", "k", *ORDER)
    return stream.select("conv_id", "counts", "role", "text", "cls").mapInArrow(_edit_batches, f"conv_id {kind}, edit string, role string, text string, counts array<long>")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """conv_id, edit (K, R or I), role and text of the turns that the repair leaves, in order within a partition."""
    return _repaired_stream(rows).where("edit IS NOT NULL").drop("counts")


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, kind = None, None
    names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
    out = lambda done: pa.RecordBatch.from_arrays(
        [pa.array([d[0] for d in done], kind), *[pa.array([d[1][i] for d in done], pa.int64()) for i in range(len(COUNTS))],
         pa.array([d[2] for d in done], pa.string()), pa.array([d[3].hexdigest() for d in done], pa.string())], names)
    for batch in batches:
        kind, done = batch.schema.field(0).type, []
        for conv, edit, role, text, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if edit is None:
                if at is not None:
                    done.append(at)
                at = [conv, counts, text, hashlib.sha256(), False]
            else:
                at[3].update((("\n" if at[4] else "") + role + ":" + text).encode())
                at[4] = True
        yield out(done)
    if at is not None:
        yield out([at])


def repair_report(rows: DataFrame) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string"
    return _repaired_stream(rows).mapInArrow(_digest_batches, schema)
