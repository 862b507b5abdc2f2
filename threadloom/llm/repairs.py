"""Conversation structure repair by Four-Russians tables (operator 13).

A row is one of nine symbols: to be deleted, or its role's initial and whether its text breaks off. What is left after edits must
read ``(s?(ua)+)?``, so four states are enough, and the cheapest costs from them to the end of a conversation are a vector of four
numbers. Less their minimum there are only a few dozen such vectors. Tables say, for every vector and every block of ``BLOCK`` symbols,
which vector stands before the block, what is added, and which state each state leaves the block in.

Rows are dealt by ranges of ``(conversation, turn, role, text)``, so a very long conversation lies in many tasks. Each task goes
over its chunks block by block for all vectors at once. One scan backward over the chunks of a conversation picks the vectors, one
forward the states; then every chunk is traced by itself, its blocks expanded backward, the least letter first among equals.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from threadloom.llm.common import small_side
from threadloom.llm.grams import give_back
from threadloom.session import cut_lineage

BLOCK = 4
#: Rows of a chunk: what is looked at between two rows of the scans over chunks.
CHUNK = 4_096
#: Repeated (conversation, role, text) up to this many rows (about 60 bytes each) go to every task.
BROADCAST_REPEATED = 200_000
START, SYSTEM, USER, ASSISTANT = range(4)
DELETE, INSERT, REROLE = 3, 2, 2
#: State after an inserted or reroled row, by state; and after a kept one, by state and role.
_NEXT = (USER, USER, ASSISTANT, USER)
_KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Cheapest way from each state to an end without rows.
_LAST = (0, 2 * INSERT, INSERT, 0)
_ROLES = "sua"
#: 0: to be deleted; 1 + 2 * role + broken off, roles s, u, a, any other; then one that stands for no row.
SYMBOLS, NO_ROW = 10, 9
WHITE = r"\x20\x09-\x0D"


def _row_moves(symbol: int, state: int) -> Iterator[tuple[str, int, int]]:
    """Edits of a row: (letter, cost, state after)."""
    yield "D", DELETE, state
    if symbol:
        role, broken = divmod(symbol - 1, 2)
        kept = _KEPT.get((state, _ROLES[role:role + 1]))
        if kept is not None:
            yield "K", broken, kept
        yield "R", REROLE + broken, _NEXT[state]


def _before(symbol: int, after: tuple[int, ...]) -> list[int]:
    """Costs before a row from those after it; an insert may come first, at most twice to any use."""
    costs = [min(cost + after[to] for _, cost, to in _row_moves(symbol, state)) for state in range(4)]
    for _ in range(3):
        costs = [min(costs[state], INSERT + costs[_NEXT[state]]) for state in range(4)]
    return costs


class Tables:
    """Transitions of every vector by symbol and by block of symbols."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        vectors, steps = [_LAST], {}
        for vector in vectors:  # grows
            for symbol in range(NO_ROW):
                costs = _before(symbol, vector)
                least = min(costs)
                to = tuple(c - least for c in costs)
                if to not in vectors:
                    vectors.append(to)
                steps[vector, symbol] = to, least
        self.vectors, n = vectors, len(vectors)
        place = {v: i for i, v in enumerate(vectors)}
        self.to, self.cost = np.zeros((n, SYMBOLS), np.int16), np.zeros((n, SYMBOLS), np.int64)
        self.exit, self.letters = np.zeros((n, SYMBOLS, 4), np.int8), {}
        for i, vector in enumerate(vectors):
            self.to[i, NO_ROW], self.exit[i, NO_ROW] = i, range(4)
            for symbol in range(NO_ROW):
                to, least = steps[vector, symbol]
                self.to[i, symbol], self.cost[i, symbol] = place[to], least
                for state in range(4):
                    said, end = self._edit(symbol, state, vector)
                    self.exit[i, symbol, state], self.letters[i, symbol, state] = end, said
        # A block's code has its first symbol on top; its tables are those of its symbols, last to first.
        digits = [np.arange(SYMBOLS ** block) // SYMBOLS ** (block - 1 - j) % SYMBOLS for j in range(block)]
        at, cost, ends = np.repeat(np.arange(n, dtype=np.int16)[:, None], SYMBOLS ** block, 1), np.zeros((n, SYMBOLS ** block), np.int64), []
        for digit in reversed(digits):
            ends.append(at)
            cost += self.cost[at, digit]
            at = self.to[at, digit]
        self.block_to, self.block_cost = at, cost
        state = np.broadcast_to(np.arange(4), (n, SYMBOLS ** block, 4))
        for digit, end in zip(digits, reversed(ends)):
            state = self.exit[end[..., None], digit[None, :, None], state]
        self.block_exit = state
        self._expanded: dict[tuple[int, int, int], list[str]] = {}

    def _edit(self, symbol: int, state: int, after: tuple[int, ...]) -> tuple[str, int]:
        """Letters up to and with those of the row, and the state after it: of the cheapest, the least letter at each step."""
        said = ""
        while True:
            cost = _before(symbol, after)[state]
            moves = [(letter, to) for letter, c, to in _row_moves(symbol, state) if c + after[to] == cost]
            if INSERT + _before(symbol, after)[_NEXT[state]] == cost:
                moves.append(("I", _NEXT[state]))
            letter, state = min(moves)
            said += letter
            if letter != "I":
                return said, state

    def codes(self, symbols: np.ndarray) -> np.ndarray:
        """Symbols as blocks, the last one filled up."""
        line = np.full(-(-len(symbols) // self.block) * self.block, NO_ROW, np.int64)
        line[:len(symbols)] = symbols
        return line.reshape(-1, self.block) @ (SYMBOLS ** np.arange(self.block - 1, -1, -1))

    def transfer(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every vector after a chunk: the vector before it, the cost in between, and the state that each state leaves it in."""
        at, ends = np.arange(len(self.vectors)), []
        cost, codes = np.zeros(len(at), np.int64), self.codes(symbols)
        for code in codes[::-1].tolist():
            ends.append(at)
            cost = cost + self.block_cost[at, code]
            at = self.block_to[at, code]
        state = np.broadcast_to(np.arange(4), (len(self.vectors), 4))
        for code, end in zip(codes.tolist(), reversed(ends)):
            state = self.block_exit[end[:, None], code, state]
        return at, cost, state

    def trace(self, symbols: np.ndarray, after: int, state: int) -> list[str]:
        """The letters of every row of a chunk, those of inserted rows before the letter of the row they precede."""
        codes, ends = self.codes(symbols).tolist(), []
        for code in reversed(codes):
            ends.append(after)
            after = int(self.block_to[after, code])
        out: list[str] = []
        for code, end in zip(codes, reversed(ends)):
            if (end, code, state) not in self._expanded:
                self._expanded[end, code, state] = self._expand(end, code, state)
            out += self._expanded[end, code, state]
            state = int(self.block_exit[end, code, state])
        return out

    def _expand(self, end: int, code: int, state: int) -> list[str]:
        row, afters, out = [code // SYMBOLS ** (self.block - 1 - j) % SYMBOLS for j in range(self.block)], [], []
        for symbol in reversed(row):
            afters.append(end)
            end = int(self.to[end, symbol])
        for symbol, after in zip(row, reversed(afters)):
            if symbol != NO_ROW:
                out.append(self.letters[after, symbol, state])
                state = int(self.exit[after, symbol, state])
        return out


@functools.cache
def tables() -> Tables:
    return Tables()


def damaged(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` with faults by ``crc32(conv_id:turn) % 20``; nulls, also in that key, are one space."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key) % 20).alias("_code"))
    text = F.when(F.col("_code") == 1, "").when(F.col("_code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_code") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("_code") == 3, 2).otherwise(1)))
    return rows.filter("_code != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def _lean(turns: DataFrame) -> DataFrame:
    """Rows without their texts, in order: ``(conv_id, turn, role, mark, i, symbol, fault)``; ``i`` numbers equal rows."""
    text = F.col("text")
    rows = turns.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("mark"), (~text.rlike(f"[^{WHITE}]")).alias("blank"),
                        (~text.rlike(rf"[.!?][{WHITE}]*\z")).alias("broken"))
    same = cut_lineage(rows.groupBy("conv_id", "turn", "role", "mark", "blank", "broken").agg(F.count(F.lit(1)).alias("n")))
    key = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    said = same.groupBy("conv_id", "role", "mark").agg(F.sum("n").alias("_n"), F.min(key).alias("_first"))
    again = cut_lineage(said.filter("_n > 1").select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("mark").alias("_mark"), "_first"))
    joined = same.join(small_side(again, BROADCAST_REPEATED), F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("mark") == F.col("_mark")), "left")
    each = joined.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i"))
    repeated = (F.col("i") > 1) | (F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(key))
    fault = F.when(F.col("blank"), "blank").when(repeated, "duplicate").when(F.col("broken"), "truncated").otherwise("")
    role = F.instr(F.lit(_ROLES + "?"), F.when(F.col("role").rlike(r"\A[sua]"), F.substring("role", 1, 1)).otherwise("?"))
    symbol = F.when(F.col("blank") | repeated, 0).otherwise(2 * role - 1 + F.col("broken").cast("int")).cast("int")
    flat = each.select("conv_id", "turn", "role", "mark", "i", symbol.alias("symbol"), fault.alias("fault"))
    order = ["conv_id", "turn", "role", "mark", "i"]
    return cut_lineage(flat.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))


def _edits(lean: DataFrame) -> DataFrame:
    """``(conv_id, cost, turn, role, mark, i, fault, edits)``: the letters for each row; the cost is that of the whole conversation."""
    kind = lean.schema["conv_id"].dataType.simpleString()
    carried = "array<struct<turn:bigint,role:string,mark:binary,i:bigint,fault:string>>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, number, part = tables(), [], 0, 0

        def chunk() -> pa.RecordBatch:
            nonlocal number
            number += 1
            symbols = np.array([r["symbol"] for r in held], np.uint8)
            to, cost, exits = known.transfer(symbols)
            rows = [{k: r[k] for k in ("turn", "role", "mark", "i", "fault")} for r in held]
            return _batch(lean_types, [[held[0]["conv_id"]], [part], [number], [symbols.tobytes()], [to.astype(np.int16).tobytes()], [cost.astype(np.int64).tobytes()],
                                       [exits.astype(np.int8).tobytes()], [rows]])

        for batch in batches:
            lean_types = {"conv_id": batch.schema.field("conv_id").type, **_CHUNK}
            for row in batch.to_pylist():
                if held and (held[0]["conv_id"] != row["conv_id"] or len(held) == CHUNK):
                    yield chunk()
                    held = []
                held.append(row)
                part = row["part"]
        if held:
            yield chunk()

    def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, after, cost = _NOTHING, 0, 0
        for batch in batches:
            afters, costs, maps = [], [], []
            for name, to, added, exits in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "to", "added", "exits"))):
                if name != conv:
                    conv, after, cost = name, 0, 0
                afters.append(after)
                maps.append(exits[4 * after:4 * after + 4])
                cost += int(np.frombuffer(added, np.int64)[after])
                after = int(np.frombuffer(to, np.int16)[after])
                costs.append(cost + tables().vectors[after][START])
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("conv_id", "part", "chunk", "symbols", "rows")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(afters, pa.int32()), pa.array(costs, pa.int64()), pa.array(maps, pa.binary())],
                                             names=["conv_id", "part", "chunk", "symbols", "rows", "after", "cost", "exits"])

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, cost = _NOTHING, START, 0
        for batch in batches:
            states, costs = [], []
            for name, exits, upto in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "exits", "cost"))):
                if name != conv:
                    conv, state, cost = name, START, upto
                states.append(state)
                costs.append(cost)
                state = exits[state]
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("conv_id", "symbols", "rows", "after")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(states, pa.int32()), pa.array(costs, pa.int64())], names=["conv_id", "symbols", "rows", "after", "state", "cost"])

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [tables().trace(np.frombuffer(symbols, np.uint8), after, state)
                    for symbols, after, state in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("symbols", "after", "state")))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(batch.schema.get_field_index("cost")), batch.column(batch.schema.get_field_index("rows")),
                                              pa.array(said, pa.list_(pa.string()))], names=["conv_id", "cost", "rows", "edits"])

    chunks = lean.mapInArrow(cut, f"conv_id {kind}, part int, chunk int, symbols binary, to binary, added binary, exits binary, rows {carried}")
    dealt = chunks.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("chunk"))
    back = dealt.mapInArrow(backward, f"conv_id {kind}, part int, chunk int, symbols binary, rows {carried}, after int, cost long, exits binary")
    there = back.sortWithinPartitions("conv_id", "part", "chunk").mapInArrow(forward, f"conv_id {kind}, symbols binary, rows {carried}, after int, state int, cost long")
    # Tracing is the larger part of the work and needs one chunk only, so it is dealt out again.
    traced = there.repartition(F.xxhash64("symbols", "after", F.col("rows")[0])).mapInArrow(trace, f"conv_id {kind}, cost long, rows {carried}, edits array<string>")
    each = traced.select("conv_id", "cost", F.explode(F.arrays_zip("rows", "edits")).alias("x"))
    return each.select("conv_id", "cost", "x.rows.turn", "x.rows.role", "x.rows.mark", "x.rows.i", "x.rows.fault", "x.edits")


_NOTHING = object()
_ROW = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("mark", pa.binary()), ("i", pa.int64()), ("fault", pa.string())])
_CHUNK = {"part": pa.int32(), "chunk": pa.int32(), "symbols": pa.binary(), "to": pa.binary(), "added": pa.binary(), "exits": pa.binary(), "rows": pa.list_(_ROW)}


def _batch(types: dict, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types.values())], names=list(types))


class _Conversation:
    """What is told of one conversation, row after row."""

    def __init__(self, conv_id):
        self.conv_id, self.state, self.hash, self.rows, self.cost = conv_id, START, hashlib.sha256(), 0, 0
        self.audit: list[str] = []
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.initial, self.turns, self.least, self.last = 0, None, 0, None, None

    def _put(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.rows else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.rows += 1

    def _edit(self, letter: str, role: str, text: str) -> None:
        if letter == "D":
            return
        if letter == "K":
            self.state = _KEPT[self.state, role[0]]
        else:
            self.state = _NEXT[self.state]
            role = "user" if self.state == USER else "assistant"
        self._put(role, "" if letter == "I" else text)

    def row(self, turn: int | None, role: str, text: str, fault: str, edits: str) -> None:
        if turn is not None and (self.last is None or turn != self.last):
            self.turns += 1
            self.least, self.last = turn if self.least is None else self.least, turn
        if fault:
            self.faults[fault] += 1
        self.illegal += self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]
        self.audit.append(edits)
        for letter in edits:
            self._edit(letter, role, text)

    def told(self) -> tuple:
        for letter in {SYSTEM: "II", USER: "I"}.get(self.state, ""):
            self.audit.append(letter)
            self._edit(letter, "", "")
        gaps = 0 if self.last is None else self.last - self.least + 1 - self.turns
        return (self.conv_id, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


TOLD = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def repair(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)``, one row per conversation.

    ``turns (conv_id, turn, role, text)`` are taken by ``turn``, nulls first, rows of one turn by role and then by the SHA-256 of their
    text; equal rows follow each other. Null roles and texts are one space, a null ``conv_id`` is a conversation. Roles count by their
    first character; one that is not s, u or a, or that is empty, can't be kept. ``conversations (conv_id)`` may name more of them: such
    without turns get zeros, an empty audit and the hash of nothing. Empty tables give no rows; other columns are not used.

    Rows are never gathered: texts go once through the task that owns a conversation, in order, since its hash needs them so, and
    nothing but the audit is held of them.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    edits = _edits(_lean(rows)).select("conv_id", "turn", "role", "mark", "i", F.lit(None).cast("string").alias("text"), "fault", "edits", "cost")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("fault", "string"), ("edits", "string"), ("cost", "long"))]
    # The text of a row comes just before its edits; those of equal rows all before the edits of the first.
    texts = rows.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("mark"), F.lit(0).cast("long").alias("i"), "text", *none)
    named = (rows if conversations is None else conversations).select("conv_id").distinct().select(
        "conv_id", *[F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("mark", "binary"))], F.lit(-1).cast("long").alias("i"),
        F.lit(None).cast("string").alias("text"), *none)
    order = ["conv_id", F.col("i") >= 0, "turn", "role", "mark", "i"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, text = None, None
        for batch in batches:
            done = []
            for conv, turn, role, i, said, fault, letters, cost in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (
                    "conv_id", "turn", "role", "i", "text", "fault", "edits", "cost"))):
                if now is None or now.conv_id != conv:
                    if now is not None:
                        done.append(now.told())
                    now = _Conversation(conv)
                if i == 0:
                    text = said
                elif i > 0:
                    now.cost = cost
                    now.row(turn, role, text, fault, letters)
            if done:
                yield _results(batch.schema.field("conv_id").type, done)
            kind_of = batch.schema.field("conv_id").type
        if now is not None:
            yield _results(kind_of, [now.told()])
        give_back()

    every = named.unionByName(texts).unionByName(edits)
    dealt = every.repartition("conv_id").sortWithinPartitions(*order).drop("mark")
    return dealt.mapInArrow(run, f"conv_id {kind}, {', '.join(f'{c} long' for c in TOLD)}, audit string, repaired_sha256 string")


def _results(kind: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
    types = [kind, *[pa.int64()] * len(TOLD), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], names=["conv_id", *TOLD, "audit", "repaired_sha256"])
