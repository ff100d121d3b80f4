"""Cheapest repair of damaged conversations by block tables.

A conversation is a string of symbols, one a row: the initial of its role and its fault. Repaired
roles must read ``(s?(ua)+)?``. Four states say how far that is: nothing yet, after s, after u, after a.
The cost vector of a place holds, for each state, the least cost of all that follows.

* ``Tables`` numbers the cost vectors that can occur, less their minimum: their differences are bounded,
  as an inserted row leads from one state to the next, so there are a few dozen. For every vector and
  every block of ``BLOCK`` symbols it holds the vector before the block and what the minimum grew by.
* A conversation is cut into blocks from its end. Each is one lookup, from the vector behind it to the vector before it.
* Then blocks are expanded: from the vector behind a block its inner vectors follow backward, symbol by symbol, and the
  edits forward, always the ASCII-least of those that keep the cost. An edit and the state fix the next
  state, so the letters chosen one by one are the least string: ties are safe.

Spark shuffles a conversation's rows to one task and sorts them there, on disk where they are
many; the task streams over them and holds a byte a row. The edits meet the texts in a second sorted
stream that feeds the digest, so no conversation's texts are ever in memory together.

Defined cases: null conversation, turn, role and text count as one space; null conversations are one. Rows of one turn are ordered by
role, then text. Repeated rows stay, adjacent. A conversation that loses all rows has zeros, an empty
audit and the digest of nothing. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halyard.sources.scratch import written

BLOCK = 4
SLICE_ROWS = 1024
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
TRUNCATED = 1  # added to a truncated row that stays
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a row of the role; roles are numbered as states, 0 is any other role.
AFTER = {(START, SYSTEM): SYSTEM, (START, USER): USER, (SYSTEM, USER): USER, (USER, ASSISTANT): ASSISTANT, (ASSISTANT, USER): USER}
#: The state after a row whose role may be chosen.
NEXT = [USER, USER, ASSISTANT, USER]
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Symbols: 0 must go; 1 to 4 are roles 0 to 3; 5 to 8 the same, truncated.
SYMBOLS = 9
SPACE = " \t\n\x0b\f\r"


def symbol(role: int, must_go: bool, truncated: bool) -> int:
    return 0 if must_go else 1 + role + (4 if truncated else 0)


def edits(state: int, sym: int) -> list[tuple[str, int, int]]:
    """(letter, cost, state after) of the edits that use up the row, in ASCII order."""
    out = [("D", DELETE, state)]
    if sym:
        role, extra = (sym - 1) % 4, TRUNCATED if sym > 4 else 0
        if (state, role) in AFTER:
            out.append(("K", KEEP + extra, AFTER[state, role]))
        out.append(("R", REROLE + extra, NEXT[state]))
    return out


def _with_inserts(costs: list[int]) -> tuple[int, ...]:
    """The costs when rows may be inserted first; two in a row lead to every state that inserts reach."""
    for _ in range(2):
        costs = [min(c, INSERT + costs[NEXT[s]]) for s, c in enumerate(costs)]
    return tuple(costs)


class Tables:
    """Cost vectors by number, and the transitions of all blocks of up to ``block`` symbols."""

    def __init__(self, block: int = BLOCK):
        far = 1 << 20
        self.block = block
        self.vectors = [_with_inserts([0, far, far, 0])]
        numbers = {self.vectors[0]: 0}
        before, grown = [], []
        for vector in self.vectors:  # grows until no vector is new
            row = []
            for sym in range(SYMBOLS):
                costs = _with_inserts([min(c + vector[to] for _, c, to in edits(s, sym)) for s in range(4)])
                least = min(costs)
                known = tuple(c - least for c in costs)
                if known not in numbers:
                    numbers[known] = len(self.vectors)
                    self.vectors.append(known)
                row.append((numbers[known], least))
            before.append([n for n, _ in row])
            grown.append([g for _, g in row])
        self.step = np.array(before)
        self.least = np.array([min(v) for v in self.vectors])
        one, cost = self.step, np.array(grown)
        # a block's number has its first symbol in the highest place; its last symbol is met first
        self.before, self.grown = [np.arange(len(one))[:, None]], [np.zeros((len(one), 1), np.int64)]
        for _ in range(block):
            behind, so_far = self.before[-1], self.grown[-1]
            self.before.append(np.concatenate([one[behind, s] for s in range(SYMBOLS)], axis=1))
            self.grown.append(np.concatenate([so_far + cost[behind, s] for s in range(SYMBOLS)], axis=1))
        self.letters = [[[self._chosen(v, s, state) for state in range(4)] for s in range(SYMBOLS)] for v in range(len(one))]
        self.tail = [self._inserted(self.vectors[0], s) for s in range(4)]
        self._expanded: dict[tuple[int, int, int, int], tuple[str, int]] = {}

    def _chosen(self, behind: int, sym: int, state: int) -> tuple[str, int]:
        """The least letters, inserts included, that use up a row, and the state after them."""
        costs = [min(c + self.vectors[behind][to] for _, c, to in edits(s, sym)) for s in range(4)]
        before = _with_inserts(costs)
        letters = ""
        while True:
            ways = [(letter, to, True) for letter, c, to in edits(state, sym) if c + self.vectors[behind][to] == before[state]]
            if INSERT + before[NEXT[state]] == before[state]:
                ways.append(("I", NEXT[state], False))
            letter, state, done = min(ways)
            letters += letter
            if done:
                return letters, state

    def _inserted(self, vector: tuple[int, ...], state: int) -> str:
        """The rows inserted behind the last one."""
        out = ""
        while vector[state]:
            out, state = out + "I", NEXT[state]
        return out

    def expanded(self, behind: int, length: int, number: int, state: int) -> tuple[str, int]:
        """The letters of a block that is entered in a state, and the state after it; kept, as there are few."""
        key = behind, length, number, state
        if key not in self._expanded:
            symbols = [number // SYMBOLS**i % SYMBOLS for i in range(length - 1, -1, -1)]
            inner = [behind]
            for s in reversed(symbols[1:]):
                inner.append(int(self.step[inner[-1], s]))
            letters = ""
            for s, vector in zip(symbols, reversed(inner)):
                more, state = self.letters[vector][s][state]
                letters += more
            self._expanded[key] = letters, state
        return self._expanded[key]

    def repair(self, symbols: bytes) -> tuple[int, str]:
        """The least cost of a conversation and the ASCII-least letters of its edits."""
        cut = len(symbols) % self.block
        blocks = [(len(p), _number(p)) for p in [symbols[:cut], *(symbols[i : i + self.block] for i in range(cut, len(symbols), self.block))] if p]
        behind, cost = [0], 0
        for length, number in reversed(blocks):
            cost += int(self.grown[length][behind[-1], number])
            behind.append(int(self.before[length][behind[-1], number]))
        cost += self.vectors[behind.pop()][START] if symbols else 0
        letters, state = [], START
        for (length, number), vector in zip(blocks, reversed(behind)):
            more, state = self.expanded(vector, length, number, state)
            letters.append(more)
        return cost, "".join(letters) + self.tail[state]


def _number(symbols: bytes) -> int:
    out = 0
    for s in symbols:
        out = out * SYMBOLS + s
    return out


@cache
def tables(block: int = BLOCK) -> Tables:
    return Tables(block)


def states(letters: str, roles: list[int]) -> Iterator[tuple[str, int, int]]:
    """(letter, state after it, row or -1) of the edits over rows of these roles."""
    state, row = START, 0
    for letter in letters:
        if letter == "I":
            state = NEXT[state]
            yield letter, state, -1
            continue
        if letter != "D":
            state = AFTER[state, roles[row]] if letter == "K" else NEXT[state]
        yield letter, state, row
        row += 1


# ---------------------------------------------------------------- rows


def damaged(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text) after the damage; a dropped row leaves one without a role."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv).cast("string"), blank), F.lit(":"), F.coalesce(F.col(turn).cast("string"), blank))
    hit = F.crc32(key.cast("binary")) % 20
    kept = F.when(hit != 0, F.when(hit == 4, "user").otherwise(F.coalesce(F.col(role), blank)))
    said = F.coalesce(F.col(text), blank)
    said = F.when(hit == 1, "").when(hit == 2, F.translate(said, ".!?", "")).when(hit != 0, said)
    return rows.select(
        F.col(conv).alias("conv"),
        F.col(turn).alias("turn"),
        kept.alias("role"),
        said.alias("text"),
        F.explode(F.when(hit == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _initial(role: Column) -> Column:
    first = F.left(role, F.lit(1))
    return F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(0)


ORDER = ["turn", "role", "text"]


def faults(rows: DataFrame) -> DataFrame:
    """(conv, turn, role initial, fault) of every row, the rows of a conversation in one partition and in order.

    Fault: 0 none, 1 blank, 2 duplicate, 3 truncated, -1 the place of a dropped row.
    """
    same = W.partitionBy("conv", "role", "text").orderBy("turn")  # inside the partitions of the conversation: no second shuffle
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = (
        F.when(F.col("role").isNull(), -1)
        .when(bare == "", 1)
        .when(F.col("earlier") > 1, 2)
        .when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), 3)
        .otherwise(0)
    )
    together = rows.repartition("conv").withColumn("earlier", F.row_number().over(same)).sortWithinPartitions("conv", *ORDER, "earlier")
    return together.select("conv", "turn", _initial(F.col("role")).cast("tinyint").alias("initial"), fault.cast("tinyint").alias("fault"))


class _Conversation:
    """What is kept of the rows of one conversation as they stream by."""

    def __init__(self, conv):
        self.conv = conv
        self.symbols, self.counts = bytearray(), [0, 0, 0, 0]
        self.low = self.high = self.last_turn = None
        self.turns = self.illegal = 0
        self.last_role = -1

    def add(self, turn, initial: int, fault: int) -> None:
        if fault < 0:
            return
        if turn is not None:
            if self.low is None:
                self.low = turn
            if turn != self.last_turn:
                self.turns += 1
            self.high = self.last_turn = turn
        if self.last_role >= 0 and (self.last_role, initial) not in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)):
            self.illegal += 1
        self.last_role = initial
        self.counts[fault] += 1
        self.symbols.append(symbol(initial, fault in (1, 2), fault == 3))

    def row(self, table: Tables) -> tuple:
        cost, audit = table.repair(bytes(self.symbols))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv, gaps, *self.counts[1:], self.illegal, cost, audit


FOUND = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def repairs(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation of damaged rows."""
    schema = T.StructType([rows.schema["conv"], *[T.StructField(c, T.LongType()) for c in FOUND], T.StructField("audit", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, now, done = tables(block), None, []
        for batch in batches:
            kind = batch.schema.field(0).type
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or row[0] != now.conv:
                    if now is not None:
                        done.append(now.row(table))
                    now = _Conversation(row[0])
                now.add(*row[1:])
            if len(done) >= SLICE_ROWS:
                yield _batch(done, kind, schema)
                done = []
        if now is not None:
            yield _batch([*done, now.row(table)], kind, schema)

    return faults(rows).mapInArrow(run, schema)


def _batch(rows: list[tuple], kind: pa.DataType, schema: T.StructType) -> pa.RecordBatch:
    kinds = [kind, *[pa.int64()] * len(FOUND), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], schema.names)


class _Writer:
    """Feeds a conversation's repaired rows to a sink as its rows stream by."""

    def __init__(self, letters: str):
        self.letters, self.at, self.state = letters, 0, START

    def _inserts(self) -> Iterator[tuple[str, str]]:
        while self.letters[self.at : self.at + 1] == "I":
            self.state, self.at = NEXT[self.state], self.at + 1
            yield ROLES[self.state], ""

    def row(self, initial: int, role: str, text: str) -> Iterator[tuple[str, str]]:
        """The repaired rows up to and with this one."""
        yield from self._inserts()
        letter, self.at = self.letters[self.at], self.at + 1
        if letter == "K":
            self.state = AFTER[self.state, initial]
            yield role, text
        elif letter == "R":
            self.state = NEXT[self.state]
            yield ROLES[self.state], text

    def end(self) -> Iterator[tuple[str, str]]:
        yield from self._inserts()


def _with_edits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Damaged rows behind the edits of their conversation, in order, a conversation in one partition."""
    none = F.lit(None).cast("string")
    heads = found.select("conv", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), none.alias("role"), F.col("audit").alias("text"))
    lines = rows.where(F.col("role").isNotNull()).select("conv", F.lit(1).alias("kind"), "turn", "role", "text")
    both = heads.union(lines).withColumn("initial", _initial(F.col("role")))
    return both.repartition("conv").sortWithinPartitions("conv", "kind", *ORDER).select("conv", "kind", "initial", "role", "text")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple[str, str]], bool]]:
    """(conversation, repaired rows, whether it ends with them)."""
    now = None
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            for conv, kind, initial, role, text in zip(*(c.to_pylist() for c in batch.slice(start, SLICE_ROWS).columns)):
                if kind == 0:
                    if now is not None:
                        yield now[0], now[1].end(), True
                    now = conv, _Writer(text)
                else:
                    yield conv, now[1].row(initial, role, text), False
    if now is not None:
        yield now[0], now[1].end(), True


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv, place, role, text): the rows of the repaired conversations, in order."""
    schema = T.StructType([rows.schema["conv"], T.StructField("place", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    kinds = [pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, out, place = None, [], 0

        def first(stream):
            nonlocal kind
            for batch in stream:
                kind = batch.schema.field(0).type
                yield batch

        def made():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [kind, *kinds])], schema.names)

        for conv, lines, ends in _stream(first(batches)):
            for role, text in lines:
                out.append((conv, place, role, text))
                place += 1
            place = 0 if ends else place
            if len(out) >= SLICE_ROWS:
                yield made()
                out = []
        if out:
            yield made()

    return _with_edits(rows, found).mapInArrow(run, schema)


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): the digest of ``role:text`` of the repaired rows, newlines between."""
    schema = T.StructType([rows.schema["conv"], T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, out = None, []

        def first(stream):
            nonlocal kind
            for batch in stream:
                kind = batch.schema.field(0).type
                yield batch

        def made():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [kind, pa.string()])], schema.names)

        digest, between = hashlib.sha256(), b""
        for conv, lines, ends in _stream(first(batches)):
            for role, text in lines:
                digest.update(between + f"{role}:{text}".encode())
                between = b"\n"
            if ends:
                out.append((conv, digest.hexdigest()))
                digest, between = hashlib.sha256(), b""
            if len(out) >= SLICE_ROWS:
                yield made()
                out = []
        if out:
            yield made()

    return _with_edits(rows, found).mapInArrow(run, schema)


def audited(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation of damaged rows."""
    found = written(repairs(rows, block), "conversation-repairs")
    hashed = digests(rows, found).withColumnRenamed("conv", "conv_")
    return found.join(hashed, F.col("conv").eqNullSafe(F.col("conv_"))).drop("conv_")
