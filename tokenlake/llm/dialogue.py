"""Repair of conversations: cheapest edits so that roles read s?(ua)+, or nothing is left.

A row is a symbol: its role's initial (s, u, a, other) and its fault (none,
truncated, or to be deleted). Equal consecutive symbols are a run. A symbol is
a min-plus matrix over four states (start, after s, u, a): the least cost of
insertions and the row's edit that lead from one state to another. A run is advanced by
the cached powers 2, 4, 8 ... of its matrix; choices are unrolled forward from
the costs to go, the ASCII-least edit that is still cheapest first (Delete,
Insert, Keep, Rerole), halving a long run by the same powers.

Matrices are associative, so a conversation need not be in one task: rows are
range partitioned by conversation and turn. A conversation inside a partition
is finished there; one that meets a partition's edge, or is longer than HELD
rows, leaves matrices of blocks of HELD rows and the rows in a written table.
There the matrices give the costs to go at each block's end, and the rows
stream by in order once, as one hash over a conversation has to read them; no
task holds them. Equal rows of a turn are one row with a number, so that no
number of copies meets one task; rows seen at an earlier turn are found by
joins with the texts that repeat.

Edge cases: null roles and texts are one space, so such a role is edited and
such a text is blank; an empty role has no initial and is edited; null turns
come first; rows of one turn stand by role and text; null conversation ids are
one conversation; a conversation without rows gives zeros, an empty audit and an empty
text; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches

#: Rows of one conversation that a task holds.
HELD = 20_000
START, AFTER_S, AFTER_U, AFTER_A = range(4)
INSERTED = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)  # the state after an insertion, or a rerole, in each state
ROLE = {AFTER_U: "user", AFTER_A: "assistant"}
NEVER = 1 << 60
#: Insertions to an end that is allowed.
AT_END = (0, 4, 2, 0)
DELETED = 8  # else 2 * role's class + 1 if truncated
INITIALS = "sua"
ALLOWED = {"su", "ua", "au"}
_LAST = re.compile(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z")
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

Vector = tuple[int, int, int, int]
Matrix = tuple[Vector, Vector, Vector, Vector]


def kept_in(symbol: int, state: int) -> int | None:
    """The state after a kept row."""
    role = symbol // 2
    if symbol == DELETED or role > 2:
        return None
    if role == 0:
        return AFTER_S if state == START else None
    return (AFTER_A if state == AFTER_U else None) if role == 2 else (None if state == AFTER_U else AFTER_U)


def edits(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, state after) of a row, insertions left out, in ASCII order."""
    out = [("D", 3, state)]
    if symbol != DELETED:
        cut = symbol % 2
        if (k := kept_in(symbol, state)) is not None:
            out.append(("K", cut, k))
        out.append(("R", 2 + cut, INSERTED[state]))
    return out


def times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(NEVER, *(a[i][k] + b[k][j] for k in range(4))) for j in range(4)) for i in range(4))


def before(m: Matrix, v: Vector) -> Vector:
    """Costs to go before a step, from those after it."""
    return tuple(min(m[i][k] + v[k] for k in range(4)) for i in range(4))


IDENTITY: Matrix = tuple(tuple(0 if i == j else NEVER for j in range(4)) for i in range(4))


@lru_cache(None)
def power(symbol: int, k: int) -> Matrix:
    """The matrix of 2 ** k rows of a symbol."""
    if k:
        return times(power(symbol, k - 1), power(symbol, k - 1))
    out = [[NEVER] * 4 for _ in range(4)]
    for i in range(4):
        state, paid = i, 0
        for _ in range(4):  # after three insertions a state has come back
            for _, cost, to in edits(symbol, state):
                out[i][to] = min(out[i][to], paid + cost)
            state, paid = INSERTED[state], paid + 2
    return tuple(map(tuple, out))


def advance(symbol: int, n: int, v: Vector) -> Vector:
    """Costs to go before a run of n rows."""
    k = 0
    while n >> k:
        if n >> k & 1:
            v = before(power(symbol, k), v)
        k += 1
    return v


def of_run(symbol: int, n: int) -> Matrix:
    out, k = IDENTITY, 0
    while n >> k:
        if n >> k & 1:
            out = times(out, power(symbol, k))
        k += 1
    return out


@lru_cache(100_000)
def _chosen(symbol: int, state: int, after: Vector) -> tuple[str, int]:
    """(the ASCII-least cheapest edits up to and with a row, state after)."""
    here, made = before(power(symbol, 0), after), ""
    while True:
        options = edits(symbol, state)
        if options[0][1] + after[state] == here[state]:
            return made + "D", state
        if 2 + here[INSERTED[state]] == here[state]:
            made, state = made + "I", INSERTED[state]
            continue
        for edit, cost, to in options[1:]:
            if cost + after[to] == here[state]:
                return made + edit, to


def unroll(symbol: int, n: int, state: int, after: Vector) -> Iterator[tuple[str, int]]:
    """(edits, state after) of each row of a run, given the costs to go behind it."""
    if n > 32:
        late = 1 << (n - 1).bit_length() - 1
        for made, state in unroll(symbol, n - late, state, advance(symbol, late, after)):
            yield made, state
        yield from unroll(symbol, late, state, after)
        return
    behind = [after]
    for _ in range(n - 1):
        behind.append(before(power(symbol, 0), behind[-1]))
    for v in reversed(behind):
        low = min(v)
        made, state = _chosen(symbol, state, tuple(x - low for x in v))
        yield made, state


class _Runs:
    """Rows as runs of symbols."""

    def __init__(self):
        self.runs: list[list[int]] = []

    def add(self, symbol: int, n: int) -> None:
        if self.runs and self.runs[-1][0] == symbol:
            self.runs[-1][1] += n
        else:
            self.runs.append([symbol, n])

    def add_row(self, symbol: int, n: int) -> None:
        """A row and its copies, which are to be deleted."""
        self.add(symbol, 1)
        if n > 1:
            self.add(DELETED, n - 1)

    def matrix(self) -> Matrix:
        out = IDENTITY
        for symbol, n in self.runs:
            out = times(out, of_run(symbol, n))
        return out

    def choices(self, state: int, after: Vector) -> Iterator[tuple[str, int]]:
        """(edits, state after) of each row."""
        ends = [after]
        for symbol, n in reversed(self.runs):
            ends.append(advance(symbol, n, ends[-1]))
        for (symbol, n), v in zip(self.runs, ends[-2::-1]):
            for made, state in unroll(symbol, n, state, v):
                yield made, state


class _Tally:
    """Faults, illegal neighbours and turns of rows in order; tallies of consecutive blocks add up."""

    def __init__(self, state: list | None = None):
        # blank, duplicate, truncated, illegal, distinct turns, first turn, last turn, first role, last role
        self.v = list(state) if state else [0, 0, 0, 0, 0, None, None, None, None]

    def row(self, turn: int | None, role: str, n: int, blank: bool, later: bool, cut: bool) -> None:
        initial = role[:1]
        if blank:
            faults = [n, 0, 0]
        else:
            faults = [0, n if later else n - 1, int(cut and not later)]
        self.join(_Tally([*faults, n - 1 if initial * 2 not in ALLOWED else 0, int(turn is not None), turn, turn, initial, initial]))

    def join(self, other: _Tally) -> None:
        a, b = self.v, other.v
        for i in range(5):
            a[i] += b[i]
        if a[8] is not None and b[7] is not None and a[8] + b[7] not in ALLOWED:
            a[3] += 1
        if a[6] is not None and a[6] == b[5]:
            a[4] -= 1
        a[5] = b[5] if a[5] is None else a[5]
        a[6] = a[6] if b[6] is None else b[6]
        a[7] = b[7] if a[7] is None else a[7]
        a[8] = a[8] if b[8] is None else b[8]

    def counts(self) -> list[int]:
        v = self.v
        return [v[6] - v[5] + 1 - v[4] if v[5] is not None else 0, *v[:4]]


class _Text:
    """Repaired lines, as text or as its hash only."""

    def __init__(self, digest: bool):
        self.digest, self.parts, self.hash, self.any = digest, [], hashlib.sha256(), False

    def line(self, role: str, text: str) -> None:
        line = ("\n" if self.any else "") + role + ":" + text
        self.any = True
        self.hash.update(line.encode()) if self.digest else self.parts.append(line)

    def apply(self, made: str, state: int, before_state: int, role: str, text: str) -> None:
        """Lines of a row's edits."""
        for e in made:
            if e == "D":
                continue
            before_state = INSERTED[before_state] if e in "IR" else state
            self.line(role if e == "K" else ROLE[before_state], "" if e == "I" else text)

    def done(self) -> str:
        return self.hash.hexdigest() if self.digest else "".join(self.parts)


class _Finished:
    """Edits of a conversation's rows as they come, given the costs to go."""

    def __init__(self, digest: bool):
        self.state, self.audit, self.text, self.cost = START, [], _Text(digest), None

    def rows(self, rows: list[tuple[str, str, int, int]], after: Vector) -> None:
        """rows: (role, text, symbol, copies)."""
        runs = _Runs()
        for _, _, symbol, n in rows:
            runs.add_row(symbol, n)
        if self.cost is None:
            self.cost = self._start(runs, after)
        made = runs.choices(self.state, after)
        for role, text, _, n in rows:
            for _ in range(n):
                edit, state = next(made)
                self.audit.append(edit)
                self.text.apply(edit, state, self.state, role, text)
                self.state = state

    def _start(self, runs: _Runs, after: Vector) -> int:
        for symbol, n in reversed(runs.runs):
            after = advance(symbol, n, after)
        return after[START]

    def end(self) -> tuple[int, str, str]:
        """(cost, audit, text)."""
        while AT_END[self.state]:
            self.audit.append("I")
            self.state = INSERTED[self.state]
            self.text.line(ROLE[self.state], "")
        return self.cost or 0, "".join(self.audit), self.text.done()


def _symbol(role: str, text: str, later: bool) -> tuple[int, bool, bool]:
    """(symbol, blank, truncated)."""
    last = _LAST.search(text)
    cut = last is not None and last[1] not in ".!?"
    if last is None or later:
        return DELETED, last is None, cut
    at = INITIALS.find(role[0]) if role else -1
    return 2 * (at if at >= 0 else 3) + cut, False, cut


#: What a partition leaves: a finished conversation (kind 0), a block's summary (1), or a row of an open one (2).
_LEFT = (
    "kind int, part int, block long, seq long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired string, "
    "matrix array<long>, tally array<long>, ends array<string>, role string, text string, symbol int, n long"
)


class _Output:
    """Rows to come, as Arrow batches of a schema whose first column is the conversation."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def put(self, conv, **v) -> None:
        self.rows.append((conv, v))
        self.size += 200 + len(v.get("text") or "") + len(v.get("repaired") or "")

    def full(self) -> bool:
        return self.size > 4_000_000

    def batch(self) -> pa.RecordBatch:
        columns = [[c for c, _ in self.rows], *([v.get(x) for _, v in self.rows] for x in self.schema.names[1:])]
        self.rows, self.size = [], 0
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)


class _Conversation:
    """Rows of one conversation in a partition, in blocks of HELD rows."""

    def __init__(self, conv, part: int):
        self.conv, self.part, self.block, self.held, self.tally = conv, part, 0, [], _Tally()

    def row(self, out: _Output, turn: int | None, role: str, text: str, n: int, later: bool) -> None:
        symbol, blank, cut = _symbol(role, text, later)
        if len(self.held) == HELD:
            self.leave(out)
        self.tally.row(turn, role, n, blank, later, cut)
        self.held.append((role, text, symbol, n))

    def leave(self, out: _Output) -> None:
        """A block's summary and rows, to be read again in order."""
        runs = _Runs()
        for _, _, symbol, n in self.held:
            runs.add_row(symbol, n)
        at = {"part": self.part, "block": self.block}
        out.put(self.conv, kind=1, **at, matrix=[x for row in runs.matrix() for x in row], tally=self.tally.v[:7], ends=self.tally.v[7:])
        for seq, (role, text, symbol, n) in enumerate(self.held):
            out.put(self.conv, kind=2, **at, seq=seq, role=role, text=text, symbol=symbol, n=n)
        self.block, self.held, self.tally = self.block + 1, [], _Tally()

    def close(self, out: _Output, digest: bool, at_edge: bool) -> None:
        if at_edge or self.block:
            self.leave(out)
            return
        done = _Finished(digest)
        done.rows(self.held, AT_END)
        out.put(self.conv, kind=0, **_result(self.tally, done))


def _result(tally: _Tally, done: _Finished) -> dict:
    cost, audit, text = done.end()
    return dict(zip(COUNTS, [*tally.counts(), cost])) | {"audit": audit, "repaired": text}


def _partition(batches: Iterator[pa.RecordBatch], schema: pa.Schema, digest: bool) -> Iterator[pa.RecordBatch]:
    """One range of rows in order of conversation, turn, role and text."""
    part, out, now, at_edge = TaskContext.get().partitionId(), _Output(schema), None, True
    for batch in batches:
        for conv, turn, role, text, n, later in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if now is None or conv != now.conv:
                if now is not None:
                    now.close(out, digest, at_edge)
                    at_edge = False
                now = _Conversation(conv, part)
            if n:
                now.row(out, turn, role, text, n, later)
            if out.full():
                yield out.batch()
    if now is not None:
        now.close(out, digest, True)
        yield out.batch()


class _Opened:
    """A conversation of several blocks: first their summaries, then their rows, both in order."""

    def __init__(self, conv, digest: bool):
        self.conv, self.done = conv, _Finished(digest)
        self.matrices: list[tuple[tuple[int, int], Matrix]] = []
        self.tally, self.after, self.at, self.held = _Tally(), None, None, []

    def summary(self, at: tuple[int, int], matrix: list[int], tally: list, ends: list) -> None:
        self.matrices.append((at, tuple(tuple(matrix[i : i + 4]) for i in range(0, 16, 4))))
        self.tally.join(_Tally([*tally, *ends]))

    def row(self, at: tuple[int, int], *row) -> None:
        if self.after is None:
            v, self.after = AT_END, {}
            for block, matrix in reversed(self.matrices):
                self.after[block] = v
                v = before(matrix, v)
        if at != self.at:
            self.flush()
            self.at = at
        self.held.append(row)

    def flush(self) -> None:
        if self.held:
            self.done.rows(self.held, self.after[self.at])
            self.held = []

    def close(self, out: _Output) -> None:
        self.flush()
        out.put(self.conv, **_result(self.tally, self.done))


def _open(batches: Iterator[pa.RecordBatch], schema: pa.Schema, digest: bool) -> Iterator[pa.RecordBatch]:
    """Open conversations, sorted by kind and then by place."""
    out, now = _Output(schema), None
    for batch in batches:
        columns = (batch.column(x).to_pylist() for x in ("conv", "kind", "part", "block", "matrix", "tally", "ends", "role", "text", "symbol", "n"))
        for conv, kind, part, block, matrix, tally, ends, *row in zip(*columns):
            if now is None or conv != now.conv:
                if now is not None:
                    now.close(out)
                now = _Opened(conv, digest)
            if kind == 1:
                now.summary((part, block), matrix, tally, ends)
            else:
                now.row((part, block), *row)
            if out.full():
                yield out.batch()
    if now is not None:
        now.close(out)
        yield out.batch()


def rows_of(df: DataFrame, n: Column) -> DataFrame:
    """conv, turn, role, text, n (rows like this; 0 marks a conversation without them) and later (seen at an earlier turn)."""
    blank = F.lit(" ")
    there = n > 0
    one = (
        df.select(
            F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), F.when(there, F.coalesce("role", blank)).alias("role"),
            F.when(there, F.coalesce("text", blank)).alias("text"), n.cast("long").alias("n"),
        )
        .groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n"))
        .withColumn("said", F.sha2(F.concat("role", F.lit("\0"), "text"), 256)).withColumn("when", F.struct(F.col("turn").isNotNull().alias("known"), "turn"))
    )
    firsts = (
        one.where("n > 0").groupBy(F.col("conv").alias("c"), F.col("said").alias("s")).agg(F.min("when").alias("first"), F.count("*").alias("times"))
        .where("times > 1").drop("times")
    )
    return one.join(firsts, (F.col("s") == F.col("said")) & F.col("c").eqNullSafe(F.col("conv")), "left").select(
        "conv", "turn", "role", "text", "n", F.coalesce(F.col("when") > F.col("first"), F.lit(False)).alias("later")
    )


def repair(df: DataFrame, scratch: Scratch, n: Column | None = None, digest: bool = False) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired of each conversation.

    df has conv_id, turn, role and text; ``n`` is how often a row stands (0: it is gone, its
    conversation stays). repaired is the text ``role:text``, a line a row, or with ``digest`` its sha256 in hex.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    kind = df.schema["conv_id"].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv", "turn", "role", "text"]
    dealt = rows_of(df, F.lit(1) if n is None else n).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    left_schema = f"conv {kind}, {_LEFT}"
    of_left = _arrow(spark, left_schema)
    left = scratch.write(dealt.mapInArrow(lambda it: _partition(it, of_left, digest), left_schema), "blocks")
    result = f"conv {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired string"
    of_result = _arrow(spark, result)
    names = of_result.names
    opened = left.where("kind > 0").repartition(parts, "conv").sortWithinPartitions("conv", "kind", "part", "block", "seq")
    finished = opened.mapInArrow(lambda it: _open(it, of_result, digest), result)
    return left.where("kind = 0").select(*names).unionByName(finished).withColumnRenamed("conv", "conv_id")


def _arrow(spark, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def damaged(df: DataFrame) -> tuple[DataFrame, Column]:
    """Conversations with seeded faults for tests of the repair: by crc32 of ``conv_id:turn``, a row in twenty each is dropped (n 0), emptied, robbed of its stops, repeated (n 2) or made the user's."""
    blank = F.lit(" ")
    fault = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank)).cast("binary")) % 20
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    made = df.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("n"),
    )
    return made, F.col("n")
