"""Conversation structure repair: the cheapest edits that leave turns in order, by dynamic programming over runs.

Allowed role initials are ``(s?(ua)+)?``. A row's symbol is its role's initial with its fault. Equal consecutive
symbols are one run; a run of any length is taken in one go, by binary powers of its symbol's min-plus transition
between the four states (nothing yet, after system, after user, after assistant). The choices are then unrolled
row by row for the audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlake.llm.common import cut_lineage, parts_for, small_batches, text_of

BLANK = "\t\n\x0b\x0c\r "
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
INITIALS = "sua"
NEXT = (2, 2, 3, 2)  # state after an inserted or reroled turn
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}  # state after a kept turn
ENDS = (0, 3)  # states in which a conversation may end
ROLES = {2: "user", 3: "assistant"}
_FAR = 1 << 60
_BLOCK = 4096  # rows of a run unrolled at a time
_PART_BYTES = 64 << 20
GONE = ord("-")  # symbol of a blank or repeated row; others are the initial, upper case if truncated, "x" for other roles

Vector = tuple[int, int, int, int]
Matrix = tuple[Vector, Vector, Vector, Vector]


def _times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(min(a[i][k] + b[k][j] for k in range(4)), _FAR) for j in range(4)) for i in range(4))


def _apply(m: Matrix, v: Vector) -> Vector:
    return tuple(min(min(row[k] + v[k] for k in range(4)), _FAR) for row in m)


def _choices(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """Letter, cost and next state of what may be done with a row, in the letters' order."""
    found = [("D", DELETE, state)]
    if symbol != GONE:
        more = TRUNCATED * chr(symbol).isupper()
        if (after := KEPT.get((state, chr(symbol).lower()))) is not None:
            found.append(("K", more, after))
        found.append(("R", REROLE + more, NEXT[state]))
    return found


@cache
def _inserts() -> Matrix:
    """Costs of going from state to state by inserted turns alone."""
    rows = []
    for start in range(4):
        costs, state, spent = [_FAR] * 4, start, 0
        while costs[state] > spent:
            costs[state] = spent
            state, spent = NEXT[state], spent + INSERT
        rows.append(tuple(costs))
    return tuple(rows)


@cache
def _power(symbol: int, k: int) -> Matrix:
    """The transition of 2 ** k rows of one symbol, inserted turns before each included."""
    if k:
        return _times(_power(symbol, k - 1), _power(symbol, k - 1))
    step = [[_FAR] * 4 for _ in range(4)]
    for state in range(4):
        for _, cost, after in _choices(symbol, state):
            step[state][after] = min(step[state][after], cost)
    return _times(_inserts(), tuple(map(tuple, step)))


def _before(symbol: int, rows: int, v: Vector) -> Vector:
    """Costs to go before ``rows`` rows of one symbol, given those after them."""
    k = 0
    while rows >> k:
        if rows >> k & 1:
            v = _apply(_power(symbol, k), v)
        k += 1
    return v


def _last() -> Vector:
    """Costs to go after the last row."""
    return tuple(min(row[end] for end in ENDS) for row in _inserts())


def repair_audit(symbols: bytes) -> tuple[int, str]:
    """Least cost of a conversation's symbols, and of the cheapest edits the least letters in ASCII.

    K keep, R rerole, D delete, I insert. No symbols cost nothing.
    """
    runs = [(symbol, sum(1 for _ in same)) for symbol, same in groupby(symbols)]
    after = [_last()]  # of each run, from the last one
    for symbol, rows in reversed(runs):
        after.append(_before(symbol, rows, after[-1]))
    cost = after[-1][0]
    letters: list[str] = []
    state = 0

    for (symbol, rows), end in zip(runs, after[-2::-1], strict=True):
        for first in range(0, rows, _BLOCK):
            here = min(_BLOCK, rows - first)
            costs = [_before(symbol, rows - first - here, end)]
            for _ in range(here):
                costs.append(_apply(_power(symbol, 0), costs[-1]))
            for row in range(here, 0, -1):
                now, then = costs[row], costs[row - 1]
                while True:
                    options = _choices(symbol, state)
                    # letters in order: D, I, K, R
                    options.insert(1, ("I", INSERT, NEXT[state]))
                    for letter, spent, to in options:
                        if spent + (now if letter == "I" else then)[to] == now[state]:
                            break
                    letters.append(letter)
                    state = to
                    if letter != "I":
                        break
    while state not in ENDS:
        letters.append("I")
        state = NEXT[state]
    return cost, "".join(letters)


class Turn(NamedTuple):
    turn: int | None
    role: str
    text: str


def edited(rows: Iterable[Turn], letters: str, state: int = 0) -> Iterator[tuple[str, str, str]]:
    """Letter, role and text of the turns that the edits leave; deleted rows are left out."""
    rest = iter(rows)
    for letter in letters:
        row = None if letter == "I" else next(rest)
        if letter == "D":
            continue
        if letter == "K":
            state = KEPT[state, row.role[:1]]
            yield letter, row.role, row.text
        else:
            state = NEXT[state]
            yield letter, ROLES[state], row.text if row else ""


def fault_of(text: str) -> str:
    """``blank``, ``truncated`` or nothing."""
    seen = text.rstrip(BLANK)
    return "blank" if not seen else "" if seen[-1] in ".!?" else "truncated"


class Summary:
    """What is told of rows in order: counts, turns and symbols; summaries of consecutive rows add up."""

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.first = self.last = None
        self.symbols = bytearray()

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        self.turns += turn is not None and turn != self.high
        self._follows(initial, initial, turn, turn)
        symbol = initial if initial and initial in INITIALS else "x"
        self.symbols.append(GONE if fault in ("blank", "duplicate") else ord(symbol.upper() if fault else symbol))

    def _follows(self, first: str, last: str, low: int | None, high: int | None) -> None:
        if self.first is None:
            self.first = first
        else:
            self.illegal += self.last + first not in ("su", "ua", "au")
        self.last = last
        self.low = low if self.low is None else self.low
        self.high = self.high if high is None else high

    def extend(self, other: dict) -> None:
        """Rows of a later part; ``other`` has this object's fields."""
        if other["first"] is None:
            return
        self.turns += other["turns"] - (other["low"] is not None and other["low"] == self.high)
        for name in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + other[name])
        self._follows(other["first"], other["last"], other["low"], other["high"])
        self.symbols += other["symbols"]

    def counts(self) -> tuple[int, int, int, int, int]:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal


def _digest(turns: Iterable[tuple[str, str, str]]) -> str:
    total = hashlib.sha256()
    for i, (_, role, text) in enumerate(turns):
        total.update((f"\n{role}:{text}" if i else f"{role}:{text}").encode())
    return total.hexdigest()


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_OUT = f"key string, done boolean, {RESULT}, part int, at long, turn long, role string, text string"
_NAMES = [f.split()[0] for f in _OUT.split(", ")]


class _Conversation:
    """Rows of one conversation in one task, in order."""

    def __init__(self, key: str):
        self.key, self.rows = key, []

    def results(self, turns_out: bool) -> list[dict]:
        summary, seen, turns = Summary(), set(), []
        for row in self.rows:
            if row["text"] is None:  # only a mark of the conversation
                continue
            own = hashlib.sha256(f"{len(row['role'])}:{row['role']}{row['text']}".encode()).digest()[:16]
            fault = fault_of(row["text"])
            fault = "duplicate" if own in seen and fault != "blank" else fault
            seen.add(own)
            summary.add(row["turn"], row["role"][:1], fault)
            turns.append(Turn(row["turn"], row["role"], row["text"]))
        cost, audit = repair_audit(bytes(summary.symbols))
        own = {"key": self.key, "done": True}
        if turns_out:
            left = enumerate(edited(turns, audit))
            return [own | {"at": i, "audit": letter, "role": role, "text": text} for i, (letter, role, text) in left]
        values = (*summary.counts(), cost, audit, _digest(edited(turns, audit)))
        return [own | dict(zip(_NAMES[2:10], values, strict=True))]


def _whole(batches: Iterator[pa.RecordBatch], turns_out: bool = False) -> Iterator[pa.RecordBatch]:
    """Results (or turns) of the conversations that lie in this task whole; the rows of its first and last one as they are.

    Rows come in order. What is held is a conversation inside the task's own range of rows.
    """
    schema = pa.schema(
        [("key", pa.string()), ("done", pa.bool_())]
        + [(n, pa.int64()) for n in _NAMES[2:8]]
        + [("audit", pa.string()), ("repaired_sha256", pa.string()), ("part", pa.int32()), ("at", pa.int64())]
        + [("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]
    )
    first, now, at = True, None, 0

    def closed() -> list[dict]:
        return now.rows if first else now.results(turns_out)

    for batch in small_batches(batches, 4):
        out: list[dict] = []
        for key, part, turn, role, text, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or key != now.key:
                if now is not None:
                    out += closed()
                    first = False
                now = _Conversation(key)
            for _ in range(times):
                now.rows.append({"key": key, "done": False, "part": part, "at": at, "turn": turn, "role": role, "text": text})
                at += 1
            if first:
                out += now.rows
                now.rows.clear()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    if now is not None and now.rows:
        yield pa.RecordBatch.from_pylist(now.rows, schema)  # it may go on in the next task


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The summary of each conversation's rows of one part, rows in order."""
    fields = [("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("turns", pa.int64())]
    fields += [("low", pa.int64()), ("high", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("symbols", pa.binary())]
    schema = pa.schema([("key", pa.string()), ("part", pa.int32()), *fields])
    now, summary = None, Summary()

    def done() -> pa.RecordBatch:
        values = {n: bytes(summary.symbols) if n == "symbols" else getattr(summary, n) for n, _ in fields}
        return pa.RecordBatch.from_pylist([{"key": now[0], "part": now[1]} | values], schema)

    for batch in batches:
        for key, part, turn, initial, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (key, part) != now:
                if now is not None:
                    yield done()
                now, summary = (key, part), Summary()
            if fault is not None:
                summary.add(turn, initial, fault)
    if now is not None:
        yield done()


def _joined(group: pa.Table) -> pa.Table:
    """The result of a conversation from the summaries of its parts, and each part's letters."""
    total, parts = Summary(), sorted(group.to_pylist(), key=lambda part: part["part"])
    for part in parts:
        total.extend(part)
    cost, audit = repair_audit(bytes(total.symbols))
    values = dict(zip(_NAMES[2:9], (*total.counts(), cost, audit), strict=True))
    rows, at = [], 0
    for part in parts:
        to, left = at, len(part["symbols"])
        while to < len(audit) and (left or part is parts[-1]):  # inserted turns go with the row after them
            left -= audit[to] != "I"
            to += 1
        rows.append({"key": part["key"], "part": part["part"], "letters": audit[at:to]} | (values if not rows else {}))
        at = to
    fields = [("key", pa.string()), ("part", pa.int32()), ("letters", pa.string())]
    return pa.Table.from_pylist(rows, pa.schema([*fields, *((n, pa.int64()) for n in _NAMES[2:8]), ("audit", pa.string())]))


def _hashed(batches: Iterator[pa.RecordBatch], turns_out: bool = False) -> Iterator[pa.RecordBatch]:
    """Digest (or turns) of each repaired conversation from its parts in order, each part's letters before its rows."""
    now, total, letters, place, state, at, out = None, hashlib.sha256(), "", 0, 0, 0, []
    if turns_out:
        schema = pa.schema([("key", pa.string()), ("at", pa.int64()), ("audit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    else:
        schema = pa.schema([("key", pa.string()), ("repaired_sha256", pa.string())])

    def put(letter: str, role: str, text: str) -> None:
        nonlocal at
        if turns_out:
            out.append({"key": now, "at": at, "audit": letter, "role": role, "text": text})
        else:
            total.update((f"\n{role}:{text}" if at else f"{role}:{text}").encode())
        at += 1

    def inserts() -> None:
        nonlocal place, state
        while place < len(letters) and letters[place] == "I":
            state, place = NEXT[state], place + 1
            put("I", ROLES[state], "")

    def done() -> None:
        inserts()
        if not turns_out:
            out.append({"key": now, "repaired_sha256": total.hexdigest()})

    for batch in small_batches(batches, 3):
        for key, given, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != now:
                if now is not None:
                    done()
                now, total, letters, place, state, at = key, hashlib.sha256(), "", 0, 0, 0
            if given is not None:
                inserts()
                letters, place = given, 0
                continue
            if text is None:
                continue
            inserts()
            letter, place = letters[place], place + 1
            if letter == "K":
                state = KEPT[state, role[:1]]
                put(letter, role, text)
            elif letter == "R":
                state = NEXT[state]
                put(letter, ROLES[state], text)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
            out.clear()
    if now is not None:
        done()
        yield pa.RecordBatch.from_pylist(out, schema)


def _rows(turns: DataFrame, key_col: str, times_col: str | None, turns_out: bool) -> tuple[DataFrame, DataFrame]:
    """What ``_whole`` finds in the rows, sorted over all tasks, and the rows that it leaves."""
    key = F.coalesce(F.concat(F.lit("="), F.col(key_col).cast("string")), F.lit(""))
    times = F.col(times_col) if times_col else F.lit(1)
    rows = turns.select(
        key.alias("key"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.when(times > 0, F.coalesce("text", F.lit(" "))).alias("text"),  # a row that is not there marks its conversation
        F.greatest(times, F.lit(1)).cast("int").alias("times"),
    )
    size = turns.agg(F.sum(F.octet_length(text_of("text")) + 64)).first()[0] or 0
    order = [F.asc_nulls_first(c) for c in ("key", "turn", "role", "text", "salt")]
    spread = rows.withColumn("salt", F.monotonically_increasing_id())  # equal rows need not meet in one task
    spread = spread.repartitionByRange(parts_for(turns.sparkSession, size, _PART_BYTES), *order).sortWithinPartitions(*order)
    spread = spread.select("key", F.spark_partition_id().alias("part"), "turn", "role", "text", "times")
    found = cut_lineage(spread.mapInArrow(lambda batches: _whole(batches, turns_out), _OUT), "repair-whole")
    return found.filter("done"), found.filter("NOT done").select("key", "part", "at", "turn", "role", "text")


def _pieces(rows: DataFrame) -> DataFrame:
    """Letters of each part of the conversations that are cut into parts, and their results beside the first part."""
    own = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    filled = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ended = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    plain = F.when(~filled, "blank").when(~ended, "truncated").when(F.col("text").isNotNull(), "")
    initial = F.substring("role", 1, 1).alias("initial")
    narrow = cut_lineage(rows.select("key", "part", "at", "turn", initial, plain.alias("plain"), own.alias("own")), "repair-symbols")
    first = narrow.groupBy("key", "own").agg(F.min(F.struct("part", "at")).alias("first"))
    repeated = (F.col("plain") != "blank") & (F.struct("part", "at") > F.col("first"))
    fault = F.when(repeated, "duplicate").otherwise(F.col("plain")).alias("fault")
    segments = (
        narrow.join(first, ["key", "own"], "left")
        .select("key", "part", "at", "turn", "initial", fault)
        .repartition("key", "part")
        .sortWithinPartitions("key", "part", "at")
        .select("key", "part", "turn", "initial", "fault")
        .mapInArrow(
            _segments,
            "key string, part int, blank long, duplicate long, truncated long, illegal long, turns long, low long, "
            "high long, first string, last string, symbols binary",
        )
    )
    counts = ", ".join(f"{n} long" for n in _NAMES[2:8])
    pieces = segments.groupBy("key").applyInArrow(_joined, f"key string, part int, letters string, {counts}, audit string")
    return cut_lineage(pieces, "repair-pieces")


def _past_letters(rows: DataFrame, pieces: DataFrame, schema: str, turns_out: bool) -> DataFrame:
    """The texts of cut conversations streamed past their letters, one conversation after the other."""
    none = F.lit(None).cast("string")
    given = pieces.select("key", "part", F.lit(-1).cast("long").alias("at"), "letters", none.alias("role"), none.alias("text"))
    stream = given.unionByName(rows.select("key", "part", "at", none.alias("letters"), "role", "text"))
    ordered = stream.repartition("key").sortWithinPartitions("key", "part", "at").select("key", "letters", "role", "text")
    return ordered.mapInArrow(lambda batches: _hashed(batches, turns_out), schema)


def _id_of(turns: DataFrame, key_col: str) -> Column:
    kind = turns.schema[key_col].dataType
    return F.when(F.col("key") != "", F.expr("substring(key, 2)")).cast(kind).alias(key_col)


def repair(turns: DataFrame, key_col: str = "conv_id", times_col: str | None = None) -> DataFrame:
    """One row for each conversation: its id, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``,
    ``audit`` and ``repaired_sha256`` (of the repaired ``role:text``, a line each).

    ``turns`` has ``turn``, ``role`` and ``text``; a null role or text is one space, a null id one conversation, null
    turns come first. Rows of one turn are ordered by role and text, so repeated rows are side by side. ``times_col``
    says how often a row is there; a conversation of which no row is left has zeros, an empty audit and the digest of
    nothing. An empty table has no rows. Other columns are not read.

    Rows are sorted over all tasks by conversation and turn, so one of any size is cut across them. Conversations
    inside one task end there. Those at a task's borders are put together from narrow summaries of their parts; of
    those, a symbol for each row meets in one task, as the audit, one value, has to, and the texts are streamed past
    one digest, which knows no other order.
    """
    done, rest = _rows(turns, key_col, times_col, turns_out=False)
    pieces = _pieces(rest)
    digests = _past_letters(rest, pieces, "key string, repaired_sha256 string", turns_out=False)
    joined = pieces.filter("cost IS NOT NULL").join(digests, "key")
    names = _NAMES[2:10]
    return done.select("key", *names).unionByName(joined.select("key", *names)).select(_id_of(turns, key_col), *names)


def repaired_turns(turns: DataFrame, key_col: str = "conv_id", times_col: str | None = None) -> DataFrame:
    """The repaired conversations: their id, ``at`` (from 0, no gaps), ``edit`` (``K``, ``R`` or ``I``), ``role`` and ``text``.

    Rows as in ``repair``; deleted ones are left out, so a conversation may have none.
    """
    done, rest = _rows(turns, key_col, times_col, turns_out=True)
    names = ["key", "at", "audit", "role", "text"]
    cut = _past_letters(rest, _pieces(rest), "key string, at long, audit string, role string, text string", turns_out=True)
    both = done.select(*names).unionByName(cut.select(*names))
    return both.select(_id_of(turns, key_col), "at", F.col("audit").alias("edit"), "role", "text")


def damaged(turns: DataFrame) -> tuple[DataFrame, str]:
    """``turns`` with faults chosen by the CRC-32 of id and turn, and the column that says how often a row is there.

    Of twenty, 0 drops a row, 1 empties its text, 2 takes its full stops, 3 repeats it, 4 sets its role to user.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    which = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    text = F.coalesce("text", space)
    rows = turns.select(
        "conv_id",
        "turn",
        F.when(which == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(which == 1, "").when(which == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(which == 0, 0).when(which == 3, 2).otherwise(1).alias("times"),
    )
    return rows, "times"
