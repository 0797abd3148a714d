"""Repair of the structure of conversations by the cheapest edits.

A repaired conversation has role initials of the form (s?(ua)+)? : perhaps a system message, then user and assistant in
turn. Rows may be kept (K, cost 0), given the role user or assistant (R, 3) or deleted (D, 4; blank and repeated rows
must be); an empty message of user or assistant may be inserted anywhere (I, 3); a truncated row that isn't deleted adds
3. Of the cheapest edits those are taken whose letters, in order, are least in ASCII.

Nodes of a graph are (rows read, state), with a state for what may follow: the start, after a system, user or assistant
message. Minimum costs from the start (forward) and to an end (backward) tell the arcs that lie on a cheapest path: those
where forward cost, own cost and backward cost add up to the total. Every such arc costs something or reads a row, so
they form a DAG; it is walked from the start with the set of nodes that the letters so far lead to, taking the least
letter that leaves the set.

A conversation may be of any size. Rows are sorted by ranges over all conversations; consecutive rows of a conversation in
a range form fragments of bounded length, a byte per row. Where a conversation has several fragments, each one's matrix
of costs from state to state takes it to the costs before and after it, and its map of states to the state that the walk
enters it with. Then fragments are walked one by one, in any task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexatlas.sources.workspace import map_arrow, materialize

#: Rows of a fragment, and of the fragments that a task walks.
FRAGMENT, TASK_ROWS = 1 << 16, 1 << 15
#: The white space of [^\\x20\\x09-\\x0D].
WHITE = " \t\n\x0b\f\r"
KEEP, REROLE, DELETE, INSERT = 0.0, 3.0, 4.0, 3.0
TRUNCATED = 3.0
# A row as a byte: its role's initial (s, u, a, another), and its first fault.
INITIALS = "sua"
BLANK, REPEATED, OPEN = 4, 8, 16
NONE = float("inf")
#: From state (start, after s, after u, after a) and initial to state.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
START, END = (0.0, NONE, NONE, NONE), (0.0, NONE, NONE, 0.0)
STATES = range(4)
ROLE = {"u": "user", "a": "assistant"}

Costs = tuple[float, ...]


@lru_cache
def row_arcs(code: int) -> tuple[tuple[int, str, str, int, float], ...]:
    """Arcs that read a row: state, letter, role given, next state, cost."""
    arcs = [(q, "D", "", q, DELETE) for q in STATES]
    if not code & (BLANK | REPEATED):
        more = TRUNCATED if code & OPEN else 0.0
        for q in STATES:
            arcs += [(q, "K", "", to, KEEP + more) for c, to in NEXT[q].items() if INITIALS.find(c) == code & 3]
            arcs += [(q, "R", c, to, REROLE + more) for c, to in NEXT[q].items() if c in ROLE]
    return tuple(arcs)


#: Arcs that read none: state, letter, role inserted, next state, cost.
INSERTS = tuple((q, "I", c, to, INSERT) for q in STATES for c, to in NEXT[q].items() if c in ROLE)


def _opened(costs: list[float], forward: bool) -> Costs:
    """Costs with any number of insertions; three rounds reach every state."""
    costs = list(costs)
    for _ in range(3):
        for q, _, _, to, cost in INSERTS:
            if forward:
                costs[to] = min(costs[to], costs[q] + cost)
            else:
                costs[q] = min(costs[q], costs[to] + cost)
    return tuple(costs)


#: Costs to an end, with what may be inserted after the last row.
ENDING = _opened(END, False)


def _level(costs: Costs) -> tuple[Costs, float]:
    """Costs less their least, which keeps the number of different ones small; and that least."""
    least = min(costs)
    return tuple(c - least for c in costs), least


@lru_cache(maxsize=1 << 16)
def forward(code: int, before: Costs) -> tuple[Costs, float]:
    """Costs after a row from those before it."""
    costs = [NONE] * 4
    for q, _, _, to, cost in row_arcs(code):
        costs[to] = min(costs[to], before[q] + cost)
    return _level(_opened(costs, True))


@lru_cache(maxsize=1 << 16)
def backward(code: int, after: Costs) -> tuple[Costs, float]:
    """Costs to an end before a row from those after it."""
    costs = [NONE] * 4
    for q, _, _, to, cost in row_arcs(code):
        costs[q] = min(costs[q], cost + after[to])
    return _level(_opened(costs, False))


@lru_cache(maxsize=1 << 16)
def walk(code: int, before: Costs, after: Costs, at: frozenset) -> tuple[str, str, str, frozenset]:
    """The least letters along tight arcs from a set of states through a row: roles inserted before it, its letter, the
    role given to it, and the states reached. Equal letters lead to equal states, so roles are those of any path."""
    here, least = backward(code, after)
    total = min(f + b for f, b in zip(before, here)) + least
    inserted = ""
    while True:
        tight = [(letter, role, to) for q, letter, role, to, cost in row_arcs(code) if q in at and before[q] + cost + after[to] == total]
        tight += [(letter, role, to) for q, letter, role, to, cost in INSERTS if q in at and before[q] + cost + here[to] + least == total]
        letter = min(x[0] for x in tight)
        role = next(x[1] for x in tight if x[0] == letter)
        at = frozenset(x[2] for x in tight if x[0] == letter)
        if letter != "I":
            return inserted, letter, role, at
        inserted += role


@lru_cache(maxsize=1 << 10)
def close(before: Costs, at: frozenset) -> str:
    """Roles inserted after the last row."""
    total, inserted = min(f + b for f, b in zip(before, ENDING)), ""
    while not any(END[q] == 0 and before[q] == total for q in at):
        tight = [(role, to) for q, _, role, to, cost in INSERTS if q in at and before[q] + cost + ENDING[to] == total]
        inserted += tight[0][0]
        at = frozenset(x[1] for x in tight)
    return inserted


def matrix(codes: bytes) -> list[float]:
    """A fragment's costs from each state before it to each state after it, row by row."""
    out = []
    for q in STATES:
        costs, total = _opened([0.0 if p == q else NONE for p in STATES], True), 0.0
        for code in codes:
            costs, least = forward(code, costs)
            total += least
        out += [c + total for c in costs]
    return out


def steps(codes: bytes, before: Costs, after: Costs, entry: int) -> tuple[list[tuple[str, str, str]], Costs, frozenset]:
    """The walk through a fragment from a state: (inserted, letter, role given) of each row, the forward costs at its end
    and the states reached. A state that no cheapest path enters gives none."""
    befores, costs = [], _level(_opened(before, True))[0]
    for code in codes:
        befores.append(costs)
        costs = forward(code, costs)[0]
    last = costs
    afters, costs = [], _level(_opened(after, False))[0]
    for code in reversed(codes):
        afters.append(costs)
        costs = backward(code, costs)[0]
    tight = min(f + b for f, b in zip(befores[0], costs))
    if befores[0][entry] + costs[entry] != tight:
        return [], last, frozenset()
    out, at = [], frozenset([entry])
    for code, f, b in zip(codes, befores, reversed(afters)):
        *step, at = walk(code, f, b, at)
        out.append(tuple(step))
    return out, last, at


# Spark: rows, fragments, edits.

FRAGMENTS = "conv_id long, at long, rows long, codes binary, blank long, duplicate long, truncated long, illegal long, first int, last int, turns long, least long, most long"
_LEGAL = ((0, 1), (1, 2), (2, 1))


def sorted_rows(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with `at`, their place: by conv_id, turn, role and text, nulls first."""
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("uid"))
    keys = ["conv_id", "turn", "role", "text", "uid"]
    placed = own.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("uid")
    return materialize(placed.withColumn("at", F.monotonically_increasing_id()), "sorted-rows", compression="zstd")


def _codes(placed: DataFrame) -> DataFrame:
    """at, part (of the ranges), conv_id, turn and code of each row."""
    solid = F.rtrim(F.col("text"), F.lit(WHITE))
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    own = placed.select("at", "conv_id", "turn", said.alias("said"), F.instr(F.lit(INITIALS), F.substring("role", 1, 1)).alias("initial"), (F.length("role") > 0).alias("named"),
                        (solid == "").alias("blank"), (~F.right(solid, F.lit(1)).isin(*".!?")).alias("open"))
    narrow = materialize(own, "rows-faults")
    firsts = narrow.groupBy("conv_id", "said").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("is_first"))
    initial = F.when(F.col("named") & (F.col("initial") > 0), F.col("initial") - 1).otherwise(3)
    fault = F.when(F.col("blank"), BLANK).when(F.col("is_first").isNull(), REPEATED).when(F.col("open"), OPEN).otherwise(0)
    return narrow.join(firsts, "at", "left").select("at", F.shiftright("at", 33).cast("int").alias("part"), "conv_id", "turn", (initial + fault).cast("int").alias("code"))


def _fragment(rows: list[tuple[np.ndarray, ...]], conv_id: int | None) -> tuple:
    at, turn, code = (np.concatenate(c) for c in zip(*rows))
    known = turn[turn != _NO_TURN]
    first, last = code[:-1] & 3, code[1:] & 3
    legal = np.zeros(len(first), bool)
    for a, b in _LEGAL:
        legal |= (first == a) & (last == b)
    turns = 1 + int((known[1:] != known[:-1]).sum()) if len(known) else 0
    counts = (int(((code & bit) > 0).sum()) for bit in (BLANK, REPEATED, OPEN))
    return conv_id, int(at[0]), len(at), code.tobytes(), *counts, int((~legal).sum()), int(code[0] & 3), int(code[-1] & 3), turns, int(known[0]) if len(known) else None, int(known[-1]) if len(known) else None


_NO_TURN = np.iinfo(np.int64).min


def _fragments(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(c, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[t]) for c, t in (f.split() for f in FRAGMENTS.split(", "))])
    key, rows, held, out = None, [], 0, []
    for batch in batches:
        at, part = (np.asarray(batch.column(c), np.int64) for c in ("at", "part"))
        turn = np.asarray(batch.column("turn").fill_null(_NO_TURN), np.int64)
        code = np.asarray(batch.column("code"), np.uint8)
        conv, null = np.asarray(batch.column("conv_id").fill_null(0), np.int64), np.asarray(batch.column("conv_id").is_null())
        edges = 1 + np.flatnonzero((np.diff(part) != 0) | (np.diff(conv) != 0) | (null[1:] != null[:-1]))
        for a, z in zip([0, *edges.tolist()], [*edges.tolist(), len(at)]):
            own = (int(part[a]), None if null[a] else int(conv[a])) if z > a else key
            if rows and own != key:
                out.append(_fragment(rows, key[1]))
                rows, held = [], 0
            key = own
            while z > a:
                more = min(z - a, size - held)
                rows.append((at[a : a + more], turn[a : a + more], code[a : a + more]))
                a, held = a + more, held + more
                if held == size:
                    out.append(_fragment(rows, key[1]))
                    rows, held = [], 0
        if len(out) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out = []
    if rows:
        out.append(_fragment(rows, key[1]))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def fragments(placed: DataFrame, size: int = FRAGMENT) -> DataFrame:
    """Consecutive rows of a conversation, `size` at most, with their codes, faults and turns."""
    rows = _codes(placed).repartition("part").sortWithinPartitions("part", "at")
    return materialize(map_arrow(rows, lambda it: _fragments(it, size), FRAGMENTS), "fragments")


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        costs = pa.array([matrix(c) for c in batch.column("codes").to_pylist()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("at"), costs], names=["conv_id", "at", "costs"])


def _around(own: pd.DataFrame) -> pd.DataFrame:
    """Costs before and after each fragment of a conversation."""
    own = own.sort_values("at")
    costs = [np.array(c).reshape(4, 4) for c in own["costs"]]
    before, after = [np.array(START)], [np.array(ENDING)]
    for m in costs[:-1]:
        before.append((before[-1][:, None] + m).min(axis=0))
    for m in costs[:0:-1]:
        after.append((m + after[-1]).min(axis=1))
    return pd.DataFrame({"at": own["at"], "before": [b.tolist() for b in before], "after": [a.tolist() for a in reversed(after)]})


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state that a fragment's walk ends in for each state that it may begin in, -1 where there is no walk."""
    for batch in batches:
        out = []
        for codes, before, after in zip(*(batch.column(c).to_pylist() for c in ("codes", "before", "after"))):
            ends = (steps(codes, tuple(before), tuple(after), q)[2] for q in STATES)
            out.append([min(e) if e else -1 for e in ends])
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("at"), pa.array(out, pa.list_(pa.int32()))], names=["conv_id", "at", "exits"])


def _entries(own: pd.DataFrame) -> pd.DataFrame:
    """The state in which the walk enters each fragment of a conversation."""
    own, at = own.sort_values("at"), [0]
    for exits in own["exits"]:
        at.append(int(exits[at[-1]]))
    return pd.DataFrame({"at": own["at"], "entry": at[:-1]})


_EDITS = "conv_id long, at long, inserted string, edit string, role_given string, added string, cost long"
_COST = {"K": KEEP, "R": REROLE, "D": DELETE}


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _EDITS.split(", ")]
    for batch in batches:
        for conv_id, at, codes, before, after, entry, final in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "at", "codes", "before", "after", "entry", "final"))):
            found, last, reached = steps(codes, tuple(before or START), tuple(after or ENDING), entry or 0)
            added = [""] * (len(found) - 1) + [close(last, reached) if final else ""]
            cost = [_COST[edit] + (TRUNCATED if code & OPEN and edit != "D" else 0) + INSERT * len(inserted + more) for code, (inserted, edit, _), more in zip(codes, found, added)]
            columns = [pa.array([conv_id] * len(found), pa.int64()), pa.array(np.arange(at, at + len(found))), *(pa.array(c, pa.string()) for c in zip(*found)), pa.array(added, pa.string()), pa.array(np.array(cost, np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def edits(parts: DataFrame) -> DataFrame:
    """Of each row: conv_id, at, inserted (initials of the roles inserted before it), edit, role_given (initial of the role
    that R gives), added (initials of the roles inserted after the last row), cost."""
    own = Window.partitionBy("conv_id")
    shown = parts.select("conv_id", "at", F.count("*").over(own).alias("n"), (F.max("at").over(own) == F.col("at")).alias("final"))
    several = materialize(shown.where("n > 1"), "several").select("at", "final")
    chosen = materialize(parts.select("conv_id", "at", "codes").join(several.select("at"), "at"), "split")
    costs = map_arrow(chosen, _matrices, "conv_id long, at long, costs array<double>")
    around = materialize(costs.groupBy("conv_id").applyInPandas(_around, "at long, before array<double>, after array<double>"), "around")
    exits = map_arrow(chosen.join(around, "at"), _exits, "conv_id long, at long, exits array<int>")
    entries = exits.groupBy("conv_id").applyInPandas(_entries, "at long, entry int")
    known = several.join(around, "at").join(entries, "at")
    tasks = max(1, -(-(parts.agg(F.sum("rows")).first()[0] or 0) // TASK_ROWS))
    whole = parts.select("conv_id", "at", "codes").join(known, "at", "left").withColumn("final", F.coalesce("final", F.lit(True)))
    return map_arrow(whole.repartition(tasks, "at"), _edits, _EDITS)


def report(parts: DataFrame, edited: DataFrame) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost."""
    w = Window.partitionBy("conv_id").orderBy("at")
    ended = F.last("most", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    pair = F.struct(F.lag("last").over(w).alias("a"), F.col("first").alias("b"))
    joined = parts.drop("codes").withColumns({"_pair": pair, "_shared": (ended == F.col("least")).cast("long")})
    legal = F.lit(False)
    for a, b in _LEGAL:
        legal = legal | ((F.col("_pair.a") == a) & (F.col("_pair.b") == b))
    joined = joined.withColumn("illegal", F.col("illegal") + F.when(F.col("_pair.a").isNotNull() & ~legal, 1).otherwise(0))
    sums = joined.groupBy("conv_id").agg(
        F.coalesce(F.max("most") - F.min("least") + 1 - F.sum(F.col("turns") - F.coalesce("_shared", F.lit(0))), F.lit(0)).alias("gaps"),
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")))
    costs = edited.groupBy("conv_id").agg(F.sum("cost").alias("cost"))
    return sums.join(costs, sums.conv_id.eqNullSafe(costs.conv_id)).drop(costs.conv_id)


def repair(rows: DataFrame, size: int = FRAGMENT) -> tuple[DataFrame, DataFrame]:
    """Repaired messages, and a report per conversation.

    rows: (conv_id, turn, role, text); other columns are ignored. A conversation's rows are taken by turn (nulls first),
    those of one turn by role and text; null roles and texts count as empty. A row's first fault counts: blank (no
    character but white space), duplicate (role and text of an earlier row of its conversation), truncated (its last
    character but white space isn't one of .!?). A null conv_id is a conversation like others. Empty tables give none.

    Messages: conv_id, at and n (their order), edit (K, R, D or I), role and text (null where deleted). Report: conv_id,
    gaps (turns missing between the first and the last), blank, duplicate, truncated, illegal (neighbours whose initials
    aren't su, ua or au), cost.
    """
    placed = sorted_rows(rows)
    parts = fragments(placed, size)
    changes = materialize(edits(parts), "edits")
    opened = materialize(placed.select("at", "role", "text").join(changes, "at").select("conv_id", "at", F.posexplode(_messages()).alias("n", "m")), "messages", compression="zstd")
    messages = opened.select("conv_id", "at", "n", "m.edit", "m.role", "m.text")
    return messages, report(parts, changes)


def _messages() -> Column:
    """A row's messages: those inserted before it, itself, those added after it."""
    said = F.struct(F.col("edit").alias("edit"), F.when(F.col("edit") == "K", F.col("role")).when(F.col("edit") == "R", _role(F.col("role_given"))).alias("role"), F.when(F.col("edit") != "D", F.col("text")).alias("text"))
    return F.concat(_new("inserted"), F.array(said), _new("added"))


def _new(initials: str) -> Column:
    return F.transform(F.filter(F.split(initials, ""), lambda c: c != ""), lambda c: F.struct(F.lit("I").alias("edit"), _role(c).alias("role"), F.lit("").alias("text")))


def _role(initial: Column) -> Column:
    return F.when(initial == "u", ROLE["u"]).when(initial == "a", ROLE["a"])


class _Digest:
    """What is kept of a conversation while its messages pass."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.audit, self.text, self.n = conv_id, [], hashlib.sha256(), 0

    def add(self, edit: str, role: str | None, text: str | None) -> None:
        self.audit.append(edit)
        if edit != "D":
            self.text.update(f"{chr(10) if self.n else ''}{role}:{text}".encode())
            self.n += 1


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own, out = None, []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d.conv_id for d in out], pa.int64()), pa.array(["".join(d.audit) for d in out], pa.string()), pa.array([d.text.hexdigest() for d in out], pa.string())], names=["conv_id", "audit", "repaired_sha256"])

    for batch in batches:
        for conv_id, edit, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "edit", "role", "text"))):
            if own is None or own.conv_id != conv_id:
                own = _Digest(conv_id)
                out.append(own)
            own.add(edit, role, text)
        if len(out) > 4096:
            out.pop()
            yield made()
            out = [own]
    if out:
        yield made()


def digest(messages: DataFrame) -> DataFrame:
    """conv_id, audit (the letters) and repaired_sha256 (of role:text of all messages left, joined by line ends).

    A hash reads its conversation in order: messages are sorted by Spark and pass one by one; a task keeps the state of a
    hash and the letters, which are the result, never a conversation's text.
    """
    rows = messages.repartition("conv_id").sortWithinPartitions("conv_id", "at", "n").select("conv_id", "edit", "role", "text")
    return map_arrow(rows, _digests, "conv_id long, audit string, repaired_sha256 string")


def damage(rows: DataFrame) -> DataFrame:
    """Conversations with known faults, from (conv_id, turn, role, text), nulls read as one space: by the remainder of
    crc32("conv_id:turn") by 20, 0 drops a row, 1 empties its text, 2 takes .!? out of it, 3 repeats it, 4 makes its role
    user."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind, role, text = F.crc32(key.cast("binary")) % 20, F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    own = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    changed = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return own.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), copies.alias("copy")).drop("copy")


def audit(rows: DataFrame, size: int = FRAGMENT) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation of rows after
    damage(rows); zeros, no letters and the hash of nothing where no row is left."""
    messages, found = repair(damage(rows), size)
    ids, hashes = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct(), digest(messages)
    out = ids.join(found, ids.conv_id.eqNullSafe(found.conv_id), "left").drop(found.conv_id)
    out = out.join(hashes, ids.conv_id.eqNullSafe(hashes.conv_id), "left").drop(hashes.conv_id)
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


SQL = r"""
WITH RECURSIVE damaged AS (
  SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role,
         CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               xor(list_reduce(list_transform(range(1, 1 + length(key)), lambda i: CAST(ascii(key[i]) AS BIGINT)),
                               lambda c, b: list_reduce(range(0, 8), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)),
                               CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS k
        FROM (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations)),
       (VALUES (1), (2)) AS c (copy)
  WHERE k <> 0 AND (copy = 1 OR k = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, substring(role, 1, 1) AS own FROM damaged),
faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
         coalesce(lag(own) OVER (PARTITION BY conv_id ORDER BY n) || own NOT IN ('su', 'ua', 'au'), FALSE) AS illegal
  FROM placed),
next AS (SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) AS t (q, c, q2)),
opened AS (SELECT * FROM (VALUES (0, 0, '', []), (1, 1, '', []), (2, 2, '', []), (3, 3, '', []), (0, 2, 'I', ['user:']), (1, 2, 'I', ['user:']), (3, 2, 'I', ['user:']),
                                 (2, 3, 'I', ['assistant:']), (0, 3, 'II', ['user:', 'assistant:']), (1, 3, 'II', ['user:', 'assistant:'])) AS t (q, q2, letters, added)),
arcs AS (
  SELECT f.conv_id, f.n, q, q AS q2, 4 AS cost, 'D' AS letter, [] AS said FROM faults f, (SELECT DISTINCT q2 AS q FROM opened)
  UNION ALL
  SELECT f.conv_id, f.n, q, q2, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END, 'K', [role || ':' || text] FROM faults f JOIN next ON own = c WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL
  SELECT f.conv_id, f.n, q, q2, CASE fault WHEN 'truncated' THEN 6 ELSE 3 END, 'R', [CASE c WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text] FROM faults f, next WHERE c <> 's' AND fault NOT IN ('blank', 'duplicate')),
walks AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS n, 0 AS q, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS said FROM (SELECT DISTINCT conv_id FROM faults)
  UNION ALL
  SELECT conv_id, n, q, cost, audit, said
  FROM (SELECT w.conv_id, a.n, a.q2 AS q, w.cost + 3 * length(o.letters) + a.cost AS cost, w.audit || o.letters || a.letter AS audit, list_concat(list_concat(w.said, o.added), a.said) AS said
        FROM walks w JOIN opened o ON w.q = o.q JOIN arcs a ON w.conv_id IS NOT DISTINCT FROM a.conv_id AND a.n = w.n + 1 AND a.q = o.q2)
  QUALIFY row_number() OVER (PARTITION BY conv_id, n, q ORDER BY cost, audit) = 1),
ends AS (
  SELECT w.conv_id, w.cost + 3 * length(o.letters) AS cost, w.audit || o.letters AS audit, list_concat(w.said, o.added) AS said
  FROM walks w JOIN (SELECT conv_id, max(n) AS n FROM faults GROUP BY 1) f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND w.n = f.n JOIN opened o ON w.q = o.q
  WHERE o.q2 IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + 3 * length(o.letters), w.audit || o.letters) = 1),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal
  FROM faults GROUP BY 1)
SELECT i.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
LEFT JOIN counts c ON i.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends e ON i.conv_id IS NOT DISTINCT FROM e.conv_id"""
