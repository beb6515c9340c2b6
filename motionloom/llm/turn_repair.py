"""Conversations brought back to the alternating grammar `(s?(ua)+)?` by the cheapest edits.

A conversation's turns are aligned to every feasible length of the grammar string by
Wagner-Fischer tables. The cheapest alignment so far, at first "delete all", limits the lengths that
are tried and, after Ukkonen, the diagonals of each table; tables are filled from the end, so that
the walk from the start can take the least edit letter of all cheapest ones, and the audits of
different lengths are compared as strings.

A stretch of more than SEGMENT turns is aligned in pieces. The grammar string has four places to be
cut at (nothing said, after the system turn, after a user turn, after an assistant turn), so a piece
has one cheapest audit for each pair of places, and pieces join like matrices do. Pieces of a hot
conversation lie in many tasks; only these small tables of pairs meet.

Edits: K keeps a turn (0), R gives it the role user or assistant (1), D deletes it (2), I inserts an
empty user or assistant turn (5). A truncated turn that stays costs 5 more; blank and duplicate
turns must go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
SEGMENT = 32  # turns of one alignment
BLANKS = " \t\n\x0b\f\r"
HEAD = 64  # characters that order turns of one place and role before their digests do

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {"u": "user", "a": "assistant"}
LAWFUL = {"su", "ua", "au"}
#: What follows a place until another: (before, first of the alternating part, its least length, step).
ROUTES = {
    (START, START): [("", "u", 0, 0)],
    (START, SYSTEM): [("s", "u", 0, 0)],
    (START, USER): [("", "u", 1, 2), ("s", "u", 1, 2)],
    (START, ASSISTANT): [("", "u", 2, 2), ("s", "u", 2, 2)],
    (SYSTEM, SYSTEM): [("", "u", 0, 0)],
    (SYSTEM, USER): [("", "u", 1, 2)],
    (SYSTEM, ASSISTANT): [("", "u", 2, 2)],
    (USER, USER): [("", "a", 0, 2)],
    (USER, ASSISTANT): [("", "a", 1, 2)],
    (ASSISTANT, USER): [("", "u", 1, 2)],
    (ASSISTANT, ASSISTANT): [("", "u", 0, 2)],
}

Answer = tuple[int, str]
Pairs = dict[tuple[int, int], Answer]


def lengths(shape: str, before: str, least: int, step: int) -> Iterator[tuple[int, int]]:
    """Lower bounds of the cost and lengths of the alternating part, cheapest bound first."""
    n, gone = len(shape), shape.count("d")

    def bound(m: int) -> int:
        total = m + len(before)
        deleted = max(gone, n - total, 0)
        return DELETE * deleted + INSERT * (total - n + deleted)

    if not step:
        yield bound(least), least
        return
    up = least + max(0, -(-(n - gone - len(before) - least) // step)) * step
    down = up - step
    while True:
        if down < least or bound(up) <= bound(down):
            yield bound(up), up
            up += step
        else:
            yield bound(down), down
            down -= step


def fill(shape: str, target: str, limit: int) -> list[list[int]]:
    """Cost of aligning shape[i:] with target[j:]; beyond `limit` for cells that cannot lie on an answer."""
    n, m, far = len(shape), len(target), 10**9
    ahead = lambda k: DELETE * k if k >= 0 else -INSERT * k
    diagonals = [k for k in range(-m, n + 1) if ahead(k) + ahead(n - m - k) <= limit]
    low, high = (diagonals[0], diagonals[-1]) if diagonals else (1, 0)
    table = [[far] * (m + 2) for _ in range(n + 1)]
    for i in range(n, -1, -1):
        row = table[i]
        under = table[i + 1] if i < n else None
        code = shape[i] if i < n else ""
        stays = CUT_OFF if code.isupper() else 0
        initial = code.lower()
        for j in range(min(m, i - low), max(0, i - high) - 1, -1):
            if i == n and j == m:
                row[j] = 0
                continue
            best = far
            if i < n:
                best = under[j] + DELETE
                if j < m and code != "d":
                    want = target[j]
                    if want == initial:
                        best = min(best, under[j + 1] + stays + KEEP)
                    elif want != "s":
                        best = min(best, under[j + 1] + stays + REROLE)
            if j < m and target[j] != "s":
                best = min(best, row[j + 1] + INSERT)
            row[j] = best
    return table


def trace(shape: str, target: str, table: list[list[int]]) -> str:
    """The least of the cheapest edit strings: the least letter that stays cheapest, from the start."""
    n, m, i, j, out = len(shape), len(target), 0, 0, []
    while i < n or j < m:
        left = table[i][j]
        if i < n and table[i + 1][j] + DELETE == left:
            out.append("D")
            i += 1
        elif j < m and target[j] != "s" and table[i][j + 1] + INSERT == left:
            out.append("I")
            j += 1
        else:
            out.append("K" if shape[i].lower() == target[j] else "R")
            i, j = i + 1, j + 1
    return "".join(out)


def align(shape: str, start: int, end: int) -> Answer | None:
    """Cheapest cost and least audit of the turns between two places of the grammar; None if there is none.

    `shape` has a letter for each turn: d must go, else the role's initial (x: any other), in upper
    case where the text is truncated.
    """
    inserted = {(START, USER): 1, (START, ASSISTANT): 2, (SYSTEM, USER): 1, (SYSTEM, ASSISTANT): 2, (USER, ASSISTANT): 1, (ASSISTANT, USER): 1}.get((start, end), 0)
    best: Answer | None = None if (start, end) == (START, SYSTEM) else (DELETE * len(shape) + INSERT * inserted, "D" * len(shape) + "I" * inserted)
    for before, first, least, step in ROUTES[start, end]:
        for bound, m in lengths(shape, before, least, step):
            if best is not None and bound > best[0]:
                break
            pair = "ua" if first == "u" else "au"
            target = before + (pair * (m // 2 + 1))[:m]
            limit = best[0] if best is not None else 10**8
            table = fill(shape, target, limit)
            if table[0][0] <= limit:
                found = (table[0][0], trace(shape, target, table))
                best = found if best is None else min(best, found)
    return best


@lru_cache(maxsize=50_000)
def whole(shape: str) -> Answer:
    """Cost and audit of a conversation of up to SEGMENT turns."""
    return min(align(shape, START, START), align(shape, START, ASSISTANT))


@lru_cache(maxsize=20_000)
def piece(shape: str) -> tuple[tuple[tuple[int, int], Answer], ...]:
    found = ((route, align(shape, *route)) for route in ROUTES)
    return tuple((route, answer) for route, answer in found if answer is not None)


def joined(left: Pairs, right: Pairs) -> Pairs:
    """Answers of two neighbouring pieces together."""
    out: Pairs = {}
    for (a, b), (cost, audit) in left.items():
        for (c, d), (more, rest) in right.items():
            if b == c and ((a, d) not in out or cost + more <= out[a, d][0]):
                both = (cost + more, audit + rest)
                out[a, d] = min(out.get((a, d), both), both)
    return out


def answer_of(pairs: Pairs) -> Answer:
    """Cost and audit of a whole conversation."""
    return min(pairs[route] for route in ((START, START), (START, ASSISTANT)) if route in pairs)


class Pieces:
    """Answers of pieces as they come; neighbours of like size are joined, so texts are copied log n times."""

    def __init__(self):
        self.held: list[tuple[int, Pairs]] = []

    def add(self, pairs: Pairs) -> None:
        level = 0
        while self.held and self.held[-1][0] == level:
            pairs = joined(self.held.pop()[1], pairs)
            level += 1
        self.held.append((level, pairs))

    def result(self) -> Pairs:
        out: Pairs | None = None
        for _, pairs in reversed(self.held):
            out = pairs if out is None else joined(pairs, out)
        return out or {(k, k): (0, "") for k in range(4)}


class Run:
    """The turns of one conversation in one partition, met in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.first = self.last = self.head = self.tail = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.codes: list[str] = []
        self.pieces = Pieces()
        self.closed = 0

    def add(self, turn: int | None, initial: str, state: str, repeated: bool, copies: int) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.turns += 1
        if self.tail is None:
            self.head = initial
        elif self.tail + initial not in LAWFUL:
            self.illegal += 1
        self.tail = initial
        self.illegal += copies - 1
        if state == "blank":
            self.blank += copies
        else:
            self.duplicate += copies - (not repeated)
            self.truncated += not repeated and state == "truncated"
        code = "d" if repeated or state == "blank" else initial.upper() if state == "truncated" else initial
        self.codes += [code, *["d"] * (copies - 1)]
        while len(self.codes) > SEGMENT:
            self.close(SEGMENT)

    def close(self, size: int) -> None:
        shape, self.codes = "".join(self.codes[:size]), self.codes[size:]
        self.pieces.add(dict(piece(shape)))
        self.closed += 1

    def row(self, part: int, ended: bool) -> tuple:
        """`ended`: the conversation has no turns in other partitions."""
        if ended and not self.closed:
            answers = {(START, START): whole("".join(self.codes))}
        else:
            self.close(SEGMENT)
            answers = self.pieces.result()
            if ended:
                answers = {(START, START): answer_of(answers)}
        routes = list(answers)
        return (
            self.conv_id, part, ended, self.first, self.last, self.turns, self.blank, self.duplicate, self.truncated, self.illegal, self.head, self.tail,
            [4 * a + b for a, b in routes], [answers[r][0] for r in routes], [answers[r][1] for r in routes],
        )


RUNS = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("ended", pa.bool_()), ("first", pa.int64()), ("last", pa.int64()), ("turns", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()),
    ("truncated", pa.int64()), ("illegal", pa.int64()), ("head", pa.string()), ("tail", pa.string()), ("routes", pa.list_(pa.int32())), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())),
])
RUNS_DDL = "conv_id long, part int, ended boolean, first long, last long, turns long, blank long, duplicate long, truncated long, illegal long, head string, tail string, routes array<int>, costs array<long>, audits array<string>"
AUDITS_DDL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation of a partition in the order of turns."""
    part = TaskContext.get().partitionId()
    run, opened, out = None, False, []
    for batch in batches:
        for conv_id, *turn in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            if run is None or conv_id != run.conv_id:
                if run is not None:
                    out.append(run.row(part, opened))
                    opened = True
                run = Run(conv_id)
            run.add(*turn)
        if len(out) >= 1000:
            yield _batch(out, RUNS)
            out = []
    if run is not None:
        out.append(run.row(part, False))
    yield _batch(out, RUNS)


def fold(key: tuple, runs: pd.DataFrame) -> pd.DataFrame:
    """One row for a conversation that reaches into several partitions."""
    runs = runs.sort_values("part")
    pieces, totals = Pieces(), dict.fromkeys(("turns", "blank", "duplicate", "truncated", "illegal"), 0)
    first = last = tail = None
    for r in runs.itertuples():
        for name in totals:
            totals[name] += int(getattr(r, name))
        if not pd.isna(r.first):
            totals["turns"] -= last is not None and last == int(r.first)
            first = int(r.first) if first is None else first
            last = int(r.last)
        if tail is not None and tail + r.head not in LAWFUL:
            totals["illegal"] += 1
        tail = r.tail
        pieces.add({(k // 4, k % 4): (int(cost), audit) for k, cost, audit in zip(r.routes, r.costs, r.audits, strict=True)})
    cost, audit = answer_of(pieces.result())
    gaps = 0 if first is None else last - first + 1 - totals["turns"]
    return pd.DataFrame([(key[0], gaps, totals["blank"], totals["duplicate"], totals["truncated"], totals["illegal"], cost, audit)], columns=[c.split()[0] for c in AUDITS_DDL.split(", ")]).astype({"conv_id": "Int64"})


def _said(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without nulls in the last two, and what orders the rows of a turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"))
    said = F.unhex(F.sha2(F.encode(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), "utf-8"), 256))
    return rows.withColumns({"head": F.substring("text", 1, HEAD), "said": said})


def _state(text: Column) -> Column:
    body = F.rtrim(text, F.lit(BLANKS))
    return F.when(body == "", "blank").when(~F.right(body, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("whole")


def audits(turns: DataFrame) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    Turns are taken by turn, nulls first; rows of one turn by role, then text (its first HEAD
    characters, then a digest). A null role or text is one space; a null conv_id is a conversation
    of its own; rows that repeat are duplicates. gaps are turn numbers that lack between the least
    and the greatest, nulls apart. Other columns are not read; an empty table has no rows.
    """
    initial = F.substring("role", 1, 1)
    narrow = _said(turns).select("conv_id", "turn", "role", "head", "said", F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"), _state(F.col("text")).alias("state"))
    counted = narrow.groupBy(*narrow.columns).agg(F.count(F.lit(1)).alias("copies"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    firsts = counted.groupBy(F.col("conv_id").alias("_conv"), F.col("said").alias("_said")).agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_places")).filter("_places > 1")
    marked = counted.join(firsts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("said") == F.col("_said")), "left")
    repeated = F.coalesce(place > F.col("_first"), F.lit(False))
    order = ["conv_id", "turn", "role", "head"]
    rows = marked.withColumn("repeated", repeated).repartitionByRange(*order).sortWithinPartitions(*order, "said")
    runs = stored(rows.select("conv_id", "turn", "initial", "state", "repeated", "copies").mapInArrow(summed, RUNS_DDL))
    gaps = F.when(F.col("first").isNull(), F.lit(0)).otherwise(F.col("last") - F.col("first") + 1 - F.col("turns"))
    done = runs.filter("ended").select("conv_id", gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("costs")[0].alias("cost"), F.col("audits")[0].alias("audit"))
    return done.unionByName(runs.filter("NOT ended").groupBy("conv_id").applyInPandas(fold, AUDITS_DDL))


TURNS = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def replay(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired turns; each conversation's audit comes before its turns."""
    conv_id, audit, at, place, expected = None, None, 0, 0, "u"
    out: list[tuple] = []

    def inserts() -> None:
        nonlocal at, place, expected
        while audit is not None and at < len(audit) and audit[at] == "I":
            out.append((conv_id, place, "I", ROLES[expected], ""))
            at, place, expected = at + 1, place + 1, "a" if expected == "u" else "u"

    for batch in batches:
        for conv, kind, found, role, text in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if kind == 0:
                inserts()
                conv_id, audit, at, place, expected = conv, found, 0, 0, "u"
                continue
            inserts()
            edit, at = audit[at], at + 1
            if edit == "D":
                continue
            if edit == "R":
                role = ROLES[expected]
            out.append((conv_id, place, edit, role, text))
            place += 1
            expected = "a" if role[:1] == "u" else "u"
        yield _batch(out, TURNS)
        out.clear()
    inserts()
    yield _batch(out, TURNS)


def repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, place, edit (K, R or I), role, text of every turn after the edits of `found` (from `audits`).

    Turns of one conversation follow each other in one partition. They pass through it as a
    stream, so only the audit is held; a conversation without turns left has no rows.
    """
    said = _said(turns).select("conv_id", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("audit"), "turn", "role", "text", "head", "said")
    heads = found.select("conv_id", F.lit(0).alias("kind"), "audit")
    rows = heads.unionByName(said, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "head", "said")
    return rows.select("conv_id", "kind", "audit", "role", "text").mapInArrow(replay, "conv_id long, place long, edit string, role string, text string")


def digests(fixed: DataFrame) -> DataFrame:
    """conv_id, sha256 of `role:text` of the repaired turns, newline-joined, taken as they stream by."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("sha256", pa.string())])
        current, started, state, out = None, False, None, []
        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if not started or conv_id != current:
                    if started:
                        out.append((current, state.hexdigest()))
                    current, started, state = conv_id, True, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode("utf-8", "replace"))
            yield _batch(out, schema)
            out = []
        if started:
            out.append((current, state.hexdigest()))
        yield _batch(out, schema)

    return fixed.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, sha256 string")
