"""Repair of conversations by error-correcting Earley parsing.

A repaired conversation has the role initials `(s?(ua)+)?`. The weighted grammar is left-recursive, so that a chart has a
few items a row; its error productions delete a row (2), give it another role (1) or insert an empty row (5), and a
truncated row that stays costs 5. Chart items keep the least (cost, audit) from their origin to their place, where the
audit is the edits' initials (K, R, D, I); of equal costs the audit that comes first in ASCII wins.

Scale: the parse sees a few bytes a row. Rows that are equal in all are counted first; then rows are dealt out by ranges
of (conversation, turn, role, digest), so that a conversation of any length is parsed in pieces. A piece that may go on
in another task is parsed from each nonterminal that may stand before it, in segments of 64 rows whose tables of least
(cost, audit) are multiplied in a tree. In the last step a conversation's pieces come first and its rows after them, as
one sorted stream: a digest over a conversation is sequential by its definition, but nothing of it is held but the audit.

Odd rows: null ids, turns, roles and texts read as one space where they make text (`id:turn`, role, text); a null id is a
conversation of its own, and null turns come first and count for no gap. Rows of one turn follow each other by role, then
by the text's SHA-256. Repeated rows are duplicates. A role of another initial, an empty one too, can only be reroled or
deleted. Conversations that the damage leaves without rows give zeros, an empty audit and the digest of the empty text.
An empty table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: White space of the contract, and what ends a whole sentence. Fixed values.
SPACES = " \t\n\x0b\x0c\r"
STOPS = (".", "!", "?")
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
#: What a conversation is after its rows so far; a repaired one ends in Empty or Answered.
STATES = ("Empty", "Opened", "Asked", "Answered")
ROLES = {"u": "user", "a": "assistant"}
#: Rules by left side. Terminals are an edit and the role that it gives.
GRAMMAR: dict[str, tuple[tuple[str, ...], ...]] = {
    "Empty": (("Empty", "Deleted"),),
    "Opened": (("Empty", "System"), ("Opened", "Deleted")),
    "Asked": (("Empty", "User"), ("Opened", "User"), ("Answered", "User"), ("Asked", "Deleted")),
    "Answered": (("Asked", "Assistant"), ("Answered", "Deleted")),
    "System": (("keep s",),),
    "User": (("keep u",), ("rerole u",), ("insert u",)),
    "Assistant": (("keep a",), ("rerole a",), ("insert a",)),
    "Deleted": (("delete",),),
}
#: Rows of a segment.
SEGMENT = 64
#: A row that must go, whatever its role.
GONE = "x"
Best = tuple[int, str]


def symbol(role: str, gone: bool, truncated: bool) -> str:
    """All that the grammar sees of a row: its role's initial (o: another one), in upper case if it is truncated."""
    if gone:
        return GONE
    initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return initial.upper() if truncated else initial


def edit(terminal: str, row: str) -> Best | None:
    """Cost and initial of an edit of a row; None where it can't be done."""
    kind, _, role = terminal.partition(" ")
    if kind == "delete":
        return DELETE, "D"
    if row == GONE or kind == "insert":
        return None
    kept = TRUNCATED if row.isupper() else 0
    if kind == "keep":
        return (kept, "K") if row.lower() == role else None
    return REROLE + kept, "R"


@lru_cache(1 << 14)
def parse(rows: str, start: str = "Empty") -> dict[str, Best]:
    """Least (cost, audit) of each state after the rows, when `start` is the state before them."""
    chart: list[dict] = []
    scanned: list[tuple[Best, tuple]] = [((0, ""), (state, rule, 0, 0)) for state in STATES for rule in GRAMMAR[state]] + [((0, ""), (start, (), 0, 0))]
    for place in range(len(rows) + 1):
        items: dict[tuple, Best] = {}
        waiting: dict[str, list[tuple]] = {}
        empty: dict[str, Best] = {}  # what was completed without a row
        chart.append(waiting)
        agenda: list[tuple[Best, tuple]] = []
        for entry in scanned:
            heappush(agenda, entry)
        scanned = []

        def advance(item: tuple, value: Best, by: Best, agenda: list = agenda) -> None:
            left, rule, dot, origin = item
            heappush(agenda, ((value[0] + by[0], value[1] + by[1]), (left, rule, dot + 1, origin)))

        while agenda:
            value, item = heappop(agenda)
            if item in items and items[item] <= value:
                continue
            items[item] = value
            left, rule, dot, origin = item
            if dot == len(rule):  # complete
                if origin == place:
                    empty[left] = value
                for other, known in (chart[origin].get(left, ()) if origin < place else [(i, items[i]) for i in waiting.get(left, ())]):
                    advance(other, known, value)
                continue
            after = rule[dot]
            if after in GRAMMAR:  # predict
                known = waiting.setdefault(after, [])
                if item not in known:
                    known.append(item)
                if after not in STATES:
                    for more in GRAMMAR[after]:
                        heappush(agenda, ((0, ""), (after, more, 0, place)))
                if after in empty:
                    advance(item, value, empty[after])
            elif after.startswith("insert"):
                advance(item, value, (INSERT, "I"))
            elif place < len(rows) and (done := edit(after, rows[place])):  # scan
                scanned.append(((value[0] + done[0], value[1] + done[1]), (left, rule, dot + 1, origin)))
        chart[place] = {symbol: [(i, items[i]) for i in found] for symbol, found in waiting.items()}
    return {left: value for (left, rule, dot, origin), value in sorted(items.items(), key=lambda x: x[1], reverse=True) if left in STATES and dot == len(rule) and origin == 0}


def joined(a: dict[str, dict[str, Best]], b: dict[str, dict[str, Best]]) -> dict[str, dict[str, Best]]:
    """Least (cost, audit) over two parts, for each state before them and each after them. Of one state before and one
    after, no audit begins another of the same cost, so that the least of a whole is made of the least of its parts."""
    out: dict[str, dict[str, Best]] = {}
    for start, ends in a.items():
        best: dict[str, Best] = {}
        for middle, (cost, audit) in ends.items():
            for end, (more, rest) in b[middle].items():
                if end not in best or cost + more < best[end][0] or cost + more == best[end][0] and audit + rest < best[end][1]:
                    best[end] = cost + more, audit + rest
        out[start] = best
    return out


def segments(runs: Iterable[tuple[str, int]]) -> Iterator[str | int]:
    """Strings of SEGMENT rows at most, and the lengths of long runs of rows that must go."""
    held = ""
    for row, n in runs:
        if n > SEGMENT and row == GONE:
            yield held
            yield n
            held = ""
            continue
        held += row * n
        while len(held) >= SEGMENT:
            yield held[:SEGMENT]
            held = held[SEGMENT:]
    yield held


def table_of(runs: list[tuple[str, int]], starts: tuple[str, ...] = STATES) -> dict[str, dict[str, Best]]:
    """Least (cost, audit) of a piece by the state before it and the state after it."""
    parts = [s for s in segments(runs) if s != ""] or [""]
    if len(parts) == 1 and isinstance(parts[0], str):
        return {s: parse(parts[0], s) for s in starts}
    tables = [{s: {s: (DELETE * p, "D" * p)} for s in STATES} if isinstance(p, int) else {s: parse(p, s) for s in STATES} for p in parts]
    while len(tables) > 1:
        tables = [joined(*tables[i : i + 2]) if i + 1 < len(tables) else tables[i] for i in range(0, len(tables), 2)]
    return {s: tables[0][s] for s in starts}


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): the contract's damage; rows that it drops have 0 copies."""
    spoken = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spoken("conv_id"), F.lit(":"), spoken("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(spoken("text"), "".join(STOPS), "")).otherwise(spoken("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(spoken("role"))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"))


ORDER = ("conv_id", "turn", "role", "digest")
PIECE = (
    "conv_id {id}, part int, lo {turn}, hi {turn}, turns long, first_turn {turn}, last_turn {turn}, blank long, duplicate long, truncated long, illegal long, first_role string, last_role string, "
    "ends array<struct<start: string, end: string, cost: long, audit: string>>"
)


def marked(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, copies, fault, first): equal rows counted, and whether their first one is the first
    of its role and text in the conversation. Both counts combine before their shuffle; the join back is an equi join
    whose hot keys Spark can split."""
    trimmed = F.rtrim("text", F.lit(SPACES))
    fault = F.when(trimmed == "", "blank").when(~F.right(trimmed, F.lit(1)).isin(*STOPS), "truncated").otherwise("none")
    digest = F.unhex(F.sha2("text", 256))
    equal = rows.select("conv_id", "turn", "role", digest.alias("digest"), fault.alias("fault"), "copies").groupBy("conv_id", "turn", "role", "digest", "fault").agg(F.sum("copies").alias("copies"))
    earliest = F.min(F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn")))
    seen = equal.filter("copies > 0 AND fault <> 'blank'").groupBy(F.col("conv_id").alias("_id"), F.col("role").alias("_role"), F.col("digest").alias("_digest")).agg(earliest.alias("_earliest"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    same = F.col("conv_id").eqNullSafe(F.col("_id")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    first = F.col("_n").isNull() | F.col("turn").eqNullSafe(F.col("_earliest.turn"))
    return equal.join(seen, same, "left").select("conv_id", "turn", "role", "digest", "copies", "fault", first.alias("first"))


class Piece:
    """A conversation's rows in one range, as they come in order."""

    def __init__(self, conv_id):
        self.conv_id, self.lo, self.hi, self.turns, self.turn_at = conv_id, None, None, 0, [None, None]
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.roles, self.runs = 0, [None, None], []

    def add(self, turn, role: str, copies: int, fault: str, first: bool) -> None:
        if not copies:
            return
        if turn is not None and turn != self.turn_at[1]:
            self.turns += 1
            self.lo = turn if self.lo is None else min(self.lo, turn)
            self.hi = turn if self.hi is None else max(self.hi, turn)
            self.turn_at = [turn if self.turn_at[0] is None else self.turn_at[0], turn]
        initial = role[:1]
        self.illegal += copies - 1 + (self.roles[1] is not None and self.roles[1] + initial not in ("su", "ua", "au"))
        self.roles = [initial if self.roles[0] is None else self.roles[0], initial]
        again = copies
        if fault == "blank":
            self.faults["blank"] += copies
        else:
            again -= first
            self.faults["duplicate"] += again
            if first:
                self.faults["truncated"] += fault == "truncated"
                self.runs.append((symbol(role, False, fault == "truncated"), 1))
        if again:
            self.runs.append((GONE, again))

    def row(self, part: int, whole: bool) -> dict:
        ends = table_of(self.runs, ("Empty",) if whole else STATES)
        listed = [{"start": s, "end": e, "cost": cost, "audit": audit} for s, found in ends.items() for e, (cost, audit) in found.items()]
        turns = {"lo": self.lo, "hi": self.hi, "turns": self.turns, "first_turn": self.turn_at[0], "last_turn": self.turn_at[1]}
        return {"conv_id": self.conv_id, "part": part, **turns, **self.faults, "illegal": self.illegal, "first_role": self.roles[0], "last_role": self.roles[1], "ends": listed}


def _batches(rows: Iterable[dict], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def pieces(rows: DataFrame) -> DataFrame:
    """A row for each conversation and range that holds rows of it. Only the first and the last conversation of a range
    may have rows elsewhere, and are parsed from every state."""
    kinds = dict(rows.dtypes)
    ddl = PIECE.format(id=kinds["conv_id"], turn=kinds["turn"])
    schema = _arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def parsed() -> Iterator[dict]:
            held, first = None, True
            for batch in batches:
                for conv_id, turn, role, _, copies, fault, is_first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if held is not None and held.conv_id != conv_id:
                        yield held.row(part, not first)
                        held, first = None, False
                    held = held or Piece(conv_id)
                    held.add(turn, role, copies, fault, is_first)
            if held is not None:
                yield held.row(part, False)

        yield from _batches(parsed(), schema)

    return marked(rows).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).mapInArrow(run, ddl)


class Whole:
    """A conversation put together from its pieces, and then repaired as its rows come."""

    def __init__(self, conv_id):
        self.conv_id, self.sums, self.gap = conv_id, dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0), [None, None, 0]
        self.turn = self.role = self.edits = None
        self.best: dict[str, Best] = {"Empty": (0, "")}
        self.hash, self.state, self.place = hashlib.sha256(), "Empty", 0

    def add_piece(self, p: dict) -> None:
        for k in self.sums:
            self.sums[k] += p[k]
        if p["first_role"] is not None:
            self.sums["illegal"] += self.role is not None and self.role + p["first_role"] not in ("su", "ua", "au")
            self.role = p["last_role"]
        if p["lo"] is not None:
            self.gap = [p["lo"] if self.gap[0] is None else self.gap[0], p["hi"], self.gap[2] + p["turns"] - (self.turn == p["first_turn"])]
            self.turn = p["last_turn"]
        ends: dict[str, dict[str, Best]] = {}
        for e in p["ends"]:
            ends.setdefault(e["start"], {})[e["end"]] = e["cost"], e["audit"]
        self.best = joined({"": self.best}, ends)[""]

    def chosen(self) -> Best:
        if self.edits is None:
            self.edits = min(self.best[s] for s in ("Empty", "Answered") if s in self.best)
            self.best = {}
        return self.edits

    def _out(self, line: str, role: str) -> None:
        if self.state != "Empty":
            self.hash.update(b"\n")
        self.hash.update(line.encode("utf-8", "surrogatepass"))
        self.state = {"s": "Opened", "u": "Asked", "a": "Answered"}[role]

    def add_row(self, role: str | None, text: str) -> None:
        """The next row of the damaged conversation; None for its end."""
        audit = self.chosen()[1]
        while self.place < len(audit):
            done, wanted = audit[self.place], "a" if self.state == "Asked" else "u"
            if done != "I" and role is None:
                break
            self.place += 1
            if done == "I":
                self._out(ROLES[wanted] + ":", wanted)
                continue
            if done == "K":
                self._out(f"{role}:{text}", role[:1])
            elif done == "R":
                self._out(f"{ROLES[wanted]}:{text}", wanted)
            return

    def row(self) -> dict:
        cost, audit = self.chosen()
        self.add_row(None, "")
        lo, hi, turns = self.gap
        return {"conv_id": self.conv_id, "gaps": 0 if lo is None else hi - lo + 1 - turns, **self.sums, "cost": cost, "audit": audit, "repaired_sha256": self.hash.hexdigest()}


def repaired(rows: DataFrame) -> DataFrame:
    """Repair of rows (conv_id, turn, role, text, copies): gaps in the turns, counts of faults, the cheapest edits and a
    digest of the conversation that they make."""
    small_batches(rows.sparkSession)
    kinds = dict(rows.dtypes)
    ddl = f"conv_id {kinds['conv_id']}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    schema = _arrow(ddl)
    kept = rows.filter("copies > 0").select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), "text", "copies")
    parsed = pieces(rows)
    stream = parsed.select("conv_id", F.struct(*parsed.columns[1:]).alias("piece")).unionByName(kept, allowMissingColumns=True)
    order: list[Column | str] = ["conv_id", F.col("piece").isNull(), "piece.part", "turn", "role", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results() -> Iterator[dict]:
            held = None
            for batch in batches:
                for conv_id, piece, _, role, _, text, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if held is not None and held.conv_id != conv_id:
                        yield held.row()
                        held = None
                    held = held or Whole(conv_id)
                    if piece is not None:
                        held.add_piece(piece)
                        continue
                    for _ in range(copies):
                        held.add_row(role, text)
            if held is not None:
                yield held.row()

        yield from _batches(results(), schema)

    return stream.select("conv_id", "piece", "turn", "role", "digest", "text", "copies").repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, ddl)
