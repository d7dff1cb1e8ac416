"""Cheapest repair of conversations by survivor-coalescence Viterbi.

A repaired conversation is empty, or an optional system turn followed by pairs of a
user and an assistant turn. Rows are kept, given another role or deleted, and empty
turns inserted; the cheapest edits count, and of equally cheap ones those whose
letters come first in ASCII order.

The rows of a conversation are read once, in order. For each state of the pattern
the cheapest edits that lead there survive; all survivors hang in one tree of back
pointers whose nodes count their references. A node that no survivor needs any more
goes; as soon as all survivors share an ancestor, the edits up to it are certain and
are given out. What stays in memory is the part that is is open. Candidates of the
same cost in the same state are compared by their whole open suffixes. No suffix has
to be walked for that: those of two survivors differ (their letters determine the
state they lead to) and neither begins the other (all end with the same row), so the
order of the survivors, kept from row to row, decides, and below one survivor the new
letters do. Survivors that another one beats whatever follows are dropped, which lets
the rest meet. A run of deletions at an open end is one node with a count.

How long edits stay open depends on the rows: in a conversation of one speaker only,
whether the first row stays depends on the last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Costs of the edits; a truncated row that is not deleted costs its part besides.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

# States of the pattern: nothing yet, after system, after user, after assistant.
NONE, SYSTEM, USER, ASSISTANT = range(4)
_TURN = {USER: "user", ASSISTANT: "assistant"}
#: The turns to insert on the way from one state to another.
_INSERTS = {
    NONE: [(NONE, ()), (USER, (USER,)), (ASSISTANT, (USER, ASSISTANT))],
    SYSTEM: [(SYSTEM, ()), (USER, (USER,)), (ASSISTANT, (USER, ASSISTANT))],
    USER: [(USER, ()), (ASSISTANT, (ASSISTANT,))],
    ASSISTANT: [(ASSISTANT, ()), (USER, (USER,))],
}
#: The state that a turn of this initial leads to.
_KEPT = {
    (NONE, "s"): SYSTEM,
    **{(state, "u"): USER for state in (NONE, SYSTEM, ASSISTANT)},
    (USER, "a"): ASSISTANT,
}
#: The other role that fits a state.
_FITS = {NONE: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
#: (state, better, by): a survivor is of no use where the better one costs less by
#: more than this, because that one can be continued in the same way for as much.
_BEATEN = [
    (NONE, ASSISTANT, DELETE),
    (NONE, USER, INSERT + DELETE),
    (SYSTEM, NONE, 0),
    (SYSTEM, ASSISTANT, 0),
    (SYSTEM, USER, INSERT),
    (USER, NONE, INSERT),
    (USER, SYSTEM, INSERT),
    (USER, ASSISTANT, INSERT),
    (ASSISTANT, NONE, 0),
    (ASSISTANT, USER, INSERT),
]

_BLANKS = " \t\n\x0b\x0c\r"


class _Edit:
    """A node of the tree: an edit, or a run of deletions."""

    __slots__ = ("parent", "letter", "count", "role", "row", "held", "kids")

    def __init__(self, parent: _Edit | None, letter: str, role: str | None = None, row: tuple | None = None):
        self.parent, self.letter, self.count, self.role, self.row = parent, letter, 1, role, row
        self.held, self.kids = 0, set()
        if parent:
            parent.kids.add(self)


class Trellis:
    """The survivors of one conversation; ``emit(letter, role, row)`` gets the
    certain edits, in order."""

    def __init__(self, emit: Callable[[str, str | None, tuple | None], None]):
        self.emit = emit
        self.root = _Edit(None, "")
        self.root.held = 1
        # By state, in the order of the survivors' open suffixes.
        self.tips, self.costs = {NONE: self.root}, {NONE: 0}

    def _release(self, node: _Edit) -> None:
        while node is not self.root and not node.held and not node.kids:
            node.parent.kids.discard(node)
            node = node.parent

    def step(self, role: str, row: tuple, truncated: bool, must_go: bool) -> None:
        """Read one row."""
        # To each state: (cost, rank of the survivor it goes on from, letters, ...).
        best: dict[int, tuple] = {}
        for rank, (state, tip) in enumerate(self.tips.items()):
            cost = self.costs[state]
            found = [(state, (cost + DELETE, rank, "D", tip, (), None))]
            if not must_go:
                extra = TRUNCATED if truncated else 0
                for at, inserted in _INSERTS[state]:
                    here = cost + INSERT * len(inserted) + extra
                    kept = _KEPT.get((at, role[:1]))
                    letters = "I" * len(inserted)
                    to = _FITS[at]
                    if kept is not None:
                        found.append((kept, (here, rank, letters + "K", tip, inserted, role)))
                    if kept != to:
                        found.append((to, (here + REROLE, rank, letters + "R", tip, inserted, _TURN[to])))
            for to, candidate in found:
                if to not in best or candidate[:3] < best[to][:3]:
                    best[to] = candidate
        for state, better, by in _BEATEN:
            if state in best and better in best and best[better][0] + by < best[state][0]:
                del best[state]
        self._advance(best, row)

    def _advance(self, best: dict[int, tuple], row: tuple) -> None:
        old = self.tips
        tips = {}
        # Deletions come last: a run may only grow where nothing else hangs on it.
        for state, (_, _, letters, tip, inserted, role) in sorted(best.items(), key=lambda x: x[1][2] == "D"):
            if letters == "D" and tip.letter == "D" and not tip.kids and tip is not self.root:
                tip.count += 1
                tips[state] = tip
                continue
            node = tip
            for turn in inserted:
                node = _Edit(node, "I", _TURN[turn])
            tips[state] = _Edit(node, letters[-1], role, None if letters == "D" else row)
        for tip in old.values():
            tip.held -= 1
        for tip in tips.values():
            tip.held += 1
        for tip in old.values():
            self._release(tip)
        self.tips = {state: tips[state] for state in sorted(tips, key=lambda s: best[s][1:3])}
        self.costs = {state: c[0] for state, c in best.items()}
        self._coalesce()

    def _coalesce(self) -> None:
        """Give out the edits that all survivors share."""
        while not self.root.held and len(self.root.kids) == 1:
            node = self.root.kids.pop()
            for _ in range(node.count):
                self.emit(node.letter, node.role, node.row)
            node.parent, node.row = None, None
            self.root = node

    def finish(self) -> int:
        """End the conversation; give out what is open and return the cost."""
        best = None
        for rank, (state, tip) in enumerate(self.tips.items()):
            for at, inserted in _INSERTS[state]:
                if at in (NONE, ASSISTANT):
                    candidate = (self.costs[state] + INSERT * len(inserted), rank, "I" * len(inserted), tip, inserted)
                    best = candidate if best is None or candidate[:3] < best[:3] else best
        cost, _, _, tip, inserted = best
        path = []
        while tip is not self.root:
            path.append(tip)
            tip = tip.parent
        for node in reversed(path):
            for _ in range(node.count):
                self.emit(node.letter, node.role, node.row)
        for turn in inserted:
            self.emit("I", _TURN[turn], None)
        return cost


class _Conversation:
    """One conversation as it is read: counts, survivors, and what they give out."""

    def __init__(self, conv_id, edits: list | None):
        self.conv_id, self.edits = conv_id, edits
        self.blank = self.duplicate = self.truncated = self.illegal = self.place = 0
        self.least = self.most = self.last_turn = None
        self.turns = 0
        self.initial = None
        self.audit, self.digest = [], hashlib.sha256()
        self.trellis = Trellis(self._give)
        self.first = None

    def _give(self, letter: str, role: str | None, row: tuple | None) -> None:
        self.audit.append(letter)
        turn, text = row or (None, "")
        if letter != "D":
            self.digest.update(f"{chr(10) if self.place else ''}{role}:{text}".encode())
            self.place += 1
            if self.edits is not None:
                self.edits.append((self.conv_id, self.place, letter, turn, role, text))

    def marker(self, turn, role: str, digest: str) -> None:
        """The next row of this turn, role and text is the first of its role and text."""
        self.first = (turn, role, digest)

    def row(self, turn, role: str, text: str, digest: str) -> None:
        if turn is not None:
            self.least = turn if self.least is None else self.least
            self.turns += turn != self.last_turn
            self.most = self.last_turn = turn
        said = text.strip(_BLANKS)
        new = self.first == (turn, role, digest)
        self.first = None
        blank, duplicate = not said, bool(said) and not new
        truncated = bool(said) and new and said[-1] not in ".!?"
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]
        self.trellis.step(role, (turn, text), truncated, blank or duplicate)

    def report(self) -> tuple:
        cost = self.trellis.finish()
        gaps = self.most - self.least + 1 - self.turns if self.least is not None else 0
        faults = (self.blank, self.duplicate, self.truncated, self.illegal)
        return (self.conv_id, gaps, *faults, cost, "".join(self.audit), self.digest.hexdigest())


_ID, _FIRST, _ROW = range(3)
_REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
_EDITS = ["place", "edit", "turn", "role", "text"]


def _walked(schema: pa.Schema, with_edits: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, out, edits = None, [], [] if with_edits else None

        def filled() -> pa.RecordBatch:
            rows = edits if with_edits else out
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)
            rows.clear()
            return made

        for batch in batches:
            for conv_id, kind, turn, role, digest, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if current is None or current.conv_id != conv_id:
                    if current is not None:
                        out.append(current.report())
                    current = _Conversation(conv_id, edits)
                if kind == _FIRST:
                    current.marker(turn, role, digest)
                elif kind == _ROW:
                    current.row(turn, role, text, digest)
            yield filled()
        if current is not None:
            out.append(current.report())
        yield filled()

    return run


def _walk(rows: DataFrame, conversations: DataFrame | None, with_edits: bool) -> DataFrame:
    """The rows of each conversation in order, in one task each, through the trellis.

    Which row is the first of its role and text is found by an aggregation before;
    the answer travels as a row of its own that sorts right before the one it means.
    So no task remembers the texts of a conversation.
    """
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = rows.select("conv_id", F.lit(_ROW).alias("kind"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.sha2(text, 256).alias("digest"), text.alias("text"))
    rank = F.struct(F.col("turn").isNotNull().alias("timed"), "turn")
    firsts = rows.groupBy("conv_id", "role", "digest").agg(F.min(rank)["turn"].alias("turn"))
    none = F.lit(None).cast("string")
    firsts = firsts.select("conv_id", F.lit(_FIRST).alias("kind"), "turn", "role", "digest", none.alias("text"))
    every = rows.unionByName(firsts)
    if conversations is not None:
        ids = conversations.select("conv_id").distinct()
        every = every.unionByName(ids.select("conv_id", F.lit(_ID).alias("kind"), F.lit(None).cast("long").alias("turn"), none.alias("role"), none.alias("digest"), none.alias("text")))
    # Null sorts first, also the nulls of a conversation that is only named.
    ordered = every.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest", "kind")
    kind = rows.schema["conv_id"].dataType.simpleString()
    if with_edits:
        schema = f"conv_id {kind}, place long, edit string, turn long, role string, text string"
    else:
        schema = f"conv_id {kind}, {', '.join(f'{c} long' for c in _REPORT[:6])}, audit string, repaired_sha256 string"
    arrow = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = pa.schema([(c, arrow[t]) for c, t in (x.split() for x in schema.split(", "))])
    return ordered.mapInArrow(_walked(fields, with_edits), schema)


def audited(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """What is wrong with each conversation, the cheapest edits, and their digest.

    ``rows`` has conv_id, turn, role and text; other columns are ignored.
    ``conversations`` names, by conv_id, those to report although they have no rows.
    Returns one row per conversation: conv_id, gaps (turn numbers missing between
    the least and the most), blank, duplicate and truncated (rows by their first
    fault), illegal (neighbours whose roles do not follow each other), cost, audit
    (a letter for each edit: Keep, Rerole, Delete, Insert) and repaired_sha256 (of
    the repaired ``role:text`` lines).

    Rows are ordered by turn, those without one first; rows of one turn by role,
    then by digest of the text, so repeated rows stand beside each other. A null
    role or text is one space. Rows without conv_id are one conversation. One
    conversation is read by one task, as its digest must be, whatever its length;
    memory holds its open edits only. Reports of conversations without rows have
    zeros, no edits and the digest of nothing.
    """
    return _walk(rows, conversations, with_edits=False)


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 1), edit (K, R or I), turn
    (null where inserted), role and text. Deleted rows are left out; see
    :func:`audited` for the order of rows and for nulls."""
    return _walk(rows, None, with_edits=True)
