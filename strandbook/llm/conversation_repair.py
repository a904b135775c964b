"""Repair of conversation structure: the cheapest edits that make roles an optional system turn and pairs of user and assistant.

Each row is kept (0), given the role that is due (3) or deleted (4; blank rows and repeats must be), and an empty
turn can be inserted anywhere (3); a truncated row that stays costs 3 more. A Viterbi pass over a conversation's
rows in order holds at most four survivors, one per grammar state, as heads of a tree of backpointers with
reference counts. When all survivors share an ancestor, the edits up to it are final: they are given out and their
nodes are freed, so that memory holds unresolved edits only, however long the conversation is. Of equal cost,
the least string of edit letters wins: tied survivors are compared by their complete unresolved suffixes, whose order
is carried from row to row. Two paths that have read the same rows differ in length by inserted turns only;
so one is a prefix of the other only if it lacks inserts at the very end, which is looked up in the tree.

A survivor that another one beats whatever follows (BEHIND bounds how much it can still make good) is dropped,
which lets the rest coalesce.

Rows are ordered by turn (nulls first), then role, then text. Nulls of conv_id and turn are one space in the
checksum, those of role and text one space throughout; a null conv_id is a conversation of its own. Repeated rows
are duplicates. Rows of a conversation pass through one task, in order, as the digest of its repaired text asks for;
what was seen earlier is found by a salted join beforehand, so that no task holds a conversation.
"""

from __future__ import annotations

import hashlib
from functools import cmp_to_key

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANKS = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SALTS = 16
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a row of each initial.
KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: The role that is due in each state, and the state after it.
DUE = {START: ("user", USER), SYSTEM: ("user", USER), ASSISTANT: ("user", USER), USER: ("assistant", ASSISTANT)}
#: BEHIND[x][y]: what finishing from x can cost more than finishing from y, at most.
BEHIND = {START: {SYSTEM: 0, USER: 3, ASSISTANT: 0}, SYSTEM: {START: 6, USER: 3, ASSISTANT: 6}, USER: {START: 7, SYSTEM: 3, ASSISTANT: 3}, ASSISTANT: {START: 4, SYSTEM: 0, USER: 3}}


class Node:
    """An edit on a path; heads counts the survivors that end here, kids are the edits that follow."""

    __slots__ = ("parent", "letter", "role", "text", "kids", "heads")

    def __init__(self, parent, letter, role, text):
        self.parent, self.letter, self.role, self.text = parent, letter, role, text
        self.kids, self.heads = [], 0
        if parent is not None:
            parent.kids.append(self)


class Repairer:
    """Takes the rows of one conversation and calls emit(letter, role, text) for each edit as soon as it is final."""

    def __init__(self, emit):
        self.emit, self.root = emit, Node(None, "", None, None)
        self.survivors, self.rank = {START: (0, self.root)}, {START: 0}
        self.root.heads = 1
        self._step({START: [(0, START, "")]}, None, None)

    def take(self, role: str, text: str, deleted: bool, truncated: bool) -> None:
        """Relax all states over one row, then over inserted turns."""
        found: dict[int, list] = {}
        extra = TRUNCATED if truncated else 0
        for state, (cost, _) in self.survivors.items():
            found.setdefault(state, []).append((cost + DELETE, state, "D"))
            if not deleted:
                after = KEEP.get((state, role[:1]))
                if after is not None:
                    found.setdefault(after, []).append((cost + extra, state, "K"))
                found.setdefault(DUE[state][1], []).append((cost + REROLE + extra, state, "R"))
        self._step(found, role, text)

    def finish(self) -> int:
        """Give out what is left; returns the cost."""
        ends = [(self.survivors[s][0], s, "") for s in (START, ASSISTANT) if s in self.survivors]
        cost, state, _ = self._least(ends)
        for other in [s for s in self.survivors if s != state]:
            self._drop(self.survivors.pop(other)[1])
        self.survivors[state][1].heads -= 1
        self._settle()
        return cost

    def _inserted(self, short: int, long: int) -> str | None:
        """The inserts at the end of one survivor after which it is another one's path; None if it is no such path."""
        node, goal, letters = self.survivors[long][1], self.survivors[short][1], ""
        while node is not goal:
            if node.letter != "I":
                return None
            node, letters = node.parent, letters + "I"
        return letters

    def _compare(self, one, two) -> int:
        """Order of (cost, survivor, letters after it) by cost, then by the whole string of letters."""
        if one[0] != two[0]:
            return -1 if one[0] < two[0] else 1
        (_, x, w), (_, y, v) = one, two
        if x != y:
            more, less = self._inserted(x, y), self._inserted(y, x)
            if more is None and less is None:
                return -1 if self.rank[x] < self.rank[y] else 1
            v, w = (more or "") + v, (less or "") + w
        return (w > v) - (w < v)

    def _least(self, options):
        return min(options, key=cmp_to_key(self._compare)) if len(options) > 1 else options[0]

    def _step(self, found: dict, role: str | None, text: str | None) -> None:
        best = {state: self._least(options) for state, options in found.items()}
        for _ in range(2):
            for state, (cost, at, letters) in list(best.items()):
                after, option = DUE[state][1], (cost + INSERT, at, letters + "I")
                best[after] = self._least([best[after], option]) if after in best else option
        best = {y: b for y, b in best.items() if not any(x != y and a[0] + BEHIND[x][y] < b[0] for x, a in best.items())}
        # Of strings alone: the order in which later ties are decided.
        order = sorted(best, key=cmp_to_key(lambda x, y: self._compare((0, *best[x][1:]), (0, *best[y][1:]))))
        made, after = {}, {}
        for state, (cost, at, letters) in best.items():
            node, here = self.survivors[at][1], at
            for n, letter in enumerate(letters):
                key = (at, letters[: n + 1])
                if letter == "R" or letter == "I":
                    due, here = DUE[here]
                elif letter == "K":
                    due, here = role, KEEP[here, role[:1]]
                else:
                    due = role
                if key not in made:
                    made[key] = Node(node, letter, due, "" if letter == "I" else text)
                node = made[key]
            after[state] = (cost, node)
        for _, node in after.values():
            node.heads += 1
        old, self.survivors = self.survivors, after
        for _, node in old.values():
            self._drop(node)
        self.rank = {state: n for n, state in enumerate(order)}
        self._settle()

    def _drop(self, node: Node) -> None:
        """Release a survivor's head and every node that nothing refers to any more."""
        node.heads -= 1
        while node is not self.root and not node.heads and not node.kids:
            node.parent.kids.remove(node)
            node = node.parent

    def _settle(self) -> None:
        """Give out edits while all survivors lie below one child of the root."""
        while len(self.root.kids) == 1 and not self.root.heads:
            self.root = self.root.kids[0]
            self.root.parent = None
            self.emit(self.root.letter, self.root.role, self.root.text)
            self.root.letter, self.root.text, self.root.role = "", None, None


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows damaged by the checksum of conversation and turn; dropped rows have 0 copies."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    role = F.when(fate == 4, "user").otherwise(spaced("role"))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("copies"))


def marked(rows: DataFrame) -> DataFrame:
    """rows with blank, truncated, and again: whether an earlier turn of the conversation has the role and the text."""
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    rows = rows.withColumns({"blank": bare == "", "truncated": ~F.right(bare, F.lit(1)).isin(".", "!", "?"), "place": F.struct(F.col("turn").isNotNull().alias("known"), "turn"), "text_key": F.unhex(F.md5("text"))})
    # Only what stands in several turns can be a repeat; copies in one turn lie beside each other.
    seen = rows.filter("copies > 0 and not blank").groupBy("conv_id", "role", "text_key").agg(F.min("place").alias("first_place"), F.max("place").alias("last_place"))
    seen = seen.filter("first_place < last_place").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    seen = seen.select(*(F.col(c).alias(f"seen_{c}") for c in ("conv_id", "role", "text_key", "salt")), "first_place")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("turn"), F.lit(SALTS)).cast("int"))
    match = F.col("conv_id").eqNullSafe(F.col("seen_conv_id")) & (F.col("role") == F.col("seen_role")) & (F.col("text_key") == F.col("seen_text_key")) & (F.col("salt") == F.col("seen_salt"))
    rows = rows.join(seen, match, "left").withColumn("again", F.coalesce(F.col("place") > F.col("first_place"), F.lit(False)))
    return rows.select("conv_id", "turn", "role", "text", "copies", "blank", "truncated", "again")


class Audit:
    """What is told of one conversation."""

    def __init__(self, conv_id, given):
        self.conv_id, self.given, self.letters, self.digest, self.lines = conv_id, given, [], hashlib.sha256(), 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.rows = 0
        self.first = self.turn = self.before = None
        self.repairer = Repairer(self._edit)

    def _edit(self, letter: str, role: str, text: str) -> None:
        self.letters.append(letter)
        if letter != "D":
            self.digest.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            self.lines += 1
        if self.given is not None:
            self.given(self.conv_id, len(self.letters), letter, role, text)

    def take(self, turn, role, text, copies, blank, truncated, again) -> None:
        if copies and turn is not None and turn != self.turn:
            self.first, self.turn, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        for _ in range(copies):
            repeat = again or self.before == (turn, role, text)
            self.illegal += self.rows > 0 and self.before[1][:1] + role[:1] not in ("su", "ua", "au")
            self.rows, self.before = self.rows + 1, (turn, role, text)
            fault = "blank" if blank else "duplicate" if repeat else "truncated" if truncated else ""
            if fault:
                setattr(self, fault, getattr(self, fault) + 1)
            self.repairer.take(role, text, fault in ("blank", "duplicate"), fault == "truncated")

    def row(self) -> tuple:
        cost = self.repairer.finish()
        gaps = self.turn - self.first + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.letters), self.digest.hexdigest())


ROWS_A_BATCH = 4096


def _rows(batches):
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _audited(schema: T.StructType, edits: bool):
    """A function for mapInArrow over ordered rows: one row per conversation, or one per edit."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        out, held = [], None
        tell = (lambda *row: out.append(row)) if edits else None
        for conv_id, *row in _rows(batches):
            if held is None or held.conv_id != conv_id:
                if held is not None:
                    last = held.row()
                    if not edits:
                        out.append(last)
                held = Audit(conv_id, tell)
            held.take(*row)
            if len(out) >= ROWS_A_BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
                out.clear()
        if held is not None:
            last = held.row()
            if not edits:
                out.append(last)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return run


def _in_order(rows: DataFrame) -> DataFrame:
    return marked(rows).repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")


def audit(rows: DataFrame) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text, copies): faults, cost, the edits' letters and the digest of the repaired text.

    Rows of 0 copies only name their conversation.
    """
    longs = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    kinds = [("conv_id", rows.schema["conv_id"].dataType), *((n, T.LongType()) for n in longs), ("audit", T.StringType()), ("repaired_sha256", T.StringType())]
    schema = T.StructType([T.StructField(n, t) for n, t in kinds])
    return _in_order(rows).mapInArrow(_audited(schema, False), schema)


def repair(rows: DataFrame) -> DataFrame:
    """The edits themselves: conv_id, place (from 1), edit (K, R, D or I), role and text after it; a repaired conversation is its rows other than D."""
    kinds = [("conv_id", rows.schema["conv_id"].dataType), ("place", T.LongType()), ("edit", T.StringType()), ("role", T.StringType()), ("text", T.StringType())]
    schema = T.StructType([T.StructField(n, t) for n, t in kinds])
    return _in_order(rows).mapInArrow(_audited(schema, True), schema)
