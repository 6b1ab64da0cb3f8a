"""Repair of conversations whose turns are missing, blank, repeated, cut off or under the wrong role.

A repaired conversation is empty, or an optional system turn and then pairs of user and assistant.  Rows are kept
(cost 0), reroled to user or assistant (1) or deleted (2; always where blank or repeated), and empty turns are inserted (5);
a truncated row that isn't deleted costs 5 more.  The cheapest edits are found by a dynamic programme over the retained
rows: between two of them lies a gap of deleted rows, priced by the difference of prefix sums of deletions, so each
role (none yet, system, user, assistant) needs only a running minimum over the rows retained with it; the pair of
roles at the gap's ends says how many turns to insert.  Of edits of equal cost the one with the least string of initials
(D, I, K, R in ASCII's order) wins.  Strings of two roles are compared by their ranks after every row, which follow from the
ranks before it and one token, so a row costs the same however long its conversation is.

A conversation's rows are ordered by turn (nulls first), then role, then text, all after damage; exact repetitions are
next to each other.  Rows are read in that order as a stream.  A conversation holds one digest for each of the four roles and a byte
of back-pointer for each row and role, never its texts: its audit has as many characters, and its digest depends on
the order, so this is the one part that isn't divided.  Null ids form one conversation; null roles and texts count as one space, which
no role begins with and which is blank; very long texts are digested as they come; an empty table gives an empty
result; other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
ROLES = {"s": "system", "u": "user", "a": "assistant"}
#: Roles that turns inserted between a retained one (or the start) and the next one (or the end) have.
BETWEEN = {("", "s"): "", ("", "u"): "", ("", "a"): "u", ("s", "u"): "", ("s", "a"): "u", ("u", "u"): "a", ("u", "a"): "", ("a", "u"): "", ("a", "a"): "u"}
AT_END = {"": "", "s": "ua", "u": "a", "a": ""}
STATES = "sua"  # and "", before the first retained row
TOKENS = ["D", "IK", "IR", "K", "R"]  # in the order of their strings
LEGAL = {"su", "ua", "au"}
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class Repair:
    """The cheapest repair of one conversation whose rows come in order."""

    def __init__(self):
        self.gone = 0  # what deleting all rows so far would cost
        self.base = {"": 0}  # by role of the last retained row: cost, less ``gone`` at that row
        self.rank = {"": 0}
        self.digest = {"": (hashlib.sha256(), False)}
        self.back: dict[str, bytearray] = {p: bytearray() for p in ("", *STATES)}

    def _written(self, start: tuple, turns: list[tuple[str, str]]) -> tuple:
        if not turns:
            return start
        digest, begun = start[0].copy(), start[1]
        for role, text in turns:
            digest.update((("\n" if begun else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            begun = True
        return digest, begun

    def add(self, role: str, text: str, deleted: bool, truncated: bool) -> None:
        """One row; ``deleted`` where it may not stay."""
        before = self.gone
        self.gone += DELETE
        chosen = {p: (cost, rank, 0, p) for p, cost in self.base.items() if (rank := self.rank[p]) >= 0}
        if not deleted:
            own = role[:1]
            for q in STATES:
                if q != own and q == "s":
                    continue
                kept, price = q == own, (0 if q == own else REROLE) + TRUNCATED * truncated + before - self.gone
                for p, cost in self.base.items():
                    if (p, q) in BETWEEN:
                        inserted = len(BETWEEN[p, q])
                        token = (1 if inserted else 3) + (not kept)
                        new = (cost + price + INSERT * inserted, self.rank[p], token, p)
                        if q not in chosen or new < chosen[q]:
                            chosen[q] = new
        order = {key: n for n, key in enumerate(sorted({c[1:3] for c in chosen.values()}))}
        digest = {}
        for q, (_, _, token, p) in chosen.items():
            if token:
                name = role if TOKENS[token][-1] == "K" else ROLES[q]
                digest[q] = self._written(self.digest[p], [*((ROLES[r], "") for r in BETWEEN[p, q]), (name, text)])
            else:
                digest[q] = self.digest[p]
        for q in self.back:
            self.back[q].append((["", *STATES].index(chosen[q][3]) * 8 + chosen[q][2]) if q in chosen else 255)
        self.base = {q: c[0] for q, c in chosen.items()}
        self.rank = {q: order[c[1:3]] for q, c in chosen.items()}
        self.digest = digest

    def finish(self) -> tuple[int, str, str]:
        """Cost, audit and SHA-256 of the repaired conversation."""
        cost, _, last = min((cost + self.gone + INSERT * len(AT_END[p]), self.rank[p], p) for p, cost in self.base.items())
        digest, _ = self._written(self.digest[last], [(ROLES[r], "") for r in AT_END[last]])
        audit, at = ["I" * len(AT_END[last])], last
        for n in range(len(self.back[""]) - 1, -1, -1):
            code = self.back[at][n]
            audit.append(TOKENS[code % 8])
            at = ("", *STATES)[code // 8]
        return cost, "".join(reversed(audit)), digest.hexdigest()


class Conversation:
    """What is counted over one conversation's rows, beside its repair."""

    def __init__(self, conv_id):
        self.conv_id, self.repair, self.last = conv_id, Repair(), None
        self.count = dict.fromkeys(COUNTS, 0)
        self.turns, self.first_turn, self.turn = 0, None, None

    def add(self, turn: int | None, role: str, text: str, times: int, seen: bool) -> None:
        if times and turn is not None and turn != self.turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.turn = turn
        end = text.rstrip(SPACE)[-1:]
        for copy in range(times):
            fault = "blank" if not end else "duplicate" if seen or copy else "truncated" if end not in ".!?" else ""
            if fault:
                self.count[fault] += 1
            if self.last is not None and self.last + role[:1] not in LEGAL:
                self.count["illegal"] += 1
            self.last = role[:1]
            self.repair.add(role, text, fault in ("blank", "duplicate"), fault == "truncated")

    def finish(self) -> tuple:
        if self.turns:
            self.count["gaps"] = self.turn - self.first_turn + 1 - self.turns
        self.count["cost"], audit, digest = self.repair.finish()
        return self.conv_id, *(self.count[c] for c in COUNTS), audit, digest


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and how often the row stands there (0 for a dropped one): faults by a hash of id and turn."""
    word = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(word("text"), "[.!?]", "")).otherwise(word("text"))
    rows = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(kind == 4, F.lit("user")).otherwise(word("role")).alias("role"), text.alias("text"),
        F.when(kind == 0, F.lit(0)).when(kind == 3, F.lit(2)).otherwise(F.lit(1)).alias("times"),
    )
    dropped: Column = F.col("times") == 0
    return rows.withColumn("text", F.when(~dropped, F.col("text")).otherwise(F.lit(""))).withColumn("role", F.when(~dropped, F.col("role")).otherwise(F.lit("")))


def repair(rows: DataFrame) -> DataFrame:
    """One row for each conversation of (conv_id, turn, role, text, times): faults, and the cheapest repair."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    out = pa.schema([rows.select("conv_id").limit(0).toArrow().schema.field("conv_id"), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Conversation | None = None
        for b in batches:
            done = []
            for conv_id, turn, role, text, times, seen in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "times", "seen")), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.finish())
                    now = Conversation(conv_id)
                now.add(turn, role, text, times, seen)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*done, strict=True), out, strict=True)], schema=out)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(now.finish(), out, strict=True)], schema=out)

    earlier = F.row_number().over(Window.partitionBy("conv_id", "there", "role", "text").orderBy("turn")) > 1
    marked = rows.repartition("conv_id").withColumn("there", F.col("times") > 0).withColumn("seen", earlier & F.col("there"))
    ordered = marked.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "turn", "role", "text", "times", "seen")
    return ordered.mapInArrow(run, f"conv_id {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", audit string, repaired_sha256 string")


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """Damages the conversations and repairs them: one row for each conversation of the table."""
    return repair(damage(conversations))
