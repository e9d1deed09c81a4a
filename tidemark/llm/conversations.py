"""Repair of conversation structure by a Viterbi search that emits what all survivors share.

A conversation's rows are edited at least cost until the initials of its roles read
(s?(ua)+)?: rows are kept, reroled or deleted, and empty ones inserted. The search goes through
the rows in turn order with one survivor for each state (nothing yet, system, user, assistant
last). Survivors are leaves of a tree of back-pointers with reference counts. A node that no
survivor needs is freed; once all survivors descend from one child of the root, that child's edit
is final, is emitted and becomes the root. So a task holds the unresolved rows alone, however long
the conversation. Where costs tie, the whole unresolved suffixes are compared: each edit is a
letter (D, I, K, R) and the least string wins. Two strings that tie never begin with one another,
since the longer would hold one insertion more at the same cost, so what is least now stays least.

Spark deals conversations out by id and sorts them by turn; Python sees one stream of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import table
from .words import small_batches

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
#: Costs of the edits, and of a truncated row that stays.
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED = 1
#: States by the initial of the last role given out; the role that follows each, and those a conversation may end in.
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
ENDS = ("", "a")
ROLE = {"u": "user", "a": "assistant"}


@dataclass(eq=False)
class Node:
    """An edit and the one before it; `users` counts the nodes and survivors that point here."""

    before: Node | None
    edit: str
    row: tuple[str, str] | None  # what the edit gives out
    depth: int
    users: int = 0
    after: list[Node] = field(default_factory=list)


class Repair:
    """The search through one conversation; emit(edit, row) is called for each edit once it is final."""

    def __init__(self, emit: Callable[[str, tuple[str, str] | None], None]):
        self.emit = emit
        self.root = Node(None, "", None, 0)
        self.survivors: dict[str, tuple[int, Node]] = {"": (0, self.root)}
        self.root.users = 1
        self.held = self.most_held = 1
        self.closed()

    def grown(self, before: Node, edit: str, row: tuple[str, str] | None) -> Node:
        node = Node(before, edit, row, before.depth + 1)
        before.users += 1
        before.after.append(node)
        self.held += 1
        self.most_held = max(self.most_held, self.held)
        return node

    def freed(self, node: Node) -> None:
        """Drops a survivor's hold of a node, and all nodes that nothing needs any more."""
        node.users -= 1
        while not node.users and node is not self.root:
            before = node.before
            before.after.remove(node)
            before.users -= 1
            self.held -= 1
            node = before

    def suffix(self, node: Node, edit: str, other: Node, other_edit: str) -> bool:
        """Whether node's edits and then edit are less than the other's: both unresolved suffixes, back to where they part."""
        x, y = [edit], [other_edit]
        while node is not other:
            if node.depth >= other.depth:
                x.append(node.edit)
                node = node.before
            else:
                y.append(other.edit)
                other = other.before
        return x[::-1] < y[::-1]

    def better(self, found: dict, state: str, cost: int, before: Node, edit: str, row: tuple[str, str] | None) -> None:
        """Offers a way to a state: the cheaper stays, of equal ones the least string. A way without an edit is the survivor `before` itself."""
        old = found.get(state)
        if old is None or cost < old[0] or cost == old[0] and self.suffix(before, edit, *(old[1:3] if old[2] else (old[1].before, old[1].edit))):
            found[state] = (cost, before, edit, row)

    def moved(self, found: dict) -> None:
        """Takes found ways as the new survivors; those of the old that are not named are dropped."""
        new = {}
        for state, (cost, before, edit, row) in found.items():
            node = before if not edit else self.grown(before, edit, row)
            node.users += 1
            new[state] = (cost, node)
        for _, node in self.survivors.values():
            self.freed(node)
        self.survivors = new

    def closed(self) -> None:
        """Insertions: at most two of use in a row, since a third gives the role of the first again."""
        for _ in range(2):
            found = {state: (cost, node, "", None) for state, (cost, node) in self.survivors.items()}
            for state, (cost, node) in self.survivors.items():
                to = NEXT[state]
                self.better(found, to, cost + COST[INSERT], node, INSERT, (ROLE[to], ""))
            self.moved(found)

    def step(self, role: str, text: str, fault: str) -> None:
        """The next row; fault is blank, duplicate, truncated or empty."""
        found: dict = {}
        stays = TRUNCATED if fault == "truncated" else 0
        for state, (cost, node) in self.survivors.items():
            self.better(found, state, cost + COST[DELETE], node, DELETE, None)
            if fault in ("blank", "duplicate"):
                continue
            to, initial = NEXT[state], role[:1]
            if initial == to or initial == "s" and not state:
                self.better(found, initial, cost + COST[KEEP] + stays, node, KEEP, (role, text))
            self.better(found, to, cost + COST[REROLE] + stays, node, REROLE, (ROLE[to], text))
        self.moved(found)
        self.closed()
        self.pruned()
        self.coalesced()

    def pruned(self) -> None:
        """Drops survivors that cost more than doing the same after an assistant's row would: all that can follow a system row, and all that can follow nothing but for a system row, which is deleted instead."""
        if "a" in self.survivors:
            cost = self.survivors["a"][0]
            for state, more in (("s", 0), ("", COST[DELETE])):
                if state in self.survivors and self.survivors[state][0] > cost + more:
                    self.freed(self.survivors.pop(state)[1])

    def coalesced(self) -> None:
        """Emits the edits that all survivors share."""
        while self.root.users == 1 and self.root.after:
            (self.root,) = self.root.after
            self.root.before.after.clear()
            self.root.before = None
            self.held -= 1
            self.emit(self.root.edit, self.root.row)

    def finished(self) -> int:
        """Settles the end, emits the rest and returns the cost."""
        ends = [self.survivors[s] for s in ENDS if s in self.survivors]
        cost = min(c for c, _ in ends)
        node, *tied = [n for c, n in ends if c == cost]
        for other in tied:
            if self.suffix(other.before, other.edit, node.before, node.edit):
                node = other
        rest = []
        while node is not self.root:
            rest.append(node)
            node = node.before
        for node in reversed(rest):
            self.emit(node.edit, node.row)
        return cost


class Audit:
    """Counts, edits and the digest of one conversation, row by row in turn order."""

    def __init__(self, conv):
        self.conv, self.edits, self.rows, self.digest, self.some = conv, [], [], hashlib.sha256(), False
        self.count = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.first = self.last = self.role = None
        self.turns = 0
        self.repair = Repair(self.emit)

    def emit(self, edit: str, row: tuple[str, str] | None) -> None:
        self.edits.append(edit)
        role, text = row or (None, None)
        self.rows.append({"conv": self.conv, "place": len(self.edits), "edit": edit, "role": role, "text": text})
        if row:
            self.digest.update(f"{'\n' if self.some else ''}{row[0]}:{row[1]}".encode())
            self.some = True

    def row(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        fault = fault_of(text, repeated)
        if fault:
            self.count[fault] += 1
        if self.role is not None and self.role[:1] + role[:1] not in ("su", "ua", "au"):
            self.count["illegal"] += 1
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1
        self.role = role
        self.repair.step(role, text, fault)

    def result(self) -> dict:
        cost = self.repair.finished()
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return {"conv": self.conv, "gaps": gaps, **self.count, "cost": cost, "audit": "".join(self.edits), "repaired_sha256": self.digest.hexdigest(), "most_held": self.repair.most_held}


def fault_of(text: str, repeated: bool) -> str:
    """A row's first fault."""
    ink = text.rstrip(" \t\n\v\f\r")
    if not ink:
        return "blank"
    if repeated:
        return "duplicate"
    return "" if ink[-1] in ".!?" else "truncated"


COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, most_held long"


ROWS = "place long, edit string, role string, text string"


def _searched(schema: pa.Schema, rows: bool):
    """One result for each conversation of a sorted stream, or the rows of its edits as they become final."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []

        def ended() -> None:
            result = now[1].result()
            out.extend(now[1].rows if rows else [result])

        for batch in batches:
            for key, conv, turn, role, text, repeated in zip(*(batch.column(c).to_pylist() for c in ("key", "conv", "turn", "role", "text", "repeated")), strict=True):
                if now is None or now[0] != key:
                    if now:
                        ended()
                    now = (key, Audit(conv))
                now[1].row(turn, role, text, repeated)
            if rows and now:
                out.extend(now[1].rows)
                now[1].rows.clear()
            elif now:
                now[1].rows.clear()
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if now:
            ended()
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _streams(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """The rows of each conversation in one partition, in turn order, with a mark on those seen earlier."""
    own = rows.select(rows[id_col].alias("conv"), rows[turn_col].cast("long").alias("turn"), F.coalesce(rows[role_col], F.lit(" ")).alias("role"), F.coalesce(rows[text_col], F.lit(" ")).alias("text"))
    own = own.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit(""))).withColumn("digest", F.sha2("text", 256))
    earlier = W.partitionBy("key", "role", "digest").orderBy(F.asc_nulls_first("turn"))
    own = own.withColumn("repeated", F.row_number().over(earlier) > 1).drop("digest")
    small_batches(rows)
    return own.repartition("key").sortWithinPartitions("key", F.asc_nulls_first("turn"), "role", "text", "repeated")


def _run(rows: DataFrame, names: tuple[str, str, str, str], added: str, each: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType([StructField("conv", rows.schema[names[0]].dataType), *StructType.fromDDL(added).fields])
    return _streams(rows, *names).mapInArrow(_searched(to_arrow_schema(schema), each), schema).withColumnRenamed("conv", names[0])


def repaired(rows: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation of rows: id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, most_held.

    Rows go by turn, nulls first, then role, text. Null roles and texts count as one space, a null
    id is one conversation. A row is a duplicate if its role and text were in an earlier row; that is
    found by a window on (conversation, role, digest of the text), so no task holds what was seen.
    most_held is the largest number of tree nodes held at once. Other columns are not read.
    """
    return _run(rows, (id_col, turn_col, role_col, text_col), COUNTS, False)


def edited(rows: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per edit of each conversation of rows: id, place (from 1, in order), edit (K, R, D or I) and the role and text it leaves, null where deleted. Rows are read as by `repaired`."""
    return _run(rows, (id_col, turn_col, role_col, text_col), ROWS, True)


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage to (conv_id, turn, role, text), by the crc32 of `conv_id:turn`: rows dropped, emptied, without their stops, repeated, or said by the user. Nulls are one space."""
    space = F.lit(" ")
    own = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    return own.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, edits and digest of every conversation after damage; one that lost all its rows has zeros, an empty audit and the digest of an empty text."""
    rows = table(spark, sf_dir, "conversations")
    found = repaired(damaged(rows)).drop("most_held")
    every = rows.select("conv_id").distinct()
    joined = every.join(found.withColumnRenamed("conv_id", "found_id"), F.col("conv_id").eqNullSafe(F.col("found_id")), "left").drop("found_id")
    empty = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return joined.select("conv_id", *[F.coalesce(c, F.lit(empty.get(c, 0))).alias(c) for c in joined.columns if c != "conv_id"])
