"""Structure repair of conversations: the cheapest edits that make roles alternate, by A* on the edit lattice.

Rows of a conversation are ordered by turn (nulls first; rows of one turn by role and text). A row's first fault counts: blank (no character but ASCII white
space), duplicate (role and text seen earlier in the conversation), truncated (the last such character ends no sentence).

A node of the lattice is a number of rows consumed and the state of the pattern ``(s?(ua)+)?``. Edits lead on: Keep costs 0 and
needs a role that the pattern allows, Rerole (to the one role allowed) 1, Delete 2, Insert (a turn without text) 5; blank and duplicate
rows can only be deleted, a truncated row that stays costs 5 more. The heuristic is a suffix sum: 2 for every blank or duplicate
row to come, and for every truncated one the cheaper of its charge and its deletion. It never exceeds the true rest, and never falls by more than an edit
costs, so a node is final when it leaves the queue. The queue is keyed by cost plus heuristic and then by the audit, the
edits' initials so far, so that of equally cheap repairs the one with the ASCII-least audit comes first. An audit is a node of a tree, and two are
compared at their lowest common ancestor, by jump pointers, so long conversations need no copies of their audits.

Spark orders rows, finds faults and gathers one short symbol a row; a task searches one conversation's symbols and never holds texts. Texts stay in a table
written once, and meet the edits by (conversation, position).

Defined results: null role and text become one space; a role's initial is its first character, a role without any is an ``_``; rows without conv_id are a conversation, its id null;
repeated rows are duplicates; an empty table gives an empty one. Other columns of the input are not returned, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quorumlens.llm.common import by_slices, scratch_path, small_batches

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States of the pattern (nothing yet, after s, after u, after a): the next state of a kept initial; of a user or assistant turn that is put there; accepted at the end.
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
PUT = (2, 2, 3, 2)
ACCEPTED = (0, 3)
#: ASCII white space.
WHITE = " \t\n\x0b\x0c\r"
#: Faults of a row, as the second character of its symbol; the first is the role's initial.
BLANK, DUPLICATE, CUT_OFF, FINE = "b", "d", "t", "."


class Audit:
    """A string of edits' initials, as a path from the root; comparing two takes time logarithmic in their length."""

    __slots__ = ("edit", "parent", "jump", "depth")

    def __init__(self, edit: str, parent: Audit | None):
        self.edit, self.parent = edit, parent
        self.depth = 0 if parent is None else parent.depth + 1
        far = None if parent is None else parent.jump
        even = far is not None and far.jump is not None and parent.depth - far.depth == far.depth - far.jump.depth
        self.jump = far.jump if even else parent

    def prefix(self, depth: int) -> Audit:
        node = self
        while node.depth > depth:
            node = node.jump if node.jump is not None and node.jump.depth >= depth else node.parent
        return node

    def __lt__(self, other: Audit) -> bool:
        depth = min(self.depth, other.depth)
        a, b = self.prefix(depth), other.prefix(depth)
        if a is b:
            return self.depth < other.depth
        while a.parent is not b.parent:
            a, b = (a.jump, b.jump) if a.jump is not b.jump else (a.parent, b.parent)
        return a.edit < b.edit

    def text(self) -> str:
        edits, node = [], self
        while node.parent is not None:
            edits.append(node.edit)
            node = node.parent
        return "".join(reversed(edits))


def repair(symbols: str) -> tuple[int, str]:
    """Cost and audit of the cheapest repair of rows given as two characters each (initial, fault).

    The successors of a node by different edits are different, and those by one edit are one, so audits and paths of the lattice are the same thing.
    """
    rows = [symbols[k : k + 2] for k in range(0, len(symbols), 2)]
    rest = [0] * (len(rows) + 1)
    for i in range(len(rows) - 1, -1, -1):
        fault = rows[i][1]
        rest[i] = rest[i + 1] + (DELETE if fault in (BLANK, DUPLICATE) else min(DELETE, TRUNCATED) if fault == CUT_OFF else 0)
    queue, closed = [(rest[0], Audit("", None), 0, 0, 0)], set()
    while queue:
        _, audit, cost, i, state = heapq.heappop(queue)
        if (i, state) in closed:
            continue
        closed.add((i, state))
        if i == len(rows) and state in ACCEPTED:
            return cost, audit.text()
        steps = [("I", INSERT, i, PUT[state])]
        if i < len(rows):
            initial, fault = rows[i]
            steps.append(("D", DELETE, i + 1, state))
            if fault not in (BLANK, DUPLICATE):
                charge = TRUNCATED if fault == CUT_OFF else 0
                steps.append(("R", REROLE + charge, i + 1, PUT[state]))
                if initial in KEPT[state]:
                    steps.append(("K", KEEP + charge, i + 1, KEPT[state][initial]))
        for edit, price, at, then in steps:
            if (at, then) not in closed:
                heapq.heappush(queue, (cost + price + rest[at], Audit(edit, audit), cost + price, at, then))
    raise AssertionError("every conversation can be deleted")


def replay(symbols: str, audit: str) -> Iterator[tuple[int | None, str | None]]:
    """The turns that an audit leaves: (row, None) for a kept one, (row, role) with its new role, (None, role) for an inserted one."""
    i, state = 0, 0
    for edit in audit:
        if edit == "K":
            yield i, None
            state = KEPT[state][symbols[2 * i]]
        elif edit != "D":
            state = PUT[state]
            yield (None if edit == "I" else i), "user" if state == 2 else "assistant"
        i += edit != "I"


REPAIRED = "struct<cost: bigint, audit: string, turns: array<struct<pos: bigint, role: string>>>"


def repaired(symbols: Column) -> Column:
    """cost, audit and the turns that stay (pos from 0 or null, new role or null)."""
    turn = pa.struct([("pos", pa.int64()), ("role", pa.string())])
    arrow = pa.struct([("cost", pa.int64()), ("audit", pa.string()), ("turns", pa.list_(turn))])

    def one(symbols: str) -> dict:
        cost, audit = repair(symbols)
        return {"cost": cost, "audit": audit, "turns": [{"pos": pos, "role": role} for pos, role in replay(symbols, audit)]}

    return by_slices(REPAIRED, arrow, lambda: lambda many: list(map(one, many)), symbols, step=100)


def with_faults(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with pos (from 0), symbol, illegal (whether its initial may not follow the one before) and first_of_turn."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    order = [F.asc_nulls_first("turn"), "role", "text"]
    in_order, same = W.partitionBy("conv_id").orderBy(*order), W.partitionBy("conv_id", "role", "text").orderBy(*order)  # one shuffle serves both
    visible = F.rtrim("text", F.lit(WHITE))
    fault = F.when(visible == "", BLANK).when(F.col("nth") > 1, DUPLICATE).when(~F.right(visible, F.lit(1)).isin(".", "!", "?"), CUT_OFF).otherwise(FINE)
    initial = F.when(F.col("role") == "", "_").otherwise(F.left("role", F.lit(1)))
    before = F.lag("initial").over(in_order)
    numbered = rows.withColumn("nth", F.row_number().over(same)).withColumn("initial", initial).withColumn("pos", F.row_number().over(in_order).cast("long") - 1)
    return numbered.select(
        "conv_id", "turn", "pos", "role", "text", F.concat("initial", fault).alias("symbol"),
        (before.isNotNull() & ~F.concat(before, "initial").isin("su", "ua", "au")).alias("illegal"),
        (F.col("turn").isNotNull() & ~F.lag("turn").over(in_order).eqNullSafe(F.col("turn"))).alias("first_of_turn"),
    )


def repair_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables. Reports: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation of ``turns`` (conv_id, turn, role, text).
    Turns after repair: conv_id, place (from 0), role, text, edit (keep, rerole or insert)."""
    spark = turns.sparkSession
    rows_path, report_path = scratch_path(spark, "chat-rows"), scratch_path(spark, "chat-repairs")
    with_faults(turns).write.parquet(rows_path)
    rows = spark.read.parquet(rows_path)
    count = lambda fault: F.count_if(F.substring("symbol", 2, 1) == fault)
    found = rows.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_if("first_of_turn"), F.lit(0)).alias("gaps"),
        count(BLANK).alias("blank"), count(DUPLICATE).alias("duplicate"), count(CUT_OFF).alias("truncated"), F.count_if("illegal").alias("illegal"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "symbol"))), lambda x: x["symbol"]), "").alias("symbols"),
    )
    found.withColumn("repaired", repaired(F.col("symbols"))).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "repaired.*").write.parquet(report_path)
    reports = spark.read.parquet(report_path)
    stay = reports.select("conv_id", F.posexplode("turns").alias("place", "t")).select("conv_id", "place", "t.pos", F.col("t.role").alias("new_role"))
    texts = rows.select(F.col("conv_id").alias("_id"), F.col("pos").alias("_pos"), "role", "text")
    joined = stay.join(texts, F.col("conv_id").eqNullSafe(F.col("_id")) & (F.col("pos") == F.col("_pos")), "left")
    edit = F.when(F.col("pos").isNull(), "insert").when(F.col("new_role").isNull(), "keep").otherwise("rerole")
    after = joined.select("conv_id", "place", F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"), edit.alias("edit"))
    return reports.drop("turns"), after


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, sha256 of the lines ``role:text`` of each conversation (conv_id, place, role, text), in order; texts stream through, one at a time."""
    small_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, done = None, None, []
        for batch in batches:
            for conv, place, role, text in zip(*[batch.column(k) for k in range(4)], strict=True):
                if place.as_py() == 0:
                    if state is not None:
                        done.append((held, state.hexdigest()))
                    held, state = conv.as_py(), hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], kind) for k, kind in enumerate((batch.schema.field(0).type, pa.string()))], ["conv_id", "sha256"])
            done, id_type = [], batch.schema.field(0).type
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held], id_type), pa.array([state.hexdigest()])], ["conv_id", "sha256"])

    kind = turns.schema["conv_id"].dataType.simpleString()
    placed = turns.select("conv_id", "place", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return placed.mapInArrow(run, f"conv_id {kind}, sha256 string")
