"""Repair of conversations by generalised LR parsing with edits.

The role grammar ``C -> e | P | s P``, ``P -> u a | P u a`` is parsed by its LR automaton. A graph-structured stack
holds every stack top that some edits of the turns so far can lead to; each turn is kept, given another role or
deleted, and turns are inserted, at a cost. Equal tops are merged to the one of least (cost, audit), where audit
spells the edits; this loses nothing, since what lies below a top decides neither later costs nor later audits.

A conversation is cut into chunks of sorted turns. For a chunk that may have turns before it, the best edits are found
from each top that it can start at; these tables are then joined in order. Costs add up and audits are appended, and
two audits of equal cost over the same turns are never prefixes of each other, so minima of chunks give the minimum of
the whole. So no task needs to hold a conversation, only its audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .scratch import Scratch

#: Turns of a chunk.
CHUNK = 1024
#: The automaton: state -> terminal -> state; states that reduce (symbols popped); where P leads to; where input may end.
SHIFT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 5}, 3: {"u": 6}, 4: {"u": 6}, 6: {"a": 7}}
REDUCE, GOTO, END = {5: 2, 7: 3}, {0: 3, 1: 4}, (0, 3, 4)
#: A stack for each top at which a chunk can start.
STACKS = {0: (0,), 1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (0, 1, 4), 6: (0, 3, 6)}
NAMES = {"u": "user", "a": "assistant"}
COST = {"K": 0, "R": 2, "D": 3, "I": 2}
SPACE = " \t\n\x0b\x0c\r"
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
_TOPS = "array<struct<enter:int,leave:int,cost:long,audit:string>>"
_CHUNKS = f"part int, seq int, conv_id long, turns array<bigint>, roles array<string>, texts array<string>, faults array<int>, tops {_TOPS}"
_SHARES = "part int, seq int, share string, cost long, audit string"
_REPAIRED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Stack:
    """A graph-structured stack: for each top the node below it and the least (cost, audit) that leads there."""

    def __init__(self, start: tuple[int, ...]):
        node = None
        for state in start:
            node = (state, node)
        self.tops = {start[-1]: (0, "", node)}

    def shift(self, tops: dict, top: tuple, symbol: str, cost: int, edit: str) -> bool:
        """Push a terminal and reduce; whether it gave a new or better top in ``tops``."""
        at, audit, node = top
        state = SHIFT.get(node[0], {}).get(symbol)
        if state is None:
            return False
        node = (state, node)
        if state in REDUCE:
            for _ in range(REDUCE[state]):
                node = node[1]
            node = (GOTO[node[0]], node)
        return self.merge(tops, (at + cost, audit + edit, node))

    @staticmethod
    def merge(tops: dict, top: tuple) -> bool:
        old = tops.get(top[2][0])
        if old is not None and old[:2] <= top[:2]:
            return False
        tops[top[2][0]] = top
        return True

    def insert(self) -> None:
        """Insertions in front of the next turn, until none gives a better top."""
        new = True
        while new:
            new = any([self.shift(self.tops, top, x, COST["I"], "I") for top in list(self.tops.values()) for x in NAMES])

    def turn(self, role: str, fault: int) -> None:
        """One turn: blank ones and duplicates have to go, a truncated one costs 1 more unless it goes."""
        self.insert()
        tops: dict = {}
        for top in self.tops.values():
            self.merge(tops, (top[0] + COST["D"], top[1] + "D", top[2]))
            if fault not in (BLANK, DUPLICATE):
                more = int(fault == TRUNCATED)
                self.shift(tops, top, role[:1], COST["K"] + more, "K")
                for x in NAMES:
                    self.shift(tops, top, x, COST["R"] + more, "R")
        self.tops = tops


def table(roles: list[str], faults: list[int], starts: tuple[int, ...]) -> list[dict]:
    """The least (cost, audit) from each top in ``starts`` to each top after the turns."""
    out = []
    for s in starts:
        stack = Stack(STACKS[s])
        for role, fault in zip(roles, faults, strict=True):
            stack.turn(role, fault)
        out += [{"enter": s, "leave": t, "cost": c, "audit": a} for t, (c, a, _) in sorted(stack.tops.items())]
    return out


def closed(tops: dict[int, tuple[int, str]]) -> tuple[int, str]:
    """The least (cost, audit) at the end of a conversation, after insertions."""
    stack = Stack((0,))
    stack.tops = {}
    for t, (cost, audit) in tops.items():
        node = None
        for state in STACKS[t]:
            node = (state, node)
        stack.tops[t] = (cost, audit, node)
    stack.insert()
    return min(stack.tops[t][:2] for t in END if t in stack.tops)


def _schema(spark_type: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(spark_type))


def _chunks(kinds: pa.Schema, size: int):
    """Over sorted turns: a row for each chunk. Only a task's first conversation may have turns in an earlier task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, inside = TaskContext.get().partitionId(), 0, [], True  # inside: turns may come before held

        def made() -> pa.RecordBatch:
            turns, roles, texts, faults = ([x[i] for x in held] for i in range(1, 5))
            row = {"part": part, "seq": seq, "conv_id": held[0][0], "turns": turns, "roles": roles, "texts": texts, "faults": faults}
            return pa.RecordBatch.from_pylist([row | {"tops": table(roles, faults, tuple(STACKS) if inside else (0,))}], kinds)

        for batch in batches:
            for conv, turn, role, text, fault, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for i in range(copies):
                    if held and (conv != held[0][0] or len(held) == size):
                        yield made()
                        inside, seq, held = conv == held[0][0], seq + 1, []
                    held.append((conv, turn, role, text, DUPLICATE if i and fault != BLANK else fault))
        if held:
            yield made()

    return run


def _shares(kinds: pa.Schema):
    """Over the tables of chunks sorted by conversation: its cost and audit, and each chunk's share of the audit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, tops, chunks = None, {}, []

        def made() -> pa.RecordBatch:
            cost, audit = closed(tops)
            rows, at = [], 0
            for i, (part, seq, n) in enumerate(chunks):
                end = at
                while n:
                    n -= audit[end] != "I"
                    end += 1
                if i == len(chunks) - 1:
                    end = len(audit)
                rows.append({"part": part, "seq": seq, "share": audit[at:end], "cost": cost, "audit": None if i else audit})
                at = end
            return pa.RecordBatch.from_pylist(rows, kinds)

        for batch in batches:
            for row in batch.to_pylist():
                if chunks and row["conv_id"] != conv:
                    yield made()
                    chunks = []
                if not chunks:
                    conv, tops = row["conv_id"], {0: (0, "")}
                new: dict[int, tuple[int, str]] = {}
                for x in row["tops"]:
                    if x["enter"] in tops:
                        cost, audit = tops[x["enter"]]
                        new[x["leave"]] = min(new.get(x["leave"], (1 << 62, "")), (cost + x["cost"], audit + x["audit"]))
                tops = new
                chunks.append((row["part"], row["seq"], row["n"]))
        if chunks:
            yield made()

    return run


class Repaired:
    """What is reported of one conversation, as its chunks come in order."""

    def __init__(self, conv_id: int | None, cost: int, audit: str):
        self.row = {"conv_id": conv_id, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": cost, "audit": audit}
        self.first = self.turn = self.role = None
        self.distinct, self.next, self.started, self.hash = 0, "u", False, hashlib.sha256()

    def put(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.started else "") + f"{role}:{text}").encode())
        self.started, self.next = True, "a" if role[:1] == "u" else "u"

    def add(self, turns: list, roles: list[str], texts: list[str], faults: list[int], share: str) -> None:
        i = 0
        for edit in share:
            if edit == "I":
                self.put(NAMES[self.next], "")
                continue
            turn, role, fault = turns[i], roles[i], faults[i]
            if turn is not None and turn != self.turn:
                self.first = turn if self.first is None else self.first
                self.turn, self.distinct = turn, self.distinct + 1
            for k, name in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (TRUNCATED, "truncated")):
                self.row[name] += fault == k
            self.row["illegal"] += self.role is not None and self.role[:1] + role[:1] not in ("su", "ua", "au")
            self.role = role
            if edit != "D":
                self.put(role if edit == "K" else NAMES[self.next], texts[i])
            i += 1

    def result(self) -> dict:
        if self.distinct:
            self.row["gaps"] = self.turn - self.first + 1 - self.distinct
        return self.row | {"repaired_sha256": self.hash.hexdigest()}


def _repaired(kinds: pa.Schema):
    """Over chunks sorted by conversation and place: a row for each conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["audit"] is not None:  # a conversation's first chunk
                    if now is not None:
                        out.append(now.result())
                    now = Repaired(row["conv_id"], row["cost"], row["audit"])
                now.add(row["turns"], row["roles"], row["texts"], row["faults"], row["share"])
            if out:
                yield pa.RecordBatch.from_pylist(out, kinds)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.result()], kinds)

    return run


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows damaged by crc32 of ``conv_id:turn``; equal rows are one with their number."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text"))
    rows = rows.withColumn("kind", F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))


def faulted(rows: DataFrame) -> DataFrame:
    """The same rows with ``fault``: 0, or the number of the first of each row's faults."""
    place = F.struct(F.col("turn").isNotNull(), "turn")
    key = F.md5("text")
    first = rows.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), key.alias("h")).agg(F.min(place).alias("first"))
    ended = F.rtrim("text", F.lit(SPACE))
    fault = F.when(ended == "", BLANK).when(place > F.col("first"), DUPLICATE).when(~F.substring(ended, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    return rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (key == F.col("h"))).select("conv_id", "turn", "role", "text", fault.alias("fault"), "copies")


def repair(conversations: DataFrame, damage: bool = True, size: int = CHUNK) -> DataFrame:
    """One row per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Turns are damaged first (unless ``damage`` is false) and then ordered by turn, nulls first, and within a turn by
    role and text; equal rows stand next to each other. Nulls in role and text count as one space, rows of null
    conv_id are one conversation. The cheapest edits that give the roles ``(s?(ua)+)?`` by their initials are
    chosen, of equally cheap ones those of the least audit. A conversation of which no turn is left has zeros, an
    empty audit and the hash of nothing. Extra columns are ignored; an empty table gives an empty result.

    A task holds a chunk of ``size`` turns and, of one conversation at a time, the audit. The hash of one repaired
    conversation is made chunk by chunk in one task.
    """
    spark = conversations.sparkSession
    scratch = Scratch(spark, "conversations")
    order = ["conv_id", "turn", "role", "text"]
    rows = damaged(conversations) if damage else conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text"))).groupBy(*order).agg(F.count("*").alias("copies"))
    chunks = scratch.save(faulted(rows).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_chunks(_schema(_CHUNKS), size), _CHUNKS), "chunks")
    tables = chunks.select("conv_id", "part", "seq", F.size("faults").alias("n"), "tops")
    shares = tables.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "part", "seq").mapInArrow(_shares(_schema(_SHARES)), _SHARES)
    shares = scratch.save(shares, "shares")
    done = chunks.drop("tops").join(shares, ["part", "seq"]).repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "part", "seq")
    done = done.mapInArrow(_repaired(_schema(_REPAIRED)), _REPAIRED).withColumnRenamed("conv_id", "id")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = every.join(done, F.col("conv_id").eqNullSafe(F.col("id")), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return scratch.keep(out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")))
