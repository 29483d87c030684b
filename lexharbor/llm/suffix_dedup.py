"""Removal of repeated passages by longest previous factors in suffix order.

A position goes, with the ``length`` bytes from it, if its longest previous factor (LPF) is that long. Suffixes are
ordered over the whole cluster by their bytes, up to ``length`` of them, and then by position. One pass over the order
gives the common prefixes of neighbours and, by a stack of smaller positions, each suffix's previous and next smaller
position; the longer of its common prefixes with these two is its LPF. Values are not told apart beyond ``length``,
on which alone removal depends.

Only suffixes that can have an earlier match of that length are ordered, as an order of all bytes doesn't fit on the
disk. Equal windows of ``length`` bytes have the same least hash among their ``GRAM``-byte substrings, their anchor.
Runs of windows of the same anchor are sorted by anchor and bytes first: whole runs that repeat are settled there, an
anchor of one run only has no repeats, and single windows are ordered only where an anchor has several different runs.
Hot anchors, prefixes and copies are split: both sorts are by range and include the position, so that equal keys may
go to several tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .hashing import mix, powers, prefix_hash, utf8
from .scratch import Scratch

#: Bytes of a repeated string, and of the substrings whose least hash stands for it.
LENGTH, GRAM = 100, 32
#: Bytes of a text that are worked on at a time, and rows of one anchor that a task holds at a time.
CHUNK, HELD = 1 << 20, 500_000
_RUN = "anchor long, body long, doc_id long, start int, info long"
_FOUND = "doc_id long, start int, n int, whole boolean"
_PLACED = "kind int, part int, bytes binary, doc_id long, start int"
#: Windows whose bytes a task hands on at a time.
WINDOWS = 20_000


def _hashes(c: np.ndarray, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    return (c[at + size] - c[at]) * powers(len(c))[1][at]


def runs(a: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Anchor hash, hash of the bytes, first start and info of each run of windows with the same anchor.

    The anchor is the leftmost substring of least hash. Windows of a run differ in where the anchor lies, so no
    two of them are equal. info packs the count of windows and the anchor's place in the first one (12 bits
    each), and 20 bits each of the hashes of half of the rest before and after the anchor.
    """
    wide, half = length - GRAM + 1, (length - GRAM) // 2
    for lo in range(0, len(a) - length + 1, CHUNK):
        part = a[lo : lo + CHUNK + length - 1]
        c = prefix_hash(part)
        m = len(part) - GRAM + 1
        gram = mix(_hashes(c, np.arange(m), GRAM))
        rank = ((gram >> np.uint64(21)) << np.uint64(21)) | np.arange(m, dtype=np.uint64)  # ties: the leftmost
        padded = np.full(-(-m // wide) * wide, np.iinfo(np.uint64).max, dtype=np.uint64)
        padded[:m] = rank
        square = padded.reshape(-1, wide)
        before = np.minimum.accumulate(square, axis=1).ravel()
        after = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(part) - length + 1
        least = np.minimum(after[:n], before[wide - 1 : wide - 1 + n])
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        count = np.diff(np.append(first, n))
        anchor = (least[first] & np.uint64((1 << 21) - 1)).astype(np.int64)
        sides = [mix(_hashes(c, np.clip(anchor + off, 0, max(0, len(part) - half)), half)) >> np.uint64(44) for off in (-half, GRAM)]
        info = count.astype(np.uint64) << np.uint64(52) | (anchor - first).astype(np.uint64) << np.uint64(40) | sides[0] << np.uint64(20) | sides[1]
        yield gram[anchor].view(np.int64), mix(_hashes(c, first, count - 1 + length)).view(np.int64), first + lo, info.view(np.int64)


def _runs(length: int):
    names = ["anchor", "body", "doc_id", "start", "info"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0

            def made() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names)

            for doc, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), strict=True):
                for anchor, body, start, info in runs(np.frombuffer(text, dtype=np.uint8), length):
                    held.append((anchor, body, np.full(len(start), doc), start.astype(np.int32), info))
                    size += len(start)
                    if size > 200_000:
                        yield made()
                        held, size = [], 0
            if held:
                yield made()

    return run


def _equal(*columns: np.ndarray) -> np.ndarray:
    """Whether each row equals the one before it in all columns; false for the first."""
    out = np.zeros(len(columns[0]), dtype=bool)
    if len(out) > 1:
        out[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in columns])
    return out


def _chosen(rows: list[np.ndarray], length: int, cut: tuple[bool, bool]) -> pa.RecordBatch:
    """Sorted runs to whole repeats, and to windows that are to be ordered one by one.

    cut tells whether the first and the last anchor may have more rows elsewhere: these count as having
    several runs, so a run is settled here only if its first one is.
    """
    half = (length - GRAM) // 2
    anchor, body, doc, start, info = rows
    same = _equal(anchor)
    again = same & _equal(body)
    group = np.cumsum(~same) - 1
    groups = group[-1] + 1
    touched = np.zeros(groups, dtype=bool)
    touched[0], touched[-1] = touched[0] | cut[0], touched[-1] | cut[1]
    bits = info.view(np.uint64)
    n, q = (bits >> np.uint64(52)).astype(np.int64), (bits >> np.uint64(40) & np.uint64(4095)).astype(np.int64)
    single = ~again & ((np.bincount(group[~again], minlength=groups) > 1) | touched)[group]
    middle = start + q - half  # of the windows before it, half of the rest or more lies before the anchor
    parts = [(doc[again], start[again], n[again], np.ones(again.sum(), dtype=bool))]
    for shift, lo, hi in ((20, start, np.minimum(start + n - 1, middle)), (0, np.maximum(start, middle + 1), start + n - 1)):
        fit = np.flatnonzero(single & (lo <= hi))
        key = group[fit] << 20 | (bits[fit] >> np.uint64(shift) & np.uint64(0xFFFFF)).astype(np.int64)
        _, place, count = np.unique(key, return_inverse=True, return_counts=True)
        fit = fit[(count[place] > 1) | touched[group[fit]]]
        parts.append((doc[fit], lo[fit], hi[fit] - lo[fit] + 1, np.zeros(len(fit), dtype=bool)))
    out = [np.concatenate(x) for x in zip(*parts, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.bool_()), strict=True)], ["doc_id", "start", "n", "whole"])


def _sorted_runs(length: int):
    """Over sorted runs, all rows of an anchor at a time; of one with more than HELD rows, in several parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        opened = True  # more rows of the first anchor may lie in an earlier part
        for batch in batches:
            new = [batch.column(i).to_numpy() for i in range(5)]
            rows = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            if not len(rows[0]):
                continue
            rows = [x[~_equal(*rows[:4])] for x in rows]  # a row that repeats a doc_id
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            if len(rows[0]) - cut > HELD:
                yield _chosen([x[:-1] for x in rows], length, (opened, True))
                held, opened = [x[-1:] for x in rows], True
            else:
                if cut:
                    yield _chosen([x[:cut] for x in rows], length, (opened, False))
                    opened = False
                held = [x[cut:] for x in rows]
        if held is not None:
            yield _chosen(held, length, (opened, True))

    return run


def _lists(column: pa.Array, *fields: str) -> tuple[np.ndarray, ...]:
    """Offsets and flat fields of a list of structs; null lists are empty."""
    sizes = column.value_lengths().fill_null(0).to_numpy()
    flat = column.flatten()
    return np.concatenate(([0], np.cumsum(sizes))), *(flat.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in fields)


def _windows(length: int):
    """The chosen windows of each text as (bytes, doc_id, start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts, first, count = _lists(batch.column("spans"), "start", "n")
            for i, (doc, text) in enumerate(zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), strict=True)):
                f, n = first[cuts[i] : cuts[i + 1]], count[cuts[i] : cuts[i + 1]]
                at = np.repeat(f - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                a = np.frombuffer(text, dtype=np.uint8)
                for lo in range(0, len(at), WINDOWS):
                    own = at[lo : lo + WINDOWS]
                    rows = np.lib.stride_tricks.sliding_window_view(a, length)[own]
                    held = pa.FixedSizeBinaryArray.from_buffers(pa.binary(length), len(own), [None, pa.py_buffer(rows.tobytes())])
                    yield pa.RecordBatch.from_arrays([held.cast(pa.binary()), pa.array(np.full(len(own), doc), pa.int64()), pa.array(own.astype(np.int32))], ["bytes", "doc_id", "start"])

    return run


class Factors:
    """LPF values of suffixes that come in order, with the length of the prefix that each shares with the one before.

    The stack holds suffixes of ever greater position, each with the prefix that it shares with the one below, its
    previous smaller position. A suffix of smaller position is the next smaller one of those that it takes off. One
    that shares ``most`` bytes with its previous smaller position has its value and needs no place on the stack, since
    what is below stands for it.
    """

    def __init__(self, most: int):
        self.most, self.stack = most, []

    def add(self, position, shared: int) -> Iterator[tuple]:
        """(position, LPF) of the suffixes whose value is now known."""
        stack, now = self.stack, shared
        while stack and stack[-1][0] > position:
            top, below = stack.pop()
            yield top, max(below, now)
            now = min(now, below)
        if not now:
            yield from stack
            stack.clear()
        if now >= self.most:
            yield position, now
        else:
            stack.append((position, now))

    def end(self) -> Iterator[tuple]:
        yield from self.stack
        self.stack = []


def shared_prefixes(rows: np.ndarray) -> np.ndarray:
    """Bytes that each row but the first shares with the one before, from the left."""
    differ = rows[1:] != rows[:-1]
    return np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])


def _ordered(length: int):
    """Over sorted suffixes: kind 0 for those whose LPF reaches ``length``; 1 and 2 for the task's ends.

    The first suffix of a task may have its previous smaller position in an earlier task, which the ends tell; others of
    its prefix have the first itself before them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, factors = TaskContext.get().partitionId(), None, Factors(length)

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int32()), strict=True)], ["kind", "part", "bytes", "doc_id", "start"])

        for batch in batches:
            keys = [x for x in batch.column("bytes").to_pylist()]
            places = list(zip(batch.column("doc_id").to_pylist(), batch.column("start").to_pylist(), strict=True))
            if not keys:
                continue
            found: list[tuple] = []
            if last is None:
                found.append((1, part, keys[0], *places[0]))
                shared = [0]
            else:
                shared = []
            rows = np.frombuffer(b"".join(keys if last is None else [last[0], *keys]), dtype=np.uint8).reshape(-1, length)
            shared += shared_prefixes(rows).tolist()
            before = None if last is None else last[1]
            for place, n in zip(places, shared, strict=True):
                if place != before:  # else a row that repeats a doc_id
                    found += [(0, part, None, *p) for p, lpf in factors.add(place, n) if lpf >= length]
                before = place
            last = (keys[-1], places[-1])
            if found:
                yield made(found)
        if last is not None:
            yield made([(0, part, None, *p) for p, lpf in factors.end() if lpf >= length] + [(2, part, last[0], *last[1])])

    return run


def _ends_found(ends: list) -> list[tuple[int, int]]:
    """(doc_id, start) of the first suffixes of tasks that begin as the last suffix of the task before."""
    out, last = [], None
    for r in sorted(ends, key=lambda r: (r["part"], r["kind"])):
        key = (bytes(r["bytes"]), r["doc_id"], r["start"])
        if r["kind"] == 1 and last is not None and last[0] == key[0] and last != key:
            out.append(key[1:])
        last = key
    return out


def _cut(length: int):
    """Each text without the bytes that its spans cover: sizes, kept text's hash and the removed ranges."""
    kinds = [*[pa.int64()] * 4, pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            cuts, first, count = _lists(batch.column("spans"), "start", "n")
            for i, (doc, text, copy) in enumerate(zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), batch.column("copy").to_pylist(), strict=True)):
                lo, hi = np.empty(0, np.int64), np.empty(0, np.int64)
                if copy and len(text) >= length:
                    lo, hi = np.array([0]), np.array([len(text)])
                elif not copy and cuts[i] < cuts[i + 1]:
                    order = np.argsort(first[cuts[i] : cuts[i + 1]], kind="stable")
                    s = first[cuts[i] : cuts[i + 1]][order]
                    e = np.maximum.accumulate(s + count[cuts[i] : cuts[i + 1]][order] - 1 + length)
                    new = np.concatenate(([True], s[1:] > e[:-1]))
                    lo, hi = s[new], e[np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)]
                gone = list(zip(lo.tolist(), hi.tolist(), strict=True))
                kept = b"".join(text[a:b] for a, b in zip([0, *hi.tolist()], [*lo.tolist(), len(text)], strict=True)) if gone else text
                out.append((doc, len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in gone]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per row of docs (doc_id, text): n_bytes, n_removed, n_spans, kept_sha256, removed (byte ranges).

    Each byte that is covered by a ``length``-byte string which also starts earlier (smaller doc_id, or same
    document, earlier start) is removed; strings are judged on the input. A null text is empty; texts shorter
    than ``length`` stay whole. A row of null doc_id stays whole and gives no earlier strings. Rows that repeat
    a doc_id with the same text are judged as the one document they are. Extra columns are ignored; an empty
    table gives an empty result.

    Whole texts that repeat are copies of the first and need no search. What a task holds is bounded by its
    batches and HELD; the driver reads two rows for each task of the last sort.
    """
    if not GRAM < length < GRAM + 4095:
        raise ValueError(f"length must lie between {GRAM + 1} and {GRAM + 4094}")
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    prints = docs.filter("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("h"), F.unhex(F.md5("text")).alias("g"))
    first = prints.groupBy("h", "g").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first <> last").drop("last")
    copies = scratch.save(prints.join(first, ["h", "g"]).filter("doc_id <> first").select("doc_id").distinct(), "copies")
    own = docs.filter((F.octet_length("text") >= length) & F.col("doc_id").isNotNull()).join(copies, "doc_id", "left_anti")
    every = scratch.save(own.mapInArrow(_runs(length), _RUN), "runs")
    order = ["anchor", "body", "doc_id", "start"]
    found = scratch.save(every.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_sorted_runs(length), _FOUND), "found", (every,))
    spans = found.filter("NOT whole").groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    windows = scratch.save(docs.join(spans, "doc_id").mapInArrow(_windows(length), "bytes binary, doc_id long, start int"), "windows")
    order = ["bytes", "doc_id", "start"]
    later = scratch.save(windows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_ordered(length), _PLACED), "later", (windows,))
    ends = spark.createDataFrame(_ends_found(later.filter("kind > 0").collect()), "doc_id long, start int")
    gone = later.filter("kind = 0").select("doc_id", "start").union(ends).select("doc_id", "start", F.lit(1).alias("n")).union(found.filter("whole").select("doc_id", "start", "n"))
    gone = gone.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    out = docs.join(gone, "doc_id", "left").join(copies.withColumn("copy", F.lit(True)), "doc_id", "left").select("doc_id", "text", "spans", F.coalesce("copy", F.lit(False)).alias("copy"))
    return scratch.keep(out.mapInArrow(_cut(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:int,end:int>>"))
