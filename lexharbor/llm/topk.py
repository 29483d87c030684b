"""Exact top-k search by integer inner product over a bit-sliced index.

Components are quantised to integers. The index cuts the vectors into blocks; of each block and component it keeps
one bitmap for each binary digit (a slice), with a bit for each vector. A query adds these slices: a digit j of its
component and slice s count 2**(j + s), bitmaps of equal weight are added three at a time by full adders, and what
remains are the slices of the scores. From the most significant score slice downward, rows that hold the digit are
kept as long as there are k of them; what lies on the boundary is then resolved exactly, by score and id.

Every vector is looked at by every query, in blocks, and nothing is approximate: recall is 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .scratch import Scratch

#: Vectors of an index block, queries of one row, and groups that the queries' rows are dealt into at most.
BLOCK, QUERIES, GROUPS = 8192, 128, 64
#: Rows on the boundary from which on the exact scores are read instead of more slices.
BOUNDARY = 64
_INDEX = "block long, ids binary, digits binary, shape array<int>, least binary"


def quantised(vector: str, scale: int) -> Column:
    """floor(scale * x) of each component, with x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


class Slices:
    """The slices of one block: ``digits`` has (2, components, slices, words), the second half complemented."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        ids, values = ids[order], values[order]
        least = values.min(axis=0)
        above = (values - least).astype(np.uint64)
        count = max(1, int(above.max()).bit_length())
        words = -(-len(ids) // 64)
        digits = np.zeros((values.shape[1], count, words * 8), dtype=np.uint8)
        for s in range(count):
            bit = (above >> np.uint64(s) & np.uint64(1)).astype(np.uint8)
            packed = np.packbits(bit, axis=0, bitorder="little")
            digits[:, s, : packed.shape[0]] = packed.T
        self.ids, self.least, self.digits = ids, least, digits.view(np.uint64)

    @classmethod
    def stored(cls, ids: bytes, digits: bytes, shape: list[int], least: bytes) -> Slices:
        out = cls.__new__(cls)
        out.ids, out.least = np.frombuffer(ids, np.int64), np.frombuffer(least, np.int64)
        out.digits = np.frombuffer(digits, np.uint64).reshape(shape)
        return out

    def open(self) -> Slices:
        """Complemented slices beside the plain ones: a negative factor counts digits that are absent."""
        self.both = np.stack([self.digits, ~self.digits])
        alive = np.zeros(self.digits.shape[2] * 64, dtype=np.uint8)
        alive[: len(self.ids)] = 1
        self.alive = np.packbits(alive, bitorder="little").view(np.uint64)
        return self

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of the scores, least significant first, and what is to be added to each score."""
        count = self.digits.shape[1]
        size, minus = np.abs(query), (query < 0).astype(np.int64)
        parts: dict[int, list[np.ndarray]] = {}
        for j in range(int(size.max()).bit_length()):
            own = np.flatnonzero(size >> j & 1)
            if len(own):
                rows = self.both[minus[own], own]
                for s in range(count):
                    parts.setdefault(j + s, []).append(rows[:, s])
        out, weight = [], 0
        while parts and weight <= max(parts):
            stack = np.concatenate(parts.pop(weight)) if weight in parts else np.zeros((1, self.digits.shape[2]), np.uint64)
            carry = []
            while len(stack) > 1:
                m = len(stack) // 3
                if m:
                    a, b, c = stack[:m], stack[m : 2 * m], stack[2 * m : 3 * m]
                    half = a ^ b
                    carry.append((a & b) | (half & c))
                    half ^= c
                    stack = np.concatenate((half, stack[3 * m :]))
                else:
                    carry.append(stack[:1] & stack[1:])
                    stack = stack[:1] ^ stack[1:]
            out.append(stack[0])
            if carry:
                parts.setdefault(weight + 1, []).extend(carry)
            weight += 1
        absent = (1 << count) - 1
        return out, int(query @ self.least) - absent * int(size @ minus)

    def top(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """(score, id) of the k best rows but those of id ``own``, ties to smaller ids."""
        slices, more = self.scores(query)
        rest, sure = self.alive.copy(), np.zeros_like(self.alive)
        for i in range(*np.searchsorted(self.ids, [own, own + 1])):
            rest[i // 64] &= ~np.uint64(1 << (i % 64))
        need, open_rows = k, int(np.bitwise_count(rest).sum())
        for digit in reversed(slices):
            if open_rows <= BOUNDARY or need == 0:
                break
            have = rest & digit
            n = int(np.bitwise_count(have).sum())
            if n >= need:
                rest, open_rows = have, n
            elif n:
                sure |= have
                rest &= ~digit
                need, open_rows = need - n, open_rows - n
        mask = sure | rest if need else sure
        at = np.flatnonzero(np.unpackbits(mask.view(np.uint8), bitorder="little")) if mask.any() else np.empty(0, np.int64)
        score = np.zeros(len(at), dtype=np.int64)
        for w, digit in enumerate(slices):
            score += (digit[at // 64] >> (at % 64).astype(np.uint64) & np.uint64(1)).astype(np.int64) << w
        order = np.lexsort((self.ids[at], -score))[:k]
        return [(int(score[i]) + more, int(self.ids[at[i]])) for i in order]


def _padded(column: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows; what is missing counts as 0."""
    sizes = column.value_lengths().to_numpy()
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def _blocks(width: int):
    """Sorted by block: an index row for each block, of which a task holds one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def made() -> pa.RecordBatch:
            block, ids, values = (np.concatenate(x) for x in zip(*held, strict=True))
            s = Slices(ids, values)
            return pa.RecordBatch.from_pydict({"block": [int(block[0])], "ids": [s.ids.tobytes()], "digits": [s.digits.tobytes()], "shape": pa.array([list(s.digits.shape)], pa.list_(pa.int32())), "least": [s.least.tobytes()]})

        for batch in batches:
            block, ids, values = batch.column("block").to_numpy(), batch.column("vec_id").to_numpy(), _padded(batch.column("v"), width)
            cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1), len(block)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if held and lo < hi and held[-1][0][-1] != block[lo]:
                    yield made()
                    held = []
                if lo < hi:
                    held.append((block[lo:hi], ids[lo:hi], values[lo:hi]))
        if held:
            yield made()

    return run


def _search(k: int, width: int):
    """Over rows sorted by cell: its index block first, then its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["digits"] is not None:
                    index = Slices.stored(row["ids"], row["digits"], row["shape"], row["least"]).open()
                    continue
                out = []
                for q in row["queries"]:
                    own = np.zeros(width, dtype=np.int64)
                    own[: len(q["v"])] = q["v"]
                    out += [(q["vec_id"], i, s) for s, i in index.top(own, q["vec_id"], k)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest inner products of floor(scale * x), ties to smaller vec_id.

    vectors has vec_id and embedding. Queries are the rows whose vec_id is divisible by ``every``; candidates are
    all rows of another vec_id. A query with fewer candidates has fewer rows. Rows whose vec_id or embedding is
    null, or whose embedding holds a null or a number that isn't finite, take no part. Of rows that repeat a
    vec_id, the least embedding stands for all. A shorter vector counts as ended by zeros. Extra columns are
    ignored; an empty table gives an empty result. Scores must fit 64 bits; quantised components beyond 2**31
    are refused.

    A task holds one index block and one row of queries. Blocks and query rows are cut by hashes of distinct ids,
    so no key is hot. Each block returns k rows for a query. The index goes to GROUPS cells a block at most, the
    queries to each block.
    """
    scratch = Scratch(vectors.sparkSession, "topk")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = rows.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").filter(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    rows = scratch.save(rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).select("vec_id", quantised("embedding", scale).alias("v")), "rows")
    asked = (F.col("vec_id") % every == 0)
    n, n_queries, width, most = rows.agg(F.count("*"), F.count_if(asked), F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()
    if (most or 0) >= 1 << 31:
        raise ValueError(f"a quantised component of {most} is beyond 31 bits")
    blocks, lots = math.ceil(n / BLOCK), math.ceil(n_queries / QUERIES)
    groups = max(1, min(lots, GROUPS))
    cut = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, blocks))))
    index = scratch.save(cut.repartition(F.col("block")).sortWithinPartitions("block").mapInArrow(_blocks(width or 0), _INDEX), "index")
    lot = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(max(1, lots)))
    queries = rows.filter(asked).groupBy(lot.alias("lot")).agg(F.collect_list(F.struct("vec_id", "v")).alias("queries"))
    queries = queries.select((F.col("lot") % groups).cast("int").alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, blocks - 1)).cast("long"))).alias("block"), "queries")
    index = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    cells = index.withColumn("later", F.lit(False)).unionByName(queries.withColumn("later", F.lit(True)), allowMissingColumns=True)
    found = cells.repartition("block", "part").sortWithinPartitions("block", "part", "later").mapInArrow(_search(k, width or 0), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scratch.keep(found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
