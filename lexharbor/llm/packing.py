"""Conflict-constrained best-fit packing of documents into training sequences."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Units that a bin holds.
CAPACITY = 8192
#: Rows that are packed together; the table is dealt by hash into blocks of about as many.
BLOCK_ROWS = 5000
#: Documents of one source that share a bin.
PER_SOURCE = 4
SCHEMA = "block long, doc_id long, piece long, bin long, start long, units long"


class Packer:
    """Bins in order of what is left in them; each carries bitmaps of its sources and duplicate clusters."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.order: list[tuple[int, int]] = []
        self.clusters: list[int] = []
        self.sources: list[list[int]] = []
        self.names: tuple[dict, dict] = ({}, {})

    def put(self, units: int, source: object, cluster: object) -> tuple[int, int]:
        """The bin and offset: the tightest that fits and conflicts with neither, or else a new one.

        A bin's source bitmaps count in unary: the n-th is set for sources that have n documents there.
        """
        s, c = (1 << kind.setdefault(x, len(kind)) for kind, x in zip(self.names, (source, cluster), strict=True))
        i = bisect_left(self.order, (units, -1))
        while i < len(self.order) and (self.clusters[b := self.order[i][1]] & c or self.sources[b][-1] & s):
            i += 1
        if i < len(self.order):
            left, b = self.order.pop(i)
        else:
            left, b = self.capacity, len(self.clusters)
            self.clusters.append(0)
            self.sources.append([0] * self.per_source)
        self.clusters[b] |= c
        for k in range(self.per_source):
            if not self.sources[b][k] & s:
                self.sources[b][k] |= s
                break
        if left - units:
            insort(self.order, (left - units, b))
        return b, self.capacity - left


def pack(docs: DataFrame, units: str = "units", source: str = "source", cluster: str = "cluster", capacity: int = CAPACITY, per_source: int = PER_SOURCE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows block, doc_id, piece, bin, start, units: where each piece of each document goes.

    Documents are dealt by a hash of doc_id into blocks of about ``block_rows`` rows, each packed by
    decreasing size, ties by doc_id. A document longer than a bin fills bins of its own and its rest is
    packed. No bin has two pieces of one cluster (of one document: neither), nor more than ``per_source``
    of one source. Null units count as 0 and take no room; null source and cluster are values of their own,
    but a null cluster conflicts with nothing else. Empty documents are one piece of 0 units. Repeated rows
    are packed each. Other columns are ignored; an empty table gives no rows.
    """
    blocks = max(1, -(-docs.count() // block_rows))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(units).cast("long"), F.lit(0)).alias("units"), F.col(source).cast("string").alias("source"), F.col(cluster).cast("string").alias("cluster"))
    spread = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())  # else all rows of null doc_id and one text meet
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "cluster", spread), F.lit(blocks)).cast("long"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        packer, out = Packer(capacity, per_source), []
        ids = [None if pd.isna(x) else int(x) for x in pdf["doc_id"]]
        entries = sorted(zip(ids, pdf["units"].tolist(), pdf["source"], pdf["cluster"], strict=True), key=lambda r: (-(r[1] % capacity or capacity * (r[1] > 0)), -r[1], r[0] is None, r[0] or 0))
        for n, (doc, size, src, own) in enumerate(entries):
            own = ("row", n) if own is None or own != own else own
            src = None if src != src else src
            for piece in range(max(1, -(-size // capacity))):
                length = min(capacity, size - piece * capacity)
                b, start = packer.put(length, src, own)
                out.append((key[0], doc, piece, b, start, length))
        frame = pd.DataFrame(out, columns=["block", "doc_id", "piece", "bin", "start", "units"])
        return frame.astype({"doc_id": "Int64"})

    return rows.groupBy("block").applyInPandas(run, SCHEMA)
