"""Shards of near equal bytes by histogram sort, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .scratch import Scratch, unused

#: A splitter is good if it is off by at most this share of a shard's bytes.
TOLERANCE = 0.001
#: Bits that a round of probes tells apart.
BITS = 10


def _probe(rows: DataFrame, weight: str, tie: Column | None, key: Column, top: int, targets: list[tuple[float, object, float]], tolerance: float) -> tuple[list, list]:
    """Narrow each target (bytes wanted below, tie value, bytes known below) on ``key``, unsigned of ``top`` bits.

    Each round sums bytes by candidate boundary for the prefixes that still hold a target, so what reaches
    the driver is bounded by targets and bits. Gives (target, tie, boundary) found and (target, tie, key,
    bytes below) where a single key holds the target.
    """
    found, held = [], []
    active = [(want, t, 0, below) for want, t, below in targets]  # with the prefix of the key so far
    left = top
    while active and left > 0:
        step = min(BITS, left)
        left -= step
        own = rows.select((tie if tie is not None else F.lit(0)).cast("long").alias("t"), F.shiftrightunsigned(key, left).alias("k"), F.col(weight).alias("w"))
        if left + step < top or tie is not None:
            wanted = rows.sparkSession.createDataFrame(sorted({(t, p) for _, t, p, _ in active}), "t long, p long")
            own = own.withColumn("p", F.shiftrightunsigned("k", step) if left + step < top else F.lit(0).cast("long")).join(F.broadcast(wanted), ["t", "p"])  # as many rows as targets at most
        sums: dict[tuple, dict[int, int]] = {}
        for r in own.groupBy("t", "k").agg(F.sum("w").alias("w")).collect():  # at most 2**BITS for each prefix
            sums.setdefault((r["t"], r["k"] >> step), {})[r["k"]] = r["w"]
        again = []
        for want, t, prefix, below in active:
            bins, ok = sorted(sums.get((t, prefix), {}).items()), False
            for k, w in bins:
                if abs(below - want) <= tolerance:
                    found.append((want, t, k << left))
                    ok = True
                    break
                if below + w > want:
                    if abs(below + w - want) <= tolerance and k + 1 < 1 << top - left:
                        found.append((want, t, (k + 1) << left))
                    elif left:
                        again.append((want, t, k, below))
                    else:
                        held.append((want, t, k, below, below + w))
                    ok = True
                    break
                below += w
            if not ok:
                found.append((want, t, None))  # nothing lies beyond it
        active = again
    return found, held


def splitters(rows: DataFrame, shards: int, k1: str = "k1", k2: str = "k2", size: str = "size", tolerance: float = TOLERANCE) -> list[tuple[int, int] | None]:
    """Boundaries (k1, k2) of the order by k1 and k2 at which the sums of ``size`` are nearly equal.

    k1 is an unsigned 63-bit number. Only where a single k1 holds more than the tolerance is its group cut, by k2.
    """
    low, high, total = rows.agg(F.min(k2), F.max(k2), F.sum(size)).first()
    total = total or 0
    allowed = tolerance * total / shards
    found, held = _probe(rows, size, None, F.col(k1), 63, [(total * j / shards, 0, 0) for j in range(1, shards)], allowed) if total else ([], [])
    out = {want: None if k is None else (k, None) for want, _, k in found}
    if held:
        width = max(1, (high - low).bit_length())
        cut, last = _probe(rows, size, F.col(k1), F.col(k2) - F.lit(low), width, [(want, k, below) for want, _, k, below, _ in held], allowed)
        out |= {want: (k, None if o is None else o + low) if o is not None else (k + 1, None) for want, k, o in cut}
        out |= {want: (k, o + low + (want - below > after - want)) for want, k, o, below, after in last}
    return [out[w] for w in sorted(out)]


def histogram_shard(docs: DataFrame, shards: int = 8, tolerance: float = TOLERANCE) -> DataFrame:
    """docs (doc_id, group, size, ...) with the columns shard and slot: law ``bytes``.

    The order is by a hash of ``group``, then by doc_id; rows of equal groups stay together but where a
    splitter must cut one. Candidate boundaries are refined until each splitter is within the tolerance of
    its share of ``size``; then rows are exchanged once, by range. ``slot`` is the place within the shard,
    gapless from 0. Null doc_ids sort as 0, null groups as one group; repeated rows each have a slot. Extra
    columns are carried along, whatever their names, but shard and slot, which are replaced. An empty table
    gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "sharding")
    docs = docs.drop("shard", "slot")
    k1, k2, part, place, first, before = (unused(docs, x) for x in ("sort_hash", "sort_id", "sort_part", "sort_place", "sort_first", "sort_before"))
    rows = docs.withColumns({k1: F.shiftrightunsigned(F.xxhash64("group"), 1), k2: F.coalesce("doc_id", F.lit(0)).cast("long")})
    rows = scratch.save(rows, "rows")
    shard = F.lit(0)
    for s in splitters(rows, shards, k1, k2, "size", tolerance):
        if s is not None:
            a, b = s
            shard = shard + (F.col(k1) >= a if b is None else (F.col(k1) > a) | ((F.col(k1) == a) & (F.col(k2) >= b))).cast("int")
    dealt = rows.withColumn("shard", shard).repartitionByRange("shard", k1, k2).sortWithinPartitions("shard", k1, k2)
    dealt = scratch.save(dealt.withColumns({part: F.spark_partition_id(), place: F.monotonically_increasing_id().bitwiseAND(2**33 - 1)}), "dealt")
    starts = dealt.groupBy("shard", part).agg(F.count("*").alias("n"), F.min(place).alias(first))
    starts = starts.withColumn(before, F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = dealt.join(F.broadcast(starts.drop("n")), ["shard", part])  # at most a row for each task and splitter
    out = out.withColumn("slot", F.col(before) + F.col(place) - F.col(first))
    return scratch.keep(out.drop(k1, k2, part, place, first, before))
