"""MinHash near-duplicate detection with exact confirmation.

Universal hash minima over word shingles, banded; bands propose links, signatures and then full sets
verify them; alternating large-star and small-star steps give the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .components import components
from .hashing import mix, shingle_sets, utf8
from .scratch import Scratch

#: 32 bands of 4 minima: a pair of similarity 0.8 shares no band with probability 4.7e-8.
BANDS, ROWS = 32, 4
#: Agreeing minima of 128 below which a pair isn't confirmed on full sets: 6.7 standard deviations under 0.8.
AGREE = 72
#: Members of one centre that one task group confirms; more are dealt over several.
MEMBERS = 256
#: Document ids up to which a lookup table is broadcast (8 bytes each); beyond, both sides are shuffled.
BROADCAST_IDS = 1_000_000
#: Documents up to which a shingle counts as rare: pairs that share it are listed, and it bounds what others share.
RARE = 8
#: Rows of a bucket on either side whose pairs one join key holds; the pairs of larger buckets are dealt over several.
CELL = 1024

_RNG = np.random.default_rng(7)
_A = _RNG.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)
_B = _RNG.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)
_C = _RNG.integers(1, 2**63, ROWS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the non-empty sets, and their minima under each hash: the upper half of ``a * x + b`` modulo 2**64.

    With random a and b, and x of 32 bits, the hashes of any two x are independent.
    """
    full = np.flatnonzero(np.diff(offsets))
    out = np.empty((len(full), BANDS * ROWS), dtype=np.uint32)
    lo = 0
    while lo < len(full):  # a stretch of sets at a time stays in cache
        hi = max(lo + 1, np.searchsorted(offsets, offsets[full[lo]] + 100_000, "right") - 1)
        hi = int(np.searchsorted(full, hi)) if hi > full[lo] else lo + 1
        hi = max(hi, lo + 1)
        x = (values[offsets[full[lo]] : offsets[full[hi - 1] + 1]] >> np.uint64(32))
        cut = offsets[full[lo:hi]] - offsets[full[lo]]
        for j in range(BANDS * ROWS):
            out[lo:hi, j] = np.minimum.reduceat(x * _A[j] + _B[j], cut) >> np.uint64(32)
        lo = hi
    return full, out


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                offsets, values = shingle_sets(utf8(part.column("text")), k)
                full, sig = signatures(values, offsets)
                n = part.num_rows
                wide = sig.astype(np.uint64).reshape(len(full), BANDS, ROWS)
                keys = np.zeros((len(full), BANDS), dtype=np.uint64)
                for i in range(ROWS):
                    keys += wide[:, :, i] * _C[i]
                keys = mix(keys + np.arange(BANDS, dtype=np.uint64) * _C[ROWS]).view(np.int64)
                sketch = ((sig * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
                mixed = mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5))
                prints = np.zeros((n, 2), dtype=np.uint64)
                if len(full):
                    prints[full, 0] = np.add.reduceat(values, offsets[full])
                    prints[full, 1] = np.add.reduceat(mixed, offsets[full])
                size = np.zeros(n, dtype=np.int64)
                size[full] = 1
                place = np.concatenate(([0], np.cumsum(size)))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()),
                        pa.array(np.diff(offsets)),
                        *(pa.array(prints[:, i].view(np.int64)) for i in (0, 1)),
                        pa.ListArray.from_arrays(pa.array((place * BANDS).astype(np.int32)), pa.array(keys.ravel())),
                        pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((place * sketch.shape[1]).astype(np.int32).tobytes()), pa.py_buffer(sketch.tobytes())]),
                    ],
                    ["doc_id", "n_shingles", "f1", "f2", "bands", "sketch"],
                )

    return run


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Agreeing minima of each pair, from one byte of each."""
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array((x == y).sum(axis=1).astype(np.int32))], ["a", "b", "agree"])


def _confirm(k: int, percent: int):
    """Rows in order of centre, salt and role: a centre's text, then its members' texts. Gives the true links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, centre = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                offsets, values = shingle_sets(utf8(part.column("text")), k)
                us, vs = [], []
                for i, (c, salt, role, d) in enumerate(zip(*(part.column(x).to_pylist() for x in ("centre", "salt", "role", "doc_id")), strict=True)):
                    own = values[offsets[i] : offsets[i + 1]]
                    if role == 0:
                        key, centre = (c, salt), own
                    elif key == (c, salt) and len(own) and len(centre):
                        both = np.concatenate((own, centre))
                        both.sort()
                        common = int((both[1:] == both[:-1]).sum())
                        if 100 * common >= percent * (len(both) - common):
                            us.append(c)
                            vs.append(d)
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return run


def _shingles(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                offsets, values = shingle_sets(utf8(part.column("text")), k)
                ids = np.repeat(part.column("doc_id").to_numpy(), np.diff(offsets))
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(ids)], ["s", "doc_id"])

    return run


def _among(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of df whose doc_id is among ids; ids are broadcast only while they are few."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def _estimated(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures agree often enough, with the count."""
    rows = pairs.join(sketches.select(F.col("doc_id").alias("a"), F.col("sketch").alias("sa")), "a").join(sketches.select(F.col("doc_id").alias("b"), F.col("sketch").alias("sb")), "b")
    return rows.select("a", "b", "sa", "sb").mapInArrow(_agree, "a long, b long, agree int").filter(F.col("agree") >= AGREE)


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (u, v) among the pairs (a: centre, b: member), by full sets. A centre of many members is dealt over salts."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).alias("parts"))
    members = pairs.join(parts, "a").select(F.col("a").alias("centre"), F.pmod(F.xxhash64("b"), F.col("parts")).alias("salt"), F.lit(1).alias("role"), F.col("b").alias("doc_id"))
    centres = parts.select(F.col("a").alias("centre"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("a").alias("doc_id"))
    rows = members.union(centres).join(texts, "doc_id").select("centre", "salt", "role", "doc_id", "text")
    rows = rows.repartition(F.col("centre"), F.col("salt")).sortWithinPartitions("centre", "salt", "role", "doc_id")
    return rows.mapInArrow(_confirm(k, percent), "u long, v long")


def _possible(named: DataFrame, texts: DataFrame, sketches: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of different components that share a bucket or a rare shingle and may still be similar.

    named: band, doc_id and component c of every document that a bucket of several components holds. A
    shingle of one document alone is shared with none; a document with too many of those can't have a link
    and goes. Pairs with a rare shingle in common are listed by it, at most ``RARE`` documents to a shingle.
    Any other pair shares no rare shingle, so the smaller number of common ones bounds its intersection;
    of a bucket, only pairs that this bound lets through are made. The bounds are exact.
    """
    docs = scratch.save(named.select("doc_id", "c").distinct(), "docs")
    shingles = scratch.save(texts.join(docs.select("doc_id"), "doc_id", "left_semi").mapInArrow(_shingles(k), "s long, doc_id long"), "shingles")
    rare = scratch.save(shingles.join(shingles.groupBy("s").agg(F.count("*").alias("n")).filter(F.col("n") <= RARE), "s"), "rare", (shingles,))
    counts = rare.groupBy("doc_id").agg(F.count("*").alias("rare"), F.count_if(F.col("n") == 1).alias("own"))
    able = docs.join(sketches.select("doc_id", "n_shingles"), "doc_id").join(counts, "doc_id", "left").fillna(0, ["rare", "own"])
    able = able.filter(100 * (F.col("n_shingles") - F.col("own")) >= percent * F.col("n_shingles"))
    able = scratch.save(able.select("doc_id", "c", F.col("n_shingles").alias("size"), (F.col("n_shingles") - F.col("rare")).alias("common")), "able")

    def side(df: DataFrame, x: str, *keys: str) -> DataFrame:
        return df.select(*(F.col(c).alias(f"{c}{x}") for c in keys), F.col("doc_id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("c", "size", "common")))

    def enough(shared: Column) -> Column:
        return 100 * shared >= percent * (F.col("size_a") + F.col("size_b") - shared)

    least = F.least("common_a", "common_b")
    posted = rare.filter("n > 1").select("s", "doc_id").join(able, "doc_id")
    both = side(posted, "a", "s").join(side(posted, "b", "s"), (F.col("sa") == F.col("sb")) & (F.col("a") < F.col("b")) & (F.col("c_a") != F.col("c_b")))
    listed = both.groupBy("a", "b", "size_a", "size_b", least.alias("most")).count().filter(enough(F.col("most") + F.col("count")))
    named = named.select("band", "doc_id").join(named.groupBy("doc_id").agg(F.collect_set("band").alias("bands")).join(able, "doc_id"), "doc_id")  # at most BANDS of them
    sizes = named.groupBy("band", "c").count().groupBy("band").agg(F.sum("count").alias("all"), F.max(F.struct("count", "c")).alias("most"))
    sizes = sizes.select("band", F.col("most.c").alias("main"), F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("most.count")) / CELL)).alias("high"), F.ceil(F.col("all") / CELL).alias("wide"))
    dealt = named.join(sizes, "band")
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    # the bucket's commonest component meets only the others; each pair meets in one cell of the bucket's square
    minor = dealt.filter("c <> main").withColumn("row", F.pmod(F.xxhash64("doc_id"), F.col("high"))).withColumn("column", spread("wide"))
    every = dealt.withColumn("column", F.pmod(F.xxhash64("doc_id"), F.col("wide"))).withColumn("row", spread("high"))
    minor, every = side(minor, "a", "band", "bands", "main", "row", "column"), side(every, "b", "band", "bands", "row", "column")
    apart = (F.col("c_a") != F.col("c_b")) & ((F.col("c_b") == F.col("maina")) | (F.col("a") < F.col("b")))
    once = F.array_min(F.array_intersect("bandsa", "bandsb")) == F.col("banda")  # of the buckets that a pair shares, one lists it
    near = minor.join(every, (F.col("banda") == F.col("bandb")) & (F.col("rowa") == F.col("rowb")) & (F.col("columna") == F.col("columnb")) & apart & enough(least) & once)
    return near.select("a", "b").union(listed.select("a", "b")).distinct()


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs (doc_id, text): n_shingles, component_id, kept.

    Texts with 100 * |A & B| >= percent * |A | B| are linked, A and B being their sets of word shingles;
    component_id is the smallest doc_id reachable and kept marks that document. A null or wordless text has
    an empty set and no links. A null doc_id has a null component_id and is kept. Rows that repeat a doc_id
    are expected to repeat its text; each is returned. Other columns are ignored. An empty table gives an
    empty result.

    Equal sets are folded into the smallest doc_id first. Then each document is tried against the best
    centre among its buckets, which joins the large groups; after that only documents of different
    components within a bucket remain, and each pair of those that may be similar is tried, so no link between
    components is lost but by the bands' own odds.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-duplicates")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = scratch.save(docs.mapInArrow(_sign(shingle_words), "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, sketch binary"), "signed")
    usable = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    same = usable.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    same = scratch.save(same.filter("copies > 1").drop("copies"), "same")
    owner = scratch.save(signed.select("doc_id", "n_shingles", "f1", "f2").join(same, ["f1", "f2", "n_shingles"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep")), "owner")
    spare = owner.filter("doc_id <> rep").select("doc_id")
    reps = without(usable, spare)

    rows = reps.select("doc_id", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.min("doc_id").alias("centre"), F.count("*").alias("n")).filter("n > 1").drop("n")
    members = scratch.save(rows.join(shared, "band").distinct(), "members")
    ids = scratch.save(members.select("doc_id").distinct(), "ids")
    texts = scratch.save(_among(docs, ids).dropDuplicates(["doc_id"]), "texts")
    sketches = scratch.save(_among(reps.select("doc_id", "n_shingles", "sketch"), ids).dropDuplicates(["doc_id"]), "sketches")

    pairs = members.filter("doc_id <> centre").select(F.col("centre").alias("a"), F.col("doc_id").alias("b")).distinct()
    stars = scratch.save(_estimated(pairs, sketches), "stars")
    best = stars.groupBy("b").agg(F.max(F.struct("agree", (-F.col("a")).alias("a"))).alias("best")).select((-F.col("best.a")).alias("a"), "b")
    links = scratch.save(_confirmed(best, texts, shingle_words, percent), "links")
    found = scratch.save(components(links, scratch), "found")
    tried = best
    # then the remaining centres, between components
    def apart(p: DataFrame, c: DataFrame) -> DataFrame:
        named = [c.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in ("a", "b")]
        return p.join(named[0], "a", "left").join(named[1], "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    second = scratch.save(apart(stars.select("a", "b"), found).join(tried, ["a", "b"], "left_anti"), "second")
    links = scratch.save(links.union(_confirmed(second, texts, shingle_words, percent)), "links")
    found = scratch.save(components(links, scratch), "found")
    # then the pairs of different components
    named = scratch.save(members.select("band", "doc_id").join(found, F.col("node") == F.col("doc_id"), "left").select("band", "doc_id", F.coalesce("component", "doc_id").alias("c")), "named")
    mixed = named.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("band")
    named = scratch.save(named.join(mixed, "band"), "mixed")
    rest = _possible(named, texts, sketches, shingle_words, percent, scratch)
    rest = rest.join(stars.select("a", "b"), ["a", "b"], "left_anti").join(stars.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
    rest = scratch.save(_estimated(rest, sketches), "rest")
    links = links.union(scratch.save(_confirmed(rest.select("a", "b"), texts, shingle_words, percent), "more"))
    found = components(links, scratch)

    out = owner.join(found, F.col("node") == F.col("rep"), "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    return scratch.keep(out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")))


def without(docs: DataFrame, spare: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id isn't in spare; rows of null doc_id stay."""
    few = spare.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(spare) if few else spare, "doc_id", "left_anti")
