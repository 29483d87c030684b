"""Phrase collocations by best-first branch-and-bound growth.

A phrase grows word by word from its first one. Cutting off the first word shows that no phrase scores above
1000 * n / f(w) of its first word w, nor of its last: its count is at most that of what follows the cut. So words are
expanded from the rarest on, in steps; after each one the score of each language's last place is compared with the
bound of the words that are left, and a language is settled once its bound is lower. Within a step, prefixes that
occur often enough are extended by a word at a time. What is cut off is proven not to matter, nothing else is.

Words are fingerprints of 64 bits; the corpus is encoded once, as runs of words that are frequent enough. Each level
counts fingerprints of phrases first, so that counts of what is rare are a number a phrase; phrases whose fingerprint
is frequent are then counted by their words, exactly. Sets of fingerprints reach the tasks as bitmaps of a fixed size,
where a false hit only costs a count.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .hashing import blocks, mix, powers, prefix_hash, utf8
from .scratch import Scratch

#: Words of a phrase at most, phrases of a language that are returned, occurrences of a phrase at least.
LONGEST, TOP, LEAST = 5, 2000, 100
#: Shares of the words that may be expanded after each step.
STEPS = (0.25, 0.5, 1.0)
#: Bits (as a power of two) of a set of fingerprints, fingerprints that a task counts, and texts and bytes of them that it codes at a time.
BITS, HELD, ROWS, BLOCK = 25, 1 << 18, 256, 1 << 18
#: Codes of a stored row: that before the first start, the starts, and what their phrases need behind the last. Readers hold thousands of rows at a time.
WIDE = 256
STARTS = WIDE - 1 - LONGEST
_STEP = np.random.default_rng(12).integers(1, 2**63, LONGEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_GAP, _BREAK = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_GAP[[0x20, 0x09]] = True
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORDS = [f"w{i}" for i in range(1, LONGEST + 1)]
_STATS = ["c", "left_min", "left_max", "right_min", "right_max"]
_KINDS = ", ".join(f"{x} long" for x in [*_WORDS, *_STATS])


def words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start, end and number of the piece of each word of a lower-cased text, worked on in parts that end at a gap."""
    a, at, piece = np.frombuffer(text, dtype=np.uint8), 0, 0
    found: list[tuple[np.ndarray, ...]] = []
    while at < len(a):
        size = 1 << 20
        while True:
            part = a[at : at + size]
            gap = _GAP[part] | _BREAK[part]
            if at + size >= len(a) or gap.any():
                break
            size *= 2
        if at + size < len(a):
            end = int(np.flatnonzero(gap)[-1]) + 1
            part, gap = part[:end], gap[:end]
        edge = np.diff(np.concatenate(([True], gap, [True])).astype(np.int8))
        lo, hi = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        c, cuts = prefix_hash(part), np.flatnonzero(_BREAK[part])
        found.append((mix((c[hi] - c[lo]) * powers(len(part))[1][lo]), lo + at, hi + at, np.searchsorted(cuts, lo) + piece))
        at, piece = at + len(part), piece + len(cuts)
    if not found:
        return np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _coded(whole: pa.RecordBatch) -> Iterator[tuple]:
    """For stretches of documents: their text, codes of the words (with the language), starts, ends, pieces and languages."""
    for top in range(0, whole.num_rows, ROWS):
        batch = whole.slice(top, ROWS)
        texts, langs = utf8(batch.column("text")), utf8(batch.column("lang"))
        seed = {x: int(mix(mix(prefix_hash(np.frombuffer(x, dtype=np.uint8))[-1:]) + _STEP[:1])[0]) for x in set(langs)}  # unlike a word's hash
        seeds, langs = np.array([seed[x] for x in langs], dtype=np.uint64), np.array(langs, dtype=object)
        for lo, hi in blocks(texts, BLOCK):
            joined = b"\n".join(texts[lo:hi]).lower()
            h, start, end, piece = words(joined)
            at = np.cumsum([0, *(len(t) + 1 for t in texts[lo : hi - 1])])
            doc = np.searchsorted(at, start, "right") - 1 + lo
            yield joined, np.maximum(mix(h ^ seeds[doc]), np.uint64(1)), start, end, piece, langs[doc]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, code, word, c) of the words of each stretch."""
    for batch in batches:
        for joined, code, start, end, _, lang in _coded(batch):
            if not len(code):
                continue
            own, first, count = np.unique(code, return_index=True, return_counts=True)
            names = [joined[a:b].decode() for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x.decode() for x in lang[first]]), pa.array(own.view(np.int64)), pa.array(names), pa.array(count)], ["lang", "code", "word", "c"])


def _in(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = x >> np.uint64(64 - BITS)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _encoded(frequent: Broadcast):
    """Runs of frequent words of a stretch, 0 between them, in rows of WIDE codes that overlap; words without a neighbour are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, code, _, _, piece, _ in _coded(batch):
                new = np.cumsum(np.concatenate(([False], piece[1:] != piece[:-1]))) if len(code) else np.empty(0, np.int64)
                out = np.zeros(len(code) + (int(new[-1]) if len(new) else 0) + 2, dtype=np.uint64)
                out[np.arange(len(code)) + new + 1] = np.where(_in(frequent.value, code), code, np.uint64(0))
                full = out != 0
                alone = full[1:-1] & ~full[:-2] & ~full[2:]
                out[1:-1][alone] = 0
                full = out != 0
                out = out[1:][full[1:] | full[:-1]]
                if len(out):
                    n = -(-len(out) // STARTS)
                    x = np.concatenate((np.zeros(1, np.uint64), out, np.zeros(n * STARTS - len(out) + LONGEST, np.uint64)))
                    x = np.lib.stride_tricks.sliding_window_view(x, WIDE)[::STARTS].reshape(-1)
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * WIDE), pa.array(x.view(np.int64)))], ["codes"])

    return run


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """Codes of k places, with the code before the first place and those up to the end of the last one's phrases; and which are starts."""
    own = np.zeros(WIDE, dtype=bool)
    own[1 : 1 + STARTS] = True
    for lo in range(0, batch.num_rows, HELD // WIDE):
        v = batch.column("codes").slice(lo, HELD // WIDE).flatten().to_numpy().view(np.uint64)
        k = len(v) - 1 - LONGEST
        yield v, k, np.tile(own, len(v) // WIDE)[1 : 1 + k]


def _gram(v: np.ndarray, k: int, m: int, off: int = 0) -> np.ndarray:
    """Fingerprints of the m words from each start, or from ``off`` words later."""
    s = np.zeros(k, dtype=np.uint64)
    for j in range(m):
        s += v[1 + off + j : 1 + off + j + k] * _STEP[j]
    return mix(s)


def _full(v: np.ndarray, k: int, m: int) -> np.ndarray:
    out = v[1 : 1 + k] != 0
    for j in range(1, m):
        out &= v[1 + j : 1 + j + k] != 0
    return out


def _level(m: int, new: Broadcast, open_: Broadcast, often: Broadcast):
    """(h, c): counts of fingerprints of m words that start with a new word, whose known parts are frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def made() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])

        for batch in batches:
            for v, k, own in _stretches(batch):
                fit = own & _full(v, k, m) & _in(new.value, v[1 : 1 + k])
                if m > 2:
                    fit &= _in(often.value, _gram(v, k, m - 1))
                    fit &= ~_in(open_.value, v[2 : 2 + k]) | _in(often.value, _gram(v, k, m - 1, 1))
                held.append(_gram(v, k, m)[fit])
                if sum(map(len, held)) >= HELD:
                    yield made()
                    held = []
        if sum(map(len, held)):
            yield made()

    return run


def _phrases(wanted: Broadcast, new: Broadcast | None):
    """Phrases by their words, counts and the least and greatest neighbours on both sides (0: none); new: of first words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for v, k, starts in _stretches(batch):
                for m in range(2, LONGEST + 1):
                    fit = starts & _full(v, k, m) & _in(wanted.value, _gram(v, k, m))
                    at = np.flatnonzero(fit & _in(new.value, v[1 : 1 + k]) if new else fit)
                    if not len(at):
                        continue
                    own = [v[1 + at + j].view(np.int64) for j in range(m)]
                    order = np.lexsort(own[::-1])
                    own, at = [x[order] for x in own], at[order]
                    first = np.flatnonzero(np.concatenate(([True], np.logical_or.reduce([x[1:] != x[:-1] for x in own]))))
                    sides = [v[at].view(np.int64), (v[1 + at + m] if m < LONGEST else np.zeros(len(at), np.uint64)).view(np.int64)]
                    stats = [np.diff(np.append(first, len(at))), *(f.reduceat(x, first) for x in sides for f in (np.minimum, np.maximum))]
                    columns = [x[first] for x in own] + [np.zeros(len(first), np.int64)] * (LONGEST - m) + stats
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], [*_WORDS, *_STATS])

    return run


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases of w1 to w5 (0: none) to the fingerprints that _gram gives them."""
    for batch in batches:
        s = np.zeros(batch.num_rows, dtype=np.uint64)
        for j, w in enumerate(_WORDS):
            s += batch.column(w).to_numpy().view(np.uint64) * _STEP[j]
        yield pa.RecordBatch.from_arrays([pa.array(mix(s).view(np.int64))], ["h"])


def _bits(rows: DataFrame, column: str) -> np.ndarray:
    """A set of fingerprints as a bitmap, put together by Spark; the driver gets its words that aren't 0."""
    at = F.shiftrightunsigned(column, 64 - BITS)
    one = rows.groupBy(F.shiftright(at, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(shiftrightunsigned({column}, {64 - BITS}) & 63 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), dtype=np.uint64)
    out[one.column("at").to_numpy()] = one.column("bits").to_numpy().view(np.uint64)
    return out


@contextmanager
def _shared(spark: SparkSession, bits: np.ndarray) -> Iterator[Broadcast]:
    """A bitmap that tasks can read until the end of the block."""
    sent = spark.sparkContext.broadcast(bits.copy())
    try:
        yield sent
    finally:
        sent.destroy()


def _part(lo: int, hi: int) -> Column:
    """Words lo to hi - 1 of a phrase as a struct of LONGEST, 0 behind them."""
    return F.struct(*(F.col(_WORDS[lo + j]).alias(w) if lo + j < hi else F.lit(0).cast("long").alias(w) for j, w in enumerate(_WORDS)))


def scored(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """Phrases (w1 to w5, m, c, n) with k, l, r and score of their lowest-scoring cut; counts: of all parts."""
    cuts = phrases.select(*_WORDS, "m", "c", "n", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    sides = []
    for side in ("l", "r"):
        part = None
        for m in range(2, LONGEST + 1):
            for k in range(1, m):
                here = (F.col("m") == m) & (F.col("k") == k)
                value = _part(0, k) if side == "l" else _part(k, m)
                part = F.when(here, value) if part is None else part.when(here, value)
        sides.append(part.alias(side))
    parts = cuts.select(*_WORDS, "m", "c", "n", "k", *sides)
    known = counts.select(F.struct(*_WORDS).alias("part"), F.col("c").alias("count"))
    for side in ("l", "r"):
        parts = parts.join(known.select(F.col("part").alias(side), F.col("count").alias(f"n_{side}")), side)
    score = F.expr("(CAST(1000 AS DECIMAL(4,0)) * CAST(c AS DECIMAL(16,0)) * CAST(n AS DECIMAL(17,0))) div (CAST(n_l AS DECIMAL(18,0)) * CAST(n_r AS DECIMAL(18,0)))")
    best = F.min(F.struct(score.alias("score"), "k", F.col("n_l").alias("l"), F.col("n_r").alias("r"))).alias("best")
    return parts.groupBy(*_WORDS).agg(best).select(*_WORDS, "best.*")


def mine(docs: DataFrame, top: int = TOP, least: int = LEAST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to LONGEST words.

    docs has text and lang. A-Z are lower-cased; texts are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these at
    blanks and tabs into words. Null texts are empty, a null lang is ``und``; a text of no words adds nothing and a
    language of no candidates has no rows. Repeated rows count each time. Candidates occur ``least`` times or more. A
    candidate is dropped if all its occurrences have the same word in front of them, or behind, so that a longer
    candidate has them all. Ties in score and count are ordered by the phrase's bytes. Extra columns are ignored; an
    empty table gives an empty result.

    Counts are summed before and behind the shuffles; no task holds a document's phrases but of HELD starts, nor more
    of the stored runs than a batch of rows of WIDE codes, however long texts and parts of the corpus are.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "collocations")
    docs = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    every = scratch.save(docs.mapInArrow(_counted, "lang string, code long, word string, c long").groupBy("lang", "code", "word").agg(F.sum("c").alias("c")), "every")
    if every.groupBy("code").agg(F.count("*").alias("words"), F.sum("c").alias("c")).filter((F.col("words") > 1) & (F.col("c") >= least)).limit(1).count():
        raise ValueError("two words have the same fingerprint")
    total = every.groupBy("lang").agg(F.sum("c").alias("n"))
    vocabulary = scratch.save(every.filter(F.col("c") >= least), "vocabulary")
    with _shared(spark, _bits(vocabulary, "code")) as frequent:
        encoded = scratch.save(docs.mapInArrow(_encoded(frequent), "codes array<bigint>"), "encoded")
    band = vocabulary.groupBy("lang", F.floor(F.log2("c") * 4).alias("band")).agg(F.sum("c").alias("c"), F.max("c").alias("top"))
    by_band = Window.partitionBy("lang").orderBy("band")
    band = band.withColumn("up", F.sum("c").over(by_band) / F.sum("c").over(Window.partitionBy("lang")))
    limits = [F.coalesce(F.max(F.when(F.col("up") <= s, F.col("top"))), F.lit(0)).cast("long").alias(f"limit{i}") for i, s in enumerate(STEPS)]
    plan = scratch.save(band.groupBy("lang").agg(*limits).join(total, "lang"), "plan", (every,))

    one = [F.col("code").alias("w1"), *(F.lit(0).cast("long").alias(w) for w in _WORDS[1:])]
    single = vocabulary.select(*one, "c")
    names = vocabulary.select("lang", "code", F.col("c").alias("f"))
    open_ = np.zeros(1 << (BITS - 6), dtype=np.uint64)
    often = open_.copy()
    grown: DataFrame | None = None  # phrases by words, with counts and neighbours
    parts: DataFrame | None = None  # counts of what follows a cut, where its own first word isn't expanded
    ranked: DataFrame | None = None
    unsettled = plan.select("lang")
    sums = [F.sum("c").alias("c"), *((F.min if x.endswith("min") else F.max)(x).alias(x) for x in _STATS[1:])]
    for step in range(len(STEPS)):
        limit, before = F.col(f"limit{step}"), F.col(f"limit{step - 1}") if step else F.lit(0)
        new = scratch.save(names.join(plan, "lang").join(unsettled, "lang", "left_semi").filter((F.col("f") > before) & (F.col("f") <= limit)).select("code"), "new")
        fresh = _bits(new, "code")
        if not fresh.any():
            continue
        open_ |= fresh
        with _shared(spark, fresh) as first:
            for m in range(2, LONGEST + 1):
                with _shared(spark, open_) as opened, _shared(spark, often) as known:
                    counted = encoded.mapInArrow(_level(m, first, opened, known), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
                    hits = _bits(scratch.save(counted.filter(F.col("c") >= least).select("h"), "hits"), "h")
                often |= hits
                if not hits.any():
                    break
            with _shared(spark, often) as wanted:
                found = encoded.mapInArrow(_phrases(wanted, first), _KINDS).groupBy(*_WORDS).agg(*sums).filter(F.col("c") >= least)
                found = scratch.save(found.join(new.withColumnRenamed("code", "w1"), "w1", "left_semi").select(*_WORDS, *_STATS), "phrases")
        grown = found if grown is None else grown.union(found)
        m, last = F.lit(0), F.lit(None)
        for i, w in enumerate(_WORDS):
            m = F.when(F.col(w) != 0, i + 1).otherwise(m)
            last = F.when(F.col(w) != 0, F.col(w)).otherwise(last)
        ends = names.select("lang", F.col("code").alias("last"), "f").join(plan, "lang").filter(F.col("f") <= limit).select("lang", "last", "n", (F.floor(F.expr(f"CAST(1000 AS DECIMAL(4,0)) * CAST(n AS DECIMAL(17,0)) div (limit{step} + 1)"))).cast("long").alias("bound"))
        candidates = scratch.save(grown.withColumn("m", m).withColumn("last", last).join(ends, "last").drop("last"), "candidates")
        tails = None
        for size in range(3, LONGEST + 1):
            for k in range(1, size - 1):
                tail = candidates.filter(F.col("m") == size).select(_part(k, size).alias("p")).select("p.*")
                tails = tail if tails is None else tails.union(tail)
        done = grown.select(*_WORDS) if parts is None else grown.select(*_WORDS).union(parts.select(*_WORDS))
        missing = scratch.save(tails.distinct().join(done, _WORDS, "left_anti"), "missing")
        asked = _bits(missing.mapInArrow(_fingerprints, "h long"), "h")
        if asked.any():
            with _shared(spark, asked) as wanted:
                more = encoded.mapInArrow(_phrases(wanted, None), _KINDS).groupBy(*_WORDS).agg(F.sum("c").alias("c"))
                more = scratch.save(more.join(missing, _WORDS, "left_semi").select(*_WORDS, "c"), "parts")
            parts = more if parts is None else parts.union(more)
        counts = single.union(grown.select(*_WORDS, "c"))
        counts = counts if parts is None else counts.union(parts)
        inside = (F.col("m") < LONGEST) & (((F.col("left_min") == F.col("left_max")) & (F.col("left_min") != 0)) | ((F.col("right_min") == F.col("right_max")) & (F.col("right_min") != 0)))
        ranked = scratch.save(candidates.join(scored(candidates, counts), _WORDS).filter(~inside), "ranked")
        done = ranked.filter(F.col("score") > F.col("bound")).groupBy("lang").count().filter(F.col("count") >= top)
        unsettled = plan.select("lang").join(done, "lang", "left_anti")
        # a settled language keeps its phrases; later steps only add such as can't reach its places
    if ranked is None:
        return spark.createDataFrame([], "lang string, rank int, phrase string, a long, l long, r long, n long, score long")
    place = F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("c")))
    kept = ranked.withColumn("place", place).filter(F.col("place") <= top)
    spoken = kept.select("lang", *_WORDS, F.posexplode(F.array(*_WORDS)).alias("i", "code")).filter("code <> 0")
    spoken = spoken.join(vocabulary.select("code", "word"), "code").groupBy("lang", *_WORDS).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x.word), " ").alias("phrase"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("c"), "phrase"))
    out = kept.join(spoken, ["lang", *_WORDS]).withColumn("rank", rank).filter(F.col("rank") <= top)
    return scratch.keep(out.select("lang", F.col("rank").cast("int").alias("rank"), "phrase", F.col("c").alias("a"), "l", "r", "n", "score"))
