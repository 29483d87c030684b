"""Toxic passages as maximum-scoring segments of token log-odds.

Every word of the labelled texts has signed log-odds with a Dirichlet prior, shrunk by how far they may be chance;
words that are seldom seen take those of their beginning. A linear scan finds every maximal segment of a text; the
segments' scores are judged by the extreme-value law of such maxima in clean texts, and a logistic curve maps what
a text's segments have beyond chance in all, and its mean log-odds (not shrunk, negative ones too), to the label.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .decontaminate import WORD, normal
from .hashing import utf8
from .scratch import Scratch

#: Labelled texts of each class that the fit reads at most, those of the least hashes. All else is fitted on every one of them.
SAMPLE = 20_000
#: Weight of the prior in texts, and standard deviations up to which log-odds count as chance and are shrunk to 0.
PRIOR, SHRINK = 30.0, 3.0
#: Texts from which a word is known by itself, and lengths of the beginnings that stand for other words.
ATTESTED, PREFIXES = 8, (6, 5, 4)
#: What a passage must outweigh for each of its words, and expected segments by chance above which one isn't significant.
DRIFT, EXPECT = 0.5, 0.01
#: Least factor of each number in the curve, and words that a task keeps in mind.
RANK, HELD = 0.1, 50_000
SCHEMA = "doc_id long, score double, predicted int, passages array<struct<start:int,end:int,bits:double>>"


def beginnings(word: str) -> list[str]:
    return [word[:n] + "*" for n in PREFIXES if len(word) > n]


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in one pass.

    Each open candidate holds the sum before it and the sum up to its end; a new one joins the nearest
    earlier candidate that began lower and ended lower.
    """
    total = 0.0
    open_: list[list[float]] = []
    for i, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        new, total = [i, i + 1, total, total + s], total + s
        while True:
            j = len(open_) - 1
            while j >= 0 and open_[j][2] >= new[2]:
                j = int(open_[j][4])
            if j < 0 or open_[j][3] >= new[3]:
                open_.append([*new, j])
                break
            new = [open_[j][0], new[1], open_[j][2], new[3]]
            del open_[j:]
    return [(int(a), int(b), r - l) for a, b, l, r, _ in open_]


@dataclass
class Model:
    """Log-odds of words and beginnings, shrunk and as they are; of each also those without one text of class 0 or 1, for texts that the model was fitted on."""

    weights: list[dict[str, tuple[float, float]]]
    decay: float = 1.0
    scale: float = 1.0
    curve: tuple[float, float, float] = (1.0, 0.0, -2.0)
    held: list[dict[str, tuple[float, float]]] = field(default_factory=lambda: [{}, {}, {}])

    def weight(self, word: str, own: int) -> tuple[float, float]:
        table = self.weights[own]
        found = table.get(word)
        if found is None:
            found = next((x for b in beginnings(word) if (x := table.get(b)) is not None), (0.0, 0.0))
        return found

    def odds(self, words: list[str], own: int = 2) -> list[tuple[float, float]]:
        """Both log-odds of each word; own is the class of a text of the sample, whose own part in them is left out."""
        held = self.held[own]
        if len(held) > HELD:
            held.clear()
        out = []
        for w in words:
            x = held.get(w)
            if x is None:
                x = held[w] = self.weight(w, own)
            out.append(x)
        return out

    def judge(self, words: list[str], own: int = 2) -> tuple[float, float, list[tuple[int, int, float]]]:
        """Bits beyond chance of all segments, mean log-odds, and the significant segments: first and last word and bits."""
        odds = self.odds(words, own)
        noise = math.log(self.scale * max(1, len(words)))
        found = [(a, b, self.decay * s - noise) for a, b, s in segments([x - DRIFT for x, _ in odds])] if odds and max(odds)[0] > DRIFT else []
        return sum(bits for _, _, bits in found if bits > 0), sum(x for _, x in odds) / (len(odds) + 10), [x for x in found if x[2] > -math.log(EXPECT)]

    def score(self, bits: float, mean: float) -> float:
        x = self.curve[0] * math.log1p(bits) + self.curve[1] * mean + self.curve[2]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text and toxic of a bounded sample; at most twice SAMPLE ids are broadcast."""
    ids = None
    for kind in (0, 1):
        own = labels.filter(F.col("toxic") == kind).select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(kind).alias("toxic")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        ids = own if ids is None else ids.union(own)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id").dropDuplicates(["text", "toxic"])  # a copy tells nothing new


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in which each word and beginning occurs, by class, with the least and greatest word of each; summed as far as HELD features go."""
    texts: dict[int, Counter] = {0: Counter(), 1: Counter()}

    def made() -> pa.RecordBatch:
        keys = sorted({*texts[0], *texts[1]})
        low, high = {}, {}
        for w in keys:
            for b in (w, *beginnings(w)) if not w.endswith("*") else ():
                low.setdefault(b, w)
                high[b] = w
        columns = [pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in (texts[0], texts[1])), *(pa.array([c.get(k) for k in keys], pa.string()) for c in (low, high))]
        for c in texts.values():
            c.clear()
        return pa.RecordBatch.from_arrays(columns, ["feature", "d0", "d1", "low", "high"])

    for batch in batches:
        for kind, text in zip(batch.column("toxic").to_pylist(), utf8(batch.column("text")), strict=True):
            words = set(WORD.findall(normal(text)))
            texts[kind].update(words | {b for w in words for b in beginnings(w)} | {""})
            if len(texts[0]) + len(texts[1]) > HELD:
                yield made()
    yield made()


def log_odds(d0: Column, d1: Column, n0: int, n1: int) -> tuple[Column, Column]:
    """Log-odds of being in a text of class 1 against 0, with a Dirichlet prior of PRIOR texts, by the share of all
    texts: shrunk towards 0 by the square of SHRINK over the likelihood ratio's standard deviations, and plain."""
    both = d0 + d1
    prior = F.lit(PRIOR) * both / max(1, n0 + n1)
    odds = [F.log((d + prior) / (n + PRIOR + 1 - d - prior)) for d, n in ((d1, n1), (d0, n0))]
    gain = [F.when(d > 0, d * F.log(F.try_divide(d * (n0 + n1), both * n))).otherwise(0.0) for d, n in ((d1, n1), (d0, n0))]
    shrunk = F.greatest(F.lit(0.0), 1 - F.lit(SHRINK**2) / F.greatest(F.lit(1e-9), 2 * (gain[0] + gain[1])))
    plain = F.when((both > 0) & (d0 >= 0) & (d1 >= 0), odds[0] - odds[1]).otherwise(0.0)
    return F.coalesce(plain * shrunk, F.lit(0.0)), plain


def _weights(counts: DataFrame, n: list[int]) -> list[dict[str, tuple[float, float]]]:
    """Of features without one text of class 0, without one of class 1, and with all; as many as a bounded sample has words."""
    d0, d1 = F.col("d0"), F.col("d1")
    own = [log_odds(d0 - 1, d1, n[0] - 1, n[1]), log_odds(d0, d1 - 1, n[0], n[1] - 1), log_odds(d0, d1, *n)]
    word = ~F.col("feature").endswith("*")
    rows = counts.filter("feature <> ''").select("feature", (word & (d0 + d1 >= ATTESTED)).alias("known"), (word | (F.col("low") < F.col("high"))).alias("fit"), *(F.round(x, 6).alias(f"w{i}") for i, (x, _) in enumerate(own)), *(F.round(x, 6).alias(f"p{i}") for i, (_, x) in enumerate(own)))
    rows = rows.filter("fit AND (known OR w0 <> 0 OR w1 <> 0 OR w2 <> 0)").collect()
    return [{r["feature"]: (r[f"w{i}"], r[f"p{i}"] if r["known"] else r[f"w{i}"]) for r in rows if r["known"] or r[f"w{i}"]} for i in range(3)]


def _root(law: dict[float, float]) -> float:
    """The positive root of sum p * exp(x * s) = 1; the mean of s is negative."""
    mean = lambda x: sum(p * math.exp(min(600.0, x * s)) for s, p in law.items()) / sum(law.values())
    lo, hi = 0.0, 1.0
    while mean(hi) < 1 and hi < 64:
        lo, hi = hi, 2 * hi
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mean(mid) < 1 else (lo, mid)
    return max(hi, 0.05)


def _curve(x: np.ndarray, y: np.ndarray, k: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression on two numbers and a constant, by Newton steps with a little shrinkage.

    Neither number may count against the label: a factor below RANK is set to it, so that texts that the
    segments don't tell apart are still ranked.
    """
    x = np.column_stack([x, np.ones(len(x))])
    ridge, out, free = np.array([0.1, 0.1, 0.01]), np.array([1.0, 0.0, -1.0]), np.array([True, True, True])
    while True:
        z, w, fixed = x[:, free], out[free], x[:, ~free] @ out[~free]
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(z @ w + fixed, -30, 30)))
            step = np.clip(np.linalg.solve((z * (k * p * (1 - p))[:, None]).T @ z + np.diag(ridge[free]), z.T @ (k * (p - y)) + ridge[free] * w), -1, 1)
            w = w - step
            if abs(step).max() < 1e-9:
                break
        out[free] = w
        low = free[:2] & (out[:2] < RANK)
        if not low.any():
            return tuple(float(round(v, 9)) for v in out)
        out[:2][low], free[:2] = RANK, free[:2] & ~low


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from labelled texts, toxic 0 or 1; None where either class is missing."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    try:
        sample = scratch.save(_sample(docs, labels), "sample")
        counts = sample.mapInArrow(_counts, "feature string, d0 long, d1 long, low string, high string").groupBy("feature").agg(*(F.sum(c).alias(c) for c in ("d0", "d1")), F.min("low").alias("low"), F.max("high").alias("high"))
        counts = scratch.save(counts, "counts")
        totals = counts.filter("feature = ''").first()
        if totals is None or not totals["d0"] or not totals["d1"]:
            return None
        model = Model(_weights(counts, [totals["d0"], totals["d1"]]))
        share = docs.sparkSession.sparkContext.broadcast(model)

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: Counter = Counter()
            for batch in batches:
                for kind, text in zip(batch.column("toxic").to_pylist(), utf8(batch.column("text")), strict=True):
                    if not kind:
                        found.update(round(x, 2) for x, _ in share.value.odds(WORD.findall(normal(text)), 0))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.float64()), pa.array(list(found.values()), pa.int64())], ["s", "n"])

        # chance: words of clean texts score as they do in the sample; a few hundred distinct scores
        seen = {r["s"]: r["n"] for r in sample.mapInArrow(clean, "s double, n long").groupBy("s").agg(F.sum("n").alias("n")).collect()} or {0.0: 1}
        n = sum(seen.values())
        model.decay = _root({s - DRIFT: c for s, c in seen.items()} | {1.0: seen.get(1.0 + DRIFT, 0) + 1.0})
        model.scale = max(sum(c for s, c in seen.items() if s > DRIFT), 1) / n
        every = docs.sparkSession.sparkContext.broadcast(model)

        def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds = batch.column("toxic").to_pylist()
                x = [every.value.judge(WORD.findall(normal(t)), k)[:2] for k, t in zip(kinds, utf8(batch.column("text")), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([math.log1p(b) for b, _ in x], pa.float64()), pa.array([m for _, m in x], pa.float64()), pa.array(kinds, pa.int32())], ["x", "m", "y"])

        # the curve reads at most twice SAMPLE rows of two numbers
        rows = sample.mapInArrow(judged, "x double, m double, y int").groupBy(F.round("x", 2).alias("x"), F.round("m", 3).alias("m"), "y").count().orderBy("x", "m", "y").collect()
        x, y, k = np.array([(r["x"], r["m"]) for r in rows]), np.array([r["y"] for r in rows], dtype=float), np.array([r["count"] for r in rows], dtype=float)
        mix = {r["toxic"]: r["n"] for r in labels.filter("toxic IN (0, 1)").groupBy(F.col("toxic").cast("int").alias("toxic")).agg(F.count_distinct("doc_id").alias("n")).collect()}
        whole = k.sum() / sum(mix.values())
        model.curve = _curve(x, y, k * np.where(y == 1, mix[1] * whole / k[y == 1].sum(), mix[0] * whole / k[y == 0].sum()))  # classes as in all labels
        return Model([{}, {}, model.weights[2]], model.decay, model.scale, model.curve)
    finally:
        scratch.clear()


def _judged(model: Model | None, texts: list[bytes]) -> tuple[list[float], list[list[dict]]]:
    scores, found = [], []
    for text in texts:
        low = normal(text)
        total, mean, own = model.judge(WORD.findall(low)) if model is not None else (0.0, 0.0, [])
        scores.append(model.score(total, mean) if model is not None else 0.0)
        place = [m.span() for m in WORD.finditer(low)] if own else []
        found.append([{"start": place[a][0], "end": place[b - 1][1], "bits": bits} for a, b, bits in own])
    return scores, found


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): score from 0 to 1, predicted (1 from 0.5), passages.

    ``labels`` (doc_id, toxic) are what the model may learn from. Passages are significant segments with
    their offsets in the text and bits beyond chance. Null and empty texts have no words and are scored as
    such; without labels of both classes every score is 0. Null labels are left out, rows that repeat are
    scored each, other columns are never read.
    """
    fitted = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, found = _judged(fitted.value, utf8(batch.column("text")))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("bits", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(found, kind)], ["doc_id", "score", "predicted", "passages"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with all their columns and ``predicted`` as above."""
    fitted = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, _ = _judged(fitted.value, utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([int(s >= 0.5) for s in scores], pa.int32())], [*batch.schema.names, "predicted"])

    rows = docs.drop("predicted")
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("predicted", T.IntegerType())]))


def held_out(doc_id):
    """Whether crc32 of doc_id as text is divisible by 5: rows that no model learns from."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0
