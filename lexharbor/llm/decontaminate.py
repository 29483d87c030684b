"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all items.

The automaton reads words, each as two characters of the item vocabulary's code, so a window is as long as its
words are many and not as they are long; words that no item has break every match.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from .hashing import utf8
from .scratch import Scratch

#: Consecutive item words that make a window.
WINDOW = 10
#: Item words that one automaton holds, at about 1 kB each (170,000 words of 30,000 types took 160 MB); larger
#: benchmarks are scanned for in several parts, one after the other. Words of an item that are dealt together.
AUTOMATON_WORDS, PIECE = 300_000, 10_000
WORD = re.compile("[0-9a-z\u0080-\U0010ffff]+")
_JAVA_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_HITS = "array<struct<item_id:bigint,first_word:int,last_word:int,start:int,end:int>>"
_KIND = pa.list_(pa.struct([("item_id", pa.int64()), *((x, pa.int32()) for x in ("first_word", "last_word", "start", "end"))]))


def normal(text: bytes) -> str:
    """A-Z lower-cased, offsets unchanged."""
    return text.lower().decode("utf-8", "replace")


class Windows:
    """Item windows as an automaton over the coded words of a text."""

    def __init__(self, pieces: list[tuple[int, list[str]]], size: int):
        import ahocorasick

        names = sorted({w for _, words in pieces for w in words})
        base = max(2, int(np.ceil(np.sqrt(len(names) + 1))))
        letters = [chr(0x100 + i) for i in range(base)]
        self.code = {w: letters[i // base] + letters[i % base] for i, w in enumerate(names)}
        owners: dict[str, set[int]] = {}
        for item, words in pieces:
            coded = [self.code[w] for w in words]
            for i in range(max(1, len(words) - size + 1) if words else 0):
                owners.setdefault("".join(coded[i : i + size]), set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for text, own in owners.items():
            self.automaton.add_word(text, (len(text) // 2, sorted(own)))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def _found(self, words: list[str]) -> Iterator[tuple[int, int, list[int]]]:
        """First and last word of each window's place, and the items that have it."""
        if not self.empty:
            get = self.code.get
            for end, (n, own) in self.automaton.iter("".join([get(w, "\0\0") for w in words])):
                if end % 2:  # else it ends within a word's code
                    yield end // 2 - n + 1, end // 2, own

    def any(self, text: bytes) -> bool:
        return next(self._found(WORD.findall(normal(text))), None) is not None

    def spans(self, text: bytes) -> tuple[int, list[dict]]:
        """The number of words, and the maximal runs of words that each item covers, with offsets in the original text."""
        low = normal(text)
        words = WORD.findall(low)
        by_item: dict[int, list[list[int]]] = {}
        for first, last, own in self._found(words):
            for item in own:
                runs, at = by_item.setdefault(item, []), first
                while runs and at <= runs[-1][1] + 1:
                    at = min(at, runs.pop()[0])
                runs.append([at, last])
        place = [m.span() for m in WORD.finditer(low)] if by_item else []
        return len(words), [{"item_id": k, "first_word": a, "last_word": b, "start": place[a][0], "end": place[b][1]} for k in sorted(by_item) for a, b in by_item[k]]


def _parts(items: DataFrame, window: int) -> Iterator[Broadcast]:
    """Pieces of the items' words, (item_id, words), in parts of bounded size. Long items are cut so that each window is whole in a piece."""
    words = F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(_JAVA_WORD), F.lit(0))
    own = items.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), words.alias("words"))
    cut = own.select("item_id", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(PIECE))).alias("at"))
    cut = cut.select("item_id", F.slice("words", F.col("at") + 1, PIECE + window - 1).alias("words")).filter(F.size("words") > 0).distinct()
    parts = max(1, -(-(cut.agg(F.sum(F.size("words"))).first()[0] or 0) // AUTOMATON_WORDS))
    for part in range(parts):
        rows = cut.filter(F.pmod(F.xxhash64("item_id", "words"), F.lit(parts)) == part).collect()  # of bounded size
        yield items.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in rows])


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs without any window of an item, with all their columns; null texts are clean."""
    for shared in _parts(items, window):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            windows = Windows(shared.value, window)
            for batch in batches:
                yield batch.filter(pa.array([not windows.any(t) for t in utf8(batch.column("text"))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def _scanned(rows: DataFrame, shared: Broadcast, window: int, row: str | None) -> DataFrame:
    """n_words and hits of each row; with a row id, rows without hits are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(shared.value, window)
        for batch in batches:
            found = [windows.spans(t) for t in utf8(batch.column("text"))]
            out = pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([n for n, _ in found], pa.int64()), pa.array([h for _, h in found], _KIND)], [row or "doc_id", "n_words", "hits"])
            yield out.filter(pa.array([bool(h) for _, h in found], pa.bool_())) if row else out

    return rows.mapInArrow(run, f"{row or 'doc_id'} long, n_words long, hits {_HITS}")


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words and hits, the runs of words that items cover.

    Words are runs of 0-9, a-z (A-Z counting as a-z) and characters beyond ASCII. Each run of ``window``
    words of an item (item_id, text) is sought; an item of fewer words, but not none, is sought whole. Null
    texts have no words, null item_ids are left out, repeated items count once, other columns are ignored.

    The benchmark is read in parts of bounded size, one automaton each. With several parts, rows get an id of
    their own, written once; what each part finds is written before the next is read, and only rows with hits
    are brought together by that id, so repeated and null doc_ids stay rows of their own.
    """
    parts = _parts(items, window)
    first, second = next(parts), next(parts, None)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if second is None:
        return _scanned(rows, first, window, None)
    own, found = Scratch(docs.sparkSession, "scan"), []
    rows = own.save(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    for shared in (first, second, *parts):
        found.append(own.save(_scanned(rows.select("row", "text"), shared, window, "row").drop("n_words"), "hits"))
        shared.unpersist()
    whole = found[0]
    for more in found[1:]:
        whole = whole.union(more)
    joined = whole.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits")).mapInArrow(_joined, f"row long, hits {_HITS}")  # as many rows a row as parts
    low = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counted = rows.select("row", "doc_id", F.regexp_count(low, F.lit(_JAVA_WORD)).cast("long").alias("n_words"))
    return own.keep(counted.join(joined, "row", "left").select("doc_id", "n_words", F.coalesce("hits", F.array().cast(_HITS)).alias("hits")))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of an item that texts in several parts cover, joined as one automaton would have."""
    for batch in batches:
        out = []
        for hits in batch.column("hits").to_pylist():
            runs: list[dict] = []
            for h in hits:
                if runs and runs[-1]["item_id"] == h["item_id"] and h["first_word"] <= runs[-1]["last_word"] + 1:
                    if h["last_word"] > runs[-1]["last_word"]:
                        runs[-1] |= {"last_word": h["last_word"], "end": h["end"]}
                else:
                    runs.append(h)
            out.append(runs)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, _KIND)], ["row", "hits"])


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    covered = """aggregate(array_sort(transform(hits, h -> struct(h.first_word, h.last_word))), struct(0L AS n, -1 AS upto),
        (s, h) -> struct(s.n + greatest(0, h.last_word - greatest(h.first_word - 1, s.upto)) AS n, greatest(s.upto, h.last_word) AS upto), s -> s.n)"""
    ids = "array_sort(array_distinct(transform(hits, h -> cast(h.item_id AS string))))"
    return scanned.selectExpr("doc_id", "n_words", f"{covered} AS n_hit", f"cast(size({ids}) AS bigint) AS n_items", f"sha2(array_join({ids}, ','), 256) AS items_sha256", "size(hits) > 0 AS contaminated")
