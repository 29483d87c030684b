"""Vectors of texts without a model: weighted words under random signs, so that cosines of texts come close to those of TF-IDF."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, functions as F

#: Parts of a vector, hexadecimal digits of a hash, and buckets in which documents of words are counted (four digits).
SIZE, DIGITS, BUCKETS = 64, 32, 16**4
#: Documents, and pairs of a document and one of its words, that a task works on at a time.
ROWS, PAIRS = 512, 1 << 15


def _counted(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, list[str]]]:
    """For stretches of rows: first row and rows; row, number of the word and count of each pair, by row; the words."""
    for lo in range(0, batch.num_rows, ROWS):
        column = batch.column("words").slice(lo, ROWS)
        flat, n = column.flatten(), len(column)
        row = np.repeat(np.arange(n), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        if flat.null_count:
            row, flat = row[flat.is_valid().to_numpy(zero_copy_only=False)], flat.drop_null()
        coded = flat.dictionary_encode()
        names = coded.dictionary.to_pylist()
        pair, tf = np.unique(row * max(1, len(names)) + coded.indices.to_numpy(), return_counts=True)
        yield lo, n, pair // max(1, len(names)), pair % max(1, len(names)), tf, names


def _buckets(names: list[str]) -> np.ndarray:
    """The first four digits of each word's hash as a number."""
    return np.frombuffer(b"".join(md5(x.encode()).digest()[:2] for x in names), dtype=">u2").astype(np.int64)


def _signs(names: list[str], size: int) -> np.ndarray:
    """1 where a digit of the hashes of a word is below 8, else -1, for as many digits as a vector has parts."""
    hashes = range(-(-size // DIGITS))
    raw = np.frombuffer(b"".join(md5(f"{i}:{x}".encode()).digest() for x in names for i in hashes), dtype=np.uint8).reshape(len(names), len(hashes) * DIGITS // 2)
    high = np.stack((raw & 0x80, raw & 0x08), axis=2).reshape(len(names), len(hashes) * DIGITS)[:, :size]
    return np.where(high == 0, 1.0, -1.0)


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket and d: documents of each batch with a word in the bucket."""
    for batch in batches:
        d = np.zeros(BUCKETS, dtype=np.int64)
        for _, _, row, word, _, names in _counted(batch):
            d += np.bincount(np.unique(row * BUCKETS + _buckets(names)[word]) % BUCKETS, minlength=BUCKETS)
        at = np.flatnonzero(d)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(d[at])], ["bucket", "d"])


def _summed(idf: np.ndarray, size: int):
    """doc_id and v, of length 1 or of zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, n, row, word, tf, names in _counted(batch):
                v = np.zeros((n, size))
                signs, w = _signs(names, size), tf * idf[_buckets(names)[word]]
                for at in range(0, len(row), PAIRS):
                    own = row[at : at + PAIRS]
                    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                    v[own[first]] += np.add.reduceat(w[at : at + PAIRS, None] * signs[word[at : at + PAIRS]], first, axis=0)
                norm = np.sqrt((v * v).sum(axis=1))[:, None]
                v = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
                parts = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), pa.array(v.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, n), parts], ["doc_id", "v"])

    return run


def text_vectors(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id and v (array of doubles of length 1, or of zeros without words) for each row of docs (doc_id, words).

    A word weighs its count times ln((1 + n) / (1 + d)) + 1, with d the documents in its bucket of BUCKETS, so the
    table of d has a fixed size and goes to every task. Each word adds its weight to every part of the vector, with a
    sign from its hash; the cosine of two vectors misses that of all weights by about 1 / sqrt(size) at most. Null
    lists have no words. Documents are read twice, and nothing but the table of d is shuffled.
    """
    n = docs.count()
    seen = docs.select("words").mapInArrow(_seen, "bucket long, d long").groupBy("bucket").agg(F.sum("d").alias("d")).toArrow()  # BUCKETS rows at most
    d = np.zeros(BUCKETS)
    d[seen.column("bucket").to_numpy()] = seen.column("d").to_numpy()
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "words").mapInArrow(_summed(np.log((n + 1) / (d + 1)) + 1, size), f"doc_id {kind}, v array<double>")
