"""Nearest lexicon keys of words by edit ratio, as a similarity join.

The ratio of two strings of n and m characters is 200 * c / (n + m), with c the length of their longest common
subsequence; it reaches a threshold t only within d = (100 - t) * (n + m) / 100 insertions and deletions. Cut into
d + 1 parts, one part of a key then stands unchanged in the word, at most d places from where it was. Parts and
substrings meet in an equi-join; this loses no pair, and what meets is verified exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: The least ratio of a match, and characters below which a word isn't looked up.
THRESHOLD, LEAST = 92, 5


def common(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two strings, row by row of its table."""
    letters, other = F.split(a, ""), F.split(b, "")
    zero = F.lit(0)
    row = lambda above, x: F.aggregate(other, F.array(zero), lambda left, y: F.concat(left, F.array(F.when(x == y, F.get(above, F.size(left) - 1) + 1).otherwise(F.greatest(F.get(above, F.size(left)), F.get(left, F.size(left) - 1))))))
    return F.element_at(F.aggregate(letters, F.array_repeat(zero, F.size(other) + 1), row), -1)


def _sizes(n: Column, threshold: int) -> Column:
    """Lengths that a partner of a string of n characters can have."""
    return F.sequence(F.ceil(n * threshold / (200 - threshold)).cast("int"), F.floor(n * (200 - threshold) / threshold).cast("int"))


def _edits(n: Column, m: Column, threshold: int) -> Column:
    return F.floor((100 - threshold) * (n + m) / 100).cast("int")


def candidates(words: DataFrame, keys: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs (word, key) that share a part; every pair that reaches the threshold is among them."""
    start = lambda n, d, i: F.floor(i * n / (d + 1)).cast("int")
    of_keys = keys.select("key", F.length("key").alias("n")).select("key", "n", F.explode(_sizes(F.col("n"), threshold)).alias("m"))
    of_keys = of_keys.withColumn("d", _edits(F.col("n"), F.col("m"), threshold)).select("key", "n", "m", "d", F.explode(F.sequence(F.lit(0), "d")).alias("i"))
    lo, hi = start(F.col("n"), F.col("d"), F.col("i")), start(F.col("n"), F.col("d"), F.col("i") + 1)
    of_keys = of_keys.select("key", "n", "m", "i", F.substring("key", lo + 1, hi - lo).alias("part"))
    of_words = words.select("word", F.length("word").alias("m")).select("word", "m", F.explode(_sizes(F.col("m"), threshold)).alias("n"))
    of_words = of_words.withColumn("d", _edits(F.col("n"), F.col("m"), threshold)).select("word", "n", "m", "d", F.explode(F.sequence(F.lit(0), "d")).alias("i"))
    places = F.sequence(F.greatest(F.lit(0), lo - F.col("d")), F.least(lo + F.col("d"), F.col("m") - (hi - lo)))
    fits = F.greatest(F.lit(0), lo - F.col("d")) <= F.least(lo + F.col("d"), F.col("m") - (hi - lo))
    parts = F.array_distinct(F.transform(F.when(fits, places), lambda p: F.substring("word", p + 1, hi - lo)))
    of_words = of_words.select("word", "n", "m", "i", F.explode(parts).alias("part"))
    return of_words.join(of_keys, ["n", "m", "i", "part"]).select("word", "key").distinct()


def nearest(words: DataFrame, keys: DataFrame, threshold: int = THRESHOLD, least: int = LEAST) -> DataFrame:
    """word, key, score: for each distinct word the key of the best ratio, of equal ones the first, if it reaches the threshold.

    words has word, keys has key; nulls, repeated rows and extra columns don't matter. Words of fewer than ``least``
    characters have no row. Thresholds are whole numbers from 70 to 100, below which a key has too few characters
    for its parts.
    """
    if not 70 <= threshold <= 100:
        raise ValueError("threshold must lie between 70 and 100")
    words = words.filter(F.length("word") >= least).select("word").distinct()
    keys = keys.filter(F.length("key") > 0).select("key").distinct()
    most = _edits(F.length("word"), F.length("key"), threshold)
    near = candidates(words, keys, threshold).filter(F.levenshtein("word", "key") <= most)  # at most the edits
    score = 200.0 * common(F.col("word"), F.col("key")) / (F.length("word") + F.length("key"))
    best = near.withColumn("score", score).filter(F.col("score") >= threshold).groupBy("word").agg(F.min(F.struct((-F.col("score")).alias("s"), "key")).alias("x"))
    return best.select("word", "x.key", (-F.col("x.s")).alias("score"))
