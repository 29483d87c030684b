"""Fewer topics: the most similar ones merged step by step, with the whole tree of merges as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..sources.stored import stored


def class_vectors(tokens: DataFrame, group: str) -> DataFrame:
    """group, word, weight: all class TF-IDF weights, scaled to length 1 for each group.

    The tokens are read once; their counts by group and word, and the weights, are stored.
    """
    tf = stored(tokens.groupBy(group, "word").agg(F.count("*").alias("tf")), "class-counts")
    sizes = tf.groupBy(group).agg(F.sum("tf").alias("n"))
    terms = tf.groupBy("word").agg(F.sum("tf").alias("m"))
    mean = sizes.agg(F.avg("n").alias("mean"))
    rows = tf.join(sizes, group).join(terms, "word").join(F.broadcast(mean)).withColumn("w", F.col("tf") / F.col("n") * F.log1p(F.col("mean") / F.col("m")))
    norm = rows.groupBy(group).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return stored(rows.join(norm, group).select(group, "word", (F.col("w") / F.col("norm")).alias("weight")), "class-vectors")


def similarities(vectors: DataFrame, group: str) -> DataFrame:
    """a < b and their cosine, for all pairs of groups, 0 where they share no word. Pairs are as many as the square of the groups."""
    ids = vectors.select(group).distinct()
    grid = ids.select(F.col(group).alias("a")).join(ids.select(F.col(group).alias("b")), F.col("a") < F.col("b"))
    left, right = (vectors.select(F.col(group).alias(n), "word", F.col("weight").alias(f"w_{n}")) for n in ("a", "b"))
    both = left.join(right, "word").filter("a < b").groupBy("a", "b").agg(F.sum(F.col("w_a") * F.col("w_b")).alias("s"))
    return grid.join(both, ["a", "b"], "left").select("a", "b", F.coalesce("s", F.lit(0.0)).alias("s"))


def merges(pairs: DataFrame) -> DataFrame:
    """(a, b, similarity, size): every merge of an agglomeration by average similarity; the merged group is called a, the smaller.

    pairs (a, b, s) has all pairs of groups once, a < b. In a round all pairs merge that are each other's most
    similar, the smaller names first among equals; averages never bring a merged pair closer to a third than both
    were, so the rounds find the merges that one at a time would, the most similar pair first.
    """
    now = stored(pairs.select("a", "b", "s", F.lit(1).cast("long").alias("n_a"), F.lit(1).cast("long").alias("n_b")), "pairs")
    done = None
    while not now.isEmpty():
        both = now.select(F.col("a").alias("x"), F.col("b").alias("y"), "s", F.col("n_a").alias("n_x"), F.col("n_b").alias("n_y")).union(now.select("b", "a", "s", "n_b", "n_a"))
        nearest = both.groupBy("x").agg(F.min(F.struct((-F.col("s")).alias("s"), F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"))).alias("m"))
        mutual = nearest.groupBy("m").agg(F.count("*").alias("n")).filter("n = 2").select("m.lo", "m.hi")
        found = stored(mutual.join(now, (F.col("a") == F.col("lo")) & (F.col("b") == F.col("hi"))).select("a", "b", F.col("s").alias("similarity"), (F.col("n_a") + F.col("n_b")).alias("size")), "merged")
        done = found if done is None else done.union(found)
        into = found.select(F.col("b").alias("x"), F.col("a").alias("to"))
        rows = both.join(into, "x", "left").withColumn("x", F.coalesce("to", "x")).drop("to")
        rows = rows.join(into.withColumnRenamed("x", "y"), "y", "left").withColumn("y", F.coalesce("to", "y")).drop("to").filter("x < y")
        weight = F.col("n_x") * F.col("n_y")
        now = rows.groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg((F.sum(F.col("s") * weight) / F.sum(weight)).alias("s"), F.sum(weight).alias("w"))
        sizes = both.select("x", "n_x").distinct().join(into, "x", "left").groupBy(F.coalesce("to", "x").alias("g")).agg(F.sum("n_x").alias("n"))
        now = now.drop("w").join(sizes.select(F.col("g").alias("a"), F.col("n").alias("n_a")), "a").join(sizes.select(F.col("g").alias("b"), F.col("n").alias("n_b")), "b")
        now = stored(now.select("a", "b", "s", "n_a", "n_b"), "pairs")
    return done if done is not None else pairs.limit(0).select("a", "b", F.col("s").alias("similarity"), F.lit(0).cast("long").alias("size"))


def dendrogram(tree: DataFrame) -> DataFrame:
    """The merges with their step, from 1, the most similar first. Groups are few; their steps are numbered in one task."""
    return tree.withColumn("step", F.row_number().over(Window.orderBy(F.desc("similarity"), "a", "b")).cast("long"))


def reduced(groups: DataFrame, tree: DataFrame, group: str, wanted: int) -> DataFrame:
    """group and reduced: the group that each belongs to once the first merges have left ``wanted`` groups."""
    steps = dendrogram(tree).filter(F.col("step") <= F.lit(groups.select(group).distinct().count() - wanted)).select(F.col("b").alias("at"), F.col("a").alias("to"))
    now = stored(groups.select(group, F.col(group).alias("at")).distinct(), "groups")
    while True:
        moved = stored(now.join(steps, "at", "left").select(group, F.coalesce("to", "at").alias("at"), F.col("to").isNotNull().alias("moved")), "groups")
        if not moved.filter("moved").limit(1).count():
            return now.select(group, F.col("at").alias("reduced"))
        now = moved.drop("moved")
