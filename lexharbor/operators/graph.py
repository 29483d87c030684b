"""Connected components and minimum spanning forests in rounds of joins and aggregations.

Every round is written to the shared folder, so plans stay short and a lost executor costs the tasks of one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.stored import stored


def linked(a: DataFrame, b: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of tables whose rows grow with the input, by sorting and merging both.

    Spark would broadcast one as long as its files are small, but numbers of nodes fill many times their files' size
    when the driver builds the hashed relation, and several are built at once.
    """
    return a.join(b.hint("merge"), on, how)


def components(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, node, component): the smallest node that each node of an edge (u, v) reaches, separately for each value of ``by``.

    Large and small stars take turns until nothing changes: nodes link their larger neighbours, then themselves and
    their smaller ones, to the smallest. Loops, repeated and reversed edges don't matter.
    """
    keys, before = list(by), None
    now = edges.select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    while True:
        both = now.select(*keys, "u", "v").union(now.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = stored(linked(both.filter("v > u"), least, [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        least = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        small = linked(large, least, [*keys, "u"]).select(*keys, F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        now = stored(small.filter("u <> v").distinct(), "small-star")
        state = now.agg(F.count("*"), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            roots = now.select(*keys, F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return now.select(*keys, F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
        before = state


def _roots(links: DataFrame) -> DataFrame:
    """(x, root) of links (x, to), one for each x, whose only cycles are pairs; the smaller of a pair is the root."""
    back = links.select(F.col("x").alias("to"), F.col("to").alias("back"))
    now = linked(links, back, "to", "left").select("x", F.when((F.col("back") == F.col("x")) & (F.col("x") < F.col("to")), F.col("x")).otherwise(F.col("to")).alias("root"))
    now = stored(now, "roots")
    while True:
        up = now.select(F.col("x").alias("root"), F.col("root").alias("above"))
        further = stored(linked(now, up, "root").select("x", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "roots")
        now = further.drop("moved")
        if further.filter("moved").isEmpty():
            return now


def merged(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A minimum spanning forest (a, b, w) by Borůvka's rounds, and the trees that each node was in; edges of equal weight are ordered by (a, b).

    In each round every tree takes its least edge to another one; trees that are linked so become one, and of the
    edges between two trees only the least stays. The number of trees at least halves in a round.

    The second table has node and steps, array of (tree, w): the trees that the node was in before each round, from
    itself on, with the weights of the edges they took, and the last one without. Along the steps of two nodes, up to
    the first tree that is the same, the greatest weight is the greatest on their path in the forest (V. King, A
    simpler minimum spanning tree verification algorithm, 1997), so the steps tell what hangs together below a weight.
    """
    cross = stored(edges.filter("a <> b").select(F.col("a").alias("x"), F.col("b").alias("y"), F.struct("w", "a", "b").alias("e")), "cross")
    taken, rounds = None, []
    while True:
        each = cross.union(cross.select(F.col("y").alias("x"), F.col("x").alias("y"), "e"))
        best = stored(each.groupBy("x").agg(F.min(F.struct("e", "y")).alias("m")).select("x", F.col("m.y").alias("to"), "m.e"), "best")
        if best.isEmpty():
            break
        own = best.select("e").distinct()
        taken = own if taken is None else taken.union(own)
        root = _roots(best.select("x", "to"))
        rounds.append(linked(best.select("x", "e.w"), root, "x"))
        moved = linked(linked(cross, root, "x").select(F.col("root").alias("p"), "y", "e"), root.withColumnRenamed("x", "y"), "y").select("p", F.col("root").alias("q"), "e")
        cross = stored(moved.filter("p <> q").groupBy(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).agg(F.min("e").alias("e")), "cross")
    rows = cross.select("e") if taken is None else taken
    step = lambda tree, w: F.struct(F.col(tree).alias("tree"), w.cast("double").alias("w"))
    last = F.array(step("root", F.lit(None)))
    up = cross.select("x", F.array(step("x", F.lit(None))).alias("steps")).limit(0)
    for k, one in enumerate(reversed(rounds)):  # from the last round, which has the fewest trees
        later = one.select("x", "w", "root", last.alias("later")) if k == 0 else linked(one, up.select(F.col("x").alias("root"), "steps"), "root", "left").select("x", "w", "root", F.coalesce("steps", last).alias("later"))
        up = later.select("x", F.concat(F.array(step("x", F.col("w"))), "later").alias("steps"))
    return rows.select("e.a", "e.b", "e.w"), up.withColumnRenamed("x", "node")


def spanning_forest(edges: DataFrame) -> DataFrame:
    """The edges (a, b, w) of a minimum spanning forest, see ``merged``."""
    return merged(edges)[0]
