"""Clusters of dense regions: neighbours by random projections, mutual reachability, a spanning forest and its condensed tree.

Distances are cut at a number of levels, quantiles of the forest's edges. At each level the forest falls apart into
components; those of ``least`` members or more are clusters, where a component that falls apart into two or more of
these ends and new ones begin. Of each branch of this tree the clusters of the greatest stability are taken; members
of none are outliers, -1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.stored import stored
from .graph import linked, merged

#: Rows that are compared with each other at a time, projections, neighbours, least members and levels.
CHUNK, TABLES, NEAR, LEAST, LEVELS = 1024, 8, 10, 15, 16
_PAIR = "id long, other long, distance double"


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a to all of b."""
    out = np.empty((len(a), len(b)))
    for i in range(len(a)):
        out[i] = np.sqrt(((b - a[i]) ** 2).sum(axis=1))
    return out


def _nearest(ids: np.ndarray, v: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, place of its neighbour and distance, for the k nearest of each row of v by (distance, id), 64 rows at a time.

    Matrix products tell which rows may be among the k nearest; they err by no more than ``slack``, and only the
    rows within it have their distances taken as ``distances`` takes them, so the result is the same.
    """
    n, k = len(ids), min(k, len(ids) - 1)
    norms = (v * v).sum(axis=1)
    slack = (8 * (v.shape[1] + 8) * np.finfo(float).eps * (norms + norms.max()) + 1e-300) if norms.max() < 1e300 else np.full(n, np.inf)
    step = max(1, (1 << 20) // max(1, v.shape[1]))
    for lo in range(0, n if k > 0 else 0, 64):
        here = v[lo : lo + 64]
        with np.errstate(over="ignore", invalid="ignore"):
            about = norms[lo : lo + 64, None] + norms - 2 * (here @ v.T)
            about[np.arange(len(here)), lo + np.arange(len(here))] = np.inf
            far = about > (np.partition(about, k - 1, axis=1)[:, k - 1] + slack[lo : lo + 64])[:, None]
        far[np.arange(len(here)), lo + np.arange(len(here))] = True
        row, other = np.nonzero(~far)
        d = np.concatenate([np.sqrt(((v[other[i : i + step]] - here[row[i : i + step]]) ** 2).sum(axis=1)) for i in range(0, len(row), step)])
        order = np.lexsort((ids[other], d, row))
        first = np.searchsorted(row, np.arange(len(here)))
        order = order[np.arange(len(row)) - first[row] < k]  # row is sorted, before and after
        yield lo + row[order], other[order], d[order]


def _near(k: int, chunk: int):
    """Over rows sorted by projection: the k nearest of each among ``chunk`` rows that follow each other."""

    def made(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        ids, v = (np.concatenate(x) for x in zip(*held, strict=True))
        for row, other, d in _nearest(ids, v, k):
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(ids[other]), pa.array(d)], ["id", "other", "distance"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        line = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t, ids, column = batch.column("t").to_numpy(), batch.column("id").to_numpy(), batch.column("v")
            if len(column.value_lengths().unique()) > 1:
                raise ValueError("vectors differ in length")
            v = column.flatten().to_numpy().reshape(len(column), -1)
            for lo, hi in zip(starts := [0, *(np.flatnonzero(t[1:] != t[:-1]) + 1)], [*starts[1:], len(t)], strict=True):
                if held and t[lo] != line:
                    yield from made(held)
                    held = []
                line = t[lo]
                while lo < hi:
                    end = min(hi, lo + chunk - sum(len(x) for x, _ in held))
                    held.append((ids[lo:end], v[lo:end]))
                    lo = end
                    if sum(len(x) for x, _ in held) == chunk:
                        yield from made(held)
                        held = []
        if held:
            yield from made(held)

    return run


def neighbours(vectors: DataFrame, k: int = NEAR, tables: int = TABLES, chunk: int = CHUNK, seed: int = 1) -> DataFrame:
    """id, other, distance: the k nearest rows of each row (id, v) among those that lie near it on a random line.

    Rows are sorted along each of ``tables`` lines and compared within ``chunk`` neighbours; up to that many rows in
    all, the result is exact. Equal projections are told apart by id, so no group of equal vectors is held whole.
    """
    n, width = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    lines = np.random.default_rng(seed).normal(size=(tables, width or 0))
    if n <= chunk:
        lines = lines[:1]
    on = [F.struct(F.lit(t).alias("t"), F.aggregate(F.zip_with("v", F.lit([float(x) for x in line]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x).alias("x")) for t, line in enumerate(lines)]
    rows = vectors.select("id", "v", F.explode(F.array(*on)).alias("p")).select("p.t", "p.x", "id", "v")
    parts = max(1, n * len(lines) // (8 * chunk))
    found = rows.repartitionByRange(parts, "t", "x", "id").sortWithinPartitions("t", "x", "id").mapInArrow(_near(k, chunk), _PAIR)
    each = found.repartition("id").groupBy("id", "other").agg(F.min("distance").alias("distance"))  # dealt by id for the places too
    place = F.row_number().over(Window.partitionBy("id").orderBy("distance", "other"))
    return each.withColumn("place", place).filter(F.col("place") <= k).drop("place")


def reachability(near: DataFrame) -> DataFrame:
    """Edges a < b with w: the distance, or, if greater, the distance of either end to its last neighbour."""
    core = near.groupBy("id").agg(F.max("distance").alias("core"))
    pairs = near.groupBy(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).agg(F.min("distance").alias("d"))
    ends = linked(linked(pairs, core.withColumnsRenamed({"id": "a", "core": "core_a"}), "a"), core.withColumnsRenamed({"id": "b", "core": "core_b"}), "b")
    return ends.select("a", "b", F.greatest("d", "core_a", "core_b").alias("w"))


def condensed(ids: DataFrame, forest: DataFrame, cuts: list[float], least: int = LEAST, steps: DataFrame | None = None) -> DataFrame:
    """id and path: the clusters (level of birth, least member, last level) that a row belongs to, outermost first.

    cuts are distances from wide to narrow; at a level the edges up to its distance hold. What hangs together at a
    level stands in the steps of ``merged``, without rounds: a row is in the last tree before an edge that is too long.
    """
    trees = merged(forest)[1] if steps is None else steps
    upto = F.transform(F.array(*map(F.lit, cuts)), lambda c: F.array_position(F.transform("steps", lambda s: s.w.isNull() | (s.w > c)), F.lit(True)).cast("int"))
    each = trees.select("node", "steps", F.posexplode(upto).alias("level", "at")).filter("at > 1")  # others are alone
    each = stored(each.select("level", "node", "at", F.element_at("steps", F.col("at")).tree.alias("tree")), "trees")
    key = ["level", "at", "tree"]
    full = stored(each.groupBy(*key).agg(F.count("*").alias("n"), F.min("node").alias("component")).filter(F.col("n") >= least), "components")
    rows = stored(linked(each, full.drop("n"), key).select("level", "node", "component"), "levels")
    full = full.select("level", "component")
    # a component is new where its parent has two or more children; all of the widest level are
    above = rows.select((F.col("level") + 1).alias("level"), "node", F.col("component").alias("parent"))
    tree = linked(full, above.withColumnRenamed("node", "component"), ["level", "component"], "left")
    many = tree.filter("parent IS NOT NULL").groupBy("level", "parent").agg(F.count("*").alias("children"))
    tree = linked(tree, many, ["level", "parent"], "left").select("level", "component", (F.coalesce("children", F.lit(2)) > 1).alias("new"))
    rows = linked(rows, tree, ["level", "component"])
    steps = F.array_sort(F.collect_list(F.struct("level", "component", "new")))
    born = F.filter("steps", lambda s: s.new)
    ends = F.transform(born, lambda s, i: F.struct(s.level.alias("born"), s.component.alias("first"), F.coalesce(F.get(born, i + 1).level - 1, F.element_at(F.col("steps"), -1).level).alias("last")))
    paths = rows.groupBy(F.col("node").alias("id")).agg(steps.alias("steps")).select("id", ends.alias("path"))
    return linked(ids, paths, "id", "left").select("id", F.coalesce("path", F.array().cast("array<struct<born:int,first:bigint,last:int>>")).alias("path"))


def stable(paths: DataFrame, cuts: list[float], single: bool = False) -> DataFrame:
    """id and cluster (its least member at birth, or -1): the most stable clusters of ``condensed`` paths, none within another.

    A cluster's stability is the sum, over its members, of the inverse distances at which they leave it less that at
    which it is born. A cluster that is the only one of the widest level doesn't count unless ``single`` is true.
    """
    inverse = F.array(*(F.lit(1 / max(c, 1e-12)) for c in cuts))
    each = paths.select("id", "path", F.posexplode("path").alias("depth", "c")).select("id", "depth", "c.*", F.get("path", F.col("depth") - 1).alias("outer"))
    gain = F.get(inverse, F.col("last")) - F.when(F.col("born") > 0, F.get(inverse, F.col("born") - 1)).otherwise(0.0)
    tree = each.groupBy("born", "first").agg(F.sum(gain).alias("own"), F.min("outer.born").alias("up_born"), F.min("outer.first").alias("up_first"), F.max("depth").alias("depth"))
    tree = stored(tree, "tree")
    roots, deepest = tree.agg(F.count_if(F.col("depth") == 0), F.coalesce(F.max("depth"), F.lit(-1))).first()
    own = F.when((F.col("depth") == 0) & F.lit(roots == 1 and not single), F.lit(None).cast("double")).otherwise(F.col("own"))
    done = None
    for depth in range(deepest, -1, -1):
        here = tree.filter(F.col("depth") == depth).withColumn("own", own)
        below = F.lit(0.0) if done is None else F.coalesce("below", F.lit(0.0))
        if done is not None:
            inner = done.filter(F.col("depth") == depth + 1).groupBy(F.col("up_born").alias("born"), F.col("up_first").alias("first")).agg(F.sum("best").alias("below"))
            here = linked(here, inner, ["born", "first"], "left")
        here = here.select("born", "first", "up_born", "up_first", "depth", F.coalesce(F.col("own") >= below, F.lit(False)).alias("wins"), F.greatest(F.coalesce("own", F.lit(0.0)), below).alias("best"))
        done = stored(here if done is None else here.unionByName(done), "chosen")
    if done is None:
        return paths.select("id", F.lit(-1).cast("long").alias("cluster"))
    taken = linked(each, done.filter("wins").select("born", "first"), ["born", "first"]).groupBy("id").agg(F.min_by("first", "depth").alias("cluster"))
    return linked(paths.select("id"), taken, "id", "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def clusters(vectors: DataFrame, k: int = NEAR, least: int = LEAST, levels: int = LEVELS, tables: int = TABLES, chunk: int = CHUNK, single: bool = False) -> DataFrame:
    """id and cluster of each row (id, v): the id of the cluster's least member at its birth, or -1 for outliers.

    Vectors that are null, empty or hold a null or a number that isn't finite are outliers. Ids are unique; extra
    columns are ignored; an empty table gives an empty result.
    """
    every = vectors.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    good = stored(every.filter((F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))), "vectors")
    forest, steps = merged(reachability(stored(neighbours(good, k, tables, chunk), "near")))
    forest = stored(forest, "forest")
    cuts = forest.agg(F.percentile_approx("w", [i / levels for i in range(levels, 0, -1)], 10_000)).first()[0] or []
    cuts = sorted({float(c) for c in cuts}, reverse=True)
    if not cuts:
        return every.select("id", F.lit(-1).cast("long").alias("cluster"))
    return stable(stored(condensed(every.select("id"), forest, cuts, least, steps), "paths"), cuts, single)
