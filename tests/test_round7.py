"""CoNLL-U columns that nothing asks for aren't stored, and lines that are only counted aren't cut; density clusters search once and take their levels from the forest's steps."""

import numpy as np
from pyspark.sql import functions as F

from lexharbor import plans
from lexharbor.operators import density, graph
from lexharbor.sources import conllu

DATA = "/root/testdata/sf0.001"


def test_paragraphs_store_names_and_numbers_only(spark, monkeypatch):
    made = []
    monkeypatch.setattr(conllu, "stored", lambda df, name, own=conllu.stored: made.append((df.columns, df._jdf.queryExecution().executedPlan().toString())) or own(df, name))
    plans.QUERIES["conllu_paragraphs"](spark, DATA)
    (columns, plan), (_, ends) = made
    assert not {"at", "comments", "sent_id", "text", "bad_rows", "body", "rows"} & set(columns)
    assert "split(body" not in plan and "cells" not in plan and "Aggregate" not in ends


def test_lines_are_counted_uncut(spark):
    """Counts, and what splits hand on, are the same whether rows are kept, made to facts or only counted."""
    fields = "\t".join("_" * 7)
    first = ["# newdoc id = a", "# newpar id = p", "# sent_id = s", f"1\tAb\ty\t{fields}", f"1-2\tx\ty\t{fields}", f"1.1\tx\ty\t{fields}", "3\tshort", f"4\tx\ty\t{fields}\tlong", f"5\tx\ty\t{fields}"]
    raw = spark.createDataFrame([("f", 0, 0, first), ("f", 0, 1, ["# only"]), ("f", 1, 2, [f"1\tq\ty\t{fields}"]), ("f", 2, 3, ["# newdoc id = b"]), ("f", 3, 4, [f"1\tq\ty\t{fields}"] * 3)], "file string, split long, at long, lines array<string>")
    whole, counted = conllu.sentences(raw), conllu.sentences(raw, {})
    own = [c for c in whole.columns if c != "rows"]
    assert counted.columns == own and whole.select(own).orderBy("at").collect() == counted.orderBy("at").collect()
    assert [(len(r.rows), r.n_rows, r.bad_rows, r.doc_id, r.par_id, r.first_token) for r in whole.orderBy("at").collect()] == [(2, 2, 2, "a", "p", 0), (0, 0, 0, "a", "p", 2), (1, 1, 0, "a", "p", 2), (0, 0, 0, "b", None, 3), (3, 3, 0, "b", None, 3)]
    few = conllu.sentences(raw, {}, ("at", "comments", "sent_id", "text", "bad_rows"))
    names = ["file", "doc_no", "doc_id", "par_id", "n_rows", "first_token", "sentence_index", "opens"]
    assert few.columns == names and sorted(few.collect(), key=str) == sorted(whole.select(names).collect(), key=str)


def test_nearest_equals_all_distances():
    """Filtered by matrix products, with the same distances to the last bit and ties by id."""
    rng = np.random.default_rng(7)
    far, huge = rng.normal(size=(150, 64)) * 1e-9 + 1e6, rng.normal(size=(150, 3)) * 10.0 ** rng.integers(-5, 200, (150, 1))
    for v in (rng.normal(size=(150, 64)), np.ones((150, 5)), rng.integers(0, 3, (150, 4)).astype(float), far, huge, rng.normal(size=(150, 8)) * 1e-160, rng.normal(size=(3, 2)), rng.normal(size=(1, 2))):
        ids = rng.permutation(400)[: len(v)]
        with np.errstate(over="ignore"):
            d, got = density.distances(v, v), [x for row, other, d in density._nearest(ids, v, 10) for x in zip(row, other, d, strict=True)]
        want = [(i, j, d[i, j]) for i in range(len(v)) for j in sorted(set(range(len(v))) - {i}, key=lambda j: (d[i, j], ids[j]))[:10]]
        assert got == want


def test_levels_stand_in_the_steps(spark, monkeypatch):
    """What hangs together below a distance, for a forest of several trees with long paths and equal weights."""
    rng = np.random.default_rng(8)
    pairs = {(min(a, b), max(a, b)) for a, b in rng.integers(0, 300, (500, 2)).tolist() if a != b and a // 100 == b // 100} | {(i, i + 1) for i in range(400, 460)}
    table = spark.createDataFrame([(a, b, float(rng.integers(1, 12))) for a, b in sorted(pairs)], "a long, b long, w double").cache()
    forest, steps = graph.merged(table)
    cuts = [11.0, 7.0, 4.0, 2.5, 1.0, 0.5]
    made = []
    for m in (graph, density):
        monkeypatch.setattr(m, "stored", lambda df, name, own=m.stored: made.append((name, own(df, name))) or made[-1][1])
    got = density.condensed(spark.range(500), forest, cuts, 2, steps)
    assert [n for n, _ in made] == ["trees", "components", "levels"] and got.count() == 500
    found = {(r.level, r.node, r.component) for r in made[-1][1].collect()}
    edges = table.select(F.posexplode(F.array(*map(F.lit, cuts))).alias("level", "c"), F.col("a").alias("u"), F.col("b").alias("v"), "w").filter("w <= c")
    assert found == {(r.level, r.node, r.component) for r in graph.components(edges, ("level",)).collect()} and len(found) > 500


def test_neighbours_are_searched_once(spark, monkeypatch):
    made = []
    for m in (graph, density):
        monkeypatch.setattr(m, "stored", lambda df, name, own=m.stored: made.append((name, df._jdf.queryExecution().executedPlan().toString())) or own(df, name))
    plans.QUERIES["density_clusters"](spark, DATA)
    assert [n for n, p in made if "MapInArrow" in p] == ["near"] and not {"large-star", "small-star"} & {n for n, _ in made}
