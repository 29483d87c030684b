"""CoNLL-U lines are sorted uncut; vectors of texts are summed within tasks."""

import math
from hashlib import md5

import pytest

from lexharbor.operators import vectors
from lexharbor.sources import conllu


def test_lines_are_sorted_before_they_are_cut(spark, monkeypatch):
    plans, stored = [], conllu.stored
    monkeypatch.setattr(conllu, "stored", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or stored(df, name))
    fields = "\t".join("_" * 7)
    lines = ["# newdoc id = a", f"1\tx\ty\t{fields}", f"1-2\tx\ty\t{fields}", f"2.1\tx\ty\t{fields}", "3\tshort", f"4\tx\ty\t{fields}\tlong", f"5\tz\r\ty\t{fields}"]
    raw = spark.createDataFrame([("f", 0, 0, lines), ("f", 0, 1, ["# only"]), ("f", 1, 2, [f"1\tq\ty\t{fields}"])], "file string, split long, at long, lines array<string>")
    got = conllu.sentences(raw).orderBy("at").collect()
    assert [(len(r.rows), r.bad_rows, r.sentence_index, r.first_token) for r in got] == [(2, 2, 0, 0), (0, 0, None, 2), (1, 0, 1, 2)]
    assert [x[1] for r in got for x in r.rows] == ["x", "z\r", "q"]
    assert "cells" not in plans[0][plans[0].rindex("Window [") :]


def test_text_vectors_shuffle_no_words(spark):
    docs = spark.createDataFrame([(1, ["a", None, "b", "a"]), (2, None), (3, []), (4, ["b"])], "doc_id long, words array<string>")
    made = vectors.text_vectors(docs, 40)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    got = {r.doc_id: r.v for r in made.collect()}
    sign = lambda w: [1 if c < "8" else -1 for c in "".join(md5(f"{i}:{w}".encode()).hexdigest() for i in range(2))[:40]]
    a, b = (2 * (math.log(5 / 2) + 1), math.log(5 / 3) + 1)
    v = [a * x + b * y for x, y in zip(sign("a"), sign("b"))]
    n = math.sqrt(sum(x * x for x in v))
    assert got[1] == pytest.approx([x / n for x in v]) and got[2] == got[3] == [0.0] * 40 and len(got[4]) == 40
