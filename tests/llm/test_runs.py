"""Stored runs of frequent words: rows of one width, in which each place starts phrases once."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from lexharbor.llm import collocations


def test_rows_of_runs_are_bounded():
    every = SimpleNamespace(value=np.full(1 << (collocations.BITS - 6), ~np.uint64(0)))
    texts = ["w" + " w".join(map(str, range(5000))), "a b. c d e! f", "", "x"]
    out = list(collocations._encoded(every)([pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["en"] * 4)], ["text", "lang"])]))
    assert {n for b in out for n in b.column("codes").value_lengths().to_pylist()} == {collocations.WIDE}
    runs, phrases = 0, 0
    for b in out:
        for v, k, own in collocations._stretches(b):
            runs += int((own & (v[1 : 1 + k] != 0)).sum())
            phrases += int((own & collocations._full(v, k, 5)).sum())
    assert runs == 5005 and phrases == 4996  # f and x have no neighbour
