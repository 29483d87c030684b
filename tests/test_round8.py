"""Topic models over matrices of documents against plain loops and pyspark.ml."""

import math

import numpy as np
import pytest
from pyspark.ml.clustering import LDA
from pyspark.sql import functions as F

from lexharbor import plans
from lexharbor.operators import density, graph, lda, lexicon, topics
from lexharbor.plans import models
from lexharbor.sources import conllu

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def features(spark):
    """Documents of three kinds of words, some common to all, and one without words of the model."""
    rng = np.random.default_rng(3)
    docs = [(i, [f"w{i % 3}{x}" for x in rng.integers(0, 15, 40)] + [f"c{x}" for x in rng.integers(0, 9, 5 + i)]) for i in range(40)] + [(99, ["rare"] * 50)]
    return topics._vectorized(spark.createDataFrame(docs, "doc_id long, words array<string>"), 30)


def plain(words, n, beta, alpha):
    g = np.ones(len(alpha))
    while True:
        t = np.exp(lda.expected(g))
        new = t * (beta[words].T @ (n / (beta[words] @ t))) + alpha
        if abs(new - g).mean() < 1e-9:
            return new
        g = new


def test_functions():
    x = np.array([1e-3, 0.1, 0.5, 1.0, 3.0, 10.0, 1000.0])
    assert np.allclose(lda.lgamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-10)
    assert np.allclose(lda.digamma(x), (lda.lgamma(x * 1.0001) - lda.lgamma(x * 0.9999)) / (x * 0.0002), rtol=1e-5) and np.allclose(lda.trigamma(x), (lda.digamma(x * 1.0001) - lda.digamma(x * 0.9999)) / (x * 0.0002), rtol=1e-5)


def test_documents_are_inferred_as_by_plain_steps(monkeypatch):
    rng = np.random.default_rng(4)
    lens = np.array([0, 5, 40, 1, 300, 7, 0, 60])
    words, n, alpha = rng.integers(0, 50, lens.sum()), rng.integers(1, 4, lens.sum()).astype(float), np.array([0.1, 0.3, 0.2])
    beta = np.vstack([rng.gamma(1.0, 1.0, (50, 3)) / 50, np.zeros(3)])
    monkeypatch.setattr(lda, "SETTLED", 1e-8)
    for cells in (1, 400, 1 << 17):  # each alone, some together, all
        monkeypatch.setattr(lda, "CELLS", cells)
        gamma, theta, norm = lda.inferred(lens, words, n, beta, alpha)
        for d, lo in enumerate(np.cumsum(lens) - lens):
            own = slice(lo, lo + lens[d])
            if lens[d]:
                assert np.allclose(gamma[d], plain(words[own], n[own], beta, alpha), atol=1e-4) and np.allclose(norm[own], beta[words[own]] @ theta[d])


def test_perplexity_and_shares_as_of_pyspark(features):
    rows, vectorizer = features
    held, k, size = lda.counts(rows), 3, len(vectorizer.vocabulary)
    other = LDA(k=k, maxIter=20, seed=1, optimizer="online", subsamplingRate=1.0).fit(rows)
    model = lda.Model(other.topicsMatrix().toArray().T, np.array(other.estimatedDocConcentration().toArray()), 1 / k)
    assert abs(lda.log_perplexity(held, model) - other.logPerplexity(rows)) < 1e-3
    want = {r.doc_id: r.topicDistribution.toArray() for r in other.transform(rows).collect()}
    got = {r.doc_id: np.array(r.v) for r in lda.distributions(held, model).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i], atol=0.01) for i in got) and not got[99].any()
    mine = lda.fit(held, size, k, 20)
    assert abs(lda.log_perplexity(held, mine) - other.logPerplexity(rows)) < 0.1
    again = lda.fit(held.repartition(7), size, k, 20)
    assert np.allclose(mine.weights, again.weights) and np.allclose(mine.alpha, again.alpha)


def test_coherence_equals_joins(spark, features):
    rows, vectorizer = features
    held = lda.counts(rows)
    told = lda.described(np.random.default_rng(5).random((4, len(vectorizer.vocabulary))), 6)
    tokens = held.select("doc_id", F.explode("i").alias("word"))
    want = {r.topic: r.coherence for r in topics.umass(tokens, spark.createDataFrame([x[:3] for x in told], "topic int, rank int, term int")).collect()}
    got = lda.coherence(held, told)
    assert got.keys() == want.keys() and all(abs(got[t] - want[t]) < 1e-9 for t in got)


def test_em_equals_plain_loops(spark, features, monkeypatch):
    """However the documents are dealt, and with sums kept from one iteration to the next."""
    rows, vectorizer = features
    held, k, size = lda.counts(rows), 3, len(vectorizer.vocabulary)
    docs = [(r.h, np.array(r.i, dtype=np.int64), np.array(r.n)) for r in held.select(F.xxhash64("doc_id").alias("h"), "i", "n").collect()]
    alpha, eta, total, state = 50 / k + 1, 1.1, np.zeros((size, k)), []
    for h, i, n in docs:
        share = lda._uniform(np.full(len(i), h), i, k, 42) if len(i) else np.zeros((0, k))
        share = share / share.sum(axis=1, keepdims=True) * n[:, None]
        assert ((share >= 0) & (share <= n[:, None])).all()
        state.append(share.sum(axis=0))
        np.add.at(total, i, share)
    for _ in range(4):
        phi, new = (total + eta - 1) / (total.sum(axis=0) + size * (eta - 1)), np.zeros((size, k))
        for d, (_, i, n) in enumerate(docs):
            share = phi[i] * (state[d] + alpha - 1)
            share = share / share.sum(axis=1, keepdims=True) * n[:, None]
            state[d] = share.sum(axis=0)
            np.add.at(new, i, share)
        total = new
    monkeypatch.setattr(lda, "PAIRS", 16)
    made = []
    monkeypatch.setattr(lda, "stored", lambda df, name, own=lda.stored: made.append(name) or own(df, name))
    monkeypatch.setattr(lda, "EVERY", 2)
    for dealt in (held, held.repartition(5)):
        assert np.allclose(lda.fit_em(dealt, size, k, 4), total.T)
    assert made == ["lda-batches"] * 2  # lineage is cut, else many iterations overflow the stack
    monkeypatch.setattr(lda, "EVERY", 8)
    assert not spark._jsparkSession.sharedState().cacheManager().lookupCachedData(held._jdf).isDefined() and not spark.sparkContext._jsc.getPersistentRDDs()
    found = {}
    for t, _, w, _ in lda.described(lda.fit_em(held, size, k, 60), 8):
        found.setdefault(t, set()).add(vectorizer.vocabulary[w][:2])
    assert len(found) == k


def test_fuzzy_matches_shuffle_no_tokens(spark, monkeypatch):
    """Tokens are stored once and joined with the values that match, which Spark broadcasts; exact keys of any source come first."""
    made = []
    monkeypatch.setattr(lexicon, "stored", lambda df, name, own=lexicon.stored: made.append(name) or own(df, name))
    plan = plans.QUERIES["token_match_export"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert made == ["tokens", "known"] and "SortMergeJoin" not in plan and "Generate posexplode" not in plan
    rows = [("meadows", "meadow", "NOUN"), ("meadowy", "xmeadow", "NOUN"), ("meadowz", "qqqqqqq", "NOUN"), ("qqqqqqq", "zzzzzzz", "NOUN"), ("meadow", "meadow", "ADP"), ("meadow", None, "NOUN")]
    tokens = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, form string, lemma string, upos string")
    keys = spark.createDataFrame([("meadow", 1.0)], "key string, joy double")
    got = lexicon.match_by_sources(tokens, keys, ["lemma", "form"], ["NOUN"], 92).orderBy("i").collect()
    score = 200 * 6 / 13
    assert [(r.lex_key, r.source, r.fuzzy_score, r.joy) for r in got] == [("meadow", "lemma", None, 1.0), ("meadow", "lemma:fuzzy:xmeadow", score, 1.0), ("meadow", "form:fuzzy:meadowz", score, 1.0), (None, None, None, None), (None, None, None, None), ("meadow", "form", None, 1.0)]


def test_graphs_broadcast_no_table_of_rows(spark, monkeypatch):
    made = []
    for m in (graph, density, models):
        monkeypatch.setattr(m, "stored", lambda df, name, own=m.stored: made.append((name, df._jdf.queryExecution().executedPlan().toString())) or own(df, name))
    last = plans.QUERIES["document_clusters"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert {"roots", "cross", "trees", "levels"} <= {n for n, _ in made} and "Broadcast" not in last
    assert not [n for n, p in made if "Broadcast" in p]


def test_lines_stay_uncut_for_tokens_and_render(spark, monkeypatch):
    """They are stored as lines, and give the same tokens and blocks as rows of cells."""
    made = []
    monkeypatch.setattr(conllu, "stored", lambda df, name, own=conllu.stored: made.append((name, dict(df.dtypes), df._jdf.queryExecution().executedPlan().toString())) or own(df, name))
    for name in ("conllu_tokens", "conllu_restored"):
        plans.QUERIES[name](spark, DATA)
    held = [(kinds, plan) for name, kinds, plan in made if name == "conllu-sentences"]
    assert len(held) == 2 and all(kinds["body"] == "array<string>" and "array<array<string>>" not in kinds.values() and not {"text", "bad_rows"} & set(kinds) and "split(lambda" not in plan for kinds, plan in held)
    fields = "\t".join("_" * 5)
    lines = ["# newdoc id = a", "# sent_id = s", f"1\tAb\ty\tX\t{fields}\tNER=B|SpaceAfter=No", f"1-2\tx\ty\tX\t{fields}\t_", f"1.1\tx\ty\tX\t{fields}\t_", "3\tshort", f"4\tx-.\ty\tX\t{fields}\t_", f"\tx\ty\tX\t{fields}\t", f"5\tx\ty\tX\t{fields}\t_\tlong"]
    raw = spark.createDataFrame([("f", 0, 0, lines), ("f", 0, 1, ["# only"]), ("f", 1, 2, [f"1\tq\ty\tX\t{fields}\tA=1|A=2|B"])], "file string, split long, at long, lines array<string>")
    rows, uncut = conllu.sentences(raw), conllu.sentences(raw, None, ("rows",))
    assert "lines" in uncut.columns and "rows" not in uncut.columns and [len(r.rows) for r in rows.orderBy("at").collect()] == [3, 0, 1] and [r.bad_rows for r in rows.orderBy("at").collect()] == [2, 0, 0]
    assert conllu.tokens(rows).orderBy("ordinal").collect() == conllu.tokens(uncut).orderBy("ordinal").collect()
    assert [r.misc for r in conllu.tokens(rows).orderBy("ordinal").collect()] == [{"NER": "B", "SpaceAfter": "No"}, {}, {}, {"A": "2", "B": ""}]
    assert conllu.render(rows).orderBy("at").collect() == conllu.render(uncut).orderBy("at").collect()


def test_problems_look_at_each_row_once(spark):
    """Heads outside a sentence are told by hashes, not by a search through its ids for each row."""
    row = lambda i, head, name="dep": [i, "x", "x", "X", "_", "_", head, name, "_", "_"]
    rows = [[row("1", "0", "root"), row("2", "9"), row("3", "9"), row("4", "8"), row("5", "1")], [row("1", "0"), row("b", "x"), row("3", "-1"), row("4", "0", "root")], [], [row("1", "1")]]
    table = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, rows array<array<string>>")
    found = table.select("i", conllu.problems_of("rows").alias("p"))
    assert [r.p for r in found.orderBy("i").collect()] == [["head_outside"] * 3, ["bad_head", "bad_id", "root_name", "root_count"], [], ["root_count"]]
    assert "array_contains" not in found._jdf.queryExecution().optimizedPlan().toString()
