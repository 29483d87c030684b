"""CoNLL-U rows that nothing asks for aren't stored; texts are cut once for topics; scores and clusters shuffle little."""

import re

from pyspark.sql import functions as F

from lexharbor import plans
from lexharbor.operators import lexicon, reduction, review, topics
from lexharbor.plans import corpus
from lexharbor.sources import conllu

DATA = "/root/testdata/sf0.001"


def kept(monkeypatch, *modules):
    """(name, columns) of the tables that are stored from here on."""
    made = []
    for m in modules:
        monkeypatch.setattr(m, "stored", lambda df, name, own=m.stored: made.append((name, df.columns)) or own(df, name))
    return made


def test_rows_are_neither_sorted_nor_stored(spark, monkeypatch):
    made = kept(monkeypatch, conllu)
    for name in ("conllu_metadata", "conllu_paragraphs", "conllu_problems", "conllu_integrity", "conllu_frequencies"):
        plans.QUERIES[name](spark, DATA)
    assert len(made) == 8 and not any({"rows", "body"} & set(columns) for _, columns in made)


def test_facts_stand_in_place_of_rows(spark):
    fields = "\t".join("_" * 7)
    lines = ["# newdoc id = a", "# sent_id = s", f"1\tAb\ty\t{fields}", f"1-2\tx\ty\t{fields}", "3\tshort", f"4\tx\ty\t{fields}"]
    raw = spark.createDataFrame([("f", 0, 0, lines), ("f", 0, 1, ["# only"]), ("f", 1, 2, [f"1\tq\ty\t{fields}"])], "file string, split long, at long, lines array<string>")
    whole, facts = conllu.sentences(raw), conllu.sentences(raw, {"n": F.size("rows"), "problems": conllu.problems_of("rows"), "glued": conllu.glued(F.col("rows"))})
    own = [c for c in whole.columns if c != "rows"]
    assert whole.select(own).orderBy("at").collect() == facts.select(own).orderBy("at").collect()
    assert [r.n for r in facts.orderBy("at").collect()] == [2, 0, 1]
    assert sorted(map(str, conllu.problems(whole).collect())) == sorted(map(str, conllu.problems(facts).collect()))
    assert conllu.integrity(whole).collect() == conllu.integrity(facts).collect()
    assert sorted(conllu.frequencies(whole).collect()) == sorted(conllu.frequencies(conllu.parsed(raw)).collect())


def test_vocabulary_keeps_no_words_in_memory(spark, monkeypatch):
    """A share of documents goes to the vectorizer as their number; words and counts are stored once."""
    made, given = kept(monkeypatch, topics), []
    monkeypatch.setattr(topics, "CountVectorizer", lambda own=topics.CountVectorizer, **k: given.append(k) or own(**k))
    docs = spark.createDataFrame([(i, [f"w{(5 * i + j) % 60}" for j in range(30)] + ["all"]) for i in range(12)], "doc_id long, words array<string>")
    rows, model = topics._vectorized(docs, 30)
    assert given[0]["maxDF"] == 0.85 * 12 and "all" not in model.vocabulary and len(model.vocabulary) == 60
    assert made == [("words", ["doc_id", "words"]), ("features", ["doc_id", "features"])] and rows.count() == 12


def test_scores_shuffle_no_words(spark):
    """Words stay dealt by document, and no set of entries is held."""
    plan = corpus._doc_scores(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "collect_set" not in plan
    words = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (1, "x"), (2, "x")], "doc_id long, word string")
    keys = spark.createDataFrame([("a", 1.0, 0.5), ("b", 0.0, None)], "key string, joy double, valence double")
    rest = [c for c in [*lexicon.EMOTIONS, *lexicon.SENTIMENTS, *lexicon.VAD] if c not in keys.columns]
    got = lexicon.score(lexicon.match(words, keys.withColumns({c: F.lit(None).cast("double") for c in rest})), ["doc_id"], spark.range(1, 4).withColumnRenamed("id", "doc_id"))
    assert [tuple(r) for r in got.select("doc_id", "n_words", "hits", "distinct_hits", "joy", "fear", "valence").orderBy("doc_id").collect()] == [(1, 4, 3, 2, 2.0, 0.0, 0.5), (2, 1, 0, 0, 0.0, 0.0, None), (3, 0, 0, 0, 0.0, 0.0, None)]


def test_cluster_terms_shuffle_counts_once(spark, monkeypatch):
    made, plans_ = [], []
    monkeypatch.setattr(review, "stored", lambda df, name, own=review.stored: plans_.append(df._jdf.queryExecution().executedPlan().toString()) or made.append(name) or own(df, name))
    plans.QUERIES["cluster_top_terms"](spark, DATA)
    assert made == ["counts", "idf", "norms"] and "hashpartitioning(lang" not in plans_[0]


def test_topic_words_are_counted_once(spark, monkeypatch):
    made = kept(monkeypatch, reduction)
    plan = plans.QUERIES["topic_similarities"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert [n for n, _ in made] == ["class-counts", "class-vectors"] and "Generate" not in plan
