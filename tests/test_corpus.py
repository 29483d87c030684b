"""Corpus operators against small hand-made cases and DuckDB."""

import glob
import os
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexharbor import plans, streaming
from lexharbor.functions import text as tx
from lexharbor.operators import lexicon, metadata, segments, summary, topics
from lexharbor.sources import conllu, delimited

DATA = "/root/testdata/sf0.001"
CONLLU = """# newdoc id = d1
# naslov = One
# sent_id = d1.1
1\tJanez\tJanez\tPROPN\t_\t_\t2\tnsubj\t_\tNER=B-PER
2\tNovak\tNovak\tPROPN\t_\t_\t0\troot\t_\tNER=I-PER|SpaceAfter=No
3\t.\t.\tPUNCT\t_\t_\t2\tpunct\t_\tNER=O

# sent_id = d1.2
1-2\tdoa\t_\t_\t_\t_\t_\t_\t_\t_
1\tdo\tdo\tADP\t_\t_\t9\tcase\t_\tNER=I-LOC
2\ta\ta\tDET\t_\t_\t0\troot\t_\t_
bad\trow
"""


def clean(rows):
    return sorted(repr([None if x is None or x != x else round(float(x), 6) if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x) for x in r]) for r in rows)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", list(plans.ORACLE))
def test_query_equals_sql(spark, sql, name):
    got = plans.QUERIES[name](spark, DATA)
    want = sql.execute(plans.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert clean(got.select(sorted(got.columns)).toPandas().itertuples(index=False)) == clean(want[sorted(want.columns)].itertuples(index=False))


def test_models(spark):
    """Clusters and coordinates against numpy; the grid's choice follows its own figures."""
    vectors = {r.vec_id: np.array(r.embedding, dtype=float) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    found = {r.vec_id: r.cluster for r in plans.QUERIES["kmeans_clusters"](spark, DATA).collect()}
    assert set(found) == set(vectors) and 2 <= len(set(found.values())) <= 22
    centre = {c: np.mean([vectors[i] for i in found if found[i] == c], axis=0) for c in set(found.values())}
    near = sum(min(centre, key=lambda c: ((vectors[i] - centre[c]) ** 2).sum()) == found[i] for i in found)
    assert near > 0.9 * len(found)
    m = np.array([vectors[i] for i in sorted(vectors)])
    m = m - m.mean(axis=0)
    _, _, axes = np.linalg.svd(m, full_matrices=False)
    got = np.array([(r.x, r.y) for r in plans.QUERIES["pca_coords"](spark, DATA).orderBy("vec_id").collect()])
    assert all(min(abs(got[:, k] - m @ axes[k]).max(), abs(got[:, k] + m @ axes[k]).max()) < 1e-6 for k in (0, 1))
    held = plans.QUERIES["cluster_silhouette"](spark, DATA).collect()
    assert len({r.silhouette for r in held}) == 1 and -1 <= held[0].silhouette <= 1
    grid = plans.QUERIES["lda_grid"](spark, DATA).collect()
    assert [r.k for r in grid if r.chosen] == [min(grid, key=lambda r: (-r.coherence, r.perplexity)).k] and all(r.perplexity > 1 for r in grid)
    shares = plans.QUERIES["lda_segment_topics"](spark, DATA).groupBy("doc_id").agg(F.sum("probability").alias("p"), F.count_if("dominant").alias("d")).collect()
    assert shares and all(abs(r.p - 1) < 1e-6 and r.d == 1 for r in shares)


def test_model_is_kept(spark, tmp_path):
    docs = spark.createDataFrame([(i, [f"w{(5 * i + j) % 60}" for j in range(30)]) for i in range(12)], "doc_id long, words array<string>")
    rows, vectorizer = topics._vectorized(docs, 30)
    from pyspark.ml.clustering import LDA

    topics.save_topics(LDA(k=2, maxIter=2).fit(rows), vectorizer, str(tmp_path / "m"))
    assert topics.load_topics(str(tmp_path / "m")).transform(docs).filter("topicDistribution IS NOT NULL").count() == 12
    assert topics._vectorized(docs, 31)[1] is None


def test_conllu(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.conllu").write_text(CONLLU)
    (tmp_path / "in" / "b.conllu").write_bytes(b"\xef\xbb\xbf" + CONLLU.replace("d1", "d2").replace("\n\n", "\n \t\n\n").replace("\n", "\r\n").encode())
    sents = conllu.sentences(conllu.blocks(conllu.lines(spark, str(tmp_path / "in"))))
    toks = conllu.tokens(sents)
    for d in ("d1", "d2"):
        assert [(r.doc_id, r.sentence_index, r.form, r.ner, r.no_space_after, r.is_word) for r in toks.filter(F.col("doc_id") == d).orderBy("sentence_index", "token_index").collect()] == [(d, 0, "Janez", "B-PER", False, True), (d, 0, "Novak", "I-PER", True, True), (d, 0, ".", "O", False, False), (d, 1, "do", "I-LOC", False, True), (d, 1, "a", "O", False, True)]
    assert sorted((r.doc_id, r.key, r.value, r.aliased) for r in conllu.metadata(sents).collect()) == [("d1", "title", "One", 1), ("d2", "title", "One", 1)]
    assert sorted((r.sent_id, r.problem) for r in conllu.problems(sents).collect()) == [("d1.2", "head_outside"), ("d2.2", "head_outside")]
    level = {r["item"]: (r.n, r.level) for r in conllu.integrity(sents, 3, {"title": 1.0, "genre": 0.5}).collect()}
    assert level["column_count"] == (2, "error") and level["repeated_doc_id"] == (0, "ok") and level["few_documents"] == (2, "error") and level["coverage_title"] == (2, "ok") and level["coverage_genre"] == (0, "error")
    spans = summary.iob_spans(toks, ["doc_id", "sent_id"], "token_index").collect()
    assert [(r.type, r.text) for r in spans] == [("PER", "Janez Novak")] * 2
    conllu.write(sents, str(tmp_path / "out"))
    again = conllu.sentences(conllu.blocks(conllu.lines(spark, str(tmp_path / "out"))))
    same = lambda s: sorted((r.doc_id, r.sentence_index, tuple(r.comments), tuple(map(tuple, r.rows))) for r in s.collect())
    assert same(again) == same(sents)


def test_conllu_in_splits(spark, tmp_path):
    """Documents, paragraphs and sentences of one file are the same however it is split."""
    parts = [f"# newdoc id = d{i // 7}\n# newpar id = p{i // 3}" if i % 7 == 0 else f"# newpar id = p{i // 3}" if i % 3 == 0 else "# remark" for i in range(100)]
    (tmp_path / "a.conllu").write_text("\n\n".join(f"{p}\n# sent_id = s{i}\n1\tw{i}\tw\tNOUN\t_\t_\t0\troot\t_\t_" for i, p in enumerate(parts)) + "\n\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
        read = conllu.lines(spark, str(tmp_path / "a.conllu"))
        assert read.select("split").distinct().count() > 10
        got = sorted((int(r.sent_id[1:]), r.doc_id, r.sentence_index) for r in conllu.tokens(conllu.sentences(conllu.blocks(read))).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(i, f"d{i // 7}", i % 7) for i in range(100)]


def test_encodings(spark, tmp_path):
    for name, content in (("a", "čaj\r\nž".encode("cp1250")), ("b", "\ufeffčaj\nž".encode()), ("c", "čaj\nž".encode())):
        (tmp_path / f"{name}.txt").write_bytes(content)
    got = conllu.legacy_lines(spark, str(tmp_path)).groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "value"))), lambda x: x.value), "|").alias("t")).collect()
    assert sorted(r.t for r in got) == ["čaj|ž"] * 3


def test_xml(spark, tmp_path):
    (tmp_path / "bad.xml").write_text("<corpus>\n<doc title='A & B' Century=\"19. stol.\" n=3>Text &lt;one&gt; \x01</doc>\n<doc title=\"C>D\">two <b>bold</b>\n more</doc><docs/></corpus>")
    rows = conllu.xml_documents(spark, str(tmp_path / "bad.xml")).orderBy("doc_no").collect()
    assert [(r.attrs, r.text) for r in rows] == [({"title": "A & B", "century": "19. stol.", "n": "3"}, "Text <one>"), ({"title": "C>D"}, "two bold\nmore")]
    with pytest.raises(Exception):  # noqa: B017
        conllu.xml_documents(spark, str(tmp_path / "bad.xml"), mode="strict").collect()
    (tmp_path / "good.xml").write_text('<corpus><doc title="A" century="19">Text</doc><doc id="x">2</doc><doc id="x">3</doc></corpus>')
    rows = conllu.disambiguated(conllu.xml_documents(spark, str(tmp_path / "good.xml"), mode="strict")).orderBy("doc_no").collect()
    assert [(r.doc_id, r.text) for r in rows] == [("A", "Text"), ("x", "2"), ("x-002", "3")]
    text = spark.createDataFrame([("<doc a='1' b=\"x &amp; y\">t <doc2 a='1'/></doc>",)], "x string")
    assert text.select(conllu.rewritten_tags(F.col("x"), "doc", lambda m: F.map_filter(m, lambda k, v: k == "b"))).first()[0] == '<doc b="x &amp; y">t <doc2 a=\'1\'/></doc>'


def test_alignment_and_restoring(spark):
    docs = spark.createDataFrame([(i, f"d{i}") for i in range(10)], "pos long, doc_id string")
    source = spark.createDataFrame([(i, f"d{i}", {"title": f"t{i}"}) for i in range(8)] + [(9, "d1", {"title": "later"})], "pos long, doc_id string, attrs map<string,string>")
    assert {r.doc_id: r.attrs and r.attrs["title"] for r in metadata.aligned(docs, source).collect()} == {f"d{i}": f"t{i}" if i < 8 else None for i in range(10)}
    with pytest.raises(ValueError):
        metadata.aligned(docs, source, "by-order")
    same = docs.withColumn("doc_id", F.lit("doc"))
    full = source.union(source.limit(1).withColumn("pos", F.lit(20).cast("long")))
    rows = metadata.aligned(same, full)
    assert [r.attrs["title"] for r in rows.orderBy("pos").collect()] == [f"t{i}" for i in range(8)] + ["later", "t0"]
    assert [r.out_id for r in metadata.output_ids(rows).orderBy("pos").collect()] == [*(f"d{i}" for i in range(8)), "d1__0002", "d0__0002"]
    assert [r.out_id for r in metadata.output_ids(rows, "order").orderBy("pos").collect()][:2] == ["doc-000001", "doc-000002"]
    assert sorted(r.place for r in metadata.placed(docs, "pos", 3).collect()) == list(range(10))
    with pytest.raises(ValueError):
        metadata.aligned(docs, source.withColumn("doc_id", F.lit("none")), "by-id")


def test_maps(spark):
    rows = spark.createDataFrame([("a", 0, "k", "1"), ("a", 1, "K2", "2"), ("b", 0, "old", "x")], "doc_id string, pos int, key string, value string")
    keys = spark.createDataFrame([("K2", "k", "keep"), ("old", "", "keep")], "original_key string, canonical_key string, action string")
    values = spark.createDataFrame([("old", "x", "y", "replace")], "key string, old_value string, new_value string, action string")
    got = lambda p: sorted((r.doc_id, r.key, r.value) for r in metadata.apply_maps(rows, keys, values, p).collect())
    assert [got(p) for p in ("existing", "incoming", "join")] == [[("a", "k", v), ("b", "old", "y")] for v in ("1", "2", "1 | 2")]
    with pytest.raises(Exception, match="conflicting"):
        got("abort")
    with pytest.raises(Exception, match="invalid action"):
        metadata.apply_maps(rows, keys.withColumn("action", F.lit("delete")), values).collect()


def test_lexicon_columns(spark):
    table = spark.createDataFrame([("1", "Vesel|radost", "joy", "0,5", "da", "1"), ("2", "tih", "sad", "1", "", "n")], "`Id` string, `Slovenian word(s)` string, English string, `Joy-intensity` string, veselje string, `Žalost` string")
    assert lexicon.word_column(table) == "Slovenian word(s)" and lexicon.word_column(table, "english") == "English"
    assert lexicon.roles(table, "Slovenian word(s)") == {"joy intensity": ["Joy-intensity"], "joy": ["veselje"], "sadness": ["Žalost"]}
    got = {r.key: (r.joy, r.joy_intensity, r.sadness, r.anger, r.valence) for r in lexicon.load_by_roles(table).collect()}
    assert got == {"vesel": (1.0, 0.5, 1.0, 0.0, None), "radost": (1.0, 0.5, 1.0, 0.0, None), "tih": (0.0, 1.0, 0.0, 0.0, None)}
    with pytest.raises(ValueError):
        lexicon.word_column(table, "nothing")


def test_text_functions(spark):
    odd = spark.createDataFrame([("  »ZhaaaaR—x«  ",), (None,), ("Čaj",)], "s string")
    assert [[r[0] for r in odd.select(tx.lexeme(m)(F.col("s"))).collect()] for m in ("simple", "historical", "ascii")] == [["zhaaaar-x", "", "čaj"], ["čaar-x", "", "čaj"], ["zhaaaar-x", "", "caj"]]
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(tx.century(F.lit(x))) for x in ("IX. stol.", "xv", "ok 1850", "7", "no")] == [9, 15, 19, 7, None]
    assert [one(tx.number(F.lit(x))) for x in ("y", "T", "n", "f", "1,5", "?")] == [1.0, 1.0, 0.0, 0.0, 1.5, None]
    assert [one(tx.time_key(F.lit(x))) for x in ("leta 1895", "19. stol.", "no 12345", "x")] == [1895.0, 19.0, 12345.0, None]
    assert one(tx.bundle(F.lit("a = 1; b=2;a=3"))) == {"a": "1", "b": "2"} and one(tx.bundle(F.lit('{"a": "x"}'))) == {"a": "x"}
    assert one(tx.bare_name(F.lit("{http://x}id"))) == "id" and one(tx.bare_name(F.lit("xml:id"))) == "id" and one(tx.comment_safe(F.lit("a\n b\x01"))) == "a b"
    assert one(tx.canonical_key(F.lit("newdoc id"))) == "" and one(tx.canonical_key(F.lit("doc_meta.Gernre"))) == "genre" and one(tx.word_count(F.lit("a_1 b-č"))) == 3
    blocks = one(tx.packed_blocks(F.lit("aa bb\ncc\n\n" + "word " * 5 + "\nx"), 10))
    assert blocks == ["aa bb\ncc", "word word", "word word", "word\nx"] and one(tx.packed_blocks(F.lit("a\nb"), 10, "none")) == ["a\nb"]
    plain = spark.createDataFrame([("č",), ("Á x",)], "s string").select(tx.fold(F.col("s"))).collect()
    assert [r[0] for r in plain] == ["c", "a x"]


def test_scores_of_streams(spark, tmp_path):
    docs = spark.createDataFrame([(1, "joy of w"), (2, "w w")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    lex = spark.createDataFrame([("joy", 1.0)], "key string, joy double").withColumns({c: F.lit(0.0) for c in [*lexicon.EMOTIONS, *lexicon.SENTIMENTS, *lexicon.VAD] if c != "joy"})
    streaming.follow(spark, str(tmp_path / "in"), docs.schema, lex, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted((r.doc_id, r.hits, r.joy) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 1, 1.0), (2, 0, 0.0)]


def test_windows_and_lexicon(spark):
    docs = spark.createDataFrame([(n, " ".join(["w"] * n)) for n in (0, 1, 250, 251, 260, 500)], "doc_id long, text string")
    got = {(r.doc_id, r.seg_no): len(r.words) for r in segments.windows(docs).collect()}
    assert got == {(0, 1): 0, (1, 1): 1, (250, 1): 250, (251, 1): 250, (251, 2): 126, (260, 1): 250, (260, 2): 135, (500, 1): 250, (500, 2): 250, (500, 3): 250, (500, 4): 125}
    rows = spark.createDataFrame([("Vesel|radost", "1", "0,5"), ("vesel", "da", ""), (None, "1", "1")], "word string, joy string, valence string")
    assert sorted(map(tuple, lexicon.load(rows, "word", ["joy", "valence"]).collect())) == [("radost", 1.0, 0.5), ("vesel", 1.0, 0.25)]


def test_scalars_and_tables(spark, tmp_path):
    df = spark.createDataFrame([("19. stol.",), ("leta 1895",), ("XIX",), ("",)], "s string")
    assert [r[0] for r in df.select(tx.century(F.col("s"))).collect()] == [19, 19, 19, None]
    one = spark.createDataFrame([("a=1|b|a=2|c=x=y",)], "m string").select(tx.misc_map(F.col("m")).alias("m"), tx.canonical_key(F.lit("document.Gnere")).alias("k")).first()
    assert one.m == {"b": "", "a": "2", "c": "x=y"} and one.k == "genre"
    (tmp_path / "t.csv").write_text("ID;x\n1;\n1;b\n2;c\n")
    side = delimited.sidecar(delimited.read(spark, str(tmp_path / "t.csv")))
    assert sorted(map(tuple, side.collect())) == [("1", ""), ("2", "c")]
    long = spark.createDataFrame([("d", "k", "a", 1), ("d", "k", "b", 2)], "doc_id string, key string, value string, pos int")
    assert [delimited.resolved(long, p).first().value for p in ("existing", "incoming", "join")] == ["a", "b", "a | b"]


def test_weighted(spark):
    rows = spark.createDataFrame([("a", 1.0, 2), ("a", 4.0, 1), ("b", 3.0, 0), ("c", None, 5)], "g string, m double, w int")
    got = {r.g: r.m for r in summary.weighted(rows, ["g"], [], ["m"], "w").collect()}
    assert got == {"a": 2.0, "b": 3.0, "c": None}


def test_lda_reads_every_document(spark):
    """Counts of all documents are the topics' shares, mixed by the topics' sizes."""
    rng = np.random.default_rng(3)
    rows = [(i, [f"w{x}" for x in rng.integers(0, 12, 30 + i % 5) + 8 * (i % 3)]) for i in range(60)]
    short = [(100 + i, ["short"] * 29) for i in range(5)]
    got = topics.lda(spark.createDataFrame(rows + short, "doc_id long, words array<string>"), k=2, terms=40).collect()
    share = {t: {r.term: r.weight for r in got if r.topic == t} for t in (0, 1)}
    n = Counter(w for _, words in rows for w in words)
    assert set(share[0]) == set(share[1]) == set(n)
    x, y = (np.array([share[t][w] for w in n]) for t in (0, 1))
    total = np.array([n[w] for w in n], dtype=float)
    size = (total - total.sum() * y) @ (x - y) / ((x - y) @ (x - y))
    assert np.abs(size * x + (total.sum() - size) * y - total).max() < 1e-6 * total.sum()
    full = topics.lda(spark.createDataFrame(rows, "doc_id long, words array<string>"))
    assert full.groupBy("topic").count().filter("count = 20").count() == 20
    assert topics.lda(spark.createDataFrame(short, "doc_id long, words array<string>")).count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("id\ta;b\tn\n1\tx;y\t2,5\n2\t\t\n")
    table = delimited.read(spark, str(tmp_path / "t.tsv"))
    assert table.columns == ["id", "a;b", "n"] and {r["column"]: r["type"] for r in delimited.column_types(table).collect()} == {"id": "bigint", "a;b": "string", "n": "string"}
    assert dict(delimited.retyped(table).dtypes)["id"] == "bigint"
    assert [(r.pos, r.doc_id, r.attrs) for r in delimited.source_rows(spark, str(tmp_path / "t.tsv")).orderBy("pos").collect()] == [(0, "1", {"id": "1", "a;b": "x;y", "n": "2,5"}), (1, "2", {"id": "2"})]
    (tmp_path / "m.conllu").write_text(CONLLU)
    assert [(r.doc_id, r.attrs) for r in delimited.source_rows(spark, str(tmp_path / "m.conllu")).collect()] == [("d1", {"title": "One"})]
    (tmp_path / "m.xml").write_text('<c><doc id="a" title="T">x</doc><doc id="a">y</doc></c>')
    assert [(r.doc_id, r.attrs["id"]) for r in delimited.source_rows(spark, str(tmp_path / "m.xml")).orderBy("pos").collect()] == [("a", "a"), ("a-002", "a")]
    (tmp_path / "stop.txt").write_text("# none\nEiner,\n\n")
    words = {r.word for r in delimited.stopwords(spark, str(tmp_path / "stop.txt"), "Und").collect()}
    assert {"einer", "und", "ali"} <= words and "# none" not in words
    delimited.write_tsv(table, str(tmp_path / "out"), True)
    assert delimited.manifest(spark, str(tmp_path / "t.tsv")).first().length == 23
    kept = delimited.run_manifest({"t": table}, {"a": 1}, ["w"]).collect()
    assert [tuple(r) for r in kept] == [("argument", "a", "1"), ("warning", "1", "w"), ("rows", "t", "2")]
