"""Queries of the corpus operators over the given tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as tx
from ..operators import lexicon as lx, segments as sg, summary as sm, topics as tp
from ..sources import conllu, resumable
from ..sources.stored import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
EMO = lx.EMOTIONS


def query(sql: str | None = None, rounded: list[str] = ()):
    """Register a query and its SQL. Means of fractions depend on the order of addition: those in ``rounded`` are rounded in both."""

    def add(f):
        QUERIES[f.__name__] = (lambda spark, d: f(spark, d).withColumns({c: F.round(c, 8) for c in rounded})) if rounded else f
        if sql is not None:
            ORACLE[f.__name__] = f"SELECT * REPLACE ({', '.join(f'round({c}, 8) AS {c}' for c in rounded)}) FROM ({sql})" if rounded else sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _lexicon(spark: SparkSession, d: str) -> DataFrame:
    """A lexicon over the vocabulary of ``benchmark``; values follow from each word's length and first letter."""
    w = _t(spark, d, "benchmark").select(F.explode(tx.words(F.col("text"))).alias("key")).distinct()
    n, a = F.length("key"), F.ascii("key")
    flags = {e: F.when((a + n * (i + 1)) % 5 == 0, 1.0).otherwise(0.0) for i, e in enumerate(EMO + lx.SENTIMENTS)}
    return w.withColumns(flags | {v: ((a * (i + 2) + n) % 8) / 8.0 for i, v in enumerate(lx.VAD)})


_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '\p{L}+')"
_TOK = f"tok AS (SELECT doc_id, lang, source, unnest({_WORDS}) AS word FROM documents)"
_LEX = "lex AS (SELECT key, " + ", ".join(f"CASE WHEN (ascii(key) + length(key) * {i + 1}) % 5 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS {e}" for i, e in enumerate(EMO + lx.SENTIMENTS)) + ", " + ", ".join(f"((ascii(key) * {i + 2} + length(key)) % 8) / 8.0::DOUBLE AS {v}" for i, v in enumerate(lx.VAD)) + f" FROM (SELECT DISTINCT unnest({_WORDS}) AS key FROM benchmark))"
_SUMS = ", ".join(f"coalesce(sum({e}), 0)::DOUBLE AS {e}" for e in EMO + lx.SENTIMENTS) + ", " + ", ".join(f"avg({v}) AS {v}" for v in lx.VAD)
_TOTAL = " + ".join(EMO)
_MOST = f"greatest({', '.join(EMO)})"
_DOM = "CASE WHEN total > 0 THEN CASE " + " ".join(f"WHEN {e} = most THEN '{e}'" for e in EMO) + " END END"


def _scored(source: str, keys: str) -> str:
    return f"""g AS (SELECT {keys}, count(word) AS n_words, count(key) AS hits, count(DISTINCT key) AS distinct_hits, {_SUMS} FROM {source} LEFT JOIN lex ON word = key GROUP BY {keys}),
s AS (SELECT *, {_TOTAL} AS total, {_MOST} AS most FROM g),
scores AS (SELECT * EXCLUDE (most), hits / greatest(n_words, 1) AS coverage, {", ".join(f"{e} / greatest(n_words, 1) * 1000 AS {e}_per_1k" for e in EMO)},
 (positive - negative) / nullif(positive + negative, 0) AS balance, {_DOM} AS dominant, CASE WHEN total > 0 THEN most / total ELSE 0 END AS dominant_share FROM s)"""


_DOCS = f"WITH {_TOK}, {_LEX}, every AS (SELECT d.doc_id, word FROM documents d LEFT JOIN tok USING (doc_id)), {_scored('every', 'doc_id')}"


def _worded(spark: SparkSession, d: str) -> DataFrame:
    """doc_id and words of the documents, which are dealt before they are cut."""
    return sg.spread(_t(spark, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id", tx.words(F.col("text")).alias("words"))


def _doc_scores(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents")
    return lx.score(lx.match(sg.tokens(sg.spread(docs.select("doc_id", "text"), "doc_id")), _lexicon(spark, d)), ["doc_id"], docs)


@query(f"{_DOCS} SELECT * FROM scores")
def doc_emotion_scores(spark, d):
    return _doc_scores(spark, d)


@query(f"{_DOCS} SELECT * FROM scores")
def document_scores_resumed(spark, d):
    """The same in batches that a stopped run leaves behind and the next one completes."""
    docs, lexicon = _t(spark, d, "documents").select("doc_id", "text"), _lexicon(spark, d)
    score = lambda part: lx.score(lx.match(sg.tokens(part), lexicon), ["doc_id"], part)
    return resumable.run(docs, "doc_id", score, f"{shared_dir(spark)}/document-scores", {"lexicon": resumable.fingerprint({}, lexicon)}, 4, ("text",))


@query(f"WITH {_TOK} SELECT word, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM tok GROUP BY 1")
def type_counts(spark, d):
    return sg.tokens(_t(spark, d, "documents")).groupBy("word").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query(rf"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[.!?\n]+'), lambda x: trim(x) <> '')) AS n_sentences, len({_WORDS}) AS n_words, len(list_distinct({_WORDS})) AS n_types FROM documents")
def document_statistics(spark, d):
    return sg.statistics(_t(spark, d, "documents"))


_WIN = f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), n AS (SELECT *, len(w) AS n FROM w),
k AS (SELECT doc_id, w, unnest(CASE WHEN n <= 250 THEN [0] WHEN n >= 50 THEN range(0, ((n - 50) // 125)::BIGINT + 1) ELSE [] END) AS k FROM n),
win AS (SELECT doc_id, k + 1 AS seg_no, w[k * 125 + 1 : k * 125 + 250] AS words FROM k)"""


@query(f"{_WIN} SELECT doc_id, seg_no, len(words) AS n_words, md5(array_to_string(words, ' ')) AS digest FROM win")
def window_segments(spark, d):
    return sg.windows(_t(spark, d, "documents")).select("doc_id", "seg_no", F.size("words").cast("long").alias("n_words"), F.md5(F.array_join("words", " ")).alias("digest"))


def _window_scores(spark, d):
    return lx.score_windows(_t(spark, d, "documents"), _lexicon(spark, d))


@query(f"{_WIN}, wt AS (SELECT doc_id, seg_no, unnest(words) AS word FROM win), {_LEX}, {_scored('wt', 'doc_id, seg_no')} SELECT * FROM scores")
def segment_emotion_scores(spark, d):
    return _window_scores(spark, d)


@query(r"WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS p FROM documents) SELECT doc_id, unnest(range(1, len(p) + 1)) AS seg_no, md5(unnest(p)) AS digest FROM p")
def paragraph_segments(spark, d):
    return sg.pieces(_t(spark, d, "documents"), "paragraph").select("doc_id", "seg_no", F.md5("text").alias("digest"))


@query(r"WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?\n]+'), lambda x: trim(x)), lambda x: x <> '') AS p FROM documents) SELECT doc_id, unnest(range(1, len(p) + 1)) AS seg_no, md5(unnest(p)) AS digest FROM p")
def sentence_segments(spark, d):
    return sg.pieces(_t(spark, d, "documents"), "sentence").select("doc_id", "seg_no", F.md5("text").alias("digest"))


_RATES = [f"{e}_per_1k" for e in EMO]
_MEANS = [*_RATES, "coverage", "valence"]


def _by(column: str) -> str:
    means = ", ".join(f"sum({c} * n_words) / sum(CASE WHEN {c} IS NOT NULL THEN n_words END) AS {c}" for c in [*_RATES, "coverage", "valence"])
    return f"{_DOCS} SELECT {column}, count(*) AS n, sum(n_words)::BIGINT AS weight, {', '.join(f'sum({e}) AS {e}' for e in EMO)}, {means} FROM scores JOIN documents USING (doc_id) GROUP BY 1"


def _grouped(spark, d, column):
    rows = _doc_scores(spark, d).join(_t(spark, d, "documents").select("doc_id", column), "doc_id")
    return sm.weighted(rows, [column], EMO, [*_RATES, "coverage", "valence"], "n_words")


@query(_by("lang"), _MEANS)
def emotion_by_lang(spark, d):
    return _grouped(spark, d, "lang")


@query(_by("source"), _MEANS)
def emotion_by_source(spark, d):
    return _grouped(spark, d, "source")


@query("""WITH m AS (SELECT doc_id, 'lang' AS key, lang AS value FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents UNION ALL SELECT doc_id, 'quality', quality::VARCHAR FROM labels UNION ALL SELECT doc_id, 'toxic', toxic::VARCHAR FROM labels)
SELECT key, count(*) AS with_key, count(*) FILTER (coalesce(trim(value), '') <> '') AS with_value, count(*) FILTER (coalesce(trim(value), '') <> '') / (SELECT count(*) FROM documents) AS coverage FROM m GROUP BY 1""")
def metadata_coverage(spark, d):
    docs, labels = _t(spark, d, "documents"), _t(spark, d, "labels")
    rows = docs.select("doc_id", F.explode(F.create_map(F.lit("lang"), "lang", F.lit("source"), "source"))).unionByName(labels.select("doc_id", F.explode(F.create_map(F.lit("quality"), F.col("quality").cast("string"), F.lit("toxic"), F.col("toxic").cast("string")))))
    return sm.key_coverage(rows, docs.count())


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2")
def freq_lang_source(spark, d):
    return _t(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_text(spark, d):
    return _t(spark, d, "documents").groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query(f"""WITH {_TOK}, {_LEX}, c AS (SELECT word, count(*) AS n FROM tok GROUP BY 1), j AS (SELECT sum(n) AS a, count(*) AS b, coalesce(sum(n) FILTER (key IS NOT NULL), 0) AS h, count(key) AS k FROM c LEFT JOIN lex ON word = key)
SELECT unnest(['word_tokens', 'word_types', 'hit_tokens', 'hit_types', 'token_coverage', 'type_coverage']) AS metric, unnest([a::DOUBLE, b, h, k, h / a, k / b]) AS value FROM j""")
def lexicon_coverage(spark, d):
    return lx.coverage(sg.tokens(_t(spark, d, "documents")), _lexicon(spark, d))


@query(f"WITH {_TOK}, {_LEX}, c AS (SELECT word, count(*) AS n FROM tok GROUP BY 1 ORDER BY n DESC, word LIMIT 1000) SELECT word, n AS count FROM c WHERE word NOT IN (SELECT key FROM lex)")
def top_oov(spark, d):
    return lx.top_unknown(sg.tokens(_t(spark, d, "documents")), _lexicon(spark, d))


@query("""WITH r AS (SELECT unnest(string_split(replace(lower(p_name), ' ', '|'), '|')) AS k, p_size, p_partkey % 10 / 10.0::DOUBLE AS v FROM part), c AS (SELECT DISTINCT k, p_size, v FROM r WHERE k <> '')
SELECT k AS key, max(p_size)::DOUBLE AS joy, avg(v) AS valence FROM (SELECT unnest(list_distinct(list_filter(string_split(replace(lower(p_name), ' ', '|'), '|'), lambda x: x <> ''))) AS k, p_size, p_partkey % 10 / 10.0::DOUBLE AS v FROM part) GROUP BY 1""", ["valence"])
def lexicon_load_agg(spark, d):
    rows = _t(spark, d, "part").select(F.replace("p_name", F.lit(" "), F.lit("|")).alias("word"), F.col("p_size").cast("string").alias("joy"), (F.col("p_partkey") % 10 / 10.0).cast("string").alias("valence"))
    return lx.load(rows, "word", ["joy", "valence"])


@query("SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY md5(text)) > 1 THEN md5(text) || '__' || lpad(row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id)::VARCHAR, 4, '0') ELSE md5(text) END AS unique_id FROM documents")
def key_dedup_suffix(spark, d):
    return sm.suffixed(_t(spark, d, "documents").select("doc_id", F.md5("text").alias("id")), "id", "doc_id").select("doc_id", "unique_id")


@query("""WITH f AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM f)
SELECT user_id, run, event_type, count(*) AS n, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM r GROUP BY 1, 2, 3""")
def span_islands(spark, d):
    out = sm.islands(_t(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")
    return out.select("user_id", "run", "event_type", "n", F.unix_micros(F.col("first").cast("timestamp")).alias("first_us"), F.unix_micros(F.col("last").cast("timestamp")).alias("last_us"))


_ENT = r"""WITH e AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '\p{Lu}\p{Ll}+')) AS entity FROM documents)"""


def _entities(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\p{Lu}\p{Ll}+"), F.lit(0))).alias("entity"))


@query(f"{_ENT} SELECT entity, count(*) AS n FROM e GROUP BY 1")
def entity_counts(spark, d):
    return _entities(spark, d).groupBy("entity").agg(F.count("*").alias("n"))


@query(f"{_DOCS}, e AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '\\p{{Lu}}\\p{{Ll}}+')) AS entity FROM documents) SELECT entity, count(*) AS n, count(DISTINCT doc_id) AS n_docs, avg(joy_per_1k) AS joy, avg(fear_per_1k) AS fear FROM e LEFT JOIN scores USING (doc_id) GROUP BY 1", ["joy", "fear"])
def entity_emotion(spark, d):
    rows = _entities(spark, d).join(_doc_scores(spark, d).select("doc_id", "joy_per_1k", "fear_per_1k"), "doc_id", "left")
    return rows.groupBy("entity").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"), F.avg("joy_per_1k").alias("joy"), F.avg("fear_per_1k").alias("fear"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_meta(spark, d):
    return _t(spark, d, "events").select("event_id", F.from_json("props", "map<string,string>")["k"].alias("k"))


@query("WITH q AS (SELECT page_id, regexp_extract(url, '[?]([^#]*)', 1) AS q FROM pages), p AS (SELECT page_id, unnest(string_split(q, '&')) AS p FROM q WHERE q <> '') SELECT page_id, string_split(p, '=')[1] AS k, coalesce(string_split(p, '=')[2], '') AS v FROM p")
def misc_map(spark, d):
    q = F.replace(F.regexp_extract("url", "[?]([^#]*)", 1), F.lit("&"), F.lit("|"))
    return _t(spark, d, "pages").select("page_id", F.explode(tx.misc_map(q)).alias("k", "v"))


@query(r"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\s[^>]*>')) AS t FROM pages) SELECT page_id, regexp_extract(t, 'href\s*=\s*"([^"]*)"', 1) AS href, count(*) AS n FROM t GROUP BY 1, 2""")
def xml_recover_attrs(spark, d):
    tags = _t(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"<a\s[^>]*>"), F.lit(0))).alias("t"))
    return tags.select("page_id", F.coalesce(F.element_at(conllu.attributes(F.col("t")), "href"), F.lit("")).alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query(r"SELECT doc_id, substring(regexp_replace(regexp_replace(trim(regexp_replace(coalesce(text, ''), '[ \t\n\r]+', ' ', 'g')), ' ([.,;:!?])', '\1', 'g'), '(\p{Ll})(\p{Lu})', '\1 \2', 'g'), 1, 120) AS preview FROM documents")
def preview_clean(spark, d):
    return _t(spark, d, "documents").select("doc_id", tx.preview(F.col("text")).alias("preview"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '(\p{Ll})(\p{Lu})', '\1 \2', 'g')) AS digest FROM documents")
def glue_repair(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(tx.glue_repair(F.col("text"))).alias("digest"))


@query("SELECT o_orderkey, year(o_orderdate)::VARCHAR AS year, ((year(o_orderdate) - 1) // 100 + 1)::INT AS century FROM orders")
def year_century(spark, d):
    s = F.date_format(F.col("o_orderdate").cast("timestamp"), "dd.MM.yyyy")
    return _t(spark, d, "orders").select("o_orderkey", tx.year(s).alias("year"), tx.century(s).alias("century"))


@query("SELECT year(o_orderdate)::DOUBLE AS time_key, count(*) AS n, avg(o_totalprice) AS mean_price FROM orders GROUP BY 1", ["mean_price"])
def time_sorted_profile(spark, d):
    rows = _t(spark, d, "orders").withColumn("time_key", tx.time_key(F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy")))
    return rows.groupBy("time_key").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean_price")).orderBy(F.asc_nulls_last("time_key"))


_PRED = f"""p AS (SELECT conv_id, turn, role AS label, length(text) / 1000.0::DOUBLE AS score FROM conversations)"""


def _predictions(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("label"), (F.length("text") / 1000.0).alias("score"))


@query(f"WITH {_PRED} SELECT conv_id, turn, label, score, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn, label) AS rank FROM p QUALIFY rank <= 3")
def pred_topk(spark, d):
    return sm.top_k(_predictions(spark, d), ["conv_id"], [F.desc("score"), "turn", "label"], 3)


@query(f"WITH {_PRED}, g AS (SELECT conv_id, label, count(*) AS n, avg(score) AS mean_score FROM p GROUP BY 1, 2) SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, round(mean_score, 9) DESC, label) = 1", ["mean_score"])
def pred_doc_summary(spark, d):
    g = _predictions(spark, d).groupBy("conv_id", "label").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))
    return sm.best_per_key(g, "conv_id", [F.desc("n"), F.desc(F.round("mean_score", 9)), "label"])


@query(f"WITH {_PRED} SELECT conv_id, coalesce(avg(score) FILTER (label = 'assistant'), 0) AS assistant, coalesce(avg(score) FILTER (label = 'user'), 0) AS user_ FROM p GROUP BY 1", ["assistant", "user_"])
def pred_pivot(spark, d):
    return _predictions(spark, d).groupBy("conv_id").pivot("label", ["assistant", "user"]).agg(F.avg("score")).fillna(0.0).withColumnRenamed("user", "user_")


_CEN = """e AS (SELECT vec_id, label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT label, i, avg(x) AS c FROM e GROUP BY 1, 2),
cos AS (SELECT vec_id, label, round(sum(x * c) / nullif(sqrt(sum(x * x)) * sqrt(sum(c * c)), 0), 6) AS cosine FROM e JOIN c USING (label, i) GROUP BY 1, 2)"""


@query(f"WITH {_CEN} SELECT * FROM cos")
def centroid_cosine(spark, d):
    return tp.centroid_cosine(_t(spark, d, "embeddings"), "vec_id", "label", "embedding").withColumn("cosine", F.round("cosine", 6))


@query(f"WITH {_CEN} SELECT *, row_number() OVER (PARTITION BY label ORDER BY cosine DESC, vec_id) AS rank FROM cos QUALIFY rank <= 25")
def topic_examples(spark, d):
    return sm.top_k(centroid_cosine(spark, d), ["label"], [F.desc("cosine"), "vec_id"], 25)


@query("SELECT vec_id, label, md5(vec_id::VARCHAR || '-42') AS draw, row_number() OVER (PARTITION BY label ORDER BY md5(vec_id::VARCHAR || '-42'), vec_id) AS rank FROM embeddings QUALIFY rank <= 10")
def random_examples(spark, d):
    return sm.sample_per_group(_t(spark, d, "embeddings").select("vec_id", "label"), "label", "vec_id", 10, 42)


@query(f"""WITH {_TOK}, f AS (SELECT lang, word, count(*) AS tf FROM tok GROUP BY 1, 2), c AS (SELECT lang, sum(tf) AS cn FROM f GROUP BY 1), t AS (SELECT word, sum(tf) AS tn FROM f GROUP BY 1),
s AS (SELECT lang, word AS term, tf / cn * ln(1 + (SELECT avg(cn) FROM c) / tn) AS score FROM f JOIN c USING (lang) JOIN t USING (word))
SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(score, 12) DESC, term) AS rank FROM s QUALIFY rank <= 20""", ["score"])
def ctfidf(spark, d):
    docs = _t(spark, d, "documents")
    return tp.class_tfidf(docs.select("lang", F.explode(tx.words(F.col("text"))).alias("word")), "lang", 20)


@query(f"""WITH {_TOK}, c AS (SELECT lang, word, count(*) AS n FROM tok GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= 8),
t AS (SELECT lang AS topic, word AS term, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM c), h AS (SELECT DISTINCT topic, rank, doc_id FROM tok JOIN t ON word = term),
f AS (SELECT topic, rank, count(*) AS d FROM h GROUP BY 1, 2), b AS (SELECT x.topic, x.rank AS i, y.rank AS j, count(*) AS n FROM h x JOIN h y ON x.topic = y.topic AND x.doc_id = y.doc_id AND x.rank < y.rank GROUP BY 1, 2, 3),
g AS (SELECT x.topic, x.rank AS i, y.rank AS j FROM t x JOIN t y ON x.topic = y.topic AND x.rank < y.rank)
SELECT g.topic, avg(ln((coalesce(b.n, 0) + 1) / greatest(coalesce(f.d, 0), 1))) AS coherence FROM g LEFT JOIN b USING (topic, i, j) LEFT JOIN f ON f.topic = g.topic AND f.rank = g.i GROUP BY 1""", ["coherence"])
def umass_coherence(spark, d):
    docs = _t(spark, d, "documents")
    counts = docs.select("lang", F.explode(tx.words(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    topics = sm.top_k(counts, ["lang"], [F.desc("n"), "word"], 8).select(F.col("lang").alias("topic"), "rank", F.col("word").alias("term"))
    return tp.umass(sg.tokens(docs), topics)


_UNP = "u AS (SELECT doc_id, seg_no, n_words, coverage, hits, unnest([" + ", ".join(f"'{e}'" for e in EMO) + "]) AS emotion, unnest([" + ", ".join(_RATES) + "]) AS rate FROM scores)"
_EXT = f"{_WIN}, wt AS (SELECT doc_id, seg_no, unnest(words) AS word FROM win), {_LEX}, {_scored('wt', 'doc_id, seg_no')}, {_UNP}, x AS (SELECT *, row_number() OVER (PARTITION BY emotion ORDER BY round(rate, 9) DESC, doc_id, seg_no) AS rank FROM u WHERE n_words >= 80 AND coverage >= 0.05 AND hits >= 2 QUALIFY rank <= 50)"


@query(f"{_EXT} SELECT * FROM x")
def emotion_extremes(spark, d):
    s = _window_scores(spark, d).filter("n_words >= 80 AND coverage >= 0.05 AND hits >= 2")
    u = s.unpivot(["doc_id", "seg_no", "n_words", "coverage", "hits"], _RATES, "emotion", "rate").withColumn("emotion", F.regexp_replace("emotion", "_per_1k$", ""))
    return sm.top_k(u, ["emotion"], [F.desc(F.round("rate", 9)), "doc_id", "seg_no"], 50)


@query(f"{_EXT} SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY doc_id, seg_no ORDER BY round(rate, 9) DESC, emotion) = 1")
def strict_dedup(spark, d):
    return sm.best_per_key(emotion_extremes(spark, d).withColumn("key", F.concat_ws("::", "doc_id", "seg_no")), "key", [F.desc(F.round("rate", 9)), "emotion"]).drop("key")


@query("SELECT CASE WHEN l.doc_id IS NULL THEN 'left_only' WHEN d.doc_id IS NULL THEN 'right_only' ELSE 'both' END AS status, count(*) AS n FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def score_alignment(spark, d):
    return sm.alignment(_t(spark, d, "documents"), _t(spark, d, "labels"), "doc_id")


@query("SELECT doc_id, 'documents' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'labels' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def only_in_a_or_b(spark, d):
    a, b = _t(spark, d, "documents").select("doc_id"), _t(spark, d, "labels").select("doc_id")
    return a.join(b, "doc_id", "left_anti").withColumn("side", F.lit("documents")).unionByName(b.join(a, "doc_id", "left_anti").withColumn("side", F.lit("labels")))


@query(f"{_DOCS} SELECT toxic AS topic, count(*) AS n, {', '.join(f'avg({r}) AS {r}' for r in _RATES)} FROM scores JOIN labels USING (doc_id) GROUP BY 1", _RATES)
def topic_crosswalk(spark, d):
    rows = _doc_scores(spark, d).join(_t(spark, d, "labels").select("doc_id", F.col("toxic").alias("topic")), "doc_id")
    return rows.groupBy("topic").agg(F.count("*").alias("n"), *(F.avg(r).alias(r) for r in _RATES))


@query("""SELECT 'line_without_order' AS problem, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'order_without_first_line', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)
UNION ALL SELECT 'repeated_line', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""")
def dep_integrity(spark, d):
    lines, orders = _t(spark, d, "lineitem"), _t(spark, d, "orders")
    first = lines.filter("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"))
    parts = {"line_without_order": lines.join(orders, lines.l_orderkey == orders.o_orderkey, "left_anti"), "order_without_first_line": orders.join(first, "o_orderkey", "left_anti"), "repeated_line": lines.groupBy("l_orderkey", "l_linenumber").count().filter("count > 1")}
    out = None
    for name, rows in parts.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT l_returnflag AS flag, count(*) FILTER (l_discount NOT BETWEEN 0 AND 0.05) AS odd_discount, count(*) FILTER (year(l_shipdate) NOT BETWEEN 1993 AND 1997) AS odd_year, avg(CASE WHEN l_quantity > 40 THEN 1.0 ELSE 0.0 END) AS large_share FROM lineitem GROUP BY 1")
def value_sanity(spark, d):
    rows = _t(spark, d, "lineitem")
    return rows.groupBy(F.col("l_returnflag").alias("flag")).agg(F.count_if(~F.col("l_discount").between(0, 0.05)).alias("odd_discount"), F.count_if(~F.year("l_shipdate").between(1993, 1997)).alias("odd_year"), F.avg(F.when(F.col("l_quantity") > 40, 1.0).otherwise(0.0)).alias("large_share"))


@query(f"{_DOCS}, t AS (SELECT {', '.join(f'sum({e}) AS {e}' for e in EMO)}, avg(coverage) AS c FROM scores) SELECT unnest([{', '.join(repr(e) for e in EMO)}]) AS emotion, unnest([{', '.join(EMO)}]) AS total, unnest([{', '.join(f'{e} / nullif({_TOTAL}, 0)' for e in EMO)}]) AS share, c AS mean_coverage FROM t", ["mean_coverage", "share"])
def corpus_emotion_totals(spark, d):
    one = _doc_scores(spark, d).agg(*(F.sum(e).alias(e) for e in EMO), F.avg("coverage").alias("mean_coverage"), F.sum("total").alias("all"))
    return one.unpivot(["mean_coverage", "all"], EMO, "emotion", "total").select("emotion", "total", (F.col("total") / F.nullif("all", F.lit(0.0))).alias("share"), "mean_coverage")


@query()
def lda_topics(spark, d):
    return tp.lda(_worded(spark, d))


@query()
def kmeans_clusters(spark, d):
    return tp.kmeans(_t(spark, d, "embeddings"), "vec_id", "embedding")


@query()
def pca_coords(spark, d):
    return tp.pca(_t(spark, d, "embeddings"), "vec_id", "embedding")
