"""Queries over topics, clusters, review sheets, plot data and the report, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as tx
from ..operators import review as rv, segments as sg, summary as sm, topics as tp
from .corpus import _CEN, _DOCS, _EXT, _RATES, EMO, ORACLE, _doc_scores, _t, _worded, centroid_cosine, emotion_extremes, query, score_alignment, window_segments

#: Shares of four topics for each vector: the squares of its first four numbers.
_SHARES = """sh AS (SELECT vec_id, label, list_transform(embedding[1:4], lambda x: x::DOUBLE * x::DOUBLE) AS q FROM embeddings), v AS (SELECT vec_id, label, list_transform(q, lambda x: x / list_sum(q)) AS v FROM sh),
tw AS (SELECT vec_id, label, unnest([0, 1, 2, 3]) AS topic, unnest(v) AS probability, unnest([0, 1, 2, 3]) = list_position(v, list_max(v)) - 1 AS dominant FROM v)"""


def _shares(spark: SparkSession, d: str) -> DataFrame:
    q = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double") * x.cast("double"))
    total = lambda a: a[0] + a[1] + a[2] + a[3]
    return _t(spark, d, "embeddings").select("vec_id", "label", q.alias("q")).select("vec_id", "label", F.transform("q", lambda x: x / total(F.col("q"))).alias("v"))


def _measured(spark: SparkSession, d: str) -> DataFrame:
    return _doc_scores(spark, d).select(F.col("doc_id").alias("vec_id"), *_RATES)


@query(f"WITH {_SHARES} SELECT vec_id, topic, probability, dominant FROM tw", ["probability"])
def topic_weights(spark, d):
    return rv.topic_weights(_shares(spark, d), "vec_id", "v")


@query(f"{_DOCS}, {_SHARES} SELECT topic, count(*) AS n, avg(probability) AS mean_probability, count(*) FILTER (tw.dominant) AS n_dominant, {', '.join(f'sum({r} * probability) / sum(CASE WHEN {r} IS NOT NULL THEN probability END) AS {r}' for r in _RATES)} FROM tw LEFT JOIN scores ON doc_id = vec_id GROUP BY 1", ["mean_probability", *_RATES])
def topic_summary(spark, d):
    return rv.topic_summary(rv.topic_weights(_shares(spark, d), "vec_id", "v"), _measured(spark, d), "vec_id", _RATES)


@query(f"{_DOCS}, {_CEN} SELECT label AS topic, count(*) AS n, count(DISTINCT vec_id) AS n_docs, avg(cosine) AS mean_probability, {', '.join(f'avg({r}) AS {r}' for r in _RATES)} FROM cos LEFT JOIN scores ON doc_id = vec_id GROUP BY 1", ["mean_probability", *_RATES])
def cluster_summary(spark, d):
    rows = centroid_cosine(spark, d).join(_measured(spark, d), "vec_id", "left")
    return rv.group_summary(rows, "label", "vec_id", "cosine", _RATES)


_FAM = f"""fam AS (SELECT 'lda' AS family, topic::VARCHAR AS topic, probability AS weight, vec_id AS id FROM tw UNION ALL SELECT 'cluster', label::VARCHAR, 1.0, vec_id FROM embeddings UNION ALL SELECT 'classifier', lang, 1.0, doc_id FROM documents UNION ALL SELECT 'bertopic', source, 1.0, doc_id FROM documents),
fu AS (SELECT family, topic, weight, unnest([{', '.join(repr(r) for r in _RATES)}]) AS emotion, unnest([{', '.join(_RATES)}]) AS rate FROM fam LEFT JOIN scores ON doc_id = id)"""


@query(f"{_DOCS}, {_SHARES}, {_FAM} SELECT family, topic, emotion, sum(rate * weight) / sum(CASE WHEN rate IS NOT NULL THEN weight END) AS value FROM fu GROUP BY ALL", ["value"])
def crosswalk_families(spark, d):
    docs = _t(spark, d, "documents")
    plain = lambda df, key, topic: df.select(F.col(key).alias("vec_id"), F.col(topic).alias("topic"), F.lit(1.0).alias("weight"))
    lda = rv.topic_weights(_shares(spark, d), "vec_id", "v").withColumnRenamed("probability", "weight")
    families = {"lda": lda, "cluster": plain(_t(spark, d, "embeddings"), "vec_id", "label"), "classifier": plain(docs, "doc_id", "lang"), "bertopic": plain(docs, "doc_id", "source")}
    return rv.crosswalks(families, _measured(spark, d), "vec_id", _RATES)


_TFIDF = r"""tok AS (SELECT lang, doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '\p{L}+')) AS word FROM documents), tf AS (SELECT lang, doc_id, word, count(*) AS tf FROM tok GROUP BY ALL),
idf AS (SELECT word, ln((1 + (SELECT count(DISTINCT doc_id) FROM tf)) / (1 + count(DISTINCT doc_id))) + 1 AS idf FROM tf GROUP BY 1), w AS (SELECT lang, doc_id, word, tf * idf AS w FROM tf JOIN idf USING (word)),
nm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1), mb AS (SELECT lang, count(DISTINCT doc_id) AS m FROM tf GROUP BY 1), ts AS (SELECT lang, word AS term, sum(w / norm) / any_value(m) AS score FROM w JOIN nm USING (doc_id) JOIN mb USING (lang) GROUP BY 1, 2),
ct AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(score, 9) DESC, term) AS rank FROM ts QUALIFY rank <= 10)"""


def _terms(spark, d):
    docs = sg.spread(_t(spark, d, "documents").select("lang", "doc_id", "text"), "doc_id")
    return rv.cluster_terms(docs.select("lang", "doc_id", F.explode(tx.words(F.col("text"))).alias("word")), "lang", "doc_id")


@query(f"WITH {_TFIDF} SELECT * FROM ct", ["score"])
def cluster_top_terms(spark, d):
    return _terms(spark, d)


@query(f"WITH {_TFIDF} SELECT lang, string_agg(term, '/' ORDER BY rank) AS label FROM ct WHERE rank <= 5 GROUP BY 1")
def cluster_labels(spark, d):
    return rv.cluster_labels(_terms(spark, d), "lang")


@query("WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT event_id, CASE WHEN n < 100 THEN -1 ELSE user_id END AS user_id, n < 100 AS outlier FROM events JOIN n USING (user_id)")
def topic_outliers(spark, d):
    return rv.with_outliers(_t(spark, d, "events").select("event_id", "user_id"), "user_id", 100)


_SHEET = f"""{_CEN}, rs AS (SELECT vec_id, label, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE cosine END AS cosine, vec_id / 1000.0 AS length FROM cos), sc AS (SELECT *, coalesce(cosine, length)::DOUBLE AS review_score, CASE WHEN cosine IS NOT NULL THEN 'cosine' ELSE 'length' END AS review_source FROM rs),
best AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY review_score DESC, vec_id) AS rank, 'top' AS kind FROM sc QUALIFY rank <= 25),
drawn AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(vec_id::VARCHAR || '-42'), vec_id) AS rank, 'random' AS kind FROM sc WHERE vec_id NOT IN (SELECT vec_id FROM best) QUALIFY rank <= 10), sheet AS (SELECT * FROM best UNION ALL SELECT * FROM drawn)"""


def _sheet(spark, d):
    rows = centroid_cosine(spark, d).withColumns({"cosine": F.when(F.col("vec_id") % 3 != 0, F.col("cosine")), "length": F.col("vec_id") / 1000.0})
    return rv.topic_sheet(rv.review_score(rows, ["cosine", "length"]), "label", "vec_id")


@query(f"WITH {_SHEET} SELECT label, vec_id, review_score, review_source, rank, kind, '' AS human_label, '' AS coherent, '' AS notes FROM sheet", ["review_score"])
def topic_sheet(spark, d):
    return _sheet(spark, d).select("label", "vec_id", "review_score", "review_source", "rank", "kind", "human_label", "coherent", "notes")


@query(f"WITH {_SHEET}, n AS (SELECT label, count(*) AS n FROM sheet GROUP BY 1) SELECT count(*) AS rows, min(review_score) AS score_min, median(review_score) AS score_median, max(review_score) AS score_max, count(*) FILTER (review_score = 0) AS zeros, count(*) FILTER (review_score IS NULL) AS missing, (SELECT count(*) FROM n) AS topics, (SELECT min(n) FROM n) AS rows_min, (SELECT max(n) FROM n) AS rows_max, (SELECT count(*) FROM n WHERE n < 35) AS small_topics FROM sheet", ["score_min", "score_median", "score_max"])
def topic_verification(spark, d):
    return rv.verification(_sheet(spark, d), "label", "review_score", 35)


@query(rf"{_EXT} SELECT emotion, count(*) AS rows, count(DISTINCT doc_id || '::' || seg_no) AS segments, count(*) - count(DISTINCT doc_id || '::' || seg_no) AS repeated, min(n_words) AS words_min, median(n_words) AS words_median, count(*) FILTER (n_words < 80) AS under_80, count(*) FILTER (regexp_matches(substring(text, 1, 200), '\p{{Ll}}\p{{Lu}}')) AS glued FROM x JOIN documents USING (doc_id) GROUP BY 1")
def emotion_verification(spark, d):
    rows = emotion_extremes(spark, d).join(_t(spark, d, "documents").select("doc_id", F.substring("text", 1, 200).alias("preview")), "doc_id").withColumn("key", F.concat_ws("::", "doc_id", "seg_no"))
    return rv.emotion_verification(rows, "emotion", "key", "n_words", "preview")


@query("WITH g AS (SELECT conv_id, role AS label, count(*) AS n, avg(length(text) / 1000.0::DOUBLE) AS m FROM conversations GROUP BY 1, 2), b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, round(m, 9) DESC, label) = 1) SELECT conv_id, label, n, coalesce((SELECT m FROM g x WHERE x.conv_id = b.conv_id AND x.label = 'assistant'), 0) AS assistant, coalesce((SELECT m FROM g x WHERE x.conv_id = b.conv_id AND x.label = 'user'), 0) AS user_ FROM b", ["assistant", "user_"])
def dominant_with_pivot(spark, d):
    p = _t(spark, d, "conversations").select("conv_id", F.col("role").alias("label"), (F.length("text") / 1000.0).alias("score"))
    g = p.groupBy("conv_id", "label").agg(F.count("*").alias("n"), F.avg("score").alias("m"))
    wide = p.groupBy("conv_id").pivot("label", ["assistant", "user"]).agg(F.avg("score")).fillna(0.0).withColumnRenamed("user", "user_")
    return sm.best_per_key(g, "conv_id", [F.desc("n"), F.desc(F.round("m", 9)), "label"]).drop("m").join(wide, "conv_id", "left")


@query(f"{_DOCS}, sv AS (SELECT s.*, (1900 + s.doc_id % 60)::VARCHAR AS century FROM scores s) SELECT 'century' AS key, century AS value, count(*) AS n, {', '.join(f'sum({v} * n_words) / sum(CASE WHEN {v} IS NOT NULL THEN n_words END) AS {v}' for v in ('valence', 'arousal', 'dominance'))} FROM sv GROUP BY 2", ["valence", "arousal", "dominance"])
def plot_vad_by_time(spark, d):
    rows = _doc_scores(spark, d).withColumns({"year": F.lit(""), "century": (1900 + F.col("doc_id") % 60).cast("string"), "period": F.lit("x")})
    return rv.first_available(rows, ["year", "century", "period"], ["valence", "arousal", "dominance"], "n_words")


@query(f"WITH {_SHARES} SELECT topic, avg(probability) AS prevalence FROM tw GROUP BY 1", ["prevalence"])
def plot_topic_prevalence(spark, d):
    return rv.topic_weights(_shares(spark, d), "vec_id", "v").groupBy("topic").agg(F.avg("probability").alias("prevalence"))


@query("SELECT source AS label, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, label LIMIT 20")
def plot_label_top20(spark, d):
    return _t(spark, d, "documents").groupBy(F.col("source").alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(20)


@query("WITH n AS (SELECT user_id AS topic, count(*) AS n FROM events GROUP BY 1) SELECT * FROM n WHERE n >= 5 ORDER BY n DESC, topic LIMIT 30")
def plot_topic_top30(spark, d):
    rows = rv.with_outliers(_t(spark, d, "events").select("event_id", "user_id"), "user_id", 5).filter("NOT outlier")
    return rows.groupBy(F.col("user_id").alias("topic")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "topic").limit(30)


@query(f"{_DOCS}, t AS (SELECT {', '.join(f'sum({e})::BIGINT AS {e}' for e in EMO)} FROM scores), u AS (SELECT unnest([{', '.join(repr(e) for e in EMO)}]) AS emotion, unnest([{', '.join(EMO)}]) AS total, unnest(range(1, 9)) AS no FROM t), l AS (SELECT lang, count(*) AS n, row_number() OVER (ORDER BY lang) AS no FROM documents GROUP BY 1) SELECT 0 AS section, no + 3 AS no, '| ' || emotion || ' | ' || total || ' |' AS line FROM u UNION ALL SELECT 1, no + 3, '| ' || lang || ' | ' || n || ' |' FROM l UNION ALL SELECT unnest([0, 0, 0, 1, 1, 1]), unnest([1, 2, 3, 1, 2, 3]), unnest(['## Emotions', '| emotion | total |', '|---|---|', '## Languages', '| lang | n |', '|---|---|'])")
def report_lines(spark, d):
    one = _doc_scores(spark, d).agg(*(F.sum(e).cast("long").alias(e) for e in EMO))
    totals = one.select(F.posexplode(F.array(*(F.struct(F.lit(e).alias("emotion"), F.col(e).alias("total")) for e in EMO))).alias("i", "x")).select((F.col("i") + 1).alias("no"), "x.*")
    langs = _t(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n")).withColumn("no", F.row_number().over(Window.orderBy("lang")))  # a row for each language
    return rv.report({"Emotions": totals, "Languages": langs})


@query()
def lda_grid(spark, d):
    """Topic counts with perplexity and coherence, the best marked."""
    return tp.lda_grid(_worded(spark, d), [4, 8], iterations=5)


@query()
def lda_segment_topics(spark, d):
    """Topic of each document with its weights, of a fitted model."""
    return tp.lda_weights(_worded(spark, d), k=8, iterations=5)


@query()
def cluster_silhouette(spark, d):
    """Clusters of vectors with the silhouette of the clustering."""
    return tp.kmeans_with_silhouette(_t(spark, d, "embeddings"), "vec_id", "embedding")


@query(f"{_EXT}, held AS (SELECT doc_id, seg_no, len(words) AS n_words_segment, md5(array_to_string(words, ' ')) AS digest FROM win) SELECT x.doc_id, x.seg_no, emotion, rank, n_words, n_words_segment, digest FROM x LEFT JOIN held USING (doc_id, seg_no)")
def extremes_with_segments(spark, d):
    """The emotion sheet with the columns of its segments."""
    rows = rv.with_segments(emotion_extremes(spark, d), window_segments(spark, d), ["doc_id", "seg_no"])
    return rows.select("doc_id", "seg_no", "emotion", "rank", "n_words", "n_words_segment", "digest")


_RULES = [("topics.zeros", ">", 0, "warning"), ("topics.small_topics", ">", 0, "warning"), ("emotions.under_80", ">", 0, "stop"), ("emotions.glued", ">", 0, "warning"), ("scores.left_only", ">", 1e9, "stop"), ("scores.both", "<", 1, "stop")]
_CHECKS = {"topics": ["rows", "topics", "zeros", "missing", "small_topics"], "emotions": ["rows", "segments", "repeated", "under_80", "glued"], "scores": ["both", "left_only", "right_only"]}
_ITEMS = ", ".join(f"'{p}.{c}'" for p, names in _CHECKS.items() for c in names)
_LEVELS = " ".join(f"WHEN item = '{item}' AND value {way} {bound} THEN '{name}'" for item, way, bound, name in _RULES)


@query(f"""WITH tv AS ({ORACLE["topic_verification"]}), ev AS (SELECT sum(rows) AS rows, sum(segments) AS segments, sum(repeated) AS repeated, sum(under_80) AS under_80, sum(glued) AS glued FROM ({ORACLE["emotion_verification"]})), al AS ({ORACLE["score_alignment"]}),
sc AS (SELECT coalesce(sum(n) FILTER (status = 'both'), 0) AS both, coalesce(sum(n) FILTER (status = 'left_only'), 0) AS left_only, coalesce(sum(n) FILTER (status = 'right_only'), 0) AS right_only FROM al),
i AS (SELECT unnest([{_ITEMS}]) AS item, unnest([{", ".join(f"{t}.{c}::DOUBLE" for t, p in (("tv", "topics"), ("ev", "emotions"), ("sc", "scores")) for c in _CHECKS[p])}]) AS value FROM tv, ev, sc), l AS (SELECT *, CASE {_LEVELS} ELSE 'ok' END AS level FROM i)
SELECT *, (SELECT count(*) FROM l WHERE level = 'stop') = 0 AS go FROM l""")
def review_hardening(spark, d):
    """The checks of the topic sheet, the emotion sheet and the alignment of scores as one result."""
    emotions = emotion_verification(spark, d).agg(*(F.sum(c).alias(c) for c in _CHECKS["emotions"]))
    status = score_alignment(spark, d).agg(*(F.coalesce(F.sum(F.when(F.col("status") == s, F.col("n"))), F.lit(0)).alias(s) for s in _CHECKS["scores"]))
    return rv.hardened({"topics": topic_verification(spark, d).select(*_CHECKS["topics"]), "emotions": emotions, "scores": status}, _RULES)


@query("SELECT d.doc_id, d.lang, coalesce(e.label, -1)::BIGINT AS label, coalesce(len(e.embedding), 0)::BIGINT AS size, e.vec_id IS NOT NULL AS has_vector FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def assignments_with_vectors(spark, d):
    manifest = _t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label", F.size("embedding").cast("long").alias("size"))
    joined = rv.with_vectors(_t(spark, d, "documents").select("doc_id", "lang"), manifest, "doc_id")
    return joined.select("doc_id", "lang", F.coalesce(F.col("label").cast("long"), F.lit(-1)).alias("label"), F.coalesce("size", F.lit(0)).alias("size"), "has_vector")


_NUMBERED = ", ".join(f"({i + 1}, '{e}', (SELECT sum({e}) FROM scores))" for i, e in enumerate(EMO))


@query(f"""{_DOCS}, e(no, emotion, total) AS (VALUES {_NUMBERED}), c AS (SELECT avg(coverage) AS c, count(*) AS n, count(*) FILTER (n_words = 0) AS blank FROM scores),
b AS (SELECT 0 AS section, no, '| ' || emotion || ' | ' || total::BIGINT || ' | ' || printf('%.4f', total / (SELECT sum(total) FROM e)) || ' |' AS line FROM e UNION ALL SELECT 1, 1, '| mean coverage | ' || printf('%.4f', c) || ' |' FROM c
UNION ALL SELECT 2, 1, '| documents without words | ' || blank || ' |' FROM c UNION ALL SELECT 3, row_number() OVER (ORDER BY name), '| ' || name || ' | ' || n || ' |' FROM (SELECT 'document_scores' AS name, n FROM c UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'labels', count(*) FROM labels))
SELECT section::INT AS section, (no + 3)::BIGINT AS no, line FROM b UNION ALL SELECT unnest([0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 3])::INT, unnest([1, 2, 3, 1, 2, 3, 1, 2, 3, 1, 2, 3])::BIGINT, unnest(['## Emotions', '| emotion | total | proportion |', '|---|---|---|', '## Coverage', '| measure | value |', '|---|---|', '## Warnings', '| warning | rows |', '|---|---|', '## Outputs', '| table | rows |', '|---|---|'])""")
def report_full(spark, d):
    """Totals with proportions, coverage, warnings and the tables with their rows."""
    scores = _doc_scores(spark, d)
    one = scores.agg(*(F.sum(e).alias(e) for e in EMO), F.avg("coverage").alias("coverage"), F.count("*").alias("n"), F.count_if(F.col("n_words") == 0).alias("blank"))
    total = sum((F.col(e) for e in EMO[1:]), F.col(EMO[0]))
    emotions = one.select(F.explode(F.array(*(F.struct(F.lit(i + 1).alias("no"), F.lit(e).alias("emotion"), F.col(e).cast("long").alias("total"), (F.col(e) / total).alias("proportion")) for i, e in enumerate(EMO)))).alias("x")).select("x.*")
    coverage = one.select(F.lit(1).alias("no"), F.lit("mean coverage").alias("measure"), F.col("coverage").alias("value"))
    warnings = one.select(F.lit(1).alias("no"), F.lit("documents without words").alias("warning"), F.col("blank").alias("rows"))
    tables = {"document_scores": scores, "documents": _t(spark, d, "documents"), "labels": _t(spark, d, "labels")}
    outputs = None
    for i, (name, table) in enumerate(tables.items()):
        n = table.agg(F.count("*").alias("rows")).select(F.lit(i + 1).alias("no"), F.lit(name).alias("table"), "rows")
        outputs = n if outputs is None else outputs.union(n)
    return rv.report({"Emotions": emotions, "Coverage": coverage, "Warnings": warnings, "Outputs": outputs})
