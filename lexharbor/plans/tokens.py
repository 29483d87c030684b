"""Queries over annotated tokens, segments and lexicons, each with its SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as tx
from ..operators import fuzzy, lexicon as lx, segments as sg, summary as sm
from ..sources.stored import stored
from .corpus import _LEX, EMO, _lexicon, _t, query

_ANN = r"""flat AS (SELECT doc_id, flatten(flatten(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l, p: list_transform(regexp_extract_all(l, '[^.!?]+[.!?]*'), lambda s, i:
  list_transform(regexp_extract_all(s, '\p{L}+|[0-9]+|[^\s\p{L}0-9]|\s+'), lambda t, j: {'par': p, 'sent': i, 'at': j - 1, 'form': t}))))) AS t FROM documents),
parts AS (SELECT doc_id, unnest(range(1, len(t) + 1)) AS i, unnest(t) AS x FROM flat),
line AS (SELECT doc_id, i, x.par AS par, x.sent AS sent, x.form AS form, lead(x.form) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM parts),
ann AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, par, sent, form, regexp_replace(lower(form), '^(.{3,})s$', '\1') AS lemma,
  CASE WHEN regexp_matches(form, '^[0-9]+$') THEN 'NUM' WHEN NOT regexp_matches(form, '\p{L}') THEN 'PUNCT' WHEN regexp_matches(form, '^\p{Lu}') THEN 'PROPN' ELSE ['VERB', 'ADJ', 'NOUN', 'ADP'][length(form) % 4 + 1] END AS upos,
  nxt IS NULL OR regexp_matches(nxt, '^\s') AS space_after FROM line WHERE NOT regexp_matches(form, '^\s')),
tok AS (SELECT *, upos <> 'PUNCT' AS is_word, upos IN ('NOUN', 'PROPN', 'VERB', 'ADJ', 'ADV', 'INTJ') AS lexical FROM ann)"""
_HITS = "hit AS (SELECT t.*, CASE WHEN NOT lexical THEN NULL WHEN a.key IS NOT NULL THEN a.key ELSE b.key END AS lex_key, CASE WHEN NOT lexical THEN NULL WHEN a.key IS NOT NULL THEN 'lemma' WHEN b.key IS NOT NULL THEN 'form' END AS source FROM tok t LEFT JOIN lex a ON t.lemma = a.key LEFT JOIN lex b ON lower(t.form) = b.key)"
_INTENSE = ", ".join(f"(ascii(key) + length(key) * {i + 3}) % 4 / 4.0::DOUBLE AS {e}_intensity" for i, e in enumerate(EMO))
_FULL = f"full_lex AS (SELECT *, {_INTENSE} FROM lex)"


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return sg.annotate(_t(spark, d, "documents"))


def _words(spark: SparkSession, d: str) -> DataFrame:
    t = _tokens(spark, d)
    return t.filter(tx.is_word(F.col("form"), F.col("upos"))).withColumn("lowered", F.lower("form"))


def _full_lexicon(spark: SparkSession, d: str) -> DataFrame:
    n, a = F.length("key"), F.ascii("key")
    return _lexicon(spark, d).withColumns({f"{e}_intensity": (a + n * (i + 3)) % 4 / 4.0 for i, e in enumerate(EMO)})


def _matched(spark: SparkSession, d: str) -> DataFrame:
    return lx.match_by_sources(_words(spark, d).withColumnsRenamed({"form": "surface", "lowered": "form"}), _full_lexicon(spark, d), ["lemma", "form"], lx.LEXICAL)


def _scores(keys: str, frame: str) -> tuple[str, list[str]]:
    """SQL of ``score_segments`` over hits, and the columns that are rounded."""
    sums = ", ".join(f"coalesce(sum({e}), 0)::DOUBLE AS {e}" for e in EMO + lx.SENTIMENTS)
    means = ", ".join(f"avg({v}) AS {v}" for v in [*lx.VAD, *(f"{e}_intensity" for e in EMO)])
    total, most = " + ".join(EMO), f"greatest({', '.join(EMO)})"
    dominant = "CASE WHEN total > 0 THEN CASE " + " ".join(f"WHEN {e} = most THEN '{e}'" for e in EMO) + " END END"
    sql = f"""g AS (SELECT {keys}, count(*) AS n_words, count(*) FILTER (lexical) AS n_lexical, count(lex_key) AS hits, count(DISTINCT lex_key) AS distinct_hits, {sums}, {means} FROM hit LEFT JOIN full_lex ON lex_key = key WHERE is_word GROUP BY ALL),
f AS (SELECT DISTINCT {keys} FROM {frame}),
e AS (SELECT f.*, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ["n_words", "n_lexical", "hits", "distinct_hits", *EMO, *lx.SENTIMENTS])}, {", ".join([*lx.VAD, *(f"{e}_intensity" for e in EMO)])} FROM f LEFT JOIN g USING ({keys})),
m AS (SELECT *, {total} AS total, {most} AS most FROM e),
seg_scores AS (SELECT * EXCLUDE (most), hits / greatest(n_lexical, 1) AS coverage, {", ".join(f"{e} / greatest(n_lexical, 1) * 1000 AS {e}_per_1k" for e in EMO)}, (positive - negative) / nullif(positive + negative, 0) AS balance,
 {dominant} AS dominant, CASE WHEN total > 0 THEN most / total ELSE 0 END AS dominant_share, {", ".join(f"coalesce({e} / nullif(total, 0), 0) AS {e}_prop" for e in EMO)} FROM m)"""
    return sql, [*lx.VAD, *(f"{e}_intensity" for e in EMO), *(f"{e}_per_1k" for e in EMO)]


_DOC_SQL, _DOC_ROUND = _scores("doc_id", "documents")
_SENT_SQL, _ = _scores("doc_id, par, sent", "tok")


@query(f"WITH {_ANN} SELECT upos, count(*) AS n, count(*) / (SELECT count(*) FROM tok) AS share FROM tok GROUP BY 1", ["share"])
def upos_counts(spark, d):
    counts = _tokens(spark, d).groupBy("upos").agg(F.count("*").alias("n"))
    return counts.select("upos", "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))  # a row for each tag


@query(rf"""WITH {_ANN}, j AS (SELECT doc_id, pos, form, space_after, par, sent, lead(par) OVER w AS np, lead(sent) OVER w AS ns FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
s AS (SELECT doc_id, string_agg(form || CASE WHEN np IS NULL THEN '' WHEN space_after OR np <> par OR ns <> sent THEN ' ' ELSE '' END, '' ORDER BY pos) AS t FROM j GROUP BY 1) SELECT doc_id, md5(regexp_replace(t, '(\p{{Ll}})(\p{{Lu}})', '\1 \2', 'g')) AS digest FROM s""")
def reconstructed_text(spark, d):
    return sg.reconstructed(_tokens(spark, d), ["doc_id"]).select("doc_id", F.md5("text").alias("digest"))


@query(f"""WITH {_ANN}, w AS (SELECT doc_id, list(pos ORDER BY pos) AS p, count(*) AS n FROM tok WHERE is_word GROUP BY 1),
k AS (SELECT doc_id, p, n, unnest(CASE WHEN n <= 250 THEN [0] ELSE range(0, ((n - 50) // 125)::BIGINT + 1) END) AS k FROM w),
b AS (SELECT doc_id, k + 1 AS seg, least(n - k * 125, 250) AS n_words, p[k * 125 + 1] AS first_pos, p[least(k * 125 + 250, n)] AS last_pos FROM k)
SELECT doc_id, seg, first_pos, last_pos, last_pos - first_pos + 1 AS n_tokens, n_words FROM b""")
def window_members(spark, d):
    word = tx.is_word(F.col("form"), F.col("upos"))
    return sg.members(_tokens(spark, d), "window").groupBy("doc_id", "seg").agg(F.min("pos").cast("long").alias("first_pos"), F.max("pos").cast("long").alias("last_pos"), F.count("*").alias("n_tokens"), F.count_if(word).alias("n_words"))


@query(rf"""WITH {_ANN}, p AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY par) AS seg FROM tok), j AS (SELECT *, lead(par) OVER w AS np, lead(sent) OVER w AS ns FROM p WINDOW w AS (PARTITION BY doc_id, seg ORDER BY pos)),
s AS (SELECT doc_id, seg, string_agg(form || CASE WHEN np IS NULL THEN '' WHEN space_after OR np <> par OR ns <> sent THEN ' ' ELSE '' END, '' ORDER BY pos) AS t, count(*) AS n_tokens, count(*) FILTER (is_word) AS n_words, list_sort(list_distinct(list(doc_id || '.' || par || '.' || sent))) AS ids FROM j GROUP BY ALL)
SELECT doc_id || '::paragraph-' || seg AS segment_id, 'paragraph' AS unit, doc_id, seg, len(ids) AS n_sentences, array_to_string(ids[1:20], ',') AS sent_ids, n_tokens, n_words, substring(regexp_replace(t, '(\p{{Ll}})(\p{{Lu}})', '\1 \2', 'g'), 1, 300) AS text_preview, lang, source FROM s JOIN documents USING (doc_id)""")
def segment_projection(spark, d):
    docs = _t(spark, d, "documents")
    return sg.projection(sg.members(_tokens(spark, d), "paragraph"), "paragraph", docs.select("doc_id", "lang", "source")).select("segment_id", "unit", "doc_id", "seg", "n_sentences", "sent_ids", "n_tokens", "n_words", "text_preview", "lang", "source")


@query(f"WITH {_ANN} SELECT doc_id, count(DISTINCT (par, sent)) AS n_sentences, count(*) AS n_tokens, count(*) FILTER (is_word) AS n_words, count(DISTINCT CASE WHEN is_word THEN lower(form) END) AS n_forms, count(DISTINCT CASE WHEN is_word THEN lemma END) AS n_lemmas FROM tok GROUP BY 1")
def token_statistics(spark, d):
    word = tx.is_word(F.col("form"), F.col("upos"))
    distinct = lambda x: F.size(F.collect_set(x)).cast("long")  # noqa: E731  sets of one document; tokens are dealt by it already
    return _tokens(spark, d).groupBy("doc_id").agg(distinct(F.struct("par", "sent")).alias("n_sentences"), F.count("*").alias("n_tokens"), F.count_if(word).alias("n_words"), distinct(F.when(word, F.lower("form"))).alias("n_forms"), distinct(F.when(word, F.col("lemma"))).alias("n_lemmas"))


@query(f"WITH {_ANN}, {_LEX}, {_FULL}, {_HITS} SELECT doc_id, pos, lower(form) AS form, lemma, upos, source, lex_key, joy, fear, positive, negative, valence, joy_intensity FROM hit JOIN full_lex ON lex_key = key WHERE is_word")
def token_matches(spark, d):
    return _matched(spark, d).filter("lex_key IS NOT NULL").select("doc_id", F.col("pos").cast("long").alias("pos"), "form", "lemma", "upos", "source", "lex_key", "joy", "fear", "positive", "negative", "valence", "joy_intensity")


@query(f"WITH {_ANN}, {_LEX}, {_FULL}, {_HITS}, {_DOC_SQL} SELECT * FROM seg_scores", _DOC_ROUND)
def document_scores_full(spark, d):
    return lx.score_segments(_t(spark, d, "documents").select("doc_id"), _matched(spark, d), ["doc_id"], F.col("upos").isin(lx.LEXICAL))


def _sentence_scores(spark, d):
    return lx.score_segments(_tokens(spark, d).select("doc_id", "par", "sent"), _matched(spark, d), ["doc_id", "par", "sent"], F.col("upos").isin(lx.LEXICAL))


@query(f"""WITH {_ANN}, {_LEX}, {_FULL}, {_HITS}, {_SENT_SQL} SELECT form AS entity, count(*) AS n, count(DISTINCT doc_id) AS n_docs, avg(joy_per_1k) AS joy, avg(fear_per_1k) AS fear, avg(coverage) AS coverage FROM tok JOIN seg_scores USING (doc_id, par, sent) WHERE upos = 'PROPN' GROUP BY 1""", ["joy", "fear", "coverage"])
def entity_sentence_emotion(spark, d):
    rows = _tokens(spark, d).filter("upos = 'PROPN'").join(_sentence_scores(spark, d), ["doc_id", "par", "sent"], "left")
    return rows.groupBy(F.col("form").alias("entity")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"), F.avg("joy_per_1k").alias("joy"), F.avg("fear_per_1k").alias("fear"), F.avg("coverage").alias("coverage"))


_STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)
_TOPIC = f"topic_tok AS (SELECT * FROM tok WHERE lexical AND length(lemma) >= 2 AND lemma NOT IN ({_STOP}))"


@query(f"WITH {_ANN}, {_TOPIC} SELECT lemma, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM topic_tok GROUP BY 1")
def topic_lemma_counts(spark, d):
    by_doc = sg.topic_lemmas(_tokens(spark, d), lx.LEXICAL).groupBy("doc_id", "lemma").agg(F.count("*").alias("n"))
    return by_doc.groupBy("lemma").agg(F.sum("n").alias("n"), F.count("*").alias("n_docs"))


@query(f"WITH {_ANN}, {_TOPIC}, p AS (SELECT 'paragraph' AS unit, doc_id || '.' || par AS segment, count(*) AS n FROM topic_tok GROUP BY ALL UNION ALL SELECT 'document', doc_id::VARCHAR, count(*) FROM topic_tok GROUP BY ALL) SELECT * FROM p WHERE n >= 30 AND unit = CASE WHEN (SELECT count(*) FROM p WHERE unit = 'paragraph' AND n >= 30) > 0 THEN 'paragraph' ELSE 'document' END")
def topic_segments(spark, d):
    counts = stored(sg.topic_lemmas(_tokens(spark, d), lx.LEXICAL).groupBy("doc_id", "par").agg(F.count("*").alias("n")), "topic-segments")  # read three times
    by = lambda unit, key: counts.groupBy(key.alias("segment")).agg(F.sum("n").alias("n")).select(F.lit(unit).alias("unit"), "segment", "n")
    return sg.chosen(by("paragraph", F.concat_ws(".", F.col("doc_id").cast("string"), F.col("par").cast("string"))).unionByName(by("document", F.col("doc_id").cast("string"))), 30, ["paragraph", "document"])


def _wide_lexicon(spark, d):
    """A lexicon with names of columns as they occur, over the words of the benchmark."""
    w = _lexicon(spark, d)
    return w.select(F.monotonically_increasing_id().cast("string").alias("Id"), F.col("key").alias("Slovene"), F.lit("en").alias("English"), F.col("joy").cast("string").alias("Joy"), F.col("fear").cast("string").alias("strah"), F.col("valence").cast("string").alias("joy-intensity"), F.col("positive").cast("string").alias("Positive"), F.col("arousal").cast("string").alias("NRC VAD arousal"), F.lit("x").alias("notes"))


_HELD = [{e: {"joy": ["Joy"], "fear": ["strah"]}.get(e, []) for e in EMO}, {f"{e} intensity": ["joy-intensity"] if e == "joy" else [] for e in EMO}, {"positive": ["Positive"], "negative": []}, {"valence": [], "arousal": ["NRC VAD arousal"], "dominance": []}]
_JSON = [json.dumps(x) for x in _HELD]


@query(f"""WITH {_ANN}, {_LEX}, c AS (SELECT count(*) AS n, count(*) FILTER (lemma IN (SELECT key FROM lex)) AS h FROM tok WHERE is_word), k AS (SELECT count(*) AS k FROM lex)
SELECT unnest(['lexicon_rows', 'lexicon_keys', 'corpus_word_tokens', 'corpus_word_token_hits', 'corpus_word_token_coverage', 'lexicon_word_columns', 'detected_emotion_columns', 'detected_intensity_columns', 'detected_sentiment_columns', 'detected_vad_columns']) AS metric,
unnest([k::VARCHAR, k::VARCHAR, n::VARCHAR, h::VARCHAR, round(h / n, 6)::VARCHAR, 'Slovene', '{_JSON[0]}', '{_JSON[1]}', '{_JSON[2]}', '{_JSON[3]}']) AS value FROM c, k""")
def lexicon_coverage_full(spark, d):
    table = _wide_lexicon(spark, d)
    words = lx.word_column(table)
    return lx.coverage_report(_words(spark, d), table, lx.load_by_roles(table), words)


@query(f"WITH {_LEX} SELECT key, joy, fear, valence AS joy_intensity, positive, arousal, 0.0::DOUBLE AS anger, 0.0::DOUBLE AS negative FROM lex")
def lexicon_by_roles(spark, d):
    return lx.load_by_roles(_wide_lexicon(spark, d), norm=tx.lexeme()).select("key", "joy", "fear", "joy_intensity", "positive", "arousal", "anger", "negative")


@query("""WITH r AS (SELECT replace(p_name, ' ', ';') AS w, p_size::DOUBLE AS a, (p_partkey % 60)::DOUBLE AS b, p_size % 10 / 10.0::DOUBLE AS v1, p_partkey % 10 / 10.0::DOUBLE AS v2 FROM part), k AS (SELECT *, unnest(list_distinct(list_filter(string_split(lower(w), ';'), lambda x: x <> ''))) AS key FROM r)
SELECT key, max(greatest(a, b)) AS joy, avg((v1 + v2) / 2) AS valence FROM k GROUP BY 1""", ["valence"])
def lexicon_reduced(spark, d):
    part = _t(spark, d, "part")
    rows = part.select(F.replace("p_name", F.lit(" "), F.lit(";")).alias("term"), F.col("p_size").cast("string").alias("joy"), (F.col("p_partkey") % 60).cast("string").alias("happy"), F.replace((F.col("p_size") % 10 / 10.0).cast("string"), F.lit("."), F.lit(",")).alias("valence"), (F.col("p_partkey") % 10 / 10.0).cast("string").alias("vad_valence"))
    return lx.load_by_roles(rows).select("key", "joy", "valence")


_PIVOT = ", ".join(f"max(CASE WHEN p_size % 8 = {i} THEN p_retailprice END) AS {e}" for i, e in enumerate(EMO))


@query(f"SELECT p_type AS word, {_PIVOT} FROM part GROUP BY 1")
def lexicon_pivot(spark, d):
    rows = _t(spark, d, "part").select(F.col("p_type").alias("word"), F.initcap(F.element_at(F.array(*map(F.lit, EMO)), (F.col("p_size") % 8 + 1).cast("int"))).alias("emotion"), F.replace(F.col("p_retailprice").cast("string"), F.lit("."), F.lit(",")).alias("score"))
    return lx.from_long(rows, "word")


@query(f"WITH {_ANN}, {_LEX}, c AS (SELECT lemma AS word, count(*) AS n FROM tok WHERE lexical GROUP BY 1 ORDER BY n DESC, word LIMIT 1000) SELECT word, n AS count, '' AS oov_type, '' AS should_add_to_lexicon, '' AS normalization_candidate, '' AS notes FROM c WHERE word NOT IN (SELECT key FROM lex) AND length(word) >= 3 AND word NOT IN ('the', 'und') ORDER BY count DESC, word LIMIT 500")
def oov_review(spark, d):
    words = _words(spark, d).filter(F.col("upos").isin(lx.LEXICAL)).select(F.col("lemma").alias("word"))
    return lx.review_unknown(lx.top_unknown(words, _lexicon(spark, d)), ["the", "und"])


#: The best ratio of each word against every key of a fitting length.
_LCS = "list_reduce([list_transform(range(0, m + 1), lambda i: 0::BIGINT)] || list_transform(range(1, n + 1), lambda i: [i]), lambda above, i: list_reduce([[0::BIGINT]] || list_transform(range(1, m + 1), lambda j: [j]), lambda acc, j: acc || [CASE WHEN key[i[1]] = word[j[1]] THEN above[j[1]] + 1 ELSE greatest(above[j[1] + 1], acc[-1]) END]))[-1]"


def _near(words: str) -> str:
    plain = lambda x: f"regexp_replace({x}, '[^\\x00-\\x7F]', '?', 'g')"  # noqa: E731  levenshtein counts bytes
    return f"""pair AS (SELECT word, key, length(word) AS m, length(key) AS n FROM (SELECT DISTINCT word, {plain("word")} AS p FROM {words}) JOIN (SELECT key, {plain("key")} AS q FROM lex) ON length(word) >= 5 AND 200 * least(length(word), length(key)) >= 92 * (length(word) + length(key)) WHERE 100 * levenshtein(p, q) <= 8 * (length(word) + length(key))),
ratio AS (SELECT word, key, 200.0::DOUBLE * {_LCS} / (n + m) AS score FROM pair),
near AS (SELECT * FROM ratio WHERE score >= 92 QUALIFY row_number() OVER (PARTITION BY word ORDER BY score DESC, key) = 1)"""


_MISS = "miss AS (SELECT unnest([lemma, lower(form)]) AS word FROM tok WHERE lexical)"


@query(f"WITH {_ANN}, {_LEX}, {_MISS}, open AS (SELECT DISTINCT word FROM miss WHERE word NOT IN (SELECT key FROM lex)), {_near('open')} SELECT word, key, score FROM near")
def fuzzy_matches(spark, d):
    """Lemmas and forms without a lexicon key, with the nearest one."""
    lexicon = _lexicon(spark, d)
    words = _words(spark, d).filter(F.col("upos").isin(lx.LEXICAL)).select(F.explode(F.array("lemma", "lowered")).alias("word")).distinct()
    return fuzzy.nearest(words.join(lexicon, F.col("word") == F.col("key"), "left_anti"), lexicon)


@query(f"""WITH {_ANN}, {_LEX}, {_FULL}, {_HITS}, {_MISS}, open AS (SELECT DISTINCT word FROM miss WHERE word NOT IN (SELECT key FROM lex)), {_near('open')},
m AS (SELECT h.*, coalesce(h.lex_key, a.key, b.key) AS k, CASE WHEN h.lex_key IS NOT NULL THEN h.source WHEN a.key IS NOT NULL THEN 'lemma:fuzzy:' || h.lemma ELSE 'form:fuzzy:' || lower(h.form) END AS s, CASE WHEN h.lex_key IS NULL THEN coalesce(a.score, b.score) END AS score
  FROM hit h LEFT JOIN near a ON h.lexical AND a.word = h.lemma LEFT JOIN near b ON h.lexical AND b.word = lower(h.form) WHERE is_word)
SELECT doc_id || '::document-1' AS segment_id, 'document' AS unit, doc_id, doc_id || '.' || par || '.' || sent AS sent_id, pos::VARCHAR AS token_id, lower(form) AS form, lemma, upos, k AS matched_key, s AS match_source, score AS fuzzy_score,
{", ".join(f"{e} AS emotion_{e}, {e}_intensity AS intensity_{e}" for e in EMO)}, {", ".join(f"{x} AS sentiment_{x}" for x in lx.SENTIMENTS)}, {", ".join(f"{v} AS vad_{v}" for v in lx.VAD)} FROM m JOIN full_lex ON full_lex.key = k""")
def token_match_export(spark, d):
    """All columns of the matched tokens, near keys for those without one; only words of the tags that are looked up are kept."""
    words = _words(spark, d).filter(F.col("upos").isin(lx.LEXICAL)).select("doc_id", "pos", "par", "sent", "upos", "lemma", F.col("lowered").alias("form"))
    return lx.match_export(lx.match_by_sources(words, _full_lexicon(spark, d), ["lemma", "form"], lx.LEXICAL, fuzzy.THRESHOLD))


_RUNS = [c * 3 for c in "abcdefghijklmnopqrstuvwxyzčšž"]


@query(f"WITH {_ANN}, w AS (SELECT DISTINCT form, replace(lower(form), 'zh', 'č') AS f FROM tok WHERE is_word) SELECT form, list_reduce([f] || {_RUNS}, lambda s, r: regexp_replace(s, r || '+', r[1:2], 'g')) AS modern FROM w")
def lexeme_historical(spark, d):
    """Old spellings of distinct forms; runs of one letter are cut to two."""
    return _words(spark, d).select("form").distinct().select("form", tx.lexeme("historical")(F.col("form")).alias("modern"))


@query(f"WITH {_ANN}, w AS (SELECT DISTINCT form FROM tok WHERE is_word) SELECT form, lower(form) AS simple, strip_accents(lower(form)) AS ascii FROM w")
def lexeme_forms(spark, d):
    return _words(spark, d).select("form").distinct().select("form", tx.lexeme()(F.col("form")).alias("simple"), tx.lexeme("ascii")(F.col("form")).alias("ascii"))


@query(f"WITH {_ANN}, s AS (SELECT doc_id, CASE WHEN upos = 'PROPN' THEN CASE WHEN lag(upos) OVER w = 'PROPN' THEN 'I-PER' ELSE 'B-PER' END ELSE 'O' END AS ner, * EXCLUDE (doc_id) FROM tok WINDOW w AS (PARTITION BY doc_id, par, sent ORDER BY pos)), r AS (SELECT *, sum(CASE WHEN ner = 'I-PER' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, par, sent ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM s), e AS (SELECT string_agg(form, ' ' ORDER BY pos) AS text FROM r WHERE ner <> 'O' GROUP BY doc_id, par, sent, run) SELECT text, count(*) AS n FROM e GROUP BY 1")
def entity_spans(spark, d):
    w = Window.partitionBy("doc_id", "par", "sent").orderBy("pos")
    ner = F.when(F.col("upos") == "PROPN", F.when(F.lag("upos").over(w) == "PROPN", "I-PER").otherwise("B-PER")).otherwise("O")
    return sm.iob_spans(_tokens(spark, d).withColumn("ner", ner), ["doc_id", "par", "sent"], "pos").groupBy("text").agg(F.count("*").alias("n"))
