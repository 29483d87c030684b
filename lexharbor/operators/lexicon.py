"""Lexicon loading, matching, segment scores and coverage."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..sources.stored import stored
from .fuzzy import nearest

#: The emotions in the order that breaks ties, and names by which columns are known.
EMOTIONS = ["anger", "anticipation", "disgust", "fear", "joy", "sadness", "surprise", "trust"]
SENTIMENTS, VAD = ["positive", "negative"], ["valence", "arousal", "dominance"]
LEXICAL = ["NOUN", "PROPN", "VERB", "ADJ", "ADV", "INTJ"]
NAMES = {
    "anger": ["anger", "jeza", "angry"],
    "anticipation": ["anticipation", "anticip", "pričakovanje", "pricakovanje"],
    "disgust": ["disgust", "gnus", "odpor"],
    "fear": ["fear", "strah"],
    "joy": ["joy", "veselje", "radost", "happiness", "happy"],
    "sadness": ["sadness", "zalost", "žalost", "sad"],
    "surprise": ["surprise", "presenecenje", "presenečenje"],
    "trust": ["trust", "zaupanje"],
    "positive": ["positive", "positivity", "pozitivno", "pozitiven", "pos"],
    "negative": ["negative", "negativity", "negativno", "negativen", "neg"],
    "valence": ["valence", "valenca", "vad_valence", "nrc_vad_valence"],
    "arousal": ["arousal", "vzburjenje", "vzburjenost", "aktivacija", "vad_arousal", "nrc_vad_arousal"],
    "dominance": ["dominance", "dominanca", "vad_dominance", "nrc_vad_dominance"],
}
WORD_COLUMNS = ["slovene", "slovenian", "sl", "word_sl", "sl_word", "slo", "lemma", "lemmas", "word", "term", "entry", "lexeme", "token", "form"]
NO_WORD_COLUMNS = ["id", "index", "source", "origin", "english", "en", "translation", "notes", "comment"]
INTENSITY_MARKS = ["intensity", "intens", "affect", "score"]


def _name(column: str) -> str:
    """A column's name as it is compared: NFKC, lower-cased, other characters as underscores, without diacritics."""
    plain = re.sub(r"[^\w]+", "_", unicodedata.normalize("NFKC", column).strip().lower()).strip("_")
    return "".join(c for c in unicodedata.normalize("NFD", plain) if unicodedata.category(c) != "Mn")


def _decimal(column: str | Column) -> Column:
    """A number with a decimal comma or point; null for anything else."""
    return F.replace((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(","), F.lit(".")).try_cast("double")


def word_column(table: DataFrame, wanted: str | None = None) -> str:
    """The column that holds the words: the wanted one, else by its name, else by what its first 50 rows hold.

    Names are compared in their plain form, known ones in their order; of columns by content, the first counts of
    which under a fifth are numbers and whose name isn't that of notes, sources or translations.
    """
    plain = {c: _name(c) for c in table.columns}
    if wanted is not None:
        fit = [c for c in plain if c == wanted] or [c for c in plain if plain[c] == _name(wanted)]
    else:
        fit = sorted((c for c in plain if plain[c] in WORD_COLUMNS), key=lambda c: WORD_COLUMNS.index(plain[c]))
    if not fit and wanted is None:
        open_ = [c for c in plain if plain[c] not in NO_WORD_COLUMNS]
        numbers = table.limit(50).agg(F.count("*"), *(F.count(_decimal(f"`{c}`")) for c in open_)).first()
        fit = [c for c, n in zip(open_, numbers[1:], strict=True) if 5 * n < max(1, numbers[0])]
    if not fit:
        raise ValueError(f"no column {wanted}" if wanted else "no column of words")
    return fit[0]


def _rules() -> list[tuple[str, set[str], set[str]]]:
    """(role, names of which a column's name is one or has one as a part, parts that speak against it)."""
    against = {s: {_name(n) for n in NAMES["valence"][:2]} for s in SENTIMENTS}
    return [(role, {_name(n) for n in names}, against.get(role, set())) for role, names in NAMES.items()]


def roles(table: DataFrame, words: str) -> dict[str, list[str]]:
    """Columns by what they hold: an emotion, its intensity (``joy intensity``), a sentiment or a VAD dimension."""
    found = [
        (f"{role} intensity" if role in EMOTIONS and any(m in _name(c) for m in INTENSITY_MARKS) else role, c)
        for c in table.columns
        for role, names, against in _rules()
        if c != words and names & {_name(c), *_name(c).split("_")} and not any(x in _name(c) for x in against)
    ]
    return {role: [c for r, c in found if r == role] for role in dict(found)}


def from_long(table: DataFrame, word: str, emotion: str = "emotion", score: str = "score") -> DataFrame:
    """A table of (word, emotion, score) with a column for each emotion: the greatest score of each word."""
    rows = table.select(F.col(word).alias("word"), tx.lexeme("simple", True)(F.col(emotion)).alias("e"), _decimal(score).alias("s"))
    return rows.groupBy("word").pivot("e", EMOTIONS).max("s")


def load_by_roles(table: DataFrame, wanted: str | None = None, norm=None) -> DataFrame:
    """key and a column for each emotion, intensity, sentiment and VAD dimension, from a table of any columns.

    Columns of one role are joined in the row: the greatest, of VAD the mean; a role without columns is 0, or
    null for intensity and VAD. Cells of several words are split; of equal keys the greatest value counts, of
    VAD the mean. norm normalises keys (as of ``text.lexeme``), which are lower-cased without it.
    """
    words = word_column(table, wanted)
    held = roles(table, words)
    if not any(e in held for e in EMOTIONS) and {"emotion", "score"} <= {_name(c) for c in table.columns}:
        named = {_name(c): c for c in table.columns}
        table, words = from_long(table, words, named["emotion"], named["score"]), "word"
        held = {e: [e] for e in EMOTIONS}
    values = {}
    for name in [*EMOTIONS, *SENTIMENTS, *(f"{e} intensity" for e in EMOTIONS), *VAD]:
        own = [tx.number(F.col(f"`{c}`").cast("string")) for c in held.get(name, [])]
        if name in VAD:
            values[name] = F.get(F.array(F.try_divide(F.aggregate(F.filter(F.array(*own), lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x), F.size(F.filter(F.array(*own), lambda x: x.isNotNull())).cast("double"))), F.lit(0)) if own else F.lit(None).cast("double")
        else:
            most = F.array_max(F.array(*own)) if own else F.lit(None).cast("double")
            values[name.replace(" ", "_")] = most if name.endswith("intensity") else F.coalesce(most, F.lit(0.0))
    keys = F.array_distinct(F.filter(F.transform(F.split(F.col(f"`{words}`"), r"[|;/]"), lambda x: F.lower(F.trim(x))), lambda x: x != ""))
    each = table.select(F.explode(keys).alias("key"), *(v.alias(n) for n, v in values.items()))
    if norm is not None:
        each = each.withColumn("key", norm(F.col("key"))).filter("key <> ''")
    return each.groupBy("key").agg(*((F.avg if n in VAD else F.max)(n).alias(n) for n in values))


def load(rows: DataFrame, word: str, values: list[str]) -> DataFrame:
    """key and values: cells of several words are split on ``|;/``; equal keys keep the greatest value, VAD the mean."""
    keys = F.array_distinct(F.filter(F.transform(F.split(word, r"[|;/]"), lambda x: F.lower(F.trim(x))), lambda x: x != ""))
    each = rows.select(F.explode(keys).alias("key"), *(tx.number(F.col(v).cast("string")).alias(v) for v in values))
    return each.groupBy("key").agg(*((F.avg if v in VAD else F.max)(v).alias(v) for v in values))


def match(tokens: DataFrame, lexicon: DataFrame, word: str = "word") -> DataFrame:
    """tokens with the lexicon's columns, null where there is no entry; Spark broadcasts a small lexicon by itself."""
    return tokens.join(lexicon.withColumnRenamed("key", "lex_key"), F.col(word) == F.col("lex_key"), "left")


def score_windows(docs: DataFrame, lexicon: DataFrame, size: int = 250, step: int = 125) -> DataFrame:
    """The measures of ``score`` for rolling windows (doc_id, seg_no) of words, as ``segments.windows`` cuts them.

    Each word is looked up once: sums are made for panes of ``step`` words, and windows of their panes. The
    size is a multiple of the step.
    """
    if step <= 0 or size % step:
        raise ValueError("size must be a multiple of step")
    least, panes = max(25, size // 5), size // step
    words = docs.select("doc_id", tx.words(F.col("text")).alias("w")).select("doc_id", F.size("w").alias("n"), F.posexplode("w").alias("rank", "word"))
    rows = match(words.withColumn("pane", F.floor(F.col("rank") / step)), lexicon)
    pane = rows.groupBy("doc_id", "n", "pane").agg(F.count("*").alias("n_words"), F.count("lex_key").alias("hits"), F.collect_set("lex_key").alias("keys"), *(F.coalesce(F.sum(e), F.lit(0.0)).alias(e) for e in EMOTIONS + SENTIMENTS), *(F.sum(v).alias(v) for v in VAD), *(F.count(v).alias(f"{v}_n") for v in VAD))
    fit = lambda k: (k >= 0) & F.when(F.col("n") <= size, k == 0).otherwise(k * step + least <= F.col("n"))
    each = pane.withColumn("k", F.explode(F.filter(F.sequence(F.col("pane") - (panes - 1), F.col("pane")), fit)))
    keys = F.size(F.array_distinct(F.flatten(F.collect_list("keys")))).cast("long")
    out = each.groupBy("doc_id", (F.col("k") + 1).alias("seg_no")).agg(F.sum("n_words").alias("n_words"), F.sum("hits").alias("hits"), keys.alias("distinct_hits"), *(F.sum(e).alias(e) for e in EMOTIONS + SENTIMENTS), *((F.sum(v) / F.nullif(F.sum(f"{v}_n"), F.lit(0))).alias(v) for v in VAD))
    return _measures(out, "n_words")


def match_by_sources(tokens: DataFrame, lexicon: DataFrame, sources: list[str], upos: list[str] | None = None, fuzzy: int | None = None) -> DataFrame:
    """tokens with lex_key, source and the lexicon's columns: the first of the source columns whose value is a key. Only words of the given tags are looked up.

    One left join for each source and one for the values; Spark broadcasts a small lexicon by itself. With fuzzy, a
    threshold, words without a key take the nearest one (``fuzzy.nearest``) of the first source that has any; source
    is then ``lemma:fuzzy:`` and the value, and fuzzy_score the ratio, else null. Distinct values are compared once, and
    what they match is stored beside the lexicon's keys: tokens, stored too as they are read twice, are joined with
    that small table as with the lexicon, and not shuffled.
    """
    able = F.lit(True) if upos is None else F.col("upos").isin(upos)
    known = lexicon.select(F.col("key").alias("value"), "key", F.lit(None).cast("double").alias("score"))
    if fuzzy is not None:
        tokens = stored(tokens, "tokens")
        left = tokens.filter(able).select(F.explode(F.array(*sources)).alias("word")).distinct().join(lexicon, F.col("word") == F.col("key"), "left_anti")
        known = stored(known.union(nearest(left, lexicon, fuzzy).select("word", "key", "score")), "known")
    rows, names = tokens, [f"_hit{i}" for i in range(len(sources))]
    for n, s in zip(names, sources, strict=True):
        own = known.select(F.col("value").alias(f"{n}_value"), F.struct("key", "score").alias(n))
        rows = rows.join(own, F.when(able, F.col(s)) == F.col(f"{n}_value"), "left").drop(f"{n}_value")
    exact = [F.when(F.col(n).isNotNull() & F.col(n)["score"].isNull(), F.col(n)["key"]) for n in names]
    made = {"source": F.coalesce(*(F.when(x.isNotNull(), F.lit(s)) for x, s in zip(exact, sources, strict=True))), "lex_key": F.coalesce(*exact)}
    if fuzzy is not None:
        near_source = F.coalesce(*(F.when(F.col(n).isNotNull(), F.concat(F.lit(f"{s}:fuzzy:"), F.col(s))) for n, s in zip(names, sources, strict=True)))
        best = F.coalesce(*names)
        made |= {"source": F.coalesce(made["source"], near_source), "fuzzy_score": F.when(made["lex_key"].isNull(), best["score"]), "lex_key": F.coalesce(made["lex_key"], best["key"])}
    return rows.withColumns(made).drop(*names).join(lexicon.withColumnRenamed("key", "lex_key"), "lex_key", "left")


def match_export(matched: DataFrame, unit: str = "document") -> DataFrame:
    """The 32 columns of a token match: where it stands, what matched, and the lexicon's values; only words that matched.

    matched (doc_id, par, sent, pos, form, lemma, upos and the columns of ``match_by_sources``) may have segment_id;
    without it, its document is the segment.
    """
    segment = F.col("segment_id") if "segment_id" in matched.columns else F.concat_ws("::", F.col("doc_id").cast("string"), F.lit("document-1"))
    score = F.col("fuzzy_score") if "fuzzy_score" in matched.columns else F.lit(None).cast("double")
    have = lambda c: F.col(c) if c in matched.columns else F.lit(None).cast("double")
    sent = F.concat_ws(".", *(F.col(c).cast("string") for c in ("doc_id", "par", "sent")))
    return matched.filter("lex_key IS NOT NULL").select(
        segment.alias("segment_id"), F.lit(unit).alias("unit"), "doc_id", sent.alias("sent_id"), F.col("pos").cast("string").alias("token_id"), "form", "lemma", "upos",
        F.col("lex_key").alias("matched_key"), F.col("source").alias("match_source"), score.alias("fuzzy_score"),
        *(F.coalesce(e, F.lit(0.0)).alias(f"emotion_{e}") for e in EMOTIONS), *(have(f"{e}_intensity").alias(f"intensity_{e}") for e in EMOTIONS),
        *(F.coalesce(s, F.lit(0.0)).alias(f"sentiment_{s}") for s in SENTIMENTS), *(have(v).alias(f"vad_{v}") for v in VAD),
    )


def score_segments(segments: DataFrame, matched: DataFrame, keys: list[str], lexical: Column | None = None) -> DataFrame:
    """The measures of ``score`` for every segment, also those without words; rates and coverage are by lexical words.

    segments hold the keys, matched the keys and words with lex_key; lexical tells which words count, else all.
    Shares of the emotions' total (``joy_prop``) and means of intensity, where the lexicon has it, come on top.
    """
    counted = F.count_if(lexical) if lexical is not None else F.count("*")
    sums = [F.sum(e).alias(e) for e in EMOTIONS + SENTIMENTS]
    more = [c for c in (f"{e}_intensity" for e in EMOTIONS) if c in matched.columns]
    out = matched.groupBy(*keys).agg(F.count("*").alias("n_words"), counted.alias("n_lexical"), F.count("lex_key").alias("hits"), F.size(F.collect_set("lex_key")).cast("long").alias("distinct_hits"), *sums, *(F.avg(v).alias(v) for v in [*VAD, *more]))
    out = segments.select(*keys).distinct().join(out, keys, "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0).cast(out.schema[c].dataType)) for c in ["n_words", "n_lexical", "hits", "distinct_hits", *EMOTIONS, *SENTIMENTS]})
    return _measures(out, "n_lexical").withColumns({f"{e}_prop": F.coalesce(F.col(e) / F.nullif(F.col("total"), F.lit(0.0)), F.lit(0.0)) for e in EMOTIONS})


def score(matched: DataFrame, keys: list[str], segments: DataFrame | None = None) -> DataFrame:
    """Per segment: hits, distinct hits, coverage, emotion sums, per 1000 words, shares, sentiment balance, VAD means, dominant emotion.

    With segments (keys, each once), those without words have a row of zeros too. Sums are made by segment and entry
    first, so that distinct entries are counted and no set of them is held. Words that are dealt by a key stay so.
    """
    each = matched.groupBy(*keys, "lex_key").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in EMOTIONS + SENTIMENTS + VAD), *(F.count(v).alias(f"{v}_n") for v in VAD))
    sums = [F.coalesce(F.sum(e), F.lit(0.0)).alias(e) for e in EMOTIONS + SENTIMENTS]
    means = [(F.sum(v) / F.nullif(F.sum(f"{v}_n"), F.lit(0))).alias(v) for v in VAD]
    hits = F.coalesce(F.sum(F.when(F.col("lex_key").isNotNull(), F.col("n"))), F.lit(0)).alias("hits")
    out = each.groupBy(*keys).agg(F.sum("n").alias("n_words"), hits, F.count("lex_key").alias("distinct_hits"), *sums, *means)
    if segments is not None:
        out = segments.select(*keys).join(out, keys, "left").fillna(0, ["n_words", "hits", "distinct_hits", *EMOTIONS, *SENTIMENTS])
    return _measures(out, "n_words")


def _measures(out: DataFrame, words: str) -> DataFrame:
    total = reduce(Column.__add__, (F.col(e) for e in EMOTIONS))
    most = F.greatest(*EMOTIONS)
    dominant = F.when(total > 0, F.element_at(F.array(*map(F.lit, EMOTIONS)), F.array_position(F.array(*EMOTIONS), most).cast("int")))
    return out.withColumns(
        {
            "coverage": F.col("hits") / F.greatest(F.col(words), F.lit(1)),
            "total": total,
            **{f"{e}_per_1k": F.col(e) / F.greatest(F.col(words), F.lit(1)) * 1000 for e in EMOTIONS},
            "balance": (F.col("positive") - F.col("negative")) / F.nullif(F.col("positive") + F.col("negative"), F.lit(0.0)),
            "dominant": dominant,
            "dominant_share": F.when(total > 0, most / F.nullif(total, F.lit(0.0))).otherwise(0.0),
        }
    )


def coverage(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """metric, value over all words: words, types, hits, type hits and their ratios."""
    counts = tokens.groupBy("word").count()
    joined = match(counts, lexicon.select("key"))
    one = joined.agg(F.sum("count").alias("word_tokens"), F.count("*").alias("word_types"), F.sum(F.when(F.col("lex_key").isNotNull(), F.col("count"))).alias("hit_tokens"), F.count("lex_key").alias("hit_types"))
    return one.selectExpr("stack(6, 'word_tokens', double(word_tokens), 'word_types', double(word_types), 'hit_tokens', double(coalesce(hit_tokens, 0)), 'hit_types', double(hit_types), 'token_coverage', coalesce(hit_tokens, 0) / word_tokens, 'type_coverage', hit_types / word_types) AS (metric, value)")


def top_unknown(tokens: DataFrame, lexicon: DataFrame, depth: int = 1000) -> DataFrame:
    """Of the ``depth`` commonest words, those outside the lexicon."""
    common = tokens.groupBy("word").count().orderBy(F.desc("count"), "word").limit(depth)
    return common.join(lexicon, F.col("word") == F.col("key"), "left_anti")


def coverage_report(tokens: DataFrame, table: DataFrame, lexicon: DataFrame, words: str) -> DataFrame:
    """metric and value (string): sizes of the lexicon, words of the corpus and those among its keys by lemma, and the columns that were found."""
    held = roles(table, words)
    group = lambda names: json.dumps({n: held.get(n, []) for n in names}, ensure_ascii=False)
    counts = tokens.groupBy(F.col("lemma").alias("word")).count()
    one = match(counts, lexicon.select("key")).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(F.col("lex_key").isNotNull(), F.col("count"))), F.lit(0)).alias("hits"))
    sizes = table.agg(F.count("*").alias("rows")).join(F.broadcast(lexicon.agg(F.count("*").alias("keys")))).join(F.broadcast(one))
    fixed = {"lexicon_word_columns": words, "detected_emotion_columns": group(EMOTIONS), "detected_intensity_columns": group([f"{e} intensity" for e in EMOTIONS]), "detected_sentiment_columns": group(SENTIMENTS), "detected_vad_columns": group(VAD)}
    values = {"lexicon_rows": F.col("rows").cast("string"), "lexicon_keys": F.col("keys").cast("string"), "corpus_word_tokens": F.col("total").cast("string"), "corpus_word_token_hits": F.col("hits").cast("string"), "corpus_word_token_coverage": F.round(F.coalesce(F.col("hits") / F.nullif("total", F.lit(0)), F.lit(0.0)), 6).cast("string"), **{k: F.lit(v) for k, v in fixed.items()}}
    return sizes.select(F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in values.items()))).alias("x")).select("x.*")


def review_unknown(unknown: DataFrame, generic: list[str], least: int = 3, n: int = 500) -> DataFrame:
    """Unknown lemmas (word, count) for review: without generic and short ones, the commonest n, with blank columns to fill in."""
    kept = unknown.filter(~F.col("word").isin(generic) & (F.length("word") >= least)).orderBy(F.desc("count"), "word").limit(n)
    return kept.withColumns({c: F.lit("") for c in ("oov_type", "should_add_to_lexicon", "normalization_candidate", "notes")})
