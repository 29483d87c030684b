"""Documents cut into words, sentences, paragraphs and rolling windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as tx

SIZE, STEP = 250, 125


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, rank (from 0), word, one row per word; a narrow transformation."""
    return docs.select("doc_id", F.posexplode(tx.words(F.col("text"))).alias("rank", "word"))


def pieces(docs: DataFrame, unit: str) -> DataFrame:
    """doc_id, seg_no (from 1), text: lines as paragraphs, or sentences by end punctuation; blank ones are left out."""
    cut = r"\n" if unit == "paragraph" else r"[.!?\n]+"
    parts = F.filter(F.transform(F.split("text", cut), lambda x: F.btrim(x, F.lit(tx.BLANKS))), lambda x: x != "")
    return docs.select("doc_id", F.posexplode(parts).alias("i", "text")).select("doc_id", (F.col("i") + 1).alias("seg_no"), "text")


def windows(docs: DataFrame, size: int = SIZE, step: int = STEP) -> DataFrame:
    """doc_id, seg_no, words: rolling windows of words, sliced within the row.

    Up to ``size`` words are one window; else windows start every ``step`` words, up to the first with fewer
    than max(25, size // 5).
    """
    if step <= 0:
        raise ValueError("step must be positive")
    least = max(25, size // 5)
    w = docs.select("doc_id", tx.words(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    last = F.floor((F.col("n") - least) / step)
    starts = F.when(F.col("n") <= size, F.array(F.lit(0).cast("long"))).when((last >= 0) & (size >= least), F.sequence(F.lit(0).cast("long"), last)).otherwise(F.array().cast("array<bigint>"))
    return w.select("doc_id", F.explode(starts).alias("k"), "w").select("doc_id", (F.col("k") + 1).alias("seg_no"), F.slice("w", (F.col("k") * step + 1).cast("int"), size).alias("words"))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, sentences, words, types."""
    w = tx.words(F.col("text"))
    s = F.filter(F.transform(F.split("text", r"[.!?\n]+"), lambda x: F.trim(x)), lambda x: x != "")
    return docs.select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("n_types"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt by key, over four times as many partitions as there are cores or its source has.

    Meant for rows that are dear to work on, such as texts, behind a scan: they are shuffled while they are small, and
    what is made of them stays dealt by key, so that groups and windows by it need no shuffle of their own.
    """
    return df.repartition(4 * max(df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()), key)


def annotate(docs: DataFrame, keep: tuple[str, ...] = (), by: str = "doc_id") -> DataFrame:
    """Tokens of texts by plain rules, where no annotator is at hand: doc_id, pos (place in the document), par, sent, form, lemma, upos, space_after.

    Lines are paragraphs, sentences end at . ! or ?; lemmas are lower-cased words without a plural s; numbers,
    marks and capitalised words are told by their form, other words by length alone. Columns in keep stay; by is
    doc_id or one of them of which each document has one value, and rows are dealt by it.
    """
    texts = spread(docs.select("doc_id", "text", *keep), by)
    each = texts.select("doc_id", *keep, sentences_of(F.col("text")).alias("_sents")).select("doc_id", *keep, F.posexplode(tokens_of("_sents")).alias("pos", "x"))
    each = each.select("doc_id", *keep, "pos", "x.par", "x.sent", F.col("x.t").alias("_t"), _form(F.col("x.t")).alias("form"))
    form = F.col("form")
    return each.select("doc_id", *keep, "pos", "par", "sent", "form", _lemma(form).alias("lemma"), _upos(form).alias("upos"), (F.col("_t") != form).alias("space_after"))


def sentences_of(text: Column) -> Column:
    """Array of (par, sent, text): the sentences of each line."""
    cut = lambda line, p: F.transform(F.regexp_extract_all(line, F.lit("[^.!?]+[.!?]*"), F.lit(0)), lambda s, i: F.struct((p + 1).alias("par"), (i + 1).alias("sent"), s.alias("text")))
    return F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), cut))


def words_of(sents: str) -> Column:
    """Array of (par, sent, words) for a column of ``sentences_of``: words, numbers and marks, each with the blanks behind it.

    The last of a sentence has one where the next sentence begins with a blank, and where there is none.
    """

    def one(s: Column, k: Column) -> Column:
        behind = F.when(F.coalesce(F.get(sents, k + 1).text.rlike(r"^\s"), F.lit(True)), " ").otherwise("")
        return F.struct(s.par.alias("par"), s.sent.alias("sent"), F.regexp_extract_all(F.concat(s.text, behind), F.lit(r"(?:\p{L}+|[0-9]+|[^\s\p{L}0-9])\s*"), F.lit(0)).alias("words"))

    return F.transform(sents, one)


def tokens_of(sents: str) -> Column:
    """Array of (par, sent, t), a word of ``words_of`` each, in order."""
    return F.flatten(F.transform(words_of(sents), lambda s: F.transform(s.words, lambda t: F.struct(s.par.alias("par"), s.sent.alias("sent"), t.alias("t")))))


def analysed(words: Column) -> Column:
    """Array of (form, lemma, upos, space_after) for words of ``words_of``, within the row; the same as ``annotate``."""
    forms = F.transform(words, lambda t: F.struct(t.alias("t"), _form(t).alias("form")))
    return F.transform(forms, lambda x: F.struct(x.form.alias("form"), _lemma(x.form).alias("lemma"), _upos(x.form).alias("upos"), (x.t != x.form).alias("space_after")))


def _form(t: Column) -> Column:
    return F.rtrim(t, F.lit(" \t\n\x0b\f\r"))


def _lemma(form: Column) -> Column:
    low = F.lower(form)
    return F.when(F.endswith(low, F.lit("s")) & (F.length(low) > 3), F.left(low, F.length(low) - 1)).otherwise(low)


def _upos(form: Column) -> Column:
    """Tags by the first character; patterns are asked only beyond ASCII."""
    first, by_length = F.ascii(form), F.element_at(F.array(*map(F.lit, ("VERB", "ADJ", "NOUN", "ADP"))), F.length(form) % 4 + 1)
    ascii_ = F.when(first.between(48, 57), "NUM").when(first.between(97, 122), by_length).when(first.between(65, 90), "PROPN").when(first < 128, "PUNCT")
    return F.coalesce(ascii_, F.when(~form.rlike(r"^\p{L}"), "PUNCT").when(form.rlike(r"^\p{Lu}"), "PROPN").otherwise(by_length))


def reconstructed(tokens: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """keys and text: forms with a blank where space_after says so and at the ends of sentences and paragraphs, glued words parted."""
    place = ["par", "sent"]
    last = F.array_sort(F.collect_list(F.struct(order, *place, "form", "space_after")))
    joined = F.array_join(F.transform("t", lambda x, i: F.concat(x.form, F.when(i == F.size("t") - 1, "").when(x.space_after | (F.struct(x.par, x.sent) != F.struct(F.get("t", i + 1).par, F.get("t", i + 1).sent)), " ").otherwise(""))), "")
    return tokens.groupBy(*keys).agg(last.alias("t")).select(*keys, tx.glue_repair(joined).alias("text"))


def members(tokens: DataFrame, unit: str, size: int = SIZE, step: int = STEP) -> DataFrame:
    """tokens with segment_id and seg: the document, sentence, paragraph or rolling windows of words that each belongs to.

    A token that is not a word lies in a window if words of it stand on both sides. Windows follow from the
    number of a word, so no ranges are joined; a window of fewer than max(25, size // 5) words is left out
    unless it is the document's only one.
    """
    if unit == "document":
        return tokens.withColumns({"seg": F.lit(1).cast("long"), "segment_id": F.concat_ws("::", F.col("doc_id").cast("string"), F.lit("document-1"))})
    if unit in ("sentence", "paragraph"):
        key = F.struct("par", "sent") if unit == "sentence" else F.struct("par")
        seg = F.dense_rank().over(Window.partitionBy("doc_id").orderBy(key)).cast("long")
        return tokens.withColumn("seg", seg).withColumn("segment_id", F.concat_ws("::", F.col("doc_id").cast("string"), F.concat(F.lit(f"{unit}-"), F.col("seg").cast("string"))))
    if unit != "window" or step <= 0:
        raise ValueError("units are document, sentence, paragraph and window; step is positive")
    word = tx.is_word(F.col("form"), F.col("upos"))
    upto = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = tokens.withColumn("_hi", F.sum(F.when(word, 1).otherwise(0)).over(upto)).withColumn("_n", F.sum(F.when(word, 1).otherwise(0)).over(Window.partitionBy("doc_id")))
    lo, hi, n = F.col("_hi") - 1, F.when(word, F.col("_hi") - 1).otherwise(F.col("_hi")), F.col("_n")
    first = F.greatest(F.lit(0).cast("long"), F.floor((hi - size) / step) + 1)
    some = F.when(n <= size, F.array(F.lit(0).cast("long"))).when(first <= F.floor(lo / step), F.sequence(first, F.floor(lo / step))).otherwise(F.array().cast("array<bigint>"))
    fit = lambda k: (n <= size) | ((k * step < n) & (F.least(F.lit(size), n - k * step) >= max(25, size // 5)))
    out = rows.filter((lo >= 0) & (hi < n)).withColumn("seg", F.explode(F.transform(F.filter(some, fit), lambda k: k + 1))).drop("_hi", "_n")
    return out.withColumn("segment_id", F.concat_ws("::", F.col("doc_id").cast("string"), F.concat(F.lit("window-"), F.col("seg").cast("string"))))


def by_paragraph_id(tokens: DataFrame) -> DataFrame:
    """tokens, or sentences, (doc_id, par_id, ...) with segment_id by the paragraph's id, wherever its tokens stand; those without one share ``paragraph-1``."""
    own = F.coalesce(F.nullif("par_id", F.lit("")), F.lit("paragraph-1"))
    return tokens.withColumn("segment_id", F.concat_ws("::", F.col("doc_id").cast("string"), own))


def projection(held: DataFrame, unit: str, docs: DataFrame, ids: int = 20, length: int = 300) -> DataFrame:
    """One row per segment: unit, the first sentences' names, counts, a preview, and the documents' columns."""
    word = tx.is_word(F.col("form"), F.col("upos"))
    sent = F.concat_ws(".", F.col("doc_id").cast("string"), F.col("par").cast("string"), F.col("sent").cast("string"))
    one = held.groupBy("doc_id", "seg", "segment_id").agg(F.array_sort(F.collect_set(sent)).alias("s"), F.count("*").alias("n_tokens"), F.count_if(word).alias("n_words"))
    text = reconstructed(held, ["doc_id", "seg"]).withColumn("text_preview", F.substring("text", 1, length)).drop("text")
    out = one.join(text, ["doc_id", "seg"]).select("segment_id", F.lit(unit).alias("unit"), "doc_id", "seg", F.size("s").cast("long").alias("n_sentences"), F.array_join(F.slice("s", 1, ids), ",").alias("sent_ids"), "n_tokens", "n_words", "text_preview")
    return out.join(docs, "doc_id", "left")


def topic_lemmas(tokens: DataFrame, upos: list[str], stopwords: list[str] = tx.STOPWORDS) -> DataFrame:
    """Tokens that topics are made of: of the given tags, two characters or more, no stopword, not only digits and marks."""
    return tokens.filter(F.col("upos").isin(upos) & (F.length("lemma") >= 2) & ~F.col("lemma").isin(stopwords) & ~F.col("lemma").rlike(r"^[\p{N}_\P{L}]+$"))


def chosen(counts: DataFrame, least: int, units: list[str]) -> DataFrame:
    """Segments (unit, n) of the first unit that has any with ``least`` or more."""
    have = {r["unit"] for r in counts.filter(F.col("n") >= least).select("unit").distinct().collect()}  # a few names
    unit = next((u for u in units if u in have), units[-1])
    return counts.filter((F.col("n") >= least) & (F.col("unit") == unit))


def first_documents(docs: DataFrame, n: int, order: str = "doc_id") -> DataFrame:
    """The first n documents, for trials; the limit is the feature."""
    return docs.orderBy(order).limit(n)
