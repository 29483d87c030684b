"""Topic summaries, crosswalks, review sheets, their verification, plot data and the report."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.stored import stored
from . import summary as sm


def topic_weights(shares: DataFrame, key: str, vector: str) -> DataFrame:
    """key, topic (from 0), probability and dominant (the first greatest) of an array of shares."""
    each = shares.select(key, F.posexplode(vector).alias("topic", "probability"), (F.array_position(vector, F.array_max(vector)) - 1).alias("_top"))
    return each.select(key, "topic", F.col("probability").cast("double").alias("probability"), (F.col("topic") == F.col("_top")).alias("dominant"))


def topic_summary(weights: DataFrame, scores: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """topic, n, mean_probability, n_dominant and means of the measures weighted by probability."""
    rows = weights.join(scores.select(key, *measures), key, "left")
    mean = lambda c: (F.sum(F.col(c) * F.col("probability")) / F.nullif(F.sum(F.when(F.col(c).isNotNull(), F.col("probability"))), F.lit(0.0))).alias(c)
    return rows.groupBy("topic").agg(F.count("*").alias("n"), F.avg("probability").alias("mean_probability"), F.count_if("dominant").alias("n_dominant"), *map(mean, measures))


def group_summary(rows: DataFrame, topic: str, doc: str, probability: str | None, measures: list[str]) -> DataFrame:
    """topic, n, n_docs, mean_probability and plain means of the measures."""
    p = F.avg(probability) if probability else F.lit(None).cast("double")
    return rows.groupBy(F.col(topic).alias("topic")).agg(F.count("*").alias("n"), F.count_distinct(doc).alias("n_docs"), p.alias("mean_probability"), *(F.avg(c).alias(c) for c in measures))


def crosswalks(families: dict[str, DataFrame], scores: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """family, topic, emotion, value: the mean of each measure, by weight, by topic of each family.

    A family has the key, topic and weight; all families are put together before the scores (key, measures) join them once.
    """
    every = None
    for name, rows in families.items():
        one = rows.select(F.lit(name).alias("family"), key, F.col("topic").cast("string").alias("topic"), F.col("weight").cast("double").alias("weight"))
        every = one if every is None else every.unionByName(one)
    mean = lambda c: (F.sum(F.col(c) * F.col("weight")) / F.nullif(F.sum(F.when(F.col(c).isNotNull(), F.col("weight"))), F.lit(0.0))).alias(c)
    return every.join(scores.select(key, *measures), key, "left").groupBy("family", "topic").agg(*map(mean, measures)).unpivot(["family", "topic"], measures, "emotion", "value")


def cluster_terms(tokens: DataFrame, group: str, doc: str, k: int = 10) -> DataFrame:
    """group, term, score, rank: the terms of the greatest mean TF-IDF; rows have length one, idf is ln((1 + n) / (1 + df)) + 1.

    Counts by document and word are made once and stored, and so are the words' idf and the documents' norms; a
    document has one group. A term's score is its idf times the mean of its counts over the norms, so counts are
    shuffled once, by document. Tokens that are dealt by document are counted without a shuffle.
    """
    tf = stored(tokens.groupBy(group, doc, "word").agg(F.count("*").alias("tf")), "counts")
    members = tf.select(group, doc).distinct().groupBy(group).agg(F.count("*").alias("members"))
    n = members.agg(F.sum("members").alias("n"))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    idf = stored(df.join(F.broadcast(n)).select("word", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")), "idf")  # n is one row
    w = F.col("tf") * F.col("idf")
    norm = stored(tf.join(idf, "word").groupBy(doc).agg(F.sqrt(F.sum(w * w)).alias("norm")), "norms")
    mean = tf.join(norm, doc).groupBy(group, "word").agg(F.sum(F.col("tf") / F.col("norm")).alias("s")).join(idf, "word").join(members, group)
    scored = mean.select(group, F.col("word").alias("term"), (F.col("s") * F.col("idf") / F.col("members")).alias("score"))
    return sm.top_k(scored, [group], [F.desc(F.round("score", 9)), "term"], k)


def cluster_labels(terms: DataFrame, group: str, k: int = 5) -> DataFrame:
    """group and label: its first terms between slashes."""
    return terms.filter(F.col("rank") <= k).groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x.term), "/").alias("label"))


def with_outliers(rows: DataFrame, topic: str, least: int) -> DataFrame:
    """rows with topic -1 where a topic has fewer than ``least`` members, and outlier."""
    n = rows.groupBy(topic).agg(F.count("*").alias("_n"))
    own = F.when(F.col("_n") < least, -1).otherwise(F.col(topic))
    return rows.join(n, topic).withColumn(topic, own).withColumn("outlier", F.col(topic) == -1).drop("_n")


def review_score(rows: DataFrame, sources: list[str]) -> DataFrame:
    """rows with review_score and review_source: the first of the columns that is not null."""
    score = F.coalesce(*(F.col(c).cast("double") for c in sources))
    source = F.coalesce(*(F.when(F.col(c).isNotNull(), F.lit(c)) for c in sources))
    return rows.withColumns({"review_score": score, "review_source": source})


def topic_sheet(rows: DataFrame, topic: str, key: str, top: int = 25, drawn: int = 10, seed: int = 42, human: tuple[str, ...] = ("human_label", "coherent", "notes")) -> DataFrame:
    """The best examples of each topic by review_score, and others drawn at random, as one sheet with blank columns."""
    best = sm.top_k(rows, [topic], [F.desc("review_score"), key], top).withColumn("kind", F.lit("top"))
    rest = rows.join(best.select(key), key, "left_anti")
    some = sm.sample_per_group(rest, topic, key, drawn, seed).drop("draw").withColumn("kind", F.lit("random"))
    return best.unionByName(some).withColumns({c: F.lit("") for c in human})


def verification(topics: DataFrame, topic: str, score: str, least: int) -> DataFrame:
    """One row on a topic sheet: rows, topics, least, median and greatest score, zeros, missing ones, and topics with fewer than ``least`` rows."""
    n = topics.groupBy(topic).agg(F.count("*").alias("n"))
    sizes = n.agg(F.count("*").alias("topics"), F.min("n").alias("rows_min"), F.max("n").alias("rows_max"), F.count_if(F.col("n") < least).alias("small_topics"))
    one = topics.agg(F.count("*").alias("rows"), F.min(score).alias("score_min"), F.median(score).alias("score_median"), F.max(score).alias("score_max"), F.count_if(F.coalesce(score, F.lit(0.0)) == 0).alias("zeros"), F.count_if(F.col(score).isNull()).alias("missing"))
    return one.join(F.broadcast(sizes))  # one row


def emotion_verification(rows: DataFrame, emotion: str, key: str, words: str, preview: str) -> DataFrame:
    """By emotion: rows, segments, repeated ones, least and median words, rows under 80 words, and previews with glued words."""
    glued = F.count_if(F.col(preview).rlike(r"\p{Ll}\p{Lu}"))
    return rows.groupBy(F.col(emotion).alias("emotion")).agg(F.count("*").alias("rows"), F.count_distinct(key).alias("segments"), (F.count("*") - F.count_distinct(key)).alias("repeated"), F.min(words).alias("words_min"), F.median(words).alias("words_median"), F.count_if(F.col(words) < 80).alias("under_80"), glued.alias("glued"))


def verdicts(checks: DataFrame, rules: list[tuple[str, str, float, str]]) -> DataFrame:
    """item, value, level of checks (item, value) under rules (item, relation < or >, bound, level); without a hit it is ok."""
    level = F.lit("ok")
    for name, relation, bound, to in reversed(rules):
        hit = F.col("value") < bound if relation == "<" else F.col("value") > bound
        level = F.when((F.col("item") == name) & hit, to).otherwise(level)
    out = checks.withColumn("level", level)
    stop = out.agg(F.max(F.when(F.col("level") == "stop", 1).otherwise(0)).alias("s"))
    return out.join(F.broadcast(stop)).withColumn("go", F.col("s") == 0).drop("s")  # one row


def hardened(parts: dict[str, DataFrame], rules: list[tuple[str, str, float, str]]) -> DataFrame:
    """item (part.column), value, level and go: tables of one row each, as checks that are judged together (see ``verdicts``)."""
    rows = None
    for part, table in parts.items():
        one = table.select(F.explode(F.array(*(F.struct(F.lit(f"{part}.{c}").alias("item"), F.col(c).cast("double").alias("value")) for c in table.columns))).alias("x")).select("x.*")
        rows = one if rows is None else rows.unionByName(one)
    return verdicts(rows, rules)


def with_segments(rows: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of their segments; those of a name that rows have already get the suffix _segment."""
    named = segments.select(*keys, *(F.col(c).alias(f"{c}_segment" if c in rows.columns else c) for c in segments.columns if c not in keys))
    return rows.join(named, keys, "left")


def with_vectors(assigned: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Assignments with the columns of a manifest of vectors, joined by key, whatever the order of either; has_vector tells where there is one."""
    held = manifest.withColumns({"_key": F.col(key), "_held": F.lit(True)}).drop(key)
    return assigned.join(held, F.col(key) == F.col("_key"), "left").withColumn("has_vector", F.coalesce("_held", F.lit(False))).drop("_key", "_held")


def empty_rates(rows: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """by, column, n, rate of blank or underscore cells."""
    share = lambda c: F.avg((F.coalesce(F.trim(F.col(c)), F.lit("")).isin("", "_")).cast("int")).alias(c)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *map(share, columns)).unpivot([*by, "n"], columns, "column", "rate")


def group_columns(rows: DataFrame, candidates: list[str], most: int = 80, never: tuple[str, ...] = ("doc_id", "segment_id", "unit", "text_preview", "sent_ids")) -> DataFrame:
    """column and values of those that can group: candidates first, then all others with 2 to ``most`` values; one pass over the table."""
    names = [c for c in dict.fromkeys([*candidates, *rows.columns]) if c in rows.columns and c not in never]
    held = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    one = rows.agg(*(F.count_distinct(held(c)).alias(c) for c in names))
    return one.select(F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(c).alias("column"), F.col(c).alias("values")) for i, c in enumerate(names)))).alias("x")).select("x.*").filter((F.col("values") > 1) & (F.col("values") <= most))


def first_available(rows: DataFrame, keys: list[str], measures: list[str], weight: str) -> DataFrame:
    """key, value and weighted means of the measures by the first of the keys that any row has filled."""
    have = rows.agg(*(F.count(F.nullif(F.trim(F.col(k).cast("string")), F.lit(""))).alias(k) for k in keys)).first()
    key = next((k for k in keys if have[k]), keys[-1])
    return sm.weighted(rows.filter(F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) != ""), [key], [], measures, weight).select(F.lit(key).alias("key"), F.col(key).cast("string").alias("value"), "n", *measures)


def report(sections: dict[str, DataFrame], digits: int = 4) -> DataFrame:
    """section, no, line: Markdown tables of small tables (already ordered by a column ``no``), a line a row."""
    out = None
    for i, (title, table) in enumerate(sections.items()):
        cells = [c for c in table.columns if c != "no"]
        text = lambda c, t=table: F.coalesce(F.format_string(f"%.{digits}f", F.col(c)) if t.schema[c].dataType.typeName() == "double" else F.col(c).cast("string"), F.lit(""))
        body = table.select(F.lit(i).alias("section"), (F.col("no") + 3).cast("long").alias("no"), F.concat(F.lit("| "), F.concat_ws(" | ", *map(text, cells)), F.lit(" |")).alias("line"))
        head = [(1, f"## {title}"), (2, f"| {' | '.join(cells)} |"), (3, f"|{'---|' * len(cells)}")]
        one = table.sparkSession.createDataFrame(head, "no long, line string").select(F.lit(i).alias("section"), "no", "line").unionByName(body)
        out = one if out is None else out.unionByName(one)
    return out


def preview(docs: DataFrame, first: int = 5) -> DataFrame:
    """item, value on documents (doc_id, text, attrs, name): rows, ids, blank texts, all keys of metadata and the first names."""
    one = docs.agg(F.count("*").cast("string").alias("documents"), F.count_distinct("doc_id").cast("string").alias("distinct_ids"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").cast("string").alias("blank_texts"))
    keys = docs.select(F.explode(F.map_keys("attrs")).alias("k")).agg(F.array_join(F.array_sort(F.collect_set("k")), ",").alias("keys"))
    head = docs.orderBy("doc_id").limit(first).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "name"))), lambda x: x["name"]), " ").alias("first_keys"))
    return one.join(F.broadcast(keys)).join(F.broadcast(head)).unpivot([], ["documents", "distinct_ids", "blank_texts", "keys", "first_keys"], "item", "value")  # one row each


def validation(facts: DataFrame, checks: dict[str, tuple[str, str]]) -> DataFrame:
    """item and result of one row of facts: ok where a check's condition holds, else what it says (warn or fail)."""
    held = {name: F.when(F.expr(test), "ok").otherwise(bad) for name, (test, bad) in checks.items()}
    return facts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("item"), c.alias("result")) for n, c in held.items()))).alias("x")).select("x.*")
