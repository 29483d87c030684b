"""Topics, clusters and embeddings: class TF-IDF, coherence, centroids, and pyspark.ml models."""

from __future__ import annotations

import math

from pyspark.errors import IllegalArgumentException
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.stored import stored
from . import lda as bayes
from .review import topic_weights


def class_tfidf(tokens: DataFrame, group: str, k: int) -> DataFrame:
    """group, term, score, rank: term share within the class times ln(1 + mean class words / term count)."""
    tf = tokens.groupBy(group, "word").agg(F.count("*").alias("tf"))
    by_class = tf.groupBy(group).agg(F.sum("tf").alias("class_n"))
    by_term = tf.groupBy("word").agg(F.sum("tf").alias("term_n"))
    mean = by_class.agg(F.avg("class_n").alias("mean_n"))
    scored = tf.join(by_class, group).join(by_term, "word").join(F.broadcast(mean)).withColumn("score", F.col("tf") / F.col("class_n") * F.log1p(F.col("mean_n") / F.col("term_n")))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(F.round("score", 12)), "word")))
    return ranked.filter(F.col("rank") <= k).select(group, F.col("word").alias("term"), "score", "rank")


def umass(tokens: DataFrame, topics: DataFrame) -> DataFrame:
    """topic, coherence: mean over term pairs (i < j) of ln((docs with both + 1) / max(1, docs with i)); topics (topic, rank, term)."""
    held = tokens.select("doc_id", "word").join(topics, F.col("word") == F.col("term")).select("topic", "rank", "doc_id").distinct()
    df = held.groupBy("topic", "rank").agg(F.count("*").alias("d"))
    other = held.select("topic", "doc_id", F.col("rank").alias("j"))
    pairs = held.withColumnRenamed("rank", "i").join(other, ["topic", "doc_id"]).filter("i < j").groupBy("topic", "i", "j").agg(F.count("*").alias("both"))
    grid = topics.select("topic", F.col("rank").alias("i")).join(topics.select("topic", F.col("rank").alias("j")), "topic").filter("i < j")
    full = grid.join(pairs, ["topic", "i", "j"], "left").join(df.withColumnRenamed("rank", "i"), ["topic", "i"], "left")
    return full.groupBy("topic").agg(F.avg(F.log((F.coalesce("both", F.lit(0)) + 1) / F.greatest(F.coalesce("d", F.lit(0)), F.lit(1)))).alias("coherence"))


def centroid_cosine(vectors: DataFrame, key: str, group: str, vector: str) -> DataFrame:
    """key, group, cosine to the mean vector of the group.

    Means are summed within tasks (``Summarizer``), so each task hands on a vector for each group and no row is
    taken apart; rows get their group's mean by a join that Spark broadcasts where the means are small.
    """
    rows = vectors.select(key, group, F.col(vector).cast("array<double>").alias("v"))
    means = rows.groupBy(group).agg(Summarizer.mean(array_to_vector("v")).alias("m")).select(F.col(group).alias("_g"), vector_to_array("m").alias("c"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t)
    cosine = dot(F.col("v"), F.col("c")) / F.nullif(F.sqrt(dot(F.col("v"), F.col("v"))) * F.sqrt(dot(F.col("c"), F.col("c"))), F.lit(0.0))
    return rows.join(means, F.col(group).eqNullSafe(F.col("_g"))).select(key, group, cosine.alias("cosine"))


#: Documents that a term is in at least, the share of documents at most, and terms at most.
LIMITS = (2, 0.85, 50_000)


def _vectorized(docs: DataFrame, least: int, limits: tuple[int, float, int] = LIMITS, retry: bool = True) -> tuple[DataFrame, CountVectorizerModel | None]:
    """Documents of at least ``least`` words with their counts; a vocabulary of fewer than five terms, or none, gives no model.

    limits are as LIMITS; where there are fewer than five documents, terms may be in one. If no term is within the
    limits, those of any number of documents are taken, unless retry is false. Words are cut once and stored, and so
    are the counts (doc_id, features), which models read in each of their iterations.
    """
    kept = stored(docs.select("doc_id", "words").filter(F.size("words") >= least), "words")
    n = kept.count()
    if n < 2:
        return kept, None
    low, high, most = limits
    for min_df, share in ((low if n >= 5 else 1, high), (1, 1.0))[: 2 if retry else 1]:
        max_df = share * n  # as a number: for a share, the vectorizer would keep all words to count the documents
        if max_df < min_df:
            continue
        try:
            model = CountVectorizer(inputCol="words", outputCol="features", minDF=min_df, maxDF=max_df, vocabSize=most).fit(kept)
        except IllegalArgumentException:  # no term is left
            continue
        if len(model.vocabulary) < 5:
            return kept, None
        return stored(model.transform(kept).select("doc_id", "features"), "features"), model
    return kept, None


def lda_grid(docs: DataFrame, counts: list[int], iterations: int = 30, terms: int = 20, least: int = 30, seed: int = 42, limits: tuple[int, float, int] = LIMITS) -> DataFrame:
    """k, perplexity, coherence and chosen for each number of topics below the number of documents.

    Chosen is that of the greatest mean coherence, then the least perplexity. Perplexity is of the fitted
    documents, per word, by the variational bound of an online model; coherence is of each topic's terms.
    """
    spark = docs.sparkSession
    rows, vectorizer = _vectorized(docs, least, limits)
    out, n = [], rows.count()
    size = 0 if vectorizer is None else len(vectorizer.vocabulary)
    for k in sorted({min(k, n - 1) for k in counts if min(k, n - 1) >= 2}) if size else ():
        held = bayes.counts(rows)
        model = bayes.fit(held, size, k, iterations, seed)
        found = bayes.coherence(held, bayes.described(model.weights, terms))
        out.append((k, math.exp(bayes.log_perplexity(held, model)), sum(found.values()) / len(found) if found else 0.0))
    best = min(out, key=lambda r: (-r[2], r[1]))[0] if out else None
    return spark.createDataFrame([(*r, r[0] == best) for r in out], "k int, perplexity double, coherence double, chosen boolean")


def lda_weights(docs: DataFrame, k: int = 20, iterations: int = 30, least: int = 30, seed: int = 42, limits: tuple[int, float, int] = LIMITS) -> DataFrame:
    """doc_id, topic, probability and dominant for each document of ``least`` words and each topic."""
    rows, vectorizer = _vectorized(docs, least, limits)
    if vectorizer is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, topic int, probability double, dominant boolean")
    held = bayes.counts(rows)
    model = bayes.fit(held, len(vectorizer.vocabulary), min(k, max(2, rows.limit(k + 1).count() - 1)), iterations, seed)
    return topic_weights(bayes.distributions(held, model), "doc_id", "v")


def kmeans_with_silhouette(vectors: DataFrame, key: str, vector: str, k: int | None = None, seed: int = 42) -> DataFrame:
    """key, cluster and the silhouette of all rows (squared distances), the same in each row."""
    rows = vectors.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    k = k or max(2, min(30, int(rows.count() ** 0.5)))
    held = KMeans(k=k, seed=seed, maxIter=10).fit(rows).transform(rows)
    return held.select(key, F.col("prediction").alias("cluster"), F.lit(float(ClusteringEvaluator().evaluate(held))).alias("silhouette"))


def save_topics(model, vectorizer: CountVectorizerModel, path: str) -> None:
    """A fitted model with its vocabulary, to be read again by ``load_topics``."""
    PipelineModel([vectorizer, model]).write().overwrite().save(path)


def load_topics(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def lda(docs: DataFrame, k: int = 20, iterations: int = 30, terms: int = 20, least: int = 30, seed: int = 42) -> DataFrame:
    """topic, rank, term, weight; docs (doc_id, words), those of at least ``least`` words.

    Fitted by EM, which reads every document in each iteration. Topics are fewer than documents; with fewer than
    two documents or five terms there are none.
    """
    spark = docs.sparkSession
    none = spark.createDataFrame([], "topic int, rank int, term string, weight double")
    rows, vectorizer = _vectorized(docs, least, retry=False)
    if vectorizer is None:
        return none
    size = len(vectorizer.vocabulary)
    weights = bayes.fit_em(bayes.counts(rows), size, min(k, max(2, rows.limit(k + 1).count() - 1)), iterations, seed)
    words = vectorizer.vocabulary
    return spark.createDataFrame([(t, r + 1, words[w], x) for t, r, w, x in bayes.described(weights, terms)], "topic int, rank int, term string, weight double")


def kmeans(vectors: DataFrame, key: str, vector: str, k: int | None = None, seed: int = 42) -> DataFrame:
    """key, cluster; k defaults to the square root of the rows, from 2 to 30."""
    rows = vectors.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    k = k or max(2, min(30, int(rows.count() ** 0.5)))
    return KMeans(k=k, seed=seed, maxIter=10).fit(rows).transform(rows).select(key, F.col("prediction").alias("cluster"))


def pca(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """key, x, y: centred coordinates on the first two components."""
    rows = vectors.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    out = PCA(k=2, inputCol="features", outputCol="p").fit(rows).transform(rows).select(key, vector_to_array("p").alias("p"))
    mean = out.agg(F.avg(F.col("p")[0]).alias("mx"), F.avg(F.col("p")[1]).alias("my"))
    return out.join(F.broadcast(mean)).select(key, (F.col("p")[0] - F.col("mx")).alias("x"), (F.col("p")[1] - F.col("my")).alias("y"))
