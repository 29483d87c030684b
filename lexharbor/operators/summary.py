"""Group summaries, coverage, crosswalks, alignment and top-k sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as tx
from .numbering import numbered


def weighted(df: DataFrame, group: list[str], sums: list[str], means: list[str], weight: str) -> DataFrame:
    """n, sums, and means weighted over non-null values; where all weights are zero, plain means."""
    def mean(c: str):
        w = F.sum(F.when(F.col(c).isNotNull(), F.col(weight)))
        return F.coalesce(F.sum(F.col(c) * F.col(weight)) / F.nullif(w.cast("double"), F.lit(0.0)), F.avg(c)).alias(c)

    return df.groupBy(*group).agg(F.count("*").alias("n"), F.sum(weight).alias("weight"), *(F.sum(c).alias(c) for c in sums), *(mean(c) for c in means))


def key_coverage(metadata: DataFrame, total: int, key: str = "key", value: str = "value") -> DataFrame:
    """key, with_key, with_value, coverage over ``total`` documents."""
    filled = F.count_if(F.coalesce(F.trim(F.col(value)), F.lit("")) != "")
    return metadata.groupBy(key).agg(F.count("*").alias("with_key"), filled.alias("with_value"), (filled / F.lit(total)).alias("coverage"))


def top_k(df: DataFrame, group: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark's group limit keeps the window from sorting whole groups."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(rank) <= k)


def best_per_key(df: DataFrame, key: str, order: list) -> DataFrame:
    return top_k(df, [key], order, 1, "_rank").drop("_rank")


def sample_per_group(df: DataFrame, group: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows of each group in an order that only key and seed decide."""
    return top_k(df.withColumn("draw", F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(seed)))), [group], ["draw", key], n)


def alignment(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """status (both, left_only, right_only) and rows."""
    x, y = a.select(F.col(key).alias("a")), b.select(F.col(key).alias("b"))
    status = F.when(F.col("b").isNull(), "left_only").when(F.col("a").isNull(), "right_only").otherwise("both")
    return x.join(y, F.col("a") == F.col("b"), "full_outer").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def suffixed(df: DataFrame, key: str, order: str) -> DataFrame:
    """Repeated keys as key__0001, ..., unique ones unchanged; in the column unique_id. No task holds all rows of a key."""
    rows = numbered(df, [key], [order], "_i", "_all")
    return rows.withColumn("unique_id", F.when(F.col("_all") > 1, F.concat(F.col(key), F.lit("__"), tx.padded(F.col("_i"), 4))).otherwise(F.col(key))).drop("_i", "_all")


def islands(df: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Runs of equal values: group, run, value, n and the ends of the first order column."""
    w = Window.partitionBy(group).orderBy(*order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    marked = df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(group, "run", value).agg(F.count("*").alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def iob_spans(tokens: DataFrame, keys: list[str], order: str, tag: str = "ner", form: str = "form") -> DataFrame:
    """Entities of B-, I- tags: keys, type, text; an I- that continues nothing is ignored."""
    w = Window.partitionBy(*keys).orderBy(order)
    kind, lead = F.regexp_extract(tag, "^[BI]-(.+)$", 1), F.substring(tag, 1, 1)
    marked = tokens.withColumn("type", kind).withColumn("_run_start", F.when((lead == "I") & F.coalesce(F.lag(kind).over(w) == kind, F.lit(False)), 0).otherwise(1))
    marked = marked.withColumn("_run", F.sum("_run_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = marked.filter("type <> ''").groupBy(*keys, "_run", "type").agg(F.min(order).alias("start"), F.min_by(tag, order).alias("_first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, form))), lambda x: x[form]), " ").alias("text"))
    return spans.filter("_first LIKE 'B%'").drop("_run", "_first")
