"""A cleaning pipeline over ``documents``: toxicity, near duplicates, benchmark passages, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexharbor.llm import decontaminate, near_dedup, packing, pii, toxicity
from lexharbor.llm.scratch import Scratch, passing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score says toxic go. The model learns from all labels but those held out.

    Null and empty texts are scored as such and stay unless such texts are labelled toxic; repeated rows go or
    stay together; without labels of both classes, as in empty tables, every row stays. Other columns go.
    """
    known = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~toxicity.held_out("doc_id"))
    rows = docs.select(*COLUMNS)
    return toxicity.flagged(rows, known).filter("predicted = 0").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five words, similarity 0.8) stays: that of the smallest doc_id.

    Null and wordless texts and rows of null doc_id stay; rows that repeat a doc_id stay or go together.
    """
    spare = near_dedup.near_duplicates(docs.select("doc_id", "text")).filter("NOT kept").select("doc_id")
    return near_dedup.without(docs.select(*COLUMNS), spare)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go; null and empty texts stay, and every row does without a benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean(docs.select(*COLUMNS), items)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text. A null text becomes an empty one; every row stays."""
    found = pii.find_personal_data(docs.select(*COLUMNS)).withColumn("text", pii.masked())
    return found.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document goes in bins of training sequences. Null and empty texts are pieces of no units; each repeated row is packed."""
    text = F.coalesce("text", F.lit(""))
    return packing.pack(docs.select("doc_id", "source", F.octet_length(text).alias("units"), F.xxhash64(text).alias("cluster")))


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("decontamination", contamination), ("personal_data", personal), ("packing", packed)]
#: Log-odds fits, hash bands and bootstrapped patterns aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written and read again, and removed after the next one's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch, last = Scratch(spark, "pipeline"), ()
    for name, stage in STAGES:
        with passing(spark):
            docs = scratch.save(stage(spark, docs, sf_dir), name, last)
        last = (docs,)
    return docs
