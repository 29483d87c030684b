"""Tokens stay dealt by document, CoNLL-U blocks by split; texts in rows are cut into blocks as files are."""

import re

from pyspark.sql import Window, functions as F

from lexharbor.operators import segments as sg
from lexharbor.plans import meta
from lexharbor.sources import conllu

DATA = "/root/testdata/sf0.001"


def shuffles(df):
    return len(re.findall(r"Exchange hashpartitioning|RepartitionByExpression|REPARTITION_BY", df._jdf.queryExecution().executedPlan().toString()))


def test_groups_by_document_need_no_shuffle_of_tokens(spark):
    tokens = sg.annotate(spark.read.parquet(f"{DATA}/documents.parquet").repartition(8))  # as many partitions as there are cores, or more
    assert shuffles(tokens.groupBy("doc_id", "par").count()) == shuffles(tokens)
    assert shuffles(tokens.withColumn("n", F.count("*").over(Window.partitionBy("doc_id")))) == shuffles(tokens)


def test_blanks_behind_words(spark):
    text = "Aa bs...  !x. \n...Cats\n dogs 7 Čas"
    got = [(r.par, r.sent, r.form, r.lemma, r.upos, r.space_after) for r in sg.annotate(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("pos").collect()]
    assert [r[2] for r in got] == ["Aa", "bs", ".", ".", ".", "!", "x", ".", "Cats", "dogs", "7", "Čas"]
    assert [r[5] for r in got] == [True, False, False, False, True, False, False, True, True, True, True, True]
    assert [r[:2] for r in got] == [(1, 1)] * 5 + [(1, 2)] * 1 + [(1, 3)] * 2 + [(2, 1)] + [(3, 1)] * 3
    assert [r[3:5] for r in got][8:] == [("cat", "PROPN"), ("dog", "VERB"), ("7", "NUM"), ("čas", "PROPN")]


def test_blocks_of_texts_keep_their_split(spark):
    blocks = conllu.text_blocks(meta._conllu(spark, DATA))
    assert shuffles(blocks.withColumn("n", F.count("*").over(Window.partitionBy("file", "split").orderBy("at")))) == shuffles(blocks)


def test_text_blocks(spark):
    rows = [("f", 0, 0, "\n \n# newdoc id = a\r\n1\tx\r\n \r\n\n2\ty\n"), ("f", 0, 1, ""), ("f", 1, 2, "3\tz\n\n\n")]
    got = conllu.text_blocks(spark.createDataFrame(rows, "file string, split long, place long, value string")).orderBy("at").collect()
    assert [r.lines for r in got] == [["# newdoc id = a", "1\tx"], ["2\ty"], ["3\tz"]]
