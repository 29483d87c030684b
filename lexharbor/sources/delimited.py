"""Delimited tables in and out, and run manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as tx
from ..operators.numbering import numbered
from . import conllu

#: Names under which a sidecar table may hold the document id, in order.
KEYS = ["doc_id", "document_id", "id", "newdoc_id", "source_id", "title"]


#: Separators by a file's ending.
SUFFIXES = {".tsv": "\t", ".tab": "\t"}


def read(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """All columns as strings, empty cells empty; the separator is by the file's ending, or the commonest of tab, semicolon and comma in the header."""
    sep = sep or next((v for k, v in SUFFIXES.items() if path.lower().endswith(k)), None)
    if sep is None:
        head = spark.read.text(path).limit(1).collect()
        line = head[0][0] if head else ""
        sep = max("\t;,", key=line.count)
    return spark.read.csv(path, sep=sep, header=True, inferSchema=False, multiLine=False).fillna("")


def column_types(table: DataFrame) -> DataFrame:
    """place, column and type of string columns: bigint, double or boolean if every filled cell is one, else string; one pass."""
    cell = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    fits = lambda c, kind: F.count_if(cell(c).isNotNull() & cell(c).try_cast(kind).isNull()) == 0
    kind = lambda c: F.when(F.count(cell(c)) == 0, "string").when(fits(c, "bigint"), "bigint").when(fits(c, "double"), "double").when(F.count_if(cell(c).isNotNull() & ~F.lower(cell(c)).isin("true", "false")) == 0, "boolean").otherwise("string")
    one = table.agg(*(kind(c).alias(c) for c in table.columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(c).alias("column"), F.col(c).alias("type")) for i, c in enumerate(table.columns)))).alias("x")).select("x.*")


def retyped(table: DataFrame) -> DataFrame:
    """The table with the columns' types inferred again, blank cells null where a type isn't string."""
    kinds = {r["column"]: r["type"] for r in column_types(table).collect()}  # a row for each column
    return table.select(*(F.nullif(F.trim(F.col(c)), F.lit("")).cast(k).alias(c) if k != "string" else F.col(c) for c, k in kinds.items()))


def concatenated(parts: list[DataFrame]) -> DataFrame:
    """Tables one after the other by the names of their columns; a column that a table lacks is null there."""
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def stopwords(spark: SparkSession, path: str | None = None, extra: str = "") -> DataFrame:
    """word: the built-in list, the lines of a file but those that begin with #, and words between commas; normalised."""
    own = [(w,) for w in [*tx.STOPWORDS, *extra.split(",")]]
    rows = spark.createDataFrame(own, "word string")
    if path is not None:
        rows = rows.union(spark.read.text(path).filter(~F.ltrim("value").startswith("#")).select("value"))
    return rows.select(tx.lexeme()(F.col("word")).alias("word")).filter("word <> ''").distinct()


def source_rows(spark: SparkSession, path: str, tag: str = "doc") -> DataFrame:
    """pos, doc_id, attrs of a metadata source by its ending: XML (attributes), CoNLL-U (comments) or a table (columns, blank cells left out)."""
    low = path.lower()
    if low.endswith(".xml"):
        rows = conllu.disambiguated(conllu.xml_documents(spark, path, tag)).select(F.struct("file", "doc_no").alias("at"), "doc_id", "attrs")
    elif low.endswith((".conllu", ".conll")):
        sents = conllu.sentences(conllu.blocks(conllu.lines(spark, path)))
        held = conllu.metadata(sents).filter("value <> ''").groupBy("file", "doc_no", "doc_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("attrs"))
        rows = sents.select("file", "doc_no", "doc_id").distinct().join(held, ["file", "doc_no", "doc_id"], "left").select(F.struct("file", "doc_no").alias("at"), "doc_id", F.coalesce("attrs", F.create_map().cast("map<string,string>")).alias("attrs"))
    else:
        table = read(spark, path)
        key = next((c for k in KEYS for c in table.columns if c.lower() == k), None)
        every = F.create_map(*(x for c in table.columns for x in (F.lit(c), F.col(c))))
        rows = table.select(F.monotonically_increasing_id().alias("at"), (F.col(key) if key else F.lit("")).alias("doc_id"), F.map_filter(every, lambda k, v: F.trim(v) != "").alias("attrs"))
    return numbered(rows.withColumn("all", F.lit(1)), ["all"], ["at"], "n").select((F.col("n") - 1).cast("long").alias("pos"), "doc_id", "attrs")


def sidecar(table: DataFrame, key: str | None = None) -> DataFrame:
    """The table with its key column named doc_id; the first row of each key."""
    by_name = {c.lower(): c for c in table.columns}
    found = key or next((by_name[k] for k in KEYS if k in by_name), None)
    if found is None:
        raise ValueError("no key column")
    return table.withColumnRenamed(found, "doc_id").withColumn("_n", F.monotonically_increasing_id()).groupBy("doc_id").agg(F.min_by(F.struct(*(c for c in table.columns if c != found)), "_n").alias("r")).select("doc_id", "r.*")


def attach(docs: DataFrame, extra: DataFrame) -> DataFrame:
    """docs left-joined with a sidecar; columns of the same name get the suffix _metadata."""
    named = extra.select("doc_id", *(F.col(c).alias(f"{c}_metadata" if c in docs.columns else c) for c in extra.columns if c != "doc_id"))
    return docs.join(named, "doc_id", "left")


def renamed(table: DataFrame, key_map: DataFrame) -> DataFrame:
    """Long metadata (doc_id, key, value) under a reviewed map (original_key, canonical_key, action: keep, rename, drop)."""
    bad = F.when(~F.col("action").isin("keep", "rename", "drop"), F.raise_error(F.concat(F.lit("invalid action "), F.col("action")))).otherwise(F.col("action"))
    joined = table.join(key_map.select(F.col("original_key").alias("key"), "canonical_key", bad.alias("action")), "key", "left")
    return joined.filter(F.coalesce("action", F.lit("keep")) != "drop").select("doc_id", F.coalesce(F.nullif("canonical_key", F.lit("")), F.col("key")).alias("key"), "value")


def resolved(table: DataFrame, policy: str = "existing") -> DataFrame:
    """One value per (doc_id, key) of rows with ``pos``: existing (first), incoming (last) or join (distinct, by bar)."""
    filled = table.filter(F.coalesce(F.trim("value"), F.lit("")) != "")
    how = {"existing": F.min_by("value", "pos"), "incoming": F.max_by("value", "pos"), "join": F.array_join(F.array_sort(F.collect_set("value")), " | ")}[policy]
    return filled.groupBy("doc_id", "key").agg(how.alias("value"), (F.count_distinct("value") > 1).alias("conflict"))


def write_tsv(df: DataFrame, path: str, one_file: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.mode("overwrite").csv(path, sep="\t", header=True)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256, md5 of input files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))


def run_manifest(tables: dict[str, DataFrame], args: dict[str, object], warnings: list[str], inputs: DataFrame | None = None, columns: dict[str, list[str]] | None = None) -> DataFrame:
    """kind, name, value of a run: its arguments, the rows of its tables, its warnings, the hashes of its inputs (``manifest``) and the lexicon's columns by role."""
    spark = next(iter(tables.values())).sparkSession
    fixed = [("argument", k, str(v)) for k, v in sorted(args.items())] + [("warning", str(i), w) for i, w in enumerate(warnings, 1)]
    fixed += [("lexicon_column", role, ",".join(names)) for role, names in (columns or {}).items()]
    out = spark.createDataFrame(fixed, "kind string, name string, value string")
    for name, table in tables.items():
        out = out.union(table.agg(F.count("*").cast("string").alias("value")).select(F.lit("rows"), F.lit(name), "value"))
    if inputs is not None:
        out = out.union(inputs.select(F.lit("sha256"), F.element_at(F.split("path", "/"), -1), "sha256"))
    return out


def numbers(table: DataFrame, columns: list[str]) -> DataFrame:
    return table.withColumns({c: tx.number(F.col(c)) for c in columns})
