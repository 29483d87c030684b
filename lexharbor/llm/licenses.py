"""Licence scans by canonical digests, in DataFrame functions only.

A text's canonical form is its words without copyright lines, in one spelling. Entire texts are looked up by the
digest of that form, and so is every stretch of a text that begins like a known licence and has as many words, so
that layout, comment marks and what stands around a licence don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .license_texts import KNOWN
from .scratch import Scratch

#: Equivalent spellings, after lower-casing and the reduction to words.
SPELLINGS = [("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("sublicence", "sublicense"), ("organisation", "organization"), ("merchantibility", "merchantability"), ("non infringement", "noninfringement"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("https", "http")]
#: A line that begins with a copyright notice: the word, with a year, a sign, a placeholder or ``by`` in the same
#: line (a wrapped line of a licence may begin with the word alone), or the sign, or the reservation of rights.
COPYRIGHT = r"(?m)^[^\p{L}\p{N}\n(\x{00A9}]*(?:copyright[^\n]*(?:\(c\)|\x{00A9}|[0-9]{4}|[\[<{])|copyright\s+by\b|\(c\)|\x{00A9}|all rights reserved)[^\n]*$"
#: Words by which a known text is sought within others (shorter ones are only looked up as entire texts), and known texts up to which their table is broadcast.
HEAD, BROADCAST_ROWS = 3, 100_000


def canonical(text: Column) -> Column:
    """Lower-cased words of a text without its copyright lines, in one spelling; empty for null.

    Each substitution is one pass; punctuation, dashes, quotes and white space all become one blank.
    """
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT, "")
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(out)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known(spark: SparkSession, texts: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """(license, digest, head, n) of known texts, a digest once: the least name; head is the first words, n the number of words."""
    table = spark.createDataFrame(texts, "license string, text string").withColumn("c", canonical(F.col("text"))).filter("c <> ''")
    return table.groupBy(F.sha2("c", 256).alias("digest")).agg(F.min("license").alias("license"), F.first(F.substring_index("c", " ", HEAD)).alias("head"), F.first(F.size(F.split("c", " "))).alias("n"))


def scan_licenses(docs: DataFrame, licenses: DataFrame | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): digest, license, n_notices, notices.

    ``license`` names the known licence that the entire text is, else null. ``notices`` lists, comma-joined and
    sorted, the licences whose words stand anywhere in the text, n_notices counts those names. Null and empty
    texts have the digest of the empty text and no licence. Repeated rows give repeated results; other columns
    are ignored. ``licenses`` is as from ``known``; its heads and lengths, a few bytes a licence, are read by
    the driver. It is broadcast only up to BROADCAST_ROWS; a repeated digest counts as its least name.
    """
    licenses = known(docs.sparkSession) if licenses is None else licenses.groupBy("digest").agg(F.min("license").alias("license"), F.first("head").alias("head"), F.first("n").alias("n"))
    marks = [r for r in licenses.select("head", "n").distinct().collect() if r["n"] >= HEAD]
    names = licenses.select("digest", "license")
    if licenses.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        names = F.broadcast(names)
    rows = docs.select("doc_id", canonical(F.col("text")).alias("c")).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2("c", 256).alias("digest"), F.split("c", " ").alias("w"))
    # where a known text may begin, then the digests of as many words; each array is evaluated once a row
    three = F.transform(F.arrays_zip("w", *(F.slice("w", i + 1, F.greatest(F.size("w") - i, F.lit(0))).alias(f"w{i}") for i in range(1, HEAD))), lambda x, i: F.struct((i + 1).alias("i"), F.concat_ws(" ", x.w, *(x[f"w{j}"] for j in range(1, HEAD))).alias("head")))
    begins = F.filter(three, lambda x: x.head.isin(sorted({r["head"] for r in marks})))
    sizes = F.array(*(F.struct(F.lit(r["head"]).alias("head"), F.lit(r["n"]).alias("n")) for r in marks)) if marks else F.array().cast("array<struct<head:string,n:int>>")

    def digests(w: Column) -> Column:
        at = lambda x: F.transform(F.filter(sizes, lambda s: (s.head == x.head) & (x.i + s.n - 1 <= F.size(w))), lambda s: F.sha2(F.array_join(F.slice(w, x.i, s.n), " "), 256))
        return F.flatten(F.transform(begins, at))

    # every text is canonicalised once: its digest and those of its stretches are stored, without words
    scratch = Scratch(docs.sparkSession, "licenses")
    slim = scratch.save(rows.select("row", "doc_id", "digest", F.array_distinct(F.flatten(F.transform(F.array("w"), digests))).alias("parts")), "digests")
    whole = slim.drop("parts").join(names, "digest", "left")
    parts = slim.select("row", F.explode("parts").alias("digest")).join(names, "digest")
    named = parts.groupBy("row").agg(F.array_sort(F.collect_set("license")).alias("names"))
    out = whole.join(named, "row", "left")
    return scratch.keep(out.select("doc_id", "digest", "license", F.coalesce(F.array_join("names", ","), F.lit("")).alias("notices"), F.coalesce(F.size("names"), F.lit(0)).cast("long").alias("n_notices")))
