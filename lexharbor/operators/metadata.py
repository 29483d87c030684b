"""Metadata of documents as rows (doc_id, pos, key, value): inventories, repair, reviewed maps, and restoring by id or order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as tx
from .numbering import numbered

#: Keys that make metadata useful, the order of the columns of a metadata table, and ids that name no document.
USEFUL = ["title", "author", "genre", "century", "year", "publication", "period", "source", "url", "translator"]
PREFERRED = ["doc_id", "title", "author", "genre", "century", "year", "publication", "url", "source"]
GENERIC_IDS = ["doc", "document", "corpus"]


def _filled(value: str = "value") -> Column:
    return F.coalesce(F.trim(F.col(value)), F.lit("")) != ""


def distribution(rows: DataFrame) -> DataFrame:
    """key, value, n; blank values count as <EMPTY>."""
    return rows.groupBy("key", F.when(_filled(), F.trim("value")).otherwise("<EMPTY>").alias("value")).agg(F.count("*").alias("n"))


def inventory(rows: DataFrame, samples: int = 5) -> DataFrame:
    """key, n, n_empty, n_values and the commonest values with their counts, and a blank map to fill in: canonical_key and action."""
    counts = rows.groupBy("key", "value").agg(F.count("*").alias("c"))
    ranked = counts.withColumn("_r", F.when(_filled(), F.row_number().over(Window.partitionBy("key", _filled()).orderBy(F.desc("c"), "value"))))
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_r") <= samples, F.struct("_r", F.concat_ws(" x", "value", F.col("c").cast("string")).alias("s"))))), lambda x: x.s), "; ")
    out = ranked.groupBy("key").agg(F.sum("c").alias("n"), F.sum(F.when(_filled(), 0).otherwise(F.col("c"))).alias("n_empty"), F.count_if(_filled()).alias("n_values"), shown.alias("samples"))
    return out.withColumns({"canonical_key": tx.canonical_key(F.col("key")), "action": F.when(tx.canonical_key(F.col("key")) == "", "drop").when(tx.canonical_key(F.col("key")) == F.col("key"), "keep").otherwise("rename")})


def useful(rows: DataFrame) -> DataFrame:
    """One row: whether any document has any of the useful keys filled."""
    return rows.agg(F.coalesce(F.bool_or(F.col("key").isin(USEFUL) & _filled()), F.lit(False)).alias("useful"))


def match_ratio(docs: DataFrame, extra: DataFrame, least: float = 0.8) -> DataFrame:
    """documents, matched, ratio and a warning where fewer than ``least`` of the documents have a row of the other table."""
    held = docs.select("doc_id").join(extra.select("doc_id").distinct().withColumn("_m", F.lit(1)), "doc_id", "left")
    one = held.agg(F.count("*").alias("documents"), F.count("_m").alias("matched"))
    return one.withColumn("ratio", F.coalesce(F.col("matched") / F.nullif("documents", F.lit(0)), F.lit(0.0))).withColumn("warning", F.col("ratio") < least)


def canonical(rows: DataFrame) -> DataFrame:
    """rows under canonical keys, the first filled value of each: doc_id, key, value, provenance (the key it had), aliases, conflict."""
    named = rows.withColumn("original", F.col("key")).withColumn("key", tx.canonical_key(F.col("key"))).filter("key <> ''")
    first = F.min_by(F.struct("value", "original"), F.struct(~_filled(), F.col("pos")))
    out = named.groupBy("doc_id", "key").agg(first.alias("f"), F.count_if(F.col("original") != F.col("key")).alias("aliases"), (F.count_distinct(F.when(_filled(), F.trim("value"))) > 1).alias("conflict"))
    return out.select("doc_id", "key", F.trim("f.value").alias("value"), F.col("f.original").alias("provenance"), "aliases", "conflict")


def coverage_gate(rows: DataFrame, total: int, least: dict[str, float]) -> DataFrame:
    """key, coverage, least and ok for keys that must be filled in a share of ``total`` documents."""
    wanted = rows.sparkSession.createDataFrame(sorted(least.items()), "key string, least double")
    have = rows.filter(_filled()).groupBy("key").agg(F.count_distinct("doc_id").alias("n"))
    return wanted.join(have, "key", "left").select("key", (F.coalesce("n", F.lit(0)) / F.lit(max(1, total))).alias("coverage"), "least").withColumn("ok", F.col("coverage") >= F.col("least"))


def normalized(rows: DataFrame) -> DataFrame:
    """Canonical metadata with plain years (1500 to 2099) and centuries, a century derived from the year where there is none, and the fix of each row.

    fix is renamed, value, conflict (the first value stays), derived or null, the first that applies.
    """
    base = canonical(rows)
    year = F.regexp_extract("value", r"(?:^|[^0-9])((?:1[5-9]|20)[0-9]{2})(?:[^0-9]|$)", 1)
    clean = F.when(F.col("key") == "year", F.when(year != "", year).otherwise(F.col("value"))).when(F.col("key") == "century", F.coalesce(tx.century(F.col("value")).cast("string"), F.col("value"))).otherwise(F.col("value"))
    fixed = base.withColumn("clean", clean).withColumn("fix", F.when(F.col("conflict"), "conflict").when(F.col("clean") != F.col("value"), "value").when(F.col("provenance") != F.col("key"), "renamed")).select("doc_id", "key", F.col("clean").alias("value"), "fix")
    years = fixed.filter("key = 'year' AND value RLIKE '^[0-9]{4}$'")
    without = years.join(fixed.filter("key = 'century' AND value <> ''").select("doc_id"), "doc_id", "left_anti")
    derived = without.select("doc_id", F.lit("century").alias("key"), tx.century(F.col("value")).cast("string").alias("value"), F.lit("derived").alias("fix"))
    blank = fixed.filter("key = 'century' AND value = ''").join(derived.select("doc_id", "key"), ["doc_id", "key"], "left_semi")
    return fixed.join(blank.select("doc_id", "key"), ["doc_id", "key"], "left_anti").unionByName(derived)


def value_problems(rows: DataFrame) -> DataFrame:
    """doc_id, key, value, problem of canonical metadata (doc_id, key, value): tabs, centuries beyond 8 to 21 or without a number, years beyond 800 to 2100 or without one."""
    value = F.trim(F.regexp_replace("value", r"^\s+|\s+$", ""))
    outside = lambda form, low, high: F.filter(F.transform(F.regexp_extract_all(value, F.lit(form), F.lit(0)), lambda n: n.try_cast("decimal(38,0)")), lambda n: n.isNull() | ~n.between(low, high))
    told = lambda form, low, high, none, far: F.when(~value.rlike(form), F.array(F.lit(none))).otherwise(F.array_repeat(F.lit(far), F.size(outside(form, low, high))))
    tab = F.when(F.contains(value, F.lit("\t")), F.array(F.lit("tab in value"))).otherwise(F.array().cast("array<string>"))
    own = F.when(F.col("key") == "century", told("[0-9]+", 8, 21, "no numeric century", "century outside 8-21")).when(F.col("key") == "year", told("[0-9]{3,4}", 800, 2100, "no year of 3 or 4 digits", "year outside 800-2100")).otherwise(F.array().cast("array<string>"))
    return rows.filter(_filled()).select("doc_id", "key", "value", F.explode(F.concat(tab, own)).alias("problem"))


def renewed(docs: DataFrame, id_attribute: str = "id") -> tuple[DataFrame, DataFrame]:
    """Documents (doc_index, attrs) with unique ids and canonical attributes (doc_index, doc_id, attrs), and the log of what was done.

    The log has doc_index, action, old_key, new_key, old_value and new_value: rename_key, conflict_keep_first (the first
    attribute of a key stays), normalize_value (years and centuries), derive_century_from_year and set_doc_id.
    Repeated ids get __0002 and so on in the order of doc_index; without an id, the title serves.
    """
    entry = lambda e: F.struct(e.key.alias("raw"), tx.canonical_key(tx.bare_name(e.key)).alias("key"), tx.comment_safe(e.value).alias("value"))
    rows = docs.select("doc_index", F.col("attrs").alias("given"), F.transform(F.map_entries("attrs"), entry).alias("e"))
    ids = ["id", "xml_id", "doc_id", ""]
    first = F.filter("e", lambda x, i: ~x.key.isin(ids) & ~F.exists(F.slice("e", 1, i), lambda y: y.key == x.key))
    rows = rows.withColumn("first", first)
    plain = lambda x: F.when(x.key == "year", F.coalesce(F.nullif(tx.year(x.value), F.lit("")), x.value)).when(x.key == "century", F.coalesce(tx.century(x.value).cast("string"), x.value)).otherwise(x.value)
    rows = rows.withColumn("clean", F.transform("first", lambda x: F.struct(x.key.alias("key"), x.value.alias("old"), plain(x).alias("value"))))
    of = lambda key: F.get(F.filter("clean", lambda x: x.key == key), F.lit(0)).value
    century = F.when(F.coalesce(of("century"), F.lit("")) == "", tx.century(F.when(of("year").rlike("^[0-9]{4}$"), of("year"))).cast("string"))
    rows = rows.withColumn("derived", century)
    base = F.coalesce(F.nullif(F.element_at("given", id_attribute), F.lit("")), F.nullif(F.element_at("given", "xml:id"), F.lit("")), F.nullif(F.element_at("given", "doc_id"), F.lit("")), F.lit(""))
    rows = rows.withColumns({"old_id": base, "_id": tx.safe_id(F.when(base != "", base).otherwise(F.coalesce(of("title"), F.lit(""))))})
    rows = numbered(rows, ["_id"], ["doc_index"], "_n")
    rows = rows.withColumn("doc_id", F.when(F.col("_n") == 1, F.col("_id")).otherwise(F.concat("_id", F.lit("__"), tx.padded(F.col("_n"), 4))))
    log = lambda action, old_key, new_key, old, new: F.struct(F.lit(action).alias("action"), old_key.alias("old_key"), new_key.alias("new_key"), old.alias("old_value"), new.alias("new_value"))
    renamed = F.transform(F.filter("e", lambda x: (x.key != x.raw) & (x.raw != "xml:id")), lambda x: log("rename_key", x.raw, x.key, x.value, x.value))
    held = lambda x: F.get(F.filter("first", lambda y: y.key == x.key), F.lit(0)).value
    conflicts = F.transform(F.filter("e", lambda x: ~x.key.isin(ids) & (held(x) != "") & (x.value != "") & (held(x) != x.value)), lambda x: log("conflict_keep_first", x.raw, x.key, x.value, held(x)))
    values = F.transform(F.filter("clean", lambda x: x.old != x.value), lambda x: log("normalize_value", x.key, x.key, x.old, x.value))
    none = F.array().cast("array<struct<action:string,old_key:string,new_key:string,old_value:string,new_value:string>>")
    from_year = F.when(F.col("derived").isNotNull(), F.array(log("derive_century_from_year", F.lit("year"), F.lit("century"), of("year"), F.col("derived")))).otherwise(none)
    set_id = F.when(F.col("doc_id") != F.col("old_id"), F.array(log("set_doc_id", F.lit(id_attribute), F.lit("doc_id"), F.col("old_id"), F.col("doc_id")))).otherwise(none)
    fixes = rows.select("doc_index", F.explode(F.concat(renamed, conflicts, values, from_year, set_id)).alias("x")).select("doc_index", "x.*")
    kept = F.filter(F.transform("clean", lambda x: F.struct(x.key.alias("key"), F.when(x.key == "century", F.coalesce(F.col("derived"), x.value)).otherwise(x.value).alias("value"))), lambda x: x.value != "")
    more = F.when(F.col("derived").isNotNull() & of("century").isNull(), F.array(F.struct(F.lit("century").alias("key"), F.col("derived").alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    return rows.select("doc_index", "doc_id", F.map_from_entries(F.array_sort(F.concat(kept, more))).alias("attrs")), fixes


def refuse(fixes: DataFrame, gate: DataFrame, on_alias: bool = False, on_coverage: bool = False) -> None:
    """Raise ValueError if keys were renamed (``on_alias``) or a key of the gate (key, coverage, least, ok) has too little coverage."""
    if on_alias and fixes.filter("action = 'rename_key'").limit(1).count():
        raise ValueError("keys had to be renamed")
    low = [f"{r.key}: {r.coverage:.3f} < {r.least:.3f}" for r in gate.filter("NOT ok").orderBy("key").collect()] if on_coverage else []
    if low:
        raise ValueError("too little coverage: " + ", ".join(low))


def apply_maps(rows: DataFrame, key_map: DataFrame, value_map: DataFrame, policy: str = "existing") -> DataFrame:
    """rows under reviewed maps: doc_id, key, value, conflict.

    key_map (original_key, canonical_key, action: keep, rename or drop; keep under another name renames) and
    value_map (key, old_value, new_value, action: keep or replace). Where a document then has several values of a
    key: abort raises, existing and incoming take the first or last, join takes all between bars. An action of
    another name raises.
    """
    how = {"abort": F.min_by("value", "pos"), "existing": F.min_by("value", "pos"), "incoming": F.max_by("value", "pos"), "join": F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x.value)), " | ")}
    if policy not in how:
        raise ValueError(f"unknown policy {policy}")
    ask = lambda known: F.when(F.col("action").isin(known), F.col("action")).otherwise(F.raise_error(F.concat(F.lit("invalid action "), F.coalesce("action", F.lit("null")))))
    keys = key_map.select(F.col("original_key").alias("key"), F.nullif(F.trim("canonical_key"), F.lit("")).alias("new_key"), ask(["keep", "rename", "drop"]).alias("how"))
    values = value_map.select("key", F.col("old_value").alias("value"), "new_value", ask(["keep", "replace"]).alias("how_value"))
    named = rows.join(keys, "key", "left").filter(F.coalesce("how", F.lit("keep")) != "drop").withColumn("key", F.coalesce("new_key", "key"))
    done = named.join(values, ["key", "value"], "left").withColumn("value", F.when(F.col("how_value") == "replace", F.col("new_value")).otherwise(F.col("value"))).filter(_filled())
    out = done.groupBy("doc_id", "key").agg(how[policy].alias("value"), (F.count_distinct("value") > 1).alias("conflict"))
    if policy == "abort":
        out = out.withColumn("value", F.when(F.col("conflict"), F.raise_error(F.concat(F.lit("conflicting values of "), "key"))).otherwise(F.col("value")))
    return out


def placed(table: DataFrame, order: str, width: int = 100_000) -> DataFrame:
    """table with place, its number from 0 in the order of an integer column; no window holds more than ``width`` values of it."""
    part = F.floor(F.col(order) / width)
    counts = table.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # a row for each part
    own = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return table.withColumn("_part", part).join(before, "_part").withColumn("place", own + F.col("_before")).drop("_part", "_before")


def aligned(docs: DataFrame, source: DataFrame, mode: str = "auto") -> DataFrame:
    """docs (pos, doc_id) with source_id and attrs of the source row (pos, doc_id, attrs) that each goes with.

    by-id takes the first source row of the same id; by-order the row at the same place, and asks for as many
    rows on both sides; auto is by-id if the documents' ids are unique and four fifths of them, at least one,
    are in the source, and else by-order.
    """
    if mode not in ("by-id", "by-order", "auto"):
        raise ValueError(f"unknown mode {mode}")
    first = source.filter("coalesce(doc_id, '') <> ''").groupBy("doc_id").agg(F.min_by("attrs", "pos").alias("attrs")).withColumn("source_id", F.col("doc_id"))
    by_id = docs.join(first, "doc_id", "left")
    n = by_id.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"), F.count("source_id").alias("hits")).first()
    if mode == "by-id" or (mode == "auto" and n["ids"] == n["n"] and n["hits"] and n["hits"] >= max(1, int(0.8 * n["n"]))):
        if not n["hits"]:
            raise ValueError("no id of the source is a document's")
        return by_id.select("pos", "doc_id", "source_id", "attrs")
    rows = source.count()
    if rows != n["n"]:
        raise ValueError(f"{n['n']} documents, but {rows} rows of metadata")
    own = placed(source, "pos").select("place", F.col("doc_id").alias("source_id"), "attrs")
    return placed(docs, "pos").join(own, "place").select("pos", "doc_id", "source_id", "attrs")


def output_ids(rows: DataFrame, mode: str = "auto", prefix: str = "doc") -> DataFrame:
    """aligned rows with out_id: the document's own id (keep), the source's, or one by order; later ones of equal ids get a number.

    auto takes the source's ids where the documents' repeat, are almost all the same, or name no document.
    """
    if mode == "auto":
        n = rows.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"), F.coalesce(F.bool_or(F.lower("doc_id").isin(GENERIC_IDS)), F.lit(False)).alias("generic")).first()
        mode = "source" if n["ids"] < n["n"] or n["ids"] <= max(1, n["n"] // 100) or n["generic"] else "keep"
    by_order = F.concat(F.lit(f"{prefix}-"), tx.padded(F.col("place") + 1, 6))
    own = {"keep": F.coalesce(F.nullif("doc_id", F.lit("")), F.nullif("source_id", F.lit("")), by_order), "source": F.coalesce(F.nullif("source_id", F.lit("")), by_order), "order": by_order}[mode]
    named = placed(rows, "pos").withColumn("_id", tx.safe_id(own))
    i = F.row_number().over(Window.partitionBy("_id").orderBy("pos"))
    return named.withColumn("out_id", F.when(i == 1, F.col("_id")).otherwise(F.concat(F.col("_id"), F.lit("__"), tx.padded(i, 4)))).drop("_id", "place")


def restored(sents: DataFrame, attrs: DataFrame) -> DataFrame:
    """Sentences of CoNLL-U (file, doc_no, at, opens, comments, ...) whose documents begin with the metadata of attrs (file, doc_no, out_id, attrs).

    Rows of tokens are never touched; comments of structure, sent_id and text stay, others go. Only the first block of
    each document is joined with attrs.
    """
    key = lambda c: F.lower(F.regexp_replace(F.trim(F.regexp_extract(c, "^#([^=]*)", 1)), r"\s+", "_"))
    stay = F.filter("comments", lambda c: key(c).isin("sent_id", "text", "newpar", "newpar_id", "par_id"))
    lines = F.transform(F.map_entries(F.map_filter("attrs", lambda k, v: (F.trim(v) != "") & ~k.isin("doc_id", "id"))), lambda e: F.concat(F.lit("# "), tx.comment_safe(e.key), F.lit(" = "), tx.comment_safe(e.value)))
    head = F.concat(F.array(F.concat(F.lit("# newdoc id = "), F.col("out_id"))), F.coalesce(lines, F.array().cast("array<string>")))
    first = sents.filter("opens").join(attrs.select("file", "doc_no", "out_id", "attrs"), ["file", "doc_no"], "left").withColumn("comments", F.concat(head, stay))
    return first.select(*sents.columns).unionByName(sents.filter("NOT opens").withColumn("comments", stay))


def wide(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each document: its id, then preferred keys, then others in order; the first value of each."""
    order = [k for k in PREFERRED[1:] if k in keys] + sorted(k for k in keys if k not in PREFERRED)
    return rows.groupBy("doc_id").pivot("key", order).agg(F.coalesce(F.min_by("value", "pos"), F.lit(""))).fillna("", order)


def classified(comments: DataFrame) -> DataFrame:
    """comments (comment, ...) with kind: newdoc, par, sent, text, bundle, metadata or plain."""
    key = tx.normalize_key(F.regexp_extract("comment", "^#([^=]*)", 1))
    kind = F.when(key.isin("newdoc", "newdoc_id"), "newdoc").when(key.isin("newpar", "newpar_id", "par", "par_id", "paragraph_id"), "par").when(key == "sent_id", "sent").when(key == "text", "text").when(key.isin("doc_meta", "meta", "metadata"), "bundle").when(F.contains("comment", F.lit("=")), "metadata").otherwise("plain")
    return comments.withColumn("kind", kind)
