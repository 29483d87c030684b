"""Personal data: fixed forms, and more by bootstrapped contextual patterns, in DataFrame functions only.

Matches are rows of their own (digest of the text, kind, number, length of the gap before), so time and memory
grow with the matches of a text and not with their square; equal texts count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .scratch import Scratch, unused

KINDS = ["email", "ip", "card", "phone"]
_LOCAL, _LABEL, _TOKEN = "A-Za-z0-9._%+-", "A-Za-z0-9-", "A-Za-z0-9._%+@=/#-"
#: Each finds the leftmost matches of the plain form, in linear time and without deep recursion: a match can
#: only begin where its first run of characters does, and repeated groups are runs of single characters.
#: A candidate token is a run of characters with a digit or one of @ _ #.
FORMS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_LABEL}]++(?:(?!\.(?![{_LABEL}]))[{_LABEL}.])++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:(?![\x20-](?![0-9]))[0-9\x20-])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "token": rf"(?<![{_TOKEN}])[A-Za-z.%+=/-]*+[0-9@_#][{_TOKEN}]*+",
}
#: What a text must contain for a form to be tried.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]", "token": "[0-9@_#]"}
#: Code points before and after a token in which its context is looked for.
BEFORE, AFTER = 60, 40
#: Rounds of bootstrapping; distinct known instances that a pattern needs; confidence from which a pattern counts
#: at all, and from which an instance is believed.
ROUNDS, SUPPORT, USEFUL, CONFIDENCE = 3, 5, 0.3, 0.9


def _matches(docs: DataFrame, key: str) -> DataFrame:
    """key, k (from 1, tokens last), no, gap (code points since the match before it), t, and a token's surroundings."""
    cut, parts = {}, []
    for k, (kind, form) in enumerate(FORMS.items(), 1):
        there, none = F.col("text").rlike(NEEDS[kind]), F.array().cast("array<string>")
        hits, gaps = f"_{kind}_hits", f"_{kind}_gaps"
        cut |= {hits: F.when(there, F.regexp_extract_all("text", F.lit(form), F.lit(0))).otherwise(none), gaps: F.when(there, F.split("text", form, -1)).otherwise(none)}
        around = f"right(x.{gaps}, {BEFORE}) AS before, left(x.`2`, {AFTER}) AS after" if kind == "token" else "string(NULL) AS before, string(NULL) AS after"
        parts.append(f"transform(arrays_zip({hits}, {gaps}, slice({gaps}, 2, greatest(size({gaps}), 1))), (x, i) -> struct({k} AS k, i AS no, char_length(x.{gaps}) AS gap, x.{hits} AS t, {around}))")
    rows = docs.select(F.col(key).alias("key"), "text").withColumns(cut)
    return rows.select("key", F.explode(F.expr(f"concat({', '.join(parts)})")).alias("x")).select("key", "x.*").filter("t IS NOT NULL")


def _valid() -> Column:
    """Whether a match of a fixed form has the numbers that its kind asks for."""
    digits = "regexp_replace(t, '[^0-9]', '')"
    luhn = """aggregate(sequence(1, length(d)), 0L, (a, i) -> a + CASE WHEN i % 2 = 1 THEN int(substr(d, length(d) + 1 - i, 1))
        ELSE 2 * int(substr(d, length(d) + 1 - i, 1)) DIV 10 + 2 * int(substr(d, length(d) + 1 - i, 1)) % 10 END) % 10 = 0"""
    return F.expr(f"""CASE k WHEN 1 THEN true
        WHEN 2 THEN forall(split(t, '[.]'), p -> length(ltrim('0', p)) <= 3 AND int(right(concat('000', p), 3)) <= 255)
        WHEN 3 THEN length({digits}) BETWEEN 13 AND 19 AND exists(array({digits}), d -> {luhn})
        WHEN 4 THEN length({digits}) BETWEEN 9 AND 15 ELSE false END""")


def placed(docs: DataFrame, key: str) -> DataFrame:
    """key, k, t, s, e, before, after: valid matches of the fixed forms and candidate tokens, once for equal texts."""
    each = _matches(docs, key).dropDuplicates(["key", "k", "no"])
    end = F.sum(F.col("gap") + F.char_length("t")).over(Window.partitionBy("key", "k").orderBy("no").rowsBetween(Window.unboundedPreceding, 0))
    trimmed = F.when(F.col("k") > len(KINDS), F.regexp_replace("t", r"[._=/-]+$", "")).otherwise(F.col("t"))
    each = each.withColumn("s", (end - F.char_length("t")).cast("int")).withColumn("t", trimmed).withColumn("e", (F.col("s") + F.char_length("t")).cast("int"))
    return each.filter(_valid() | ((F.col("k") > len(KINDS)) & (F.col("t") != ""))).drop("no", "gap")


def _known(rows: DataFrame) -> DataFrame:
    """Tokens with the kind of a fixed match that they overlap, or null: one sweep over the matches of each text."""
    token = F.col("k") > len(KINDS)
    sweep = Window.partitionBy("key").orderBy(F.when(token, F.col("e")).otherwise(F.col("s")), F.when(token, 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, 0)
    reach = [F.max(F.when(F.col("k") == k, F.col("e"))).over(sweep) for k in range(1, len(KINDS) + 1)]
    known = F.coalesce(*(F.when(r > F.col("s"), F.lit(k)) for k, r in enumerate(reach, 1)))
    return rows.withColumn("known", known).filter(token)


def _patterns(tokens: DataFrame) -> DataFrame:
    """key, s, e, t, known and pattern: a token's shape, and the words before it, after it and on both sides with its coarse shape."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("t", "[A-Z]+", "A"), "[a-z]+", "a"), "[0-9]", "9")
    coarse = F.regexp_replace(shape, "9+", "9")
    word = lambda c, form: F.nullif(F.lower(F.regexp_extract(c, form, 1)), F.lit(""))
    last, two, following = word("before", r"(\S+)\s*$"), word("before", r"(\S+\s+\S+)\s*$"), word("after", r"^[^\s\p{L}]*\s*(\p{L}+)")
    names = {"shape": shape, "after": F.concat(last, F.lit("|"), coarse), "after2": two, "before": F.concat(following, F.lit("|"), coarse), "between": F.concat(last, F.lit("|"), following)}
    return tokens.select("key", "s", "e", "t", "known", F.explode(F.array(*(F.concat(F.lit(f"{n} "), v) for n, v in names.items()))).alias("pattern")).filter("pattern IS NOT NULL")


def discover(rows: DataFrame, scratch: Scratch, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """key, k, s, e that the fixed forms miss; rows are as from ``placed``.

    Patterns and distinct token texts, the instances, are the two sides of a graph. Instances that overlap a
    fixed match are the seeds. Each round scores every pattern by the share of its instances that are known as
    one kind, and every unknown instance by its best contextual pattern and its shape together: it is wrong if
    both are. Instances of enough confidence are known in the next round. A token is found if its text is
    known and a pattern of its own place counts for that kind.
    """
    found = scratch.save(_patterns(_known(rows)), "tokens")
    edges = scratch.save(found.groupBy("pattern", "t").agg(F.min("known").alias("seed")), "edges")
    known = scratch.save(edges.filter("seed IS NOT NULL").groupBy("t").agg(F.min("seed").alias("k")), "known")
    kinds = range(1, len(KINDS) + 1)
    for _ in range(rounds):
        counts = edges.join(known, "t", "left").groupBy("pattern").agg(F.count("*").alias("n"), *(F.count_if(F.col("k") == k).alias(f"n{k}") for k in kinds))
        best = F.greatest(*(F.struct(F.col(f"n{k}").alias("n"), F.lit(k).alias("k")) for k in kinds))
        useful = counts.withColumn("best", best).filter((F.col("best.n") >= support) & (F.col("best.n") >= USEFUL * F.col("n")))
        useful = scratch.save(useful.select("pattern", F.col("best.k").alias("k"), (F.col("best.n") / (F.col("n") + 1)).alias("c")), "useful")
        form = F.col("pattern").startswith("shape ")
        scored = edges.join(known, "t", "left_anti").join(useful, "pattern").groupBy("t", "k").agg((1 - (1 - F.coalesce(F.max(F.when(form, F.col("c"))), F.lit(0.0))) * (1 - F.coalesce(F.max(F.when(~form, F.col("c"))), F.lit(0.0)))).alias("c"))
        new = scored.filter(F.col("c") >= confidence).groupBy("t").agg(F.max_by("k", F.struct("c", -F.col("k"))).alias("k"))
        known = scratch.save(known.union(new), "known")
    return found.filter("known IS NULL").join(known, "t").join(useful.drop("c"), ["pattern", "k"]).select("key", "k", "s", "e").distinct()


def find_personal_data(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """docs (doc_id, text, ...) with base and spans, arrays of (k, kind, s, e, reach) in order of k, the kind's number, and s.

    Offsets are code points, the end exclusive; ``reach`` is how far earlier spans of the text go. Null texts
    are empty. Base spans stay; a discovered one overlaps none of them. Repeated rows have the same spans each;
    null doc_ids don't matter, as spans belong to texts. Extra columns are carried along, whatever their names,
    but base and spans, which are replaced.
    """
    own = scratch or Scratch(docs.sparkSession, "personal")
    key, more = unused(docs, "text_key"), unused(docs, "text_spans")
    named = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn(key, F.unhex(F.md5("text")))
    rows = own.save(placed(named, key), "placed")
    every = rows.filter(F.col("k") <= len(KINDS)).select("key", "k", "s", "e", F.lit(True).alias("fixed")).union(discover(rows, own).withColumn("fixed", F.lit(False)))
    reach = F.coalesce(F.max("e").over(Window.partitionBy("key").orderBy("s", "e", "k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("k"))
    spans = every.withColumn("reach", reach).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("k", kind.alias("kind"), "s", "e", "reach", "fixed"))).alias(more)).withColumnRenamed("key", key)
    out = named.drop("base", "spans").join(own.keep(spans), key, "left")
    plain = lambda x: F.struct(x.k.alias("k"), x.kind.alias("kind"), x.s.alias("s"), x.e.alias("e"), x.reach.alias("reach"))
    every = F.coalesce(F.col(more), F.array().cast("array<struct<k:int,kind:string,s:int,e:int,reach:int,fixed:boolean>>"))
    return out.withColumns({"base": F.transform(F.filter(every, lambda x: x.fixed), plain), "spans": F.transform(every, plain)}).drop(key, more)


def masked(text: str = "text", spans: str = "spans", block: int = 1000) -> Column:
    """The text with each of its spans, or run of overlapping ones, replaced by its first kind in brackets.

    Pieces are cut from blocks of the text, so that none is sought from the text's beginning.
    """
    piece = f"substring(array_join(slice(b, x.lo DIV {block} + 1, (x.hi - 1) DIV {block} - x.lo DIV {block} + 1), ''), x.lo % {block} + 1, x.hi - x.lo)"
    cuts = f"transform(array_sort(transform({spans}, x -> struct(x.s, x.reach, x.kind))), x -> struct(x.reach AS lo, x.s AS hi, x.kind AS kind))"
    tail = f"struct(array_max(transform({spans}, x -> x.e)) AS lo, char_length({text}) AS hi, string(NULL) AS kind)"
    pieces = f"transform(concat({cuts}, array({tail})), x -> CASE WHEN x.hi < x.lo THEN '' ELSE concat(CASE WHEN x.hi > x.lo THEN {piece} ELSE '' END, coalesce(concat('[', upper(x.kind), ']'), '')) END)"
    whole = f"array_join(flatten(transform(array(regexp_extract_all({text}, '(?s).{{1,{block}}}', 0)), b -> {pieces})), '')"
    return F.expr(f"CASE WHEN size({spans}) = 0 THEN {text} ELSE {whole} END")


def listed(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(F.col(spans), lambda x: F.concat_ws(":", x.kind, x.s, x.e)), ",")
