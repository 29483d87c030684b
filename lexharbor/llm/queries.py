"""Registered queries over the operators, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import collocations, conversations, decontaminate, licenses, near_dedup, packing, pii, sharding, suffix_dedup, tiff, topk, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=4, percent=80)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    known = _table(spark, sf_dir, "labels").filter(~toxicity.held_out("doc_id"))
    return toxicity.score_toxicity(docs, known).select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted", F.size("passages").cast("long").alias("n_passages"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.sha2(text, 256).alias("group"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return sharding.histogram_shard(rows, 8).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), 100).drop("removed")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.filter("base", lambda x: x.k == 1)), F.size(F.filter("base", lambda x: x.k == 2)), F.size(F.filter("base", lambda x: x.k == 3)), F.size(F.filter("base", lambda x: x.k == 4))]
    return found.select("doc_id", *(c.cast("long").alias(f"n_{kind}") for kind, c in zip(pii.KINDS, counts, strict=True)), F.sha2(pii.listed("base"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = _table(spark, sf_dir, "documents").select("doc_id", "source", F.octet_length(text).alias("units"), F.xxhash64(text).alias("cluster"))
    return packing.pack(rows)


def op9_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.media_digest(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op11_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), every=50, k=5, scale=256)


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(_table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_url_filter, op3_toxicity, op4_sharding, op5_suffix_dedup, op6_personal_data, op7_license_scan, op8_best_fit_packing, op9_tiff_media, op10_decontamination, op11_bit_sliced_top_k, op12_phrase_collocations, op13_conversation_repair)}

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op2_url_filter": r"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(verdict, host_part, path_part) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
f AS (SELECT p.page_id, p.host, p.path, r.host_part || r.path_part AS rule, r.verdict,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host_part || r.path_part) DESC NULLS LAST) AS n
  FROM p LEFT JOIN r ON (p.host = r.host_part OR ends_with(p.host, '.' || r.host_part)) AND starts_with(p.path, r.path_part))
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN verdict
  WHEN regexp_matches(host || path, '^[^/]*ads-track\.') OR starts_with(host || path, 'ads.') OR regexp_matches(host || path, '/login[^/]\.php$') OR ends_with(host || path, '.exe') THEN 'block'
  ELSE 'allow' END AS verdict FROM f WHERE n = 1""",
    "op12_phrase_collocations": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
g AS (SELECT lang, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM w, range(1, 6) r(m) WHERE len(w) >= m),
f AS (SELECT lang, m, w[i : i + m - 1] AS p, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT f.lang, f.m, f.p, f.f AS a, n.n, unnest(range(1, f.m)) AS k FROM f JOIN n USING (lang) WHERE f.m > 1),
s AS (SELECT c.*, l.f AS l, r.f AS r, ((1000::HUGEINT * c.a * c.n) // (l.f::HUGEINT * r.f))::BIGINT AS score FROM c JOIN f l ON l.lang = c.lang AND l.p = c.p[1 : c.k] JOIN f r ON r.lang = c.lang AND r.p = c.p[c.k + 1 : c.m]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
d AS (SELECT lang, f, p[1 : m - 1] AS p FROM f WHERE m > 2 UNION SELECT lang, f, p[2 : m] FROM f WHERE m > 2),
o AS (SELECT b.lang, array_to_string(b.p, ' ') AS phrase, b.a, b.l, b.r, b.n, b.score FROM b WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.lang = b.lang AND d.p = b.p AND d.f >= b.a))
SELECT lang, rank::INT AS rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM o) WHERE rank <= 2000""",
    "op11_bit_sliced_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op10_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT item_id, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s, w FROM b WHERE len(w) > 0),
v AS (SELECT DISTINCT item_id, k, array_to_string(w[s : s + k - 1], ' ') AS t FROM i),
g AS (SELECT DISTINCT k FROM v),
o AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS s, w FROM d, g WHERE len(w) >= k),
h AS (SELECT o.doc_id, o.s, o.k, v.item_id FROM o JOIN v ON v.k = o.k AND v.t = array_to_string(o.w[o.s : o.s + o.k - 1], ' ')),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM h) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n, string_agg(t, ',' ORDER BY t) AS ids FROM (SELECT DISTINCT doc_id, cast(item_id AS VARCHAR) AS t FROM h) GROUP BY 1)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(n.n, 0) AS n_items, sha256(coalesce(n.ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op1_minhash_near_dedup": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, array_to_string(w[i : i + least(len(w), 4) - 1], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0) GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS root, doc_id AS node FROM d UNION SELECT r.root, l.v FROM r JOIN l ON l.u = r.node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, m.c = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT root, min(node) AS c FROM r GROUP BY 1) m ON m.root = d.doc_id""",
}


def _canonical_sql(text: str) -> str:
    out = f"regexp_replace(lower(coalesce({text}, '')), '{licenses.COPYRIGHT}', '', 'g')"
    out = rf"' ' || trim(regexp_replace({out}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' '"
    for old, new in licenses.SPELLINGS:
        out = f"replace({out}, ' {old} ', ' {new} ')"
    return f"trim({out})"


_KNOWN = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in licenses.KNOWN)
ORACLE["op7_license_scan"] = f"""
WITH k AS (SELECT min(n) AS license, c, min(len(string_split(c, ' '))) AS n FROM (SELECT n, {_canonical_sql("t")} AS c FROM (VALUES {_KNOWN}) v(n, t)) GROUP BY 2),
d AS (SELECT doc_id, {_canonical_sql("text")} AS c FROM documents),
n AS (SELECT doc_id, string_agg(license, ',' ORDER BY license) AS notices, count(*) AS n_notices FROM (SELECT DISTINCT d.doc_id, k.license FROM d JOIN k ON k.n >= {licenses.HEAD} AND contains(' ' || d.c || ' ', ' ' || k.c || ' ')) GROUP BY 1)
SELECT d.doc_id, sha256(d.c) AS digest, k.license, coalesce(n.notices, '') AS notices, coalesce(n.n_notices, 0) AS n_notices
FROM d LEFT JOIN k ON k.c = d.c LEFT JOIN n ON n.doc_id = d.doc_id"""


def _cheapest(*tops: str) -> str:
    return f"list_min([{', '.join(tops)}])"


def _edit(top: str, cost: str, edit: str, line: str = "''") -> str:
    """A top after an edit: cost, audit and the repaired lines so far (a top that nothing leads to costs 1e9)."""
    return f"{{'c': {top}.c + {cost}, 'w': {top}.w || '{edit}', 't': {top}.t || {line}}}"


_NOTHING = "{'c': 1000000000, 'w': '', 't': ''}"
_IN_U = _cheapest("u", *(_edit(t, "2", "I", "chr(10) || 'user:'") for t in "esa"))
_IN_A = _cheapest("a", _edit("v", "2", "I", "chr(10) || 'assistant:'"))
_KEPT = "chr(10) || role || ':' || text"
_GONE = "CASE WHEN f IN (1, 2) THEN 1000000000 ELSE (f = 3)::INT END"


def _into(own: str, before: str, initial: str, name: str) -> str:
    """The best top ``own`` after a turn: it goes, is kept behind one of ``before``, or takes another role."""
    keep = [_edit(t, f"CASE WHEN left(role, 1) = '{initial}' THEN {_GONE} ELSE 1000000000 END", "K", _KEPT) for t in before]
    return _cheapest(_edit(own, "3", "D"), *keep, *(_edit(t, f"2 + {_GONE}", "R", f"chr(10) || '{name}:' || text") for t in before if name))


ORACLE["op13_conversation_repair"] = rf"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
h AS (SELECT *, list_reduce([4294967295::UBIGINT] || list_transform(range(1, len(k) + 1), lambda i: ascii(k[i])::UBIGINT), lambda c, b: list_reduce([xor(c, b)] || [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))) AS z FROM o),
d AS (SELECT conv_id, turn, CASE WHEN m = 4 THEN 'user' ELSE role END AS role, CASE m WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN m = 3 THEN 2 ELSE 1 END)) AS copy
  FROM (SELECT *, xor(z, 4294967295::UBIGINT) % 20 AS m FROM h) WHERE m <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS p FROM (SELECT *, row_number() OVER w AS i FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))),
r AS (SELECT conv_id, turn, role, text, i, p, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 1 WHEN seen > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 3 ELSE 0 END AS f FROM n),
g AS (SELECT DISTINCT conv_id, 1::BIGINT AS i, {{'c': 0, 'w': '', 't': ''}} AS e, {_NOTHING} AS s, {_NOTHING} AS u, {_NOTHING} AS a FROM conversations
  UNION ALL SELECT conv_id, i + 1, {_edit("e", "3", "D")}, {_into("s", "e", "s", "")}, {_into("v", "esx", "u", "user")}, {_into("x", "v", "a", "assistant")}
  FROM (SELECT *, {_IN_A} AS x FROM (SELECT g.*, r.role, r.text, r.f, {_IN_U} AS v FROM g JOIN r ON r.conv_id IS NOT DISTINCT FROM g.conv_id AND r.i = g.i))),
l AS (SELECT conv_id, {_cheapest("e", "x")} AS b FROM (SELECT *, {_IN_A} AS x FROM (SELECT *, {_IN_U} AS v FROM (SELECT * FROM g QUALIFY i = max(i) OVER (PARTITION BY conv_id))))),
t AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(f = 1) AS blank, count_if(f = 2) AS duplicate, count_if(f = 3) AS truncated, count_if(p || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY 1)
SELECT l.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  b.c::BIGINT AS cost, b.w AS audit, sha256(substr(b.t, 2)) AS repaired_sha256 FROM l LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM l.conv_id"""
