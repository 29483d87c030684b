"""Operators against brute force on small tables with nulls, empty, long and repeated rows."""

import hashlib
import math
import random
import re
import struct
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexharbor.llm import decontaminate, licenses, near_dedup, packing, pii, queries, sharding, suffix_dedup, tiff, toxicity, url_filter

random.seed(5)
VOCAB = [f"{a}{b}" for a in ("lo", "Mi", "ré", "su") for b in ("na", "pe", "tor", "x1")]
TEXTS = [" ".join(random.choices(VOCAB, k=k)) for k in (1, 2, 3, 4, 30, 60, 90, 300)]
ROWS = [(1, None), (2, ""), (3, " \t\n")] + [(10 + i, t) for i, t in enumerate(TEXTS)]
ROWS += [(30 + i, t) for i, t in enumerate(TEXTS[3:])]
ROWS += [(50 + i, t[:len(t) // 2] + " extra" + t[len(t) // 2:]) for i, t in enumerate(TEXTS[4:])]
ROWS += [(70, "long " * 30_000), (71, "x" * 100_000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", 7) for i, t in ROWS], "doc_id long, text string, lang string, kept int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def shingles(text, k=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_near_duplicates(docs, empty):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, 4).collect()}
    sets = {i: shingles(t) for i, t in ROWS}
    group = {i: i for i in sets}
    for _ in ROWS:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    assert got == {i: (len(sets[i]), group[i], group[i] == i) for i in sets}
    assert near_dedup.near_duplicates(empty).count() == 0


def test_families_of_different_similarity(spark):
    """Many texts of one family, of which only some pairs are similar: chains, pairs by a shared addition, and loners."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for n in range(90):
        words = list(base)
        for _ in range(n % 9):
            words[rng.randrange(120)] = f"{rng.choice('xy')}{rng.randrange(3 + n)}"
        if n % 5 == 0:
            words[40:40] = [f"added{n // 10}-{j}" for j in range(25)]
        rows.append((n, " ".join(words)))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    sets, group = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in rows:
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    assert len(set(group.values())) > 10 and len(links) > 100
    assert got == group


def test_url_filter(spark):
    urls = [None, "", "nothing", "http://WWW.Example.COM/en/7x?q", "https://a.com/en/#x", "http://x.example.net/de/8", "http://net/de/", "http://b.org/es/a", "http://b.orgx/es/", "http://z.org/a.com/en/", "ftp://ads.q/", "http://h/login1php", "http://h/login1.php", "http://" + "h" * 3000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host[:20], r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages).collect()}
    assert [got[i][2:] for i in range(len(urls))] == [(None, "allow")] * 3 + [("example.com/en/7", "allow"), ("com/en/", "block"), ("example.net/de/8", "block"), ("net/de/", "allow"), ("org/es/", "block"), (None, "allow"), (None, "allow"), (None, "block"), (None, "allow"), (None, "block"), (None, "allow")]
    assert got[3][:2] == ("www.example.com", "/en/7x")


def test_automaton_against_patterns():
    globs = ["a*b", "**a?", "a**", "*", "b*a*b"]
    form = [re.compile(g.replace("**", "\0").replace("*", "[^/]*").replace("?", "[^/]").replace("\0", ".*") + r"\Z", re.S) for g in globs] * 20
    texts = ["".join(random.choices("ab/", k=random.randrange(9))) for _ in range(400)]
    automaton = url_filter.Automaton([url_filter._glob(g) for g in globs * 20])
    hit = sorted((int(t), int(p)) for rows, found in automaton.run([t.encode() for t in texts]) for t, p in zip(rows, found, strict=True))
    assert hit == [(i, k) for i, t in enumerate(texts) for k, f in enumerate(form) if f.match(t)]
    assert [min([k for k, f in enumerate(form) if f.match(t)], default=len(form)) for t in texts] == automaton.first([t.encode() for t in texts]).tolist()


def test_toxic_segments(spark):
    for _ in range(300):
        s = [random.uniform(-2, 3) * random.choice([1, -1]) for _ in range(random.randrange(14))]

        def maximal(lo, hi):  # the best stretch, then what lies left and right of it
            best = max(((sum(s[i:j]), i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0,))
            return [] if best[0] <= 0 else [*maximal(lo, best[1]), best[1:], *maximal(best[2], hi)]

        assert [x[:2] for x in toxicity.segments(s)] == maximal(0, len(s))


def test_toxicity_fit(spark, empty):
    """Log-odds against the formula in plain Python; scores of held-out documents rank them and rarely tie."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    known = labels.filter(~toxicity.held_out("doc_id"))
    texts = sorted({(r.text, r.toxic) for r in docs.join(known, "doc_id").collect()})
    sets = [(set(decontaminate.WORD.findall(decontaminate.normal(t.encode()))), y) for t, y in texts]
    n = [sum(y == k for _, y in sets) for k in (0, 1)]
    want = {}
    for w in {w for s, _ in sets for w in s}:
        e = [sum(w in s for s, y in sets if y == k) for k in (0, 1)]
        if sum(e) < toxicity.ATTESTED:
            continue
        prior = toxicity.PRIOR * sum(e) / sum(n)
        odds = math.log((e[1] + prior) / (n[1] + toxicity.PRIOR + 1 - e[1] - prior)) - math.log((e[0] + prior) / (n[0] + toxicity.PRIOR + 1 - e[0] - prior))
        gain = 2 * sum(x * math.log(x * sum(n) / sum(e) / m) for x, m in zip(e, n, strict=True) if x)
        want[w] = odds * max(0.0, 1 - toxicity.SHRINK**2 / max(gain, 1e-9)), odds
    got = toxicity.fit(docs, known).weights[2]
    assert len(want) > 100 and all(abs(got[w][k] - x[k]) < 1e-5 for w, x in want.items() for k in (0, 1))
    more = "/root/testdata/sf0.1"
    rows = queries.op3_toxicity(spark, more).join(spark.read.parquet(f"{more}/labels.parquet"), "doc_id").filter("held_out").collect()
    pairs = [(a.score > b.score) + 0.5 * (a.score == b.score) for a in rows for b in rows if a.toxic > b.toxic]
    assert sum(pairs) / len(pairs) > 0.95
    assert sum(r.predicted for r in rows if r.toxic) >= 0.9 * sum(r.toxic for r in rows) and sum(r.predicted for r in rows if not r.toxic) <= 0.01 * len(rows)
    every = toxicity.score_toxicity(docs.withColumn("score", F.lit("x")).select("*", F.lit(1).alias("passages")), known)
    assert every.count() == docs.count() and every.groupBy("score").count().agg(F.max("count")).first()[0] < 0.1 * docs.count()
    odd = spark.createDataFrame([(None, "you idiot"), (-1, None), (-2, ""), (-2, ""), (-3, "idiot " * 100_000)], "doc_id long, text string")
    got = toxicity.score_toxicity(odd.union(docs.select("doc_id", "text")), known).filter("doc_id IS NULL OR doc_id < 0").collect()
    assert sorted((r.doc_id or 0, r.predicted) for r in got) == [(-3, 1), (-2, 0), (-2, 0), (-1, 0), (0, 1)]
    assert toxicity.score_toxicity(empty, known).count() == 0
    assert {r.score for r in toxicity.score_toxicity(odd, known.limit(0)).collect()} == {0.0}


def test_varied_toxic_words(spark):
    """120 toxic words, each in 20 of 1,200 toxic texts: under 2%."""
    rng = random.Random(4)
    bad = [hashlib.md5(str(i).encode()).hexdigest()[:8] for i in range(120)]
    plain = [hashlib.md5(b"p%d" % i).hexdigest()[:8] for i in range(300)]
    rows = [(i, " ".join([*rng.choices(plain, k=15), *([bad[i % 120], bad[(i + 1) % 120]] if i < 1200 else []), *rng.choices(plain, k=15)]), int(i < 1200)) for i in range(2400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {(r.toxic, r.predicted): r["count"] for r in toxicity.score_toxicity(d, d).join(d, "doc_id").groupBy("toxic", "predicted").count().collect()}
    assert got.get((1, 1), 0) >= 1140 and got[0, 0] >= 1188


def test_class_mix_of_all_labels(spark, monkeypatch):
    """Half of the 200 toxic texts look like the 1,000 clean ones: 100 of 1,100 such texts are toxic, sampled or not."""
    rng = random.Random(6)
    plain = [hashlib.md5(b"q%d" % i).hexdigest()[:8] for i in range(300)]
    rows = [(i, " ".join([*rng.choices(plain, k=15), *(["vile", "nasty"] if i < 200 and i % 2 else []), *rng.choices(plain, k=15)]), int(i < 200)) for i in range(1200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    monkeypatch.setattr(toxicity, "SAMPLE", 150)
    m = toxicity.fit(d, d)
    assert 0.05 < np.mean([m.score(*m.judge(rng.choices(plain, k=30))[:2]) for _ in range(50)]) < 0.14


def test_sharding(spark, docs, empty):
    rows = docs.selectExpr("doc_id", "coalesce(text, '') AS group", "octet_length(coalesce(text, '')) + 1L AS size")
    rows = rows.union(rows).union(rows.filter("doc_id = 30").selectExpr("CAST(NULL AS bigint)", "group", "size"))
    got = sharding.histogram_shard(rows, 3).toPandas()
    assert len(got) == 2 * len(ROWS) + 1 and got["size"].sum() == rows.agg({"size": "sum"}).first()[0]
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    even = spark.range(3000).selectExpr("id AS doc_id", "CAST(IF(id % 3 = 0, 0, id) AS string) AS group", "100L AS size")
    assert max(abs(c - 375) for c in sharding.histogram_shard(even, 8).groupBy("shard").count().toPandas()["count"]) <= 1
    assert sharding.histogram_shard(empty.selectExpr("doc_id", "text AS group", "doc_id AS size"), 8).count() == 0


def test_remove_repeats(docs, empty):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect()}
    seen, want = set(), {}
    for i, t in sorted(ROWS):
        data = (t or "").encode()
        gone, end = bytearray(len(data)), 0
        for p in range(len(data) - 99):
            if data[p : p + 100] in seen:
                for q in range(max(p, end), p + 100):
                    gone[q] = 1
                end = p + 100
            seen.add(data[p : p + 100])
        kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        want[i] = (len(data), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    assert got == want
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_personal_data(spark, empty):
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    rows = [(1, None), (2, ""), (3, "a@b@c.d.e x@y..z 1.2.3.4.5.6.7.8 300.1.1.1 4111 1111-1111 1111 +1 (555) 123-4567"), (4, "1" * 30_000), (5, "a" * 99_999 + "@" + "b." * 9_999 + "c")]
    rows += [(i, "".join(random.choice("ab.@+-1 2345(é") for _ in range(200))) for i in range(10, 200)]

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    def spans(text):
        for kind, form in plain.items():
            for m in re.finditer(form, text):
                d = re.sub("[^0-9]", "", m[0])
                if kind == "email" or kind == "ip" and all(int(p) < 256 for p in m[0].split(".")) or kind == "card" and 13 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                    yield f"{kind}:{m.start()}:{m.end()}"

    got = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "text", "spans", pii.listed("base").alias("base"), pii.masked().alias("masked")).collect()
    assert {r.doc_id: r.base for r in got} == {i: ",".join(spans(t or "")) for i, t in rows}
    assert next(r.masked for r in got if r.doc_id == 3) == "a@[EMAIL] x@y..z [IP].[IP] 300.1.1.1 4111 1111-1111 1111 [PHONE]"
    for r in got:
        cut, at = "", 0
        for x in sorted(r.spans, key=lambda x: (x.s, x.e, x.k)):
            if x.s >= at:
                cut += f"{r.text[at : x.s]}[{x.kind.upper()}]"
            at = max(at, x.e)
        assert r.masked == cut + r.text[at:]
    assert pii.find_personal_data(empty).count() == 0


def test_personal_data_of_a_long_text(spark):
    """100,000 addresses in one text, with names of columns that the operator uses itself."""
    text = " ".join(f"u{i}@é{i}.example.com" for i in range(100_000))
    rows = spark.createDataFrame([(1, text.replace("é", "x"), "a", "b"), (None, "é " * 50_000 + "mail a@b.c", "a", "b")], "doc_id long, text string, text_key string, more string")
    got = pii.find_personal_data(rows).select("doc_id", "text_key", "more", F.size("base").alias("n"), F.element_at("base", -1).alias("last"), F.sha2(pii.masked(), 256).alias("m"))
    assert sorted((r.n, r.last.s, r.last.e, r.text_key, r.m) for r in got.collect()) == [(1, 100_005, 100_010, "a", hashlib.sha256(("é " * 50_000 + "mail [EMAIL]").encode()).hexdigest()), (100_000, len(text) - len("u99999@x99999.example.com"), len(text), "a", hashlib.sha256(" ".join(["[EMAIL]"] * 100_000).encode()).hexdigest())]


def test_discovered_identifiers(spark):
    """Numbers that a fixed form misses are found where the words around known ones stand, and not elsewhere."""
    rng = random.Random(8)
    plain = lambda n: " ".join(hashlib.md5(str(rng.random()).encode()).hexdigest()[:5].translate(str.maketrans("0123456789", "ghijklmnop")) for _ in range(n))
    rows = [(i, f"{plain(4)} reach support at agent{i}@corp{i % 7}.example.com anytime {plain(3)}") for i in range(60)]
    rows += [(100 + i, f"{plain(4)} the host address {rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)} responded {plain(3)}") for i in range(60)]
    rows += [(200, f"{plain(3)} reach support at agent_x9@corp anytime {plain(3)}"), (201, f"{plain(3)} the host address 10.1.2.300 responded {plain(2)}")]
    rows += [(300 + i, f"{plain(3)} item {i}_{i * 7}@lot {plain(3)}") for i in range(30)] + [(400 + i, f"{plain(2)} version {i}.1.2.300 of it {plain(3)}") for i in range(30)]
    got = {r.doc_id: [(x.kind, r.text[x.s : x.e]) for x in r.spans if x not in r.base] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: x for i, x in got.items() if x} == {200: [("email", "agent_x9@corp")], 201: [("ip", "10.1.2.300")]}


def test_licenses(spark, empty):
    mit = next(t for n, t in licenses.KNOWN if n == "MIT" and len(t) > 100)
    two, three = (next(t for n, t in licenses.KNOWN if n == f"BSD-{k}-Clause") for k in (2, 3))
    rows = [(1, None), (2, ""), (3, "Copyright 2020 Someone\n\n" + mit.upper().replace('"', "'")), (4, "text\nReleased under the MIT licence!\nLicensed under CC BY-NC 4.0.\n"), (4, "text\nReleased under the MIT licence!\nLicensed under CC BY-NC 4.0.\n")]
    rows += [(5, three), (6, "/* " + two.replace("\n\n", "\n").replace("\n", "\n * ") + " */\nint x;"), (7, "Some title\n(c) 2001 A\nCopyright (c) [year] B\n\n" + mit + "\n\nand more"), (8, mit[:-20]), (9, "Copyright holders 1999\nRedistribution and use in source")]
    rows += [(100 + width, "\n".join(textwrap.fill(p, width) for p in mit.split("\n\n"))) for width in range(40, 100)]
    got = {r.doc_id: (r.license, r.notices, r.n_notices) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("x"))).collect()}
    none = (None, "", 0)
    want = {1: none, 2: none, 3: ("MIT", "MIT", 1), 4: (None, "CC-BY-NC-4.0,MIT", 2), 5: ("BSD-3-Clause", "BSD-3-Clause", 1), 6: (None, "BSD-2-Clause", 1), 7: (None, "MIT", 1), 8: none, 9: none}
    assert got == want | {100 + width: ("MIT", "MIT", 1) for width in range(40, 100)}
    assert licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id = 4").count() == 2
    assert licenses.scan_licenses(empty).count() == 0


def test_licenses_of_any_wording(spark):
    """A caller's texts are found whatever their words are; one of two words only as an entire text."""
    own = [("BSD-like", "Redistribution and use in source and binary forms, with or without modification, are permitted."), ("PD", "This file is in the public domain."), ("Free", "Anyone is free to copy, modify\nand publish this software."), ("Short", "Public domain"), ("Other", "public   DOMAIN!")]
    rows = [(i, f"First line.\n\n// {t.upper()}\n\nlast") for i, (_, t) in enumerate(own[:4])] + [(7, "nothing\n\nof that"), (8, "(public domain)")]
    got = {r.doc_id: (r.license, r.notices, r.n_notices) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), licenses.known(spark, own)).collect()}
    assert got == {0: (None, "BSD-like", 1), 1: (None, "PD", 1), 2: (None, "Free", 1), 3: (None, "", 0), 7: (None, "", 0), 8: ("Other", "", 0)}
    assert licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), licenses.known(spark, own).limit(0)).filter("license IS NOT NULL OR n_notices > 0").count() == 0


def test_packing(spark, empty):
    rows = [(i, random.randrange(0, 250), random.choice("abc") if i % 7 else None, i % 20 if i % 5 else None) for i in range(300)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, units long, source string, cluster long"), capacity=100, per_source=2, block_rows=100).toPandas()
    assert got.groupby("doc_id")["units"].sum().to_dict() == {r[0]: r[1] for r in rows}
    src, own = {r[0]: r[2] for r in rows}, {r[0]: r[3] for r in rows}
    for _, g in got.groupby(["block", "bin"]):
        g = g.sort_values("start")
        assert (g["start"].to_numpy()[1:] == (g["start"] + g["units"]).to_numpy()[:-1]).all() and g["units"].sum() <= 100
        assert g["doc_id"].map(lambda i: src[i] or "-").value_counts().max() <= 2
        known = [own[i] for i in g["doc_id"] if own[i] is not None]
        assert len(known) == len(set(known))
    p = packing.Packer(10, 1)
    assert [p.put(6, "a", 1), p.put(7, "b", 2), p.put(3, "c", 2), p.put(3, "b", 3), p.put(3, "d", 4)] == [(0, 0), (1, 0), (0, 6), (2, 0), (1, 7)]
    assert packing.pack(empty.selectExpr("doc_id", "doc_id AS units", "text AS source", "text AS cluster")).count() == 0


@pytest.mark.parametrize("kind", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
def test_tiff_round_trip(kind):
    for data in (bytes(64), random.randbytes(64 * 700), b"ab" * 32 * 5000):
        for predictor in (1, 2) if kind in (tiff.LZW, tiff.DEFLATE) else (1,):
            for tiled in (False, True):
                assert b"".join(p[8] for p in tiff.pages(tiff.encode(data, kind, predictor, tiled))) == data


@pytest.mark.parametrize("kind", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
def test_tiff_for_other_readers(spark, kind):
    """Java's own reader gives the same pixels, page by page."""
    jvm = spark._jvm
    for data in (bytes(64), random.randbytes(64 * 700), (b"some text " * 40_000)[: 64 * 6000]):
        for predictor in (1, 2) if kind in (tiff.LZW, tiff.DEFLATE) else (1,):
            for tiled in (False, True):
                file = tiff.encode(data, kind, predictor, tiled)
                stream = jvm.javax.imageio.ImageIO.createImageInputStream(jvm.java.io.ByteArrayInputStream(file))
                reader = jvm.javax.imageio.ImageIO.getImageReaders(stream).next()
                reader.setInput(stream)
                got = []
                for n in range(reader.getNumImages(True)):
                    raster = reader.read(n).getRaster()
                    assert raster.getSampleModel().getSampleSize(0) == 8 and raster.getNumBands() == 1
                    got.append(bytes(raster.getDataBuffer().getData()))
                assert b"".join(got) == data


def test_tiff_planes_and_broken_files(spark):
    red, green, blue = (bytes((i * k) % 256 for i in range(6 * 4)) for k in (1, 7, 31))
    def file(order, planes):
        body = [red, green, blue] if planes else [bytes(x for p in zip(red, green, blue, strict=True) for x in p)]
        out, offsets = bytearray(struct.pack(f"{order}2sHI", b"II" if order == "<" else b"MM", 42, 0)), []
        for b in body:
            offsets.append(len(out))
            out += b
        fields = [(256, 3, [6]), (257, 3, [4]), (258, 3, [8, 8, 8]), (259, 3, [1]), (262, 3, [2]), (273, 4, offsets), (277, 3, [3]), (278, 3, [4]), (279, 4, [len(b) for b in body]), (284, 3, [1 + planes])]
        entries = b""
        for tag, t, v in fields:
            packed = struct.pack(f"{order}{len(v)}{'H' if t == 3 else 'I'}", *v)
            if len(packed) > 4:
                packed, where = struct.pack(f"{order}I", len(out)), packed
                out += where
            entries += struct.pack(f"{order}HHI", tag, t, len(v)) + packed.ljust(4, b"\0")
        struct.pack_into(f"{order}I", out, 4, len(out))
        return bytes(out + struct.pack(f"{order}H", len(fields)) + entries + bytes(4))
    good = tiff.encode(random.randbytes(64 * 5000), tiff.LZW, 2)
    huge = bytearray(good)
    at = struct.unpack_from("<I", good, 4)[0]
    struct.pack_into("<I", huge, at + 2 + 12 + 8, 2**31)
    rows = [(1, file("<", True)), (2, file(">", False)), (3, b""), (4, None), (5, b"II*\0\xff\xff\0\0"), (6, good[:70_000]), (7, bytes(huge)), (8, good), (9, good[:4] + bytes(4))]
    got = tiff.tiff_pages(spark.createDataFrame(rows, "doc_id long, media binary").withColumn("page", F.lit(1))).collect()
    pixels = bytes(x for p in zip(red, green, blue, strict=True) for x in p)
    assert [(r.doc_id, r.page, r.samples, bytes(r.pixels), r.error) for r in got if r.doc_id < 3] == [(1, 0, 3, pixels, None), (2, 0, 3, pixels, None)]
    assert sorted((r.doc_id, r.page, r.error is None) for r in got if r.doc_id > 2) == [(3, 0, False), (5, 0, False), (6, 0, False), (7, 0, False), (8, 0, True), (8, 1, True)]


def test_tiff_query(docs, empty):
    rows = {r.doc_id: r for r in tiff.media_digest(docs).collect()}
    for i, t in ROWS:
        data = (t or "").encode()
        data += bytes(64 if not data else -len(data) % 64)
        assert (rows[i].n_bytes, rows[i].payload_bytes, rows[i].payload_sha256, rows[i].tail_crc32) == (len((t or "").encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
    stored = tiff.text_to_tiff(docs)
    assert tiff.tiff_pages(stored).filter("doc_id = 71").count() == 1 and tiff.tiff_pages(stored.filter("doc_id = 1")).first().height == 1
    assert tiff.media_digest(empty).count() == 0


def test_decontamination(spark, empty):
    words = [f"w{i}" for i in range(30)]
    items = [(1, " ".join(words[:12])), (2, "Só curta"), (3, None), (4, ""), (10, " ".join(words[5:16])), (2, "Só curta")]
    rows = [(1, None), (2, ""), (3, "x, " + "; ".join(words[:11]).upper() + " y"), (4, "SÓ curta! só curta"), (5, "Só, curta"), (6, " ".join(words))]
    i, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.digest(decontaminate.scan(d, i)).collect()}
    assert got == {1: (0, 0, 0, False), 2: (0, 0, 0, False), 3: (13, 11, 1, True), 4: (4, 2, 1, True), 5: (2, 2, 1, True), 6: (30, 16, 2, True)}
    assert decontaminate.digest(decontaminate.scan(d, i)).filter("doc_id = 6").first().items_sha256 == hashlib.sha256(b"1,10").hexdigest()
    assert sorted(r.doc_id for r in decontaminate.clean(d, i).collect()) == [1, 2]
    assert decontaminate.scan(empty, i).count() == 0 and decontaminate.scan(d, i.limit(0)).count() == 6


def test_decontamination_in_parts(spark, monkeypatch):
    """Rows that repeat a doc_id, or have none, stay rows of their own, whatever the number of automata."""
    w = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(w[i : i + 12])) for i in range(0, 28, 3)] + [(99, " ".join(w[a : a + 3])) for a in range(0, 30, 2)]
    rows = [(1, " ".join(w)), (1, "none"), (1, " ".join(w[3:20])), (None, " ".join(w[:15])), (None, None), (None, "x y"), (2, " ".join(w[5:30])), (2, " ".join(w[5:30]))]
    i, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(rows, "doc_id long, text string")
    found = lambda: sorted(map(repr, decontaminate.scan(d, i).collect()))
    one = found()
    assert len(one) == len(rows)
    monkeypatch.setattr(decontaminate, "AUTOMATON_WORDS", 30)
    monkeypatch.setattr(decontaminate, "PIECE", 2)
    assert len(list(decontaminate._parts(i, 10))) > 3
    assert found() == one
    assert sorted((r.doc_id is None, r.text or "") for r in decontaminate.clean(d, i).collect()) == [(False, "none"), (True, ""), (True, "x y")]


def test_sharding_against_sums(spark):
    """Shards are ranges of the order, and each splitter is as near its share as tolerance or a single row allow; names of columns don't matter."""
    rng = random.Random(2)
    rows = [(rng.randrange(10**6), f"g{rng.choice([0, i % 90])}", rng.randrange(1, 400)) for i in range(900)] + [(5, None, 50), (5, None, 50), (None, "g0", 9)]
    table = spark.createDataFrame(rows, "doc_id long, group string, size long").withColumns({x: F.lit(x) for x in ("k1", "k2", "part", "place", "first", "before", "sort_hash", "shard")})
    got = sharding.histogram_shard(table, 7)
    assert got.columns == ["doc_id", "group", "size", "k1", "k2", "part", "place", "first", "before", "sort_hash", "shard", "slot"] or set(got.columns) == set(table.columns) | {"slot"}
    out = got.select(F.shiftrightunsigned(F.xxhash64("group"), 1).alias("h"), F.coalesce("doc_id", F.lit(0)).alias("d"), "size", "shard", "slot", "first", "place").collect()
    assert len(out) == len(rows) and {(r.first, r.place) for r in out} == {("first", "place")}
    out.sort(key=lambda r: (r.h, r.d, r.shard, r.slot))
    assert [r.shard for r in out] == sorted(r.shard for r in out)
    total, below, at = sum(r[2] for r in rows), {k: 0 for k in range(8)}, 0
    for r in out:
        for k in range(r.shard + 1, 8):
            below[k] += r.size
    assert all(abs(below[k] - total * k / 7) <= max(400 + 100, sharding.TOLERANCE * total / 7) for k in range(1, 7))
    for k in range(7):
        assert [r.slot for r in out if r.shard == k] == list(range(sum(r.shard == k for r in out)))


def naive_packing(entries, capacity, per_source):
    """For each entry the fullest bin that takes it, the first of equals, by a look at every bin."""
    bins, out = [], []
    for units, source, cluster in entries:
        fit = [(capacity - sum(u for u, _, _ in b), k) for k, b in enumerate(bins) if sum(u for u, _, _ in b) + units <= capacity and cluster not in {c for _, _, c in b} and sum(s == source for _, s, _ in b) < per_source and sum(u for u, _, _ in b) < capacity]
        k = min(fit)[1] if fit else len(bins)
        if not fit:
            bins.append([])
        out.append((k, sum(u for u, _, _ in bins[k])))
        bins[k].append((units, source, cluster))
    return out


def test_packing_against_every_bin(spark):
    rng = random.Random(3)
    for _ in range(60):
        entries = [(rng.randrange(0, 60), rng.choice("abc"), rng.randrange(12)) for _ in range(80)]
        p = packing.Packer(100, 2)
        assert [p.put(*e) for e in entries] == naive_packing(entries, 100, 2)
    nulls = spark.createDataFrame([(None, 5, "a", 1)] * 300 + [(None, None, None, None)] * 3 + [(1, 10**4, "s", 2)], "doc_id long, units long, source string, cluster long").withColumn("block", F.lit("x")).withColumn("bin", F.lit(1))
    got = packing.pack(nulls, capacity=100, block_rows=20).toPandas()
    assert len(got) == 303 + 100 and got[got["units"] == 5].groupby("block").size().max() < 100 and got["units"].sum() == 300 * 5 + 10**4


def test_near_duplicates_in_split_buckets(spark, monkeypatch):
    """The same links whatever the size of a bucket's cells."""
    rng, base = random.Random(12), [f"w{i}" for i in range(100)]
    rows = []
    for n in range(80):
        words = list(base)
        for _ in range(n % 9):
            words[rng.randrange(100)] = f"{rng.choice('xy')}{rng.randrange(3 + n)}"
        rows.append((n if n else None, " ".join(words)))
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("band", F.lit(1)).withColumn("rep", F.lit("x"))
    monkeypatch.setattr(near_dedup, "CELL", 3)
    sets = {i: shingles(t) for i, t in rows if i is not None}
    group, links = {i: i for i in sets}, [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in rows:
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(table, 4).collect()} == group | {None: None}


def test_previous_factors(spark, monkeypatch):
    """Removed bytes are those within reach of a long previous factor, by a plain suffix array; the same if anchors and tasks are cut."""
    rng = random.Random(9)
    part = ["".join(rng.choices("abc", k=k)) for k in (40, 60, 90, 130)]
    rows = [(i, "".join(rng.choice([rng.choice(part), "".join(rng.choices("xyz", k=30))]) for _ in range(8))) for i in range(60)] + [(7, "a" * 300), (8, "a" * 150)]
    rows = list({i: (i, t) for i, t in rows}.values())
    joined, owner = "".join(t + chr(0x4000 + i) for i, t in sorted(rows)), []
    for i, t in sorted(rows):
        owner += [(i, p) for p in range(len(t) + 1)]
    order = sorted(range(len(joined)), key=lambda p: joined[p : p + 400])
    lcp = lambda a, b: next((k for k, (x, y) in enumerate(zip(joined[a : a + 2000], joined[b : b + 2000])) if x != y), 0)  # noqa: E731, B905
    lpf = dict.fromkeys(order, 0)
    for line in (order, order[::-1]):  # previous, then next smaller positions
        stack = []
        for p in line:
            while stack and stack[-1] > p:
                stack.pop()
            if stack:
                lpf[p] = max(lpf[p], lcp(p, stack[-1]))
            stack.append(p)
    want = {i: set() for i, _ in rows}
    for p, n in lpf.items():
        if n >= 100:
            want[owner[p][0]] |= set(range(owner[p][1], owner[p][1] + n))
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)).repartition(5)
    got = lambda: {r.doc_id: {p for x in r.removed for p in range(x.start, x.end)} for r in suffix_dedup.remove_repeats(table).collect()}
    assert got() == want
    twice = suffix_dedup.remove_repeats(table.union(table).union(table.limit(1).withColumn("doc_id", F.lit(None).cast("long"))))
    assert twice.groupBy("doc_id").agg(F.max("n_removed"), F.min("n_removed"), F.count("*")).filter("doc_id IS NOT NULL").collect().__len__() == len(rows)
    assert {r.doc_id: r.n_removed for r in twice.filter("doc_id IS NOT NULL").collect()} == {i: len(x) for i, x in want.items()}
    monkeypatch.setattr(suffix_dedup, "HELD", 5)
    assert got() == want


@pytest.fixture(scope="module")
def small(tmp_path_factory, spark):
    """A folder of tables with nulls, repeated rows, long texts and extra columns, and one of empty tables."""
    root = tmp_path_factory.mktemp("tables")
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "s", 0), (None, "one text", "en", "s", 8), (90001, None, "de", None, None), (90002, "w " * 30_000, "en", "s", 60_000)], docs.schema)
    docs.union(odd).union(docs.limit(3)).withColumns({x: F.lit(1) for x in ("row", "base", "spans", "band", "score", "predicted", "block", "text_key")}).write.parquet(f"{root}/full/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{d}/{name}.parquet").write.parquet(f"{root}/full/{name}.parquet")
        spark.read.parquet(f"{d}/{name}.parquet").limit(0).write.parquet(f"{root}/none/{name}.parquet")
    docs.limit(0).write.parquet(f"{root}/none/documents.parquet")
    return root


def test_pipeline_stages(spark, small):
    """Each stage against a plain version of its own."""
    import corpus_pipeline

    d = f"{small}/full"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    plain = lambda df: sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in df.collect())
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = toxicity.fit(docs, spark.read.parquet(f"{d}/labels.parquet").filter(~toxicity.held_out("doc_id")))
    words = lambda t: decontaminate.WORD.findall(decontaminate.normal((t or "").encode()))
    got = stages["toxicity"](spark, docs, d)
    assert got.columns == corpus_pipeline.COLUMNS and plain(got) == sorted((i is None, i or 0, t or "") for i, t in rows if model.score(*model.judge(words(t))[:2]) < 0.5)
    sets = {i: shingles(t, 5) for i, t in rows if i is not None}
    group = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) * 100 >= 80 * len(sets[a] | sets[b])]
    for _ in range(20):
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    got = stages["near_duplicates"](spark, docs, d)
    assert got.columns == corpus_pipeline.COLUMNS and plain(got) == sorted((i is None, i or 0, t or "") for i, t in rows if i is None or group[i] == i)
    windows = set()
    for r in spark.read.parquet(f"{d}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} - {()}
    hit = lambda t: any(tuple(w[k : k + n]) in windows for w in [words(t)] for n in {len(x) for x in windows} for k in range(len(w) - n + 1))
    got = stages["decontamination"](spark, docs, d)
    assert got.columns == corpus_pipeline.COLUMNS and plain(got) == sorted((i is None, i or 0, t or "") for i, t in rows if not hit(t))
    got = stages["personal_data"](spark, docs, d).collect()
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    assert len(got) == len(rows) and not any(mail.search(r.text) for r in got) and all(r.n_chars == len(r.text) for r in got)
    assert sum(r.text.count("[EMAIL]") for r in got) >= sum(len(mail.findall(t or "")) for _, t in rows) > 0
    got = stages["packing"](spark, docs, d).toPandas()
    assert got["units"].sum() == sum(len((t or "").encode()) for _, t in rows) and got.groupby(["block", "bin"])["units"].sum().max() <= packing.CAPACITY


def test_pipeline(spark, small):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, f"{small}/full")
    assert out.columns == ["block", "doc_id", "piece", "bin", "start", "units"] and out.filter("doc_id IS NULL").count() >= 3
    assert {r.doc_id for r in out.collect()} <= {r.doc_id for r in spark.read.parquet(f"{small}/full/documents.parquet").collect()}
    assert corpus_pipeline.run(spark, f"{small}/none").count() == 0


def test_queries_of_odd_tables(spark, small):
    """Nulls, repeated rows and columns of any name give a row for each row; empty tables give none."""
    for name in ("op3_toxicity", "op4_sharding", "op6_personal_data", "op7_license_scan", "op9_tiff_media", "op10_decontamination"):
        assert queries.QUERIES[name](spark, f"{small}/full").count() == 208, name
        assert queries.QUERIES[name](spark, f"{small}/none").count() == 0, name
