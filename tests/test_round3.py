"""Similarity joins, density clusters, topic reduction, vectors of texts, resumable outputs and batches against plain versions."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexharbor.functions import text as tx
from lexharbor.operators import density, fuzzy, graph, lexicon, metadata, minibatch, numbering, reduction, segments, vectors
from lexharbor.sources import conllu, delimited, resumable


def ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return 200.0 * row[-1] / (len(a) + len(b))


@pytest.mark.parametrize("threshold", [70, 85, 92, 100])
def test_nearest_keys(spark, threshold):
    rng = random.Random(threshold)
    base = ["".join(rng.choices("abčé", k=rng.randrange(1, 24))) for _ in range(60)]
    keys = base + ["" , None, "aaaa", "aaaaa"]
    words = [None, "", "abab", *base[:5]]
    for w in base * 3:
        w = list(w)
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(w) + 1)
            w[i : i + rng.randrange(2)] = rng.choice(["", "a", "x"])
        words.append("".join(w))
    got = fuzzy.nearest(spark.createDataFrame([(w, 1) for w in words], "word string, key int"), spark.createDataFrame([(k,) for k in keys], "key string"), threshold).collect()
    want = {}
    for w in {w for w in words if w and len(w) >= 5}:
        best = min(((-ratio(w, k), k.encode()) for k in keys if k), default=(0, b""))
        if -best[0] >= threshold:
            want[w] = (best[1].decode(), -best[0])
    assert {r.word: (r.key, r.score) for r in got} == want and len(got) == len(want) > 5
    with pytest.raises(ValueError, match="threshold"):
        fuzzy.nearest(spark.createDataFrame([("a",)], "word string"), spark.createDataFrame([("a",)], "key string"), 60)


def test_match_by_sources_with_near_keys(spark):
    toks = spark.createDataFrame([(1, "running", "NOUN", "runninq"), (2, "walkingg", "VERB", "stand"), (3, "happines", "NOUN", "happines"), (4, "happines", "ADP", "x"), (5, None, "NOUN", "unknown words")], "pos int, lemma string, upos string, form string")
    keys = spark.createDataFrame([("running", 1.0), ("walking", 2.0), ("happiness", 3.0), ("stand", 4.0)], "key string, joy double")
    got = {r.pos: (r.lex_key, r.source, r.fuzzy_score, r.joy) for r in lexicon.match_by_sources(toks, keys, ["lemma", "form"], ["NOUN", "VERB"], 92).collect()}
    assert got == {1: ("running", "lemma", None, 1.0), 2: ("stand", "form", None, 4.0), 3: ("happiness", "lemma:fuzzy:happines", 1600 / 17, 3.0), 4: (None, None, None, None), 5: (None, None, None, None)}


def test_components_and_forest(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(80), rng.randrange(80), rng.choice([0.5, 1.0, 2.0, rng.random()])) for _ in range(150)] + [(i, i + 1, 10.0 - i / 10) for i in range(100, 140)]
    best = {}
    for a, b, w in edges:
        if a != b:
            key = (min(a, b), max(a, b))
            best[key] = min(w, best.get(key, w))
    up = {n: n for e in best for n in e}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    want = []
    for w, a, b in sorted((w, a, b) for (a, b), w in best.items()):
        if root(a) != root(b):
            up[max(root(a), root(b))] = min(root(a), root(b))
            want.append((a, b, w))
    table = spark.createDataFrame([(a, b, w) for (a, b), w in best.items()], "a long, b long, w double")
    assert sorted(map(tuple, graph.spanning_forest(table).collect())) == sorted(want)
    assert graph.spanning_forest(table.limit(0)).count() == 0
    links = table.select(F.col("a").alias("u"), F.col("b").alias("v"))
    assert {r.node: r.component for r in graph.components(links).collect()} == {n: root(n) for n in up}
    two = links.withColumn("g", F.lit(1)).union(links.filter("u > 90").withColumn("g", F.lit(2)))
    assert {(r.g, r.node) for r in graph.components(two, ("g",)).collect()} == {(1, n) for n in up} | {(2, n) for n in range(100, 141)}


def plain_clusters(ids, v, k, least, cuts):
    """The same definitions in plain loops over all pairs."""
    n = len(ids)
    d = density.distances(v, v)
    near = {i: sorted((d[i, j], ids[j], j) for j in range(n) if j != i)[:k] for i in range(n)}
    core = {i: near[i][-1][0] for i in range(n)}
    edges = sorted({(max(x, core[i], core[j]), min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(n) for x, _, j in near[i]})
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    forest = []
    for w, a, b in edges:
        if root(a) != root(b):
            up[max(root(a), root(b))] = min(root(a), root(b))
            forest.append((a, b, w))
    cuts = cuts(sorted(w for _, _, w in forest))
    kept = []
    for c in cuts:
        up.update({i: i for i in ids})
        for a, b, w in forest:
            if w <= c:
                up[max(root(a), root(b))] = min(root(a), root(b))
        groups = defaultdict(set)
        for i in ids:
            groups[root(i)].add(i)
        kept.append({g: m for g, m in groups.items() if len(m) >= least})
    nodes = {}

    def grow(level, members, born, first, parent):
        """One cluster downwards, from the level that it is born at."""
        at, last = members, {i: level for i in members}
        below, l = [], level
        while l + 1 < len(cuts):
            below = [(g, m) for g, m in kept[l + 1].items() if m <= at]
            if len(below) != 1:
                break
            l, at = l + 1, below[0][1]
            last.update(dict.fromkeys(at, l))
            below = []
        nodes[born, first] = (parent, sum(1 / cuts[x] - (1 / cuts[born - 1] if born else 0) for x in last.values()), set(last))
        for g, m in below:
            grow(l + 1, m, l + 1, g, (born, first))

    for g, m in kept[0].items():
        grow(0, m, 0, g, None)
    single = len(kept[0]) == 1
    best, wins = {}, {}
    for node in sorted(nodes, reverse=True):
        inner = sum(best[c] for c in nodes if nodes[c][0] == node)
        own = None if single and nodes[node][0] is None else nodes[node][1]
        wins[node], best[node] = own is not None and own >= inner, max(own or 0.0, inner)
    out = dict.fromkeys(ids, -1)
    for node in sorted(nodes, reverse=True):
        if wins[node]:
            out.update(dict.fromkeys(nodes[node][2], node[1]))
    return out, forest


def test_density_clusters(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(c, s, (n, 3)) for c, s, n in ((0, 0.3, 60), (3, 0.2, 40), (3.9, 0.2, 40), (8, 2.5, 25))])
    ids = [int(i) for i in rng.permutation(len(v)) + 5]
    table = spark.createDataFrame([(i, [float(y) for y in x], "a") for i, x in zip(ids, v)] + [(9000, None, "b"), (9001, [], "b"), (9002, [1.0, float("nan"), 0.0], "b")], "id long, v array<double>, cluster string").repartition(4)
    good = table.filter("id < 9000")
    near = density.neighbours(good.select("id", "v"), 6)
    assert near.count() == 6 * len(ids)
    forest = graph.spanning_forest(density.reachability(near))
    held = sorted(r.w for r in forest.collect())
    cuts = sorted({held[round((len(held) - 1) * q)] for q in np.linspace(0.1, 1, 10)}, reverse=True)
    want, tree = plain_clusters(ids, v, 6, 10, lambda w: cuts)
    assert [(r.a, r.b) for r in forest.orderBy("w", "a", "b").collect()] == [(a, b) for a, b, _ in sorted(tree, key=lambda e: (e[2], e[0], e[1]))]
    got = {r.id: r.cluster for r in density.stable(density.condensed(good.select("id"), forest, cuts, 10), cuts).collect()}
    assert got == want and len(set(want.values())) >= 4
    whole = {r.id: r.cluster for r in density.clusters(table, 6, 10).collect()}
    assert set(whole) == {*ids, 9000, 9001, 9002} and whole[9001] == -1
    assert density.clusters(table.limit(0)).count() == 0
    assert {r.cluster for r in density.clusters(table.limit(1)).collect()} == {-1}


def test_neighbours_of_many_rows(spark):
    """Chunks of sorted projections find most of the nearest rows."""
    rng = np.random.default_rng(6)
    v = rng.normal(0, 1, (600, 4))
    table = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "id long, v array<double>")
    got = density.neighbours(table, 5, tables=8, chunk=128).collect()
    d = density.distances(v, v)
    np.fill_diagonal(d, np.inf)
    true = {(i, int(j)) for i in range(600) for j in np.argsort(d[i])[:5]}
    assert len(got) == 3000 and len({(r.id, r.other) for r in got} & true) > 0.7 * len(true)


def test_topic_merges(spark):
    rng = random.Random(7)
    names = [f"t{i:02}" for i in range(14)]
    rows = [(t, f"w{rng.randrange(8 * (i % 4), 8 * (i % 4) + 25)}") for i, t in enumerate(names) for _ in range(60)]
    table = spark.createDataFrame(rows, "topic string, word string")
    weights = reduction.class_vectors(table, "topic")
    tf, size, term = Counter(rows), Counter(t for t, _ in rows), Counter(w for _, w in rows)
    mean = len(rows) / len(size)
    w = {t: {x: tf[t, x] / size[t] * math.log1p(mean / term[x]) for x in term if tf[t, x]} for t in names}
    norm = {t: math.sqrt(sum(x * x for x in w[t].values())) for t in names}
    cosine = {(a, b): sum(w[a][x] * w[b].get(x, 0) for x in w[a]) / norm[a] / norm[b] for a in names for b in names if a < b}
    pairs = reduction.similarities(weights, "topic")
    assert {(r.a, r.b): round(r.s, 9) for r in pairs.collect()} == {k: round(s, 9) for k, s in cosine.items()}
    groups, want = {t: [t] for t in names}, []
    while len(groups) > 1:
        link = lambda a, b: sum(cosine[min(x, y), max(x, y)] for x in groups[a] for y in groups[b]) / len(groups[a]) / len(groups[b])
        s, a, b = min((-link(a, b), a, b) for a in groups for b in groups if a < b)
        groups[a] = groups[a] + groups.pop(b)
        want.append((a, b, round(-s, 9), len(groups[a])))
    tree = reduction.merges(pairs)
    got = [(r.a, r.b, round(r.similarity, 9), r["size"]) for r in reduction.dendrogram(tree).orderBy("step").collect()]
    assert got == want
    left = {t: t for t in names}
    for a, b, *_ in want[: len(names) - 5]:
        left = {t: a if x == b else x for t, x in left.items()}
    assert dict(reduction.reduced(table, tree, "topic", 5).collect()) == left
    assert reduction.merges(pairs.limit(0)).count() == 0


def test_vectors_of_texts(spark):
    rng = random.Random(9)
    vocabulary = [f"word{i}" for i in range(400)]
    docs = [(i, rng.choices(vocabulary[20 * (i % 12) :], k=rng.randrange(5, 200))) for i in range(120)] + [(500, []), (501, None)]
    table = spark.createDataFrame(docs, "doc_id long, words array<string>")
    for size, bound in ((64, 0.13), (256, 0.065)):
        got = {r.doc_id: np.array(r.v) for r in vectors.text_vectors(table, size).collect()}
        assert len(got) == 122 and not got[500].any() and not got[501].any() and len(got[3]) == size
        df = Counter(w for _, ws in docs for w in set(ws or []))
        full = {}
        for i, ws in docs[:120]:
            full[i] = {w: c * (math.log(123 / (df[w] + 1)) + 1) for w, c in Counter(ws).items()}
        off = []
        for _ in range(500):
            a, b = rng.randrange(120), rng.randrange(120)
            norm = math.sqrt(sum(x * x for x in full[a].values()) * sum(x * x for x in full[b].values()))
            off.append(float(got[a] @ got[b]) - sum(x * full[b].get(w, 0) for w, x in full[a].items()) / norm)
        assert np.sqrt(np.mean(np.square(off))) < bound


def test_resumed_outputs(spark, tmp_path):
    rows = spark.range(100).withColumnRenamed("id", "doc_id").withColumn("batch", F.lit("x"))
    seen = []

    def make(part, stop=None):
        seen.append(sorted(r.doc_id for r in part.collect()))
        if stop is not None and len(seen) == stop:
            raise RuntimeError("stopped")
        return part.withColumn("n", F.col("doc_id") * 2)

    path = str(tmp_path / "out")
    with pytest.raises(RuntimeError):
        resumable.run(rows, "doc_id", lambda p: make(p, 4), path, {"size": 1}, 8)
    first = list(seen)
    seen.clear()
    out = resumable.run(rows, "doc_id", make, path, {"size": 1}, 8)
    assert sorted((r.doc_id, r.n) for r in out.collect()) == [(i, 2 * i) for i in range(100)]
    assert len(seen) == 5 and sorted(sum(first[:3] + seen, [])) == list(range(100))
    seen.clear()
    resumable.run(rows, "doc_id", make, path, {"size": 1}, 8)
    assert not seen
    resumable.run(rows, "doc_id", make, path, {"size": 2}, 8)
    resumable.run(rows.filter("doc_id < 99"), "doc_id", make, path, {"size": 1}, 8)
    assert len(seen) == 16 and len(list((tmp_path / "out").iterdir())) == 3
    assert resumable.run(rows.limit(0), "doc_id", make, path, {}, 2).count() == 0
    other = rows.withColumn("batch", F.lit("y"))
    for table in (rows, other, rows):
        resumable.run(table, "doc_id", make, path, {"size": 1}, 8, ("batch",))
    assert len(list((tmp_path / "out").iterdir())) == 6


def test_batched_k_means(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(c, 0.5, (80, 2)) for c in (0, 5, 10)])
    rows = [(i, [float(y) for y in x]) for i, x in enumerate(v)]
    table = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    key = {r.id: (r.b, r.s) for r in table.select("id", F.pmod(F.xxhash64("id"), F.lit(4)).alias("b"), F.xxhash64("id", F.lit(7)).alias("s")).collect()}
    c = np.array([v[i] for i in sorted(key, key=lambda i: key[i][1])[:3]])
    n = np.zeros(3)
    for _ in range(5):
        for b in range(4):
            own = [i for i in key if key[i][0] == b]
            to = np.array([((v[i] - c) ** 2).sum(axis=1).argmin() for i in own])
            moved = c.copy()
            for j in range(3):
                m = [v[i] for i, t in zip(own, to) if t == j]
                if m:
                    n[j] += len(m)
                    moved[j] = c[j] + len(m) / n[j] * (np.mean(m, axis=0) - c[j])
            c = moved
    got = minibatch.fit(table, 3, 5, 4)
    assert np.allclose(got, c)
    found = minibatch.predict(table, got).collect()
    assert all(r.cluster == ((v[r.id] - got) ** 2).sum(axis=1).argmin() for r in found)
    assert minibatch.auto_k(10_000) == 30 and minibatch.auto_k(2) == 1 and minibatch.auto_k(50) == 7


def test_entities(spark):
    texts = ["a &#382;&#x17E;&#x17e; &amp;lt; &lt;b&gt; &unknown; &#0; &#xD800; &#128512;", "&#38;lt;", "", None, "no & sign;", "&Scaron;&ndash;"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(conllu.unescape(F.col("t"))).collect()]
    assert got == ["a žžž &lt; <b> &unknown; &#0; &#xD800; 😀", "&lt;", "", None, "no & sign;", "Š–"]


def test_lexeme_of_odd_strings(spark):
    odd = [" ﬁn x‑y—z ", "«Ꝛaaaazhȷ»", "ſh…", None, "Éa"]
    rows = spark.createDataFrame([(t,) for t in odd], "t string")
    of = lambda m, s=False: [r[0] for r in rows.select(tx.lexeme(m, s)(F.col("t"))).collect()]
    assert of("simple") == ["fin x-y-z", "ꝛaaaazhȷ", "sh", "", "éa"]
    assert of("historical")[1] == "raačj" and of("ascii")[4] == "ea" and of("none")[0] == "fin x‐y—z" and of("none", True)[4] == "ea"


def test_written_order(spark, tmp_path):
    """Reading, writing and reading again gives the same sentences in the same order, a folder for each source."""
    (tmp_path / "in").mkdir()
    for name, docs in (("b", range(40)), ("a", range(40, 60))):
        body = "".join(f"# newdoc id = d{d}\n" + "".join(f"# sent_id = {d}.{s}\n1\tw{s}\tw\tNOUN\t_\t_\t0\troot\t_\t_\n\n" for s in range(1 + d % 3)) for d in docs)
        (tmp_path / "in" / f"{name}.conllu").write_text(body)
    order = lambda s: [r.sent_id for r in s.orderBy("file", "doc_no", "at").collect()]
    sents = conllu.sentences(conllu.blocks(conllu.lines(spark, str(tmp_path / "in"))))
    conllu.write(sents, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["source=a.conllu", "source=b.conllu"]
    again = conllu.sentences(conllu.blocks(conllu.lines(spark, str(tmp_path / "out"))))
    assert order(again) == order(sents) and len(order(sents)) == 120
    ordinals = [(r.file, r.ordinal) for r in conllu.tokens(sents).orderBy("file", "ordinal").collect()]
    assert [o for f, o in ordinals if f.endswith("b.conllu")] == list(range(len([1 for f, _ in ordinals if f.endswith("b.conllu")])))


def test_numbers_within_a_hot_key(spark, monkeypatch):
    """One id on nine tenths of all rows lies in many partitions and is numbered through; null is a key too."""
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 18 + ["cold", None]), i) for i in range(20_000)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "id string, place long").repartition(6)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    dealt, store = [], numbering.stored
    monkeypatch.setattr(numbering, "stored", lambda df, name: dealt.append(store(df, name)) or dealt[-1])
    try:
        got = numbering.numbered(table, ["id"], ["place"], "n", "all")
        assert dealt[0].filter("id = 'hot'").select("_n_part").distinct().count() > 8
        found = sorted(((r["id"] or "", r.place, r.n, r["all"]) for r in got.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = []
    for key in {k for k, _ in rows}:
        own = sorted(p for k, p in rows if k == key)
        want += [(key or "", p, i + 1, len(own)) for i, p in enumerate(own)]
    assert found == sorted(want)


def test_encodings_in_splits(spark, tmp_path):
    """Files of several splits are told and decoded without a task for a whole file."""
    body = {"a": ("cp1250", [f"čaj {i} žŽ„“" for i in range(400)]), "b": ("utf-8", [f"čaj {i}" for i in range(400)]), "c": ("iso8859_2", [f"č\x81{i}š" for i in range(400)])}
    for name, (charset, rows) in body.items():
        (tmp_path / f"{name}.txt").write_bytes("\n".join(rows).encode(charset))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        read = conllu.legacy_lines(spark, str(tmp_path))
        assert read.select("file", "split").distinct().count() > 12
        got = read.orderBy("file", "split", "row").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name, (_, rows) in body.items():
        assert [r.value for r in got if r.file.endswith(f"{name}.txt")] == rows


def test_renewed_metadata_and_refusal(spark):
    docs = [(1, {"id": "x 1", "Gnere": "a", "genre": "b", "leto": "okoli 1850", "stoletje": ""}), (2, {"id": "x 1", "year": "?"}), (3, {"title": "T", "century": "XIX"}), (4, {}), (5, {"xml:id": "z", "genre": "", "vrsta": "c"})]
    normal, fixes = metadata.renewed(spark.createDataFrame([(i, list(a.items())) for i, a in docs], "doc_index long, a array<struct<k:string,v:string>>").select("doc_index", F.map_from_entries("a").alias("attrs")))
    assert {r.doc_index: (r.doc_id, r.attrs) for r in normal.collect()} == {1: ("x_1", {"genre": "a", "year": "1850", "century": "19"}), 2: ("x_1__0002", {"year": "?"}), 3: ("T", {"title": "T", "century": "19"}), 4: ("doc", {}), 5: ("z", {})}
    log = sorted((r.doc_index, r.action, r.old_key, r.new_value) for r in fixes.collect())
    assert [x for x in log if x[0] == 1] == [(1, "conflict_keep_first", "genre", "a"), (1, "derive_century_from_year", "year", "19"), (1, "normalize_value", "year", "1850"), (1, "rename_key", "Gnere", "a"), (1, "rename_key", "leto", "okoli 1850"), (1, "rename_key", "stoletje", ""), (1, "set_doc_id", "id", "x_1")]
    assert [x[1] for x in log if x[0] == 2] == ["set_doc_id"] and (3, "normalize_value", "century", "19") in log
    gate = spark.createDataFrame([("genre", 0.2, 0.8, False), ("title", 1.0, 0.5, True)], "key string, coverage double, least double, ok boolean")
    metadata.refuse(fixes, gate)
    with pytest.raises(ValueError, match="renamed"):
        metadata.refuse(fixes, gate, on_alias=True)
    with pytest.raises(ValueError, match="genre: 0.200 < 0.800"):
        metadata.refuse(fixes.limit(0), gate, on_alias=True, on_coverage=True)


def test_manifest_of_a_run(spark, tmp_path):
    (tmp_path / "in.txt").write_text("a")
    made = delimited.run_manifest({"t": spark.range(3)}, {"size": 2}, ["odd"], delimited.manifest(spark, str(tmp_path / "in.txt")), {"joy": ["Joy", "veselje"]})
    assert sorted(map(tuple, made.collect())) == [("argument", "size", "2"), ("lexicon_column", "joy", "Joy,veselje"), ("rows", "t", "3"), ("sha256", "in.txt", hashlib.sha256(b"a").hexdigest()), ("warning", "1", "odd")]


def test_wordless_documents_have_scores(spark):
    docs = spark.createDataFrame([(1, "joy joy x"), (2, "..."), (3, None)], "doc_id long, text string")
    keys = spark.createDataFrame([("joy", *[1.0] * 13)], "key string, " + ", ".join(f"{c} double" for c in [*lexicon.EMOTIONS, *lexicon.SENTIMENTS, *lexicon.VAD]))
    got = {r.doc_id: (r.n_words, r.hits, r.joy, r.coverage, r.dominant) for r in lexicon.score(lexicon.match(segments.tokens(docs), keys), ["doc_id"], docs).collect()}
    assert got == {1: (3, 2, 2.0, 2 / 3, "anger"), 2: (0, 0, 0.0, 0.0, None), 3: (0, 0, 0.0, 0.0, None)}
