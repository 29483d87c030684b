"""Top-k search, collocations and conversation repair against brute force, with odd rows and tables."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from lexharbor.llm import collocations, conversations, suffix_dedup, topk, url_filter

random.seed(3)


def best(rows, every, k, scale):
    """Every pair of a query and another id."""
    kept = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept[i] = min(kept.get(i, v), v)
    q = {i: [math.floor(scale * x) for x in v] for i, v in kept.items()}
    out = []
    for a in q:
        if a % every == 0:
            ranked = sorted((-sum(x * y for x, y in zip(q[a], q[b])), b) for b in q if b != a)[:k]
            out += [(a, n + 1, b, -s) for n, (s, b) in enumerate(ranked)]
    return sorted(out)


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.3, 7)]) for i in range(300)]
    rows += [(400 + i, rows[3][1]) for i in range(90)]  # ties beyond what is read exactly
    rows += [(1000, None), (1010, [0.1, None]), (1020, [float("nan")] * 7), (1030, [1.0, float("inf")]), (None, [1.0] * 7), (1040, [0.5, -2.0]), (1050, [])]
    rows += [(100, rows[100][1]), (110, [9.0] * 7), (110, [-9.0] * 7), (7, rows[7][1]), (-20, [0.25] * 7)]
    table = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id long, embedding array<float>, score string, block double").repartition(5)
    exact = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want = best(exact, 10, 5, 256)
    for block, queries, groups in ((8192, 128, 64), (64, 4, 3)):
        monkeypatch.setattr(topk, "BLOCK", block)
        monkeypatch.setattr(topk, "QUERIES", queries)
        monkeypatch.setattr(topk, "GROUPS", groups)
        assert sorted(map(tuple, topk.top_k(table, 10, 5).collect())) == want
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (50, [-1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.top_k(few, 50, 5).collect())) == [(0, 1, 1, 131072), (0, 2, 50, -65536), (50, 1, 0, -65536), (50, 2, 1, -131072)]
    assert topk.top_k(few.limit(0)).count() == 0 and topk.top_k(few.filter("vec_id = 1")).count() == 0
    with pytest.raises(ValueError, match="31 bits"):
        topk.top_k(spark.createDataFrame([(0, [1e12])], "vec_id long, embedding array<double>"))


def test_slices_add_up():
    rng = np.random.default_rng(2)
    values = rng.integers(-200, 200, (130, 9))
    index = topk.Slices(np.arange(130), values).open()
    for q in (*rng.integers(-150, 150, (20, 9)), np.zeros(9, np.int64)):
        slices, more = index.scores(q)
        bits = [np.unpackbits(s.view(np.uint8), bitorder="little")[:130].astype(np.int64) << w for w, s in enumerate(slices)]
        assert (sum(bits, np.zeros(130, np.int64)) + more == values @ q).all()


def mined(rows, top, least):
    pieces, n = {}, Counter()
    for text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for p in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", p)
            n[lang or "und"] += len(w)
            pieces.setdefault(lang or "und", []).append(w)
    out = []
    for lang, own in pieces.items():
        f = Counter(tuple(w[i : i + m]) for w in own for m in range(1, 6) for i in range(len(w) - m + 1))
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {q for p, a in cand.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if f[q := p[i : i + m]] <= a}
        rows_ = []
        for p in cand.keys() - gone:
            s, k = min((1000 * cand[p] * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows_.append((-s, -cand[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows_)[:top])]
    return sorted(out)


@pytest.mark.parametrize(("top", "least"), [(15, 3), (2000, 4), (1, 5)])
def test_collocations(spark, top, least):
    rng = random.Random(8)
    common, rare = ["the", "of", "Aé"], [f"w{i}" for i in range(40)]
    fixed = ["new york city hall", "a b", "a b c", "ab ab ab ab ab ab ab", "x the y", "en de", "de en", "of the of the of"]
    rows = [(None, "en"), ("", "en"), (" \t.\n", None), ("ONE Two", None), ("w1 w2", "xx")]
    for i in range(260):
        words = [rng.choice(rng.choice([common, rare, fixed])) for _ in range(rng.randrange(1, 40))]
        rows.append((rng.choice([" ", "\t "]).join(w + rng.choice(["", "", "", ".", ",\n", " !"]) for w in words), rng.choice(["en", "en", "de", None])))
    rows += [rows[9]] * 5 + [("long phrase here, " * 3000, "fr")]
    table = spark.createDataFrame([(t, x, 1, "y") for t, x in rows], "text string, lang string, code int, word string").repartition(3)
    got = collocations.mine(table, top, least)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == mined(rows, top, least)


def test_collocations_of_nothing(spark):
    table = spark.createDataFrame([(None, None), ("a b", "x")], "text string, lang string")
    assert collocations.mine(table).count() == 0 and collocations.mine(table.limit(0)).count() == 0


def damaged(conv, rows):
    out = []
    for turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or " ", r[2] or " ")):
        role, text = role if role is not None else " ", text if text is not None else " "
        m = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if m == 1 else re.sub("[.!?]", "", text) if m == 2 else text
        out += [(turn, "user" if m == 4 else role, text)] * (0 if m == 0 else 2 if m == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        own = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not own else "duplicate" if (role, text) in seen else "" if own[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def repaired(rows, bad, inserts=2):
    """All edits of a short conversation: the least (cost, audit) and what it makes."""
    names = {"u": "user", "a": "assistant"}
    choices = []
    for (_, role, text), f in zip(rows, bad):
        one = [(3, "D", [])]
        if f not in ("blank", "duplicate"):
            more = f == "truncated"
            one += [(more, "K", [(role, text)])] + [(2 + more, "R", [(names[x], text)]) for x in "ua"]
        choices.append(one)
    gap = [(2 * k, "I" * k, [(names[x], "") for x in p]) for k in range(inserts + 1) for p in itertools.product("ua", repeat=k)]
    found = None
    for picked in itertools.product(gap, *(x for c in choices for x in (c, gap))):
        turns = [t for _, _, own in picked for t in own]
        if re.fullmatch("(s?(ua)+)?", "".join(r[:1] if r else "-" for r, _ in turns)):
            now = (sum(c for c, _, _ in picked), "".join(a for _, a, _ in picked), "\n".join(f"{r}:{t}" for r, t in turns))
            found = now if found is None else min(found, now)
    return found


def reported(conv, rows):
    rows = damaged(conv, rows)
    bad = faults(rows)
    turns = {t for t, _, _ in rows if t is not None}
    first = [r[:1] for _, r, _ in rows]
    cost, audit, text = repaired(rows, bad)
    return (conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(bad.count(x) for x in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), cost, audit, hashlib.sha256(text.encode()).hexdigest())


def test_repair(spark):
    rng = random.Random(5)
    talks = {None: [(0, "user", "x."), (None, None, None)], 1: [], 900: [(0, "user", "a"), (0, "user", "a"), (0, "assistant", "b.")]}
    for conv in range(2, 70):
        talks[conv] = [(rng.choice([None, 0, 1, 2, 7]), rng.choice(["user", "assistant", "system", "user", "assistant", None, "", "Über"]), rng.choice(["Hi.", "Hi.", "so", "\t", "", None, "ends! \n", "é"])) for _ in range(rng.randrange(1, 4))]
    rows = [(c, *r, "x", 1) for c, own in talks.items() for r in own]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, fault string, copies int").repartition(3)
    got = sorted(map(tuple, conversations.repair(table).collect()), key=str)
    assert got == sorted((reported(c, own) for c, own in talks.items() if own), key=str)
    assert conversations.repair(table.limit(0)).count() == 0


def test_long_conversations_are_cut(spark):
    """Chunks give what whole conversations give, also across tasks."""
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice([f"t{t}.", "Same.", "open", " "])) for c, n in ((1, 400), (2, 3), (3, 1), (4, 150)) for t in range(n)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    whole = sorted(map(tuple, conversations.repair(table).collect()))
    assert sorted(map(tuple, conversations.repair(table, size=7).collect())) == whole
    for conv, *_, cost, audit, _ in whole:
        own = damaged(conv, [r[1:] for r in rows if r[0] == conv])
        assert len(audit.replace("I", "")) == len(own)
        assert cost == sum({"D": 3, "R": 2, "I": 2, "K": 0}[x] for x in audit) + sum(f == "truncated" and e != "D" for f, e in zip(faults(own), audit.replace("I", "")))


def test_stack_merges_equal_tops():
    """Behind the same top only the cheapest stack stays: what a deleted system turn leaves costs more than a kept one."""
    tops = {(r["enter"], r["leave"]): (r["cost"], r["audit"]) for r in conversations.table(["system", "user", "assistant"], [0, 0, 0], (0,))}
    assert tops[0, 4] == (0, "KKK") and tops[0, 0] == (9, "DDD") and min(tops.values()) == (0, "KKK")
    assert conversations.closed({2: (5, "KK"), 0: (6, "DD")}) == (6, "DD") and conversations.closed({2: (3, "KK"), 0: (6, "DD")}) == (5, "KKI")


def test_longest_previous_factors():
    """LPF values, up to a length, of all suffixes of some texts against the longest common prefix with every earlier one."""
    rng = random.Random(12)
    for most in (3, 6, 40):
        texts = ["".join(rng.choices("ab", k=rng.randrange(1, 60))) for _ in range(4)] + ["ab" * 30, "a" * 50]
        suffixes = {(d, i): t[i : i + most].encode() for d, t in enumerate(texts) for i in range(len(t))}
        order = sorted(suffixes, key=lambda p: (suffixes[p].ljust(most, b"\0"), p))
        rows = np.array([list(suffixes[p].ljust(most, b"\0")) for p in order], dtype=np.uint8)
        shared = [0, *suffix_dedup.shared_prefixes(rows).tolist()]
        factors, got = suffix_dedup.Factors(most), {}
        for p, n in zip(order, shared):
            got.update(factors.add(p, n))
        got.update(factors.end())

        def common(a, b):
            return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

        padded = {p: s.ljust(most, b"\0") for p, s in suffixes.items()}
        assert got == {p: max((common(padded[p], padded[q]) for q in suffixes if q < p), default=0) for p in suffixes}


def test_odd_url_tables(spark):
    """Long URLs end in seconds; repeated rows, clashing columns and an empty table."""
    long = "http://ads.example.com/" + "x/" * 600_000
    rows = [(1, long + "login1.php", "a", 1), (2, long + "en.exe", "b", 2), (2, long + "en.exe", "b", 2), (3, None, None, None), (4, "http://WWW.com/en/" + "y" * 5000, "c", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict int")
    begun = time.time()
    got = sorted((r.page_id, r.rule or "", r.verdict) for r in url_filter.filter_urls(pages).collect())
    assert got == [(1, "", "block"), (2, "", "block"), (2, "", "block"), (3, "", "allow"), (4, "com/en/", "block")]
    assert time.time() - begun < 20
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_urls_alone_and_together():
    """States of single texts and of batches are the same, over several words."""
    globs = [url_filter._glob(g) for g in ("**a?b*", "*//**", "?b**a", "**")] * 30
    texts = [bytes(random.choices(b"ab/", k=random.randrange(40))) for _ in range(60)]
    automaton = url_filter.Automaton(globs)
    together = sorted((int(t), int(p)) for rows, found in automaton.run(texts) for t, p in zip(rows, found, strict=True))
    alone = sorted((i, int(p)) for i, t in enumerate(texts) for _, found in automaton.run([t]) for p in found)
    assert together == alone
