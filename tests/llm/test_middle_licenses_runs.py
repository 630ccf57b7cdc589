"""Fill-in-the-middle, license scans and periodic runs against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from consentry.llm import fim, licenses, periodic

SCHEMA = "doc_id long, text string, n long, row long, output string, form string, w string, h1 string, spans string, template string, runs string, g string, p string, d int"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts():
    r = random.Random(7)
    bits = ["a", "bb", "été", "日本", "😀", "<P>", "<", "<S", "P>", "<M>", "\x85", " ", "x1"]
    some = ["".join(r.choice(bits) + r.choice(["", " ", "  ", "\n", "\t\v"]) for _ in range(r.choice([1, 3, 20, 60]))) for _ in range(60)]
    clean = [t.replace("<", "(").replace(">", ")") for t in some]
    return [None, "", " ", " \n\t", "word", *some, *clean, "a b " * 20000, "😀 " * 50, "q" * 200000]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, *[None if c == "w" else 1 if c in "nd" else "x" for c in "n"], 3, *["x"] * 9, 4) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, "no id here at all", *rows[0][2:]), (None, None, *rows[0][2:])]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def in_order(rows):
    return sorted(rows, key=str)


def brute_fim(i, t, rate=50, spm=80, seed=42, marks=("<P>", "<S>", "<M>")):
    x = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    u = UNIT.findall(t)
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    if not t or any(m in t for m in marks) or h[2] % 100 >= rate:
        return i, len(u), "plain", None, None, t
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    first = [marks[1], s, marks[0], p] if h[3] % 100 < spm else [marks[0], p, marks[1], s]
    return i, len(u), "spm" if h[3] % 100 < spm else "psm", len(p), len(m), "".join([*first, marks[2], m])


@pytest.mark.parametrize("options", [{}, {"rate": 100, "spm_rate": 50, "seed": 7}, {"rate": 90, "sentinels": ("<pre>", "§", "{mid}")}])
def test_fill_in_middle(docs, empty, options):
    out = fim.transform(docs, **options)
    marks = options.get("sentinels", fim.SENTINELS)
    got = out.withColumn("back", fim.restored(F.col("output"), F.col("form"), marks)).collect()
    want = [brute_fim(i, t, options.get("rate", 50), options.get("spm_rate", 80), options.get("seed", 42), marks) for i, t in pairs(docs)]
    assert in_order((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == in_order(want)
    assert in_order((r.doc_id, r.back) for r in got) == in_order(pairs(docs))
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert all(r.n_chars == len(r.back) for r in got)
    assert fim.transform(empty).count() == 0


def test_scan_does_not_depend_on_lanes():
    r = random.Random(1)
    stream = "".join(r.choice("<PSM> \né") for _ in range(30000)).encode()
    symbols = np.frombuffer(stream, np.uint8).astype(np.int16)
    symbols = np.where(np.arange(len(symbols)) % 997 == 0, fim.BREAK, symbols)
    a = fim.automaton()
    state, want = 0, []
    for s in symbols.tolist():
        at = state + a.classes[s]
        state = a.next[at]
        want.append(a.emit[at])
    assert a.read(symbols).tolist() == want
    assert a.read(symbols[:0]).tolist() == []


def test_sentinels_that_overlap_are_refused():
    for bad in (("<P>", "<P>", "<M>"), ("ab", "bc", "x"), ("aa", "b", "c"), ("", "b", "c")):
        with pytest.raises(ValueError):
            fim.Automaton(bad)


NOTICE = dict(licenses.NOTICES)


@pytest.fixture(scope="module")
def licensed(spark):
    r = random.Random(3)
    noise = [f"w{k}" for k in range(400)] + ["license", "mit", "the", "of", "cc", "by", "apache"]

    def text(n):
        return " ".join(r.choice(noise) for _ in range(n))

    mit = NOTICE["mit"].split()
    shifted = " ".join([*mit[:20], "xx", "yy", *mit[20:45], *mit[47:]])
    rows = [None, "", " -- ", "MIT", "Released under the MIT-License.", "GNU General\nPublic License, apache licenseX", "Apache License Apache License", text(50), f"{text(300)} {NOTICE['mit']} {text(200)}", f"{text(40)} {shifted} {text(9)}"]
    rows += [" ".join(mit[:15]) + text(60), f"{NOTICE['isc']} {text(700)} {NOTICE['isc']}", "mit license " * 5000, text(30000), "ＣＣ BY été cc by-nc", "cc by", "permission is hereby granted " * 300 + NOTICE["mit"]]
    rows += [f"{text(20)} licensed under {r.choice(noise)} {text(5)} by nc 4 0" for _ in range(20)]
    rows = [(i, t, 1, 2, *["x"] * 9, 3) for i, t in enumerate(rows)]
    return spark.createDataFrame([*rows, rows[8], rows[8], (None, "mit license", *rows[0][2:])], SCHEMA).repartition(3)


def brute_licenses(t, k=4, slack=8, least=0.6):
    def words(x):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", x.translate({c: c + 32 for c in range(65, 91)}))

    w = words(t)
    spans, score = [], 0.0
    for label, text, exact in [(*x, True) for x in licenses.PHRASES] + [(*x, False) for x in licenses.NOTICES]:
        v = words(text)
        g = min(k, len(v))
        where = {}
        for j in range(len(v) - g + 1):
            where.setdefault(tuple(v[j : j + g]), []).append(j)
        votes = {}
        for i in range(len(w) - g + 1):
            for j in where.get(tuple(w[i : i + g]), []):
                votes.setdefault(i - j, []).append(j)
        islands = []
        for d in sorted(votes):
            if islands and not exact and d - islands[-1][-1] <= slack:
                islands[-1].append(d)
            else:
                islands.append([d])
        for some in islands:
            found = []
            for ds in [*([d] for d in some), some]:
                places = {j for d in ds for j in votes[d]}
                start, stop = min(d + min(votes[d]) for d in ds), max(d + max(votes[d]) + g for d in ds)
                found.append((len({x for j in places for x in range(j, j + g)}) / max(len(v), stop - start), start, stop))
            share, start, stop = max(found)
            score = max(score, share)
            if share >= (1.0 if exact else least):
                spans.append((start, stop, label, exact, share))
    return len(w), sorted(spans), score


def test_license_scans(licensed, empty, monkeypatch):
    want = in_order((i, *brute_licenses(t)) for i, t in pairs(licensed))
    for most in (licenses.MAX_BROADCAST_GRAMS, 0):  # by broadcast, then by the salted shuffle
        monkeypatch.setattr(licenses, "MAX_BROADCAST_GRAMS", most)
        got = in_order((r.doc_id, r.n_words, [tuple(s) for s in r.spans], r.score) for r in licenses.scan(licensed).collect())
        assert got == want
    found = {r.doc_id: r for r in licenses.summary(licenses.scan(licensed)).collect()}
    assert found[4].base_labels == "mit" and (found[4].n_base, found[4].first_word, found[4].last_word) == (1, 3, 3)
    assert (found[6].n_base, found[6].first_word, found[6].last_word) == (2, 0, 2)
    assert found[9].labels == "mit" and found[9].base_labels == "" and found[9].score > 0.8
    assert found[12].n_base == 5000
    assert (found[1].n_words, found[1].labels, found[1].first_word, found[1].score) == (0, "", None, 0.0)
    assert licenses.scan(empty).count() == 0


def test_license_templates_of_the_caller(spark, licensed):
    own = spark.createDataFrame([("one", "w1", True), ("none", " -- ", True), ("twice", "w2 w2 w3", False), ("twice", "w2 w2 w3", False), (None, "w5 w6", True)], "label string, text string, exact boolean")
    got = licenses.scan(licensed, own).where("doc_id = 13").first()
    w = pairs(licensed)
    text = next(t for i, t in w if i == 13).split()
    assert sum(s.label == "one" for s in got.spans) == text.count("w1")
    assert licenses.scan(licensed, own.limit(0)).count() == licensed.count()


def test_license_scan_is_native(licensed):
    plan = licenses.scan(licensed)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan) and "CartesianProduct" not in plan and "NestedLoop" not in plan


def brute_runs(w, least=24, times=3):
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least, times * q) and not any(all(w[k] == w[k + s] for k in range(i, j + q - s)) for s in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize(("least", "times"), [(24, 3), (4, 3), (6, 4), (9, 3)])
def test_runs_are_all_runs(least, times):
    r = random.Random(least)
    texts = [[], [0], [0] * 100, [0, 1] * 40, [1, 0] * 40 + [1, 0, 0] * 20]
    for _ in range(300):
        letters = r.choice([1, 2, 3, 8])
        t = []
        while len(t) < r.choice([10, 40, 120]):
            root = [r.randrange(letters) for _ in range(r.randint(1, 9))]
            t += (root * r.choice([1, 2, 3, 5, 12]))[: r.randint(1, 60)]
        texts.append(t)
    a, b = [0], [1]
    for _ in range(9):
        a, b = a + b, a  # a Fibonacci word has runs of many periods
    texts.append(a)
    rows = periodic.find_runs(np.array([x for t in texts for x in t], np.int64), np.array([len(t) for t in texts]), least, times)
    got = [[tuple(x[1:]) for x in rows[rows[:, 0] == k].tolist()] for k in range(len(texts))]
    assert got == [brute_runs(t, least, times) for t in texts]
    assert sum(map(len, got)) > 50


def test_fewer_periods_are_refused():
    with pytest.raises(ValueError):
        periodic.find_runs(np.zeros(3, np.int64), np.array([3]), 24, 2)


def test_collapse(spark, docs, empty):
    r = random.Random(11)
    some = [" ".join(["x", *(["a", "b", "c"] * 10), "y"]), "z " * 30000, "q\n" * 23, "q\t" * 24, " ".join(r.choice("ab") for _ in range(3000)), "é é  " * 30]
    d = docs.select("doc_id", "text", "runs", "g").unionByName(spark.createDataFrame([(1000 + i, t, "x", "x") for i, t in enumerate(some)], "doc_id long, text string, runs string, g string"))

    def want(i, t, plant):
        w = WORD.findall(t)
        h = zlib.crc32(b"" if i is None else str(i).encode())
        g, n = h // 10, len(w)
        if plant and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        runs = brute_runs(w) if n < 5000 else [(0, n, {"z": 1, "a": 2, "q": 1}[w[0]])] if len(set(w)) < 3 else []
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        return i, n, runs, " ".join(x for k, x in enumerate(w) if k not in gone)

    for plant in (False, True):
        got = periodic.collapse(periodic.planted(d) if plant else d).collect()
        assert in_order((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got) == in_order(want(i, t, plant) for i, t in pairs(d))
    assert periodic.collapse(periodic.planted(empty)).count() == 0
    top = periodic.collapse(d).select("doc_id", periodic.greatest(F.col("runs")).alias("top"), periodic.digest(F.col("runs")).alias("sha")).where("doc_id >= 1000").collect()
    by = {r.doc_id: r for r in top}
    assert tuple(by[1000].top) == (1, 30, 3) and by[1002].top is None
    assert by[1000].sha == hashlib.sha256(b"1,30,3\n").hexdigest() and by[1002].sha == hashlib.sha256(b"").hexdigest()
