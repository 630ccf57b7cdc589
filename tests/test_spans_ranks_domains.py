"""Interval joins, inversions and domain containment against plain code, with groups cut into blocks."""

import random

import numpy as np
import pytest


from consentry.operators import intervals, inversions, retrieval


@pytest.mark.parametrize("width", [7, 1024])
def test_containment(spark, width):
    r = random.Random(width)
    outer = [(k % 3, a, a + r.randint(0, 40)) for k in range(60) for a in [r.randint(0, 300)]]
    inner = [(k % 4, a, a + r.randint(0, 15), k) for k in range(150) for a in [r.randint(0, 320)]]
    inner += [(0, e, e, 1000 + k) for k, (_, _, e) in enumerate(outer) if outer[k][0] == 0]  # empty ones at the ends
    o = spark.createDataFrame([(*x, n) for n, x in enumerate(outer)], "doc int, start int, end int, o int")
    i = spark.createDataFrame(inner, "doc int, start int, end int, i int")
    got = sorted((x.o, x.i) for x in intervals.contained(i, o, "doc", width).collect())
    assert got == sorted((n, k) for n, (d, a, b) in enumerate(outer) for e, s, t, k in inner if d == e and a <= s and t <= b)


def test_annotated_paragraphs(spark):
    text = "\n  " + "a" * 40 + " \n \n" + "short\n\n" + "b" * 700 + "\n\n" + "c" * 35
    at = {x: text.index(x * 3) for x in "abc"}
    entities = [(1, at["a"], at["a"] + 5, "aaaaa", "PERSON", "QUASI"), (1, at["a"] + 2, at["a"] + 9, "aaaaaaa", None, "DIRECT"), (1, at["a"] + 30, at["b"] + 3, "across", "LOC", "DIRECT"), (1, at["b"], at["b"] + 1, "b", "DATE", None), (1, at["c"], at["c"] + 2, "cc", "CODE", "ODD"), (2, 0, 3, "zzz", "X", "DIRECT")]
    d = spark.createDataFrame([(1, text), (2, "z" * 10), (3, None)], "id int, t string")
    e = spark.createDataFrame(entities, "id int, start int, end int, span_text string, entity_type string, identifier_type string")
    got = {r.paragraph: (len(r.text), r.category, r.risk_score, r.sensitive_fields) for r in intervals.annotated_paragraphs(d, e, "id", "t").collect()}
    assert got == {0: (40, "MISC|PERSON", 0.85, ["aaaaa", "aaaaaaa"]), 2: (35, "CODE", 0.5, ["cc"])}
    p = {r.paragraph: (r.start, r.end, r.text) for r in intervals.paragraphs(d, "id", "t").collect()}
    assert all(text[a:b].strip() == t for a, b, t in p.values()) and len(p) == 3


def test_inversions_of_many_arrays():
    r = np.random.default_rng(0)
    arrays = [r.integers(0, k + 1, n).astype(float) for k, n in [(0, 5), (3, 40), (1000, 200), (1, 0), (5, 1), (7, 333)]] + [np.arange(50.0)[::-1]]
    want = [sum(a[i] > a[j] for i in range(len(a)) for j in range(i + 1, len(a))) for a in arrays]
    assert inversions.count_inversions(np.concatenate(arrays), np.array([len(a) for a in arrays])).tolist() == want


def tau(rows):
    n = len(rows)
    c = d = tx = ty = 0
    for i in range(n):
        for j in range(i + 1, n):
            a, b = rows[i][0] - rows[j][0], rows[i][1] - rows[j][1]
            tx, ty, c, d = tx + (a == 0), ty + (b == 0), c + (a * b > 0), d + (a * b < 0)
    all_ = n * (n - 1) / 2
    den = ((all_ - tx) * (all_ - ty)) ** 0.5
    return (c - d) / den if den else 0.0


@pytest.mark.parametrize("block", [1 << 16, 16, 50])
def test_kendall(spark, block, monkeypatch):
    monkeypatch.setattr(inversions, "MOST_BLOCKS", 8)
    r = random.Random(block)
    groups = {"ties": [(r.randint(0, 4), r.randint(0, 4)) for _ in range(150)], "free": [(r.random(), r.random()) for _ in range(170)], "up": [(k, k) for k in range(60)], "down": [(k, -k) for k in range(90)], "same": [(1, 2)] * 40, "one": [(1, 1)], "two": [(1, 1), (2, 0)], "hot": [(1, r.randint(0, 90)) for _ in range(100)] + [(r.randint(0, 3), 5) for _ in range(60)]}
    rows = [(g, k, float(x), float(y)) for g, v in groups.items() for k, (x, y) in enumerate(v)] + [("two", 9, None, 1.0), ("two", 10, 1.0, float("nan"))]
    d = spark.createDataFrame(rows, "g string, k int, x double, y double").repartition(5)
    got = {x.g: x.tau for x in inversions.kendall(d, "k", "x", "y", ["g"], block).collect()}
    assert got == pytest.approx({g: tau(v) for g, v in groups.items() if len(v) > 1})
    assert inversions.kendall(d.limit(0), "k", "x", "y", ["g"], block).count() == 0


def test_numbering(spark):
    d = spark.createDataFrame([(k % 3, k * 7919 % 1000) for k in range(900)], "g int, v int").repartition(6)
    got = inversions.numbered(d, ["g"], ["v"], "n").collect()
    for g in range(3):
        some = sorted((r.n, r.v) for r in got if r.g == g)
        assert [n for n, _ in some] == list(range(300)) and [v for _, v in some] == sorted(v for _, v in some)


def test_latest_policy(spark):
    r = random.Random(6)
    host = lambda: ".".join("".join(r.choice("abc") for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 3)))
    docs = [(f"d{k:03}", host(), r.randint(0, 9)) for k in range(150)] + [("n", None, 5), ("e", "", 5), ("t", "tie.org", 3), ("s", "tie.org", 3)]
    names = [host() for _ in range(80)] + ["a", "ab", ".", "tie", "zzz", "", None, "e.or"]
    patterns = names + ["a%b", "_", "%", "a_c%", "t%.o"]
    like = lambda p, t: __import__("re").search("^.*" + "".join(".*" if c == "%" else "." if c == "_" else __import__("re").escape(c) for c in p) + ".*$", t) is not None
    d = spark.createDataFrame(docs, "doc_id string, domain string, created_at int")
    for asked, test, flag in ((names, lambda p, t: p in t, False), (patterns, like, True)):
        want = {}
        for p in asked:
            found = sorted((-c, i, t) for i, t, c in docs if p and t is not None and test(p, t))
            if found:
                want[p] = found[0][1:]
        e = spark.createDataFrame([(p,) for p in asked], "domain string")
        got = {x.domain: (x.policy_doc_id, x.policy_domain) for x in retrieval.latest_policy(e, d, flag).collect()}
        assert got == want
    plan = retrieval.latest_policy(e, d)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert retrieval.latest_policy(e.limit(0), d).count() == retrieval.latest_policy(e, d.limit(0)).count() == 0


def test_rank_sorts_stay_small_however_many_rows(spark):
    """The rows of a rank's task do not grow with the table; equal groups stay together, and rho is the same."""
    from consentry.operators import metrics as M
    from pyspark.sql import functions as F

    rows = spark.range(4000).select((F.col("id") % 1000).alias("unit"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"))
    d = M.dealt(rows, ["unit"], each=100)
    held = d.select("unit", F.spark_partition_id().alias("p")).distinct().collect()
    assert d.rdd.getNumPartitions() == 40 and len(held) == 1000 and len({r.p for r in held}) > 30
    ranked = M._ranked(d, "x", ["unit"], "rx")
    assert ranked.rdd.getNumPartitions() == 40
    assert sorted(map(tuple, ranked.collect())) == sorted(map(tuple, M._ranked(rows, "x", ["unit"], "rx").collect()))
