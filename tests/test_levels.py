"""Adaptive rewriting up to level 5 against the plain loop over rounds."""

import json
import time

import pytest
from pyspark.sql import functions as F

from consentry.functions import text as X
from consentry.operators import anonymize

TEXTS = ["write to ann@example.org now", "call 555-123-4567 or ann@example.org", "nothing at all", "", "echo bob@example.com", "keep bob@example.net"]


def _factory():
    # nested, so that workers get it by value
    def client():
        def answer(prompt):
            level, text = prompt[19], prompt.split('"')[1]
            if text.startswith("echo"):
                return json.dumps({"anonymized": text})
            if text.startswith("keep"):
                return "no json" if level == "4" else json.dumps({"anonymized": f"{text} still"})
            return json.dumps({"anonymized": f"someone writes, level {level}"})

        return answer

    return client


def _plain(masked, text, first, unsafe, cap, most):
    level, n = min(first, cap), 0
    first, out = level, None
    while n < most:
        out = masked[min(level, 3)]
        if level >= 4 and not text.startswith(("echo", "keep")):
            out = f"someone writes, level {level}"
        n += 1
        if level >= cap or not unsafe(out):
            break
        level += 1
    return first, level, out, n, level > first


@pytest.mark.parametrize(("cap", "most", "word"), [(5, 5, "e"), (5, 2, ""), (4, 5, "level 4"), (3, 3, "e")])
def test_levels_up_to_five(spark, cap, most, word):
    rows = spark.createDataFrame([(i, t, k) for i, t in enumerate(TEXTS) for k in range(1, 5)], "id int, text string, start int")
    rows, answers = anonymize.ask_rewrites(rows, "text", _factory())
    x = anonymize.adaptive(rows, F.col("start"), lambda t: F.contains(t, F.lit(word)), cap=cap, max_rounds=most, rewrites=answers)
    got = x.select("text", "start", "l1", "l2", "l3", "initial_level", "final_level", "anonymized", "rounds", "upgraded").collect()
    assert len(got) == 4 * len(TEXTS)
    for r in got:
        assert tuple(r[5:]) == _plain((None, *r[2:5]), r.text, r.start, lambda t: word in t, cap, most), r


def test_levels_of_many_entities_share_their_parts(spark):
    """All three levels of texts with many entities cost less than twice one spliced level, and are the same; so are overlapping and missing ones."""
    kind = "array<struct<start:int,end:int,type:string,value:string,granularity:int>>"
    long = spark.range(4).selectExpr("concat_ws(' ', transform(sequence(1, 2500), k -> concat('word é ', id, ' ann', k, '@example.org and some more words'))) as text").persist()
    long.count()
    e = X.entities(F.col("text"))
    three = long.select(X.let(e, lambda f: X.rewrites(F.col("text"), f, lambda at: F.array(at(1), at(2), at(3)))).alias("x"))
    one = long.select(X.let(e, lambda f: F.array(X.rewrite(F.col("text"), f, 2))).alias("x"))
    took = []
    for d in (three, one):
        began = time.perf_counter()
        got = d.collect()
        took.append(time.perf_counter() - began)
        two = {r.x[len(r.x) // 2] for r in got} if d is one else {r.x[1] for r in got}
        took.append(two)
    assert took[1] == took[3] and took[0] < 2 * took[2]
    long.unpersist()
    at = lambda a, b, t="PERSON": (a, b, t, "ab cd", 1)
    rows = [("ab cd, ef gh é", []), ("ab cd, ef gh é", [at(0, 5), at(7, 9)]), ("ab cd, ef gh é", [at(7, 9), at(0, 5), at(12, 14)]), ("ab cd, ef", [at(0, 5), at(3, 9)]), ("ab cd", [at(0, 5), at(0, 5)]), ("ab cd", [at(2, 2), at(2, 5)]), (None, []), ("ab cd ef", [at(0, 2, "DATE"), at(3, 5, "DATE")]), ("ab", [at(0, 2, None)])]
    d = spark.createDataFrame(rows, f"text string, e {kind}")
    got = d.select(X.rewrites(F.col("text"), F.col("e"), lambda lvl: F.array(lvl(1), lvl(2), lvl(3))).alias("a"), F.array(*[X.rewrite(F.col("text"), F.col("e"), k) for k in (1, 2, 3)]).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got]
