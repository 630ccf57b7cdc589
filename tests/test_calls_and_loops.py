"""Calls with a log, retries and refusals; the guess loop, the refining loop and configuration runs against plain loops."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from consentry.functions import risk as R
from consentry.functions import text as X
from consentry.operators import alignment, anonymize, calls, guessing, paths
from consentry.sources import shared


def _noting(folder):
    """A factory whose client notes every call as a file."""

    def factory(attempt):
        def answer(prompt):
            with open(os.path.join(folder, f"{prompt}-{attempt}-{os.urandom(4).hex()}"), "w"):
                pass
            if prompt == "refused":
                raise PermissionError
            if prompt == "late" and attempt < 3:
                raise TimeoutError
            if prompt == "never":
                raise ConnectionError
            return "bad" if prompt == "odd" else None if prompt == "none" else f"to {prompt}"

        return answer

    return factory


def test_calls_are_logged_and_not_repeated(spark, tmp_path):
    folder, waits = tmp_path / "calls", []
    folder.mkdir()
    rows = spark.createDataFrame([(k, p) for k, p in enumerate(["a", "b", "a", "late", "refused", "never", "odd", "none", None])], "k int, p string")
    options = {"attempts": 4, "valid": lambda x: x != "bad", "wait": waits.append, "slice_rows": 2}
    got = {r.k: (r.answer, r.error, r.attempts) for r in calls.ask(rows, "p", _noting(str(folder)), str(tmp_path / "log"), **options).collect()}
    assert got == {0: ("to a", None, 1), 1: ("to b", None, 1), 2: ("to a", None, 1), 3: ("to late", None, 3), 4: (None, "PermissionError", 1), 5: (None, "ConnectionError", 4), 6: (None, "InvalidAnswer", 4), 7: (None, "InvalidAnswer", 4), 8: (None, None, None)}
    assert waits == [2.0, 4.0, 8.0]
    count = lambda p: sum(f.startswith(f"{p}-") for f in os.listdir(folder))
    assert (count("a"), count("late"), count("refused"), count("never")) == (1, 3, 1, 4)
    more = rows.unionByName(spark.createDataFrame([(9, "new")], "k int, p string"))
    again = {r.k: r.answer for r in calls.ask(more, "p", _noting(str(folder)), str(tmp_path / "log"), **options).collect()}
    assert again[9] == "to new" and again[0] == "to a"
    assert (count("a"), count("late"), count("refused"), count("never"), count("new")) == (1, 3, 1, 4, 1)
    assert calls.ask(rows.limit(0), "p", _noting(str(folder)), str(tmp_path / "other"), **options).count() == 0


def test_a_slice_that_was_lost_is_asked_alone(spark, tmp_path):
    """What the log has of an attempt stays; only the rest of that attempt is asked."""
    folder = tmp_path / "calls"
    folder.mkdir()
    rows = spark.createDataFrame([("a",), ("b",), ("late",)], "p string")
    seen = [("a", 1, "to a", None), ("late", 1, None, "TimeoutError")]
    spark.createDataFrame([(p, n, a, e, 0.0) for p, n, a, e in seen], "p string, attempt int, answer string, error string, seconds double").select(calls.key(F.col("p")).alias("key"), "attempt", "answer", "error", "seconds").write.parquet(str(tmp_path / "log"))
    got = {r.p: r.attempts for r in calls.ask(rows, "p", _noting(str(folder)), str(tmp_path / "log"), wait=lambda s: None).collect()}
    assert got == {"a": 1, "b": 1, "late": 3}
    assert sorted(f.rsplit("-", 1)[0] for f in os.listdir(folder)) == ["b-1", "late-2", "late-3"]


def test_slices_read_their_own_prompts_and_rows_without_one_are_spread(spark, tmp_path, monkeypatch):
    """However many prompts there are, the rows are computed a fixed number of times; null prompts meet in more than one task."""
    seen = spark.sparkContext.accumulator(0)

    def noted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    def answer(attempt):
        return lambda p: f"to {p}"

    work = []
    for n, rows in ((40, 1), (400, 1)):
        before = seen.value
        d = spark.range(n).selectExpr("id", "case when id % 2 = 0 then concat('p', id) end as p").mapInArrow(noted, "id long, p string")
        got = calls.ask(d, "p", answer, str(tmp_path / f"log{n}"), slice_rows=rows, wait=lambda s: None)
        assert {(r.p, r.answer) for r in got.where("p is not null").collect()} == {(f"p{i}", f"to p{i}") for i in range(0, n, 2)}
        work.append((seen.value - before) / n)
    assert work[0] == work[1] <= 4, work
    nulls = got.where("p is null").select(F.spark_partition_id().alias("t")).groupBy("t").count().collect()
    assert len(nulls) > 1 and sum(r["count"] for r in nulls) == 200


def test_ratings_and_likelihoods(spark):
    answers = ['```json\n{"privacy": 9, "utility": 0, "fluency": "3"}\n```', '<think>{"privacy": 1}</think>{"privacy": 2.9}', "no", '{"privacy": "high"}', None, '{"likelihood": 0.25}', '{"likelihood": "x"}']
    got = [tuple(r.r) if r.r else None for r in spark.createDataFrame([(a,) for a in answers], "a string").select(calls.rated(F.col("a")).alias("r")).collect()]
    assert got[:5] == [(5, 1, 3), (2, 1, 1), None, None, None]
    likely = [r[0] for r in spark.createDataFrame([(a,) for a in answers], "a string").select(calls.likelihood(F.col("a"))).collect()]
    assert likely[4:] == [0.5, 0.25, 0.5] and likely[2] == 0.5


def test_guesses_with_and_without_an_original(spark):
    a = json.dumps({"guesses": [{"guess": "Sydney", "confidence": 0.5}, {"guess": "rome", "confidence": 0.95}], "max_confidence": 0.7})
    low = json.dumps({"guesses": [{"guess": "rome", "confidence": 0.95}], "max_confidence": 0.99})
    rows = spark.createDataFrame([(a,), (low,), ("broken",), (None,), ('{"max_confidence": 0.8}',)], "a string")
    show = lambda g: [(r.g.verified, r.g.confidence, r.g.can_identify) for r in rows.select(g.alias("g")).collect()]
    o = F.lit("I live in sydney.")
    assert show(guessing.guessed(F.col("a"), o)) == [(1, 0.7, True), (0, 0.0, False), (0, 0.0, False), (0, 0.0, False), (0, 0.0, False)]
    assert show(guessing.guessed(F.col("a"))) == [(2, 0.95, True), (1, 0.99, True), (0, 0.0, False), (0, 0.0, False), (0, 0.8, True)]
    assert show(guessing.guessed(F.col("a"), o, guessing.verifier("off")))[1] == (1, 0.99, True)
    assert show(guessing.guessed(F.col("a"), o, guessing.verifier("semantic", lambda g, t: F.length(g) == 4)))[0] == (1, 0.95, True)
    assert show(guessing.guessed(F.col("a"), o, guessing.verifier("semantic")))[0] == (1, 0.7, True)
    with pytest.raises(ValueError):
        guessing.verifier("other")


TEXTS = ["write to ann@example.org now", "call 555-123-4567 or ann@example.org", "nothing at all", "", None, "echo bob@example.com", "key AKIA0123456789ABCD and 4532 1234 5678 9012"]


def _clients():
    # nested, so that workers get them by value
    def guess(attempt):
        def answer(prompt):
            text = prompt.split('"')[1]
            if "level 4" in text or "***" in text or "..." in text:
                return json.dumps({"guesses": [{"guess": "now or at key echo call write", "confidence": 0.8}]})
            if "nothing" in text:
                raise PermissionError
            return json.dumps({"guesses": [{"guess": "qqqq", "confidence": 0.9}], "max_confidence": 0.9})

        return answer

    def rewrite(attempt):
        def answer(prompt):
            level, text = prompt[19], prompt.split('"')[1]
            return json.dumps({"anonymized": text if text.startswith("echo") else f"someone writes, level {level}"})

        return answer

    return guess, rewrite


_guess, _rewrite = _clients()


def _identified(text, original):
    if "nothing" in text or not ("level 4" in text or "***" in text or "..." in text):
        return False
    words = {w for w in original.lower().split() if len(w) > 2}
    return bool(words & {"now", "key", "echo", "call", "write"})


@pytest.mark.parametrize(("cap", "most", "rewrites"), [(3, 5, False), (5, 5, True), (5, 2, True), (2, 3, False), (4, 1, True)])
def test_loop_is_the_plain_loop(spark, tmp_path, cap, most, rewrites):
    rows = spark.createDataFrame([(i, t, k) for i, t in enumerate(TEXTS) for k in range(1, 5)], "id int, text string, start int")
    masks = {(r.id, r.start): (None, *r[3:]) for r in rows.select("*", *(X.rewrite(F.col("text"), X.entities(F.col("text")), k).alias(f"l{k}") for k in (1, 2, 3))).collect()}
    got = guessing.loop(rows, F.col("start"), _guess, str(tmp_path / "log"), cap=cap, max_rounds=most, rewriter=_rewrite if rewrites else None, wait=lambda s: None).collect()
    assert len(got) == len(masks)
    for r in got:
        text = r.text or ""
        level = first = min(r.start, cap)
        guesses = 0
        for n in range(1, most + 1):  # noqa: B007
            out = masks[r.id, r.start][min(level, 3)]
            if rewrites and level >= 4 and not text.startswith("echo"):
                out = f"someone writes, level {level}"
            if level >= cap:
                break
            guesses += 1
            if not _identified(out, text):
                break
            level += 1
        assert (r.anonymized, r.initial_level, r.final_level, r.rounds, r.guesses, r.upgraded) == (out, first, level, n, guesses, level > first), r
    assert guessing.loop(rows.limit(0), F.col("start"), _guess, str(tmp_path / "none"), wait=lambda s: None).count() == 0


def _stored(folder):
    return sum(os.path.getsize(os.path.join(a, f)) for a, _, files in os.walk(folder) for f in files)


def test_a_loop_stores_a_text_few_times(spark, tmp_path, monkeypatch):
    """Texts are stored at the level they have, where that differs from the original, and their prompts go when answered."""
    monkeypatch.setattr(shared, "folder", lambda s: f"file://{tmp_path}/shared")
    rows = spark.range(200).selectExpr("id", "concat_ws(' ', transform(sequence(1, 100), k -> sha2(concat(id, '-', k), 256))) as text", "cast(1 + id % 3 as int) as start").persist()
    size = rows.selectExpr("sum(length(text))").first()[0] * 0.6  # hexadecimal digits: half a byte each when compressed
    got = guessing.loop(rows, F.col("start"), _guess, str(tmp_path / "log"), wait=lambda s: None)
    assert got.where("anonymized = text and not upgraded").count() == 200
    assert _stored(tmp_path / "shared") < 2.5 * size
    rows.unpersist()


def test_a_level_of_its_own_is_that_of_all_levels(spark):
    """Texts masked at one level are those of levels(), levels out of bounds at the nearest; nothing is lost by packing."""
    rows = spark.createDataFrame([(i, t, k) for i, t in enumerate([*TEXTS, "[PHONE] [PHONE] , x", "  two   blanks "]) for k in range(6)], "id int, text string, k int")
    x = anonymize.levels(rows).withColumn("want", F.element_at(F.array("l1", "l2", "l3"), F.least(F.greatest("k", F.lit(1)), F.lit(3)))).drop("l1", "l2", "l3", "entities")
    got = anonymize.masked(x, F.col("k"))
    assert got.where("not (anonymized <=> want)").count() == 0 and got.count() == 54
    packed = guessing._packed(got.withColumn("anonymized", F.when(F.col("k") == 5, None).otherwise(F.col("anonymized"))), "text")
    assert packed.where((F.col("k") == 5) & guessing._unpacked("text").isNotNull() & F.col("text").isNotNull()).count() == 0
    assert packed.where((F.col("k") < 5) & ~guessing._unpacked("text").eqNullSafe(F.col("want"))).count() == 0


def test_refining_ends_when_nothing_changes(spark, tmp_path):
    def infer(attempt):
        return lambda p: json.dumps({"inferences": [{"type": "place", "inference": "x" * 500, "guess": "g"}] * 7}) if "stop" not in p else "unreadable"

    def rewrite(attempt):
        def answer(prompt):
            text = prompt.split("\n\n")[1]
            assert prompt.count("Type: place") <= 5
            if text.startswith("raw"):
                return "why\n#\nraw done"
            if text.startswith("fail"):
                raise PermissionError
            return json.dumps({"rewritten": text[:-1] if not text.startswith("stop") else text})

        return answer

    rows = spark.createDataFrame([(0, "abcdef"), (1, "stop here"), (2, "raw text"), (3, "fail text"), (4, None)], "id int, text string")
    got = {r.id: (r.anonymized, r.rounds, r.upgraded) for r in guessing.refined(rows, "text", infer, rewrite, str(tmp_path / "log"), wait=lambda s: None).collect()}
    assert got == {0: ("abc", 3, True), 1: ("stop here", 1, False), 2: ("raw done", 2, True), 3: ("fail text", 1, False), 4: ("", 1, False)}


def test_configurations_and_mergeable_quantiles(spark, tmp_path):
    rows = spark.createDataFrame([(i, TEXTS[i % len(TEXTS)], (i % 10) / 10, ["ann", "4567"]) for i in range(70)], "sample_id int, text string, risk_score double, sensitive_fields array<string>")
    runs = {"A": paths.masked_only(), "B": paths.guessed(_guess, str(tmp_path / "b"), wait=lambda s: None), "C": paths.rewritten(_rewrite, str(tmp_path / "c"), wait=lambda s: None), "D": paths.guessed(_guess, str(tmp_path / "d"), cap=5, max_rounds=5, rewriter=_rewrite, wait=lambda s: None)}
    failed = lambda name: F.when((F.lit(name) == "A") & (F.col("sample_id") % 7 == 0), "TimeoutError")
    r = paths.results(rows, runs, failed).toPandas()
    assert len(r) == 280 and (r[r["error"].notna()]["level"] == 0).all() and r["error"].notna().sum() == 10
    a = r[(r["config"] == "A") & r["error"].isna()]
    assert set(a["level"]) == {1, 2, 3} and not a["upgraded"].any()
    assert (r[r["config"] == "C"]["anonymized"].str.startswith("someone").sum()) > 40
    assert r[r["config"] == "D"]["upgraded"].any()
    assert ((r["privacy"] >= 0) & (r["privacy"] <= 1) & (r["utility"] >= 0) & (r["utility"] <= 1)).all()
    for k in (1, 2):
        got = paths.benchmark(rows, {"A": runs["A"]}, str(tmp_path / "t"), f"run{k}", failed).first()
        assert (got.n, got.errors) == (70 * k, 10 * k)
    whole = r[r["config"] == "A"]
    assert got.avg_level == pytest.approx(whole["level"].mean()) and got.avg_utility == pytest.approx(whole["utility"].mean())
    # two runs merged: the sketch's quantile is one of the values around the exact one
    both = np.sort(np.concatenate([whole["utility"]] * 2))
    assert both[int(0.45 * len(both))] <= got.utility_p50 <= both[int(0.55 * len(both))]


def test_a_benchmark_stores_sums_only(spark, tmp_path, monkeypatch):
    """What the configurations give is summed as it comes; only the table of sums is written."""
    monkeypatch.setattr(shared, "folder", lambda s: f"file://{tmp_path}/shared")
    rows = spark.createDataFrame([(i, TEXTS[i % len(TEXTS)], (i % 10) / 10, ["ann"]) for i in range(20)], "sample_id int, text string, risk_score double, sensitive_fields array<string>")
    assert paths.benchmark(rows, {"A": paths.masked_only()}, str(tmp_path / "t"), "run").first().n == 20
    assert _stored(tmp_path / "shared") == 0 and _stored(tmp_path / "t") > 0


def test_levels_of_a_risk(spark):
    got = [r[0] for r in spark.createDataFrame([(0.1,), (0.5,), (0.7,), (0.9,)], "r double").select(R.level(F.col("r"))).collect()]
    assert got == [1, 2, 3, 4]


def test_greedy_matching(spark, monkeypatch):
    r = np.random.default_rng(2)
    words = [f"w{k}" for k in range(30)]
    vectors = {w: r.normal(size=6) for w in words} | {"zero": np.zeros(6)}
    texts = [(k, [str(w) for w in r.choice([*words, "zero", "unknown"], n)], [str(w) for w in r.choice([*words, "unknown"], m)]) for k, (n, m) in enumerate([(5, 7), (1, 1), (0, 4), (40, 3), (2500, 1200), (3, 0)])]
    texts.append((9, ["unknown"], ["w1"]))

    def plain(a, b):
        a, b = ([vectors[w] for w in x if w in vectors] for x in (a, b))
        if not a or not b:
            return 0.0, 0.0, 0.0
        unit = lambda x: np.array([v / (np.linalg.norm(v) or 1.0) for v in x])
        s = unit(a) @ unit(b).T
        p, q = s.max(1).mean(), s.max(0).mean()
        return p, q, 2 * p * q / (p + q) if p + q > 0 else 0.0

    rows = spark.createDataFrame(texts, "id int, a array<string>, b array<string>")
    v = spark.createDataFrame([(w, [float(x) for x in y]) for w, y in vectors.items()] + [("none", None)], "token string, vector array<double>")
    for most in (alignment.MAX_BROADCAST_VECTORS, 3):
        monkeypatch.setattr(alignment, "MAX_BROADCAST_VECTORS", most)
        got = {r.id: (r.precision, r.recall, r.f1) for r in alignment.greedy_scores(rows, "id", "a", "b", v).collect()}
        assert got.keys() == {t[0] for t in texts}
        for k, a, b in texts:
            assert got[k] == pytest.approx(plain(a, b), abs=1e-9)
    assert alignment.greedy_scores(rows.limit(0), "id", "a", "b", v).count() == 0
