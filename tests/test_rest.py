"""Readers of further corpora, lookups and injected encoders on small inputs."""

import json
import math

import pytest
from pyspark.sql import functions as F

from consentry.functions import text as X
from consentry.operators import features
from consentry.sources import readers


def test_lookup_of_a_missing_row(spark):
    d = spark.createDataFrame([(1, "a")], "id long, v string")
    assert readers.lookup(d, "id", 1).v == "a"
    with pytest.raises(ValueError):
        readers.lookup(d, "id", 2)


def test_policy_texts(spark, tmp_path):
    (tmp_path / "train.txt").write_text("one\n\ntwo\n")
    (tmp_path / "dev.json").write_text(json.dumps([{"text": "three"}, {"sentence": "four"}, {"x": 5}]))
    (tmp_path / "test.jsonl").write_text('{"sentence": "six"}\n')
    got = {tuple(r) for r in readers.policy_texts(spark, str(tmp_path)).collect()}
    assert got == {("train", "one"), ("train", "two"), ("dev", "three"), ("dev", "four"), ("dev", '{"x":5}'), ("test", "six")}


def test_joined_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("q,what is\n")
    (tmp_path / "b.jsonl").write_text('{"q": "who", "a": "me"}\n')
    assert {r.text for r in readers.joined_lines(spark, str(tmp_path)).collect()} == {"q what is", "who me"}


def test_paragraphs_or_lines(spark, tmp_path):
    (tmp_path / "p.md").write_text("x" * 60 + "\n\nshort\n\n" + "y" * 51)
    assert sorted(len(r.text) for r in readers.paragraphs_or_lines(spark, str(tmp_path)).collect()) == [51, 60]
    (tmp_path / "c.csv").write_text("z" * 70 + "\nno\n")
    assert [len(r.text) for r in readers.paragraphs_or_lines(spark, str(tmp_path)).collect()] == [70]


def test_texts_are_encoded_once(spark):
    d = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, None)], "id long, t string")

    def factory():
        return lambda texts: [[float(len(x))] for x in texts]

    assert {r.id: r.v for r in features.encoded(d, "t", "v", factory).collect()} == {1: [2.0], 2: [2.0], 3: [0.0]}


def test_gamma_functions(spark):
    d = spark.createDataFrame([(x,) for x in (0.01, 0.5, 1.0, 2.5, 40.0, 1e4)], "x double")
    for r in d.select("x", features.log_gamma(F.col("x")).alias("g"), features.digamma(F.col("x")).alias("p")).collect():
        h = 1e-5 * max(r.x, 0.1)
        assert r.g == pytest.approx(math.lgamma(r.x), rel=1e-9, abs=1e-9)
        assert r.p == pytest.approx((math.lgamma(r.x + h) - math.lgamma(r.x - h)) / (2 * h), rel=1e-4)


def test_offsets_of_many_matches(spark):
    t = " ".join(f"é user{k}@example.com" for k in range(60))
    (found,) = spark.createDataFrame([(t,)], "t string").select(X.entities(F.col("t")).alias("e")).first()
    assert len(found) == 60 and all(t[e.start : e.end] == e.value for e in found)


def test_evidence_ids_need_a_colon(spark):
    d = spark.createDataFrame([(1, ["7:3", "3", "x:y", "a:4:5"])], "decision_id long, evidence_ids array<string>")
    s = spark.createDataFrame([(3,), (4,)], "id long")
    assert [r.policy_statement_id for r in readers.evidence_rows(d, s).collect()] == [3]
