"""The data source of annotated policies: folds per file, partitions, pushed filters; logs of feedback and behaviours."""

import csv

import pytest
from pyspark.sql import functions as F

from consentry.functions import tables as T
from consentry.sources import corpora, readers


@pytest.fixture
def folder(tmp_path):
    files = {
        "one": [["1", "We Collect things"], ["2", "your EMAIL, \"and\"\ngps"], ["3", "location use for marketing"], ["4", "health left over"]],
        "sub/two": [["1", "share bank data with analytics"], ["2", "nothing"], ["3", "ip address"], ["4", "legal disclosure"]],
        "empty": [],
    }
    for name, rows in files.items():
        path = tmp_path / "corpus" / f"{name}.csv"
        path.parent.mkdir(parents=True, exist_ok=True)
        with open(path, "w", newline="") as f:
            csv.writer(f).writerows(rows)
    (tmp_path / "corpus" / "note.txt").write_text("collect email")
    return str(tmp_path / "corpus")


def test_items(spark, folder):
    d = corpora.policy_items(spark, folder)
    got = sorted(tuple(r) for r in d.collect())
    assert got == [
        ("one", 0, ["Contact", "Location"], ["Collect"], []), ("one", 1, ["Location"], ["Use"], ["Marketing"]),
        ("two", 0, ["Financial"], ["Share"], ["Analytics"]), ("two", 1, ["Contact", "IPAddress"], ["Share"], ["Legal"]),
    ]
    assert d.rdd.getNumPartitions() == 3
    with pytest.raises(Exception, match="path"):
        spark.read.format("policy_items").load().count()


def test_filters_choose_files(spark, folder):
    d = corpora.policy_items(spark, folder)
    assert [r.file for r in d.where("file = 'two'").collect()] == ["two"] * 2
    assert d.where("file = 'two'").rdd.getNumPartitions() == 1
    assert d.where("file in ('one', 'empty') and item > 0").count() == 1
    assert d.where("file like 'o%'").count() == 2 and d.where("file = 'none'").count() == 0


def test_contrastive_behaviours(spark):
    items = spark.createDataFrame([(1, ["Contact"]), (2, T.VOCAB_DATA)], "id int, data_categories array<string>")
    got = corpora.contrastive(items, F.col("id")).collect()
    assert sorted((r.id, r.label, len(r.behaviour)) for r in got) == [(1, 0, 1), (1, 1, 1), (2, 0, len(T.VOCAB_DATA))]
    assert all((r.behaviour[0] in r.data_categories) == (r.label == 0) for r in got)


def test_logs(spark, tmp_path):
    rows = spark.createDataFrame([("allow", 0), ("ask", None), ("deny", 1)], "teacher_decision string, target_label int")
    for _ in range(2):
        readers.append_feedback(rows, f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == readers.feedback(spark, f"{tmp_path}/log").count() == 4
    lines = '{"domain": "a.org", "behavior": {"data_categories": ["Health"]}, "statement_id": 7}\n\n  \n{"domain": "b.org"}\n'
    (tmp_path / "b.jsonl").write_text(lines)
    got = readers.behaviours(spark, f"{tmp_path}/b.jsonl").orderBy("domain").collect()
    assert [(r.domain, r.statement_id, r.behavior and r.behavior.data_categories) for r in got] == [("a.org", 7, ["Health"]), ("b.org", None, None)]
