"""Readers on small files: what is broken, missing or out of range is left out as documented."""

import json

import pytest

from consentry.sources import readers as S


def test_annotations(spark, tmp_path):
    attr = json.dumps({"Type": {"value": "Contact", "selectedText": "your email"}, "Mode": {"value": "not-selected", "selectedText": "x"}, "Other": {"value": "Health", "selectedText": "null"}})
    rows = [["1", "b", "a", "p", "0", S.CATEGORIES[0], attr], ["x", "b", "a", "p", "0", S.CATEGORIES[0], attr], ["2", "b", "a", "p", "1", "Unheard", attr], ["3", "b", "a", "p", "2", S.CATEGORIES[1], "{broken"]]
    text = "\n".join(",".join('"' + c.replace('"', '""') + '"' for c in r) for r in rows)
    (tmp_path / "site.csv").write_text(text)
    got = sorted((r.policy, r.annotation_id, r.attribute or "", r.value, r.text) for r in S.annotations(spark, f"{tmp_path}/site.csv").collect())
    assert got == [("site", 1, "Other", "Health", None), ("site", 1, "Type", "Contact", "your email"), ("site", 3, "", None, None)]
    g = S.grouped_annotations(S.annotations(spark, f"{tmp_path}/site.csv"), {S.CATEGORIES[0]: "Collect"}).collect()
    assert [(r.segment, r.data_categories, r.actions) for r in g] == [(0, ["Contact", "Health"], ["Collect"])]


def test_accumulated_items(spark):
    rows = [("p", 0, "we collect things"), ("p", 1, "your email"), ("p", 2, "your location"), ("p", 3, "we share it"), ("p", 4, "email left over")]
    got = S.accumulated(spark.createDataFrame(rows, "p string, n int, t string"), "p", "n", "t").orderBy("item").collect()
    assert [(r.item, r.data_categories, r.actions) for r in got] == [(0, ["Contact"], ["Collect"]), (1, ["Location"], ["Share"])]


def test_paragraphs(spark):
    text = "a" * 60 + "\n\n" + "short" + "\n\n" + "b" * 70
    d = spark.createDataFrame([(1, text)], "id int, t string")
    p = S.paragraphs(d, "id", "t")
    assert [(r.paragraph, r.start, len(r.text)) for r in p.orderBy("start").collect()] == [(0, 0, 60), (2, 69, 70)]


def test_questions(spark, tmp_path):
    doc = {"data": [{"title": "t", "paragraphs": [{"context": "c", "qas": [{"id": "1", "question": "q", "type": "Cat|||Attr|||Val"}]}]}]}
    (tmp_path / "q.json").write_text(json.dumps(doc, indent=1))
    assert [tuple(r) for r in S.questions(spark, f"{tmp_path}/q.json").collect()] == [("c", "q", "Cat")]


def test_relevance(spark, tmp_path):
    head = ["Folder", "DocID", "QueryID", "SentID", "Split", "Query", "Segment", "Any_Relevant", *(f"Ann{k}" for k in range(1, 7))]
    rows = [["f", "d", "1", "1", "test", "q", "s1", "Relevant", *["None"] * 6], ["f", "d", "1", "2", "test", "q", "s2", "", "Relevant", "Relevant", "Irrelevant", "None", "None", "None"], ["f", "d", "1", "3", "test", "q", "s3", "", "Relevant", "Irrelevant", "None", "None", "None", "None"], ["f", "d", "1", "4", "train", "q", "s4", "Relevant", *["None"] * 6]]
    (tmp_path / "r.tsv").write_text("\n".join("\t".join(r) for r in [head, *rows]))
    assert {r.segment: r.gold for r in S.relevance(spark, f"{tmp_path}/r.tsv").collect()} == {"s1": "Relevant", "s2": "Relevant", "s3": "Irrelevant"}


def test_synthetic_profiles(spark):
    rows = [({"sex": "male", "city_country": "Paris, France"}, "f", 5, "q", "I am in paris.", "g"), ({"sex": "female"}, "f", 1, "q", "", "g")]
    got = S.synthetic_profiles(spark.createDataFrame(rows, S.SYNTH)).collect()
    assert [(r.risk_score, r.sensitive_fields) for r in got] == [(0.95, ["Paris"])]


def test_events_or_rules(spark):
    rows = [("any", [("collect",), ("nothing",)]), ("we may share this data with others today", None), ("short", None)]
    d = spark.createDataFrame(rows, "text string, event_mentions array<struct<event_type:string>>")
    assert sorted(tuple(r) for r in S.events_or_rules(d, {"collect": S.CATEGORIES[0]}).collect()) == [("any", S.CATEGORIES[0]), ("we may share this data with others today", S.CATEGORIES[1])]


def test_masked_texts(spark):
    rows = [(1, "English", "x" * 100, [("B", "v"), ("A", "v"), ("A", "w")]), (2, "German", "x" * 100, [("A", "v")]), (3, "English", "short", [("A", "v")]), (4, "English", "x" * 100, None)]
    d = spark.createDataFrame(rows, "id int, language string, source_text string, privacy_mask array<struct<label:string,value:string>>")
    assert [(r.id, r.sensitive_fields, r.category) for r in S.masked_texts(d, 5).collect()] == [(1, ["v", "w"], "A|B")]


def test_logs(spark, tmp_path):
    rows = spark.createDataFrame([("allow", 0), ("ask", None)], "teacher_decision string, target_label int")
    S.append_json(rows, f"{tmp_path}/log")
    S.append_json(rows, f"{tmp_path}/log")
    assert S.feedback(spark, f"{tmp_path}/log").count() == 2
    assert S.to_markdown(rows.limit(1)).splitlines()[0] == "| teacher_decision | target_label |"
    with pytest.raises(ValueError):
        S.to_markdown(rows, most=1)
