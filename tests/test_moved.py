"""What moves between tasks: no more of a statement than is read, vectors in their own type, index tasks of a fixed size."""

from pyspark.sql import functions as F

from consentry.operators import alignment, retrieval
from consentry.plans.inputs import frame


def test_statement_texts_stay_behind(spark, sf):
    events, docs, statements = (frame(spark, sf, p) for p in ("events", "docs", "statements"))
    met = retrieval.matched(events.where("event_id % 20 = 1"), docs)
    columns = ("event_id", "s_id", "rank", "score")
    whole, short = retrieval.hybrid(met, statements), retrieval.hybrid(met, statements, snippet=50)
    assert sorted(short.select(*columns).collect()) == sorted(whole.select(*columns).collect())
    assert whole.agg(F.max(F.length("s_snippet"))).first()[0] > 50 == short.agg(F.max(F.length("s_snippet"))).first()[0]


def test_index_tasks_follow_the_tokens(spark, sf):
    statements = frame(spark, sf, "statements").where("id < 60")
    own, dealt = retrieval.bm25_index(statements), retrieval.bm25_index(statements, each=50)
    assert sorted(own.withColumn("weight", F.round("weight", 9)).collect()) == sorted(dealt.withColumn("weight", F.round("weight", 9)).collect())
    assert dealt.rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_vectors_keep_their_type(spark, monkeypatch):
    rows = spark.createDataFrame([(1, ["a"] * 5 + ["b", "c"]), (2, ["d", "z"])], "id int, t array<string>")
    v = spark.createDataFrame([(w, [float(i), 0.5]) for i, w in enumerate("abcd")], "token string, vector array<float>")
    for most, often in ((10, 1000), (1, 1000), (1, 3), (1, 1)):
        monkeypatch.setattr(alignment, "MAX_BROADCAST_VECTORS", most)
        monkeypatch.setattr(alignment, "OFTEN", often)
        got = alignment.token_vectors(rows, "id", "t", v)
        assert got.schema["flat"].dataType.simpleString() == "array<float>"
        assert {r.id: (r.flat, r.width) for r in got.collect()} == {1: ([0.0, 0.5] * 5 + [1.0, 0.5, 2.0, 0.5], 2), 2: ([3.0, 0.5], 2)}
