"""The packed sequences follow the mixed order of the sources, through a written table."""

import random


def test_sources_hold_their_weights_in_prefixes(spark):
    import corpus_pipeline
    from consentry.llm import common

    r = random.Random(8)
    texts = [" ".join(r.choice(["the", "data", "model", "river", "stone"]) for _ in range(r.randint(600, 1000))) for _ in range(1000)]
    sources = {i: ["a", "b"][i % 2] if i % 10 == 0 or i % 10 == 5 else "hot" for i in range(1000)}
    d = spark.createDataFrame([(i, t, sources[i]) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    mixed = common.stored(corpus_pipeline.mix(spark, d, ""), "test-mixed")
    order = {row.doc_id: row.mix_order for row in mixed.collect()}
    pieces = sorted(corpus_pipeline.pack(spark, mixed, "").collect(), key=lambda p: p.sequence_id)
    assert {p.doc_id for p in pieces} == set(range(1000))
    tasks = {}
    for p in pieces:
        tasks.setdefault(p.sequence_id >> 36, []).append(order[p.doc_id])
    bounds = [(min(x), max(x)) for _, x in sorted(tasks.items())]
    assert len(bounds) > 1 and all(a[1] < b[0] for a, b in zip(bounds, bounds[1:]))
    total = sum(p.length for p in pieces)
    for part in (0.1, 0.15, 0.2, 0.25):
        taken, at = {"hot": 0, "a": 0, "b": 0}, 0
        for p in pieces:
            if at < part * total:
                taken[sources[p.doc_id]] += p.length
                at += p.length
        # weights are square roots of 0.8, 0.1 and 0.1; a source is less than a block of 65536 characters from its share
        assert abs(taken["hot"] / at - 0.586) < 0.12
