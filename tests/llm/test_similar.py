"""The pipeline's near-duplicates against all pairs of exact similarities."""

import random

import pytest

from consentry.llm import similar


def brute(pairs):
    """Ids that stay: the least of each group linked by a similarity of five-word shingles of 0.8 or more."""

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t in pairs]
    root = list(range(len(pairs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(pairs):
        least[find(i)] = min(least.get(find(i), k), k)
    return set(least.values())


def _edited(r, words, n):
    out = list(words)
    for at in r.sample(range(len(out)), n):
        out[at] = f"new{r.randrange(10**9)}"
    return " ".join(out)


@pytest.mark.parametrize("bits", [similar.MOST_BITS, 1 << 10])
def test_near_copies_go_and_others_stay(spark, bits, monkeypatch):
    """With the table of bits that keeps others from being shuffled, and with one so small that it keeps hardly any."""
    import corpus_pipeline

    monkeypatch.setattr(similar, "MOST_BITS", bits)
    r = random.Random(6)
    texts = [None, "", " \n", "one two", "One  two", "one two three"]
    for n in (6, 9, 20, 120, 500):
        for _ in range(6):
            base = [f"w{r.randrange(3000)}" for _ in range(n)]
            texts += [_edited(r, base, k) for k in (0, 1, 1, 2, 3, 4, 6, 9) if k <= n // 3]
    passage = " ".join(f"common{k}" for k in range(40))
    texts += [f"{passage} {' '.join(f'x{r.randrange(10**6)}' for _ in range(r.randint(1, 30)))}" for _ in range(200)]
    pairs = [(i, t or "") for i, t in enumerate(texts)]
    r.shuffle(pairs)
    d = spark.createDataFrame([(i, texts[i], "s") for i, _ in pairs], "doc_id long, text string, source string").repartition(3)
    kept = corpus_pipeline.near_dedup(spark, d, "")
    assert kept.columns == d.columns
    got = [row.doc_id for row in kept.collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(pairs)


def test_slices_find_the_same_links(spark, monkeypatch):
    """Pairs compared in many slices, one after the other."""
    r = random.Random(7)
    texts = [_edited(r, [f"w{r.randrange(50)}" for _ in range(80)], 0) for _ in range(5)]
    texts += [_edited(r, t.split(), k) for t in texts for k in (1, 1, 2, 2, 3)]
    pairs = list(enumerate(texts))
    whole, slices = similar._verified, []
    monkeypatch.setattr(similar, "_verified", lambda *a, **o: slices.append(1) or whole(*a, **o, least=2000))
    got = {row.doc_id for row in similar.keep_first(spark.createDataFrame(pairs, "doc_id long, text string")).collect()}
    assert got == brute(pairs) and slices


def test_near_copies_of_the_tables(spark, sf):
    import corpus_pipeline
    from consentry.llm import common

    d = common.documents(spark, sf)
    assert {row.doc_id for row in corpus_pipeline.near_dedup(spark, d, sf).collect()} == brute([(row.doc_id, row.text or "") for row in d.collect()])


@pytest.mark.parametrize("rows", [[], [(None, "a b"), (None, "a b"), (1, "a b"), (2, None)]])
def test_nulls_and_empty(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((str(row.doc_id), row.text) for row in similar.keep_first(d).collect()) == ([("2", None), ("None", "a b")] if rows else [])


def test_simhash_groups_come_first(spark, monkeypatch):
    """The stage's links begin with SimHash groups, found by op6's search, and each is checked by whole sets."""
    from consentry.llm import simhash

    r = random.Random(9)
    base = [f"w{r.randrange(3000)}" for _ in range(300)]
    texts = [" ".join(base), _edited(r, base, 1), " ".join(["other"] * 3), "", None]
    whole, searched = simhash.links, []
    monkeypatch.setattr(simhash, "links", lambda fps, *a, **o: searched.append({row.fp for row in fps.collect()}) or whole(fps, *a, **o))
    pairs = list(enumerate(texts))
    kept = similar.keep_first(spark.createDataFrame(pairs, "doc_id long, text string"))
    assert {row.doc_id for row in kept.collect()} == brute([(i, t or "") for i, t in pairs])
    assert {simhash.fingerprint((t or "").encode()) for t in texts} == {fp % (1 << 64) for fp in searched[0]}


def test_shingles_of_some_dozens_of_sets_stay_out_of_prefixes_at_any_size(spark):
    """60,000 sets, of which each 48 share a shingle: most such shingles are known as common, so hardly any pairs meet at them."""
    import numpy as np

    shared = np.arange(1250, dtype=np.uint64) * np.uint64(1 << 37) + np.uint64(1 << 20)
    rows = [(i, similar.packed(np.sort(np.array([shared[i % 1250], (i + 1) * 4001 << 16], np.uint64)))) for i in range(60_000)]
    sets = spark.createDataFrame(rows, "set long, shingles binary").repartition(4)
    keys, counts = similar._common(sets, len(rows))
    found = np.isin(shared >> np.uint64(16), keys)
    assert found.mean() > 0.9 and len(keys) == found.sum() and counts.min() >= 6


def test_sketches_tell_apart_no_similar_pair():
    """Sets of all sizes, some of which differ in their sketches' length: never more differing bits than differing shingles."""
    import numpy as np

    r = np.random.default_rng(3)
    for n in (1, 5, 120, 128, 129, 250, 300, 3000):
        a = np.unique(r.integers(0, 1 << 48, n, dtype=np.uint64))
        for k in (0, 1, n // 10, n // 2):
            b = np.unique(np.concatenate([a[k:], r.integers(0, 1 << 48, k + n // 20, dtype=np.uint64)]))
            assert similar.differing(similar.sketch(a), similar.sketch(b)) <= len(np.setxor1d(a, b))
    x, y = (similar.sketch(r.integers(0, 1 << 48, 3000, dtype=np.uint64)) for _ in range(2))
    assert similar.differing(x, y) > 1000  # unrelated sets are told apart


def test_near_copies_of_one_text_meet_in_proportion(spark, monkeypatch):
    """300 copies that are similar to some of each other: the pairs that meet stay far fewer than all pairs."""
    r = random.Random(11)
    base = [f"w{r.randrange(3000)}" for _ in range(120)]
    pairs = [(i, _edited(r, base, 2)) for i in range(300)]
    met, whole = [], similar._narrowed
    monkeypatch.setattr(similar, "_narrowed", lambda p, *a, **o: met.append(p.count()) or whole(p, *a, **o))
    got = {row.doc_id for row in similar.keep_first(spark.createDataFrame(pairs, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute(pairs)
    assert sum(met) < 300 * 299 // 2 / 3, met


def test_small_tables_are_written_by_few_tasks_and_stars_once(spark, monkeypatch):
    """The driver keeps entries of all tasks: small tables have not as many as the session has partitions, and a star needs one round."""
    from consentry.llm import common, simhash

    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = {k: spark.conf.get(k) for k in names}
    made, whole = [], common.stored
    monkeypatch.setattr(common, "stored", lambda *a: made.append(whole(*a)) or made[-1])
    try:
        for k, v in zip(names, (str(10 * spark.sparkContext.defaultParallelism), "false"), strict=True):
            spark.conf.set(k, v)
        edges = spark.createDataFrame([(0, k) for k in range(1, 200)] + [(900, 950)], "a long, b long").coalesce(1)
        found = simhash.components(edges)
        got = {r.node: r.root for r in found.collect()}
        files = len(found.inputFiles())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {k: 0 for k in range(1, 200)} | {950: 900}
    assert files <= 4 * spark.sparkContext.defaultParallelism
    assert len(made) == 3


def test_counted_shingles_are_those_of_a_plain_count(spark):
    from collections import Counter

    from consentry.llm import common

    r = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join(f"w{r.randrange(5)}" for _ in range(30))) for i in range(40)], "doc_id long, text string")
    sets = common.stored(similar._sets(docs, 2), "sets")
    keys, n = similar._common(sets, 40)
    want = Counter(int(h >> 16) for row in sets.collect() for h in similar.unpacked(bytes(row.shingles)).tolist())
    want = {k: c for k, c in want.items() if c >= 6}
    assert dict(zip(keys.tolist(), n.tolist(), strict=True)) == want and list(keys) == sorted(keys)
    top, _ = similar._common(sets, 40, most=3)
    assert set(top.tolist()) == set(sorted(want, key=lambda k: (-want[k], k))[:3])
