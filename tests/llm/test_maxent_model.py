"""The language model is a distribution, agrees with a plain computation of its formula, and gains on held-out texts."""

import numpy as np
import pytest

from consentry.llm import common, maxent


def _groups(words, counts):
    seen = np.zeros((1 << maxent.SHARED_BITS, 2))
    np.add.at(seen, (maxent.Groups._shared(words), 0), counts)
    np.add.at(seen, (maxent.Groups._shared(words), 1), 1)
    top = np.lexsort((words, -counts))[: maxent.CLASSES * maxent.OWN]
    return maxent.Groups(words[top], counts[top].astype(float), seen)


def test_probabilities_sum_to_one():
    r = np.random.default_rng(1)
    words = np.unique(r.integers(0, 1 << 63, 900).astype(np.uint64) * np.uint64(2))
    counts = r.zipf(1.5, len(words)) % 500 + 1
    groups = _groups(words, counts)
    w = maxent.Weights(groups, [r.normal(size=(64, k)).astype(np.float32) for k in (maxent.CLASSES, maxent.GROUPS)])
    c, g = groups.of(words)
    history = np.tile(r.integers(0, 1 << 63, 3).astype(np.uint64), (len(words), 1))
    inside = np.where(g >= maxent.OWN, np.log10(counts + 1.0) - groups.within[c, g], 0.0)
    seen = 10 ** (inside + w.score(history, c, g))
    # what no training word has: one share of each shared group, and frequent places without a word
    kind, group = np.divmod(np.arange(maxent.CLASSES * maxent.GROUPS), maxent.GROUPS)
    mass = 10 ** w.score(history[: len(kind)], kind, group)
    taken = {(a, b) for a, b in zip(c.tolist(), g.tolist(), strict=True)}
    rest = sum(m * 10 ** -groups.within[a, b] if b >= maxent.OWN else m * ((a, b) not in taken) for a, b, m in zip(kind.tolist(), group.tolist(), mass, strict=True))
    assert seen.sum() + rest == pytest.approx(1.0, abs=1e-4)


def test_score_is_the_formula():
    r = np.random.default_rng(2)
    words = np.unique(r.integers(0, 1 << 63, 300).astype(np.uint64))
    groups = _groups(words, np.arange(len(words)) + 1)
    w = maxent.Weights(groups, [r.normal(size=(32, k)).astype(np.float32) for k in (maxent.CLASSES, maxent.GROUPS)])
    keys = r.choice(words, 40)
    f = maxent.features(keys, np.array([0, 15]))
    c, g = groups.of(keys)
    outer, inner = w.places(f, c)
    for i in range(len(keys)):
        a = groups.outer.astype(float) + sum(w.tables[0][x].astype(float) for x in outer[i])
        b = groups.inner[c[i]].astype(float) + sum(w.tables[1][x].astype(float) for x in inner[i])
        want = np.log10(np.exp(a)[c[i]] / np.exp(a).sum()) + np.log10(np.exp(b)[g[i]] / np.exp(b).sum())
        assert w.score(f, c, g)[i] == pytest.approx(want, abs=1e-4)


def test_learning_follows_the_gradient():
    groups = _groups(np.arange(1, 400, dtype=np.uint64) << np.uint64(50), np.arange(399, 0, -1))
    w = maxent.Weights(groups, [np.zeros((256, k), np.float32) for k in (maxent.CLASSES, maxent.GROUPS)])
    keys = np.tile(np.arange(1, 9, dtype=np.uint64) << np.uint64(50), 200)
    f, (c, g) = maxent.features(keys, np.array([0])), groups.of(keys)
    before = w.score(f, c, g).mean()
    w.start_learning()
    w.learn(f, c, g, 0.3, batch=64)
    assert w.score(f, c, g).mean() > before + 1


def test_rows_grow_with_the_corpus():
    assert [maxent.rows_for(n) for n in (0, 1 << 26, 1 << 28, 1 << 40)] == [maxent.LEAST_ROWS, 1 << 14, 1 << 16, maxent.MOST_ROWS]


def test_held_out_texts_gain(spark, sf):
    rows = maxent.score(common.documents(spark, sf.replace("sf0.001", "sf0.01"))).where("held_out").agg({"score": "sum", "base_score": "sum", "n_tokens": "sum"}).first()
    assert (rows["sum(score)"] - rows["sum(base_score)"]) / rows["sum(n_tokens)"] > 0.06


def test_keys_are_those_of_words(monkeypatch):
    r = np.random.default_rng(5)
    words = [bytes(r.integers(97, 101, r.integers(1, 6)).astype(np.uint8)) for _ in range(400)] + [b"x" * 600, b"x" * 599 + b"y", "\u00e9t\u00e9".encode()]
    text = b" \n".join(words) + b"\t"
    keys = maxent.tokens_of(text)
    assert len(keys) == len(words) + 1 and keys[-1] == maxent.END
    assert len(set(keys.tolist())) == len(set(words)) + 1
    alone = [maxent.tokens_of(w)[0] for w in words]
    assert keys[:-1].tolist() == alone
    monkeypatch.setattr(maxent, "PIECE", 64)
    assert maxent.tokens_of(text).tolist() == keys.tolist()
    assert maxent.tokens_of(b"").tolist() == [maxent.END] and maxent.tokens_of(b" A a ")[0] == maxent.tokens_of(b"a")[0]


def test_few_tasks_learn(spark):
    """What a task sends does not shrink with its share of the texts, so their number follows the bytes, not the files."""
    table = spark.range(300).repartition(64)
    cores = spark.sparkContext.defaultParallelism
    assert maxent.for_learning(table, 1 << 20).rdd.getNumPartitions() <= cores
    assert maxent.for_learning(table, (cores + 3) * maxent.LEARN_BYTES).rdd.getNumPartitions() == min(64, cores + 3)


def test_segment_sums():
    r = np.random.default_rng(5)
    for top in (1, 2, 3, 9):
        n = r.integers(1, top + 1, 200)
        new, rows, x = np.cumsum(n) - n, r.integers(0, 50, n.sum()), r.integers(0, 9, (50, 4)).astype(np.float32)
        assert (maxent.segment_sums(x, rows, new, n) == np.array([x[rows[a : a + k]].sum(0) for a, k in zip(new, n, strict=True)])).all()
