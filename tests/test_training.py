"""Distributed training against the same steps in numpy, and against finite differences."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from consentry.operators import features, training


def data(spark, n=400, d=5):
    r = np.random.default_rng(3)
    x = r.normal(size=(n, d))
    y = (x[:, 0] + 0.5 * x[:, 1] * x[:, 2] > 0).astype(int)
    return spark.createDataFrame([(f"id{k}", [float(v) for v in x[k]], int(y[k])) for k in range(n)], "id string, x array<double>, y int"), x, y


def folds(n, batches, share=5, seed=42):
    h = [hashlib.md5(f"{seed}|id{k}".encode()).hexdigest() for k in range(n)]
    return np.array([-1 if int(v[:8], 16) % share == 0 else int(v[8:16], 16) % batches for v in h])


def test_gradient_is_the_loss_by_differences():
    net, r = training.Net((4, 6, 3, 2)), np.random.default_rng(0)
    w, x, y = net.start(), r.normal(size=(7, 4)), r.integers(0, 2, 7)
    for anneal in (0.0, 0.7):
        g = net.gradient(w, x, y, anneal)
        for k in range(0, len(w), 3):
            e = np.zeros_like(w)
            e[k] = 1e-6
            assert g[k] == pytest.approx((net.losses(w + e, x, y, anneal).sum() - net.losses(w - e, x, y, anneal).sum()) / 2e-6, abs=1e-5)


def test_loss_is_the_column_expression(spark):
    net, r = training.Net((2, 2)), np.random.default_rng(1)
    w, x, y = r.normal(size=6), r.normal(size=(20, 2)) * 3, r.integers(0, 2, 20)
    a = net.alphas(w, x)
    rows = spark.createDataFrame([(float(p), float(q), int(t)) for (p, q), t in zip(a, y, strict=True)], "a double, b double, y int")
    got = [r[0] for r in rows.select(features.evidential_loss(F.col("a"), F.col("b"), F.col("y"), F.lit(5.0))).collect()]
    assert got == pytest.approx(net.losses(w, x, y, 0.5).tolist(), abs=1e-6)


def test_training_is_the_plain_loop(spark, tmp_path):
    rows, x, y = data(spark)
    net, epochs, batches, rate = training.Net((5, 8, 2)), 4, 3, 0.05
    table = training.examples(rows.repartition(5), F.col("id"), F.col("x"), F.col("y"), str(tmp_path / "x"), batches)
    history = training.train(table, net, str(tmp_path / "c"), epochs, batches, rate).orderBy("epoch").collect()
    fold = folds(len(x), batches)
    assert table.where("fold = -1").count() == (fold == -1).sum() > 40
    w, m, v, step, best = net.start(), 0.0, 0.0, 0, (-1, 0)
    for epoch in range(1, epochs + 1):
        anneal, lost, seen = min(1.0, (epoch - 1) / 10), 0.0, 0
        for b in range(batches):
            some = fold == b
            lost, seen = lost + net.losses(w, x[some], y[some], anneal).sum(), seen + some.sum()
            g = net.gradient(w, x[some], y[some], anneal) / some.sum()
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        val = fold == -1
        a = net.alphas(w, x[val])
        accuracy = float(((a[:, 1] > a[:, 0]) == y[val]).mean())
        h = history[epoch - 1]
        assert (h.epoch, h.step) == (epoch, step)
        assert (h.train_loss, h.val_loss, h.val_accuracy) == pytest.approx((lost / seen, net.losses(w, x[val], y[val], anneal).mean(), accuracy), abs=1e-9)
        assert h.weights == pytest.approx(w.tolist(), abs=1e-8)
        best = max(best, (accuracy, -epoch))
    assert training.checkpoint(spark, str(tmp_path / "c")).epoch == -best[1]
    assert history[-1].train_loss < history[0].train_loss and best[0] > 0.8


def test_training_goes_on_from_the_table(spark, tmp_path):
    rows, _, _ = data(spark, 120)
    net = training.Net((5, 2))
    table = training.examples(rows, F.col("id"), F.col("x"), F.col("y"), str(tmp_path / "x"), 2)
    training.train(table, net, str(tmp_path / "a"), 3, 2, 0.1)
    training.train(table, net, str(tmp_path / "b"), 1, 2, 0.1)
    training.train(table, net, str(tmp_path / "b"), 3, 2, 0.1)
    a, b = ([r.weights for r in spark.read.parquet(str(tmp_path / k)).orderBy("epoch").collect()] for k in "ab")
    assert len(a) == len(b) == 3 and np.allclose(a, b, atol=1e-9)


def test_odd_rows_are_left_out(spark, tmp_path):
    rows = spark.createDataFrame([("a", [1.0, 2.0], 1), ("b", None, 0), ("c", [1.0], 0), ("d", [1.0, None], 1), ("e", [0.0, 0.0], 7), ("f", [0.0, 1.0], None), (None, [2.0, 1.0], 0)], "id string, x array<double>, y int")
    table = training.examples(rows, F.col("id"), F.col("x"), F.col("y"), str(tmp_path / "x"), 1, share=1000)
    net = training.Net((2, 2))
    got = training._pass(table, net, net.start(), 0.0, True)
    assert got[0] == 2 and len(got[3]) == 6
    empty = training.train(table.limit(0), net, str(tmp_path / "c"), 1, 1).first()
    assert (empty.step, empty.val_accuracy) == (0, 0.0)
    scored = {r.id: r for r in training.predicted(rows, "x", net, net.start()).collect()}
    assert scored["b"].risk is None and scored["c"].uncertainty is None and scored["d"].risk is None
    assert 0 < scored["a"].risk < 1 and 0 < scored["a"].uncertainty <= 1
