"""Quality classifier: a factorisation machine over hashed words, structure and length.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)):
all pairwise interactions in time linear in the features that a text has. The
features are its distinct words, hashed, each of weight 1 / sqrt(their number), and
standardised statistics of structure and length. Language, source and id are
not features.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, quality_rules

DIMS, RANK = 1 << 14, 8
N_STATS = 12
_EMPTY = b""


def text_features(text: bytes) -> tuple[np.ndarray, list[float]]:
    """Hashed distinct words (sorted, without repeats) and N_STATS statistics."""
    n, chars, symbols, dup_lines, repeats, lines, upper, distinct = quality_rules.text_stats(text)
    words = {zlib.crc32(w) % DIMS for w in set(text.split())}
    size = max(1, len(text))
    digits = len(text) - len(text.translate(None, b"0123456789"))
    marks = len(text) - len(text.translate(None, b".,;:!?'\"()"))
    ends = text.count(b". ") + text.count(b".\n")
    w, line = max(1, n), max(1, lines)
    stats = [np.log1p(n), chars / w, np.log1p(20 * symbols / w), (dup_lines / line) ** 0.5, (repeats / w) ** 0.5, upper / size, np.log1p(w / line), digits / size, marks / w, distinct / w, ends / w, np.log1p(len(text))]
    return np.array(sorted(words), np.int32), [float(x) for x in stats]


class Model:
    """w0, w and V of a factorisation machine, and the statistics' mean and spread."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.w0 = 0.0
        self.w = np.zeros(DIMS + N_STATS)
        self.v = rng.normal(0, 0.02, (DIMS + N_STATS, RANK))
        self.mean, self.spread = np.zeros(N_STATS), np.ones(N_STATS)

    def rows(self, words: list[np.ndarray], stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature numbers and values of all texts end to end, and where each text's begin."""
        z = np.clip((stats - self.mean) / self.spread, -4, 4)
        at = np.cumsum([0] + [len(x) + N_STATS for x in words])
        idx = np.concatenate([np.concatenate([x, np.arange(DIMS, DIMS + N_STATS)]) for x in words]).astype(np.int64)
        val = np.concatenate([np.concatenate([np.full(len(x), 1 / np.sqrt(max(1, len(x)))), s]) for x, s in zip(words, z, strict=True)])
        return idx, val, at[:-1]

    def forward(self, idx, val, at) -> tuple[np.ndarray, np.ndarray]:
        vx = self.v[idx] * val[:, None]
        s = np.add.reduceat(vx, at)
        y = self.w0 + np.add.reduceat(self.w[idx] * val, at) + 0.5 * (s**2 - np.add.reduceat(vx**2, at)).sum(1)
        return y, s

    def scores(self, words: list[np.ndarray], stats: np.ndarray) -> np.ndarray:
        if not len(words):
            return np.zeros(0)
        y, _ = self.forward(*self.rows(words, stats))
        return 1 / (1 + np.exp(-np.clip(y, -30, 30)))

    def fit(self, words: list[np.ndarray], stats: np.ndarray, labels: np.ndarray, epochs: int = 8, batch: int = 128, rate: float = 0.08, decay: float = 1e-5, seed: int = 11) -> Model:
        """AdaGrad over the logistic loss, in an order fixed by seed."""
        if not len(labels):
            return self
        self.mean, self.spread = stats.mean(0), np.maximum(stats.std(0), 1e-3)
        p = np.clip(labels.mean(), 0.01, 0.99)
        self.w0 = float(np.log(p / (1 - p)))
        gw, gv = np.full(len(self.w), 1e-2), np.full(self.v.shape, 1e-2)
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(len(labels))
            for lo in range(0, len(order), batch):
                some = order[lo : lo + batch]
                idx, val, at = self.rows([words[i] for i in some], stats[some])
                y, s = self.forward(idx, val, at)
                err = 1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels[some]
                of = np.repeat(np.arange(len(some)), np.diff(np.append(at, len(idx))))
                e = (err[of] * val) / len(some)
                self.w0 -= rate * 0.1 * err.mean()
                used, inv = np.unique(idx, return_inverse=True)
                dw = np.bincount(inv, e, len(used)) + decay * self.w[used]
                per = e[:, None] * (s[of] - self.v[idx] * val[:, None])
                dv = np.stack([np.bincount(inv, per[:, f], len(used)) for f in range(RANK)], 1) + decay * self.v[used]
                gw[used] += dw**2
                gv[used] += dv**2
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                self.v[used] -= rate * dv / np.sqrt(gv[used])
        return self


def train(docs: DataFrame, labels: DataFrame, held_out: Column, max_rows: int = 6000) -> Model:
    """A model of labels.quality from at most max_rows labelled rows that are not held out.

    The rows are those of the least hash of doc_id, so they are the same for the
    same tables. Rows with a null id, text label or quality do not count. Without
    any row the model scores every text 0.5.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.where(~held_out).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = common.id_and_text(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")

    def run(batches):
        for ids, texts, part in common.doc_batches(batches):
            got = [text_features(t) for t in texts]
            yield pa.RecordBatch.from_arrays([common.id_array(ids), part.column("quality"), pa.array([w.tobytes() for w, _ in got], pa.binary()), pa.array([s for _, s in got], pa.list_(pa.float64()))], names=["doc_id", "quality", "words", "stats"])

    t = rows.mapInArrow(run, "doc_id long, quality int, words binary, stats array<double>").toArrow().sort_by("doc_id")
    words = [np.frombuffer(x, np.int32) for x in t["words"].to_pylist()]
    return Model().fit(words, np.array(t["stats"].to_pylist(), float).reshape(-1, N_STATS), np.array(t["quality"].to_pylist(), float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1, higher: better) of every row of docs; empty texts are scored like any other."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for ids, texts, _ in common.doc_batches(batches, rows=512):
            got = [text_features(t) for t in texts]
            y = shared.value.scores([w for w, _ in got], np.array([s for _, s in got]).reshape(-1, N_STATS))
            yield pa.RecordBatch.from_arrays([common.id_array(ids), pa.array(y)], names=["doc_id", "score"])

    return common.id_and_text(docs).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs with a score of threshold or more, all columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    common.bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                got = [text_features(t or _EMPTY) for t in part.column(at).cast(pa.large_binary()).to_pylist()]
                yield part.filter(pa.array(shared.value.scores([w for w, _ in got], np.array([s for _, s in got])) >= threshold))
        common.trim()

    return docs.mapInArrow(run, docs.schema)
