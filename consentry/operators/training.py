"""Training of the evidential classifier by distributed gradient steps.

Examples are written once, partitioned by fold: a fifth to validate on, chosen by
md5 of the id, and the rest in batches. A step reads the partition of its batch, each task sums
the gradient over its rows, and the sums meet per weight, so that no task or row
holds more than one gradient a partition. The driver holds the weights and Adam's moments, whose
size does not depend on the data. Every epoch ends with a pass over the validation
fold and a row in the checkpoint table; training goes on from the last row there.

Rows without a label or with a null or short vector are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VALIDATION = -1
CHECKPOINT = "epoch int, step long, train_loss double, val_loss double, val_accuracy double, weights array<double>, first array<double>, second array<double>"


def _digamma(x: np.ndarray) -> np.ndarray:
    z = x + 8.0
    return np.log(z) - 1 / (2 * z) - 1 / (12 * z**2) + 1 / (120 * z**4) - 1 / (252 * z**6) - sum(1 / (x + k) for k in range(8))


def _trigamma(x: np.ndarray) -> np.ndarray:
    z = x + 8.0
    return 1 / z + 1 / (2 * z**2) + 1 / (6 * z**3) - 1 / (30 * z**5) + 1 / (42 * z**7) + sum(1 / (x + k) ** 2 for k in range(8))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    z = x + 8.0
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - sum(np.log(x + k) for k in range(8))


@dataclass(frozen=True)
class Net:
    """Dense layers with rectified units between them; the last one gives the two logits of the evidential head."""

    sizes: tuple[int, ...]

    def start(self, seed: int = 42) -> np.ndarray:
        """First weights: uniform within one over the root of a layer's inputs."""
        r = np.random.default_rng(seed)
        return np.concatenate([r.uniform(-1, 1, n * m + m) / np.sqrt(n) for n, m in zip(self.sizes, self.sizes[1:], strict=False)])

    def layers(self, weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for n, m in zip(self.sizes, self.sizes[1:], strict=False):
            out.append((weights[at : at + n * m].reshape(n, m), weights[at + n * m : at + n * m + m]))
            at += n * m + m
        return out

    def logits(self, weights: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        """The input and what each layer gives."""
        out = [x]
        for k, (w, b) in enumerate(self.layers(weights)):
            z = out[-1] @ w + b
            out.append(np.maximum(z, 0) if k + 2 < len(self.sizes) else z)
        return out

    def alphas(self, weights: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.logaddexp(0, self.logits(weights, x)[-1]) + 1

    def losses(self, weights: np.ndarray, x: np.ndarray, y: np.ndarray, anneal: float) -> np.ndarray:
        """Squared error and variance of the expected probabilities, and anneal times the divergence of the evidence for the wrong label."""
        a = self.alphas(weights, x)
        s, one = a.sum(1, keepdims=True), np.eye(2)[y]
        p = a / s
        wrong = a[np.arange(len(y)), 1 - y]
        kl = _log_gamma(1 + wrong) - _log_gamma(wrong) + (wrong - 1) * (_digamma(wrong) - _digamma(1 + wrong))
        return ((one - p) ** 2 + p * (1 - p) / (s + 1)).sum(1) + anneal * kl

    def gradient(self, weights: np.ndarray, x: np.ndarray, y: np.ndarray, anneal: float) -> np.ndarray:
        """The gradient of the sum of losses."""
        out = self.logits(weights, x)
        a = np.logaddexp(0, out[-1]) + 1
        s, one = a.sum(1, keepdims=True), np.eye(2)[y]
        p = a / s
        error, squares = one - p, (p * p).sum(1, keepdims=True)
        d = -2 / s * (error - (error * p).sum(1, keepdims=True)) - 2 / s * (p - squares) / (s + 1) - (1 - squares) / (s + 1) ** 2
        rows = np.arange(len(y))
        wrong = a[rows, 1 - y]
        d[rows, 1 - y] += anneal * (wrong - 1) * (_trigamma(wrong) - _trigamma(1 + wrong))
        d *= 1 / (1 + np.exp(-out[-1]))
        parts = []
        for k in range(len(self.sizes) - 2, -1, -1):
            w, _ = self.layers(weights)[k]
            parts.append(np.concatenate([(out[k].T @ d).ravel(), d.sum(0)]))
            d = (d @ w.T) * (out[k] > 0)
        return np.concatenate(parts[::-1])


def examples(rows: DataFrame, id: Column, x: Column, y: Column, path: str, batches: int = 4, share: int = 5, seed: int = 42) -> DataFrame:
    """Writes x, y and fold to path: one in share validates, the others are in batches; both by md5 of the id."""
    h = lambda at: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(id.cast("string"), F.lit("")))), at, 8), 16, 10).cast("long")
    fold = F.when(h(1) % share == 0, VALIDATION).otherwise((h(9) % batches).cast("int"))
    rows.select(x.cast("array<double>").alias("x"), y.cast("int").alias("y"), fold.alias("fold")).where("x is not null and y in (0, 1)").write.partitionBy("fold").parquet(path)
    return rows.sparkSession.read.schema("x array<double>, y int, fold int").parquet(path)


def _matrix(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """x and y of a batch, without the rows whose x has another length or a null."""
    x, y = batch.column("x"), np.asarray(batch.column("y"))
    flat = x.flatten()
    if len(flat) != width * len(x) or flat.null_count:
        ok = [k for k, v in enumerate(x.to_pylist()) if len(v) == width and None not in v]
        x, y = x.take(pa.array(ok, pa.int64())), y[ok]
        flat = x.flatten()
    return np.asarray(flat, np.float64).reshape(-1, width), y


def _pass(rows: DataFrame, net: Net, weights: np.ndarray, anneal: float, learn: bool) -> tuple[int, float, int, np.ndarray]:
    """Over all rows: their number, the sum of losses, how many are told right, and the sum of gradients if learn."""

    def run(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(3 + len(weights) * learn)
        for batch in batches:
            x, y = _matrix(batch, net.sizes[0])
            if len(y):
                a = net.alphas(weights, x)
                total[:3] += len(y), net.losses(weights, x, y, anneal).sum(), ((a[:, 1] > a[:, 0]) == y).sum()
                if learn:
                    total[3:] += net.gradient(weights, x, y, anneal)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "value"])

    sums = rows.select("x", "y").mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value"))
    got = np.zeros(3 + len(weights) * learn)
    for r in sums.collect():  # as many rows as the net has weights
        got[r["at"]] = r["value"]
    return int(got[0]), float(got[1]), int(got[2]), got[3:]


def train(data: DataFrame, net: Net, checkpoints: str, epochs: int = 10, batches: int = 4, rate: float = 1e-3, annealing: int = 10, seed: int = 42) -> DataFrame:
    """The checkpoint table after epochs epochs of Adam over data (see examples); epochs that it already has are not run again.

    A step's gradient is the mean over its batch; a batch without rows is passed over.
    """
    spark = data.sparkSession
    weights, first, second, step, done = net.start(seed), np.zeros(1), np.zeros(1), 0, 0
    last = checkpoint(spark, checkpoints, "epoch")
    if last is not None:
        weights, first, second, step, done = np.array(last["weights"]), np.array(last["first"]), np.array(last["second"]), last["step"], last["epoch"]
    for epoch in range(done + 1, epochs + 1):
        anneal, seen, lost = min(1.0, (epoch - 1) / annealing), 0, 0.0
        for b in range(batches):
            n, loss, _, gradient = _pass(data.where(F.col("fold") == b), net, weights, anneal, True)
            if not n:
                continue
            seen, lost, step, gradient = seen + n, lost + loss, step + 1, gradient / n
            first = 0.9 * first + 0.1 * gradient
            second = 0.999 * second + 0.001 * gradient**2
            weights = weights - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        n, loss, right, _ = _pass(data.where(F.col("fold") == VALIDATION), net, weights, anneal, False)
        row = (epoch, step, lost / max(1, seen), loss / max(1, n), right / max(1, n), weights.tolist(), np.broadcast_to(first, weights.shape).tolist(), np.broadcast_to(second, weights.shape).tolist())
        spark.createDataFrame([row], CHECKPOINT).coalesce(1).write.mode("append").parquet(checkpoints)
    return spark.read.schema(CHECKPOINT).parquet(checkpoints)


def checkpoint(spark: SparkSession, path: str, by: str = "val_accuracy"):
    """The row of the greatest by; of equal ones the first epoch. None without a table."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return spark.read.schema(CHECKPOINT).parquet(path).orderBy(F.col(by).desc(), "epoch").first()


def predicted(rows: DataFrame, x: str, net: Net, weights: np.ndarray) -> DataFrame:
    """rows with risk and uncertainty; null where the vector is null, short or has a null."""
    names = [*rows.columns, "risk", "uncertainty"]
    keep = [c for c in rows.columns if c not in ("risk", "uncertainty")]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            vectors = batch.column(batch.schema.get_field_index(x)).to_pylist()
            ok = np.array([v is not None and len(v) == net.sizes[0] and None not in v for v in vectors], bool)
            out = np.zeros((2, len(vectors)))
            if ok.any():
                a = net.alphas(weights, np.array([v for v, k in zip(vectors, ok, strict=True) if k], float))
                out[:, ok] = a[:, 1] / a.sum(1), 2 / a.sum(1)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), *(pa.array(o, mask=~ok) for o in out)], names=names if len(names) == len(keep) + 2 else [*keep, "risk", "uncertainty"])

    schema = rows.select(*keep).schema.add("risk", "double").add("uncertainty", "double")
    return rows.mapInArrow(run, schema)
