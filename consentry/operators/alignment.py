"""Likeness of texts by greedy matching of token vectors, as blocked matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: More vectors than this are joined by a shuffle instead of a broadcast, but for those of tokens with more than one in OFTEN of all.
MAX_BROADCAST_VECTORS = 50_000
OFTEN = 1000


def token_vectors(rows: DataFrame, key: str, tokens: str, vectors: DataFrame, few: bool | None = None) -> DataFrame:
    """(key, flat, width): the vectors of a row's tokens, by place, end to end, in their own type; tokens without a vector are passed over.

    vectors: token and vector, one row a token. Rows without any token that has one are not in the result.
    few: whether the vectors are few enough to broadcast (None: they are counted).
    """
    at = rows.select(key, F.posexplode(tokens).alias("_at", "token"))
    known = vectors.select("token", "vector").where("vector is not null")  # as they are: most embeddings are floats, half a double's bytes
    if few is None:
        few = vectors.count() <= MAX_BROADCAST_VECTORS
    if few:
        met = at.join(F.broadcast(known), "token")
    else:  # a token of more than a thousandth of all is broadcast, at most a thousand of them; no vector is sent more than once otherwise
        often = at.groupBy("token").count().where(F.col("count") * OFTEN > at.count()).select("token")
        plain = at.join(F.broadcast(often), "token", "left_anti").join(known.hint("shuffle_merge"), "token")
        met = plain.unionByName(at.join(F.broadcast(known.join(F.broadcast(often), "token")), "token"))
    listed = met.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_at", "vector"))).alias("_v"))
    return listed.select(key, F.flatten(F.transform("_v", lambda s: s["vector"])).alias("flat"), F.size(F.get("_v", F.lit(0))["vector"]).alias("width"))


def greedy(a: np.ndarray, b: np.ndarray, block: int = 1024) -> tuple[float, float, float]:
    """Precision, recall and F1: the mean greatest cosine of a's rows over b's, of b's over a's, and their harmonic mean.

    A vector of length zero has cosine 0 with all. Only a block of one by a block of the other is multiplied at a time.
    """
    a, b = (x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) > 0, n, 1.0) for x in (a, b))
    best_a, best_b = np.full(len(a), -np.inf), np.full(len(b), -np.inf)
    for i in range(0, len(a), block):
        for j in range(0, len(b), block):
            s = a[i : i + block] @ b[j : j + block].T
            np.maximum(best_a[i : i + block], s.max(1), out=best_a[i : i + block])
            np.maximum(best_b[j : j + block], s.max(0), out=best_b[j : j + block])
    p, r = float(best_a.mean()), float(best_b.mean())
    return p, r, 2 * p * r / (p + r) if p + r > 0 else 0.0


def greedy_scores(pairs: DataFrame, key: str, candidate: str, reference: str, vectors: DataFrame) -> DataFrame:
    """(key, precision, recall, f1) of every row of pairs, which has arrays of tokens; zeros where a side has no token with a vector.

    key tells rows apart.
    """
    few = vectors.count() <= MAX_BROADCAST_VECTORS
    a = token_vectors(pairs, key, candidate, vectors, few).withColumnsRenamed({"flat": "_a"})
    b = token_vectors(pairs, key, reference, vectors, few).withColumnsRenamed({"flat": "_b"}).drop("width")
    both = pairs.select(key).join(a, key, "left").join(b, key, "left")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            scores = []
            for x, y, w in zip(batch.column("_a"), batch.column("_b"), batch.column("width").to_pylist(), strict=True):
                scores.append(greedy(*(np.asarray(v.values, float).reshape(-1, w) for v in (x, y))) if x.is_valid and y.is_valid else (0.0, 0.0, 0.0))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.float64()) for c in (zip(*scores, strict=True) if scores else [[]] * 3))], names=[key, "precision", "recall", "f1"])

    return both.mapInArrow(run, pairs.select(key).schema.add("precision", "double").add("recall", "double").add("f1", "double"))
