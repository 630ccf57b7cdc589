"""Documents in chunks, and exchanges of packed arrays between chunks and hash buckets.

A chunk is a row with the texts of some documents, about two megabytes, written once to a
table in the shared folder. Work on all bytes or words of a corpus is done per
chunk in numpy. What must meet from all chunks travels in packed arrays, one
row per chunk and bucket: keys are spread over buckets by their upper bits, so
a key of any number of documents takes one entry per chunk. Answers come back
by chunk in the order of the chunk's own sorted keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SIZE = 2 << 20
SCHEMA = "chunk long, n_docs long, n_bytes long, ids binary, ends binary, blob binary"
_NAMES = ["chunk", "n_docs", "n_bytes", "ids", "ends", "blob"]


def pack(text: bytes, level: int = 3) -> bytes:
    return pa.Codec("zstd", compression_level=level).compress(text, asbytes=True)


def unpack(blob: bytes, size: int) -> bytes:
    return pa.decompress(blob, size, codec="zstd", asbytes=True) if size else b""


def chunked(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """The stored chunks of docs. A text longer than a chunk is one chunk; none is cut."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        ids, texts, held = [], [], 0
        for keys, some, _ in common.doc_batches(batches):
            for key, text in zip(keys.tolist(), some, strict=True):
                if texts and held + len(text) > size:
                    yield pa.RecordBatch.from_arrays(row(number, ids, texts), names=_NAMES)
                    number, ids, texts, held = number + 1, [], [], 0
                ids.append(key)
                texts.append(text)
                held += len(text)
        if texts:
            yield pa.RecordBatch.from_arrays(row(number, ids, texts), names=_NAMES)

    return common.stored(common.id_and_text(docs).mapInArrow(run, SCHEMA), "chunks")


def row(number: int, ids: list[int], texts: list[bytes], level: int = 3) -> list[pa.Array]:
    """The columns of one chunk."""
    joined = b"".join(texts)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    values = (number, pa.int64()), (len(ids), pa.int64()), (len(joined), pa.int64()), (np.array(ids, np.int64).tobytes(), pa.binary()), (ends.tobytes(), pa.binary()), (pack(joined, level), pa.binary())
    return [pa.array([x], t) for x, t in values]


class Chunk:
    """A row of the chunk table; extra columns are attributes as Python values."""

    def __init__(self, row: dict) -> None:
        self.__dict__.update(row)
        self.ids = np.frombuffer(self.ids, np.int64)
        self.ends = np.frombuffer(self.ends, np.int64)
        self.data = unpack(self.blob, self.n_bytes)

    def texts(self) -> Iterator[bytes]:
        at = 0
        for end in self.ends.tolist():
            yield self.data[at:end]
            at = end


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts as compressed integers of 4 bytes, or 8 where one needs them, after their number and size."""
    size = 4 if int(counts.max(initial=0)) < 1 << 32 else 8
    return len(counts).to_bytes(4, "little") + bytes([size]) + pack(counts.astype(f"<u{size}").tobytes())


def unpack_counts(data: bytes) -> np.ndarray:
    n, size = int.from_bytes(data[:4], "little"), data[4]
    return np.frombuffer(unpack(data[5:], size * n), f"<u{size}").astype(np.int64)


def all_counts(answers: list[bytes] | None) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *map(unpack_counts, answers or [])])


def pack_array(x: np.ndarray) -> bytes:
    """A compressed array, after its bytes' number."""
    data = x.tobytes()
    return len(data).to_bytes(4, "little") + pack(data)


def unpack_array(data: bytes, dtype) -> np.ndarray:
    return np.frombuffer(unpack(data[4:], int.from_bytes(data[:4], "little")), dtype)


def pack_keys(keys: np.ndarray, key_bytes: int) -> bytes:
    """The keys of one bucket of at least 256: without the top byte, which the bucket tells, and the bytes below key_bytes."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - key_bytes : 7]).tobytes()


def unpack_keys(data: bytes, key_bytes: int, top: int) -> np.ndarray:
    low = np.frombuffer(data, np.uint8).reshape(-1, key_bytes - 1)
    out = np.zeros((len(low), 8), np.uint8)
    out[:, 8 - key_bytes : 7] = low
    out[:, 7] = top
    return out.view("<u8").ravel()


def each(batches) -> Iterator[Chunk]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Chunk(batch.slice(i, 1).to_pylist()[0])
        common.trim()


def buckets_for(chunks: DataFrame) -> int:
    n = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    return common.parts_for(chunks.sparkSession, n)


def cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where sorted 64-bit keys are cut so that piece b has the keys of bucket b, which is their upper bits."""
    edges = (np.arange(1, buckets, dtype=np.uint64)) << np.uint64(64 - (buckets.bit_length() - 1))
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def tasks_for(spark: SparkSession, n_bytes: int, each: int = 16 << 20) -> int:
    """A number of tasks that keeps what one reads near a fixed size, whatever the input's."""
    return max(spark.sparkContext.defaultParallelism, -(-n_bytes // each))


def totals(chunks: DataFrame, keys_of: Callable[[Chunk], tuple[np.ndarray, np.ndarray]], buckets: int, key_bytes: int = 8, tasks: int = 0, top: int = 0) -> DataFrame:
    """For each chunk's keys the sum of their counts over all chunks.

    keys_of: sorted different 64-bit keys of a chunk, and their counts; of a key
    only its upper key_bytes bytes may be set. The table returned is stored: chunk, bucket and answer
    (pack_counts of the sums, in the order of the chunk's keys in that bucket),
    and for each bucket a row with a null chunk and n_keys, the different keys with a
    count, n_all, the sum of all counts, and often: the top keys of the greatest counts.
    tasks: that the buckets are dealt to (0: as the session has it).
    """

    def send(batches):
        for c in each(batches):
            keys, counts = keys_of(c)
            cut = cuts(keys, buckets)
            full = np.nonzero(np.diff(cut))[0]
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), c.chunk, np.int64)), pa.array([pack_keys(keys[cut[b] : cut[b + 1]], key_bytes) for b in full], pa.binary()), pa.array([pack_counts(counts[cut[b] : cut[b + 1]]) for b in full], pa.binary())], names=["bucket", "chunk", "keys", "counts"])

    def add(key, table):
        rows = table.to_pydict()
        b = key[0].as_py()
        keys = [unpack_keys(x, key_bytes, b >> (buckets.bit_length() - 9)) for x in rows["keys"]]
        joined = np.concatenate(keys)
        order = np.argsort(joined, kind="stable")
        ordered = joined[order]
        first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        sums = np.add.reduceat(all_counts(rows["counts"])[order], np.nonzero(first)[0])
        answer = np.empty(len(joined), np.int64)
        answer[order] = sums[np.cumsum(first) - 1]
        cut = np.cumsum([0] + [len(k) for k in keys])
        n = len(keys)
        distinct = ordered[first]
        most = np.lexsort((distinct, -sums))[:top]
        often = [{"key": k, "n": c} for k, c in zip(distinct[most].view(np.int64).tolist(), sums[most].tolist(), strict=True) if c]
        return pa.table({"chunk": pa.array([*rows["chunk"], None], pa.int64()), "bucket": pa.array([b] * (n + 1), pa.int32()), "answer": pa.array([*(pack_counts(answer[cut[i] : cut[i + 1]]) for i in range(n)), None], pa.binary()), "n_keys": pa.array([0] * n + [int((sums > 0).sum())], pa.int64()), "n_all": pa.array([0] * n + [int(sums.sum())], pa.int64()), "often": pa.array([None] * n + [often], pa.list_(pa.struct({"key": pa.int64(), "n": pa.int64()})))})

    sent = chunks.mapInArrow(send, "bucket int, chunk long, keys binary, counts binary")
    got = dealt(sent, "bucket", tasks).groupBy("bucket").applyInArrow(add, "chunk long, bucket int, answer binary, n_keys long, n_all long, often array<struct<key: long, n: long>>")
    return common.stored(got, "totals")


def dealt(rows: DataFrame, key: str, tasks: int) -> DataFrame:
    """rows dealt by a key to so many tasks (0: left to the session)."""
    return rows.repartition(tasks, key) if tasks else rows


def with_answers(chunks: DataFrame, answers: DataFrame, name: str = "answers", tasks: int = 0) -> DataFrame:
    """chunks with an array of their answers in bucket order (null where there are none)."""
    mine = dealt(answers.where("chunk is not null").select("chunk", "bucket", "answer"), "chunk", tasks)
    listed = mine.groupBy("chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "answer"))), lambda x: x["answer"]).alias(name))
    return dealt(chunks, "chunk", tasks).join(listed, "chunk", "left")
