"""Token-id output: documents in ascending id order, as coded segment files.

Documents are range-partitioned by id and sorted; each task encodes whole texts
and writes segments of a bounded number of ids (see coder) as the binary rows
of a table in the shared folder, through Spark's own committed writers. Reading
decodes each segment, checks its blocks, and adds the ids of all earlier
partitions, of which only one sum per partition is put in order.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import coder, common, tokens

#: More segments than this are joined to their starts without a broadcast.
MAX_BROADCAST_SEGMENTS = 100_000
SEGMENTS = "part int, segment int, n_docs long, n_ids long, image binary"


def encode(docs: DataFrame, tokenizer: str, end_id: int = 2, segment_ids: int = 1 << 21) -> DataFrame:
    """Segments of all documents' ids, each document ended by end_id; (part, segment) order is ascending doc_id.

    A null text is empty. A null doc_id comes first. Rows of one id follow each
    other in the order of their texts' hashes. segment_ids: a segment ends with
    the document that brings it to so many ids.
    """

    def run(batches):
        encoder = tokens.cache(tokenizer)
        part = TaskContext.get().partitionId()
        number, names, ids, sizes, held = 0, [], [], [], 0

        def flush():
            counts = np.array(sizes, np.int64)
            image = coder.segment(np.array(names, np.int64), counts, np.concatenate(ids))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(names)], pa.int64()), pa.array([int(counts.sum())], pa.int64()), pa.array([image], pa.binary())], names=["part", "segment", "n_docs", "n_ids", "image"])

        for keys, texts, _ in common.doc_batches(batches, rows=1 << 13, size=16 << 20):
            flat, counts = encoder.ended(texts, end_id)
            ends = np.cumsum(counts)
            done = 0  # documents of this batch in segments already written
            while done < len(keys):
                begin = int(ends[done - 1]) if done else 0
                stop = min(len(keys), int(np.searchsorted(ends, begin + segment_ids - held)) + 1)
                ids.append(flat[begin : int(ends[stop - 1])])
                names += keys[done:stop].tolist()
                sizes += counts[done:stop].tolist()
                held += int(ends[stop - 1]) - begin
                done = stop
                if held >= segment_ids:
                    yield flush()
                    number, names, ids, sizes, held = number + 1, [], [], [], 0
        if names:
            yield flush()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = common.id_and_text(docs).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(*order)
    return rows.mapInArrow(run, SEGMENTS)


def decode(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of a stored table of segments."""
    sums = segments.groupBy("part").agg(F.sum("n_ids").alias("all"))
    before = sums.select("part", F.coalesce(F.sum("all").over(W.Window.orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = W.Window.partitionBy("part").orderBy("segment").rowsBetween(W.Window.unboundedPreceding, -1)
    starts = segments.select("part", "segment", F.coalesce(F.sum("n_ids").over(own), F.lit(0)).alias("own")).join(before, "part").select("part", "segment", (F.col("own") + F.col("before")).alias("start"))

    def run(batches):
        for batch in batches:
            for image, start in zip(batch.column("image"), batch.column("start").to_pylist(), strict=True):
                names, counts, ids = coder.read_segment(image.as_py())
                ends = np.cumsum(counts.astype(np.int64))
                data = ids.astype("<u4")
                crcs = [zlib.crc32(data[e - n : e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([common.id_array(names), pa.array(ends - counts + start), pa.array(counts.astype(np.int64)), pa.array(np.array(crcs, np.int64))], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    if segments.count() <= MAX_BROADCAST_SEGMENTS:
        starts = F.broadcast(starts)  # 20 bytes a segment, against shuffling all images
    return segments.join(starts, ["part", "segment"]).select("image", "start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """decode() of the stored segments of docs."""
    return decode(common.stored(encode(docs, tokenizer, end_id), "segments"))
