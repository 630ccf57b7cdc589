"""Cost-balanced packing of documents into fixed-size training sequences.

A sequence of pieces of lengths l costs ``sum(linear * l + quadratic * l**2)``:
the matrix products grow with the tokens, attention with their square, and a
piece attends only to itself. Documents are taken in descending cost, each to
the lowest-cost sequence that has room for it; if none has,
it is cut and its head fills the cheapest one. Documents longer than a sequence
first give whole sequences.

Packing is narrow: each task packs blocks of a bounded number of tokens as it
reads, so no document is shuffled and no group of documents meets in one task.
Each block leaves less than one sequence of padding. Where an order of the
documents is given, they are first range-partitioned and sorted by it, blocks follow
it, and so do a block's sequences, by the mean place of their ids.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import common, tokens

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


class _Rooms:
    """Open sequences by remaining capacity: a heap for each, under a tree of the cheapest."""

    NONE = (float("inf"), -1)

    def __init__(self, capacity: int, sequences: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
        self.tree = [self.NONE] * (2 * self.size)
        self.heaps[capacity] = [(0.0, s) for s in range(sequences)]
        self._top(capacity)

    def _top(self, room: int) -> None:
        tree, at = self.tree, self.size + room
        tree[at] = self.heaps[room][0] if self.heaps[room] else self.NONE
        while at > 1:
            at >>= 1
            a, b = tree[2 * at], tree[2 * at + 1]
            tree[at] = a if a < b else b

    def put(self, room: int, cost: float, sequence: int) -> None:
        heapq.heappush(self.heaps[room], (cost, sequence))
        self._top(room)

    def take(self, room: int) -> tuple[float, int, int] | None:
        """Removes the cheapest sequence with so much room or more: its cost, number and room."""
        tree, at, best = self.tree, self.size + room, self.NONE
        node = at
        if tree[at] < best:
            best, node = tree[at], at
        while at > 1:
            if not at & 1 and tree[at + 1] < best:
                best, node = tree[at + 1], at + 1
            at >>= 1
        if best[1] < 0:
            return None
        while node < self.size:
            node = 2 * node if tree[2 * node] == best else 2 * node + 1
        room = node - self.size
        heapq.heappop(self.heaps[room])
        self._top(room)
        return best[0], best[1], room


def assign(lengths: list[int], capacity: int = 1024, linear: float = 1.0, quadratic: float = 1 / 2048) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) for documents of these lengths (each 1 or more).

    linear, quadratic: the cost of a piece. Ties go to the earlier
    document and the lower sequence number.
    """
    sequences = 0
    rest: list[tuple[int, int]] = []
    for doc, n in enumerate(lengths):
        for k in range(n // capacity):
            yield doc, k * capacity, capacity, sequences, 0
            sequences += 1
        if n % capacity:
            rest.append((-(n % capacity), doc))
    open_ = _Rooms(capacity, -(sum(n for n, _ in rest) // capacity))
    heapq.heapify(rest)
    while rest:
        n, doc = heapq.heappop(rest)
        n = -n
        cost, s, room = open_.take(n) or open_.take(1)
        take = min(n, room)
        yield doc, lengths[doc] - n, take, sequences + s, capacity - room
        if take < room:
            open_.put(room - take, cost + linear * take + quadratic * take * take, s)
        if take < n:
            heapq.heappush(rest, (take - n, doc))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, block_tokens: int = 1 << 20, linear: float = 1.0, quadratic: float = 1 / 2048, order: str | None = None) -> DataFrame:
    """Pieces of all documents, packed.

    tokenizer: path of a tokenizers file. A document's ids are those of its whole
    text and then end_id. A null or empty text is the end id alone. Repeated rows
    are packed as often as they occur; an empty table gives no piece.
    ids_crc32: of the piece's ids as little-endian unsigned 32-bit integers.
    sequence_id is unique in the result; offsets in a sequence have no gaps.
    order: column of docs that ascending sequence_ids follow (none: as they are read).
    """

    def run(batches):
        encoder = tokens.cache(tokenizer)
        base = TaskContext.get().partitionId() << 36
        ids: list[np.ndarray] = []
        names: list[int] = []
        sizes: list[int] = []
        held = 0

        def flush():
            nonlocal base, held
            out, places, top, first = [], [], -1, base
            data = memoryview(np.concatenate(ids or [np.zeros(0)]).astype("<u4").tobytes())
            begin = np.cumsum([0, *sizes]).tolist()
            for doc, start, length, seq, offset in assign(sizes, capacity, linear, quadratic):
                at = 4 * (begin[doc] + start)
                out.append((names[doc], start, length, zlib.crc32(data[at : at + 4 * length]), sizes[doc], base + seq, offset))
                places.append(doc)
                top = max(top, seq)
            base += top + 1
            held = 0
            ids.clear()
            names.clear()
            sizes.clear()
            cols = np.array(out, np.int64).T if out else np.zeros((7, 0), np.int64)
            if order and out:
                places = np.array(places)
                seq = cols[5] - first
                mean = np.bincount(seq, places * cols[2]) / np.maximum(np.bincount(seq, cols[2]), 1)
                rank = np.empty(len(mean), np.int64)
                rank[np.argsort(mean, kind="stable")] = np.arange(len(mean))
                cols[5] = first + rank[seq]
            return pa.RecordBatch.from_arrays([common.id_array(cols[0]), *(pa.array(c) for c in cols[1:])], schema=ARROW)

        for keys, texts, _ in common.doc_batches(batches, rows=1 << 13, size=16 << 20):
            flat, counts = encoder.ended(texts, end_id)
            ends = np.cumsum(counts)
            done = 0  # documents of this batch in blocks already packed
            while done < len(keys):
                begin = int(ends[done - 1]) if done else 0
                stop = min(len(keys), int(np.searchsorted(ends, begin + block_tokens - held)) + 1)
                ids.append(flat[begin : int(ends[stop - 1])])
                names += keys[done:stop].tolist()
                sizes += counts[done:stop].tolist()
                held += int(ends[stop - 1]) - begin
                done = stop
                if held >= block_tokens:
                    yield flush()
        yield flush()

    if order:
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        docs = docs.repartitionByRange(parts, order).sortWithinPartitions(order)
    return common.id_and_text(docs).mapInArrow(run, SCHEMA)
