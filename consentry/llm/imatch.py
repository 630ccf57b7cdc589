"""Document fingerprints by I-Match with randomised lexicons.

The lexicon is every term (lower-cased word) whose inverse document frequency,
ln(documents / documents with the term), lies in a chosen band: common words
say little, and the rarest are mistakes and numbers. A document's terms in the lexicon,
distinct and sorted, are hashed once for each of several random subsets of the
lexicon. Subsets of several densities are used, so that long and short
documents both have some that hold few of their terms. Two texts are as alike
as the share of equal hashes among the subsets that hold a term of either.

A text with no term in any subset is fingerprinted by all its terms together,
so equal texts always have equal fingerprints and other texts do not.

Documents are put in ascending order of doc_id in chunks; document frequencies
over all documents come back to each chunk for its own terms (see chunks).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import chunks as ch
from . import common

#: Shares of the lexicon in a subset, as powers of two; each is used SEEDS times.
DENSITIES, SEEDS = (4, 6, 8, 10), 8
SUBSETS = len(DENSITIES) * SEEDS
_SEED = [np.uint64(xxhash.xxh64_intdigest(f"lexicon {j}".encode())) for j in range(SUBSETS)]
#: Terms are told apart by the upper 48 bits of their hash.
KEY_BITS = np.uint64(0xFFFFFFFFFFFF0000)
#: Of the compression of texts, which are shuffled twice and stored once.
LEVEL = 6


def terms(text: bytes) -> np.ndarray:
    """Sorted different keys of the text's terms."""
    h = xxhash.xxh64_intdigest
    return np.unique(np.array([h(w) for w in set(text.lower().split())], np.uint64) & KEY_BITS)


def edited(text: str, following: str) -> str:
    """text with its last quarter replaced by as many first characters of the following text, or all of it."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


class Lexicon:
    """The answers of a chunk: its sorted keys, and which of them are in the band."""

    def __init__(self, keys: np.ndarray, df: np.ndarray, n_docs: int, low: float, high: float) -> None:
        idf = np.log(max(1, n_docs) / np.maximum(df, 1))
        self.keys = keys[(df > 0) & (idf >= low) & (idf <= high)]
        # which subsets each term is in, for all terms at once
        self.member = np.stack([common.mix64(self.keys ^ seed) >> np.uint64(64 - DENSITIES[j // SEEDS]) == 0 for j, seed in enumerate(_SEED)], 1)

    def hashes(self, own: np.ndarray) -> list[str]:
        """A hash per subset, '-' for one without any of the text's terms; one hash of all terms if no subset has any."""
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
            at = at[self.keys[at] == own]
            kept, member = self.keys[at], self.member[at].T
            out = [xxhash.xxh64_hexdigest(kept[row].tobytes())[:12] if some else "-" for row, some in zip(member, member.any(1).tolist(), strict=True)]
            if any(x != "-" for x in out):
                return out
        return [f"all{xxhash.xxh64_hexdigest(own.tobytes())}"]


def likeness(a: list[str], b: list[str]) -> float:
    if a == b:
        return 1.0
    if len(a) != len(b):
        return 0.0
    told = [(x, y) for x, y in zip(a, b, strict=True) if x != "-" or y != "-"]
    return sum(x == y for x, y in told) / len(told) if told else 0.0


_ORDERED = ch.SCHEMA + ", next binary, next_bytes long"


def _compressed(batches):
    for ids, texts, part in common.doc_batches(batches):
        yield pa.RecordBatch.from_arrays([common.id_array(ids), part.column("hash"), pa.array([len(t) for t in texts], pa.int64()), pa.array([ch.pack(t, LEVEL) for t in texts], pa.binary())], names=["doc_id", "hash", "size", "text"])


def _ordered_chunks(docs: DataFrame, size: int) -> DataFrame:
    """Stored chunks in ascending order of doc_id, each with next: the text that follows its last one (at the end: the first of all).

    A task knows what follows all of its documents but the last one, which it
    puts in a chunk of its own; only those meet with the first texts of the other tasks.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash")]
    rows = common.id_and_text(docs).withColumn("hash", F.xxhash64("text")).mapInArrow(_compressed, "doc_id long, hash long, size long, text binary")
    rows = rows.repartitionByRange(order[0]).sortWithinPartitions(*order)

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        ids, texts, held, last = [], [], 0, None

        def emit(following: bytes | None):
            cols = [*ch.row(number, ids, texts, LEVEL), pa.array([None if following is None else ch.pack(following)], pa.binary()), pa.array([None if following is None else len(following)], pa.int64())]
            return pa.RecordBatch.from_arrays(cols, names=[*ch._NAMES, "next", "next_bytes"])

        for batch in batches:
            for key, n, z in zip(common.ids_of(batch.column("doc_id")).tolist(), batch.column("size").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = ch.unpack(z, n)
                if last is not None:
                    ids.append(last[0])
                    texts.append(last[1])
                    held += len(last[1])
                    if held >= size:
                        yield emit(text)
                        number, ids, texts, held = number + 1, [], [], 0
                last = key, text
        if last is not None:
            if texts:
                yield emit(last[1])
                number += 1
            ids, texts = [last[0]], [last[1]]
            yield emit(None)

    def heads(batches):
        for c in ch.each(batches):
            yield pa.RecordBatch.from_arrays([pa.array([c.chunk >> 32]), pa.array([ch.pack(next(c.texts()))], pa.binary()), pa.array([int(c.ends[0])])], names=["part", "next", "next_bytes"])

    table = common.stored(rows.mapInArrow(run, _ORDERED), "ordered")
    known, tails = table.where("next is not null"), table.where("next is null").drop("next", "next_bytes")
    firsts = table.where(F.col("chunk") % (1 << 32) == 0).mapInArrow(heads, "part long, next binary, next_bytes long")
    parts = firsts.select("part")
    whole = W.Window.orderBy("part")  # one row per task
    order_ = parts.select("part", F.lead("part").over(whole).alias("after"), F.first("part").over(whole).alias("first")).select(F.col("part").alias("tail"), F.coalesce("after", "first").alias("part"))
    following = order_.join(firsts, "part").select("tail", "next", "next_bytes")
    tails = tails.withColumn("tail", F.shiftright("chunk", 32)).join(following, "tail").drop("tail")
    return known.unionByName(tails)


def _texts(c: ch.Chunk) -> tuple[list[str], list[str]]:
    """The chunk's texts with the first one of the next chunk at the end, and the edited text of each of its own."""
    own = [t.decode("utf-8", "replace") for t in c.texts()]
    own.append(ch.unpack(c.next, c.next_bytes).decode("utf-8", "replace"))
    return own, [edited(a, b) for a, b in zip(own[:-1], own[1:], strict=True)]


def _keys(c: ch.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Keys with the number of the chunk's documents that have them; 0 for those of edited texts and of the next text alone."""
    own, changed = _texts(c)
    counted = [terms(t.encode()) for t in own[:-1]]
    asked = np.concatenate([terms(t.encode()) for t in [own[-1], *changed]])
    keys, n = np.unique(np.concatenate(counted), return_counts=True)
    more = np.setdiff1d(asked, keys)
    both = np.concatenate([keys, more])
    order = np.argsort(both)
    return both[order], np.concatenate([n, np.zeros(len(more), np.int64)])[order]


def fingerprints(docs: DataFrame, low: float = 3.0, high: float = 9.0, size: int = 4 << 20) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row of docs.

    low, high: the band of inverse document frequencies. A text's edited form has
    its last quarter replaced by the head of the next document in ascending
    doc_id (nulls first, rows of one id by the hash of their text; after the last
    the first). A null text is the empty text, whose fingerprint is the hash of no term; all
    empty texts share it, and their likeness to each other is 1. No row, no result. near_edited and near_next: likeness of the document's fingerprint to that of
    its edited form and of the next document.
    """
    common.bounded_batches(docs.sparkSession)
    table = _ordered_chunks(docs, size)
    seen = table.agg(F.sum("n_bytes"), F.sum("n_docs")).first()
    n_docs, buckets = seen[1] or 0, common.parts_for(docs.sparkSession, seen[0] or 0, least=256)
    tasks = ch.tasks_for(docs.sparkSession, seen[0] or 0)
    answers = ch.totals(table, _keys, buckets, key_bytes=6, tasks=tasks)

    def run(batches):
        for c in ch.each(batches):
            own, changed = _texts(c)
            t_own, t_changed = ([terms(t.encode()) for t in x] for x in (own, changed))
            keys = np.unique(np.concatenate([*t_own, *t_changed]))
            lexicon = Lexicon(keys, ch.all_counts(c.answers), n_docs, low, high)
            prints, prints_changed = ([lexicon.hashes(t) for t in x] for x in (t_own, t_changed))
            n = len(c.ids)
            cols = [common.id_array(c.ids), pa.array([len(t) for t in own[:n]], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed])]
            cols += [pa.array([".".join(p) for p in prints[:n]]), pa.array([".".join(p) for p in prints_changed])]
            cols += [pa.array([likeness(a, b) for a, b in zip(prints[:n], x, strict=True)], pa.float64()) for x in (prints_changed, prints[1:])]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return ch.with_answers(table, answers, tasks=tasks).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
