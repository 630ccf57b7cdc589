"""Removal of repeated passages by longest-previous-factor arrays over distributed suffix order.

A byte goes if it lies in a string of ``length`` bytes that also begins in a document
with a smaller doc_id. For the suffix at each position, its previous and next
smaller neighbours in suffix order (smaller: of an earlier document) give the
longest factor that begins earlier; where that is ``length`` or more, the
suffix's first ``length`` bytes go. The neighbours need only be known up to that length,
so suffixes are ordered by their first ``length`` bytes, and those are looked up between
groups of suffixes that cannot match across groups:

1. In each window of ``length`` bytes the k-gram of least hash is its anchor. Equal
   windows have equal anchors at equal places, so the windows of an anchor's
   hash form a closed group. Runs of neighbouring windows share an anchor.
2. Anchors that occur in one document alone are left out: chunks send their
   different anchor hashes to buckets, and hear which are shared.
3. Copies of a whole run are put together before any sorting: chunks send the
   hash of each shared run with the least doc_id that has it. A run that an earlier
   document has goes whole; one that differs from all others of its anchor
   only by its bytes, if at all, is asked about.
4. Of the runs asked about, the bytes of the first copy go to the anchor's bucket.
   Buckets sort the suffixes into a suffix array, find for each the previous and the next position
   in it of an earlier document (nearest smaller values), take the longer of the two common prefixes
   as the longest previous factor, and answer with a bit for each window of each run that has one of full length.
5. Chunks mark the bytes of all found windows and cut them out.

An anchor with many different runs (a passage of many documents with different
surroundings) is split: its windows are sent one by one to buckets by their
own hash, so that the groups that are sorted do not grow with it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks as ch
from . import common

GRAM = 16
#: Different runs of an anchor from which its windows are sent one by one.
HOT_RUNS = 4096
#: Anchors are told apart by the upper 48 bits of their mixed hash, runs of an anchor by 64 bits of another.
KEY_BITS = np.uint64(0xFFFFFFFFFFFF0000)
KEY_BYTES = 6


def gram_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position (those without as many following are left out)."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    buf = np.frombuffer(data, np.uint8)
    eight = np.lib.stride_tricks.as_strided(buf[:8].view("<u8"), (len(data) - 7,), (1,))
    h = eight[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += eight[8 : 8 + n]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    return h


def runs(data: bytes, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, anchor hash, document) of each run of windows that share an anchor; windows lie in one document."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none.view(np.uint64), none
    h = gram_hashes(data)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    span, width = 1, length - GRAM + 1
    least = key
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(len(anchor) + 1, np.int8)
    starts = np.concatenate([[0], ends[:-1]])
    some = ends - starts >= length
    np.add.at(inside, starts[some], 1)
    np.add.at(inside, ends[some] - length + 1, -1)
    window = np.nonzero(np.cumsum(inside[:-1], dtype=np.int8))[0]
    if not len(window):
        return none, none, none.view(np.uint64), none
    a = anchor[window]
    first = np.nonzero(np.concatenate([[True], a[1:] != a[:-1]]))[0]
    return window[first], np.diff(np.append(first, len(window))), h[a[first]], np.searchsorted(ends, window[first], "right")


def _windows(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The first length bytes from each start as rows of big-endian 64-bit words, the last one overlapping."""
    eight = np.lib.stride_tricks.as_strided(data[:8].view(">u8"), (len(data) - 7,), (1,))
    at = [*range(0, length - 7, 8)] + ([length - 8] if length % 8 else [])
    return np.stack([eight[starts + k].astype(np.uint64) for k in at])


def _content_hash(words: np.ndarray) -> np.ndarray:
    h = np.zeros(words.shape[1], np.uint64)
    for w in words:
        h = common.mix64(h ^ w)
    return h


class Runs:
    """A chunk's runs, its sorted different anchors, and, as answers are known, its shared runs and entries (different shared runs)."""

    def __init__(self, c: ch.Chunk, length: int) -> None:
        self.first, self.n, h, doc = runs(c.data, c.ends, length)
        # anchors are the least hashes of their windows; mixed, they are spread evenly over the buckets
        self.h, self.doc = common.mix64(h) & KEY_BITS, c.ids[doc] if len(doc) else doc
        order = np.lexsort((self.doc, self.h))
        h, d = self.h[order], self.doc[order]
        at = np.nonzero(np.concatenate([[True], h[1:] != h[:-1]]))[0] if len(h) else order
        self.anchors = h[at]
        self.several = np.maximum.reduceat(d, at) > d[at] if len(at) else np.zeros(0, bool)

    def keep_shared(self, c: ch.Chunk, shared: np.ndarray, length: int) -> None:
        """Keeps the runs of shared anchors, and sets entry (of each run) and keys, content and least (of each entry)."""
        some = shared[np.searchsorted(self.anchors, self.h)] > 0 if len(self.h) else np.zeros(0, bool)
        self.first, self.n, self.h, self.doc = self.first[some], self.n[some], self.h[some], self.doc[some]
        data = np.frombuffer(c.data + b"\0" * 8, np.uint8)
        a = _content_hash(_windows(data, self.first, length))
        b = _content_hash(_windows(data, self.first + self.n - 1, length))
        content = common.mix64(a + common.mix64(b ^ self.n.astype(np.uint64)))
        order = np.lexsort((self.doc, content, self.h))
        h, t = self.h[order], content[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (t[1:] != t[:-1])]) if len(h) else np.zeros(0, bool)
        at = order[np.nonzero(new)[0]]
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.of = at  # the run of the least doc_id of each entry
        self.keys, self.content, self.least = self.h[at], content[at], self.doc[at]


def _pieces(cut: np.ndarray, *arrays: np.ndarray) -> list[tuple[int, list[bytes]]]:
    return [(b, [ch.pack_array(x[cut[b] : cut[b + 1]]) for x in arrays]) for b in np.nonzero(np.diff(cut))[0].tolist()]


def _rows(c: ch.Chunk, found: list[tuple[int, list[bytes]]], width: int) -> pa.RecordBatch:
    cols = [pa.array([f[k] for _, f in found], pa.binary()) for k in range(width)]
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array([c.chunk] * len(found), pa.int64()), *cols], names=["bucket", "chunk", *"abcdef"[:width]])


def _send_anchors(length: int, buckets: int):
    def run(batches):
        for c in ch.each(batches):
            r = Runs(c, length)
            cut = ch.cuts(r.anchors, buckets)
            low = np.frombuffer(ch.pack_keys(r.anchors, KEY_BYTES), np.uint8).reshape(-1, KEY_BYTES - 1)
            found = [(b, [low[cut[b] : cut[b + 1]].tobytes(), ch.pack_array(r.several[cut[b] : cut[b + 1]])]) for b in np.nonzero(np.diff(cut))[0].tolist()]
            yield _rows(c, found, 2)

    return run


def _answered(rows: dict, bucket: int, state: np.ndarray, sizes: list[int]) -> pa.Table:
    cut = np.cumsum([0, *sizes])
    return pa.table({"chunk": pa.array(rows["chunk"], pa.int64()), "bucket": pa.array([bucket] * len(sizes), pa.int32()), "answer": pa.array([ch.pack_array(state[cut[i] : cut[i + 1]]) for i in range(len(sizes))], pa.binary())})


_ANSWER = "chunk long, bucket int, answer binary"


def _answer_anchors(buckets: int):
    def run(key, table):
        rows, b = table.to_pydict(), key[0].as_py()
        keys = [ch.unpack_keys(x, KEY_BYTES, b >> (buckets.bit_length() - 9)) for x in rows["a"]]
        joined, several = np.concatenate(keys), np.concatenate([ch.unpack_array(x, bool) for x in rows["b"]])
        _, inverse, n = np.unique(joined, return_inverse=True, return_counts=True)
        any_ = np.bincount(inverse, several) > 0
        return _answered(rows, b, ((n > 1) | any_)[inverse].astype(np.uint8), [len(k) for k in keys])

    return run


def _send_runs(length: int, buckets: int):
    def run(batches):
        for c in ch.each(batches):
            r = Runs(c, length)
            r.keep_shared(c, _states(c.answers), length)
            cut = ch.cuts(r.keys, buckets)
            cols = [np.frombuffer(ch.pack_keys(x, KEY_BYTES), np.uint8).reshape(-1, KEY_BYTES - 1) for x in (r.keys,)]
            found = [(b, [cols[0][cut[b] : cut[b + 1]].tobytes(), r.content[cut[b] : cut[b + 1]].astype("<u8").tobytes(), ch.pack_array(r.least[cut[b] : cut[b + 1]])]) for b in np.nonzero(np.diff(cut))[0].tolist()]
            yield _rows(c, found, 3)

    return run


def _answer_runs(buckets: int, hot_runs: int):
    """0: nothing of the run goes; 1: its bytes are asked for; 2: all of it goes; 3: its windows are asked for one by one."""

    def run(key, table):
        rows, b = table.to_pydict(), key[0].as_py()
        keys = [ch.unpack_keys(x, KEY_BYTES, b >> (buckets.bit_length() - 9)) for x in rows["a"]]
        h, doc = np.concatenate(keys), np.concatenate([ch.unpack_array(x, np.int64) for x in rows["c"]])
        content = np.frombuffer(b"".join(rows["b"]), "<u8")
        order = np.lexsort((doc, content, h))
        hs, cs, ds = h[order], content[order], doc[order]
        new_h = np.concatenate([[True], hs[1:] != hs[:-1]])
        new = new_h | np.concatenate([[True], cs[1:] != cs[:-1]])
        of_h = np.cumsum(new_h) - 1
        contents = np.bincount(of_h, new)[of_h]
        least = ds[np.nonzero(new)[0]][np.cumsum(new) - 1]
        state = np.empty(len(h), np.uint8)
        state[order] = np.where(ds > least, 2, np.where(contents == 1, 0, np.where(contents > hot_runs, 3, 1)))
        return _answered(rows, b, state, [len(k) for k in keys])

    return run


def _states(answers: list[bytes] | None) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint8), *(ch.unpack_array(x, np.uint8) for x in answers or [])])


def _send_pieces(length: int, buckets: int):
    top = np.uint64(64 - (buckets.bit_length() - 1))

    def run(batches):
        for c in ch.each(batches):
            r = Runs(c, length)
            r.keep_shared(c, _states(c.answers), length)
            state = _states(c.states)
            ask = np.nonzero(state == 1)[0]
            bucket, start, size, entry, shift = [r.keys[ask] >> top], [r.first[r.of[ask]]], [r.n[r.of[ask]] + length - 1], [ask], [np.zeros(len(ask), np.int64)]
            ask = np.nonzero(state == 3)[0]
            if len(ask):
                n = r.n[r.of[ask]]
                k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(r.first[r.of[ask]], n) + k
                bucket.append(_content_hash(_windows(np.frombuffer(c.data + b"\0" * 8, np.uint8), at, length)) >> top)
                start.append(at)
                size.append(np.full(len(at), length))
                entry.append(np.repeat(ask, n))
                shift.append(k)
            bucket, start, size, entry, shift = (np.concatenate(x).astype(np.int64) for x in (bucket, start, size, entry, shift))
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            found = []
            for b in np.nonzero(np.diff(cut))[0].tolist():
                p = order[cut[b] : cut[b + 1]]
                text = b"".join([c.data[s : s + z] for s, z in zip(start[p].tolist(), size[p].tolist(), strict=True)])
                found.append((b, [*(ch.pack_array(x) for x in (r.least[entry[p]], entry[p].astype("<i4"), shift[p].astype(np.uint8), size[p].astype(np.uint8))), ch.pack_array(np.frombuffer(text, np.uint8))]))
            if found:
                yield _rows(c, found, 5)

    return run


def previous_smaller(x: np.ndarray) -> np.ndarray:
    """Of each place the nearest place before it with a smaller value (-1: none).

    Minima of windows of 1, 2, 4, ... places are built; each place then skips, the widest
    window first, all windows before it that hold nothing smaller.
    """
    n = len(x)
    levels = [x]
    while 1 << len(levels) <= n:
        last, w = levels[-1], 1 << (len(levels) - 1)
        levels.append(np.concatenate([last[:w], np.minimum(last[w:], last[:-w])]))  # ends at the place; at the left edge shorter
    at = np.arange(n) - 1
    for k in range(len(levels) - 1, -1, -1):
        skip = (levels[k].take(at, mode="clip") >= x) & (at >= 0)
        at -= skip.astype(np.int64) << k
        np.maximum(at, -1, out=at)
    return at


def common_prefix(words: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Equal leading bytes, up to length, of suffixes a and b."""
    out = np.full(len(a), length, np.int64)
    same = np.ones(len(a), bool)
    for k, w in enumerate(words):
        differ = w.take(a, mode="clip") ^ w.take(b, mode="clip")
        first = np.nonzero(same & (differ > 0))[0]
        if len(first):
            start = min(8 * k, length - 8)
            out[first] = start + sum((differ[first] < np.uint64(1 << (8 * j))).astype(np.int64) for j in range(1, 8))
            same[first] = False
    return out


def longest_previous_factors(words: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """For each suffix the length, up to length, of its longest factor that also begins in an earlier document.

    words: the suffixes' first length bytes, as rows of words; doc: their documents' ranks. In
    suffix order, the longest match with an earlier document is at the previous or the next
    place of a smaller doc: any other is farther away, and common prefixes only shrink with distance.
    """
    order = np.lexsort((doc, *words[::-1])) if len(doc) else np.zeros(0, np.int64)
    d = doc[order]
    ordered = words[:, order] if len(doc) else words
    n = len(d)
    previous = previous_smaller(d)
    following = n - 1 - previous_smaller(d[::-1])[::-1]
    here = np.arange(n)
    factor = np.zeros(n, np.int64)
    for other in (previous, following):
        some = np.nonzero((other >= 0) & (other < n))[0]
        factor[some] = np.maximum(factor[some], common_prefix(ordered, here[some], other[some], length))
    out = np.empty(n, np.int64)
    out[order] = factor
    return out


def _answer_pieces(length: int, at_once: int = 1 << 17):
    """Windows are sorted at_once of them, dealt by a hash of their bytes, so memory does not grow with a bucket's suffixes."""

    def run(key, table):
        rows = table.to_pydict()
        size = [ch.unpack_array(x, np.uint8).astype(np.int64) for x in rows["d"]]
        data = np.frombuffer(b"".join([ch.unpack_array(x, np.uint8).tobytes() for x in rows["e"]]) + b"\0" * 8, np.uint8)
        doc = np.unique(np.concatenate([ch.unpack_array(x, np.int64) for x in rows["a"]]), return_inverse=True)[1]
        sizes = np.concatenate(size)
        n = sizes - length + 1
        begin = np.cumsum(sizes) - sizes
        piece = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
        at = begin[piece] + k
        found = np.zeros(len(at), bool)
        passes = -(-len(at) // at_once)
        if passes > 1:
            turn = np.concatenate([_content_hash(_windows(data, at[lo : lo + at_once], length)) % np.uint64(passes) for lo in range(0, len(at), at_once)])
            for t in range(passes):
                some = np.nonzero(turn == t)[0]
                found[some] = longest_previous_factors(_windows(data, at[some], length), doc[piece[some]], length) >= length
        elif passes:
            found = longest_previous_factors(_windows(data, at, length), doc[piece], length) >= length
        shift = np.concatenate([ch.unpack_array(x, np.uint8) for x in rows["c"]]).astype(np.int64)
        mask = np.zeros(len(n), np.uint64)
        np.bitwise_or.at(mask, piece[found], np.uint64(1) << (k + shift[piece])[found].astype(np.uint64))
        cut = np.cumsum([0] + [len(s) for s in size])
        out = [[], [], []]
        common.trim()
        for i, c in enumerate(rows["chunk"]):
            m = mask[cut[i] : cut[i + 1]]
            if m.any():
                out[0].append(c)
                out[1].append(ch.pack_array(ch.unpack_array(rows["b"][i], "<i4")[m > 0]))
                out[2].append(ch.pack_array(m[m > 0]))
        return pa.table({"chunk": pa.array(out[0], pa.int64()), "entries": pa.array(out[1], pa.binary()), "masks": pa.array(out[2], pa.binary())})

    return run


def _cut(length: int, texts: bool):
    def run(batches):
        for c in ch.each(batches):
            cover = np.zeros(len(c.data) + 1, np.int32)
            if c.answers:
                r = Runs(c, length)
                r.keep_shared(c, _states(c.answers), length)
                state = _states(c.states)
                mask = np.zeros(len(state), np.uint64)
                for e, m in zip(c.entries or [], c.masks or [], strict=True):
                    np.bitwise_or.at(mask, ch.unpack_array(e, "<i4"), ch.unpack_array(m, "<u8"))
                whole = (state[r.entry] == 2) | (r.doc > r.least[r.entry])
                mask = np.where(whole, (np.uint64(1) << r.n.astype(np.uint64)) - np.uint64(1), mask[r.entry])
                hit = np.nonzero(mask)[0]
                bits = np.unpackbits(mask[hit].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                i, k = np.nonzero(bits)
                at = r.first[hit][i] + k
                np.add.at(cover, at, 1)
                np.add.at(cover, at + length, -1)
            gone = np.cumsum(cover[:-1]) > 0
            data = np.frombuffer(c.data, np.uint8)
            rows, at = [], 0
            for name, end in zip(c.ids.tolist(), c.ends.tolist(), strict=True):
                g = gone[at:end]
                removed = int(g.sum())
                spans = int((g[1:] & ~g[:-1]).sum()) + int(g[0]) if removed else 0
                kept = data[at:end][~g].tobytes() if removed else c.data[at:end]
                rows.append((name, end - at, removed, spans, kept.decode("utf-8", "replace") if texts else hashlib.sha256(kept).hexdigest()))
                at = end
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([common.id_array(cols[0]), *(pa.array(x, pa.int64()) for x in cols[1:4]), pa.array(cols[4], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept" if texts else "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame, length: int = 50, texts: bool = False, hot_runs: int = HOT_RUNS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 (texts: kept, the text that is left) of every row of docs.

    length: of the strings compared, GRAM to 64 + GRAM - 1 bytes. Strings are judged on the
    input, in bytes of UTF-8, and never reach from one document into another.
    hot_runs: different runs of an anchor from which its windows are sent one by one.
    Rows of the same doc_id do not remove each other's bytes; a null doc_id is smaller than all others.
    A removal may split a character; texts then has U+FFFD in its place.
    """
    if not GRAM <= length < 64 + GRAM:
        raise ValueError(f"length is {GRAM} to {63 + GRAM}")
    common.bounded_batches(docs.sparkSession)
    table = ch.chunked(docs, 1 << 20)
    n_bytes = table.agg(F.sum("n_bytes")).first()[0] or 0
    buckets, tasks = common.parts_for(docs.sparkSession, n_bytes, least=256), ch.tasks_for(docs.sparkSession, n_bytes)

    def sent(columns: str) -> str:
        return ", ".join(["bucket int, chunk long", *(f"{x} binary" for x in columns)])

    anchors = table.mapInArrow(_send_anchors(length, buckets), sent("ab"))
    shared = common.stored(ch.dealt(anchors, "bucket", tasks).groupBy("bucket").applyInArrow(_answer_anchors(buckets), _ANSWER), "shared")
    known = ch.with_answers(table, shared, tasks=tasks)
    entries = known.mapInArrow(_send_runs(length, buckets), sent("abc"))
    states = common.stored(ch.dealt(entries, "bucket", tasks).groupBy("bucket").applyInArrow(_answer_runs(buckets, hot_runs), _ANSWER), "states")
    known = ch.with_answers(known, states, name="states", tasks=tasks)
    pieces = known.mapInArrow(_send_pieces(length, buckets), sent("abcde"))
    masks = common.stored(ch.dealt(pieces, "bucket", tasks).groupBy("bucket").applyInArrow(_answer_pieces(length), "chunk long, entries binary, masks binary"), "masks")
    known = known.join(ch.dealt(masks, "chunk", tasks).groupBy("chunk").agg(F.collect_list("entries").alias("entries"), F.collect_list("masks").alias("masks")), "chunk", "left")
    return known.mapInArrow(_cut(length, texts), f"doc_id long, n_bytes long, n_removed long, n_spans long, {'kept' if texts else 'kept_sha256'} string")
