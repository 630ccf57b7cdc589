"""Near-duplicates by SimHash, checked and completed by exact similarity of word shingles: links, prefix filtering, groups.

SimHash groups (op6's fingerprints and search) come first: each set is paired with the least one of its
group, and a link stays if the whole sets are similar. Texts that are similar but differ in
more bits are found by prefix filtering, which leaves out no link.

Two sets of shingles of Jaccard similarity num / den or more share one of their first
n - ceil(n * num / den) + 1 shingles in any order that is common to all sets. The order
here puts shingles that many sets have last, by how many of a fixed share of the sets have them, all others by their
hash: the counts change how many sets meet, never which links are found. What meets
at a shingle is narrowed by bounds that no similar pair exceeds (sizes, positions and
the parity of 128 classes of shingles), and each pair left is compared by its whole sets.

Sets are told apart by 64-bit hashes, shingles by 48-bit ones. Equal sets are one set
from the start. The first round links sets to the least one of their SimHash group and of what they meet at their first
few shingles, the next to a few sets at every shingle of the prefixes, other ones at each, so that many near copies of one text
become one group by a number of links in proportion to theirs. The last, which tries all pairs at all shingles of the
prefixes, leaves out those that are already in one group. Before whole sets are moved, pairs are narrowed by sketches a
twenty-fourth of their size or less, which leave out no similar pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash

SEED = 42
#: The table of bits that is built on the driver and broadcast: 8 MB.
MOST_BITS = 1 << 26
#: What a shingle of a prefix sends: 32 of its bits (others that have them only make more pairs to compare) and its set.
ENTRY = np.dtype([("key", "<u4"), ("set", "<i8"), ("group", "<i8"), ("n", "<u4"), ("at", "<u4"), ("low", "<u8"), ("high", "<u8")])


def shingles(text: bytes, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's lower-cased word shingles; a shorter text is one shingle, one without words none."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((h(b" ".join(w[i : i + words]), SEED) for i in range(max(1, len(w) - words + 1))), np.uint64) >> np.uint64(16))


def packed(hashes: np.ndarray) -> bytes:
    """The six bytes of each 48-bit hash."""
    return hashes.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(x, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_hash, set, SimHash fingerprint (op6's) and the set's shingles of every row of docs."""

    def run(batches):
        for ids, texts, part in common.doc_batches(batches):
            found = [packed(shingles(t, words)) for t in texts]
            names = np.array([xxhash.xxh64_intdigest(x, SEED) for x in found], np.uint64).view(np.int64)
            fps = np.array([simhash.fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([common.id_array(ids), part.column("text_hash"), pa.array(names), pa.array(fps), pa.array(found, pa.binary())], names=["doc_id", "text_hash", "set", "fp", "shingles"])

    return common.id_and_text(docs).withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, "doc_id long, text_hash long, set long, fp long, shingles binary")


def sketch(hashes: np.ndarray) -> bytes:
    """The parity of as many classes of the hashes as they are, or up to twice as many (a power of two, 128 at least)."""
    bits = 1 << max(7, (len(hashes) - 1).bit_length())
    return np.packbits(np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ, the longer one folded: no more than the hashes that only one of the sets has."""
    x, y = (np.frombuffer(s, np.uint8) for s in (a, b))
    n = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(s.reshape(-1, n), 0) for s in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def _common(sets: DataFrame, total: int, rate: int = 4, least: int = 6, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles (their upper 32 bits) that at least so many sets of one in rate have, and in how many.

    The share of the sets that are counted is fixed, so a shingle left out of the result stays as rare in a larger corpus: what meets at it
    is some least * rate sets, whatever their number. Small corpora are counted whole.
    """
    spark = sets.sparkSession
    rate = max(1, min(rate, total // 4096))
    some = sets.where(F.pmod(F.xxhash64("set"), F.lit(rate)) == 0).select("shingles")
    n_bytes = some.agg(F.sum(F.length("shingles"))).first()[0] or 0
    buckets = common.parts_for(spark, n_bytes)

    def deal(batches):
        for batch in batches:
            keys = np.concatenate([np.zeros(0, np.uint64), *(unpacked(x.as_py()) for x in batch.column(0))]) >> np.uint64(16)
            to = (keys & np.uint64(buckets - 1)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            keys, to = keys[order].astype("<u4"), to[order]
            at = np.nonzero(np.concatenate([[True], to[1:] != to[:-1]]))[0] if len(to) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(to[at]), pa.array([x.tobytes() for x in np.split(keys, at[1:])] if len(to) else [], pa.binary())], names=["bucket", "keys"])

    def count(found):
        keys, n = np.unique(np.frombuffer(b"".join(x.as_py() for x in found["keys"]), "<u4"), return_counts=True)
        often = n >= least
        return pa.table({"key": pa.array(keys[often].astype(np.int64)), "n": pa.array(n[often].astype(np.int64))})

    counted = some.mapInArrow(deal, "bucket int, keys binary").groupBy("bucket").applyInArrow(count, "key long, n long")
    counted = common.stored(common.few(counted, n_bytes), "counted")
    rows = counted.count()
    found = (counted.orderBy(F.desc("n"), "key").limit(most) if rows > most else counted).toArrow()
    keys = np.asarray(found["key"]).astype(np.uint64)
    order = np.argsort(keys)
    got = keys[order], np.asarray(found["n"])[order]
    common.drop_stored(counted)
    return got


def _prefixes(sets: DataFrame, hot: tuple[np.ndarray, np.ndarray], num: int, den: int) -> DataFrame:
    """set, n, the prefix and the sketch of each set that has shingles, once each."""
    spread = sets.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        keys, counts = spread.value
        seen: set[int] = set()
        for batch in batches:
            out = []
            for name, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = unpacked(x.as_py())
                if not len(s) or name in seen:
                    continue
                if len(seen) > 1 << 20:
                    seen.clear()
                seen.add(name)
                often = np.zeros(len(s), np.int64)
                if len(keys):
                    top = s >> np.uint64(16)
                    at = np.minimum(np.searchsorted(keys, top), len(keys) - 1)
                    often = np.where(keys[at] == top, counts[at], 0)
                n = len(s)
                first = s[np.lexsort((s, often))][: n - (n * num + den - 1) // den + 1]
                out.append((name, n, packed(first), sketch(s)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["set", "n", "prefix", "sketch"])

    rows = sets.select("set", "shingles").mapInArrow(run, "set long, n int, prefix binary, sketch binary")
    return rows.groupBy("set").agg(*(F.first(c).alias(c) for c in ("n", "prefix", "sketch")))


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether entries a and b of one shingle may be of a similar pair of different groups, of which it is the first common one."""
    x, y = a["n"].astype(np.int64), b["n"].astype(np.int64)
    both = -(-num * (x + y) // (num + den))  # the least overlap of a similar pair
    left = np.minimum(x - a["at"], y - b["at"])
    return (a["group"] != b["group"]) & (left >= both) & (np.bitwise_count(a["low"] ^ b["low"]).astype(np.int64) + np.bitwise_count(a["high"] ^ b["high"]) <= x + y - 2 * both)


def pairs_of(e: np.ndarray, num: int, den: int, hubs: int | None, block: int = 1024) -> np.ndarray:
    """Distinct pairs (least first) of the sets of entries e that may be similar.

    hubs: all (None), those with the least set of a shingle (0), or with so many sets that a hash picks for each shingle.
    """
    order = common.mix64(e["set"].astype(np.uint64) ^ common.mix64(e["key"].astype(np.uint64))) if hubs else e["set"]
    e = e[np.lexsort((order, e["key"]))]
    begins = np.nonzero(np.concatenate([[True], e["key"][1:] != e["key"][:-1]]))[0] if len(e) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(begins, len(e)))
    out = [np.zeros((0, 2), np.int64)]
    if hubs is None:
        for lo, n in zip(begins[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            g = e[lo : lo + n]
            if (g["group"] == g["group"][0]).all():
                continue
            for i in range(0, n, block):
                for j in range(i, n, block):
                    a, b = g[i : i + block, None], g[None, j : j + block]
                    x, y = np.nonzero(similar(a, b, num, den) & (a["set"] < b["set"]))
                    if len(x):
                        out.append(np.stack([a["set"][x, 0], b["set"][0, y]], 1))
    elif len(e):
        for k in range(max(1, hubs)):
            hub = np.repeat(begins + np.minimum(k, sizes - 1), sizes)
            at = np.nonzero(similar(e[hub], e, num, den) & (e["set"][hub] != e["set"]))[0]
            out.append(np.sort(np.stack([e["set"][hub[at]], e["set"][at]], 1), axis=1))
    return np.unique(np.concatenate(out), axis=0)


def _by_fingerprint(sets: DataFrame, limit: int, n_bytes: int) -> DataFrame:
    """Pairs (a, b) of each set and the least set of its SimHash group: of fingerprints that links of limit or fewer differing bits reach."""
    held = common.stored(common.few(sets.select("set", "fp").distinct(), n_bytes), "held")
    roots = simhash.components(simhash.links(common.stored(common.few(held.select("fp").distinct(), n_bytes), "distinct"), limit))
    named = held.join(roots, held.fp == roots.node, "left").select("set", F.coalesce("root", "fp").alias("root")).distinct()
    return named.join(named.groupBy("root").agg(F.min("set").alias("a")), "root").select("a", F.col("set").alias("b")).where("a <> b")


def _candidates(prefixes: DataFrame, buckets: int, num: int, den: int, most: int | None, hubs: int | None) -> DataFrame:
    """Pairs (a, b) of sets of different groups that may be similar. prefixes: with a column group.

    most: if given, only at so many first shingles of a prefix. hubs: which pairs meet at a shingle (see pairs_of).
    """

    def parts(batches, size=1 << 18):
        """Slices of the batches with some size shingles, which keep the arrays of entries small."""
        for batch in batches:
            ends = np.cumsum([len(x.as_py()) // 6 if most is None else min(most, len(x.as_py()) // 6) for x in batch.column(2)]) if batch.num_rows else np.zeros(0, np.int64)
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, side="right")))
                yield batch.slice(lo, hi - lo)
                lo = hi

    def send(batches):
        for batch in parts(batches):
            prefix = [unpacked(x.as_py())[:most] for x in batch.column(2)]
            sizes = np.array([len(x) for x in prefix])
            e = np.empty(sizes.sum(), ENTRY)
            keys = np.concatenate(prefix)
            e["key"] = keys >> np.uint64(16)
            e["at"] = np.arange(len(e)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            for k, name in enumerate(("set", "n")):
                e[name] = np.repeat(np.asarray(batch.column(k)).astype(ENTRY[name]), sizes)
            folded = np.array([np.bitwise_xor.reduce(np.frombuffer(x.as_py(), "<u8").reshape(-1, 2), 0) for x in batch.column(3)])
            e["low"], e["high"] = (np.repeat(folded[:, k], sizes) for k in (0, 1))
            e["group"] = np.repeat(np.asarray(batch.column(4)), sizes)
            to = (keys & np.uint64(buckets - 1)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            e, to = e[order], to[order]
            at = np.nonzero(np.concatenate([[True], to[1:] != to[:-1]]))[0]
            yield pa.RecordBatch.from_arrays([pa.array(to[at]), pa.array([x.tobytes() for x in np.split(e, at[1:])], pa.binary())], names=["bucket", "entries"])
        common.trim()

    def meet(found):
        e = np.frombuffer(b"".join(x.as_py() for x in found["entries"]), ENTRY)
        got = pairs_of(e, num, den, hubs)
        del e
        common.trim()
        return pa.table({"a": pa.array(got[:, 0]), "b": pa.array(got[:, 1])})

    sent = prefixes.select("set", "n", "prefix", "sketch", "group").mapInArrow(send, "bucket int, entries binary")
    return sent.groupBy("bucket").applyInArrow(meet, "a long, b long")


def _narrowed(pairs: DataFrame, prefixes: DataFrame, num: int, den: int, n_bytes: int, salts: int = 64) -> DataFrame:
    """The pairs (a, b) that sizes and sketches do not tell apart: no similar pair is left out. n_bytes: of all sets and pairs."""

    def run(batches):
        for batch in batches:
            keep = []
            for m, n, x, y in zip(*(batch.column(c).to_pylist() for c in ("m", "n", "x", "y")), strict=True):
                keep.append(differing(x, y) <= m + n - 2 * -(-num * (m + n) // (num + den)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(salts)))
    left = common.few(salted.select("a", "salt").distinct().join(prefixes.select(F.col("set").alias("a"), F.col("n").alias("m"), F.col("sketch").alias("x")), "a"), n_bytes)
    both = common.few(salted.join(left, ["a", "salt"]), n_bytes).join(prefixes.select(F.col("set").alias("b"), "n", F.col("sketch").alias("y")), "b")
    return common.few(both.select("a", "b", "m", "n", "x", "y"), n_bytes).mapInArrow(run, "a long, b long")


def _perhaps(rows: DataFrame, one: DataFrame, ranges: int = 64) -> DataFrame:
    """The rows whose set is in one, and others: a table of at most MOST_BITS bits keeps others from being shuffled, fewer of them the more sets there are."""
    bits = min(1 << max(16, (16 * one.count()).bit_length()), MOST_BITS)
    each = bits // ranges

    def mark(found):
        h = np.asarray(found["h"])
        table = np.zeros(each, np.uint8)
        table[h % each] = 1
        return pa.table({"r": pa.array(h[:1] // each), "bits": pa.array([np.packbits(table).tobytes()], pa.binary())})

    h = F.pmod(F.xxhash64("name"), F.lit(bits)).alias("h")
    table = np.zeros((ranges, each // 8), np.uint8)
    for r in one.select(h).distinct().groupBy(F.floor(F.col("h") / each).alias("r")).applyInArrow(mark, "r long, bits binary").collect():
        table[r["r"]] = np.frombuffer(r["bits"], np.uint8)
    spread = rows.sparkSession.sparkContext.broadcast(table.ravel())

    def run(batches):
        for batch in batches:
            at = np.asarray(batch.column(4))
            yield batch.filter(pa.array((spread.value[at >> 3] >> (7 - (at & 7)) & 1).astype(bool))).select([0, 1, 2, 3])

    return rows.withColumn("h", F.pmod(F.xxhash64("set"), F.lit(bits))).mapInArrow(run, "id long, text_hash long, set long, shingles binary")


def _verified(pairs: DataFrame, sets: DataFrame, names: DataFrame, prefixes: DataFrame, num: int, den: int, n_bytes: int, salts: int = 64, least: int = 32 << 20) -> DataFrame:
    """A table of the pairs (a, b) whose whole sets are similar. n_bytes: of all sets and pairs.

    A pair takes a whole set along, so the pairs are compared in slices, one after the other, each
    of which moves at most a sixteenth of the bytes of all sets (or least bytes).
    """
    wanted = pairs.select(F.col("a").alias("set")).unionByName(pairs.select(F.col("b").alias("set"))).distinct()
    one = names.join(wanted, "set").select(F.col("set").alias("name"), F.col("first.id").alias("id"), F.col("first.hash").alias("text_hash"))
    one = common.stored(common.few(one, n_bytes), "wanted")
    whole = _perhaps(sets.withColumn("id", F.coalesce("doc_id", F.lit(common.NULL_ID))).select("id", "text_hash", "set", "shingles"), one).join(one, ["id", "text_hash"]).where("set = name").select("set", "shingles").dropDuplicates(["set"])
    whole = common.stored(common.few(whole, n_bytes), "whole")
    common.drop_stored(one)

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = unpacked(x.as_py()), unpacked(y.as_py())
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * shared >= num * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        common.trim()

    all_bytes = 6 * (prefixes.agg(F.sum("n")).first()[0] or 0)
    moved = 6 * (pairs.join(prefixes.select(F.col("set").alias("a"), "n"), "a").agg(F.sum("n")).first()[0] or 0)
    slices = max(1, -(-moved // max(least, all_bytes // 16)))
    found = None
    for k in range(slices):
        # the pairs of a set that has very many are dealt over several tasks
        salted = pairs.where(F.pmod(F.xxhash64("b", "a"), F.lit(slices)) == k).withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(salts)))
        left = common.few(salted.select("a", "salt").distinct().join(whole.select(F.col("set").alias("a"), F.col("shingles").alias("x")), "a"), n_bytes)
        both = common.few(salted.join(left, ["a", "salt"]), n_bytes).join(whole.select(F.col("set").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
        some = common.stored(common.few(both, n_bytes).mapInArrow(run, "a long, b long"), "links")
        found = some if found is None else found.unionByName(some)
    common.drop_stored(whole)
    return found


def groups(docs: DataFrame, num: int = 4, den: int = 5, words: int = 5, limit: int = 4) -> tuple[DataFrame, DataFrame]:
    """(names, roots): set and the first row (id, hash) that has it; node and root of each set linked to a lesser one."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    sets = common.stored(_sets(docs, words), "sets")
    order = F.struct(F.coalesce("doc_id", F.lit(common.NULL_ID)).alias("id"), F.col("text_hash").alias("hash"))
    total, all_bytes = sets.agg(F.count("*"), F.coalesce(F.sum(F.length("shingles")), F.lit(0))).first()
    all_bytes += 64 * total
    names = common.stored(common.few(sets.groupBy("set").agg(F.min(order).alias("first")), all_bytes), "names")
    prefixes = common.stored(common.few(_prefixes(sets, _common(sets, total), num, den), all_bytes), "prefixes")
    n_bytes = (prefixes.agg(F.sum(F.length("prefix"))).first()[0] or 0) // 6 * ENTRY.itemsize
    buckets = common.parts_for(spark, n_bytes)
    none = spark.createDataFrame([], "node long, root long")
    roots = none
    for most, hubs in ((4, 0), (None, 4), (None, None)):
        grouped = common.few(prefixes.join(roots, prefixes.set == roots.node, "left").withColumn("group", F.coalesce("root", "set")), all_bytes)
        pairs = common.few(_candidates(grouped, buckets, num, den, most, hubs), n_bytes)
        pairs = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b") if most == 4 else pairs
        if most == 4:
            pairs = pairs.unionByName(_by_fingerprint(sets, limit, all_bytes))
        met = common.stored(common.few(pairs.distinct(), all_bytes), "met")
        moved = all_bytes + 512 * met.count()
        pairs = common.stored(_narrowed(met, prefixes, num, den, moved), "pairs")
        common.drop_stored(met)
        found = _verified(pairs, sets, names, prefixes, num, den, moved)
        common.drop_stored(pairs)
        if found.limit(1).count():
            # what was linked before goes on as its roots alone
            roots = simhash.components(found.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    common.drop_stored(sets)
    common.drop_stored(prefixes)
    return names, roots


def keep_first(docs: DataFrame, num: int = 4, den: int = 5, words: int = 5) -> DataFrame:
    """docs with one row of each group of near-duplicates: the first by doc_id (nulls first), then by the text's hash.

    Texts of Jaccard similarity num / den or more of their word shingles are
    linked, and what links reach is a group. Columns and kept rows are as they
    were. Rows without words form one group.
    """
    p = common.free_prefix(docs, "_near_")
    names, roots = groups(docs, num, den, words)
    first = names.join(roots, names.set == roots.node, "left").groupBy(F.coalesce("root", "set").alias("g")).agg(F.min("first").alias("first"))
    first = common.stored(first.select(F.col("first.id").alias(f"{p}id"), F.col("first.hash").alias(f"{p}hash")), "first")
    rows = docs.withColumns({f"{p}id": F.coalesce(F.col("doc_id").cast("long"), F.lit(common.NULL_ID)), f"{p}hash": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})
    return rows.join(first, [f"{p}id", f"{p}hash"], "left_semi").dropDuplicates([f"{p}id", f"{p}hash"]).select(*docs.columns)
