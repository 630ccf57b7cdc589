"""SimHash near-duplicates: fingerprints, generalised pigeonhole search, groups.

Two 64-bit fingerprints that differ in at most T bits have, for any partition of
the bits into m parts and any integers t_1..t_m of sum T - m + 1, some part i in
which they differ in at most t_i bits (-1: the part is not probed). Bits that go
together are put in the same part, so that the other parts stay selective, and
a dynamic programme gives each part its threshold so that the expected number
of probes and candidates is smallest.

Only distinct fingerprints are searched. A probe sends a fingerprint to one
key for each value within t_i bits of its own value of part i; what meets at
a key is verified in blocks of numpy arrays, and only a spanning forest of the links
found there leaves the task. Keys that hold more than a set number of
fingerprints are dealt anew by parts of the other bits, and then to pairs of blocks.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SEED = 42


def fingerprint(text: bytes, words: int = 4) -> int:
    """64-bit SimHash of word shingles: a bit is set if set in over half of the shingles' hashes."""
    w = text.lower().split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    total = np.zeros(64, np.int64)
    h = xxhash.xxh64_intdigest
    for lo in range(0, n, 1 << 16):
        part = w[lo : lo + (1 << 16) + words - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
        hashes = np.array([h(s, SEED) for s in shingles], np.uint64)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * total > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, fp (signed long with the fingerprint's bits) and text_hash of every row of docs."""

    def run(batches):
        for ids, texts, part in common.doc_batches(batches):
            fps = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([common.id_array(ids), pa.array(fps), part.column("text_hash")], names=["doc_id", "fp", "text_hash"])

    return common.id_and_text(docs).withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, "doc_id long, fp long, text_hash long")


def correlated_parts(fps: np.ndarray, m: int) -> list[list[int]]:
    """The 64 bit positions in m parts of nearly equal size, bits of strong correlation together."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    spread = bits.std(0)
    c = np.abs(np.nan_to_num((bits - bits.mean(0)).T @ (bits - bits.mean(0)) / max(1, len(bits)) / np.maximum(np.outer(spread, spread), 1e-9)))
    free, parts = set(range(64)), []
    for k in range(m):
        size = 64 // m + (k < 64 % m)
        seed = max(free, key=lambda b: (sum(c[b][x] for x in free), -b))
        part = [seed]
        free.discard(seed)
        while len(part) < size:
            best = max(free, key=lambda b: (sum(c[b][x] for x in part), -b))
            part.append(best)
            free.discard(best)
        parts.append(sorted(part))
    return parts


def part_values(fps: np.ndarray, part: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.uint64)
    for k, b in enumerate(part):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def thresholds(fps: np.ndarray, parts: list[list[int]], limit: int, total: int, probe_cost: float = 200.0) -> tuple[list[int], float]:
    """t_i of each part, and the estimated cost, by dynamic programming.

    fps: a sample of the total fingerprints. The cost of a part at threshold t is
    its probes, weighed by probe_cost, plus the pairs that are expected to meet.
    """
    scale = (total / max(1, len(fps))) ** 2
    costs = []
    for part in parts:
        v = part_values(fps, part)
        values, counts = np.unique(v, return_counts=True)
        if len(values) > 2000:
            near = np.bincount(np.bitwise_count(values[:2000, None] ^ values[None, :]).ravel().astype(int), weights=(counts[:2000, None] * counts[None, :]).ravel(), minlength=65) * len(values) / 2000
        else:
            near = np.bincount(np.bitwise_count(values[:, None] ^ values[None, :]).ravel().astype(int), weights=(counts[:, None] * counts[None, :]).ravel(), minlength=65)
        near[0] = max(0.0, near[0] - len(v))
        met = np.cumsum(near) / 2 * scale
        row, probes = [0.0], 0
        for t in range(limit + 1):
            probes += _choose(len(part), t)
            row.append(probe_cost * probes * total + met[t] * (probes if t else 1))
        costs.append(row)  # row[t + 1]: cost at threshold t
    need = limit - len(parts) + 1
    best = {0: (0.0, [])}
    for row in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, ts) in best.items():
            for t in range(-1, limit + 1):
                x = (cost + row[t + 1], [*ts, t])
                if used + t not in after or x < after[used + t]:
                    after[used + t] = x
        best = after
    return best[need][1], best[need][0]


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def plan_search(sample: np.ndarray, total: int, limit: int) -> tuple[list[list[int]], list[int]]:
    """The parts and thresholds of the lowest estimated cost over several numbers of parts."""
    found = []
    for m in range(2, limit + 2):
        parts = correlated_parts(sample, m)
        ts, cost = thresholds(sample, parts, limit, total)
        found.append((cost, m, parts, ts))
    _, _, parts, ts = min(found)
    return parts, ts


def masks_within(part: list[int], t: int) -> np.ndarray:
    """All fingerprint masks that flip at most t bits of the part."""
    out = [0]
    for k in range(1, t + 1):
        out += [sum(1 << b for b in chosen) for chosen in itertools.combinations(part, k)]
    return np.array(out, np.uint64)


def forest(fps: np.ndarray, limit: int, block: int = 1024, split: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) of a spanning forest of the links within limit bits, as stars around the first fingerprint of each tree.

    split: only links between the first split fingerprints and the others count.
    """
    n = len(fps)
    root = np.arange(n)  # the first member of each one's class so far
    for lo in range(0, n if split is None else split, block):
        rows = slice(lo, min(n if split is None else split, lo + block))
        for low in range(lo if split is None else split, n, block):
            cols = slice(low, min(n, low + block))
            near = np.bitwise_count(fps[rows, None] ^ fps[None, cols]) <= limit
            for i in np.nonzero((near & (root[rows, None] != root[None, cols])).any(1))[0]:
                met = np.unique(np.append(root[cols][near[i]], root[lo + i]))
                if len(met) > 1:
                    root[np.isin(root, met)] = met[0]
    moved = root != np.arange(n)
    return fps[root[moved]], fps[moved]


def _probe(parts: list[list[int]], ts: list[int]):
    """Rows (part, key, fp): a fingerprint under its own key and, for t > 0, under all keys within t bits."""
    plan = [(i, np.uint64(sum(1 << b for b in p)), masks_within(p, t)) for i, (p, t) in enumerate(zip(parts, ts, strict=True)) if t >= 0]

    def run(batches):
        for batch in batches:
            fps = np.asarray(batch.column(0)).view(np.uint64)
            for i, own, masks in plan:
                for lo in range(0, len(fps), max(1, (1 << 20) // len(masks))):
                    f = fps[lo : lo + max(1, (1 << 20) // len(masks))]
                    keys = ((f & own)[:, None] ^ masks[None, :]).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), i, np.int32)), pa.array(keys.view(np.int64)), pa.array(np.repeat(f, len(masks)).view(np.int64))], names=["part", "key", "fp"])

    return run


def _verify(limit: int):
    """Edges among the fingerprints of each row's fps, or, where it has others, between these and fps."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            a, b = [], []
            for row in batch.select(["fps", "others"]).to_pylist() if "others" in batch.schema.names else ({"fps": x.values, "others": None} for x in batch.column("fps")):
                fps = np.sort(np.asarray(row["fps"], np.int64).view(np.uint64))
                x, y = forest(fps, limit) if row["others"] is None else forest(np.concatenate([fps, np.array(row["others"], np.int64).view(np.uint64)]), limit, split=len(fps))
                a.append(x)
                b.append(y)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"])

    return run


def links(fps: DataFrame, limit: int = 4, sample_size: int = 4096, hot: int = 2048, plan: tuple[list[list[int]], list[int]] | None = None) -> DataFrame:
    """Edges (a, b) that connect all fingerprints linked at limit or fewer differing bits.

    fps: a table of distinct fingerprints, one column fp. sample_size: how many
    (those of the least hash) are used to choose parts and thresholds; the
    search itself covers all. hot: keys with more fingerprints are dealt anew.
    plan: the parts and thresholds, if they are not to be chosen.
    """
    spark = fps.sparkSession
    total = fps.count()
    sample = np.array([r[0] for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(sample_size).collect()], np.int64).view(np.uint64)
    if not len(sample):
        return spark.createDataFrame([], "a long, b long")
    parts, ts = plan or plan_search(sample, total, limit)
    probes = fps.select("fp").mapInArrow(_probe(parts, ts), "part int, key long, fp long")
    sizes = probes.groupBy("part", "key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = common.stored(sizes, "keys")
    tight = sizes.where(F.col("n") <= hot).select("part", "key")
    met = probes.join(tight, ["part", "key"]).groupBy("part", "key").agg(F.collect_list("fp").alias("fps"))
    out = met.select("fps").mapInArrow(_verify(limit), "a long, b long")
    wide = sizes.where(F.col("n") > hot).select("part", "key")
    if wide.limit(1).count():
        out = out.unionByName(_crowded(probes.join(wide, ["part", "key"]), parts, limit, hot))
    return out.distinct()


def _narrower(parts: list[list[int]], limit: int):
    """Rows (part, key, mask, same, fp): each fingerprint once for each of limit + 1 parts of the bits that its group need not share.

    Two fingerprints of a group within limit bits agree on one of these parts. mask: the bits on
    which the new group agrees; same: their values. With fewer bits left than parts the group stays as it is (mask 0).
    """
    plan = []
    for p in parts:
        left = [b for b in range(64) if b not in p]
        cut = np.array_split(left, limit + 1) if len(left) > limit else [[]]
        plan.append([np.uint64(sum(1 << int(b) for b in c)) for c in cut])

    def run(batches):
        for batch in batches:
            part, key, fp = (np.asarray(batch.column(i)) for i in range(3))
            for p in np.unique(part).tolist():
                some = part == p
                f = fp[some]
                for mask in plan[p]:
                    now = np.full(len(f), mask)
                    yield pa.RecordBatch.from_arrays([pa.array(part[some]), pa.array(key[some]), pa.array(now.view(np.int64)), pa.array((f.view(np.uint64) & now).view(np.int64)), pa.array(f)], names=["part", "key", "mask", "same", "fp"])

    return run


def _crowded(rows: DataFrame, parts: list[list[int]], limit: int, hot: int) -> DataFrame:
    """Links among the fingerprints of each crowded key.

    They meet once more, by parts of the bits not yet used. A group that is
    crowded even then, as many near copies of one text are, is dealt to blocks of about hot
    fingerprints; each block is verified, and each pair of blocks: a row has two blocks, whatever the group's size.
    """
    by = ["part", "key", "mask", "same"]
    met = common.stored(rows.select("part", "key", "fp").mapInArrow(_narrower(parts, limit), "part int, key long, mask long, same long, fp long"), "crowded")
    sizes = common.stored(met.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1"), "keys")
    done = met.join(sizes.where(F.col("n") <= hot).select(*by), by).groupBy(*by).agg(F.collect_list("fp").alias("fps"))
    out = done.select("fps").mapInArrow(_verify(limit), "a long, b long")
    wide = sizes.where(F.col("n") > hot).withColumn("blocks", F.ceil(F.col("n") / hot).cast("int")).drop("n")
    if not wide.limit(1).count():
        return out
    dealt = met.join(wide, by).withColumn("block", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
    blocks = common.stored(dealt.groupBy(*by, "blocks", "block").agg(F.collect_list("fp").alias("fps")), "blocks")
    later = F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1))
    pairs = blocks.where("block + 1 < blocks").select(*by, "fps", later.alias("block")).join(blocks.select(*by, "block", F.col("fps").alias("others")), [*by, "block"])
    both = blocks.select("fps", F.lit(None).cast("array<long>").alias("others")).unionByName(pairs.select("fps", "others"))
    return out.unionByName(both.mapInArrow(_verify(limit), "a long, b long"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): each node of the edges (a, b) with the least node that it reaches (roots themselves left out).

    Alternating large-star and small-star steps; each step's edges are written to
    the shared folder, and the loop ends when a step changes nothing. Hubs, with more
    than a thousandth of the edges, meet their least neighbour by a broadcast.
    """
    def mark(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()

    now = common.stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = mark(now)
    for _ in range(rounds):
        total = before[0]
        few = functools.partial(common.few, n_bytes=64 * total)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
        met = few(common.join_one(both, least, "u", 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"))
        large = common.stored(few(met.distinct()), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = common.join_one(large, least, "u", total)
        small = few(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v"))
        after = common.stored(few(small.distinct()), "edges")
        common.drop_stored(now)
        common.drop_stored(large)
        now, last, before = after, before, mark(after)
        if before == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def near_duplicates(docs: DataFrame, limit: int = 4, words: int = 4) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable through links) and text_hash of every row of docs.

    A text without words has fingerprint zero and is linked like any other. Rows
    with the same fingerprint are linked. A null doc_id comes before all others,
    and so is the component_id of a group that holds one.
    """
    rows = common.stored(fingerprints(docs, words), "fingerprints")
    distinct = common.stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("no_id"), F.count("*").alias("n")).select("fp", F.when(F.col("no_id"), F.lit(None)).otherwise(F.col("first")).alias("first"), "no_id", "n"), "distinct")
    all_rows = distinct.agg(F.sum("n")).first()[0] or 0
    roots = components(links(distinct.select("fp"), limit))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", "no_id", F.col("n").alias("rows"), F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("least"), F.max("no_id").alias("any"), F.count("*").alias("n"))
    least = least.select("root", "n", F.when(F.col("any"), F.lit(None)).otherwise(F.col("least")).alias("component_id"))
    classes = common.stored(common.join_one(named, least, "root", distinct.count()).select("fp", "component_id", F.col("rows").alias("n")), "classes")
    return common.join_one(rows, classes, "fp", all_rows).select("doc_id", "fp", "component_id", "text_hash")


def keep_first(docs: DataFrame, limit: int = 4, words: int = 4) -> DataFrame:
    """docs with one row of each group of near-duplicates: the first by doc_id (nulls first), then by the text's hash.

    Columns and kept rows are as they were. Rows without words form one group.
    """
    p = common.free_prefix(docs, "_near_")
    found = near_duplicates(docs, limit, words)
    order = F.struct(F.coalesce("doc_id", F.lit(common.NULL_ID)).alias("id"), F.col("text_hash").alias("hash"))
    first = found.groupBy(F.coalesce("component_id", F.lit(common.NULL_ID)).alias("c"), F.when(F.col("component_id").isNull(), F.col("fp")).alias("f")).agg(F.min(order).alias("first"))
    first = common.stored(first.select(F.col("first.id").alias(f"{p}id"), F.col("first.hash").alias(f"{p}hash")).distinct(), "first")
    rows = docs.withColumns({f"{p}id": F.coalesce(F.col("doc_id").cast("long"), F.lit(common.NULL_ID)), f"{p}hash": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})
    return rows.join(first, [f"{p}id", f"{p}hash"], "left_semi").dropDuplicates([f"{p}id", f"{p}hash"]).select(*docs.columns)
