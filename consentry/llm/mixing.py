"""Mixing sources to target weights by Pfair scheduling, with SQL functions only.

Each source's documents, in a fixed pseudo-random order, are cut into blocks of
about ``block_chars`` characters. The target weights are rounded to whole blocks
of one period. Block i of a source of weight w is released at slot floor(i / w)
and due at slot ceil((i + 1) / w); of the released blocks the earliest due one
takes each slot. At every slot each source is then less than one block from its
weight. The schedule of one period is computed once, in one row of bounded
size; a document's slot follows from its block number by arithmetic.

The characters before a document in its source come from sums per bucket of
the order, so no task holds a source. When a source ends, its later slots stay
empty and the others keep their order; no document is dropped or repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import common

#: Multiplier of the pseudo-random order (2**32 over the golden ratio).
GOLDEN = 2654435761
#: More sources than this are joined to their schedule without a broadcast.
MAX_BROADCAST_SOURCES = 4096


def _order(doc_id: Column) -> Column:
    return F.pmod(F.pmod(F.coalesce(doc_id.cast("long"), F.lit(0)), F.lit(1 << 31)) * F.lit(GOLDEN), F.lit(1 << 32))


def schedule(weights: DataFrame, period: int = 1024) -> DataFrame:
    """(source, quota, slots, k, slot): the slot of each source's k-th block in a period of slots slots.

    weights: source and a positive weight per row. Every source gets one block
    a period at least, so slots may exceed period by the number of sources.
    """
    total = weights.agg(F.sum("weight").alias("total"))
    quotas = weights.crossJoin(F.broadcast(total)).select("source", F.greatest(F.lit(1), F.round(F.col("weight") / F.col("total") * period)).cast("long").alias("quota"))
    one = quotas.agg(F.array_sort(F.collect_list(F.struct("source", "quota"))).alias("all"), F.sum("quota").alias("slots"))
    one = one.where("slots > 0").withColumn("qs", F.transform("all", lambda x: x["quota"]))

    def choose(acc: Column, t: Column) -> Column:
        # deadline and number of each source whose next block is released; the least is taken
        due = F.transform(F.col("qs"), lambda q, s: F.struct((((F.element_at(acc["done"], (s + 1).cast("int")) + 1) * F.col("slots") + q - 1) / q).cast("long").alias("due"), s.cast("long").alias("s"), F.floor(F.element_at(acc["done"], (s + 1).cast("int")) * F.col("slots") / q).alias("released")))
        pick = F.array_min(F.filter(due, lambda x: x["released"] <= t))["s"]
        return F.struct(F.transform(acc["done"], lambda d, s: F.when(s == pick, d + 1).otherwise(d)).alias("done"), F.concat(acc["picks"], F.array(pick)).alias("picks"))

    begin = F.struct(F.transform("qs", lambda q: F.lit(0).cast("long")).alias("done"), F.array().cast("array<bigint>").alias("picks"))
    picks = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1), begin, choose, lambda acc: acc["picks"])
    rows = one.select("all", "slots", F.posexplode(picks).alias("slot", "s"))
    named = rows.select(F.element_at("all", (F.col("s") + 1).cast("int")).alias("x"), "slots", F.col("slot").cast("long").alias("slot"))
    each = W.Window.partitionBy("source").orderBy("slot")
    return named.select(F.col("x.source").alias("source"), F.col("x.quota").alias("quota"), "slots", "slot").withColumn("k", (F.row_number().over(each) - 1).cast("long"))


def source_weights(docs: DataFrame, exponent: float = 0.5) -> DataFrame:
    """Default target weights: each source's characters to a power (1: as they come; 0: all alike)."""
    return docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).agg(F.pow(F.sum(_size()).cast("double"), F.lit(exponent)).alias("weight"))


def _size() -> Column:
    return F.greatest(F.length(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(1)).cast("long")


def mix(docs: DataFrame, weights: DataFrame | None = None, block_chars: int = 65536, period: int = 1024, exponent: float = 0.5, bucket_rows: int = 2000, prefix: str = "mix_") -> DataFrame:
    """docs with <prefix>slot, <prefix>block and <prefix>order, in the place of any columns of these names.

    Read by ascending order, docs are mixed to the weights: order is slot *
    block_chars plus the characters of the block before the document, and no two
    rows of the result share it. A null source is a source like any other, named
    ''. A document without text counts one character. weights without a
    source of docs, or the other way round: that source's weight is the least
    given one; sources without documents leave their slots empty.
    """
    p = common.free_prefix(docs, prefix)
    rows = docs.withColumns({f"{p}src": F.coalesce(F.col("source").cast("string"), F.lit("")), f"{p}size": _size()})
    seen = rows.groupBy(f"{p}src").agg(F.count("*").alias("n")).agg(F.count("*"), F.sum("n")).first()
    n_sources, n_rows = seen[0], seen[1] or 0
    buckets = 1 << max(8, (n_rows // bucket_rows).bit_length())
    if weights is None:
        weights = source_weights(docs, exponent)
    else:
        given = weights.select(F.coalesce("source", F.lit("")).alias("source"), F.col("weight").cast("double").alias("weight")).where("weight > 0")
        least = given.agg(F.min("weight").alias("least"))
        weights = rows.select(F.col(f"{p}src").alias("source")).distinct().join(given, "source", "left").crossJoin(F.broadcast(least)).select("source", F.coalesce("weight", "least", F.lit(1.0)).alias("weight"))
    rows = rows.withColumn(f"{p}bucket", F.shiftright(_order(F.col("doc_id")), 32 - (buckets.bit_length() - 1)).cast("long"))
    sums = rows.groupBy(f"{p}src", f"{p}bucket").agg(F.sum(f"{p}size").alias("all"))
    before = W.Window.partitionBy(f"{p}src").orderBy(f"{p}bucket").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = sums.select(f"{p}src", f"{p}bucket", F.coalesce(F.sum("all").over(before), F.lit(0)).alias(f"{p}offset"))
    within = W.Window.partitionBy(f"{p}src", f"{p}bucket").orderBy("doc_id", F.xxhash64("text")).rowsBetween(W.Window.unboundedPreceding, -1)
    rows = rows.withColumn(f"{p}before", F.coalesce(F.sum(f"{p}size").over(within), F.lit(0)))
    rows = rows.join(offsets, [f"{p}src", f"{p}bucket"]).withColumn(f"{p}before", F.col(f"{p}before") + F.col(f"{p}offset"))
    plan = schedule(weights, period)
    first = plan.where("k = 0").select(F.col("source").alias(f"{p}src"), F.col("quota").alias(f"{p}quota"), F.col("slots").alias(f"{p}slots"))
    each = plan.select(F.col("source").alias(f"{p}src"), F.col("k").alias(f"{p}k"), F.col("slot").alias(f"{p}at"))
    if n_sources <= MAX_BROADCAST_SOURCES:
        first, each = F.broadcast(first), F.broadcast(each)
    rows = rows.join(first, f"{p}src").withColumn(f"{p}block", F.floor(F.col(f"{p}before") / block_chars))
    rows = rows.withColumn(f"{p}k", F.col(f"{p}block") % F.col(f"{p}quota")).join(each, [f"{p}src", f"{p}k"])
    rows = rows.withColumn(f"{p}slot", F.floor(F.col(f"{p}block") / F.col(f"{p}quota")) * F.col(f"{p}slots") + F.col(f"{p}at"))
    rows = rows.withColumn(f"{p}order", F.col(f"{p}slot") * block_chars + F.col(f"{p}before") % block_chars)
    own = [c for c in docs.columns if c.lower() not in {f"{prefix}{x}".lower() for x in ("slot", "block", "order")}]
    return rows.select(*own, *(F.col(f"{p}{x}").alias(f"{prefix}{x}") for x in ("slot", "block", "order")))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """docs in the mixed order: range-partitioned and sorted by it, with the columns of docs."""
    p = common.free_prefix(docs, "mix_")
    rows = mix(docs, **options, prefix=p)
    return rows.repartitionByRange(f"{p}order").sortWithinPartitions(f"{p}order").select(*docs.columns)


#: SQL for op8's rows: mix() of documents with its default parameters.
ORACLE = """
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source, greatest(length(coalesce(text, '')), 1) AS size,
         ((coalesce(doc_id, 0) % 2147483648 + 2147483648) % 2147483648) * 2654435761 % 4294967296 AS ord
  FROM documents),
w AS (SELECT source, pow(sum(size)::DOUBLE, 0.5) AS weight FROM d GROUP BY source),
q AS (SELECT source, greatest(1, round(weight / (SELECT sum(weight) FROM w) * 1024))::BIGINT AS quota FROM w),
one AS (SELECT list(quota ORDER BY source) AS qs, list(source ORDER BY source) AS ss, sum(quota)::BIGINT AS slots FROM q),
edf AS (
  SELECT 0::BIGINT AS t, list_transform(qs, lambda x: 0::BIGINT) AS done, 0::BIGINT AS pick, qs, slots FROM one
  UNION ALL
  SELECT t + 1, list_transform(done, lambda x, i: CASE WHEN i = p THEN x + 1 ELSE x END), p, qs, slots
  FROM (SELECT *, list_min(list_filter(list_transform(qs, lambda q, i:
          CASE WHEN done[i] * slots // q <= t THEN (((done[i] + 1) * slots + q - 1) // q) * 100000 + i END), lambda x: x IS NOT NULL)) % 100000 AS p
        FROM edf WHERE t < slots)),
plan AS (
  SELECT ss[pick] AS source, qs[pick] AS quota, edf.slots, t - 1 AS slot,
         row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS k
  FROM edf, (SELECT ss FROM one) WHERE t > 0),
r AS (SELECT doc_id, source, coalesce(sum(size) OVER (PARTITION BY source ORDER BY ord // (4294967296 // BUCKETS), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d)
SELECT doc_id, r.source AS source, (before // 65536) // quota * slots + slot AS slot, before // 65536 AS block,
       ((before // 65536) // quota * slots + slot) * 65536 + before % 65536 AS mix_order
FROM r JOIN plan ON r.source = plan.source AND plan.k = (before // 65536) % quota
""".replace("BUCKETS", "(1 << greatest(8, CASE WHEN (SELECT count(*) FROM d) < 2000 THEN 0 ELSE floor(log2((SELECT count(*) FROM d) // 2000))::INT + 1 END))")
