"""Kendall's rank correlation by counting inversions, without pairs of rows.

Pairs tied in a value follow from counts of equal values. The discordant pairs are the
inversions between the order by x and the order by y, with ties ordered alike in both. A group of
at most ``block`` rows is one array, and arrays are counted many at a time by
merging, bit by bit of the ranks. The rows of a larger group are numbered in both orders by
range partitions and cut into blocks both ways: pairs in different blocks both ways follow
from the counts of rows per cell; the others lie within one block of one of the orders, whose rows are one array.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.types import LongType

from ..sources import shared

BLOCK = 1 << 16
#: Blocks of a group in one order; beyond block times as many rows, blocks grow instead.
MOST_BLOCKS = 1000


def count_inversions(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For arrays laid end to end the pairs of places i < j with a greater value at i."""
    n = len(values)
    group = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((np.arange(n), values, group))  # equal values in the order of their places: no inversion
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n) - (np.cumsum(sizes) - sizes)[group]
    total = np.zeros(len(sizes), np.int64)
    for bit in range(int(rank.max(initial=0)).bit_length()):
        # among ranks alike above the bit: pairs of an earlier one with the bit and a later one without
        high = (group << 40) | (rank >> (bit + 1))
        order = np.argsort(high, kind="stable")
        one = (rank[order] >> bit) & 1
        ones = np.concatenate([[0], np.cumsum(one)])[:-1]
        first = np.concatenate([[True], high[order][1:] != high[order][:-1]])
        before = ones - ones[np.maximum.accumulate(np.where(first, np.arange(n), 0))]
        total += np.bincount(group[order], weights=before * (1 - one), minlength=len(sizes)).astype(np.int64)
    return total


@F.pandas_udf(LongType())
def _inversions(arrays: pd.Series) -> pd.Series:
    """Inversions of each array of numbers."""
    sizes = arrays.map(len).to_numpy(np.int64)
    return pd.Series(count_inversions(np.concatenate([np.zeros(0), *arrays]), sizes) if len(arrays) else [], dtype="int64")


def _ordered(by: Column | str, value: str) -> Column:
    """The values of a group in the order of by."""
    return F.transform(F.array_sort(F.collect_list(F.struct(by, value))), lambda s: s[value])


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """rows with name: each row's place from 0 in its group. Ranges are numbered apart, so no task holds a group."""
    spread = shared.written(rows.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "numbered")
    here = F.row_number().over(W.Window.partitionBy(*by, "_range").orderBy(*order)) - 1
    before = W.Window.partitionBy(*by).orderBy("_range").rowsBetween(W.Window.unboundedPreceding, -1)
    begins = spread.groupBy(*by, "_range").agg(F.count("*").alias("_n")).withColumn("_begin", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return spread.withColumn("_here", here).join(begins, [*by, "_range"]).withColumn(name, F.col("_begin") + F.col("_here")).drop("_range", "_here", "_begin")


def _within(rows: DataFrame, by: list[str], blocks: list[str], name: str) -> DataFrame:
    """Per group the inversions within each of its blocks, summed."""
    arrays = rows.groupBy(*by, *blocks).agg(_ordered("_r", "_s").alias("a"))
    return arrays.withColumn("a", _inversions("a")).groupBy(*by).agg(F.sum("a").alias(name))


def _across(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, across): the pairs in different blocks both ways that are inversions; a group has at most MOST_BLOCKS squared cells."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((group["_i"].max() + 1, group["_j"].max() + 1), np.int64)
        m[group["_i"], group["_j"]] = group["n"]
        later = np.vstack([m[::-1].cumsum(0)[::-1][1:], np.zeros((1, m.shape[1]), np.int64)])  # of greater i
        earlier = np.hstack([np.zeros((len(m), 1), np.int64), later.cumsum(1)[:, :-1]])  # and smaller j
        return group[by].head(1).assign(across=int((m * earlier).sum()))

    return cells.groupBy(*by).applyInPandas(run, cells.select(*by).schema.add("across", "long"))


def _large(rows: DataFrame, sizes: DataFrame, by: list[str], key: str, x: str, y: str, block: int) -> DataFrame:
    """(by, d) of the groups of sizes (by, n), with blocks of block rows or more."""
    r = numbered(rows, by, [x, y, key], "_r")
    s = numbered(r, by, [y, "_r"], "_s")
    each = sizes.select(*by, F.greatest(F.lit(block), F.ceil(F.col("n") / MOST_BLOCKS)).alias("_each"))
    p = shared.written(s.join(each, by).select(*by, "_r", "_s", F.expr("_r div _each").alias("_i"), F.expr("_s div _each").alias("_j")), "blocks")
    d = _across(p.groupBy(*by, "_i", "_j").agg(F.count("*").alias("n")), by)
    for blocks, name in ((["_i"], "rows"), (["_j"], "columns"), (["_i", "_j"], "cells")):
        d = d.join(_within(p, by, blocks, name), by)
    return d.select(*by, (F.col("across") + F.col("rows") + F.col("columns") - F.col("cells")).alias("d"))


def kendall(rows: DataFrame, key: str, x: str, y: str, by: list[str], block: int = BLOCK) -> DataFrame:
    """(by, tau) of groups of two rows or more; a pair tied in both values counts in both totals of ties, and tau is 0 where all are tied.

    Rows with a null or not-a-number in x or y are left out. key tells rows of one group apart.
    """
    rows = rows.select(*by, key, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y)).where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    pairs = lambda n: (n * (n - 1) / 2).cast("long")
    both = rows.groupBy(*by, x, y).agg(F.count("*").alias("n"))
    tied = lambda c, name: both.groupBy(*by, c).agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(pairs(F.col("n"))).alias(name))
    sizes = both.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(pairs(F.col("n"))).alias("txy"))
    small = rows.join(sizes.where(F.col("n") <= block).select(*by), by, "left_semi").groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(x, y))), lambda s: s[y]).alias("a"))
    d = small.select(*by, _inversions("a").alias("d"))
    if sizes.where(F.col("n") > block).limit(1).count():
        large = sizes.where(F.col("n") > block).select(*by, "n")
        d = d.unionByName(_large(rows.join(large, by, "left_semi"), large, by, key, x, y, block))
    t = sizes.where("n > 1").join(tied(x, "tx"), by).join(tied(y, "ty"), by).join(d, by).withColumn("all", pairs(F.col("n")))
    den = F.sqrt((F.col("all") - F.col("tx")).cast("double") * (F.col("all") - F.col("ty")))
    return t.select(*by, F.when(den == 0, 0.0).otherwise(F.try_divide(F.col("all") - F.col("tx") - F.col("ty") + F.col("txy") - 2 * F.col("d"), den)).alias("tau"))
