"""Periodic runs of words by the runs theorem, and texts with the repetition taken out.

A run is a stretch of words of smallest period q, at least max(24, 3q) words long by
default, that no neighbouring word extends. For one of the two orders of words (one and
its reverse) a Lyndon root of each run is the longest Lyndon word at its place, and
that word ends before the next suffix that is smaller: the next smaller value of the
inverse suffix array. So each place gives one candidate an order; it is extended
to the right and left by longest common extensions, which are range minima, over a
sparse table, of the longest common prefixes of neighbours in suffix order
(to the left: of the texts read backwards). At most one run begins at a candidate, and a
text of n words has fewer than n runs.

The texts of a batch are sorted together, by doubling, each text's suffixes among
themselves; suffixes that are told apart already are not sorted again. A run has two places within it that
agree for 16 words or more (max(24, 3q) - q), so texts whose suffixes are all told apart by their
first 16 words hold no run and leave after that sort.

Rules: a null text is the empty text, which has no words; a null doc_id stays null. Repeated rows
give repeated results, an empty table none, and other columns are not read. A text is one unit of
work, whatever its length: some 150 bytes of arrays a word, and the table's 4 bytes a word and doubling.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .suffix_dedup import previous_smaller

SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _later(level: np.ndarray, end: np.ndarray, by: int) -> np.ndarray:
    """level at the places by further on, plus one; 0 beyond the text's end."""
    at = np.arange(len(level)) + by
    return np.where(at < end, level[np.minimum(at, len(level) - 1)] + 1, 0)


def _starts(sorted_values: np.ndarray) -> np.ndarray:
    """For each place of a sorted array the first place of its value."""
    first = np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])
    return np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))


def suffix_levels(x: np.ndarray, doc: np.ndarray, end: np.ndarray, most: int | None = None) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
    """Ranks of all suffixes by their first h words, for h = 2, 4, 8, ..., and which are not told apart by the last.

    x: words as numbers from 0; doc: each word's text, ascending; end: where that text
    ends. Texts follow each other in the order. It goes on until all are told apart, or until most words.
    """
    n, wide = len(x), int(x.max(initial=0)) + 2
    key = (doc * wide + x) * wide + _later(x, end, 1)
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = _starts(key[order])
    h, levels = 2, []
    open_ = np.ones(n, bool)
    while True:
        levels.append((h, rank))
        at = np.flatnonzero(open_)
        open_ = np.zeros(n, bool)
        open_[at] = np.bincount(rank[at], minlength=n)[rank[at]] > 1
        if not open_.any() or most and h >= most:
            return levels, open_
        at = np.flatnonzero(open_)
        key = rank[at] * (n + 1) + _later(rank, end, h)[at]
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        old = rank[at]
        rank = rank.copy()
        rank[at] = old + _starts(key) - _starts(old)
        h *= 2


class Extensions:
    """Longest common extensions of two places of one text, to the right."""

    def __init__(self, x: np.ndarray, doc: np.ndarray, end: np.ndarray) -> None:
        levels, _ = suffix_levels(x, doc, end)
        self.rank = levels[-1][1]
        n = len(x)
        order = np.empty(n, np.int64)
        order[self.rank] = np.arange(n)
        a, b = order[:-1], order[1:]
        same = doc[a] == doc[b]
        lcp = np.zeros(len(a), np.int64)
        for h, level in reversed(levels):
            lcp += h * self._agree(level, a + lcp, b + lcp, end[a], same)
        lcp += self._agree(x, a + lcp, b + lcp, end[a], same)
        self.least = [np.concatenate([[0], lcp]).astype(np.int32)]  # at r: of the suffixes of rank r - 1 and r
        longest = int(np.bincount(doc).max())
        while 2 << (len(self.least) - 1) <= longest:
            t, half = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(t, np.concatenate([t[half:], t[-1:].repeat(half)])))

    @staticmethod
    def _agree(level: np.ndarray, a: np.ndarray, b: np.ndarray, end: np.ndarray, same: np.ndarray) -> np.ndarray:
        last = len(level) - 1
        return same & (np.maximum(a, b) < end) & (level[np.minimum(a, last)] == level[np.minimum(b, last)])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For places a and b, different and of one text, how many words from there on agree."""
        low = np.minimum(self.rank[a], self.rank[b]) + 1
        high = np.maximum(self.rank[a], self.rank[b]) + 1
        depth = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(depth):
            some = depth == k
            out[some] = np.minimum(self.least[k][low[some]], self.least[k][high[some] - (1 << int(k))])
        return out


def next_smaller(x: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller value; the array's length where there is none."""
    n = len(x)
    return n - 1 - previous_smaller(x[::-1])[::-1]


def find_runs(x: np.ndarray, sizes: np.ndarray, least: int = 24, times: int = 3) -> np.ndarray:
    """Rows (text, start, length, period), sorted, of all runs of texts laid end to end.

    x: words as numbers from 0; sizes: words of each text. A run has at least max(least, times * period)
    words, and times is 3 or more.
    """
    if times < 3 or least < 4:
        raise ValueError("runs of less than three periods or four words are not looked for")
    agree = min(max(least, times * q) - q for q in range(1, least + 1))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.cumsum(sizes)
    if not len(x):
        return np.zeros((0, 4), np.int64)
    _, open_ = suffix_levels(x, doc, ends[doc], 1 << (agree.bit_length() - 1))
    some = np.bincount(doc, weights=open_, minlength=len(sizes)) > 0
    if not some.any():
        return np.zeros((0, 4), np.int64)
    names, kept = np.flatnonzero(some), some[doc]
    x, sizes = x[kept], sizes[some]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.cumsum(sizes)
    end, begin = ends[doc], (ends - sizes)[doc]
    place = np.arange(len(x))
    mirror = begin + end - 1 - place
    right, left = Extensions(x, doc, end), Extensions(x[mirror], doc, end)
    other = suffix_levels(int(x.max()) - x, doc, end)[0][-1][1]
    found = []
    for rank in (right.rank, other):
        root_end = next_smaller(rank - doc * len(x))  # a later text's ranks count as smaller, so a root ends with its text at the latest
        i = np.flatnonzero((root_end < end) & (times * (root_end - place) <= end - begin))
        j = root_end[i]
        i, j = (z[x[i] == x[j]] for z in (i, j))
        stop = j + right.of(i, j)
        inner = i > begin[i]
        start = i.copy()
        start[inner] -= left.of(mirror[i[inner] - 1], mirror[j[inner] - 1])
        q = j - i
        long = stop - start >= np.maximum(least, times * q)
        found.append(np.stack([names[doc[i]], start - begin[i], stop - start, q], 1)[long])
    runs = np.unique(np.concatenate(found), axis=0)
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def _numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as numbers, and how many each text has."""
    index: dict[bytes, int] = {}
    sizes = np.array([len(t) for t in texts], np.int64)
    return np.fromiter((index.setdefault(w, len(index)) for t in texts for w in t), np.int64, int(sizes.sum())), sizes


def collapse(docs: DataFrame, least: int = 24, times: int = 3, batch_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and collapsed of every row of docs.

    Words are runs of other bytes than 0x20 and 0x09-0x0D, numbered from 0. collapsed: the words that no
    run holds after its first period, joined by single blanks. batch_bytes: of texts that are sorted together.
    """

    def run(batches):
        for ids, texts, _ in common.doc_batches(batches, size=batch_bytes):
            words = [t.split() for t in texts]
            x, sizes = _numbered(words)
            runs = find_runs(x, sizes, least, times)
            cut = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1))
            out = []
            for k, w in enumerate(words):
                if cut[k] < cut[k + 1]:
                    change = np.zeros(len(w) + 1, np.int64)
                    _, start, length, q = runs[cut[k] : cut[k + 1]].T
                    np.add.at(change, start + q, 1)
                    np.add.at(change, start + length, -1)
                    w = [w[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
                out.append(b" ".join(w))
            parts = pa.StructArray.from_arrays([pa.array(runs[:, c]) for c in (1, 2, 3)], names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays([common.id_array(ids), pa.array(sizes), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), parts), pa.array(out, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return common.id_and_text(docs).mapInArrow(run, SCHEMA)


def greatest(runs: Column) -> Column:
    """The run of greatest length / period, compared exactly; of equal ones the first. Null without runs."""
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def digest(runs: Column) -> Column:
    """sha256 of all runs' lines start,length,period."""
    return F.sha2(F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), ""), 256)


def planted(docs: DataFrame, share: int = 10) -> DataFrame:
    """doc_id and text of docs, with a repetition put into every text whose id's crc32 is a multiple of share.

    With g = crc32 / share and n words, words from a = g mod n on repeat the p = 1 + (n - a) / (3 + g mod 8) words at a.
    """
    given = common.id_and_text(docs)
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = given.select("*", F.floor(h / share).alias("g"), F.when(h % share == 0, F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")).alias("w"))
    rows = rows.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    source = F.transform("w", lambda _, i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(source, " ")).otherwise(F.col("text")).alias("text"))
