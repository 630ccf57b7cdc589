"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) * P(group | class, history) * P(word | group).
Both of the first are softmaxes over the sum of a bias and one row of weights per feature:
the previous word, the previous two words, and the word before the previous one (a skip).
Rows are found by a hash of the feature, for the group of the feature and the class; their
number grows with the corpus (rows_for). The most frequent training words are a group each, so
for them the second softmax is over words; all other words share the remaining groups by
their endings, which tell languages and forms apart, and there P(word | group) is the word's count plus one over the group's counts,
words and one, that one being the share of all words never seen.

Training: every task goes through its chunks of all training documents with
mini-batch gradient steps from the same start, scaled by what each row has seen (AdaGrad), and
sends the change of each block of rows with how often each row was met; a row's changes are averaged by
that, so a feature that one task has met is learned whole. Counts are exact, over all training documents (see chunks).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks as ch
from . import common

CLASSES, GROUPS = 16, 16  # powers of two; groups are those of a class
OWN = 12  # of the groups of a class, those of one frequent word each
SHARED_BITS = (CLASSES * (GROUPS - OWN)).bit_length() - 1
#: Rows of each of the two tables of weights: by bytes of text a row, within these bounds.
ROW_BYTES, LEAST_ROWS, MOST_ROWS = 1 << 12, 1 << 14, 1 << 18
BLOCKS = 64
PLACE_BITS = 24  # of a batch's features, while its rows are put in order
#: Bytes of text a task learns from: what a task sends is the rows it has met, which soon are nearly all, so tasks must be few.
LEARN_BYTES = 256 << 20
ENDING = 2  # bytes at a word's end that choose its shared group
#: The end of a document, which no word equals.
END = np.uint64(xxhash.xxh64_intdigest(b"\n"))
_TAGS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def fold(ids: np.ndarray, folds: int) -> np.ndarray:
    """crc32 of each id's decimal text modulo folds (null: of the empty text)."""
    return np.array([zlib.crc32(b"" if i == common.NULL_ID else str(i).encode()) % folds for i in ids.tolist()], np.int64)


#: Of the words' polynomial hash modulo 2**64: an odd base and its inverse, and a value of each byte.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
BYTES = common.mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
PIECE, LONG_WORD = 1 << 18, 512
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    """Powers 0 to n - 1 of the base and of its inverse."""
    if len(_powers[0]) < n:
        for k, x in enumerate((BASE, INVERSE)):
            _powers[k] = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, x, np.uint64)]))
    return _powers


def _hashes(data: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Keys of the words of a text: in the upper SHARED_BITS bits a hash of a word's last ENDING bytes, below one of all of it."""
    edge = np.diff(np.concatenate([[True], space, [True]]).view(np.int8))
    start, end = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    up, down = _power(max(PIECE, len(data)))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTES[data] * up[: len(data)], out=sums[1:])
    n = end - start
    key = common.mix64((sums[end] - sums[start]) * down[start] + n.astype(np.uint64))
    for i in np.nonzero(n > LONG_WORD)[0].tolist():  # long words could be made to collide in the polynomial
        key[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes())
    last = np.zeros(len(n), np.uint64)
    for k in range(ENDING):
        last |= np.where(n > k, data[np.maximum(end - 1 - k, 0)], 0).astype(np.uint64) << np.uint64(8 * k)
    return key >> np.uint64(SHARED_BITS) | (last + np.uint64(1)) * np.uint64(BASE) >> np.uint64(64 - SHARED_BITS) << np.uint64(64 - SHARED_BITS)


def tokens_of(text: bytes) -> np.ndarray:
    """Keys of the text's lower-cased words, and the end. Long texts are gone through in pieces that end between words."""
    data = np.frombuffer(text.lower(), np.uint8)
    space = SPACE[data]
    out, lo = [], 0
    while lo < len(data):
        hi = lo + PIECE
        if hi < len(data):
            gaps = np.nonzero(space[lo:hi])[0]
            if len(gaps):
                hi = lo + int(gaps[-1]) + 1
            else:  # a word longer than a piece
                after = np.nonzero(space[hi:])[0]
                hi = hi + int(after[0]) if len(after) else len(data)
        out.append(_hashes(data[lo:hi], space[lo:hi]))
        lo = hi
    return np.concatenate([*out, [END]])


def rows_for(n_bytes: int) -> int:
    """A power of two that grows with the corpus; the upper bound keeps a table within 16 MB."""
    return min(max(1 << max(0, n_bytes // ROW_BYTES - 1).bit_length(), LEAST_ROWS), MOST_ROWS)


class Groups:
    """The groups of words: frequent, their hashes in descending order of counts; seen: counts and words of the shared groups."""

    def __init__(self, frequent: np.ndarray, counts: np.ndarray, seen: np.ndarray) -> None:
        self.order = np.argsort(frequent)
        self.keys = frequent[self.order]
        seen = seen.copy()
        np.subtract.at(seen, (self._shared(frequent), 0), counts)
        np.subtract.at(seen, (self._shared(frequent), 1), 1)
        own = np.zeros(CLASSES * OWN)
        own[: len(counts)] = counts
        mass = np.concatenate([own.reshape(OWN, CLASSES).T, seen[:, 0].reshape(CLASSES, -1)], 1) + 1
        self.outer = np.log(mass.sum(1) / mass.sum()).astype(np.float32)
        self.inner = np.log(mass / mass.sum(1, keepdims=True)).astype(np.float32)
        self.within = np.zeros((CLASSES, GROUPS))
        self.within[:, OWN:] = np.log10(seen.sum(1) + 1).reshape(CLASSES, -1)

    @staticmethod
    def _shared(keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - SHARED_BITS)).astype(np.int64)

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and group of words."""
        s = self._shared(keys)
        c, g = s // (GROUPS - OWN), OWN + s % (GROUPS - OWN)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[at] == keys
            rank = self.order[at]
            c, g = np.where(hit, rank % CLASSES, c), np.where(hit, rank // CLASSES, g)
        return c, g


def features(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hashes of the three features of each token; first: where the documents begin."""
    one = np.concatenate([[END], keys[:-1]])
    two = np.concatenate([[END], one[:-1]])
    one[first] = END
    two[first] = END
    second = first + 1
    two[second[second < len(keys)]] = END
    return np.stack([common.mix64(x ^ t) for x, t in zip((one, one + common.mix64(two), two), _TAGS, strict=True)], 1)


def segment_sums(x: np.ndarray, rows: np.ndarray, new: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of the rows of x named by rows, over stretches of n that begin at new; most stretches have one or two."""
    out = x[rows[new]]
    two = np.nonzero(n == 2)[0]
    out[two] += x[rows[new[two] + 1]]
    more = np.nonzero(n > 2)[0]
    if len(more):
        size = n[more]
        at = np.cumsum(size) - size
        out[more] = np.add.reduceat(x[rows[np.arange(size.sum()) + np.repeat(new[more] - at, size)]], at)
    return out


class Weights:
    """Two tables of rows: for the classes by feature, for the groups by feature and class."""

    def __init__(self, groups: Groups, tables: list[np.ndarray]) -> None:
        self.groups, self.tables = groups, tables
        self.n = len(tables[0])

    def start_learning(self) -> None:
        self.tables = [t.copy() for t in self.tables]
        self.squares = [np.full(self.n, 1e-2, np.float32) for _ in self.tables]
        self.met = [np.zeros(self.n, np.int64) for _ in self.tables]

    def places(self, f: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inner = f * np.uint64(0xD6E8FEB86659FD93) + (c.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))[:, None]
        inner ^= inner >> np.uint64(32)
        return (f % np.uint64(self.n)).astype(np.int64), (inner % np.uint64(self.n)).astype(np.int64)

    def logs(self, table: np.ndarray, f: np.ndarray, bias: np.ndarray, right: np.ndarray) -> np.ndarray:
        y = table[f[:, 0]] + table[f[:, 1]] + table[f[:, 2]] + bias
        y -= y.max(1, keepdims=True)
        found = y[np.arange(len(y)), right]
        return found - np.log(np.exp(y, out=y).sum(1))

    def learn(self, f: np.ndarray, c: np.ndarray, g: np.ndarray, rate: float, batch: int = 16384) -> None:
        """Gradient steps; the gradients of a row that occurs more than once in a batch are averaged."""
        for lo in range(0, len(c), batch):
            part = slice(lo, lo + batch)
            cs = c[part]
            for k, (at, bias, right) in enumerate(zip(self.places(f[part], cs), (self.groups.outer, self.groups.inner[cs]), (cs, g[part]), strict=True)):
                table = self.tables[k]
                step = table[at[:, 0]] + table[at[:, 1]] + table[at[:, 2]] + bias
                step -= step.max(1, keepdims=True)
                np.exp(step, out=step)
                step /= step.sum(1, keepdims=True)
                step[np.arange(len(step)), right] -= 1
                # rows and their places as one number sort much faster than places by rows
                packed = np.sort(at.ravel() << PLACE_BITS | np.arange(at.size))
                r, token = packed >> PLACE_BITS, (packed & ((1 << PLACE_BITS) - 1)) // 3
                new = np.nonzero(np.concatenate([[True], r[1:] != r[:-1]]))[0]
                n = np.diff(np.append(new, len(r)))
                r = r[new]
                mean = segment_sums(step, token, new, n) / n[:, None].astype(np.float32)
                self.squares[k][r] += (mean * mean).sum(1)
                self.tables[k][r] -= np.float32(rate) * mean / np.sqrt(self.squares[k][r])[:, None]
                self.met[k][r] += n

    def score(self, f: np.ndarray, c: np.ndarray, g: np.ndarray, batch: int = 8192) -> np.ndarray:
        """log10 of each token's P(class) * P(group | class)."""
        out = [np.zeros(0)]
        for lo in range(0, len(c), batch):
            part = slice(lo, lo + batch)
            cs = c[part]
            outer, inner = self.places(f[part], cs)
            y = self.logs(self.tables[0], outer, self.groups.outer, cs) + self.logs(self.tables[1], inner, self.groups.inner[cs], g[part])
            out.append(y.astype(np.float64) / np.log(10))
        return np.concatenate(out)


def _joined(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(d) for d in docs], np.int64)
    return np.concatenate(docs) if docs else np.zeros(0, np.uint64), np.cumsum(sizes) - sizes


def _keys(folds: int, held: int):
    def keys_of(c: ch.Chunk) -> tuple[np.ndarray, np.ndarray]:
        learned = fold(c.ids, folds) != held
        docs = [tokens_of(t) for t in c.texts()]
        flat = np.concatenate(docs)
        weight = np.repeat(learned.astype(np.int64), [len(d) for d in docs])
        keys, inverse = np.unique(flat, return_inverse=True)
        return keys, np.bincount(inverse, weight, len(keys)).astype(np.int64)

    return keys_of


def for_learning(table: DataFrame, n_bytes: int) -> DataFrame:
    """A chunk table in as few tasks as have LEARN_BYTES each, or one for each core."""
    return table.coalesce(ch.tasks_for(table.sparkSession, n_bytes, LEARN_BYTES))


def train(table: DataFrame, groups: Groups, n_rows: int, folds: int, held: int, rounds: int = 1, rate: float = 0.4) -> Weights:
    """Weights learned from all training documents of a chunk table, a task's own in its order."""
    spark = table.sparkSession
    tables = [np.zeros((n_rows, k), np.float32) for k in (CLASSES, GROUPS)]
    per = n_rows // BLOCKS
    for _ in range(rounds):
        start = spark.sparkContext.broadcast(Weights(groups, tables))

        def change(batches, start=start):
            w = Weights(start.value.groups, start.value.tables)
            w.start_learning()
            some = False
            for c in ch.each(batches):
                learned = fold(c.ids, folds) != held
                keys, first = _joined([tokens_of(t) for t, use in zip(c.texts(), learned.tolist(), strict=True) if use])
                w.learn(features(keys, first), *w.groups.of(keys), rate)
                some = some or len(keys) > 0
            if some:
                for k in range(2):
                    d = (w.tables[k] - start.value.tables[k]).astype(np.float16)
                    blocks = [np.nonzero(w.met[k][b * per : (b + 1) * per])[0] for b in range(BLOCKS)]
                    cols = [[ch.pack_array(x) for x in (r.astype("<u4"), w.met[k][b * per + r].astype("<u4"), d[b * per + r])] for b, r in enumerate(blocks)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BLOCKS, dtype=np.int32) + k * BLOCKS), *(pa.array(x, pa.binary()) for x in zip(*cols, strict=True))], names=["block", "rows", "met", "change"])
            common.trim()

        def average(key, found):
            n, d = np.zeros(per), np.zeros((per, CLASSES))
            for r, m, x in zip(found["rows"], found["met"], found["change"], strict=True):
                r, m = ch.unpack_array(r.as_py(), "<u4"), ch.unpack_array(m.as_py(), "<u4")
                n[r] += m
                d[r] += m[:, None] * ch.unpack_array(x.as_py(), np.float16).reshape(-1, CLASSES)
            d /= np.maximum(n, 1)[:, None]
            return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "change": pa.array([ch.pack_array(d.astype(np.float16))], pa.binary())})

        sent = table.mapInArrow(change, "block int, rows binary, met binary, change binary")
        tables = [t.copy() for t in tables]
        for r in sent.groupBy("block").applyInArrow(average, "block int, change binary").collect():
            k, b = divmod(r["block"], BLOCKS)
            tables[k][b * per : (b + 1) * per] += ch.unpack_array(r["change"], np.float16).reshape(per, CLASSES)
    return Weights(groups, tables)


def score(docs: DataFrame, folds: int = 7, held: int = 2, size: int = 4 << 20, rounds: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs.

    Documents whose crc32 of the id's text modulo folds is held are not learned
    from. base_score: sum over tokens of log10((c + 1) / (N + V + 1)), c the token's count, N all and V different
    training tokens. score: the model's log10 probability of the text. An empty
    text is the end alone. With nothing to learn from, classes and groups are alike and each group has one share, that of the words never seen.
    """
    common.bounded_batches(docs.sparkSession)
    table = ch.chunked(docs, size)
    n_bytes = table.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = common.parts_for(docs.sparkSession, n_bytes, least=256)
    tasks = ch.tasks_for(docs.sparkSession, n_bytes)
    answers = ch.totals(table, _keys(folds, held), buckets, tasks=tasks, top=CLASSES * OWN)
    shift = buckets.bit_length() - 1 - SHARED_BITS
    seen = np.zeros((1 << SHARED_BITS, 2))
    ends = answers.where("chunk is null")
    for r in ends.groupBy(F.shiftright("bucket", shift).alias("c")).agg(F.sum("n_all"), F.sum("n_keys")).collect():
        seen[r[0]] = r[1], r[2]
    n_all, n_keys = seen.sum(0)
    often = ends.select(F.explode("often").alias("x")).select("x.*").orderBy(F.desc("n"), "key").limit(CLASSES * OWN).collect()
    groups = Groups(np.array([r["key"] for r in often], np.int64).view(np.uint64), np.array([r["n"] for r in often], np.float64), seen)
    weights = docs.sparkSession.sparkContext.broadcast(train(for_learning(table, n_bytes), groups, rows_for(n_bytes), folds, held, rounds))

    def run(batches):
        w = weights.value
        for c in ch.each(batches):
            keys, first = _joined([tokens_of(t) for t in c.texts()])
            own, inverse = np.unique(keys, return_inverse=True)
            count = ch.all_counts(c.answers)[inverse]
            kind, group = w.groups.of(keys)
            word = np.log10(count + 1.0)
            base = np.add.reduceat(word - np.log10(n_all + n_keys + 1), first)
            inside = np.where(group >= OWN, word - w.groups.within[kind, group], 0.0)
            model = np.add.reduceat(inside + w.score(features(keys, first), kind, group), first)
            n = np.diff(np.append(first, len(keys)))
            known = np.add.reduceat((count > 0).astype(np.int64), first)
            yield pa.RecordBatch.from_arrays([common.id_array(c.ids), pa.array(fold(c.ids, folds) == held), pa.array(n), pa.array(known), pa.array(np.full(len(n), int(n_all), np.int64)), pa.array(base), pa.array(model)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return ch.with_answers(table, answers, tasks=tasks).mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
