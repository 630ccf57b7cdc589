"""Token-id files: adaptive context-mixing range coder, in independent blocks.

Segment image (all integers little-endian)::

    8 bytes  magic "TIDMIX02"
    u32 x 5  documents D, ids of a block B, blocks K, size of the vocabulary, frequent ids F
    u64      ids T
    F x      u32 frequent ids, in descending order of their counts in the segment
    K x      u32 16-bit words of the block, u32 crc32 of the block's ids (as u32)
    D x      i64 doc_id, u32 ids of the document
    rest     the blocks: for each of its lanes the number of its words, then the lanes' words

Each block of B ids (the last may be shorter) starts from the same model state
and can be decoded alone. A block is cut into lanes of STEPS ids, each
with a range coder of its own, that advance together and share the block's one model,
so that an operation of numpy serves all lanes and the model learns from all of them.

An id is coded from three predictions:

* order 2: the id that last followed the same two ids, with an adaptive hit rate of its slot;
* order 1: adaptive counts of the classes that follow the class of the previous id
  (a frequent id is a class; all others are one), mixed with
* order 0: the counts of the classes, by how many different classes the row has seen.

The order-2 id's probability is mixed in the logistic domain from its slot's rate and
from what orders 1 and 0 give it, by weights that adapt. Its interval comes first, the
mixed row of orders 1 and 0 takes the rest. Of an id that is not frequent the
id itself follows, by adaptive order-0 counts of all ids.

Rows are brought up to date at steps 1, 2, 4, ... and every REFRESH steps. All arithmetic is
on integers or single rounded products, so any machine decodes what another has coded.
Carries go into the words already written and are settled at the end.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"TIDMIX02"
STEPS = 256
BLOCK = 4096 * STEPS
FREQUENT = 255
REFRESH = 64
SLOTS_BITS = 18
#: Totals: of an id's first interval, of a row of classes, of the order-0 counts.
ALL, ROW, FLAT = 28, 16, 22
U, I = np.uint64, np.int64
SMALL = U(1 << 48)
S16, S48, UALL, UROW, UFLAT = U(16), U(48), U(ALL), U(ROW), U(FLAT)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """stretch: ln(p / (1 - p)) * 256 of p in 4096ths; squash: its inverse over -2047..2047. Fixed tables, rounded to integers."""
    x = np.arange(-2047, 2048)
    squash = np.clip(np.round(4096 / (1 + np.exp(-x / 256))), 32, 4064).astype(np.int32)
    p = (np.arange(4096) + 0.5) / 4096
    stretch = np.clip(np.round(np.log(p / (1 - p)) * 256), -2047, 2047).astype(np.int32)
    return stretch, squash


STRETCH, SQUASH = _tables()


def _cumulative(f: np.ndarray, bits: int) -> np.ndarray:
    """Cumulative ranges of positive frequencies along the last axis, each at least 1, of total 1 << bits."""
    n = f.shape[-1]
    c = np.zeros((*f.shape[:-1], n + 1))
    np.cumsum(f, -1, out=c[..., 1:])  # whole numbers below 2**53, so exact
    c *= ((1 << bits) - n) / c[..., -1:]
    c = c.astype(np.int32)
    np.minimum(c, (1 << bits) - n, out=c)
    c[..., -1] = (1 << bits) - n
    c += np.arange(n + 1, dtype=np.int32)
    return c


class _Model:
    """The state of a block; arrays of lanes have an entry per lane.

    Slots are check << 24 | rate << 17 | id (0: none); cells of the rows of classes are start << 16 | size - 1.
    """

    def __init__(self, lanes: int, vocab: int, top: np.ndarray) -> None:
        self.n, self.other = lanes, len(top)
        self.bits = max(1, len(top).bit_length())
        self.k = 1 << self.bits
        self.rank = np.full(vocab, len(top), I)
        self.rank[top] = np.arange(len(top))
        self.ids = np.zeros(self.k, I)
        self.ids[: len(top)] = top
        self.slots = np.zeros(1 << SLOTS_BITS, np.uint32)
        self.weights = [12000, 52000, 0]
        self.counts = np.zeros(self.k * self.k, np.int32)
        self.flat = np.zeros(vocab, np.int32)
        self.one, self.two = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
        self.row = np.full(lanes, self.other << self.bits, I)  # the class of the previous id, as its first cell
        self.seen: list[np.ndarray] = []
        self.rare: list[np.ndarray] = []
        self.step = 0

    def keep(self, n: int) -> None:
        """Goes on with the first n lanes alone."""
        self.n = n
        self.one, self.two, self.row = self.one[:n], self.two[:n], self.row[:n]

    def refresh(self) -> None:
        if self.seen:
            self.counts += np.bincount(np.concatenate(self.seen), minlength=len(self.counts)).astype(np.int32)
            if self.rare:
                self.flat += np.bincount(np.concatenate(self.rare), minlength=len(self.flat)).astype(np.int32)
            self.seen, self.rare = [], []
        n = self.counts.reshape(self.k, self.k)
        zero = n.sum(0, dtype=I)
        share = ((zero << 15) // max(1, int(zero.sum())) + 1).astype(float)
        f = n * 32768.0
        f += (np.count_nonzero(n, 1) + 1)[:, None] * share[None, :]
        cells = _cumulative(f, ROW)
        self.cells = (cells[:, :-1].astype(np.uint32) << np.uint32(16) | (np.diff(cells, axis=1) - 1).astype(np.uint32)).ravel()
        self.ranges = _cumulative(self.flat * 32.0 + 1, FLAT).astype(U)

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """The order-2 id of each lane and its probability in 1 << ALL (0: it has none)."""
        h = self.one * np.uint32(0x9E3779B1)
        h ^= self.two * np.uint32(0x85EBCA6B) + np.uint32(0x27D4EB2F)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        self.at = (h >> np.uint32(32 - SLOTS_BITS)).astype(I)
        self.check = h << np.uint32(24)
        e = self.slots.take(self.at, mode="clip")
        self.rate = (e >> np.uint32(17)) & np.uint32(127)
        self.valid = ((e ^ self.check) < np.uint32(1 << 24)) & (self.rate > 0)
        guess = (e & np.uint32(0x1FFFF)).astype(I) * self.valid
        given = self.cells.take(self.row + self.rank.take(guess, mode="clip"), mode="clip") & np.uint32(0xFFFF)
        self.inputs = STRETCH.take((self.rate << np.uint32(5)).astype(I), mode="clip"), STRETCH.take((given >> np.uint32(ROW - 12)).astype(I), mode="clip")
        w = self.weights
        mixed = (self.inputs[0] * np.int32(w[0]) + self.inputs[1] * np.int32(w[1]) >> 16) + np.int32((w[2] >> 8) + 2047)
        self.p = SQUASH.take(mixed, mode="clip")
        self.guess = guess
        return guess, (self.p * self.valid).astype(U) << U(ALL - 12)

    def cell(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of classes in the lanes' rows."""
        c = self.cells.take(self.row + kind, mode="clip")
        start = c >> np.uint32(16)
        return start.astype(U), (start + (c & np.uint32(0xFFFF)) + np.uint32(1)).astype(U)

    def find(self, m: np.ndarray) -> np.ndarray:
        """The class of each lane's row that holds place m; a row's cells ascend, so halving finds it."""
        most = (m.astype(np.uint32) << np.uint32(16)) | np.uint32(0xFFFF)
        at = self.row
        for k in range(self.bits - 1, -1, -1):
            at = at + ((self.cells.take(at + (1 << k), mode="clip") <= most).astype(I) << k)
        return at - self.row

    def update(self, x: np.ndarray, kind: np.ndarray, hit: np.ndarray) -> None:
        """x: the ids of the lanes; kind: their classes."""
        self.step += 1
        if self.step & 3 == 0 and (many := int(np.count_nonzero(self.valid))):
            err = (hit * np.int32(4095) - self.p) * self.valid
            for k in range(2):
                self.weights[k] = min(max(self.weights[k] + int((self.inputs[k] * err).sum(dtype=I)) // many // 4, -200000), 200000)
            self.weights[2] = min(max(self.weights[2] + int(err.sum(dtype=I)) // many * 32, -200000), 200000)
        up = self.rate + ((np.uint32(131) - self.rate) >> np.uint32(2))
        rate = np.where(hit, np.minimum(up, np.uint32(126)), np.uint32(24))
        new = x.astype(np.uint32)
        self.slots[self.at] = self.check | rate << np.uint32(17) | new
        self.seen.append(self.row + kind)
        self.two, self.one, self.row = self.one, new, kind << self.bits


class _Encoder:
    def __init__(self, lanes: int, words: int) -> None:
        self.lanes, self.width = lanes, words
        self.low, self.range = np.zeros(lanes, U), np.full(lanes, 2**64 - 1, U)
        self.out = np.zeros(lanes * words, np.uint32)  # word by word, all lanes of a word together
        self.at = np.arange(lanes, dtype=I)

    def step(self, low, rng, at, start, size, bits):
        r = rng >> bits
        new, rng = low + r * start, r * size
        over = new < low
        if over.any():
            self._carry(at[over])
        low = new
        small = rng < SMALL
        self.out[at] = (low >> S48).astype(np.uint32)  # scattered faster in the type of the words
        shift = small * S16
        low, rng, at = low << shift, rng << shift, at + small * I(self.lanes)
        again = np.nonzero(rng < SMALL)[0]
        if len(again):
            self.out[at[again]] = low[again] >> S48
            low[again] <<= S16
            rng[again] <<= S16
            at[again] += self.lanes
        return low, rng, at

    def _carry(self, at: np.ndarray) -> None:
        self.out[at - self.lanes] += np.uint32(1)

    def put(self, n: int, start, size, bits) -> None:
        """For the first n lanes."""
        self.low[:n], self.range[:n], self.at[:n] = self.step(self.low[:n], self.range[:n], self.at[:n], start, size, bits)

    def put_some(self, rows, start, size, bits) -> None:
        self.low[rows], self.range[rows], self.at[rows] = self.step(self.low[rows], self.range[rows], self.at[rows], start, size, bits)

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        """The number of words of each lane, and all lanes' words."""
        low = self.low + (SMALL - U(1))
        over = low < self.low
        if over.any():
            self._carry(self.at[over])
        self.out[self.at] = low >> S48
        used = self.at // self.lanes + 1
        out = self.out.reshape(self.width, self.lanes)[: int(used.max())]
        out *= np.arange(len(out))[:, None] < used[None, :]  # what unfinished steps left
        for k in range(len(out) - 1, 0, -1):
            out[k - 1] += out[k] >> np.uint32(16)
        words = out.astype("<u2").T  # drops the carries
        return used, words[np.arange(len(out))[None, :] < used[:, None]]


class _Decoder:
    def __init__(self, used: np.ndarray, words: np.ndarray) -> None:
        self.lanes = n = len(used)
        grid = np.zeros((n, int(used.max()) + 4), U)
        grid[np.arange(grid.shape[1])[None, :] < used[:, None]] = words
        self.words = np.append(np.ascontiguousarray(grid.T).ravel(), np.zeros(n * 8, U))
        w = self.words[: 4 * n].reshape(4, n)
        self.code = w[0] << S48 | w[1] << U(32) | w[2] << S16 | w[3]
        self.range, self.at = np.full(n, 2**64 - 1, U), np.arange(n, dtype=I) + 4 * n

    def take(self, code, rng, at, r, start, size):
        code, rng = code - r * start, r * size
        small = rng < SMALL
        shift = small * S16
        code, rng = code << shift | self.words.take(at, mode="clip") * small, rng << shift
        at = at + small * I(self.lanes)
        again = np.nonzero(rng < SMALL)[0]
        if len(again):
            code[again] = code[again] << S16 | self.words.take(at[again], mode="clip")
            rng[again] <<= S16
            at[again] += self.lanes
        return code, rng, at


def _lengths(total: int, each: int) -> np.ndarray:
    return np.diff(np.append(np.arange(0, total, each), total))


def _refreshes(t: int) -> bool:
    return t % REFRESH == 0 or (t < REFRESH and t & (t - 1) == 0)


def encode_block(ids: np.ndarray, vocab: int, top: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """The 16-bit words of a block of ids below vocab (at most 1 << 17)."""
    n = _lengths(len(ids), steps)
    grid = np.zeros((len(n), int(n[0])), np.int32)
    grid.ravel()[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.T)
    model, coder = _Model(len(n), vocab, top), _Encoder(len(n), 4 * int(n[0]) + 4)
    one = U(1 << ALL)
    for t in range(int(n[0])):
        if t >= n[model.n - 1]:
            model.keep(model.n - 1)  # only the last lane can be shorter
        if _refreshes(t):
            model.refresh()
        x = grid[t, : model.n].astype(I)
        kind = model.rank.take(x, mode="clip")
        guess, p = model.predict()
        hit = (guess == x) & model.valid
        a, b = model.cell(kind)
        q = one - p
        start = (a * q >> UROW) + p
        coder.put(model.n, start * ~hit, np.where(hit, p, (b * q >> UROW) + p - start), UALL)
        rare = np.nonzero((kind == model.other) & ~hit)[0]
        if len(rare):
            y = x[rare]
            a = model.ranges[y]
            coder.put_some(rare, a, model.ranges[y + 1] - a, UFLAT)
            model.rare.append(y)
        model.update(x, kind, hit)
    used, words = coder.finish()
    return np.concatenate([used.astype("<u2"), words])


def decode_block(words: np.ndarray, total: int, vocab: int, top: np.ndarray, steps: int = STEPS) -> np.ndarray:
    n = _lengths(total, steps)
    used = words[: len(n)].astype(I)
    if used.sum() != len(words) - len(n):
        raise ValueError("the block's length is not that of its lanes")
    grid = np.zeros((int(n[0]), len(n)), np.int32)
    model, c = _Model(len(n), vocab, top), _Decoder(used, words[len(n) :])
    one = U(1 << ALL)
    for t in range(int(n[0])):
        if t >= n[model.n - 1]:
            model.keep(model.n - 1)
            c.code, c.range, c.at = c.code[: model.n], c.range[: model.n], c.at[: model.n]
        if _refreshes(t):
            model.refresh()
        guess, p = model.predict()
        r = c.range >> UALL
        v = np.minimum(c.code // np.maximum(r, U(1)), one - U(1))
        hit = v < p
        q = one - p
        y = np.where(hit, U(0), v - p)
        kind = np.minimum(model.find((((y + U(1)) << UROW) - U(1)) // q), model.other)
        a, b = model.cell(kind)
        start = (a * q >> UROW) + p
        c.code, c.range, c.at = c.take(c.code, c.range, c.at, r, start * ~hit, np.where(hit, p, (b * q >> UROW) + p - start))
        x = np.where(hit, guess, model.ids[kind])
        rare = np.nonzero((kind == model.other) & ~hit)[0]
        if len(rare):
            code, rng = c.code[rare], c.range[rare]
            r = rng >> UFLAT
            v = np.minimum(code // np.maximum(r, U(1)), U((1 << FLAT) - 1))
            y = np.searchsorted(model.ranges, v, "right") - 1
            a = model.ranges[y]
            c.code[rare], c.range[rare], c.at[rare] = c.take(code, rng, c.at[rare], r, a, model.ranges[y + 1] - a)
            x[rare] = y
            model.rare.append(y)
        kind = model.rank.take(x, mode="clip")
        model.update(x, kind, hit)
        grid[t, : model.n] = x
    return grid.T.ravel()[:total]


def segment(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, block: int = BLOCK, frequent: int = FREQUENT) -> bytes:
    """The image of a segment of whole documents."""
    counted = np.bincount(ids) if len(ids) else np.zeros(1, I)
    vocab = len(counted)
    if vocab > 1 << 17:
        raise ValueError("ids are below 131072")
    top = np.argsort(-counted, kind="stable")[: min(frequent, int((counted > 0).sum()))].astype("<u4")
    words = [encode_block(ids[lo : lo + block], vocab, top) for lo in range(0, len(ids), block)]
    crcs = [zlib.crc32(ids[lo : lo + block].astype("<u4").tobytes()) for lo in range(0, len(ids), block)]
    head = MAGIC + struct.pack("<IIIIIQ", len(doc_ids), block, len(words), vocab, len(top), len(ids))
    index = np.array([[len(w) for w in words], crcs], "<u4").T.tobytes() if words else b""
    docs = np.zeros(len(doc_ids), [("id", "<i8"), ("n", "<u4")])
    docs["id"], docs["n"] = doc_ids, counts
    return b"".join([head, top.tobytes(), index, docs.tobytes(), *(w.astype("<u2").tobytes() for w in words)])


def read_segment(image: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, counts, ids) of a segment image; a damaged block raises ValueError."""
    if image[:8] != MAGIC:
        raise ValueError("not a token-id segment")
    n_docs, block, k, vocab, n_top, total = struct.unpack_from("<IIIIIQ", image, 8)
    at = 8 + struct.calcsize("<IIIIIQ")
    top = np.frombuffer(image, "<u4", n_top, at)
    at += 4 * n_top
    index = np.frombuffer(image, "<u4", 2 * k, at).reshape(k, 2)
    at += 8 * k
    docs = np.frombuffer(image, [("id", "<i8"), ("n", "<u4")], n_docs, at)
    at += docs.nbytes
    flat = np.frombuffer(image, "<u2", -1, at)
    ends = np.cumsum(index[:, 0].astype(I))
    if len(flat) != (ends[-1] if k else 0):
        raise ValueError("the segment's length is not that of its blocks")
    parts = [np.zeros(0, np.int32)]
    for i, (end, n, size) in enumerate(zip(ends.tolist(), index[:, 0].tolist(), _lengths(total, block).tolist(), strict=True)):
        parts.append(decode_block(flat[end - n : end], size, vocab, top))
        if zlib.crc32(parts[-1].astype("<u4").tobytes()) != index[i, 1]:
            raise ValueError(f"block {i} is damaged")
    return docs["id"], docs["n"], np.concatenate(parts)
