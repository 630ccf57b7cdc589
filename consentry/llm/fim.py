"""Fill-in-the-middle: texts cut into prefix, middle and suffix at unit boundaries.

A unit is a run of blanks with the word after it, or the blanks that end a text.
One deterministic automaton over bytes knows the units, the sentinels and UTF-8:
its states are the product of where in a unit a text is and how much of a sentinel
was just read, and each transition emits what it counts (a code point begins, a
unit begins, a sentinel ends; a UTF-8 continuation byte emits nothing). Texts are
laid end to end with a reserved symbol between them and read once, in lanes that
advance together; a lane begins a sentinel's length early, by when its state no
longer depends on the one that it began in. A second pass over the transitions
that began a unit locates the cuts.

Rules: a null text is the empty text; a null doc_id counts as an empty id. The empty
text, and a text that holds a sentinel, keep the plain form. Rows with the same id get the
same random numbers; repeated rows stay repeated. An empty table gives no rows, and
other columns of the input are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SENTINELS = ("<P>", "<S>", "<M>")
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
BREAK = 256  # the symbol between texts
CHAR, UNIT, SENTINEL = 1, 2, 4


class Automaton:
    """Transition and emission arrays over classes of bytes that no state tells apart."""

    def __init__(self, sentinels: tuple[str, ...]) -> None:
        marks = [s.encode() for s in sentinels]
        if not all(marks) or any(a[:k] == b[-k:] for a in marks for b in marks for k in range(1, min(len(a), len(b)) + (a is not b))):
            raise ValueError("sentinels must not be empty, repeat, or overlap each other")
        # what was read of a sentinel: the longest beginning of one that the text ends in
        begun = sorted({m[:k] for m in marks for k in range(len(m) + 1)}, key=lambda b: (len(b), b))
        states = {("start", b""): 0}
        todo, rows, emits = [("start", b"")], [], []
        while todo:
            phase, read = todo.pop(0)
            row, emit = [], []
            for byte in range(256):
                blank = byte in BLANKS
                ended = read + bytes([byte])
                now = ("blank" if blank else "word", next(ended[k:] for k in range(len(ended) + 1) if ended[k:] in begun))
                if now not in states:
                    states[now] = len(states)
                    todo.append(now)
                row.append(states[now])
                emit.append((byte & 0xC0 != 0x80) * CHAR | (phase == "start" or blank and phase == "word") * UNIT | (now[1] in marks) * SENTINEL)
            rows.append([*row, 0])
            emits.append([*emit, 0])
        columns, self.classes = np.unique(np.vstack([rows, emits]).T, axis=0, return_inverse=True)
        self.classes = self.classes.ravel().astype(np.int64)
        n = len(states)
        self.width = len(columns)
        self.next = np.ascontiguousarray(columns[:, :n].T).ravel() * self.width  # where the row of the next state begins
        self.emit = np.ascontiguousarray(columns[:, n:].T).ravel().astype(np.uint8)
        self.memory = max(map(len, marks), default=0) + 1

    def read(self, symbols: np.ndarray) -> np.ndarray:
        """What each symbol's transition emits; symbols: bytes, and BREAK between texts."""
        n = len(symbols)
        width = max(64, min(2048, int(n**0.5)))
        lanes = -(-n // width) if n else 0
        line = np.full(self.memory + lanes * width, self.classes[BREAK])
        line[self.memory : self.memory + n] = self.classes[symbols]
        steps = np.ascontiguousarray(np.lib.stride_tricks.as_strided(line, (lanes, self.memory + width), (width * line.itemsize, line.itemsize)).T)
        row = np.zeros(lanes, np.int64)
        out = np.empty((width, lanes), np.uint8)
        for t, step in enumerate(steps):
            at = row + step
            row = self.next[at]
            if t >= self.memory:
                out[t - self.memory] = self.emit[at]
        return out.T.ravel()[:n]


@functools.cache
def automaton(sentinels: tuple[str, ...] = SENTINELS) -> Automaton:
    return Automaton(sentinels)


class Scanned:
    """The texts of a batch after one scan: counts of each text, and the places of its units."""

    def __init__(self, texts: list[bytes], sentinels: tuple[str, ...] = SENTINELS) -> None:
        sizes = np.array([len(t) for t in texts], np.int64)
        self.data = b"\0".join([*texts, b""])
        self.begin = np.cumsum(np.concatenate([[0], sizes + 1]))[:-1]
        self.end = self.begin + sizes
        symbols = np.frombuffer(self.data, np.uint8).astype(np.int16)
        symbols[self.end] = BREAK
        emitted = automaton(sentinels).read(symbols)
        self._chars = self._counted(emitted, CHAR)
        self._units = np.flatnonzero(emitted & UNIT)
        self._first = np.searchsorted(self._units, self.begin)
        self.n_units = np.searchsorted(self._units, self.end) - self._first
        self.n_chars = self.chars(self.begin, self.end)
        ends = self._counted(emitted, SENTINEL)
        self.n_sentinels = ends[self.end] - ends[self.begin]

    @staticmethod
    def _counted(emitted: np.ndarray, what: int) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(emitted & what != 0, dtype=np.int64)])

    def chars(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Code points between places a and b."""
        return self._chars[b] - self._chars[a]

    def after(self, units: np.ndarray) -> np.ndarray:
        """The place in the data where so many units of each text have ended."""
        padded = np.append(self._units, 0)
        return np.where(units < self.n_units, padded[np.minimum(self._first + units, len(self._units))], self.end)


def random_numbers(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers: the first groups of eight digits of the sha256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def transform(docs: DataFrame, rate: int = 50, spm_rate: int = 80, seed: int = 42, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """doc_id, n (units), n_chars, form, prefix_chars, middle_chars and output of every row of docs.

    rate: percent of the texts that are transformed; spm_rate: percent of these that put the
    suffix first (spm), others begin with the prefix (psm). sentinels: of prefix, suffix
    and middle. prefix_chars and middle_chars (code points) are null for the plain form.
    """
    p, s, m = (x.encode() for x in sentinels)
    given = common.id_and_text(docs)

    def run(batches):
        for ids, texts, part in common.doc_batches(batches):
            got = Scanned(texts, sentinels)
            h = [np.asarray(part.column(f"h{k}")) for k in range(1, 5)]
            one, other = h[0] % (got.n_units + 1), h[1] % (got.n_units + 1)
            low, high = got.after(np.minimum(one, other)), got.after(np.maximum(one, other))
            plain = (got.n_chars == 0) | (got.n_sentinels > 0) | (h[2] % 100 >= rate)
            spm = h[3] % 100 < spm_rate
            out = []
            for k, (a, b, c, d) in enumerate(zip(got.begin.tolist(), low.tolist(), high.tolist(), got.end.tolist(), strict=True)):
                if plain[k]:
                    out.append(texts[k])
                    continue
                prefix, middle, suffix = got.data[a:b], got.data[b:c], got.data[c:d]
                out.append(b"".join((s, suffix, p, prefix, m, middle) if spm[k] else (p, prefix, s, suffix, m, middle)))
            form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
            columns = [common.id_array(ids), pa.array(got.n_units), pa.array(got.n_chars), pa.array(form.tolist(), pa.string()), pa.array(got.chars(got.begin, low), mask=plain), pa.array(got.chars(low, high), mask=plain), pa.array(out, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "n_chars", "form", "prefix_chars", "middle_chars", "output"])

    return given.select("*", *random_numbers(F.col("doc_id"), seed)).mapInArrow(run, "doc_id long, n long, n_chars long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of transform() was made of, as an expression of output and form."""
    p, s, m = sentinels

    def between(begin: Column, end: Column) -> Column:
        return F.substr(output, begin, end - begin)

    def at(mark: str) -> Column:
        return F.instr(output, F.lit(mark))

    tail = F.substr(output, at(m) + len(m))
    psm = F.concat(between(F.lit(len(p) + 1), at(s)), tail, between(at(s) + len(s), at(m)))
    spm = F.concat(between(at(p) + len(p), at(m)), tail, between(F.lit(len(s) + 1), at(p)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


#: SQL for op11's rows.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS x,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
h AS (SELECT doc_id, t, u, len(u) AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
