"""Secret scans by one combined deterministic automaton over bytes.

All rules' patterns are parsed into one nondeterministic automaton that may
begin at every byte, made deterministic by subset construction over classes of
equal bytes, minimised by partition refinement, and stored as one transition
array. Texts are laid end to end with a reserved symbol between them and read
once, for all rules, in numpy: the stream is cut into lanes that advance
together; a lane that began in another state than its predecessor ended in is
read again until both runs agree, so the result is that of a sequential scan.

Where the automaton reports a rule, the match's start is found by the rule's
reversed automaton and its greatest end by the rule's own. Matches of a rule are
leftmost, greedy and do not overlap; a filter on the match then drops those
that are too short. Patterns may use literals, classes, groups, ``|`` and the
repetitions ``? * + {n} {n,} {n,m}`` (prefer at_least to counts: they multiply states); a rule's first end must not lie inside a
match of the same rule that begins earlier and ends later, as is so for all
rules that are tagged by a literal.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

ANY = frozenset(range(256))
BREAK = 256  # the symbol between texts
#: Bytes of text redacted at a time: the scan takes some thirty bytes for each.
SLICE = 1 << 20


@dataclass(frozen=True)
class Rule:
    """kind: name in the output; pattern: as the automaton reads it; at_least: characters of a match, or of what follows head.

    head: pattern of the part of a match before the value that at_least counts.
    tail: pattern, as re reads it, of what follows the automaton's match and belongs to it.
    """

    kind: str
    pattern: str
    at_least: int = 1
    head: str = ""
    tail: str = ""


KEYWORD = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
HEAD = KEYWORD + r"""["']?\x20*[:=]\x20*["']?"""
#: What follows a key's first line: all up to its END line; where that is missing, its headers and lines of base64.
KEY_BREAK = r"(?:\s|\\[nrt])+"
KEY_BODY = (
    r"(?:(?!-----BEGIN )[\s\S])*?-----END [A-Z ]*PRIVATE KEY-----"
    rf"|(?:{KEY_BREAK}(?:Proc-Type|DEK-Info): [^\r\n\\]*)*"
    rf"(?:(?:{KEY_BREAK}[A-Za-z0-9+/]{{16,}}={{0,2}})+(?:{KEY_BREAK}[A-Za-z0-9+/]{{1,15}}={{0,2}}(?=[ \t]*(?:[\r\n\\]|\Z)))?)?"
)
BASE = (
    Rule("assign", HEAD + "[A-Za-z0-9+/_.=-]+", 12, HEAD),
    Rule("access", "AKIA[A-Z0-9]+", 18),
    Rule("hex", "[0-9a-f]{16,}", 16),
)
MORE = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("google", "AIza[A-Za-z0-9_-]+", 39),
    Rule("web_token", "eyJ[A-Za-z0-9_.-]+", 40),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 27, tail=KEY_BODY),
)
RULES = (*BASE, *MORE)


# ---------------------------------------------------------------- patterns -> nondeterministic automaton


class _Parser:
    """Recursive descent into nested tuples: ("set", bytes), ("cat", [..]), ("alt", [..]), ("rep", x, least, most or None)."""

    ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}

    def __init__(self, pattern: str) -> None:
        self.p, self.i = pattern, 0

    def tree(self):
        out = self.alternatives()
        if self.i != len(self.p):
            raise ValueError(f"unread rest of the pattern at {self.i}: {self.p}")
        return out

    def alternatives(self):
        found = [self.sequence()]
        while self.i < len(self.p) and self.p[self.i] == "|":
            self.i += 1
            found.append(self.sequence())
        return found[0] if len(found) == 1 else ("alt", found)

    def sequence(self):
        found = []
        while self.i < len(self.p) and self.p[self.i] not in "|)":
            x = self.atom()
            while self.i < len(self.p) and self.p[self.i] in "?*+{":
                x = ("rep", x, *self.repetition())
            found.append(x)
        return ("cat", found)

    def repetition(self) -> tuple[int, int | None]:
        c = self.p[self.i]
        if c != "{":
            self.i += 1
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
        end = self.p.index("}", self.i)
        low, _, high = (inner := self.p[self.i + 1 : end]).partition(",")
        self.i = end + 1
        return int(low), (int(high) if high else None) if "," in inner else int(low)

    def atom(self):
        c = self.p[self.i]
        if c == "(":
            self.i += 1
            out = self.alternatives()
            self.i += 1
            return out
        if c == "[":
            return ("set", self.char_class())
        if c == ".":
            self.i += 1
            return ("set", ANY - {10})
        return ("set", frozenset([self.char()]))

    def char(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c == "\\":
            c = self.p[self.i]
            self.i += 1
            if c == "x":
                self.i += 2
                return int(self.p[self.i - 2 : self.i], 16)
            c = self.ESCAPES.get(c, c)
        if ord(c) > 127:
            raise ValueError("patterns are ASCII")
        return ord(c)

    def char_class(self) -> frozenset[int]:
        self.i += 1
        negative = self.p[self.i] == "^"
        self.i += negative
        out: set[int] = set()
        while self.p[self.i] != "]":
            low = self.char()
            if self.p[self.i] == "-" and self.p[self.i + 1] != "]":
                self.i += 1
                out.update(range(low, self.char() + 1))
            else:
                out.add(low)
        self.i += 1
        return frozenset(ANY - out if negative else out)


def _reversed(x):
    if x[0] == "cat":
        return ("cat", [_reversed(y) for y in reversed(x[1])])
    if x[0] == "alt":
        return ("alt", [_reversed(y) for y in x[1]])
    return ("rep", _reversed(x[1]), *x[2:]) if x[0] == "rep" else x


class _Nfa:
    def __init__(self) -> None:
        self.free: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.free.append([])
        self.moves.append([])
        return len(self.free) - 1

    def add(self, x, start: int) -> int:
        """Adds x from start; its end state."""
        if x[0] == "set":
            end = self.state()
            self.moves[start].append((x[1], end))
            return end
        if x[0] == "cat":
            for y in x[1]:
                start = self.add(y, start)
            return start
        if x[0] == "alt":
            end = self.state()
            for y in x[1]:
                self.free[self.add(y, start)].append(end)
            return end
        _, y, least, most = x
        for _ in range(least):
            start = self.add(y, start)
        if most is None:
            loop = self.state()
            self.free[start].append(loop)
            self.free[self.add(y, loop)].append(loop)
            return loop
        end = self.state()
        for _ in range(most - least):
            self.free[start].append(end)
            start = self.add(y, start)
        self.free[start].append(end)
        return end

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


# ---------------------------------------------------------------- deterministic automaton


@dataclass
class Dfa:
    """table[state * n_classes + classes[byte]] is the next state; marks[state]: bits of the rules that end here. State 0 begins.

    In an automaton for a whole match (not searching) dead is the state without a way out, else -1.
    """

    table: np.ndarray
    classes: np.ndarray
    n_classes: int
    marks: np.ndarray
    dead: int

    def __post_init__(self) -> None:
        self.rows = self.table.reshape(-1, self.n_classes).tolist()
        self.byte_class = self.classes.tolist()
        self.ends = self.marks.tolist()


def build(trees: list, search: bool) -> Dfa:
    """The minimal automaton of all trees; rule k marks bit k. search: it may begin at every byte and restarts at BREAK."""
    nfa = _Nfa()
    first = nfa.state()
    finals: dict[int, int] = {}
    for k, x in enumerate(trees):
        s = nfa.state()
        nfa.free[first].append(s)
        end = nfa.add(x, s)
        finals[end] = finals.get(end, 0) | 1 << k
    sets = sorted({s for m in nfa.moves for s, _ in m}, key=sorted)
    names: dict[tuple, int] = {}
    classes = np.array([names.setdefault(tuple(b in s for s in sets), len(names)) for b in range(256)] + [0])
    n = len(names) + 1
    classes[BREAK] = n - 1
    sample = {c: int(np.nonzero(classes == c)[0][0]) for c in range(n - 1)}
    start = nfa.closure([first])
    ids, todo, table = {start: 0}, deque([start]), []
    while todo:
        now = todo.popleft()
        row = []
        moves = [m for q in now for m in nfa.moves[q]]
        for c in range(n):
            if c == n - 1:
                to = start if search else frozenset()
            else:
                to = nfa.closure({t for s, t in moves if sample[c] in s} | ({first} if search else set()))
            if to not in ids:
                ids[to] = len(ids)
                todo.append(to)
            row.append(ids[to])
        table.append(row)
    marks = [0] * len(ids)
    for states, k in ids.items():
        for q in states:
            marks[k] |= finals.get(q, 0)
    dead = ids.get(frozenset(), -1)
    return _minimal(np.array(table), np.array(marks), classes, n, dead)


def _minimal(table: np.ndarray, marks: np.ndarray, classes: np.ndarray, n: int, dead: int) -> Dfa:
    """Moore's partition refinement: states stay together while their marks and their successors' blocks are the same."""
    block = np.unique(marks, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    order = np.full(block.max() + 1, -1)
    count = 0
    for b in block:  # number the blocks as met, so that the first state's is 0
        if order[b] < 0:
            order[b] = count
            count += 1
    block = order[block]
    small, small_marks = np.zeros((count, n), np.int64), np.zeros(count, np.int64)
    small[block] = block[table]
    small_marks[block] = marks
    return Dfa(small.ravel().astype(np.int32), classes.astype(np.int32), n, small_marks, int(block[dead]) if dead >= 0 else -1)


# ---------------------------------------------------------------- scanning


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        trees = [_Parser(r.pattern).tree() for r in rules]
        self.all = build(trees, search=True)
        self.forward = [build([t], search=False) for t in trees]
        self.backward = [build([_reversed(t)], search=False) for t in trees]
        self.heads = [re.compile(r.head.encode()) if r.head else None for r in rules]
        self.tails = [re.compile(r.tail.encode()) if r.tail else None for r in rules]

    def states(self, stream: np.ndarray, width: int = 2048) -> np.ndarray:
        """The state after each symbol of stream (byte classes), as one sequential run from state 0 would have it."""
        d = self.all
        n = len(stream)
        steps = max(64, -(-n // width))
        lanes = -(-n // steps)
        padded = np.full(lanes * steps, d.n_classes - 1, np.int32)
        padded[:n] = stream
        sym = np.ascontiguousarray(padded.reshape(lanes, steps).T)
        out = np.empty((steps, lanes), np.int32)
        s = np.zeros(lanes, np.int32)
        for t in range(steps):
            s = d.table[s * d.n_classes + sym[t]]
            out[t] = s
        # lanes whose predecessor did not end in state 0 are read again until the runs agree
        wrong = np.nonzero(out[-1, :-1] != 0)[0] + 1
        while len(wrong):
            ended = out[-1].copy()
            lane, s = wrong, out[-1, wrong - 1]
            for t in range(steps):
                s = d.table[s * d.n_classes + sym[t, lane]]
                differ = s != out[t, lane]
                if not differ.any():
                    break
                lane, s = lane[differ], s[differ]
                out[t, lane] = s
            changed = np.nonzero(out[-1] != ended)[0] + 1
            wrong = changed[changed < lanes]
        return out.T.ravel()[:n]

    def spans(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """(start, rule, end) in bytes of each text's matches, by start and then rule."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        d = self.all
        joined = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts])
        stream = d.classes[joined]
        stream[ends - 1] = d.n_classes - 1
        marks = d.marks[self.states(stream)]
        hits = np.nonzero(marks)[0]
        last = [[0] * len(self.rules) for _ in texts] if len(hits) else []
        which = np.searchsorted(ends, hits, "right")
        for at, k, bits in zip(hits.tolist(), which.tolist(), marks[hits].tolist(), strict=True):
            text, end = texts[k], at + 1 - (int(ends[k - 1]) if k else 0)
            for r in range(len(self.rules)):
                if bits >> r & 1 and end > last[k][r]:
                    start = self._furthest(self.backward[r], text, end - 1, last[k][r] - 1, -1)
                    if start is None:
                        continue
                    stop = self._furthest(self.forward[r], text, start, len(text), 1) + 1
                    if self.tails[r] and (more := self.tails[r].match(text, stop)):
                        stop = more.end()
                    last[k][r] = stop
                    if self._long_enough(r, text[start:stop]):
                        found[k].append((start, r, stop))
        for x in found:
            x.sort()
        return found

    @staticmethod
    def _furthest(d: Dfa, text: bytes, at: int, stop: int, step: int) -> int | None:
        """The last position of the longest run of d over text from at towards stop that ends a match."""
        s, best = 0, None
        for i in range(at, stop, step):
            s = d.rows[s][d.byte_class[text[i]]]
            if s == d.dead:
                break
            if d.ends[s]:
                best = i
        return best

    def _long_enough(self, r: int, match: bytes) -> bool:
        head = self.heads[r]
        return len(match) - (head.match(match).end() if head else 0) >= self.rules[r].at_least

    def kind(self, r: int) -> str:
        return self.rules[r].kind


def _code_points(text: bytes, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """The spans with code points for bytes."""
    if text.isascii():
        yield from spans
        return
    starts = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    for a, r, b in spans:
        yield (int(starts[a - 1]) if a else 0), r, int(starts[b - 1])


_scanners: dict[tuple[Rule, ...], Scanner] = {}


def scanner(rules: tuple[Rule, ...]) -> Scanner:
    """One per worker process."""
    if rules not in _scanners:
        _scanners[rules] = Scanner(rules)
    return _scanners[rules]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and matches (array of kind, start, end in code points, end exclusive) of every row of docs.

    Null and empty texts have no match. Texts of any length are read whole.
    """

    def run(batches):
        sc = scanner(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for ids, texts, _ in common.doc_batches(batches, rows=4096):
            got = [[{"kind": sc.kind(r), "start": a, "end": b} for a, r, b in _code_points(t, x)] if x else [] for t, x in zip(texts, sc.spans(texts), strict=True)]
            yield pa.RecordBatch.from_arrays([common.id_array(ids), pa.array(got, kind)], names=["doc_id", "matches"])

    return common.id_and_text(docs).mapInArrow(run, "doc_id long, matches array<struct<kind:string,start:long,end:long>>")


def digests(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the counts of the base kinds, base_sha256 and spans (kind:start:end joined by commas, by start and then rule)."""

    def run(batches):
        sc = scanner(rules)
        base = {r.kind for r in BASE}
        for ids, texts, _ in common.doc_batches(batches, rows=4096):
            counts, hashes, spans = [], [], []
            for t, x in zip(texts, sc.spans(texts), strict=True):
                named = [(sc.kind(r), f"{sc.kind(r)}:{a}:{b}") for a, r, b in _code_points(t, x)] if x else []
                counts.append([sum(k == r.kind for k, _ in named) for r in BASE])
                hashes.append(hashlib.sha256(",".join(s for k, s in named if k in base).encode()).hexdigest())
                spans.append(",".join(s for _, s in named))
            yield pa.RecordBatch.from_arrays([common.id_array(ids), *(pa.array(np.array(c, np.int64)) for c in np.array(counts).reshape(-1, 3).T), pa.array(hashes), pa.array(spans)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return common.id_and_text(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", chars: str | None = "n_chars") -> DataFrame:
    """docs with each match replaced by [KIND] in the text, and chars (if it is a column) set to the new length.

    Overlapping matches are replaced as one, by the kind of the first. Documents
    stay; a null text stays null. All other columns are passed on as they are.
    """
    schema = docs.schema
    names = docs.columns
    at = names.index(text)
    common.bounded_batches(docs.sparkSession)

    def redacted(batch: pa.RecordBatch, sc: Scanner) -> pa.RecordBatch:
        texts = batch.column(at).cast(pa.large_binary()).to_pylist()
        for i, x in enumerate(sc.spans([t or b"" for t in texts])):
            if x:
                texts[i] = _cut(sc, texts[i], x)
        arrays = [batch.column(i) for i in range(batch.num_columns)]
        arrays[at] = pa.array(texts, pa.large_binary()).cast(arrays[at].type)
        if chars in names:
            n = pa.compute.utf8_length(arrays[at])
            changed = pa.compute.not_equal(pa.compute.binary_length(arrays[at]), pa.compute.binary_length(batch.column(at)))
            k = names.index(chars)
            arrays[k] = pa.compute.if_else(pa.compute.fill_null(changed, False), n.cast(arrays[k].type), arrays[k])
        return pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    def run(batches):
        sc = scanner(rules)
        for batch in batches:
            lengths = np.asarray(pa.compute.binary_length(batch.column(at)).fill_null(0))
            for lo, hi in common.slices(lengths, 1024, SLICE):
                yield redacted(batch.slice(lo, hi - lo), sc)
        common.trim()

    return docs.mapInArrow(run, schema)


def _cut(sc: Scanner, text: bytes, spans: list[tuple[int, int, int]]) -> bytes:
    out, done, last = [], 0, -1
    for a, r, b in spans:
        if a >= done:
            out += [text[last if last > 0 else 0 : a] if last >= 0 else text[:a], f"[{sc.kind(r).upper()}]".encode()]
        done = last = max(done, b)
    return b"".join(out) + text[last:]
