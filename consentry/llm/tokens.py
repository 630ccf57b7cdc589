"""Token ids of whole texts with a public tokenizer file, at bounded memory.

A byte-level BPE splits a text into pre-tokens before it merges anything. Texts of
ASCII and Latin letters are cut into pre-tokens many at a time, by the classes of
their bytes; of a batch each different pre-token is encoded once, by the model of
the tokenizers library, and its ids are kept in a bounded cache. Texts with other
characters are cut at blanks, and the pieces by the library's own pre-tokeniser.
A text in which blanks stand in a run with other characters, so
that a cut could fall inside a pre-token, or which holds an added token of the
file, which the library finds before it splits, is encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa

RUN_OF_BLANKS = re.compile(r"\s (?:\s|$)")
#: Pre-tokens of texts of printable ASCII and line breaks, as the file's pattern has them.
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")
ENDINGS, LATIN_END = tuple(".,!?;:"), "\u0250"
MAX_PIECES, MAX_WORDS = 100_000, 200_000
#: Longer pre-tokens are not kept.
MAX_KEPT = 64
BLANK, BREAK, LETTER, DIGIT, OTHER = range(5)


def _byte_chars() -> dict[int, int]:
    """The character that byte-level BPE files write for each byte: itself if printable, else one from 256 up."""
    plain = [b for b in range(256) if chr(b).isprintable() and b != 0x20]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


BYTE_CHARS = _byte_chars()


def _byte_classes() -> tuple[np.ndarray, np.ndarray]:
    """The class of each byte, and whether a text with it is left to the library's pre-tokeniser.

    All bytes from 128 up count as letters, which holds of the two-byte characters that begin
    with 0xC3 to 0xC8, but for the signs of multiplication and division.
    """
    kind = np.full(256, OTHER, np.uint8)
    kind[0x20] = BLANK
    kind[0x09:0x0E] = BREAK
    kind[ord("0") : ord("9") + 1] = DIGIT
    kind[ord("A") : ord("Z") + 1] = kind[ord("a") : ord("z") + 1] = LETTER
    kind[128:] = LETTER
    odd = np.zeros(256, bool)
    odd[[*range(0x09), *range(0x0E, 0x20), 0x7F, *range(0xC0, 0xC3), *range(0xC9, 0x100)]] = True
    return kind, odd


KIND, ODD = _byte_classes()


def token_starts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of texts without odd bytes begin; ends: of the texts, which are not empty.

    A blank goes with what follows it; of white space before something else the last
    character stands alone or, if a blank, with that; at the end of a text it stays together.
    """
    kind = KIND[data]
    n = len(data)
    start = np.empty(n, bool)
    start[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start[1:] &= kind[:-1] != BLANK
    space = kind <= BREAK
    at = np.nonzero(space)[0]
    last = np.zeros(n + 1, bool)
    last[ends] = True
    start[at] = ~space[at - 1] | ~(space[np.minimum(at + 1, n - 1)] | last[at + 1])
    start[0] = True
    start[ends[:-1]] = True
    quote = np.nonzero(data[:-1] == ord("'"))[0] if n else at
    if len(quote):
        a, b = data[quote + 1], data[np.minimum(quote + 2, n - 1)]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        stop = ends[np.searchsorted(ends, quote, "right")]
        one &= quote + 1 < stop
        two &= quote + 2 < stop
        own = start[quote]
        q, size = quote[own & (one | two)], np.where(one, 2, 3)[own & (one | two)]
        start[q + 1] = False
        start[(q + size)[q + size < n]] = True
    return np.nonzero(start)[0]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _has_run(text: str) -> bool:
    """Whether RUN_OF_BLANKS is in the text, without the regex where all white space is blanks and line breaks."""
    if text.replace("\n", "").isprintable():
        return "  " in text or "\n \n" in text or text.endswith("\n ")
    return RUN_OF_BLANKS.search(text) is not None


class IdCache(dict):
    """Piece of text that follows a blank -> its ids' bytes."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.words: dict[str, bytes] = {}
        self.fresh: dict[bytes, bytes] = {}
        self.stale: dict[bytes, bytes] = {}
        self.model = self.tok.model
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.by_word = self.tok.normalizer is None and self._splits_as_expected()

    def _splits_as_expected(self) -> bool:
        """Whether the file's own pre-tokeniser cuts as this module does."""
        try:
            got = [w for w, _ in self.tok.pre_tokenizer.pre_tokenize_str(" ab12, c'll\nd \n\ne")]
        except Exception:  # noqa: BLE001  a file without a pre-tokeniser: texts are encoded whole
            return False
        return got == ["Ġab", "12", ",", "Ġc", "'ll", "Ċ", "d", "ĠĊ", "Ċ", "e"]

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MAX_PIECES:
            self.clear()
        if piece.isalpha() and (piece.isascii() or max(piece) < LATIN_END):
            out = self.word(f" {piece}")
        elif piece[-1:] in ENDINGS and piece[:-1].isalpha() and (piece.isascii() or max(piece) < LATIN_END):
            out = self.word(f" {piece[:-1]}") + self.word(piece[-1])
        elif piece.isascii() and piece.replace("\n", "").isprintable():
            out = b"".join(map(self.word, ASCII_WORDS.findall(f" {piece}")))
        else:
            out = b"".join([self.mapped(w) for w, _ in self.tok.pre_tokenizer.pre_tokenize_str(f" {piece}")])
        self[piece] = out
        return out

    def word(self, w: str) -> bytes:
        out = self.words.get(w)
        if out is None:
            if len(self.words) >= MAX_WORDS:
                self.words.clear()
            self.words[w] = out = self.mapped(w.encode().decode("latin-1").translate(BYTE_CHARS))
        return out

    def mapped(self, w: str) -> bytes:
        return array(self.code, [t.id for t in self.model.tokenize(w)]).tobytes()

    def of_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of pre-tokens. Of two generations kept, the older is dropped when the newer is full."""
        out = list(map(self.fresh.get, words))
        new = [i for i, x in enumerate(out) if x is None]
        if new and self.stale:
            for i in new:
                out[i] = self.stale.get(words[i])
            new, old = [i for i in new if out[i] is None], [i for i in new if out[i] is not None]
            self.keep(old, words, out)
        if new:
            apart = b"\xff"  # in no UTF-8 text
            texts = apart.join([words[i] for i in new]).decode("latin-1").translate(BYTE_CHARS).split(chr(BYTE_CHARS[0xFF]))
            tokenize, code = self.model.tokenize, self.code
            for i, text in zip(new, texts, strict=True):
                out[i] = array(code, [t.id for t in tokenize(text)]).tobytes()
            self.keep(new, words, out)
        return out

    def keep(self, some: list[int], words: list[bytes], ids: list[bytes]) -> None:
        lo = 0
        while lo < len(some):
            if len(self.fresh) >= MAX_WORDS:
                self.stale, self.fresh = self.fresh, {}
            hi = lo + MAX_WORDS - len(self.fresh)
            self.fresh.update([(words[i], ids[i]) for i in some[lo:hi] if len(words[i]) <= MAX_KEPT])
            lo = hi

    def batch(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, end to end, and their number in each."""
        sizes = np.array([len(t) for t in texts], np.int64)
        joined = b"".join(texts)
        data = np.frombuffer(joined, np.uint8)
        ends = np.cumsum(sizes)
        plain = sizes > 0
        if self.by_word and len(data):
            odd = np.nonzero(ODD[data])[0]
            sign = np.nonzero(data[:-1] == 0xC3)[0]
            sign = sign[np.isin(data[sign + 1], np.array([0x97, 0xB7], np.uint8))]
            found = [odd, sign]
            for t in self.added:
                t, at = t.encode(), joined.find(t.encode())
                while at >= 0:
                    found.append(np.array([at]))
                    at = joined.find(t, at + 1)
            plain[np.searchsorted(ends, np.concatenate(found), "right")] = False
            begins = data[(ends - sizes)[plain]]
            if ((begins & 0xC0) == 0x80).any() or not _is_utf8(joined):
                plain[:] = False
        else:
            plain[:] = False
        if not plain.all():
            some = [t for t, p in zip(texts, plain.tolist(), strict=True) if p]
            ids, counts = self._plain(b"".join(some), np.cumsum(sizes[plain]))
            cut = np.concatenate([[0], np.cumsum(counts)])
            parts, k, n = [], 0, np.zeros(len(texts), np.int64)
            for i, p in enumerate(plain.tolist()):
                if p:
                    parts.append(ids[cut[k] : cut[k + 1]])
                    k += 1
                else:
                    parts.append(self.ids(texts[i].decode("utf-8", "replace")))
                n[i] = len(parts[-1])
            return np.concatenate(parts) if parts else np.zeros(0, self.dtype), n
        return self._plain(joined, ends)

    def ended(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """batch() with end_id after each text's ids, and counted."""
        ids, n = self.batch(texts)
        n = n + 1
        out = np.full(len(ids) + len(n), end_id, self.dtype)
        inner = np.ones(len(out), bool)
        inner[np.cumsum(n) - 1] = False
        out[inner] = ids
        return out, n

    def _plain(self, joined: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(ends):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        starts = token_starts(np.frombuffer(joined, np.uint8), ends)
        offsets = np.append(starts, len(joined)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(joined)]).dictionary_encode()
        which = words.indices.to_numpy()
        got = self.of_words(words.dictionary.to_pylist())
        pool = np.frombuffer(b"".join(got), self.dtype)
        n = np.fromiter(map(len, got), np.int64, len(got)) // self.dtype.itemsize
        begin = np.cumsum(n) - n
        many = n[which]
        stop = np.cumsum(many)
        at = np.arange(stop[-1], dtype=np.int64) + np.repeat(begin[which] - (stop - many), many)
        upto = stop[np.searchsorted(starts, ends) - 1]
        return pool[at], np.diff(np.concatenate([[0], upto]))

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def ids(self, text: str) -> np.ndarray:
        if not self.by_word or _has_run(text) or any(t in text for t in self.added):
            return np.frombuffer(self.whole(text), self.dtype)
        first, *rest = text.split(" ")
        head = self.whole(first) if first else b""
        return np.frombuffer(head + b"".join(map(self.__getitem__, rest)), self.dtype)


def _is_utf8(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


_caches: dict[str, IdCache] = {}


def cache(path: str) -> IdCache:
    """One per worker process, kept from task to task."""
    if path not in _caches:
        _caches[path] = IdCache(path)
    return _caches[path]
