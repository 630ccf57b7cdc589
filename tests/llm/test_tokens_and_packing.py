"""Batches of texts have the library's ids; pieces are assigned by the stated rule; id files are small."""

import random
import zlib

import numpy as np
import pytest

from consentry.llm import coder, common, packing, tokens

PARTS = ["a", "B", "é", "ß", " ", " ", "\n", "\t", "'", "s", "t", "re", "ll", "ve", "d", "m", "1", "23", ".", ",", "×", "÷", "“", "中", "<|endoftext|>", "\x1c", "\x85", "\xa0", "ø", "\r", "\x7f", "ɐ"]


@pytest.mark.parametrize("parts", [PARTS, [p for p in PARTS if p in "aBé \n'srelveld1."]])
def test_batches_are_the_librarys(parts):
    cache, r = tokens.cache(tokens.tokenizer_path()), random.Random(5)
    for _ in range(600):
        texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(r.randint(0, 6))]
        ids, n = cache.batch([t.encode() for t in texts])
        cut = np.concatenate([[0], np.cumsum(n)]).astype(int)
        assert [ids[a:b].tolist() for a, b in zip(cut, cut[1:])] == [cache.tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_full_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "MAX_WORDS", 3)
    cache = tokens.IdCache(tokens.tokenizer_path())
    texts = [b"one two three four five six", b"six five four", b"x" * 500 + b" one"]
    ids, _ = cache.batch(texts)
    assert ids.tolist() == [i for t in texts for i in cache.tok.encode(t.decode(), add_special_tokens=False).ids]
    assert len(cache.fresh) <= 3 and len(cache.stale) <= 3


def _assigned(lengths, capacity, linear=1.0, quadratic=1 / 2048):
    """The rule by looking at all sequences."""
    out, rest, whole = [], [], 0
    for d, n in enumerate(lengths):
        for k in range(n // capacity):
            out.append((d, k * capacity, capacity, whole, 0))
            whole += 1
        if n % capacity:
            rest.append((n % capacity, d))
    state = [[0.0, 0] for _ in range(-(-sum(n for n, _ in rest) // capacity))]
    while rest:
        n, d = min(rest, key=lambda x: (-x[0], x[1]))
        rest.remove((n, d))
        fits = [s for s, (_, used) in enumerate(state) if capacity - used >= n] or [s for s, (_, used) in enumerate(state) if used < capacity]
        s = min(fits, key=lambda s: (state[s][0], s))
        take = min(n, capacity - state[s][1])
        out.append((d, lengths[d] - n, take, whole + s, state[s][1]))
        state[s] = [state[s][0] + linear * take + quadratic * take * take, state[s][1] + take]
        if take < n:
            rest.append((n - take, d))
    return out


def test_assignment_is_the_rule():
    r = random.Random(2)
    for _ in range(150):
        lengths = [r.randint(1, r.choice([4, 40, 260])) for _ in range(r.randint(0, 50))]
        capacity = r.choice([1, 8, 63, 64, 100])
        assert list(packing.assign(lengths, capacity)) == _assigned(lengths, capacity)


def test_files_are_smaller_than_deflate(spark, sf):
    cache = tokens.cache(tokens.tokenizer_path())
    ids, _ = cache.ended([(r.text or "").encode() for r in common.documents(spark, sf.replace("sf0.001", "sf0.01")).orderBy("doc_id").collect()], 2)
    image = coder.segment(np.array([0]), np.array([len(ids)]), ids)
    assert len(image) * 8 < 7 * len(ids) and len(image) < len(zlib.compress(ids.astype("<u2").tobytes(), 9))
    assert (coder.read_segment(image)[2] == ids).all()


def test_blocks_are_decoded_alone():
    ids = np.random.default_rng(3).zipf(1.4, 5000) % 900
    top = np.arange(40)
    words = [coder.encode_block(ids[lo : lo + 2000], 900, top) for lo in (0, 2000, 4000)]
    assert (coder.decode_block(words[2], 1000, 900, top) == ids[4000:]).all()
