"""Previous smaller values and longest previous factors against brute force; counts of any size travel."""

import random

import numpy as np

from consentry.llm import chunks, suffix_dedup


def test_previous_smaller():
    r = random.Random(1)
    for _ in range(200):
        x = np.array([r.randint(0, r.choice([2, 9, 50])) for _ in range(r.randint(0, 70))], np.int64)
        assert suffix_dedup.previous_smaller(x).tolist() == [max((j for j in range(i) if x[j] < x[i]), default=-1) for i in range(len(x))]


def test_longest_previous_factors():
    r = random.Random(2)
    for length in (16, 23, 50, 79):
        for _ in range(12):
            data = bytes(r.choice(b"ab") for _ in range(300)) + b"\0" * 8
            starts = np.array(sorted(r.sample(range(300 - length), 60)))
            doc = np.array([r.randint(0, 5) for _ in starts])
            got = suffix_dedup.longest_previous_factors(suffix_dedup._windows(np.frombuffer(data, np.uint8), starts, length), doc, length)
            for i, s in enumerate(starts):
                shared = [next((k for k in range(length) if data[s + k] != data[t + k]), length) for t, d in zip(starts, doc, strict=True) if d < doc[i]]
                assert got[i] == max(shared, default=0)


def test_counts_beyond_four_bytes():
    for x in ([], [0, 7], [2**32 - 1], [2**32, 5, 2**45]):
        assert chunks.unpack_counts(chunks.pack_counts(np.array(x, np.int64))).tolist() == x
    assert chunks.all_counts(None).tolist() == []


def test_anchors_are_spread_over_buckets():
    """Anchors are the least hashes of their windows, so as they are most would go to the first buckets."""
    text = np.random.default_rng(3).integers(97, 123, 1 << 18).astype(np.uint8).tobytes()
    row = {"chunk": 0, "n_docs": 1, "n_bytes": len(text), "ids": np.array([1]).tobytes(), "ends": np.array([len(text)]).tobytes(), "blob": chunks.pack(text)}
    anchors = suffix_dedup.Runs(chunks.Chunk(row), 50).anchors
    sizes = np.diff(chunks.cuts(anchors, 256))
    assert len(anchors) > 10_000
    assert sizes.max() < 2 * sizes.mean()
