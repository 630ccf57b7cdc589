"""Ids are the library's also where a text holds the file's special token."""

import zlib

import numpy as np
import pytest

from consentry.llm import id_files, packing, tokens

TEXTS = ["see <|endoftext|> here", "<|endoftext|>", "a<|endoftext|>b c", "two words <|endoftext|><|endoftext|>", "no <|endoftext|ing> here", "<| endoftext|>", "plain words"]


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.tokenizer_path())
    return [tok.encode(t, add_special_tokens=False).ids for t in TEXTS]


def test_ids_of_texts(ids):
    cache = tokens.cache(tokens.tokenizer_path())
    assert 50256 in ids[0]
    assert [cache.ids(t).tolist() for t in TEXTS] == ids


def test_operators(spark, ids):
    path = tokens.tokenizer_path()
    d = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    packed = {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in packing.pack(d, path).collect()}
    assert packed == {i: (len(x) + 1, zlib.crc32(np.array([*x, 0], "<u4").tobytes())) for i, x in enumerate(ids)}
    coded = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in id_files.write_and_read(d, path).collect()}
    assert coded == {i: (len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes())) for i, x in enumerate(ids)}
