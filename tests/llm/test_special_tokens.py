"""Strings of special tokens get the ids that an untouched tokenizer gives."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from briefloom.llm import tokens
from tests.llm.conftest import prose


@pytest.mark.parametrize(("name", "mark"), [("word_bpe_49k.json", 49407), ("byte_bpe_50k.json", 50256)])
def test_ids_equal_an_untouched_tokenizer(name, mark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    direct = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "x<|endoftext|>y", "<|endoftext|>", "<|startoftext|>a", "<|ENDOFTEXT|> <|endoftext", "|>", "<|endoftext|", "\n<|endoftext|><|endoftext|> \n", "", prose(1, 50), prose(1, 50) + "<|endoftext|>", "é<|endoftext|>　x"]
    for batch in (texts, texts[::-1], texts[4:7]):
        got = [x.tolist() for x in tokens.encoder(path).encode(pa.array(batch))]
        assert got == [direct.encode(x, add_special_tokens=False).ids for x in batch]
    assert mark in next(tokens.encoder(path).encode(pa.array(texts[:1]))).tolist()
    ids = np.frombuffer(next(tokens.encoded(pa.array(texts[:1]), path, 0)), "<u4").tolist()
    assert ids == [*direct.encode(texts[0], add_special_tokens=False).ids, 0]
