import os
import random

import pytest
import regex
import tiktoken

from pageframe.llm.tokenizer import PATTERN, TOKENIZERS, BacktrackingEncoder, encode_corpus

VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")


@pytest.fixture(scope="module")
def encoder():
    return BacktrackingEncoder.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def reference(encoder):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})


def encode(encoder, text):
    return [i for p in regex.findall(PATTERN, text) for i in encoder.encode_piece(p.encode())]


def test_equals_the_merge_procedure(encoder, reference):
    rnd = random.Random(7)
    for _ in range(3000):
        text = "".join(rnd.choice("aabcdefghiilmnoprstu éșț\n\t 中あ🙂0123'.,-") for _ in range(rnd.randint(0, 60)))
        ids = encode(encoder, text)
        assert ids == reference.encode_ordinary(text)
        assert encoder.decode(ids) == text.encode()


def test_long_piece_without_spaces(encoder, reference):
    text = "ab" * 4000 + "xyz" * 1000
    assert encode(encoder, text) == reference.encode_ordinary(text)


def test_table(texts, reference):
    rows = [(1, None), (2, ""), (3, "<|endoftext|> is text"), (3, "<|endoftext|> is text"), (4, "  \n")]
    got = sorted((r["id"], r["ids"]) for r in encode_corpus(texts(rows), "id", "text").collect())
    assert got == sorted((i, reference.encode_ordinary(t or "")) for i, t in rows)
    assert encode_corpus(texts([]), "id", "text").count() == 0
