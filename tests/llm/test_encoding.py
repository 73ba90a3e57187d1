"""The encoder of pieces against the tokenizer on whole texts, and how much reaches the tokenizer."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from evidra.llm import common

WORD, BYTE = (public_tokenizers.path(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k"))


def encoded(enc, texts):
    out = []
    for _, _, ids, off in enc.encode_column(pa.array(texts, pa.string()), 7):
        out += [ids[a:z].tolist() for a, z in zip(off[:-1], off[1:], strict=True)]
    return out


def whole(path, texts):
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return [tok.encode(t or "", add_special_tokens=False).ids + [7] for t in texts]


def odd_texts(n, seed=5):
    rng = random.Random(seed)
    signs = ["a", "Z", "7", "é", "ß", "日", "🙂", "é", "́", "'s", "'", "-", ".", "!!", "(", "\x00", "\x1c", "\x7f", "×", "—", " ", " ", "<|endoftext|>"]
    gaps = ["", "", "", " ", " ", " ", " ", "\n", "  ", "\t", " \n", "\r\n"]
    return [None, "", " ", "\n", "x" * 400 + " " + "y " * 300] + ["".join(rng.choice(signs) * rng.choice([1, 1, 3]) + rng.choice(gaps) for _ in range(rng.choice([1, 3, 30, 200]))) for _ in range(n)]


def test_new_words_reach_the_tokenizer_together():
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("aeioustrnlé") for _ in range(9)) for _ in range(100)) for _ in range(40)]
    enc, sent = common.PieceEncoder(BYTE, True), []
    plain = enc._encode
    enc._encode = lambda t: (sent.append(len(t)), plain(t))[1]
    assert encoded(enc, texts) == whole(BYTE, texts)
    assert sum(sent) < 400  # 4,000 words, of which 40 open a text


@pytest.mark.parametrize(("path", "keeps_space"), [(WORD, False), (BYTE, True)])
@pytest.mark.parametrize("keep", [20, 300_000])
def test_odd_texts(path, keeps_space, keep):
    enc = common.PieceEncoder(path, keeps_space, keep=keep)
    texts = odd_texts(400)
    want = whole(path, texts)
    assert [got for i in range(0, len(texts), 50) for got in encoded(enc, texts[i : i + 50])] == want
    assert encoded(enc, texts[::-1]) == want[::-1]


def test_words_whose_ids_do_not_tell_their_bytes():
    enc, texts = common.PieceEncoder(BYTE, True), odd_texts(100, 6) + ["one two  three, four"]
    enc.width = np.full_like(enc.width, 5)
    assert encoded(enc, texts) == whole(BYTE, texts)
