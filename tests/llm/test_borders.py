"""Byte-level BPE where special tokens, white space and endings cross the border of two parts of a text."""

import random
from array import array

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from glintmark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
SPECIAL = "<|endoftext|>"
CASES = [
    "\n\n" + SPECIAL, "  " + SPECIAL, " \n" + SPECIAL, "\n\n\n" + SPECIAL + "\n\n" + SPECIAL, SPECIAL * 3, "word" + SPECIAL + "word", "\n\n<|endoftext", "\n\n<|endoftex|>", "\n\n<", "  <|end", "\t\t" + SPECIAL + "  x",
    "　　" + SPECIAL, " 's" + SPECIAL, "don't" + SPECIAL, "12" + SPECIAL + "34", "\n\n<" + SPECIAL, "\n\n<|<|endoftext|>", " " * 60 + SPECIAL, "é😀\r\n\r\n" + SPECIAL, "\x85\x85" + SPECIAL + "\xa0\xa0" + SPECIAL, "it'll  we've", "\n \n  x",
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return lambda text: t.encode(text, add_special_tokens=False).ids


def ids_of(text):
    out = array("I")
    for part in bpe.encode_parts(bpe.vocabulary(PATH), memoryview(text.encode())):
        out.frombytes(part)
    return out.tolist()


@pytest.mark.parametrize("case", CASES)
def test_every_offset_at_the_real_size(library, case):
    """The head of the text is encoded once by the library; it ends in a full stop and a line feed before words, which no case can upset."""
    head = "word and more words. " * (bpe.CHUNK // 21 - 10)
    for back in range(len(case.encode()) + 4):
        text = head + "w" * (bpe.CHUNK - len(head) - back) + case + " tail of it"
        assert ids_of(text) == library(text), back


@pytest.mark.parametrize("chunk, long, wait", [(5, 80, 32), (17, 80, 32), (64, 80, 32), (64, 4096, 32), (33, 40, 32)])
def test_random_texts_in_small_parts(library, monkeypatch, chunk, long, wait):
    monkeypatch.setattr(bpe, "CHUNK", chunk)
    monkeypatch.setattr(bpe, "LONG", long)
    rnd = random.Random(chunk * long)
    bits = ["\n", " ", "\t", "\n\n", "<", "<|", "<|end", SPECIAL, "'s", "'", "a", "word", "12", "é", "😀", "...", "<|endoftext|", "x" * 90, " " * 90, " ", "日本"]
    for _ in range(600):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 30)))
        assert ids_of(text) == library(text), text
