"""Tokens of texts with long runs are those of the vocabulary's own encoding of the whole text."""

import random

import pytest

from lociframe.llm.tokens import Encoder, count

CHANCE = random.Random(7)
WHITE = " \t\n \x85"


def run_of(signs, n):
    return "".join(CHANCE.choice(signs) for _ in range(n))


TEXTS = [
    run_of("abcXYZ019+/", 60_000),
    "word " + "a" * 60_000 + " end",
    "".join(chr(0x4E00 + CHANCE.randrange(3000)) for _ in range(30_000)),
    "one" + " " * 300 + "two" + "\n" * 200 + "'ll see" + run_of(WHITE, 900),
    run_of(WHITE, 400) + "x",
    "x" + "\x1c" * 400 + " y" + "\x1f" * 300 + " " * 120 + "\x1c",
    *[run_of("ab 1'\n\t.", 4000).replace("a", " " * CHANCE.randrange(40, 90)) for _ in range(20)],
    "a" + " " * 49 + "b" + " " * 50 + "c" + " " * 51 + "d",
]


@pytest.mark.parametrize("text", TEXTS, ids=range(len(TEXTS)))
def test_runs_change_no_token(text):
    short, usual = Encoder(run=50), Encoder()
    plain = usual.encoding.encode_ordinary(text)
    assert short(text).tolist() == plain
    assert usual(text).tolist() == plain


def test_white_space_beyond_the_pattern_engine():
    encode = Encoder()
    text = "head" + " " * 2_500_000 + "tail\nnext"
    tokens = encode(text)
    assert encode.encoding.decode_bytes(tokens.tolist()) == text.encode()
    sections = count(text, encode, "most")
    assert sum(s["n_tokens"] for s in sections) == len(tokens) and len(sections) == 2
