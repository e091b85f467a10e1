"""Ids against the tokenizers library: every code point in several places, and random strings of awkward pieces."""

import random

import numpy as np
import pytest

from lexloom.llm import queries
from lexloom.llm.bpe import LATE, ODD_SPACE, Encoder, load_model


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    return Encoder(load_model(path)), Tokenizer.from_file(path)


def same(both, texts: list[str]) -> list[str]:
    """Texts whose ids or decoded texts differ."""
    enc, tok = both
    got = enc.encode(texts)
    want = tok.encode_batch(texts, add_special_tokens=False)
    bad = [t for t, g, w in zip(texts, got, want, strict=True) if np.frombuffer(g, "<u4").tolist() != w.ids]
    some = range(0, len(texts), 50)
    back = tok.decode_batch([want[i].ids for i in some], skip_special_tokens=False)
    return bad + [texts[i] for i, b in zip(some, back, strict=True) if enc.decode(got[i]) != b]


def test_reported_cases(both):
    assert not same(both, ["a\n  b\tc", "'s՘'ll a", "֋", "a ࢏1", "x\x1cy z", "<|endoftext|>", " <|endoftext|> a\n<|endoftext|>", ""])


def test_every_code_point(both):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 100_000):
        block = points[i : i + 100_000]
        assert not same(both, ["".join(block[k : k + 40]) for k in range(0, len(block), 40)])
        near = [c for c in block if not 0x34000 <= ord(c) < 0xE0000 and ord(c) < 0xE0200]  # beyond, nothing is assigned but private planes
        assert not same(both, [" ".join(f"a{c}'s 1{c}2 !{c} {c}a\n{c}" for c in near[k : k + 20]) for k in range(0, len(near), 20)])


def test_late_letters_one_by_one(both):
    points = [chr(c) for a, b in LATE for c in range(a, min(b, a + 400) + 1)]
    assert not same(both, [f"'s{c}'ll a {c}{c} 5{c}x\n {c}" for c in points])


def test_random_strings(both):
    rng = random.Random(11)
    pieces = ["a", "b'll", "'s", "12", "!", "é", "中文", " ", " ", "\n", "  ", "\t", "\r", "\x1c", "\x1f", "\0", "  ", "​", "\U0001f600", "<|endoftext|>", "՘", "½", *ODD_SPACE]
    for _ in range(10):
        assert not same(both, ["".join(rng.choices(pieces, k=rng.randrange(1, 14))) for _ in range(10_000)])


def test_words_are_encoded_once(both, monkeypatch):
    """Words seen before are not encoded again, in any slice, also where there are more than 250,000; nor do results depend on the table."""
    enc = Encoder(load_model(queries.tokenizer_path()))
    asked = []
    batch = enc._batch
    monkeypatch.setattr(enc, "_batch", lambda words, width: (asked.extend(words), batch(words, width))[1])
    words = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(300_000)]
    texts = [" ".join(words[i : i + 1_000]) for i in range(0, len(words), 1_000)]
    enc.encode(texts[:150])
    enc.encode(texts[150:])
    n = len(asked)
    assert n > 250_000
    first = enc.encode(texts)
    assert len(asked) == n
    small = Encoder(load_model(queries.tokenizer_path()), remember=3)
    mixed = [*texts[:3], "a\n  b\tc", "<|endoftext|> a", "'s x\nit's y", "a\nb", "", "\n", "a'll\n", "é ü's"] * 2
    assert [small.encode([t])[0] for t in mixed] == small.encode(mixed) and not same((small, both[1]), mixed)
    assert first[:3] == small.encode(mixed)[:3]
