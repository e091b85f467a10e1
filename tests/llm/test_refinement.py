"""Substrings: buckets refined where they are, and those too large for it, against brute force."""

import random
from collections import Counter

import pytest

from lexloom.llm.common import Scratch
from lexloom.llm.suffixes import dedup_substrings


def expected(texts: list[str | None]) -> list[tuple[int, int, bytes]]:
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + 200] for t in raw for i in range(len(t) - 199))
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        out.append((sum(gone), sum(g > (i and gone[i - 1]) for i, g in enumerate(gone)), bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


@pytest.fixture(scope="module")
def texts() -> list[str | None]:
    rng = random.Random(5)
    word = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    core, ends = word(230), [word(60) for _ in range(6)]
    # One passage cut to 130 to 230 bytes, between ends that some share: a bucket of many kinds.
    some = [rng.choice(ends) + core[rng.randrange(50) : 180 + rng.randrange(50)] + rng.choice(ends) + word(rng.randrange(80)) for _ in range(120)]
    some += [word(300) + core + word(3), "é" * 150 + core[:199], core[:200], "ab" * 300, "x" * 201, "x" * 199, "y" * 200, word(150)]
    return [*some, some[0], some[0], None, "", None]


@pytest.mark.parametrize("whole", [None, 2, 30])
def test_levels_agree_with_brute_force(spark, monkeypatch, texts, whole):
    labels = []
    keep = Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, label: (labels.append(label), keep(self, df, label))[1])
    ids = [None if i > len(texts) - 7 else i for i in range(len(texts))]  # copies without a number, too
    df = spark.createDataFrame(list(zip(ids, texts, range(len(texts)), strict=True)), "doc_id long, text string, i int").repartition(3)
    out = dedup_substrings(df, **({} if whole is None else {"whole": whole}))
    got = {r.i: (r.n_removed, r.n_spans, bytes(r.kept_bytes)) for r in out.collect()}
    assert got == dict(enumerate(expected(texts)))
    # Levels move rows only for buckets that one task can't take.
    assert any(x.startswith("rows") for x in labels) == (whole is not None)
