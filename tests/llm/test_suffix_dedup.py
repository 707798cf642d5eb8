"""Texts without repeats against a plain search for every string of 100 bytes."""

import random
from hashlib import sha256

import numpy as np
import pytest

from shopweave.llm import suffix_dedup as sd

W = 100


def plain(docs):
    """docs: (doc_id, text) in any order; ids may repeat only with one text."""
    seen, out = set(), []
    for name, text in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        hit = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - W + 1):
            if (own := data[i : i + W]) in seen:
                hit[i : i + W] = True
            seen.add(own)
        runs = int((hit[:-1] & ~np.r_[False, hit[:-1]][:-1]).sum())
        kept = bytes(b for b, h in zip(data, hit, strict=False) if not h)
        out.append((name, len(data), int(hit.sum()), runs, sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [some(30) for _ in range(4)] + ["x" * 99, "y" * 100, "ab" * 80, some(22)[:99]]
    docs = []
    for i in range(60):
        text = some(rng.randint(0, 120))
        for _ in range(rng.randint(0, 4)):
            text += rng.choice(["", " ", "\n"]) + rng.choice(passages)
        if i and rng.random() < 0.4:
            text = list(rng.choice(docs)[1])
            for _ in range(rng.randint(0, 5)):
                if text:
                    text[rng.randrange(len(text))] = rng.choice(["", "é", "zz"])
            text = "".join(text)
        docs.append((rng.choice([-1, 1]) * i * 7, text))
    return docs


CASES = {
    "random": corpus(1),
    "other": corpus(2),
    "one letter": [(3, "a" * 5000), (4, "a" * 99), (2, "a" * 101 + "b" + "a" * 250), (9, "ab" * 700), (1, "a" * 100)],
    "odd": [(None, "null " * 60), (1, None), (2, ""), (5, "null " * 60), (-4, "\0" * 200 + "end"), (6, "\0" * 150), (6, "\0" * 150)],
    "none": [],
}


def expected(docs):
    rows, once = plain(list(dict.fromkeys(docs))), list(dict.fromkeys(docs))
    again = [d for d in once for _ in range(docs.count(d) - 1)]
    return sorted(rows + [(n, len(t.encode()), len(t.encode()), 1, sha256(b"").hexdigest()) for n, t in again], key=str)


@pytest.mark.parametrize("wide", [sd.WIDE, 1])
@pytest.mark.parametrize("name", sorted(CASES))
def test_repeats_equal_a_plain_search(spark, monkeypatch, name, wide):
    monkeypatch.setattr(sd, "WIDE", wide)
    docs = spark.createDataFrame([(*r, 1, "x") for r in CASES[name]], "doc_id long, text string, h long, at string").repartition(4)
    found = sd.without_repeats(docs)
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == expected(CASES[name])


def test_the_cover_meets_every_pair():
    for r in range(sd.PERIOD):
        for q in range(sd.PERIOD):
            assert all((x + sd.STEPS[r, q]) % sd.PERIOD in sd.COVER for x in (r, q))


def test_suffixes_stand_in_order():
    rng = np.random.default_rng(3)
    parts = [bytes(rng.integers(0, 3, 300).astype(np.uint8)), b"\1" * 260, b"\1\2" * 130]
    data = np.frombuffer(b"".join([parts[k] for k in (0, 1, 0, 2, 1, 2, 0)]), np.uint8)
    at = rng.permutation(len(data) - W)
    bucket = at % 2
    order = sd.suffix_order(data, bucket, at)
    keys = [(bucket[i], data[at[i] : at[i] + W].tobytes()) for i in order]
    assert keys == sorted(keys)


def test_pieces_of_a_very_long_text(spark, monkeypatch):
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefgh ") for _ in range(6000))
    docs = [(1, text), (2, "z" + text[500:4000] + "q" + text[:300] + text[3900:])]
    for piece in (256, 1000):
        monkeypatch.setattr(sd, "PIECE", piece)
        monkeypatch.setattr(sd, "BLOCK", piece)
        own = sd.stretches([t.encode() for _, t in docs])
        assert own[4].sum() == sum(len(t) - W + 1 for _, t in docs)
    assert sorted(map(tuple, sd.without_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=str) == plain(docs)
