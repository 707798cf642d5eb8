"""Variants of words against all pairs, and the words themselves against a plain count."""

import random
import re
import zlib
from collections import Counter

import pytest

from shopweave.llm import spelling


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words, leads=5):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= leads * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return sorted(out, key=str)


def plain_words(docs, typo_every=0):
    total = Counter()
    for name, text in docs:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if typo_every and h % typo_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def random_words(seed):
    rng, words = random.Random(seed), {}
    for _ in range(60):
        w = "".join(rng.choice("aabé") for _ in range(rng.randint(6, 9)))
        words[w] = rng.choice([5, 5, 6, 25, 30, 125, 700, 4000])
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(w))
            v = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abÿ") + w[k + 1 :], w[:k] + w[k] + w[k:], w + "a", "a" + w])
            words[v] = rng.choice([5, 6, 26, 140])
    return words


CASES = {
    "random 1": random_words(1),
    "random 2": random_words(2),
    "chain": {"abcdefg": 5, "abcdefgh": 25, "abcdefghi": 125, "abcdefghij": 625, "abcdefghijk": 3125, "xbcdefgh": 124},
    "equal letters": {"aaaaaa": 5, "aaaaaaa": 100, "aaaaaaaa": 600, "baaaaaa": 100, "aaabaaa": 100},
    "ties": {"letter": 5, "better": 25, "setter": 25, "wetter": 24},
    "alone": {"nothing": 9},
    "none": {},
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_variants_equal_all_pairs(spark, name):
    words = spark.createDataFrame(list(CASES[name].items()), "word string, n long")
    assert sorted(map(tuple, spelling.variants(words).collect()), key=str) == plain_variants(CASES[name])


DOCS = [
    (None, "letter " * 6), (1, None), (2, ""), (3, "x"), (4, "STRASSE Straße straße STRAßE " * 4), (5, "naïve×words÷ÿÿÿÿÿÿ " * 7), (6, "naïve×words÷ÿÿÿÿÿÿ " * 7), (6, "under_score don'tĀabcdefg " * 5),
    *[(i, "running runing corner letter1letter") for i in range(300)],
]


@pytest.mark.parametrize("typo_every", [0, 3])
def test_counted_words(spark, typo_every):
    docs = spark.createDataFrame([(*d, "en") for d in DOCS], "doc_id long, text string, word string").repartition(3)
    found = spelling.counted(docs, typo_every=typo_every)
    assert {r["word"]: r["n"] for r in found.collect()} == plain_words(DOCS, typo_every)


def test_words_of_a_very_long_text(spark):
    docs = [(7, "lengthy words, " * 100_000 + "ending"), (8, "ending " * 4)]
    assert len(docs[0][1]) > spelling.LISTED
    rows = spelling.counted(spark.createDataFrame(docs, "doc_id long, text string"), typo_every=2)
    assert {r["word"]: r["n"] for r in rows.collect()} == plain_words(docs, 2)
