"""Lines and texts of one bucket: many slices compared at once, by codes that are exact for plain lines."""

import random

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from shopweave.llm import fingerprints as FP, line_dedup as LD, links

KEY = (5 - links.FIRST_BAND) << links.BAND_SHIFT  # of band 5
ODD = ["abc", "abc\0\0\0\0\0", "a" * 20, "š" * 20, "a" * 10 + "š" * 10, "中文" * 9, "\U0001f600" * 12, "café " * 5, "\0" * 8, "\0" * 9, "x"]


def edited(rng, line, places):
    for _ in range(places):
        i = rng.randrange(len(line))
        line = line[:i] + rng.choice("xyzéš") + line[i + 1 :]
    return line


def slices(rng, near, word):
    """(slice, text, lower bands) of slices of 1 to 40 texts: near copies and others."""
    out = []
    for part in range(60):
        base = word(rng)
        for _ in range(rng.choice([1, 2, 2, 2, 3, 5, 40])):
            out.append((part, near(rng, base) if rng.random() < 0.7 else word(rng), [rng.randrange(9) for _ in range(links.FIRST_BAND // 2)]))
    return out


def roots(ids, pairs):
    top = {i: i for i in ids}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        top[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def rows_of(made):
    press = zstandard.ZstdCompressor()
    return pa.table({
        "key": pa.array([KEY] * len(made), pa.int64()), "slice": pa.array([m[0] for m in made], pa.int32()), "id": pa.array(range(len(made)), pa.int64()),
        "bands": pa.array([m[2] for m in made], pa.list_(pa.int64())), "z": pa.array([press.compress(m[1].encode()) for m in made], pa.binary()),
    })


LINES = (LD.shingle_codes, LD.jaccard, lambda rng, x: edited(rng, x, rng.randint(0, 2)), lambda rng: "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(9, 120))))
TEXTS = (links.one_by_one(FP.distinct_hashes), FP.jaccard, lambda rng, x: x + " more", lambda rng: " ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))))


@pytest.mark.parametrize("kind", [LINES, TEXTS], ids=["lines", "texts"])
@pytest.mark.parametrize("at_once", [1, 500, 1 << 18])
def test_slices_equal_all_pairs(monkeypatch, kind, at_once):
    """All links of a slice but those between texts that share a lower band, whatever goes into one pass and wherever a batch ends."""
    monkeypatch.setattr(links, "CHARS_AT_ONCE", at_once)
    shingles, likeness, near, word = kind
    made = slices(random.Random(at_once), near, word) + [(100, x, [-i] * 8) for i, x in enumerate(ODD)]
    compare = links.Compared(shingles, likeness, 0.8)
    batches = rows_of(made).to_batches(max_chunksize=7)
    runs = list(links._runs(iter(batches)))
    assert sum(r.num_rows for r in runs) == len(made)
    found = [x for r in runs for x in compare.slices(r)]
    want = [
        (i, j) for i, a in enumerate(made) for j, b in enumerate(made[:i])
        if a[0] == b[0] and not any(x == y for x, y in zip(a[2][:5], b[2][:5], strict=True)) and likeness(a[1], b[1]) >= 0.8
    ]
    assert {(max(p), min(p)) for p in found} <= set(want)
    assert roots(range(len(made)), found) == roots(range(len(made)), want)
    assert len(found) == sum(i != r for i, r in roots(range(len(made)), want).items())


def test_codes_equal_sets():
    """Codes of plain lines are equal only for equal shingles, those of others at least for those, in every call."""
    rng = random.Random(3)
    lines = ODD + ["".join(rng.choice("abéš中") for _ in range(rng.randint(1, 30))) for _ in range(40)] + ["".join(rng.choice("abé") for _ in range(rng.randint(1, 30))) for _ in range(40)]
    codes, n, plain = LD.shingle_codes(lines)
    own = [set(x.tolist()) for x in np.split(codes, np.cumsum(n)[:-1])]
    assert own == [set(LD.shingle_codes([x])[0].tolist()) for x in lines]
    assert plain.any() and not plain.all()
    for i, a in enumerate(lines):
        for j, b in enumerate(lines):
            both = len(LD.shingle_set(a) & LD.shingle_set(b))
            assert len(own[i] & own[j]) == both or (len(own[i] & own[j]) > both and not (plain[i] and plain[j]))


def test_plain_lines_are_compared_once(spark, monkeypatch):
    """A plain line is compared by its codes alone, without a second comparison by sets of strings."""
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefghijklm ") for _ in range(150)) for _ in range(20)]
    rows = [(i, x if i < 20 else x[:70] + "#" + x[71:]) for i, x in enumerate(base * 3)]

    def never(a, b):
        raise AssertionError("compared a second time")

    monkeypatch.setattr(LD, "jaccard", never)
    found = LD.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in found} == {i: int(i >= 20) for i, _ in rows}
