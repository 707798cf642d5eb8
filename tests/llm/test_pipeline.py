"""The clean-up pipeline on the small tables, stage by stage."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shopweave.llm import decontaminate, line_dedup, quality_fm, simhash_bktree
from shopweave.llm.common import table, written


def test_stages(spark, sf_dir):
    docs = first = table(spark, sf_dir, "documents")
    results = {}
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, sf_dir), "stage")
        if name != "packing":
            assert out.columns == first.columns
        results[name] = (docs, out)
        docs = out
    before, after = results["quality classifier"]
    model = quality_fm.train(before, table(spark, sf_dir, "labels"))
    want = {r.doc_id for r in before.collect() if model.score(r.text or "") >= 0.5}
    assert {r.doc_id for r in after.collect()} == want
    before, after = results["line dedup"]
    assert {r.doc_id: r.text for r in after.collect()} == without_repeats(before.collect())
    before, after = results["simhash near-dedup"]
    codes = {r.doc_id: simhash_bktree.fingerprint(r.text) for r in before.collect()}
    kept = {r.doc_id for r in after.collect()}
    group = {}
    for d in sorted(codes):
        near = [d, *(x for x in codes if (codes[d] ^ codes[x]).bit_count() <= 4)]
        low = min(group.get(x, x) for x in near)
        merged = {group.get(x, x) for x in near}
        group = {x: low if g in merged else g for x, g in group.items()} | dict.fromkeys(near, low)
    assert kept == {min(x for x in group if group[x] == g) for g in set(group.values())}
    before, after = results["benchmark decontamination"]
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    tests = decontaminate.Tests(items, decontaminate.SEED)
    clean = {r.doc_id for r in before.collect() if not any(True for _ in tests.matches(r.text, decontaminate.COVERAGE))}
    assert {r.doc_id for r in after.collect()} == clean
    pieces = results["packing"][1]
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == clean


def without_repeats(rows):
    """The line dedup stage by comparing each two lines; ids are unique and not null here."""
    places = [(r.doc_id, i, x.strip(" ")) for r in rows for i, x in enumerate((r.text or "").split("\n")) if x.strip(" ")]
    sets = {x: line_dedup.shingle_set(x) for _, _, x in places}
    top = {x: x for x in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    by_size = sorted(sets, key=lambda x: len(sets[x]))
    for i, x in enumerate(by_size):
        for y in itertools.takewhile(lambda y, n=len(sets[x]): 0.8 * len(sets[y]) <= n, by_size[i + 1 :]):
            both = len(sets[x] & sets[y])
            if both >= 0.8 * (len(sets[x]) + len(sets[y]) - both):
                top[root(x)] = root(y)
    first = {}
    for d, i, x in sorted(places):
        first.setdefault(root(x), (d, i))
    out = {}
    for r in rows:
        lines = (r.text or "").split("\n")
        kept = [x for i, x in enumerate(lines) if not x.strip(" ") or first[root(x.strip(" "))] == (r.doc_id, i)]
        if len(kept) == len(lines) or "".join(kept).strip():
            out[r.doc_id] = "\n".join(kept)
    return out


CLASHES = ["_text", "_key", "_gone", "_bad", "_n", "row", "key", "root", "h", "l", "id", "fp", "size", "bands", "doc_key", "no_id", "lines", "owner"]


@pytest.fixture(scope="module")
def edge(spark):
    rng = random.Random(31)
    prose = lambda n: " ".join(rng.choice(["plain", "words", "that", "make", "a", "text", "of", "some", "kind"]) + str(rng.randint(0, 30)) for _ in range(n))
    long = "\n".join(prose(60) for _ in range(400))
    rows = [(1, "one line here and more\nanother line of it"), (7, "one line here and more\nanother line of it"), (7, "something unrelated to the others " + prose(30)), (None, "one line here and more\nanother line of it"), (None, None), (2, None), (3, ""), (4, " \n\t"), (5, long), (5, long), (6, prose(50))]
    docs = spark.createDataFrame([(d, t, "en", "web", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_on_edge_cases(spark, sf_dir, edge, name, stage):
    """Nulls, empty and long texts, ties, repeated rows, clashing columns, an empty table."""
    out = stage(spark, edge, sf_dir)
    rows = out.collect()
    assert stage(spark, edge.limit(0), sf_dir).count() == 0
    if name == "packing":
        assert sorted((r.doc_id or 0) for r in rows if r.start == 0) == [0, 0, 1, 2, 3, 4, 5, 5, 6, 7, 7]
        return
    assert out.columns == edge.columns
    assert all(r[c] == f"own {c}" for r in rows for c in CLASHES)
    texts = [(r.doc_id, r.text) for r in rows]
    if name == "line dedup":
        assert sum(1 for _, t in texts if "one line here" in (t or "")) == 1 and sum(1 for _, t in texts if not (t or "").strip()) == 4
        assert len({t for d, t in texts if d == 5}) == 1 and len([d for d, _ in texts if d == 5]) == 2
    if name == "simhash near-dedup":
        assert sorted((d or 0, (t or "")[:3]) for d, t in texts) == [(1, "one"), (2, ""), (5, texts[[d for d, _ in texts].index(5)][1][:3]), (6, texts[[d for d, _ in texts].index(6)][1][:3]), (7, "som")]
    if name == "benchmark decontamination":
        assert len(rows) == edge.count()
