"""Stages that drop rows, on tables whose ids are null or repeated: each row is judged by itself."""

from collections import Counter

import corpus_pipeline
import pytest

from shopweave.llm import decontaminate

SCHEMA = "doc_id long, text string, lang string"
ITEM = " ".join(f"w{i}" for i in range(40))
LEAK = f"before {ITEM} after"


def prose(k, n=40):
    return " ".join(f"v{k}x{i * i % 97}" for i in range(n))


def test_a_leak_takes_no_clean_row_with_it(spark):
    clean = [(None, prose(1), "en"), (7, prose(2), "en"), (7, prose(2), "en"), (None, None, "en"), (8, None, "en")]
    bad = [(None, LEAK, "en"), (7, LEAK, "en"), (7, LEAK, "de"), (9, LEAK, "en")]
    docs = spark.createDataFrame(clean + bad, SCHEMA)
    tests = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    kept = decontaminate.decontaminate(docs, tests)
    assert kept.columns == docs.columns
    assert Counter(map(tuple, kept.collect())) == Counter(clean)


@pytest.mark.parametrize("ids", [(None, None, None), (7, 7, 7), (7, 8, None)])
def test_one_row_of_each_group_stays(spark, sf_dir, ids):
    a, b, c = prose(1), prose(2), prose(3)
    rows = [(ids[0], a, "en"), (ids[1], a, "en"), (ids[2], a, "en"), (ids[0], b, "en"), (ids[0], c, "en"), (ids[1], c, "en")]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = corpus_pipeline.one_of_near_copies(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert Counter(map(tuple, kept.collect())) == Counter([(ids[0], a, "en"), (ids[0], b, "en"), (ids[0], c, "en")])
