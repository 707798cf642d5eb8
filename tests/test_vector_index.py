"""The index of vectors against the exact search."""

import numpy as np
import pytest

from shopweave.operators import search, vector_index as VI

KIND = "query_id long, store_slug string, product_id string, embedding array<float>"


@pytest.fixture(scope="module")
def items(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(12, 16))
    rows = [(i, f"s{i % 3 % 2}", f"p{i:05d}", [float(x) for x in centers[i % 12] + 0.4 * rng.normal(size=16)]) for i in range(3000)]
    rows += [(9000, "s0", "none", None), (9001, "s0", "zero", [0.0] * 16), (9002, "lonely", "one", [1.0] * 16)]
    return spark.createDataFrame(rows, KIND)


@pytest.fixture(scope="module")
def path(items, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    VI.build(items.drop("query_id"), path)
    return path


def pairs(rows):
    return {(r["query_id"], r["product_id"]): (r["rank"], round(r["distance"], 6)) for r in rows.collect()}


def test_all_lists_give_the_exact_result(spark, items, path):
    asked = items.where("query_id % 100 = 0 or query_id > 8999")
    assert pairs(VI.search(spark, path, asked, 10, n_probe=VI.MOST_LISTS)) == pairs(search.vector_topk(items, asked, 10))


def test_few_lists_find_nine_of_ten(spark, items, path):
    asked = items.where("query_id % 100 = 0")
    exact, found = (set(pairs(x)) for x in (search.vector_topk(items, asked, 10), VI.search(spark, path, asked, 10, n_probe=4)))
    assert len(exact & found) >= 0.9 * len(exact)


def test_clusters_need_few_lists(spark, items, path):
    assert 1 <= spark.read.parquet(f"{path}/probes").first()["n"] <= VI.lists_for(items.count()) // 3


def test_recall_on_the_table(spark, sf_dir):
    from shopweave.queries import search_queries as Q

    v = Q.vectors(spark, sf_dir)
    asked = v.where("query_id % 100 = 0")
    exact = set(pairs(search.vector_topk(v, asked, 20)))
    found = {(r["query_id"], r["product_id"]) for r in Q.s4_vector_index(spark, sf_dir).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_slices_and_unread_cells(spark, items, path, monkeypatch, tmp_path):
    monkeypatch.setattr(VI, "SLICE_ROWS", 50)
    VI.build(items.drop("query_id"), str(tmp_path), lists=3)
    assert spark.read.parquet(f"{tmp_path}/lists").agg({"slices": "max"}).first()[0] > 5
    asked = items.where("query_id % 500 = 0")
    assert pairs(VI.search(spark, str(tmp_path), asked, 7, n_probe=3)) == pairs(search.vector_topk(items, asked, 7))
    plan = VI.search(spark, path, items.where("query_id = 9002"), 3, n_probe=1)._jdf.queryExecution().optimizedPlan().toString()
    cells = {r["cell"] for r in VI.probes(spark, path, items.where("query_id = 9002"), 1).collect()}
    assert len(cells) == 1 and f"(cell#" in plan and f"= {cells.pop()})" in plan
