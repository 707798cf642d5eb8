"""Pages are parsed in parts of bounded size, and nothing is lost between them."""

import json

import pyarrow as pa

from shopweave.operators import extract

KIND = "store_slug string, store_url string, url string, etag string, last_modified string, body string, rank long"


def page(n, offers, pad=0):
    node = {"@type": "Product", "name": f"P{n}", "category": "a, b", "image": f"//cdn/{n}.png", "offers": [{"sku": f"{n}-{i}", "price": i} for i in range(offers)]}
    return f'<script type="application/ld+json">{json.dumps([node, node | {"name": "Q"}])}</script>' + " " * pad


def test_a_part_holds_few_pages_and_characters():
    bodies = [page(n, 30) for n in range(3000)] + [page(7, 1, 2 * extract.PART_CHARS)] + [page(n, 1, extract.PART_CHARS // 3) for n in range(10)]
    whole = pa.RecordBatch.from_pydict({"body": bodies, "page_url": [f"https://s/products/{i}" for i in range(len(bodies))], "product_like": [True] * len(bodies)})
    pieces = list(extract.parts(whole))
    assert all(p.num_rows == 1 or p.num_rows <= extract.PART_PAGES and sum(map(len, p.column("body").to_pylist())) <= extract.PART_CHARS for p in pieces)
    assert [b for p in pieces for b in p.column("body").to_pylist()] == bodies
    made = [extract.products_of(p, ["page_url"]) for p in pieces]
    assert max(m.nbytes for m in made) < 4 * extract.PART_CHARS
    both = pa.Table.from_batches(made)
    assert both.num_rows == 2 * len(bodies)
    assert both.slice(0, 6000)["variants"].to_pylist()[-1][29]["sku"] == "2999-29"
    assert not list(extract.parts(whole.slice(0, 0)))


def test_products_of_odd_pages(spark):
    bodies = [page(1, 2), None, "", "<h1>Cup</h1>", page(2, 0)]
    rows = [("s", "https://s", f"https://s/products/p{i}", "e" if i else None, None, b, i if i % 2 else None) for i, b in enumerate(bodies)]
    found = extract.extract_products(spark.createDataFrame(rows, KIND)).orderBy("page_url", "pos").collect()
    assert [(r.page_url[-1], r.pos, r.title, r["rank"], r.etag, len(r.variants), list(r.tags)) for r in found] == [
        ("0", 0, "P1", None, None, 2, ["a", "b"]), ("0", 1, "Q", None, None, 2, ["a", "b"]), ("3", 0, "Cup", 3, "e", 0, []), ("4", 0, "P2", None, "e", 0, ["a", "b"]), ("4", 1, "Q", None, "e", 0, ["a", "b"]),
    ]
    assert found[0].image_url == "https://cdn/1.png" and found[0].url == "https://s/products/p0" and found[0].handle == "p0"
    assert [(v.id, v.sku, v.price, v.available, v.options) for v in found[0].variants] == [("1-0", "1-0", "0", None, None), ("1-1", "1-1", "1", None, None)]
