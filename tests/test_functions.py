"""Expected values of single functions and operators on small fixtures."""

import gzip

import pytest
from pyspark.sql import functions as F

from shopweave.functions import columns as C, urls as U
from shopweave.operators import baskets as B, dedup, discovery as D, extract, feeds, merge, search
from shopweave.sources import io


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://owalalife.com/undefined-undefined/products/freesip?Color=Red&Size=24oz", "https://owalalife.com/products/freesip"),
        ("https://owalalife.com/en-ca/products/replacement-lids?Size=24oz", "https://owalalife.com/products/replacement-lids"),
        ("https://example.com/search?q=bottle&utm_source=ads", "https://example.com/search?q=bottle"),
        ("HTTPS://Example.com:443//a//?b=2&a=1#top", "https://example.com/a?a=1&b=2"),
        ("ftp://example.com/x", None),
    ],
)
def test_normalize_url(spark, url, want):
    assert one(spark, U.normalize_url(F.lit(url))) == want


def test_store_slug(spark):
    assert one(spark, U.store_slug(F.lit("https://www.Example-Store.com"))) == "example-store-com"
    assert one(spark, U.store_slug(F.lit("https://acme-demo.myshopify.com"))) == "acme-demo"


def test_money_and_availability(spark):
    assert one(spark, C.to_cents(F.lit("$19.99"))) == 1999
    assert one(spark, C.num_to_cents(F.lit(12))) == 1200
    assert one(spark, C.to_cents(F.lit("1,299.00"))) == 100  # the leading number alone
    assert one(spark, C.to_cents(F.lit("1,299.00"), thousands=True)) == 129900
    assert one(spark, C.to_cents(F.lit("free"))) is None
    words = ["https://schema.org/InStock", "https://schema.org/OutOfStock", "1", "0", "perhaps"]
    assert [one(spark, C.to_available(F.lit(w))) for w in words] == [True, False, True, False, None]


def test_relative_urls(spark):
    assert one(spark, U.resolved(F.lit("../b?x=1"), F.lit("https://e.com/a/c/"))) == "https://e.com/a/b?x=1"
    assert one(spark, U.resolved(F.lit(" "), F.lit("https://e.com"))) is None


def test_robots_and_sitemaps(spark):
    robots = spark.createDataFrame([("s", "https://e.com/robots.txt", "User-agent: *\nSitemap: https://e.com/a.xml\nsitemap:https://e.com/b.xml\n")], "store_slug string, url string, body string")
    assert sorted(r.url for r in D.robots_sitemaps(robots).collect()) == ["https://e.com/a.xml", "https://e.com/b.xml"]
    index = b"<sitemapindex><sitemap><loc>https://e.com/1.xml</loc></sitemap><sitemap><loc>https://e.com/2.xml</loc></sitemap></sitemapindex>"
    assert D.sitemap_entries(index) == [("sitemap", "https://e.com/1.xml"), ("sitemap", "https://e.com/2.xml")]
    assert D.sitemap_entries(gzip.compress(index)) == D.sitemap_entries(index)
    image = b'<urlset xmlns:image="i"><url><image:image><image:loc>https://e.com/p.png</image:loc></image:image><loc>https://e.com/p</loc></url></urlset>'
    assert D.sitemap_entries(image) == [("url", "https://e.com/p")]
    assert D.sitemap_entries(b"<broken\nhttps://e.com/x\n ftp://y") == [("url", "https://e.com/x")]
    assert D.sitemap_entries(None) == []


def test_sitemap_walk_stops_at_its_depth(spark):
    links = spark.createDataFrame([("s", f"u{i}", f"u{i + 1}", "sitemap") for i in range(9)] + [("s", "u0", "u0", "sitemap")], "store_slug string, url string, loc string, kind string")
    seeds = spark.createDataFrame([("s", "u0")], "store_slug string, url string")
    assert sorted(r.url for r in D.expand_sitemaps(seeds, links).collect()) == [f"u{i}" for i in range(6)]


def raw(spark, **fields):
    base = {"store_slug": "s", "store_url": "https://e.com", "id": "1", "url": "https://e.com/products/x", "title": "T", "handle": None, "description": None, "brand": None, "vendor": None, "product_type": None, "image_url": None, "tags": [], "price": None, "currency": None, "availability": None, "variants": [], "options": [], "source": "html", "etag": None, "last_modified": None}
    from shopweave.sources.schemas import RAW

    return spark.createDataFrame([base | fields], RAW)


def variant(price, available, compare=None):
    return {"id": "v", "price": price, "available": available, "compare_at_price": compare}


def test_normalize_product(spark):
    p = feeds.normalize_products(raw(spark, price="10.50")).first()
    assert (p.price_min, p.price_max, p.available, p.handle, p.description) == (1050, 1050, True, "x", None)
    p = feeds.normalize_products(raw(spark, variants=[variant("12.50", "false", "15.00"), variant("13.50", "true")])).first()
    assert (p.price_min, p.price_max, p.available, p.variants[0].compare_at_cents) == (1250, 1350, True, 1500)
    assert feeds.normalize_products(raw(spark, title=" ")).count() == 0


def test_feed_text_with_unions(spark):
    body = '{"products":[{"id":7,"handle":"a","title":"A","tags":["x","y"],"variants":[{"id":1,"price":12.5,"inventory_quantity":3,"option1":"Red","presentment_prices":{"presentment_prices":[{"price":{"currency_code":"EUR"}}]}}]}]}'
    feed = spark.createDataFrame([("s", "https://e.com", body), ("s", "https://e.com", "no json")], "store_slug string, store_url string, body string")
    p = feeds.normalize_products(feeds.map_feed(io.explode_feed(feed))).collect()
    assert [(x.product_id, x.url, x.tags, x.price_min, x.currency, x.available) for x in p] == [("7", "https://e.com/products/a", ["x", "y"], 1250, "EUR", True)]
    assert p[0].variants[0].options == {"Option 1": "Red"}


def test_jsonld_shapes():
    html = """<script type="application/ld+json">[{"@type":["Thing","Product"],"name":"A","sku":"1","offers":{"@type":"AggregateOffer","offers":[{"price":1},{"price":"2"}]}},
    {"@type":"Product","name":"A2","sku":"1"}]</script><script type="application/ld+json">{oops</script>
    <script type="application/ld+json">{"@type":"ItemList","itemListElement":[{"item":{"@type":"Product","name":"B"}}]}</script>"""
    found = extract.page_products(html, False)
    assert [(p["title"], len(p["variants"])) for p in found] == [("A2", 0), ("B", 0)]
    assert [p["title"] for p in extract.page_products("<h1>Big <b>Cup</b></h1>", True)] == ["Big Cup"]
    assert extract.page_products("<h1>Cup</h1>", False) == []
    assert extract.page_products("<h1>Page Not Found</h1>", True) == []


def test_dedup_keeps_one_per_key_and_upsert_twice_is_once(spark, sf_dir):
    from shopweave.queries.catalog_queries import raw_records, two_versions

    kept = dedup.dedup(raw_records(spark, sf_dir))
    assert kept.groupBy("store_slug", F.lower("handle")).count().where("count > 1").count() == 0
    old, new = two_versions(spark, sf_dir)
    once = merge.upsert_products(old, new)
    assert sorted(once.collect()) == sorted(merge.upsert_products(once, new).select(*once.columns).collect())


def test_embedding_failures_give_nulls(spark):
    rows = spark.createDataFrame([("s", f"h{i}", "bad" if i == 3 else "a b") for i in range(6)], "store_slug string, handle string, search_text string")

    def embed(texts):
        if "bad" in texts:
            raise RuntimeError("down")
        return [[1.0]] * len(texts)

    found = merge.embed_changed(rows.coalesce(1), embed, batch=2).collect()
    assert sorted(r.handle for r in found if r.embedding is None) == ["h2", "h3"]


def plain_density(places):
    """Sum over the minimal covers of (pos, term) places, as told in words: each start counts with its first end."""
    n, last, covers = len({t for _, t in places}), {}, []
    for p, t in sorted(places):
        last[t] = p
        if len(last) == n and (not covers or min(last.values()) > covers[-1][0]):
            covers.append((min(last.values()), p))
    return sum(1.0 / (1 + max(0, e - s + 1 - n)) for s, e in covers)


def test_cover_density(spark):
    import random

    rng = random.Random(7)
    products = {"a": [(0, 1), (1, 2), (5, 1)], "b": [(4, 1)], "c": [(p, 1) for p in range(700)]}
    for k in range(20):
        products[f"r{k}"] = [(p, rng.randint(1, 1 + k % 4)) for p in range(0, 900) if rng.random() < 0.5]
    rows = spark.createDataFrame([("q", "s", name, p, t) for name, places in products.items() for p, t in places], "query_id string, store_slug string, product_id string, pos int, t int")
    rows = rows.repartition("query_id", "store_slug", "product_id")
    found = search.cover_densities(search.Hits(rows, 4), rows.select("query_id", "store_slug", "product_id").distinct())
    assert {r["product_id"]: r["score"] for r in found.collect()} == pytest.approx({name: plain_density(places) for name, places in products.items()}, rel=1e-12)
    assert plain_density(products["a"]) == 1 + 1 / 4 and plain_density(products["c"]) == 700


def test_fusion_ignores_the_order_of_rankings(spark):
    kind = "query_id int, store_slug string, product_id string, rank int"
    a = spark.createDataFrame([(1, "s", "x", 1), (1, "s", "y", 2)], kind)
    b = spark.createDataFrame([(1, "s", "y", 1), (1, "s", "z", 2)], kind)
    assert sorted(search.rrf_fuse(a, b).collect()) == sorted(search.rrf_fuse(b, a).collect())


def test_payload_cap(spark):
    rows = spark.createDataFrame([(1, i, "x" * 100) for i in range(1, 11)], "query_id int, rank int, t string")
    kept = search.cap_payload(rows, 500).collect()
    assert 0 < len(kept) < 10 and all(r.truncated for r in kept)
    assert sum(len(f'{{"rank":{r.rank},"t":"{r.t}"}},') for r in kept) - 1 <= 500


def test_sequential_fold(spark):
    """The fold by windows equals a plain loop over random logs."""
    import random

    rng, rows = random.Random(1), []
    for b in range(40):
        for seq in range(rng.randint(1, 25)):
            op = rng.choice(["add", "add", "set", "remove", "clear", "checkout"])
            rows.append((str(b), seq, op, str(rng.randint(0, 2)), rng.randint(-1, 4), 100 + seq, rng.random() < 0.3))
    events = spark.createDataFrame(rows, "basket_id string, seq long, op string, variant_id string, quantity long, unit_price long, mark boolean")
    want = {}
    for b in {r[0] for r in rows}:
        lines, closed = {}, False
        for _, seq, op, v, q, price, mark in sorted(r for r in rows if r[0] == b):
            if closed:
                continue
            if op == "add" and q > 0:
                lines[v] = (lines.get(v, (0, 0))[0] + min(99, q), price)
            elif op == "set" and v in lines:
                lines[v] = (min(99, q), lines[v][1])
                if q <= 0:
                    del lines[v]
            elif op == "remove":
                lines.pop(v, None)
            elif op == "clear":
                lines.clear()
            elif op == "checkout" and mark and lines:
                closed = True
        want |= {(b, v): (*x, "checked_out" if closed else "active") for v, x in lines.items()}
    found = {(r.basket_id, r.variant_id): (r.quantity, r.unit_price, r.status) for r in B.fold_baskets(events).collect()}
    assert found == want


def test_one_store_with_most_rows(spark):
    """A hot store and a hot handle: one best record per key all the same."""
    rows = spark.range(3000).select(
        F.when(F.col("id") < 2700, "big").otherwise("small").alias("store_slug"), F.lit("").alias("product_id"), F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).otherwise("product").alias("handle"),
        F.lit("https://e.com/x").alias("url"), F.col("id").alias("seq"), F.lit(1).alias("price_min"), F.lit(None).cast("int").alias("price_max"), F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("string").alias("image_url"), F.array().cast("array<int>").alias("variants"), F.lit("html").alias("source"),
    )
    kept = dedup.dedup(rows).collect()
    assert len(kept) == 1000 + 2
    assert {r.seq for r in kept if r.handle == "product"} == {2699, 2999}


def test_refresh_by_stream(spark, tmp_path):
    import json

    from shopweave.streaming.refresh import stream_refresh

    body = lambda price: json.dumps({"products": [{"id": 1, "handle": "a", "title": "A", "variants": [{"id": 1, "price": price}]}]})
    for i, price in enumerate(["1.00", "2.00"]):
        spark.createDataFrame([("s", "https://e.com", body(price))], "store_slug string, store_url string, body string").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("store_slug string, store_url string, body string").parquet(str(tmp_path / "in"))
        stream_refresh(spark, stream, str(tmp_path / "catalog"), str(tmp_path / "state")).awaitTermination()
        assert [r.price_min for r in spark.read.parquet(str(tmp_path / f"catalog/v{i}")).collect()] == [int(float(price) * 100)]


def test_refresh_writes_only_the_stores_of_a_batch(spark, tmp_path, monkeypatch):
    import json

    from shopweave.streaming import refresh

    monkeypatch.setattr(refresh, "FULL", 3)
    at = str(tmp_path / "catalog")

    def batch(version, *landed):
        rows = [(s, f"https://{s}.com", json.dumps({"products": [{"id": i, "handle": f"h{i}", "title": "A", "variants": [{"id": i, "price": price}]}]})) for s, i, price in landed]
        refresh.refresh_batch(spark, spark.createDataFrame(rows, "store_slug string, store_url string, body string"), at, version)
        return {(r.store_slug, r.handle): r.price_min for r in refresh.current(spark, at, version).collect()}

    assert batch(0, ("s", 1, "1.00"), ("t", 1, "2.00")) == {("s", "h1"): 100, ("t", "h1"): 200}
    want = {("s", "h1"): 150, ("s", "h2"): 300, ("t", "h1"): 200}
    assert batch(1, ("s", 1, "1.50"), ("s", 2, "3.00")) == want
    assert batch(1, ("s", 1, "1.50"), ("s", 2, "3.00")) == want  # run again
    assert {r.store_slug for r in spark.read.parquet(f"{at}/v1").collect()} == {"s"}
    assert batch(2) == want
    assert batch(3, ("t", 1, "2.50")) == want | {("t", "h1"): 250}
    assert {r.store_slug for r in spark.read.parquet(f"{at}/v3").collect()} == {"s", "t"}


def test_substrings_are_found_by_their_rarest_grams(spark):
    bodies = [("a", "red wool hat"), ("a", "hatter"), ("b", "red\u0001what"), ("b", "x"), ("c", ""), ("c", None), ("b", "aaaa")]
    asked = [(1, "hat"), (2, "d w"), (3, "x"), (4, "re"), (5, "zzz"), (6, "hatters"), (7, "aaa"), (8, ""), (9, "red wool hat")]
    found = search.substring_hits(spark.createDataFrame(bodies, "store_slug string, body string"), spark.createDataFrame(asked, "query_id int, hint string"))
    want = {}
    for q, hint in asked:
        for store, body in bodies:
            if hint and hint in (body or ""):
                want[q, store] = want.get((q, store), 0) + 1
    assert {(r["query_id"], r["store_slug"]): r["n"] for r in found.collect()} == want
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_each_text_is_embedded_once(spark, tmp_path):
    rows = spark.createDataFrame([("s", f"h{i}", f"text {i % 4}", i) for i in range(40)] + [("s", "none", None, 1), ("t", "none", "", 2)], "store_slug string, handle string, search_text string, n long")
    log = str(tmp_path)

    def embed(texts):
        import uuid

        with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(texts))
        return [[float(len(t))] for t in texts]

    def asked():
        return sorted(line for f in tmp_path.iterdir() for line in f.read_text().split("\n"))

    found, new = merge.embed_texts(rows, None, embed)
    assert {(r["handle"], r["n"]): r["embedding"] for r in found.collect()} == {("none", 1): [0.0], ("none", 2): [0.0]} | {(f"h{i}", i): [6.0] for i in range(40)}
    assert asked() == sorted(["", *(f"text {i}" for i in range(4))])
    more = rows.unionByName(spark.createDataFrame([("s", "h9", "another text", 9)], rows.schema))
    again, fresh = merge.embed_texts(more, new, embed)
    assert again.where("embedding is null").count() == 0 and fresh.count() == 1
    assert asked() == sorted(["", "another text", *(f"text {i}" for i in range(4))])


def test_filters_read_semistructured_products_by_path(spark):
    import json

    from shopweave.operators import catalog
    from shopweave.sources import semistructured as semi

    items = [
        {"store_slug": "s", "product_id": "1", "handle": "a", "variants": [{"options": {"Size ": " M", "Color": "Red"}, "available": True}], "extra": {"deep": [1, {"x": "y"}]}},
        {"store_slug": "s", "product_id": "2", "handle": "b", "variants": [{"options": {"size": "m"}, "available": True}, {"options": {"color": "red"}, "available": True}], "price_min": 5},
        {"store_slug": "s", "product_id": "3", "handle": "c", "variants": "none", "price_min": "dear", "tags": ["x", "y"]},
        {"store_slug": "s", "product_id": "4", "handle": "d", "variants": [{"options": {"size": 7, "color": "red"}}], "tags": None},
    ]
    lines = spark.createDataFrame([(json.dumps(x),) for x in items] + [("{broken",)], "value string")
    rows = semi.filterable(semi.from_json_lines(lines))
    ids = lambda **kw: sorted(r["product_id"] for r in catalog.filter_products(rows.where("store_slug is not null"), **kw).collect())
    assert ids(options={"size": "M", "color": "red"}, available_only=True) == ["1"]
    assert ids(options={"size": "7"}) == ["4"] and ids(tags=["y"]) == ["3"] and ids(price_min=5) == ["2"]
    assert rows.where(semi.field(rows.data, "$.extra.deep[1].x") == "y").count() == 1 and rows.where("data is null").count() == 1
    back = semi.filterable(semi.to_data(spark.createDataFrame([("s", "9", "h", 4, None)], "store_slug string, product_id string, handle string, price_min long, price_max long"), ("store_slug", "product_id", "handle")))
    assert tuple(back.select("price_min", "price_max").first()) == (4, None)
