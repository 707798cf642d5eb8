"""The refresh works each expression out once, and derived columns only for the records that are left."""

import re

from pyspark.sql import functions as F

from shopweave.functions import columns as C
from shopweave.functions.urls import normalize_url
from shopweave.operators import dedup, feeds
from shopweave.plans import workloads
from shopweave.queries import discovery_queries as D


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_urls_are_not_read_again_for_each_use(spark):
    plan = optimized(spark.range(1).select(normalize_url(C.product_link(F.concat(F.lit("/a"), F.col("id").cast("string")), F.lit("https://s"))).alias("u")))
    assert plan.count("regexp_extract") < 12


def test_hashes_are_made_after_dedup(spark, sf_dir):
    plan = optimized(D.w1_refresh_catalog(spark, sf_dir))
    hashed, best = [m.start() for m in re.finditer("AS content_hash", plan)], plan.index("max_by(")
    assert len(hashed) == 1 and hashed[0] < best and len(plan) < 250_000


def test_derived_columns_are_those_of_a_full_normalization(spark):
    kind = "struct<id:string,title:string,sku:string,price:string,compare_at_price:string,currency:string,available:string,option1:string,option2:string,option3:string,options:map<string,string>>"
    made = lambda n, price, options: ("s", "https://s.example.com", n, f"/products/{n}", f"T{n}", None, "d", None, None, "Type", None, [" a", "a"], None, "usd", None, [("1", "t", None, price, None, None, "true", "x ", None, None, options)], [], "html", None, None, int(n))
    schema = f"store_slug string, store_url string, id string, url string, title string, handle string, description string, brand string, vendor string, product_type string, image_url string, tags array<string>, price string, currency string, availability string, variants array<{kind}>, options array<struct<name:string,values:array<string>>>, source string, etag string, last_modified string, seq long"
    raw = spark.createDataFrame([made("1", "1,299.00", {"size ": "L", "Size": "M"}), made("2", "0012.30", {}), made("3", None, {"a  b": " c"}), made("4", "12.345", None), made("2", "9.99", None)], schema)
    assert set(raw.columns) == set(workloads.RAW_COLUMNS)
    found = feeds.with_derived(dedup.dedup(feeds.normalize_fields(raw)))
    want = dedup.dedup(feeds.normalize_products(raw))
    key = lambda r: r["product_id"]
    assert sorted((r.asDict(True) for r in found.select(*want.columns).collect()), key=key) == sorted((r.asDict(True) for r in want.collect()), key=key)
    prices = {r.product_id: (r.price_min, [v.options for v in r.variants]) for r in found.collect()}
    assert prices == {"1": (100, [{"Size": "M"}]), "2": (999, [{"Option 1": "x"}]), "3": (None, [{"A B": "c"}]), "4": (1235, [{"Option 1": "x"}])}
