"""Queries of feeds, normalization, dedup, upserts, filters, lookups, facets and store lists."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import columns as C
from ..operators import catalog as K, dedup as D, feeds, merge as M, tallies as TL
from ..sources import bucketed, io, semistructured as semi
from ..sources.shared import new_path, written
from . import views as V
from .column_queries import SQL_TOKENS, sql_url

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
P, PS = V.SQL_PRODUCTS, V.SQL_STORES


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def joined(c: str, sep: str = "|"):
    return F.array_join(c, sep).alias(c)


# ---- feeds

FEED_SPAN = 500  # part keys on a page of all stores' feeds, some 20 products of each store


def feed_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed texts as a platform would serve them, in pages: (store_slug, store_url, page, body)."""
    p = V.products(spark, sf_dir)
    variant = F.transform(
        "variants",
        lambda v: F.struct(v["id"].alias("id"), v["title"].alias("title"), V.units(v["price_cents"]).alias("price"), v["available"].alias("available"), v["options"]["Size"].alias("option1"), v["options"]["Color"].alias("option2")),
    )
    options = F.array(F.struct(F.lit("Size").alias("name"), F.array(F.lit("XL")).alias("values")), F.struct(F.lit("").alias("name"), F.array().cast("array<string>").alias("values")))
    body = F.struct(
        F.col("p_partkey").alias("id"), "handle", F.concat(F.lit(" "), "title").alias("title"), F.concat(F.lit("<p>All about&nbsp;"), "title", F.lit("</p>")).alias("body_html"), "vendor", "product_type",
        F.array_join("tags", ", ").alias("tags"), options.alias("options"), variant.alias("variants"),
    )
    page = F.floor(F.col("p_partkey") / FEED_SPAN).cast("long").alias("page")
    one = p.groupBy("store_slug", page).agg(F.sort_array(F.collect_list(F.struct("p_partkey", body.alias("b")))).alias("l"))
    text = F.to_json(F.struct(F.transform("l", lambda x: x["b"]).alias("products")))
    return one.select("store_slug", F.concat(F.lit("https://"), "store_slug", F.lit(".example.com")).alias("store_url"), "page", text.alias("body"))


@query(f"""with {P} select store_slug, partkey // {FEED_SPAN} as page, (row_number() over (partition by store_slug, partkey // {FEED_SPAN} order by partkey) - 1)::int as pos, product_id as id, handle, ' ' || title as title, array_to_string(tags, ', ') as tags, n_variants::int as n_variants from products""")
def io1_read_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = io.explode_feed(feed_bodies(spark, sf_dir))
    return rows.select("store_slug", "page", "pos", "product.id", "product.handle", "product.title", "product.tags", F.size("product.variants").alias("n_variants"))


@query("select count(*) as n, count(distinct url) as urls, sum(length(html))::bigint as chars from pages")
def io2_read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages table landed as fetched pages, then read with their schema."""
    path = new_path(spark, "landed-pages")
    pages = V.table(spark, sf_dir, "pages")
    landed = pages.select(F.lit("s").alias("store_slug"), "url", F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), F.lit(None).cast("string").alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.col("html").alias("body"), F.col("page_id").alias("further"))
    landed.write.parquet(path)
    rows = io.read_pages(spark, path)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("url").alias("urls"), F.sum(F.length("body")).alias("chars"))


@query("select o_orderstatus, count(*) as n, round(sum(o_totalprice), 2)::double as total from orders group by 1")
def io4_read_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.read_table(spark, f"{sf_dir}/orders.parquet").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"""with {P} select '{{"handle":"' || handle || '","price_min":' || price_min || case when partkey % 2 = 0 then ',"tags":[]' else ',"tags":["' || array_to_string(tags, '","') || '"]' end || ',"available":' || case when partkey % 3 = 0 then 'false' else available::varchar end || '}}' as payload from products""")
def io5_to_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.products(spark, sf_dir).select(
        "handle", F.col("price_min").cast("double").alias("price_min"), F.when(F.col("p_partkey") % 2 != 0, F.col("tags")).alias("tags"), F.when(F.col("p_partkey") % 3 != 0, F.col("available")).alias("available"), F.lit(None).cast("string").alias("summary_llm")
    )
    return io.to_payload(p, ("tags",), ("price_min",), ("available",))


def raw_of_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.map_feed(io.explode_feed(feed_bodies(spark, sf_dir)))


@query(f"""with {P}, vs as (select partkey, string_agg(v.id || '/' || coalesce(floor(v.price_cents / 100)::bigint || '.' || lpad((v.price_cents % 100)::varchar, 2, '0'), '') || '/Size=' || v.size || ',Option 2=' || color, '|' order by v.id) as vs,
  string_agg(distinct v.size, ',' order by v.size) as sizes, max(color) as color from variants v join (select partkey as pk, color from products) on pk = v.partkey group by partkey)
select store_slug, product_id as id, url, title, 'All about ' || title as description, available::varchar as availability, vs as variants, 'Size=' || array_to_string(list_sort(['XL'] || string_split(sizes, ',')), ',') || '|Option 2=' || vs.color as options from products join vs using (partkey)""")
def x3_map_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    show = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    vs = F.array_join(F.transform("variants", lambda v: F.concat_ws("/", v["id"], v["price"], show(v["options"]))), "|")
    options = F.array_join(F.transform("options", lambda o: F.concat(o["name"], F.lit("="), F.array_join(F.array_sort(o["values"]), ","))), "|")
    return raw_of_feed(spark, sf_dir).select("store_slug", "id", "url", "title", "description", "availability", vs.alias("variants"), options.alias("options"))


@query("""select l_orderkey, l_partkey, l_suppkey, l_linenumber, case when l_linenumber = 1 then l_returnflag = 'A' when l_linenumber = 2 then l_quantity > 25 when l_linenumber = 3 and l_linestatus = 'O' then true end as available,
case when l_linenumber % 2 = 0 then 'EUR' when l_linenumber = 3 then 'usd' end as currency from lineitem""")
def x4_feed_variant_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    v = F.struct(
        F.when(n == 1, F.when(F.col("l_returnflag") == "A", "yes").otherwise("sold out")).alias("available"), F.when(n == 2, (F.col("l_quantity") - 25).cast("string")).alias("inventory_quantity"),
        F.when((n == 3) & (F.col("l_linestatus") == "O"), " Continue ").alias("inventory_policy"), F.when(n == 3, "usd").alias("currency"),
        F.when(n % 2 == 0, '{"presentment_prices":[{"price":{"currency_code":"EUR"}}]}').alias("presentment_prices"),
    )
    rows = V.table(spark, sf_dir, "lineitem").withColumn("v", v)
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", feeds.feed_variant_available(F.col("v")).alias("available"), feeds.feed_variant_currency(F.col("v")).alias("currency"))


@query(f"""with {P} select store_slug, product_id, handle, title, url, price_min, price_max, available, vendor, product_type, array_to_string(tags, '|') as tags, true as is_catalog_product,
title || ' ' || handle || ' All about ' || title || ' ' || vendor || ' ' || vendor || ' ' || product_type || ' ' || array_to_string(tags, ' ') as search_text, n_variants::int as n_variants from products""")
def x5_normalize_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = feeds.normalize_products(raw_of_feed(spark, sf_dir))
    return p.select("store_slug", "product_id", "handle", "title", "url", "price_min", "price_max", "available", "vendor", "product_type", joined("tags"), "is_catalog_product", "search_text", F.size("variants").alias("n_variants"))


# ---- dedup

SQL_RAW = (
    P
    + """, raw as (
  select store_slug, case when partkey % 17 = 0 and copy = 2 then '' else product_id end as product_id, case when partkey % 40 = 0 then replace(title, ' ', '-') else handle end as handle, url, title, price_min, price_max,
    case when (partkey + copy) % 3 <> 0 then 'about ' || title end as description, case when (partkey + copy) % 5 <> 0 then url || '/i.png' end as image_url, case when copy = 1 then 'shopify_json' else 'html' end as source,
    copy * 1000000 + partkey as seq from products, (select unnest([0, 1, 2]) as copy)),
scored as (select *, 2 + (description is not null)::int + (image_url is not null)::int + case when source = 'shopify_json' then 2 else 0 end as score,
  case when product_id <> '' then 'id:' || lower(product_id) else 'handle:' || lower(handle) end as key from raw),
by_id as (select * from (select *, min(seq) over (partition by store_slug, key) as first_seq, row_number() over (partition by store_slug, key order by score desc, seq desc) as rn from scored) where rn = 1),
by_handle as (select * from (select *, row_number() over (partition by store_slug, lower(handle) order by score desc, first_seq desc) as rn2 from by_id) where rn2 = 1)"""
)


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three copies of each product, from pages and feeds, with gaps and shared handles."""
    p = V.products(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    k = F.col("p_partkey")
    return p.select(
        "store_slug", F.when((k % 17 == 0) & (F.col("copy") == 2), "").otherwise(F.col("product_id")).alias("product_id"), F.when(k % 40 == 0, F.translate("title", " ", "-")).otherwise(F.col("handle")).alias("handle"),
        "url", "title", "price_min", "price_max", F.when((k + F.col("copy")) % 3 != 0, F.concat(F.lit("about "), "title")).alias("description"), F.when((k + F.col("copy")) % 5 != 0, F.concat("url", F.lit("/i.png"))).alias("image_url"),
        F.when(F.col("copy") == 1, "shopify_json").otherwise("html").alias("source"), (F.col("copy") * 1000000 + k).alias("seq"), "variants",
    )


@query(f"with {SQL_RAW} select seq, score from scored")
def u1_record_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_records(spark, sf_dir).select("seq", D.record_score().alias("score"))


@query(f"with {SQL_RAW} select store_slug, seq, first_seq, handle, source from by_id")
def u2_dedup_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.dedup_by_id(raw_records(spark, sf_dir)).select("store_slug", "seq", "first_seq", "handle", "source")


@query(f"with {SQL_RAW} select store_slug, seq, handle, source from by_handle")
def u3_dedup_by_handle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.dedup(raw_records(spark, sf_dir)).select("store_slug", "seq", "handle", "source")


SQL_KEYS = (
    SQL_RAW
    + """, keys as (select store_slug, 'map_key' as kind, key as value from scored union all select store_slug, 'handle', lower(handle) from scored
  union all select store_slug, 'product_id', product_id from scored where product_id <> '' union all select store_slug, 'url', lower(url) from scored),
dups as (select store_slug, kind, value, count(*) as n from keys group by all having count(*) > 1)"""
)


@query(f"""with {SQL_KEYS}, d as (select store_slug, count(*) filter (kind = 'map_key') as a, count(*) filter (kind = 'handle') as b, count(*) filter (kind = 'product_id') as c, count(*) filter (kind = 'url') as e from dups group by 1)
select r.store_slug, raw_records, unique_by_id, unique_records, raw_records - unique_records as dropped_records, coalesce(a, 0) as duplicate_map_keys, coalesce(b, 0) as duplicate_handles, coalesce(c, 0) as duplicate_product_ids, coalesce(e, 0) as duplicate_urls
from (select store_slug, count(*) as raw_records from raw group by 1) r join (select store_slug, count(*) as unique_by_id from by_id group by 1) using (store_slug)
join (select store_slug, count(*) as unique_records from by_handle group by 1) using (store_slug) left join d using (store_slug)""")
def u4_dedup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.dedup_report(raw_records(spark, sf_dir))


@query(f"with {SQL_KEYS} select * from (select *, row_number() over (partition by store_slug, kind order by n desc, value)::int as rank from dups) where rank <= 25")
def u5_top_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.top_duplicates(raw_records(spark, sf_dir))


@query(f"""with {SQL_RAW}, g as (select store_slug, lower(handle) as handle, count(distinct product_id) as n_ids, string_agg(distinct product_id, '|' order by product_id) as product_ids from raw where product_id <> '' group by 1, 2 having count(distinct product_id) > 1)
select * from (select *, row_number() over (partition by store_slug order by n_ids desc, handle)::int as rank, count(*) over (partition by store_slug) as n_collisions from g) where rank <= 25""")
def u6_handle_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.handle_collisions(raw_records(spark, sf_dir)).withColumn("product_ids", F.array_join("product_ids", "|"))


@query(f"with {P} select partkey % 6 <> 0 as is_catalog, count(*) as n from products group by 1")
def u7_split_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.products(spark, sf_dir).withColumn("is_catalog_product", F.col("p_partkey") % 6 != 0)
    yes, no = D.split_catalog(p)
    both = yes.select(F.lit(True).alias("is_catalog")).unionByName(no.select(F.lit(False).alias("is_catalog")))
    return both.groupBy("is_catalog").agg(F.count(F.lit(1)).alias("n"))


# ---- changes and upserts

SQL_V2 = (
    P
    + """, v1 as (select store_slug, handle, product_id, price_min, sha1(title || '|' || price_min) as content_hash, case when partkey % 4 <> 0 then 'old-' || partkey end as summary_llm from products),
v2 as (select store_slug, handle, product_id, p2 as price_min, sha1(title || '|' || p2) as content_hash, case when partkey % 3 <> 0 then 'new-' || partkey end as summary_llm from (select *, price_min + case when partkey % 10 = 0 then 100 else 0 end as p2 from products where partkey % 50 <> 1)
  union all select store_slug, replace(title, ' ', '-') || '-' || (partkey + 10000000), (partkey + 10000000)::varchar, price_min, sha1(title || '|' || price_min), 'new' from products where partkey % 50 = 2)"""
)


def two_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(stored, new) catalogs: some prices changed, some products gone, some added."""
    p, k = V.products(spark, sf_dir), F.col("p_partkey")
    cols = lambda llm: ["store_slug", "handle", "product_id", "price_min", F.sha1(F.concat_ws("|", "title", "price_min")).alias("content_hash"), llm.alias("summary_llm")]
    old = p.select(*cols(F.when(k % 4 != 0, F.concat(F.lit("old-"), k.cast("string")))))
    kept = p.where(k % 50 != 1).withColumn("price_min", F.col("price_min") + F.when(k % 10 == 0, 100).otherwise(0))
    kept = kept.select(*cols(F.when(k % 3 != 0, F.concat(F.lit("new-"), k.cast("string")))))
    more = (k + 10000000).cast("string")
    added = p.where(k % 50 == 2).withColumns({"handle": F.concat(F.translate("title", " ", "-"), F.lit("-"), more), "product_id": more}).select(*cols(F.lit("new")))
    return old, kept.unionByName(added)


@query(f"with {SQL_V2} select v2.* from v2 left join v1 using (store_slug, handle) where v1.content_hash is null or v1.content_hash <> v2.content_hash")
def u8_changed_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = two_versions(spark, sf_dir)
    return M.changed_products(new, old)


@query(f"""with {SQL_V2} select store_slug, handle, coalesce(v2.product_id, v1.product_id) as product_id, coalesce(v2.price_min, v1.price_min) as price_min, coalesce(v2.content_hash, v1.content_hash) as content_hash,
case when v2.handle is null or (v1.content_hash = v2.content_hash and v1.summary_llm is not null) then v1.summary_llm else coalesce(v2.summary_llm, v1.summary_llm) end as summary_llm from v1 full join v2 using (store_slug, handle)""")
def u9_upsert_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.upsert_products(*two_versions(spark, sf_dir))


@query(ORACLES["u9_upsert_products"])
def u9_bucketed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upsert of u9 into a catalog stored in buckets of its key."""
    old, new = two_versions(spark, sf_dir)
    table = f"catalog_{uuid.uuid4().hex}"
    bucketed.save(old, table, new_path(spark, table), 16)
    found = written(bucketed.upserted(spark, table, new, force=True), "upserted")
    spark.sql(f"drop table {table}")
    return found


SQL_CRAWL = f"""urls as (select page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) as store_slug, {sql_url('url')} as url_norm, ['sitemap', 'shopify_json', 'html_link', 'external'][(page_id % 4 + 1)::int] as source from pages),
crawl as (select store_slug, url_norm, max_by(source, page_id) as source, max(page_id) as run_id, max((source = 'external')::int) = 1 as external_discovered from urls group by 1, 2)"""


def crawl_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.urls import host, normalize_url

    source = F.element_at(F.array(*map(F.lit, ["sitemap", "shopify_json", "html_link", "external"])), (F.col("page_id") % 4 + 1).cast("int"))
    rows = V.table(spark, sf_dir, "pages").select("page_id", host(F.col("url")).alias("store_slug"), normalize_url(F.col("url")).alias("url_norm"), source.alias("source"))
    return rows.groupBy("store_slug", "url_norm").agg(F.max_by("source", "page_id").alias("source"), F.max("page_id").alias("run_id"), F.bool_or(F.col("source") == "external").alias("external_discovered"))


@query(f"""with {SQL_CRAWL}, a as (select *, 'indexed' as status from crawl where run_id % 3 <> 0), b as (select *, not external_discovered and run_id % 2 = 0 as ext from crawl where run_id % 3 <> 1)
select store_slug, url_norm, coalesce(b.source, a.source) as source, coalesce(b.run_id, a.run_id) as run_id, case when b.run_id is not null then 'queued' else a.status end as status, coalesce(a.external_discovered, false) or coalesce(b.ext, false) as external_discovered
from a full join b using (store_slug, url_norm)""")
def u10_upsert_crawl_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = crawl_urls(spark, sf_dir)
    old = rows.where("run_id % 3 <> 0").withColumn("status", F.lit("indexed"))
    new = rows.where("run_id % 3 <> 1").withColumn("external_discovered", ~F.col("external_discovered") & (F.col("run_id") % 2 == 0)).withColumn("status", F.lit("queued"))
    return M.upsert_crawl_urls(old, new)


@query(f"""with {SQL_CRAWL} select store_slug, url_norm, case when run_id % 2 = 0 then 'error' else 'queued' end as status, case when run_id % 2 = 0 then 500 end::int as http_status, case when run_id % 2 = 0 then 'http 500' else 'old' end as error from crawl""")
def u11_apply_fetch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = crawl_urls(spark, sf_dir)
    urls = rows.select("store_slug", "url_norm", F.lit("queued").alias("status"), F.lit(None).cast("int").alias("http_status"), F.lit("old").alias("error"))
    done = rows.where("run_id % 2 = 0").select("store_slug", "url_norm", F.lit("error").alias("status"), F.lit(500).alias("http_status"), F.lit("http 500").alias("error"))
    return M.apply_fetch_status(urls, done)


@query(f"""with {PS} select slug, case when number % 5 <> 0 and number % 3 <> 0 then 'html' else platform end as platform, case when number % 5 <> 0 and number % 3 <> 0 then product_count else 0 end as product_count,
case when number % 5 = 0 then 'old' when number % 3 = 0 then 'boom' end as last_error from stores""")
def u12_store_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.stores(spark, sf_dir).withColumn("product_count", F.lit(0).cast("long")).withColumn("last_error", F.lit("old"))
    runs = s.where("number % 5 <> 0").select(F.col("slug").alias("store_slug"), F.lit("html").alias("platform"), F.lit("2024-06-01").cast("timestamp").alias("finished_at"), F.when(F.col("number") % 3 == 0, "boom").alias("error"))
    return M.store_outcome(s, runs, V.products(spark, sf_dir)).select("slug", "platform", "product_count", "last_error")


@query(f"""with {P}, w as (select partkey, unnest(list_transform(tags, lambda x: lower(x)) || string_split(lower(title), ' ') || string_split(lower(product_type), ' ')) as t from products), tok as (select partkey, string_agg(distinct t, '|' order by t) as option_tokens from w where trim(t) <> '' group by 1)
select partkey, true as is_catalog_product, title || ': ' || product_type as summary_short, option_tokens,
md5(title || '|' || handle || '|' || url || '||' || array_to_string(tags, ',') || '|' || price_min || '|' || price_max || '|' || available::varchar) as content_hash from products join tok using (partkey)""")
def u13_backfill_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    p = V.products(spark, sf_dir).withColumns({"is_catalog_product": F.lit(None).cast("boolean"), "summary_short": none, "option_tokens": F.array().cast("array<string>"), "content_hash": none, "description": none})
    return M.backfill_metadata(p).select(F.col("p_partkey").alias("partkey"), "is_catalog_product", "summary_short", joined("option_tokens"), "content_hash")


SQL_LETTERS = "concat_ws(' ', " + ", ".join(f"length(text) - length(replace(text, '{c}', ''))" for c in "aeinorst") + ", length(text))"
SQL_CHANGED = f"""{SQL_V2}, changed as (select v2.*, replace(v2.handle, '-', ' ') as text from v2 left join v1 using (store_slug, handle) where v1.content_hash is null or v1.content_hash <> v2.content_hash)"""


def letter_counts(texts: list[str]) -> list[list[float]]:
    """An embedding that SQL can work out too: how often some letters stand in a text, and its length."""
    return [[float(t.count(c)) for c in "aeinorst"] + [float(len(t))] for t in texts]


def _with_counts(rows: DataFrame) -> DataFrame:
    shown = F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), " ")
    return rows.select("store_slug", "handle", "product_id", "price_min", "content_hash", "summary_llm", shown.alias("vector"))


@query(f"with {SQL_CHANGED} select store_slug, handle, product_id, price_min, content_hash, summary_llm, {SQL_LETTERS} as vector from changed")
def u14_embed_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = two_versions(spark, sf_dir)
    changed = M.changed_products(new, old).withColumn("search_text", F.translate("handle", "-", " "))
    return _with_counts(M.embed_changed(changed, letter_counts))


@query(f"with {SQL_CHANGED} select store_slug, handle, product_id, price_min, content_hash, summary_llm, case when length(text) % 2 = 0 then '7 7' else {SQL_LETTERS} end as vector from changed")
def u14_embed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same against a stored table that has vectors, told by their values, of all texts of even length."""
    old, new = two_versions(spark, sf_dir)
    changed = M.changed_products(new, old).withColumn("search_text", F.translate("handle", "-", " "))
    texts = new.unionByName(old).select(F.translate("handle", "-", " ").alias("t")).where("length(t) % 2 = 0").distinct()
    stored = texts.select(M.text_key(F.col("t")).alias("text_key"), F.array(F.lit(7.0), F.lit(7.0)).cast("array<float>").alias("embedding"))
    return _with_counts(M.embed_texts(changed, stored, letter_counts)[0])


# ---- filters and lookups


@query(f"""with {P} select store_slug, product_id, rank from (select *, row_number() over (partition by store_slug order by product_id)::int as rank from products
where lower(product_type) = 'economy' and list_contains(tags, 'red') and price_max >= 90000 and price_min <= 200000 and available) where rank <= 20""")
def f1_filter_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = K.filter_products(V.products(spark, sf_dir), "Economy ", ["red"], 90000, 200000, True)
    return found.select("store_slug", "product_id", "rank")


@query(f"""with {P}, ok as (select distinct partkey from variants where size = 'M' and available)
select store_slug, product_id, rank from (select *, row_number() over (partition by store_slug order by product_id)::int as rank from products semi join ok using (partkey) where color = 'red') where rank <= 100""")
def f2_filter_by_option(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = K.filter_products(V.products(spark, sf_dir), options={"SIZE": "m ", "color": "Red"}, available_only=True, limit=500)
    return found.select("store_slug", "product_id", "rank")


@query(ORACLES["f2_filter_by_option"])
def f2_filter_raw_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter of f2 over products landed as JSON lines and read by path, without a schema."""
    path = new_path(spark, "product-lines")
    V.products(spark, sf_dir).select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    rows = semi.filterable(semi.from_json_lines(spark.read.text(path)))
    return K.filter_products(rows, options={"SIZE": "m ", "color": "Red"}, available_only=True, limit=500).select("store_slug", "product_id", "rank")


SQL_REQUESTS = P + """, requests as (select partkey as request_id, store_slug, case when partkey % 7 = 0 then 'none' else handle end as handle from products where partkey % 3 = 0)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.products(spark, sf_dir).where("p_partkey % 3 = 0")
    return p.select(F.col("p_partkey").alias("request_id"), "store_slug", F.when(F.col("p_partkey") % 7 == 0, "none").otherwise(F.col("handle")).alias("handle"))


@query(f"""with {SQL_REQUESTS} select request_id, store_slug, handle, title, price_min, available, n_variants::int as variant_count, p.handle is not null as found from requests left join products p using (store_slug, handle)""")
def f3_lookup_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = K.lookup_products(requests(spark, sf_dir), V.full_products(spark, sf_dir), brief=True)
    return found.select("request_id", "store_slug", "handle", "title", "price_min", "available", "variant_count", "found")


@query(f"with {P} select store_slug, product_id, title from products where partkey % 11 = 0")
def f4_fetch_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.full_products(spark, sf_dir)
    ids = p.where("p_partkey % 11 = 0").select("store_slug", "product_id").unionByName(p.where("p_partkey % 22 = 0").select("store_slug", "product_id"))
    return K.fetch_by_ids(ids, p).select("store_slug", "product_id", "title")


@query(f"""with {SQL_REQUESTS}, v as (select v.*, store_slug, handle from variants v join products using (partkey)), first as (select store_slug, handle, min(id) as id from v where size = 'M' group by 1, 2)
select request_id, p.handle is not null as found, f.id is not null as matched, coalesce(v.available, false) as available, f.id as variant_id, coalesce(v.price_cents, 0) as price
from requests r left join products p using (store_slug, handle) left join first f using (store_slug, handle) left join v on v.id = f.id""")
def f5_check_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = requests(spark, sf_dir).withColumn("options", F.create_map(F.lit("size"), F.lit(" M")))
    return K.check_variants(asked, V.products(spark, sf_dir))


SQL_RESOLVE = (
    SQL_REQUESTS
    + """, v as (select v.*, store_slug, handle from variants v join products using (partkey)),
pick as (select store_slug, handle, min(id) as any_id, min(id) filter (size = 'S') as s_id, count(*) filter (available) as n_av, min(id) filter (available) as av_id from v group by 1, 2),
chosen as (select r.*, p.handle is not null as known, case request_id % 5 when 0 then pk.any_id when 1 then null when 2 then s_id else case when n_av = 1 then av_id end end as variant_id
  from requests r left join products p using (store_slug, handle) left join pick pk using (store_slug, handle)),
resolved as (select *, case when not known then 'product_not_found' when variant_id is not null then null when request_id % 5 = 1 then 'variant_not_found' when request_id % 5 = 2 then 'options_not_found' else 'variant_selection_required' end as reason from chosen)"""
)


def resolve_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by id, by an unknown id, by options, and without either."""
    p = V.products(spark, sf_dir).select("store_slug", "handle", F.element_at("variants", 1)["id"].alias("first_id"))
    r, k = requests(spark, sf_dir).join(p, ["store_slug", "handle"], "left"), F.col("request_id") % 5
    return r.select("request_id", "store_slug", "handle", F.when(k == 0, F.col("first_id")).when(k == 1, "no-such-id").alias("variant_id"), F.when(k == 2, F.create_map(F.lit("Size"), F.lit("s"))).alias("options"))


@query(f"with {SQL_RESOLVE} select request_id, variant_id, reason from resolved")
def f6_resolve_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.resolve_variants(resolve_requests(spark, sf_dir), V.products(spark, sf_dir)).select("request_id", F.col("variant.id").alias("variant_id"), "reason")


@query(f"""with {P} select store_slug, product_id, price, rank from (select *, price_min as price, row_number() over (partition by store_slug order by partkey % 100 desc, product_id)::int as rank from products where price_min >= 50000) where rank > 2 and rank <= 7""")
def f7_list_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.products(spark, sf_dir).withColumn("updated_at", F.timestamp_seconds(F.col("p_partkey") % 100))
    return K.list_products(p, 5, 2, price_min=50000).select("store_slug", "product_id", "price", "rank")


# ---- facets, manifests, stores


@query(f"with {P} select *, row_number() over (partition by store_slug order by n desc, product_type)::int as rank from (select store_slug, product_type, count(*) as n from products group by 1, 2)")
def a1_product_type_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.product_type_facets(V.products(spark, sf_dir))


@query(f"with {P} select * from (select *, row_number() over (partition by store_slug order by n desc, tag)::int as rank from (select store_slug, tag, count(*) as n from (select store_slug, unnest(tags) as tag from products) group by 1, 2)) where rank <= 25")
def a2_top_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.top_tags(V.products(spark, sf_dir))


@query(f"with {P} select store_slug, count(*) as total_products from products group by 1")
def a3_catalog_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.catalog_totals(V.full_products(spark, sf_dir))


SQL_MANIFEST = (
    P
    + """, manifest as (select store_slug, product_id, title, handle, case when partkey % 5 = 0 then 'uncategorized' else product_type end as category, price_min, price_max, available, n_variants::int as variant_count,
  case when partkey % 4 = 0 then 'unknown' else 'shopify_json' end as source, url, partkey % 9 = 0 as external_match from products)"""
)


def with_blanks(p: DataFrame) -> DataFrame:
    """Products some of which have a blank type or no source."""
    k = F.col("p_partkey")
    return p.withColumns({"product_type": F.when(k % 5 == 0, " ").otherwise(F.col("product_type")), "source": F.when(k % 4 != 0, F.col("source"))})


def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.full_products(spark, sf_dir)
    urls = p.select("store_slug", F.col("url").alias("url_norm"), (F.col("p_partkey") % 9 == 0).alias("external_discovered"))
    return K.manifest(with_blanks(p), urls)


@query(f"with {SQL_MANIFEST} select * from manifest")
def a4_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest_rows(spark, sf_dir)


@query(f"""with {SQL_MANIFEST} select store_slug, count(*) as total_products, count(*) filter (available) as available_products, count(*) filter (not available) as unavailable_products, sum(variant_count)::bigint as total_variants, round(avg(variant_count), 2)::double as avg_variants from manifest group by 1""")
def a5_manifest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.manifest_summary(manifest_rows(spark, sf_dir))


@query(f"with {SQL_MANIFEST} select store_slug, 'category' as kind, category as value, count(*) as n from manifest group by 1, 3 union all select store_slug, 'source', source, count(*) from manifest group by 1, 3")
def a6_breakdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.breakdowns(manifest_rows(spark, sf_dir))


SQL_EXTERNAL = f"{SQL_CRAWL}, ext as (select distinct store_slug, url_norm from urls where page_id % 2 = 0), own as (select distinct store_slug, url_norm from urls where page_id % 3 = 0), cov as (select e.store_slug, e.url_norm, o.url_norm is not null as matched from ext e left join own o using (store_slug, url_norm))"


def _external(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from ..functions.urls import host, normalize_url

    rows = V.table(spark, sf_dir, "pages").select("page_id", host(F.col("url")).alias("store_slug"), normalize_url(F.col("url")).alias("url_norm"))
    return rows.where("page_id % 2 = 0"), rows.where("page_id % 3 = 0")


@query(f"with {SQL_EXTERNAL} select * from cov")
def a7_external_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.external_coverage(*_external(spark, sf_dir))


@query(f"with {SQL_EXTERNAL} select store_slug, count(*) as discovered, count(*) filter (matched) as matched, count(*) filter (not matched) as unmatched from cov group by 1")
def a7_external_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.external_counts(*_external(spark, sf_dir))


SQL_RUNS = """runs as (select o_orderkey as id, o_custkey::varchar as store_slug, case o_orderstatus when 'F' then 'completed' when 'O' then 'running' else 'failed' end as status, o_orderdate as started_at,
  floor(o_totalprice)::bigint as discovered_urls from orders)"""


def crawl_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = V.table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    n = F.floor("o_totalprice")
    stats = F.struct(n.alias("discovered_urls"), n.alias("crawled_urls"), n.alias("sitemap_urls"), n.alias("skipped_unchanged"))
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("store_slug"), status.alias("status"), F.when(status == "failed", "boom").alias("error"), F.col("o_orderdate").alias("started_at"), F.col("o_orderdate").alias("finished_at"), stats.alias("stats")
    )


@query(f"with {SQL_RUNS} select case when regexp_matches(status, 'complete') then 'ok' when regexp_matches(status, 'fail') then 'error' else 'warn' end as status_group, count(*) as n from runs group by 1")
def a8_status_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.status_tally(crawl_runs(spark, sf_dir))


@query(f"""with {SQL_RUNS}, last as (select * from (select *, row_number() over (partition by store_slug order by started_at desc, id desc) as rn from runs) where rn = 1)
select c_custkey::varchar as slug, id as run_id, discovered_urls, coalesce(status, case when c_custkey % 2 = 0 then 'failed' else 'completed' end) as state from customer left join last on store_slug = c_custkey::varchar""")
def r1_stores_with_latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("slug"), F.when(F.col("c_custkey") % 2 == 0, "boom").alias("last_error"))
    return K.stores_with_latest_run(s, crawl_runs(spark, sf_dir)).select("slug", F.col("run.id").alias("run_id"), F.col("run.stats.discovered_urls").alias("discovered_urls"), "state")


@query(f"with {PS} select slug, product_count, indexed_at from stores order by product_count desc, indexed_at desc nulls last, slug limit 10 offset 3")
def l1_list_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.list_stores(V.stores(spark, sf_dir), "size", 10, 3).select("slug", "product_count", F.col("indexed_at").cast("timestamp_ntz").alias("indexed_at"))


# ---- counts kept by changes


def kept_counts(p: DataFrame) -> DataFrame:
    """Counts of an older catalog, in which products had other types, tags and stock, some were missing and some are gone since, with the changes to the present one put in."""
    new = p.select("handle", *TL.READ, "p_partkey").withColumn("content_hash", F.xxhash64("product_type", "tags", "available", F.size("variants")))
    k = F.col("p_partkey")
    old = new.where(k % 7 != 1).withColumns(
        {
            "product_type": F.when(k % 5 == 0, "old type").when(k % 5 == 1, "").otherwise(F.col("product_type")), "tags": F.when(k % 4 == 0, F.array(F.lit("old"), F.lit(""))).otherwise(F.col("tags")),
            "available": F.when(k % 6 == 0, ~F.col("available")).otherwise(F.col("available")), "variants": F.when(k % 10 == 3, F.slice("variants", 1, 1)).otherwise(F.col("variants")),
        }
    ).withColumn("content_hash", F.xxhash64("product_type", "tags", "available", F.size("variants")))
    old = old.unionByName(new.where(k % 8 == 2).withColumns({"handle": F.concat(F.lit("gone-"), "handle"), "store_slug": F.when(k % 3 == 0, "gone").otherwise(F.col("store_slug"))}))
    return TL.merged(TL.summed(TL.contributions(old)), TL.changes(new, old, gone=True))


@query(ORACLES["a1_product_type_facets"])
def a1_facets_by_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TL.type_facets(kept_counts(V.full_products(spark, sf_dir)))


@query(ORACLES["a2_top_tags"])
def a2_tags_by_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TL.top_tags(kept_counts(V.full_products(spark, sf_dir)))


@query(ORACLES["a3_catalog_totals"])
def a3_totals_by_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TL.totals(kept_counts(V.full_products(spark, sf_dir)))


@query(ORACLES["a5_manifest_summary"])
def a5_summary_by_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TL.summary(kept_counts(V.full_products(spark, sf_dir)))


@query(ORACLES["a6_breakdowns"])
def a6_breakdowns_by_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TL.breakdowns(kept_counts(with_blanks(V.full_products(spark, sf_dir))))
