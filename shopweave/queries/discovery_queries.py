"""Queries of discovery and extraction, and the whole workloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.urls import host, normalize_url
from ..operators import discovery as D, extract as X, feeds
from ..plans import workloads
from ..sources import io
from ..sources.shared import new_path
from . import views as V
from .basket_queries import SQL_CLOSED, SQL_LINES
from .catalog_queries import feed_bodies
from .column_queries import SQL_SHOP_URL, shop_url, sql_part, sql_score, sql_url
from .search_queries import ORACLES as SEARCH_ORACLES, SQL_ROUTED, SQL_SCORED, hybrid

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


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.table(spark, sf_dir, "pages")
    return p.select("page_id", host(F.col("url")).alias("store_slug"), "url", F.col("html").alias("body"))


def sitemap_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sitemap per host, made of its pages' URLs; hosts of an even length name further sitemaps instead."""
    loc = F.replace("url", F.lit("&"), F.lit("&amp;"))
    even = F.length("store_slug") % 2 == 0
    node = F.when(even, F.concat(F.lit("<sitemap><loc> "), loc, F.lit("</loc></sitemap>"))).otherwise(F.concat(F.lit("<url><loc>"), loc, F.lit("</loc></url>")))
    body = pages(spark, sf_dir).groupBy("store_slug").agg(F.array_join(F.sort_array(F.collect_set(node)), "\n").alias("x"))
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    text = F.when(even, F.concat(F.lit(f'<?xml version="1.0"?><sitemapindex {ns}>'), "x", F.lit("</sitemapindex>"))).otherwise(F.concat(F.lit(f"<urlset {ns}>"), "x", F.lit("</urlset>")))
    return body.select("store_slug", F.concat(F.lit("https://"), "store_slug", F.lit("/sitemap.xml")).alias("url"), F.encode(text, "utf-8").alias("body"))


@query(f"select distinct {sql_part('url', 2)} as store_slug, case when length({sql_part('url', 2)}) % 2 = 0 then 'sitemap' else 'url' end as kind, trim(url) as loc from pages")
def d1_parse_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.parse_sitemaps(sitemap_bodies(spark, sf_dir)).select("store_slug", "kind", "loc")


@query(f"""with {PS} select slug as store_slug, url || unnest(['/sitemap.xml', '/sitemap_index.xml', '/sitemap_products.xml', '/sitemap_products_1.xml', '/maps/a.xml', '/maps/b.xml?x=1']) as url from stores""")
def d2_seed_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.stores(spark, sf_dir)
    text = F.concat(F.lit("User-agent: *\nSitemap: "), "url", F.lit("/maps/a.xml\r\n sitemap:/maps/b.xml?x=1&utm_source=q\nDisallow: /cart"))
    robots = s.select(F.col("slug").alias("store_slug"), F.concat("url", F.lit("/robots.txt")).alias("url"), text.alias("body"))
    return D.seed_sitemaps(s, robots)


@query("""with recursive links as (select 's' || page_id % 3 as store_slug, 'u' || page_id as url, unnest(['u' || (page_id * 2 + 3), 'u' || (page_id * 2 + 6), 'u0']) as loc, page_id from pages),
walk as (select distinct store_slug, url, 0 as depth from links where page_id < 6 union select l.store_slug, l.loc, depth + 1 from walk w join links l on l.store_slug = w.store_slug and l.url = w.url where depth < 5),
best as (select store_slug, url, min(depth) as depth from walk group by 1, 2)
select store_slug, url, depth::int as depth from (select *, row_number() over (partition by store_slug order by depth, url) as n from best) where n <= 40""")
def d3_expand_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.table(spark, sf_dir, "pages")
    name = lambda c: F.concat(F.lit("u"), c.cast("string"))
    k = F.col("page_id")
    store = F.concat(F.lit("s"), (k % 3).cast("string")).alias("store_slug")
    links = p.select(store, name(k).alias("url"), F.explode(F.array(name(k * 2 + 3), name(k * 2 + 6), F.lit("u0"))).alias("loc"), F.lit("sitemap").alias("kind"))
    return D.expand_sitemaps(p.where("page_id < 6").select(store, name(k).alias("url")), links, 5, 40)


SQL_LINK_PAGES = f"link_pages as (select page_id, {sql_part('url', 2)} as store_slug, url, case when page_id % 2 = 0 then replace(html, 'href=\"/', 'href=\"/products/') else replace(html, 'href=\"/', 'href=\"/collections/') end as body from pages)"


@query(f"""with {SQL_LINK_PAGES}, raw as (select store_slug, url as page_url, lower({sql_part('url', 1)}) || '://' || {sql_part('url', 2)} || unnest(list_distinct(regexp_extract_all(body, '(?i)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']+)["'']', 1) || regexp_extract_all(body, '(?i)["''](/[^"'']*/(?:products?|collections)/[^"'']+)["'']', 1))) as u from link_pages)
select distinct store_slug, page_url, url, case when contains(lower(url), '/products/') or contains(lower(url), '/product/') or contains(lower(url), 'variant=') then 'product' else 'collection' end as kind
from (select store_slug, page_url, {sql_url('u')} as url from raw) where contains(lower(url), '/products/') or contains(lower(url), '/product/') or contains(lower(url), 'variant=') or contains(lower(url), '/collections/')""")
def d4_extract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir)
    put = lambda x: F.replace("body", F.lit('href="/'), F.lit(f'href="/{x}/'))
    return X.extract_links(p.withColumn("body", F.when(F.col("page_id") % 2 == 0, put("products")).otherwise(put("collections"))))


SQL_COLLECTION_LINKS = f"""link_pages as (select {sql_part('url', 2)} as store_slug, url, replace(html, 'href="/', 'href="/collections/') as body from pages),
raw as (select store_slug, url as page_url, lower({sql_part('url', 1)}) || '://' || {sql_part('url', 2)} || unnest(list_distinct(regexp_extract_all(body, '(?i)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']+)["'']', 1) || regexp_extract_all(body, '(?i)["''](/[^"'']*/(?:products?|collections)/[^"'']+)["'']', 1))) as u from link_pages),
links as (select distinct store_slug, page_url, {sql_url('u')} as url from raw where contains(lower(u), '/collections/') and not (contains(lower(u), '/products/') or contains(lower(u), '/product/') or contains(lower(u), 'variant=')))"""


@query(f"""with recursive {SQL_COLLECTION_LINKS}, seeds as (select *, row_number() over (partition by store_slug order by case when regexp_matches(page_url, '/collections/all/?$') then 0 else 1 end, page_url) as n from (select distinct store_slug, page_url from links)),
walk as (select store_slug, page_url as url, 0 as depth from seeds where n <= 17 union select w.store_slug, l.url, depth + 1 from walk w join links l on l.store_slug = w.store_slug and l.page_url = w.url where depth < 12),
best as (select store_slug, url, min(depth) as depth from walk group by 1, 2)
select store_slug, url, depth::int as depth from (select *, row_number() over (partition by store_slug order by depth, url) as n from best) where n <= 12""")
def d5_expand_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir)
    links = X.extract_links(p.withColumn("body", F.replace("body", F.lit('href="/'), F.lit('href="/collections/'))))
    return D.expand_collections(links.where("kind = 'collection'").select("store_slug", F.col("page_url").alias("url")).distinct(), links)


SQL_FOUND = f"""found as (select 's' || page_id % 7 as store_slug, {sql_url(SQL_SHOP_URL)} as url, ['sitemap', 'shopify_json', 'html_link', 'external'][(page_id % 4 + 1)::int] as source, page_id % 3 = 0 as candidate from pages
  union all select 's' || page_id % 7, {sql_url(SQL_SHOP_URL)}, 'html_link', page_id % 5 = 0 from pages where page_id % 2 = 0),
merged as (select store_slug, url, max_by(source, case source when 'external' then 4 when 'shopify_json' then 3 when 'html_link' then 2 else 1 end) as source, max(candidate::int) = 1 as candidate from found group by 1, 2)"""


def merged_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = V.table(spark, sf_dir, "pages"), F.col("page_id")
    source = F.element_at(F.array(*map(F.lit, ["sitemap", "shopify_json", "html_link", "external"])), (k % 4 + 1).cast("int"))
    base = [F.concat(F.lit("s"), (k % 7).cast("string")).alias("store_slug"), normalize_url(shop_url()).alias("url")]
    one = p.select(*base, source.alias("source"), (k % 3 == 0).alias("candidate"))
    two = p.where(k % 2 == 0).select(*base, F.lit("html_link").alias("source"), (k % 5 == 0).alias("candidate"))
    return D.merge_discovered(one, two)


@query(f"with {SQL_FOUND} select * from merged")
def d6_merge_discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged_urls(spark, sf_dir)


@query(f"""select distinct store_slug, url from (select regexp_replace({sql_part('url', 2)}, '^www\\.', '') as store_slug, {sql_url(SQL_SHOP_URL)} as url from pages where page_id % 4 <> 1) where contains(url, '/products/') or contains(url, '/product/') or contains(url, 'variant=')""")
def d7_filter_external_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.regexp_replace(host(F.col("url")), r"^www\.", "")
    store = F.when(F.col("page_id") % 4 == 1, "https://other.example.org").otherwise(F.concat(F.lit("https://www."), own))
    return X.filter_external_urls(V.table(spark, sf_dir, "pages").select(own.alias("store_slug"), store.alias("store_url"), shop_url().alias("url")))


@query(f"""with {SQL_FOUND}, s as (select *, (contains(lower(url), '/products/') or contains(lower(url), '/product/') or contains(lower(url), '?variant='))::int as product, {sql_score('url')} as score from merged),
per as (select store_slug, count(*) as n, sum(product) as np from s group by 1), r as (select s.*, n, np, row_number() over (partition by s.store_slug order by product desc, score desc, url)::int as rank from s join per using (store_slug))
select store_slug, url, rank, score::int as score from r where rank <= case when n >= 6 and store_slug <> 's3' then 4 else 9 end and (not (store_slug in ('s1', 's2') and np > 0) or product = 1)""")
def d8_plan_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = merged_urls(spark, sf_dir)
    slug = F.col("store_slug")
    stores = urls.select("store_slug").distinct().select(slug.alias("slug"), F.when(slug.isin("s1", "s2", "s3"), "shopify").otherwise("html").alias("platform"), (slug == "s3").alias("has_feed"))
    return D.plan_crawl(urls, stores, most=9, large_most=4, large_from=6)


@query(f"""with {PS} select slug, case when number % 6 = 0 then 'shopify' when number % 6 = 1 then 'shopify' when number % 6 = 2 then 'unknown' when number % 6 = 3 then 'shopify' else 'html' end as platform from stores""")
def d9_detect_platform(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = V.stores(spark, sf_dir), F.col("number") % 6
    s = s.withColumn("url", F.when(k == 0, F.concat(F.lit("https://"), "slug", F.lit(".myshopify.com"))).otherwise(F.col("url")))
    probes = s.select(F.col("slug").alias("store_slug"), F.when(k == 1, ' {"Products": []}').otherwise("<html>products</html>").alias("body"))
    homes = s.where(k != 2).select(F.col("slug").alias("store_slug"), F.when(k == 3, "<link href=//CDN.shopify.com/x>").otherwise("<p>shop</p>").alias("body"))
    return D.detect_platform(s, probes, homes)


SQL_FETCHES = """fetches as (select event_id, 's' || event_id % 9 as store_slug, 'u' || event_id as url, event_type, case event_type when 'signup' then 304 when 'error' then 500 when 'purchase' then 404 else 200 end as status from events),
outcomes as (select *, case event_type when 'signup' then 'excluded' when 'error' then 'error' when 'purchase' then 'error' when 'click' then 'crawled' else case when event_id % 3 = 0 then 'indexed' else 'crawled' end end as outcome from fetches)"""


def fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, kind, k = V.table(spark, sf_dir, "events"), F.col("event_type"), F.col("event_id")
    status = F.when(kind == "signup", 304).when(kind == "error", 500).when(kind == "purchase", 404).otherwise(200)
    rows = e.select(F.concat(F.lit("s"), (k % 9).cast("string")).alias("store_slug"), F.concat(F.lit("u"), k.cast("string")).alias("url"), status.alias("status"), F.when(kind == "click", "image/png").otherwise("text/HTML").alias("content_type"), "event_id")
    return D.classify_fetches(rows, rows.where(k % 3 == 0).select("store_slug", "url", F.lit(2).alias("n_products")))


@query(f"with {SQL_FETCHES} select store_slug, url, status, outcome from outcomes")
def d10_classify_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetched(spark, sf_dir).select("store_slug", "url", "status", "outcome")


@query(f"""with {SQL_FETCHES}, d as (select 's' || page_id % 12 as store_slug, count(*) as discovered_urls, count(*) filter (page_id % 4 = 0) as sitemap_urls from pages group by 1), t as (select store_slug, count(*) as crawled_urls, count(*) filter (outcome = 'excluded') as skipped_unchanged from outcomes group by 1)
select store_slug, coalesce(discovered_urls, 0) as discovered_urls, coalesce(sitemap_urls, 0) as sitemap_urls, coalesce(crawled_urls, 0) as crawled_urls, coalesce(skipped_unchanged, 0) as skipped_unchanged from d full join t using (store_slug)""")
def d11_crawl_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    found = V.table(spark, sf_dir, "pages").select(F.concat(F.lit("s"), (k % 12).cast("string")).alias("store_slug"), F.when(k % 4 == 0, "sitemap").otherwise("html_link").alias("source"))
    return D.crawl_metrics(fetched(spark, sf_dir), found)


@query(f"""with {P} select store_slug, url, case when partkey % 2 = 0 then 'e' || partkey end as etag, case when partkey % 2 = 0 then 'm' || partkey end as last_modified from products""")
def d12_fetch_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = V.products(spark, sf_dir), F.col("p_partkey")
    stored = p.where(k % 2 == 0).select("store_slug", "url", "handle", F.concat(F.lit("e"), k.cast("string")).alias("etag"), F.concat(F.lit("m"), k.cast("string")).alias("last_modified"))
    return D.fetch_state(p.select("store_slug", "url"), stored)


def product_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product pages with JSON-LD; every fourth has only meta tags, every ninth says it is missing."""
    p, k = V.products(spark, sf_dir), F.col("p_partkey")
    offers = F.transform("variants", lambda v: F.struct(F.lit("Offer").alias("@type"), v["id"].alias("sku"), V.units(v["price_cents"]).alias("price"), F.lit("usd").alias("priceCurrency"), F.when(v["available"], "https://schema.org/InStock").otherwise("https://schema.org/OutOfStock").alias("availability")))
    offer = F.struct(F.lit("AggregateOffer").alias("@type"), offers.alias("offers"))
    node = F.struct(F.array(F.lit("Thing"), F.lit("Product")).alias("@type"), "product_id", F.col("title").alias("name"), F.col("product_id").alias("sku"), F.struct(F.col("vendor").alias("name")).alias("brand"), F.array_join("tags", ", ").alias("category"), offer.alias("offers"))
    ld = F.concat(F.lit('<html><script type="application/ld+json">{bad</script><script type="application/ld+json">{"@graph":['), F.to_json(node), F.lit("]}</script><h1>other</h1></html>"))
    price = F.format_string("%.2f", F.col("price_min") / 100.0)
    meta = F.concat(F.lit('<meta property="og:title" content=" '), "title", F.lit('"><meta property="product:price:amount" content="'), price, F.lit('"><p itemprop="brand"><b>'), "vendor", F.lit("</b></p>"))
    missing = F.lit("<h1>404 not found</h1>")
    body = F.when(k % 9 == 0, missing).when(k % 4 == 0, meta).otherwise(ld)
    return p.select("store_slug", F.concat(F.lit("https://"), "store_slug", F.lit(".example.com")).alias("store_url"), "url", F.lit(None).cast("string").alias("etag"), F.lit(None).cast("string").alias("last_modified"), body.alias("body"))


@query(f"""with {P}, first as (select partkey, arg_min(price_cents, id) as price, arg_min(available, id) as av from variants group by 1)
select store_slug, handle, url, title, vendor as brand, case when partkey % 4 <> 0 then product_id end as id, case when partkey % 4 <> 0 then array_to_string(tags, '|') else '' end as tags,
format('{{:.2f}}', case when partkey % 4 = 0 then price_min else price end / 100.0) as price, case when partkey % 4 <> 0 then case when av then 'https://schema.org/InStock' else 'https://schema.org/OutOfStock' end end as availability,
case when partkey % 4 <> 0 then n_variants else 0 end::int as n_variants from products join first using (partkey) where partkey % 9 <> 0""")
def x1_extract_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.extract_products(product_pages(spark, sf_dir))
    return found.select("store_slug", "handle", "url", "title", "brand", "id", F.array_join("tags", "|").alias("tags"), "price", "availability", F.size("variants").alias("n_variants"))


@query(f"""with {P}, first as (select partkey, arg_min(available, id) as av from variants group by 1)
select store_slug, handle, title, price_min, case when partkey % 4 = 0 then price_min else price_max end as price_max, partkey % 4 = 0 or av as available from products join first using (partkey) where partkey % 9 <> 0""")
def x2_normalize_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's product is available if its first offer is; one of meta tags alone has one price and counts as available."""
    raw = X.extract_products(product_pages(spark, sf_dir)).withColumn("options", F.array().cast("array<struct<name:string,values:array<string>>>"))
    return feeds.normalize_products(raw).select("store_slug", "handle", "title", "price_min", "price_max", "available")


@query(f"""with {P} select store_slug, handle, product_id, title, price_min, price_max, available, 'shopify_json' as source from products""")
def w1_refresh_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty catalog after a run over feeds and pages of the same products: the feeds' records win."""
    feed, found = io.explode_feed(feed_bodies(spark, sf_dir)), product_pages(spark, sf_dir)
    new = feeds.normalize_products(workloads.raw_candidates(feed, None))
    stored = spark.createDataFrame([], new.drop("store_url", "seq").schema)
    out = workloads.refresh_catalog(stored, feed, found)
    return out.select("store_slug", "handle", "product_id", "title", "price_min", "price_max", "available", "source")


@query(SEARCH_ORACLES["s9_search_v2"].replace(SQL_SCORED, SQL_ROUTED))
def w2_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword and vector rankings fused, for questions to each store and to none, which are routed to one."""
    products, asked = hybrid(spark, sf_dir)
    found = workloads.ranked_search(products, asked, V.stores(spark, sf_dir))
    return found.select("query_id", "rank", "product_id", "price_min", "price_max", "available", F.round("total", 6).alias("total"))


@query(f"""with {V.SQL_EVENTS}, {SQL_CLOSED}, open_log as (select l.* from log l left join closed c using (basket_id) where closed_seq is null or seq <= closed_seq), {SQL_LINES.format(log='open_log')},
t as (select b.basket_id, count(variant_id) as item_count, coalesce(sum(quantity), 0)::bigint as quantity_total, coalesce(sum(greatest(1, quantity) * unit_price), 0)::bigint as subtotal, string_agg(variant_id || ':' || greatest(1, least(99, quantity)), ',' order by added_seq, variant_id) as line
  from (select distinct basket_id from log) b left join folded f using (basket_id) group by 1)
select basket_id, item_count, subtotal, case when item_count = 0 then 'empty_basket' end as reason, case when item_count > 0 then 'https://s.example.com/cart/' || line end as checkout_url from t""")
def w3_checkout(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = V.basket_events(spark, sf_dir).withColumn("store_slug", F.lit("s"))
    baskets = events.select("basket_id", "store_slug", F.lit("active").alias("status")).distinct()
    stores = baskets.select(F.col("store_slug").alias("slug"), F.lit("shopify").alias("platform"), F.lit("https://s.example.com/").alias("url")).distinct()
    return workloads.checkout(events, baskets, stores).select("basket_id", "item_count", "subtotal", "reason", "checkout_url")


@query(ORACLES["d1_parse_sitemaps"])
def io3_read_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed, compressed sitemap files, one of each host, read and parsed."""
    at = new_path(spark, "sitemaps")
    sitemap_bodies(spark, sf_dir).select("store_slug", F.decode("body", "utf-8").alias("body")).write.partitionBy("store_slug").option("compression", "gzip").text(at)
    rows = io.read_sitemaps(spark, at).withColumn("store_slug", F.regexp_extract("url", "/store_slug=([^/]+)/", 1))
    return D.parse_sitemaps(rows).select("store_slug", "kind", "loc")
