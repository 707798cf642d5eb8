"""Where product pages are: sitemaps, robots files, merged URLs, crawl plans, fetch outcomes."""

from __future__ import annotations

import gzip
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.urls import host, is_product_url, normalize_url, resolved, url_product_score
from ..sources.shared import written

#: Where sitemaps are looked for without being told. Fixed values.
FALLBACK_PATHS = ["/sitemap.xml", "/sitemap_index.xml", "/sitemap_products.xml", "/sitemap_products_1.xml"]
#: What shows the supported platform in a page. Fixed values.
MARKERS = ["cdn.shopify.com", "shopify-section", "shopify.theme", "x-shopify-stage", "/products.json"]
PRIORITY = {"external": 4, "shopify_json": 3, "html_link": 2, "sitemap": 1}


def _plain(body: bytes) -> str:
    if body[:2] == b"\x1f\x8b":
        body = gzip.decompress(body)
    return body.decode("utf-8", "replace")


def sitemap_entries(body: bytes | None) -> list[tuple[str, str]]:
    """(kind, loc) of a sitemap body, kind being sitemap or url; of a text that isn't such XML the lines that are URLs."""
    if not body:
        return []
    try:
        text = _plain(bytes(body))
    except (OSError, EOFError):
        return []
    out = []
    try:
        root = ET.fromstring(text.lstrip("﻿ \t\r\n").encode())
        name = lambda e: e.tag.rsplit("}", 1)[-1]
        kinds = {"sitemapindex": "sitemap", "urlset": "url"}
        for node in root if name(root) in kinds else []:
            if name(node) == kinds[name(root)]:
                # a loc of another namespace, such as an image's, lies deeper
                loc = next((c.text.strip() for c in node if name(c) == "loc" and c.text and c.text.strip()), None)
                if loc:
                    out.append((kinds[name(root)], loc))
    except ET.ParseError:
        pass
    return out or [("url", x.strip()) for x in re.split(r"\r?\n", text) if re.match(r"(?i)https?://", x.strip())]


def parse_sitemaps(bodies: DataFrame) -> DataFrame:
    """(store_slug, url, body) sitemap bodies, plain or gzip, as (store_slug, url, kind, loc) rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(s, u, *e) for s, u, x in zip(b["store_slug"], b["url"], b["body"], strict=True) for e in sitemap_entries(x)]
            yield pd.DataFrame(out, columns=["store_slug", "url", "kind", "loc"])

    return bodies.select("store_slug", "url", "body").mapInPandas(run, "store_slug string, url string, kind string, loc string")


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """Distinct (store_slug, url) of the sitemaps that robots files (store_slug, url, body) name."""
    named = F.explode(F.regexp_extract_all("body", F.lit(r"(?im)^[ \t]*sitemap[ \t]*:[ \t]*(\S[^\r\n]*)$"), F.lit(1)))
    rows = robots.select("store_slug", F.col("url").alias("base"), named.alias("raw"))
    whole = F.when(F.trim("raw").rlike("^(?i:https?)://"), F.trim("raw"))
    return rows.select("store_slug", normalize_url(F.coalesce(whole, resolved(F.col("raw"), F.col("base")))).alias("url")).where("url is not null").distinct()


def seed_sitemaps(stores: DataFrame, robots: DataFrame | None = None) -> DataFrame:
    """Distinct (store_slug, url) of all sitemaps to start from: those named in robots files and the usual places."""
    usual = stores.select(F.col("slug").alias("store_slug"), F.explode(F.array(*map(F.lit, FALLBACK_PATHS))).alias("path"), "url")
    usual = usual.select("store_slug", normalize_url(F.concat(F.regexp_replace("url", "/+$", ""), "path")).alias("url"))
    return (usual if robots is None else usual.unionByName(robots_sitemaps(robots))).distinct()


def expand(seeds: DataFrame, links: DataFrame, max_depth: int, most: int) -> DataFrame:
    """Breadth-first walk from (store_slug, url) seeds over (store_slug, url, loc) links: (store_slug, url, depth).

    No URL is visited twice; at most `most` of a store, nearest first, then by URL.
    """
    links = written(links.select("store_slug", "url", "loc").distinct(), "links")  # read in each round, worked out once
    seen = written(seeds.select("store_slug", "url").distinct().withColumn("depth", F.lit(0)), "frontier")
    frontier = seen
    for depth in range(1, max_depth + 1):
        found = frontier.select("store_slug", "url").join(links, ["store_slug", "url"]).select("store_slug", F.col("loc").alias("url")).distinct()
        frontier = written(found.join(seen.select("store_slug", "url"), ["store_slug", "url"], "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    place = F.row_number().over(W.partitionBy("store_slug").orderBy("depth", "url"))
    return seen.withColumn("_n", place).where(F.col("_n") <= most).drop("_n")


def expand_sitemaps(seeds: DataFrame, entries: DataFrame, max_depth: int = 5, most: int = 500) -> DataFrame:
    """Sitemaps reached from the seeds over parsed entries."""
    return expand(seeds, entries.where("kind = 'sitemap'").select("store_slug", "url", "loc"), max_depth, most)


def expand_collections(seeds: DataFrame, page_links: DataFrame, max_depth: int = 12, most: int = 12, most_seeds: int = 16) -> DataFrame:
    """Collection pages to read: the store's list of all and at most 16 seeds, then what they link to, 12 at most."""
    place = F.row_number().over(W.partitionBy("store_slug").orderBy(F.when(F.col("url").rlike("/collections/all/?$"), 0).otherwise(1), "url"))
    first = seeds.withColumn("_n", place).where(F.col("_n") <= most_seeds + 1).select("store_slug", "url")
    links = page_links.where("kind = 'collection'").select("store_slug", F.col("page_url").alias("url"), F.col("url").alias("loc"))
    return expand(first, links, max_depth, most)


def merge_discovered(*found: DataFrame) -> DataFrame:
    """(store_slug, url, source, candidate) of all sources, one row per URL: the strongest source, candidate for any."""
    rows = found[0]
    for other in found[1:]:
        rows = rows.unionByName(other)
    rank = F.coalesce(*[F.when(F.col("source") == s, n) for s, n in PRIORITY.items()], F.lit(0))
    return rows.groupBy("store_slug", "url").agg(F.max_by("source", F.struct(rank, "source")).alias("source"), F.bool_or("candidate").alias("candidate"))


def plan_crawl(urls: DataFrame, stores: DataFrame, most: int = 500, large_most: int = 250, large_from: int = 1200) -> DataFrame:
    """(store_slug, url, rank) to crawl: product URLs first, by score, then URL, up to the store's limit.

    stores: (slug, platform, has_feed). A large store without a feed gets the lower
    limit; one of the supported platform without a feed but with product URLs only those.
    """
    rows = urls.select("store_slug", "url", is_product_url(F.col("url"), True).cast("int").alias("product"), url_product_score(F.col("url")).alias("score"))
    per = rows.groupBy("store_slug").agg(F.count(F.lit(1)).alias("n"), F.sum("product").alias("n_product"))
    per = per.join(stores.select(F.col("slug").alias("store_slug"), "platform", "has_feed"), "store_slug", "left")
    no_feed = ~F.coalesce("has_feed", F.lit(False))
    limit = F.when((F.col("n") >= large_from) & no_feed, large_most).otherwise(most)
    only = (F.col("platform") == "shopify") & no_feed & (F.col("n_product") > 0)
    place = F.row_number().over(W.partitionBy("store_slug").orderBy(F.desc("product"), F.desc("score"), "url"))
    top = rows.withColumn("rank", place).where(F.col("rank") <= max(most, large_most))  # cut before the shuffle of the join
    out = top.join(per.select("store_slug", limit.alias("_limit"), F.coalesce(only, F.lit(False)).alias("_only")), "store_slug")
    return out.where((F.col("rank") <= F.col("_limit")) & (~F.col("_only") | (F.col("product") == 1))).select("store_slug", "url", "rank", "score")


def detect_platform(stores: DataFrame, feed_probes: DataFrame, home_pages: DataFrame) -> DataFrame:
    """(slug, platform): by host, else by the feed probe's body, else by markers in the home page; unknown without a page."""
    feed = feed_probes.select(F.col("store_slug").alias("slug"), F.col("body").alias("_feed"))
    home = home_pages.select(F.col("store_slug").alias("slug"), F.col("body").alias("_home"))
    both = stores.join(feed, "slug", "left").join(home, "slug", "left")
    body, page = F.lower(F.trim("_feed")), F.lower("_home")
    marked = F.lit(False)
    for m in MARKERS:
        marked = marked | F.contains(page, F.lit(m))
    platform = (
        F.when(host(F.col("url")).rlike(r"\.myshopify\.com$"), "shopify").when(F.startswith(body, F.lit("{")) & F.contains(body, F.lit('"products"')), "shopify")
        .when(page.isNull() | (page == ""), "unknown").when(marked, "shopify").otherwise("html")
    )
    return both.select("slug", platform.alias("platform"))


def classify_fetches(fetches: DataFrame, extracted: DataFrame) -> DataFrame:
    """Fetches (store_slug, url, status, content_type) with their outcome: excluded, error, indexed or crawled. extracted: (store_slug, url, n_products)."""
    both = fetches.join(extracted, ["store_slug", "url"], "left")
    html = F.contains(F.lower(F.coalesce("content_type", F.lit(""))), F.lit("html"))
    outcome = (
        F.when(F.col("status") == 304, "excluded").when(F.col("status").isNull() | ~F.col("status").between(200, 299), "error")
        .when(~html, "crawled").when(F.coalesce("n_products", F.lit(0)) > 0, "indexed").otherwise("crawled")
    )
    return both.withColumn("outcome", outcome)


def crawl_metrics(outcomes: DataFrame, discovered: DataFrame) -> DataFrame:
    """Per store: URLs discovered, those of sitemaps, attempts to crawl, and those skipped as unchanged."""
    found = discovered.groupBy("store_slug").agg(F.count(F.lit(1)).alias("discovered_urls"), F.count_if(F.col("source") == "sitemap").alias("sitemap_urls"))
    tried = outcomes.groupBy("store_slug").agg(F.count(F.lit(1)).alias("crawled_urls"), F.count_if(F.col("outcome") == "excluded").alias("skipped_unchanged"))
    return found.join(tried, "store_slug", "full").fillna(0)


def fetch_state(targets: DataFrame, products: DataFrame) -> DataFrame:
    """Targets (store_slug, url) with the etag and last_modified of the product stored there."""
    state = products.groupBy("store_slug", "url").agg(F.max_by("etag", "handle").alias("etag"), F.max_by("last_modified", "handle").alias("last_modified"))
    return targets.join(state, ["store_slug", "url"], "left")
