"""The three workloads, from sources to results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import baskets as B, catalog, dedup, discovery, extract, feeds, merge, search

RAW_COLUMNS = ["store_slug", "store_url", "id", "url", "title", "handle", "description", "brand", "vendor", "product_type", "image_url", "tags", "price", "currency", "availability", "variants", "options", "source", "etag", "last_modified", "seq"]


def raw_candidates(feed: DataFrame | None, pages: DataFrame | None) -> DataFrame:
    """Raw products of feeds and pages with their order: feeds by page and place first, then pages by plan rank and place.

    pages may have the `rank` of plan_crawl; those without one come last, by URL. seq is a
    struct, so that no page or place runs into the next one.
    """
    found = []
    if feed is not None:
        found.append(feeds.map_feed(feed).withColumn("seq", _order(F.lit(False), "page", F.lit(""), "pos")))
    if pages is not None:
        ranked = pages if "rank" in pages.columns else pages.withColumn("rank", F.lit(None).cast("long"))
        rows = extract.extract_products(ranked)
        rows = rows.withColumn("seq", _order(F.lit(True), F.coalesce(F.col("rank").cast("long"), F.lit((1 << 62))), F.col("page_url"), "pos"))
        found.append(rows.withColumn("options", F.array().cast("array<struct<name:string,values:array<string>>>")))
    out = found[0].select(*RAW_COLUMNS)
    for other in found[1:]:
        out = out.unionByName(other.select(*RAW_COLUMNS))
    return out


def _order(from_page: Column, rank: Column | str, page_url: Column, pos: str) -> Column:
    return F.struct(from_page.alias("from_page"), (F.col(rank) if isinstance(rank, str) else rank).alias("rank"), page_url.alias("page_url"), F.col(pos).cast("long").alias("pos"))


def refresh_catalog(stored: DataFrame, feed: DataFrame | None = None, pages: DataFrame | None = None, force: bool = False) -> DataFrame:
    """The catalog after a run: candidates normalized, dedupped, compared by hash, upserted. The stored columns decide the schema.

    What only follows from a record's other columns is worked out for the records that are left.
    """
    new = feeds.with_derived(dedup.dedup(feeds.normalize_fields(raw_candidates(feed, pages))))
    return merge.upsert_products(stored, merge.changed_products(new, stored, force))


def crawl_targets(sources: list[DataFrame], stores: DataFrame, products: DataFrame) -> DataFrame:
    """What to fetch, in which order, with the validators of what is stored."""
    plan = discovery.plan_crawl(discovery.merge_discovered(*sources), stores)
    return discovery.fetch_state(plan, products)


def ranked_search(products: DataFrame, queries: DataFrame, stores: DataFrame) -> DataFrame:
    """Search results of all queries; those without a store are routed to one first. Results are capped in size."""
    routed = search.route_queries(queries.where("store_slug is null"), products, stores).select("query_id", F.col("store_slug").alias("_slug"))
    asked = queries.join(routed, "query_id", "left").withColumn("store_slug", F.coalesce("store_slug", "_slug")).drop("_slug")
    return search.cap_payload(search.search_v2(products, asked, stores))


def checkout(events: DataFrame, baskets: DataFrame, stores: DataFrame) -> DataFrame:
    """Totals and checkout links of all baskets after their logs. baskets: (basket_id, store_slug, status)."""
    good = B.validate_events(events, baskets).where("reason is null").drop("reason")
    platforms = baskets.join(stores.select(F.col("slug").alias("store_slug"), "platform", F.col("url").alias("store_url")), "store_slug", "left")
    lines = B.fold_baskets(good, platforms).withColumn("added_at", F.col("added_seq")).drop("status", "closed_seq")
    return B.checkout_links(B.basket_totals(platforms, lines))


def store_report(products: DataFrame, crawl_urls: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(manifest, its summary per store, its breakdowns)."""
    rows = catalog.manifest(products, crawl_urls)
    return rows, catalog.manifest_summary(rows), catalog.breakdowns(rows)
