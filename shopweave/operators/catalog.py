"""Filters, lookups, variant choice, facets, manifests, store lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import last_by_key, no_strings, product_link, summary_short
from ..functions.urls import normalize_url


def normal_options(options: Column) -> Column:
    """Option map as trimmed lower-case (key, value) entries without blanks; of keys that become alike the last counts."""
    entries = F.transform(F.coalesce(F.map_entries(options), F.array()), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), F.lower(F.trim(e["value"])).alias("value")))
    return last_by_key(F.filter(entries, lambda e: (e["key"] != "") & (e["value"] != "")))


def has_options(variant_options: Column, wanted: Column) -> Column:
    """Whether a variant has every wanted option, ignoring case."""
    return F.size(F.array_except(normal_options(wanted), normal_options(variant_options))) == 0


def is_available(variant: Column) -> Column:
    return F.coalesce(variant["available"], F.lit(False))


def filter_products(
    products: DataFrame, product_type: str | None = None, tags: Sequence[str] = (), price_min: int | None = None, price_max: int | None = None, available_only: bool = False,
    product_ids: Sequence[str] = (), options: Mapping[str, str] | None = None, limit: int = 20,
) -> DataFrame:
    """The first `limit` (1 to 100) products by id of each store that meet all criteria; options must meet in one variant."""
    out = products
    if product_type:
        out = out.where(F.lower("product_type") == product_type.strip().lower())
    if tags:
        out = out.where(F.size(F.array_except(F.array(*map(F.lit, tags)), F.coalesce("tags", no_strings()))) == 0)
    if price_min is not None:
        out = out.where(F.coalesce("price_max", "price_min", F.lit(0)) >= price_min)
    if price_max is not None:
        out = out.where(F.coalesce("price_min", "price_max", F.lit(0)) <= price_max)
    if product_ids:
        out = out.where(F.col("product_id").isin(list(product_ids)))
    if options:
        wanted = F.create_map(*[F.lit(x) for kv in options.items() for x in kv])
        fits = lambda v: has_options(v["options"], wanted) & (is_available(v) if available_only else F.lit(True))
        out = out.where(F.exists("variants", fits))
    elif available_only:
        out = out.where("available")
    rank = F.row_number().over(W.partitionBy("store_slug").orderBy("product_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= max(1, min(100, limit)))


def lookup_products(requests: DataFrame, products: DataFrame, brief: bool = False) -> DataFrame:
    """Each request (request_id, store_slug, handle) with its product, or found = false."""
    found = products.withColumn("found", F.lit(True))
    if brief:
        found = product_summary(products).select("store_slug", "handle", "title", "price_min", "price_max", "available", "variant_count", "summary_short", F.lit(True).alias("found"))
    return requests.join(found, ["store_slug", "handle"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def fetch_by_ids(ids: DataFrame, products: DataFrame) -> DataFrame:
    """The catalog products of the given (store_slug, product_id) rows, each once."""
    return products.where(F.coalesce("is_catalog_product", F.lit(True))).join(ids.select("store_slug", "product_id"), ["store_slug", "product_id"], "left_semi")


def check_variants(requests: DataFrame, products: DataFrame) -> DataFrame:
    """Each request (request_id, store_slug, handle, options) with the first variant that has its options."""
    both = requests.withColumnRenamed("options", "_wanted").join(products.select("store_slug", "handle", "variants"), ["store_slug", "handle"], "left")
    first = F.try_element_at(F.filter(F.coalesce("variants", F.array().cast(dict(products.dtypes)["variants"])), lambda v: has_options(v["options"], F.col("_wanted"))), F.lit(1))
    both = both.withColumn("_v", first)
    return both.select(
        "request_id", F.col("variants").isNotNull().alias("found"), F.col("_v").isNotNull().alias("matched"), F.coalesce(F.col("_v.available"), F.lit(False)).alias("available"),
        F.col("_v.id").alias("variant_id"), F.coalesce(F.col("_v.price_cents"), F.lit(0).cast("long")).alias("price"),
    )


def resolve_variants(requests: DataFrame, products: DataFrame) -> DataFrame:
    """Each request (request_id, store_slug, handle, variant_id, options) with the variant that goes to a basket, or why there is none.

    By id; else by options; else the only available one; else the only one.
    """
    both = requests.withColumnsRenamed({"options": "_wanted", "variant_id": "_id"}).join(products.select("store_slug", "handle", "variants", F.col("price_min").alias("product_price"), "title", "url"), ["store_slug", "handle"], "left")
    v, asked = F.col("variants"), F.trim(F.coalesce("_id", F.lit("")))
    first = lambda xs: F.try_element_at(xs, F.lit(1))
    stocked = F.filter(v, is_available)
    wants = F.size(normal_options(F.col("_wanted"))) > 0
    chosen = (
        F.when(asked != "", first(F.filter(v, lambda x: x["id"] == asked)))
        .when(wants, first(F.filter(v, lambda x: has_options(x["options"], F.col("_wanted")))))
        .when(F.size(stocked) == 1, first(stocked)).when(F.size(v) == 1, first(v))
    )
    both = both.withColumn("variant", chosen)
    reason = (
        F.when(v.isNull(), "product_not_found").when(F.size(v) == 0, "no_variants").when(F.col("variant").isNotNull(), None)
        .when(asked != "", "variant_not_found").when(wants, "options_not_found").otherwise("variant_selection_required")
    )
    keep = [c for c in requests.columns if c not in ("options", "variant_id")]
    return both.select(*keep, "variant", reason.alias("reason"), "product_price", "title", "url")


def list_products(products: DataFrame, limit: int, offset: int = 0, price_min: int | None = None, price_max: int | None = None) -> DataFrame:
    """A page of each store's products, newest first."""
    price = F.coalesce("price_min", "price_max")
    out = products.withColumn("price", price)
    if price_min is not None:
        out = out.where(F.col("price") >= price_min)
    if price_max is not None:
        out = out.where(F.col("price") <= price_max)
    rank = F.row_number().over(W.partitionBy("store_slug").orderBy(F.desc("updated_at"), "product_id"))
    return out.withColumn("rank", rank).where((F.col("rank") > offset) & (F.col("rank") <= offset + limit))


def product_summary(products: DataFrame, stores: DataFrame | None = None) -> DataFrame:
    """Products with the serving columns: prices widened by the variants', availability of any variant, variant count, link, summary."""
    v = F.coalesce("variants", F.array().cast(dict(products.dtypes)["variants"]))
    prices = F.filter(F.transform(v, lambda x: x["price_cents"]), lambda x: x.isNotNull())
    out = products
    if stores is not None:
        out = out.join(stores.select(F.col("slug").alias("store_slug"), F.col("url").alias("_store_url")), "store_slug", "left")
    link = product_link(F.col("url"), F.col("_store_url") if stores is not None else F.lit(None).cast("string"))
    available = F.when(F.size(v) > 0, F.exists(v, is_available)).otherwise(F.coalesce("available", F.lit(False)))
    fallback = summary_short(F.coalesce("title", F.lit("Product")), F.col("product_type"), None, F.col("price_min"), F.col("price_max"), F.coalesce("available", F.lit(False)))
    line = F.trim(F.coalesce(*[F.nullif(c, F.lit("")) for c in ("summary_llm", "summary_short") if c in products.columns], fallback))
    return out.withColumns(
        {
            "price_min": F.least("price_min", F.array_min(prices)), "price_max": F.greatest("price_max", F.array_max(prices)), "available": available,
            "variant_count": F.size(v), "link": link, "summary_short": line,
        }
    ).drop("_store_url")


def available_options(variants: Column) -> Column:
    """(name, values) of the options of available variants, values sorted and distinct, by name; no shuffle."""
    pairs = F.flatten(F.transform(F.filter(variants, is_available), lambda v: F.coalesce(F.map_entries(v["options"]), F.array())))
    pairs = F.transform(pairs, lambda e: F.struct(F.trim(e["key"]).alias("key"), F.trim(e["value"]).alias("value")))
    pairs = F.array_sort(F.array_distinct(F.filter(pairs, lambda e: (e["key"] != "") & (e["value"] != ""))))
    names = F.array_distinct(F.transform(pairs, lambda e: e["key"]))
    return F.transform(names, lambda n: F.struct(n.alias("name"), F.transform(F.filter(pairs, lambda e: e["key"] == n), lambda e: e["value"]).alias("values")))


def _named(options: Column, names: Sequence[str]) -> Column:
    """The entries of these names, in their order."""
    one = lambda n: F.filter(options, lambda o: (o["name"] == n) & (F.size(o["values"]) > 0))
    return F.flatten(F.array(*map(one, names)))


PREFERRED = ("Shade", "Color")  # fixed values: options shown and recommended first


def option_preview(options: Column, most: int = 6) -> Column:
    """Shade and Color, else the first option, with at most `most` values; the last one says how many more."""
    best = _named(options, PREFERRED)
    shown = F.when(F.size(best) > 0, best).otherwise(F.slice(options, 1, 1))

    def clip(o: Column) -> Column:
        n = F.size(o["values"])
        if most <= 1:
            cut = F.array(F.concat(F.lit("+"), n.cast("string"), F.lit(" options")))
        else:
            cut = F.concat(F.slice(o["values"], 1, most - 1), F.array(F.concat(F.lit("+"), (n - (most - 1)).cast("string"), F.lit(" more"))))
        return F.struct(o["name"].alias("name"), F.when(n <= most, o["values"]).otherwise(cut).alias("values"))

    return F.transform(shown, clip)


def _tone_values(options: Column, tones: Column) -> Column:
    """(name, value) of Shade and Color values with a tone's word in them."""
    pairs = F.flatten(F.transform(_named(options, PREFERRED), lambda o: F.transform(o["values"], lambda v: F.struct(o["name"].alias("name"), v.alias("value")))))
    return F.filter(pairs, lambda p: F.exists(tones, lambda t: F.contains(F.lower(p["value"]), t)))


def recommended_option(options: Column, tones: Column) -> Column:
    """The first (name, value) that speaks for the tone, or null."""
    return F.try_element_at(_tone_values(options, tones), F.lit(1))


def tone_matches(options: Column, tones: Column, most: int = 3) -> Column:
    return F.slice(F.transform(_tone_values(options, tones), lambda p: F.concat(p["name"], F.lit(": "), p["value"])), 1, most)


def product_type_facets(products: DataFrame) -> DataFrame:
    """Products per store and type, with their place by count, then name."""
    n = products.where("product_type is not null and product_type <> ''").groupBy("store_slug", "product_type").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rank", F.row_number().over(W.partitionBy("store_slug").orderBy(F.desc("n"), "product_type")))


def top_tags(products: DataFrame, n: int = 25) -> DataFrame:
    """The n most used tags of each store."""
    tags = products.select("store_slug", F.explode("tags").alias("tag")).where("tag is not null and tag <> ''").groupBy("store_slug", "tag").agg(F.count(F.lit(1)).alias("n"))
    return tags.withColumn("rank", F.row_number().over(W.partitionBy("store_slug").orderBy(F.desc("n"), "tag"))).where(F.col("rank") <= n)


def catalog_totals(products: DataFrame) -> DataFrame:
    return products.where(F.coalesce("is_catalog_product", F.lit(True))).groupBy("store_slug").agg(F.count(F.lit(1)).alias("total_products"))


def manifest(products: DataFrame, crawl_urls: DataFrame) -> DataFrame:
    """One row per product: category, variant count, source, and whether an external search has found its URL."""
    outside = crawl_urls.where("external_discovered").select("store_slug", F.col("url_norm").alias("_url")).distinct().withColumn("_hit", F.lit(True))
    rows = products.withColumn("_url", F.coalesce(normalize_url(F.col("url")), F.col("url"))).join(outside, ["store_slug", "_url"], "left")
    blank = lambda c, other: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit(other)).alias(c)
    return rows.select(
        "store_slug", "product_id", "title", "handle", blank("product_type", "uncategorized").alias("category"), "price_min", "price_max", "available",
        F.greatest(F.coalesce(F.size("variants"), F.lit(0)), F.lit(0)).alias("variant_count"), blank("source", "unknown"), "url", F.coalesce("_hit", F.lit(False)).alias("external_match"),
    )


def manifest_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("store_slug").agg(
        F.count(F.lit(1)).alias("total_products"), F.count_if(F.col("available")).alias("available_products"), F.count_if(~F.col("available")).alias("unavailable_products"),
        F.sum("variant_count").alias("total_variants"), F.round(F.avg("variant_count"), 2).alias("avg_variants"),
    )


def breakdowns(rows: DataFrame) -> DataFrame:
    """Products per store by category and by source, in one pass."""
    one = F.explode(F.array(F.struct(F.lit("category").alias("kind"), F.col("category").alias("value")), F.struct(F.lit("source").alias("kind"), F.col("source").alias("value"))))
    return rows.select("store_slug", one.alias("k")).groupBy("store_slug", "k.kind", "k.value").agg(F.count(F.lit(1)).alias("n"))


def external_coverage(external: DataFrame, products: DataFrame) -> DataFrame:
    """Each distinct external (store_slug, url_norm), matched to a product's URL or not."""
    own = products.select("store_slug", "url_norm").distinct().withColumn("_hit", F.lit(True))
    found = external.select("store_slug", "url_norm").distinct().join(own, ["store_slug", "url_norm"], "left")
    return found.select("store_slug", "url_norm", F.coalesce("_hit", F.lit(False)).alias("matched"))


def external_counts(external: DataFrame, products: DataFrame) -> DataFrame:
    rows = external_coverage(external, products)
    return rows.groupBy("store_slug").agg(F.count(F.lit(1)).alias("discovered"), F.count_if("matched").alias("matched"), F.count_if(~F.col("matched")).alias("unmatched"))


# fixed values: groups of a run's status, tried in this order
STATUS_GROUPS = [("ok", "done|ready|complete|indexed|success"), ("error", "fail|error|invalid"), ("warn", "queue|pending|crawl|running|index")]


def status_group(status: Column) -> Column:
    low = F.lower(F.coalesce(status, F.lit("")))
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in STATUS_GROUPS:
        out = out.when(low.rlike(pattern), name)
    return out.otherwise("neutral")


def status_tally(rows: DataFrame) -> DataFrame:
    return rows.groupBy(status_group(F.col("status")).alias("status_group")).agg(F.count(F.lit(1)).alias("n"))


def stores_with_latest_run(stores: DataFrame, runs: DataFrame) -> DataFrame:
    """Every store with its latest run by start, then id. Partial aggregation: no window over a store's runs."""
    last = runs.groupBy("store_slug").agg(F.max_by(F.struct("id", "status", "error", "started_at", "finished_at", "stats"), F.struct("started_at", "id")).alias("run"))
    both = stores.join(last, stores.slug == last.store_slug, "left").drop("store_slug")
    state = F.coalesce(F.col("run.status"), F.when(F.col("last_error").isNotNull(), "failed").otherwise("completed"))
    return both.withColumn("state", state)


def list_stores(stores: DataFrame, order: str = "size", limit: int | None = None, offset: int = 0) -> DataFrame:
    """Stores by size (products, then last indexed, nulls last) or touched (last change)."""
    by = [F.desc("product_count"), F.desc_nulls_last("indexed_at"), F.col("slug")] if order == "size" else [F.desc_nulls_last("touched_at"), F.col("slug")]
    out = stores.orderBy(*by)
    if offset:
        out = out.offset(offset)
    if limit is not None:
        out = out.limit(limit)
    return out


def store_total(stores: DataFrame) -> DataFrame:
    """(total): how many stores a paged list is of."""
    return stores.agg(F.count(F.lit(1)).alias("total"))
