"""Feed products and raw products into the normalized schema; all column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import columns as C
from ..functions.urls import normalize_url


def feed_variant_available(v: Column) -> Column:
    """A feed variant's stock: its flag, else a positive quantity, else the policy to go on selling, else unknown."""
    quantity = F.regexp_extract(F.trim(v["inventory_quantity"]), r"^[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)", 0).try_cast("double")
    goes_on = F.when(F.lower(F.trim(v["inventory_policy"])) == "continue", True)
    return F.coalesce(C.to_bool(v["available"], "feed"), quantity > 0, goes_on)


def feed_variant_currency(v: Column) -> Column:
    """Its own currency, else that of its first presentment price."""
    presented = [F.get_json_object(v["presentment_prices"], p) for p in ("$.presentment_prices[0].price.currency_code", "$.presentment_prices.price.currency_code")]
    return F.coalesce(C.text_or_null(v["currency"]), *map(C.text_or_null, presented))


def _image(src: Column, store_url: Column) -> Column:
    """An image's URL: absolute as given, else put behind the store's."""
    return C.let(C.product_link(src, store_url), lambda link: normalize_url(F.nullif(link, F.lit(""))))


def map_feed(feed: DataFrame) -> DataFrame:
    """Feed rows (store_slug, store_url, page if there are several, pos, product) as raw products with their variants and options."""
    p, base = F.col("product"), F.col("store_url")
    text = lambda name: C.text_or_null(p[name])
    handle = text("handle")
    link = F.when(handle.isNotNull(), F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/products/"), handle)).otherwise(C.product_link(text("url"), base))
    url = C.let(link, normalize_url)
    nodes = F.coalesce(p["variants"], F.array().cast(feed.select("product.variants").dtypes[0][1]))
    rows = feed.withColumns(
        {"_nodes": F.filter(nodes, lambda v: v.isNotNull()), "_given": F.coalesce(p["options"], F.array().cast("array<struct<name:string,values:array<string>>>")), "_handle": handle}
    )
    nodes, given = F.col("_nodes"), F.col("_given")
    values = lambda v: F.array(*[C.text_or_null(v[f"option{i}"]) for i in (1, 2, 3)])
    last = lambda v: F.coalesce(*[F.when(C.text_or_null(v[f"option{i}"]).isNotNull(), i) for i in (3, 2, 1)], F.lit(0))
    used = F.coalesce(F.array_max(F.transform(nodes, last)), F.lit(0))
    rows = rows.withColumn("_count", F.greatest(F.size(given), used))
    numbers = F.when(F.col("_count") > 0, F.sequence(F.lit(1), "_count")).otherwise(F.array().cast("array<int>"))
    numbered = lambda i: F.coalesce(C.text_or_null(F.try_element_at(given, i)["name"]), F.concat(F.lit("Option "), i.cast("string")))
    rows = rows.withColumn("_names", F.transform(numbers, numbered))
    names, distinct = F.col("_names"), F.size(F.array_distinct("_names")) == F.size("_names")

    def variant(v: Column) -> Column:
        pairs = F.transform(values(v), lambda x, i: F.struct(F.try_element_at(names, i + 1).alias("key"), x.alias("value")))
        pairs = F.filter(pairs, lambda e: e["value"].isNotNull())
        out = [C.text_or_null(v[c]).alias(c) for c in ("id", "title", "sku", "price", "compare_at_price")]
        out += [feed_variant_currency(v).alias("currency"), feed_variant_available(v).cast("string").alias("available")]
        out += [C.text_or_null(v[f"option{i}"]).alias(f"option{i}") for i in (1, 2, 3)]
        by_name = C.let(pairs, lambda e: F.when(F.size(e) > 0, F.map_from_entries(F.when(distinct, e).otherwise(C.last_by_key(e)))))
        return F.struct(*out, by_name.alias("options"))

    rows = rows.withColumn("_variants", F.transform(nodes, variant))
    variants = F.col("_variants")

    def option(name: Column, i: Column) -> Column:
        of_variants = F.transform(nodes, lambda v: F.try_element_at(values(v), i + 1))
        every = F.concat(F.coalesce(F.try_element_at(given, i + 1)["values"], C.no_strings()), of_variants)
        return F.struct(name.alias("name"), C.clean_list(F.filter(F.array_distinct(every), lambda x: x.isNotNull())).alias("values"))

    options = F.filter(F.transform(names, option), lambda o: F.size(o["values"]) > 0)
    flags = F.filter(F.transform(variants, lambda v: v["available"].cast("boolean")), lambda b: b.isNotNull())
    available = C.let(flags, lambda known: F.when(F.size(known) > 0, F.exists(known, lambda b: b)).otherwise(C.to_bool(p["available"], "feed")))
    first = lambda xs: F.try_element_at(F.filter(xs, lambda x: x.isNotNull()), F.lit(1))
    images = F.transform(F.coalesce(p["images"], F.array().cast("array<struct<id:string,src:string>>")), lambda i: _image(i["src"], base))
    sources = F.filter(F.transform(nodes, lambda v: F.get_json_object(v["featured_image"], "$.src")), lambda src: src.isNotNull())
    of_variants = F.transform(sources, lambda src: _image(src, base))
    own_image = F.coalesce(F.get_json_object(p["image"], "$.src"), F.when(~F.startswith(F.ltrim(p["image"]), F.lit("{")), p["image"]))
    return rows.select(
        "store_slug", "store_url", (F.col("page") if "page" in feed.columns else F.lit(0)).cast("long").alias("page"), "pos", text("id").alias("id"), url.alias("url"), text("title").alias("title"), handle.alias("handle"), C.html_to_text(p["body_html"]).alias("description"),
        text("vendor").alias("brand"), text("vendor").alias("vendor"), text("product_type").alias("product_type"),
        F.coalesce(_image(own_image, base), first(images), first(of_variants)).alias("image_url"), C.parse_tags(p["tags"]).alias("tags"),
        F.try_element_at(variants, F.lit(1))["price"].alias("price"), F.try_element_at(variants, F.lit(1))["currency"].alias("currency"), available.cast("string").alias("availability"),
        variants.alias("variants"), options.alias("options"), F.lit("shopify_json").alias("source"), F.lit(None).cast("string").alias("etag"), F.lit(None).cast("string").alias("last_modified"),
    )


def normalized_variant(v: Column) -> Column:
    return F.struct(
        C.text_or_null(v["id"]).alias("id"), C.text_or_null(v["title"]).alias("title"), C.text_or_null(v["sku"]).alias("sku"), C.to_cents(v["price"]).alias("price_cents"),
        C.to_cents(v["compare_at_price"]).alias("compare_at_cents"), F.upper(C.text_or_null(v["currency"])).alias("currency"), C.to_available(v["available"]).alias("available"),
        C.variant_options(v["options"], F.array(v["option1"], v["option2"], v["option3"]), True).alias("options"),
    )


def normalize_products(raw: DataFrame) -> DataFrame:
    """Raw products (with store_slug and store_url) as normalized ones. Rows without a title or a valid URL are dropped.

    Extra columns stay. Prices come from the variants, else from the product; stock from
    the product, else from any variant, else it is assumed.
    """
    return with_derived(normalize_fields(raw))


def normalize_fields(raw: DataFrame) -> DataFrame:
    """normalize_products without the columns of with_derived: all that dedup asks for."""
    col = F.col
    text = lambda name: C.text_or_null(col(name))
    link = C.product_link(F.coalesce(text("url"), col("store_url")), col("store_url"))
    rows = raw.withColumns({"title": text("title"), "url": C.let(link, normalize_url), "_raw_handle": text("handle"), "_raw_id": text("id"), "_own": C.to_available(col("availability")), "_price": C.to_cents(col("price"))})
    rows = rows.where("title is not null and url is not null")
    rows = rows.withColumn("variants", F.transform(F.coalesce("variants", F.array().cast(dict(raw.dtypes)["variants"])), normalized_variant))
    prices = F.filter(F.transform("variants", lambda v: v["price_cents"]), lambda x: x.isNotNull())
    flags = F.filter(F.transform("variants", lambda v: v["available"]), lambda x: x.isNotNull())
    currencies = F.filter(F.transform("variants", lambda v: v["currency"]), lambda x: x.isNotNull())
    option = lambda o: F.struct(F.trim(o["name"]).alias("name"), F.filter(F.transform(F.coalesce(o["values"], C.no_strings()), lambda x: F.trim(x)), lambda x: x != "").alias("values"))
    rows = rows.withColumns(
        {
            "handle": C.derive_handle(col("_raw_handle"), col("url"), col("title")),
            "price_min": F.coalesce(F.array_min(prices), "_price"), "price_max": F.coalesce(F.array_max(prices), "_price"),
            "available": F.coalesce("_own", C.let(flags, lambda known: F.when(F.size(known) > 0, F.exists(known, lambda x: x))), F.lit(True)),
            "currency": F.coalesce(F.upper(text("currency")), F.try_element_at(currencies, F.lit(1))),
            "description": text("description"), "brand": text("brand"), "vendor": F.coalesce(text("vendor"), text("brand")), "product_type": text("product_type"),
            "image_url": _image(text("image_url"), F.regexp_extract("url", "^https?://[^/?#]+", 0)), "tags": C.clean_list(col("tags")),
            "options": F.filter(F.transform(F.coalesce("options", F.array().cast("array<struct<name:string,values:array<string>>>")), option), lambda o: o["name"] != ""),
            "source": F.coalesce(text("source"), F.lit("html")), "etag": text("etag"), "last_modified": text("last_modified"),
        }
    )
    rows = rows.withColumn("product_id", C.derive_product_id(col("_raw_id"), col("handle"), col("url")))
    return rows.drop("_raw_handle", "_raw_id", "_own", "_price", "id", "price", "availability")


def with_derived(rows: DataFrame) -> DataFrame:
    """Normalized products with tokens, texts, flag and hash, which their other columns alone decide."""
    col = F.col
    rows = rows.withColumn("option_tokens", C.option_tokens(col("tags"), col("options"), col("variants"), col("title"), col("product_type")))
    rows = rows.withColumns(
        {
            "search_text": C.search_text(*map(col, ("title", "handle", "description", "brand", "vendor", "product_type", "tags"))),
            "is_catalog_product": C.is_catalog_product(*map(col, ("url", "variants", "price_min", "price_max"))),
            "summary_short": C.summary_short(*map(col, ("title", "product_type", "tags", "price_min", "price_max", "available"))),
        }
    )
    blank = lambda name: F.coalesce(col(name), F.lit("")).alias(name)
    fields = {c: col(c) for c in ("title", "handle", "url")} | {c: blank(c) for c in ("description", "product_type")}
    fields |= {c: col(c) for c in ("tags", "price_min", "price_max", "available", "variants", "options", "option_tokens")}
    return rows.withColumn("content_hash", C.content_hash(**fields))
