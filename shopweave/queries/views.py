"""Catalog tables made from the test tables, in Spark and in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import columns as C


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units(cents: Column) -> Column:
    """Cents as the text of currency units with two decimals."""
    return F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def variant_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per variant of a part: a line's identity, price, stock and options."""
    line = table(spark, sf_dir, "lineitem")
    size = F.element_at(F.array(F.lit("S"), F.lit("M"), F.lit("L")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    return line.groupBy("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey").agg(
        F.min(F.round(F.col("l_extendedprice") / F.col("l_quantity") * 100)).cast("long").alias("price_cents"),
        F.max((F.col("l_quantity") >= 46) & (F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O")).alias("available"),
    ).select("l_partkey", F.concat_ws("-", "l_partkey", "l_orderkey", "l_linenumber", "l_suppkey").alias("id"), "price_cents", "available", size.alias("size"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog: a product per part, its variants in a nested column ordered by id."""
    part = table(spark, sf_dir, "part")
    color = F.split("p_name", " ")[0]
    variant = F.struct(
        "id", F.concat(F.col("size"), F.lit(" variant")).alias("title"), F.lit(None).cast("string").alias("sku"), "price_cents", F.lit(None).cast("long").alias("compare_at_cents"),
        F.lit("USD").alias("currency"), "available", "size",
    )
    grouped = variant_rows(spark, sf_dir).groupBy("l_partkey").agg(F.sort_array(F.collect_list(variant)).alias("v"))
    rows = part.join(grouped, F.col("p_partkey") == F.col("l_partkey"))
    with_options = F.transform(
        "v",
        lambda v: F.struct(
            v["id"].alias("id"), v["title"].alias("title"), v["sku"].alias("sku"), v["price_cents"].alias("price_cents"), v["compare_at_cents"].alias("compare_at_cents"),
            v["currency"].alias("currency"), v["available"].alias("available"), F.create_map(F.lit("Size"), v["size"], F.lit("Color"), color).alias("options"),
        ),
    )
    store = F.lower(F.replace("p_brand", F.lit("#"), F.lit("-")))
    prices = F.transform("v", lambda v: v["price_cents"])
    rows = rows.select(
        F.col("p_partkey"), store.alias("store_slug"), F.col("p_partkey").cast("string").alias("product_id"), F.col("p_name").alias("title"), F.col("p_type").alias("product_type"), F.col("p_brand").alias("vendor"),
        F.concat(F.translate("p_name", " ", "-"), F.lit("-"), F.col("p_partkey").cast("string")).alias("handle"),
        F.concat(F.split("p_name", " "), F.array(F.concat(F.lit("size-"), F.col("p_size").cast("string")))).alias("tags"),
        F.array_min(prices).alias("price_min"), F.array_max(prices).alias("price_max"), F.exists("v", lambda v: v["available"]).alias("available"), with_options.alias("variants"),
        F.array(F.struct(F.lit("Size").alias("name"), F.array(F.lit("S"), F.lit("M"), F.lit("L")).alias("values")), F.struct(F.lit("Color").alias("name"), F.array(color).alias("values"))).alias("options"),
    )
    return rows.withColumn("url", F.concat(F.lit("https://"), "store_slug", F.lit(".example.com/products/"), "handle"))


def full_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """products with the derived columns of the stored schema."""
    p = products(spark, sf_dir)
    col = F.col
    p = p.withColumn("option_tokens", C.option_tokens(col("tags"), col("options"), col("variants"), col("title"), col("product_type")))
    p = p.withColumn("search_text", C.search_text(col("title"), col("handle"), F.lit(None), F.lit(None), col("vendor"), col("product_type"), col("tags")))
    p = p.withColumn("summary_short", C.summary_short(col("title"), col("product_type"), col("tags"), col("price_min"), col("price_max"), col("available")))
    return p.withColumns({"summary_llm": F.lit(None).cast("string"), "source": F.lit("shopify_json"), "is_catalog_product": F.lit(True), "description": F.lit(None).cast("string"), "currency": F.lit("USD")})


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").join(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct(), "p_partkey", "left_semi")
    number = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int")
    rows = part.groupBy(F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))).alias("slug"), number.alias("number")).agg(F.count(F.lit(1)).alias("product_count"))
    at = F.when(F.col("number") % 7 != 0, F.timestamp_add("DAY", F.col("number"), F.lit("2024-01-01 00:00:00").cast("timestamp")))
    return rows.select(
        "slug", "number", F.concat(F.lit("https://"), "slug", F.lit(".example.com")).alias("url"), "product_count",
        F.when(F.col("number") % 2 == 0, "shopify").otherwise("html").alias("platform"), at.alias("indexed_at"),
    )


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "checked_out").otherwise("active")
    return o.select(F.col("o_orderkey").cast("string").alias("basket_id"), status.alias("status"), F.when(F.col("o_orderkey") % 2 == 0, "shopify").otherwise("html").alias("platform"), F.lit("https://shop.example.com/").alias("store_url"))


def basket_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    price = F.round(F.col("l_extendedprice") / F.col("l_quantity") * 100).cast("long")
    return line.groupBy(F.col("l_orderkey").cast("string").alias("basket_id"), F.col("l_partkey").cast("string").alias("variant_id")).agg(
        F.max(price).alias("unit_price"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.min("l_shipdate").alias("added_at")
    )


def basket_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basket_events_of(table(spark, sf_dir, "events"))


def basket_events_of(e: DataFrame) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    op = F.when(kind.isin("purchase", "view"), "add").when(kind == "click", "set").when(kind == "signup", "remove").when(value < 5, "clear").otherwise("checkout")
    quantity = F.when(kind == "purchase", 1 + F.floor(value) % 5).when(kind == "view", 1).when(kind == "click", F.floor(value) % 4)
    variant = F.get_json_object("props", "$.k").cast("long") % 10
    return e.select(
        F.col("user_id").cast("string").alias("basket_id"), F.col("event_id").alias("seq"), op.alias("op"), variant.cast("string").alias("variant_id"), quantity.cast("long").alias("quantity"),
        (100 + variant * 10).alias("unit_price"), (F.col("event_id") % 50 == 0).alias("mark"),
    )


#: The same tables for DuckDB, to stand before a query as "with ...".
SQL_VARIANTS = """variants as (
  select l_partkey as partkey, l_partkey || '-' || l_orderkey || '-' || l_linenumber || '-' || l_suppkey as id,
    min(round(l_extendedprice / l_quantity * 100))::bigint as price_cents, max((l_quantity >= 46 and l_returnflag = 'N' and l_linestatus = 'O')::int) = 1 as available,
    ['S', 'M', 'L'][l_linenumber % 3 + 1] as size
  from lineitem group by l_partkey, l_orderkey, l_linenumber, l_suppkey)"""
SQL_PRODUCTS = (
    SQL_VARIANTS
    + """, of_part as (select partkey, min(price_cents) as price_min, max(price_cents) as price_max, max(available::int) = 1 as available, count(*) as n_variants from variants group by partkey),
products as (
  select p_partkey as partkey, lower(replace(p_brand, '#', '-')) as store_slug, p_partkey::varchar as product_id, p_name as title, p_type as product_type, p_brand as vendor,
    replace(p_name, ' ', '-') || '-' || p_partkey as handle, list_append(string_split(p_name, ' '), 'size-' || p_size) as tags, price_min, price_max, available, n_variants,
    'https://' || lower(replace(p_brand, '#', '-')) || '.example.com/products/' || replace(p_name, ' ', '-') || '-' || p_partkey as url, string_split(p_name, ' ')[1] as color
  from part join of_part on p_partkey = of_part.partkey)"""
)
SQL_STORES = (
    SQL_PRODUCTS
    + """, stores as (
  select store_slug as slug, regexp_extract(vendor, '([0-9]+)', 1)::int as number, 'https://' || store_slug || '.example.com' as url, count(*) as product_count,
    case when regexp_extract(vendor, '([0-9]+)', 1)::int % 2 = 0 then 'shopify' else 'html' end as platform,
    case when regexp_extract(vendor, '([0-9]+)', 1)::int % 7 <> 0 then timestamp '2024-01-01' + regexp_extract(vendor, '([0-9]+)', 1)::int * interval 1 day end as indexed_at
  from products group by store_slug, vendor)"""
)
SQL_BASKETS = """baskets as (
  select o_orderkey::varchar as basket_id, case when o_orderstatus = 'F' then 'checked_out' else 'active' end as status,
    case when o_orderkey % 2 = 0 then 'shopify' else 'html' end as platform, 'https://shop.example.com/' as store_url from orders),
basket_items as (
  select l_orderkey::varchar as basket_id, l_partkey::varchar as variant_id, max(round(l_extendedprice / l_quantity * 100)::bigint) as unit_price, sum(l_quantity::bigint)::bigint as quantity, min(l_shipdate) as added_at
  from lineitem group by 1, 2)"""
SQL_EVENTS = """log as (
  select user_id::varchar as basket_id, event_id as seq,
    case when event_type in ('purchase', 'view') then 'add' when event_type = 'click' then 'set' when event_type = 'signup' then 'remove' when value < 5 then 'clear' else 'checkout' end as op,
    (json_extract_string(props, '$.k')::bigint % 10)::varchar as variant_id,
    case when event_type = 'purchase' then 1 + floor(value)::bigint % 5 when event_type = 'view' then 1 when event_type = 'click' then floor(value)::bigint % 4 end::bigint as quantity,
    100 + json_extract_string(props, '$.k')::bigint % 10 * 10 as unit_price, event_id % 50 = 0 as mark
  from events)"""
