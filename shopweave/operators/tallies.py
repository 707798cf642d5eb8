"""Facets, totals and breakdowns kept by changes: what a product adds to each count is a row, so an old version is taken away and a new one put in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .merge import KEYS, changed_products, vanished_products

#: What is read from products.
READ = ["store_slug", "product_type", "tags", "source", "available", "variants", "is_catalog_product"]


def contributions(products: DataFrame, sign: int = 1) -> DataFrame:
    """(store_slug, kind, value, n): what each product counts for, once for each type, tag, category, source and state, and its number of variants."""
    filled = lambda c, other: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit(other))
    some = lambda c: (c.isNotNull()) & (c != "")

    def one(kind: str, value: Column, n: Column | int = 1) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"), (F.lit(n) if isinstance(n, int) else n).cast("long").alias("n"))

    state = F.when(F.col("available"), "yes").when(~F.col("available"), "no").otherwise("unknown")
    single = [
        F.when(some(F.col("product_type")), one("type", F.col("product_type"))), F.when(F.coalesce("is_catalog_product", F.lit(True)), one("catalog", F.lit(""))),
        one("category", filled("product_type", "uncategorized")), one("source", filled("source", "unknown")), one("available", state), one("variants", F.lit(""), F.greatest(F.coalesce(F.size("variants"), F.lit(0)), F.lit(0))),
    ]
    tags = F.transform(F.filter(F.coalesce("tags", F.array().cast("array<string>")), some), lambda t: one("tag", t))
    each = products.select("store_slug", F.explode(F.concat(F.array_compact(F.array(*single)), tags)).alias("c"))
    return each.select("store_slug", "c.kind", "c.value", (F.col("c.n") * sign).alias("n"))


def summed(rows: DataFrame) -> DataFrame:
    """Contributions added up; a count that has come to nothing is no row (the sum of variants aside)."""
    return rows.groupBy("store_slug", "kind", "value").agg(F.sum("n").alias("n")).where("n <> 0 or kind = 'variants'")


def changes(new: DataFrame, stored: DataFrame, gone: bool = False) -> DataFrame:
    """What an upsert of new products changes: the stored version of each changed one with a minus, the new one with a plus. gone: stored ones that new lacks are taken away too."""
    changed = changed_products(new, stored)
    old = stored.join(changed.select(*KEYS), KEYS, "left_semi").select(*READ)
    out = contributions(changed.select(*READ)).unionByName(contributions(old, -1))
    return summed(out.unionByName(contributions(vanished_products(stored, new).select(*READ), -1)) if gone else out)


def merged(tallies: DataFrame, delta: DataFrame) -> DataFrame:
    """Stored counts with a delta put in: the size of the counts, not of the catalog, is read."""
    return summed(tallies.unionByName(delta))


def type_facets(tallies: DataFrame) -> DataFrame:
    """product_type_facets() of the counts."""
    n = tallies.where("kind = 'type'").select("store_slug", F.col("value").alias("product_type"), "n")
    return n.withColumn("rank", F.row_number().over(W.partitionBy("store_slug").orderBy(F.desc("n"), "product_type")))


def top_tags(tallies: DataFrame, most: int = 25) -> DataFrame:
    n = tallies.where("kind = 'tag'").select("store_slug", F.col("value").alias("tag"), "n")
    return n.withColumn("rank", F.row_number().over(W.partitionBy("store_slug").orderBy(F.desc("n"), "tag"))).where(F.col("rank") <= most)


def totals(tallies: DataFrame) -> DataFrame:
    return tallies.where("kind = 'catalog'").select("store_slug", F.col("n").alias("total_products"))


def breakdowns(tallies: DataFrame) -> DataFrame:
    return tallies.where("kind in ('category', 'source')").select("store_slug", "kind", "value", "n")


def summary(tallies: DataFrame) -> DataFrame:
    """manifest_summary() of the counts; every product has one category."""
    of = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0).cast("long"))
    kind, value = F.col("kind"), F.col("value")
    rows = tallies.groupBy("store_slug").agg(
        of(kind == "category").alias("total_products"), of((kind == "available") & (value == "yes")).alias("available_products"),
        of((kind == "available") & (value == "no")).alias("unavailable_products"), of(kind == "variants").alias("total_variants"),
    )
    return rows.where("total_products > 0").withColumn("avg_variants", F.round(F.col("total_variants") / F.col("total_products"), 2))
