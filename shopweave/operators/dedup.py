"""Best record per product, duplicate reports, catalog split.

Best records come from max_by over a struct: partial aggregation keeps a hot key, such
as a default handle, from gathering in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import text_or_null
from ..functions.urls import normalize_url


def record_score() -> Column:
    """1 each for a price, a description, an image, variants; 2 for the feed as source."""
    points = [
        (F.col("price_min").isNotNull() | F.col("price_max").isNotNull(), 1), (text_or_null(F.col("description")).isNotNull(), 1), (text_or_null(F.col("image_url")).isNotNull(), 1),
        (F.coalesce(F.size("variants"), F.lit(0)) > 0, 1), (F.col("source") == "shopify_json", 2),
    ]
    return sum((F.when(test, n).otherwise(0) for test, n in points[1:]), F.when(points[0][0], points[0][1]).otherwise(0))


def _low(name: str) -> Column:
    return F.lower(text_or_null(F.col(name)))


def url_key() -> Column:
    return F.lower(F.coalesce(normalize_url(F.col("url")), F.col("url")))


def id_key() -> Column:
    """Key of a record: its product id in lower case; its handle, then its URL, where there is none."""
    named = [F.concat(F.lit("id:"), _low("product_id")), F.concat(F.lit("handle:"), _low("handle"))]
    return F.coalesce(*named, F.concat(F.lit("url:"), url_key()))


def handle_key() -> Column:
    named = [F.concat(F.lit("handle:"), _low("handle")), F.concat(F.lit("id:"), _low("product_id"))]
    return F.coalesce(*named, F.concat(F.lit("url:"), url_key()))


def _best(df: DataFrame, key: Column, order: list[str], seq: str) -> DataFrame:
    """One row per store and key: the greatest by `order`; first_seq is the least seq of the key."""
    row = F.struct(*[c for c in df.columns if c not in ("first_seq", "_score")])
    best = df.groupBy("store_slug", key.alias("_key")).agg(F.max_by(row, F.struct(*order)).alias("_row"), F.min(seq).alias("_first"))
    return best.select("_row.*", F.col("_first").alias("first_seq"))


def dedup_by_id(df: DataFrame) -> DataFrame:
    """Best record per product id key: highest score, of equal ones the last seen."""
    scored = df.withColumn("_score", record_score())
    return _best(scored, id_key(), ["_score", "seq"], "seq")


def dedup_by_handle(df: DataFrame) -> DataFrame:
    """Best record per handle key of dedup_by_id's result: highest score, of equal ones that whose id was first seen last."""
    scored = df.withColumn("_score", record_score()).withColumn("_first_seen", F.col("first_seq"))
    return _best(scored, handle_key(), ["_score", "_first_seen", "seq"], "_first_seen").drop("_first_seen")


def dedup(df: DataFrame) -> DataFrame:
    return dedup_by_handle(dedup_by_id(df)).drop("first_seq")


def _keys(df: DataFrame) -> DataFrame:
    """(store_slug, kind, value): each record under its map key, handle, id and URL."""
    pairs = [("map_key", id_key()), ("handle", _low("handle")), ("product_id", text_or_null(F.col("product_id"))), ("url", url_key())]
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in pairs])
    return df.select("store_slug", F.explode(kinds).alias("k")).select("store_slug", "k.kind", "k.value").where("value is not null")


def duplicate_counts(df: DataFrame) -> DataFrame:
    return _keys(df).groupBy("store_slug", "kind", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def dedup_report(df: DataFrame) -> DataFrame:
    """Per store: raw records, unique ones by id and in the end, dropped ones, and how many values of each kind are repeated."""
    twice = duplicate_counts(df).groupBy("store_slug").agg(*[F.count_if(F.col("kind") == k).alias(f"duplicate_{k}s") for k in ("map_key", "handle", "product_id", "url")])
    raw = df.groupBy("store_slug").agg(F.count(F.lit(1)).alias("raw_records"))
    by_id = dedup_by_id(df)
    unique = by_id.groupBy("store_slug").agg(F.count(F.lit(1)).alias("unique_by_id"))
    last = dedup_by_handle(by_id).groupBy("store_slug").agg(F.count(F.lit(1)).alias("unique_records"))
    out = raw.join(unique, "store_slug").join(last, "store_slug").join(twice, "store_slug", "left").withColumn("dropped_records", F.col("raw_records") - F.col("unique_records"))
    return out.fillna(0)


def top_duplicates(df: DataFrame, n: int = 25) -> DataFrame:
    """The n most repeated values per store and kind; of equal counts the smaller value."""
    rank = F.row_number().over(W.partitionBy("store_slug", "kind").orderBy(F.desc("n"), "value"))
    return duplicate_counts(df).withColumn("rank", rank).where(F.col("rank") <= n)


def handle_collisions(df: DataFrame, n: int = 25) -> DataFrame:
    """Handles that several product ids have, most ids first; n_collisions counts all of the store, before the cut. Ids are listed for what is left after it."""
    pairs = df.select("store_slug", F.lower(text_or_null(F.col("handle"))).alias("handle"), text_or_null(F.col("product_id")).alias("product_id")).where("handle is not null and product_id is not null").distinct()
    sizes = pairs.groupBy("store_slug", "handle").agg(F.count(F.lit(1)).alias("n_ids")).where("n_ids > 1")
    all_of = sizes.groupBy("store_slug").agg(F.count(F.lit(1)).alias("n_collisions"))
    rank = F.row_number().over(W.partitionBy("store_slug").orderBy(F.desc("n_ids"), "handle"))
    top = sizes.withColumn("rank", rank).where(F.col("rank") <= n)
    ids = pairs.join(top.select("store_slug", "handle"), ["store_slug", "handle"]).groupBy("store_slug", "handle").agg(F.sort_array(F.collect_list("product_id")).alias("product_ids"))
    return top.join(ids, ["store_slug", "handle"]).join(all_of, "store_slug")


def split_catalog(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(catalog products, other records)."""
    flag = F.coalesce(F.col("is_catalog_product"), F.lit(False))
    return df.where(flag), df.where(~flag)
