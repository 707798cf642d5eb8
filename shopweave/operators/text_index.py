"""A stored inverted index of products: postings with their places, in buckets of store and term, kept up by changed products alone.

On disk an index is a folder of versions. `postings/version=V/bucket=B` has one row per
store, term and product with the sorted places of the term, rows sorted by store and
term; `log/version=V` names the products that version V brought anew or took away. A
product's postings count only in the last version that names it, so an update writes
what has changed and never reads what is there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .search import Hits, asked_terms, fts_hits, words

#: Buckets of (store, term).
BUCKETS = 64
#: Places are ascending: Parquet's second format keeps them as packed differences.
FORMAT = {"parquet.writer.version": "v2", "parquet.enable.dictionary": "false", "compression": "zstd"}
POSTINGS = "store_slug string, term string, product_id string, places array<int>, version int, bucket int"
LOG = "store_slug string, product_id string, version int"


def bucket_of(store: Column, term: Column) -> Column:
    return F.pmod(F.xxhash64(store, term), F.lit(BUCKETS)).cast("int")


def blocks(docs: DataFrame) -> DataFrame:
    """(store_slug, term, product_id, places): the ascending places of each word of search_text."""
    at = docs.select("store_slug", "product_id", F.posexplode(words(F.col("search_text"))).alias("pos", "term"))
    return at.groupBy("store_slug", "term", "product_id").agg(F.array_sort(F.collect_list("pos")).alias("places"))


def _write(rows: DataFrame, path: str) -> None:
    """Rows in folders by bucket; a large bucket is split over tasks. What a task writes is sorted, so that a reader skips the parts of a file without its terms."""
    dealt = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "store_slug", "term", "product_id")
    dealt.write.options(**FORMAT).mode("overwrite").partitionBy("bucket").parquet(path)


def _append(docs: DataFrame, touched: DataFrame, path: str, version: int) -> None:
    rows = blocks(docs.where("search_text is not null")).withColumn("bucket", bucket_of(F.col("store_slug"), F.col("term")))
    _write(rows, f"{path}/postings/version={version}")
    touched.select("store_slug", "product_id").distinct().write.mode("overwrite").parquet(f"{path}/log/version={version}")


def build(docs: DataFrame, path: str) -> None:
    """Writes version 0 of docs (store_slug, product_id, search_text); product ids are unique in a store, a null text has no words."""
    _append(docs, docs.limit(0), path, 0)


def update(changed: DataFrame, path: str, version: int) -> None:
    """Writes version 1, 2, ... of changed products: new or changed ones with their text, those that are gone with a null text. Run again it writes the same."""
    _append(changed, changed, path, version)


def postings(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame:
    """(store_slug, product_id, term, pos) of the asked (store_slug, term): only their buckets are read."""
    keys = asked.select("store_slug", "term").distinct()
    buckets = [r["b"] for r in keys.select(bucket_of(F.col("store_slug"), F.col("term")).alias("b")).distinct().collect()]  # at most BUCKETS
    rows = spark.read.schema(POSTINGS).option("basePath", f"{path}/postings").parquet(f"{path}/postings").where(F.col("bucket").isin(buckets))
    rows = rows.withColumn("key", F.struct("store_slug", "term")).join(keys.select(F.struct("store_slug", "term").alias("key")), "key", "left_semi")
    last = spark.read.schema(LOG).option("basePath", f"{path}/log").parquet(f"{path}/log").groupBy("store_slug", "product_id").agg(F.max("version").alias("last"))
    live = rows.join(last, ["store_slug", "product_id"], "left").where(F.col("last").isNull() | (F.col("last") == F.col("version")))
    return live.select("store_slug", "product_id", "term", F.explode("places").alias("pos"))


def hits(spark: SparkSession, path: str, queries: DataFrame) -> Hits:
    """fts_hits() of the stored index."""
    return fts_hits(postings(spark, path, asked_terms(queries)), queries)


def compact(spark: SparkSession, path: str, to: str) -> None:
    """Writes the index at `path` anew as version 0 at `to`, without what is outdated."""
    rows = spark.read.schema(POSTINGS).option("basePath", f"{path}/postings").parquet(f"{path}/postings")
    last = spark.read.schema(LOG).option("basePath", f"{path}/log").parquet(f"{path}/log").groupBy("store_slug", "product_id").agg(F.max("version").alias("last"))
    live = rows.join(last, ["store_slug", "product_id"], "left").where(F.col("last").isNull() | (F.col("last") == F.col("version"))).drop("last", "version")
    _write(live, f"{to}/postings/version=0")
    spark.createDataFrame([], "store_slug string, product_id string").write.mode("overwrite").parquet(f"{to}/log/version=0")
