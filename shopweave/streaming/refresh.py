"""Incremental catalog refresh: feed files, as they land, become catalog upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import dedup, feeds, merge
from ..plans import workloads
from ..sources import io
from ..sources.shared import forget, written

STORED = ["store_slug", "product_id", "handle", "title", "url", "tags", "search_text", "available", "source", "price_min", "price_max", "currency", "description", "brand", "vendor", "product_type", "image_url", "is_catalog_product", "summary_short", "option_tokens", "content_hash", "variants", "options"]
#: Buckets of stores that a catalog is kept in, and how often a version holds all of them.
BUCKETS, FULL = 256, 64


def current(spark: SparkSession, catalog_path: str, version: int, buckets: set[int] | None = None) -> DataFrame | None:
    """The catalog after batch `version`, or its buckets asked for; None where there is none yet.

    A bucket is where the last version up to this one wrote it, none before the last
    full version. Only folder names are listed, at most BUCKETS times FULL.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(catalog_path)
    files, last = root.getFileSystem(spark._jsc.hadoopConfiguration()), {}
    for v in range(version // FULL * FULL, version + 1):
        for found in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, f"v{v}/bucket=*")) or []:
            last[int(found.getPath().getName().split("=")[1])] = found.getPath().toString()
    paths = [p for b, p in sorted(last.items()) if buckets is None or b in buckets]
    return spark.read.parquet(*paths).select(*STORED) if paths else None


def refresh_batch(spark: SparkSession, bodies: DataFrame, catalog_path: str, version: int) -> None:
    """One batch of feed bodies (store_slug, store_url, body) merged into the catalog.

    A store lies in one bucket, and a version writes the buckets of the stores that the
    batch names, so a batch rewrites no more than these; each FULL-th version writes
    all. A batch that is run again reads what came before it and writes the same.
    """
    bucket = F.pmod(F.xxhash64("store_slug"), F.lit(BUCKETS)).cast("int").alias("bucket")
    raw = workloads.raw_candidates(io.explode_feed(bodies), None)
    found = written(feeds.with_derived(dedup.dedup(feeds.normalize_fields(raw))).select(*STORED), "refresh")
    touched = None if version % FULL == 0 else {r.bucket for r in found.select(bucket).distinct().collect()}  # at most BUCKETS rows
    stored = current(spark, catalog_path, version - 1, touched) if version else None
    new = found if stored is None else merge.upsert_products(stored, merge.changed_products(found, stored))
    new.select(*STORED, bucket).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{catalog_path}/v{version}")
    forget(found)


def stream_refresh(spark: SparkSession, bodies: DataFrame, catalog_path: str, checkpoint: str) -> StreamingQuery:
    """Starts the refresh over a stream of feed bodies; current() reads the catalog after a batch."""
    return bodies.writeStream.foreachBatch(lambda df, n: refresh_batch(spark, df, catalog_path, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
