"""A catalog table in buckets of its natural key, so that an upsert shuffles what is new and never what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import merge

#: Buckets of a catalog; at least the shuffle partitions, else Spark would shuffle the stored side to these.
BUCKETS = 256


def save(df: DataFrame, table: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Writes df as an external table in buckets of store and handle, sorted by them in each: one file for each bucket."""
    dealt = df.repartition(buckets, *merge.KEYS)
    dealt.write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, *merge.KEYS).sortBy(*merge.KEYS).saveAsTable(table)
    return df.sparkSession.table(table)


def upserted(spark: SparkSession, table: str, new: DataFrame, force: bool = False) -> DataFrame:
    """The stored catalog with new products merged in: merge.upsert_products of those that changed, or of all if forced.

    Both joins read the stored buckets where they lie, for the comparison only keys and
    hashes of them; the new products are shuffled once, to these buckets.
    """
    stored = spark.table(table)
    return merge.upsert_products(stored, merge.changed_products(new.hint("merge"), stored, force))


def resaved(spark: SparkSession, table: str, merged: DataFrame, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Writes an upserted catalog to a new place, as its rows lie after the join, and lets the table point there; the old files stay for running readers."""
    next_ = f"{table}_next"
    merged.write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, *merge.KEYS).sortBy(*merge.KEYS).saveAsTable(next_)
    spark.sql(f"drop table {table}")
    spark.sql(f"alter table {next_} rename to {table}")
    return spark.table(table)
