"""Feeds, pages, sitemap bodies and tables in; tables and compact JSON out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import schemas


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite", fmt: str = "parquet") -> None:
    """Writes a table; with partitions only those present in df are replaced."""
    writer = df.write.format(fmt).mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.save(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PAGES).parquet(path)


def read_sitemaps(spark: SparkSession, path: str) -> DataFrame:
    """(url, body) of landed sitemap files, plain or compressed."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("url"), F.col("content").alias("body"))


def feed_products(body: Column) -> Column:
    """The products of a feed's JSON text; null when it isn't such a text."""
    return F.from_json(body, schemas.FEED)["products"]


def read_feed(spark: SparkSession, path: str, store_slug: str, store_url: str) -> DataFrame:
    """(store_slug, store_url, pos, product) for each raw product of landed feed files."""
    files = spark.read.text(path, wholetext=True)
    return explode_feed(files.select(F.lit(store_slug).alias("store_slug"), F.lit(store_url).alias("store_url"), F.col("value").alias("body")))


def explode_feed(bodies: DataFrame) -> DataFrame:
    """(store_slug, store_url, page, pos, product) of feed bodies (store_slug, store_url, body and, where a feed has several, page)."""
    page = F.col("page") if "page" in bodies.columns else F.lit(0)
    rows = bodies.select("store_slug", "store_url", page.cast("long").alias("page"), F.posexplode(feed_products(F.col("body"))).alias("pos", "product"))
    return rows.where("product is not null")


def to_payload(df: DataFrame, array_cols: tuple[str, ...] = (), price_cols: tuple[str, ...] = (), flag_cols: tuple[str, ...] = ()) -> DataFrame:
    """(payload): each row as compact JSON. Nulls are left out, but listed arrays become empty ones, flags false; prices are whole."""
    kinds = dict(df.dtypes)

    def one(name: str) -> Column:
        c = F.col(f"`{name}`")
        if name in array_cols:
            c = F.coalesce(c, F.array().cast(kinds[name]))
        elif name in price_cols:
            c = c.cast("long")
        elif name in flag_cols:
            c = F.coalesce(c.cast("boolean"), F.lit(False))
        return c.alias(name)

    return df.select(F.to_json(F.struct(*map(one, df.columns))).alias("payload"))
