"""Change detection and upserts as joins on the natural keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.columns import is_catalog_product, no_strings
from ..sources.shared import written

KEYS = ["store_slug", "handle"]


def changed_products(new: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """New products that are not stored under their store and handle, or with another hash; all of them if forced."""
    if force:
        return new
    old = stored.select(*KEYS, F.col("content_hash").alias("_old"))
    return new.join(old, KEYS, "left").where(F.col("_old").isNull() | ~F.col("content_hash").eqNullSafe(F.col("_old"))).drop("_old")


def upsert(stored: DataFrame, new: DataFrame, keys: Sequence[str], rules: dict[str, Callable[[Column, Column, Column], Column]] | None = None) -> DataFrame:
    """Stored rows with new ones merged in by key.

    A matched or new row has the new columns; `rules` gives other ones from the old
    value, the new value and whether there is a new row. Columns are those of `stored`;
    the keys of each side are unique.
    """
    a, b = stored.withColumn("_has_old", F.lit(True)).alias("a"), new.withColumn("_has_new", F.lit(True)).alias("b")
    both = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], "full")
    has_new = F.col("b._has_new").isNotNull()

    def one(c: str) -> Column:
        old, fresh = F.col(f"a.{c}"), F.col(f"b.{c}") if c in new.columns else F.lit(None)
        if c in keys:
            return F.coalesce(fresh, old).alias(c)
        if rules and c in rules:
            return rules[c](old, fresh, has_new).alias(c)
        return F.when(has_new, fresh).otherwise(old).alias(c)

    return both.select(*map(one, stored.columns))


def upsert_products(stored: DataFrame, new: DataFrame) -> DataFrame:
    """New columns win; embedding and summary_llm keep the old value where the hash is unchanged or the new one is null."""
    same = F.col("a.content_hash").eqNullSafe(F.col("b.content_hash"))

    def sticky(old: Column, fresh: Column, has_new: Column) -> Column:
        return F.when(~has_new | (same & old.isNotNull()), old).otherwise(F.coalesce(fresh, old))

    return upsert(stored, new, KEYS, {c: sticky for c in ("embedding", "summary_llm") if c in stored.columns})


def id_conflicts(stored: DataFrame, new: DataFrame) -> DataFrame:
    """New products whose id is stored under another handle of the store: the second unique key would break."""
    old = stored.select("store_slug", "product_id", F.col("handle").alias("stored_handle"))
    return new.join(old, ["store_slug", "product_id"]).where("stored_handle <> handle")


def vanished_products(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored products that the new set no longer has; upserts never remove them."""
    return stored.join(new, KEYS, "left_anti")


def upsert_crawl_urls(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Latest run and source win, the status goes back to queued, external_discovered stays once true."""
    either = lambda old, fresh, has: F.coalesce(old, F.lit(False)) | F.coalesce(fresh, F.lit(False))
    queued = lambda old, fresh, has: F.when(has, F.lit("queued")).otherwise(old)
    return upsert(stored, new, ["store_slug", "url_norm"], {"external_discovered": either, "status": queued})


def apply_fetch_status(urls: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Crawl URLs with the status, HTTP status and error of their fetch."""
    fresh = outcomes.select("store_slug", "url_norm", F.col("status").alias("_s"), F.col("http_status").alias("_h"), F.col("error").alias("_e"))
    out = urls.join(fresh, ["store_slug", "url_norm"], "left")
    out = out.withColumn("error", F.when(F.col("_s").isNotNull(), F.col("_e")).otherwise(F.col("error")))
    return out.withColumns({"status": F.coalesce("_s", "status"), "http_status": F.coalesce("_h", "http_status")}).drop("_s", "_h", "_e").select(*urls.columns)


def upsert_stores(stored: DataFrame, new: DataFrame) -> DataFrame:
    """New URL, name and platform win where they are given."""
    keep = lambda old, fresh, has: F.coalesce(fresh, old)
    return upsert(stored, new, ["slug"], {c: keep for c in stored.columns if c != "slug"})


def store_outcome(stores: DataFrame, runs: DataFrame, products: DataFrame) -> DataFrame:
    """Stores with the platform, product count, index time and last error of their finished run.

    runs: (store_slug, platform, finished_at, error). A failed run sets last_error alone.
    """
    counts = products.groupBy(F.col("store_slug").alias("slug")).agg(F.count(F.lit(1)).alias("_n"))
    run = runs.select(F.col("store_slug").alias("slug"), F.col("platform").alias("_p"), F.col("finished_at").alias("_at"), F.col("error").alias("_e"), F.lit(True).alias("_ran"))
    out = stores.join(run, "slug", "left").join(counts, "slug", "left")
    ok = F.col("_ran").isNotNull() & F.col("_e").isNull()
    return out.withColumns(
        {
            "platform": F.when(ok, F.coalesce("_p", "platform")).otherwise(F.col("platform")),
            "product_count": F.when(ok, F.coalesce("_n", F.lit(0))).otherwise(F.col("product_count")),
            "indexed_at": F.when(ok, F.col("_at")).otherwise(F.col("indexed_at")),
            "last_error": F.when(F.col("_ran").isNotNull(), F.col("_e")).otherwise(F.col("last_error")),
        }
    ).drop("_p", "_at", "_e", "_ran", "_n")


def backfill_metadata(products: DataFrame) -> DataFrame:
    """Fills a missing flag, summary, token list and hash from the stored columns; the hash is md5, unlike the one at ingest."""
    words = lambda c: F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), r"\s+")
    lower_tags = F.transform(F.coalesce("tags", no_strings()), lambda t: F.lower(t))
    tokens = F.array_sort(F.array_distinct(F.filter(F.concat(lower_tags, words("title"), words("product_type")), lambda t: F.trim(t) != "")))
    flag = is_catalog_product(F.col("url"), F.col("variants"), F.col("price_min"), F.col("price_max"))
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("title", "handle", "url", "description")]
    parts += [F.array_join(F.coalesce("tags", no_strings()), ",")] + [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("price_min", "price_max", "available")]
    return products.withColumns(
        {
            "is_catalog_product": F.coalesce("is_catalog_product", flag),
            "summary_short": F.coalesce("summary_short", F.concat("title", F.lit(": "), F.coalesce(F.nullif("product_type", F.lit("")), F.lit("Product")))),
            "option_tokens": F.when(F.coalesce(F.size("option_tokens"), F.lit(0)) <= 0, tokens).otherwise(F.col("option_tokens")),
            "content_hash": F.coalesce("content_hash", F.md5(F.concat_ws("|", *parts))),
        }
    )


def hashing_embedding(texts: list[str], dims: int = 64) -> list[list[float]]:
    """Offline default of embed_changed: hashed word counts of length 1."""
    import zlib

    import numpy as np

    out = np.zeros((len(texts), dims), np.float32)
    for i, t in enumerate(texts):
        for w in t.lower().split():
            h = zlib.crc32(w.encode())
            out[i, h % dims] += 1 if h & 0x10000 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm == 0, 1, norm)).tolist()


def _embedded(texts: list[str], embed: Callable[[list[str]], list[list[float]]], batch: int) -> list[list[float] | None]:
    vectors: list[list[float] | None] = []
    for at in range(0, len(texts), batch):
        part = texts[at : at + batch]
        try:
            vectors += embed(part)
        except Exception:  # the callable is the user's: whatever it raises, these rows stay without a vector
            vectors += [None] * len(part)
    return vectors


def embed_changed(changed: DataFrame, embed: Callable[[list[str]], list[list[float]]] = hashing_embedding, batch: int = 64, max_chars: int = 8000, parallelism: int | None = None) -> DataFrame:
    """changed with an embedding of search_text; a batch that fails gives nulls. parallelism spreads the calls.

    Rows go through the calls whole, so they are worked out once and joined to nothing.
    """
    if parallelism:
        changed = changed.repartition(parallelism)
    rows = changed.drop("embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(t or "")[:max_chars] for t in b.column("search_text").to_pylist()]
            vectors = pa.array(_embedded(texts, embed, batch), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*b.columns, vectors], [*b.schema.names, "embedding"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))]))


def text_key(text: Column, max_chars: int = 8000) -> Column:
    """What a vector is stored under: the digest of the text that is embedded."""
    return F.sha2(F.substring(F.coalesce(text, F.lit("")), 1, max_chars), 256)


def embed_texts(changed: DataFrame, vectors: DataFrame | None, embed: Callable[[list[str]], list[list[float]]] = hashing_embedding, batch: int = 64, max_chars: int = 8000) -> tuple[DataFrame, DataFrame]:
    """(changed with an embedding, new vectors): each text is asked for once, and only if no stored vector has its key.

    vectors is the stored table (text_key, embedding); the new ones, written, are to be
    appended to it. Texts without a vector, as their batch failed, are asked for again next time.
    """
    rows = changed.drop("embedding").withColumn("text_key", text_key(F.col("search_text"), max_chars))
    texts = rows.groupBy("text_key").agg(F.any_value(F.coalesce("search_text", F.lit(""))).alias("search_text"))
    if vectors is not None:
        texts = texts.join(vectors.select("text_key"), "text_key", "left_anti")
    new = written(embed_changed(texts, embed, batch, max_chars).where("embedding is not null").select("text_key", "embedding"), "vectors")
    known = new if vectors is None else new.unionByName(vectors.select("text_key", "embedding"))
    return rows.join(known, "text_key", "left").drop("text_key"), new
