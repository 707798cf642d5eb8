"""Ranked search for many queries at once: keyword and vector rankings, fusion, business scoring.

queries: (query_id, store_slug, text, embedding, limit, available_only, budget_min,
budget_max, tone, sort). Only query terms meet postings, and only the best candidates
of a query meet whole products.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions.columns import budget_fit, product_tokens, tone_tokens
from ..sources.shared import written
from .catalog import available_options, option_preview, product_summary, recommended_option, tone_matches

RRF_K = 60  # fixed value: the constant of reciprocal rank fusion
PAYLOAD_BYTES = 12288
#: Queries are sent to all tasks only up to so many at a time; more are joined by shuffles.
BROADCAST_QUERIES = 100_000
#: Characters of the stretches by which texts are looked up.
GRAM = 3
#: Vectors that are held against a block of queries at a time.
SLICE = 2048


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case, no stemming, no stop words."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def postings(docs: DataFrame) -> DataFrame:
    """(store_slug, product_id, term, pos) for each word of search_text."""
    return docs.select("store_slug", "product_id", F.posexplode(words(F.col("search_text"))).alias("pos", "term"))


def parse_queries(queries: DataFrame) -> DataFrame:
    """(query_id, store_slug, clause, negative, n, terms): one row per alternative of each clause.

    Clauses are all asked for; a quoted one is a phrase of several terms, alternatives
    are joined by "or", a dash before a clause excludes it.
    """
    tokens = F.regexp_extract_all(F.lower(F.col("text")), F.lit(r'(-?"[^"]*"|\S+)'), F.lit(1))
    rows = queries.select("query_id", "store_slug", F.posexplode(tokens).alias("i", "raw"))
    order = W.partitionBy("query_id").orderBy("i")
    rows = rows.withColumn("before", F.lag("raw").over(order)).where("raw <> 'or'")
    joined = F.coalesce(F.col("before") == "or", F.lit(False))
    rows = rows.withColumn("clause", F.sum(F.when(joined, 0).otherwise(1)).over(order))
    negative = F.startswith("raw", F.lit("-"))
    rows = rows.select("query_id", "store_slug", "clause", "i", negative.alias("negative"), words(F.col("raw")).alias("terms"))
    return rows.where("size(terms) > 0")


class Hits(NamedTuple):
    """Places of asked terms: rows (query_id, store_slug, product_id, pos, t, want, uses), dealt by query and product, and the most positive terms of a query."""

    rows: DataFrame
    terms: int


def asked_terms(queries: DataFrame) -> DataFrame:
    """(query_id, store_slug, term, t, want, uses): one row per term of a query.

    t numbers the terms that are not excluded, want is how many clauses are asked for, uses
    lists where the term stands in the query: clause, alternative, place in it and its length.
    """
    parts = parse_queries(queries)
    clauses = F.size(F.collect_set(F.when(~F.col("negative"), F.col("clause"))).over(W.partitionBy("query_id")))
    one = parts.withColumn("want", clauses).select("query_id", "store_slug", "want", "clause", "negative", "i", F.size("terms").alias("n"), F.posexplode("terms").alias("at", "term"))
    uses = F.collect_list(F.struct("clause", "negative", "i", "at", "n"))
    per_term = one.groupBy("query_id", "store_slug", "term", "want").agg(uses.alias("uses"), F.max(~F.col("negative")).alias("_counts"))
    number = F.row_number().over(W.partitionBy("query_id", "_counts").orderBy("term"))
    return per_term.withColumn("t", F.when(F.col("_counts"), number)).drop("_counts")


def fts_hits(posts: DataFrame, queries: DataFrame) -> Hits:
    """The postings that queries ask for, scanned once for matching and ranking.

    The asked terms are written, counted, and sent to all tasks only if they are few; hits
    are dealt by query and product once, for all that follows.
    """
    asked = written(asked_terms(queries), "asked-terms")
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("t")).first()
    rows = posts.join(F.broadcast(asked) if size["n"] <= BROADCAST_QUERIES else asked, ["store_slug", "term"])
    return Hits(rows.select("query_id", "store_slug", "product_id", "pos", "t", "want", "uses").repartition("query_id", "store_slug", "product_id"), size["t"] or 0)


def fts_match(hits: Hits) -> DataFrame:
    """(query_id, store_slug, product_id) of the products that match a query: every clause, none excluded.

    A clause is met where all terms of an alternative stand side by side.
    """
    key = ["query_id", "store_slug", "product_id"]
    used = hits.rows.select(*key, "want", "pos", F.explode("uses").alias("u")).select(*key, "want", "u.clause", "u.negative", "u.i", "u.n", "u.at", (F.col("pos") - F.col("u.at")).alias("start"))
    places = used.groupBy(*key, "want", "clause", "negative", "i", "n", "start").agg(F.count(F.lit(1)).alias("k")).where("k = n")
    met = places.groupBy(*key, "want").agg(F.countDistinct(F.when(~F.col("negative"), F.col("clause"))).alias("have"), F.max("negative").alias("excluded"))
    return met.where("have > 0 and have = want and not excluded").select(*key)


def cover_densities(hits: Hits, matched: DataFrame) -> DataFrame:
    """(query_id, store_slug, product_id, score) of matched products: the sum over the minimal covers of the query's terms in it of 1 / (1 + other words inside).

    Places are gone through in order with the last place of each term so far; a cover ends
    where the earliest of these moves. Of a single term that is how often it stands.
    """
    key = ["query_id", "store_slug", "product_id"]
    rows = hits.rows.where("t is not null").select(*key, "pos", "t").join(matched, key, "left_semi")
    order = W.partitionBy(*key).orderBy("pos")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    last = [f"_l{k}" for k in range(1, hits.terms + 1)]
    rows = rows.withColumns({c: F.max(F.when(F.col("t") == k, F.col("pos"))).over(so_far) for k, c in enumerate(last, 1)})
    seen = reduce(lambda x, y: x + y, [F.col(c).isNotNull().cast("int") for c in last], F.lit(0))
    start = F.least(*last) if len(last) > 1 else F.col(last[0]) if last else F.lit(None).cast("int")
    rows = rows.select(*key, "pos", seen.alias("seen"), start.alias("start"))
    rows = rows.withColumns({"width": F.max("seen").over(W.partitionBy(*key)), "before": F.lag(F.struct("seen", "start")).over(order)})
    new = (F.col("seen") == F.col("width")) & (F.coalesce(F.col("before.seen") < F.col("width"), F.lit(True)) | (F.col("start") > F.col("before.start")))
    other = F.greatest(F.lit(0), F.col("pos") - F.col("start") + 1 - F.col("width"))
    return rows.where(new).groupBy(*key).agg(F.sum(1.0 / (1 + other)).alias("score"))


def fts_rank(hits: Hits, matched: DataFrame, most: DataFrame | None = None) -> DataFrame:
    """(query_id, store_slug, product_id, rank) of matched products by cover density, then id. most: (query_id, k), how many to keep."""
    return ranked(cover_densities(hits, matched), [F.desc("score"), F.col("product_id")], most)


def ranked(rows: DataFrame, order: list[Column], most: DataFrame | None) -> DataFrame:
    out = rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))
    if most is not None:
        out = out.join(most, "query_id").where(F.col("rank") <= F.col("k"))
    return out.select("query_id", "store_slug", "product_id", "rank")


def vector_topk(items: DataFrame, queries: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """(query_id, store_slug, product_id, distance, rank): the k nearest by cosine distance, then id, in the query's store.

    The queries, the asked side, go to the tasks in blocks of at most `block`; each task
    keeps its k best per query by matrix products, and only those are shuffled.
    """
    spark = items.sparkSession
    asked = queries.where("embedding is not null").select("query_id", "store_slug", "embedding")
    n = asked.count()
    parts = -(-n // block) or 1
    dealt = asked.withColumn("_b", F.pmod(F.xxhash64("query_id"), F.lit(parts)))
    rows = items.where("embedding is not null").select("store_slug", "product_id", "embedding")
    found = None
    for i in range(parts):
        own = dealt.where(F.col("_b") == i).select("query_id", "store_slug", "embedding").toPandas()
        sent = spark.sparkContext.broadcast((own["query_id"].tolist(), own["store_slug"].tolist(), np.array(own["embedding"].tolist(), np.float64)))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            names, stores, q = sent.value
            if not names:
                return
            q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
            by_store: dict[str, list[int]] = {}
            for j, s in enumerate(stores):
                by_store.setdefault(s, []).append(j)
            best: list[pd.DataFrame] = []
            for b in batches:
                for store, own in b.groupby("store_slug"):
                    if store not in by_store:
                        continue
                    asked_here = by_store[store]
                    for at in range(0, len(own), SLICE):
                        some = own.iloc[at : at + SLICE]
                        v = np.array(some["embedding"].tolist(), np.float64)
                        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                        d = np.round(1.0 - v @ q[asked_here].T, 9)  # equal vectors are equally far, whatever their place
                        ids = some["product_id"].to_numpy()
                        last = np.partition(d, k - 1, axis=0)[k - 1] if len(d) > k else np.full(len(asked_here), np.inf)
                        for c, j in enumerate(asked_here):
                            near = np.nonzero(d[:, c] <= last[c])[0]  # the k nearest and what ties with the last of them
                            top = near[np.lexsort((ids[near], d[near, c]))[:k]]
                            best.append(pd.DataFrame({"query_id": names[j], "store_slug": store, "product_id": ids[top], "distance": d[top, c]}))
                if len(best) > 256:
                    best = [_best(best, k)]
            if best:
                yield _best(best, k)

        kinds = f"query_id {dict(queries.dtypes)['query_id']}, store_slug string, product_id string, distance double"
        part = rows.mapInPandas(run, kinds)
        found = part if found is None else found.unionByName(part)
    place = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "product_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def _best(parts: list[pd.DataFrame], k: int) -> pd.DataFrame:
    return pd.concat(parts).sort_values(["query_id", "distance", "product_id"]).groupby("query_id").head(k)


def rrf_fuse(*rankings: DataFrame, most: DataFrame | None = None, k: int = RRF_K) -> DataFrame:
    """(query_id, store_slug, product_id, score, place): sums of 1 / (k + rank), best first, then id; most: (query_id, k)."""
    rows = rankings[0].select("query_id", "store_slug", "product_id", "rank")
    for r in rankings[1:]:
        rows = rows.unionByName(r.select("query_id", "store_slug", "product_id", "rank"))
    fused = rows.groupBy("query_id", "store_slug", "product_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))
    fused = fused.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "product_id")))
    if most is not None:
        fused = fused.join(most, "query_id").where(F.col("place") <= F.col("k")).drop("k")
    return fused


def search_sizes(queries: DataFrame, version: int = 2) -> DataFrame:
    """queries with their result limit, candidates per ranking and fused candidates."""
    low, high = (1, 8) if version == 2 else (1, 50)
    limit = F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce("limit", F.lit(5 if version == 2 else 10))))
    out = queries.withColumn("n_results", limit)
    if version == 2:
        out = out.withColumn("n_candidates", F.greatest(F.lit(100), F.col("n_results") * 20))
        return out.withColumn("n_fused", F.greatest("n_candidates", F.lit(120)))
    out = out.withColumn("n_candidates", F.greatest(F.lit(120), F.col("n_results") * 10))
    return out.withColumn("n_fused", F.col("n_results") * 5)


def candidates(products: DataFrame, queries: DataFrame, version: int = 2) -> DataFrame:
    """Fused keyword and vector candidates of each query (with text), joined to their products and the query."""
    sized = search_sizes(queries.where("trim(text) <> ''"), version)
    shop = products.where(F.coalesce("is_catalog_product", F.lit(True)))
    posts = postings(shop)
    most = sized.select("query_id", F.col("n_candidates").alias("k"))
    hits = fts_hits(posts, sized)
    rankings = [fts_rank(hits, fts_match(hits), most)]
    if "embedding" in shop.columns and "embedding" in sized.columns:
        k = 1000 if version == 1 else 160  # no query has more candidates
        near = vector_topk(shop, sized, k).join(most, "query_id").where(F.col("rank") <= F.col("k"))
        rankings.append(near)
    fused = rrf_fuse(*rankings, most=sized.select("query_id", F.col("n_fused").alias("k")))
    asked = sized.drop("store_slug", *(["embedding"] if "embedding" in sized.columns else []))
    return fused.join(asked, "query_id").join(shop.drop("embedding"), ["store_slug", "product_id"])


def excluded_reason(row_available: Column) -> Column:
    """Why a candidate is left out, the first reason only: unavailable, over_budget, low_relevance; null when it stays."""
    return (
        F.when(F.col("available_only") & ~row_available, "unavailable").when(F.col("price_min") > F.col("budget_max"), "over_budget")
        .when(F.col("price_max") < F.col("budget_min"), "over_budget").when(F.col("score") <= 0, "low_relevance")
    )


def scored(rows: DataFrame, stores: DataFrame | None = None) -> DataFrame:
    """Candidates with serving columns, reason, fit parts, total, signals and why."""
    out = product_summary(rows, stores)
    out = out.withColumns({"reason": excluded_reason(F.col("available")), "available_options": available_options(F.col("variants")), "tones": tone_tokens(F.col("tone"))})
    tokens = product_tokens(*[F.col(c) for c in ("title", "product_type", "handle", "tags", "option_tokens", "variants")])
    hit = F.arrays_overlap(tokens, "tones")
    out = out.withColumns(
        {
            "budget_fit": budget_fit(*[F.col(c) for c in ("price_min", "price_max", "budget_min", "budget_max")]), "tone_hit": F.coalesce(hit, F.lit(False)),
            "preview": option_preview(F.col("available_options"), 5), "recommended": recommended_option(F.col("available_options"), F.col("tones")),
            "tone_matches": tone_matches(F.col("available_options"), F.col("tones"), 2),
        }
    )
    tone_fit = F.when(F.size("tones") == 0, 0.5).when(F.col("tone_hit"), 1.0).otherwise(0.2)
    total = 0.50 * F.col("score") + 0.20 * F.col("budget_fit") + 0.15 * F.col("available").cast("double") + 0.10 * tone_fit + 0.05
    return out.withColumns({"total": total, "fit_signals": fit_signals(), "why_match": why_match()})


def fit_signals() -> Column:
    tone = F.when(F.lower("tone").isin("deep", "dark", "darker"), "deeper_shade_signal").otherwise("skin_tone_signal")
    signals = F.array(
        F.lit("intent_match"), F.when(F.col("budget_fit") > 0, "under_budget"), F.when(F.col("available"), "in_stock"), F.when(F.col("tone_hit"), tone), F.when(F.col("recommended").isNotNull(), "recommended_option")
    )
    return F.filter(signals, lambda s: s.isNotNull())


def why_match() -> Column:
    matches = F.when(F.size("tone_matches") > 0, F.concat(F.lit("tone-aligned options: "), F.array_join("tone_matches", ", ")))
    return F.concat_ws("; ", F.lit("Matches query intent"), F.when(F.col("budget_fit") > 0, "within budget"), F.when(F.col("tone_hit"), "shade fit signal detected"), matches)


def excluded_counts(rows: DataFrame) -> DataFrame:
    """Per query, how many scored candidates each reason has left out."""
    return rows.groupBy("query_id").agg(*[F.count_if(F.col("reason") == r).alias(r) for r in ("over_budget", "unavailable", "low_relevance")])


def search_v2(products: DataFrame, queries: DataFrame, stores: DataFrame | None = None) -> DataFrame:
    """The ranked results of each query: filtered, scored, in the order that it asks for."""
    rows = scored(candidates(products, queries, 2), stores).where("reason is null")
    sort = F.lower(F.trim(F.coalesce("sort", F.lit(""))))
    by_price = F.when(sort == "price_low_to_high", F.coalesce("price_min", F.lit(10**12))).when(sort == "price_high_to_low", -F.coalesce("price_max", F.lit(-1))).otherwise(0)
    place = F.row_number().over(W.partitionBy("query_id").orderBy(by_price, F.desc(F.round("total", 9)), "title", "product_id"))
    out = rows.withColumn("rank", place).where(F.col("rank") <= F.col("n_results"))
    return out.select("query_id", "rank", "store_slug", "product_id", "handle", "title", "price_min", "price_max", "available", "link", "variant_count", "summary_short", "why_match", "fit_signals", "preview", "recommended", "tone_matches", "total")


def search_v1(products: DataFrame, queries: DataFrame, stores: DataFrame | None = None) -> DataFrame:
    """The first results of each query in fusion order, unavailable ones left out if asked; the tone is read from its text."""
    from ..functions.columns import infer_tone

    asked = queries.withColumn("tone", infer_tone(F.col("text")))
    rows = product_summary(candidates(products, asked, 1), stores).where("available or not available_only")
    rows = rows.withColumns({"options": available_options(F.col("variants")), "tones": tone_tokens(F.col("tone"))})
    place = F.row_number().over(W.partitionBy("query_id").orderBy("place"))
    out = rows.withColumn("rank", place).where(F.col("rank") <= F.col("n_results"))
    return out.select(
        "query_id", "rank", "store_slug", "product_id", "handle", "title", "price_min", "price_max", "available", "link", "variant_count", "summary_short", F.round("score", 6).alias("score"),
        option_preview(F.col("options"), 5).alias("preview"), recommended_option(F.col("options"), F.col("tones")).alias("recommended"), tone_matches(F.col("options"), F.col("tones"), 2).alias("tone_matches"),
    )


def cap_payload(results: DataFrame, most_bytes: int = PAYLOAD_BYTES, head_bytes: int = 0) -> DataFrame:
    """results (query_id, rank, ...) without those at the end that make a query's JSON too large; truncated tells.

    head_bytes is what the payload has besides its results.
    """
    kinds = [c for c in results.columns if c != "query_id"]
    rows = results.withColumn("_b", F.octet_length(F.to_json(F.struct(*kinds))) + 1)
    w = W.partitionBy("query_id").orderBy("rank")
    rows = rows.withColumn("_sum", F.sum("_b").over(w.rowsBetween(W.unboundedPreceding, 0)) + head_bytes - 1)
    rows = rows.withColumn("truncated", F.max("_sum").over(W.partitionBy("query_id")) > most_bytes)
    return rows.where(F.col("_sum") <= most_bytes).drop("_b", "_sum")


def _grams(text: Column, size: Column | int) -> Column:
    """All stretches of so many characters of a text that has as many."""
    return F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substr(text, i, F.lit(size) if isinstance(size, int) else size))


def substring_hits(bodies: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, store_slug, n): how many bodies (store_slug, body) of each store have the hint of an asked (query_id, hint) in them.

    Bodies are looked up by trigrams (hints of one or two characters by these). Each
    hint waits only at its rarest one, counted over all bodies; a hint with one that no body
    has is left at once. What meets there is held against the whole hint.
    """
    size = F.least(F.lit(GRAM), F.length("hint"))
    grams = asked.where("hint <> ''").select("query_id", "hint", F.explode(F.array_distinct(_grams(F.col("hint"), size))).alias("gram"))
    own = [F.when(F.length("body") >= k, _grams(F.col("body"), k)).otherwise(F.array().cast("array<string>")) for k in range(1, GRAM + 1)]
    held = bodies.select("store_slug", "body", F.explode(F.array_distinct(F.concat(*own))).alias("gram"))
    counts = held.select("gram").join(grams.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = grams.join(counts, "gram", "left").groupBy("query_id", "hint").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count_if(F.col("n").isNull()).alias("without"))
    rarest = written(rarest.where("without = 0").select("query_id", "hint", "gram"), "rarest-grams")
    found = held.join(rarest, "gram").where(F.contains("body", F.col("hint")))
    return found.groupBy("query_id", "store_slug").agg(F.count(F.lit(1)).alias("n"))


def route_queries(queries: DataFrame, products: DataFrame, stores: DataFrame) -> DataFrame:
    """(query_id, store_slug, rung): the store that a query without one goes to.

    That with the most keyword matches, else the most products with the text in them,
    else the largest, else the last indexed. The text rung looks only for queries that
    the keyword rung has missed, by their rarest trigrams.
    """
    shop = products.where(F.coalesce("is_catalog_product", F.lit(True)))
    posts = postings(shop).withColumns({"product_id": F.concat_ws("\u0001", "store_slug", "product_id"), "store_slug": F.lit("")})
    good = fts_match(fts_hits(posts, queries.withColumn("store_slug", F.lit(""))))
    counted = good.groupBy("query_id", F.substring_index("product_id", "\u0001", 1).alias("store_slug")).agg(F.count(F.lit(1)).alias("n"))
    first = lambda df: df.groupBy("query_id").agg(F.min_by("store_slug", F.struct(F.negative("n"), "store_slug")).alias("store_slug"))
    by_words = first(counted)
    missed = queries.select("query_id", F.lower(F.trim("text")).alias("hint")).where("hint <> ''").join(by_words, "query_id", "left_anti")
    body = F.lower(F.concat_ws("\u0001", "title", "handle", "product_type", F.array_join("tags", "\u0001")))
    by_text = first(substring_hits(shop.select("store_slug", body.alias("body")), written(missed, "missed-queries")))
    largest = stores.orderBy(F.desc(F.greatest("product_count", F.lit(0))), F.desc_nulls_last("indexed_at"), "slug").limit(1).select(F.col("slug").alias("_largest"), F.lit(1).alias("_one"))
    out = queries.select("query_id", F.lit(1).alias("_one")).join(by_words.withColumnRenamed("store_slug", "a"), "query_id", "left").join(by_text.withColumnRenamed("store_slug", "b"), "query_id", "left")
    out = out.join(F.broadcast(largest), "_one", "left")  # one row
    rung = F.when(F.col("a").isNotNull(), "words").when(F.col("b").isNotNull(), "text").otherwise("largest")
    return out.select("query_id", F.coalesce("a", "b", "_largest").alias("store_slug"), rung.alias("rung"))
