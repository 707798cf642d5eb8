"""Queries of search: matching, ranking, fusion, scoring, routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import tone_tokens
from ..operators import catalog as K, search as S, text_index as TI, vector_index as VI
from ..sources.shared import new_path, written
from . import views as V
from .column_queries import SQL_BUDGET, SQL_TOKENS

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
P, PS = V.SQL_PRODUCTS, V.SQL_STORES


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


SQL_DOC_WORDS = r"words as (select lang as store_slug, doc_id::varchar as product_id, unnest(l) as term, generate_subscripts(l, 1) as pos from (select *, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') as l from documents))"
DOC_QUERIES = ["the and", "of -token", "der or para or la", '"of the"']


def doc_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select(F.col("lang").alias("store_slug"), F.col("doc_id").cast("string").alias("product_id"), F.col("text").alias("search_text"))


def doc_queries(spark: SparkSession, sf_dir: str, texts: list[str]) -> DataFrame:
    """Each text asked in each language."""
    langs = V.table(spark, sf_dir, "documents").select(F.col("lang").alias("store_slug")).distinct()
    asked = F.explode(F.array(*[F.struct(F.lit(i).alias("n"), F.lit(t).alias("text")) for i, t in enumerate(texts)]))
    return langs.select("store_slug", asked.alias("q")).select(F.concat_ws("/", "store_slug", F.col("q.n").cast("string")).alias("query_id"), "store_slug", "q.text")


@query(f"with {SQL_DOC_WORDS} select store_slug, term, count(*) as n, count(distinct product_id) as n_docs from words group by 1, 2")
def s1_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.postings(doc_items(spark, sf_dir))
    per_doc = rows.groupBy("store_slug", "term", "product_id").agg(F.count(F.lit(1)).alias("k"))
    return per_doc.groupBy("store_slug", "term").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("n_docs"))


@query(f"""with {SQL_DOC_WORDS}, has as (select store_slug, product_id, max((term = 'the')::int) as the, max((term = 'and')::int) as a, max((term = 'of')::int) as o, max((term = 'token')::int) as t, max((term in ('der', 'para', 'la'))::int) as alt from words group by 1, 2),
phrase as (select distinct x.store_slug, x.product_id from words x join words y on x.product_id = y.product_id and y.pos = x.pos + 1 where x.term = 'of' and y.term = 'the')
select store_slug || '/0' as query_id, product_id from has where the = 1 and a = 1 union all select store_slug || '/1', product_id from has where o = 1 and t = 0 union all select store_slug || '/2', product_id from has where alt = 1 union all select store_slug || '/3', product_id from phrase""")
def s2_fts_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fts_match(S.fts_hits(S.postings(doc_items(spark, sf_dir)), doc_queries(spark, sf_dir, DOC_QUERIES))).select("query_id", "product_id")


def changed_docs(spark: SparkSession, sf_dir: str):
    """(old, new, changed) documents as items: an older version with other texts, some missing and some that are gone since, the present one, and what changed, gone ones with a null text."""
    from ..operators import merge as M

    new = doc_items(spark, sf_dir).select("store_slug", "product_id", F.col("product_id").alias("handle"), "search_text", F.xxhash64("search_text").alias("content_hash"))
    number = F.col("product_id").cast("long")
    text = F.when(number % 5 == 0, F.concat(F.lit("the of token and der "), "search_text")).when(number % 7 == 0, F.lit("")).otherwise(F.col("search_text"))
    old = new.where(number % 6 != 1).withColumn("search_text", text).withColumn("content_hash", F.xxhash64("search_text"))
    gone = new.where(number % 9 == 0).withColumns({"product_id": F.concat(F.lit("gone-"), "product_id"), "handle": F.concat(F.lit("gone-"), "handle")})
    old = old.unionByName(gone)
    changed = M.changed_products(new, old).unionByName(M.vanished_products(old, new).withColumn("search_text", F.lit(None).cast("string")))
    return old, new, changed


@query(ORACLES["s2_fts_match"])
def s2_stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The match of s2 on a stored index that was built from an older version of the documents and updated by the changed ones."""
    old, _, changed = changed_docs(spark, sf_dir)
    path = new_path(spark, "text-index")
    TI.build(old, path)
    TI.update(changed, path, 1)
    return S.fts_match(TI.hits(spark, path, doc_queries(spark, sf_dir, DOC_QUERIES))).select("query_id", "product_id")


@query(f"""with {SQL_DOC_WORDS}, n as (select store_slug || '/' || case term when 'the' then 0 else 1 end as query_id, product_id, count(*) as n from words where term in ('the', 'de') group by 1, 2)
select * from (select query_id, product_id, row_number() over (partition by query_id order by n desc, product_id)::int as rank from n) where rank <= 50""")
def s3_fts_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = doc_queries(spark, sf_dir, ["the", "de"])
    hits = S.fts_hits(S.postings(doc_items(spark, sf_dir)), asked)
    return S.fts_rank(hits, S.fts_match(hits), asked.select("query_id", F.lit(50).alias("k"))).select("query_id", "product_id", "rank")


@query(rf"""with {SQL_DOC_WORDS}, terms(n, t, term) as (values (0, 1, 'and'), (0, 2, 'the'), (1, 1, 'of'), (2, 1, 'der'), (2, 2, 'la'), (2, 3, 'para'), (3, 1, 'of'), (3, 2, 'the')),
phrase as (select distinct x.product_id from words x join words y on x.product_id = y.product_id and y.pos = x.pos + 1 where x.term = 'of' and y.term = 'the'),
has as (select product_id, max((term = 'the')::int) * max((term = 'and')::int) as q0, max((term = 'of')::int) * (1 - max((term = 'token')::int)) as q1, max((term in ('der', 'para', 'la'))::int) as q2 from words group by 1),
hits as (select n, store_slug, product_id, t, pos from words join terms using (term) join has using (product_id) where case n when 0 then q0 when 1 then q1 when 2 then q2 else (product_id in (from phrase))::int end = 1),
width as (select n, product_id, count(distinct t) as k, count(*) as places from hits group by 1, 2),
ends as (select n, store_slug, product_id, pos, k, places, max(case when t = 1 then pos end) over w as a, max(case when t = 2 then pos end) over w as b, max(case when t = 3 then pos end) over w as c from hits join width using (n, product_id) window w as (partition by n, product_id order by pos)),
covers as (select n, store_slug, product_id, k, places, least(a, b, c) as s, min(pos) as e from ends where (a is not null)::int + (b is not null)::int + (c is not null)::int = k group by all),
scores as (select n, store_slug, product_id, case when any_value(k) = 1 then any_value(places)::double else list_reduce(list(1.0::double / (1 + greatest(0, e - s + 1 - k)) order by e), lambda x, y: x + y) end as score from covers group by 1, 2, 3)
select store_slug || '/' || n as query_id, product_id, rank from (select *, row_number() over (partition by store_slug, n order by score desc, product_id)::int as rank from scores) where rank <= 50""")
def s3_cover_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = doc_queries(spark, sf_dir, DOC_QUERIES)
    hits = S.fts_hits(S.postings(doc_items(spark, sf_dir)), asked)
    return S.fts_rank(hits, S.fts_match(hits), asked.select("query_id", F.lit(50).alias("k"))).select("query_id", "product_id", "rank")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("store_slug"), F.col("vec_id").cast("string").alias("product_id"), F.col("vec_id").alias("query_id"), "embedding")


SQL_NEAR = """near as (select q.vec_id as query_id, v.label::varchar as store_slug, v.vec_id::varchar as product_id, round(1 - list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 9) as distance
  from embeddings q join embeddings v on q.label = v.label where q.vec_id % 50 = 0),
top as (select * from (select *, row_number() over (partition by query_id order by distance, product_id)::int as rank from near) where rank <= 20)"""


@query(f"with {SQL_NEAR} select query_id, product_id, rank, round(distance, 6) as distance from top")
def s4_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return S.vector_topk(v, v.where("query_id % 50 = 0"), 20).select("query_id", "product_id", "rank", F.round("distance", 6).alias("distance"))


@query()
def s4_vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search in the nearest lists of an index built over all rows; approximate, so its recall is tested, not its rows."""
    v = vectors(spark, sf_dir)
    path = new_path(spark, "vector-index")
    VI.build(v.select("store_slug", "product_id", "embedding"), path)
    return VI.search(spark, path, v.where("query_id % 100 = 0"), 20).select("query_id", "product_id", "rank", F.round("distance", 6).alias("distance"))


@query(f"""with {SQL_NEAR}, other as (select * from (select query_id, store_slug, product_id, row_number() over (partition by query_id order by product_id desc)::int as rank from near) where rank <= 20),
f as (select query_id, product_id, sum(1.0 / (60 + rank)) as score from (select query_id, product_id, rank from top union all select query_id, product_id, rank from other) group by 1, 2)
select * from (select query_id, product_id, round(score, 9)::double as score, row_number() over (partition by query_id order by round(score, 12) desc, product_id)::int as place from f) where place <= 15""")
def s5_rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    asked = v.where("query_id % 50 = 0")
    near = S.vector_topk(v, asked, 20)
    pairs = v.drop("query_id").join(asked.select("query_id", "store_slug"), "store_slug")
    other = S.ranked(pairs, [F.desc("product_id")], asked.select("query_id", F.lit(20).alias("k")))
    fused = S.rrf_fuse(near, other, most=asked.select("query_id", F.lit(15).alias("k")))
    return fused.select("query_id", "product_id", F.round("score", 9).alias("score"), "place")


@query("""with t as (select o_orderkey, case when o_orderkey % 9 <> 0 then (o_orderkey % 60)::int - 1 end as l from orders)
select o_orderkey, greatest(1, least(8, coalesce(l, 5))) as r2, greatest(100, greatest(1, least(8, coalesce(l, 5))) * 20) as c2, greatest(120, greatest(1, least(8, coalesce(l, 5))) * 20) as f2,
greatest(1, least(50, coalesce(l, 10))) as r1, greatest(120, greatest(1, least(50, coalesce(l, 10))) * 10) as c1, greatest(1, least(50, coalesce(l, 10))) * 5 as f1 from t""")
def s6_search_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = V.table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, (F.col("o_orderkey") % 60).cast("int") - 1).alias("limit"))
    two = S.search_sizes(o, 2).withColumnsRenamed({"n_results": "r2", "n_candidates": "c2", "n_fused": "f2"})
    return S.search_sizes(two, 1).select("o_orderkey", "r2", "c2", "f2", F.col("n_results").alias("r1"), F.col("n_candidates").alias("c1"), F.col("n_fused").alias("f1"))


@query(f"""with {P}, t as (select *, case when partkey % 2 = 0 then 1 else price_min end as lo from products)
select product_id, lo as price_min, price_max, available, n_variants::int as variant_count, url as link, case when partkey % 3 = 0 then 'by hand' else title || ': ' || product_type || case when available then ' currently unavailable' else ' in stock' end
|| case when lo = price_max then ' at $' || format('{{:.2f}}', lo / 100.0) else ' from $' || format('{{:.2f}}', lo / 100.0) || ' to $' || format('{{:.2f}}', price_max / 100.0) end || '.' end as summary_short from t""")
def s7_product_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    p = V.products(spark, sf_dir).withColumns({"price_min": F.when(k % 2 == 0, F.lit(1).cast("long")).otherwise(F.col("price_min")), "available": ~F.col("available"), "summary_short": F.when(k % 3 == 0, " by hand ")})
    p = p.withColumn("url", F.regexp_replace("url", "^https://[^/]+/", ""))
    return K.product_summary(p, V.stores(spark, sf_dir)).select("product_id", "price_min", "price_max", "available", "variant_count", "link", "summary_short")


#: Fixed questions, asked of every store: (text, available only, lowest price, highest price, tone, order, limit).
ASKED = [
    ("red", True, None, 2000000, "red", "best_match", 5), ("widget", False, 90000, None, "dark", "price_low_to_high", 8), ("economy", False, None, 150000, None, "price_high_to_low", 3),
    ("small", True, None, None, "small", "", 50), ("blue -anvil", False, 5000, 5000000, "light", "best_match", None),
]


def stored_catalog(products: DataFrame) -> DataFrame:
    """The catalog as it is searched, from its stored table and not worked out anew for each ranking."""
    return written(products, "catalog")


def store_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = "struct<n:int,text:string,available_only:boolean,budget_min:bigint,budget_max:bigint,tone:string,sort:string,limit:int>"
    asked = [F.struct(F.lit(i), *map(F.lit, row)).cast(kinds) for i, row in enumerate(ASKED)]
    stores = V.stores(spark, sf_dir).select(F.col("slug").alias("store_slug"), F.explode(F.array(*asked)).alias("q"))
    return stores.select(F.concat_ws("/", "store_slug", F.col("q.n").cast("string")).alias("query_id"), "store_slug", "q.*").drop("n")


def _values() -> str:
    lit = lambda x: "null" if x is None else str(x).lower() if isinstance(x, (bool, int)) else "'" + x + "'"
    return ", ".join(f"({i}, {', '.join(map(lit, row))})" for i, row in enumerate(ASKED))


SQL_OWN = rf"""asked as (select store_slug || '/' || n as query_id, store_slug, text, available_only, budget_min::bigint as budget_min, budget_max::bigint as budget_max, tone, sort, lim::int as lim from (select distinct store_slug from products),
  (values {_values()}) q(n, text, available_only, budget_min, budget_max, tone, sort, lim)),
"""
SQL_TEXTS = r"""texts as (select *, title || ' ' || handle || ' ' || vendor || ' ' || product_type || ' ' || array_to_string(tags, ' ') as search_text from products),
words as (select store_slug, product_id, unnest(list_filter(string_split_regex(lower(search_text), '[^\p{L}\p{N}]+'), lambda w: w <> '')) as term from texts),
"""
SQL_HITS = """hits as (select a.query_id, w.store_slug, w.product_id, count(*) as n from asked a join words w on w.store_slug = a.store_slug and w.term = string_split(a.text, ' ')[1]
  where not exists (select 1 from words x where a.text = 'blue -anvil' and x.term = 'anvil' and x.product_id = w.product_id) group by 1, 2, 3),
ranked as (select *, row_number() over (partition by query_id order by n desc, product_id) as rank from hits)"""
SQL_ASKED = f"{SQL_TOKENS}, {SQL_OWN}{SQL_TEXTS}{SQL_HITS}"

SQL_TOTAL = f"""reasoned as (select *, case when available_only and not available then 'unavailable' when price_min > budget_max then 'over_budget' when price_max < budget_min then 'over_budget' end as reason,
  {SQL_BUDGET.format(lo='budget_min', hi='budget_max')}::double as fit from cand),
toned as (select r.*, coalesce(list_has_any(string_split_regex(translate(lower(title || ' ' || product_type || ' ' || handle || ' ' || array_to_string(tags, ' ') || ' ' || array_to_string(option_tokens, ' ')), '/-', '  '), '\\s+'),
  case tone when 'dark' then ['deep', 'rich', 'dark', 'berry', 'plum', 'cocoa', 'espresso', 'mahogany', 'fig', 'ember', 'vesper', 'brown'] when 'light' then ['light', 'fair', 'pink', 'peach', 'nude', 'cool', 'soft'] else [tone] end), false) and tone is not null as tone_hit,
  exists (select 1 from variants v where v.partkey = r.partkey and v.available) and contains(color, coalesce(tone, '?')) as color_hit from reasoned r join tokens using (partkey)),
scored as (select *, 0.5 * score + 0.2 * fit + 0.15 * available::int + 0.1 * case when tone is null then 0.5 when tone_hit then 1.0 else 0.2 end + 0.05 as total from toned)"""
SQL_SCORED = f"""{SQL_ASKED}, cand as (select a.*, p.* exclude (store_slug), 1.0::double / (60 + rank) as score, greatest(1, least(8, coalesce(lim, 5))) as n_results from ranked r join asked a using (query_id) join products p on p.store_slug = r.store_slug and p.product_id = r.product_id
  where rank <= greatest(100, greatest(1, least(8, coalesce(lim, 5))) * 20)),
{SQL_TOTAL}"""


@query(f"""with {SQL_ASKED}, f as (select *, row_number() over (partition by query_id order by rank) as place from ranked r join products p using (store_slug, product_id) join (select query_id, available_only, lim from asked) using (query_id)
  where rank <= greatest(1, least(50, coalesce(lim, 10))) * 5 and (available or not available_only))
select query_id, place::int as rank, product_id, round(1.0::double / (60 + rank), 6) as score, price_min, available from f where place <= greatest(1, least(50, coalesce(lim, 10)))""")
def s8_search_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search_v1(stored_catalog(V.full_products(spark, sf_dir)), store_queries(spark, sf_dir), V.stores(spark, sf_dir)).select("query_id", "rank", "product_id", "score", "price_min", "available")


@query(f"""with {SQL_SCORED}, r as (select *, row_number() over (partition by query_id order by case sort when 'price_low_to_high' then price_min when 'price_high_to_low' then -price_max else 0 end, round(total, 9) desc, title, product_id)::int as rank from scored where reason is null)
select query_id, rank, product_id, price_min, price_max, available, round(total, 6)::double as total from r where rank <= n_results""")
def s9_search_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.search_v2(stored_catalog(V.full_products(spark, sf_dir)), store_queries(spark, sf_dir), V.stores(spark, sf_dir))
    return found.select("query_id", "rank", "product_id", "price_min", "price_max", "available", F.round("total", 6).alias("total"))


@query(f"with {SQL_SCORED} select query_id, count(*) filter (reason = 'over_budget') as over_budget, count(*) filter (reason = 'unavailable') as unavailable, 0::bigint as low_relevance from scored group by 1")
def s10_excluded_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.excluded_counts(S.scored(S.candidates(stored_catalog(V.full_products(spark, sf_dir)), store_queries(spark, sf_dir))))


@query(f"""with {SQL_SCORED} select query_id, product_id, array_to_string(list_filter(['intent_match', case when fit > 0 then 'under_budget' end, case when available then 'in_stock' end,
case when tone_hit then case when tone = 'dark' then 'deeper_shade_signal' else 'skin_tone_signal' end end, case when color_hit then 'recommended_option' end], lambda x: x is not null), '|') as signals,
'Matches query intent' || case when fit > 0 then '; within budget' else '' end || case when tone_hit then '; shade fit signal detected' else '' end || case when color_hit then '; tone-aligned options: Color: ' || color else '' end as why from scored""")
def s11_fit_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.scored(S.candidates(stored_catalog(V.full_products(spark, sf_dir)), store_queries(spark, sf_dir)))
    return rows.select("query_id", "product_id", F.array_join("fit_signals", "|").alias("signals"), F.col("why_match").alias("why"))


def _shown(c: str):
    return F.array_join(F.transform(c, lambda o: F.concat(o["name"], F.lit("="), F.array_join(o["values"], ","))), "|").alias(c)


@query(f"with {P} select p.product_id, coalesce('Color=' || any_value(color) filter (v.available) || '|Size=' || string_agg(distinct v.size, ',' order by v.size) filter (v.available), '') as options from products p join variants v using (partkey) group by 1")
def s12_available_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.products(spark, sf_dir).withColumn("options", K.available_options(F.col("variants"))).select("product_id", _shown("options"))


@query(f"""with {P}, s as (select p.product_id, any_value(color) as color, count(*) filter (v.available) as n from products p join variants v using (partkey) group by 1)
select product_id, case when n > 0 then 'Color=' || color else '' end as preview, case when n > 0 and contains(color, 'e') then 'Color: ' || color end as recommended, case when n > 0 and contains(color, 'e') then 'Color: ' || color else '' end as matches from s""")
def s13_option_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.products(spark, sf_dir).withColumn("options", K.available_options(F.col("variants")))
    tones = tone_tokens(F.lit("e"))
    p = p.withColumns({"preview": K.option_preview(F.col("options"), 2), "r": K.recommended_option(F.col("options"), tones), "m": K.tone_matches(F.col("options"), tones)})
    return p.select("product_id", _shown("preview"), F.concat("r.name", F.lit(": "), "r.value").alias("recommended"), F.array_join("m", "|").alias("matches"))


@query(f"""with {P}, t as (select store_slug as query_id, row_number() over (partition by store_slug order by partkey) as rank, title, handle, price_min from products),
b as (select *, sum(strlen('{{"rank":' || rank || ',"title":"' || title || '","handle":"' || handle || '","price_min":' || price_min || '}}') + 1) over (partition by query_id order by rank) - 1 + 100 as s from t)
select query_id, rank::int as rank, handle, m > 2000 as truncated from (select *, max(s) over (partition by query_id) as m from b) where s <= 2000""")
def s14_cap_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    p = V.products(spark, sf_dir)
    rank = F.row_number().over(W.partitionBy("store_slug").orderBy("p_partkey"))
    rows = p.select(F.col("store_slug").alias("query_id"), rank.alias("rank"), "title", "handle", "price_min")
    return S.cap_payload(rows, 2000, 100).select("query_id", "rank", "handle", "truncated")


@query(rf"""with {PS}, q as (select distinct color as query_id, color as text from products union select 'x' || substring(color, 1, 3), substring(color, 2, 2) from products union select 'none', 'zzzz'),
texts as (select *, title || ' ' || handle || ' ' || vendor || ' ' || product_type || ' ' || array_to_string(tags, ' ') as search_text from products),
words as (select distinct store_slug, product_id, unnest(string_split_regex(lower(search_text), '[^\p{{L}}\p{{N}}]+')) as term from texts),
a as (select query_id, min_by(store_slug, (-n, store_slug)) as slug from (select query_id, store_slug, count(*) as n from q join words on term = text group by 1, 2) group by 1),
b as (select query_id, min_by(store_slug, (-n, store_slug)) as slug from (select query_id, store_slug, count(*) as n from q join products p on contains(lower(title), text) or contains(lower(handle), text) or contains(lower(product_type), text) or contains(lower(array_to_string(tags, ' ')), text) group by 1, 2) group by 1),
c as (select slug from stores order by product_count desc, indexed_at desc nulls last, slug limit 1)
select q.query_id, coalesce(a.slug, b.slug, c.slug) as store_slug, case when a.slug is not null then 'words' when b.slug is not null then 'text' else 'largest' end as rung from q left join a using (query_id) left join b using (query_id), c""")
def s15_route_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.full_products(spark, sf_dir)
    color = F.split("title", " ")[0]
    asked = p.select(F.explode(F.array(F.struct(color.alias("query_id"), color.alias("text")), F.struct(F.concat(F.lit("x"), F.substring(color, 1, 3)).alias("query_id"), F.substring(color, 2, 2).alias("text")), F.struct(F.lit("none").alias("query_id"), F.lit("zzzz").alias("text")))).alias("q"))
    return S.route_queries(asked.select("q.*").distinct(), p, V.stores(spark, sf_dir))


#: Questions without a store, besides those asked of each: one that words route, one that nothing but the stores' sizes does.
ANY_STORE = ["red", "zzzz"]
SQL_ROUTED = f"""{SQL_TOKENS}, {V.SQL_STORES.removeprefix(V.SQL_PRODUCTS).lstrip(", ")}, {SQL_OWN.replace("asked as", "own as", 1)}{SQL_TEXTS}
asked as (select * from own union all
  select 'any/0', (select store_slug from words where term = 'red' group by 1 order by count(distinct product_id) desc, store_slug limit 1), 'red', false, null, null, null, 'best_match', 8 union all
  select 'any/1', (select slug from stores order by product_count desc, indexed_at desc nulls last, slug limit 1), 'zzzz', false, null, null, null, 'best_match', 8),
{SQL_HITS},
limits as (select query_id, greatest(1, least(8, coalesce(lim, 5))) as n_results from asked),
vectors as (select a.query_id, a.store_slug, e.embedding from asked a join embeddings e on e.vec_id = ascii(right(a.query_id, 1)) + ascii(substring(a.query_id, length(a.query_id) - 2, 1))),
near as (select q.query_id, p.store_slug, p.product_id, row_number() over (partition by q.query_id order by round(1 - list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 9), p.product_id) as rank
  from vectors q join products p using (store_slug) join embeddings e on e.vec_id = p.partkey),
both_ranks as (select query_id, store_slug, product_id, rank from ranked union all select query_id, store_slug, product_id, rank from near),
fused as (select query_id, store_slug, product_id, sum(1.0::double / (60 + rank)) as score from both_ranks join limits using (query_id) where rank <= greatest(100, n_results * 20) group by all),
placed as (select *, row_number() over (partition by query_id order by round(score, 12) desc, product_id) as place from fused),
cand as (select a.*, p.* exclude (store_slug), score, n_results from placed f join asked a using (query_id) join limits using (query_id) join products p on p.store_slug = f.store_slug and p.product_id = f.product_id where place <= greatest(120, n_results * 20)),
{SQL_TOTAL}"""


def hybrid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Products and questions with embeddings, where the table of vectors has one for them, and questions without a store."""
    vectors = V.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    p = V.full_products(spark, sf_dir)
    p = stored_catalog(p.join(vectors, p.p_partkey == vectors.vec_id, "left").drop("vec_id"))
    own = store_queries(spark, sf_dir)
    kinds = dict(own.dtypes)
    fixed = {"available_only": False, "sort": "best_match", "limit": 8}
    anywhere = spark.range(len(ANY_STORE)).select(
        F.concat(F.lit("any/"), "id").alias("query_id"), F.element_at(F.array(*map(F.lit, ANY_STORE)), (F.col("id") + 1).cast("int")).alias("text"),
        *[F.lit(fixed.get(c)).cast(kinds[c]).alias(c) for c in own.columns if c not in ("query_id", "text")],
    )
    asked = own.unionByName(anywhere)
    near = F.ascii(F.right("query_id", F.lit(1))) + F.ascii(F.substr("query_id", F.length("query_id") - 2, F.lit(1)))
    return p, asked.join(vectors, near == F.col("vec_id"), "left").drop("vec_id")
