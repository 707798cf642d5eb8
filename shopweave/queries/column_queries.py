"""Queries of the column functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import columns as C, urls as U
from . import views as V

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def sql_cents(x: str) -> str:
    s = f"regexp_replace(regexp_replace({x}, '[^0-9.,-]', '', 'g'), ',([0-9]{{2}})$', '.\\1')"
    number = f"nullif(regexp_extract({s}, '^-?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)'), '')"
    return f"case when {number} is not null then greatest(0, floor(try_cast({number} as double) * 100 + 0.5))::bigint end"


def sql_slug(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower(trim({x})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(f"""select c_custkey, {sql_cents("'$' || cast(c_acctbal::decimal(12,2) as varchar) || ' USD'")} as cents,
{sql_cents("replace(cast(c_acctbal::decimal(12,2) as varchar), '.', ',')")} as comma_cents, greatest(0, floor(c_acctbal * 100 + 0.5))::bigint as num_cents from customer""")
def c1_to_cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("c_acctbal").cast("decimal(12,2)").cast("string")
    return V.table(spark, sf_dir, "customer").select(
        "c_custkey",
        C.to_cents(F.concat(F.lit("$"), text, F.lit(" USD"))).alias("cents"),
        C.to_cents(F.replace(text, F.lit("."), F.lit(","))).alias("comma_cents"),
        C.num_to_cents(F.col("c_acctbal")).alias("num_cents"),
    )


@query("""with t as (select s_suppkey, cast(s_acctbal::decimal(12,2) as varchar) as x, cast(floor(s_acctbal)::bigint as varchar) as y from supplier)
select s_suppkey, round(try_cast(replace(x, ',', '') as decimal(28,8)) * 100)::bigint as units, try_cast(replace(y, ',', '') as bigint) as whole from t""")
def c2_serve_cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("s_acctbal").cast("decimal(12,2)").cast("string")
    whole = F.floor("s_acctbal").cast("long").cast("string")
    return V.table(spark, sf_dir, "supplier").select("s_suppkey", C.serve_cents(text).alias("units"), C.serve_cents(whole).alias("whole"))


_STOCK = ["InStock", " out of stock", "https://schema.org/OutOfStock", "maybe", "1", " 7", "-2.5"]
_STOCK_SQL = f"([{quoted(_STOCK)}])[(l_orderkey % 7 + 1)::int]"


def _stock():
    return F.element_at(F.array(*map(F.lit, _STOCK)), (F.col("l_orderkey") % 7 + 1).cast("int"))


@query(f"""select l_returnflag, x as word, case when lower(trim(x)) in ({quoted(C.INGEST_YES)}) then true when lower(trim(x)) in ({quoted(C.INGEST_NO)}) then false when try_cast(trim(x) as double) is not null then try_cast(trim(x) as double) > 0 end as available, count(*) as n
from (select l_returnflag, {_STOCK_SQL} as x from lineitem) group by all""")
def c3_to_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.table(spark, sf_dir, "lineitem").select("l_returnflag", _stock().alias("word"))
    return rows.groupBy("l_returnflag", "word", C.to_available(F.col("word")).alias("available")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""with t as (select lower(x) as x from (select unnest([l_returnflag, {_STOCK_SQL}]) as x from lineitem))
select x as word, case when trim(x) in ({quoted(C.FEED_YES)}) then true when trim(x) in ({quoted(C.FEED_NO)}) then false end as feed,
case when trim(x) in ({quoted(C.SERVE_YES)}) then true when trim(x) in ({quoted(C.SERVE_NO)}) then false else false end as serve, count(*) as n from t group by all""")
def c4_to_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.table(spark, sf_dir, "lineitem").select(F.explode(F.array("l_returnflag", _stock())).alias("word")).select(F.lower("word").alias("word"))
    word = F.col("word")
    return rows.groupBy("word", C.to_bool(word, "feed").alias("feed"), C.to_bool(word, "serve", False).alias("serve")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""select p_partkey, {sql_slug("p_name || ' & ' || p_brand || '!'")} as slug,
substring(regexp_replace(regexp_replace(regexp_replace(lower('HTTPS://' || p_name || ' ' || p_type), '^https?://', ''), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 12) as cut from part""")
def c5_slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_name", F.lit(" & "), "p_brand", F.lit("!"))
    return V.table(spark, sf_dir, "part").select("p_partkey", C.slugify(name).alias("slug"), C.slugify(F.concat(F.lit("HTTPS://"), "p_name", F.lit(" "), "p_type"), 12).alias("cut"))


SHAPE = "'(?i)^(https?)://([^/?#:]+)(:[0-9]+)?([^?#]*)(\\?[^#]*)?'"


def sql_part(x: str, n: int) -> str:
    return f"regexp_extract({x}, {SHAPE}, {n})"


@query(f"""with t as (select page_id, regexp_replace(regexp_replace(lower({sql_part('url', 2)}), '^www\\.', ''), '\\.myshopify\\.com$', '') as h, url from pages)
select page_id, case when {sql_slug('h')} <> '' then {sql_slug('h')} else 'store-' || substring(sha1(url), 1, 8) end as slug from t""")
def c6_store_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "pages").select("page_id", U.store_slug(F.col("url")).alias("slug"))


def _html_sql(x: str) -> str:
    steps = [("(?i)<style[\\s\\S]*?</style>", " "), ("(?i)<script[\\s\\S]*?</script>", " "), ("<[^>]+>", " "), ("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&quot;", '"'), ("(?i)&#39;|&apos;", "''"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("\\s+", " ")]
    for pattern, new in steps:
        x = f"regexp_replace({x}, '{pattern}', '{new}', 'g')"
    return f"nullif(trim({x}), '')"


@query(f"select page_id, {_html_sql('html')} as text from pages")
def c7_html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "pages").select("page_id", C.html_to_text(F.col("html")).alias("text"))


def sql_url(x: str) -> str:
    """normalize_url in DuckDB's SQL, as an expression over x."""
    p = f"regexp_replace({sql_part(x, 4)}, '/+', '/', 'g')"
    path = f"regexp_replace(case when {p} in ('', '/') then '/' else regexp_replace({p}, '/+$', '') end, '(?i)^/(?:[a-z]{{2}}(?:-[a-z]{{2}})?|undefined-undefined)/(products?/.+)$', '/\\1')"
    pairs = f"""list_filter(list_transform(list_filter(string_split(substring({sql_part(x, 5)}, 2), '&'), lambda p: p <> ''),
      lambda p: {{'k': regexp_extract(p, '^([^=]*)', 1), 'v': regexp_extract(p, '^[^=]*=(.*)$', 1)}}), lambda p: not regexp_matches(p.k, '(?i)^(utm_|fbclid$|gclid$|mc_cid$|mc_eid$)'))"""
    query = f"coalesce(array_to_string(list_transform(list_sort({pairs}), lambda p: p.k || '=' || p.v), '&'), '')"
    return f"""case when {sql_part(x, 1)} <> '' then lower({sql_part(x, 1)}) || '://' || lower({sql_part(x, 2)})
      || case when (lower({sql_part(x, 1)}) = 'http' and {sql_part(x, 3)} = ':80') or (lower({sql_part(x, 1)}) = 'https' and {sql_part(x, 3)} = ':443') then '' else {sql_part(x, 3)} end
      || {path} || case when contains(lower({path}), '/products/') or contains(lower({path}), '/product/') or {query} = '' then '' else '?' || {query} end end"""


@query(f"""select page_id, {sql_url('trim(url)')} as url_norm, {sql_url("replace(trim(url), '.com/', '.com:443/en-us/products//') || '?b=2&a=1&utm_x=9'")} as product_norm,
regexp_replace({sql_url("'https://' || lower(" + sql_part('url', 2) + ") || '//'")}, '/$', '') as store_norm from pages""")
def c8_normalize_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    made = F.concat(F.replace(F.trim(url), F.lit(".com/"), F.lit(".com:443/en-us/products//")), F.lit("?b=2&a=1&utm_x=9"))
    return V.table(spark, sf_dir, "pages").select(
        "page_id", U.normalize_url(url).alias("url_norm"), U.normalize_url(made).alias("product_norm"), U.normalize_store_url(F.concat(U.host(url), F.lit("//"))).alias("store_norm")
    )


@query(f"""with u as (select page_id, regexp_extract(trim(url), '^https?://([^/?#]+)', 1) as h, regexp_replace({sql_url('trim(url)')}, '^https?://[^/?#]+', '') as tail from pages)
select page_id, case (page_id % 7)::int when 0 then 'https://user:p%40w@' || lower(h) || tail when 1 then 'http://[2001:db8::a]:8080' || tail when 2 then 'https://name@' || lower(h) || tail when 3 then 'https://' || lower(h) || tail
  when 4 then 'http://a@b:c@' || lower(h) || ':8443' || tail end as url_norm, case (page_id % 7)::int when 1 then '[2001:db8::a]' when 5 then lower(h) when 6 then '' else lower(h) end as host from u""")
def c8_url_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs with credentials, IPv6 hosts, odd ports, and two that are none: a port out of range and a bracket left open."""
    url = F.trim("url")
    h, rest = F.regexp_extract(url, "^https?://([^/?#]+)", 1), F.regexp_replace(url, "^https?://[^/?#]+", "")
    heads = [
        F.concat(F.lit("https://user:p%40w@"), F.upper(h), F.lit(":443")), F.lit("http://[2001:DB8::A]:8080"), F.concat(F.lit("HTTPS://name:@"), h, F.lit(":00443")), F.concat(F.lit("https://@"), h, F.lit(":")),
        F.concat(F.lit("http://a@b:c@"), h, F.lit(":8443")), F.concat(F.lit("https://"), h, F.lit(":99999")), F.lit("http://[::1"),
    ]
    made = F.concat(F.element_at(F.array(*heads), (F.col("page_id") % 7 + 1).cast("int")), rest)
    return V.table(spark, sf_dir, "pages").select("page_id", U.normalize_url(made).alias("url_norm"), U.host(made).alias("host"))


def sql_score(x: str) -> str:
    path, query = f"lower({sql_part(x, 4)})", sql_part(x, 5)
    return f"""(case when contains({path}, '/products/') then 100 else 0 end + case when contains({path}, '/product/') then 80 else 0 end + case when contains({path}, '/collections/') then 8 else 0 end
      + case when contains({path}, 'item') or contains({path}, 'sku') then 15 else 0 end + case when regexp_matches({query}, '[?&](product|sku)(=|&|$)') then 20 else 0 end
      + case when regexp_matches({query}, '(?i)\\b(variant|color|size)=') then 5 else 0 end)"""


SQL_SHOP_URL = "case page_id % 5 when 0 then replace(url, '.com/', '.com/products/') when 1 then replace(url, '.com/', '.com/collections/') when 2 then replace(url, '.com/', '.com/item/') || '?sku=1&color=red' else url end"


def shop_url():
    """Page URLs, some made to look like product, collection and item pages."""
    k = F.col("page_id") % 5
    put = lambda x: F.replace("url", F.lit(".com/"), F.lit(f".com/{x}/"))
    return F.when(k == 0, put("products")).when(k == 1, put("collections")).when(k == 2, F.concat(put("item"), F.lit("?sku=1&color=red"))).otherwise(F.col("url"))


@query(f"select page_id, {sql_score(SQL_SHOP_URL)} as score from pages")
def c9_url_product_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "pages").select("page_id", U.url_product_score(shop_url()).alias("score"))


@query(f"""with t as (select page_id, lower({SQL_SHOP_URL} || case when page_id % 3 = 0 then '?variant=4' when page_id % 7 = 0 then '&variant=4' else '' end) as u from pages)
select page_id, contains(u, '/products/') or contains(u, '/product/') or contains(u, '?variant=') as strict, contains(u, '/products/') or contains(u, '/product/') or contains(u, 'variant=') as loose,
contains(u, '/collections/') as collection from t""")
def c10_url_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.when(F.col("page_id") % 3 == 0, "?variant=4").when(F.col("page_id") % 7 == 0, "&variant=4").otherwise("")
    u = F.concat(shop_url(), more)
    return V.table(spark, sf_dir, "pages").select("page_id", U.is_product_url(u, True).alias("strict"), U.is_product_url(u).alias("loose"), U.is_collection_url(u).alias("collection"))


SQL_DISTINCT = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


@query("""with t as (select p_partkey, list_filter(list_transform(string_split(p_name || ', ,' || p_brand || ',' || p_name, ','), lambda x: trim(x)), lambda x: x <> '') as l,
list_filter([trim(p_type), trim(p_type), p_brand], lambda x: x <> '') as j from part)
select p_partkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') as tags, array_to_string(list_filter(j, lambda x, i: list_position(j, x) = i), '|') as json_tags from t""")
def c11_parse_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("p_name", F.lit(", ,"), "p_brand", F.lit(","), "p_name")
    as_json = F.to_json(F.array(F.concat(F.lit(" "), "p_type"), "p_type", "p_brand"))
    return V.table(spark, sf_dir, "part").select("p_partkey", F.array_join(C.parse_tags(text), "|").alias("tags"), F.array_join(C.parse_tags(as_json), "|").alias("json_tags"))


SQL_TOKENS = (
    V.SQL_PRODUCTS
    + """, of_v as (select v.partkey, flatten(list([lower(v.size) || ' variant', 'size', lower(v.size), 'color', lower(p.color)] order by v.id)) as l from variants v join products p using (partkey) group by v.partkey),
raw_tokens as (select partkey, list_transform(tags, lambda x: lower(trim(x))) || ['size', 's', 'm', 'l', 'color', lower(color)] || l || [lower(title), lower(product_type)] as l from products join of_v using (partkey)),
tokens as (select partkey, list_filter(l, lambda x, i: list_position(l, x) = i) as option_tokens from raw_tokens)"""
)


@query(f"""with {SQL_TOKENS} select partkey, array_to_string(list_sort(option_tokens), '|') as tokens from tokens""")
def c12_option_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.products(spark, sf_dir)
    tokens = C.option_tokens(F.col("tags"), F.col("options"), F.col("variants"), F.col("title"), F.col("product_type"))
    return p.select(F.col("p_partkey").alias("partkey"), F.array_join(F.array_sort(tokens), "|").alias("tokens"))


@query("""select p_partkey, trim(p_name) || ' ' || trim(p_brand) || case when p_partkey % 3 = 0 then '' else ' ' || trim(p_type) end || ' a b' as text from part""")
def c13_search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_partkey") % 3 == 0, "  ").otherwise(F.col("p_type"))
    text = C.search_text(F.col("p_name"), F.col("p_brand"), F.lit(None).cast("string"), F.lit(" "), F.lit(None).cast("string"), kind, F.array(F.lit("a"), F.lit("b")))
    return V.table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))


SQL_SUMMARY = """title || ': ' || product_type || ' ' || case when available then 'in stock' else 'currently unavailable' end
  || case when price_min = price_max then ' at $' || format('{:.2f}', price_min / 100.0) else ' from $' || format('{:.2f}', price_min / 100.0) || ' to $' || format('{:.2f}', price_max / 100.0) end"""


@query(f"""with {V.SQL_PRODUCTS} select partkey, {SQL_SUMMARY} || '. Tags: ' || array_to_string(tags[1:3], ', ') || '.' as summary, {SQL_SUMMARY} || '.' as short from products""")
def c14_summary_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.products(spark, sf_dir)
    args = [F.col(c) for c in ("price_min", "price_max", "available")]
    with_tags = C.summary_short(F.col("title"), F.col("product_type"), F.col("tags"), *args)
    return p.select(F.col("p_partkey").alias("partkey"), with_tags.alias("summary"), C.summary_short(F.col("title"), F.col("product_type"), None, *args).alias("short"))


@query("""select p_partkey, sha1('{"title":"' || p_name || '","price":' || floor(p_retailprice)::bigint || ',"brand":null,"tags":["' || p_type || '"]}') as hash from part""")
def c15_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = C.content_hash(title=F.col("p_name"), price=F.floor("p_retailprice"), brand=F.lit(None).cast("string"), tags=F.array("p_type"))
    return V.table(spark, sf_dir, "part").select("p_partkey", h.alias("hash"))


@query(f"""with t as (select page_id, case when page_id % 4 = 0 then ' Big Sale ' end as h, regexp_extract(regexp_replace({sql_part('url', 4)}, '/+$', ''), '([^/]+)$', 1) as last, url from pages),
d as (select page_id, url, case when h is not null then {sql_slug('h')} when last <> '' then {sql_slug('last')} else 'a-title' end as handle from t)
select page_id, handle, handle || '-' || substring(sha1(handle || '|' || url), 1, 12) as product_id from d""")
def c16_derive_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("page_id") % 4 == 0, " Big Sale ")
    rows = V.table(spark, sf_dir, "pages").select("page_id", "url", C.derive_handle(given, F.col("url"), F.lit("A title")).alias("handle"))
    return rows.select("page_id", "handle", C.derive_product_id(F.lit(" "), F.col("handle"), F.col("url")).alias("product_id"))


@query(f"""select page_id, contains(lower({SQL_SHOP_URL}), '/products/') or contains(lower({SQL_SHOP_URL}), '/product/') or page_id % 9 = 0 as is_catalog from pages""")
def c17_is_catalog_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.when(F.col("page_id") % 9 == 0, F.lit(100))
    none = F.array().cast("array<struct<id:string>>")
    return V.table(spark, sf_dir, "pages").select("page_id", C.is_catalog_product(shop_url(), none, F.lit(None).cast("long"), price).alias("is_catalog"))


@query("""select l_orderkey, l_partkey, l_suppkey, l_linenumber, case when l_linenumber % 2 = 0 then 'Ship Mode=' || l_returnflag || '|Size=' || l_linenumber else 'Option 1=' || l_returnflag || '|Option 2=' || l_linestatus end as ingest,
case when l_linenumber % 2 = 0 then 'ship MODE=' || l_returnflag || '|size=' || l_linenumber else 'Option 1=' || l_returnflag || '|Option 3=' || l_linestatus end as serve from lineitem""")
def c18_variant_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = V.table(spark, sf_dir, "lineitem")
    none = F.lit(None).cast("string")
    named = F.create_map(F.lit(" ship  MODE"), F.concat(F.col("l_returnflag"), F.lit(" ")), F.lit("size"), F.col("l_linenumber").cast("string"), F.lit("blank"), F.lit(" "))
    options = F.when(F.col("l_linenumber") % 2 == 0, named)
    at = F.array("l_returnflag", F.lit(" "), "l_linestatus")
    plain = F.when(F.col("l_linenumber") % 2 == 0, F.create_map(F.lit(" ship MODE"), "l_returnflag", F.lit("size"), F.col("l_linenumber").cast("string")))
    show = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return line.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", show(C.variant_options(options, at, True)).alias("ingest"), show(C.variant_options(plain, F.array("l_returnflag", none, "l_linestatus"))).alias("serve"))


@query("""with t as (select page_id, case page_id % 4 when 0 then url when 1 then '//cdn.example.com/x' when 2 then '/p/' || page_id else 'p/' || page_id end as u from pages)
select page_id, case when regexp_matches(lower(u), '^https?://') then u when u like '//%' then 'https:' || u when u like '/%' then 'https://s.example.com' || u else 'https://s.example.com/' || u end as link from t""")
def c19_product_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, page = F.col("page_id") % 4, F.col("page_id").cast("string")
    u = F.when(k == 0, F.col("url")).when(k == 1, "//cdn.example.com/x").when(k == 2, F.concat(F.lit("/p/"), page)).otherwise(F.concat(F.lit("p/"), page))
    return V.table(spark, sf_dir, "pages").select("page_id", C.product_link(u, F.lit("https://s.example.com//")).alias("link"))


SQL_BUDGET = """(case when {lo} is null and {hi} is null then 1.0 when {hi} is not null and price_min > {hi} then 0.0 when {lo} is not null and price_max < {lo} then 0.0
  when {hi} is not null then least(1.0, greatest(0.1, 1.0 - price_min::double / greatest(1, {hi}) * 0.5)) else 1.0 end)"""


@query(f"""with {V.SQL_PRODUCTS}, b as (select *, case when partkey % 3 = 0 then 100000 end as hi, case when partkey % 2 = 0 then 150000 end as lo from products)
select partkey, round({SQL_BUDGET.format(lo='lo', hi='hi')}::double, 6) as fit from b""")
def c20_budget_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    hi, lo = F.when(F.col("p_partkey") % 3 == 0, 100000), F.when(F.col("p_partkey") % 2 == 0, 150000)
    return V.products(spark, sf_dir).select(F.col("p_partkey").alias("partkey"), F.round(C.budget_fit(F.col("price_min"), F.col("price_max"), lo, hi), 6).alias("fit"))


@query(f"""with t as (select doc_id, (['Deep', 'medium ', 'fair', 'teal', ''])[(doc_id % 5 + 1)::int] as tone, lower(text) as q from documents)
select doc_id, case lower(trim(tone)) when 'deep' then '{"|".join(C.TONES[0][1])}' when 'medium' then '{"|".join(C.TONES[1][1])}' when 'fair' then '{"|".join(C.TONES[2][1])}' else lower(trim(tone)) end as tokens,
case when regexp_matches(q, 'deep|dark|darker|deeper|rich') then 'dark' when regexp_matches(q, 'tan|medium|olive') then 'medium' when regexp_matches(q, 'light|fair|pale') then 'light' end as inferred from t""")
def c21_tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    tone = F.element_at(F.array(*map(F.lit, ["Deep", "medium ", "fair", "teal", ""])), (F.col("doc_id") % 5 + 1).cast("int"))
    return V.table(spark, sf_dir, "documents").select("doc_id", F.array_join(C.tone_tokens(tone), "|").alias("tokens"), C.infer_tone(F.col("text")).alias("inferred"))


@query(f"""with {SQL_TOKENS}, w as (select partkey, unnest(string_split_regex(translate(lower(title || ' ' || product_type || ' ' || handle || ' ' || array_to_string(tags, ' ') || ' ' || array_to_string(option_tokens, ' ')), '/-', '  '), '\\s+')) as word
from products join tokens using (partkey)) select partkey, string_agg(distinct word, '|' order by word) as words from w where word <> '' group by partkey""")
def c22_product_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.full_products(spark, sf_dir)
    words = C.product_tokens(*[F.col(c) for c in ("title", "product_type", "handle", "tags", "option_tokens", "variants")])
    return p.select(F.col("p_partkey").alias("partkey"), F.array_join(F.array_sort(words), "|").alias("words"))


@query("""with t as (select o_orderkey, floor(o_totalprice)::bigint % 900 as discovered, floor(o_totalprice)::bigint % 1000 as crawled, (o_orderkey % 150) / 100.0 as ratio from orders)
select o_orderkey, round(case when discovered > 0 then least(crawled, discovered)::double / discovered * 100 else least(100.0, greatest(0.0, case when ratio <= 1 then ratio * 100 else ratio end)) end, 6)::double as pct from t""")
def c23_coverage_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.floor("o_totalprice")
    pct = C.coverage_pct(total % 900, total % 1000, (F.col("o_orderkey") % 150) / F.lit(100.0))
    return V.table(spark, sf_dir, "orders").select("o_orderkey", F.round(pct, 6).alias("pct"))
