"""Queries of baskets and checkouts."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..operators import baskets as B
from ..sources.shared import new_path
from ..streaming import baskets as stream
from . import views as V
from .catalog_queries import SQL_RESOLVE, resolve_requests

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
PS = V.SQL_STORES


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""with {V.SQL_EVENTS} select basket_id, seq, case when op = 'add' and coalesce(quantity - 2, 1) <= 0 then 'invalid_quantity' end as reason,
case when op = 'add' then greatest(1, least(99, coalesce(quantity - 2, 1))) when op = 'set' and quantity * 60 > 0 then greatest(1, least(99, quantity * 60)) when op = 'set' then 0 end::bigint as quantity from log""")
def b1_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.basket_events(spark, sf_dir)
    e = e.withColumn("quantity", F.when(F.col("op") == "add", F.col("quantity") - 2).otherwise(F.col("quantity") * 60))
    return B.checked_changes(e).select("basket_id", "seq", "reason", F.col("quantity").cast("long").alias("quantity"))


#: The fold as SQL: events after a line's last delete; its last set after the first add, or 0, and the adds behind it.
SQL_LINES = """lines as (select * from {log} where op in ('add', 'set', 'remove')), vs as (select distinct basket_id, variant_id from lines),
every as (select basket_id, seq, op, variant_id, quantity, unit_price from lines union all select c.basket_id, c.seq, c.op, v.variant_id, null, null from {log} c join vs v using (basket_id) where c.op = 'clear'),
dels as (select *, max(seq) filter (op in ('remove', 'clear') or (op = 'set' and quantity <= 0)) over (partition by basket_id, variant_id) as gone from every),
rest as (select *, min(seq) filter (op = 'add') over (partition by basket_id, variant_id) as first_add from dels where gone is null or seq > gone),
born as (select *, max(seq) filter (op = 'set') over (partition by basket_id, variant_id) as last_set from rest where seq >= first_add),
folded as (select basket_id, variant_id, sum(case when last_set is null or seq >= last_set then quantity else 0 end)::bigint as quantity, min(first_add) as added_seq, max_by(unit_price, seq) filter (op = 'add') as unit_price from born group by 1, 2)"""


@query(f"with {V.SQL_EVENTS}, {SQL_LINES.format(log='log')} select * from folded")
def b2_fold_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.fold_lines(V.basket_events(spark, sf_dir)).select("basket_id", "variant_id", F.col("quantity").cast("long").alias("quantity"), "added_seq", "unit_price")


#: Live lines at each checkout: each variant's state, carried on, then summed up.
SQL_CLOSED = """all_lines as (select * from log where op in ('add', 'set', 'remove')), all_vs as (select distinct basket_id, variant_id from all_lines),
acts as (select basket_id, seq, variant_id, case when op = 'remove' or (op = 'set' and quantity <= 0) then 0 when op = 'add' then 1 end as state from all_lines union all select c.basket_id, c.seq, v.variant_id, 0 from log c join all_vs v using (basket_id) where c.op = 'clear'),
ends as (select basket_id, seq from log where op = 'checkout' and mark),
at_end as (select e.basket_id, e.seq, a.variant_id, max_by(a.state, a.seq) filter (a.state is not null) as state from ends e join acts a on a.basket_id = e.basket_id and a.seq < e.seq group by all),
closed as (select basket_id, min(seq) as closed_seq from (select basket_id, seq from at_end where state = 1 group by 1, 2) group by 1)"""


@query(f"""with {V.SQL_EVENTS}, {SQL_CLOSED}, open_log as (select l.* from log l left join closed c using (basket_id) where closed_seq is null or seq <= closed_seq), {SQL_LINES.format(log='open_log')}
select f.*, case when closed_seq is null then 'active' else 'checked_out' end as status from folded f left join closed using (basket_id)""")
def b6_fold_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = B.fold_baskets(V.basket_events(spark, sf_dir))
    return lines.select("basket_id", "variant_id", F.col("quantity").cast("long").alias("quantity"), "added_seq", "unit_price", "status")


SQL_TOTALS = (
    V.SQL_BASKETS
    + """, totals as (select basket_id, any_value(platform) as platform, any_value(store_url) as store_url, count(variant_id) as item_count, coalesce(sum(quantity), 0)::bigint as quantity_total, coalesce(sum(unit_price * quantity), 0)::bigint as subtotal,
  coalesce(string_agg(variant_id || ':' || least(99, quantity), ',' order by added_at, variant_id), '') as line from baskets left join basket_items using (basket_id) group by 1)"""
)


@query(f"with {SQL_TOTALS} select basket_id, item_count, quantity_total, subtotal, line from totals")
def b3_basket_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = B.basket_totals(V.baskets(spark, sf_dir), V.basket_items(spark, sf_dir))
    line = F.array_join(F.transform("items", lambda i: F.concat_ws(":", i["variant_id"], F.least(F.lit(99), i["quantity"]).cast("string"))), ",")
    return t.select("basket_id", "item_count", "quantity_total", "subtotal", line.alias("line"))


@query(f"""with {V.SQL_EVENTS} select case when basket_id::bigint % 11 = 0 then 'unknown_basket' when seq % 13 = 0 then 'wrong_store' when basket_id::bigint % 4 = 0 and not (op = 'checkout') then 'not_active' end as reason, op, count(*) as n from log group by all""")
def b4_validate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.basket_events(spark, sf_dir).withColumn("store_slug", F.when(F.col("seq") % 13 == 0, "b").when(F.col("seq") % 2 == 0, "a"))
    known = e.select("basket_id").distinct().where("cast(basket_id as bigint) % 11 <> 0")
    known = known.select("basket_id", F.lit("a").alias("store_slug"), F.when(F.col("basket_id").cast("long") % 4 == 0, "checked_out").otherwise(" Active").alias("status"))
    return B.validate_events(e, known).groupBy("reason", "op").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {SQL_TOTALS} select basket_id, case when item_count = 0 then 'empty_basket' when platform <> 'shopify' then 'unsupported_platform' end as reason,
case when item_count > 0 and platform = 'shopify' then 'https://shop.example.com/cart/' || replace(line, ':', '%2F%20~%2A:') end as checkout_url from totals""")
def b5_checkout_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = V.basket_items(spark, sf_dir).withColumn("variant_id", F.concat("variant_id", F.lit("/ ~*")))
    return B.checkout_links(B.basket_totals(V.baskets(spark, sf_dir), items)).select("basket_id", "reason", "checkout_url")


SQL_ADDS = (
    SQL_RESOLVE
    + """, adds as (select r.request_id, v.id as variant_id, greatest(1, least(99, request_id % 120 - 3)) as quantity, coalesce(v.price_cents, p.price_min, 0) as unit_price, p.url,
  case when request_id % 120 - 3 <= 0 then 'invalid_quantity' else coalesce(reason, case when not v.available then 'variant_unavailable' end) end as reason
  from resolved r left join v on v.id = r.variant_id left join products p on p.store_slug = r.store_slug and p.handle = r.handle)"""
)


@query(f"with {SQL_ADDS} select * from adds")
def b7_prepare_adds(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = resolve_requests(spark, sf_dir).withColumn("quantity", (F.col("request_id") % 120 - 3).cast("long"))
    made = B.prepare_adds(asked, V.products(spark, sf_dir), V.stores(spark, sf_dir))
    return made.select("request_id", "variant_id", "quantity", "unit_price", F.nullif("url", F.lit("")).alias("url"), "reason")


@query(f"""with {PS}, ranked as (select *, row_number() over (partition by store_slug order by partkey) as k from products), ask as (select store_slug as request_id, k as line, store_slug, handle, partkey from ranked),
best as (select partkey, id from (select partkey, id, row_number() over (partition by partkey order by id) as rn from variants where available) where rn = 1),
pick as (select a.*, b.id, coalesce(v.price_cents, 0) as price, case when b.id is null then 'variant_not_found' end as reason from ask a left join best b using (partkey) left join variants v on v.id = b.id),
bad as (select request_id, min(line) as failed_line, min_by(reason, line) as failed_reason from pick where reason is not null group by 1),
kept as (select p.* from pick p left join bad using (request_id) where failed_line is null or line < failed_line),
sums as (select request_id, count(*) as added_count, sum(price * 2)::bigint as subtotal, string_agg(id || ':2', ',' order by line) as line from kept group by 1)
select a.request_id, coalesce(added_count, 0) as added_count, failed_line, coalesce(subtotal, 0) as subtotal, coalesce(failed_reason, case when platform <> 'shopify' then 'unsupported_platform' end) as reason,
case when failed_line is null and platform = 'shopify' then s.url || '/cart/' || sums.line end as checkout_url
from (select distinct request_id, store_slug from ask) a join stores s on s.slug = a.store_slug left join bad using (request_id) left join sums using (request_id)""")
def b8_checkout_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.products(spark, sf_dir)
    k = F.row_number().over(W.partitionBy("store_slug").orderBy("p_partkey"))
    first = F.try_element_at(F.filter("variants", lambda v: v["available"]), F.lit(1))["id"]
    lines = p.withColumn("line", k).select(
        F.col("store_slug").alias("request_id"), "line", "store_slug", "handle", F.coalesce(first, F.lit("none")).alias("variant_id"), F.lit(None).cast("map<string,string>").alias("options"), F.lit(2).cast("long").alias("quantity")
    )
    return B.checkout_batch(lines, p, V.stores(spark, sf_dir)).select("request_id", "added_count", "failed_line", "subtotal", "reason", "checkout_url")


@query(ORACLES["b6_fold_baskets"])
def b9_stream_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replays the event table as a stream; the last state of each basket equals the batch fold."""
    stream.use_state_store(spark)
    at = new_path(spark, "baskets")
    schema = V.table(spark, sf_dir, "events").schema
    files = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    live = stream.stream_baskets(V.basket_events_of(files))
    q = live.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{at}/out/n={n}")).outputMode("update").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{at}/out").withColumn("last", F.max("n").over(W.partitionBy("basket_id")))
    return out.where("n = last and variant_id is not null").select("basket_id", "variant_id", "quantity", "added_seq", "unit_price", "status")


@query(ORACLES["b6_fold_baskets"])
def b9_handover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of the log folded as a batch, the rest as a stream that starts from it; some of the first half comes again and is late."""
    stream.use_state_store(spark)
    at = new_path(spark, "handover")
    events = V.basket_events(spark, sf_dir)
    half = (events.agg(F.max("seq")).first()[0] or 0) // 2
    so_far = stream.handover(events.where(F.col("seq") <= half))
    so_far.write.parquet(f"{at}/so-far")
    so_far = spark.read.parquet(f"{at}/so-far")
    files = spark.readStream.schema(V.table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    live = stream.stream_baskets(V.basket_events_of(files).where(F.col("seq") > half - 500), so_far)
    q = live.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{at}/out/n={n}")).outputMode("update").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    cols = ["basket_id", "variant_id", "quantity", "added_seq", "unit_price", "status"]
    out = spark.read.parquet(f"{at}/out").withColumn("last", F.max("n").over(W.partitionBy("basket_id"))).where("n = last")
    still = so_far.join(out.select("basket_id").distinct(), "basket_id", "left_anti").withColumn("status", F.when(F.col("closed_seq").isNull(), "active").otherwise("checked_out"))
    return out.select(*cols).unionByName(still.select(*cols)).where("variant_id is not null")
