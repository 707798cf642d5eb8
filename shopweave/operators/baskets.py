"""Baskets as a fold over their event log, totals, checkout links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import product_link
from .catalog import resolve_variants

MOST = 99  # fixed value: the largest quantity of one change
STRETCH = 4096  # seqs of one basket that are looked through together


def bounded(quantity: Column) -> Column:
    """A quantity of one change: at least 1, at most 99."""
    return F.greatest(F.lit(1), F.least(F.lit(MOST), F.coalesce(quantity, F.lit(1))))


def checked_changes(events: DataFrame) -> DataFrame:
    """Events with the quantity that counts: adds below 1 are rejected, sets below 1 delete, all else is bounded; reason tells why not."""
    q = F.col("quantity")
    reason = F.when((F.col("op") == "add") & (F.coalesce(q, F.lit(1)) <= 0), "invalid_quantity")
    count = F.when(F.col("op") == "add", bounded(q)).when((F.col("op") == "set") & (q > 0), bounded(q)).when(F.col("op") == "set", 0)
    return events.withColumns({"reason": reason, "quantity": count})


def fold_lines(events: DataFrame) -> DataFrame:
    """(basket_id, variant_id, quantity, added_seq, unit_price and other last-add columns) of the lines that the log leaves.

    events: (basket_id, seq, op, variant_id, quantity, ...), op add, set, remove or
    clear, in the order of seq. Adds sum up, a set replaces the quantity of a line that
    is there, remove, clear and a set below 1 delete it. Of the clears only the last of
    a basket counts: what comes before it is left out before any line is folded, and
    every line is folded by itself, partitioned by basket and variant.
    """
    events = checked_changes(events).where("reason is null and op in ('add', 'set', 'remove', 'clear')")
    cleared = events.where("op = 'clear'").groupBy("basket_id").agg(F.max("seq").alias("_cleared"))
    log = events.where("op <> 'clear'").join(cleared, "basket_id", "left").where("_cleared is null or seq > _cleared").drop("_cleared")
    gone = (F.col("op") == "remove") | ((F.col("op") == "set") & (F.col("quantity") <= 0))
    whole = W.partitionBy("basket_id", "variant_id")
    log = log.withColumn("_gone", F.max(F.when(gone, F.col("seq"))).over(whole)).where("_gone is null or seq > _gone")
    # what is left has no delete: adds and sets after the first add
    log = log.withColumn("_first", F.min(F.when(F.col("op") == "add", F.col("seq"))).over(whole)).where("seq >= _first")
    log = log.withColumn("_set", F.max(F.when(F.col("op") == "set", F.col("seq"))).over(whole))
    counts = F.when(F.col("_set").isNull() | (F.col("seq") >= F.col("_set")), F.col("quantity")).otherwise(0)
    carried = [c for c in ("unit_price", "handle", "title", "url", "options") if c in events.columns]
    last = [F.max_by(c, F.when(F.col("op") == "add", F.col("seq"))).alias(c) for c in carried]
    return log.groupBy("basket_id", "variant_id").agg(F.sum(counts).alias("quantity"), F.min("_first").alias("added_seq"), *last)


def closings(events: DataFrame, platforms: DataFrame | None = None) -> DataFrame:
    """(basket_id, closed_seq): the first marked checkout of a basket with a line in it, on the supported platform.

    platforms: (basket_id, platform); without it every basket is on that platform. A
    checkout counts if some add stands before it with neither a delete of its variant
    nor a clear of the basket in between; of the checkouts behind an add the next one
    decides. Deletes are looked up by basket and variant, the next checkout and clear
    in stretches of each basket's log, so a long log is not one task's work.
    """
    log = checked_changes(events).where("reason is null")
    gone = (F.col("op") == "remove") | ((F.col("op") == "set") & (F.col("quantity") <= 0))
    lines = log.where("op in ('add', 'set', 'remove')").withColumn("_gone", F.when(gone, F.col("seq")))
    ahead = W.partitionBy("basket_id", "variant_id").orderBy(F.desc("seq")).rowsBetween(W.unboundedPreceding, -1)  # read backwards, so what was seen last is next
    adds = lines.withColumn("_until", F.last("_gone", True).over(ahead)).where("op = 'add'")
    stops = log.where("op = 'clear' or op = 'checkout' and mark")
    out = _next_stops(adds.select("basket_id", "seq", "_until"), stops.select("basket_id", "seq", "op"))
    out = out.where("_checkout is not null and (_until is null or _checkout < _until) and (_clear is null or _checkout < _clear)")
    if platforms is not None:
        out = out.join(platforms.where("platform = 'shopify'").select("basket_id"), "basket_id", "left_semi")
    return out.groupBy("basket_id").agg(F.min("_checkout").alias("closed_seq"))


def _next_stops(adds: DataFrame, stops: DataFrame) -> DataFrame:
    """adds with _checkout and _clear, the seq of the next marked checkout and clear of the basket.

    Each basket's log is cut into stretches of STRETCH seqs. A stretch is looked
    through by itself; what it lacks is taken from the first stops of later ones, of
    which there is one row a stretch.
    """
    kinds = {"_checkout": "checkout", "_clear": "clear"}
    seqs = {c: F.when(F.col("op") == op, F.col("seq")) for c, op in kinds.items()}
    stretch = F.floor(F.col("seq") / STRETCH).alias("_stretch")
    rows = adds.withColumn("op", F.lit("add")).unionByName(stops, allowMissingColumns=True).select("*", stretch)
    firsts = rows.groupBy("basket_id", "_stretch").agg(*[F.min(s).alias(c) for c, s in seqs.items()])
    later = W.partitionBy("basket_id").orderBy(F.desc("_stretch")).rowsBetween(W.unboundedPreceding, -1)
    firsts = firsts.select("basket_id", "_stretch", *[F.last(c, True).over(later).alias(f"{c}_later") for c in kinds])
    here = W.partitionBy("basket_id", "_stretch").orderBy(F.desc("seq")).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.select("*", *[F.last(s, True).over(here).alias(c) for c, s in seqs.items()]).where("op = 'add'")
    rows = rows.join(firsts, ["basket_id", "_stretch"], "left")
    return rows.select("basket_id", "seq", "_until", *[F.coalesce(c, f"{c}_later").alias(c) for c in kinds])


def open_events(events: DataFrame, closed: DataFrame) -> DataFrame:
    """The events up to a basket's closing."""
    return events.join(closed, "basket_id", "left").where("closed_seq is null or seq <= closed_seq").drop("closed_seq")


def fold_baskets(events: DataFrame, platforms: DataFrame | None = None) -> DataFrame:
    """Lines of every basket after its log, changes after its closing left out, with its status."""
    closed = closings(events, platforms)
    lines = fold_lines(open_events(events, closed))
    return lines.join(closed, "basket_id", "left").withColumn("status", F.when(F.col("closed_seq").isNotNull(), "checked_out").otherwise("active"))


def validate_events(events: DataFrame, baskets: DataFrame) -> DataFrame:
    """Events with the reason they are rejected: unknown_basket, wrong_store, not_active; null for good ones.

    A checkout of a checked-out basket is allowed. baskets: (basket_id, store_slug, status).
    """
    known = baskets.select("basket_id", F.col("store_slug").alias("_store"), F.lower(F.trim("status")).alias("_status"))
    both = events.join(known, "basket_id", "left")
    again = (F.col("op") == "checkout") & (F.col("_status") == "checked_out")
    reason = F.when(F.col("_store").isNull(), "unknown_basket").when(F.col("store_slug").isNotNull() & (F.col("store_slug") != F.col("_store")), "wrong_store").when((F.col("_status") != "active") & ~again, "not_active")
    return both.withColumn("reason", reason).drop("_store", "_status")


def basket_totals(baskets: DataFrame, items: DataFrame) -> DataFrame:
    """Each basket with item_count, quantity_total, subtotal and its items by added_at, then variant; empty ones stay."""
    quantity = F.greatest(F.lit(1).cast("long"), F.coalesce("quantity", F.lit(1)).cast("long"))
    total = F.greatest(F.lit(0).cast("long"), F.coalesce("unit_price", F.lit(0)).cast("long")) * quantity
    rows = items.withColumns({"quantity": quantity, "line_total": total})
    item = F.struct("added_at", "variant_id", "unit_price", "quantity", "line_total")
    sums = rows.groupBy("basket_id").agg(F.count(F.lit(1)).alias("item_count"), F.sum("quantity").alias("quantity_total"), F.sum("line_total").alias("subtotal"), F.sort_array(F.collect_list(item)).alias("items"))
    out = baskets.join(sums, "basket_id", "left")
    return out.fillna(0, ["item_count", "quantity_total", "subtotal"]).withColumn("items", F.coalesce("items", F.array().cast(dict(sums.dtypes)["items"])))


def percent_encoded(c: Column) -> Column:
    """Percent encoding that leaves letters, digits, - . _ ~ alone."""
    out = F.url_encode(c)
    for new, old in [("%20", "+"), ("%2A", "*"), ("~", "%7E")]:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def checkout_links(totals: DataFrame) -> DataFrame:
    """basket_totals with platform and store_url: checkout_url, or why there is none (empty_basket, unsupported_platform, missing_variant_ids)."""
    blank = lambda i: F.trim(F.coalesce(i["variant_id"], F.lit(""))) == ""
    line = lambda i: F.concat(percent_encoded(F.trim(i["variant_id"])), F.lit(":"), F.greatest(F.lit(1), F.least(F.lit(MOST), i["quantity"])).cast("string"))
    reason = F.when(F.size("items") == 0, "empty_basket").when(F.coalesce("platform", F.lit("unknown")) != "shopify", "unsupported_platform").when(F.exists("items", blank), "missing_variant_ids")
    url = F.concat(F.regexp_replace(F.trim("store_url"), "/+$", ""), F.lit("/cart/"), F.array_join(F.transform("items", line), ","))
    return totals.withColumn("reason", reason).withColumn("checkout_url", F.when(F.col("reason").isNull(), url))


def prepare_adds(requests: DataFrame, products: DataFrame, stores: DataFrame | None = None) -> DataFrame:
    """Requests (request_id, store_slug, handle, variant_id, options, quantity) as add events: variant, price and options copied; reason tells why not.

    A variant without a price gets the product's lowest one, else 0; an unavailable one is refused.
    """
    rows = resolve_variants(requests, products)
    if stores is not None:
        rows = rows.join(stores.select(F.col("slug").alias("store_slug"), F.col("url").alias("_store_url")), "store_slug", "left")
    v, q = F.col("variant"), F.coalesce("quantity", F.lit(1))
    late = F.when(F.trim(F.coalesce(v["id"], F.lit(""))) == "", "missing_variant_id").when(~F.coalesce(v["available"], F.lit(False)), "variant_unavailable")
    reason = F.when(q <= 0, "invalid_quantity").otherwise(F.coalesce("reason", late))
    keep = [c for c in requests.columns if c not in ("options", "variant_id", "quantity")]
    return rows.select(
        *keep, F.trim(v["id"]).alias("variant_id"), bounded(q).alias("quantity"), F.coalesce(v["price_cents"], F.col("product_price"), F.lit(0).cast("long")).alias("unit_price"),
        F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.col("handle")).alias("title"), product_link(F.col("url"), F.col("_store_url") if stores is not None else F.lit(None).cast("string")).alias("url"),
        v["options"].alias("options"), reason.alias("reason"),
    )


def checkout_batch(lines: DataFrame, products: DataFrame, stores: DataFrame) -> DataFrame:
    """One-shot checkouts of (request_id, line, store_slug, handle, variant_id, options, quantity) lines.

    Lines are added in order up to the first that fails; a request with a failing line
    gets no link but its reason, line and how many were added before it.
    """
    ready = prepare_adds(lines, products, stores)
    bad = ready.where("reason is not null").groupBy("request_id").agg(F.min("line").alias("failed_line"), F.min_by("reason", "line").alias("failed_reason"))
    kept = ready.join(bad, "request_id", "left").where("failed_line is null or line < failed_line")
    items = kept.groupBy("request_id", "variant_id").agg(F.max_by("unit_price", "line").alias("unit_price"), F.sum("quantity").alias("quantity"), F.min("line").alias("added_at"))
    added = kept.groupBy("request_id").agg(F.count(F.lit(1)).alias("added_count"))
    asked = lines.groupBy("request_id").agg(F.min_by("store_slug", "line").alias("store_slug")).withColumnRenamed("request_id", "basket_id")
    asked = asked.join(stores.select(F.col("slug").alias("store_slug"), "platform", F.col("url").alias("store_url")), "store_slug", "left")
    linked = checkout_links(basket_totals(asked, items.withColumnRenamed("request_id", "basket_id"))).withColumnRenamed("basket_id", "request_id")
    out = linked.join(bad, "request_id", "left").join(added, "request_id", "left")
    failed = F.col("failed_reason").isNotNull()
    return out.withColumns({"reason": F.coalesce("failed_reason", "reason"), "checkout_url": F.when(~failed, F.col("checkout_url")), "added_count": F.coalesce("added_count", F.lit(0))}).drop("failed_reason")
