"""Money, availability, text, tag, option and scoring expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# fixed values: what the ingest side reads as available or not
INGEST_YES = ["instock", "in stock", "available", "true", "1", "http://schema.org/instock", "https://schema.org/instock"]
INGEST_NO = ["outofstock", "out of stock", "soldout", "sold out", "unavailable", "false", "0", "http://schema.org/outofstock", "https://schema.org/outofstock"]
# fixed values: flags in feeds, and flags at serving
FEED_YES = ["true", "1", "yes", "in stock", "instock", "available"]
FEED_NO = ["false", "0", "no", "out of stock", "outofstock", "sold out", "soldout", "unavailable"]
SERVE_YES = ["true", "t", "1", "yes", "y", "in stock", "available", "instock"]
SERVE_NO = ["false", "f", "0", "no", "n", "out of stock", "unavailable", "outofstock"]
VOCABULARIES = {"ingest": (INGEST_YES, INGEST_NO), "feed": (FEED_YES, FEED_NO), "serve": (SERVE_YES, SERVE_NO)}

# fixed values: words that speak for a tone, by the words that name it
TONES = [
    (["deep", "dark", "darker"], ["deep", "rich", "dark", "berry", "plum", "cocoa", "espresso", "mahogany", "fig", "ember", "vesper", "brown"]),
    (["tan", "medium"], ["tan", "medium", "rose", "mauve", "caramel", "spice", "warm", "neutral"]),
    (["light", "fair"], ["light", "fair", "pink", "peach", "nude", "cool", "soft"]),
]
# fixed values: words of a query that ask for a tone, first match wins
TONE_HINTS = [("dark", ["deep", "dark", "darker", "deeper", "rich"]), ("medium", ["tan", "medium", "olive"]), ("light", ["light", "fair", "pale"])]



def no_strings() -> Column:
    return F.array().cast("array<string>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def text_or_null(c: Column) -> Column:
    """Trimmed text, null when nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def num_to_cents(c: Column) -> Column:
    """A number in currency units as whole cents, half up, at least 0."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0), F.floor(c * 100 + 0.5)).cast("long"))


def to_cents(c: Column, thousands: bool = False) -> Column:
    """Price text at ingest as cents. Only the leading number counts, so "1,299.00" is 1 unit unless thousands is set."""
    s = F.regexp_replace(c, "[^0-9.,-]", "")
    s = F.regexp_replace(s, ",([0-9]{2})$", ".$1")
    if thousands:
        s = F.regexp_replace(s, ",", "")
    number = F.regexp_extract(s, r"^-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)", 0)
    # a plain price, the usual form, is read as it stands
    return F.when(c.rlike(r"^[0-9]{1,9}\.[0-9]{2}$"), F.replace(c, F.lit("."), F.lit("")).cast("long")).otherwise(let(F.nullif(number, F.lit("")).try_cast("double"), num_to_cents))


def serve_cents(c: Column) -> Column:
    """Price text at serving as cents: with a point it is currency units, without one it is cents already."""
    s = F.nullif(F.replace(F.trim(c), F.lit(","), F.lit("")), F.lit(""))
    units = F.round(s.try_cast("decimal(28,8)") * 100, 0).cast("long")
    return F.when(F.contains(s, F.lit(".")), units).otherwise(s.try_cast("decimal(28,0)").cast("long"))


def to_bool(c: Column, vocabulary: str = "feed", default: bool | None = None) -> Column:
    """Flag text by a vocabulary; anything else gives the default."""
    yes, no = VOCABULARIES[vocabulary]
    return let(F.lower(F.trim(c)), lambda word: F.when(word.isin(yes), True).when(word.isin(no), False).otherwise(F.lit(default).cast("boolean")))


def to_available(c: Column) -> Column:
    """Availability text at ingest: a listed word, or a number in stock, of which any above 0 is available; null when unknown."""
    return F.coalesce(to_bool(c, "ingest"), let(F.trim(c).try_cast("double"), lambda stock: F.when(~F.isnan(stock), stock > 0)))


def slugify(c: Column, max_len: int | None = None) -> Column:
    """Lower case, other runs than a-z and 0-9 as one dash, none at the ends. With max_len a scheme goes first and the rest is cut."""
    s = F.lower(F.trim(c))
    if max_len is not None:
        s = F.regexp_replace(s, "^https?://", "")
    s = F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return s if max_len is None else F.substring(s, 1, max_len)


def html_to_text(c: Column) -> Column:
    """Plain text of HTML: style and script blocks and tags out, seven entities decoded in order, white space squeezed."""
    s = F.regexp_replace(c, r"(?i)<style[\s\S]*?</style>", " ")
    s = F.regexp_replace(s, r"(?i)<script[\s\S]*?</script>", " ")
    s = F.regexp_replace(s, "<[^>]+>", " ")
    # fixed values: entities in the order they are decoded
    for entity, char in [("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;|&apos;", "'"), ("&lt;", "<"), ("&gt;", ">")]:
        s = F.regexp_replace(s, f"(?i){entity}", char)
    return text_or_null(F.regexp_replace(s, r"\s+", " "))


def clean_list(c: Column) -> Column:
    """Trimmed, non-empty, distinct texts in order; null gives an empty list."""
    trimmed = F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.array_distinct(trimmed), no_strings())


def parse_tags(c: Column) -> Column:
    """Tags from comma text or from the text of a JSON array."""
    as_json = F.from_json(c, "array<string>", {"mode": "PERMISSIVE"})
    return clean_list(F.when(F.startswith(F.ltrim(c), F.lit("[")), as_json).otherwise(F.split(c, ",")))


def lower_tokens(c: Column) -> Column:
    """Trimmed lower-case texts, non-empty and distinct, in order."""
    return clean_list(F.transform(F.filter(c, lambda x: x.isNotNull()), lambda x: F.lower(F.trim(x))))


def option_tokens(tags: Column, options: Column, variants: Column, title: Column, product_type: Column) -> Column:
    """Everything that can be asked for: tags, option names and values, variant titles and options, title, type."""
    of_options = F.flatten(F.transform(F.coalesce(options, F.array()), lambda o: F.concat(F.array(o["name"]), F.coalesce(o["values"], no_strings()))))

    def of_variant(v: Column) -> Column:
        pairs = F.flatten(F.transform(F.coalesce(F.map_entries(v["options"]), F.array()), lambda e: F.array(e["key"], e["value"])))
        return F.concat(F.array(v["title"]), pairs)

    of_variants = F.flatten(F.transform(F.coalesce(variants, F.array()), of_variant))
    return lower_tokens(F.array_distinct(F.concat(F.coalesce(tags, no_strings()), of_options, of_variants, F.array(title, product_type))))  # variants say the same again and again


def search_text(title: Column, handle: Column, description: Column, brand: Column, vendor: Column, product_type: Column, tags: Column) -> Column:
    """The non-empty ones of these, joined by spaces."""
    return F.concat_ws(" ", *[text_or_null(c) for c in (title, handle, description, brand, vendor, product_type, F.array_join(tags, " "))])


def dollars(cents: Column) -> Column:
    return F.concat(F.lit("$"), F.format_string("%.2f", cents / 100.0))


def price_phrase(price_min: Column, price_max: Column) -> Column:
    """ " at $x", " from $x to $y", " from $x", " up to $y" or nothing."""
    both = F.when(price_min == price_max, F.concat(F.lit(" at "), dollars(price_min))).otherwise(F.concat(F.lit(" from "), dollars(price_min), F.lit(" to "), dollars(price_max)))
    return (
        F.when(price_min.isNotNull() & price_max.isNotNull(), both)
        .when(price_min.isNotNull(), F.concat(F.lit(" from "), dollars(price_min)))
        .when(price_max.isNotNull(), F.concat(F.lit(" up to "), dollars(price_max)))
        .otherwise("")
    )


def summary_short(title: Column, product_type: Column, tags: Column | None, price_min: Column, price_max: Column, available: Column) -> Column:
    """One line: title, type, stock, price and, if tags are given, the first three of them."""
    stock = F.when(available, "in stock").otherwise("currently unavailable")
    line = F.concat(title, F.lit(": "), F.coalesce(text_or_null(product_type), F.lit("Product")), F.lit(" "), stock, price_phrase(price_min, price_max))
    if tags is None:
        return F.concat(line, F.lit("."))
    hint = F.array_join(F.slice(tags, 1, 3), ", ")
    return F.when(hint != "", F.concat(line, F.lit(". Tags: "), hint, F.lit("."))).otherwise(F.concat(line, F.lit(".")))


def content_hash(**fields: Column) -> Column:
    """sha1 of the given fields as one JSON object, nulls included, in the order given."""
    return F.sha1(F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"}))


def derive_handle(handle: Column, url: Column, title: Column) -> Column:
    """Slug of the given handle, else of the URL's last path part, else of the title, else "product"."""
    path = F.regexp_replace(F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1), "/+$", "")
    last = let(F.regexp_extract(path, "([^/]+)$", 1), lambda x: F.nullif(x, F.lit("")))
    named = F.coalesce(text_or_null(handle), last)
    return let(named, lambda x: F.when(x.isNotNull(), slugify(x)).otherwise(F.coalesce(let(slugify(title), lambda t: F.nullif(t, F.lit(""))), F.lit("product"))))


def derive_product_id(product_id: Column, handle: Column, url: Column) -> Column:
    """The given id, else the handle with 12 hex digits of the sha1 of handle|url."""
    made = F.concat(handle, F.lit("-"), F.substring(F.sha1(F.concat_ws("|", handle, F.coalesce(url, F.lit("")))), 1, 12))
    return F.coalesce(text_or_null(product_id), made)


def is_catalog_product(url: Column, variants: Column, price_min: Column, price_max: Column) -> Column:
    """A product path, a variant or a price."""
    low = F.lower(F.coalesce(url, F.lit("")))
    path = F.contains(low, F.lit("/products/")) | F.contains(low, F.lit("/product/"))
    return path | (F.coalesce(F.size(variants), F.lit(0)) > 0) | price_min.isNotNull() | price_max.isNotNull()


def variant_options(options: Column, positional: Column, title_case: bool = False) -> Column:
    """Option map without blanks; where it is empty, "Option n" for the given positional values. title_case as at ingest."""
    name = (lambda k: F.initcap(F.regexp_replace(F.trim(k), r"\s+", " "))) if title_case else F.trim
    entries = F.transform(F.coalesce(F.map_entries(options), F.array()), lambda e: F.struct(name(e["key"]).alias("key"), F.trim(e["value"]).alias("value")))
    named = let(F.filter(entries, lambda e: (e["key"] != "") & (e["value"] != "")), last_by_key)
    if title_case:  # blanks are left out before they are numbered
        given = F.filter(F.transform(positional, lambda x: F.trim(x)), lambda x: x != "")
        numbered = F.transform(given, lambda x, i: F.struct(F.concat(F.lit("Option "), (i + 1).cast("string")).alias("key"), x.alias("value")))
    else:
        numbered = F.transform(positional, lambda x, i: F.struct(F.concat(F.lit("Option "), (i + 1).cast("string")).alias("key"), F.trim(x).alias("value")))
        numbered = F.filter(numbered, lambda e: e["value"] != "")
    return F.map_from_entries(let(named, lambda n: F.when(F.size(n) > 0, n).otherwise(F.coalesce(numbered, n))))


def last_by_key(entries: Column) -> Column:
    """Entries with each key once, the last value, in order of the key's first place."""
    each = lambda keys: F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1))
    several = let(F.array_distinct(F.transform(entries, lambda e: e["key"])), lambda keys: F.when(F.size(keys) == F.size(entries), entries).otherwise(each(keys)))
    return F.when(F.size(entries) < 2, entries).otherwise(several)


def product_link(url: Column, store_url: Column) -> Column:
    """Absolute link of a product: full URLs stay, //x gets https, a path goes behind the store's URL."""
    base = F.regexp_replace(F.trim(F.coalesce(store_url, F.lit(""))), "/+$", "")

    def behind(u: Column) -> Column:
        path = F.when(F.startswith(u, F.lit("/")), u).otherwise(F.concat(F.lit("/"), u))
        return let(base, lambda b: F.when(b != "", F.concat(b, path)).otherwise(u))

    return let(
        F.trim(F.coalesce(url, F.lit(""))),
        lambda u: F.when(u == "", "").when(F.lower(u).rlike("^https?://"), u).when(F.startswith(u, F.lit("//")), F.concat(F.lit("https:"), u)).otherwise(behind(u)),
    )


def budget_fit(price_min: Column, price_max: Column, budget_min: Column, budget_max: Column) -> Column:
    """How well prices fit a budget, 0 to 1: 1 without one, 0.5 without a price, 0 outside, else lower the dearer."""
    floor, ceiling = F.coalesce(price_min, price_max), F.coalesce(price_max, price_min)
    inside = F.greatest(F.lit(0.1), 1.0 - floor / F.greatest(F.lit(1), budget_max) * 0.5)
    return (
        F.when(budget_min.isNull() & budget_max.isNull(), 1.0)
        .when(floor.isNull(), 0.5)
        .when(budget_max.isNotNull() & (floor > budget_max), 0.0)
        .when(budget_min.isNotNull() & (ceiling < budget_min), 0.0)
        .otherwise(F.when(budget_max.isNotNull(), F.least(F.lit(1.0), inside)).otherwise(1.0))
    )


def tone_tokens(c: Column) -> Column:
    """Words that speak for a tone; an unknown tone is its own word, none gives none."""
    tone = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    out = F.when(tone == "", no_strings())
    for names, words in TONES:
        out = out.when(tone.isin(names), F.array(*map(F.lit, words)))
    return out.otherwise(F.array(tone))


def infer_tone(query: Column) -> Column:
    """The tone that a query's text asks for, or null."""
    low = F.lower(F.trim(query))
    out = F.when(low == "", None)
    for tone, hints in TONE_HINTS:
        out = out.when(low.rlike("|".join(hints)), tone)
    return out


def product_tokens(title: Column, product_type: Column, handle: Column, tags: Column, tokens: Column, variants: Column) -> Column:
    """The distinct lower-case words of a product's texts; / and - part words."""
    of_variants = F.flatten(F.transform(F.coalesce(variants, F.array()), lambda v: F.concat(F.array(v["title"]), F.coalesce(F.map_values(v["options"]), no_strings()))))
    every = F.concat(F.array(title, product_type, handle), F.coalesce(tags, no_strings()), F.coalesce(tokens, no_strings()), of_variants)
    words = F.split(F.translate(F.lower(F.array_join(every, " ")), "/-", "  "), r"\s+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def coverage_pct(discovered: Column, crawled: Column, ratio: Column) -> Column:
    """Share of discovered URLs crawled, in per cent, at most 100; else a given ratio, which up to 1 is a fraction."""
    counted = F.least(crawled, discovered) / discovered * 100
    given = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.when(ratio <= 1, ratio * 100).otherwise(ratio)))
    return F.when(discovered > 0, counted).otherwise(given)
