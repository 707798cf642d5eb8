"""URL expressions, and the one helper for URLs relative to a page."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from .columns import let, slugify

#: Scheme, host (a name, or an IPv6 address in brackets), port, path and query of a whole URL; what stands before an @ is USER's.
SHAPE = r"(?s)^(?i:(https?))://(?:[^/?#]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@\[\]\s]+)(:[0-9]*)?(/[^?#]*)?(\?[^#]*)?(?:#.*)?$"
USER = r"^(?i:https?)://([^/?#]*)@"
# fixed values: names of tracking parameters, and the language parts that stand before product paths
TRACKING = "(?i)^(utm_|fbclid$|gclid$|mc_cid$|mc_eid$)"
LOCALE = r"(?i)^/(?:[a-z]{2}(?:-[a-z]{2})?|undefined-undefined)/(products?/.+)$"


def host(url: Column) -> Column:
    """Lower-case host, empty when there is none."""
    return F.lower(F.regexp_extract(url, SHAPE, 2))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def normalize_url(url: Column) -> Column:
    """Canonical http(s) URL, else null.

    Fragment, default port, tracking parameters, locale prefixes of product paths and
    spare slashes go; parameters are sorted by name, then value; product URLs lose
    their parameters. Names, values and credentials keep their escapes; credentials
    without a name or password, empty ports and zeros before a port go, a port above
    65535 gives null. Hosts are lower-cased; names of other scripts stay as they are.
    """
    return let(F.trim(url), lambda u: let(_pieces(u), _joined))


def _pieces(u: Column) -> Column:
    """Each piece of a URL is read once: the expressions of _joined name them often."""
    number = F.regexp_replace(F.regexp_extract(u, SHAPE, 3), "^:(?:0+(?=[0-9]))?", "")
    user = F.regexp_replace(F.regexp_extract(u, USER, 1), ":$", "")
    path = F.regexp_replace(F.regexp_extract(u, SHAPE, 4), "/+", "/")
    named = {"scheme": F.lower(F.regexp_extract(u, SHAPE, 1)), "user": user, "host": host(u), "number": number, "path": let(path, _bare_path), "query": F.substring(F.regexp_extract(u, SHAPE, 5), 2, 1 << 30)}
    return F.struct(*[c.alias(k) for k, c in named.items()])


def _bare_path(path: Column) -> Column:
    return F.regexp_replace(F.when(path.isin("", "/"), "/").otherwise(F.regexp_replace(path, "/+$", "")), LOCALE, "/$1")


def _joined(p: Column) -> Column:
    scheme, number = p["scheme"], p["number"]
    default = (scheme == "http") & (number == "80") | (scheme == "https") & (number == "443")
    port = F.when((number == "") | default, "").otherwise(F.concat(F.lit(":"), number))
    user = F.when(p["user"] == "", "").otherwise(F.concat(p["user"], F.lit("@")))
    possible = (F.length(number) < 5) | (F.length(number) == 5) & (number <= "65535")
    product = let(F.lower(p["path"]), lambda low: F.contains(low, F.lit("/products/")) | F.contains(low, F.lit("/product/")))
    query = F.when((p["query"] == "") | product, "").otherwise(let(_sorted_query(p["query"]), lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q))))
    return F.when((scheme != "") & possible, F.concat(scheme, F.lit("://"), user, p["host"], port, p["path"], query))


def _sorted_query(query: Column) -> Column:
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    pairs = F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, "^([^=]*)", 1).alias("k"), F.regexp_extract(p, "^[^=]*=(.*)$", 1).alias("v")))
    pairs = F.array_sort(F.filter(pairs, lambda p: ~p["k"].rlike(TRACKING)))
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")


def normalize_store_url(url: Column) -> Column:
    """A store's URL: https where no scheme is given, without the last slash."""
    u = F.trim(url)
    u = F.when(u.rlike("^(?i:https?)://"), u).otherwise(F.concat(F.lit("https://"), u))
    return F.regexp_replace(normalize_url(u), "/$", "")


def absolute(url: str | None, base: str | None) -> str | None:
    """A page's URL made absolute; an empty one gives None."""
    if not url or not url.strip():
        return None
    try:
        return urljoin(base or "", url.strip())
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def resolved(url: pd.Series, base: pd.Series) -> pd.Series:
    """URLs of a page made absolute; for normalize_url afterwards. Empty ones give null."""
    return pd.Series([absolute(u, b) for u, b in zip(url, base, strict=True)], dtype=object)


def store_slug(url: Column) -> Column:
    """Slug of the host without www. or, on the shared platform's domain, of its first label; else store- and 8 hex digits of the sha1."""
    u = F.when(F.trim(url).rlike("^(?i:https?)://"), F.trim(url)).otherwise(F.concat(F.lit("https://"), F.trim(url)))
    h = F.regexp_replace(bare_host(u), r"\.myshopify\.com$", "")
    slug = slugify(h)
    return F.when(slug != "", slug).otherwise(F.concat(F.lit("store-"), F.substring(F.sha1(url), 1, 8)))


def url_product_score(url: Column) -> Column:
    """How much a URL looks like a product page; additive."""
    path = F.lower(F.regexp_extract(url, SHAPE, 4))
    query = F.regexp_extract(url, SHAPE, 5)
    has = lambda x: F.contains(path, F.lit(x))
    points = [
        (has("/products/"), 100), (has("/product/"), 80), (has("/collections/"), 8), (has("item") | has("sku"), 15),
        (query.rlike("[?&](product|sku)(=|&|$)"), 20), (query.rlike(r"(?i)\b(variant|color|size)="), 5),
    ]
    return sum((F.when(test, n).otherwise(0) for test, n in points[1:]), F.when(points[0][0], points[0][1]).otherwise(0))


def is_product_url(url: Column, strict_variant: bool = False) -> Column:
    """A product path, or a variant parameter (strict_variant: only as the first one)."""
    low = F.lower(url)
    return F.contains(low, F.lit("/products/")) | F.contains(low, F.lit("/product/")) | F.contains(low, F.lit("?variant=" if strict_variant else "variant="))


def is_collection_url(url: Column) -> Column:
    return F.contains(F.lower(url), F.lit("/collections/"))
