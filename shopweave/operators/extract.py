"""Products and links in fetched pages. One small HTML pass per page, Arrow-batched."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import let
from ..functions.urls import absolute, bare_host, host, is_collection_url, is_product_url, normalize_url, resolved

_VARIANT = "struct<id:string,title:string,sku:string,price:string,compare_at_price:string,currency:string,available:string,option1:string,option2:string,option3:string,options:map<string,string>>"
NAMES = ["id", "url", "title", "handle", "description", "brand", "vendor", "product_type", "image_url", "tags", "price", "currency", "availability", "variants", "source"]
TEXTS = ["id", "url", "title", "handle", "description", "brand", "vendor", "product_type", "image_url", "price", "currency", "availability", "source"]
VARIANT_TEXTS = ["id", "title", "sku", "price", "compare_at_price", "currency", "available", "option1", "option2", "option3"]
#: Pages are parsed, and their products go back to Spark, in parts of so many characters and pages, or one page if it alone is larger.
PART_CHARS, PART_PAGES = 1 << 22, 1024
# fixed values: which sources a field is read from, the first that says something. ld is a product node of JSON-LD,
# offer its first offer; meta, attr and text are the page's meta tags, marked attributes and marked elements
FIELDS = {
    "id": ["ld productID", "ld sku", "ld @id", "meta product:retailer_item_id"],
    "url": ["ld url", "ld @id"],
    "title": ["ld name", "meta og:title", "text h1 name", "text h1"],
    "description": ["ld description", "meta description", "text description"],
    "brand": ["ld brand.name", "ld brand", "meta product:brand", "text brand"],
    "image_url": ["ld image", "ld image 0", "meta og:image"],
    "price": ["offer price", "meta product:price:amount", "attr price", "text price", "text .price"],
    "currency": ["offer priceCurrency"],
    "availability": ["offer availability", "offer inventoryLevel", "meta product:availability", "attr availability", "attr data-availability"],
}
# fixed values: the same for a variant, from an offer
VARIANT = {"id": ["offer @id", "offer sku"], "title": ["offer name"], "sku": ["offer sku"], "price": ["offer price"], "compare_at_price": ["offer highPrice"], "currency": ["offer priceCurrency"], "available": ["offer availability", "offer inventoryLevel"]}
#: What is read of a node, by its source: key -> fact. All other keys say nothing.
USED = {of: {f.removeprefix(f"{of} "): f for sources in [*FIELDS.values(), *VARIANT.values()] for f in sources if f.startswith(f"{of} ")} for of in ("ld", "offer")}
# fixed values: where products and offers lie, in which key of a node of what type ("": of any), and under which key of each entry
INNER = {"product": {"": ["@graph"], "itemlist": ["itemListElement", "item"]}, "offer": {"aggregateoffer": ["offers"]}}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Page(HTMLParser):
    """A page as facts, source -> text, each the first of its kind, and its JSON-LD scripts."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.facts: dict[str, str] = {}
        self.scripts: list[str] = []
        self.marked: list[tuple[str, list[str]]] = []  # open elements and the facts their text goes to
        self.in_script = False
        self.feed(html)
        self.close()
        self.facts = {k: v.strip() for k, v in self.facts.items()}

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        item = a.get("itemprop", "")
        said = {
            f"meta {a.get('property') or a.get('name') or ''}": a.get("content") if tag == "meta" else None,
            "attr price": a.get("content") if item == "price" else None,
            "attr availability": a.get("href", "") if tag == "link" and item == "availability" else None,
            "attr data-availability": a.get("data-availability"),
        }
        for k, v in said.items():
            if v is not None:
                self.facts.setdefault(k, v)
        if tag == "script":
            self.in_script = a.get("type", "").lower() == "application/ld+json"
            self.scripts += [""] * self.in_script
        if tag not in _VOID:
            marks = {"text " + item: bool(item), "text h1": tag == "h1", "text h1 name": tag == "h1" and item == "name", "text .price": "price" in a.get("class", "").split()}
            own = [m for m, holds in marks.items() if holds and m not in self.facts]
            self.facts.update(dict.fromkeys(own, ""))
            self.marked.append((tag, own))

    def handle_endtag(self, tag: str) -> None:
        self.in_script = self.in_script and tag != "script"
        if (same := [i for i, (t, _) in enumerate(self.marked) if t == tag]):
            del self.marked[same[-1] :]

    def handle_data(self, data: str) -> None:
        if self.in_script:
            self.scripts[-1] += data
        for m in (m for _, own in self.marked for m in own):
            self.facts[m] += data


def said(value: object) -> str:
    """The text of a JSON scalar; lists, objects, truth values and nothing say nothing."""
    if isinstance(value, str):
        return value.strip()
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return str(int(value)) if float(value).is_integer() else str(value)
    return ""


def facts_of(node: dict, source: str) -> dict[str, str]:
    """A JSON object as facts, of those that are used: its scalars, those of objects in it, and the first of each list."""
    out, used = {}, USED[source]
    for k, v in node.items():
        if isinstance(v, dict):
            out |= {used[name]: said(y) for x, y in v.items() if (name := f"{k}.{x}") in used}
        elif isinstance(v, list) and v:
            if (name := f"{k} 0") in used:
                out[used[name]] = said(v[0])
        elif k in used:
            out[used[k]] = said(v)
    return out


def picked(facts: dict[str, str], table: dict[str, list[str]]) -> dict[str, str | None]:
    out: dict[str, str | None] = dict.fromkeys(table)
    for field, sources in table.items():
        for k in sources:
            if v := facts.get(k):
                out[field] = v
                break
    return out


def kinds(node: dict) -> set[str]:
    of = node.get("@type")
    if isinstance(of, str):
        return {kind} if (kind := of.strip().lower()) else set()
    return {said(x).lower() for x in (of if isinstance(of, list) else [of])} - {""}


def nodes(value: object, wanted: str) -> Iterator[dict]:
    """The nodes of a kind in a JSON value: in lists, and where INNER says that nodes keep others.

    Products are marked as such; an offer is whatever doesn't keep others. A node comes
    after those of its graph and is not searched further.
    """
    inner, work = INNER[wanted], [(value, False)]
    graphs, any_kind = inner.get("", [None])[0], wanted == "offer"
    while work:
        now, ready = work.pop()
        if ready:
            yield now
        elif isinstance(now, list):
            work += [(x, False) for x in reversed(now) if wanted == "product" or isinstance(x, dict)]
        elif isinstance(now, dict):
            own = kinds(now)
            keys = next((inner[t] for t in own if t in inner and inner[t][0] in now), None)
            graph = now.get(graphs)
            if wanted in own or (any_kind and keys is None):
                if not isinstance(graph, list):
                    yield now
                    continue
                work.append((now, True))
            elif keys is not None:
                held = now[keys[0]] if isinstance(now[keys[0]], list) else [now[keys[0]]]
                work.append(([next((x[k] for k in keys[1:] if x.get(k)), x) for x in held if isinstance(x, dict)], False))
            if isinstance(graph, list):
                work.append((graph, False))


def labels(value: object) -> list[str]:
    """The texts of a list, or the parts of a text between commas."""
    every = map(said, value) if isinstance(value, list) else (x.strip() for x in said(value).split(","))
    return [x for x in every if x]


def page_products(html: str, product_url: bool) -> list[dict]:
    """Products of a page, the last of each key; one of the page's own facts only where there are none and the URL is product-like."""
    page, found = Page(html), {}
    for text in page.scripts:
        try:
            value = json.loads(text)
        except ValueError:
            continue
        for node in nodes(value, "product"):
            offers = [facts_of(o, "offer") for o in nodes(node.get("offers"), "offer")]
            p = picked(facts_of(node, "ld") | (offers[0] if offers else {}), FIELDS)
            p |= {"tags": labels(node.get("category")), "variants": [picked(o, VARIANT) for o in offers]}
            found[p["id"] or f"{p['url'] or ''}|{p['title'] or ''}"] = p
    if not found and product_url:
        p = picked(page.facts, FIELDS)
        missing = (p["title"] or "404").lower()
        if "404" not in missing and "not found" not in missing:
            found[""] = p | {"tags": labels(page.facts.get("meta keywords")), "variants": []}
    return [p | {"source": "html"} for p in found.values()]


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of pages in pieces that hold few pages and characters, however many and large its pages are."""
    begin, held = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column("body")).to_pylist()):
        if i > begin and (held + n > PART_CHARS or i - begin == PART_PAGES):
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def lists(values: list[list], flat: pa.Array) -> pa.Array:
    """Lists of the same lengths as `values`, over their elements one after the other."""
    ends = [0]
    for v in values:
        ends.append(ends[-1] + len(v))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)


def products_of(pages: pa.RecordBatch, keep: list[str]) -> pa.RecordBatch:
    """The products of pages: columns of their page, place, texts, tags and variants. Links are made absolute."""
    bodies, urls, like = (pages.column(c).to_pylist() for c in ("body", "page_url", "product_like"))
    at, pos, found = [], [], []
    for i, body in enumerate(bodies):
        for n, p in enumerate(page_products(body, like[i])):
            p["url"], p["image_url"] = absolute(urls[i] if p["url"] is None else p["url"], urls[i]), absolute(p["image_url"], urls[i])
            at.append(i)
            pos.append(n)
            found.append(p)
    tags, variants = [p["tags"] for p in found], [p["variants"] for p in found]
    each = [v for vs in variants for v in vs]
    of_variant = [pa.array([v.get(c) for v in each], pa.string()) for c in VARIANT_TEXTS] + [pa.nulls(len(each), pa.map_(pa.string(), pa.string()))]
    columns = {c: pages.column(c).take(pa.array(at, pa.int32())) for c in keep} | {"pos": pa.array(pos, pa.int32())}
    columns |= {c: pa.array([p.get(c) for p in found], pa.string()) for c in TEXTS}
    columns["tags"] = lists(tags, pa.array([t for ts in tags for t in ts], pa.string()))
    columns["variants"] = lists(variants, pa.StructArray.from_arrays(of_variant, [*VARIANT_TEXTS, "options"]))
    return pa.RecordBatch.from_pydict(columns)


def extract_products(pages: DataFrame) -> DataFrame:
    """Raw products of pages (store_slug, store_url, url, etag, last_modified, body, rank if planned), pos being the place on the page."""
    rank = F.col("rank") if "rank" in pages.columns else F.lit(None)
    rows = pages.select("store_slug", "store_url", F.col("url").alias("page_url"), "etag", "last_modified", rank.cast("long").alias("rank"), F.coalesce("body", F.lit("")).alias("body"))
    rows = rows.withColumn("product_like", F.coalesce(let(F.coalesce(normalize_url(F.col("page_url")), F.col("page_url")), is_product_url), F.lit(False)))
    keep = ["store_slug", "store_url", "page_url", "etag", "last_modified", "rank"]
    kinds_of = [f"{c} string" for c in TEXTS] + ["tags array<string>", f"variants array<{_VARIANT}>"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in parts(b):
                yield products_of(part, keep)

    found = rows.mapInArrow(run, "store_slug string, store_url string, page_url string, etag string, last_modified string, rank long, pos int, " + ", ".join(kinds_of))
    found = found.select(*keep, "pos", *NAMES).withColumns({"url": normalize_url(F.col("url")), "image_url": normalize_url(F.col("image_url"))})
    return found.withColumn("handle", F.nullif(F.regexp_extract(F.regexp_extract("url", "^https?://[^/?#]+([^?#]*)", 1), "([^/]+)/*$", 1), F.lit("")))


def extract_links(pages: DataFrame) -> DataFrame:
    """Distinct (store_slug, page_url, url, kind) of the product and collection links of pages, on the page's own host."""
    rows = pages.select("store_slug", F.col("url").alias("page_url"), F.coalesce("body", F.lit("")).alias("body"))
    anchors = F.regexp_extract_all("body", F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']+)["']"""), F.lit(1))
    quoted = F.regexp_extract_all("body", F.lit(r"""(?i)["'](/[^"']*/(?:products?|collections)/[^"']+)["']"""), F.lit(1))
    every = F.array_distinct(F.concat(anchors, F.transform(quoted, lambda x: F.regexp_replace(x, "(?i)&amp;", "&"))))
    links = rows.select("store_slug", "page_url", F.explode(every).alias("raw")).where("trim(raw) <> ''")
    own = F.regexp_extract("page_url", "^(?i:https?)://[^/?#]+", 0)
    # root-relative and full links, the usual ones, need no helper
    whole = F.when(F.startswith("raw", F.lit("/")) & ~F.startswith("raw", F.lit("//")), F.concat(own, "raw")).when(F.col("raw").rlike("^(?i:https?)://"), F.col("raw"))
    links = links.withColumn("whole", whole)
    direct = links.where("whole is not null").select("store_slug", "page_url", normalize_url(F.trim("whole")).alias("url"))
    rest = links.where("whole is null").select("store_slug", "page_url", normalize_url(resolved(F.col("raw"), F.col("page_url"))).alias("url"))
    both = direct.unionByName(rest).where("url is not null").where(host(F.col("url")) == host(F.col("page_url")))
    kind = F.when(is_product_url(F.col("url")), "product").when(is_collection_url(F.col("url")), "collection")
    return both.withColumn("kind", kind).where("kind is not null").distinct()


def filter_external_urls(found: DataFrame) -> DataFrame:
    """Distinct product URLs that an external search has found on a store's own host: (store_slug, store_url, url) rows in."""
    rows = found.select("store_slug", "store_url", normalize_url(F.col("url")).alias("url")).where("url is not null")
    return rows.where((bare_host(F.col("url")) == bare_host(F.col("store_url"))) & is_product_url(F.col("url"))).select("store_slug", "url").distinct()
