"""Merkle manifest of a table: a digest for each row, a root over all of them, and a proof that ties each row to the root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import grouped, numbered, written

FANOUT = 3
#: What a leaf covers, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SIBLINGS = "array<struct<before:binary,after:binary>>"


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts one after another, as bytes."""
    return F.unhex(F.sha2(F.concat(*[p.cast("binary") for p in parts]), 256))


def as_text(d: Column) -> Column:
    return F.lower(F.hex(d))


def leaf(values: dict[str, Column]) -> Column:
    """Digest of a row: each value as its count of UTF-8 bytes, a colon and itself, or a dash for null."""

    def field(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return digest(*[field(v) for v in values.values()])


def pivoted(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The parents (g, i, n, h, c0, c1, ...) of nodes (g, i, n, h, more): child k as a struct in column ck, h over all of them.

    Conditional aggregates spread the children over the slots, so a parent's children are
    reduced before they are shuffled. n is how many nodes the group has on the level.
    """
    child = F.struct(*[c for c in nodes.columns if c not in ("g", "i", "n")])
    spread = [F.max(F.when(F.pmod("i", F.lit(fanout)) == k, child)).alias(f"c{k}") for k in range(fanout)]
    up = nodes.groupBy("g", F.expr(f"i div {fanout}").alias("i"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n")).agg(*spread)
    return up.withColumn("h", digest(*[F.coalesce(as_text(F.col(f"c{k}.h")), F.lit("")) for k in range(fanout)]))


def unfolded(parents: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The children of pivoted parents (with top and path): g, i, h and more, top, and the path with the child's siblings before it.

    A child's siblings are the slot columns joined without its own one.
    """
    none = F.lit("").cast("binary")
    joined = lambda slots: F.concat(none, *[F.coalesce(F.col(f"c{k}.h"), none) for k in slots])

    def kid(k: int) -> Column:
        own = F.struct(joined(range(k)).alias("before"), joined(range(k + 1, fanout)).alias("after"))
        return F.struct((F.col("i") * fanout + k).alias("i"), F.concat(F.array(own), "path").alias("path"), F.col(f"c{k}").alias("node"))

    kids = parents.select("g", "top", F.explode(F.array(*map(kid, range(fanout)))).alias("kid")).where("kid.node is not null")
    return kids.select("g", "top", "kid.i", "kid.path", "kid.node.*")


def climbed(leaves: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """The levels above the leaves (g, i, n, h, more), lowest first, each pivoted and written: together half as many rows as leaves."""
    out, nodes, most = [], leaves, leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        out.append(written(pivoted(nodes.where("n > 1"), fanout), "merkle-level"))
        nodes, most = out[-1].select("g", "i", "n", "h"), -(-most // fanout)
    return out


def roots(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(g, h, level): the node that remains of each group and the level it stands on, 0 for a lone leaf."""
    found = None
    for k, nodes in enumerate([leaves, *levels]):
        own = nodes.where("n = 1").select("g", "h", F.lit(k).alias("level"))
        found = own if found is None else found.unionByName(own)
    return found


def carried(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The leaves with the top of their group and the path of siblings up to it; tops: (g, level, top, path).

    Top and path go down level by level, each parent to its children in its own row; a
    group's top meets only the one node it stands on.
    """
    down = None
    for k in range(len(levels), 0, -1):
        known = tops.where(F.col("level") == k).select("g", F.lit(0).cast("long").alias("i"), "top", "path")
        if down is not None:
            known = known.unionByName(down.select("g", "i", "top", "path"))
        down = unfolded(levels[k - 1].join(known, ["g", "i"]), fanout)
    lone = leaves.where("n = 1").drop("n").join(tops.where("level = 0").drop("level"), "g")
    return lone if down is None else lone.unionByName(down)


def proofs(leaves: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Each leaf (g, i, n, h, more) with top (subroot, root) and path, an array of the sibling digests before and after it on each level up to the root."""
    levels = climbed(leaves, fanout)
    subroots = numbered(roots(leaves, levels), "g").drop("part")
    n = subroots.count()
    over = subroots.select(F.lit(0).cast("long").alias("g"), F.col("at").alias("i"), F.lit(n).cast("long").alias("n"), "h", F.col("g").alias("group"), "level")
    above = climbed(over, fanout)
    root = roots(over, above).select("g", "level", F.col("h").alias("top"), F.array().cast(SIBLINGS).alias("path"))
    tops = carried(over, above, root, fanout)
    tops = tops.select(F.col("group").alias("g"), "level", F.struct(F.col("h").alias("subroot"), F.col("top").alias("root")).alias("top"), "path")
    return carried(leaves, levels, written(tops, "merkle-tops"), fanout)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings give."""
    return F.aggregate(path, start, lambda x, s: digest(as_text(s["before"]), as_text(x), as_text(s["after"])))


def siblings_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, from the leaf up and left to right."""
    every = F.aggregate(path, F.lit("").cast("binary"), lambda x, s: F.concat(x, s["before"], s["after"]))
    return F.sha2(as_text(every), 256)


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of docs.

    A leaf covers doc_id, source, lang, n_chars and text, nulls too; other columns are
    not looked at. Leaves of a source (null is a source, the first one) ascend by doc_id,
    null ids first; rows that share an id ascend by their digests, and rows that repeat
    everything stand beside each other. Every three nodes become one until one
    remains, the subroot; subroots likewise give the root. The last two columns hold the
    proof against a changed table: where 2 divides the crc32 of the id's decimal text,
    line feeds are taken from the text, and the row is verified only if it still gives the
    root. Null ids and texts are left alone. An empty table gives an empty result.
    """
    own = {c: F.col(c) for c in FIELDS}
    changed = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    bare = leaf(own | {"text": F.translate("text", "\n", "")})
    rows = written(docs.select("doc_id", "source", leaf(own).alias("h"), F.when(changed & F.contains("text", F.lit("\n")), bare).alias("bad")), "leaves")
    found = proofs(grouped(rows, "source", "doc_id", "h"))
    back = folded(F.coalesce("bad", "h"), F.col("path"))
    out = found.select("doc_id", "h", "top", siblings_digest(F.col("path")).alias("proof_sha256"), back.alias("back"))
    return out.select(
        "doc_id", as_text(F.col("h")).alias("leaf"), as_text(F.col("top.subroot")).alias("subroot"), as_text(F.col("top.root")).alias("root"), "proof_sha256",
        as_text(F.col("back")).alias("folded_root"), (F.col("back") == F.col("top.root")).alias("verified"),
    )


def oracle() -> str:
    """DuckDB SQL for the manifest of documents; the crc32 is worked out digit by digit from its table."""
    field = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}, '-')"
    whole = lambda text: "sha256(" + " || ".join(field(text if c == "text" else c) for c in FIELDS) + ")"
    step = "case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end"
    bits = "x"
    for _ in range(8):
        bits = f"(select {step} from (select {bits} as x))" if bits != "x" else f"(select {step} from (select i as x))"
    climb = lambda name, src: f"""{name} as (select g, 0 as lvl, i, h, n from {src} union all
  select g, lvl + 1, i // {FANOUT}, sha256(string_agg(h, '' order by i)), (n + {FANOUT - 1}) // {FANOUT} from {name} where n > 1 group by g, lvl, i // {FANOUT}, n)"""  # noqa: E731
    sides = lambda name: f"""{name}_sides as (select a.g, a.lvl, a.i, coalesce(string_agg(b.h, '' order by b.i) filter (b.i < a.i), '') as before, coalesce(string_agg(b.h, '' order by b.i) filter (b.i > a.i), '') as after
  from {name} a join {name} b on a.g = b.g and a.lvl = b.lvl and a.i // {FANOUT} = b.i // {FANOUT} where a.n > 1 group by 1, 2, 3)"""  # noqa: E731
    return f"""with recursive tab as (select list(c order by i) as t from (select i, {bits} as c from range(256) r(i))),
leaves as (select doc_id, source, {whole('text')} as h, case when doc_id is not null and xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda d: ascii(d)::bigint)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 2 = 0
  then {whole("replace(text, chr(10), '')")} else {whole('text')} end as bad from documents, tab),
placed as (select *, dense_rank() over (order by source nulls first) - 1 as g, row_number() over (partition by source order by doc_id nulls first, h) - 1 as i, count(*) over (partition by source) as n from leaves),
{climb('low', 'placed')},
subs as (select 0 as g, g as i, h, count(*) over () as n from low where n = 1),
{climb('high', 'subs')}, {sides('low')}, {sides('high')},
steps as (select p.g, p.i, s.lvl, s.before, s.after from placed p join low_sides s on s.g = p.g and s.i = p.i // ({FANOUT} ** s.lvl)::bigint union all
  select p.g, p.i, 100 + s.lvl, s.before, s.after from placed p join high_sides s on s.i = p.g // ({FANOUT} ** s.lvl)::bigint),
walk as (select g, i, row_number() over (partition by g, i order by lvl) as k, before, after from steps),
back as (select g, i, 0 as k, bad as x from placed union all select b.g, b.i, w.k, sha256(w.before || b.x || w.after) from back b join walk w on w.g = b.g and w.i = b.i and w.k = b.k + 1),
ends as (select g, i, max_by(x, k) as x from back group by 1, 2),
proof as (select g, i, sha256(string_agg(before || after, '' order by k)) as p from walk group by 1, 2)
select doc_id, p.h as leaf, s.h as subroot, r.h as root, coalesce(f.p, sha256('')) as proof_sha256, e.x as folded_root, e.x = r.h as verified
from placed p join subs s on s.i = p.g join (select h from high where n = 1) r on true join ends e on e.g = p.g and e.i = p.i left join proof f on f.g = p.g and f.i = p.i"""
