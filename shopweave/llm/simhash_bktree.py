"""SimHash near-duplicates, found by BK-trees over shards of the fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import aside, guarded, parts, restored, row_key, texts, written
from .links import components

BITS, SHINGLE, RADIUS = 64, 4, 4
#: Codes that a shard, and so a tree, should have at most.
SHARD_CODES = 4096
#: Codes up to which all shard trees are sent to all tasks: a quarter of a megabyte of codes, all of which ask all trees. More meet by blocks of bits.
SENT = 1 << 15


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """SimHash of a text: bit j is set when more than half of the shingle hashes have it. No word: 0."""
    words = text.encode().lower().split()  # bytes: lowers A-Z, splits at ASCII white space only
    if not words:
        return 0
    hashed, join = xxhash.xxh64_intdigest, b" ".join
    rows = [hashed(join(words[i : i + shingle]), 42) for i in range(max(1, len(words) - shingle + 1))]
    bits = np.unpackbits(np.array(rows, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(bits), 255):  # sums of up to 255 ones stay in a byte
        counts += bits[at : at + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(counts * 2 > len(rows), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) and the whole-number columns to carry: fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in b["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "no_id": b["no_id"], "fp": fp, **{c: b[c] for c in carry}})

    rows = guarded(texts(docs, id_col, text_col, carry))
    return restored(rows.mapInPandas(run, ", ".join(["doc_id long, no_id boolean, fp long", *[f"{c} long" for c in carry]])))


class BKTree:
    """Burkhard-Keller tree of 64-bit codes.

    Children hang on the integer Hamming distance to their parent. It is built and
    searched for many codes at a time: a node holds the codes below it as arrays, and
    one of at most LEAF codes is compared as a whole.
    """

    LEAF = 8

    def __init__(self, codes: np.ndarray):
        self.pivot, self.kids, self.leaf = codes[0], {}, None
        if len(codes) <= self.LEAF:
            self.leaf = codes
            return
        away = np.bitwise_count(codes[1:] ^ self.pivot)
        order = np.argsort(away, kind="stable")
        steps, at = np.unique(away[order], return_index=True)
        self.kids = {int(d): BKTree(x) for d, x in zip(steps, np.split(codes[1:][order], at[1:]), strict=True)}

    def near(self, asked: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Arrays (asked, found) of the codes within the radius; only edges within it are followed."""
        if self.leaf is not None:
            i, j = np.nonzero(np.bitwise_count(asked[:, None] ^ self.leaf[None, :]) <= radius)
            yield asked[i], self.leaf[j]
            return
        away = np.bitwise_count(asked ^ self.pivot).astype(np.int64)
        if (hit := asked[away <= radius]).size:
            yield hit, np.full(hit.shape, self.pivot)
        for step, kid in self.kids.items():
            if (down := asked[np.abs(away - step) <= radius]).size:
                yield from kid.near(down, radius)

    def inner(self) -> int:
        """Nodes with children."""
        return 0 if self.leaf is not None else 1 + sum(kid.inner() for kid in self.kids.values())


def _links(trees: np.ndarray, asked: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of one shard: each code to the smallest code that its links reach here."""
    codes = np.unique(np.concatenate([trees, asked]))
    label = np.arange(len(codes))
    tree = BKTree(trees)
    found = [(np.searchsorted(codes, a), np.searchsorted(codes, b)) for at in range(0, len(asked), 512) for a, b in tree.near(asked[at : at + 512], radius)]
    a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1)) if found else (label[:0], label[:0])
    while True:
        low, old = label.copy(), label
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        label = np.minimum(low, low[low])
        if (label == old).all():
            break
    moved = label != np.arange(len(codes))
    return codes[moved], codes[label[moved]]


def _shards(rows: np.ndarray, cuts: np.ndarray, radius: int) -> pd.DataFrame:
    """Links of whole shards; rows are (shard, i, j, mine, fp), cut before the given ones."""
    fp, out = rows[:, 4].copy().view(np.uint64), [(np.empty(0, np.uint64),) * 2]
    for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)], strict=True):
        if e - s < 2:
            continue
        own = rows[s:e, 3] == rows[s, 1]
        tree, asked = (fp[s:e][own], fp[s:e][~own]) if rows[s, 1] != rows[s, 2] else (fp[s:e], fp[s:e])
        if len(tree) and len(asked):
            out.append(_links(tree, asked, radius))
    return pd.DataFrame({c: np.concatenate([o[k] for o in out]).view(np.int64) for k, c in enumerate("ab")})


def block_masks(blocks: int, radius: int) -> list[int]:
    """Masks of blocks - radius out of so many blocks of the 64 bits: codes within the radius agree under one of them."""
    edge = [round(i * BITS / blocks) for i in range(blocks + 1)]
    whole = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(blocks)]
    return [sum(whole[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]


def blocks_for(n: int, radius: int, per_shard: int = SHARD_CODES) -> int:
    """Fewest blocks under which a shard has up to about per_shard random codes: fewer blocks, fewer copies and larger trees. Exact for any choice."""
    for blocks in range(radius + 1, 2 * radius + 2):
        if n / 2.0 ** (BITS * (blocks - radius) // blocks) <= per_shard:
            return blocks
    return 2 * radius + 1


def forest(codes: np.ndarray, tree_codes: int = SHARD_CODES) -> list[BKTree]:
    """BK-trees of codes dealt at random to shards of about tree_codes."""
    shard = (codes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(max(1, -(-len(codes) // tree_codes)))
    return [BKTree(codes[shard == s]) for s in np.unique(shard)]


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", tree_codes: int = SHARD_CODES) -> DataFrame:
    """(doc_id, fp, component_id) for each row; component_id is the smallest doc_id reachable.

    Fingerprints that differ in at most `radius` bits are linked. Equal ones are one code.
    Codes are counted. Up to SENT of them are dealt at random to shards of about
    `tree_codes`, each a BK-tree; the trees are broadcast, and each task asks all of them
    with its own codes, following only edges within the radius. As a radius of 4 out of
    64 bits prunes little, that takes the square of their number, and more codes have no
    bound to be sent under: so their 64 bits are cut into blocks, and each code goes to
    one shard for each choice of blocks that linked codes can agree on; any two linked
    codes meet in one. A task turns a shard into a tree; one of over `tree_codes` codes is
    cut into that many trees as needed, each with all codes of the shard as queries in
    slices, so that no task holds more than two slices. Only spanning links leave a shard.
    Empty and null texts have fingerprint 0 and link as others do; an
    empty table gives an empty result; repeated rows stay and share a component. Null
    ids are never a component's id unless it has no other.
    """
    rows = written(fingerprints(docs, id_col, text_col), "simhash")
    codes = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    labels = _labels(rows, radius, tree_codes)
    named = codes.join(labels, codes.fp == labels.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    found = named.join(lows, "root").select("fp", "component_id")
    return rows.join(found, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS, tree_codes: int = SHARD_CODES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs (all columns, whatever their names), exactly one of each component of near copies.

    The one of the smallest id stays, null ids last, then that of the smallest row key
    (id and text). Rows are numbered, so rows that repeat both are told apart as well
    and neither a shared id nor a repeated row gathers rows in one task: fingerprints
    and components are reduced to their first row before anything is joined.
    """
    numbered = written(aside(docs, id_col, text_col).withColumns({"_n": F.monotonically_increasing_id(), "_key": row_key()}), "numbered")
    rows = written(fingerprints(numbered, carry=("_n", "_key")), "simhash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_key", "_n")).alias("first")
    codes = rows.groupBy("fp").agg(first)
    labels = _labels(rows, radius, tree_codes)
    named = codes.join(labels, codes.fp == labels.node, "left").select("first", F.coalesce("root", "fp").alias("root"))
    stay = named.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first._n").alias("_n"))
    return numbered.join(stay, "_n", "left_semi").select(*[F.col(f"row.`{c}`") for c in docs.columns])


def _asked(codes: DataFrame, radius: int, tree_codes: int) -> DataFrame:
    """Links (a, b) of at most SENT codes: the shard trees of all are sent to the tasks, each of which asks them with its own codes."""
    spark = codes.sparkSession
    every = np.sort(codes.toPandas()["fp"].to_numpy(np.int64)).view(np.uint64)
    sent = spark.sparkContext.broadcast(forest(every, tree_codes))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = b["fp"].to_numpy(np.int64).view(np.uint64)
            found = [x for tree in sent.value for at in range(0, len(own), 512) for x in tree.near(own[at : at + 512], radius)]
            a, c = (np.concatenate([np.empty(0, np.uint64), *(f[k] for f in found)]) for k in (0, 1))
            yield pd.DataFrame({"a": a[a > c].view(np.int64), "b": c[a > c].view(np.int64)})

    return codes.repartition(parts(spark)).mapInPandas(run, "a long, b long")


def _labels(rows: DataFrame, radius: int, tree_codes: int, sent: int = SENT) -> DataFrame:
    """(node, root): the component of each fingerprint of rows that is linked to another."""
    spark = rows.sparkSession
    codes = rows.select("fp").distinct()
    n = codes.count()
    if n <= sent:
        return components(_asked(codes, radius, tree_codes))
    masks = block_masks(blocks_for(max(n, 1), radius), radius)
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    keyed = rows.select("fp").distinct().select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("mask", "block"))
    keyed = keyed.select("fp", F.xxhash64("mask", "block").alias("shard"))
    sizes = keyed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    slices = F.ceil(F.col("n") / F.lit(tree_codes)).cast("int")
    keyed = keyed.join(sizes, "shard").select("shard", "fp", slices.alias("k"))
    mine = F.pmod(F.xxhash64(F.lit("slice"), "fp"), F.col("k")).cast("int")
    pair = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    keyed = keyed.select("shard", "fp", mine.alias("mine"), pair.alias("other"))
    keyed = keyed.select("shard", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp", "mine")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = np.empty((0, 5), np.int64)
        for b in batches:
            rows = np.concatenate([rest, b[["shard", "i", "j", "mine", "fp"]].to_numpy(np.int64)])
            cuts = np.nonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1))[0] + 1
            whole, rest = (rows[: cuts[-1]], rows[cuts[-1] :]) if len(cuts) else (rows[:0], rows)
            yield _shards(whole, cuts[:-1], radius)
        yield _shards(rest, np.empty(0, np.int64), radius)

    sorted_ = keyed.repartition(parts(spark), "shard", "i", "j").sortWithinPartitions("shard", "i", "j")
    links = sorted_.mapInPandas(run, "a long, b long")
    return components(links)
