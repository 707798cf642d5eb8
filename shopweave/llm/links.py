"""Distributed union-find, and verified links within the buckets of a banded sketch.

Texts are numbered (`id`), so all joins here are on longs. A bucket is what shares a
band key. It is compared inside a task, slice by slice, and only links that span its
components leave the task: a group of m near copies yields fewer than m rows, however
many pairs it has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Observation, functions as F

from .common import forget, parts, written

#: A second seed of XXH64, beside Spark's own 42: together they tell texts apart by 128 bits.
SALT = xxhash.xxh64_intdigest(b"second", 42)
#: Band keys hold their band in the upper bits, so that the lower band has the smaller key.
BAND_SHIFT, FIRST_BAND = 59, 16
#: A bucket is cut into slices of about so many texts and characters.
SLICE_TEXTS, SLICE_CHARS = 2048, 1 << 24
#: Small slices are compared together until they have so many characters.
CHARS_AT_ONCE = 1 << 18
#: Slots of the sieve, one bit each: what is sent to tasks has this size whatever the input.
SIEVE_BITS = 1 << 25
#: Texts -> their shingles' uint64 codes, one text after the other, repeats allowed; how many each has; which texts are plain:
#: two plain texts have equal codes for equal shingles only. Equal shingles have equal codes in all calls.
Shingles = Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]]


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) links of longs -> (node, root): root is the smallest node reachable.

    Alternating large-star and small-star rounds (Kiveris et al. 2014) over child-to-parent
    edges, written to the shared folder; it ends when a round changes nothing. In a large
    star only the parents that have a smaller neighbour are joined, a written table that
    shrinks from round to round, so a root with many children waits for no join: Spark
    sends the table when it is small and splits a skewed partition when it isn't. Self
    links and null ends are dropped; repeated links count once.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges, mark = _marked(edges)
    for _ in range(max_rounds):
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = written(low.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select(F.col("a").alias("b"), "m"), "moved")
        large = edges.join(moved, "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        after, now = _marked(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct())
        forget(edges)
        forget(moved)
        edges = after
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"links did not settle in {max_rounds} rounds")
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _marked(edges: DataFrame) -> tuple[DataFrame, dict]:
    """The edges as a written table, with a count and a sum of hashes taken on the way."""
    seen = Observation()
    total = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    return written(edges.observe(seen, F.count(F.lit(1)).alias("n"), total.alias("total")), "links"), seen.get


def hashed(text: str) -> list[Column]:
    """(h, l): 128 bits that tell a text apart."""
    return [F.xxhash64(text).alias("h"), F.xxhash64(F.lit("second"), text).alias("l")]


def one_by_one(hashes: Callable[[str], np.ndarray]) -> Shingles:
    """Shingles of a function for single texts, whose hashes can collide."""

    def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        made = [hashes(t) for t in texts]
        return np.concatenate(made), np.array([len(m) for m in made], np.int64), np.zeros(len(made), bool)

    return shingles


def keyed(hashes: np.ndarray) -> np.ndarray:
    """(text, band) uint64 hashes of bands -> signed band keys that order by band."""
    band = (np.arange(hashes.shape[1]) - FIRST_BAND).astype(np.int64) << BAND_SHIFT
    return (hashes >> np.uint64(64 - BAND_SHIFT)).view(np.int64) + band


def _sieve(wanted: DataFrame):
    """A broadcast bitmap of SIEVE_BITS slots with the slots of the wanted `h` set. Whatever it lets through is joined exactly afterwards."""
    slot = F.pmod("h", F.lit(SIEVE_BITS))
    words = wanted.select(F.shiftright(slot, 6).alias("w"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
    words = words.groupBy("w").agg(F.bit_or("bit").alias("bits")).toPandas()  # SIEVE_BITS / 64 rows at most
    bits = np.zeros(SIEVE_BITS // 64, np.int64)
    bits[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return wanted.sparkSession.sparkContext.broadcast(bits)


def fetched(docs: DataFrame, units: Callable[[str], list[str]], wanted: DataFrame) -> DataFrame:
    """(id, bands, z): the compressed unit of text of each wanted (id, h, l, bands), from one more scan of docs' `text`."""
    sent = _sieve(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, bits = zstandard.ZstdCompressor(level=1), sent.value
        for b in batches:
            raw = list(dict.fromkeys(u.encode() for t in b.column(0).to_pylist() for u in units(t)))
            h = np.fromiter((xxhash.xxh64_intdigest(u, 42) for u in raw), np.uint64, len(raw)).view(np.int64)
            slot = h & (SIEVE_BITS - 1)
            hit = np.nonzero((bits[slot >> 6] >> (slot & 63)) & 1)[0]
            own = [raw[i] for i in hit.tolist()]
            low = np.fromiter((xxhash.xxh64_intdigest(u, SALT) for u in own), np.uint64, len(own)).view(np.int64)
            yield pa.record_batch({"h": h[hit], "l": low, "z": pa.array([press.compress(u) for u in own], pa.binary())})

    found = docs.select("text").mapInArrow(run, "h long, l long, z binary")
    return written(found.join(wanted, ["h", "l"]).select("id", "bands", "z").dropDuplicates(["id"]), "bucket-texts")


class Group:
    """Texts as sets of shingle codes, to be compared with each other by exact counts."""

    def __init__(self, made: tuple[np.ndarray, np.ndarray, np.ndarray]):
        codes, n, self.plain = made
        self.vocabulary, at = np.unique(codes, return_inverse=True)
        self.bits = len(self.vocabulary).bit_length()
        both = np.sort((np.repeat(np.arange(len(n)), n) << self.bits) | at)  # of each text, in order, its codes' places in the vocabulary
        both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
        self.at, self.sizes = both & ((1 << self.bits) - 1), np.bincount(both >> self.bits, minlength=len(n))
        self.ends = np.cumsum(self.sizes)
        self.marks = np.zeros(len(self.vocabulary) + 1, bool)

    def places(self, i: int) -> np.ndarray:
        return self.at[self.ends[i] - self.sizes[i] : self.ends[i]]

    def foreign(self, codes: np.ndarray) -> np.ndarray:
        """Places of the sorted codes of a text that need not be of this group."""
        at = np.searchsorted(self.vocabulary, codes)
        at = at[at < len(self.vocabulary)]
        return at[self.vocabulary[at] == codes[: len(at)]]

    def of(self, some: np.ndarray) -> np.ndarray:
        """The places of some texts, one text after the other."""
        n = self.sizes[some]
        return self.at[np.arange(n.sum()) + np.repeat(self.ends[some] - np.cumsum(n), n)]

    def shared(self, places: np.ndarray, others: np.ndarray) -> np.ndarray:
        """How many of the places each of the others has."""
        self.marks[places] = True
        sums = np.concatenate([[0], np.cumsum(self.marks[self.of(others)])])
        self.marks[places] = False
        ends = np.cumsum(self.sizes[others])
        return sums[ends] - sums[ends - self.sizes[others]]

    def shared_by_pairs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many places x[i] and y[i] share, for each i."""
        pairs = np.arange(len(x)) << self.bits
        both = np.sort(np.concatenate([np.repeat(pairs, self.sizes[o]) | self.of(o) for o in (x, y)]))
        return np.bincount(both[1:][both[1:] == both[:-1]] >> self.bits, minlength=len(x))


def _like(shared: np.ndarray, one: np.ndarray | int, sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sets of these sizes that share so many reach the threshold. Two empty sets are alike."""
    return shared >= threshold * (one + sizes - shared) - 1e-9


class Compared:
    """Links of buckets: exact likeness inside a task, spanning links out."""

    def __init__(self, shingles: Shingles, likeness: Callable[[str, str], float], threshold: float):
        self.shingles, self.likeness, self.threshold = shingles, likeness, threshold

    def slices(self, rows: pa.Table) -> Iterator[tuple[int, int]]:
        """Links within each slice of whole (key, slice) runs of (key, slice, id, bands, z), many small slices at once.

        A pair that shares a lower band too is left to that band's bucket, so no pair is
        compared in two buckets, and a slice of such pairs only isn't opened.
        """
        open_ = zstandard.ZstdDecompressor()
        key, ids, packed = rows["key"].to_numpy(), rows["id"].to_numpy(), rows["z"].to_pylist()
        bands = rows["bands"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        at = _starts(rows)
        held, texts, chars = [], [], 0
        for s, e in zip(at, [*at[1:], len(ids)], strict=True):
            lower = bands[s:e, : (key[s] >> BAND_SHIFT) + FIRST_BAND]
            if e - s == 1 or (lower == lower[0]).all(axis=0).any():
                continue
            held.append((ids[s:e], lower))
            texts += [open_.decompress(z).decode() for z in packed[s:e]]
            chars += sum(map(len, texts[s - e :]))
            if chars >= CHARS_AT_ONCE:
                yield from self._within(held, texts)
                held, texts, chars = [], [], 0
        if held:
            yield from self._within(held, texts)

    def _within(self, slices: list[tuple[np.ndarray, np.ndarray]], texts: list[str]) -> Iterator[tuple[int, int]]:
        """Links that connect what the links of each slice connect; texts has those of one slice after the other.

        From each text reached so far the links to those not yet reached are taken, so a
        pair that is connected anyway is not compared.
        """
        group, ids = Group(self.shingles(texts)), np.concatenate([i for i, _ in slices])
        ends = np.cumsum([len(i) for i, _ in slices])
        twos = np.array([e - 2 for (i, _), e in zip(slices, ends.tolist(), strict=True) if len(i) == 2], np.int64)
        if len(twos):
            near = _like(group.shared_by_pairs(twos, twos + 1), group.sizes[twos], group.sizes[twos + 1], self.threshold)
            yield from ((int(ids[x]), int(ids[x + 1])) for x in twos[near].tolist() if self._checked(group, texts, x, x + 1))
        for (own, lower), end in zip(slices, ends.tolist(), strict=True):
            if len(own) == 2:
                continue
            start, rest = end - len(own), np.arange(end - len(own), end)
            while len(rest):
                reached, rest = [int(rest[0])], rest[1:]
                for x in reached:
                    s, sizes = group.sizes[x], group.sizes[rest]
                    ok = (np.minimum(s, sizes) >= self.threshold * np.maximum(s, sizes)) & ~(lower[rest - start] == lower[x - start]).any(axis=1)
                    asked = np.nonzero(ok)[0]
                    if not len(asked):
                        continue
                    y = rest[asked]
                    near = _like(group.shared(group.places(x), y), s, group.sizes[y], self.threshold)
                    new = [k for k in asked[near].tolist() if self._checked(group, texts, x, int(rest[k]))]
                    if new:
                        found = rest[new].tolist()
                        yield from ((int(ids[x]), int(ids[k])) for k in found)
                        reached += found
                        rest = np.delete(rest, new)
                        if not len(rest):
                            break

    def _checked(self, group: Group, texts: list[str], x: int, y: int) -> bool:
        """Whether a pair alike by its codes is alike: codes of plain texts are their shingles, others can collide."""
        return bool(group.plain[x] and group.plain[y]) or self.likeness(texts[x], texts[y]) >= self.threshold

    def across(self, group: Group, own: list[tuple[int, int, str]], asker: tuple[int, int, str]) -> Iterator[tuple[int, int]]:
        """A link of an asker to each other component of a slice's (id, root, text) that it has a link to."""
        one = np.unique(self.shingles([asker[2]])[0])
        roots = np.array([o[1] for o in own])
        ok = (roots != asker[1]) & (np.minimum(len(one), group.sizes) >= self.threshold * np.maximum(len(one), group.sizes))
        y = np.nonzero(ok)[0]
        near = y[_like(group.shared(group.foreign(one), y), len(one), group.sizes[y], self.threshold)]
        done = set()
        for k in near.tolist():
            if own[k][1] not in done and self.likeness(asker[2], own[k][2]) >= self.threshold:
                done.add(own[k][1])
                yield asker[0], own[k][0]


def _starts(rows: pa.Table) -> list[int]:
    """Where runs of equal (key, slice) start."""
    key, part = rows["key"].to_numpy(), rows["slice"].to_numpy()
    return np.nonzero(np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])))[0].tolist()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches cut so that no run of equal (key, slice) goes over an end."""
    held = None
    for b in batches:
        if b.num_rows:
            rows = pa.Table.from_batches([b])
            rows = rows if held is None else pa.concat_tables([held, rows])
            cut = _starts(rows)[-1]
            if cut:
                yield rows.slice(0, cut)
            held = rows.slice(cut)
    if held is not None:
        yield held


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(found, np.int64).reshape(-1, 2)
    return pa.record_batch({"a": both[:, 0], "b": both[:, 1]})


def _sent(found: Iterator[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    held = []
    for x in found:
        held.append(x)
        if len(held) == 1 << 14:
            yield _pairs(held)
            held = []
    yield _pairs(held)


def bucketed_links(distinct: DataFrame, docs: DataFrame, units: Callable[[str], list[str]], shingles: Shingles, likeness: Callable[[str, str], float], threshold: float) -> DataFrame:
    """(node, root) of the links of at least `threshold` by exact likeness between texts that share a band key.

    `distinct` has one row per distinct text: id (a unique long), h and l (hashed() of it),
    size (its characters) and bands (an array of keyed() band keys). The texts themselves
    are units of docs' `text`, fetched only for those that share a key with another.

    1. Keys are counted, with partial sums before the shuffle, and those of a single text
       go. Of the keys with the same members one stays, that of the lowest band.
    2. Each slice of a bucket (all of it, but for very large buckets) is compared in a task,
       text against all that no link has reached; only spanning links come out.
    3. Buckets of several slices: what lies outside the bucket's largest component so far
       asks all its slices. So every pair of a bucket is either connected or was compared.
    """
    n_parts = parts(docs.sparkSession)
    compare = Compared(shingles, likeness, threshold)
    rows = distinct.select(F.explode("bands").alias("key"), "id", "size")
    keys = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor("id").alias("y"), F.sum("size").alias("chars"))
    kept = keys.where("n > 1").groupBy("n", "x", "y", "chars").agg(F.min("key").alias("key"))
    slices = F.greatest(F.ceil(F.col("n") / F.lit(SLICE_TEXTS)), F.ceil(F.col("chars") / F.lit(SLICE_CHARS))).cast("int")
    kept = written(kept.select("key", slices.alias("k")), "buckets")
    members = written(rows.select("key", "id").join(kept.hint("shuffle_hash"), "key"), "members")
    wanted = written(distinct.select("id", "h", "l", "bands").join(members.select("id").distinct(), "id", "left_semi"), "wanted")
    texts = fetched(docs, units, wanted)
    own = F.pmod(F.xxhash64(F.lit("slice"), "id"), F.col("k")).cast("int").alias("slice")

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sent(link for rows in _runs(batches) for link in compare.slices(rows))

    dealt = members.select("key", own, "id").join(texts, "id").repartition(n_parts, "key", "slice").sortWithinPartitions("key", "slice")
    found = written(dealt.mapInArrow(inside, "a long, b long"), "spanning-links")
    large = members.where("k > 1")
    if not large.isEmpty():
        roots = written(components(found), "roots").withColumnRenamed("node", "id")
        named = written(large.join(roots, "id", "left").select("key", "k", "id", F.coalesce("root", "id").alias("root")), "large-buckets")
        most = named.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max(F.struct("n", "root")).alias("most"))
        most = written(most.select("key", F.col("most.root").alias("main")), "main-roots")
        outside = named.join(most, "key").where("root <> main")
        asking = outside.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("key", "slice", F.lit(True).alias("asks"), "id", "root")
        asked = named.join(outside.select("key").distinct(), "key", "left_semi").select("key", own, F.lit(False).alias("asks"), "id", "root")

        def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            open_ = zstandard.ZstdDecompressor()

            def found() -> Iterator[tuple[int, int]]:
                now, own, group = None, [], None
                for b in batches:
                    for key, part, asks, id_, root, z in zip(*(b.column(c).to_pylist() for c in ("key", "slice", "asks", "id", "root", "z")), strict=True):
                        if (key, part) != now:
                            now, own, group = (key, part), [], None
                        row = (id_, root, open_.decompress(z).decode())
                        if not asks:
                            own.append(row)
                        elif own:
                            group = group or Group(shingles([o[2] for o in own]))
                            yield from compare.across(group, own, row)

            yield from _sent(found())

        rows = asked.unionByName(asking).join(texts.select("id", "z"), "id")
        rows = rows.repartition(n_parts, "key", "slice").sortWithinPartitions("key", "slice", "asks")
        found = found.unionByName(rows.mapInArrow(outer, "a long, b long"))
    settled = components(found)  # all but its last step has run
    for done in (kept, members, wanted, texts):
        forget(done)
    return settled


def all_pairs(texts: list[str], shingles: Shingles, threshold: float) -> list[tuple[int, int]]:
    """All pairs at the threshold by comparing each with each; for tests and recall figures."""
    sets = [set(shingles([t])[0].tolist()) for t in texts]
    return [(i, j) for i, j in combinations(range(len(texts)), 2) if len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])]
