"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from .common import guarded, restored, texts

SEED, COVERAGE, BLOCK_TOKENS = 5, 0.5, 2_000_000
BASE, SPREAD = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)
_WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** n, modulo 2**64."""
    steps = np.full(n + 1, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


class Rolling:
    """Karp-Rabin hashes, modulo 2**64, of the windows of a sequence of word numbers.

    Running sums of x[i] * BASE**-i are kept once. The hash of any window is then one
    subtraction and one multiplication, for any length, and from one window to the next
    only the ends change: the memory is one number for each word.
    """

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        self.power = _powers(BASE, n)
        x = (ids.astype(np.uint64) + np.uint64(1)) * SPREAD
        x ^= x >> np.uint64(29)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * _powers(pow(BASE, -1, 1 << 64), n)[:n], dtype=np.uint64)])

    def windows(self, n: int) -> np.ndarray:
        """The hashes of all windows of n words."""
        return (self.sums[n:] - self.sums[:-n]) * self.power[: len(self.sums) - n] if n < len(self.sums) else np.empty(0, np.uint64)


def tiles(a: np.ndarray, b: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiling of a with b: (start in a, start in b, length), the longest unmarked match first.

    Running Karp-Rabin: windows of the search length that are unmarked on both sides are
    matched by rolling hash, verified and extended; the longest are marked and the rest is
    searched again. Once no match is left the search length is halved, down to `least`.
    """
    free_a, free_b, out = np.ones(len(a), bool), np.ones(len(b), bool), []
    rolls_a, rolls_b = Rolling(a), Rolling(b)
    size = min(len(a), len(b))
    while size >= least:
        found = list(_matches(a, b, free_a, free_b, rolls_a.windows(size), rolls_b.windows(size), size))
        longest = max(found, default=(0,))[0]
        for n, i, j in found:
            if n == longest and free_a[i : i + n].all() and free_b[j : j + n].all():
                free_a[i : i + n] = free_b[j : j + n] = False
                out.append((i, j, n))
        if not found:
            size = max(least, size // 2) if size > least else 0
    return out


def _matches(a: np.ndarray, b: np.ndarray, free_a: np.ndarray, free_b: np.ndarray, hashes_a: np.ndarray, hashes_b: np.ndarray, size: int) -> Iterator[tuple[int, int, int]]:
    """(length, i, j) of the unmarked matches of at least `size` words that don't go on to the left."""
    at_a, at_b = _free_windows(free_a, size), _free_windows(free_b, size)
    at_b = at_b[np.argsort(hashes_b[at_b], kind="stable")]
    ordered = hashes_b[at_b]
    lo, hi = np.searchsorted(ordered, hashes_a[at_a], "left"), np.searchsorted(ordered, hashes_a[at_a], "right")
    for i, x, y in zip(at_a[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
        places = at_b[x:y]
        if i and free_a[i - 1]:
            places = places[(places == 0) | ~free_b[places - 1] | (b[places - 1] != a[i - 1])]
        for j in places.tolist():
            if not np.array_equal(a[i : i + size], b[j : j + size]):
                continue
            n = size
            while i + n < len(a) and j + n < len(b) and free_a[i + n] and free_b[j + n] and a[i + n] == b[j + n]:
                n += 1
            yield n, i, j


def _free_windows(free: np.ndarray, size: int) -> np.ndarray:
    """Starts of the windows that are wholly unmarked."""
    run = np.concatenate([[0], np.cumsum(free)])
    return np.nonzero(run[size:] - run[:-size] == size)[0] if len(free) >= size else np.empty(0, np.int64)


class Tests:
    """A block of test items: vocabulary, tokens, and the seed windows with the items that have them."""

    def __init__(self, items: list[tuple[int, str]], seed: int):
        self.vocabulary: dict[str, int] = {}
        self.names = [i for i, _ in items]
        number = self.vocabulary
        self.tokens = [np.array([number.setdefault(w, len(number) + 1) for w in words(t)], np.int32) for _, t in items]
        self.least = [min(seed, len(t)) for t in self.tokens]
        self.by_size = {}
        for n in sorted({x for x in self.least if x}):
            own = [(k, Rolling(t).windows(n)) for k, t in enumerate(self.tokens) if self.least[k] == n]
            hashes = np.concatenate([h for _, h in own])
            item = np.concatenate([np.full(len(h), k) for k, h in own])
            place = np.concatenate([np.arange(len(h)) for _, h in own])
            order = np.argsort(hashes, kind="stable")
            self.by_size[n] = hashes[order], item[order], place[order]

    def matches(self, text: str, coverage: float) -> Iterator[tuple[int, float, int, int]]:
        """(item, coverage, tiles, longest tile) of each item that the text covers so far."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words(text)), np.int32)
        known, rolls = np.concatenate([[0], np.cumsum(ids > 0)]), None
        for n, (hashes, item, place) in self.by_size.items():
            if len(ids) < n:
                continue
            at = np.nonzero(known[n:] - known[:-n] == n)[0]  # windows of words that tests have
            if not len(at):
                continue
            rolls = rolls or Rolling(ids)
            h = rolls.windows(n)[at]
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            hit = hi > lo
            if not hit.any():
                continue
            at, lo, hi = at[hit], lo[hit], hi[hit]
            seeds: dict[int, set[int]] = defaultdict(set)
            for x, y in set(zip(lo.tolist(), hi.tolist(), strict=True)):
                for k in range(x, y):
                    seeds[int(item[k])].add(int(place[k]))
            # a tile lies in seed windows: what lies in none can neither be tiled nor count
            inside = np.zeros(len(ids) + 1, np.int32)
            np.add.at(inside, at, 1)
            np.add.at(inside, at + n, -1)
            inside = np.cumsum(inside[:-1]) > 0
            kept = np.where(inside, ids, 0)
            kept = kept[inside | np.concatenate([[False], inside[:-1]])]
            for k, places in seeds.items():
                own = self.tokens[k]
                cover = np.zeros(len(own), bool)
                for p in places:
                    cover[p : p + n] = True
                if cover.sum() < coverage * len(own):
                    continue
                found = tiles(own, kept, n)
                share = sum(t[2] for t in found) / len(own)
                if share >= coverage:
                    yield self.names[k], share, len(found), max(t[2] for t in found)


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest) for each document that covers a test item.

    Words are letter, digit and underscore runs in lower case. The seeds are the
    `seed`-word windows of an item (all its words where it is shorter); documents meet
    items by shared seeds, then greedy string tiling gives the share of the item's
    words in tiles, in whatever order they stand. Pairs of at least `coverage` are
    returned, one row for each row of documents and item.

    The tests are the stated query set: their words are counted first and they go to
    the tasks in blocks of about `block_tokens` words (an item is never cut), one
    scan of the documents for each block, so what is sent has a fixed bound and the
    documents are never shuffled. Items without a word match nothing; null texts count
    as empty; empty tables give an empty result; items that repeat are matched each.
    `carry` names whole-number columns of docs that come along in the result.
    """
    rows = guarded(texts(docs, id_col, text_col, carry))
    names = ["doc_id", "no_id", *carry]
    kinds = ", ".join(["doc_id long, no_id boolean", *[f"{c} long" for c in carry], "item_id long, coverage double, n_tiles int, longest int"])
    found = []
    for sent in _blocks(benchmark, seed, block_tokens, item_col, item_text_col):

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = [(*own, *m) for *own, t in zip(*[b[c] for c in names], b["text"], strict=True) for m in sent.value.matches(t, coverage)]
                yield pd.DataFrame(out, columns=[*names, "item_id", "coverage", "n_tiles", "longest"])

        found.append(restored(rows.mapInPandas(run, kinds)))
    return reduce(DataFrame.unionByName, found)


def _blocks(benchmark: DataFrame, seed: int, block_tokens: int, item_col: str, item_text_col: str) -> Iterator[Broadcast]:
    """Broadcast blocks of the test items, of about block_tokens words each."""
    tests = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{item_text_col}`").alias("text")).where("text is not null")
    size = tests.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0
    blocks = int(size // block_tokens) + 1
    for block in range(blocks):
        own = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield benchmark.sparkSession.sparkContext.broadcast(Tests([(r.item_id, r.text) for r in own.toLocalIterator()], seed))


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED, block_tokens: int = BLOCK_TOKENS, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs (all columns, whatever their names) whose text covers no test item.

    Each row is judged by its own text, in the scan: nothing is shuffled or joined, and
    shared or null ids don't matter. Null texts stay.
    """
    for sent in _blocks(benchmark, seed, block_tokens, item_col, item_text_col):
        docs = docs.where(_clean(sent, coverage)(F.col(f"`{text_col}`")))
    return docs


def _clean(sent: Broadcast, coverage: float):
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([next(sent.value.matches(t or "", coverage), None) is None for t in texts], dtype=bool)

    return clean
