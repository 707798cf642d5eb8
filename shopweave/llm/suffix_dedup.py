"""Long repeated byte strings of a corpus, found by sorting suffixes bucket by bucket, and texts without their repeats.

A suffix here is what stands at a byte of a text with at least WIDTH bytes from there on;
suffixes that agree in their first WIDTH bytes are repeats, and all but the first go. The
bucket of a suffix is the smallest hash among the K-grams of its first WIDTH bytes: equal
ones share it, neighbours mostly do too, and so one row stands for a stretch of
neighbours. A bucket with one stretch needs no sorting, in one whose stretches are all
equal the first stays, and only the rest are sorted, with their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import parts, row_key, written

WIDTH, K = 100, 32
#: K-grams of a suffix's first WIDTH bytes, and so the most suffixes that one of them can stand for.
GRAMS = WIDTH - K + 1
#: Bytes that are hashed at a time; longer texts are cut into pieces that overlap by WIDTH - 1.
PIECE = 1 << 20
#: Stretches above which a bucket is dealt out by whole suffixes instead.
WIDE = 1024
#: Parts that the stretches of a bucket are dealt to when it is told whether it is a wide one.
SALTS = 32
#: Bytes whose suffixes a task sorts at a time.
BLOCK = 1 << 20
#: A perfect difference set: any two residues meet in it after the same number of steps.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: What a row's lowest two bits say of its stretch: to be compared, not yet told apart, repeated.
ASK, OPEN, GONE = 0, 1, 2
ROWS = "k long, c long, d long, h long, at long"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _packed(lo: np.ndarray, n: np.ndarray | int, kind: np.ndarray | int) -> np.ndarray:
    return lo.astype(np.int64) << 32 | np.int64(n) << 2 | kind


def _count(at: np.ndarray) -> np.ndarray:
    return (at & 0xFFFFFFFF) >> 2


def _steps() -> np.ndarray:
    """The steps after which two residues both stand in the cover, for all pairs of residues."""
    inside = np.isin(np.arange(2 * PERIOD) % PERIOD, COVER)
    both = np.array([[[inside[r + s] and inside[q + s] for s in range(PERIOD)] for q in range(PERIOD)] for r in range(PERIOD)])
    return both.argmax(axis=2)


STEPS = _steps()


def _sliding(pick: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """pick over each `width` neighbours of x."""
    k = 1
    while 2 * k <= width:
        x = pick(x[:-k], x[k:])
        k *= 2
    return pick(x[: len(x) - (width - k)], x[width - k :])


def smallest_grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, a, b): for each suffix of data with WIDTH bytes the smallest hash of a K-gram in them, and the places of grams next to each other that are the smallest of one suffix."""
    spread = (np.arange(1, 257, dtype=np.uint64) * _ODD) ^ (np.arange(1, 257, dtype=np.uint64) << np.uint64(17))
    h, k, factor = (spread * spread * _ODD + spread)[data], 1, int(_ODD)
    while k < K:  # of 2k bytes from two of k
        h = h[:-k] * np.uint64(factor) + h[k:]
        k, factor = 2 * k, factor * factor % (1 << 64)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    low = _sliding(np.minimum, h, GRAMS)
    edge = np.zeros(GRAMS - 1, np.uint64)
    used = np.flatnonzero(h == _sliding(np.maximum, np.concatenate([edge, low, edge]), GRAMS))
    pair = np.flatnonzero((h[used[1:]] == h[used[:-1]]) & (used[1:] - used[:-1] < GRAMS))
    return low.view(np.int64), used[pair], used[pair + 1]


def _pieces(texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """(data, row, from, start): pieces of texts joined to about PIECE bytes, each piece's row, place in data and place in its text."""
    own, size = [], 0
    for row, text in enumerate(texts):
        for at in range(0, max(len(text) - WIDTH + 1, 0), PIECE):
            own.append((text[at : at + PIECE + WIDTH - 1], row, size, at))
            size += len(own[-1][0])
            if size >= PIECE:
                yield b"".join(o[0] for o in own), *[np.array([o[k] for o in own]) for k in (1, 2, 3)]
                own, size = [], 0
    if own:
        yield b"".join(o[0] for o in own), *[np.array([o[k] for o in own]) for k in (1, 2, 3)]


def _ranges(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lo, n) of the runs of ascending places."""
    cut = np.flatnonzero(np.diff(places) != 1) + 1
    lo = places[np.r_[0, cut]] if len(places) else places
    return lo, np.diff(np.r_[0, cut, len(places)]) if len(places) else places


def stretches(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(m, c, row, lo, n, kind): stretches of neighbouring suffixes of a bucket m, c the hash of all bytes they look at.

    A stretch in which its K-gram stands more than once can repeat itself: its own repeats
    are GONE, the rest OPEN in slices, and one row without suffixes asks for its bucket.
    """
    out = [[np.empty(0, np.int64)] * 6]
    for data, rows, begin, start in _pieces(texts):
        flat = np.frombuffer(data, np.uint8)
        (low, a, b), end = smallest_grams(flat), np.r_[begin[1:], len(flat)]
        new = np.r_[True, low[1:] != low[:-1]]
        inside = np.zeros(len(low) + 1, np.int64)
        np.add.at(inside, begin, 1)
        np.add.at(inside, end - WIDTH + 1, -1)
        inside = np.cumsum(inside)[:-1] > 0  # not those that look into the next piece
        new |= np.r_[False, inside[1:] != inside[:-1]]
        new[begin] = True
        lo = np.flatnonzero(new)
        n = np.diff(np.r_[lo, len(low)])
        s, e = (np.searchsorted(lo, np.clip(x, 0, len(low) - 1), "right") - 1 for x in (b - GRAMS + 1, a))
        long = n > GRAMS
        for t in range(int((e - s).max(initial=-1)) + 1):  # stretches with a suffix that has its K-gram twice
            long[np.minimum(s + t, e)] = True
        long, lo, n = long[inside[lo]], lo[inside[lo]], n[inside[lo]]
        view = memoryview(data)
        c = np.array([xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(lo.tolist(), (lo + n + WIDTH - 1).tolist(), strict=True)], np.uint64).view(np.int64)
        piece = np.searchsorted(begin, lo, "right") - 1
        place = lo - begin[piece] + start[piece]
        kind = np.full(len(lo), ASK)
        out.append([np.where(long, 0, x) if x is c or x is n else x for x in (low[lo], c, rows[piece], place, n, kind)])
        for i in np.flatnonzero(long):
            seen: dict[bytes, None] = {}
            first = np.zeros(n[i], bool)
            for k in range(n[i]):
                own = data[lo[i] + k : lo[i] + k + WIDTH]
                if own not in seen:
                    seen[own], first[k] = None, True
            for keep, what in ((first, OPEN), (~first, GONE)):
                at, many = _ranges(np.flatnonzero(keep))
                if what == OPEN and len(at):
                    at = np.concatenate([np.arange(a, a + m, GRAMS) for a, m in zip(at, many, strict=True)])
                    many = np.minimum(GRAMS, np.r_[_ends(first, at)] - at)
                out.append([np.full(len(at), x) for x in (low[lo[i]], 0, rows[piece[i]])] + [place[i] + at, many, np.full(len(at), what)])
    return tuple(np.concatenate([np.asarray(o[k], np.int64) for o in out]) for k in range(6))


def _ends(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The end of the run of true values that each place stands in."""
    off = np.r_[np.flatnonzero(~mask), len(mask)]
    return off[np.searchsorted(off, at)]


def _first_of_equal(k: np.ndarray, c: np.ndarray, d: np.ndarray, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(order, new k, new c, gone) of rows with one k and c: gone are those that stand after the first, by d, h and at; repeated rows once."""
    order = np.lexsort((at, h, d, c, k))
    k, c, d, h, at = (x[order] for x in (k, c, d, h, at))
    same = np.r_[False, (k[1:] == k[:-1]) & (c[1:] == c[:-1]) & (d[1:] == d[:-1]) & (h[1:] == h[:-1]) & (at[1:] == at[:-1])][: len(k)]
    order, k, c = order[~same], k[~same], c[~same]
    new_k = np.r_[True, k[1:] != k[:-1]][: len(k)]
    new_c = new_k | np.r_[True, c[1:] != c[:-1]][: len(k)]
    return order, new_k, new_c, ~new_c


def _scattered(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((h.view(np.uint64) ^ at.view(np.uint64)) * _ODD).view(np.int64)


def _frame(*arrays: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(("k", "c", "d", "h", "at"), arrays, strict=True)))


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stretches of texts as rows for judge(): at most two of a bucket and batch are asked about, what the batch itself tells is told."""
    for b in batches:
        m, c, row, lo, n, kind = stretches([t.encode() for t in b["text"]])
        d, h, at = b["d"].to_numpy(np.int64)[row], b["h"].to_numpy(np.int64)[row], lo << 32 | n << 2 | kind
        told = np.flatnonzero(kind != ASK)
        yield _frame(_scattered(h[told], at[told]), np.where(kind[told] == OPEN, m[told], 0), d[told], h[told], at[told])
        own = np.flatnonzero(kind == ASK)
        own = own[np.argsort(m[own], kind="stable")]
        twice = np.r_[False, m[own][1:] == m[own][:-1]][: len(own)]
        twice |= np.r_[twice[1:], False][: len(own)]
        once, own = own[~twice], own[twice]
        yield _frame(m[once], c[once], d[once], h[once], at[once])
        order, new_m, new_c, gone = _first_of_equal(m[own], c[own], d[own], h[own], at[own])
        own = own[order]
        group = np.cumsum(new_m) - 1
        place = np.cumsum(new_c) - 1
        place = place - (place[new_m][group] if len(own) else 0)  # of its c among those of the bucket
        ask, more = own[new_c & (place < 2)], own[new_c & (place >= 2)]
        yield _frame(m[ask], c[ask], d[ask], h[ask], at[ask])
        more = more[n[more] > 0]
        yield _frame(_scattered(h[more], at[more]), m[more], d[more], h[more], at[more] | OPEN)
        own = own[gone & (n[own] > 0)]
        yield _frame(_scattered(h[own], at[own]), np.zeros(len(own), np.int64), d[own], h[own], at[own] | GONE)


def _whole_groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The rows of a partition sorted by key, cut only between its values."""
    rest = None
    for b in batches:
        rows = b if rest is None or rest.empty else pd.concat([rest, b], ignore_index=True)
        values = rows[key].to_numpy()
        cut = int(np.searchsorted(values, values[-1])) if len(values) else 0
        rest = rows.iloc[cut:]
        yield rows.iloc[:cut]
    if rest is not None:
        yield rest


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(m, d, h, at) of the stretches that are repeated or still open; rows are sorted by k."""
    for b in _whole_groups(batches, "k"):
        k, c, d, h, at = (b[x].to_numpy(np.int64) for x in ("k", "c", "d", "h", "at"))
        ask = at & 3 == ASK
        told = ~ask
        yield pd.DataFrame({"m": c[told], "d": d[told], "h": h[told], "at": at[told]})
        k, c, d, h, at = (x[ask] for x in (k, c, d, h, at))
        twice = np.r_[False, k[1:] == k[:-1]][: len(k)]
        twice |= np.r_[twice[1:], False][: len(k)]
        k, c, d, h, at = (x[twice] for x in (k, c, d, h, at))
        order, new_k, new_c, gone = _first_of_equal(k, c, d, h, at)
        k, d, h, at = (x[order] for x in (k, d, h, at))
        real = _count(at) > 0
        several = np.bincount(np.cumsum(new_k) - 1, weights=new_c)[np.cumsum(new_k) - 1] > 1 if len(k) else new_k
        open_, gone = new_c & several & real, gone & real
        yield pd.DataFrame({"m": k[open_], "d": d[open_], "h": h[open_], "at": at[open_] | OPEN})
        yield pd.DataFrame({"m": np.zeros(int(gone.sum()), np.int64), "d": d[gone], "h": h[gone], "at": at[gone] | GONE})


def _opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(k, d, h, at, bytes) of open stretches: with all that they look at, or in wide buckets a digest for each suffix."""
    for b in batches:
        rows: list[tuple] = []
        seen: dict[bytes, tuple[int, int, int]] = {}
        for d, h, text, ats, ms in zip(b["d"], b["h"], b["text"], b["ats"], b["ms"], strict=True):
            data = text.encode()
            for at, m in zip(ats.tolist(), ms.tolist(), strict=True):
                lo, n = at >> 32, (at & 0xFFFFFFFF) >> 2
                if at & 3 != GONE:
                    rows.append((m, d, h, lo << 32 | n << 2 | OPEN, data[lo : lo + n + WIDTH - 1]))
                    continue
                for i in range(lo, lo + n):
                    digest, own = xxhash.xxh3_128_digest(data[i : i + WIDTH]), (d, h, i)
                    before = seen.setdefault(digest, own)
                    if own < before:
                        seen[digest], own = own, before
                    elif own == before:
                        continue
                    rows.append((own[1] ^ own[2], own[0], own[1], own[2] << 32 | 1 << 2 | GONE, b""))
        rows += [(int.from_bytes(digest[:8], "little", signed=True), d, h, i << 32 | 1 << 2 | ASK, digest) for digest, (d, h, i) in seen.items()]
        yield pd.DataFrame(rows, columns=["k", "d", "h", "at", "bytes"])


def suffix_order(data: np.ndarray, bucket: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The order of the suffixes at `at` (each with WIDTH bytes in data), within their buckets, by their first WIDTH bytes at least.

    Suffixes at places of a difference cover are ranked first. Then all are sorted by
    bucket and their first PERIOD bytes; those that tie are split by a pivot, all ties at
    once, by the ranks of the two cover places that they reach after the same few steps.
    """
    padded = np.concatenate([data, np.zeros(WIDTH + PERIOD + 16, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)

    def word(places: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(words[places]).view(">u8").ravel().astype(np.uint64)

    sample = np.flatnonzero(np.isin(np.arange(len(data) + PERIOD) % PERIOD, COVER))
    keys = [word(sample + k) for k in range(0, WIDTH, 8)]
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(sample), bool)
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    rank = np.zeros(len(data) + 2 * PERIOD, np.int64)
    rank[sample[order]] = np.cumsum(new)

    heads = [word(at), word(at + 8), word(at + 16), word(at + PERIOD - 8)]
    order = np.lexsort([*heads[::-1], bucket])
    new = np.r_[True, np.zeros(len(at) - 1, bool)]
    for key in (bucket, *heads):
        new[1:] |= key[order][1:] != key[order][:-1]
    tie = np.cumsum(new) - 1
    live = np.arange(len(at))  # places in the order that are still tied
    while True:
        size = np.bincount(tie[live])
        live = live[size[tie[live]] > 1]
        if not len(live):
            return order
        own, group = at[order[live]], tie[live]
        first = np.r_[True, group[1:] != group[:-1]]
        middle = np.flatnonzero(first) + np.diff(np.r_[np.flatnonzero(first), len(live)]) // 2
        pivot = own[middle][np.cumsum(first) - 1]
        step = STEPS[own % PERIOD, pivot % PERIOD]
        side = np.sign(rank[own + step] - rank[pivot + step])
        by = np.lexsort((side, group))
        order[live] = order[live][by]
        group, side = group[by], side[by]
        new = np.r_[True, (group[1:] != group[:-1]) | (side[1:] != side[:-1])]
        tie[live] = np.cumsum(new) - 1
        live = live[side != 0]  # equal to the pivot: as far as ranks go there is nothing left to tell


def _block(k: np.ndarray, d: np.ndarray, h: np.ndarray, lo: np.ndarray, n: np.ndarray, texts: list[bytes]) -> pd.DataFrame:
    """(d, h, at) of the suffixes of whole buckets that repeat an earlier one."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.cumsum([0, *map(len, texts[:-1])])
    row = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at, place = begin[row] + step, lo[row] + step
    order = suffix_order(data, k[row], at)
    sorted_ = at[order]
    equal = np.zeros(len(order), bool)
    for s in range(0, len(order) - 1, 1 << 16):  # neighbours in the order that agree in all WIDTH bytes
        a, b = sorted_[s : s + (1 << 16)][:, None], sorted_[s + 1 : s + 1 + (1 << 16)][:, None]
        span = np.arange(WIDTH)[None, :]
        equal[s + 1 : s + 1 + len(b)] = (data[a[: len(b)] + span] == data[b + span]).all(axis=1)
    equal &= np.r_[False, k[row][order][1:] == k[row][order][:-1]]
    group = np.cumsum(~equal)
    by = np.lexsort((place[order], h[row][order], d[row][order], group))
    order, group = order[by], group[by]
    first = np.r_[True, group[1:] != group[:-1]]
    head = order[np.flatnonzero(first)[np.cumsum(first) - 1]]
    r, q = row[order], row[head]
    gone = order[(d[r] != d[q]) | (h[r] != h[q]) | (place[order] != place[head])]
    return pd.DataFrame({"d": d[row[gone]], "h": h[row[gone]], "at": _packed(place[gone], 1, GONE)})


def _sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(d, h, at) of what repeats an earlier suffix, from rows (k, d, h, at, bytes) sorted by k: buckets are sorted in blocks of about BLOCK bytes."""
    for b in _whole_groups(batches, "k"):
        at, kind = b["at"].to_numpy(np.int64), b["at"].to_numpy(np.int64) & 3
        yield b.loc[kind == GONE, ["d", "h", "at"]]
        own = b[kind == ASK]
        k, d, h, a = (own[x].to_numpy(np.int64) for x in ("k", "d", "h", "at"))
        c = np.array([int.from_bytes(x[8:], "little", signed=True) for x in own["bytes"]], np.int64)
        order, _, _, gone = _first_of_equal(k, c, d, h, a)
        g = order[gone]
        yield pd.DataFrame({"d": d[g], "h": h[g], "at": a[g] | GONE})
        own = b[kind == OPEN]
        k, d, h, at = (own[x].to_numpy(np.int64) for x in ("k", "d", "h", "at"))
        texts = own["bytes"].to_numpy()
        twice = np.r_[False, k[1:] == k[:-1]][: len(k)]
        twice |= np.r_[twice[1:], False][: len(k)]
        k, d, h, at, texts = (x[twice] for x in (k, d, h, at, texts))
        size = np.cumsum([len(t) for t in texts])
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]][: len(k)])
        s = 0
        while s < len(k):
            full = np.searchsorted(size, (size[s - 1] if s else 0) + BLOCK, "right")
            later = starts[starts > s]
            e = len(k) if full >= len(k) else int(later[np.searchsorted(later, full)]) if len(later) and later[-1] >= full else len(k)
            yield _block(k[s:e], d[s:e], h[s:e], at[s:e] >> 32, _count(at[s:e]), list(texts[s:e]))
            s = e


def cut(data: bytes, ats: np.ndarray) -> tuple[int, int, str]:
    """(bytes removed, runs of them, SHA-256 of the rest) of a text from the packed stretches of its repeated suffixes."""
    ats = np.sort(ats)
    lo, hi = ats >> 32, (ats >> 32) + _count(ats) - 1 + WIDTH
    if not len(lo):
        return 0, 0, sha256(data).hexdigest()
    reach = np.maximum.accumulate(hi)
    new = np.r_[True, lo[1:] > reach[:-1]]
    start, end = lo[new], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(lo) - 1]]
    rest = sha256()
    for s, e in zip([0, *end.tolist()], [*start.tolist(), len(data)], strict=True):
        rest.update(memoryview(data)[s:e])
    return int((end - start).sum()), len(start), rest.hexdigest()


def _kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    none = np.empty(0, np.int64)
    for b in batches:
        texts = [t.encode() for t in b["text"]]
        found = [cut(t, none if a is None else a) for t, a in zip(texts, b["ats"], strict=True)]
        out = pd.DataFrame({"doc_id": b["d"], "no_id": b["no_id"], "h": b["h"], "n_bytes": [len(t) for t in texts]})
        yield out.assign(**{c: [f[k] for f in found] for k, c in enumerate(("n_removed", "n_spans", "kept_sha256"))})


def repeated(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keyed, gone): docs as (d, h, no_id, text), d the id, h a key of id and text; and (d, h, at), the suffixes of each that repeat an earlier one, packed."""
    spark = docs.sparkSession
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("d"), row_key().alias("h"), F.col("doc_id").isNull().alias("no_id"), F.coalesce("text", F.lit("")).alias("text"))
    asked = keyed.select("d", "h", "text").mapInPandas(_scan, ROWS)
    judged = written(asked.repartition(parts(spark), "k").sortWithinPartitions("k").mapInPandas(_judge, "m long, d long, h long, at long"), "stretches")
    told = F.col("at").bitwiseAND(F.lit(3)) == GONE
    left = judged.where(~told)
    wide = left.groupBy("m").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > WIDE).select("m", F.lit(True).alias("wide"))
    copies = wide.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # at most SALTS rows for WIDE ones of left
    left = left.withColumn("salt", F.pmod(F.xxhash64("d", "h", "at"), F.lit(SALTS)).cast("int")).join(copies, ["m", "salt"], "left").withColumn("at", F.when(F.col("wide"), F.col("at") - OPEN + GONE).otherwise(F.col("at")))
    per_doc = left.groupBy("d", "h").agg(F.collect_list(F.struct("at", "m")).alias("l")).select("d", "h", F.col("l.at").alias("ats"), F.col("l.m").alias("ms"))
    # the same columns as in without_repeats(), so that texts are shuffled once for both joins
    opened = keyed.join(per_doc, ["d", "h"]).select("d", "h", "no_id", "text", "ats", "ms").mapInPandas(_opened, "k long, d long, h long, at long, bytes binary")
    found = opened.repartition(parts(spark), "k").sortWithinPartitions("k").mapInPandas(_sorted, "d long, h long, at long")
    return keyed, judged.where(told).select("d", "h", "at").unionByName(found)


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row: its UTF-8 bytes without those that a string of WIDTH bytes covers which also starts earlier.

    Earlier is in a smaller doc_id (null ids come first, rows that share an id follow each
    other by a key of id and text) or in the same text before. Matches do not cross texts.
    Null texts are empty ones; texts of fewer than WIDTH bytes have no repeats. Of rows
    that repeat id and text one counts as the first. Very long texts are hashed in pieces.
    An empty table gives an empty result; other columns are not looked at.
    """
    keyed, gone = repeated(docs)
    spans = gone.groupBy("d", "h").agg(F.collect_list("at").alias("ats"))
    found = keyed.join(spans, ["d", "h"], "left").select("d", "h", "no_id", "text", "ats")
    rows = found.mapInPandas(_kept, "doc_id long, no_id boolean, h long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    same = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))
    each = same.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    again = (F.col("copy") > 1) & (F.col("n_bytes") >= WIDTH)
    whole = {"n_removed": F.col("n_bytes"), "n_spans": F.lit(1).cast("long"), "kept_sha256": F.lit(sha256(b"").hexdigest())}
    return each.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "n_bytes", *[F.when(again, v).otherwise(F.col(c)).alias(c) for c, v in whole.items()])
