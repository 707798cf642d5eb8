"""MinHash document fingerprints, likeness to edited and next documents, verified near copies."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import parts, texts, written
from .links import BAND_SHIFT, FIRST_BAND, SALT, bucketed_links, one_by_one

SLOTS, SHINGLE, BANDS, ROWS, THRESHOLD = 128, 5, 21, 6, 0.8
_R = np.random.default_rng(90210)
#: Universal hashing: x -> a * x + b modulo 2**32 with odd a permutes the 32-bit shingle hashes.
A = _R.integers(0, 2**31, SLOTS, np.uint32) * np.uint32(2) + np.uint32(1)
B = _R.integers(0, 2**32, SLOTS, np.uint32)
NO_ID = -(1 << 63)
#: Characters that are held in a task at a time.
HELD = 1 << 20


def distinct_hashes(text: str) -> np.ndarray:
    """The set of a text's shingles as sorted 64-bit hashes."""
    return np.unique(_mixed(text.encode().lower().split(), SHINGLE, wide=True))


def shingles(words: list[bytes], k: int = SHINGLE) -> np.ndarray:
    """32-bit hashes of the k-word shingles; fewer words are one shingle, none is none."""
    return (_mixed(words, k) >> np.uint64(32)).astype(np.uint32)


def _mixed(words: list[bytes], k: int, wide: bool = False) -> np.ndarray:
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) if wide else np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    n = max(1, len(w) - k + 1) if len(w) else 0
    h = np.full(n, min(k, len(w)), np.uint64)
    for i in range(min(k, len(w))):
        h = (h ^ w[i : i + n]) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(29)
    return h


def signatures(many: list[str]) -> np.ndarray:
    """(text, slot) MinHash values, the low 8 bits of each; a text without a word has ones throughout."""
    out, at = np.full((len(many), SLOTS), 0xFF, np.uint8), 0
    while at < len(many):
        own, size = [], 0
        while at + len(own) < len(many) and (not own or size < 1 << 16):
            own.append(shingles(many[at + len(own)].encode().lower().split()))
            size += len(own[-1])
        some = [i for i, h in enumerate(own) if len(h)]
        if some:
            h = np.concatenate([own[i] for i in some])
            starts = np.concatenate([[0], np.cumsum([len(own[i]) for i in some])[:-1]])
            x, rows = np.empty(len(h), np.uint32), at + np.array(some)
            for j in range(SLOTS):
                np.multiply(h, A[j], out=x)
                np.add(x, B[j], out=x)
                out[rows, j] = np.minimum.reduceat(x, starts) & np.uint32(0xFF)
        at += len(own)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of fingerprints: the share of equal values beyond what 8 bits match by chance."""
    return np.clip(((a == b).mean(axis=1) - 1 / 256) / (1 - 1 / 256), 0, 1)


def jaccard(a: str, b: str) -> float:
    """Exact Jaccard similarity of the sets of five-word shingles; two texts without a word are alike."""
    x, y = (t.encode().lower().split() for t in (a, b))
    x, y = ({tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} for w in (x, y))
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the first as many characters of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _ordered(docs: DataFrame, n: int) -> DataFrame:
    """(bucket, halo, doc_id, z): documents dealt to n ranges of doc_id, each followed by a copy of the document after it.

    Only ids are counted to find the ranges and their first documents, n of each; the
    texts, compressed, are shuffled once. Null ids come last.
    """
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"))
    quantiles = ids.stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (4 * n)) if n > 1 else []
    edges = np.unique(np.array(quantiles, np.float64)).astype(np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch({"bucket": np.searchsorted(edges, b.column(0).to_numpy(), "right"), "doc_id": b.column(0)})

    heads = dict(ids.mapInArrow(place, "bucket long, doc_id long").groupBy("bucket").agg(F.max("doc_id")).collect())  # n rows at most
    used = sorted(heads)
    follows: dict[int, list[int]] = {}
    for bucket, after in zip(used, used[1:] + used[:1], strict=True):
        follows.setdefault(heads[bucket], []).append(after)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            doc = b.column(0).to_numpy()
            z = [press.compress(t.encode()) for t in b.column(1).to_pylist()]
            again = [(i, after) for i, d in enumerate(doc.tolist()) if d in follows for after in follows[d]]
            bucket = np.concatenate([np.searchsorted(edges, doc, "right"), np.array([a for _, a in again], np.int64)])
            take = np.concatenate([np.arange(len(doc)), np.array([i for i, _ in again], np.int64)])
            yield pa.record_batch({"bucket": bucket, "halo": np.arange(len(take)) >= len(doc), "doc_id": doc[take], "z": pa.array([z[i] for i in take.tolist()], pa.binary())})

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    return rows.mapInArrow(deal, "bucket long, halo boolean, doc_id long, z binary")


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, h, l, fingerprint, edited_fingerprint, edited_sha256, near_edited, near_next), in one pass over ordered ranges."""
    rows = texts(docs, id_col, text_col)
    n = parts(docs.sparkSession)
    dealt = _ordered(rows, n).repartitionById(n, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "halo", F.desc("doc_id"), "z")

    def made(held: list[tuple[int, bool, int, str]]) -> pa.RecordBatch:
        """Rows of all held documents but the last, which is only what the one before it is followed by."""
        at = [k for k, (a, b) in enumerate(zip(held, held[1:], strict=False)) if a[0] == b[0] and not a[1]]
        own = signatures([h[3] for h in held])
        new = [edited(held[k][3], held[k + 1][3]) for k in at]
        mine, following, changed = own[at], own[[k + 1 for k in at]], signatures(new)
        raw = [held[k][3].encode() for k in at]
        h, low = (np.fromiter((xxhash.xxh64_intdigest(t, s) for t in raw), np.uint64, len(raw)).view(np.int64) for s in (42, SALT))
        return pa.record_batch(
            {
                "doc_id": pa.array([held[k][2] for k in at], pa.int64()),
                "n_chars": pa.array([len(held[k][3]) for k in at], pa.int64()),
                "h": h,
                "l": low,
                "fingerprint": pa.array([m.tobytes() for m in mine], pa.binary()),
                "edited_fingerprint": pa.array([m.tobytes() for m in changed], pa.binary()),
                "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new], pa.string()),
                "near_edited": likeness(mine, changed),
                "near_next": likeness(mine, following),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        held: list[tuple[int, bool, int, str]] = []
        size = 0
        for b in batches:
            for bucket, halo, doc_id, z in zip(*(b.column(c).to_pylist() for c in ("bucket", "halo", "doc_id", "z")), strict=True):
                held.append((bucket, halo, doc_id, open_.decompress(z).decode()))
                size += len(held[-1][3])
                if size > HELD and len(held) > 1:
                    yield made(held)
                    held = held[-1:]
                    size = len(held[0][3])
        if held:
            yield made(held)

    kinds = "doc_id long, n_chars long, h long, l long, fingerprint binary, edited_fingerprint binary, edited_sha256 string, near_edited double, near_next double"
    return dealt.mapInArrow(run, kinds)


def near_copies(signed: DataFrame, docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h, l, root, low) of each distinct text: the number of its component, and the smallest doc_id of the text.

    Texts that agree in a band of their fingerprints are compared by exact Jaccard.
    """
    bands = [(F.shiftrightunsigned(F.xxhash64(F.substring("fingerprint", 1 + ROWS * i, ROWS)), 64 - BAND_SHIFT) + F.lit(i - FIRST_BAND << BAND_SHIFT)) for i in range(BANDS)]
    distinct = signed.groupBy("h", "l").agg(F.min(F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))).alias("low"), F.max("n_chars").alias("size"), F.first("fingerprint").alias("fingerprint"))
    distinct = written(distinct.select(F.monotonically_increasing_id().alias("id"), "h", "l", "low", "size", F.array(*bands).alias("bands")), "distinct-texts")
    labels = bucketed_links(distinct.drop("low"), texts(docs, id_col, text_col), lambda t: [t], one_by_one(distinct_hashes), jaccard, threshold)
    return distinct.join(labels, distinct.id == labels.node, "left").select("h", "l", F.coalesce("root", "id").alias("root"), "low")


def fingerprints(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, component_id) for each row.

    A fingerprint is 128 MinHash values of 8 bits over five-word shingles (words lower
    case, split at ASCII white space); likeness is the share of equal values, less
    what matches by chance. The next
    document is that of the next smaller doc_id, after the last the first; rows that
    repeat an id follow each other in an order of their bytes, null ids come last.
    component_id is the smallest doc_id reachable over exact Jaccard links of at least
    `threshold`, looked for wherever a band of fingerprints agrees. Null texts count as
    empty; texts without a word are alike; a shorter text than five words is one
    shingle; an only row is its own next; an empty table gives an empty result.
    """
    signed = written(compared(docs, id_col, text_col), "fingerprints")
    named = written(near_copies(signed, docs, threshold, id_col, text_col), "text-roots")
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    found = written(named.join(least, "root").select("h", "l", "component_id"), "text-components")
    text = [F.lower(F.hex(c)).alias(c) for c in ("fingerprint", "edited_fingerprint")]
    doc_id = F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id")
    return signed.join(found, ["h", "l"]).select(doc_id, "n_chars", "edited_sha256", *text, "near_edited", "near_next", "component_id")
