"""Fuzzy line dedup: MinHash over character shingles, verified, one line kept per component."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import aside, forget, row_key, texts, written
from .links import SALT, bucketed_links, keyed

SHINGLE, BANDS, ROWS, THRESHOLD = 8, 10, 4, 0.8
_R = np.random.default_rng(20240607)
MULTIPLY = _R.integers(0, 2**31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
ADD = _R.integers(0, 2**32, BANDS * ROWS, np.uint32)
FOLD = _R.integers(0, 2**63, ROWS, np.uint64) | np.uint64(1)


def shingle_hashes(text: str, k: int) -> np.ndarray:
    """32-bit hashes of all windows of k characters."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    h = np.zeros(len(c) - k + 1, np.uint32)
    for i in range(k):
        h *= np.uint32(0x01000193)
        h ^= c[i : i + len(h)] * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return h ^ (h >> np.uint32(13))


def signatures(lines: list[str], k: int = SHINGLE) -> np.ndarray:
    """(line, slot) MinHash values over k-character shingles; a shorter line is one shingle."""
    out = np.empty((len(lines), BANDS * ROWS), np.uint32)
    at = 0
    while at < len(lines):
        chosen, size = [], 0
        while at + len(chosen) < len(lines) and (not chosen or size < 1 << 16):
            chosen.append(lines[at + len(chosen)].ljust(k, "\0"))
            size += len(chosen[-1]) + 1
        out[at : at + len(chosen)] = _signed(chosen, k)
        at += len(chosen)
    return out


def _signed(lines: list[str], k: int) -> np.ndarray:
    h = shingle_hashes("\n".join(lines) + "\n" * k, k)
    n = len(h)
    sizes = np.array([len(x) for x in lines])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    spans = np.stack([starts, starts + sizes - k + 1], axis=1).ravel()  # the windows of each line, then those over its end
    low, x = np.empty((BANDS * ROWS, len(lines)), np.uint32), np.empty(n, np.uint32)
    for j in range(BANDS * ROWS):
        np.multiply(h, MULTIPLY[j], out=x)
        np.add(x, ADD[j], out=x)
        low[j] = np.minimum.reduceat(x, spans)[::2]
    return low.T


def band_keys(signed: np.ndarray) -> np.ndarray:
    """(line, band) keys: lines with the same slots in a band have the same key."""
    rows = (signed.reshape(-1, BANDS, ROWS).astype(np.uint64) + np.uint64(1)) * FOLD
    rows ^= rows >> np.uint64(29)
    mixed = rows[:, :, 0].copy()
    for r in range(1, ROWS):
        mixed = (mixed ^ rows[:, :, r]) * np.uint64(0x9FB21C651E98DF25)
        mixed ^= mixed >> np.uint64(32)
    return keyed(mixed * np.uint64(0xD6E8FEB86659FD93))


def shingle_set(line: str, k: int = SHINGLE) -> set[str]:
    return {line[i : i + k] for i in range(max(1, len(line) - k + 1))}


def jaccard(a: str, b: str) -> float:
    """Exact Jaccard similarity of the two sets of character shingles."""
    x, y = shingle_set(a), shingle_set(b)
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def shingle_codes(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`links.Shingles` of lines. A shingle below U+0100 is coded by its 8 characters, a byte each, another by a hash; a shorter line is one shingle."""
    c = np.frombuffer("".join([x.ljust(SHINGLE, "\0") for x in lines]).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.array([max(len(x), SHINGLE) for x in lines], np.int64)
    ends, whole = np.cumsum(n), -(-len(c) // SHINGLE) * SHINGLE
    low, codes = np.zeros(whole + SHINGLE, np.uint8), np.empty(whole, np.uint64)
    low[: len(c)] = c.astype(np.uint8)
    for i in range(SHINGLE):
        codes[i::SHINGLE] = low[i : i + whole].view(np.uint64)
    inside = np.ones(len(c), bool)
    inside[(ends[:, None] - np.arange(1, SHINGLE)).ravel()] = False
    wide = np.concatenate([[0], np.cumsum(c > 255)])
    if wide[-1]:
        at = np.nonzero(inside[: len(c) - SHINGLE + 1] & (wide[SHINGLE:] > wide[:-SHINGLE]))[0]
        h = np.zeros(len(at), np.uint64)
        for i in range(SHINGLE):
            h = (h ^ c[at + i]) * np.uint64(0x9FB21C651E98DF25)
            h ^= h >> np.uint64(32)
        codes[at] = h
    plain = np.ones(len(n), bool)
    plain[np.searchsorted(ends, np.nonzero((c > 255) | (c == 0))[0], side="right")] = False  # a real \0 looks like padding
    return codes[: len(c)][inside], n - SHINGLE + 1, plain


def lines_of(text: str) -> list[str]:
    """The lines that aren't blank, without spaces at their ends."""
    return [x for line in text.split("\n") if (x := line.strip(" "))]


def _places(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, doc_key, pos, h, l, size, b0 ...): each line that isn't blank, its 128-bit hash, and once in a batch its length and band keys."""
    rows = texts(docs, id_col, text_col).select("doc_id", row_key().alias("doc_key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, pos, which, number = [], [], [], {}
            for d, t in enumerate(batch.column("text").to_pylist()):
                for i, line in enumerate(t.split("\n")):
                    if line := line.strip(" "):
                        doc.append(d)
                        pos.append(i)
                        which.append(number.setdefault(line, len(number)))
            lines, at = list(number), np.array(which, np.int64)
            raw = [x.encode() for x in lines]
            h, low = (np.fromiter((xxhash.xxh64_intdigest(x, s) for x in raw), np.uint64, len(raw)).view(np.int64) for s in (42, SALT))
            first = np.zeros(len(at), bool)
            first[np.unique(at, return_index=True)[1]] = True
            once = np.nonzero(first)[0]  # in the order of `lines`
            slot = np.zeros(len(at), np.int64)
            slot[once] = at[once]
            bands, size = band_keys(signatures(lines)), np.array([len(x) for x in lines], np.int32)
            take = pa.array(np.array(doc, np.int64))
            own = {c: pa.array(v[slot] if len(v) else np.zeros(0, v.dtype), mask=~first) for c, v in {"size": size, **{f"b{i}": bands[:, i] for i in range(BANDS)}}.items()}
            yield pa.record_batch({"doc_id": batch.column("doc_id").take(take), "doc_key": batch.column("doc_key").take(take), "pos": pa.array(pos, pa.int32()), "h": h[at], "l": low[at], **own})

    kind = rows.schema["doc_id"].dataType.simpleString()
    kinds = f"doc_id {kind}, doc_key long, pos int, h long, l long, size int, " + ", ".join(f"b{i} long" for i in range(BANDS))
    return written(rows.mapInArrow(run, kinds), "line-places")


def _components(places: DataFrame, docs: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """(h, l, root): lines that occur again or are linked, with a number that those of one component share."""
    bands = [f"b{i}" for i in range(BANDS)]
    distinct = places.groupBy("h", "l").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"), *[F.max(b).alias(b) for b in bands])
    distinct = written(distinct.select(F.monotonically_increasing_id().alias("id"), "h", "l", "n", "size", F.array(*bands).alias("bands")), "distinct-lines")
    linked = bucketed_links(distinct, texts(docs, id_col, text_col), lines_of, shingle_codes, jaccard, threshold)
    named = distinct.select("id", "h", "l", "n").join(linked.withColumnRenamed("node", "id"), "id", "left")
    roots = written(named.where("n > 1 or root is not null").select("h", "l", F.coalesce("root", "id").alias("root")), "line-roots")
    forget(distinct)
    return roots


def line_components(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h, l, root) of each line, by the 128-bit hash of it, that occurs again or is linked to another; linked ones share a root."""
    return _components(_places(docs, id_col, text_col), docs, threshold, id_col, text_col)


def _gone(docs: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """(key, owner, gone): for rows that lose lines, the row key and doc_id and the sorted positions of those lines."""
    places = _places(docs, id_col, text_col)
    roots = _components(places, docs, threshold, id_col, text_col)
    again = written(places.select("h", "l", "doc_id", "doc_key", "pos").join(roots, ["h", "l"]).select("root", "doc_id", "doc_key", "pos"), "repeated-lines")
    keep = again.groupBy("root").agg(F.min(F.struct("doc_id", "doc_key", "pos")).alias("keep")).select("keep.*").toDF("d", "k", "p")
    keep = written(keep, "kept-lines")
    same = F.col("doc_key").eqNullSafe(F.col("k")) & (F.col("pos") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("d"))
    gone = again.join(keep, same, "left_anti").groupBy(F.col("doc_key").alias("key"), F.col("doc_id").alias("owner"))
    gone = written(gone.agg(F.array_sort(F.collect_set("pos")).alias("gone")), "gone-lines")
    for done in (places, roots, again, keep):
        forget(done)
    return gone


def _with_gone(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows (doc_id, text ...) and gone, null where no line goes."""
    keyed = rows.withColumn("doc_key", row_key())
    return keyed.join(gone, (F.col("doc_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("owner")), "left").withColumn("lines", F.split("text", "\n"))


def _without() -> Column:
    """The text of what lies between the lines that go, each line looked at once."""
    before, after = F.concat(F.array(F.lit(-1)), "gone"), F.concat("gone", F.array(F.size("lines")))
    kept = F.flatten(F.zip_with(before, after, lambda a, b: F.slice("lines", a + 2, b - a - 1)))
    return F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_lines, n_removed) for each row: text without the lines kept elsewhere.

    Lines are compared without spaces at their ends; links join lines whose 8-character
    shingle sets reach the threshold. Equal lines are one node; lines are told apart by
    128 bits. Of each component the occurrence with the smallest (doc_id, row key,
    position) stays, wherever it is; blank lines always stay. Null texts count as empty
    and come back empty. Rows that repeat doc_id and text are one document: both keep or
    lose the same lines. Null ids sort first. An empty table gives an empty result. A
    line is never cut, however long it is.
    """
    rows = _with_gone(texts(docs, id_col, text_col), _gone(docs, threshold, id_col, text_col))
    return rows.select("doc_id", _without().alias("text"), F.size("lines").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"))


def drop_repeated_lines(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with all their columns, whatever their names, the text without lines kept elsewhere; rows that have lost every line that isn't blank go."""
    rows = _with_gone(aside(docs, id_col, text_col), _gone(docs, threshold, id_col, text_col)).select("row", "gone", _without().alias("left"))
    rows = rows.where(F.col("gone").isNull() | F.col("left").rlike(r"\S"))
    new = F.when(F.col("gone").isNotNull(), F.col("left")).otherwise(F.col(f"row.`{text_col}`")).alias(text_col)
    return rows.select(*[new if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])
