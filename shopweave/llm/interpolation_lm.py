"""Bigram language model by deleted interpolation, counted over the whole corpus."""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .common import forget, guarded, parts, restored, shared_dir, texts, written

BLOCK_CHARS, ROUNDS = 1 << 23, 80
#: Tokens whose hashes one shard adds up: a task of it holds no more hashes than that.
SHARD_TOKENS = 1 << 21
END, BEGIN = b"\n", b"\t"  # neither can be a word
#: EM sums are kept by context bucket and by the two ratios to the uniform probability, STEPS to the octave.
BUCKETS, STEPS, LEVELS, ZERO = 24, 4, 240, 80


def words(text: str) -> list[bytes]:
    return text.encode().lower().split()


def pack(numbers: np.ndarray) -> bytes:
    """Whole numbers as zstd over byte planes; sorted hashes are given as differences."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.uint64)


def differences(hashes: np.ndarray) -> np.ndarray:
    return np.diff(hashes, prepend=np.uint64(0))


def pairs_of(hashes: np.ndarray, ids: np.ndarray, firsts: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """(context ids, bigram hashes) of each token; the first one of a text follows the begin mark."""
    context = np.concatenate([[begin], ids[:-1]]).astype(ids.dtype)
    context[firsts] = begin
    mixed = (hashes[context] * np.uint64(0x9E3779B97F4A7C15)) ^ (hashes[ids] + np.uint64(0x632BE59BD9B4E019))
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return context, mixed ^ (mixed >> np.uint64(29))


@dataclass
class Block:
    """Some whole documents as token ids of a vocabulary of their own."""

    doc_ids: np.ndarray
    no_ids: np.ndarray
    learned: np.ndarray  # of each document: whether it is learned from
    sizes: np.ndarray  # of each document: tokens, the end included
    hashes: np.ndarray  # of each word of the vocabulary; 0 is the end, 1 the begin mark
    ids: np.ndarray  # of each token

    def __post_init__(self):
        self.firsts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        self.context, mixed = pairs_of(self.hashes, self.ids, self.firsts, 1)
        self.pairs, self.pair = np.unique(mixed, return_inverse=True)
        self.order = np.argsort(self.hashes, kind="stable")
        self.train = np.repeat(self.learned, self.sizes)

    def counted(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(kind, sorted hashes, how often each is learned from): kind 1 for tokens and the begin mark, 2 for bigrams."""
        one = np.bincount(self.ids[self.train], minlength=len(self.hashes))
        one[1] = self.learned.sum()
        two = np.bincount(self.pair[self.train], minlength=len(self.pairs))
        return [(1, self.hashes[self.order], one[self.order]), (2, self.pairs, two)]


COLUMNS = ("doc_ids", "no_ids", "learned", "sizes", "hashes", "ids")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows never learned from: crc32 of the id's text leaves 1 when divided by 5. Null ids are held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 1, F.lit(True))


def blocks(rows: DataFrame, block_chars: int) -> DataFrame:
    """(block, doc_ids ... ids): what each task has read, cut into blocks of whole documents, packed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs: list[tuple[int, bool, bool]] = []
        ids: list[np.ndarray] = []
        size, number = 0, defaultdict(count(2).__next__, {END: 0, BEGIN: 1})

        def out() -> pd.DataFrame:
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in number), np.uint64, len(number))
            own = dict(zip(COLUMNS, (np.array([d[0] for d in docs], np.int64).view(np.uint64), np.array([d[1] for d in docs]), np.array([d[2] for d in docs]), np.array([len(i) for i in ids]), hashes, np.concatenate(ids)), strict=True))
            return pd.DataFrame({"block": [uuid.uuid4().int >> 65], "n_tokens": [sum(map(len, ids))], **{k: [pack(v)] for k, v in own.items()}})

        for b in batches:
            for doc_id, no_id, learned, text in zip(b["doc_id"], b["no_id"], b["learned"], b["text"], strict=True):
                tokens = words(text)
                tokens.append(END)
                docs.append((doc_id, no_id, learned))
                ids.append(np.fromiter(map(number.__getitem__, tokens), np.uint32, len(tokens)))
                size += len(text)
                if size >= block_chars:
                    yield out()
                    docs, ids, size = [], [], 0
                    number = defaultdict(count(2).__next__, {END: 0, BEGIN: 1})
        if docs:
            yield out()

    kinds = "block long, n_tokens long, " + ", ".join(f"{c} binary" for c in COLUMNS)
    return rows.mapInPandas(run, kinds)


def opened(row) -> Block:
    doc_ids, no_ids, learned, sizes, hashes, ids = (unpack(row[c]) for c in COLUMNS)
    return Block(doc_ids.view(np.int64), no_ids > 0, learned > 0, sizes.astype(np.int64), hashes, ids.astype(np.int64))


def shared_counts(stored: DataFrame, shards: int) -> DataFrame:
    """(block, shard, kind, counts): for each block, the corpus counts of its hashes in a shard of the hash range.

    A block sends each distinct hash once, with its count, so a frequent word is as
    many rows as there are blocks. A shard, one partition, adds up all blocks' counts
    and returns each block its own, in the order sent. Block -1 has what the shard adds to N and V.
    """
    edges = [(i << 64) // shards for i in range(1, shards)]

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut = np.array(edges, np.uint64)
        for b in batches:
            for row in b.to_dict("records"):
                out = []
                for kind, hashes, counts in opened(row).counted():
                    at = np.searchsorted(hashes, cut)
                    for shard, (h, c) in enumerate(zip(np.split(hashes, at), np.split(counts, at), strict=True)):
                        if len(h):
                            out.append((shard, kind, row["block"], pack(differences(h)), pack(c)))
                yield pd.DataFrame(out, columns=["shard", "kind", "block", "hashes", "counts"])

    def add(rows: list[tuple[int, int, int, bytes, bytes]]) -> pd.DataFrame:
        hashes = [np.cumsum(unpack(r[3]), dtype=np.uint64) for r in rows]
        counts = np.concatenate([unpack(r[4]) for r in rows]).astype(np.int64)
        _, where = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.zeros(where.max() + 1, np.int64)
        np.add.at(total, where, counts)
        back = np.split(total[where], np.cumsum([len(h) for h in hashes])[:-1])
        shard, kind = rows[0][:2]
        out = [(r[2], shard, kind, pack(x)) for r, x in zip(rows, back, strict=True)]
        out.append((-1, shard, kind, pack(np.array([total.sum(), (total > 0).sum()]))))
        return pd.DataFrame(out, columns=["block", "shard", "kind", "counts"])

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, int, int, bytes, bytes]] = []
        for b in batches:
            for row in zip(*(b[c] for c in ("shard", "kind", "block", "hashes", "counts")), strict=True):
                if held and held[0][:2] != row[:2]:
                    yield add(held)
                    held = []
                held.append(row)
        if held:
            yield add(held)

    sent = stored.mapInPandas(send, "shard int, kind int, block long, hashes binary, counts binary")
    sent = sent.repartitionById(shards, "shard").sortWithinPartitions("shard", "kind", "block")
    return sent.mapInPandas(gather, "block long, shard int, kind int, counts binary")


def counts_of(block: Block, got: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Corpus counts of each token's bigram, context and word, from the shards' answers."""
    back = {k: np.concatenate([unpack(g["counts"]) for g in sorted((g for g in got if g["kind"] == k), key=lambda g: g["shard"])]).astype(np.int64) for k in (1, 2)}
    one = np.empty(len(block.hashes), np.int64)
    one[block.order] = back[1]
    return back[2][block.pair], one[block.context], one[block.ids]


def bucket(context: np.ndarray) -> np.ndarray:
    """Context-frequency bucket: the octave of the context's count."""
    return np.minimum(np.log2(np.maximum(context, 0) + 1).astype(np.int64), BUCKETS - 1)


def estimates(pair: np.ndarray, context: np.ndarray, word: np.ndarray, n: int, v: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Maximum-likelihood bigram and unigram estimates, and the uniform one over V words and an unseen one."""
    return np.where(context > 0, pair / np.maximum(context, 1), 0.0), word / max(n, 1), 1.0 / (v + 1)


def cells(block: Block, pair: np.ndarray, context: np.ndarray, word: np.ndarray, n: int, v: int) -> dict[str, np.ndarray]:
    """cell, many, two, one: tokens learned from, each left out of its own counts, by context bucket and rounded ratios.

    many counts a cell's tokens, two and one are sums of their bigram and unigram estimates over the uniform one.
    """
    t = block.train
    two, one, zero = estimates(pair[t] - 1, context[t] - 1, word[t] - 1, n - 1, v)

    def level(p: np.ndarray) -> np.ndarray:
        return np.where(p > 0, np.clip(np.rint(STEPS * np.log2(np.maximum(p, 1e-300) / zero)) + ZERO, 1, LEVELS - 1), 0).astype(np.int64)

    cell, at, many = np.unique((bucket(context[t] - 1) * LEVELS + level(two)) * LEVELS + level(one), return_inverse=True, return_counts=True)
    return {"cell": cell, "many": many, **{k: np.bincount(at, p / zero, len(cell)) for k, p in (("two", two), ("one", one))}}


def weights(cell: np.ndarray, many: np.ndarray, two: np.ndarray, one: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """(bucket, part) mixture weights of bigram, unigram and uniform estimates, by expectation-maximisation on the held-out counts.

    A cell's tokens stand at the mean of their ratios, which differ by less than a step.
    """
    where = cell // (LEVELS * LEVELS)
    p = np.stack([two / many, one / many, np.ones(len(cell))], axis=1)
    mix = np.full((BUCKETS, 3), 1 / 3)
    for _ in range(rounds):
        part = mix[where] * p
        part *= (many / part.sum(axis=1))[:, None]
        total = np.zeros((BUCKETS, 3))
        np.add.at(total, where, part)
        total += 1e-3  # keeps each weight above zero: every text has a probability
        mix = total / total.sum(axis=1, keepdims=True)
    return mix


def interpolated(docs: DataFrame, block_chars: int = BLOCK_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row.

    Tokens are the words in lower case (A-Z), split at ASCII white space, and one end.
    base_score adds log10 of the smoothed unigram estimates. score adds log10 of
    l2 c(u v)/c(u) + l1 c(v)/N + l0/(V+1), where u is the token before, or the begin
    mark, and the weights depend on the octave of c(u). The weights come from
    expectation-maximisation over all tokens learned from, each deleted from its own
    counts. All counts cover all rows outside held_out(); tokens are told apart by
    64-bit hashes. Null texts count as empty and have the end only; repeated rows are
    counted and scored each; an empty table gives an empty result.

    What a block of documents asks and is told about its distinct words and bigrams
    is shuffled, to shards of a bounded number of hashes; its tokens are written once,
    bucketed by block, and never move again. These tables are deleted once the scores,
    a few numbers a document, are written.
    """
    spark = docs.sparkSession
    n_parts = parts(spark)
    rows = guarded(texts(docs, id_col, text_col)).withColumn("learned", ~held_out() & ~F.col("no_id"))
    name = f"lm_blocks_{uuid.uuid4().hex}"
    blocks(rows, block_chars).write.bucketBy(n_parts, "block").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    stored = spark.table(name)
    shards = max(n_parts, -(-(stored.agg(F.sum("n_tokens")).first()[0] or 0) // SHARD_TOKENS))
    told = written(shared_counts(stored, shards), "lm-counts")
    sums = told.where("block = -1 and kind = 1").select("counts").toPandas()["counts"]  # one short row for each shard
    total = np.sum([unpack(x) for x in sums], axis=0, dtype=np.uint64) if len(sums) else np.zeros(2, np.uint64)
    # the begin mark is counted among the tokens' hashes but is none
    begun = rows.where("learned").count()
    n, v = int(total[0]) - begun, int(total[1]) - (begun > 0)
    answers = told.where("block <> -1").groupBy("block").agg(F.collect_list(F.struct("shard", "kind", "counts")).alias("got"))
    both = stored.join(answers, "block")

    def sums_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.to_dict("records"):
                block = opened(row)
                yield pd.DataFrame(cells(block, *counts_of(block, row["got"]), n, v))

    seen = both.mapInPandas(sums_of, "cell long, many long, two double, one double").groupBy("cell")
    seen = seen.agg(*[F.sum(c).alias(c) for c in ("many", "two", "one")]).orderBy("cell").toPandas()  # at most BUCKETS * LEVELS * LEVELS rows
    mix = weights(seen["cell"].to_numpy(np.int64), *(seen[c].to_numpy(np.float64) for c in ("many", "two", "one")))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.to_dict("records"):
                block = opened(row)
                pair, context, word = counts_of(block, row["got"])
                two, one, zero = estimates(pair, context, word, n, v)
                w = mix[bucket(context)]
                full = np.log10(w[:, 0] * two + w[:, 1] * one + w[:, 2] * zero)
                base = np.log10((word + 0.5) / (n + 0.5 * (v + 1)))
                yield pd.DataFrame(
                    {
                        "doc_id": block.doc_ids,
                        "no_id": block.no_ids,
                        "n_tokens": block.sizes,
                        "n_known": np.add.reduceat((word > 0).astype(np.int64), block.firsts),
                        "base_score": np.add.reduceat(base, block.firsts),
                        "score": np.add.reduceat(full, block.firsts),
                    }
                )

    out = written(restored(both.mapInPandas(score, "doc_id long, no_id boolean, n_tokens long, n_known long, base_score double, score double")), "lm-scores")
    forget(stored)
    forget(told)
    spark.sql(f"drop table {name}")
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
