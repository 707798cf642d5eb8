"""Quality classifier: a factorisation machine over hashed words and structure statistics."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import guarded, restored, texts

WORD_BUCKETS, RANK, SAMPLE, EPOCHS = 1 << 15, 8, 6000, 6
#: Structure statistics, each cut into BINS one-hot features behind the word buckets.
STATS, BINS = 16, 24
SIZE = WORD_BUCKETS + STATS * BINS


def statistics(text: str, words: list[bytes], hashes: np.ndarray) -> np.ndarray:
    """Each statistic as a number of about 0 to 1: shares, ratios and lengths on a log scale."""
    n, w = max(1, len(text)), max(1, len(words))
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    lines = text.split("\n")
    upper = ((c >= 65) & (c <= 90)).sum()
    lower = ((c >= 97) & (c <= 122)).sum()
    digits = ((c >= 48) & (c <= 57)).sum()
    signs = ((c < 128) & (c > 32)).sum() - upper - lower - digits
    usual = np.isin(c, [33, 39, 44, 45, 46, 63]).sum()
    kinds, counts = np.unique(hashes, return_counts=True)
    ends = sum(x[-1:] in b".,!?" for x in words)
    log = lambda x, top: np.log1p(x) / np.log1p(top)
    return np.array(
        [
            log(len(text), 200_000), log(w, 30_000), min(1, (n / w) / 20), upper / n, (upper / max(1, upper + lower)), digits / n, signs / n, (signs - usual) / n,
            len(kinds) / w, counts.max(initial=0) / w, log(len(lines), 3000), min(1, log(n / len(lines), 5000)), len(set(lines)) / len(lines), ends / w,
            (c > 127).sum() / n, text.count("|") / w,
        ]
    )


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values): a hashed word weighs its log count, all words together 1; each statistic lights one bin."""
    words = text.encode().lower().split()
    hashes = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) & np.uint32(WORD_BUCKETS - 1)
    index, counts = np.unique(hashes, return_counts=True)
    value = np.log1p(counts)
    value /= max(1e-9, np.sqrt((value * value).sum()))
    bins = np.clip((np.sqrt(np.clip(statistics(text, words, hashes), 0, 1)) * BINS).astype(np.int64), 0, BINS - 1)
    extra = WORD_BUCKETS + np.arange(STATS) * BINS + bins
    return np.concatenate([index.astype(np.int64), extra]), np.concatenate([value, np.full(STATS, 0.5)]).astype(np.float32)


class FactorisationMachine:
    """bias + w.x + pairwise interactions of rank k, by half of (sum v x)^2 - sum (v x)^2."""

    def __init__(self, size: int = SIZE, rank: int = RANK, seed: int = 7):
        self.bias, self.w = 0.0, np.zeros(size, np.float32)
        self.v = (np.random.default_rng(seed).standard_normal((size, rank)) * 0.02).astype(np.float32)

    def margin(self, index: np.ndarray, value: np.ndarray) -> float:
        vx = self.v[index] * value[:, None]
        total = vx.sum(axis=0)
        return float(self.bias + self.w[index] @ value + 0.5 * (total @ total - (vx * vx).sum()))

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(*features(text)), -30, 30))))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.1, decay: float = 1e-5, seed: int = 11) -> FactorisationMachine:
        """Logistic loss, AdaGrad, one row at a time in a fixed random order."""
        if not len(rows):
            return self
        share = np.clip(labels.mean(), 0.01, 0.99)
        self.bias = float(np.log(share / (1 - share)))
        gw, gv, gb, order = np.full(len(self.w), 1e-6, np.float32), np.full(self.v.shape, 1e-6, np.float32), 1e-6, np.random.default_rng(seed)
        for _ in range(epochs):
            for r in order.permutation(len(rows)):
                i, x = rows[r]
                vx = self.v[i] * x[:, None]
                total = vx.sum(axis=0)
                z = self.bias + self.w[i] @ x + 0.5 * (total @ total - (vx * vx).sum())
                d = np.float32(1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[r])
                dw = d * x + decay * self.w[i]
                dv = d * x[:, None] * (total[None, :] - vx) + decay * self.v[i]
                gw[i] += dw * dw
                gv[i] += dv * dv
                gb += float(d * d)
                self.w[i] -= rate * dw / np.sqrt(gw[i])
                self.v[i] -= 0.3 * rate * dv / np.sqrt(gv[i])
                self.bias -= rate * float(d) / np.sqrt(gb)
        return self


def held_out(id_col: str = "doc_id") -> Column:
    """Rows never learned from: crc32 of the id's text leaves 1 when divided by 3. Null ids are held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> FactorisationMachine:
    """Fits the machine on at most `sample` labelled rows outside held_out(): those of the smallest hash of their id.

    Of the documents that share an id one counts, that of the text of the smallest hash;
    an id that is labelled both ways counts as 1; null and other labels are left out.
    """
    own = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    own = own.where(~held_out() & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = own.orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id").limit(sample)
    rows = texts(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")  # chosen: at most `sample` rows of 12 bytes
    rows = rows.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            both = [features(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "label": b["label"], "i": [i.astype(np.int32).tobytes() for i, _ in both], "x": [x.tobytes() for _, x in both]})

    got = rows.mapInPandas(run, "doc_id long, label int, i binary, x binary").toPandas().sort_values(["doc_id", "i"])
    pairs = [(np.frombuffer(i, np.int32).astype(np.int64), np.frombuffer(x, np.float32)) for i, x in zip(got["i"], got["x"], strict=True)]
    return FactorisationMachine().fit(pairs, got["label"].to_numpy(np.float32))


def score(docs: DataFrame, model: FactorisationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row.

    The score comes from the text alone. Empty and null texts have the score of their
    statistics; texts are read whole; repeated rows are scored each; an empty table
    gives an empty result. The model has a fixed size, whatever the input.
    """
    rows = guarded(texts(docs, id_col, text_col))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "no_id": b["no_id"], "score": [sent.value.score(t) for t in b["text"]]})

    out = restored(rows.mapInPandas(run, "doc_id long, no_id boolean, score double"))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: FactorisationMachine, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores at least `least`."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(text: pd.Series) -> pd.Series:
        return pd.Series([sent.value.score(t or "") for t in text], dtype="float64")

    return docs.where(of(F.col(f"`{text_col}`")) >= least)
