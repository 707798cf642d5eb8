"""Cost-balanced packing of tokenized documents into fixed-length training sequences."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import guarded, restored, texts

LENGTH, END_ID, CHUNK_TOKENS = 4096, 2, 1 << 22
LINEAR, QUADRATIC = 1.0, 1.0 / LENGTH


SIGNS = b".,!?;:#$%&*()|-=+@/"
#: How the vocabulary's merge model spells bytes: printable ones as themselves, the others from U+0100 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
SPELT = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in set(_SHOWN))}


class WordTokenizer:
    """Token ids of a text, with the ids of each word kept for later texts.

    The vocabulary drops white space and never merges across it, so a text's ids are
    its words' ids in order. A word of letters up to U+024F, with signs behind it or
    without, goes to the merge model directly; any other goes through the whole
    tokenizer. The first `keep` words are kept for good, later ones in turns.
    """

    def __init__(self, path: str, keep: int = 400_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model, self.keep, self.known, self.late = self.whole.model, keep, {}, {}
        self.special = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        self.kind = "H" if self.whole.get_vocab_size() < 1 << 16 else "I"

    def word(self, word: bytes) -> bytes:
        """The ids of one word. Its letters and the signs behind them are looked up by themselves: other words share them."""
        stem = word.rstrip(SIGNS)
        text = stem.decode()
        plain = text.isalpha() and (text.isascii() or len(text.lower()) == len(text))
        if stem and not plain:
            return array(self.kind, self.whole.encode(word.decode(), add_special_tokens=False).ids).tobytes()
        if stem and stem != word:
            return self.of(stem) + self.of(word[len(stem) :])
        if not word.isascii():
            text = text.lower().encode().decode("latin-1").translate(SPELT)
        return array(self.kind, [t.id for t in self.model.tokenize(text or word.decode())]).tobytes()

    def of(self, word: bytes) -> bytes:
        """The ids of a word, as bytes; met words are kept."""
        known, late = self.known, self.late
        if (ids := known.get(word)) is None and (ids := late.get(word)) is None:
            ids = self.word(word)
            if len(known) < self.keep:
                known[word] = ids
            else:
                if len(late) >= self.keep // 4:
                    late.clear()
                late[word] = ids
        return ids

    def __call__(self, text: str) -> np.ndarray:
        raw = text.encode()
        if any(s in raw for s in self.special) or not (raw.isascii() or _plain(text)):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        words = raw.lower().split()  # lowers A-Z, splits at ASCII white space
        try:
            ids = b"".join(map(self.known.__getitem__, words))
        except KeyError:
            ids = b"".join(map(self.of, words))
        return np.frombuffer(ids, self.kind).astype(np.uint32)


def _plain(text: str) -> bool:
    """Characters up to U+024F and no control or white space but ASCII's own: words can be taken apart from each other."""
    return not any(c > "ɏ" or c in "İ\xad" or "\x7f" <= c <= "\xa0" for c in set(text))


def assign(lengths: np.ndarray, length: int = LENGTH, linear: float = LINEAR, quadratic: float = QUADRATIC, powers: bool = False) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset).

    Whole stretches of a full sequence are cut off first. The rests go, longest first,
    to the sequence of the lowest estimated cost, linear * n + quadratic * n * n summed
    over its pieces, among those with room for all of it; where none has, to the
    cheapest with any room, and what is over is assigned again. There are as many
    sequences as the tokens need, so less than one sequence is padding; with `powers` what
    would be a last one is cut into sequences of powers of two, which need no padding.
    """
    pieces, rests, seq = [], [], 0
    for d, n in enumerate(lengths.tolist()):
        for at in range(0, n - length + 1, length):
            pieces.append((d, at, length, seq, 0))
            seq += 1
        if n % length:
            rests.append((n % length, d, n - n % length))
    total = sum(r[0] for r in rests)
    over = total % length
    last = [1 << k for k in reversed(range(over.bit_length())) if over >> k & 1] if powers else [length] * (over > 0)
    most = np.array([length] * (total // length) + last, np.int64)
    used, cost = np.zeros(len(most), np.int64), np.zeros(len(most))
    for n, d, at in sorted(rests, key=lambda r: (-r[0], r[1])):
        while n:
            room = most - used
            fits = np.where(room >= n, cost, np.inf)
            k = int(fits.argmin())
            if not np.isfinite(fits[k]):
                k = int(np.where(room > 0, cost, np.inf).argmin())
            take = min(n, int(room[k]))
            pieces.append((d, at, take, seq + k, int(used[k])))
            used[k] += take
            cost[k] += linear * take + quadratic * take * take
            at, n = at + take, n - take
    return pieces


_TOKENIZERS: dict[str, WordTokenizer] = {}


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID, chunk_tokens: int = CHUNK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_cost.

    Each task packs the documents it has read, in chunks of about `chunk_tokens`
    tokens, so there is no shuffle, memory is bounded and a lost executor's tasks run
    again by themselves. Nothing is padded. sequence_id is the
    partition, the chunk and the sequence in it. Null and empty texts are the end id
    alone. A text over a chunk long is a chunk of its own. Repeated rows are packed
    each; null ids stay null; an empty table gives no pieces.
    """
    rows = guarded(texts(docs, id_col, text_col)).select("doc_id", "no_id", "text", F.spark_partition_id().cast("long").alias("part"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if tokenizer_path not in _TOKENIZERS:
            _TOKENIZERS[tokenizer_path] = WordTokenizer(tokenizer_path)
        ids_of, end = _TOKENIZERS[tokenizer_path], np.array([end_id], np.uint32)
        names, held, size, chunk = [], [], 0, 0

        def out(part: int) -> pd.DataFrame:
            pieces = assign(np.array([len(h) for h in held], np.int64), length, powers=True)
            cost: dict[int, float] = {}
            for p in pieces:
                cost[p[3]] = cost.get(p[3], 0.0) + LINEAR * p[2] + QUADRATIC * p[2] * p[2]
            return pd.DataFrame(
                {
                    "doc_id": [names[p[0]][0] for p in pieces],
                    "no_id": [names[p[0]][1] for p in pieces],
                    "start": [p[1] for p in pieces],
                    "length": [p[2] for p in pieces],
                    "ids_crc32": [zlib.crc32(held[p[0]][p[1] : p[1] + p[2]].astype("<u4").tobytes()) for p in pieces],
                    "doc_tokens": [len(held[p[0]]) for p in pieces],
                    "sequence_id": [(part << 40) + (chunk << 24) + p[3] for p in pieces],
                    "offset": [p[4] for p in pieces],
                    "sequence_cost": [cost[p[3]] for p in pieces],
                }
            )

        part = 0
        for b in batches:
            for name, no_id, text, part in zip(b["doc_id"], b["no_id"], b["text"], b["part"], strict=True):
                ids = np.concatenate([ids_of(text), end])
                if held and size + len(ids) > chunk_tokens:
                    yield out(part)
                    names, held, size, chunk = [], [], 0, chunk + 1
                names.append((name, no_id))
                held.append(ids)
                size += len(ids)
        if held:
            yield out(part)

    kinds = "doc_id long, no_id boolean, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_cost double"
    return restored(rows.mapInPandas(run, kinds))
