"""Words that are one edit apart, found among the sorted rotations of all words, and the form that each variant belongs to."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import parts, texts, written

#: Ends each word before it is rotated; no word has it.
MARK = "$"
RUN = re.compile("[a-zÀ-ÿ]+")
MIN_LENGTH, MIN_COUNT, LEADS, TYPO_EVERY = 6, 5, 5, 199
#: Distinct words that a task adds up before it lets go of them.
HELD = 1 << 19
#: Texts above this many characters are read run by run, not into a list of all runs.
LISTED = 1 << 20


def counted(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, typo_every: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the runs of letters of whole texts, A-Z lower-cased, that are long and frequent enough.

    With typo_every, one code point is taken from a run of a document where that number
    divides h, the crc32 of "id:run": the one at h modulo the run's length. A null id
    counts as an empty one there.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[str] = Counter()

        def let_go() -> pd.DataFrame:
            out = pd.DataFrame({"word": np.array(list(total.keys()), object), "n": np.fromiter(total.values(), np.int64, len(total))})
            total.clear()
            return out

        for b in batches:
            for name, text in zip(b["name"], b["text"], strict=True):
                lower = text.encode().lower().decode()  # of bytes: A-Z only
                runs = RUN.findall(lower) if len(lower) <= LISTED else (m[0] for m in RUN.finditer(lower))
                start = crc32(f"{name}:".encode())
                for word, n in Counter(runs).items():
                    if len(word) < min_length:
                        continue
                    if typo_every and (h := crc32(word.encode(), start)) % typo_every == 0:
                        word = word[: h % len(word)] + word[h % len(word) + 1 :]
                        if len(word) < min_length:
                            continue
                    total[word] += n
                if len(total) > HELD:
                    yield let_go()
        yield let_go()

    rows = texts(docs, id_col, text_col).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), "text")
    words = rows.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return words.where(F.col("n") >= min_count)


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, skipped, n) of words (word, n): each rotation of a marked word twice, whole and without its last character.

    The last character of a rotation is the one that an edit touches. A word with another
    character there has the same prefix, one without any has the prefix as a whole rotation.
    """
    marked = words.select(F.concat("word", F.lit(MARK)).alias("m"), "n")
    turned = marked.select("n", F.explode(F.sequence(F.lit(1), F.length("m"))).alias("k"), "m").select(F.concat(F.expr("substr(m, k)"), F.expr("substr(m, 1, k - 1)")).alias("r"), "n")
    last = F.right("r", F.lit(1))
    whole = F.struct(F.col("r").alias("prefix"), F.lit("").alias("skipped"))
    cut = F.when(last != MARK, F.struct(F.expr("left(r, length(r) - 1)").alias("prefix"), last.alias("skipped")))
    return turned.select("n", F.explode(F.array(whole, cut)).alias("e")).where("e is not null").select("e.prefix", "e.skipped", "n")


def _unturned(rotation: str) -> str:
    tail, _, head = rotation.partition(MARK)
    return head + tail


def _scanned(prefix: np.ndarray, skipped: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    """(word, near, near_n, k) of whole groups, sorted by prefix, n downwards and skipped character: k near words, of which the best is told."""
    word = np.array([_unturned(p + s) for p, s in zip(prefix, skipped, strict=True)], object)
    starts = np.r_[True, prefix[1:] != prefix[:-1]] if len(prefix) else np.zeros(0, bool)
    group = np.cumsum(starts) - 1
    groups = int(group[-1]) + 1 if len(group) else 0
    whole = skipped == ""
    #: Taking one of several equal letters in a row gives the same word: only the first of them stands for an indel.
    once = ~whole & np.array([p[-1:] != s for p, s in zip(prefix, skipped, strict=True)], bool)
    out = []

    def first_of(rows: np.ndarray) -> np.ndarray:
        found = np.full(groups, -1)
        found[group[rows][::-1]] = rows[::-1]
        return found

    def tell(rows: np.ndarray, near: np.ndarray, k: np.ndarray) -> None:
        out.append(pd.DataFrame({"word": word[rows], "near": word[near], "near_n": n[near], "k": k}))

    members = np.flatnonzero(~whole)
    first = first_of(members)
    second = first_of(members[members != first[group[members]]]) if len(members) else first
    others = np.bincount(group[members], minlength=groups) - 1
    rows = members[others[group[members]] > 0]  # another character in its place
    tell(rows, np.where(rows == first[group[rows]], second[group[rows]], first[group[rows]]), others[group[rows]])
    full = first_of(np.flatnonzero(whole))
    rows = np.flatnonzero(once)
    rows = rows[full[group[rows]] >= 0]  # the character taken out
    tell(rows, full[group[rows]], np.ones(len(rows), np.int64))
    longer, more = first_of(np.flatnonzero(once)), np.bincount(group[once], minlength=groups)
    rows = full[(full >= 0) & (longer >= 0)]  # a character put in
    tell(rows, longer[group[rows]], more[group[rows]])
    return pd.concat(out)


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near, near_n, k): from each group of rotations with one prefix, how many near words a word has there and the most frequent.

    Rotations are dealt by prefix and sorted; a group has one word for each character at
    most, so it is small whatever the words are, and no pairs are put out. A pair of words
    that are one edit apart meets in exactly one group.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = [np.empty(0, object), np.empty(0, object), np.empty(0, np.int64)]
        for b in batches:
            rows = [np.concatenate([r, b[c].to_numpy()]) for r, c in zip(rest, ("prefix", "skipped", "n"), strict=True)]
            at = len(rows[0])
            while at and rows[0][at - 1] == rows[0][-1]:
                at -= 1
            rest = [r[at:] for r in rows]
            yield _scanned(*[r[:at] for r in rows])
        yield _scanned(*rest)

    dealt = rotations(words).repartition(parts(words.sparkSession), "prefix").sortWithinPartitions("prefix", F.desc("n"), F.expr("substr(prefix || skipped, instr(prefix || skipped, '$') + 1) || substring_index(prefix || skipped, '$', 1)"))
    return dealt.mapInPandas(run, "word string, near string, near_n long, k long")


def variants(words: DataFrame, leads: int = LEADS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each of words (word, n), which are distinct.

    n_near counts the words one inserted, deleted or replaced code point away. The form
    is the most frequent of them (ties: the first in code-point order) if it is at least
    `leads` times as frequent as the word, else null. The root is the last form reached by
    following forms. Frequencies grow by that factor at each step, so the number of
    steps, and of the doubling rounds here, follows from the largest one.
    """
    words = written(words, "words")
    per_word = neighbours(words).groupBy("word").agg(F.sum("k").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best"))
    led = -F.col("best.n") >= leads * F.col("n")
    told = words.join(per_word, "word", "left").select(
        "word", F.when(led, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(led, -F.col("best.n")).alias("form_n")
    )
    told = written(told, "forms")
    ends = told.agg(F.min("n"), F.max("n")).first()
    steps = int(math.log(max(ends[1] / ends[0], 1), leads) + 1e-9) if ends[0] else 0
    up = told.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        ahead = up.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        up = written(up.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "roots")
    return told.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def grouped(docs: DataFrame) -> DataFrame:
    """variants() of the words of docs, with a letter taken from about every 199th run of a document.

    Null and empty texts have no words, repeated rows count each, an empty table gives an
    empty result, other columns are not looked at; a very long text is read run by run.
    """
    return variants(counted(docs, typo_every=TYPO_EVERY))


def oracle() -> str:
    """DuckDB SQL for grouped(documents)."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    bits = "i"
    for _ in range(8):
        bits = f"(select case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end from (select {bits} as x))"
    codes = "flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: case when unicode(c) < 128 then [unicode(c)::bigint] else [195::bigint, unicode(c)::bigint - 64] end))"
    return rf"""with recursive tab as (select list(c order by i) as t from (select i, {bits} as c from range(256) r(i))),
runs as (select doc_id, run, count(*) as n from (select doc_id, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) as run from documents) where length(run) >= {MIN_LENGTH} group by 1, 2),
hashed as (select *, xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) as h from runs, tab),
made as (select case when h % {TYPO_EVERY} = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from hashed),
words as (select word, sum(n)::bigint as n from made where length(word) >= {MIN_LENGTH} group by 1 having sum(n) >= {MIN_COUNT}),
cut as (select word, n, k, left(word, k::int - 1) as a, substr(word, k::int + 1) as b from (select word, n, unnest(range(1, length(word) + 1)) as k from words)),
near as (select x.word, y.word as near, y.n as near_n from cut x join cut y on x.k = y.k and x.a = y.a and x.b = y.b and x.word <> y.word
  union select x.word, y.word, y.n from cut x join words y on y.word = x.a || x.b union select y.word, x.word, x.n from cut x join words y on y.word = x.a || x.b),
best as (select word, count(*) as n_near, min_by(near, (-near_n, near)) as near, max(near_n) as near_n from near group by 1),
forms as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when near_n >= {LEADS} * w.n then near end as form, case when near_n >= {LEADS} * w.n then near_n end as form_n from words w left join best using (word)),
walk as (select word, word as here, 0 as step from words union all select w.word, f.form, step + 1 from walk w join forms f on f.word = w.here where f.form is not null)
select word, form, (select max_by(here, step) from walk k where k.word = f.word) as root, n, n_near, form_n from forms f"""
