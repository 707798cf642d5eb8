"""Licence scan: canonical digests of whole texts and whole lines, joined to known ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .common import texts
from .license_texts import DIGESTS, KNOWN, SPELLINGS

#: Patterns that Java and RE2 read alike. A copyright line names a year, a holder in brackets or the sign.
COPYRIGHT = r"(^|\n)[^\p{L}\p{N}\n]*(copyright[ \t]*(\(c\)|©|[0-9<\[])|\(c\)[ \t]*(copyright|[0-9])|©|all rights reserved)[^\n]*"
NOT_WORD = r"[^\p{L}\p{N}]+"
PAIRS = [tuple(x.split()) for x in SPELLINGS.split("\n") if x]


def spelt(text: Column) -> Column:
    """One spelling for equivalent words of a text whose words single spaces part, with a space at both ends."""
    for other, usual in PAIRS:
        text = F.replace(text, F.lit(f" {other} "), F.lit(f" {usual} "))
    return text


def plain(text: Column) -> Column:
    """Lower case, without copyright lines, signs as single spaces, a space at both ends."""
    text = F.regexp_replace(F.lower(text), COPYRIGHT, "$1")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(text, NOT_WORD, " ")), F.lit(" "))


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the canonical text."""
    return F.sha2(spelt(plain(text)), 256)


def licenses(docs: DataFrame, known: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line, license_id, digest) for each whole text (line 0) and each whole line (from 1) that is a known one.

    known: (licence, text); without it the listed texts and the listed digests of long
    licences. The digests, a fixed small list, are broadcast. Only texts of
    known first words are spelt out and hashed, which loses none: equal digests have
    equal first words. Null texts count as empty; texts without a word never match;
    a text of one line gives line 0 and line 1; repeated rows match each; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    listed = spark.createDataFrame([(i, t, t.strip()) for i, t in (known or KNOWN)], "license_id string, text string, key string")
    listed = listed.select("license_id", digest(F.col("text")).alias("digest"), first_words(plain(F.col("text"))).alias("start"))
    if not known:
        listed = listed.unionByName(spark.createDataFrame([(i, d, f" {s} ") for i, s, d in DIGESTS], "license_id string, digest string, start string"))
    listed = listed.where("trim(start) <> ''").dropDuplicates(["digest", "license_id"])  # what has no word matches nothing
    rows = texts(docs, id_col, text_col)
    lines = rows.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    units = rows.select("doc_id", F.lit(0).alias("line"), "text").unionByName(lines.withColumn("line", F.col("line") + 1))
    units = units.select("doc_id", "line", plain(F.col("text")).alias("plain"))
    starts = F.broadcast(listed.select("start").distinct())  # no more than the known texts
    units = units.withColumn("start", first_words(F.col("plain"))).join(starts, "start", "left_semi")
    units = units.select("doc_id", "line", F.sha2(spelt(F.col("plain")), 256).alias("digest"))
    return units.join(F.broadcast(listed.select("license_id", "digest")), "digest").select("doc_id", "line", "license_id", "digest")


def first_words(text: Column, n: int = 2) -> Column:
    """The first words of a plain text, spelt alike."""
    return spelt(F.concat(F.substring_index(text, " ", n + 1), F.lit(" ")))


def oracle(quote: Callable[[str], str] = lambda s: "'" + s.replace("'", "''") + "'") -> str:
    """The same in DuckDB's SQL, on the table documents."""
    spell = "concat(' ', trim(regexp_replace(regexp_replace(lower(t), {c}, '\\1', 'g'), {w}, ' ', 'g')), ' ')".format(c=quote(COPYRIGHT), w=quote(NOT_WORD))
    for other, usual in PAIRS:
        spell = f"replace({spell}, {quote(f' {other} ')}, {quote(f' {usual} ')})"
    known = ", ".join(f"({quote(i)}, {quote(t)})" for i, t in KNOWN)
    digests = ", ".join(f"({quote(i)}, {quote(d)})" for i, _, d in DIGESTS)
    return f"""
with known as (select distinct license_id, sha256({spell}) as digest from (values {known}) k(license_id, t) union select * from (values {digests}) d(license_id, digest)),
units as (
  select doc_id, 0 as line, coalesce(text, '') as t from documents
  union all
  select doc_id, generate_subscripts(l, 1)::int as line, unnest(l) as t from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents)),
spelt as (select doc_id, line, {spell} as s from units)
select doc_id, line, license_id, digest from (select doc_id, line, sha256(s) as digest from spelt where trim(s) <> '') join known using (digest)
"""
