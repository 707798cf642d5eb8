"""Surrogates held against the texts put out, and patterns on very long texts."""

import re

from pyspark.sql import functions as F

from shopweave.llm import pii_surrogates as PII

SCHEMA = "doc_id long, text string"
#: A separate, plainer reading of what is put out.
FOUND = {"email": re.compile(r"[\w.%+-]+@[\w.-]+\.[^\W\d_]{2,}"), "ssn": re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"), "phone": re.compile(r"(?<=tel )[+(]?\d[\d ().-]*\d"), "ip": re.compile(r"(?<=ip )[\d.]+\d"), "card": re.compile(r"(?<=card )[\d -]+\d")}


def plain(kind, x):
    if kind == "phone" and not x.startswith("+"):
        return ("phone", re.sub(r"\D", "", x).removeprefix("1") if len(re.sub(r"\D", "", x)) == 11 else re.sub(r"\D", "", x))
    if kind == "phone":
        return ("phone", re.sub(r"\D", "", x.removeprefix("+1")) if x.startswith("+1") else "+" + re.sub(r"\D", "", x))
    return (kind, re.sub(r"\D", "", x) if kind in ("card", "ssn") else x.lower())


def test_outputs_are_one_to_one(spark):
    """Over all entities put out: equal where the originals are equal, else different, and never one of the originals."""
    rows = []
    for i in range(400):
        rows.append(f"mail {'abcdefghijklmnopqrstuvwxyz'[i % 26]}@example.com or User{i % 90}@Mail{i % 7}.org, tel +44 20 7946 {i % 70:04d}, tel +442079460{i % 70:03d}, tel (415) 555-{i % 80:04d} then")
        rows.append(f"tel +353 87 1234{i % 60:03d}, tel +1 415-555-{i % 80:04d}, ip 10.0.{i % 5}.{i % 50}, card 4111 1111 1111 {i % 65:04d}, id {i % 90 + 100:03d}-12-{i % 75:04d} end")
    out = {r.doc_id: r.text for r in PII.pseudonymised(spark.createDataFrame(list(enumerate(rows)), SCHEMA), "k").collect()}
    mapped, real, made = {}, set(), set()
    for i, before in enumerate(rows):
        for kind, pattern in FOUND.items():
            old, new = pattern.findall(before), pattern.findall(out[i])
            assert len(old) == len(new), (kind, before, out[i])
            for x, y in zip(old, new, strict=True):
                x, y = plain(kind, x), plain(kind, y)
                assert mapped.setdefault(x, y) == y
                real.add(x)
                made.add(y)
    assert len(made) == len(mapped) and not made & real


def test_phones_of_all_countries(spark):
    numbers = {"+44 2079460958": "+44 ", "+353 871234567": "+353 ", "+7 9161234567": "+7 ", "+33 1 42 68 53 00": "+33 ", "+49 (0)30 123456": "+49 (", "+1 (415) 555-0100": "+1 ("}
    rows = [(i, f"call {x} now") for i, x in enumerate(numbers)]
    out = {r.doc_id: r.text for r in PII.pseudonymised(spark.createDataFrame(rows, SCHEMA), "k").collect()}
    for i, (number, code) in enumerate(numbers.items()):
        got = out[i].removeprefix("call ").removesuffix(" now")
        assert got != number and got.startswith(code) and re.sub(r"\d", "0", got) == re.sub(r"\d", "0", number)


def test_very_long_texts(spark):
    """A million characters that look like the start of each pattern; some hold a very long entity."""
    n, many = 1_000_000, 60_000  # rows that hold many entities are shorter
    rows = ["a@" + "b." * 20000 + "com", "a@" + "b." * (n // 2), "a." * (n // 2), "x" * n, "1" * n, "1-" * (n // 2), "A" + "a" * n, "10." * (n // 3), "(415) " * (n // 6), "@" * n, "a@b-" * (n // 4)]
    rows += ["+1 " * (many // 3), "Mr " * (many // 3), "John " * (many // 5), "1234 " * (many // 5)]
    found = {r.doc_id: (r.n, r.e) for r in PII.pseudonymised(spark.createDataFrame(list(enumerate(rows)), SCHEMA), "k").select("doc_id", F.length("text").alias("n"), F.col("n_entities").alias("e")).collect()}
    assert len(found) == len(rows)
    assert found[0] == (len(rows[0]), 1)  # the whole address
    assert all(found[i][0] >= 0.9 * len(x) for i, x in enumerate(rows))


def test_a_short_space_that_is_over_half_full(spark):
    """60,000 of the 100,000 numbers of one country with five digits: all get another number, no two the same one."""
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.format_string("call +354 %05d now", "id").alias("text"))
    found = PII.pseudonymised(docs, "k").join(docs.withColumnRenamed("text", "before"), "doc_id")
    row = found.agg(F.count_distinct("text").alias("n"), F.count_if(F.col("text") == F.col("before")).alias("same"), F.count_if(~F.col("text").rlike(r"^call \+354 [0-9]{5} now$")).alias("odd")).first()
    assert (row["n"], row["same"], row["odd"]) == (60_000, 0, 0)


def test_names_beyond_the_list(spark):
    rows = ["Priya Sharma met Wei Zhang at noon.", "Dear Chinwe Okafor,", "Author: Ludwig van der Berg", "Mr. Tomasz K. Nowak said so", "Hello World", "The Big House was cold", "We met Monday"]
    out = {r.doc_id: r.text for r in PII.pseudonymised(spark.createDataFrame(list(enumerate(rows)), SCHEMA), "k").collect()}
    for i, gone in enumerate([["Priya", "Sharma", "Wei", "Zhang"], ["Chinwe", "Okafor"], ["Ludwig", "Berg"], ["Tomasz", "Nowak"]]):
        assert not any(x in out[i] for x in gone), out[i]
    assert re.fullmatch(r"\w+ \w+ met \w+ \w+ at noon\.", out[0]) and re.fullmatch(r"Author: \w+ van der \w+", out[2]) and re.fullmatch(r"Mr\. \w+ K\. \w+ said so", out[3])
    assert [out[i] for i in (4, 5, 6)] == rows[4:]
