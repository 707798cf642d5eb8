"""Short email addresses at one host, more than have surrogates of their length."""

from string import ascii_lowercase as abc

from shopweave.llm import pii_surrogates as PII

SCHEMA = "doc_id long, text string"


def test_short_addresses_become_distinct(spark):
    locals_ = [*abc, *(a + b for a in abc for b in abc)]
    mails = [f"{x}@example.com" for x in locals_] + ["_@example.com", "_@example.org", "7@example.com", "B.C@example.com"]
    docs = spark.createDataFrame([(i, m) for i, m in enumerate(mails)] + [(5000, "A@example.com")], SCHEMA)
    found = {r.doc_id: r.text for r in PII.pseudonymised(docs, "k").collect()}
    assert len(found) == len(mails) + 1
    assert len({found[i] for i in range(len(mails))}) == len(mails)
    assert not {found[i].lower() for i in range(len(mails))} & {m.lower() for m in mails}
    assert found[5000] != found[0] and found[5000].lower() == found[0].lower()
