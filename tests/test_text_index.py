"""The stored index through builds, updates and compaction, against postings worked out anew."""

from pyspark.sql import functions as F

from shopweave.operators import search as S, text_index as TI

KIND = "store_slug string, product_id string, search_text string"
OLD = [("a", "1", "red wool hat"), ("a", "2", "blue hat"), ("b", "1", "red hat red shoe"), ("a", "3", "old news"), ("b", "4", None), ("b", "5", "")]
FIRST = [("a", "2", "red hat blue"), ("a", "3", None), ("a", "9", "hat of red wool")]
SECOND = [("a", "2", "green coat"), ("a", "3", "red hat again"), ("b", "1", "red hat")]


def asked(spark):
    return spark.createDataFrame([("q1", "a", "red hat"), ("q2", "a", '"red hat"'), ("q3", "b", "red -shoe"), ("q4", "a", "hat -wool")], "query_id string, store_slug string, text string")


def matches(spark, hits):
    return sorted(tuple(r) for r in S.fts_match(hits).collect())


def ranks(hits):
    return sorted(tuple(r) for r in S.fts_rank(hits, S.fts_match(hits)).collect())


def test_updates_equal_a_new_index(spark, tmp_path):
    path, queries = str(tmp_path / "i"), asked(spark)
    TI.build(spark.createDataFrame(OLD, KIND), path)
    live = {(s, p): t for s, p, t in OLD}
    for version, rows in enumerate([[], FIRST, SECOND]):
        if version:
            TI.update(spark.createDataFrame(rows, KIND), path, version)
            TI.update(spark.createDataFrame(rows, KIND), path, version)  # run again after a failure
            live |= {(s, p): t for s, p, t in rows}
        posts = S.postings(spark.createDataFrame([(s, p, t) for (s, p), t in live.items() if t is not None], KIND))
        found, want = TI.hits(spark, path, queries), S.fts_hits(posts, queries)
        assert matches(spark, found) == matches(spark, want) and ranks(found) == ranks(want)
    TI.compact(spark, path, str(tmp_path / "c"))
    again = TI.hits(spark, str(tmp_path / "c"), queries)
    assert ranks(again) == ranks(S.fts_hits(posts, queries))
    held = spark.read.parquet(f"{tmp_path}/c/postings")
    assert held.count() == posts.groupBy("store_slug", "term", "product_id").count().count()


def test_only_the_asked_buckets_are_read(spark, tmp_path):
    TI.build(spark.createDataFrame(OLD, KIND), str(tmp_path))
    terms = spark.createDataFrame([("a", "wool")], "store_slug string, term string")
    rows = TI.postings(spark, str(tmp_path), terms)
    assert [tuple(r) for r in rows.collect()] == [("a", "1", "wool", 1)]
    bucket = terms.select(TI.bucket_of(F.col("store_slug"), F.col("term"))).first()[0]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and f"= {bucket})]" in plan
