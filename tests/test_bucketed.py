"""Upserts into a catalog in buckets: right rows, and no shuffle of what is stored."""

from shopweave.operators import merge
from shopweave.sources import bucketed

KIND = "store_slug string, handle string, product_id string, price_min long, content_hash string, embedding array<float>"


def test_stored_buckets_are_not_shuffled(spark, tmp_path):
    row = lambda i, price: (f"s{i % 7}", f"h{i}", str(i), price, f"{i}-{price}", [1.0] if i % 2 else None)
    old = spark.createDataFrame([row(i, 10) for i in range(300)], KIND)
    new = spark.createDataFrame([row(i, 10 + (i % 3 == 0)) for i in range(200, 400)], KIND)
    bucketed.save(old, "catalog_of_test", str(tmp_path / "a"), 8)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged = bucketed.upserted(spark, "catalog_of_test", new)
        plan = merged._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and plan.count("FileScan parquet") == 2
        want = {tuple(map(str, r)) for r in merge.upsert_products(old, merge.changed_products(new, old)).collect()}
        again = bucketed.resaved(spark, "catalog_of_test", merged, str(tmp_path / "b"), 8)
        assert {tuple(map(str, r)) for r in again.collect()} == want and again.count() == 400
        twice = bucketed.upserted(spark, "catalog_of_test", new)
        assert twice._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        assert {tuple(map(str, r)) for r in twice.collect()} == want
        assert len(list((tmp_path / "b").glob("*.parquet"))) <= 8
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
        spark.sql("drop table catalog_of_test")
