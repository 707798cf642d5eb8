"""A stored index of vectors: inverted lists around centroids, searched in the nearest lists only, with exact distances there.

On disk an index is a folder with `items` (each vector with its list, in cells that a
search can leave unread), `lists` (how many vectors a list of a store has and in how
many slices they are cut), `centroids` and `probes`, how many lists a query should ask.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .search import vector_topk

#: Rows that the centroids are fitted on at most, the first by a hash of their ids; at most so many lists.
SAMPLE_ROWS, MOST_LISTS = 65_536, 1024
#: Vectors that an index is tried with when it is built, neighbours looked for, and the share of them that the lists asked by default must hold.
TRIED, TRIED_NEAR, FOUND = 200, 20, 0.95
#: Folders of `items`, and vectors that a slice of a list should have.
CELLS, SLICE_ROWS = 64, 4096


def _unit(rows: pd.Series) -> np.ndarray:
    v = np.array(rows.tolist(), np.float64)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def lists_for(n: int) -> int:
    """Lists for n vectors: half the square root, so that lists grow as slowly as their number."""
    return int(np.clip(round(n**0.5 / 2), 1, MOST_LISTS))


def build(items: DataFrame, path: str, lists: int | None = None, sample_rows: int = SAMPLE_ROWS) -> None:
    """Writes an index of items (store_slug, product_id, embedding); rows without an embedding are left out.

    Centroids are fitted on at most sample_rows vectors of length one; every row is then put
    on the list of the centroid nearest to it. Large lists are cut into slices by a hash.
    """
    spark = items.sparkSession
    rows = items.where("embedding is not null").select("store_slug", "product_id", "embedding")
    k = lists or lists_for(rows.count())
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    some = rows.where(norm > 0).orderBy(F.xxhash64("store_slug", "product_id")).limit(sample_rows)
    some = some.select(array_to_vector(F.transform("embedding", lambda x: x.cast("double") / norm)).alias("features"))
    centers = KMeans(k=k, seed=1, maxIter=10).fit(some).clusterCenters() if k > 1 and not some.isEmpty() else [np.zeros(1)]
    table = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centers)], "list int, center array<double>")
    table.write.mode("overwrite").parquet(f"{path}/centroids")

    def put(batches: Iterator[pd.DataFrame], centers=spark.sparkContext.broadcast(np.array(centers))) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["list"] = _nearest(_unit(b["embedding"]), centers.value, 1)[:, 0] if len(b) else np.empty(0, np.int64)
            yield b

    kind = dict(rows.dtypes)["embedding"]
    put_ = rows.mapInPandas(put, f"store_slug string, product_id string, embedding {kind}, list int")
    cell = F.pmod(F.xxhash64("store_slug", "list"), F.lit(CELLS)).cast("int")
    put_ = put_.withColumn("cell", cell)
    # a list's rows are dealt over several files if it is large, each sorted so that files tell which lists they hold
    dealt = put_.repartition(CELLS, "cell", F.pmod(F.xxhash64("product_id"), F.lit(4))).sortWithinPartitions("cell", "store_slug", "list")
    dealt.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/items")
    sizes = spark.read.parquet(f"{path}/items").groupBy("store_slug", "list").agg(F.count(F.lit(1)).alias("n"))
    sizes.withColumn("slices", F.ceil(F.col("n") / SLICE_ROWS).cast("int")).write.mode("overwrite").parquet(f"{path}/lists")
    asked = spark.createDataFrame([(_tried(spark, path),)], "n int")
    asked.write.mode("overwrite").parquet(f"{path}/probes")


def _tried(spark: SparkSession, path: str) -> int:
    """The fewest lists that hold FOUND of the exact neighbours of TRIED vectors, the first by another hash of their ids.

    Vectors in clusters need few lists, those without any order most of them.
    """
    items = spark.read.parquet(f"{path}/items")
    some = items.orderBy(F.xxhash64(F.lit("tried"), "store_slug", "product_id")).limit(TRIED)
    some = some.select(F.concat_ws("\u0001", "store_slug", "product_id").alias("query_id"), "store_slug", "embedding")
    near = vector_topk(items, some, TRIED_NEAR + 1).where(F.concat_ws("\u0001", "store_slug", "product_id") != F.col("query_id"))
    held = near.join(items.select("store_slug", "product_id", "list"), ["store_slug", "product_id"]).groupBy("query_id").agg(F.collect_list("list").alias("lists"))
    rows = held.join(some, "query_id").select("embedding", "lists").toPandas()  # at most TRIED
    if rows.empty:
        return 1
    centers = np.array(spark.read.parquet(f"{path}/centroids").orderBy("list").toPandas()["center"].tolist(), np.float64)
    order = _nearest(_unit(rows["embedding"]), centers, len(centers))
    places = np.concatenate([np.argsort(o)[np.asarray(own, np.int64)] for o, own in zip(order, rows["lists"], strict=True)]) if order.shape[1] > 1 else np.zeros(1)
    return int(np.quantile(places, FOUND, method="higher")) + 1


def _nearest(unit: np.ndarray, centers: np.ndarray, n: int) -> np.ndarray:
    """The n centroids nearest to each vector, the nearest first."""
    if centers.shape[1] != unit.shape[1]:  # nothing was fitted: one list
        return np.zeros((len(unit), 1), np.int64)
    away = (centers**2).sum(axis=1)[None, :] - 2 * unit @ centers.T
    return np.argsort(away, axis=1, kind="stable")[:, :n]


def probes(spark: SparkSession, path: str, queries: DataFrame, n_probe: int) -> DataFrame:
    """(query_id, store_slug, list, cell, embedding): each query beside the lists that it is held against."""
    centers = spark.read.parquet(f"{path}/centroids").orderBy("list").toPandas()["center"]  # at most MOST_LISTS rows
    sent = spark.sparkContext.broadcast(np.array(centers.tolist(), np.float64))
    kinds = dict(queries.dtypes)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            near = _nearest(_unit(b["embedding"]), sent.value, n_probe) if len(b) else np.empty((0, 1), np.int64)
            out = b.loc[b.index.repeat(near.shape[1])]
            yield out.assign(list=near.ravel())

    asked = queries.where("embedding is not null").select("query_id", "store_slug", "embedding")
    rows = asked.mapInPandas(ask, f"query_id {kinds['query_id']}, store_slug string, embedding {kinds['embedding']}, list int")
    return rows.withColumn("cell", F.pmod(F.xxhash64("store_slug", "list"), F.lit(CELLS)).cast("int"))


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, n_probe: int | None = None) -> DataFrame:
    """(query_id, store_slug, product_id, distance, rank): the k nearest by cosine distance, then id, among the n_probe nearest lists of the query's store (as many as the index was tried to need, if not told).

    Distances are exact; only vectors of lists that are not asked can be missed. Only the
    cells of asked lists are read, queries meet the slices of their lists by a
    shuffle, and each slice hands on its k best of each query.
    """
    asked = probes(spark, path, queries, n_probe or spark.read.parquet(f"{path}/probes").first()["n"])
    cells = [r["cell"] for r in asked.select("cell").distinct().collect()]  # at most CELLS
    slices = spark.read.parquet(f"{path}/lists").where("slices > 0").select("store_slug", "list", "slices")
    asked = asked.join(slices, ["store_slug", "list"])
    items = spark.read.parquet(f"{path}/items").where(F.col("cell").isin(cells))
    items = items.join(asked.select("store_slug", "list", "slices").distinct(), ["store_slug", "list"])
    items = items.withColumn("slice", F.pmod(F.xxhash64("product_id"), F.col("slices")).cast("int")).select("store_slug", "list", "slice", "product_id", "embedding")
    asked = asked.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select("store_slug", "list", "slice", "query_id", "embedding")
    key = ["store_slug", "list", "slice"]

    def near(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        out, ids = [], v["product_id"].to_numpy()
        unit = _unit(v["embedding"]) if len(v) else None
        for at in range(0, len(q) if len(v) else 0, 1024):
            some = q.iloc[at : at + 1024]
            d = np.round(1.0 - _unit(some["embedding"]) @ unit.T, 9)
            for name, store, row in zip(some["query_id"], some["store_slug"], d, strict=True):
                few = np.flatnonzero(row <= np.partition(row, k - 1)[k - 1]) if len(row) > k else np.arange(len(row))
                best = few[np.lexsort((ids[few], row[few]))[:k]]
                out.append(pd.DataFrame({"query_id": name, "store_slug": store, "product_id": ids[best], "distance": row[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": q["query_id"][:0], "store_slug": "", "product_id": "", "distance": 0.0}, index=[])

    kind = f"query_id {dict(queries.dtypes)['query_id']}, store_slug string, product_id string, distance double"
    found = asked.groupBy(*key).cogroup(items.groupBy(*key)).applyInPandas(near, kind)
    place = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "product_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)
