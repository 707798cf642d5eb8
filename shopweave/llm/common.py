"""Helpers that the text operators share: reading tables, cutting lineage, row keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.shared import forget, shared_dir, written  # noqa: F401 (for the operators)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text) and the columns to carry alone, a null text as the empty one: other columns can't clash."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), *carry)


def aside(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, row): id and text (null: empty) beside the whole row as a struct, so no column of docs can clash with an operator's own."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), F.struct("*").alias("row"))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A 64-bit key of a row: rows that repeat both id and text share it, null ids are ids, null texts empty ones."""
    return F.xxhash64(F.lit("row"), F.col(id_col).isNull(), F.coalesce(F.col(id_col), F.lit(0)), F.coalesce(F.col(text_col), F.lit("")))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def guarded(rows: DataFrame) -> DataFrame:
    """Null ids as 0 with a flag, so that pandas keeps the others as whole numbers."""
    return rows.withColumn("no_id", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")))


def restored(rows: DataFrame) -> DataFrame:
    """Undoes guarded()."""
    first = F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id")
    return rows.select(first, *[c for c in rows.columns if c not in ("doc_id", "no_id")])


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows, written, with `at`, their place in the given order from 0 over all rows, and `part`, the task that placed them.

    Rows are dealt by ranges of the order, so no task gets a group whole; each range is
    numbered by itself and moved by what stands before it. Rows equal in all of the
    order columns are told apart by their place in the input, so that ranges can cut them.
    """
    told = rows.withColumn("_tie", F.monotonically_increasing_id())
    sorted_ = told.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    placed = written(sorted_.withColumn("_id", F.monotonically_increasing_id()), "numbered").withColumn("part", F.shiftright("_id", 33))
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()  # one row for each task
    starts, before = [], 0
    for part, n in sorted(sizes):
        starts.append((part, before))
        before += n
    offsets = rows.sparkSession.createDataFrame(starts, "part long, _start long")
    row = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(offsets), "part").withColumn("at", F.col("_start") + row).drop("_id", "_start")


def grouped(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows with g, i and n: their group as a long (ascending as the group does, null first), place in it and its size.

    Each task's stretch of a group is looked up by itself, so a group that holds most rows gathers nowhere.
    """
    placed = numbered(rows, group, *order)
    runs = placed.groupBy("part", group).agg(F.min("at").alias("g"), F.count(F.lit(1)).alias("n"))
    whole = runs.groupBy(group).agg(F.min("g").alias("g"), F.sum("n").alias("n"))
    runs = runs.select("part", F.col(group).alias("_group")).join(whole.withColumnRenamed(group, "_whole"), F.col("_group").eqNullSafe(F.col("_whole")))
    runs = runs.select(F.col("part").alias("_part"), "_group", "g", "n")
    found = placed.join(runs, (F.col("part") == F.col("_part")) & F.col(group).eqNullSafe(F.col("_group")))
    return found.withColumn("i", F.col("at") - F.col("g")).drop("part", "at", "_part", "_group", group)
