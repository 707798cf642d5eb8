"""A corpus clean-up in five stages; each one's result is written as Parquet and read by the next.

In every stage a null text counts as empty, further columns come along whatever their names, null and repeated ids
don't matter (each row is judged by itself, but for the groups of near copies), and an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from shopweave.llm import decontaminate, line_dedup, packing, quality_fm, simhash_bktree
from shopweave.llm.common import table, written
from shopweave.llm.queries import tokenizer_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (operator 5): a score of 0.5 or more. Empty texts have the score of their statistics; equal texts stay or go together."""
    return quality_fm.keep_good(docs, quality_fm.train(docs, table(spark, sf_dir, "labels")))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines kept elsewhere (operator 1); those of which no line is left go, n_chars follows the text.

    Of equal or linked lines that of the smallest id, row key and place stays. Empty and null texts stay as they are;
    rows that repeat id and text lose the same lines.
    """
    kept = line_dedup.drop_repeated_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest id, of each group of near copies (operator 8).

    Null ids come last, ties go by text; of rows that repeat everything one stays. Texts without a word are copies of each other.
    """
    return simhash_bktree.one_of_each(docs).select(docs.columns)


def without_tests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item (operator 10). Empty texts cover none; repeated rows stay or go together."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences (operator 9). An empty text is its end mark alone; repeated rows are packed each."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("line dedup", without_repeated_lines),
    ("simhash near-dedup", one_of_near_copies),
    ("benchmark decontamination", without_tests),
    ("packing", packed),
]

#: The classifier, the fuzzy links and the tokenizer have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents table, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
