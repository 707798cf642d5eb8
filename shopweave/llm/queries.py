"""The registered queries of the text operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, interpolation_lm, license_scan, line_dedup, merkle, packing, pii_surrogates, quality_fm, secret_scan, simhash_bktree, spelling, suffix_dedup
from . import fingerprints as minhash
from .common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_surrogates.pseudonymised(table(spark, sf_dir, "documents"), key="corpus")


def op5_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_fm.score(docs, quality_fm.train(docs, table(spark, sf_dir, "labels")))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprints(table(spark, sf_dir, "documents"))


def op7_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation_lm.interpolated(table(spark, sf_dir, "documents"))


def op8_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_bktree.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.grouped(table(spark, sf_dir, "documents"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_secret_scan": op3_secret_scan,
    "op4_pii_surrogates": op4_pii_surrogates,
    "op5_quality_fm": op5_quality_fm,
    "op6_fingerprints": op6_fingerprints,
    "op7_deleted_interpolation": op7_deleted_interpolation,
    "op8_simhash_bktree": op8_simhash_bktree,
    "op9_packing": op9_packing,
    "op10_string_tiling": op10_string_tiling,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_suffix_dedup": op13_suffix_dedup,
}

ORACLES: dict[str, str] = {"op2_license_scan": license_scan.oracle(), "op11_merkle_manifest": merkle.oracle(), "op12_spelling_variants": spelling.oracle()}
