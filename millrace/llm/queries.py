"""Queries of this subpackage over the test tables, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, classifier, cover_tree, license_scan, line_dedup, packing, periodic, quality, sharding, simhash, token_files, unigram, url_filter
from .common import load, new_path

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.pack_documents(load(spark, sf_dir, "documents"), BYTE_BPE)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, and what decoding gives back, as checksums."""
    encoded = unigram.encode(load(spark, sf_dir, "documents"), PIECES)
    return unigram.digests(unigram.decode(encoded, PIECES))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without later copies of runs of lines."""
    return line_dedup.dedup_lines(load(spark, sf_dir, "documents")).select("doc_id", "text", F.col("n_dropped").cast("long").alias("n_dropped"))


def op4_cover_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five rows with the highest inner product for every fiftieth vector."""
    vectors = cover_tree.integer_vectors(load(spark, sf_dir, "embeddings"))
    return cover_tree.top_k(vectors, F.col("vec_id") % 50 == 0)


def op5_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards by virtual slots."""
    return sharding.shard_documents(load(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of all documents."""
    return quality.judge(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op8_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the urls of all pages."""
    return url_filter.judge_urls(load(spark, sf_dir, "pages"), load(spark, sf_dir, "labels")).drop("mean")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written and read again."""
    path = new_path(spark, "tokens")
    token_files.write_token_files(load(spark, sf_dir, "documents"), path, BYTE_BPE)
    return token_files.with_crc32(token_files.read_tokens(spark, path))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses named in all documents."""
    return license_scan.scan_licenses(load(spark, sf_dir, "documents"))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated quality scores of all documents, learnt from the labels."""
    return classifier.score_quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' byte-level tokens against their pieces."""
    return alignment.align_tokenizers(load(spark, sf_dir, "documents"), BYTE_BPE, PIECES)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words in all documents, every tenth of which is made periodic."""
    return periodic.periodic_runs(load(spark, sf_dir, "documents"), plant=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_sentencepiece, op3_line_dedup, op4_cover_tree_search, op5_slot_sharding,
        op6_simhash, op7_quality_rules, op8_url_reputation, op9_token_files, op10_license_scan,
        op11_quality_classifier, op12_tokenizer_alignment, op13_periodic_runs,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": line_dedup.ORACLE_SQL,
    "op4_cover_tree_search": cover_tree.ORACLE_SQL,
    "op7_quality_rules": quality.ORACLE_SQL,
    "op8_url_reputation": url_filter.ORACLE_SQL,
    "op10_license_scan": license_scan.ORACLE_SQL,
}
