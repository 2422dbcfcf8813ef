"""Registered queries: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageframe.llm import ann, bpe, crf, epsilon, lines, manifest, packing, phrases, simhash, substrings, token_files, warc, weighted

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register a query under its own name."""
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicate_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(found["fp"]).alias("fingerprint"), "component_id")


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(table(spark, sf_dir, "documents"))


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.without_boilerplate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op7_line_dedup"] = lines.SQL


@query
def op10_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op9_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return crf.scored(docs, crf.fit_quality(docs, table(spark, sf_dir, "labels")))


@query
def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@query
def op5_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted.fingerprints(table(spark, sf_dir, "documents"))


@query
def op3_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return token_files.token_counts(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


@query
def op8_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    suspect = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return manifest.manifest(table(spark, sf_dir, "documents"), suspect=suspect)


ORACLES["op12_merkle_manifest"] = manifest.SQL


@query
def op13_epsilon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epsilon.near_embeddings(table(spark, sf_dir, "embeddings"))


ORACLES["op13_epsilon_grid"] = epsilon.SQL


@query
def op11_itemset_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


ORACLES["op11_itemset_phrases"] = phrases.SQL
