"""Corpus pipeline over `documents`: quality, line dedup, near-dedup, substring dedup, packing.

Every stage takes (spark, docs, sf_dir). Its result is written to the shared folder
as Parquet and read again as the next stage's docs. All stages but the last return
the columns of `documents`; n_chars follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageframe.llm import crf, lines, packing, simhash, substrings
from pageframe.llm.store import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_text(found: DataFrame) -> DataFrame:
    """Documents with the text that is kept. One of which nothing is kept goes, unless it was blank before."""
    changed = found.withColumn("n_chars", F.length("kept").cast("long"))
    stay = changed.where("trim(BOTH ' \n\t\r' FROM kept) <> '' OR untouched")
    return stay.select("doc_id", F.col("kept").alias("text"), "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the line classifier, fitted on `labels`, predicts to be good."""
    model = crf.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return crf.scored(docs, model, keep=tuple(COLUMNS)).where("predicted = 1").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that ten sites or more share, but for the document in which each comes first."""
    found = lines.without_boilerplate(docs, carry=("lang", "source"))
    return _with_text(found.withColumn("untouched", F.col("n_removed") == 0))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each class of near copies by SimHash, of equal rows one. Rows without doc_id stay.

    Texts that share a doc_id are documents of their own: unlike ones stay.
    """
    classes = simhash.text_classes(docs).where("doc_id IS NOT NULL")
    kept = classes.groupBy("class").agg(F.min(F.struct("doc_id", "tag")).alias("first")).select("first.*")
    named = docs.withColumn("tag", simhash.text_tag()).join(kept, ["doc_id", "tag"], "left_semi").dropDuplicates(["doc_id", "tag"])
    return named.select(*COLUMNS).unionByName(docs.where("doc_id IS NULL").select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop every byte of a 200-byte string that starts at more than one place, but no part of a character."""
    found = substrings.without_repeats(docs, keep_text=True, carry=("lang", "source"))
    return _with_text(found.withColumn("untouched", F.col("n_removed") == 0))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of at most 4096 tokens."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", substring_dedup),
    ("best-fit packing", packing_stage),
]

#: Fingerprints, a fitted classifier and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
