"""Corpus preparation in five stages, each one of the training-data operators.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's
result as Parquet in the cluster's shared folder and hands the reread table to the next. All
stages but the last return the columns of documents.

Defined results, by stage: language_id rejects null, blank and letterless texts (no evidence) and
text in no language; line_dedup keeps a line of many sources in the smallest id, a null id is the
largest, and documents that only had such lines go; near_duplicates keeps one row of the smallest id
of each class, and of rows without an id one for each text; mixing gives rows with one id the same
number of copies, a null source is a source; bpe_encoding gives blank texts no ids. Ties go to the
smallest id, or language first in order. Very long texts are whole in every stage, an empty table
stays empty, and other columns are carried along, whatever their names, up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import bpe, language_id, line_dedup, mixing, ngram_join
from panelforge.llm.common import free_name, prepare, shared_dir, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; the text models come from all labelled documents."""
    prepare(spark)
    found = language_id.identify(docs, language_id.fit(docs), host="source", declared=language_id.declared_in("text"))
    return found.where(F.col(free_name(docs, "lang_kept"))).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the boilerplate lines of many sources; n_chars follows the text."""
    cleaned = line_dedup.deduplicate(docs).where(F.col(free_name(docs, "kept")))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(F.col(free_name(docs, "n_removed")) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cleaned.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near copies; of rows that repeat it, one stays."""
    prepare(spark)
    first = ngram_join.join(docs).where(F.col("kept")).select("doc_id").distinct()
    # The rows of an id are in one partition after the join, so dropping repeats needs no shuffle.
    kept = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    nameless = docs.where(F.col("doc_id").isNull()).dropDuplicates(["text"])
    return kept.select(docs.columns).unionByName(nameless)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in equal shares: each document as often as drawn."""
    return mixing.mix(docs).select(docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and the digest of the text they decode to."""
    prepare(spark)
    both = bpe.encode(docs.select("doc_id", "source", "text"), decoded="decoded")
    return both.select("doc_id", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("language_id", language), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("mixing", mixture), ("bpe_encoding", encoding)]

#: Language models, MinHash classes and token ids have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = shared_dir(spark)
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return docs
