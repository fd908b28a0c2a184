"""Token counts through a digest cache.

A text's count is stored under the digest of its normalised content and the digest of the
tokenizer's file. Only distinct contents that the cache lacks are encoded; their counts are
appended. Copies cost a digest, not an encoding, and a second run over the same corpus encodes
nothing.

Where the cache is: the query takes the folder that the Spark setting panelforge.token_cache
names, which lasts from run to run, and a new folder where that is unset.

Defined results: a null text counts as empty, with 0 bytes and 0 tokens; repeated rows are all
returned; very long texts are counted whole; an empty table gives an empty table and leaves the
cache as it was; other columns are ignored. If two runs append the same digest, the rows are
equal and one of them is used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from .bpe import default_path, is_word_bpe, loaded
from .common import SPACE, release, shared_dir, stored, table, text_or_empty

CACHE_SCHEMA = "digest string, tokenizer string, n_tokens long"
_OTHERS: dict = {}


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def normalised(text: Column, path: str) -> Column:
    """Content that decides the count: for a word vocabulary white space only separates."""
    return F.trim(F.regexp_replace(text, SPACE, " ")) if is_word_bpe(path) else text


def _count(path: str, texts: pd.Series) -> list[int]:
    if is_word_bpe(path):
        return [len(x) // 4 for x in loaded(path).encode(texts)]
    if path.endswith(".model"):
        import sentencepiece

        model = _OTHERS.setdefault(path, None) or sentencepiece.SentencePieceProcessor(model_file=path)
        _OTHERS[path] = model
        return list(map(len, model.encode(texts.tolist(), num_threads=1)))
    from tokenizers import Tokenizer

    model = _OTHERS.setdefault(path, None) or Tokenizer.from_file(path)
    _OTHERS[path] = model
    model.no_truncation()
    model.no_padding()
    return [len(x.ids) for x in model.encode_batch(texts.tolist(), add_special_tokens=False)]


def counter(path: str):
    @F.pandas_udf(T.LongType())
    def count_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(_count(path, texts), dtype="int64")
        release()

    return count_tokens


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    """Counts of this tokenizer, one row for each digest; None if there is no cache yet."""
    try:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return None
    return stored.where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(df: DataFrame, cache: str, text: str = "text", key: str = "doc_id", path: str | None = None) -> DataFrame:
    """key, n_bytes, n_tokens of every row; counts that cache (a Parquet folder) lacks are added to it."""
    spark, path = df.sparkSession, path or default_path()
    version = tokenizer_digest(path)
    content = df.select(F.col(key).alias("key"), text_or_empty(text).alias("content"))
    content = content.withColumn("plain", normalised(F.col("content"), path)).withColumn("digest", F.sha2(F.col("plain").cast("binary"), 256))
    rows = stored(content.select("key", F.octet_length("content").cast("long").alias("n_bytes"), "digest"))
    # Copies meet on the map side first, so a large group of copies sends one row from each task.
    distinct = content.groupBy("digest").agg(F.first("plain").alias("plain"))
    known = read_cache(spark, cache, version)
    missing = distinct if known is None else distinct.join(known, "digest", "left_anti")
    added = missing.select("digest", F.lit(version).alias("tokenizer"), counter(path)("plain").alias("n_tokens"))
    added.write.mode("append").parquet(cache)
    # Both sides are stored, so the join is of two plain shuffles and Spark can split a digest
    # that many rows have; of the cache only this table's counts are read.
    counts = stored(read_cache(spark, cache, version).join(rows.select("digest").distinct(), "digest", "left_semi"))
    return rows.join(counts, "digest").select(F.col("key").alias(key), "n_bytes", "n_tokens")


def query(spark: SparkSession, sf_dir: str, limit: int = 2048) -> DataFrame:
    """op7: tokens of every document."""
    counts = count_tokens(table(spark, sf_dir, "documents"), spark.conf.get("panelforge.token_cache", None) or shared_dir(spark))
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
