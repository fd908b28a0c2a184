"""Exact de-duplication with a heavy-hitter split.

Digests of the normalised texts are stored once. Misra-Gries summaries of all partitions name
the candidates for frequent digests; exact counts verify them. The verified winners, at most
`counters` rows, are broadcast, so their copies are settled on the map side and no task gathers
a large group. All other digests meet in an ordinary shuffle. What the summaries miss is thus
only slower, never wrong.

Defined results: a null text counts as empty; of equal texts the row with the smallest doc_id
stays, and if several rows have that id one of them; a null id is larger than any other; all
rows are returned, each with the group's keep_id; very long texts travel as digests only; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, stored, table, text_or_empty


def with_digest(df: DataFrame, text: str = "text", digest: str = "text_sha256") -> DataFrame:
    """Adds the SHA-256 of the text with each run of white space as one space."""
    return df.withColumn(digest, F.sha2(F.regexp_replace(text_or_empty(text), SPACE, " ").cast("binary"), 256))


def _summaries(counters: int):
    """Misra-Gries over the digests of one partition: every digest with more than 1/(counters+1)
    of the rows is among the counters that remain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: Counter[str] = Counter()
        for batch in batches:
            kept.update(batch.column(0).to_pylist())
            if len(kept) > counters:
                # as often as needed, one is taken from counters + 1 different digests
                cut = sorted(kept.values(), reverse=True)[counters]
                kept = Counter({k: v - cut for k, v in kept.items() if v > cut})
        yield pa.RecordBatch.from_pydict({"digest": pa.array(list(kept), pa.string()), "seen": pa.array(list(kept.values()), pa.int64())})

    return run


def frequent(digests: DataFrame, digest: str, counters: int) -> DataFrame:
    """At most `counters` candidate digests, the most frequent by the merged summaries."""
    parts = digests.select(digest).mapInArrow(_summaries(counters), "digest string, seen long")
    merged = parts.groupBy("digest").agg(F.sum("seen").alias("seen"))
    return merged.orderBy(F.desc("seen"), "digest").limit(counters).select(F.col("digest").alias(digest))


def groups(digests: DataFrame, digest: str, order: str, counters: int = 1000, least: int = 100) -> DataFrame:
    """Adds keep_id (smallest order value of the digest), keep_row (row of such a row) and
    group_size to each row.

    digests: a stored table with a number for each row in column row, as it is read several times. counters: Misra-Gries counters, also
    the bound of what is broadcast. least: rows from which a candidate is a verified winner.
    """
    found = [F.min(order).alias("keep_id"), F.coalesce(F.min_by("row", order), F.min("row")).alias("keep_row"), F.count(F.lit(1)).alias("group_size")]
    candidates = F.broadcast(frequent(digests, digest, counters))
    winners = stored(digests.join(candidates, digest, "left_semi").groupBy(digest).agg(*found).where(F.col("group_size") >= least))
    marked = digests.join(F.broadcast(winners), digest, "left")
    heavy = marked.where(F.col("keep_row").isNotNull())
    rest = marked.where(F.col("keep_row").isNull()).drop("keep_id", "keep_row", "group_size")
    light = rest.join(rest.groupBy(digest).agg(*found), digest)
    return heavy.unionByName(light)


def deduplicate(df: DataFrame, text: str = "text", order: str = "doc_id", counters: int = 1000, least: int = 100) -> DataFrame:
    """One row per row of df: its order value, keep_id, group_size, kept, text_sha256."""
    digests = stored(with_digest(df.select(F.col(order).alias("order"), F.col(text).alias("text"))).select("order", F.monotonically_increasing_id().alias("row"), "text_sha256"))
    out = groups(digests, "text_sha256", "order", counters, least)
    return out.select(F.col("order").alias(order), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: exact groups of all documents."""
    return deduplicate(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
