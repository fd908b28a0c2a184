"""Quality rules: hashed n-gram log-likelihood ratio of trusted target against raw corpus.

Words and word pairs are hashed into a fixed number of bins. Two multinomials are counted over
all documents: the raw corpus, and the trusted target (documents whose label says good quality
and not toxic). A document's score is the mean log ratio of its features; it stays if the score
reaches the threshold. The target's multinomial is smoothed towards the raw one, so a feature
without evidence says little.

The trusted target is a bounded sample of labelled rows (max_trusted, smallest hash first); its
ids are the only thing broadcast besides the bins. Counts of the raw corpus use every row.

Defined results: a null text has no words; a text without features scores 0; base_failed
documents are never kept; repeated rows are all returned; empty tables give an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty

BINS = 1 << 16
SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\r\x0b\x0c"
_BLOCK_WORDS = 300_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def _blocks(texts: list[str]) -> Iterator[tuple[int, list[bytes], list[list[bytes]]]]:
    """First row, texts and their words, a bounded number of words at a time."""
    at, raw, words, held = 0, [], [], 0
    for k, text in enumerate(texts):
        b = (text or "").encode()
        raw.append(b)
        words.append(b.split())  # ASCII white space: U+0009 to U+000D and space
        held += len(words[-1])
        if held > _BLOCK_WORDS:
            yield at, raw, words
            at, raw, words, held = k + 1, [], [], 0
    if raw:
        yield at, raw, words


def _features(words: list[list[bytes]], bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and document of each word and each pair of neighbours."""
    counts = np.fromiter(map(len, words), np.int64, len(words))
    doc = np.repeat(np.arange(len(words)), counts)
    h = np.fromiter(map(crc32, chain.from_iterable(words)), np.uint64, int(counts.sum()))
    one = _mixed(h + np.uint64(1))
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    two = _mixed(one[pair] * np.uint64(3) + one[pair + 1])
    bin_of = np.concatenate([one, two]) >> np.uint64(20)
    return (bin_of % np.uint64(bins)).astype(np.int64), np.concatenate([doc, doc[pair]])


def _repeated(words: list[list[bytes]], n: int) -> np.ndarray:
    """For each text, its words in n-word windows that occur twice or more in it."""
    counts = np.fromiter(map(len, words), np.int64, len(words))
    total = int(counts.sum())
    doc = np.repeat(np.arange(len(words)), counts)
    if total < n:
        return np.zeros(len(words), np.int64)
    h = _mixed(np.fromiter(map(hash, chain.from_iterable(words)), np.int64, total).view(np.uint64))
    starts = np.flatnonzero(doc[: total - n + 1] == doc[n - 1 :])
    key = doc[starts].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(n):
        key = _mixed(key + h[starts + k])
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(starts), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, starts[twice], 1)
    np.add.at(edge, starts[twice] + n, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(doc[covered], minlength=len(words)).astype(np.int64)


def _dup_lines(raw: bytes) -> int:
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def _counting(bins: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw_counts, good_counts = np.zeros(bins, np.int64), np.zeros(bins, np.int64)
        for batch in batches:
            good = np.array(batch.column(1).to_pylist(), bool)
            for at, raw, words in _blocks(batch.column(0).to_pylist()):
                bin_of, doc = _features(words, bins)
                raw_counts += np.bincount(bin_of, minlength=bins)
                good_counts += np.bincount(bin_of[good[at : at + len(raw)][doc]], minlength=bins)
        seen = np.flatnonzero(raw_counts)
        yield pa.RecordBatch.from_pydict({"bin": pa.array(seen, pa.int32()), "n_raw": pa.array(raw_counts[seen]), "n_good": pa.array(good_counts[seen])})

    return run


def log_ratios(docs: DataFrame, trusted: DataFrame, text: str, key: str, bins: int, prior: float) -> np.ndarray:
    """log p(bin | trusted) - log p(bin | raw), for each bin."""
    flagged = docs.select(F.col(key), text_or_empty(text).alias("text")).join(F.broadcast(trusted.withColumn("good", F.lit(True))), key, "left")
    parts = flagged.select("text", F.coalesce("good", F.lit(False)).alias("good")).mapInArrow(_counting(bins), "bin int, n_raw long, n_good long")
    sums = parts.groupBy("bin").agg(F.sum("n_raw").alias("n_raw"), F.sum("n_good").alias("n_good")).toArrow().to_pandas()  # one row for each bin
    raw, good = np.zeros(bins), np.zeros(bins)
    raw[sums["bin"]], good[sums["bin"]] = sums["n_raw"], sums["n_good"]
    p_raw = (raw + 0.5) / (raw.sum() + 0.5 * bins)
    p_good = (good + prior * p_raw) / (good.sum() + prior)
    return np.log(p_good / p_raw).astype(np.float32)


def _rules(ratios: np.ndarray, threshold: float, bins: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, raw, words in _blocks(batch.column(1).to_pylist()):
                bin_of, doc = _features(words, bins)
                n_words = np.fromiter(map(len, words), np.int64, len(words))
                n = np.bincount(doc, minlength=len(raw))
                score = np.bincount(doc, ratios[bin_of].astype(np.float64), len(raw)) / np.maximum(n, 1)
                n_repeat = _repeated(words, 5)
                failed = (n_words < 10) | (100 * n_repeat > 20 * n_words)
                # a code point begins at each byte that isn't a continuation
                chars = [len(b.translate(None, SPACES).decode()) for b in raw]
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": batch.column(0).slice(at, len(raw)),
                        "n_words": pa.array(n_words),
                        "word_chars": pa.array(chars, pa.int64()),
                        "n_symbols": pa.array([len(b) - len(b.translate(None, SYMBOLS)) for b in raw], pa.int64()),
                        "n_dup_lines": pa.array([_dup_lines(b) for b in raw], pa.int64()),
                        "n_repeat_words": pa.array(n_repeat),
                        "base_failed": pa.array(failed),
                        "kept": pa.array(~failed & (score >= threshold)),
                        "score": pa.array(score),
                    }
                )

    return run


def rate(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", max_trusted: int = 20_000, threshold: float = -0.13, bins: int = BINS, prior: float = 4.0 * BINS) -> DataFrame:
    """Base counts, score and verdict of every document. labels: key, quality (1 good), toxic (1 toxic)."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).select(key).distinct()
    trusted = good.orderBy(F.xxhash64(key), key).limit(max_trusted)
    ratios = log_ratios(docs, trusted, text, key, bins, prior)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"
    rated = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text")).mapInArrow(_rules(ratios, threshold, bins), schema)
    return rated.withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: all documents, with the good and not toxic labels as trusted target."""
    return rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
