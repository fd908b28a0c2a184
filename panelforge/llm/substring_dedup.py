"""Removal of passages that an earlier document has, by windows of words in super-k-mers.

A window is a fixed number of consecutive words. Its minimiser is the smallest hash of the
m-grams in it, and consecutive windows that share a minimiser travel as one packed string (their
words, each once) to the minimiser's bucket. All windows with the same words have the same
minimiser, so a bucket sees each of its windows whole: it sorts them by their words and finds the
smallest key of each. Words that a window covers whose words also start in a document with a
smaller key go.

Three passes over the texts:

* Counts: windows and packed strings of each minimiser are summed up. From the sums two tables of
  bits are made, of a fixed size: minimisers that are there more than once, and minimisers of so
  many windows that they would make a bucket too large for one task.
* Strings: a string whose minimiser is there once can't repeat anything and stays at home. Strings
  of large buckets are dealt by all their words instead of their minimiser: an aggregation with
  map-side sums leaves each different string once, with its least key, and rows of larger keys lose
  the whole string. Only different strings are cut into windows, which are dealt by their own words,
  and what they lose goes to the rows of their least key. All other strings go to their buckets. Bits
  that several minimisers share only send more than needed, or in another way, with the same result.
* Texts are joined with the stretches to be removed.

Defined results: a null, empty or blank text has no words, and a text shorter than a window loses
none; windows are judged on the input, not on what is left; a window repeated within one document
stays; rows with one key are one document, and each loses what earlier keys have, judged by its own
text; a null key is larger than any other, and null keys are no copies of each other; keys are whole
numbers; a very long text is cut in blocks of its own; an empty table gives an empty table; other
columns are carried along, and added columns get a leading underscore if the table has their name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, release, stored, table, text_or_empty
from .words import blocks, numbered, ordered, packed, spans

WINDOW, GRAM = 13, 5
#: Bits of the two tables (16 MB each), and windows from which a bucket is a large one.
BITS, LARGE = 27, 100_000
_BLOCK, _NULL = 1 << 19, (1 << 63) - 1
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _scrambled(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[:-step], values[step:])
        done += step
    return values


def strings(words: list[bytes], ends: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, text, first word and number of windows of the super-k-mers of several texts."""
    none = np.zeros(0, np.int64)
    if len(words) < window:
        return none.astype(np.uint64), none, none, none
    ids, distinct = numbered(words)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))[ids]
    grams = hashes[: len(hashes) - gram + 1]
    for t in range(1, gram):
        grams = grams * _MIX + hashes[t : len(hashes) - gram + 1 + t]
    least = _least(_scrambled(grams), window - gram + 1)
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[: len(least)]
    inside = np.flatnonzero(np.arange(window, window + len(least)) <= ends[text + 1])
    least, text = least[inside], text[inside]
    new = np.ones(len(inside), bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return least[first], text[first], inside[first], np.diff(np.append(first, len(inside)))


def _counts(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, words, ends in blocks(batch.column(0).cast(pa.binary()).to_pylist(), _BLOCK):
                least, _, _, windows = strings(words, ends, window, gram)
                order, new = ordered([least.view(np.int64)])
                first = np.flatnonzero(new)
                if len(first):
                    n = np.diff(np.append(first, len(order)))
                    yield pa.RecordBatch.from_pydict({"bucket": least[order[first]].view(np.int64), "strings": n, "windows": np.add.reduceat(windows[order], first)})
        release()

    return run


def shared(docs: DataFrame, window: int, gram: int, bits: int, large: int) -> tuple[bytes, bytes]:
    """Bits of the minimisers of several strings, and of those with over `large` windows. What comes
    to the driver is 2**bits / 64 rows at most."""
    sums = docs.select("text").mapInArrow(_counts(window, gram), "bucket long, strings long, windows long").groupBy("bucket").agg(F.sum("strings").alias("strings"), F.sum("windows").alias("windows"))
    place = F.shiftrightunsigned("bucket", 64 - bits)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    rows = sums.where(F.col("strings") > 1).groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(bit).alias("some"), F.bit_or(F.when(F.col("windows") > large, bit)).alias("many")).toArrow()
    tables = []
    for name in ("some", "many"):
        table_ = np.zeros(max(1, (1 << bits) // 64), np.int64)
        table_[rows["at"].to_numpy()] = rows[name].fill_null(0).to_numpy()
        tables.append(table_.tobytes())
    return tables[0], tables[1]


def _has(bits: np.ndarray, least: np.ndarray, n_bits: int) -> np.ndarray:
    place = least >> np.uint64(64 - n_bits)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0


def _sent(window: int, gram: int, n_bits: int, some, many, from_large: bool):
    """A row for each string that may repeat something, of large buckets or of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, hot = np.frombuffer(some.value, np.uint64), np.frombuffer(many.value, np.uint64)
        for batch in batches:
            keys, hashes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "hash"))
            for top, _, words, ends in blocks(batch.column("text").cast(pa.binary()).to_pylist(), _BLOCK):
                least, text, first, windows = strings(words, ends, window, gram)
                may = np.flatnonzero(_has(hot, least, n_bits) if from_large else _has(often, least, n_bits) & ~_has(hot, least, n_bits))
                least, text, first, windows = least[may], text[may], first[may], windows[may]
                start, end = first, first + window - 1 + windows
                for a in range(0, len(start), 20_000):
                    b = min(len(start), a + 20_000)
                    row = text[a:b]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "bucket": least[a:b].view(np.int64), "key": keys[top + row], "hash": hashes[top + row], "at": (start[a:b] - ends[row]).astype(np.int32),
                            "words": pa.array([b" ".join(words[p:q]) for p, q in zip(start[a:b].tolist(), end[a:b].tolist())], pa.binary()),
                        }
                    )
        release()

    return run


def _repeats(keys: np.ndarray, packs: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin and end of the stretches of words that a window covers which a smaller key has too."""
    first, _, words, ends = next(blocks(packs, 1 << 62))
    ids, distinct = numbered(words)
    row = np.repeat(np.arange(len(packs)), np.diff(ends))
    at = np.flatnonzero(np.arange(window, window + len(ids)) <= ends[row + 1])
    order, new = ordered(packed([ids[at + t] for t in range(window)], len(distinct)))
    group = np.flatnonzero(new)
    key = keys[row[at]]
    earliest = np.empty(len(at), np.int64)
    earliest[order] = np.repeat(np.minimum.reduceat(key[order], group), np.diff(np.append(group, len(at))))
    gone = at[earliest < key]
    # a gap after each row keeps the stretches of neighbours apart
    shift = np.arange(len(packs))
    change = np.zeros(len(ids) + len(packs) + 1, np.int64)
    np.add.at(change, gone + shift[row[gone]], 1)
    np.add.at(change, gone + shift[row[gone]] + window, -1)
    begin, end = spans(np.cumsum(change) > 0)
    of = np.searchsorted(ends[:-1] + shift, begin, "right") - 1
    base = ends[of] + shift[of]
    return of, begin - base, end - base


def _sorting(window: int, at_once: int):
    """Stretches to be removed, from rows in the order of their buckets, some buckets at a time."""

    def done(part: pa.Table) -> pa.RecordBatch:
        of, begin, end = _repeats(part["key"].to_numpy(), part["words"].to_pylist(), window)
        at = part["at"].to_numpy()[of]
        return pa.RecordBatch.from_pydict({"key": part["key"].to_numpy()[of], "hash": part["hash"].to_numpy()[of], "begin": (at + begin).astype(np.int32), "end": (at + end).astype(np.int32)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= at_once:
                rows = pa.Table.from_batches(held)
                bucket = rows["bucket"].to_numpy()
                cut = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on
                if cut:
                    yield done(rows.slice(0, cut))
                rest = rows.slice(cut).combine_chunks()
                held, size = rest.to_batches(), rest.nbytes
        rows = pa.Table.from_batches(held) if held else None
        if rows is not None and rows.num_rows:
            yield done(rows)
        release()

    return run


def _windows(window: int):
    """The windows of each string, with its words and least key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, batch.num_rows, 100):
                part = batch.slice(row, 100)
                packs, split = part["words"].to_pylist(), [p.split(b" ") for p in part["words"].to_pylist()]
                n = np.array([len(w) - window + 1 for w in split])
                of = np.repeat(np.arange(len(n)), n)
                cut = [b" ".join(w[k : k + window]) for w in split for k in range(len(w) - window + 1)]
                offset = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_pydict({"words": pa.array([packs[k] for k in of], pa.binary()), "key": part["earliest"].to_numpy()[of], "offset": offset.astype(np.int32), "win": pa.array(cut, pa.binary())})

    return run


def stretches(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bits: int = BITS, large: int = LARGE) -> DataFrame:
    """key, hash, begin and end (word numbers) of what goes from each text. docs: key, hash, text."""
    spark = docs.sparkSession
    tables = shared(docs, window, gram, bits, large)
    some, many = map(spark.sparkContext.broadcast, tables)
    schema = "bucket long, key long, hash long, at int, words binary"
    # Strings are made for their shuffle alone; only windows of large buckets are used twice, and stored.
    here = docs.mapInArrow(_sent(window, gram, bits, some, many, False), schema).repartition("bucket").sortWithinPartitions("bucket")
    found = here.mapInArrow(_sorting(window, 16 << 20), "key long, hash long, begin int, end int")
    if not np.frombuffer(tables[1], np.int64).any():
        return found
    # Tables that are joined are stored, so that a frequent string or window is split among tasks.
    one = stored(docs.mapInArrow(_sent(window, gram, bits, some, many, True), schema).drop("bucket"))
    apart = stored(one.groupBy("words").agg(F.min("key").alias("earliest")))
    copies = one.join(apart, "words").where(F.col("earliest") < F.col("key"))
    copies = copies.select("key", "hash", F.col("at").alias("begin"), (F.col("at") + F.size(F.split(F.col("words").cast("string"), " "))).alias("end"))
    each = stored(apart.mapInArrow(_windows(window), "words binary, key long, offset int, win binary"))
    known = stored(each.groupBy("win").agg(F.min("key").alias("first"), F.max("key").alias("last")).where(F.col("first") < F.col("last")).drop("last"))
    later = each.join(known, "win").where(F.col("first") < F.col("key")).select("words", "key", "offset")
    parts = one.join(later, ["words", "key"]).select("key", "hash", (F.col("at") + F.col("offset")).alias("begin"), (F.col("at") + F.col("offset") + window).alias("end"))
    return found.unionByName(copies).unionByName(parts)


def _cutting(text: str, cut: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, cuts = batch.column(text).cast(pa.binary()).to_pylist(), batch.column(cut).to_pylist()
            n_words, n_removed, left = [], [], []
            for body, gone in zip(texts, cuts):
                words = body.split() if body else []
                n_words.append(len(words))
                if gone:
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, [g["begin"] for g in gone], 1)
                    np.add.at(change, [g["end"] for g in gone], -1)
                    begin, end = spans(np.cumsum(change)[:-1] == 0)
                    words = [w for a, b in zip(begin.tolist(), end.tolist()) for w in words[a:b]]
                n_removed.append(n_words[-1] - len(words))
                left.append(b" ".join(words))
            kept = [batch.column(k) for k in range(batch.num_columns) if batch.schema.names[k] != cut]
            names = [n for n in batch.schema.names if n != cut]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(left, pa.binary()).cast(pa.string())], names=[*names, "_0", "_1", "_2"])
        release()

    return run


def deduplicate(df: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, gram: int = GRAM, bits: int = BITS, large: int = LARGE) -> DataFrame:
    """df's rows; adds n_words, n_removed and left, the words that stay joined by one space."""
    df = df.withColumn(text, F.col(text).cast("string"))
    id_, mark = F.coalesce(F.col(key).cast("long"), F.lit(_NULL)), F.xxhash64(text_or_empty(text))
    gone = stretches(df.select(id_.alias("key"), mark.alias("hash"), text_or_empty(text).alias("text")), window, gram, bits, large)
    own = {c: free_name(df, f"gone_{c}") for c in ("key", "hash", "cuts")}
    gone = gone.groupBy("key", "hash").agg(F.collect_set(F.struct("begin", "end")).alias("cuts")).select([F.col(a).alias(b) for a, b in own.items()])
    joined = df.join(gone, (id_ == F.col(own["key"])) & (mark == F.col(own["hash"])), "left").drop(own["key"], own["hash"])
    names = [free_name(df, c) for c in ("n_words", "n_removed", "left")]
    added = [T.StructField(n, kind) for n, kind in zip(names, (T.LongType(), T.LongType(), T.StringType()))]
    return joined.mapInArrow(_cutting(text, own["cuts"]), T.StructType([*df.schema.fields, *added]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: all documents without passages of 13 words that an earlier document has."""
    out = deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("left").cast("binary"), 256).alias("kept_sha256"))


SQL = """
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (SELECT row, doc_id, unnest(range(len(w) - 12)) AS i, unnest(list_transform(range(len(w) - 12), lambda i: array_to_string(w[i + 1:i + 13], ' '))) AS win FROM d WHERE len(w) >= 13),
e AS (SELECT win, min(doc_id) AS earliest FROM s GROUP BY win),
gone AS (SELECT DISTINCT row, unnest(range(i, i + 13)) AS i FROM s JOIN e USING (win) WHERE earliest < doc_id),
x AS (SELECT row, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
kept AS (SELECT row, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS left_over FROM x ANTI JOIN gone USING (row, i) GROUP BY row)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(left_over, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (row)
"""
