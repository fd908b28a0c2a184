"""Periodic runs in texts, and texts in which each run is left once.

A run is a stretch of words with a smallest period q (words q apart are identical), at least
max(12, 2 q) words long, that no neighbouring word extends. Texts are laid one after the other in
blocks, each between marks of its own, and all texts of a block are searched at once:

* Only suffixes at places of a difference cover are sorted: the places whose remainder by 13 is in
  a set whose differences give every remainder. Their first 13 words are ranked, and ranks of
  pairs twice as far apart double the length until all differ.
* The longest common extension of two places compares the few words up to the next offset at
  which both are in the cover; from there it is the least entry between their ranks, by a sparse
  table over the common prefixes of neighbours in the order. Reversed texts give extensions to
  the left.
* A run of period q holds two neighbours of the grid 0, q, 2 q, ... of its text, so for each q only
  pairs of neighbours with the same word are extended, n/1 + n/2 + ... of them at most. A stretch
  found with several periods has the smallest.

Work stays in map tasks: nothing is shuffled, and a task holds one block (262,144 words, or one
longer text) at a time.

Defined results: a null, empty or blank text has no words and no runs, its collapsed text is
empty; words keep their letters; a very long text is a block of its own; repeated rows get equal
results; keys are not looked at (for the query a null doc_id has no repeated part); runs are in
order of start, then period; an empty table gives an empty table; other columns are carried along,
and added columns get a leading underscore if the table has their name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, free_name, release, table, text_or_empty
from .words import blocks, numbered, ordered, packed

#: A perfect difference cover: every remainder by 13 is a difference of two of these.
COVER, STEP = (0, 1, 3, 9), 13
_SLOT = np.full(STEP, -1)
_SLOT[list(COVER)] = np.arange(len(COVER))
_AHEAD = np.array([[next(d for d in range(STEP) if (a + d) % STEP in COVER and (b + d) % STEP in COVER) for b in range(STEP)] for a in range(STEP)])
_BLOCK, _GRID = 1 << 18, 1 << 20


class Extensions:
    """Longest common extensions to the right of two different places of an array whose last
    number, like all marks between texts, is there once."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.symbols = s = np.concatenate((symbols, np.zeros(2 * STEP, symbols.dtype)))
        places = np.arange(n)
        self.places = places = places[_SLOT[places % STEP] >= 0]
        m, far = len(places), len(COVER)
        order, new = ordered(packed([s[places + t] for t in range(STEP)], int(s.max())))
        levels = [self._ranks(order, new)]
        while int(levels[-1].max()) < m - 1:
            rank, behind = levels[-1], np.zeros(m, np.int64)
            if far < m:
                behind[:-far] = rank[far:] + 1
            levels.append(self._ranks(*ordered([rank * (m + 1) + behind])))
            far *= 2
        self.rank = levels[-1]
        order = np.empty(m, np.int64)
        order[self.rank] = np.arange(m)
        self.table = self._minima(self._common(order, levels))

    @staticmethod
    def _ranks(order: np.ndarray, new: np.ndarray) -> np.ndarray:
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new) - 1
        return rank

    def _common(self, order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Common words of each sampled suffix and the one before it in order; the first has 0."""
        m, s = len(order), self.symbols
        a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(m - 1, np.int64)
        for k in range(len(levels) - 1, -1, -1):
            inside = np.flatnonzero((a < m) & (b < m))
            same = inside[levels[k][a[inside]] == levels[k][b[inside]]]
            common[same] += STEP << k
            a[same] += len(COVER) << k
            b[same] += len(COVER) << k
        start = self.places[order]
        at, other, live = start[:-1] + common, start[1:] + common, np.arange(m - 1)
        for t in range(STEP):
            live = live[s[at[live] + t] == s[other[live] + t]]
            common[live] += 1
        return np.concatenate(([0], common)).astype(np.int32)

    @staticmethod
    def _minima(values: np.ndarray) -> np.ndarray:
        rows, width = [values], 1
        while 2 * width <= len(values):
            row = rows[-1].copy()
            row[:-width] = np.minimum(row[:-width], rows[-1][width:])
            rows.append(row)
            width *= 2
        return np.stack(rows)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        s, ahead, length = self.symbols, _AHEAD[i % STEP, j % STEP], np.zeros(len(i), np.int64)
        live, sampled = np.arange(len(i)), []
        for t in range(STEP):
            there = ahead[live] == t
            sampled.append(live[there])
            live = live[~there]
            live = live[s[i[live] + t] == s[j[live] + t]]
            length[live] += 1
        at = np.concatenate(sampled)
        rank = lambda x: self.rank[x // STEP * len(COVER) + _SLOT[x % STEP]]
        a, b = rank(i[at] + ahead[at]), rank(j[at] + ahead[at])
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp(high - low + 1)[1] - 1
        length[at] = ahead[at] + np.minimum(self.table[level, low], self.table[level, high - (1 << level) + 1])
        return length


def _grid(symbols: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and periods of all neighbours on the grids of the texts that have the same word."""
    halves = sizes // 2
    text = np.repeat(np.arange(len(sizes)), halves)
    period = np.arange(len(text)) - np.repeat(np.cumsum(halves) - halves, halves) + 1
    pairs = (sizes[text] - 1) // period
    upto = np.cumsum(pairs)
    first = 0
    while first < len(text):
        last = max(first + 1, int(np.searchsorted(upto, upto[first] - pairs[first] + _GRID, "right")))
        n = pairs[first:last]
        q = np.repeat(period[first:last], n)
        step = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(begins[text[first:last]], n) + step * q
        same = symbols[at] == symbols[at + q]
        yield at[same], q[same]
        first = last


def runs(numbers: np.ndarray, ends: np.ndarray, least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start in the text, length and period of the runs of several texts, in that order.
    numbers: the words of all texts, from 1 on; ends: where each text begins and the last one ends."""
    n, texts = len(numbers), len(ends) - 1
    # a mark before each text and after the last
    where = np.arange(n) + np.repeat(np.arange(1, texts + 1), np.diff(ends))
    symbols = np.empty(n + texts + 1, np.int64)
    marks = ends + np.arange(texts + 1)
    symbols[where] = numbers
    symbols[marks] = (int(numbers.max()) if n else 0) + 1 + np.arange(texts + 1)
    long = np.flatnonzero(np.diff(ends) >= least)
    none = np.zeros(0, np.int64)
    if not len(long):
        return none, none, none, none
    right, left, size = Extensions(symbols), Extensions(symbols[::-1].copy()), len(symbols)
    found = []
    for at, q in _grid(symbols, marks[long] + 1, np.diff(ends)[long]):
        start, end = at - left(size - at, size - at - q), at + q + right(at, at + q)
        enough = np.flatnonzero(end - start >= np.maximum(least, 2 * q))
        keys = [start[enough], end[enough], q[enough]]
        order, new = ordered([keys[0] * (size + 1) + keys[1], keys[2]])
        found.append(np.stack(keys)[:, order[new]])
    start, end, q = np.concatenate(found, axis=1)
    order, new = ordered([start * (size + 1) + end])  # stable, but not by period
    whole = np.flatnonzero(new)
    smallest = np.minimum.reduceat(q[order], whole) if len(whole) else none
    start, end = start[order[whole]], end[order[whole]]
    text = np.searchsorted(marks, start, "right") - 1
    order = np.lexsort((smallest, start))
    return text[order], (start - marks[text] - 1)[order], (end - start)[order], smallest[order]


def _searching(text: str, least: int):
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).cast(pa.binary()).to_pylist()
            for first, last, words, ends in blocks(texts, _BLOCK):
                of, start, length, period = runs(numbered(words, 1)[0], ends, least)
                # what follows the first period of a run goes
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, ends[of] + start + period, 1)
                np.add.at(change, ends[of] + start + length, -1)
                stays = np.cumsum(change)[:-1] == 0
                offsets = np.searchsorted(of, np.arange(last - first + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(a) for a in (start, length, period)], fields=list(kind)))
                short = []
                for k in range(last - first):
                    a, b = ends[k], ends[k + 1]
                    short.append(b" ".join(words[a:b] if offsets[k] == offsets[k + 1] else compress(words[a:b], stays[a:b])))
                added = [pa.array(np.diff(ends)), lists, pa.array(short, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.slice(first, last - first).columns, *added], names=[*batch.schema.names, *(f"_{c}" for c in range(3))])
        release()

    return run


def collapse(df: DataFrame, text: str = "text", least: int = 12) -> DataFrame:
    """df's rows; adds n_words, runs (start, length, period in words) and collapsed, the words that
    stay joined by one space."""
    names = [free_name(df, c) for c in ("n_words", "runs", "collapsed")]
    df = df.withColumn(text, F.col(text).cast("string"))
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    added = [T.StructField(n, kind) for n, kind in zip(names, (T.LongType(), T.ArrayType(run), T.StringType()))]
    return df.mapInArrow(_searching(text, least), T.StructType([*df.schema.fields, *added]))


def with_repeats(text: Column, key: Column) -> Column:
    """The text, or for a tenth of the keys its words up to some place and from there on a few words
    again and again: a check on texts that have runs."""
    words = F.filter(F.split(F.trim(F.regexp_replace(text, SPACE, " ")), " "), lambda w: w != "")
    n, h = F.size(words), F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), F.array_join(F.concat(F.slice(words, F.lit(1), a), again), " ")).otherwise(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: runs of all documents, of which a tenth have a repeated part."""
    docs = table(spark, sf_dir, "documents")
    found = collapse(docs.select("doc_id", with_repeats(text_or_empty(), F.col("doc_id")).alias("text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("best"), F.array_join(lines, "").alias("lines"), "collapsed")
    return out.select(
        "doc_id", "n_runs", (-F.col("best.s")).alias("start"), F.col("best.n").alias("length"), (-F.col("best.p")).alias("period"), F.floor(F.col("best.n") * 1000 / -F.col("best.p")).alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: Pairs of equal words of a text, those with one distance in stretches: the definition itself.
SQL = """
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
         list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS c FROM documents
), h AS (SELECT row, doc_id, w, len(w) AS n, xor(c, 4294967295) AS h, xor(c, 4294967295) // 10 AS g FROM d),
a AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM h), p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
t AS (SELECT row, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w FROM p),
x AS (SELECT row, unnest(w) AS word, unnest(range(n)) AS i FROM t),
pairs AS (SELECT x.row, x.i, y.i - x.i AS q FROM x JOIN x AS y ON x.row = y.row AND x.word = y.word AND y.i > x.i),
isles AS (SELECT row, q, i, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS isle FROM pairs),
stretches AS (SELECT row, min(i) AS start, q + count(*) AS length, q FROM isles GROUP BY row, q, isle HAVING q + count(*) >= greatest(12, 2 * q)),
runs AS (SELECT row, start, length, min(q) AS period FROM stretches GROUP BY row, start, length),
gone AS (SELECT DISTINCT row, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT row, string_agg(word, ' ' ORDER BY i) AS collapsed FROM x ANTI JOIN gone USING (row, i) GROUP BY row),
of AS (
  SELECT row, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
         first({'s': start, 'n': length, 'p': period} ORDER BY length DESC, start, period) AS best FROM runs GROUP BY row
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.n AS length, best.p AS period, 1000 * best.n // best.p AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM t LEFT JOIN of USING (row) LEFT JOIN kept USING (row)
"""
