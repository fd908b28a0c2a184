"""Phrases of two to four words that are more than their parts, by the stripes pattern.

A phrase's words but the last are its prefix, and each prefix keys a stripe: an associative counter
of the words that come next. A map task counts the stripes of some million words at a time; stripes
of one prefix meet in a shuffle and are merged elementwise. From the merged stripes come

* extensions: the entries, which are the counts of phrases one word longer;
* totals: the stripe of the empty prefix adds up to the number of words, and its entries are the
  words' own counts;
* subsumption maxima: the largest entry is the most frequent extension to the right.

The stripe of the empty prefix is counted first, then those of words, then longer ones. Each pass
only counts what may be frequent: a phrase with `least` occurrences has only words and pairs of words
with as many, and those are known then. Their bits are broadcast, in tables of a fixed size; words or
pairs that share a bit are counted without need, and dropped when the stripes are merged.

Stripes of prefixes with `HOT` occurrences (for three words: whose first two have as many) are dealt
out in parts by a hash of the next word, so they aren't gathered in one task, and so is that of the
empty prefix. A map task sends each entry once. Phrases left over are found by ordinary joins and
ranked by parts first, then by language.

Defined results: a null language is `und`; a null or empty text has no words; only A to Z become
lower case; pieces end at `.,;:!?` and at the line breaks U+000A to U+000D, and phrases don't cross
them; a very long text is counted in full, with other texts or alone; repeated rows count each;
ties rank by the bytes of the phrase; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import release, stored, table, text_or_empty
from .words import ordered

LEAST, LONGEST, TOP = 30, 4, 2000
#: Parts of the stripe of the empty prefix and of those of frequent ones, and how frequent these are;
#: bits of a table; words a block.
PARTS, HOT, BITS, BLOCK = (4096, 256), 100_000, 27, 2_000_000
_LINES = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: A stripe travels packed: its words joined by spaces, their counts as 32-bit integers.
_STRIPES = "lang string, prefix string, part int, nexts string, counts binary"


class _Block:
    """Some million words of several languages, with a gap after each piece."""

    def __init__(self):
        self.langs: list[str] = []
        self.known: dict[str, defaultdict[bytes, int]] = {}
        self.next = count(1)
        self.numbers: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, text: bytes) -> None:
        known = self.known.get(lang)
        if known is None:
            known = self.known[lang] = defaultdict(self.next.__next__)
        number, numbers = known.__getitem__, [0]
        for piece in text.lower().translate(_LINES).split(b"\n"):
            words = piece.split()
            if words:
                numbers += map(number, words)
                numbers.append(0)
        self.size += len(numbers)
        self.numbers.append(np.array(numbers, np.int64))

    def close(self) -> None:
        """Numbers in the order of the words' hashes, so that a sort by number is one by part."""
        names = list(self.known)
        words = [w for known in self.known.values() for w in known]
        number = np.fromiter((k for known in self.known.values() for k in known.values()), np.int64, len(words))
        lang = np.repeat(np.arange(len(names)), [len(k) for k in self.known.values()])
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        order = np.argsort(hashes, kind="stable")
        place = np.zeros(len(words) + 1, np.int64)
        place[number[order]] = np.arange(1, len(words) + 1)
        self.ids = place[np.concatenate(self.numbers)]
        self.words = pa.array([b"", *(words[k] for k in order)], pa.binary()).cast(pa.string())
        self.lang = np.concatenate(([0], lang[order]))
        self.hash = np.concatenate(([np.uint64(0)], hashes[order]))
        self.names = pa.array(names, pa.string())
        of_lang = np.fromiter((xxhash.xxh3_64_intdigest(n) for n in names), np.uint64, len(names))
        self.salted = self.hash ^ of_lang[self.lang] * _MIX if names else self.hash


def _blocks(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[_Block]:
    block = _Block()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            block.add(lang, text)
            if block.size >= words:
                block.close()
                yield block
                block = _Block()
    if block.size:
        block.close()
        yield block


def _place(hashes: list[np.ndarray], bits: int) -> np.ndarray:
    """Bit of a word or a pair of words, given their hashes (the first one's with its language)."""
    h = hashes[0] if len(hashes) == 1 else hashes[0] * _MIX + hashes[1]
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h >> np.uint64(64 - bits)


def _has(table_, place: np.ndarray) -> np.ndarray:
    known = np.frombuffer(table_, np.uint64)
    return (known[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0


def _rows(block: _Block, columns: list[np.ndarray], parts: int | np.ndarray) -> Iterator[pa.RecordBatch]:
    """Stripes of the phrases whose words are in columns (equal phrases are counted), a row for each
    prefix and part. parts: into how many the stripe of each phrase's prefix is dealt."""
    *prefix, nexts = columns
    size = len(prefix)
    key = nexts.astype(np.int64)
    keys = [*prefix, key] if size > 1 else [prefix[0] * len(block.words) + key] if size else [block.lang[nexts] * len(block.words) + key]
    order, new = ordered(keys)
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(order)))
    entry = order[first]
    part = (block.hash[nexts[entry]] >> np.uint64(32)).astype(np.int64) * (parts[entry] if size else parts) >> 32
    opens = np.ones(len(entry), bool)
    heads = [p[entry] for p in prefix] or [block.lang[nexts[entry]]]
    opens[1:] = np.any([c[1:] != c[:-1] for c in [*heads, part]], axis=0)
    at = np.flatnonzero(opens)
    for a in range(0, len(at), 20_000):
        rows = at[a : a + 20_000]
        low, high = int(rows[0]), int(at[a + 20_000]) if a + 20_000 < len(at) else len(entry)
        offsets = (np.append(rows, high) - low).astype(np.int32)
        said = pc.binary_join_element_wise(*[block.words.take(pa.array(h[rows])) for h in heads], " ") if size else pa.array([""] * len(rows), pa.string())
        yield pa.RecordBatch.from_pydict(
            {
                "lang": block.names.take(pa.array(block.lang[nexts[entry[rows]]])), "prefix": said, "part": pa.array(part[rows], pa.int32()),
                "nexts": pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), block.words.take(pa.array(nexts[entry[low:high]]))), " "),
                "counts": pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets * 4), pa.py_buffer(counts[low:high].astype("<u4"))]),
            }
        )


def _word_stripes(words: int):
    """Stripes of the empty prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, words):
            if block.ids.any():
                yield from _rows(block, [block.ids[block.ids > 0]], PARTS[0])
            del block
        release()

    return run


def _pair_stripes(words: int, bits: int, often, hot):
    """Stripes of single words, of pairs of words that both may be frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, words):
            place = _place([block.salted], bits)
            may, split = _has(often.value, place), np.where(_has(hot.value, place), PARTS[1], 1)
            may[0] = False
            at = np.flatnonzero(may[block.ids[:-1]] & may[block.ids[1:]])
            if len(at):
                yield from _rows(block, [block.ids[at], block.ids[at + 1]], split[block.ids[at]])
            del block
        release()

    return run


def _long_stripes(words: int, longest: int, bits: int, often, hot):
    """Stripes of prefixes of two words and more in which all pairs may be frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, words):
            ids = block.ids
            place = _place([block.salted[ids[:-1]], block.hash[ids[1:]]], bits)
            may = (ids[:-1] > 0) & (ids[1:] > 0) & _has(often.value, place)
            split = np.where(_has(hot.value, place), PARTS[1], 1)
            at = np.flatnonzero(may)
            for size in range(3, longest + 1):
                at = at[at + size - 2 < len(may)]
                at = at[may[at + size - 2]]
                if len(at):
                    yield from _rows(block, [ids[at + t] for t in range(size)], split[at])
            del block
        release()

    return run


def _unpacked(batch: pa.RecordBatch) -> pa.Table:
    """The stripes of a batch with words and counts as lists."""
    words = pc.split_pattern(batch["nexts"], " ")
    counts = np.frombuffer(b"".join(batch["counts"].to_pylist()), "<u4").astype(np.int64)
    return pa.table({c: batch[c] for c in ("lang", "prefix", "part")} | {"nexts": words, "counts": pa.ListArray.from_arrays(words.offsets, pa.array(counts))})


def _merged(table_: pa.Table) -> pa.Table:
    """One row for each prefix and part, counters added elementwise."""
    table_ = table_.combine_chunks()
    keys = ["lang", "prefix", "part"]
    opens = np.ones(table_.num_rows, bool)
    differ = [pc.not_equal(table_[c].slice(1), table_[c].slice(0, table_.num_rows - 1)).to_numpy(zero_copy_only=False) for c in keys]
    opens[1:] = np.any(differ, axis=0)
    nexts, counts = (table_[c].combine_chunks() for c in ("nexts", "counts"))
    sizes = pc.list_value_length(nexts).to_numpy(zero_copy_only=False)
    stripe = np.repeat(np.cumsum(opens) - 1, sizes)
    flat = pa.table({"stripe": pa.array(stripe), "next": nexts.flatten(), "n": counts.flatten()})
    added = flat.group_by(["stripe", "next"]).aggregate([("n", "sum")]).sort_by([("stripe", "ascending"), ("next", "ascending")])
    offsets = pa.array(np.searchsorted(added["stripe"].to_numpy(), np.arange(int(opens.sum()) + 1)).astype(np.int32))
    heads = table_.select(keys).take(pa.array(np.flatnonzero(opens)))
    lists = {"nexts": pa.ListArray.from_arrays(offsets, added["next"].combine_chunks()), "counts": pa.ListArray.from_arrays(offsets, added["n_sum"].combine_chunks())}
    return pa.table({c: heads[c] for c in keys} | lists)


def _merging(least: int, at_once: int):
    """Merged stripes, from rows in order of language, prefix and part: total, largest entry, and
    the entries with `least` occurrences. Of stripes without such entries only the total of the
    empty prefix goes on."""

    def finished(table_: pa.Table) -> list[pa.RecordBatch]:
        nexts, counts = (table_[c].combine_chunks() for c in ("nexts", "counts"))
        flat, n = counts.flatten().to_numpy(), table_.num_rows
        starts = np.concatenate(([0], np.cumsum(pc.list_value_length(counts).to_numpy(zero_copy_only=False))))
        total = np.add.reduceat(flat, starts[:-1]) if n else flat
        best = np.maximum.reduceat(flat, starts[:-1]) if n else flat
        good = np.flatnonzero(flat >= least)
        offsets = np.searchsorted(good, starts).astype(np.int32)
        out = pa.table(
            {
                "lang": table_["lang"], "prefix": table_["prefix"], "total": total, "best": best,
                "nexts": pa.ListArray.from_arrays(pa.array(offsets), nexts.flatten().take(pa.array(good))), "counts": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[good], pa.int64())),
            }
        )
        out = out.filter(pc.or_(pa.array(best >= least), pc.equal(table_["prefix"], "")))
        return out.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size, full = 0, at_once
        for batch in batches:
            held.append(_unpacked(batch))
            size += held[-1].nbytes
            if size >= full:
                rows = _merged(pa.concat_tables(held))
                upto = rows.num_rows - 1  # the last stripe may go on
                yield from finished(rows.slice(0, upto))
                held = [rows.slice(upto).combine_chunks()]
                size = held[0].nbytes
                full = max(at_once, 2 * size)
        if held:
            yield from finished(_merged(pa.concat_tables(held)))
        release()

    return run


def merge(stripes: DataFrame, least: int) -> DataFrame:
    dealt = stripes.repartition("lang", "prefix", "part").sortWithinPartitions("lang", "prefix", "part")
    out = dealt.mapInArrow(_merging(least, 16 << 20), "lang string, prefix string, total long, best long, nexts array<string>, counts array<long>")
    return out.withColumn("size", F.when(F.col("prefix") == "", 0).otherwise(F.size(F.split("prefix", " "))))


def _places(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, *words = (np.array([xxhash.xxh3_64_intdigest(x) for x in batch.column(c).cast(pa.binary()).to_pylist()], np.uint64) for c in batch.schema.names if c != "f")
            yield pa.RecordBatch.from_pydict({"place": _place([words[0] ^ lang * _MIX, *words[1:]], bits).astype(np.int64), "f": batch.column("f")})

    return run


def _tables(rows: DataFrame, bits: int) -> tuple:
    """Broadcast bits of the words or pairs (lang, one or two words, f), and of those with HOT
    occurrences; 2**bits / 64 rows at most come to the driver."""
    place = rows.mapInArrow(_places(bits), "place long, f long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("place", F.lit(64)).cast("int"))
    found = place.groupBy(F.shiftright("place", 6).alias("at")).agg(F.bit_or(bit).alias("often"), F.bit_or(F.when(F.col("f") >= HOT, bit)).alias("hot")).toArrow()
    out = []
    for name in ("often", "hot"):
        table_ = np.zeros(max(1, (1 << bits) // 64), np.int64)
        table_[found["at"].to_numpy()] = found[name].fill_null(0).to_numpy()
        out.append(rows.sparkSession.sparkContext.broadcast(table_.tobytes()))
    return tuple(out)


def entries(merged: DataFrame) -> DataFrame:
    """lang, phrase, size and f of the entries that merged stripes have."""
    each = merged.select("lang", "prefix", (F.col("size") + 1).alias("size"), F.explode(F.arrays_zip("nexts", "counts")).alias("e"))
    return each.select("lang", F.when(F.col("size") == 1, F.col("e.nexts")).otherwise(F.concat_ws(" ", "prefix", "e.nexts")).alias("phrase"), "size", F.col("e.counts").alias("f"))


def phrases(df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, bits: int = BITS, words: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Counts of all phrases of one to `longest` words with `least` occurrences (lang, phrase, size,
    f, right: of the most frequent extension to the right, null if it is below `least`), and the
    number of words of each language."""
    docs = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), text_or_empty(text).alias("text"))
    stripes = lambda tasks: stored(merge(docs.mapInArrow(tasks, _STRIPES), least))
    each = lambda merged: merged.select("lang", "prefix", F.explode(F.arrays_zip("nexts", "counts")).alias("e"))
    one = stripes(_word_stripes(words))
    two = stripes(_pair_stripes(words, bits, *_tables(each(one).select("lang", F.col("e.nexts").alias("first"), F.col("e.counts").alias("f")), bits)))
    more = stripes(_long_stripes(words, longest, bits, *_tables(each(two).select("lang", F.col("prefix").alias("first"), F.col("e.nexts").alias("second"), F.col("e.counts").alias("f")), bits)))
    both = two.unionByName(more)
    right = both.where(F.col("best") >= least).groupBy("lang", F.col("prefix").alias("phrase")).agg(F.max("best").alias("right"))
    return entries(one.unionByName(both)).join(right, ["lang", "phrase"], "left"), one.groupBy("lang").agg(F.sum("total").alias("n"))


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, share: int = 80, bits: int = BITS, words: int = BLOCK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of each language."""
    counted, sizes = phrases(df, text, lang, least, longest, bits, words)
    known = stored(counted)
    wanted = known.where("size > 1").withColumnRenamed("f", "a")
    # words of a phrase lie in a longer one only if they lie in one that is longer by one, at least as frequent
    left = wanted.where("size > 2").select("lang", F.expr("substr(phrase, instr(phrase, ' ') + 1)").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("left"))
    covered = F.greatest(F.coalesce("left", F.lit(0)), F.coalesce("right", F.lit(0)))
    free = wanted.join(left, ["lang", "phrase"], "left").where(100 * covered.cast("decimal(20,0)") < share * F.col("a").cast("decimal(20,0)")).select("lang", "phrase", "size", "a")
    cuts = free.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumns({"head": F.expr("substring_index(phrase, ' ', k)"), "tail": F.expr("substring_index(phrase, ' ', k - size)")})
    part = lambda c, f: known.select("lang", F.col("phrase").alias(c), F.col("f").alias(f))
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    score = F.expr("cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + r)")
    worst = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    scored = worst.select("lang", "phrase", "a", "c.l", "c.r", "c.score", F.pmod(F.xxhash64("phrase"), F.lit(64)).alias("salt"))
    order = [F.desc("score"), F.desc("a"), F.col("phrase").cast("binary")]
    some = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)  # 64 x top rows at most
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the first 2000 phrases of each language of all documents."""
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


SQL = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
g AS (
  SELECT lang, k AS size, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k
), f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 30),
inner_ AS (
  SELECT lang, a AS longer, unnest(flatten(list_transform(range(2, size), lambda k: list_transform(range(1, size - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))))) AS phrase
  FROM c WHERE size > 2
), cover AS (SELECT lang, phrase, max(longer) AS longer FROM inner_ GROUP BY ALL),
free AS (SELECT c.* FROM c LEFT JOIN cover USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM free),
s AS (
  SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f + y.f))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:], ' ')
), worst AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM worst)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
