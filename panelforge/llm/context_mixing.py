"""Language-model scoring by online logistic context mixing.

A text is a sequence of lower-cased words and one end. The most frequent words, the end and an
escape have binary codes (Huffman's, from their counts); any other word is the escape and then
bits of its hash, so words of one hash share their probability, and a word that training lacks
costs about what its hash bits cost. Each bit is predicted by its place in the code alone, from
the counts of words, and in two hashed contexts: the word before, and the two words before. A
context predicts a bit from how often training texts took either turn at that place. The
predictors' log odds are added with weights that a gate chooses by the depth in the code and by
how much each context has been seen. The weights are learned online over all training texts,
each text's own part of the counts left out, and the mixed odds are refined by a table that
follows how often odds of that size came true, as it adapts during the same pass.

Where the work happens: every token is sent to the range of contexts that its preceding words
fall in, and both its contexts are whole there. A range merges what all blocks of texts send,
learns its weights, scores each distinct event once and returns one sum for each text. Ranges
follow the training tokens in number, so what is gathered grows with the input and none of it is
whole on one machine. Words too frequent for a range are split: the context of a word with over
`cap` tokens also holds some bits of the word before it, and where both words are that frequent,
the part of the documents (by a hash of their ids), so one common word, pair or passage never
meets in one task. Exact counts of words without a code come from ranges of words in the same
way. What is broadcast is bounded: `words` frequent words and 65,536 sums of rare ones.

Sums are whole numbers of 2**-20 nats, and ranges and merged events have a fixed order, so
scores don't depend on partitions. Total bits are -score / log10(2); bits_per_byte divides them
by the text's bytes.

Defined results: a null text is an empty one, with the end as only token (bits_per_byte null); a
null key counts as the text "None"; repeated rows are scored one by one, and each counts in
training; ties in frequency go to the smaller word; a very long text is a block of its own;
without training documents all counts are 0; an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable, Iterator
from math import gcd
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, stored, table, text_or_empty

WORDS, PER_RANGE, CAP = 1 << 16, 1_000_000, 300_000
INPUTS, CLASSES, TRUST, BUCKETS = 3, 4, 5, 24
GATES = CLASSES * TRUST * TRUST
_TRUST_OF = np.array([(n > 0) + (n > 1) + (n > 3) + (n > 30) for n in range(32)], np.int32)
_MIX, _GOLD = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
_RARE, _START = np.uint64(1 << 63), np.uint64((1 << 63) - 1)
_COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])
_BLOCK_TOKENS, _BATCH, _LEAF_BITS, _UNIT = 250_000, 16_384, 16, float(1 << 20)
LOG10_E = float(np.log10(np.e))


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of texts with A to Z in lower case, and how many each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, ends = split.flatten(), np.asarray(split.offsets)
    solid = np.asarray(pc.not_equal(flat, ""))  # white space at an end leaves an empty one
    upto = np.concatenate([[0], np.cumsum(solid)])
    return flat.filter(pa.array(solid)), np.diff(upto[ends - ends[0]])


def held_out(key: object) -> bool:
    return crc32(str(key).encode()) % 7 == 2


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


class Codes:
    """Binary codes of words. A word is known by its place in the order of codes: a frequent word
    or the end has one place, the escape one for each value of the hash bits."""

    def __init__(self, frequent: list[str], counts: list[int], ends: int, escapes: int, bits: int, leaves: np.ndarray):
        n = len(frequent) + 2
        weight = [c + 0.5 for c in (*counts, ends, escapes)]
        heap = [(w, k) for k, w in enumerate(weight)]
        heapq.heapify(heap)
        children, total = [], list(weight)
        while len(heap) > 1:
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            children.append((x, y))
            total.append(a + b)
            heapq.heappush(heap, (a + b, len(total) - 1))
        path: list[list[tuple[int, int]]] = [[] for _ in total]
        odds = np.zeros(len(children), np.float32)
        for k in range(len(children) - 1, -1, -1):
            x, y = children[k]
            path[x], path[y] = [*path[n + k], (k, 0)], [*path[n + k], (k, 1)]
            odds[k] = np.log(total[y] / total[x])
        value = [sum(b << (63 - k) for k, (_, b) in enumerate(p)) for p in path[:n]]
        order = sorted(range(n), key=value.__getitem__)
        rank = np.argsort(order)
        self.bits, self.escape = bits, int(rank[n - 1])
        self.code = np.array([value[k] for k in order], np.uint64)
        self.length = np.array([len(path[k]) for k in order], np.int64)
        self.start = np.cumsum(self.length) - self.length
        #: log odds of each step of each code, in favour of the step
        self.steps = np.array([(2 * b - 1) * odds[x] for k in order for x, b in path[k]], np.float32)
        place = np.arange(n) + np.where(np.arange(n) > self.escape, (1 << bits) - 1, 0)
        self.first = place  # place of each code
        self.place = {w: int(place[r]) for w, r in zip(frequent, rank.tolist(), strict=False)}
        self.end = int(place[rank[n - 2]])
        count = np.array([*counts, ends, 0], np.int64)[order]
        self.count = count
        self.log_count = np.log10(count + 1.0)
        self.least = int(counts[-1]) if counts else 0
        # log odds of each hash bit from the counts of rare words below either turn, root first
        self.rare_odds, sums = np.zeros(max(1, len(leaves)), np.float32), leaves.astype(np.float64)
        while len(sums) > 1:
            zero, one = sums[0::2], sums[1::2]
            self.rare_odds[len(zero) : 2 * len(zero)] = np.log((one + 0.2) / (zero + 0.2))
            sums = zero + one
        self.leaf_bits = max(0, len(leaves).bit_length() - 1)

    def which(self, place: np.ndarray) -> np.ndarray:
        """The code that each place belongs to."""
        wide = (1 << self.bits) - 1
        return np.where(place <= self.escape, place, np.maximum(place - wide, self.escape))

    def of(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which code, the bits from the highest down, and how many of them, for each place."""
        which = self.which(place)
        code, length = self.code[which], self.length[which]
        rare = which == self.escape
        shift = np.uint64(64 - int(self.length[self.escape]) - self.bits)
        code[rare] |= (place[rare].astype(np.uint64) - np.uint64(self.first[self.escape])) << shift
        length[rare] += self.bits
        return which, code, length

    def favour(self, start: np.ndarray, code: np.ndarray, depth: int) -> np.ndarray:
        """Log odds of each code's step at this depth, from the counts of words alone; start: where its steps begin."""
        head = int(self.length[self.escape])
        out = self.steps[np.minimum(start + depth, len(self.steps) - 1)]
        if depth >= head:
            rare = np.flatnonzero(start == self.start[self.escape])
            out[rare] = 0
            if depth - head < self.leaf_bits:
                code = code[rare] << np.uint64(head)
                before = code >> np.uint64(64 - (depth - head)) if depth > head else np.zeros(len(rare), np.uint64)
                odds = self.rare_odds[(1 << (depth - head)) + before.astype(np.int64)]
                out[rare] = np.where(code >> np.uint64(63 - (depth - head)) & np.uint64(1), odds, -odds)
        return out


def _zip(a: np.ndarray) -> bytes:
    """An array byte by byte (the high bytes of small numbers are alike), compressed."""
    return pa.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes(), "zstd", asbytes=True) if len(a) else b""


def _unzip(data: bytes, n: int, kind: type) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(data, n * width, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, n).T).view(kind).ravel()


def _blocks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """First and last of texts with about so many tokens together, a word taken as six bytes."""
    size = np.cumsum(np.asarray(pc.binary_length(texts))) // (6 * _BLOCK_TOKENS)
    cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(texts)]
    yield from ((a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a partition's training texts with their counts; emptied when large."""
    parts: list[pa.Table] = []
    held = 0

    def merged() -> pa.Table:
        return pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

    for batch in batches:
        train = pa.array([not held_out(k) for k in batch.column(0).to_pylist()], pa.bool_())
        texts = batch.column(1).filter(train)
        for a, b in _blocks(texts):
            counts = pc.value_counts(_words(texts.slice(a, b - a))[0])
            parts.append(pa.table({"word": counts.field(0), "n": counts.field(1)}))
            held += len(counts)
        if held > 600_000:
            parts = [merged()]
            held = parts[0].num_rows
            if held > 300_000:
                yield from parts[0].cast(_COUNTS).to_batches()
                parts, held = [], 0
    if parts:
        yield from merged().cast(_COUNTS).to_batches()
    release()


def _leaf_sums(bits: int) -> Callable:
    """Counts of rare words by the first bits of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << bits, np.int64)
        for batch in batches:
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, batch.column(0).to_pylist()), np.uint64, batch.num_rows)
            np.add.at(sums, (h >> np.uint64(64 - bits)).astype(np.int64), batch.column(1).to_numpy(zero_copy_only=False))
        seen = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"leaf": pa.array(seen, pa.int32()), "n": pa.array(sums[seen])})

    return run


EVENTS_SCHEMA = (
    "range long, block long, n_train int, size int, h1 binary, h2 binary, place binary, doc binary, n binary, "
    "doc_id array<{kind}>, held_out array<boolean>, n_bytes array<bigint>, n_tokens array<bigint>, base array<double>, known array<bigint>"
)


def _sent(codes: Codes, ranges: int, word_ranges: int, cap: int, kind: pa.DataType) -> Callable:
    """For each block of texts: a row about the texts (its range is negative), what happens in
    each range of contexts, and the rare words in each range of words."""
    kinds = {"range": pa.int64(), "block": pa.int64(), "n_train": pa.int32(), "size": pa.int32()} | {c: pa.binary() for c in ("h1", "h2", "place", "doc", "n")}
    kinds |= {"doc_id": pa.list_(kind), "held_out": pa.list_(pa.bool_()), "n_bytes": pa.list_(pa.int64()), "n_tokens": pa.list_(pa.int64()), "base": pa.list_(pa.float64()), "known": pa.list_(pa.int64())}

    def rows(columns: dict) -> pa.RecordBatch:
        n = len(columns["range"])
        return pa.RecordBatch.from_arrays([columns[c].cast(k) if isinstance(columns.get(c), pa.Array) else pa.array(columns.get(c, [None] * n), k) for c, k in kinds.items()], names=list(kinds))

    def cut(place: np.ndarray) -> list[tuple[int, int]]:
        cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(place)]
        return list(zip(cuts, cuts[1:], strict=False)) if len(place) else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for at, upto in _blocks(texts):
                block += 1
                names = keys.slice(at, upto - at).to_pylist()
                held = np.array([held_out(k) for k in names], bool)
                order = np.argsort(held, kind="stable")  # training texts first
                names, n_train = [names[k] for k in order], int((~held).sum())
                own_texts = texts.slice(at, upto - at).take(pa.array(order))
                words, size = _words(own_texts)
                words = words.dictionary_encode()
                distinct = words.dictionary.to_pylist()
                found = np.fromiter((codes.place.get(w, -1) for w in distinct), np.int64, len(distinct))
                hashes = np.zeros(len(distinct), np.uint64)
                lacking = np.flatnonzero(found < 0)
                hashes[lacking] = np.fromiter((xxhash.xxh3_64_intdigest(distinct[k]) for k in lacking), np.uint64, len(lacking))
                size = size + 1
                doc = np.repeat(np.arange(len(size)), size)
                place, h = np.full(len(doc), codes.end, np.int64), np.zeros(len(doc), np.uint64)
                inner = np.ones(len(doc), bool)
                inner[np.cumsum(size) - 1] = False
                index = np.asarray(words.indices)
                place[inner], h[inner] = found[index], hashes[index]
                is_rare = place < 0
                h = h[is_rare]
                key = place.astype(np.uint64)
                key[is_rare] = h | _RARE
                place[is_rare] = codes.first[codes.escape] + (h >> np.uint64(64 - codes.bits)).astype(np.int64)
                which = codes.which(place)
                own = codes.count[which]
                # about the texts; rare words add to base and known later
                base = np.bincount(doc, np.where(is_rare, 0.0, codes.log_count[which]), len(size))
                known = np.bincount(doc, ~is_rare & (own > 0), len(size)).astype(np.int64)
                info = {"doc_id": keys.slice(at, upto - at).take(pa.array(order)), "held_out": pa.array(held[order]), "n_tokens": pa.array(size), "base": pa.array(base), "known": pa.array(known)}
                info["n_bytes"] = pc.binary_length(own_texts).cast(pa.int64())
                offsets = pa.array([0, len(size)], pa.int32())
                yield rows({"range": [-1 - block], "block": [block], "n_train": [n_train], "size": [len(size)]} | {c: pa.ListArray.from_arrays(offsets, v) for c, v in info.items()})

                seen = np.where(is_rare, codes.least, own)
                one, two = np.full(len(key), _START), np.full(len(key), _START)
                seen_one, seen_two = np.full(len(key), codes.count[codes.which(np.array([codes.end]))[0]]), np.full(len(key), codes.count[codes.which(np.array([codes.end]))[0]])
                same = doc[1:] == doc[:-1]
                one[1:], seen_one[1:] = np.where(same, key[:-1], one[1:]), np.where(same, seen[:-1], seen_one[1:])
                same = doc[2:] == doc[:-2]
                two[2:], seen_two[2:] = np.where(same, key[:-2], two[2:]), np.where(same, seen[:-2], seen_two[2:])
                before = _mixed(two * _MIX + np.uint64(5))
                by_word = np.maximum(1, -(-seen_one // cap)).astype(np.uint64)
                least = np.minimum(seen_one, seen_two)
                by_doc = np.where(least > cap, -(-least // cap), 1).astype(np.uint64)
                of_doc = np.fromiter((xxhash.xxh3_64_intdigest(str(k)) for k in names), np.uint64, len(names))[doc]
                route = _mixed(_mixed(one * _MIX + np.uint64(1)) + (before % by_word) * _GOLD + _mixed(of_doc % by_doc + np.uint64(7)))
                context = route >> np.uint64(32) << np.uint64(16) | before >> np.uint64(48)
                # equal events of one text are one row with a number; the sort keeps the order of texts
                first = np.lexsort((place, context))
                columns = [a[first] for a in (context, place.astype(np.uint32), doc.astype(np.uint32))]
                new = np.ones(len(first), bool)
                new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
                starts = np.flatnonzero(new)
                n = np.diff(np.append(starts, len(first))).astype(np.uint32)
                context, place, of = (c[starts] for c in columns)
                h1, h2 = (context >> np.uint64(16)).astype(np.uint32), context.astype(np.uint16)
                to = ((context >> np.uint64(16)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
                parts = cut(to)
                yield rows(
                    {
                        "range": [int(to[a]) for a, _ in parts],
                        "block": [block] * len(parts),
                        "n_train": [n_train] * len(parts),
                        "size": [b - a for a, b in parts],
                        "h1": [_zip(np.diff(h1[a:b], prepend=np.uint32(0))) for a, b in parts],
                        "h2": [_zip(h2[a:b]) for a, b in parts],
                        "place": [_zip(place[a:b]) for a, b in parts],
                        "doc": [_zip(of[a:b]) for a, b in parts],
                        "n": [_zip(n[a:b]) for a, b in parts],
                    }
                )
                of = doc[is_rare]
                first = np.lexsort((of, h))
                h, of = h[first], of[first]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
                starts = np.flatnonzero(new)
                n = np.diff(np.append(starts, len(h))).astype(np.uint32)
                h, of = h[starts], of[starts].astype(np.uint32)
                to = ((h >> np.uint64(32)) * np.uint64(word_ranges) >> np.uint64(32)).astype(np.int64)
                parts = cut(to)
                yield rows(
                    {
                        "range": [ranges + int(to[a]) for a, _ in parts],
                        "block": [block] * len(parts),
                        "n_train": [n_train] * len(parts),
                        "size": [b - a for a, b in parts],
                        "place": [_zip(h[a:b]) for a, b in parts],
                        "doc": [_zip(of[a:b]) for a, b in parts],
                        "n": [_zip(n[a:b]) for a, b in parts],
                    }
                )
        release()

    return run


class Events:
    """Distinct events of a range in the order of contexts and codes, with how often training
    texts have each, and their nodes' counts by depth."""

    def __init__(self, codes: Codes, context: np.ndarray, place: np.ndarray, n: np.ndarray):
        """context: the wider one in the bits from 16 up."""
        self.codes = codes
        which, self.code, self.length = codes.of(place)
        self.start = codes.start[which]
        self.n = n
        wide = context >> np.uint64(16)
        rank = np.cumsum(np.diff(wide, prepend=wide[:1]) != 0).astype(np.uint64)
        pairs, self.pair = np.unique(rank << np.uint64(32) | place.astype(np.uint64), return_inverse=True)
        _, self.pair_code, self.pair_length = codes.of((pairs & np.uint64(0xFFFFFFFF)).astype(np.int64))
        self.pair_n = np.bincount(self.pair, n, len(pairs))
        self.shared, self.pair_shared = self._shared(context, self.code), self._shared(pairs >> np.uint64(32), self.pair_code)

    @staticmethod
    def _shared(context: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Leading bits that each code shares with the one before it, -1 in another context."""
        x = code[1:] ^ code[:-1]
        _, exponent = np.frexp((x & ~(x >> np.uint64(1))).astype(np.float64))
        return np.concatenate([[-1], np.where(context[1:] == context[:-1], 64 - exponent, -1)])[: len(code)]

    @staticmethod
    def _at(shared: np.ndarray, n: np.ndarray, depth: int) -> np.ndarray:
        """Counts of the nodes at this depth that the codes pass."""
        of = np.cumsum(shared < depth) - 1
        return np.bincount(of, n).astype(np.float32)[of] if len(of) else np.zeros(0, np.float32)

    def depths(self) -> Iterator[tuple]:
        """For each depth: the events that are as deep, their node's and next node's counts in
        both contexts, and the log odds without context in favour of what happened."""
        at, shared, n, start, code, length, pair = np.arange(len(self.n)), self.shared, self.n, self.start, self.code, self.length, self.pair
        p_shared, p_n, p_length = self.pair_shared, self.pair_n, self.pair_length
        here, p_here = self._at(shared, n, 0), self._at(p_shared, p_n, 0)
        for depth in range(int(self.length.max(initial=0))):
            go, p_go = length > depth, p_length > depth
            if not go.all():
                pair = (np.cumsum(p_go) - 1)[pair[go]]
                at, shared, n, start, code, length, here = (a[go] for a in (at, shared, n, start, code, length, here))
                p_shared, p_n, p_length, p_here = (a[p_go] for a in (p_shared, p_n, p_length, p_here))
            there, p_there = self._at(shared, n, depth + 1), self._at(p_shared, p_n, depth + 1)
            yield depth, at, p_here[pair], p_there[pair], here, there, self.codes.favour(start, code, depth)
            here, p_here = there, p_there


def _trust(n: np.ndarray) -> np.ndarray:
    """How much a context has been seen, from 0 to TRUST - 1."""
    return _TRUST_OF[np.minimum(n, 31).astype(np.int8)]


def _inputs(depth: int, seen: tuple, own: np.ndarray | np.float32) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of the three predictors in favour of what happened, and gates; own: what is left out."""
    one, one_next, two, two_next, odds = seen
    x = np.empty((INPUTS, len(odds)), np.float32)
    x[0] = odds
    small = np.float32(0.2)
    np.log((one_next + (small - own)) / (one - one_next + small), out=x[1])
    np.log((two_next + (small - own)) / (two - two_next + small), out=x[2])
    np.clip(x, -12, 12, out=x)
    return x, (min(depth // 3, CLASSES - 1) * TRUST + _trust(one - own)) * TRUST + _trust(two - own)


class Mixer:
    """Gated weights, and how often mixed odds of each size came true."""

    def __init__(self) -> None:
        self.w = np.zeros((INPUTS, GATES), np.float32)
        one, two = np.arange(GATES) // TRUST % TRUST, np.arange(GATES) % TRUST
        self.w[0], self.w[1], self.w[2] = np.where(one > 0, 1 - 0.2 * one, 0.9), 0.15 * one, 0.12 * two
        self.seen = np.zeros(GATES)
        sure = 1 / (1 + np.exp(-(np.arange(BUCKETS) + 0.5) / 2))
        self.hits, self.misses = np.tile(8 * sure, (GATES, 1)), np.tile(8 * (1 - sure), (GATES, 1))

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return self.w[0, gate] * x[0] + self.w[1, gate] * x[1] + self.w[2, gate] * x[2]

    def learn(self, x: np.ndarray, gate: np.ndarray, n: np.ndarray) -> None:
        """One step for each gate over a batch of bits that happened n times; steps shrink as a gate has seen more."""
        z = self.mixed(x, gate)
        error = n / (1 + np.exp(np.clip(z, -30, 30)))
        cell = (gate * BUCKETS + self._bucket(z)) * 2 + (z > 0)
        came = np.bincount(cell, n, GATES * BUCKETS * 2).reshape(GATES, BUCKETS, 2)
        self.misses += came[..., 0]
        self.hits += came[..., 1]
        total = came.sum(axis=(1, 2))
        self.seen += total
        rate = (2.0 / np.sqrt(np.maximum(1, self.seen / 2000))) / np.maximum(1, total)
        for k in range(INPUTS):
            self.w[k] += rate * np.clip(np.bincount(gate, error * x[k], GATES), -total, total)

    @staticmethod
    def _bucket(z: np.ndarray) -> np.ndarray:
        return np.minimum(np.abs(z) * 2, BUCKETS - 1).astype(np.int32)

    def log_p(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Log probability of what happened; the other turn's is its complement, as both are the
        same function of the odds with another sign. No bit is surer than 1 in a million."""
        z = self.mixed(x, gate)
        refined = np.log(self.hits / self.misses).astype(np.float32).ravel()[gate * BUCKETS + self._bucket(z)]
        z = (z + np.sign(z) * refined) / 2
        return -np.log1p(np.exp(-np.clip(z, -13.8, 13.8)))


def _merged(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """Row, h1 and h2 together, place, text and number of all events of a range."""
    sizes = rows.column("size").to_pylist()

    def whole(column: str, kind: type) -> list[np.ndarray]:
        return [_unzip(x, n, kind) for x, n in zip(rows.column(column).to_pylist(), sizes, strict=True)]

    row = np.repeat(np.arange(len(sizes)), sizes)
    context = np.concatenate([np.cumsum(a, dtype=np.uint32) for a in whole("h1", np.uint32)]).astype(np.uint64) << np.uint64(16) | np.concatenate(whole("h2", np.uint16))
    return row, context, np.concatenate(whole("place", np.uint32)), np.concatenate(whole("doc", np.uint32)), np.concatenate(whole("n", np.uint32))


def range_scores(codes: Codes, context: np.ndarray, place: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log probability of each event, in units; events are distinct and in order, n is how often
    training texts have each."""
    out, mixer = np.zeros(len(n), np.int64), Mixer()

    def settle(held: list[tuple]) -> None:
        """Learns from depths that share their gates, then scores them, a batch that fits in the
        processor's cache at a time. Batches are of events that training texts have, and spread over
        the contexts, so what other texts have changes nothing."""
        for depth, at, *seen in held:
            trained = np.flatnonzero(n[at] > 0)
            if not len(trained):
                continue
            times = n[at[trained]].astype(np.float32)
            own, known = np.minimum(times, 1), [a[trained] for a in seen]
            steps = -(-len(trained) // _BATCH)
            stride = next(k for k in range(steps * 5 // 8 + 1, steps + 2) if gcd(k, steps) == 1)
            for k in range(steps):
                part = slice(k * stride % steps * _BATCH, (k * stride % steps + 1) * _BATCH)
                mixer.learn(*_inputs(depth, tuple(a[part] for a in known), own[part]), times[part])
        for depth, at, *seen in held:
            for k in range(0, len(at), _BATCH):
                part = slice(k, k + _BATCH)
                out[at[part]] += np.rint(mixer.log_p(*_inputs(depth, tuple(a[part] for a in seen), np.float32(0))) * _UNIT).astype(np.int64)

    held: list[tuple] = []
    for found in Events(codes, context, place, n).depths():
        if held and min(found[0] // 3, CLASSES - 1) != min(held[-1][0] // 3, CLASSES - 1):
            settle(held)
            held = []
        held.append(found)
    settle(held)
    return out


SUMS_SCHEMA = "range long, block long, doc array<int>, score array<bigint>, base array<double>, known array<bigint>, doc_id array<{kind}>, held_out array<boolean>, n_bytes array<bigint>, n_tokens array<bigint>"


def _ranged(codes: Codes, ranges: int, kind: pa.DataType) -> Callable:
    kinds = {"range": pa.int64(), "block": pa.int64(), "doc": pa.list_(pa.int32()), "score": pa.list_(pa.int64()), "base": pa.list_(pa.float64()), "known": pa.list_(pa.int64())}
    kinds |= {"doc_id": pa.list_(kind), "held_out": pa.list_(pa.bool_()), "n_bytes": pa.list_(pa.int64()), "n_tokens": pa.list_(pa.int64())}

    def out(columns: dict, n: int) -> pa.Table:
        return pa.table({c: columns[c] if c in columns else pa.nulls(n, k) for c, k in kinds.items()}, schema=pa.schema(list(kinds.items())))

    def run(rows: pa.Table) -> pa.Table:
        place_of = rows.column("range")[0].as_py()
        if place_of < 0:
            return out({c: rows.column(c).cast(kinds[c]) for c in ("range", "block", "doc_id", "held_out", "n_bytes", "n_tokens", "base", "known")}, rows.num_rows)
        n_train = np.array(rows.column("n_train").to_pylist(), np.int64)
        sizes = np.array(rows.column("size").to_pylist(), np.int64)
        if place_of < ranges:
            row, context, place, doc, n = _merged(rows)
            _, rank = np.unique(context, return_inverse=True)
            _, first, of = np.unique(rank.astype(np.uint64) << np.uint64(32) | place, return_index=True, return_inverse=True)
            times = np.bincount(of, np.where(doc < n_train[row], n, 0), len(first))
            scores = range_scores(codes, context[first], place[first].astype(np.int64), times)
            values = {"score": (scores[of] * n, np.int64)}
        else:
            row = np.repeat(np.arange(len(sizes)), sizes)
            word, doc, n = (np.concatenate([_unzip(x, k, kind) for x, k in zip(rows.column(c).to_pylist(), sizes.tolist(), strict=True)]) for c, kind in (("place", np.uint64), ("doc", np.uint32), ("n", np.uint32)))
            _, of = np.unique(word, return_inverse=True)
            count = np.bincount(of, np.where(doc < n_train[row], n, 0))[of]
            values = {"base": (np.log10(count + 1.0) * n, np.float64), "known": ((count > 0) * n, np.int64)}
        order = np.lexsort((doc, row))
        row, doc = row[order], doc[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (doc[1:] != doc[:-1])
        starts = np.flatnonzero(new)
        offsets = pa.array(np.searchsorted(row[starts], np.arange(len(sizes) + 1)), pa.int32())
        lists = {c: pa.ListArray.from_arrays(offsets, pa.array(np.add.reduceat(v[order].astype(kind), starts))) for c, (v, kind) in values.items()}
        lists["doc"] = pa.ListArray.from_arrays(offsets, pa.array(doc[starts].astype(np.int32)))
        del row, doc, n, of, values, order
        release()
        return out({"range": rows.column("range"), "block": rows.column("block"), **lists}, rows.num_rows)

    return run


TEXTS_SCHEMA = "doc_id {kind}, held_out boolean, n_bytes long, n_tokens long, base double, known long, score double"


def _texts(rows: pa.Table) -> pa.Table:
    """The texts of one block, with the sums that the ranges sent."""
    rows = rows.sort_by("range")
    info = rows.slice(0, 1)
    flat = {c: info.column(c).combine_chunks().flatten() for c in ("doc_id", "held_out", "n_bytes", "n_tokens")}
    base, known = np.array(info.column("base")[0].as_py()), np.array(info.column("known")[0].as_py())
    score = np.zeros(len(base), np.int64)
    for k in range(1, rows.num_rows):
        doc = np.array(rows.column("doc")[k].as_py(), np.int64)
        if rows.column("score")[k].is_valid:
            score[doc] += np.array(rows.column("score")[k].as_py(), np.int64)
        else:
            base[doc] += np.array(rows.column("base")[k].as_py())
            known[doc] += np.array(rows.column("known")[k].as_py())
    return pa.table({**flat, "base": pa.array(base), "known": pa.array(known), "score": pa.array(score / _UNIT * LOG10_E)})


def score(df: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, per_range: int = PER_RANGE, cap: int = CAP) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row.

    per_range: about so many tokens are in a range; cap: words with more are split.
    """
    kind = df.schema[key].dataType.simpleString()
    docs = df.select(F.col(key).alias("doc_id"), text_or_empty(text).alias("text"))
    arrow_kind = docs.select("doc_id").limit(0).toArrow().schema.field(0).type
    vocabulary = stored(docs.mapInArrow(_word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    ends = docs.where(F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("None"))), F.lit(7)) != 2).count()
    seen = vocabulary.agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("words")).first()
    top = vocabulary.orderBy(F.desc("n"), "word").limit(words).toArrow()  # bounded by words
    frequent, counts = top["word"].to_pylist(), top["n"].to_pylist()
    total = (seen["tokens"] or 0) + ends
    others, n_rare = total - ends - sum(counts), seen["words"] - len(frequent)
    bits = min(30, max(1, (4 * max(1, n_rare) - 1).bit_length()))
    leaf_bits = min(bits, _LEAF_BITS)
    rare = vocabulary
    if frequent:
        edge = F.lit(counts[-1])
        rare = vocabulary.where((F.col("n") < edge) | ((F.col("n") == edge) & (F.col("word") > F.lit(frequent[-1]))))
    sums = rare.mapInArrow(_leaf_sums(leaf_bits), "leaf int, n long").groupBy("leaf").agg(F.sum("n").alias("n")).toArrow()  # 65,536 rows at most
    leaves = np.zeros(1 << leaf_bits, np.int64)
    leaves[sums["leaf"].to_numpy()] = sums["n"].to_numpy()
    codes = Codes(frequent, counts, ends, others, bits, leaves)

    ranges, word_ranges = total // per_range + 1, others // per_range + 1
    sent = docs.mapInArrow(_sent(codes, ranges, word_ranges, cap, arrow_kind), EVENTS_SCHEMA.format(kind=kind))
    found = sent.groupBy("range").applyInArrow(_ranged(codes, ranges, arrow_kind), SUMS_SCHEMA.format(kind=kind))
    texts = found.groupBy("block").applyInArrow(_texts, TEXTS_SCHEMA.format(kind=kind))
    size = float(np.log10(total + seen["words"] + (1 if ends else 0) + 1))
    return texts.select(
        F.col("doc_id").alias(key),
        "held_out",
        "n_tokens",
        F.col("known").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * size).alias("base_score"),
        "score",
        F.try_divide(-F.col("score") / float(np.log10(2)), F.col("n_bytes")).alias("bits_per_byte"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: scores of all documents."""
    return score(table(spark, sf_dir, "documents"))
