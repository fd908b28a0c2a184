"""BPE encoding and decoding by speculation and verification.

A word's tokens are first proposed by greedy longest match, from its end. A proposal is the true encoding
exactly when each adjacent pair of tokens is *compatible*, i.e. when the merge order would not
have joined symbols across their border; numpy tests this for all pairs of all new words of a
batch at once. Only words with a failing pair are merged pair by pair. Words met before come
from a bounded cache, so the work grows with the distinct words of a task.

Defined results: a null text encodes as the empty text (no ids); an empty or blank text gives
no ids; special tokens inside a text become their own id, as the library does by default; of
pairs of equal rank the leftmost merges first; repeated rows are encoded each; very long texts
are whole; an empty table gives an empty table; columns named as the new ones are replaced.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import release, table

#: No word holds white space, so this marks special tokens in a list of words.
_MARK = " "
_CACHE_WORDS, _BLOCK_WORDS, _OUT_ROWS = 150_000, 100_000, 300
#: Characters that never compose and that all Unicode versions class and lower alike.
_COMMON = re.compile("[\x00-\u024f\u2010-\u2027\u2030-\u205e\u20ac\u2122]*")
_LOADED: dict[str, WordBpe] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@functools.cache
def is_word_bpe(path: str) -> bool:
    """Whether a file holds a byte-level BPE vocabulary with word ends, whose white space only separates."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    removes = first.get("type") == "Split" and first.get("behavior") == "Removed" and "Regex" in first.get("pattern", {})
    return removes and spec["model"].get("type") == "BPE" and bool(spec["model"].get("end_of_word_suffix"))


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(extra)
            extra += 1
    return [letters[b] for b in range(256)]


def _packed(ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Runs of ids, counts[k] of them each, as little-endian unsigned 32-bit integers."""
    whole, end = ids.astype("<u4").tobytes(), (np.cumsum(counts) * 4).tolist()
    return [whole[a:b] for a, b in zip([0, *end], end, strict=False)]


class WordBpe:
    """Encoder and decoder for a BPE vocabulary with word ends, in the tokenizers JSON format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}"))
        self.ascii_pattern = re.compile(pattern.replace(r"\s", r"\t-\r ").replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9"))
        self.letters = _byte_letters()
        self.byte_of = {c: b for b, c in enumerate(self.letters)}
        self.path, self.library = path, None
        size = max(self.vocab.values()) + 1
        size = max(size, max(self.special.values()) + 1)
        self.names = [""] * size
        for token, i in (self.vocab | self.special).items():
            self.names[i] = token
        self._tables(model["merges"], size)
        self.cache: dict[str, bytes] = {}

    def _tables(self, merges: list, size: int) -> None:
        v = self.vocab
        parts = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([v[a] for a, _ in parts], np.int64)
        right = np.array([v[b] for _, b in parts], np.int64)
        made = np.array([v[a + b] for a, b in parts], np.int64)
        #: rank of the merge that makes a token, -1 for single symbols
        self.rank = np.full(size, -1, np.int64)
        self.rank[made] = np.arange(len(made))
        self.left, self.right = np.arange(size), np.arange(size)
        self.left[made], self.right[made] = left, right
        key = left << 20 | right
        order = np.argsort(key, kind="stable")
        self.pair_key, self.pair_rank = key[order], order
        self.rank_of = {k: r for r, k in enumerate(key.tolist())}
        self.made_of = made.tolist()
        self.letter_id, self.letter_id_end = np.full(1 << 9, -1, np.int64), np.full(1 << 9, -1, np.int64)
        for x in self.letters:
            self.letter_id[ord(x)], self.letter_id_end[ord(x)] = v[x], v[x + self.end]
        # A token can be proposed only if merging its own symbols gives that token. Both parts
        # have lower ranks, so one pass over the merges settles all.
        whole = self._compatible(left, right, np.arange(len(made)))
        ok = np.ones(size, bool)
        for a, b, c, w in zip(left.tolist(), right.tolist(), made.tolist(), whole.tolist(), strict=True):
            ok[c] = w and ok[a] and ok[b]
        self.ends_word = np.zeros(size, np.int64)
        self.automaton = ahocorasick.Automaton()
        for t, i in v.items():
            self.ends_word[i] = t.endswith(self.end)
            if ok[i]:
                self.automaton.add_word((t.removesuffix(self.end) + "\n" if t.endswith(self.end) else t)[::-1], i)
        self.automaton.make_automaton()

    def _joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, a large number where there is none."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], np.iinfo(np.int64).max)

    def _compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge crosses the border of a and b before both are complete.

        Walks both tokens back through their merges, the later one first. Where the symbols at
        the border could merge earlier than what was just undone, the pair fails; at equal rank
        the leftmost place merges first.
        """
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max) if limit is None else limit.copy()
        while len(live):
            early = self._joined(a, b) < limit
            good[live[early]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~early & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[go], a[go], b[go], ra[go], rb[go]
            undo_a = ra > rb
            limit = np.where(undo_a, ra, rb + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return good

    def _merge_many(self, words: list[str]) -> list[bytes]:
        """Exact merging of words of similar length, one row each: in every round each row joins
        its pair of lowest rank, the leftmost on ties, until no pair can merge."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        code = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        last = np.cumsum(length) - 1
        flat = self.letter_id[code]
        flat[last] = self.letter_id_end[code[last]]
        width = int(length.max())
        column = np.arange(width)
        ids = np.full((len(words), width), -1, np.int64)
        ids[column < length[:, None]] = flat
        none = len(self.made_of)
        made = np.array([*self.made_of, -1])
        ranks = np.minimum(self._joined(ids[:, :-1], ids[:, 1:]), none)
        live, out = np.arange(len(words)), ids
        while len(live) and width > 1:
            at = ranks.argmin(axis=1)
            row = np.arange(len(live))
            rank = ranks[row, at]
            go = rank < none
            if not go.all():
                out[live[~go]] = np.pad(ids[~go], ((0, 0), (0, out.shape[1] - ids.shape[1])), constant_values=-1)
                live, ids, ranks, at, rank = live[go], ids[go], ranks[go], at[go], rank[go]
                row = row[: len(live)]
                if not len(live):
                    break
            ids[row, at] = made[rank]
            width -= 1
            column = np.arange(width)
            ids = np.take_along_axis(np.pad(ids, ((0, 0), (0, 1)), constant_values=-1), np.arange(width + 1) + (np.arange(width + 1) > at[:, None]), 1)[:, : width + 1]
            ranks = np.take_along_axis(np.pad(ranks, ((0, 0), (0, 1)), constant_values=none), column + (column >= at[:, None]), 1)[:, :width]
            here = np.minimum(at, width - 1)
            ranks[row, here] = np.minimum(self._joined(ids[row, here], ids[row, here + 1]), none)
            before = np.maximum(at - 1, 0)
            ranks[row, before] = np.minimum(self._joined(ids[row, before], ids[row, before + 1]), none)
        return _packed(out[out >= 0], (out >= 0).sum(axis=1))

    def _propose(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words by longest match from each word's end, and the words they are in.

        From the end every word can be covered, as each letter is a token with and without the
        word end. One automaton runs over all words at once, backwards.
        """
        backwards = ("\n".join(words) + "\n")[::-1]
        tokens = np.fromiter((t for _, t in self.automaton.iter_long(backwards)), np.int64)[::-1]
        last = self.ends_word[tokens]
        return tokens, np.cumsum(last) - last

    def words(self, words: list[str]) -> list[bytes]:
        """Packed ids of distinct words, given in byte letters."""
        if not words:
            return []
        tokens, word_of = self._propose(words)
        inner = np.flatnonzero(word_of[1:] == word_of[:-1])
        failing = np.zeros(len(words), bool)
        failing[word_of[inner[~self._compatible(tokens[inner], tokens[inner + 1])]]] = True
        out = _packed(tokens, np.bincount(word_of, minlength=len(words)))
        bad = sorted(np.flatnonzero(failing).tolist(), key=lambda k: len(words[k]))
        while bad and len(words[bad[-1]]) >= 64:
            k = bad.pop()
            out[k] = np.array(self._merge_long(words[k]), "<u4").tobytes()
        for k in range(0, len(bad), 10_000):
            part = bad[k : k + 10_000]
            for n, x in zip(part, self._merge_many([words[n] for n in part]), strict=True):
                out[n] = x
        return out

    def _merge_long(self, word: str) -> list[int]:
        """Exact merging with a heap, for long words."""
        v, rank_of, made_of = self.vocab, self.rank_of, self.made_of
        ids: list[int] = [v[x] for x in [*word[:-1], word[-1] + self.end] if x in v]
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(rank_of[p], k, p) for k in range(n - 1) if (p := ids[k] << 20 | ids[k + 1]) in rank_of]
        heapq.heapify(heap)
        while heap:
            rank, k, p = heapq.heappop(heap)
            m = after[k]
            if not alive[k] or m >= n or ids[k] << 20 | ids[m] != p:
                continue
            ids[k], alive[m], after[k] = made_of[rank], False, after[m]
            if after[k] < n:
                before[after[k]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y < n and (q := ids[x] << 20 | ids[y]) in rank_of:
                    heapq.heappush(heap, (rank_of[q], x, q))
        return [t for t, a in zip(ids, alive, strict=True) if a]

    def _words_of(self, text: str) -> list[str]:
        """Words of a text without special tokens, as the library's normalizer and pattern give them."""
        if text.isascii():
            return self.ascii_pattern.findall(text.lower())
        if _COMMON.fullmatch(text):
            return self.pattern.findall(text.lower())
        # Unicode tables differ between versions in what composes, lowers and is a letter, so rarer
        # characters are split by the library's own normalizer and pattern.
        if self.library is None:
            self.library = Tokenizer.from_file(self.path)
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes([self.byte_of[c] for c in piece]).decode() for piece, _ in pieces]

    def _split(self, text: str) -> list[str]:
        """Words and special tokens of a text."""
        if "<|" not in text:
            return self._words_of(text)
        out: list[str] = []
        for k, piece in enumerate(self.special_pattern.split(text)):
            out += [_MARK + piece] if k % 2 else self._words_of(piece)
        return out

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text, packed as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        block: list[list[str]] = []
        held = 0
        for text in texts:
            block.append(self._split(text or ""))
            held += len(block[-1])
            if held > _BLOCK_WORDS:
                out += self._block(block)
                block, held = [], 0
        return out + self._block(block)

    def _block(self, block: list[list[str]]) -> list[bytes]:
        new = set().union(*block).difference(self.cache)
        if new:
            if len(self.cache) + len(new) > _CACHE_WORDS:
                self.cache.clear()
                new = set().union(*block)
            self._learn([w for w in new if w[0] != _MARK])
            self.cache.update((w, self.special[w[1:]].to_bytes(4, "little")) for w in new if w[0] == _MARK)
        get = self.cache.__getitem__
        return [b"".join(map(get, words)) for words in block]

    def _learn(self, words: list[str]) -> None:
        letters = self.letters
        spelled = [w if w.isascii() and w.isprintable() else "".join([letters[b] for b in w.encode()]) for w in words]
        self.cache.update(zip(words, self.words(spelled), strict=True))

    def decode(self, packed: bytes | None) -> str:
        """The tokens' names joined by a space, as the library decodes without a decoder."""
        get = self.names.__getitem__
        return " ".join(map(get, np.frombuffer(packed or b"", "<u4").tolist()))


def loaded(path: str) -> WordBpe:
    """One encoder for each vocabulary and Python worker."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def _encoding(path: str, text: str, ids: str, n_tokens: str, decoded: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for start in range(0, batch.num_rows, _OUT_ROWS):
                part = batch.slice(start, _OUT_ROWS)
                packed = bpe.encode(part.column(at).to_pylist())
                columns = dict(zip(part.schema.names, part.columns, strict=True))
                columns |= {ids: pa.array(packed, pa.binary()), n_tokens: pa.array([len(x) // 4 for x in packed], pa.int64())}
                if decoded:
                    columns[decoded] = pa.array(map(bpe.decode, packed), pa.string())
                yield pa.RecordBatch.from_pydict(columns)
        bpe.cache.clear()
        release()

    return run


def encode(df: DataFrame, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens", decoded: str | None = None, path: str | None = None) -> DataFrame:
    """Adds ids (packed little-endian unsigned 32-bit integers), their number and, if a name is
    given, the text that they decode to. Columns that have these names already are replaced."""
    new = [ids, n_tokens, *([decoded] if decoded else [])]
    kept = df.drop(*new).withColumn(text, F.col(text).cast("string"))
    schema = T.StructType([*kept.schema.fields, T.StructField(ids, T.BinaryType()), T.StructField(n_tokens, T.LongType()), *([T.StructField(decoded, T.StringType())] if decoded else [])])
    return kept.mapInArrow(_encoding(path or default_path(), text, ids, n_tokens, decoded), schema)


def decode(df: DataFrame, ids: str = "ids", decoded: str = "decoded", path: str | None = None) -> DataFrame:
    """Adds the text that packed ids stand for."""
    vocabulary = path or default_path()

    @F.pandas_udf(T.StringType())
    def bpe_decode(packed: pd.Series) -> pd.Series:
        return pd.Series([loaded(vocabulary).decode(p) for p in packed], dtype=object)

    return df.withColumn(decoded, bpe_decode(F.col(ids)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: encodes and decodes every whole text; digests of ids and of the decoded text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = encode(docs, decoded="decoded")
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


