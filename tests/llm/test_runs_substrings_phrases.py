"""Periodic runs, repeated passages and collocations against brute force, with odd tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import collocations, periodic_runs, substring_dedup
from panelforge.llm.words import blocks, numbered


def plain_runs(words, least=12):
    """Maximal stretches of each period, the smallest period of each stretch."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(least, 2 * q):
                found.setdefault((start, i - start + q), q)
            i += 1
    return sorted((start, q, length) for (start, length), q in found.items())


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_many_texts_at_once(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(40):
        some = [rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(0, 60))]
        at, size = rng.randint(0, len(some)), rng.randint(1, 9)
        texts.append(some[:at] + some[at : at + size] * rng.randint(1, 12) + some[at:])
    texts += [texts[0], texts[0], [], ["a"] * 300, list("abcabcabcabcabc") * 4]
    words = [w.encode() for t in texts for w in t]
    of, start, length, period = periodic_runs.runs(numbered(words, 1)[0], np.cumsum([0, *map(len, texts)]))
    got = [[] for _ in texts]
    for k, a, b, c in zip(of, start, length, period):
        got[k].append((int(a), int(c), int(b)))
    assert got == [plain_runs(t) for t in texts]


def test_extensions_against_plain_comparison():
    rng = np.random.default_rng(4)
    s = np.concatenate((rng.integers(1, 3, 700), rng.integers(1, 3, 40).repeat(9), [9]))
    find = periodic_runs.Extensions(s)
    i, j = rng.integers(0, len(s), 4000), rng.integers(0, len(s), 4000)
    i, j = i[i != j], j[i != j]
    want = [next(k for k in range(len(s)) if s[a + k] != s[b + k]) if max(a, b) < len(s) else 0 for a, b in zip(i, j)]
    assert find(i, j).tolist() == want


def test_runs_of_odd_documents(spark, odd_docs, no_docs):
    rows = periodic_runs.collapse(odd_docs).collect()
    assert len(rows) == 12 and periodic_runs.collapse(no_docs).count() == 0
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert all(by[k]["n_words"] == 0 and by[k]["runs"] == [] and by[k]["collapsed"] == "" for k in (1, 2, 3))
    words = by[4]["text"].split()
    # k * k modulo 20 has period 10
    assert [tuple(r) for r in by[4]["runs"]] == [(0, len(words), 10)] and by[4]["collapsed"].split() == words[:10]
    assert by[6]["collapsed"] == by[5]["collapsed"] and by[5]["kept"] == "clash"
    texts = spark.createDataFrame([(k, " ".join(f"w{i}" for i in range(30)), "clash") for k in (*range(60), None)], "doc_id long, text string, runs string")
    again = texts.withColumn("text", periodic_runs.with_repeats(F.col("text"), F.col("doc_id")))
    assert periodic_runs.collapse(again).columns == ["doc_id", "text", "runs", "n_words", "_runs", "collapsed"]
    import zlib

    for r in again.collect():
        words, h = [f"w{i}" for i in range(30)], zlib.crc32(str(r["doc_id"]).encode())
        if r["doc_id"] is not None and h % 10 == 0:
            g = h // 10
            a = g % 30
            p = 1 + (30 - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        assert r["text"].split() == words


def plain_removal(docs, window=13):
    """n_words, n_removed and the words left, by (id, text)."""
    first, inf = {}, float("inf")
    split = [(inf if k is None else k, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in docs]
    for k, w in split:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, inf), k)
    out = []
    for k, w in split:
        gone = {j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < k for j in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


@pytest.mark.parametrize("bits,large", [(27, 20_000), (6, 20_000), (27, 8), (8, 0)])
def test_removal_with_shared_bits_and_large_buckets(spark, bits, large):
    rng = random.Random(bits + large)
    pool = [[rng.choice("abcdefgh") for _ in range(rng.randint(5, 60))] for _ in range(12)]
    docs = []
    for k in range(120):
        words = sum((rng.choice(pool) if rng.random() < 0.5 else [f"x{rng.randint(0, 999)}" for _ in range(15)] for _ in range(rng.randint(0, 5))), [])
        docs.append((rng.choice([k, k, k, 7, None]), rng.choice([" ", "\n", " \t"]).join(words) if k % 17 else None))
    docs += docs[:5] + [(500, "a " * 400), (3, "a " * 90)]
    df = spark.createDataFrame([(k, d[0], d[1], "clash") for k, d in enumerate(docs)], "row int, doc_id long, text string, n_removed string").repartition(5)
    got = {r["row"]: (r["n_words"], r["_n_removed"], r["left"]) for r in substring_dedup.deduplicate(df, bits=bits, large=large).collect()}
    assert [got[k] for k in range(len(docs))] == plain_removal(docs)


def test_buckets_split_over_chunks():
    """Rows that come in many batches, cut between buckets only."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    rows = sorted((int(k % 9), k, " ".join(f"{x}{k % 9}" for x in rng.choice(list("ab"), 16))) for k in map(int, rng.permutation(400)))
    batches = [pa.RecordBatch.from_pydict({"bucket": [r[0] for r in part], "key": [r[1] for r in part], "hash": [0] * len(part), "at": pa.array([5] * len(part), pa.int32()), "words": [r[2].encode() for r in part]}) for part in (rows[k : k + 7] for k in range(0, 400, 7))]
    found = lambda size: sorted(tuple(r.values()) for b in substring_dedup._sorting(13, size)(iter(batches)) for r in b.to_pylist())
    assert found(1) == found(1 << 30) and len(found(1)) > 5


def test_removal_from_odd_documents(odd_docs, no_docs):
    rows = substring_dedup.deduplicate(odd_docs).collect()
    assert len(rows) == 12 and substring_dedup.deduplicate(no_docs).count() == 0
    got = sorted((str(r["doc_id"]), r["n_words"], r["_n_removed"]) for r in rows if r["n_words"] == 14)
    # both rows of id 5 keep the text; those of larger ids and of none lose it
    assert got == [("5", 14, 0), ("5", 14, 0), ("6", 14, 14), ("None", 14, 14)]
    assert {r["doc_id"]: r["_n_removed"] for r in rows}[4] == 0  # repeats within one document stay


def plain_phrases(docs, least, top=2000):
    count, total = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for size in (1, 2, 3, 4):
                count.update((lang, tuple(w[i : i + size])) for i in range(len(w) - size + 1))
    wanted = {k: a for k, a in count.items() if len(k[1]) > 1 and a >= least}
    covered = {(lang, w[i : i + n]) for (lang, w), f in wanted.items() for n in range(2, len(w)) for i in range(len(w) - n + 1) if 100 * f >= 80 * wanted[lang, w[i : i + n]]}
    out = []
    for (lang, w), a in wanted.items():
        if (lang, w) not in covered:
            score, k = min((2_000_000 * a // (count[lang, w[:k]] + count[lang, w[k:]]), k) for k in range(1, len(w)))
            out.append((lang, -score, -a, " ".join(w).encode(), count[lang, w[:k]], count[lang, w[k:]]))
    ranked, seen = [], Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(ranked)


@pytest.mark.parametrize("bits,words,hot,top", [(27, 2_000_000, 100_000, 2000), (6, 300, 1, 2000), (16, 1000, 50, 25)])
def test_phrases_against_plain_counts(spark, monkeypatch, bits, words, hot, top):
    monkeypatch.setattr(collocations, "HOT", hot)
    rng = random.Random(7)
    names = ["The", "of", "a", "Zoë", "É", "new", "york", "city", "|", "is"]
    docs = []
    for k in range(300):
        parts = [" ".join(rng.choices(names, weights=range(10, 0, -1), k=rng.randint(0, 9))) for _ in range(4)] + ["new york city is"] * (k % 3)
        docs.append((rng.choice(["en", "fr", None]), rng.choice([". ", "\n", " \t", ", "]).join(parts) if k % 29 else None))
    df = spark.createDataFrame([(*d, "clash") for d in docs], "lang string, text string, rank string").repartition(3)
    got = collocations.collocations(df, least=9, bits=bits, words=words, top=top)
    assert sorted(tuple(r) for r in got.collect()) == plain_phrases(docs, 9, top)
    assert collocations.collocations(df.limit(0), least=9).count() == 0


def test_phrases_of_odd_documents(odd_docs):
    got = {(r["lang"], r["phrase"]): (r["a"], r["l"], r["r"], r["n"]) for r in collocations.collocations(odd_docs).collect()}
    # 20 words in a period of 10: every phrase of four is as frequent as its parts
    assert all(len(p.split()) == 4 for _, p in got) and len(got) == 10 and set(n for *_, n in got.values()) == {60_000 + 3 * 14}


def test_blocks_hold_whole_texts():
    texts = [b"a b", None, b"", b" \x0b\x0c ", b"c d e f", b"g"]
    assert [(a, b, w, e.tolist()) for a, b, w, e in blocks(texts, 3)] == [(0, 4, [b"a", b"b"], [0, 2, 2, 2, 2]), (4, 5, [b"c", b"d", b"e", b"f"], [0, 4]), (5, 6, [b"g"], [0, 1])]
    assert list(blocks([], 3)) == []


def test_digests_of_the_query(spark, data):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    want = {k: (n, gone, hashlib.sha256(left.encode()).hexdigest()) for (k, _), (n, gone, left) in zip(docs, plain_removal(docs))}
    assert {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.query(spark, data).collect()} == want
