import hashlib
import math
import os
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from helpers import rows_of, sql_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelforge.llm import bpe, chat, components, context_mixing, exact_dedup, language_id, line_dedup, mixing, ngram_join, quality, registry, token_counts

SPACE = " \t\n\x0b\x0c\r"


def split(text):
    return (text or "").encode().split()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, data, name):
    assert rows_of(registry.QUERIES[name](spark, data)) == sql_rows(duck, registry.ORACLE_SQL[name])


def texts_of(spark, data):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}


# 1 and 7: tokens


def test_bpe_equals_the_library_on_all_documents(spark, data, library):
    got = {r["doc_id"]: r for r in bpe.query(spark, data).collect()}
    counts = {r["doc_id"]: r for r in token_counts.query(spark, data).collect()}
    for key, text in texts_of(spark, data).items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[key]["n_tokens"] == len(ids) == counts[key]["n_tokens"]
        assert got[key]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[key]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert counts[key]["n_bytes"] == len((text or "").encode()) and counts[key]["over_limit"] == (len(ids) > 2048)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("abstredlvm' \n\t<|>endoftextΣςİ")), max_size=60))
def test_bpe_of_any_text(text):
    from tokenizers import Tokenizer

    lib = test_bpe_of_any_text.__dict__.setdefault("lib", Tokenizer.from_file(bpe.default_path()))
    own = bpe.loaded(bpe.default_path())
    ids = lib.encode(text, add_special_tokens=False).ids
    packed = own.encode([text])[0]
    assert packed == struct.pack(f"<{len(ids)}I", *ids)
    assert own.decode(packed) == lib.decode(ids, skip_special_tokens=False)


def test_only_failing_words_are_merged(monkeypatch):
    own = bpe.WordBpe(bpe.default_path())
    tokens, word_of = own._propose(["the", "hello"])
    assert word_of.tolist() == sorted(word_of.tolist()) and own.names[tokens[0]] == "the</w>"
    monkeypatch.setattr(own, "_merge_many", lambda words: pytest.fail(f"merged {words}"))
    assert own.encode(["the the hello"])[0] == own.cache["the"] * 2 + own.cache["hello"]


def test_cache_grows_by_misses_only(spark, tmp_path):
    cache = str(tmp_path / "cache")
    first = spark.createDataFrame([(1, "a b"), (2, "a  b"), (3, "c")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(first, cache).collect()} == {1: 2, 2: 2, 3: 1}
    assert spark.read.parquet(cache).count() == 2
    more = first.union(spark.createDataFrame([(4, "d e f")], "doc_id long, text string"))
    assert token_counts.count_tokens(more, cache).count() == 4 and spark.read.parquet(cache).count() == 3
    other = token_counts.count_tokens(first, cache, path=os.path.join(os.path.dirname(bpe.default_path()), "piece_bpe_32k.model"))
    assert other.count() == 3 and spark.read.parquet(cache).select("tokenizer").distinct().count() == 2


def test_the_query_hits_a_lasting_cache(spark, data, tmp_path, monkeypatch):
    spark.conf.set("panelforge.token_cache", str(tmp_path / "lasting"))
    try:
        first = sorted(map(tuple, token_counts.query(spark, data).collect()))
        rows = spark.read.parquet(str(tmp_path / "lasting")).count()
        monkeypatch.setattr(token_counts, "counter", lambda path: lambda text: F.raise_error(F.lit("encoded again")).cast("long"))
        assert sorted(map(tuple, token_counts.query(spark, data).collect())) == first
        assert spark.read.parquet(str(tmp_path / "lasting")).count() == rows
    finally:
        spark.conf.unset("panelforge.token_cache")


def test_the_kind_of_a_tokenizer_is_in_its_file(spark, tmp_path):
    import shutil

    folder = os.path.dirname(bpe.default_path())
    (tmp_path / "word_bpe").mkdir()
    renamed, other = str(tmp_path / "renamed.json"), str(tmp_path / "word_bpe" / "bytes.json")
    shutil.copy(bpe.default_path(), renamed)
    shutil.copy(os.path.join(folder, "byte_bpe_50k.json"), other)
    assert bpe.is_word_bpe(renamed) and not bpe.is_word_bpe(other) and not bpe.is_word_bpe(os.path.join(folder, "piece_bpe_32k.model"))
    from tokenizers import Tokenizer

    text = "Two  words\nand\t more"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    for path in (renamed, other):
        assert token_counts.count_tokens(df, str(tmp_path / "c"), path=path).first()["n_tokens"] == len(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)


# 2: quality


def test_quality_base_counts(spark, data):
    got = {r["doc_id"]: r for r in quality.query(spark, data).collect()}
    for key, text in texts_of(spark, data).items():
        words = split(text)
        windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        covered = {k + i for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for i in range(5)}
        lines = [x for x in (text or "").encode().split(b"\n") if x.split()]
        r = got[key]
        assert (r["n_words"], r["n_repeat_words"], r["n_dup_lines"]) == (len(words), len(covered), len(lines) - len(set(lines)))
        assert r["word_chars"] == sum(c not in SPACE for c in text or "") and r["n_symbols"] == sum(c in "#*$%&|<>" for c in text or "")
        assert r["base_failed"] == (len(words) < 10 or 100 * len(covered) > 20 * len(words))
        assert not (r["base_failed"] and r["kept"])


def test_quality_verdicts_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rated = quality.rate(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").where("NOT base_failed")
    share = {r["quality"]: r["s"] for r in rated.groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("s")).collect()}
    assert share[1] > 0.99 and share[0] < 0.1


# 3: lines


def test_lines_near_the_threshold_are_counted_exactly(spark):
    rows = [(k, f"shared by few sites\nown text {k}\nHome", f"s{k % 4}") for k in range(40)] + [(100 + k, f"shared by more sites\nbody number {k}\nLog in", f"s{k % 5}") for k in range(40)]
    rows += [(None, "Log in\nnameless", "s0"), (None, "only\nnameless", "s1")]
    got = line_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    out = {(r["doc_id"], r["source"]): (r["text"], r["n_removed"]) for r in got.collect()}
    assert out[3, "s3"] == ("shared by few sites\nown text 3\nHome", 0)
    # one-word lines count as well, and a null id is after all others
    assert out[100, "s0"] == ("shared by more sites\nbody number 0\nLog in", 0) and out[101, "s1"] == ("body number 1", 2)
    assert out[None, "s0"] == ("nameless", 1) and out[None, "s1"] == ("only\nnameless", 0)


# 4: mixing


def test_poisson_counts(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 9, "big").otherwise("small").alias("source"))
    got = {(r["source"]): (r["n"], r["docs"]) for r in mixing.mix(df).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs")).collect()}
    assert abs(got["big"][0] - 10_000) < 500 and abs(got["small"][0] - 10_000) < 500
    # a Poisson number with mean 5/9 is 0 with probability exp(-5/9)
    assert abs(got["big"][1] / 18_000 - (1 - math.exp(-5 / 9))) < 0.02
    few = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("x").alias("source"))
    assert abs(mixing.mix(few, size=30_000).count() - 30_000) < 1000
    only = mixing.mix(df, weights={"small": 1.0}, size=100)
    assert {r["source"] for r in only.select("source").distinct().collect()} == {"small"}


def test_mix_is_the_same_for_any_partitions(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("string").alias("source"))
    assert mixing.mix(df.repartition(1)).collect() == mixing.mix(df.repartition(7)).collect()


# 5: exact groups (with SQL); heavy hitters


def test_heavy_hitters_are_found_and_light_ones_stay_right(spark):
    texts = ["hot"] * 400 + ["warm  text", "warm\ttext"] * 100 + [f"t{k}" for k in range(500)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    digests = exact_dedup.with_digest(df)
    found = {r[0] for r in exact_dedup.frequent(digests, "text_sha256", 4).collect()}
    assert hashlib.sha256(b"hot").hexdigest() in found and len(found) <= 4
    out = exact_dedup.deduplicate(df, counters=4, least=100).collect()
    sizes = Counter(" ".join(t.split()) for t in texts)
    first = {}
    for k, t in enumerate(texts):
        first.setdefault(" ".join(t.split()), k)
    assert all(r["group_size"] == sizes[" ".join(texts[r["doc_id"]].split())] and r["keep_id"] == first[" ".join(texts[r["doc_id"]].split())] for r in out) and len(out) == len(texts)


# 6: language model


def test_scores(spark, data):
    got = {r["doc_id"]: r for r in context_mixing.query(spark, data).collect()}
    lower = bytes(range(256)).lower()
    docs = {k: [*(t or "").encode().translate(lower).split(), None] for k, t in texts_of(spark, data).items()}
    train = Counter(w for k, ws in docs.items() if zlib.crc32(str(k).encode()) % 7 != 2 for w in ws)
    n, v = sum(train.values()), len(train)
    for key, words in docs.items():
        r = got[key]
        assert r["held_out"] == (zlib.crc32(str(key).encode()) % 7 == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(w in train for w in words), n)
        assert abs(r["base_score"] - sum(math.log10((train[w] + 1) / (n + v + 1)) for w in words)) < 1e-6 * len(words)
        assert r["score"] < 0
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def lm_codes(bits=3, leaves=(4, 1, 0, 2)):
    return context_mixing.Codes(["a", "b", "c", "d"], [50, 20, 5, 1], 10, 7, bits, np.array(leaves))


def test_word_codes_are_a_complete_prefix_code():
    codes = lm_codes()
    places = np.arange(5 + 8)
    which, code, length = codes.of(places)
    assert sum(2.0 ** -int(n) for n in length) == 1 and (which == codes.escape).sum() == 8
    assert (np.diff(code.astype(object)) > 0).all()  # places follow the codes' order
    p, at = 1.0, codes.place["a"]
    for depth in range(int(length[at])):
        p /= 1 + math.exp(-codes.favour(codes.start[which[[at]]], code[[at]], depth)[0])
    assert abs(p - 50.5 / 96) < 1e-6


def test_node_counts_equal_brute_force():
    rng, codes = np.random.default_rng(2), lm_codes()
    events = sorted({(int(rng.integers(0, 4)) << 16 | int(rng.integers(0, 3)), int(rng.integers(0, 13))) for _ in range(100)})
    context, place = np.array([c for c, _ in events], np.uint64), np.array([p for _, p in events])
    n = rng.integers(0, 5, len(events))
    bits = ["".join(str(int(c) >> (63 - k) & 1) for k in range(int(size))) for c, size in zip(*codes.of(place)[1:], strict=True)]
    seen = 0
    for depth, at, one, one_next, two, two_next, _ in context_mixing.Events(codes, context, place, n).depths():
        for k, e in enumerate(at):
            def total(size, shift, e=e):
                return sum(int(n[j]) for j in range(len(events)) if context[j] >> np.uint64(shift) == context[e] >> np.uint64(shift) and bits[j][:size] == bits[e][:size])
            assert (one[k], one_next[k], two[k], two_next[k]) == (total(depth, 16), total(depth + 1, 16), total(depth, 0), total(depth + 1, 0))
            seen += 1
    assert seen == sum(map(len, bits))


def test_probabilities_of_a_context_sum_to_one():
    codes = lm_codes()
    context, place = np.repeat(np.array([5 << 16, 5 << 16 | 1], np.uint64), 13), np.tile(np.arange(13), 2)
    n = np.array([9, 0, 3, 0, 0, 1, 0, 0, 2, 0, 0, 0, 4] + [0] * 13)
    p = np.exp(context_mixing.range_scores(codes, context, place, n) / context_mixing._UNIT)
    assert np.abs(p.reshape(2, 13).sum(axis=1) - 1).max() < 1e-4


def test_scores_do_not_depend_on_partitions(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    one, other = ({r["doc_id"]: (r["score"], r["base_score"]) for r in context_mixing.score(docs.repartition(n), words=500, per_range=9000, cap=500).collect()} for n in (1, 7))
    assert one == other


def test_mixing_beats_its_codes_on_regular_text(spark):
    """Frequent words, then words without a code that always follow each other."""
    for words, texts in ((64, ["one two three four five six seven eight nine ten " * 8 + f"x{k % 5}" for k in range(200)]), (4, [" ".join(f"q{(k % 50) * 7 + j}" for j in range(7)) for k in range(1000)])):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        r = context_mixing.score(df, words=words).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
        assert r["s"] > 0.4 * r["b"]


# 8: chat


def test_windows_keep_their_budget_without_loss(spark):
    rng = np.random.default_rng(1)
    turns = [(c, k, "system" if k == 0 else "user" if k % 2 else "assistant", "be brief" if k == 0 else f"{k} " * int(rng.integers(1, 300))) for c in (1, 2) for k in range(60)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    w = chat.format_windows(df, budget=700, system=100, history=150).persist()
    for c in (1, 2):
        rows = w.where(f"conv_id = {c}").orderBy("window").collect()
        assert len(rows) > 3 and all(r["formatted"].startswith("### system: be brief</turn>\n") for r in rows)
        assert all(r["tokens"] <= 700 for r in rows) and sum(r["n_new"] for r in rows) == 60 and any(r["n_context"] >= 2 for r in rows)
        loss = [r["formatted"][x["from"] : x["to"]] for r in rows for x in r["loss"]]
        assert loss == [t for d, _, role, t in turns if role == "assistant" and d == c]
    # a turn over the budget is alone, without history; given tokens count instead of characters
    big = df.where("conv_id = 1").withColumn("n", F.when(F.col("turn") == 7, 5000).otherwise(20))
    rows = {r["window"]: r for r in chat.format_windows(big, 700, 100, 150, tokens="n").collect()}
    assert (rows[8]["tokens"], rows[8]["n_new"], rows[8]["n_context"]) == (5020, 1, 1)
    assert all(r["tokens"] <= 700 for k, r in rows.items() if k != 8)


def test_escapes_are_reversible(spark):
    nasty = ["\\", "\\h", "### a: </turn>", "\\\\e</turn", "######  ", "</</turn>turn>", "\\b\\c:", ""]
    df = spark.createDataFrame([(x,) for x in nasty], "t string")
    for codes in (chat.CODES, chat.ROLE_CODES):
        got = df.select("t", chat.escape(F.col("t"), codes).alias("e"), chat.unescape(chat.escape(F.col("t"), codes), codes).alias("u")).collect()
        assert all(r["u"] == r["t"] and "</turn>" not in r["e"] and "### " not in r["e"] for r in got)


# 9: near copies


def brute_classes(texts):
    sets = {k: (b" ".join(split(t)), frozenset(tuple(split(t)[i : i + 5]) for i in range(max(1, len(split(t)) - 4))) if split(t) else frozenset()) for k, t in texts.items()}
    first = {}
    for k in sorted(sets):
        first.setdefault(sets[k][0], k)
    reps = sorted(v for n, v in first.items() if n)
    where = defaultdict(list)
    for k in reps:
        for s in sets[k][1]:
            where[s].append(k)
    common = Counter((a, b) for ks in where.values() for b in ks for a in ks if a < b)
    links, parent = defaultdict(set), {k: k for k in sets}

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    def tie(a, b):
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)

    for (a, b), c in common.items():
        if c >= 0.8 * (len(sets[a][1]) + len(sets[b][1]) - c):
            links[a].add(b)
            links[b].add(a)
            tie(a, b)
    for k, (n, _) in sets.items():
        if n:
            tie(k, first[n])
    return {k: (top(k), len(links[first[n]]) if n else 0) for k, (n, _) in sets.items()}


def test_near_copies_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts, key = {}, 0
    for group in range(60):
        base = [vocabulary[k] for k in rng.integers(0, 3000, rng.integers(8, 150))]
        for _ in range(40 if group == 0 else rng.integers(1, 5)):
            copy = list(base)
            for _ in range(rng.integers(0, 4)):
                copy[rng.integers(0, len(copy))] = vocabulary[rng.integers(0, 3000)]
            texts[key] = " ".join(copy)
            key += 1
    texts |= {key: "", key + 1: None, key + 2: "a b c", key + 3: "a  b\tc"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    expected = brute_classes(texts)
    for block in (512, 8):  # 8: groups are cut into blocks, and sure links are counted
        got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.join(df, block=block).collect()}
        assert got == expected


def test_pruning_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(0)
    checks = ngram_join.least_matches(0.8, 1e-6)
    assert [n for n, _ in checks] == list(range(16, 129, 16)) and all(m <= n for n, m in checks)
    hits = rng.random((20_000, 128)) < 0.8
    kept = np.ones(len(hits), bool)
    for n, m in checks:
        kept &= hits[:, :n].sum(axis=1) >= m
    assert kept.mean() > 0.9999
    assert all((rng.random((2000, 128)) < 0.3)[:, :n].sum(axis=1).mean() < m + n for n, m in checks)


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


def test_unlike_hubs_do_not_part_like_texts(spark):
    """Only one bucket each, whose smallest node is like none of the others."""
    rng, rows = np.random.default_rng(3), []
    for k in range(60):
        sig = rng.integers(0, 256, 128, np.uint8)
        for copy in range(2 if k % 3 else 1):
            bands = [k % 2, *rng.integers(10, 1 << 60, 31).tolist()]
            rows.append((copy * 100 + k, bands, bytearray(sig.tobytes())))
    nodes = spark.createDataFrame(rows, "node long, bands array<bigint>, sig binary")
    planted = {(k, 100 + k) for k in range(60) if k % 3}
    for block, rounds in ((256, 8), (8, 0)):
        edges = ngram_join.candidate_edges(nodes, 0.8, 1e-6, block, rounds)
        assert {tuple(sorted((r["a"], r["b"]))) for r in edges.collect()} == planted


def test_ties_equal_pairs():
    """Row by row against what isn't tied yet gives the same components as all pairs."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 256, (6, 128), np.uint8)
    sig = np.array([np.where(rng.random(128) < 0.9, base[k % 6], rng.integers(0, 256, 128)) for k in range(90)], np.uint8)
    checks, own = ngram_join.least_matches(0.8, 1e-6), np.arange(90)
    for rows, columns in ((own, own), (own[:40], own[40:])):
        def parts(pairs):
            of = list(range(90))
            for a, b in zip(*map(list, pairs), strict=True):
                x, y = of[a], of[b]
                of = [min(x, y) if o in (x, y) else o for o in of]
            return of
        assert parts(ngram_join._ties(sig, rows, columns, checks)) == parts(ngram_join._pairs(sig, rows, columns, checks))


def test_recall_just_above_the_threshold(spark):
    """Pairs at similarities from 0.80 to 0.85 among unlike texts: at least 0.99 are found."""
    rng, rows, expected = np.random.default_rng(9), [], 0
    for k in range(300):
        words = [f"w{k}x{j}" for j in range(400)]
        other = list(words)
        for place in rng.choice(np.arange(10, 390, 12), rng.integers(6, 9), replace=False):
            other[place] = f"y{k}x{place}"
        a, b = ({tuple(t[j : j + 5]) for j in range(396)} for t in (words, other))
        assert 0.79 < len(a & b) / len(a | b) < 0.9
        expected += len(a & b) >= 0.8 * len(a | b)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    found = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).where("n_links = 1").count() / 2
    assert 0.99 * expected <= found <= expected


def test_near_copies_with_null_and_repeated_ids(spark):
    texts = [" ".join(f"{name}{j}" for j in range(60)) for name in "abc"]
    rows = [(None, texts[0]), (None, texts[0] + " end"), (1, texts[1]), (1, texts[2]), (2, texts[1] + " end"), (3, texts[2] + " end")]
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r["n_links"] for r in got] == [1] * 6


# 10: language


def test_languages_of_documents_and_pages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", F.col("lang").alias("true"))
    r = language_id.query(spark, data).join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("true")).cast("double")).alias("right"), F.avg(F.col("kept").cast("double")).alias("kept")).first()
    assert r["right"] > 0.98 and r["kept"] > 0.98
    pages = language_id.page_query(spark, data)
    assert pages.where("lang = said").count() >= 0.98 * pages.count()


def test_held_out_texts_are_identified(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs.where("doc_id % 2 = 0"))
    r = language_id.identify(docs.where("doc_id % 2 = 1"), model, host="source").agg(F.avg((F.col("lang_id") == F.col("lang")).cast("double")).alias("right")).first()
    assert r["right"] > 0.98
    noise = spark.createDataFrame([("qxzj wvkk zzqp xjq kkwz pqqx " * 4,), ("".join(chr(0x4E00 + 7 * k % 3000) for k in range(100)),)], "text string")
    assert [(r["lang_id"], r["lang_kept"]) for r in language_id.identify(noise, model).collect()] == [(None, False)] * 2


def test_posteriors_equal_brute_force(spark):
    """Text, declared language and host, domain and suffix priors, by plain Python."""
    rows = [("aaa bbb", "x"), ("ccc ddd", "y"), ("eee", "z")] * 20 + [("rare fff", "w")]
    model = language_id.fit(spark.createDataFrame(rows, "text string, lang string"), bins=1 << 10)
    assert model.languages == ["w", "x", "y", "z"]  # one row is enough
    asked = [(1, "", "x-XX", None), (2, "", None, None), (3, "a", None, "one.example.org"), (4, None, None, "two.other.net"), (5, "zq jk qq", None, "b.example.org"), (6, "aaa", "?", "host")]
    asked += [(10 + k, "ccc ddd", None, f"h{k % 2}.example.org") for k in range(9)] + [(30, "bbb ccc", "y", "H0.example.org"), (31, "rare fff", None, "c.org")]
    df = spark.createDataFrame(asked, "id int, text string, said string, host string").withColumn("lang_id", F.lit("clash"))
    got = {r["id"]: r for r in language_id.identify(df, model, host="host", declared="said").collect()}
    n, unknown, strength = 4, 1e-3, 5.0
    shares = [p * (1 - unknown) for p in model.shares] + [unknown]

    def logs(text):
        out = np.zeros(n + 1)
        for _, _, bins, _ in language_id._trigrams([text], 1 << 10):
            out[:n] += model.table[bins].sum(axis=0, dtype=float)
            out[n] -= len(bins) * np.log(1 << 10)
        return out / 3

    def share(values):
        e = np.exp(np.array(values) - max(values))
        return e / e.sum()

    own = {k: share(logs(t) + np.log(shares)) for k, t, _, _ in asked}
    ends = lambda host: [host, ".".join(host.split(".")[-2:]) if "." in host else "", host.split(".")[-1] if "." in host else ""]
    for key, text, said, host in asked:
        prior = np.array(shares)
        if host:
            for level in (2, 1, 0):
                members = [k for k, _, _, h in asked if h and k != key and ends(h.lower())[level] == ends(host.lower())[level]]
                counts = sum((own[k] for k in members), np.zeros(n + 1))
                prior = (counts + strength * prior) / (counts.sum() + strength)
        total = logs(text) + np.log(prior)
        named = (said or "").split("-")[0] in model.languages
        if named:
            total += [np.log(0.9) if x == said.split("-")[0] else np.log(0.1 / n) for x in [*model.languages, ""]]
        r, p = got[key], share(total)
        if not np.abs(logs(text)).sum() and not named:
            assert r["_lang_id"] is None and r["lang_p"] is None and not r["lang_kept"]
            continue
        assert abs(r["lang_p"] - p[:n].max()) < 1e-5 and r["lang_kept"] == (p[:n].max() > 0.5)
        assert r["_lang_id"] == (model.languages[int(p[:n].argmax())] if p[:n].max() >= p[n] else None)
    assert got[30]["_lang_id"] == "y"
    assert len(language_id.fit(spark.createDataFrame(rows, "text string, lang string"), most_bytes=40_000).table) == 2048


def test_stored_tables_can_be_removed(spark):
    from panelforge.llm import common

    made = dict(common._MADE)
    common._MADE.clear()
    kept = common.stored(spark.range(3))
    path = common._MADE[spark.sparkContext.applicationId][0]
    assert kept.count() == 3 and common.remove_stored(spark) == 1 and not os.path.exists(path.removeprefix("file:").replace("//", "/"))
    common._MADE.update(made)


def test_held_out_texts_change_no_score_of_training_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    whole = {r["doc_id"]: (r["score"], r["base_score"], r["n_known"]) for r in context_mixing.score(docs).collect() if not r["held_out"]}
    trained = docs.where("crc32(cast(cast(doc_id as string) as binary)) % 7 != 2")
    alone = {r["doc_id"]: (r["score"], r["base_score"], r["n_known"]) for r in context_mixing.score(trained).collect()}
    assert whole == alone and len(alone) > 800
