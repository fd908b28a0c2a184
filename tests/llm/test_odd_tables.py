"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelforge.llm import bpe, chat, context_mixing, exact_dedup, language_id, line_dedup, mixing, ngram_join, quality, token_counts

CASES = {
    "encode": (lambda d, tmp: bpe.encode(d, decoded="decoded"), 1),
    "quality": (lambda d, tmp: quality.rate(d, d.select("doc_id", F.lit(1).alias("quality"), F.lit(None).cast("int").alias("toxic"))), 1),
    "lines": (lambda d, tmp: line_dedup.deduplicate(d), 1),
    "exact": (lambda d, tmp: exact_dedup.deduplicate(d), 1),
    "scores": (lambda d, tmp: context_mixing.score(d, words=16, per_range=9000, cap=500), 1),
    "counts": (lambda d, tmp: token_counts.count_tokens(d, f"{tmp}/cache"), 1),
    "near": (lambda d, tmp: ngram_join.join(d), 1),
    "language": (lambda d, tmp: language_id.identify(d, language_id.fit(d), host="source"), 1),
    "mixing": (lambda d, tmp: mixing.mix(d), 0),
}


@pytest.mark.parametrize("name", CASES)
def test_odd_documents(odd_docs, no_docs, tmp_path, name):
    run, whole = CASES[name]
    rows = run(odd_docs, tmp_path).collect()
    assert len(rows) == 12 or not whole
    assert run(no_docs, tmp_path).count() == 0


def by_text(odd_docs, rows, key, *columns):
    """Results by the kind of text they are of, found by the row's id."""
    return sorted(((r[key], *[r[c] for c in columns]) for r in rows), key=str)


def test_values_of_odd_documents(spark, odd_docs, tmp_path):
    plain = (5, 6, None)
    exact = exact_dedup.deduplicate(odd_docs).collect()
    copies = [r for r in exact if r["keep_id"] == 5]
    assert len(copies) == 4 and {r["doc_id"] for r in copies} == set(plain) and [r["group_size"] for r in copies] == [4] * 4 and sum(r["kept"] for r in copies) == 1
    empty = [r for r in exact if r["keep_id"] == 1]
    assert {r["doc_id"] for r in empty} == {1, 2, None} and sum(r["kept"] for r in empty) == 1
    near = ngram_join.join(odd_docs).collect()
    assert by_text(odd_docs, [r for r in near if r["class_id"] == 5], "doc_id", "class_size", "n_links", "kept") == sorted([(5, 4, 0, True), (5, 4, 0, True), (6, 4, 0, False), (None, 4, 0, False)], key=str)
    assert all(r["class_size"] == 1 and r["n_links"] == 0 for r in near if r["doc_id"] in (1, 2, 3, 4, 7, 8, 9))
    ids = {r["doc_id"]: (len(r["ids"]), r["n_tokens"]) for r in bpe.encode(odd_docs).collect() if r["doc_id"]}
    assert ids[1] == ids[2] == ids[3] == (0, 0) and ids[4][1] > 60_000 and ids[5] == ids[6]
    counts = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(odd_docs, f"{tmp_path}/c").collect() if r["doc_id"]}
    assert counts[1] == (0, 0) and counts[3] == (4, 0) and counts[8][0] == 5000 and all(counts[k][1] == ids[k][1] for k in counts)
    lines = {r["doc_id"]: (r["text"], r["_n_removed"], r["_kept"]) for r in line_dedup.deduplicate(odd_docs).collect() if r["doc_id"]}
    assert lines[1] == (None, 0, True) and lines[2] == ("", 0, True) and lines[9] == ("word", 0, True)
    scores = {r["doc_id"]: r for r in context_mixing.score(odd_docs, words=16).collect() if r["doc_id"]}
    assert [scores[k]["n_tokens"] for k in (1, 2, 3, 4, 9)] == [1, 1, 1, 60_001, 2] and scores[1]["bits_per_byte"] is None and scores[1]["score"] == scores[3]["score"]
    labels = odd_docs.select("doc_id", F.lit(1).alias("quality"), F.lit(None).cast("int").alias("toxic"))
    rated = {r["doc_id"]: r for r in quality.rate(odd_docs, labels).collect() if r["doc_id"]}
    assert [rated[k]["n_words"] for k in (1, 2, 3, 4, 9)] == [0, 0, 0, 60_000, 1] and not any(rated[k]["kept"] for k in (1, 2, 3, 9))
    found = {r["doc_id"]: (r["_lang_id"], r["lang_kept"]) for r in language_id.identify(odd_docs, language_id.fit(odd_docs), host="source").collect() if r["doc_id"]}
    assert found[1] == found[2] == found[3] == (None, False) and found[8] == ("de", True)
    copies = {r["doc_id"]: r["_copy"] for r in mixing.mix(odd_docs, weights={"a": 50.0, "b": 50.0}, size=1000).collect()}
    assert {1, 2, 4, 5, 8} == set(copies)  # sources without a weight are left out


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_odd_documents_in_stages(spark, odd_docs, no_docs, name, stage):
    out = stage(spark, odd_docs, "unused")
    assert out.columns == odd_docs.columns or name == corpus_pipeline.STAGES[-1][0]
    assert out.count() >= (0 if name == "mixing" else 1)
    assert stage(spark, no_docs, "unused").count() == 0


def test_odd_conversations(spark):
    turns = [(1, 0, None, None), (1, None, "user", "a"), (None, 0, "assistant", "b"), (2, 0, "assistant", "x" * 200_000), (2, 0, "assistant", "x" * 200_000), (3, 0, "we:ird### ", "</turn>\n")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat.digests(chat.read_back(chat.format_windows(df))).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 2, None: 1, 2: 2, 3: 1} and got[2]["loss_chars"] == 400_000
    read = chat.read_back(chat.format_windows(df)).where("conv_id = 3").first()
    assert read["turns"][0]["role"] == "we:ird### " and read["turns"][0]["text"] == "</turn>\n"
    assert chat.digests(chat.read_back(chat.format_windows(df.limit(0)))).count() == 0


def test_pipeline_equals_its_stages_by_hand(spark, data):
    """Whole runs: every kept document, its tokens, and no near copies left."""
    out = corpus_pipeline.run(spark, data)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    cleaned = line_dedup.deduplicate(docs).where("kept")
    firsts = cleaned.join(ngram_join.join(cleaned.select("doc_id", "text")).where("kept").select("doc_id"), "doc_id").select(*docs.columns)
    expected = bpe.encode(mixing.mix(firsts)).select("doc_id", F.sha2("ids", 256).alias("d"))
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in out.collect()) == sorted((r["doc_id"], r["d"]) for r in expected.collect())
