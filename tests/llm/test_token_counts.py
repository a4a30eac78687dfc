"""Token counts against the library they stand for."""

from __future__ import annotations

import json
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from burnwatch.llm import token_counts
from burnwatch.llm.queries import merges, op11_token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = [
    "", " ", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext|", "  <|endoftext|>  x", "<|ENDOFTEXT|>",
    "I'll we've x's 'S it'd", "\x1c\x1d \x85\xa0 　 x", "İstanbul ½٣Ⅻ", "🙂‍\U0001f468‍\U0001f469".encode("utf-16", "surrogatepass").decode("utf-16"),
    "\U0001fae8 ՘ \U000323b0 \U0003d000x", "\x00\x00a", "aaaa" * 3, "ab" * 3000, "a" * 9001, " " * 5000, "中文" * 3000, "\n\n\n  \t x",
]


def library(texts):
    return [len(x.ids) for x in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_odd_texts_count_as_in_the_library():
    assert token_counts.Counter(merges()).count(ODD) == library(ODD)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("ab t'sh<|endoftext|>\n 1"))), max_size=6))
def test_any_texts_count_as_in_the_library(texts):
    assert token_counts.Counter(merges()).count(texts) == library(texts)


def test_long_words_and_short_ones_count_alike_by_both_ways():
    rng = random.Random(3)
    words = ["".join(rng.choice(a) for _ in range(rng.randint(1, 300))).encode() for a in ("ab", "aaab", "etaoin shrdlu", "éa中") for _ in range(40)]
    assert merges().left_of(words).tolist() == [merges().left_of_long(w) for w in words]


def test_a_text_of_one_word_of_a_million_letters():
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    assert token_counts.Counter(merges()).count([text, text + " " + text]) == library([text, text + " " + text])


def test_lists_of_pre_tokens_and_memory_are_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "AT_A_TIME", 16)
    monkeypatch.setattr(token_counts, "TOGETHER", 8)
    monkeypatch.setattr(token_counts, "MEMO", 5)
    texts = ["the quick brown fox jumps over the lazy dog " * 5, "", "x", "the the the", "a<|endoftext|>bb cc dd ee ff gg"]
    counter = token_counts.Counter(merges())
    assert counter.count(texts) == library(texts)
    assert counter.count(texts) == library(texts)


def test_rows_of_every_kind(spark):
    rows = [(1, "the end", 9, "x"), (1, "the end", 9, "x"), (2, None, None, None), (None, "", 0, None), (3, "a<|endoftext|>", 1, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, merges string").repartition(2)
    got = token_counts.count_tokens(docs, merges())
    assert got.columns == ["doc_id", "merges", "n_tokens"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "x", 2), (1, "x", 2), (2, None, 0), (None, None, 0), (3, "y", 2)], key=repr)
    assert token_counts.count_tokens(docs.limit(0), merges()).count() == 0


def test_registered_query_over_whole_texts(spark):
    path = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    want = dict(zip(texts, library(list(texts.values())), strict=True))
    for row in op11_token_counts(spark, path).collect():
        n = want[row["doc_id"]]
        assert (row["n_bytes"], row["n_tokens"], row["over_limit"]) == (len(texts[row["doc_id"]].encode()), n, n > 512)


def _file(tmp_path, **changes):
    with open(PATH, encoding="utf-8") as f:
        whole = json.load(f)
    whole["model"] |= changes
    out = tmp_path / "t.json"
    out.write_text(json.dumps(whole))
    return str(out)


def test_files_for_which_joining_at_once_would_differ_are_refused(tmp_path):
    letters = list(token_counts.byte_letters())
    vocab = {x: i for i, x in enumerate(letters)} | {"ab": 256, "abc": 257, "bc": 258}
    ok = token_counts.Merges.read(_file(tmp_path, vocab=vocab, merges=[["a", "b"], ["ab", "c"]]))
    assert ok.left_of([b"abcab", b"c"]).tolist() == [2, 1]
    for bad in ([["ab", "c"], ["a", "b"]], [["a", "b"], ["b", "c"], ["ab", "c"], ["a", "bc"]]):
        with pytest.raises(ValueError, match="join before|another merge"):
            token_counts.Merges.read(_file(tmp_path, vocab=vocab, merges=bad))
    with pytest.raises(ValueError, match="not a plain"):
        token_counts.Merges.read(_file(tmp_path, dropout=0.1))
    with pytest.raises(ValueError, match="no entry"):
        token_counts.Merges.read(_file(tmp_path, vocab={"a": 0}, merges=[]))
    none = token_counts.Merges.read(_file(tmp_path, vocab=vocab, merges=[]))
    assert none.left_of([b"abc"]).tolist() == [3] and none.left_of_long(b"abc") == 3


def test_nothing_is_counted_twice_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        docs = spark.range(50).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("word"), F.col("id").cast("string")).alias("text"))
        got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, merges()).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [got[i] for i in range(50)] == library([f"word {i}" for i in range(50)])
