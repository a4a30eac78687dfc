"""Very long urls, texts and conversations."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from burnwatch.llm import chat, mixing, order_minhash, urls
from burnwatch.llm.queries import URL_RULES


def test_long_urls(spark):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = [
        (1, "http://example.net/en/" + "x/" * 300_000),
        (2, "http://" + "a." * 5_000 + "net/y"),
        (3, "http://" + "b" * 200_000 + ".org/fr/z?q"),
        (4, "n" * 500_000),
    ]
    found = {r.page_id: r for r in urls.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), rules).collect()}
    assert [(found[i].rule, found[i].verdict) for i in (1, 2, 3, 4)] == [
        ("example.net/en/", "allow"), ("net/", "block"), ("org/fr/", "allow"), (None, "allow"),
    ]
    assert len(found[1].path) == 600_004 and len(found[2].host) == 10_003


def test_a_conversation_of_many_turns(spark):
    rng = random.Random(3)
    rows = [(1, i, "user" if i % 2 else "assistant", "".join(rng.choices("ab<&|>\n é", k=60))) for i in range(2_000)]
    rows += [(2, 0, "assistant", "x<" * 300_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(4)
    found = chat.format_chats(turns).select(
        "conv_id", chat.read_chats(F.col("formatted")).alias("turns"), F.array_join(chat.under_mask(F.col("formatted"), F.col("loss_runs")), "").alias("learned")
    )
    for row in found.collect():
        own = [r for r in rows if r[0] == row.conv_id]
        assert [(t.role, t.text) for t in row.turns] == [r[2:] for r in own]
        assert row.learned == "".join(r[3] for r in own if r[2] == "assistant")


def test_long_texts_in_mixing_and_fingerprints(spark):
    long = "word " * 400_000
    docs = spark.createDataFrame([(1, long, "a"), (2, "x", "b"), (3, "w" * 2_000_000, "b"), (4, None, None)], "doc_id long, text string, source string")
    counts = {r.source: r["count"] for r in mixing.mix(docs, repetition_limit=2.0).groupBy("source").count().collect()}
    assert counts["a"] == 1 and set(counts) == {"a", "b", None}
    signed = {r.doc_id: r.n for r in order_minhash.signatures(docs, s="text").select("doc_id", F.size("s").alias("n")).collect()}
    assert signed[1] > 0 and signed[2] == signed[3] == 1 and signed[4] == 0
