"""The registered queries: each operator with its production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burnwatch.llm import bpe, chat, hard_negatives, html_text, lexical, mixing, ngram_join, order_minhash, suffix_dedup, token_counts, toxicity, urls, vectors

#: Host, path and verdict of each rule.
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
#: A conversation whose texts look like marks of other templates.
CHAT_PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
BPE_RANKS = "byte_bpe_multi_50k.tiktoken"
#: The file whose tokens are counted, and the count over which a text is long.
COUNTED, TOKEN_LIMIT = "byte_bpe_50k.json", 512


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence"
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, repetition_limit=2.0).select("doc_id", "source", "epoch", "turn")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge_urls(_table(spark, sf_dir, "pages"), rules)


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), window=200).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = order_minhash.against_next(_table(spark, sf_dir, "documents"))
    signature, edited = F.col("signature"), F.col("edited_signature")
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        order_minhash.fingerprint(signature).alias("fingerprint"),
        order_minhash.fingerprint(edited).alias("edited_fingerprint"),
        order_minhash.likeness(signature, edited).alias("near_edited"),
        order_minhash.likeness(signature, F.col("next_signature")).alias("near_next"),
    )


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"), size=4, percent=85)


@cache
def bpe_vocabulary() -> bpe.Vocabulary:
    import public_tokenizers

    return bpe.Vocabulary.read(public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)


def bpe_digests(texts: DataFrame) -> DataFrame:
    """(doc_id, text) encoded and decoded; digests of both."""
    return bpe.round_trip(texts.select("doc_id", "text"), bpe_vocabulary()).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(_table(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    chats = chat.format_chats(rows.unionByName(spark.createDataFrame(CHAT_PROBE, rows.schema)))
    read = chats.select(
        "conv_id",
        chat.read_chats(F.col("formatted")).alias("turns"),
        F.array_join(chat.under_mask(F.col("formatted"), F.col("loss_runs")), "").alias("learned"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
    lines = F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
    )


@cache
def merges() -> token_counts.Merges:
    import public_tokenizers

    return token_counts.Merges.read(public_tokenizers.path(COUNTED))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    docs = _table(spark, sf_dir, "documents").select("doc_id", n_bytes, "text")
    return token_counts.count_tokens(docs, merges()).withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=20)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = _table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0, positives=5, negatives=5, low=80, high=100, scale=256)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_mixing": op2_mixing,
    "op3_url_filter": op3_url_filter,
    "op4_main_text": op4_main_text,
    "op5_top_k": op5_top_k,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_order_minhash": op7_order_minhash,
    "op8_ngram_join": op8_ngram_join,
    "op9_bpe": op9_bpe,
    "op10_chat": op10_chat,
    "op11_token_counts": op11_token_counts,
    "op12_lexical": op12_lexical,
    "op13_hard_negatives": op13_hard_negatives,
}
