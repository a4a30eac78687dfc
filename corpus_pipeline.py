"""A corpus pipeline: from raw documents to token ids, one operator a stage.

Each stage takes all rows that the one before it kept; what it decides takes effect in its rows. Its result is written as Parquet and read again as the documents of
the next one, so that a stage's work is done once and a lost executor costs a re-read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burnwatch.llm import bpe, mixing, ngram_join, suffix_dedup, toxicity
from burnwatch.llm.queries import bpe_vocabulary
from burnwatch.llm.staging import drop_staged, staged

#: Ids of dropped documents that are broadcast at most; beyond it they are joined by shuffle.
BROADCAST_IDS = 1_000_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that are predicted to be toxic."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs.withColumnsRenamed({"score": "_score", "predicted": "_predicted"}), model, evidence=False)
    kept = scored.where("predicted = 0").drop("score", "predicted")
    return kept.withColumnsRenamed({"_score": "score", "_predicted": "predicted"}).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 80 percent) the document with the smallest doc_id, a null one last; of equal rows, one."""
    found = staged(ngram_join.near_duplicates(docs, size=5, percent=80))
    if not found.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        return _keep_one_by_text(docs)
    dropped = found.where("component_id <> doc_id").select("doc_id").distinct()
    few = dropped.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    kept = docs.join(F.broadcast(dropped) if few else dropped, "doc_id", "left_anti")
    return kept.select(*docs.columns)


def _keep_one_by_text(docs: DataFrame) -> DataFrame:
    """The same where ids repeat or are null: each distinct (doc_id, text) has its own key, and texts without words all stay."""
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    found = ngram_join.near_duplicates(keyed.select(F.col("_key").alias("doc_id"), "text"), size=5, percent=80).where("n_shingles > 0")
    members = staged(found.select(F.col("doc_id").alias("_key"), "component_id").distinct())
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key"))["_key"]
    ids = keyed.select("_key", "doc_id").distinct()
    first = staged(members.join(ids, "_key").groupBy("component_id").agg(smallest.alias("_key")).select("_key"))
    kept = keyed.join(first, "_key", "left_semi").dropDuplicates(["_key"])
    wordless = keyed.join(members, "_key", "left_anti")
    return kept.select(*docs.columns).unionByName(wordless.select(*docs.columns))


def _apart(docs: DataFrame, *own: str) -> tuple[DataFrame, dict[str, str]]:
    """The columns that an operator has no use for under names that meet none of its own, and the way back."""
    names = {c: f"_kept_{i}" for i, c in enumerate(docs.columns) if c not in own}
    return docs.withColumnsRenamed(names), {new: old for old, new in names.items()}


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes that stand more than once; `n_chars` follows the text. No row is dropped."""
    apart, back = _apart(docs, "doc_id", "text")
    rest = tuple(c for c in apart.columns if c != "text")
    cut = suffix_dedup.remove_repeats(apart, window=200, carry=rest, as_text=True).withColumnRenamed("kept", "text").select(*apart.columns)
    cut = cut.withColumnsRenamed(back)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, those of small sources up to twice, so that sources are as even as that allows."""
    apart, back = _apart(docs, "doc_id", "text", "source")
    return mixing.mix(apart, repetition_limit=2.0).select(*apart.columns).withColumnsRenamed(back).select(*docs.columns)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and whether they decode to its text."""
    # The digest goes along instead of the text, which would travel through the workers and back.
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest")
    found = bpe.round_trip(docs.select("doc_id", "source", digest, "text"), bpe_vocabulary())
    same = F.sha2("decoded", 256) == F.col("digest")
    return found.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("source mixing", mix_sources),
    ("byte-level BPE", to_tokens),
]

#: SQL cannot express the stages; `tests/llm/test_pipeline_stages.py` holds each against a plain form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, staged(stage(spark, docs, sf_dir))
        drop_staged(before)  # leaves the given table, which is none of its own
    return STAGES[-1][1](spark, docs, sf_dir)
