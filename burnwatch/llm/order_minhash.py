"""Order MinHash fingerprints with Spark expressions only.

The k-mers of a text are its runs of k words, numbered where one occurs again, so that a repeated k-mer counts as often as it stands there. Hashes
of the numbered k-mers are dealt into bins by their first bits. From each bin the LENGTH smallest are taken, put back into text order, and hashed as a tuple:
a slot of the signature is equal for two texts when their smallest k-mers of the bin are the same and stand in the same order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burnwatch.llm.staging import staged

#: Words of a k-mer, bits of a bin's number, bits of a tuple's hash in the signature.
K, BIN_BITS, TUPLE_BITS = 5, 6, 25
#: Bits of a packed number that hold the place in the text; places from the last one on count as one.
PLACE_BITS = 24
WORD_BREAK = r"[\x20\x09-\x0D]+"


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """The frame with columns that are computed once, also where a lambda reads them for every element."""
    named = F.struct(*(c.alias(name) for name, c in columns.items()))
    wide = df.select("*", F.explode(F.array(named)).alias("_held"))
    return wide.select(*df.columns, *(f"_held.{name}" for name in columns))


def _packed(h: Column, place: Column) -> Column:
    last = F.lit(2**PLACE_BITS - 1)
    return F.shiftleft(F.shiftright(h, PLACE_BITS), PLACE_BITS).bitwiseOR(F.least(place.cast("long"), last.cast("long")))


def _kmer(packed: Column) -> Column:
    return F.shiftright(packed, PLACE_BITS)


def _place(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(2**PLACE_BITS - 1).cast("long"))


def _bin(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, 64 - BIN_BITS)


def _range(n: Column) -> Column:
    """0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _starts(array: Column, n: Column, of) -> Column:
    """Where runs of equal `of(element)` begin."""
    return F.filter(_range(n), lambda i: (i == 0) | (of(F.get(array, i)) != of(F.get(array, i - 1))))


def signatures(df: DataFrame, **texts: str) -> DataFrame:
    """The frame with an array of ints by each new name, the signature of the text column that it names.

    Null, empty and blank texts have an empty signature; a text of fewer than k words is one k-mer; equal texts have equal signatures.
    Very long texts are taken whole; k-mers from the 2^24th of a text on count as standing in one place, so their order among themselves is not told apart.
    """
    for name, text in texts.items():
        kept = [c for c in df.columns if c != name]
        words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), WORD_BREAK), lambda w: w != "")
        df = held(df.select(*kept), _h=F.transform(words, lambda w: F.xxhash64(w)))
        m = F.size("_h")
        width = F.least(m, F.lit(K))
        df = held(df, _kmers=F.transform(_range(F.when(m > 0, m - width + 1).otherwise(0)), lambda i: F.xxhash64(F.slice("_h", i + 1, width))))
        df = held(df.drop("_h"), _n=F.size("_kmers"), _sorted=F.when(
            F.size(F.array_distinct("_kmers")) < F.size("_kmers"), F.sort_array(F.transform("_kmers", _packed))
        ))
        # Where k-mers repeat: runs of one k-mer in the order of places, each element hashed with its number in the run.
        df = held(df, _runs=F.when(F.col("_sorted").isNotNull(), _starts(F.col("_sorted"), F.col("_n"), _kmer)))
        numbered = F.flatten(
            F.transform(
                "_runs",
                lambda begin, j: F.transform(
                    F.slice("_sorted", begin + 1, F.coalesce(F.get("_runs", j + 1), F.col("_n")) - begin),
                    lambda x, i: _packed(F.when(i == 0, F.shiftleft(_kmer(x), PLACE_BITS)).otherwise(F.xxhash64(_kmer(x), i)), _place(x)),
                ),
            )
        )
        df = held(df, _dealt=F.sort_array(F.coalesce(numbered, F.transform("_kmers", _packed))))
        df = held(df.drop("_kmers", "_sorted", "_runs"), _bins=_starts(F.col("_dealt"), F.col("_n"), _bin))

        def slot(i: Column) -> Column:
            a, b = F.get("_dealt", i), F.get("_dealt", i + 1)
            pair = F.coalesce(_bin(a) == _bin(b), F.lit(False))
            both = (
                F.when(pair & (_place(b) < _place(a)), F.xxhash64(_kmer(b), _kmer(a)))
                .when(pair, F.xxhash64(_kmer(a), _kmer(b)))
                .otherwise(F.xxhash64(_kmer(a)))
            )
            low = both.bitwiseAND(F.lit(2**TUPLE_BITS - 1).cast("long"))
            return F.shiftleft(_bin(a), TUPLE_BITS).bitwiseOR(low).cast("int")

        df = df.select(*kept, F.transform("_bins", slot).alias(name))
    return df


def fingerprint(signature: Column) -> Column:
    """A signature as text: eight hex digits a slot."""
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Equal slots over the slots of the longer signature, 0 to 1; two empty signatures are alike."""
    longer = F.greatest(F.size(a), F.size(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / longer)


def with_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, text, key, check): the two hashes stand for a row in joins; equal rows share them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("key"), F.hash(text, F.col("doc_id")).alias("check")
    )


def next_rows(keyed: DataFrame) -> DataFrame:
    """(doc_id, key, check, n, copies, next_key, next_check): each distinct row and the one after it by doc_id, the first after the last.

    Only ids and hashes move: ranges of ids are sorted apart, and the first rows of the ranges, one for each, tell what follows a range's last.
    """
    rows = keyed.groupBy("doc_id", "key", "check", F.char_length("text").alias("n")).agg(F.count("*").alias("copies"))
    ranged = staged(rows.repartitionByRange("doc_id", "key", "check").withColumn("part", F.spark_partition_id()))
    order = ["doc_id", "key", "check"]
    this = F.struct(*order)
    firsts = ranged.groupBy("part").agg(F.min(this).alias("first"))
    every = Window.orderBy("part")
    following = firsts.select("part", F.coalesce(F.lead("first").over(every), F.first("first").over(every)).alias("after"))
    within = ranged.withColumn("within", F.lead(this).over(Window.partitionBy("part").orderBy(*order)))
    return within.join(following, "part").select(
        "doc_id", "key", "check", "n", "copies", F.coalesce("within", "after").alias("next")
    ).select("doc_id", "key", "check", "n", "copies", F.col("next.key").alias("next_key"), F.col("next.check").alias("next_check"))


def against_next(docs: DataFrame) -> DataFrame:
    """One row per row of (doc_id, text): doc_id, n_chars, edited_sha256, signature, edited_signature, next_signature.

    The edited text has its last floor(n_chars / 2) characters replaced by as many first characters (or all) of the next document by doc_id; after the
    last comes the first. Null texts are empty. Equal rows count as one document in that order and have equal results; rows that share a doc_id but not a
    text follow each other by hash. A single document is its own next. Other columns are ignored.
    """
    nexts = staged(next_rows(with_keys(docs)))
    # Texts are shuffled once, with the same columns for both of their uses.
    texts = with_keys(docs).select("key", "check", "text").repartition("key", "check").dropDuplicates(["key", "check"])
    half = F.col("n") - F.floor(F.col("n") / 2)
    of_last = nexts.select(
        F.col("key").alias("of_key"), F.col("check").alias("of_check"), "n", F.col("next_key").alias("key"), F.col("next_check").alias("check")
    )
    heads = texts.join(of_last, ["key", "check"]).select(
        F.col("of_key").alias("key"), F.col("of_check").alias("check"), F.substr("text", F.lit(1), F.col("n") - half.cast("int")).alias("head")
    )
    whole = texts.join(nexts, ["key", "check"]).join(heads, ["key", "check"])
    edited = held(whole, edited=F.concat(F.substr("text", F.lit(1), half.cast("int")), F.col("head")))
    signed = signatures(edited, signature="text", edited_signature="edited")
    kept = staged(
        signed.select(
            "doc_id", "key", "check", "copies", "next_key", "next_check", F.col("n").cast("long").alias("n_chars"),
            F.sha2("edited", 256).alias("edited_sha256"), "signature", "edited_signature",
        )
    )
    of_next = kept.select(F.col("key").alias("next_key"), F.col("check").alias("next_check"), F.col("signature").alias("next_signature"))
    found = kept.join(of_next, ["next_key", "next_check"])
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        "doc_id", "n_chars", "edited_sha256", "signature", "edited_signature", "next_signature"
    )
