"""Mixing sources to target weights by temperature, with Spark expressions only.

A source's weight is its share of tokens to the power of an exponent between 0 (all alike) and 1 (as they are), normalised. The exponent is
bisected to meet a target. Weights become passes over each source: whole ones, and a last one that takes blocks of the source in a permuted order up to
the budget, and of the block at the edge the documents that come first by a hash. What is decided fits in a few numbers a source, so texts are not shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burnwatch.llm.staging import staged

#: Blocks of a source at most (a power of two), and documents of a block at least.
BLOCKS, BLOCK = 4096, 64
#: Sources whose numbers are broadcast at most; beyond it they are joined by shuffle.
BROADCAST_SOURCES = 50_000
#: Parts that an interval of exponents is cut into at a time, and how often.
PARTS, ROUNDS = 16, 9
#: The least exponent, at which all sources are alike, and the one that leaves them as they are.
LEAST, MOST = 0.0, 1.0


def tokens_of(text: Column) -> Column:
    """Words between white space, one at least."""
    return F.greatest(F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")), F.lit(1)).cast("long")


def share_table(rows: DataFrame) -> DataFrame:
    """(source, tokens, docs, share) of (source, tokens)."""
    sources = staged(rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")))
    total = sources.agg(F.sum("tokens")).first()[0] or 1
    return sources.withColumn("share", F.col("tokens") / F.lit(float(total)))


def exponent_for(shares: DataFrame, target_entropy: float | None, repetition_limit: float | None, sharpest: float = MOST) -> float:
    """The largest exponent whose weights have at least the entropy (in nats), or the smallest that repeats no source more than the limit times
    as often as any other; the nearest there is where none does."""
    # Relative to the largest share, so that some power is 1 whatever the exponent.
    largest = shares.agg(F.max("share")).first()[0] or 1.0
    relative = shares.select((F.col("share") / F.lit(largest)).alias("share"))
    low, high = LEAST, MOST if target_entropy is None else sharpest
    for _ in range(ROUNDS):
        step = (high - low) / PARTS
        tried = relative.select("share", F.explode(F.sequence(F.lit(0), F.lit(PARTS))).alias("i")).withColumn(
            "power", F.pow("share", F.lit(low) + F.col("i") * F.lit(step))
        )
        ratio = F.col("power") / F.col("share")
        facts = tried.groupBy("i").agg(
            # A power that is too small for a double adds nothing.
            (F.log(F.sum("power")) - F.coalesce(F.sum(F.when(F.col("power") > 0, F.col("power") * F.log("power"))), F.lit(0.0)) / F.sum("power")).alias("entropy"),
            F.try_divide(F.max(ratio), F.min(ratio)).alias("spread"),
        )
        found = {row["i"]: row for row in facts.collect()}
        if not found:
            return MOST
        if target_entropy is not None:
            # Entropy falls as the exponent grows.
            met = [i for i, row in found.items() if row["entropy"] >= target_entropy]
            at = max(met, default=0)
            low, high = low + at * step, low + min(at + 1, PARTS) * step
        else:
            met = [i for i, row in found.items() if row["spread"] <= repetition_limit]
            at = min(met, default=PARTS)
            low, high = low + max(at - 1, 0) * step, low + at * step
    return low if target_entropy is not None else high


def plan(rows: DataFrame, target_entropy: float | None, repetition_limit: float | None, budget: int | None, sharpest: float = MOST) -> DataFrame:
    """(source, passes, whole, left, blocks) of (source, tokens, order): how often each source is passed over, in how many whole passes,
    the tokens left for the last one, and the number of its blocks."""
    shares = share_table(rows)
    exponent = exponent_for(shares, target_entropy, repetition_limit, sharpest)
    largest = shares.agg(F.max("share")).first()[0] or 1.0
    power = F.pow(F.col("share") / F.lit(largest), F.lit(exponent))
    norm = shares.agg(F.sum(power).alias("sum"), F.max(F.try_divide("share", power)).alias("rarest"), F.sum("tokens").alias("tokens")).first()
    if norm["sum"] is None:
        return shares.select("source", *(F.lit(0).cast(t).alias(n) for n, t in (("passes", "double"), ("whole", "long"), ("left", "long"), ("blocks", "long"))))
    if budget is None and exponent > MOST:
        budget = norm["tokens"]
    tokens = budget if budget is not None else norm["rarest"] * norm["sum"] * norm["tokens"]
    # Without a budget the source that is repeated least is passed over once; a trifle covers rounding.
    passes = F.lit(float(tokens)) * power / F.lit(norm["sum"]) / F.col("tokens") + F.lit(1e-9)
    whole = F.floor(passes)
    blocks = F.pow(F.lit(2.0), F.least(F.lit(math.log2(BLOCKS)), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("docs") / BLOCK))))).cast("long")
    return staged(
        shares.select("source", passes.alias("passes"), whole.alias("whole"), F.floor((passes - whole) * F.col("tokens") + F.lit(1e-6)).alias("left"), blocks.alias("blocks"))
    )


def block_of(order: Column, blocks: Column) -> Column:
    return F.shiftrightunsigned(order, 20).bitwiseAND(blocks - 1)


def position(source: Column, block: Column, blocks: Column, turn: Column) -> Column:
    """Place of a block in the permutation of a pass: an odd multiple and a shift, which is one to one on a power of two."""
    odd = F.xxhash64(source, turn, F.lit("odd")).bitwiseAND(F.lit(2**20 - 1).cast("long")).bitwiseOR(F.lit(1).cast("long"))
    shift = F.xxhash64(source, turn, F.lit("shift")).bitwiseAND(F.lit(2**20 - 1).cast("long"))
    return (block * odd + shift).bitwiseAND(blocks - 1)


def edges(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """(source, edge, last): the place of the block in which the last pass ends, and the last order number that it takes there."""
    placed = _joined(rows, planned).withColumn("block", block_of(F.col("order"), F.col("blocks"))).withColumn(
        "place", position(F.col("source"), F.col("block"), F.col("blocks"), F.col("whole"))
    )
    sums = placed.groupBy("source", "place").agg(F.sum("tokens").alias("tokens"), F.max("left").alias("left"))
    by_place = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("before", F.coalesce(F.sum("tokens").over(by_place), F.lit(0)))
    edge = before.where("before + tokens > left").groupBy("source").agg(F.min(F.struct("place", "before")).alias("e"))
    edge = staged(edge.select("source", F.col("e.place").alias("edge"), F.col("e.before").alias("before")))
    inside = _joined(placed, edge).where("place = edge")
    # Equal order numbers stand or fall together, so the choice is a bound on the number.
    sums = inside.withColumn("upto", F.sum("tokens").over(Window.partitionBy("source").orderBy("order").rangeBetween(Window.unboundedPreceding, 0)))
    last = sums.where("before + upto <= left").groupBy("source").agg(F.max("order").alias("last"))
    return staged(edge.join(last, edge["source"].eqNullSafe(last["source"]), "left").select(edge["source"], "edge", "last"))


def _joined(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """Rows with the numbers of their source."""
    few = numbers.count() <= BROADCAST_SOURCES
    other = numbers.withColumnRenamed("source", "_source")
    out = rows.join(F.broadcast(other) if few else other, rows["source"].eqNullSafe(other["_source"]))
    return out.drop("_source")


def mix(
    docs: DataFrame, target_entropy: float | None = None, repetition_limit: float | None = 2.0, budget: int | None = None, seed: int = 0, sharpest: float = MOST
) -> DataFrame:
    """The rows of (doc_id, text, source, ...) as often as the mixture takes them, with `epoch` (from 0) and `turn` (0 to 1, where in the training order
    the row comes); columns of these names are replaced.

    Give either a target entropy of the weights, in nats, or a repetition limit: how often the most repeated source may be passed over for one pass of the least.
    An entropy under that of the sources as they are needs an exponent over 1: `sharpest` is the largest that is tried, and where even that leaves more entropy it is taken.
    The budget is in tokens (words); without one it is the least that passes over every source once, so every row is kept, or with an exponent over 1, where that
    would be a multiple of the corpus without bound, the corpus's own tokens. A budget that is smaller leaves rows out, and no source exceeds its part by a token. Equal rows of one source stand or fall together. Null sources are one source; null and
    empty texts count as one token; an empty table stays empty.
    """
    if (target_entropy is None) == (repetition_limit is None):
        raise ValueError("give either target_entropy or repetition_limit")
    columns = [c for c in docs.columns if c not in ("epoch", "turn")]
    source = docs.select(*columns).withColumn("_order", F.xxhash64("doc_id", "text", F.lit(seed)))
    rows = staged(source.select("source", F.col("_order").alias("order"), tokens_of(F.col("text")).alias("tokens")))
    planned = plan(rows, target_entropy, repetition_limit, budget, sharpest)
    ends = edges(rows, planned)
    numbers = planned.join(ends.withColumnRenamed("source", "_s"), planned["source"].eqNullSafe(F.col("_s")), "left").select(
        "source", *(F.col(c).alias(f"_{c}") for c in ("passes", "whole", "blocks", "edge", "last"))
    )
    taken = _joined(source, staged(numbers)).withColumn("_block", block_of(F.col("_order"), F.col("_blocks")))
    place = position(F.col("source"), F.col("_block"), F.col("_blocks"), F.col("_whole"))
    # Without an edge the last pass takes everything or, with nothing left, its first block is the edge and holds nothing.
    extra = (F.col("_edge").isNull()) | (place < F.col("_edge")) | ((place == F.col("_edge")) & F.coalesce(F.col("_order") <= F.col("_last"), F.lit(False)))
    copies = F.col("_whole") + F.when(extra, 1).otherwise(0)
    each = taken.withColumn("epoch", F.explode(F.when(copies > 0, F.sequence(F.lit(0).cast("long"), copies - 1))))
    at = position(F.col("source"), F.col("_block"), F.col("_blocks"), F.col("epoch"))
    turn = (F.col("epoch") + (at + 0.5) / F.col("_blocks")) / F.greatest(F.ceil("_passes"), F.lit(1))
    return each.withColumn("turn", turn).select(*columns, F.col("epoch").cast("int").alias("epoch"), "turn")
