"""URL filter: host suffixes times path prefixes, joined on short hash prefixes and confirmed by full digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits of the digest that the join uses.
SHORT = 8


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty for null or without `://`."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    """Of a host and a path; no host holds the slash that stands between them."""
    return F.sha2(F.concat(host, F.lit("/"), path), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row per input row: key, host, path, rule, verdict.

    `rules` has (host, path, verdict). A rule fits its host and all subdomains when the path starts with the rule's path. Of the
    rules that fit, the longest (host and path together) wins, then the longer host, then `block` over `allow`. Without one the
    verdict is `default` and the rule null. Rules with a null or empty host fit nothing; repeated rules count once.

    Null urls and urls without `://` have empty hosts and paths and fit no rule. Repeated rows, also under one key, are judged each;
    other columns are ignored. Urls may be of any length; one has as many expressions as suffixes of its host times beginnings of its path, and only those as long as some rule count. Work is done per distinct (host, path), so a url that many rows share is expanded once.
    """
    rules = (
        rules.select("host", F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .where("host <> ''")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))  # `block` sorts after `allow`
        .select(
            F.concat("host", "path").alias("rule"),
            "verdict",
            F.char_length("host").alias("host_chars"),
            (F.char_length("host") + F.char_length("path")).alias("chars"),
            F.char_length("path").alias("path_chars"),
            F.array_size(F.split("host", r"\.")).alias("labels"),
            _digest(F.col("host"), F.col("path")).alias("digest"),
        )
    )
    # Only prefixes as long as some rule's path, and suffixes of as many labels as some rule's host, can be equal to a rule's: two short
    # lists, since a url has at most a few thousand characters.
    shapes = rules.agg(
        F.sort_array(F.collect_set("path_chars")).alias("lengths"), F.sort_array(F.collect_set("labels")).alias("labels")
    ).first()
    lengths, labels = (F.lit(x).cast("array<int>") for x in (shapes["lengths"], shapes["labels"]))

    places = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    distinct = places.where("host <> ''").select("host", "path").distinct()
    names = F.split("host", r"\.")
    suffixes = F.transform(
        F.filter(labels, lambda n: n <= F.array_size(names)),
        lambda n: F.array_join(F.slice(names, F.array_size(names) - n + 1, n), "."),
    )
    prefixes = F.transform(
        F.filter(lengths, lambda n: n <= F.char_length("path")), lambda n: F.substr(F.col("path"), F.lit(1), n)
    )
    expressions = (
        distinct.select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
        .select("host", "path", "suffix", F.explode("prefixes").alias("prefix"))
        .select("host", "path", _digest(F.col("suffix"), F.col("prefix")).alias("digest"))
        .withColumn("short", F.substring("digest", 1, SHORT))
    )
    found = (
        expressions.join(rules.withColumn("short", F.substring("digest", 1, SHORT)).withColumnRenamed("digest", "full"), "short")
        .where(F.col("digest") == F.col("full"))
        .groupBy("host", "path")
        .agg(F.max(F.struct("chars", "host_chars", "verdict", "rule")).alias("best"))
        .select("host", "path", "best.rule", "best.verdict")
    )
    return places.join(found, ["host", "path"], "left").select(
        F.col("key").alias(key), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )
