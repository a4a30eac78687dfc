"""Order MinHash against a plain form of its definition, hash by hash."""

from __future__ import annotations

import hashlib
import random
import re
import struct

import xxhash

from burnwatch.llm import order_minhash as om

MASK = 2**64 - 1


def signed(n):
    n &= MASK
    return n - 2**64 if n >> 63 else n


def hashed(*values):
    """Hash of values one after another, each seeded by the one before."""
    seed = 42
    for kind, value in values:
        raw = value.encode() if kind == "s" else struct.pack("<q" if kind == "l" else "<i", value)
        seed = xxhash.xxh64_intdigest(raw, seed=seed & MASK)
    return signed(seed)


def plain_signature(text):
    words = [hashed(("s", w)) for w in re.split(om.WORD_BREAK, text or "") if w]
    width = min(len(words), om.K)
    kmers = [hashed(*(("l", h) for h in words[i : i + width])) for i in range(len(words) - width + 1)] if words else []
    last = 2**om.PLACE_BITS - 1

    def packed(h, place):
        return (h >> om.PLACE_BITS << om.PLACE_BITS) | min(place, last)

    if len(set(kmers)) < len(kmers):
        seen: dict = {}
        found = []
        for place, h in enumerate(kmers):
            k = h >> om.PLACE_BITS
            i = seen[k] = seen.get(k, -1) + 1
            found.append(packed(signed(k << om.PLACE_BITS) if i == 0 else hashed(("l", k), ("i", i)), place))
    else:
        found = [packed(h, i) for i, h in enumerate(kmers)]
    bins: dict = {}
    for x in sorted(found):
        bins.setdefault((x & MASK) >> (64 - om.BIN_BITS), []).append(x)
    out = []
    for number, held in bins.items():
        two = sorted(held[:2], key=lambda x: x & last) if len(held) > 1 and held[0] & last != held[1] & last else held[:2]
        low = hashed(*(("l", x >> om.PLACE_BITS) for x in two)) & (2**om.TUPLE_BITS - 1)
        out.append(number << om.TUPLE_BITS | low)
    return out


def plain_likeness(a, b):
    return 1.0 if not a and not b else len(set(a) & set(b)) / max(len(a), len(b))


def texts(rng):
    words = [f"w{i}" for i in range(40)] + ["é", "中文", "x" * 50]
    draw = lambda n: " ".join(rng.choice(words) for _ in range(n))
    return [None, "", " \t", "one", "a b c d", "a b c d e", "same " * 300, "ab " * 7 + "cd\n" * 9] + [draw(rng.choice((3, 9, 60, 400))) for _ in range(25)]


def test_signatures_are_those_of_the_definition(spark):
    found = texts(random.Random(5))
    docs = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: list(r.s) for r in om.signatures(docs, s="text").collect()}
    for i, text in enumerate(found):
        assert got[i] == plain_signature(text), text


def test_edited_texts_and_likeness_over_all_documents(spark):
    found = texts(random.Random(6))
    rng = random.Random(7)
    ids = sorted(rng.sample(range(1000), len(found)))
    rows = list(zip(ids, found, strict=True))
    shuffled = rng.sample(rows, len(rows))
    docs = spark.createDataFrame(shuffled, "doc_id long, text string").repartition(3)
    result = om.against_next(docs).select(
        "doc_id", "n_chars", "edited_sha256", "signature", om.fingerprint("signature").alias("fingerprint"),
        om.likeness(om.F.col("signature"), om.F.col("edited_signature")).alias("near_edited"),
        om.likeness(om.F.col("signature"), om.F.col("next_signature")).alias("near_next"),
    )
    got = {r.doc_id: r for r in result.collect()}
    for n, (i, text) in enumerate(rows):
        text, after = text or "", rows[(n + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own = plain_signature(text)
        row = got[i]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert row.fingerprint == "".join(f"{x:08x}" for x in own)
        assert abs(row.near_edited - plain_likeness(own, plain_signature(edited))) < 1e-12
        assert abs(row.near_next - plain_likeness(own, plain_signature(after))) < 1e-12
