"""Ranked lexical search against a plain form of its definition."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from burnwatch.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [x.translate(LOWER) for x in TERM.findall(text or "")]


def plain(docs, items, k=20):
    """Every item against every document."""
    held = [(i, words(t)) for i, t in docs]
    held = [(i, len(w), Counter(w)) for i, w in held if w]
    n_docs, n_terms = len(held), sum(n for _, n, _ in held)
    df = Counter(t for _, _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, n, c in held:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            weight = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
            score = sum(weight(t) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in words(text) if t in c)
            if score > 0 and i is not None:
                found.append((-score, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def frames(spark, docs, items):
    return (
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
        spark.createDataFrame(items, "item_id long, text string"),
    )


def ranked(spark, docs, items, k=20):
    return sorted(map(tuple, lexical.rank(*frames(spark, docs, items), k).collect()), key=repr)


def made(rng, n_docs, n_words=400):
    vocabulary = ["".join(rng.choice("abcé中") for _ in range(rng.randint(1, 4))) for _ in range(n_words)]
    draw = lambda n: " ".join(rng.choice(vocabulary[: rng.choice((10, 60, n_words))]) for _ in range(n))
    docs = [(i, draw(rng.choice((1, 3, 20, 80)))) for i in range(n_docs)]
    return docs, draw


def test_equal_to_every_pair(spark, monkeypatch):
    rng = random.Random(11)
    docs, draw = made(rng, 1500)
    docs += [(2000 + i, docs[7][1]) for i in range(60)]
    items = [(i, draw(12)) for i in range(15)] + [(90, docs[7][1]), (91, docs[30][1] * 3)]
    want = plain(docs, items)
    monkeypatch.setattr(lexical, "BUCKET", 64)
    assert ranked(spark, docs, items) == want


def test_items_in_several_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(12)
    docs, draw = made(rng, 120)
    items = [(i, draw(8)) for i in range(9)]
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 20)
    assert ranked(spark, docs, items, 3) == plain(docs, items, 3)


def test_nulls_blanks_ties_and_repeats(spark):
    docs = [(5, "Tie one"), (3, "tie ONE"), (3, "tie one"), (None, "tie one"), (9, None), (10, ""), (11, " .;\n"), (12, "É é"), (13, "other")]
    items = [(1, "tie"), (2, None), (3, "..."), (None, "other"), (4, "É"), (5, "unknown"), (6, "one one TIE")]
    want = plain(docs, items)
    assert ranked(spark, docs, items) == want
    assert [r[:3] for r in want if r[0] == 1] == [(1, 1, 3), (1, 2, 3), (1, 3, 5)]


def test_of_several_rows_of_one_item_the_least_text_asks(spark):
    docs = [(1, "a"), (2, "b"), (3, "c")]
    assert ranked(spark, docs, [(1, "b"), (1, "a"), (1, None)]) == plain(docs, [(1, "a")])


@pytest.mark.parametrize(("docs", "items"), [([], [(1, "a")]), ([(1, "a")], []), ([], []), ([(1, None)], [(1, None)])])
def test_empty_tables(spark, docs, items):
    assert ranked(spark, docs, items) == []


def test_names_of_other_columns_do_not_matter(spark):
    docs = spark.createDataFrame([(1, "a b", 7, "x", 1.0), (2, "b", 7, "y", 2.0)], "doc_id int, text string, n long, term string, norm double")
    items = spark.createDataFrame([("i", "b", 3, 4)], "item_id string, text string, rank int, score long")
    assert [tuple(r)[:3] for r in lexical.rank(docs, items).collect()] == [("i", 1, 2), ("i", 2, 1)]


def test_a_very_long_text(spark):
    rng = random.Random(1)
    docs = [(1, " ".join(f"w{rng.randint(0, 50_000)}" for _ in range(300_000))), (2, "w1 w2"), (3, "w3 " * 200_000), (4, "x" * 2_000_000)]
    items = [(1, "w1 w2 w3"), (2, "x" * 2_000_000), (3, docs[0][1][:200_000])]
    assert ranked(spark, docs, items) == plain(docs, items)


def test_buckets_are_passed_by_length_and_rows_by_coordinates(monkeypatch):
    """What cannot reach the k-th score is not scored again."""
    weights = np.array([1000, 10, 10])
    items = lexical.Items.of(["i"], [{0: 1, 1: 1, 2: 1}], weights)
    best = lexical.Best(items, np.array([900_000]), 1)
    taken = []
    monkeypatch.setattr(best, "_take", lambda i, ids, score: taken.append(ids.tolist()))
    row = lambda *entries: (np.array([t for t, _ in entries]), np.array([v for _, v in entries]))
    term, impact = row((1, 500), (2, 500))
    best.search(np.array([1]), np.array([0, 2]), term, impact, np.array([math.hypot(500, 500)]))
    assert taken == []  # the length would do, the heavy coordinate does not
    term, impact = row((0, 950), (1, 10))
    best.search(np.array([2]), np.array([0, 2]), term, impact, np.array([math.hypot(950, 10)]))
    assert taken == [[2]]
