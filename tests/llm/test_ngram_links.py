"""Links of the n-gram join, and words that only look alike to a weak hash."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from burnwatch.llm import ngram_join


def thue_morse(turns):
    text = "a"
    for _ in range(turns):
        text += text.translate(str.maketrans("ab", "ba"))
    return text


def test_words_of_equal_sums_differ(documents):
    """These two words collide under any polynomial hash modulo a power of two."""
    one = thue_morse(10)
    other = one.translate(str.maketrans("ab", "ba"))
    docs = documents((1, f"one two three {one}"), (2, f"one two three {other}"), (3, f"One two three {one}"))
    found = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs, size=4, percent=85).collect()}
    assert found == {1: 1, 2: 2, 3: 1}
    assert sorted(map(tuple, ngram_join.link_counts(docs, size=4, percent=85).collect())) == [(1, 1), (2, 0), (3, 1)]


@pytest.mark.parametrize("alphabet", [b"ab", b"\x00\x01", b"az09", bytes(range(0x80, 0xC0))])
def test_hashes_of_short_and_long_words_are_distinct(alphabet):
    rng = random.Random(4)
    words = list({bytes(rng.choices(alphabet, k=rng.choice((1, 2, 7, 8, 9, 15, 16, 17, 40)))) for _ in range(20_000)})
    words = [w for w in words if not set(w) & set(b" \t\n\r\x0b\x0c")]
    hashes = ngram_join.word_hashes(b" ".join(words))
    assert len(hashes) == len(words) == len(set(hashes.tolist()))
    # A word has one hash wherever it stands.
    again = ngram_join.word_hashes(b"\n".join(reversed(words)))
    np.testing.assert_array_equal(again[::-1], hashes)


def made(rng, groups, members, noise):
    docs = []
    for g in range(groups):
        base = [f"g{g}w{i}" for i in range(rng.randint(12, 60))]
        for _ in range(members):
            words = list(base)
            for _ in range(rng.randint(0, noise)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(9)}"
            docs.append(" ".join(words))
    docs += [" ".join(f"u{rng.randrange(60)}" for _ in range(rng.randint(1, 30))) for _ in range(60)] + ["", "  ", "one", "two words", "two  WORDS"]
    rng.shuffle(docs)
    return list(enumerate(docs, 100))


def sets_of(docs, size):
    out = {}
    for i, text in docs:
        words = text.lower().split()
        out[i] = frozenset(tuple(words[j : j + size]) for j in range(max(1, len(words) - size + 1))) if words else frozenset()
    return out


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_links_are_those_of_all_pairs(documents, size, percent):
    rng = random.Random(size)
    docs = made(rng, 6, 25, 3)
    sets = sets_of(docs, size)
    first: dict = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    linked = lambda x, y: 100 * len(x & y) >= percent * len(x | y)
    kinds = [s for s in first if s]
    wanted = sorted({tuple(sorted((first[x], first[y]))) for x in kinds for y in kinds if first[x] < first[y] and linked(x, y)})
    frame = documents(*docs)
    assert sorted(map(tuple, ngram_join.links(frame, size, percent).collect())) == wanted and wanted
    copies = Counter(sets.values())
    counts = {i: (sum(copies[y] for y in kinds if linked(s, y)) - 1 if s else 0) for i, s in sets.items()}
    assert {r.doc_id: r.n_links for r in ngram_join.link_counts(frame, size, percent).collect()} == counts


def test_no_documents_no_links(documents):
    docs = documents((1, None), (2, ""), (None, "a b"))
    assert ngram_join.links(docs).count() == 0 and ngram_join.links(docs.limit(0)).count() == 0
    assert sorted(map(tuple, ngram_join.link_counts(docs).collect())) == [(1, 0), (2, 0)]
