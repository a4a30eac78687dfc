"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from burnwatch.llm import bpe, chat, html_text, mixing, ngram_join, order_minhash, suffix_dedup, toxicity, urls, vectors
from burnwatch.llm.components import components
from burnwatch.llm.queries import bpe_vocabulary

LONG = " ".join(f"w{i % 5000}x{i % 77}" for i in range(60_000))


def by_id(frame):
    return {r.doc_id: r for r in frame.collect()}


# 1 toxicity


def labelled(spark, documents):
    rng = random.Random(5)
    bad, good = ["idiot", "moron", "scum"], [f"word{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choices(good, k=12) + (rng.choices(bad, k=2) if i % 3 == 0 else []))) for i in range(200)]
    return documents(*docs), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "doc_id long, toxic int")


def test_toxicity_edges(spark, documents):
    docs, labels = labelled(spark, documents)
    model = toxicity.fit(docs, labels)
    odd = documents((1, None), (2, ""), (3, "you idiot moron"), (3, "you idiot moron"), (None, LONG)).withColumn("score", F.lit("x"))
    found = toxicity.score(odd, model).collect()
    assert len(found) == 5 and len({r.score for r in found if r.text == "you idiot moron"}) == 1
    assert [r.predicted for r in found if r.text == "you idiot moron"] == [1, 1]
    assert {r.score for r in found if not r.text} == {model.blank}
    assert toxicity.fit(docs, labels.where("toxic = 0")) is None
    assert [r.score for r in toxicity.score(documents((1, "a")), None).collect()] == [0.0]
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_block_maxima_lose_no_neighbour():
    rng = np.random.default_rng(3)
    found = []
    for _ in range(300):
        terms = rng.choice(50, rng.integers(1, 8), replace=False)
        weights = rng.random(len(terms)) + 0.1
        found.append((terms, weights / np.linalg.norm(weights)))
    index = toxicity.Index.build(found, np.arange(300), np.zeros(300), 50)
    dense = np.zeros((300, 50))
    for i, (t, w) in enumerate(found):
        dense[i, t] = w
    place = {int(i): c for c, i in enumerate(index.ids)}
    for i in range(0, 300, 7):
        columns, cosines = index.nearest(*found[i], 10)
        scores = np.round(dense @ dense[i], 6)
        expected = sorted((-s, j) for j, s in enumerate(scores) if s > 0)[:10]
        assert cosines == pytest.approx([-s for s, _ in expected], abs=2e-6)
        assert place[i] in columns


# 2 mixing


def sourced(spark, sizes):
    rows = [(i, "a b c d", s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mixing_limits(spark):
    docs = sourced(spark, {"big": 900, "mid": 300, "small": 100, None: 100})
    found = mixing.mix(docs, repetition_limit=2.0).groupBy("source").count().collect()
    counts = {r.source: r["count"] for r in found}
    assert counts["big"] == 900
    # (9 / 1) to the power of 1 - a is 2.
    a = 1 - math.log(2) / math.log(9)
    for source, n in (("mid", 300), ("small", 100), (None, 100)):
        assert counts[source] == pytest.approx(n * (900 / n) ** (1 - a), abs=1)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_entropy_and_budget(spark):
    docs = sourced(spark, {"x": 800, "y": 200})
    flat = mixing.mix(docs, target_entropy=math.log(2), repetition_limit=None, budget=1600).groupBy("source").count().collect()
    assert {r.source: pytest.approx(r["count"], abs=1) for r in flat} == {"x": 200, "y": 200}
    same = mixing.mix(docs, target_entropy=0.0, repetition_limit=None, budget=4000).groupBy("source").count().collect()
    assert {r.source: r["count"] for r in same} == {"x": 800, "y": 200}
    with pytest.raises(ValueError):
        mixing.mix(docs, target_entropy=1.0)


def test_mixing_repeats_within_one_of_each_other(spark):
    docs = sourced(spark, {"x": 500, "y": 50}).withColumn("epoch", F.lit("mine"))
    found = mixing.mix(docs, repetition_limit=3.0).groupBy("doc_id", "source").count().collect()
    for source in ("x", "y"):
        counts = {r["count"] for r in found if r.source == source}
        assert max(counts) - min(counts) <= 1


# 3 URL filter

RULES = [("net", "/", "block"), ("a.net", "/x/", "allow"), ("a.net", "/x/", "allow"), (None, "/", "block"), ("b.org", "", "block")]


def test_url_edges(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    given = [None, "", "a.net/x/", "http://A.NET/x/y?z", "http://q.a.net/x", "http://xa.net/x/", "s://b.org", "s://c.b.org#/", "http://net/", "http://net", "://net/?://a"]
    pages = spark.createDataFrame(list(enumerate(given)), "page_id long, url string").withColumn("rule", F.lit("clash"))
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages.unionAll(pages), rules).collect()}
    assert urls.judge_urls(pages.unionAll(pages), rules).count() == 2 * len(given)
    assert found[0] == found[1] == found[2] == ("", "", None, "allow")
    assert found[3] == ("a.net", "/x/y", "a.net/x/", "allow")
    assert found[4] == ("q.a.net", "/x", "net/", "block")
    assert found[5][2:] == ("net/", "block")
    assert found[6] == ("b.org", "", "b.org", "block") and found[7][2:] == ("b.org", "block")
    assert found[8] == ("net", "/", "net/", "block") and found[9] == ("net", "", None, "allow") and found[10][2] == "net/"
    assert urls.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


# 4 HTML


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>a<p>b<br>c&nbsp;d &amp; &lt;", "a\n\nb c d & <"),
        ("<article><h1>T</h1><p>x<b>y</b></p><aside>no</aside><div class='comments'><p>no</p></div></article><p>out</p>", "T\n\nxy"),
        ("<main><form><p>no</p></form><script>if(a<b)'</p>'</script><p>yes, it is.</p><!-- no --></main>", "yes, it is."),
        ("<article><div class='cookie-notice'>no</div><p>one</p>\n<p>  two\t2 </p>", "one\n\ntwo 2"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_paths_without_names():
    links = "".join(f'<a href="/{i}">link number {i}</a> ' for i in range(9))
    body = "".join(f"<p>Sentence {i}, which has some words, and goes on for a while.</p>" for i in range(5))
    found = html_text.main_text(f"<body><div class='x'>{links}</div><div class='y'><h2>Head</h2>{body}<p>Ok.</p></div></body>")
    assert found.startswith("Head\n\nSentence 0") and found.endswith("Ok.") and "link" not in found


def test_extract_keeps_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>", "t"), (1, "u", "<p>a</p>", "t"), (2, None, None, "t")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id, r.text) for r in html_text.extract(pages).collect()) == [(1, "a"), (1, "a"), (2, "")]
    assert html_text.extract(pages.limit(0)).count() == 0


# 5 vectors


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5]), (4, None), (5, [nan, 0.0]), (6, [None, 1.0]), (7, [inf, 1.0]), (8, []), (2, [1.0, 0.0]), (None, [9.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = [(r.query_id, r["rank"], r.vec_id, r.score) for r in vectors.search(table, F.col("vec_id") == 0, k=4).orderBy("rank").collect()]
    assert found == [(0, 1, 1, 4096), (0, 2, 2, 4096), (0, 3, 2, 4096), (0, 4, 3, 2048)]
    assert vectors.search(table.limit(0), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("bits", [2, 6])
def test_vector_search_is_exact(spark, monkeypatch, bits):
    monkeypatch.setattr(vectors, "CANDIDATES", 100)
    monkeypatch.setattr(vectors, "QUERIES", 7)
    monkeypatch.setattr(vectors, "BITS", bits)
    rng = np.random.default_rng(2)
    data = rng.normal(0, 0.3, (700, 12))
    data[100:300] = data[100]  # a large group of one vector
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    found = {}
    for r in vectors.search(table, F.col("vec_id") % 20 == 0, k=20).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    q = np.floor(64 * data).astype(np.int64)
    for i in range(0, 700, 20):
        scores = q @ q[i]
        expected = sorted((-s, j) for j, s in enumerate(scores) if j != i)[:20]
        assert [found[i][k] for k in range(1, 21)] == [(j, -s) for s, j in expected]


# 6 suffix dedup


def test_suffix_edges(documents):
    passage = "".join(random.Random(1).choices("abcdefgh ", k=230))
    docs = documents((1, "x" * 50 + passage + "y" * 50), (2, passage + "z"), (3, None), (4, ""), (5, "r" * 203), (6, "short"), (7, "q" * 10 + passage[:199]), (8, "same " * 60), (8, "same " * 60), (None, "é" * 150))
    found = suffix_dedup.remove_repeats(docs, window=200).collect()
    sizes = sorted(((r.doc_id is None, r.doc_id or 0), r.n_bytes, r.n_bytes - len(r.kept), len(r.spans)) for r in found)
    expected = {1: (330, 230, 1), 2: (231, 230, 1), 3: (0, 0, 0), 4: (0, 0, 0), 5: (203, 203, 1), 6: (5, 0, 0), 7: (209, 0, 0), 8: (300, 300, 1)}
    for (_, i), n, removed, spans in sizes:
        assert (n, removed, spans) == (expected[i] if i else (300, 300, 1))
    assert len(found) == 10
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("group", [1, 20_000])
def test_suffix_removal_is_exact(documents, group):
    rng = random.Random(9)
    parts = ["".join(rng.choices("ab", k=rng.randint(5, 60))) for _ in range(12)]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(60)]
    found = {r.doc_id: r.kept for r in suffix_dedup.remove_repeats(documents(*enumerate(texts)), window=40, group=group).collect()}
    seen = {}
    for i, t in enumerate(texts):
        for at in range(len(t) - 39):
            seen.setdefault(t[at : at + 40], []).append((i, at))
    for i, t in enumerate(texts):
        gone = set()
        for at in range(len(t) - 39):
            if len(seen[t[at : at + 40]]) > 1:
                gone.update(range(at, at + 40))
        assert found[i].decode() == "".join(c for at, c in enumerate(t) if at not in gone)


def test_long_texts_are_cut_into_chunks(documents, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1000)
    rng = random.Random(4)
    one, two = ("".join(rng.choices("abcdefgh", k=5000)) for _ in range(2))
    found = by_id(suffix_dedup.remove_repeats(documents((1, one), (2, two[:900] + one[700:3300] + two[900:]))))
    assert len(found[1].kept) == 5000 - 2600 and found[2].kept.decode() == two


def test_sorted_suffixes_agree_with_plain_sorting():
    rng = np.random.default_rng(8)
    rows = rng.integers(97, 99, (200, 12)).astype(np.uint8)
    lengths = rng.integers(1, 13, 200)
    rows[np.arange(12) >= lengths[:, None]] = 0
    groups = np.sort(rng.integers(0, 9, 200))
    order, common = suffix_dedup.sorted_suffixes(groups, rows, lengths)
    keys = [(groups[i], rows[i, : lengths[i]].tobytes()) for i in order]
    assert keys == sorted(keys)
    for a, b, n in zip(keys, keys[1:], common[1:], strict=False):
        shared = next((k for k, (x, y) in enumerate(zip(a[1], b[1], strict=False)) if x != y), min(len(a[1]), len(b[1])))
        assert n == (shared if a[0] == b[0] else 0)


# 7 order minhash


def test_fingerprint_edges(spark, documents):
    docs = documents((1, None), (2, ""), (3, "one two"), (4, "again " * 300), (5, "again " * 300), (6, LONG), (6, LONG))
    found = order_minhash.against_next(docs).withColumn("f", order_minhash.fingerprint(F.col("signature"))).collect()
    prints = {}
    for r in found:
        prints.setdefault(r.doc_id, set()).add(r.f)
    assert len(found) == 7 and all(len(p) == 1 for p in prints.values())
    assert prints[1] == prints[2] == {""} and prints[4] == prints[5] and len(prints[4] | prints[3] | prints[6]) == 3
    assert order_minhash.against_next(docs.limit(0)).count() == 0


def test_fingerprints_see_order(spark):
    words = [f"w{i}" for i in range(400)]
    turned = words[200:] + words[:200]
    rows = [(" ".join(words), " ".join(turned), " ".join(words[:399] + ["x"]))]
    df = order_minhash.signatures(spark.createDataFrame(rows, "a string, b string, c string"), s="a", t="b", u="c")
    near, far = df.select(order_minhash.likeness(F.col("s"), F.col("u")), order_minhash.likeness(F.col("s"), F.col("t"))).first()
    assert near > 0.9 and 0.2 < far < near


# 8 n-gram join


def test_ngram_edges(documents):
    base = [f"w{i}" for i in range(100)]
    near, far = base[:97] + ["a", "b", "c"], base[:60] + [f"v{i}" for i in range(40)]
    docs = documents(
        (9, " ".join(base)), (3, " ".join(base).upper()), (5, " ".join(near)), (7, " ".join(far)), (1, None), (2, " \t\n"), (4, "one two"), (6, "ONE  two"), (8, "two one"), (9, " ".join(base)), (None, "x y")
    )
    found = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs, size=4, percent=85).collect()}
    assert found == {(9, 97, 3), (3, 97, 3), (5, 97, 3), (7, 97, 7), (1, 0, 1), (2, 0, 2), (4, 1, 4), (6, 1, 4), (8, 1, 8), (None, 1, None)}
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0


def test_large_groups_of_near_copies(documents):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(60)] = f"e{rng.randrange(30)}"
        docs.append((i, " ".join(words)))
    docs += [(1000 + i, " ".join([f"u{i}x{k}" for k in range(20)] + base[:20])) for i in range(40)]
    found = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(documents(*docs), size=4, percent=85).collect()}
    sets = {i: {tuple(t.split()[j : j + 4]) for j in range(len(t.split()) - 3)} for i, t in docs}
    component = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and component[i] != component[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((component[i], component[j]))
                component = {k: a if c == b else c for k, c in component.items()}
    assert found == component


def test_words_longer_than_a_chunk(monkeypatch):
    text = b"a bb " + b"c" * 300 + b" dd " + b"e" * 90 + b" a"
    whole = ngram_join.word_hashes(text)
    assert len(whole) == 6 and whole[0] == whole[5] and len(set(whole)) == 5
    monkeypatch.setattr(ngram_join, "CHUNK", 128)
    cut = ngram_join.word_hashes(text)
    assert len(cut) == 6 and cut[0] == cut[5] == whole[0] and cut[1] == whole[1]


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (200, 200), (None, 3), (102, 100)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 102: 100, 200: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 9 BPE


def test_bpe_edges(documents):
    docs = documents((1, None), (2, ""), (3, "a²\x1c日本 \n\n it's"), (3, "a²\x1c日本 \n\n it's"), (4, "z" * 100_000)).withColumn("ids", F.lit("clash"))
    encoded = bpe.encode(docs, bpe_vocabulary())
    found = bpe.decode(encoded, bpe_vocabulary()).collect()
    assert len(found) == 5
    for r in found:
        assert bytes(r.decoded).decode() == (r.text or "")
    assert bpe.encode(docs.limit(0), bpe_vocabulary()).count() == 0


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(2000)]
    find = bpe.PerfectHash.build(keys)
    assert [find(k) for k in keys] == list(range(2000)) and sorted(find.slots) == list(range(2000))


# 10 chat


def test_chat_edges(spark):
    rows = [
        (1, 0, "user", "a<|end|>&lt;"), (1, 1, "assistant", "<|next|>"), (1, 2, "assistant", None), (1, 2, "assistant", "tie"),
        (2, None, None, "x"), (2, 1, "us\ner&nl;", ""), (None, 0, "assistant", "n"), (None, 0, "assistant", "n"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    chats = chat.format_chats(turns)
    read = chats.select("conv_id", chat.read_chats(F.col("formatted")).alias("t"), chat.under_mask(F.col("formatted"), F.col("loss_runs")).alias("m"), "formatted").collect()
    found = {r.conv_id: ([tuple(x) for x in r.t], "".join(r.m)) for r in read}
    assert found[1] == ([("user", "a<|end|>&lt;"), ("assistant", "<|next|>"), ("assistant", ""), ("assistant", "tie")], "<|next|>tie")
    assert found[2] == ([("", "x"), ("us\ner&nl;", "")], "")
    assert found[None] == ([("assistant", "n"), ("assistant", "n")], "nn")
    assert [r.formatted.count(chat.TURN) for r in read if r.conv_id == 1] == [2]
    assert chat.format_chats(turns.limit(0)).count() == 0
