"""Registered queries of the subpackage: SQL where there is some, brute force where there is none."""

from __future__ import annotations

import collections
import hashlib
import re

import duckdb
import pyarrow.parquet as pq
import pytest

from burnwatch.llm.contract import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts():
    table = pq.read_table(f"{SF_DIR}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return {row["doc_id"]: row["text"] for row in table}


def rows(spark, name):
    return {row.doc_id: row for row in QUERIES[name](spark, SF_DIR).collect()}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "pages", "embeddings", "conversations", "benchmark"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    result = duck.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    frame = QUERIES[name](spark, SF_DIR)
    assert sorted(frame.columns) == sorted(columns)
    assert sorted(map(str, map(tuple, frame.select(*columns).collect()))) == sorted(map(str, result.fetchall()))


def test_toxicity_finds_held_out_rows(spark):
    found = rows(spark, "op1_toxicity")
    labels = pq.read_table(f"{SF_DIR}/labels.parquet").to_pylist()
    assert set(found) == set(texts()) and all(0 <= r.score <= 1 for r in found.values())
    assert all(r.predicted == int(r.score >= 0.5) for r in found.values())
    held = [(found[x["doc_id"]].predicted, x["toxic"]) for x in labels if found[x["doc_id"]].held_out]
    assert sum(p == t for p, t in held) / len(held) >= 0.85


def test_repeats(spark):
    found, source = rows(spark, "op6_suffix_dedup"), {i: t.encode() for i, t in texts().items()}
    seen = collections.Counter(b[i : i + 200] for b in source.values() for i in range(len(b) - 199))
    for i, raw in source.items():
        gone = [False] * len(raw)
        for at in range(len(raw) - 199):
            if seen[raw[at : at + 200]] > 1:
                gone[at : at + 200] = [True] * 200
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not (at and gone[at - 1]) for at, g in enumerate(gone))
        expected = (len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest())
        assert (found[i].n_bytes, found[i].n_removed, found[i].n_spans, found[i].kept_sha256) == expected


def test_edited_texts(spark):
    found, source = rows(spark, "op7_order_minhash"), sorted(texts().items())
    prints = collections.defaultdict(set)
    for (i, text), (_, following) in zip(source, source[1:] + source[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert (found[i].n_chars, found[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        prints[text].add(found[i].fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    assert sum(r.near_edited > r.near_next for r in found.values()) > 0.9 * len(found)


def test_near_duplicates(spark):
    found = rows(spark, "op8_ngram_join")
    sets = {}
    for i, text in texts().items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
        sets[i] = {tuple(words[j : j + 4]) for j in range(len(words) - 3)} or ({tuple(words)} if words else set())
    component = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((component[i], component[j]))
                component = {k: a if c == b else c for k, c in component.items()}
    assert {i: (r.n_shingles, r.component_id) for i, r in found.items()} == {i: (len(sets[i]), component[i]) for i in sets}


def test_bpe_round_trip(spark):
    import base64

    import public_tokenizers
    import tiktoken

    lines = open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = rows(spark, "op9_bpe")
    for i, text in texts().items():
        ids = reference.encode_ordinary(text)
        assert found[i].n_tokens == len(ids)
        assert found[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_mixing_keeps_every_document(spark):
    found = QUERIES["op2_mixing"](spark, SF_DIR).collect()
    assert {r.doc_id for r in found} == set(texts())
    assert all(0 <= r.turn <= 1 for r in found)


def test_pages(spark):
    found = QUERIES["op4_main_text"](spark, SF_DIR).collect()
    source = {x["page_id"]: x["html"] for x in pq.read_table(f"{SF_DIR}/pages.parquet").to_pylist()}
    assert len(found) == len(source)
    import html as h

    for row in found:
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", source[row.page_id], re.S)[1]
        parts = [" ".join(h.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert row.text == "\n\n".join(x for x in parts if x) and row.n_chars == len(row.text)
