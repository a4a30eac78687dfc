"""One pass of byte-level BPE against the library and the two passes."""

from __future__ import annotations

import base64

import public_tokenizers
import pytest
import tiktoken

from burnwatch.llm import bpe, worker_memory
from burnwatch.llm.queries import BPE_RANKS, bpe_vocabulary


def library():
    with open(public_tokenizers.path(BPE_RANKS), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_round_trip_is_encode_then_decode_and_the_library(spark, monkeypatch):
    monkeypatch.setattr(bpe, "FLUSH", 64)
    texts = [None, "", "plain words", "I'll é 中文 🙂\n\n x", "a" * 3000, "word " * 500, "<|endoftext|>", "plain words"]
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id int, text string, ids string, extra int").repartition(2)
    found = bpe.round_trip(docs, bpe_vocabulary())
    assert found.columns == ["doc_id", "extra", "ids", "decoded"]
    encoding = library()
    for row in found.collect():
        text = texts[row.doc_id] or ""
        assert row.ids == encoding.encode_ordinary(text) and bytes(row.decoded) == text.encode() and row.extra == row.doc_id
    apart = bpe.decode(bpe.encode(docs, bpe_vocabulary()), bpe_vocabulary()).select(*found.columns)
    key = lambda r: (r.doc_id, list(r.ids), bytes(r.decoded))
    assert sorted(map(key, found.collect())) == sorted(map(key, apart.collect()))
    assert bpe.round_trip(docs.limit(0), bpe_vocabulary()).count() == 0


def test_the_memory_is_bounded_and_forgets_the_older_half(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 6)
    memo = bpe.Memo(bpe_vocabulary())
    pieces = [f"piece{i}" for i in range(20)]
    first = [memo[p] for p in pieces]
    assert len(memo) <= 3 and len(memo.older) <= 3
    assert [memo[p] for p in pieces] == first


def test_ids_too_large_for_the_table_of_pairs_raise(tmp_path):
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(bytes([b])) + b" %d" % (b if b else 2**20) for b in range(256)))
    with pytest.raises(ValueError, match="2\\^20"):
        bpe.Vocabulary.read(str(path), "x")


def test_a_worker_keeps_one_thing_at_a_time():
    worker_memory.release()
    first = worker_memory.kept("a", list)
    assert worker_memory.kept("a", list) is first
    other = worker_memory.kept("b", dict)
    assert worker_memory.kept("b", dict) is other and worker_memory.kept("a", list) is not first
    again = worker_memory.kept("a", list)
    worker_memory.release()
    assert worker_memory.kept("a", list) is not again
