"""Near copies where ids repeat or are missing."""

from __future__ import annotations

import corpus_pipeline


def test_unlike_texts_under_one_id_stay(spark, documents):
    one, two, three = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = documents((5, one), (5, two), (5, two), (3, one + " more"), (7, None), (7, ""), (7, ""), (None, three), (None, three + " end"), (None, two))
    found = corpus_pipeline.keep_one_of_near_copies(spark, rows, "").collect()
    texts = sorted((str(r.doc_id), r.text or "") for r in found)
    lone = [t for i, t in texts if i == "None"]
    assert len(lone) == 1 and lone[0] in (three, three + " end")
    assert [x for x in texts if x[0] != "None"] == [("3", one + " more"), ("5", two), ("7", ""), ("7", ""), ("7", "")]
