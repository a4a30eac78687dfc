"""Pages cut at the ends of items, and pages of several sequences."""

from __future__ import annotations

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from burnwatch.sources.pages import _Cut, _parts, cut_pages, page_items, page_problems, read_page_files
from burnwatch.sources.records import good_records, typed_items
from burnwatch.sources.store import SnapshotStore

JSON = st.recursive(
    st.none() | st.booleans() | st.integers(-(10**6), 10**6) | st.text(max_size=8),
    lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=5), x, max_size=3),
    max_leaves=8,
)


@settings(max_examples=200, deadline=None)
@given(st.lists(JSON, max_size=12), st.integers(1, 60), st.sampled_from(["list", "summary", "mixed"]), st.sampled_from([None, 1, 2]))
def test_parts_hold_the_items_in_order(items, part, form, indent):
    body = {"list": items, "summary": {"summary": items}, "mixed": {"a": [1, {"summary": [2]}], "summary": items, "z": "]}"}}[form]
    parts = list(_parts(_Cut(), json.dumps(body, indent=indent), part))
    found = []
    for text, first, whole in parts:
        if items:
            assert first == len(found) and whole == len(items)
        found += json.loads(text)
    assert found == items


@pytest.mark.parametrize(
    ("body", "outcome"),
    [
        ('{"a": 1}', "whole"),
        ('{"summary": "text"}', "whole"),
        ("{}", "whole"),
        ("[]", "empty"),
        ('{"summary": []}', "empty"),
        ("", "unreadable"),
        ("5", "unreadable"),
        ("[1, 2", "unreadable"),
        ("[1 2]", "unreadable"),
        ("[1,]", "unreadable"),
        ('{"summary": [1], "summary": [2]}', "unreadable"),
        ('[{"a": 1, "a": 2}]', "unreadable"),
        ("[NaN]", "unreadable"),
        ('{"summary": [1]', "unreadable"),
        ("{1: 2}", "unreadable"),
        ("[" * 100_000, "unreadable"),
    ],
)
def test_pages_without_items_to_cut(body, outcome):
    assert list(_parts(_Cut(), body, 10)) == [{"whole": (body, None, None), "empty": ("[]", None, None), "unreadable": (None, None, None)}[outcome]]


def rows(items):
    return sorted((r.sequence, r.page_id, r.page_items, r.page_ends, r.pos, r.item) for r in items.selectExpr("*", "to_json(item) AS j").drop("item").withColumnRenamed("j", "item").collect())


def test_cut_pages_have_the_items_of_whole_ones(spark):
    rng = random.Random(3)
    texts = [[{"key": f"{p}-{i}", "n": rng.random(), "s": "é}\"]" * rng.randint(0, 5)} for i in range(rng.randint(0, 40))] for p in range(6)]
    bodies = [json.dumps({"summary": x} if n % 2 else x) for n, x in enumerate(texts)] + ["{broken", '[{"noDataFound": true}]', '{"key": "one"}']
    pages = spark.createDataFrame([(n, None, "run", b) for n, b in enumerate(bodies)], "page_id long, path string, sequence string, body string")
    assert rows(page_items(cut_pages(pages, part=100))) == rows(page_items(pages))
    assert cut_pages(pages, part=100).count() > len(bodies)


def test_a_page_too_large_for_one_value_is_loaded(spark, tmp_path):
    """150 MB in one file: parsed whole it is unreadable, cut it has the items that small files have."""
    filler = "x" * 700_000
    items = [{"key": f"k{i}", "transactionName": "s", "totalCount": i, "pad": filler} for i in range(220)]
    (tmp_path / "large").mkdir()
    (tmp_path / "large" / "page_0.json").write_text(json.dumps({"summary": items}, indent=1))
    assert (tmp_path / "large" / "page_0.json").stat().st_size > 150_000_000
    whole = read_page_files(spark, str(tmp_path / "large"), large_page=1 << 40)
    assert page_items(whole).filter("item IS NOT NULL").isEmpty()
    found = page_items(read_page_files(spark, str(tmp_path / "large")))
    got = found.selectExpr("pos", "page_items", "try_variant_get(item, '$.key', 'string') AS key", "try_variant_get(item, '$.totalCount', 'int') AS n").collect()
    assert sorted(map(tuple, got)) == [(i, 220, f"k{i}", i) for i in range(220)]


def item(**extra):
    return {"transactionName": "s", "totalCount": 1} | extra


def test_equal_numbers_of_two_folders_do_not_meet(spark, tmp_path):
    for folder in ("monday", "tuesday"):
        (tmp_path / folder).mkdir()
        for page in (0, 1, 3):
            body = [item(key=f"{folder}{page}"), item(), item(transactionId=page)]
            (tmp_path / folder / f"page_{page}.json").write_text(json.dumps(body))
    (tmp_path / "tuesday" / "again_page_1.json").write_text(json.dumps([item(key="again")]))
    pages = read_page_files(spark, str(tmp_path / "*"))
    items = page_items(pages)
    assert items.filter("item IS NOT NULL").count() == 19
    problems = {(r.sequence.rsplit("/", 2)[-2:][0], r.sequence.rsplit("/", 1)[-1], r.page_id, r.reason) for r in page_problems(pages, items, 3).collect()}
    assert problems == {("monday", "page_*.json", 2, "missing"), ("tuesday", "page_*.json", 2, "missing"), ("tuesday", "again_page_*.json", 0, "missing")}
    ids = [r.id for r in good_records(typed_items(items, "2024-02-01 00:00:00")).collect()]
    placed = [i for i in ids if "/" in i]
    assert len(placed) == 6 and len(set(placed)) == 6 and any(i.endswith("/monday/page_*.json:3:1") for i in placed)
    store = SnapshotStore(spark, str(tmp_path / "store"))
    result = store.load_pages(pages, page_size=3)
    # platform_0, platform_1 and platform_3 name a transaction and stand in both folders.
    assert result.statistics["eb_records"] == 6 + 1 + 6 + 3
    assert result.problems == {"missing": 3}


def test_the_rule_of_a_server_holds_for_each_sequence(spark):
    full, short = json.dumps([{"a": 1}, {"a": 2}]), json.dumps([{"a": 1}])
    rows_ = [("x", 0, full), ("x", 1, short), ("x", 2, full), ("y", 0, full), ("y", 1, full), ("z", 1, full)]
    pages = spark.createDataFrame(rows_, "sequence string, page_id long, body string")
    from burnwatch.sources.pages import kept_pages

    kept = {(r.sequence, r.page_id) for r in kept_pages(page_items(pages), 2).collect()}
    assert kept == {("x", 0), ("x", 1), ("y", 0), ("y", 1)}


def _variant_reads_in_filters(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line.count("try_variant_get(item") for line in plan.splitlines() if "Filter" in line]


def test_no_filter_repeats_the_casts_of_an_item(spark):
    """Filters on what is derived from an item read the finished values."""
    pages = spark.createDataFrame([(0, json.dumps([item(key="a")]))], "page_id long, body string")
    good = good_records(typed_items(page_items(pages), "2024-02-01 00:00:00"))
    reads = _variant_reads_in_filters(good.filter("eb_health = 'HEALTHY' AND burn_rate < 3").select("id", F.col("burn_rate")))
    # What tells an item and its name apart, a few small reads; not the casts of some eighty members.
    assert reads and max(reads) <= 6
