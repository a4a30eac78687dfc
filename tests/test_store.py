"""Publishing, replay, and the current view of the snapshot store."""

from __future__ import annotations

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from burnwatch.operators import degradation
from burnwatch.operators.partials import history_from, risk_from
from burnwatch.operators.trends import service_risk
from burnwatch.schema import EB, RESPONSE
from burnwatch.sources import store as store_module
from burnwatch.sources.store import SnapshotStore, _ranges


@pytest.fixture()
def store(spark, tmp_path):
    return SnapshotStore(spark, str(tmp_path / "store"))


@pytest.fixture(scope="module")
def pages(spark):
    def build(*items):
        return spark.createDataFrame([(0, json.dumps(list(items)))], "page_id long, body string")

    return build


def item(key, day=1, n=1, category=EB):
    return {"key": key, "transactionName": "svc", "totalCount": n, "dataCategory": category, "at": f"2024-02-{day:02d} 06:00:00"}


def load(store, pages, *items):
    return store.load_pages(pages(*items), event_time_key="at")


def current(store, **options):
    return sorted((r.id, r.total_count) for r in store.tables(latest=True, **options).eb.collect())


def files_read(df):
    return {name.split("/current/")[1].split("/part")[0] if "/current/" in name else name for name in df.inputFiles()}


def test_a_crash_before_publishing_loads_the_batch_once(store, pages, monkeypatch):
    """The batch dies after its rows are written and before they are published; its replay publishes them once."""
    create = SnapshotStore._create

    def dies(self, path, text=""):
        if "/published/" in path:
            raise RuntimeError("lost")
        return create(self, path, text)

    monkeypatch.setattr(SnapshotStore, "_create", dies)
    with pytest.raises(RuntimeError, match="lost"):
        store.load_batch(pages(item("a")), "q", 0)
    monkeypatch.undo()
    assert store.tables(history=True).eb.count() == 0
    assert store.load_batch(pages(item("a")), "q", 0) is not None
    assert store.load_batch(pages(item("a")), "q", 0) is None
    assert [r.id for r in store.tables(history=True).eb.collect()] == ["a"]
    assert len(store.versions(EB)) == 1


def test_a_crash_after_publishing_leaves_only_the_view_to_do(store, pages, monkeypatch):
    monkeypatch.setattr(SnapshotStore, "update_current", lambda self: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        store.load_batch(pages(item("a")), "q", 0)
    monkeypatch.undo()
    # A reader sees it already; the replay loads nothing and brings the view up to date.
    assert current(store) == [("a", 1)]
    assert store.load_batch(pages(item("a")), "q", 0) is None
    assert current(store) == [("a", 1)]
    assert [r.id for r in store.tables(history=True).eb.collect()] == ["a"]
    assert store.update_current() == 0


def test_only_touched_days_are_written(store, pages):
    load(store, pages, item("a", 1), item("b", 2), item("c", 3), item("r", 1, category=RESPONSE))
    assert store.update_current() == 1
    before = files_read(store.table(EB, latest=True))
    load(store, pages, item("b", 2, n=5), item("d", 2))
    assert store.update_current() == 1
    after = files_read(store.table(EB, latest=True))
    assert current(store) == [("a", 1), ("b", 5), ("c", 1), ("d", 1)]
    assert {f for f in before if not f.endswith("02")} <= after and not {f for f in before if f.endswith("02")} & after
    assert [r.id for r in store.table(RESPONSE, latest=True).collect()] == ["r"]


def test_an_id_that_moves_to_another_day_leaves_the_old_one(store, pages):
    load(store, pages, item("a", 1), item("b", 1))
    store.update_current()
    load(store, pages, item("a", 9, n=2))
    store.update_current()
    assert current(store) == [("a", 2), ("b", 1)]
    load(store, pages, item("b", 9, n=3))
    store.update_current()
    assert current(store) == [("a", 2), ("b", 3)]
    assert all(f.endswith("2024-02-09") for f in files_read(store.table(EB, latest=True)))
    assert store.vacuum() == 2
    assert current(store) == [("a", 2), ("b", 3)]


def test_a_large_day_is_written_in_parts(spark, store, pages, monkeypatch):
    """However few days a load has, its rows are dealt to many tasks."""
    monkeypatch.setattr(store_module, "PART_ROWS", 5)
    items = [item(f"k{i}", n=i, category=(EB, RESPONSE)[i % 2]) for i in range(40)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        load(store, pages, *items)
        store.update_current()
        load(store, pages, item("k0", n=99))
        store.update_current()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for options in ({"history": True}, {"latest": True}):
        assert len(store.table(RESPONSE, **options).inputFiles()) > 1
    assert len(store.table(EB, latest=True).inputFiles()) > 1
    assert current(store) == sorted((f"k{i}", i or 99) for i in range(0, 40, 2))


def test_whole_rows_are_compared_once_in_a_merge(store, pages, monkeypatch):
    compared = []
    newest = SnapshotStore._newest
    monkeypatch.setattr(SnapshotStore, "_newest", staticmethod(lambda rows: compared.append(1) or newest(rows)))
    load(store, pages, item("a", 1), item("b", 1))
    store.update_current()
    load(store, pages, item("a", 2, n=2), item("b", 1, n=2))
    load(store, pages, item("a", 3, n=3))
    store.update_current()
    assert len(compared) == 2
    assert current(store) == [("a", 3), ("b", 2)]
    assert {f[-2:] for f in files_read(store.table(EB, latest=True))} == {"01", "03"}


def test_versions_not_merged_yet_are_read_beside_the_view(store, pages):
    load(store, pages, item("a", 1), item("b", 2))
    store.update_current()
    load(store, pages, item("a", 1, n=7), item("c", 3))
    assert current(store) == [("a", 7), ("b", 1), ("c", 1)]
    assert current(store, start="2024-02-02") == [("b", 1), ("c", 1)]


def test_a_version_published_late_does_not_cover_a_newer_one(store, pages):
    late = store.claim()
    load(store, pages, item("a", n=2))
    store.update_current()
    store.load_pages(pages(item("a", n=1), item("z")), event_time_key="at", version=late)
    assert store.update_current() == 1
    assert current(store) == [("a", 2), ("z", 1)]


def test_of_two_writers_of_the_view_one_starts_over(store, pages, monkeypatch):
    load(store, pages, item("a"))
    other = SnapshotStore(store.spark, store.root)
    create, turns = SnapshotStore._create, []

    def interrupted(self, path, text=""):
        if "/manifests/" in path and self is store and not turns:
            turns.append(other.update_current())
        return create(self, path, text)

    monkeypatch.setattr(SnapshotStore, "_create", interrupted)
    assert store.update_current() == 0 and turns == [1]
    assert current(store) == [("a", 1)]


def test_an_abandoned_empty_marker_is_written_anew(store, monkeypatch):
    path = f"{store.root}/manifests/0"
    fs, p = store._fs(path)
    fs.create(p, False).close()
    assert not store._create(path, "x")
    monkeypatch.setattr(store_module, "ABANDONED_SECONDS", 0)
    assert store._create(path, "x") and store._read(path) == "x"
    assert not store._create(path, "y") and store._read(path) == "x"


def test_counts_come_from_the_write_and_match_what_is_stored(store, pages, spark):
    result = load(store, pages, item("a"), item("b", 2), item("r", 3, category=RESPONSE))
    assert result.statistics["eb_records"] == 2 and result.statistics["response_records"] == 1
    assert store._published()[0]["tables"] == {EB: {"rows": 2, "newest_day": "2024-02-02"}, RESPONSE: {"rows": 1, "newest_day": "2024-02-03"}}
    empty = load(store, pages)
    assert empty.published == () and set(empty.statistics.values()) == {0}


def test_counts_add_up_over_many_tasks(store, logs):
    rows = logs(*[{"id": f"i{n}"} for n in range(60)]).repartition(6)
    seen = store.write(rows)
    assert seen.statistics["eb_records"] == 60 == store.tables().eb.count()


def test_the_newest_time_is_read_from_one_day(store, pages):
    load(store, pages, *[item(f"i{d}", d) for d in range(1, 10)])
    for tables in (store.tables(), store.tables(history=True)):
        assert tables.newest_day == date(2024, 2, 9)
        report = degradation.volume_summary(tables, time_window_minutes=60)
        assert report.first().total_volume == 1
        plan = tables.eb.select(tables.latest_time().alias("t")).limit(1)
        assert plan.first().t == datetime(2024, 2, 9, 6)
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(record_date" in text and "2024-02-09" in text
    store.update_current()
    assert store.tables(latest=True).newest_day == date(2024, 2, 9)
    # A bound may leave the newest day out, so there the rows tell.
    assert store.tables(end="2024-02-05").newest_day is None


def test_whole_days_of_a_preset(store, pages):
    load(store, pages, *[item(f"i{d}", d) for d in range(1, 10)])
    found = store.tables(last_days=2, today=date(2024, 2, 6)).eb
    assert sorted(r.id for r in found.collect()) == ["i4", "i5", "i6"]
    assert "PartitionFilters: [isnotnull(record_date" in found._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        store.tables(last_days=-1)


def test_ranges():
    assert _ranges({5, 1, 2, 3, 9}) == [[1, 3], [5, 5], [9, 9]]
    assert _ranges(set()) == []


def test_each_version_is_found_by_one_listing(store, pages, monkeypatch):
    for n in range(3):
        load(store, pages, item(f"i{n}"))
    other = SnapshotStore(store.spark, store.root)
    reads = []
    monkeypatch.setattr(SnapshotStore, "_exists", lambda self, path: pytest.fail("asked for a single file"))
    read = SnapshotStore._read
    monkeypatch.setattr(SnapshotStore, "_read", lambda self, path: (reads.append(path), read(self, path))[1])
    assert other.versions(EB) == other.versions(EB) == [0, 1, 2]
    assert len(reads) == 3
    assert other.tables(history=True).eb.select(F.count("*")).first()[0] == 3


def test_stored_figures_follow_the_current_view(spark, tmp_path, pages):
    """Risk and history from the figures of the store are those of its logs after every load, and no log file is read."""
    store = SnapshotStore(spark, str(tmp_path / "kept"), partials=True)
    with pytest.raises(ValueError, match="empty"):
        store.partials()

    def item_at(key, day, hour, rate):
        return item(key, day) | {"at": f"2024-02-{day:02d} {hour:02d}:30:00", "errorRate": rate, "avgResponseTime": rate / 3}

    loads = [
        [item_at(f"a{d}-{h}", d, h, d + h / 7) for d in range(1, 6) for h in (0, 9, 23)],
        [item_at("a3-9", 3, 9, 40.0), item_at("a9", 9, 1, 2.0), item_at("a1-0", 8, 2, 7.0)],
        [item("only-response", 2, category=RESPONSE)],
    ]
    for rows in loads:
        load(store, pages, *rows)
        store.update_current()
        found, wanted = (df.drop("risk_factors").collect() for df in (risk_from(store.partials()), service_risk(store.tables(latest=True))))
        assert len(found) == len(wanted) == 1
        for name in wanted[0].asDict():
            assert str(found[0][name]) == str(wanted[0][name]) or name == "trends"
        assert found[0].trends.error_rate_slope == pytest.approx(wanted[0].trends.error_rate_slope)
        (history,) = history_from(store.partials()).collect()
        assert history.data_points == store.tables(latest=True).eb.count()
        assert all("/partials/" in f for f in store.partials().inputFiles())
    store.vacuum()
    assert store.partials().count() > 0
    load(store, pages, item("z", 12))
    SnapshotStore(spark, store.root).update_current()
    with pytest.raises(ValueError, match="without partials"):
        store.partials()
