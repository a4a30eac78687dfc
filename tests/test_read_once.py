"""Pages are parsed once."""

from datetime import datetime

from burnwatch.contract import queries


def test_cut_pages_are_parsed_once(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1, i % 24), i % 7, kind, float(i), "{}") for i, kind in enumerate(["click", "purchase", "signup", "error"] * 10)]
    spark.createDataFrame(rows, queries.EVENTS).write.parquet(str(tmp_path / "events.parquet"))
    found = queries.cut_pages(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "MapInPandas" not in plan
    assert sorted(found.collect()) == sorted(queries.ingested_records(spark, str(tmp_path)).collect())


def test_pages_are_dealt_to_more_parts_than_cores(spark, tmp_path):
    """Also where they are few bytes, which Spark would join to one part."""
    rows = [(i, datetime(2024, 1, 1), i % 7, "signup", float(i), "{}") for i in range(4000)]
    spark.createDataFrame(rows, queries.EVENTS).write.parquet(str(tmp_path / "events.parquet"))
    pages = queries.event_pages(spark, str(tmp_path))
    pages.write.parquet(str(tmp_path / "pages"))
    assert pages.rdd.getNumPartitions() == queries.PARTS_PER_CORE * spark.sparkContext.defaultParallelism
    assert spark.read.parquet(str(tmp_path / "pages")).count() == 20
