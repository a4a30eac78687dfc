"""Continuous ingest: page files are loaded into the snapshot store as they land."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from burnwatch.schema import COLUMNS
from burnwatch.sources.pages import page_items, whole_and_cut
from burnwatch.sources.records import accepted, sourced_records, typed_items
from burnwatch.sources.store import SnapshotStore
from burnwatch.streaming.clock import utc_clock, with_instant


def page_stream(spark: SparkSession, path: str, *, files_per_batch: int = 1000) -> DataFrame:
    """Pages of newly landed files, as ``read_page_files`` gives them."""
    return whole_and_cut(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path, wholetext=True))


def continuous_ingest(store: SnapshotStore, pages: DataFrame, checkpoint: str) -> DataStreamWriter:
    """A writer that loads every micro-batch into the store; the caller sets the trigger and starts it.

    Each batch becomes a version of its own, known by the query's id, which the checkpoint keeps, and the batch's number: a replayed batch is
    loaded once, and a new checkpoint does not touch what is there.  ``store.tables(latest=True)`` is the current view over all batches, one copy of each row.
    """

    def load(batch: DataFrame, batch_id: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "stream"
        store.load_batch(batch, query, batch_id)

    return pages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(load)


def first_records(pages: DataFrame, event_time_key: str, *, watermark: str = "1 hour") -> DataFrame:
    """Accepted records of a stream of pages, each id of a table once within the watermark: the 83 columns.

    The second form of continuous ingest, for sinks that only append: where the store keeps the copy of an id that arrived last, a stream cannot take back what it has handed on and keeps
    the first.  Records carry the time under ``event_time_key``; those without a valid one are left out, and those later than the watermark are dropped, as are copies
    up to that much later than the first.  The state is one key per id inside the watermark.
    """
    items = typed_items(page_items(pages), event_time_key=event_time_key)
    records = sourced_records(accepted(items)).select(*COLUMNS).filter("record_time IS NOT NULL")
    timed = with_instant(records, "record_time").withWatermark("record_time", watermark)
    once = timed.dropDuplicatesWithinWatermark(["data_category", "id"])
    return once.withColumn("record_time", utc_clock(F.col("record_time"))).select(*COLUMNS)
