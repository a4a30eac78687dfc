"""Snapshot store: versioned Parquet for both log tables, and a current view over all versions.

    <root>/logs/version=<n>/attempt=<a>/data_category=EB|RESPONSE/record_date=<day>/*.parquet
    <root>/published/version=<n>                     what a version holds: its attempt, and rows and newest day by table
    <root>/rejected/version=<n>/*.parquet            rejected records
    <root>/problems/version=<n>/*.parquet            pages that were missing, short or unreadable
    <root>/claims/version=<n>                        taken numbers
    <root>/streams/<query>/batch=<n>                 the version that a micro-batch was given
    <root>/current/merge=<m>/data_category=.../record_date=<day>/*.parquet
    <root>/partials/merge=<m>/record_date=<day>/*.parquet      hourly figures of the error-budget rows of those days, where asked for
    <root>/manifests/<k>                             which merge holds each day of the current view, and which versions are in it

A load writes a new version in one pass and publishes it by creating one small file; readers take the newest version that has rows of their table.
A failed or empty load publishes nothing, so the previous snapshot stays readable throughout.

The current view has the newest row of each id over all versions.  Bringing it up to date rewrites the days that new versions touch, and no others, and is made
visible by the next manifest, which is created whole or not at all; of two writers at the same time one starts over.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, DataFrameReader, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnwatch.operators.partials import partials
from burnwatch.plans.staging import staged
from burnwatch.plans.tables import PARTITION, SloTables, TimeLike, as_time, in_time_range
from burnwatch.schema import COLUMNS, EB, RESPONSE, SERVICE_LOG_SCHEMA
from burnwatch.sources.pages import PAGE_SIZE, kept_pages, page_items, page_problems
from burnwatch.sources.records import ARRIVAL, accepted, good_records, rejected_records, statistics_columns, typed_items
from burnwatch.sources.timerange import resolve_range

#: Age from which an empty marker counts as abandoned.
ABANDONED_SECONDS = 60
#: Rows of one table and day that are written as one part.
PART_ROWS = 25_000
_PART = "_part"
#: The version that a row of the current view came with.
LOADED = "loaded_version"
_CURRENT_SCHEMA = T.StructType([*SERVICE_LOG_SCHEMA.fields, T.StructField(LOADED, T.IntegerType())])


def coerced_time(df: DataFrame, column: str = "record_time") -> Column:
    """A record time as ``timestamp_ntz``: numbers are epoch milliseconds, text is parsed, anything invalid is NULL."""
    kind = df.schema[column].dataType.typeName()
    if kind in ("byte", "short", "integer", "long"):
        return F.expr(f"timestampadd(MILLISECOND, {column}, TIMESTAMP_NTZ '1970-01-01 00:00:00')")
    if kind in ("float", "double", "decimal"):
        return F.expr(f"timestampadd(MILLISECOND, try_cast({column} AS BIGINT), TIMESTAMP_NTZ '1970-01-01 00:00:00')")
    return F.col(column).try_cast("timestamp_ntz")


def clean(records: DataFrame, arrival: list[str]) -> DataFrame:
    """Valid times and ids only, and per category and id the record that arrived last.

    The last record is an aggregate, combined before the shuffle, so many copies of one id do not meet in one task.
    """
    timed = records.withColumn("record_time", coerced_time(records)).dropna(subset=["record_time", "id"])
    rest = [c for c in COLUMNS if c not in ("data_category", "id")]
    return (
        timed.groupBy("data_category", "id")
        .agg(F.max_by(F.struct(*rest), F.struct(*arrival)).alias("_last"))
        .select("data_category", "id", "_last.*")
        .select(*COLUMNS)
    )


def day_parts(rows: DataFrame) -> int:
    """In how many parts to write each day of a table: by the rows of the largest, so that few days are not few tasks."""
    most = rows.groupBy("data_category", PARTITION).count().agg(F.max("count")).first()[0]
    return max(math.ceil((most or 0) / PART_ROWS), 1)


def _by_day(rows: DataFrame, parts: int) -> DataFrame:
    """Rows ready to be written by table and day.  Rebalancing evens out the files of a day and joins small parts."""
    return (
        rows.withColumn(_PART, F.pmod(F.hash("id"), F.lit(parts)))
        .hint("rebalance", "data_category", PARTITION, _PART)
        .drop(_PART)
        .sortWithinPartitions("data_category", PARTITION, "service_name")
    )


@dataclass(frozen=True)
class LoadResult:
    version: int
    statistics: dict[str, int]
    published: tuple[str, ...]
    problems: dict[str, int] = field(default_factory=dict)


class SnapshotStore:
    """``partials=True`` keeps hourly figures (see ``operators.partials``) of every day of the current view beside its rows."""

    def __init__(self, spark: SparkSession, root: str, *, partials: bool = False):
        self.spark = spark
        self.root = root.rstrip("/")
        self._keep_partials = partials
        self._known: dict[int, dict] = {}

    # Paths and markers go through the Hadoop file system of the path, so any shared store works.

    def _fs(self, path: str):
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm_path

    def _version_dir(self, version: int) -> str:
        return f"{self.root}/logs/version={version}"

    def _names(self, folder: str) -> list[str]:
        """What stands in a folder, by one listing."""
        fs, p = self._fs(f"{self.root}/{folder}")
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _create(self, path: str, text: str = "") -> bool:
        """Create a small file; False if it is there already.

        A file that should have content and has stood empty for a while is what a writer left that died between two steps; it is written anew.
        """
        fs, p = self._fs(path)
        try:
            out = fs.create(p, False)
        except Exception:
            if not fs.exists(p):
                raise
            status = fs.getFileStatus(p)
            if not text or status.getLen() > 0 or time.time() - status.getModificationTime() / 1000 < ABANDONED_SECONDS:
                return False
            out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _read(self, path: str) -> str:
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _published(self) -> dict[int, dict]:
        """What each published version holds.  Published files never change, so each is read once."""
        for name in self._names("published"):
            version = int(name.split("=")[1])
            if version not in self._known:
                text = self._read(f"{self.root}/published/{name}")
                if text:  # else it is being written just now
                    self._known[version] = json.loads(text)
        return dict(sorted(self._known.items()))

    def versions(self, category: str | None = None) -> list[int]:
        """Version numbers in ascending order: all, or those in which the given table is published."""
        if category is None:
            return sorted(int(name.split("=")[1]) for name in self._names("logs"))
        return [v for v, held in self._published().items() if category in held["tables"]]

    def _reader(self, base: str = "logs", schema: T.StructType = SERVICE_LOG_SCHEMA) -> DataFrameReader:
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{base}")

    def claim(self) -> int:
        """A version number of the caller's own: writers at the same time get different ones."""
        version = max(self.versions() + [int(name.split("=")[1]) for name in self._names("claims")], default=-1) + 1
        while not self._create(f"{self.root}/claims/version={version}"):
            version += 1
        return version

    def write(self, records: DataFrame, version: int | None = None, problems: dict[str, int] | None = None, parts: int = 1) -> LoadResult:
        """Write cleaned records of both categories as a new version, each day in ``parts``, and publish it if it has rows.

        The counts are observed on the rows as they are written, after the last shuffle: there a task that is run again counts once, since Spark
        takes the figures of the first run of each partition only.  Every attempt has a folder of its own, so nothing is written over.
        """
        if version is None:
            version = self.claim()
        attempt = f"attempt=a{uuid.uuid4().hex}"
        rows = records.withColumn(PARTITION, F.col("record_time").cast("date"))
        newest = {c: F.max(F.when(F.col("data_category") == c, F.col(PARTITION))).cast("string").alias(c) for c in (EB, RESPONSE)}
        seen = Observation()
        (
            _by_day(rows, parts)
            .observe(seen, *statistics_columns(), *newest.values())
            .write.partitionBy("data_category", PARTITION)
            .parquet(f"{self._version_dir(version)}/{attempt}")
        )
        statistics = dict(seen.get)
        days = {c: statistics.pop(c) for c in (EB, RESPONSE)}
        tables = {c: {"rows": statistics[n], "newest_day": days[c]} for c, n in ((EB, "eb_records"), (RESPONSE, "response_records")) if statistics[n] > 0}
        if tables:
            self._create(f"{self.root}/published/version={version}", json.dumps({"attempt": attempt, "tables": tables}))
        return LoadResult(version, statistics, tuple(tables), problems or {})

    def load_pages(
        self,
        pages: DataFrame,
        *,
        page_size: int = PAGE_SIZE,
        ingest_time: TimeLike = None,
        event_time_key: str | None = None,
        stop_at_short_page: bool = False,
        version: int | None = None,
    ) -> LoadResult:
        """One refresh: parse pages once into a staging table, split off rejects and page problems, clean and publish.

        Every landed page is loaded unless ``stop_at_short_page`` asks for a server's sequence.  A refresh without records publishes nothing; it is an
        error only if there were pages and none could be read.
        """
        if version is None:
            version = self.claim()
        staging = f"{self.root}/staging/version={version}-{uuid.uuid4().hex}"
        try:
            items = staged(typed_items(page_items(pages), ingest_time, event_time_key), staging)
            problems = page_problems(pages, items, page_size)
            problems.write.mode("overwrite").parquet(f"{self.root}/problems/version={version}")
            counts = {row["reason"]: row["count"] for row in self.problems(version).groupBy("reason").count().collect()}
            if counts.get("unreadable") and items.filter("page_items IS NOT NULL").isEmpty():
                raise ValueError("no page could be read")
            kept = kept_pages(items, page_size) if stop_at_short_page else items
            rejected_records(kept).write.mode("overwrite").parquet(f"{self.root}/rejected/version={version}")
            parts = day_parts(accepted(items).withColumn(PARTITION, F.col("record_time").cast("date")))
            return self.write(clean(good_records(kept), ARRIVAL), version, counts, parts)
        finally:
            fs, p = self._fs(staging)
            fs.delete(p, True)

    def load_batch(self, pages: DataFrame, stream: str, batch: int) -> LoadResult | None:
        """Load a micro-batch once and bring the current view up to date.

        The batch is given its version before anything is written, and a replay uses the same one: if it is published, there is nothing
        left to load; if not, a new attempt is written and published under that number, which only one attempt can take.
        """
        given = f"{self.root}/streams/{stream}/batch={batch}"
        while not self._exists(given) or not self._read(given):
            if not self._create(given, str(self.claim())):
                time.sleep(1)
        version = int(self._read(given))
        result = None if version in self._published() else self.load_pages(pages, version=version)
        self.update_current()
        return result

    # --- the current view ---

    def _manifest(self) -> tuple[int, dict]:
        """Number and content of the newest manifest.  A file that is still being written is empty and passed over."""
        for number in sorted(map(int, self._names("manifests")), reverse=True):
            text = self._read(f"{self.root}/manifests/{number}")
            if text:
                return number, json.loads(text)
        return -1, {"days": {EB: {}, RESPONSE: {}}, "versions": []}

    def _pending(self, manifest: dict) -> list[int]:
        merged = {v for low, high in manifest["versions"] for v in range(low, high + 1)}
        return [v for v in self._published() if v not in merged]

    def _rows_of(self, versions: Iterable[int], category: str | None = None) -> DataFrame:
        """Rows of published versions, with the version and the day of each."""
        held = self._published()
        paths = [
            f"{self._version_dir(v)}/{held[v]['attempt']}" + (f"/data_category={category}" if category else "")
            for v in versions if category is None or category in held[v]["tables"]
        ]
        return self._reader().parquet(*paths).select(*COLUMNS, PARTITION, F.col("version").cast("int").alias(LOADED))

    def _rows_of_days(self, days: dict[str, dict[str, str]]) -> DataFrame | None:
        paths = [f"{self.root}/current/{merge}/data_category={c}/{PARTITION}={day}" for c, held in days.items() for day, merge in held.items()]
        return self._reader("current", _CURRENT_SCHEMA).parquet(*paths).select(*COLUMNS, PARTITION, LOADED) if paths else None

    @staticmethod
    def _newest(rows: DataFrame) -> DataFrame:
        rest = [c for c in [*COLUMNS, PARTITION, LOADED] if c not in ("data_category", "id")]
        last = rows.groupBy("data_category", "id").agg(F.max_by(F.struct(*rest), LOADED).alias("_last"))
        return last.select("data_category", "id", "_last.*").select(*COLUMNS, PARTITION, LOADED)

    @staticmethod
    def _days_of(rows: DataFrame) -> set[tuple[str, str]]:
        return {(r[0], str(r[1])) for r in rows.select("data_category", PARTITION).distinct().collect()}

    def update_current(self) -> int:
        """Merge versions that are not in the current view yet; the number of them.

        Touched are the days of the new rows and the days on which rows of their ids lie now; only these are read and written, the latter found from the id column.
        """
        while True:
            number, manifest = self._manifest()
            pending = self._pending(manifest)
            if not pending:
                return 0
            rows = self._rows_of(pending)
            days = manifest["days"]
            if len(pending) == 1:
                newest = rows
            else:
                newest = rows.groupBy("data_category", "id").agg(F.max_by(PARTITION, LOADED).alias(PARTITION))
            touched = self._days_of(newest)
            # Whole rows are compared once, below; up to there only days and ids are read.
            rest = self._rows_of_days({c: {d: m for d, m in held.items() if (c, d) not in touched} for c, held in days.items()})
            if rest is not None:
                touched |= self._days_of(rest.join(rows.select("data_category", "id"), ["data_category", "id"], "left_semi"))
            base = self._rows_of_days({c: {d: m for d, m in held.items() if (c, d) in touched} for c, held in days.items()})
            rows = rows if base is None else base.unionByName(rows)
            merge = f"merge=m{uuid.uuid4().hex}"
            (
                _by_day(self._newest(rows), day_parts(rows))
                .write.partitionBy("data_category", PARTITION)
                .parquet(f"{self.root}/current/{merge}")
            )
            after = {c: {d: m for d, m in held.items() if (c, d) not in touched} for c, held in days.items()}
            if self._keep_partials and self._exists(f"{self.root}/current/{merge}/data_category={EB}"):
                written = self._reader("current", _CURRENT_SCHEMA).parquet(f"{self.root}/current/{merge}/data_category={EB}").select(*COLUMNS)
                figures = partials(SloTables.from_pair(written, written.limit(0)))
                figures.hint("rebalance", PARTITION).write.partitionBy(PARTITION).parquet(f"{self.root}/partials/{merge}")
            for c in (EB, RESPONSE):
                for name in self._names(f"current/{merge}/data_category={c}"):
                    after[c][name.split("=")[1]] = merge
            merged = {v for low, high in manifest["versions"] for v in range(low, high + 1)} | set(pending)
            if self._create(f"{self.root}/manifests/{number + 1}", json.dumps({"days": after, "versions": _ranges(merged)})):
                return len(pending)
            time.sleep(1)

    def vacuum(self) -> int:
        """Delete merges that the newest manifest does not name; call it when no reader holds an older view."""
        _, manifest = self._manifest()
        used = {merge for held in manifest["days"].values() for merge in held.values()}
        unused = [m for m in self._names("current") if m not in used]
        for merge in unused:
            for folder in ("current", "partials"):
                fs, p = self._fs(f"{self.root}/{folder}/{merge}")
                fs.delete(p, True)
        return len(unused)

    def partials(self) -> DataFrame:
        """Hourly figures of all days of the current view, as of its last update; risk and history come from them without reading the logs."""
        _, manifest = self._manifest()
        paths = [f"{self.root}/partials/{merge}/{PARTITION}={day}" for day, merge in manifest["days"][EB].items()]
        missing = sorted({merge for merge in manifest["days"][EB].values()} - set(self._names("partials")))
        if missing or not paths:
            raise ValueError("the current view is empty or has days that were merged without partials")
        return self.spark.read.option("basePath", f"{self.root}/partials").parquet(*paths).drop("merge")

    # --- readers ---

    def problems(self, version: int) -> DataFrame:
        """``(sequence, page_id, path, reason)`` of a load's pages."""
        return self.spark.read.parquet(f"{self.root}/problems/version={version}")

    def rejected(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/rejected/version={version}")

    def table(self, category: str, *, history: bool = False, latest: bool = False) -> DataFrame:
        """The newest published snapshot of one table; all published ones with ``history``; the newest row per id with ``latest``."""
        return self._table(category, history, latest)[0]

    def _table(self, category: str, history: bool, latest: bool) -> tuple[DataFrame, date | None]:
        """The rows, and their newest day where the markers tell it."""
        if latest:
            _, manifest = self._manifest()
            days = manifest["days"][category]
            rows = self._rows_of_days({category: days})
            pending = [v for v in self._pending(manifest) if category in self._published()[v]["tables"]]
            if pending:
                new = self._rows_of(pending, category)
                return self._newest(new if rows is None else rows.unionByName(new)).drop(LOADED), None
            if rows is not None:
                return rows.drop(LOADED), date.fromisoformat(max(days))
        else:
            versions = self.versions(category)
            chosen = versions if history else versions[-1:]
            if chosen:
                newest = max(self._published()[v]["tables"][category]["newest_day"] for v in chosen)
                return self._rows_of(chosen, category).drop(LOADED), date.fromisoformat(newest)
        empty = self.spark.createDataFrame([], SERVICE_LOG_SCHEMA)
        return empty.withColumn(PARTITION, F.col("record_time").cast("date")), None

    def tables(
        self,
        *,
        history: bool = False,
        latest: bool = False,
        start: TimeLike = None,
        end: TimeLike = None,
        last_days: int | None = None,
        today: date | None = None,
    ) -> SloTables:
        """Both tables (see ``table``), of records between two times where given; the days outside are not read.

        ``last_days`` asks for whole days up to ``today``, as ``resolve_range`` has them, instead of two times.
        """
        found = {c: self._table(c, history, latest) for c in (EB, RESPONSE)}
        if last_days is not None:
            low, high = (F.lit(t) for t in resolve_range(today or date.today(), last_days=last_days))
            eb, resp = (in_time_range(rows, low, high, closed=False) for rows, _ in found.values())
            return SloTables.from_pair(eb, resp)
        low, high = as_time(start), as_time(end)
        eb, resp = (in_time_range(rows, low, high) for rows, _ in found.values())
        return SloTables.from_pair(eb, resp, newest_day=found[EB][1] if low is None and high is None else None)


def _ranges(numbers: set[int]) -> list[list[int]]:
    """Numbers as runs of consecutive ones, ``[first, last]`` each."""
    out: list[list[int]] = []
    for n in sorted(numbers):
        if out and out[-1][1] == n - 1:
            out[-1][1] = n
        else:
            out.append([n, n])
    return out
