"""The registered queries: every operator run over tables derived from the whole of ``events``.

Results are flat (no nested columns) and doubles are rounded, so that they can be compared with SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burnwatch.contract.fixture import EVENT_RULES
from burnwatch.operators import budget, degradation, health, partials, rankings, sli, trends
from burnwatch.plans.staging import shared_dir, staged
from burnwatch.plans.tables import (
    SloTables,
    all_services,
    latest_time,
    minutes,
    run_sql,
    service_logs,
    time_range,
)
from burnwatch.registry import answered, json_rows
from burnwatch.schema import SERVICE_LOG_SCHEMA
from burnwatch.sources import pages as page_source
from burnwatch.sources import records
from burnwatch.sources.rollup import daily_tables
from burnwatch.sources.store import SnapshotStore, clean
from burnwatch.streaming.alerts import alert_changes, burn_alerts
from burnwatch.streaming.burn import sliding_burn_rate

Query = Callable[[SparkSession, str], DataFrame]

DIGITS = 6
# Daily percentiles have at most six decimals, so their averages over days can fall on a rounding tie in the sixth place, where
# two right sums may differ.  In the ninth place there is no tie unless the number of days is a multiple of 16.
LATENCY_DIGITS = 9
WEEK_MINUTES = 7 * 24 * 60
SERVICE = "svc_3"


# Given, so that opening the table costs no job to infer it.
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")


def tables(spark: SparkSession, sf_dir: str, *, quantiles: bool = False) -> SloTables:
    return daily_tables(events(spark, sf_dir), EVENT_RULES, quantiles=quantiles)


def digits(name: str) -> int:
    """Places to round a column to: more for latencies (response time, p50, p95, p99)."""
    latency = any(part in name for part in ("response_time", "response_slo", "_p50", "_p95", "_p99"))
    return LATENCY_DIGITS if latency and "change" not in name and "slope" not in name else DIGITS


def rounded(df: DataFrame) -> DataFrame:
    """All doubles rounded."""
    return df.selectExpr(
        *[
            f"round(`{f.name}`, {digits(f.name)}) AS `{f.name}`" if f.dataType.typeName() == "double" else f"`{f.name}`"
            for f in df.schema
        ]
    )


def flattened(df: DataFrame) -> DataFrame:
    """Structs opened one level, ``outer_inner``."""
    out = []
    for f in df.schema:
        if f.dataType.typeName() == "struct":
            out += [f"{f.name}.{inner.name} AS {f.name}_{inner.name}" for inner in f.dataType]
        else:
            out.append(f.name)
    return df.selectExpr(*out)


def _over_tables(operator: Callable[..., DataFrame], *, quantiles: bool = False, **parameters) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(flattened(operator(tables(spark, sf_dir, quantiles=quantiles), **parameters)))

    return query


def _at_latest(operator: Callable[..., DataFrame], *, quantiles: bool = False, **parameters) -> Query:
    """An operator whose window ends at the newest record instead of at the wall clock."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = tables(spark, sf_dir, quantiles=quantiles)
        return rounded(flattened(operator(t, as_of=latest_time(t.eb), **parameters)))

    return query


def slo_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sli.slo_violations(tables(spark, sf_dir))
    return rounded(
        found.select(
            "service_name",
            F.array_join("violation_codes", "|").alias("violation_codes"),
            F.size("violations").cast("bigint").alias("n_violations"),
            "error_rate",
            "response_time",
            "total_requests",
        )
    )


def _risk(operator: Callable[..., DataFrame]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _flat_risk(operator(tables(spark, sf_dir)))

    return query


def _flat_risk(found: DataFrame) -> DataFrame:
    return rounded(
        flattened(found).withColumn("risk_codes", F.array_join("risk_codes", "|"))
        .withColumn("n_factors", F.size("risk_factors").cast("bigint"))
        .withColumn("risk_score", F.col("risk_score").cast("bigint"))
        .drop("risk_factors")
    )


def historical_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(flattened(trends.historical_patterns(tables(spark, sf_dir)).drop("hourly_patterns")))


def hourly_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_hour(trends.historical_patterns(tables(spark, sf_dir)))


def daily_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both log tables in all their columns."""
    return rounded(tables(spark, sf_dir, quantiles=True).logs)


def all_service_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(service_logs(tables(spark, sf_dir, quantiles=True)))


def service_logs_of_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir, quantiles=True)
    end = latest_time(t.eb)
    return rounded(service_logs(t, SERVICE, end - minutes(WEEK_MINUTES), end, limit=5))


def adhoc_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        run_sql(
            tables(spark, sf_dir),
            """
            SELECT e.service_name, count(*) AS days, avg(e.error_rate) AS avg_error_rate
            FROM service_logs_eb e
            WHERE e.error_rate > :floor
              AND EXISTS (SELECT 1 FROM service_logs_response r WHERE r.service_name = e.service_name)
            GROUP BY e.service_name
            """,
            {"floor": 20.0},
        )
    )


def composite_health_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoded rows, read back, which shows that encoding keeps every value."""
    scores = health.composite_health_score(tables(spark, sf_dir))
    decoded = json_rows(scores).select(F.from_json("value", scores.schema).alias("row"))
    return rounded(decoded.select("row.*"))


def composite_health_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoded rows as text."""
    return json_rows(rounded(health.composite_health_score(tables(spark, sf_dir))))


def window_burn_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sliding_burn_rate(events(spark, sf_dir), EVENT_RULES, window="6 hours", slide="1 hour"))


def window_burn_rate_uneven(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window that is no multiple of its slide."""
    return rounded(sliding_burn_rate(events(spark, sf_dir), EVENT_RULES, window="90 minutes", slide="1 hour"))


#: Burn rates that raise and clear an alert in the registered queries.
RAISE_AT, CLEAR_AT = 1.2, 0.8


def _six_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliding_burn_rate(events(spark, sf_dir), EVENT_RULES, window="6 hours", slide="1 hour")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(burn_alerts(_six_hours(spark, sf_dir), RAISE_AT, CLEAR_AT))


def alert_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(alert_changes(_six_hours(spark, sf_dir), RAISE_AT, CLEAR_AT))


# --- by the hour, and from stored figures ---


def hourly_tables(spark: SparkSession, sf_dir: str) -> SloTables:
    return daily_tables(events(spark, sf_dir), EVENT_RULES, quantiles=False, grain="HOUR")


def hours_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map by hour of day over logs by the hour, so that all 24 hours are in it."""
    return _by_hour(trends.historical_patterns(hourly_tables(spark, sf_dir)))


def _by_hour(found: DataFrame) -> DataFrame:
    hours = found.select("service_name", F.explode("hourly_patterns").alias("hour", "pattern"))
    return rounded(hours.select("service_name", F.col("hour").cast("bigint").alias("hour"), "pattern.error_rate", "pattern.response_time_avg", "pattern.total_count"))


def stored_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(partials.partials(hourly_tables(spark, sf_dir)), f"{shared_dir(spark)}/partials-{uuid.uuid4().hex}")


def hours_of_day_from_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_hour(partials.history_from(stored_partials(spark, sf_dir)))


def risk_from_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_risk(partials.risk_from(stored_partials(spark, sf_dir)))


def history_from_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole history from stored figures; of the quantiles, whether their rank is as near as it should be."""
    found = flattened(partials.history_from(stored_partials(spark, sf_dir)).drop("hourly_patterns"))
    points = [f"{stats}_stats_p{p}" for stats in ("error_rate", "response_time") for p in (50, 95, 99)]
    logs = hourly_tables(spark, sf_dir).eb.join(found.select("service_name", *points), "service_name")
    shares = []
    for point in points:
        column = "error_rate" if point.startswith("error") else "response_time_avg"
        fraction = int(point[-2:]) / 100
        under, upto = F.avg((F.col(column) < F.col(point)).cast("int")), F.avg((F.col(column) <= F.col(point)).cast("int"))
        shares.append(((under <= fraction + partials.RANK_ERROR) & (upto >= fraction - partials.RANK_ERROR)).alias(f"{point}_near"))
    near = logs.groupBy("service_name").agg(*shares)
    return rounded(found.drop(*points).join(near, "service_name"))


def answers_for_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budgets of the services asked for: a record for each, also for one that there is no data of."""
    t = tables(spark, sf_dir)
    found = sli.error_budget(t, time_window_hours=168, as_of=latest_time(t.eb))
    return rounded(answered(found, ["svc_3", "svc_99", "svc_7"])).drop("time_window_hours")


# --- ingest: every event becomes one JSON item of a page of 200 ---

#: Parts that pages are dealt to, for each core.
PARTS_PER_CORE = 4

def _member(key: str, value: Column) -> Column:
    """``"key":value`` as JSON text; NULL (no member) when the value is NULL."""
    return F.concat(F.lit(f'"{key}":'), value)


def event_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(page_id, body)``: items with missing, null, text and malformed members, repeated keys and skipped records.

    Three items in a row share a key, keys are left out for every eleventh event and then also the transaction
    for every third of those.
    """
    n = F.col("event_id")

    def every(k: int, then, otherwise=None):
        return F.when(n % k == 0, then).otherwise(otherwise)

    text = n.cast("string")
    item = F.concat(
        F.lit("{"),
        F.concat_ws(
            ",",
            _member("key", F.when(n % 11 != 0, F.concat(F.lit('"rec_'), F.floor(n / 3).cast("string"), F.lit('"')))),
            _member("transactionId", F.when((n % 11 != 0) | (n % 3 != 0), text)),
            _member("transactionName", every(19, F.lit("null"), F.concat(F.lit('"svc_'), (F.col("user_id") % 10).cast("string"), F.lit('"')))),
            _member("totalCount", F.when(n % 13 == 0, "null").when(n % 17 != 0, (n % 1000).cast("string"))),
            _member("errorCount", F.when(n % 23 == 0, '"1.5"').otherwise(F.concat(F.lit('"'), (n % 7).cast("string"), F.lit('"')))),
            _member("errorRate", F.col("value").cast("string")),
            _member("sumResponseTime", F.col("value").cast("string")),
            _member("avgPercentiles", every(29, F.lit("null"), F.concat(F.lit('{"95.0":'), F.col("value").cast("string"), F.lit("}")))),
            _member("burnRate", (F.col("value") / 50).cast("string")),
            _member("ebHealth", F.when(F.col("value") > 150, '"UNHEALTHY"').when(n % 5 == 0, "null")),
            _member("ebBreached", every(2, F.lit('"false"'), F.lit("null"))),
            _member("projectId", every(3, F.lit("null"), text)),
            _member("noDataFound", every(31, F.lit("true"))),
            _member(
                "dataCategory",
                F.when(F.col("event_type") == "error", '"RESPONSE"')
                .when(F.col("event_type") == "view", '"OTHER"')
                .when(F.col("event_type") == "click", "null")
                .when(F.col("event_type") == "signup", '"EB"'),
            ),
        ),
        F.lit("}"),
    )
    size = page_source.PAGE_SIZE
    # event_id is unique, so a page gathers at most 200 items.  Parsing a page takes long for its bytes: by bytes alone Spark would join the pages to
    # about one part per core, and one part more than cores takes twice the time.
    return (
        events(spark, sf_dir)
        .select(F.floor(n / size).alias("page_id"), n.alias("n"), item.alias("item"))
        .repartition(PARTS_PER_CORE * spark.sparkContext.defaultParallelism, "page_id")
        .groupBy("page_id")
        .agg(F.sort_array(F.collect_list(F.struct("n", "item"))).alias("items"))
        .select(
            "page_id",
            F.concat(F.lit('{"summary":['), F.array_join(F.col("items.item"), ","), F.lit("]}")).alias("body"),
        )
    )


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.records_from_pages(event_pages(spark, sf_dir), ingest_time="2024-02-01 00:00:00")


def _loaded(typed: DataFrame) -> DataFrame:
    """Good records, cleaned. Their plan reads the typed items three times, so they are parsed once and staged, as a load does."""
    spark = typed.sparkSession
    kept = staged(typed, f"{shared_dir(spark)}/typed-{uuid.uuid4().hex}")
    return clean(records.good_records(kept), records.ARRIVAL)


_INGEST_COLUMNS = (
    "id",
    "sid",
    "service_name",
    "record_time",
    "total_count",
    "error_count",
    "error_rate",
    "response_time_max",
    "response_time_p95",
    "target_error_slo_perc",
    "eb_health",
    "burn_rate",
    "eb_breached",
    "project_id",
    "data_category",
)


def ingested_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to typed, deduplicated records of both categories."""
    loaded = _loaded(_typed(spark, sf_dir))
    return loaded.select(*_INGEST_COLUMNS)


def ingested_whole_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in all 83 columns."""
    return _loaded(_typed(spark, sf_dir))


def ingest_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejected = records.rejected_records(_typed(spark, sf_dir))
    return rejected.select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), F.array_join(F.sort_array("bad_keys"), "|").alias("bad_keys")
    )


def ingest_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.load_statistics(_loaded(_typed(spark, sf_dir)))


def pages_of_all_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as lists, objects, single items, short, broken, empty and missing ones."""
    page, body = F.col("page_id"), F.col("body")
    return event_pages(spark, sf_dir).filter(page % 9 != 7).select(
        page,
        F.when(page % 9 == 1, F.expr("substr(body, 12, length(body) - 12)"))
        .when(page % 9 == 2, F.concat(F.lit('{"key":"one_'), page.cast("string"), F.lit('","dataCategory":"EB"}')))
        .when(page % 9 == 3, F.lit('{"summary":[{"key":"s1"},{"key":"s2"}]}'))
        .when(page % 9 == 4, F.lit("{broken"))
        .when(page % 9 == 5, F.lit('{"summary":[]}'))
        .when(page % 9 == 6, F.lit('[{"noDataFound":true}]'))
        .otherwise(body)
        .alias("body"),
    )


def page_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = pages_of_all_forms(spark, sf_dir)
    return page_source.page_problems(landed, page_source.page_items(landed)).select("page_id", "reason")


def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is loaded of each landed page."""
    typed = records.records_from_pages(pages_of_all_forms(spark, sf_dir), ingest_time="2024-02-01 00:00:00")
    return typed.groupBy("page_id").agg(F.count_if("is_record").alias("records"), F.max("page_items").cast("bigint").alias("items"))


def cut_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of pages that were cut into parts of a few items each, as too large ones are."""
    none = F.lit(None).cast("string")
    pages = event_pages(spark, sf_dir).select("page_id", none.alias("path"), none.alias("sequence"), "body")
    parts = page_source.cut_pages(pages, part=2_000)
    typed = records.records_from_pages(parts, ingest_time="2024-02-01 00:00:00")
    return _loaded(typed).select(*_INGEST_COLUMNS)


#: Pages of a run in the query of several runs.
RUN_PAGES = 20


def runs_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of several runs, each numbered from 0; every seventh page of a run is left out."""
    page = F.col("page_id")
    run = F.concat(F.lit("run_"), F.floor(page / RUN_PAGES).cast("string"))
    pages = event_pages(spark, sf_dir).select(run.alias("sequence"), (page % RUN_PAGES).alias("page_id"), "body")
    return pages.filter("page_id % 7 <> 3")


def run_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = runs_of_pages(spark, sf_dir)
    return page_source.page_problems(landed, page_source.page_items(landed)).select("sequence", "page_id", "reason")


def run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How records of several runs are named: by key, by transaction, or by run, page and position."""
    typed = records.records_from_pages(runs_of_pages(spark, sf_dir), ingest_time="2024-02-01 00:00:00")
    return _loaded(typed).select("id", "sid", "data_category", "error_rate")


def stored_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three micro-batches in a store, one of them replayed; the newest row of each id over all of them."""
    store = SnapshotStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    pages = event_pages(spark, sf_dir)
    for batch in (0, 1, 1, 2):
        store.load_batch(pages.filter(F.col("page_id") % 3 == batch), "events", batch)
    kept = store.tables(latest=True)
    columns = [c for c in _INGEST_COLUMNS if c != "record_time"]
    return kept.eb.unionByName(kept.resp).select(*columns)


def replaced_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads, the second without response records: its error-budget records replace the others, the response records stay."""
    store = SnapshotStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    pages = event_pages(spark, sf_dir)
    store.load_pages(pages.filter("page_id % 3 = 0"))
    store.load_pages(pages.filter("page_id % 3 = 1").withColumn("body", F.replace("body", F.lit('"RESPONSE"'), F.lit('"NONE"'))))
    kept = store.tables()
    return kept.eb.unionByName(kept.resp).select("id", "data_category", "total_count", "error_rate", "eb_health")


def coerced_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as epoch milliseconds in text or number, times as text, times that are none, and ids that are missing."""
    n = F.col("event_id")
    ident = F.when(n % 10 != 3, F.concat(F.lit("i"), (n % 5000).cast("string")))
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in SERVICE_LOG_SCHEMA if f.name not in ("id", "record_time", "data_category", "total_count")]
    shared = [ident.alias("id"), F.lit("EB").alias("data_category"), (n % 100).cast("int").alias("total_count"), n.alias("n"), *rest]
    all_events = events(spark, sf_dir)
    text = F.when(n % 7 == 0, F.lit("soon")).when(n % 7 == 1, F.lit(None)).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    forms = [(0, F.lit(1_700_000_000_000) + n * 1000), (1, (F.lit(1_700_000_000_000) + n * 1000).cast("double")), (2, text)]
    parts = [clean(all_events.filter(n % 3 == form).select(*shared, time.alias("record_time")), ["n"]) for form, time in forms]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("id", "record_time", "total_count")


QUERIES: dict[str, Query] = {
    "current_sli": _over_tables(sli.current_sli, quantiles=True),
    "current_sli_one_service": _over_tables(sli.current_sli, quantiles=True, service_name=SERVICE),
    "error_budget": _at_latest(sli.error_budget, time_window_hours=168),
    "burn_rate": _at_latest(sli.burn_rate, time_window_minutes=WEEK_MINUTES),
    "slo_violations": slo_violations,
    "service_summary": _at_latest(sli.service_summary, quantiles=True, budget_hours=168, burn_minutes=WEEK_MINUTES),
    "degrading_services": _over_tables(
        degradation.degrading_services, quantiles=True, time_window_minutes=WEEK_MINUTES, threshold_percent=5.0
    ),
    "volume_trends": _over_tables(degradation.volume_trends, time_window_minutes=WEEK_MINUTES),
    "volume_summary": _over_tables(degradation.volume_summary, time_window_minutes=WEEK_MINUTES),
    "predict_issues": _risk(trends.predict_issues_today),
    "service_risk": _risk(trends.service_risk),
    "historical_patterns": historical_patterns,
    "hourly_patterns": hourly_patterns,
    "top_services_by_volume": _over_tables(rankings.top_services_by_volume, limit=5),
    "service_health_overview": _over_tables(health.service_health_overview),
    "slowest_services": _over_tables(rankings.slowest_services, quantiles=True, limit=5),
    "error_prone_services": _over_tables(rankings.error_prone_services, limit=5),
    "services_by_burn_rate": _over_tables(rankings.services_by_burn_rate, limit=5),
    "aspirational_slo_gap": _over_tables(health.aspirational_slo_gap),
    "timeliness_issues": _over_tables(health.timeliness_issues, quantiles=True),
    "breach_vs_error": _over_tables(budget.breach_vs_error_analysis, quantiles=True),
    "budget_exhausted": _over_tables(budget.budget_exhausted_services),
    "composite_health": _over_tables(health.composite_health_score),
    "composite_health_json": composite_health_json,
    "composite_health_text": composite_health_text,
    "severity_heatmap": _over_tables(health.severity_heatmap),
    "governance_status": _over_tables(health.slo_governance_status),
    "services_by_slo_status": _over_tables(health.services_by_slo_status),
    "adhoc_sql": adhoc_sql,
    "service_logs": all_service_logs,
    "service_logs_of_one": service_logs_of_one,
    "all_services": _over_tables(all_services),
    "time_range": _over_tables(time_range),
    "daily_rollup": daily_rollup,
    "window_burn_rate": window_burn_rate,
    "window_burn_rate_uneven": window_burn_rate_uneven,
    "ingested_records": ingested_records,
    "ingest_rejects": ingest_rejects,
    "page_problems": page_problems,
    "page_counts": page_counts,
    "ingest_statistics": ingest_statistics,
    "ingested_cut_pages": cut_pages,
    "run_problems": run_problems,
    "run_records": run_records,
    "ingested_whole_records": ingested_whole_records,
    "latest_records": stored_batches,
    "replaced_snapshot": replaced_snapshot,
    "coerced_times": coerced_times,
    "burn_alerts": alerts,
    "alert_changes": alert_log,
    "hours_of_day": hours_of_day,
    "hours_of_day_from_partials": hours_of_day_from_partials,
    "risk_from_partials": risk_from_partials,
    "history_from_partials": history_from_partials,
    "answers_for_asked": answers_for_asked,
}
