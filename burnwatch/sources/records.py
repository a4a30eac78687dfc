"""Items -> typed service-log records.

An absent key takes its default.  A present value that does not cast, or an explicit null where a number is needed, rejects
the whole record, which is kept apart with the names of the offending keys.  Each item is read as VARIANT, which tells
absent from null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnwatch.plans.tables import TimeLike, as_time
from burnwatch.schema import COLUMNS, EB, FIELDS, RESPONSE, UNHEALTHY, Field
from burnwatch.sources.pages import PAGE_SIZE, kept_pages, no_data_found, page_items, page_offsets

BURN_ALERT = 2.0
#: Columns that order records as they arrived.
ARRIVAL = ["sequence", "page_id", "pos"]

_PERCENTILES = "avgPercentiles"
_TYPES = {"int": "INT", "int_or_zero": "INT", "float": "DOUBLE", "str": "STRING"}


def _member(frame: str, key: str) -> str:
    """A member in one of the readings of the item; a percentile key has a dot in its own name."""
    parent, _, child = key.partition(".")
    return f"{frame}.{parent}.`{child}`" if child else f"{frame}.{parent}"


def _typed(key: str) -> str:
    """The member in its column's type; NULL when it is absent, null or does not cast."""
    return _member("_typed", key)


def _raw(key: str) -> str:
    """The member as it is: SQL NULL for an absent key, a variant null for an explicit one."""
    return _member("_raw", key)


def _readings() -> tuple[str, str]:
    """Two casts of the whole item to a struct, typed and raw.

    Each walks the item once, which is much cheaper than looking up some eighty members one by one.
    """
    members = {"key": "STRING", "transactionId": "INT", "transactionName": "STRING", "sumResponseTime": "DOUBLE"}
    percentiles: dict[str, str] = {}
    for f in FIELDS:
        if f.cast in _TYPES:
            parent, _, child = f.key.partition(".")
            (percentiles if child else members)[child or parent] = _TYPES[f.cast]
    flags = [f.key for f in FIELDS if f.cast == "bool"]

    def struct(columns: dict[str, str]) -> str:
        return "STRUCT<" + ", ".join(f"`{name}`: {dtype}" for name, dtype in columns.items()) + ">"

    typed = members | {_PERCENTILES: struct(percentiles)}
    raw = dict.fromkeys([*members, *flags], "VARIANT") | {_PERCENTILES: struct(dict.fromkeys(percentiles, "VARIANT"))}
    return f"try_variant_get(item, '$', '{struct(typed)}')", f"try_variant_get(item, '$', '{struct(raw)}')"


def _kind(value: str) -> str:
    return f"schema_of_variant({value})"


def _text(key: str) -> str:
    """Text of a present value; an explicit null reads ``None``.  NULL only for an absent key."""
    raw = _raw(key)
    return f"CASE WHEN is_variant_null({raw}) THEN 'None' ELSE try_variant_get({raw}, '$', 'string') END"


def _truth(key: str) -> str:
    """Truth of a value: null, false, zero and anything empty are false."""
    raw = _raw(key)
    kind, text = _kind(raw), f"try_variant_get({raw}, '$', 'string')"
    return f"""CASE WHEN {raw} IS NULL OR is_variant_null({raw}) THEN false
        WHEN {kind} = 'STRING' THEN length({text}) > 0
        WHEN startswith({kind}, 'OBJECT') OR startswith({kind}, 'ARRAY') THEN {text} NOT IN ('{{}}', '[]')
        ELSE coalesce(try_variant_get({raw}, '$', 'double') <> 0, true) END"""


# Columns with a rule of their own.  ``id`` stays NULL when only the arrival position can name the record.
_SPECIAL = {
    "id": f"coalesce({_text('key')}, concat('platform_', {_text('transactionId')}))",
    "app_id": "NULL",
    "sid": _typed("transactionId"),
    "service_name": f"CASE WHEN {_raw('transactionName')} IS NULL THEN 'Unknown' ELSE {_typed('transactionName')} END",
    "record_time": "_ingest_time",
    "response_time_max": (
        f"coalesce({_typed('sumResponseTime')}, 0D)"
        f" / greatest(coalesce(try_variant_get({_raw('totalCount')}, '$', 'double'), 1D), 1D)"
    ),
}


def _value(field: Field) -> str:
    if field.cast == "float":
        return f"nanvl(coalesce({_typed(field.key)}, {field.default}D), NULL)"
    if field.cast in ("int", "int_or_zero"):
        return f"coalesce({_typed(field.key)}, {field.default})"
    if field.cast == "bool":
        return _truth(field.key)
    if field.cast == "str":
        absent_or_null = f"CASE WHEN is_variant_null({_raw(field.key)}) THEN 'None' ELSE '{field.default}' END"
        return f"coalesce({_typed(field.key)}, {absent_or_null})"
    return _SPECIAL[field.column]


def _faults() -> dict[str, str]:
    """Per key, the condition that rejects the record."""

    def unusable(key: str) -> str:
        return f"({_typed(key)} IS NULL AND {_raw(key)} IS NOT NULL)"

    def miscast(key: str) -> str:
        """A present value that is no number, where an explicit null is fine."""
        return f"({_typed(key)} IS NULL AND {_raw(key)} IS NOT NULL AND NOT is_variant_null({_raw(key)}))"

    # Only an object casts to a struct.
    faults = {
        "item": "item IS NOT NULL AND _typed IS NULL",
        _PERCENTILES: f"{_typed(_PERCENTILES)} IS NULL AND try_variant_get(item, '$.{_PERCENTILES}', 'variant') IS NOT NULL",
        "transactionId": miscast("transactionId"),
    }
    for field in FIELDS:
        if field.cast in ("int", "float"):
            faults[field.key] = unusable(field.key)
        elif field.cast == "int_or_zero":
            faults[field.key] = miscast(field.key)
    # These two take part in a division, where text does not pass for a number.
    for key in ("totalCount", "sumResponseTime"):
        faults[key] = f"({unusable(key)} OR {_kind(_raw(key))} = 'STRING')"
    return faults


def event_time(key: str) -> str:
    """The time that an item carries: a number is epoch milliseconds, text is parsed, anything else is NULL."""
    value = f"try_variant_get(item, '$.{key}', 'variant')"
    return f"""CASE WHEN schema_of_variant({value}) = 'STRING' THEN try_cast(try_variant_get(item, '$.{key}', 'string') AS TIMESTAMP_NTZ)
        ELSE timestampadd(MILLISECOND, try_variant_get(item, '$.{key}', 'bigint'), TIMESTAMP_NTZ '1970-01-01 00:00:00') END"""


def typed_items(items: DataFrame, ingest_time: TimeLike = None, event_time_key: str | None = None) -> DataFrame:
    """``page_items`` rows with the 83 columns, ``bad_keys``, and the JSON text of items that have any.

    A no-data item becomes a placeholder with ``is_record`` false, like the row of an empty page: it carries its page
    through the cut of the sequence and is no record.  Records carry the time of the load, or with ``event_time_key`` the time
    under that key of the item.  ``has_id`` tells records that name themselves from those named by their place.

    The readings of an item and the check of its keys are rows of their own (``inline``, ``explode``): a filter on what is derived from them then works on the finished values,
    where it would otherwise be pushed below them and repeat the casts of the whole item for every key it touches.
    """
    stamp = F.localtimestamp() if ingest_time is None else as_time(ingest_time)
    if event_time_key is not None:
        stamp = F.expr(event_time(event_time_key))
    usable = items.withColumn("item", F.when(~no_data_found(F.col("item")), F.col("item")))
    bad = ", ".join(f"CASE WHEN {fault} THEN '{key}' END" for key, fault in _faults().items())
    page = ["sequence", "page_id", "page_items", "page_ends", "pos", "is_record", "has_id"]
    typed, raw = _readings()
    has = " OR ".join(f"try_variant_get(item, '$.{key}', 'variant') IS NOT NULL" for key in ("key", "transactionId"))
    return (
        usable.withColumn("_ingest_time", stamp)
        .selectExpr("*", "item IS NOT NULL AS is_record", f"{has} AS has_id")
        .selectExpr("*", f"inline(array(named_struct('_typed', {typed}, '_raw', {raw})))")
        .selectExpr("*", f"explode(array(array_compact(array({bad})))) AS bad_keys")
        .selectExpr(
            *page,
            "bad_keys",
            "CASE WHEN size(bad_keys) > 0 THEN to_json(item) END AS source",
            *[f"CAST({_value(field)} AS {field.dtype}) AS {field.column}" for field in FIELDS],
        )
    )


def good_records(typed: DataFrame) -> DataFrame:
    """Accepted records of both categories with their arrival position, every record with an id.

    A record without key and transaction is named by its place: sequence, page and position where its page has a sequence, else its number in the whole sequence.
    """
    good = accepted(typed)
    named = sourced_records(good.filter("has_id OR sequence <> ''"))
    # Only the nameless records of a nameless sequence need their position in the whole of it.
    placed = good.filter("NOT has_id AND sequence = ''").join(page_offsets(typed), "page_id")
    by_position = F.concat(F.lit("platform_"), (F.col("page_offset") + F.col("pos")).cast("string"))
    return named.unionByName(placed.withColumn("id", by_position).select(*COLUMNS, *ARRIVAL))


def accepted(typed: DataFrame) -> DataFrame:
    return typed.filter(F.col("is_record") & (F.size("bad_keys") == 0) & F.col("data_category").isin(EB, RESPONSE))


def sourced_records(good: DataFrame) -> DataFrame:
    """Accepted records that name themselves or whose page is of a named sequence; row by row, so that it works on a stream."""
    place = F.concat(F.lit("platform_"), "sequence", F.lit(":"), F.col("page_id").cast("string"), F.lit(":"), F.col("pos").cast("string"))
    return good.withColumn("id", F.coalesce("id", place)).select(*COLUMNS, *ARRIVAL)


def rejected_records(typed: DataFrame) -> DataFrame:
    """Rejected records with the keys at fault and their JSON text."""
    return typed.filter(F.col("is_record") & (F.size("bad_keys") > 0)).select("sequence", "page_id", "pos", "bad_keys", "source")


def records_from_pages(
    pages: DataFrame,
    *,
    page_size: int = PAGE_SIZE,
    ingest_time: TimeLike = None,
    event_time_key: str | None = None,
    stop_at_short_page: bool = False,
) -> DataFrame:
    """``(page_id, body)`` to typed items of every page; nothing runs before the result is used.

    ``stop_at_short_page`` keeps only pages inside a server's sequence (see ``kept_pages``).
    """
    items = page_items(pages)
    if stop_at_short_page:
        items = kept_pages(items, page_size)
    return typed_items(items, ingest_time, event_time_key)


def statistics_columns() -> list[Column]:
    """Counts over loaded records of both categories, as aggregates."""
    is_eb = F.col("data_category") == EB
    unhealthy = F.col("eb_health") == UNHEALTHY
    either = unhealthy | (F.col("response_health") == UNHEALTHY)
    return [
        F.count_if(is_eb).alias("eb_records"),
        F.count_if(F.col("data_category") == RESPONSE).alias("response_records"),
        F.count_if(is_eb & either).alias("unhealthy_records"),
        F.count_if(is_eb & unhealthy).alias("eb_unhealthy_records"),
        F.count_if(is_eb & (F.col("burn_rate") > BURN_ALERT)).alias("high_burn_records"),
    ]


def load_statistics(logs: DataFrame) -> DataFrame:
    """One row of counts over loaded records of both categories."""
    return logs.agg(*statistics_columns())
