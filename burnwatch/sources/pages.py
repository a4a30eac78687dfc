"""Landed JSON pages -> items.

A refresh is one or more sequences of pages, each numbered from 0.  A sequence is named by the path of its files with the number left out, so pages of
two folders or two runs with equal numbers do not meet; pages without a path belong to one sequence without a name.  A page body is ``{"summary": [...]}``, a
bare list, or a single object; anything else holds no items.  Every landed page is loaded; ``page_problems`` names the pages that hold nothing readable, numbers
that are missing, and short pages before the last.

A page too large to parse as one JSON value is cut into parts at the ends of items (see ``cut_pages``); its items, their positions and its length are those of the whole.

A server that pages until it runs dry ends its sequence before an empty page, a lone no-data item, an unreadable or a missing page, and after
a page shorter than the page size.  ``kept_pages`` applies that rule where it is asked for.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAGE_SIZE = 200
#: Bytes of a page from which it is cut, and of a part; one parsed value holds 128 MiB at most.
LARGE_PAGE, PART = 32 << 20, 8 << 20
PAGES = "page_id bigint, path string, sequence string, body string, first bigint, whole_items bigint"
PAGE_KEY = ["sequence", "page_id"]


def read_page_files(spark: SparkSession, path: str, *, large_page: int = LARGE_PAGE) -> DataFrame:
    """``(page_id, path, sequence, body, first, whole_items)`` from one file per page, large ones in parts.

    Only the large files pass through the cut; the size is known from the listing, so each file is read once.
    """
    return whole_and_cut(spark.read.text(path, wholetext=True), large_page)


def whole_and_cut(files: DataFrame, large_page: int = LARGE_PAGE) -> DataFrame:
    """Pages of a file scan, batch or stream."""
    size = F.col("_metadata.file_size")
    none = F.lit(None).cast("bigint")
    small = with_page_number(files.filter(size < large_page)).select("*", none.alias("first"), none.alias("whole_items"))
    return small.unionByName(cut_pages(with_page_number(files.filter(size >= large_page))))


def with_page_number(files: DataFrame) -> DataFrame:
    """The page number is the last run of digits in the file name, the sequence the path without it; a stray file without any has no number."""
    name, path = F.col("_metadata.file_name"), F.col("_metadata.file_path")
    folder = F.expr("left(_metadata.file_path, length(_metadata.file_path) - length(_metadata.file_name))")
    return files.select(
        F.regexp_extract(name, r"(\d+)\D*$", 1).try_cast("bigint").alias("page_id"),
        path.alias("path"),
        F.concat(folder, F.regexp_replace(name, r"\d+(\D*)$", r"*$1")).alias("sequence"),
        F.col("value").alias("body"),
    )


class _Cut:
    """Finds the items of a page in its text."""

    def __init__(self) -> None:
        def once(pairs: list) -> dict:
            if len({k for k, _ in pairs}) < len(pairs):
                raise ValueError("a key stands twice")
            return dict(pairs)

        def refuse(name: str) -> None:
            raise ValueError(name)

        self.value = json.JSONDecoder(object_pairs_hook=once, parse_constant=refuse).raw_decode

    @staticmethod
    def skip(text: str, at: int) -> int:
        while at < len(text) and text[at] in " \t\n\r":
            at += 1
        return at

    def expect(self, text: str, at: int, wanted: str) -> int:
        at = self.skip(text, at)
        if text[at : at + 1] not in wanted or at >= len(text):
            raise ValueError(f"no {wanted} at {at}")
        return at

    def items(self, text: str, at: int) -> tuple[list[tuple[int, int]], int]:
        """Where each value of a list stands, and where the list ends; ``at`` is its bracket."""
        found = []
        at = self.skip(text, at + 1)
        if text[at : at + 1] == "]":
            return found, at + 1
        while True:
            start = self.skip(text, at)
            _, at = self.value(text, start)
            found.append((start, at))
            at = self.expect(text, at, ",]")
            if text[at] == "]":
                return found, at + 1
            at += 1

    def __call__(self, text: str) -> list[tuple[int, int]] | None:
        """Places of the items in a list or under ``summary``; None where the page is one object.  Broken text and other values raise."""
        at = self.expect(text, 0, "[{")
        if text[at] == "[":
            return self.items(text, at)[0]
        found, keys = None, set()
        at = self.skip(text, at + 1)
        while text[at : at + 1] != "}" or keys:
            key, at = self.value(text, self.skip(text, at))
            if not isinstance(key, str) or key in keys:
                raise ValueError("no key, or one that stands twice")
            keys.add(key)
            at = self.skip(text, self.expect(text, at, ":") + 1)
            if key == "summary" and text[at : at + 1] == "[":
                found, at = self.items(text, at)
            else:
                _, at = self.value(text, at)
            at = self.expect(text, at, ",}")
            if text[at] == "}":
                break
            at += 1
        return found


def cut_pages(pages: DataFrame, part: int = PART) -> DataFrame:
    """Pages in parts of whole items, each a JSON list of about ``part`` characters; ``first`` is the position of a part's first item in its page.

    A page is in the memory of one task while it is cut.  An item is never cut.  A page that is one object stays whole, and one that cannot be read
    loses its body, so that it counts as unreadable.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Cut()
        for batch in batches:
            for row in batch.to_pylist():
                for body, first, whole in _parts(places, row.pop("body"), part):
                    rows = [row | {"body": body, "first": first, "whole_items": whole}]
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema(
        [("page_id", pa.int64()), ("path", pa.string()), ("sequence", pa.string()), ("body", pa.string()), ("first", pa.int64()), ("whole_items", pa.int64())]
    )
    return pages.select("page_id", "path", "sequence", "body").mapInArrow(run, PAGES)


def _parts(places: _Cut, text: str | None, part: int) -> Iterator[tuple[str | None, int | None, int | None]]:
    try:
        found = places(text or "")
    except (ValueError, RecursionError):
        yield None, None, None
        return
    if not found:
        yield text if found is None else "[]", None, None
        return
    start = 0
    for i, (_, end) in enumerate(found):
        if i + 1 == len(found) or end - found[start][0] >= part:
            yield f"[{text[found[start][0] : end]}]", start, len(found)
            start = i + 1


def is_true(value: Column) -> Column:
    """Whether a VARIANT is JSON true or the number 1."""
    kind = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    return F.coalesce((kind != "STRING") & (number == 1), F.lit(False))


def _described(pages: DataFrame) -> DataFrame:
    """Pages with the columns that a page without a path or a cut leaves out."""
    absent = {"sequence": F.lit(""), "first": F.lit(0).cast("bigint"), "whole_items": F.lit(None).cast("bigint")}
    return pages.select(
        "page_id", "body", *[F.coalesce(name, value).alias(name) if name in pages.columns else value.alias(name) for name, value in absent.items()]
    )


def page_items(pages: DataFrame) -> DataFrame:
    """One row per item, ``(sequence, page_id, page_items, page_ends, pos, item)``.

    A page without items keeps one row with a NULL item, so that its effect on the sequence is not lost.
    ``page_items`` is the length of the page, NULL if it could not be read, and ``page_ends`` marks a page that ends a server's sequence.
    Pages without a number are no part of it; ``page_problems`` reports them.
    """
    # Casting tells an object or a list from anything else without building the schema of a whole page.
    place = ["sequence", "page_id", "first", "whole_items"]
    listed = (
        _described(pages).filter("page_id IS NOT NULL").selectExpr(*place, "try_parse_json(body) AS _root")
        .selectExpr(
            *place,
            "_root",
            "try_variant_get(_root, '$', 'array<variant>') AS _list",
            "try_variant_get(_root, '$', 'struct<summary: variant>') AS _object",
        )
        .selectExpr(
            *place,
            """coalesce(_list, try_variant_get(_object.summary, '$', 'array<variant>'),
               CASE WHEN _object IS NOT NULL THEN array(_root) END) AS _items""",
        )
    )
    count = F.when(F.col("_items").isNotNull(), F.coalesce("whole_items", F.size("_items")))
    lone_no_data = (count == 1) & no_data_found(F.get("_items", 0))
    return listed.select(
        *PAGE_KEY,
        "first",
        count.cast("int").alias("page_items"),
        ((F.coalesce(count, F.lit(0)) == 0) | F.coalesce(lone_no_data, F.lit(False))).alias("page_ends"),
        F.posexplode_outer("_items").alias("pos", "item"),
    ).select(*PAGE_KEY, "page_items", "page_ends", (F.col("first") + F.col("pos")).cast("int").alias("pos"), "item")


def no_data_found(item: Column) -> Column:
    return is_true(F.try_variant_get(item, "$.noDataFound", "variant"))


def page_problems(pages: DataFrame, items: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """``(sequence, page_id, path, reason)`` of what a load should not pass over in silence, sequence by sequence.

    ``unnumbered``: a file without a number, not loaded; ``unreadable``: broken, no envelope, or one item larger than a parsed value can be, not
    loaded; ``missing``: the first number of a gap (from 0 on); ``short``: fewer items than the page size before the last page, loaded.
    """
    none = F.lit(None).cast("string")
    path = F.col("path") if "path" in pages.columns else none
    sequence = F.coalesce("sequence", F.lit("")) if "sequence" in pages.columns else F.lit("")
    stray = pages.filter("page_id IS NULL").select(sequence.alias("sequence"), "page_id", path.alias("path"), F.lit("unnumbered").alias("reason"))
    facts = items.groupBy(*PAGE_KEY).agg(F.max("page_items").alias("n"), F.bool_or("page_ends").alias("ends"))
    lasts = facts.groupBy("sequence").agg(F.max("page_id").alias("last"))
    following = facts.select("sequence", (F.col("page_id") + 1).alias("page_id")).unionByName(
        lasts.select("sequence", F.lit(0).cast("bigint").alias("page_id"))
    )
    missing = following.distinct().join(facts, PAGE_KEY, "left_anti").join(lasts, "sequence").filter("page_id < last")
    reason = F.when(F.col("n").isNull(), "unreadable").when(
        (F.col("n") < page_size) & ~F.col("ends") & (F.col("page_id") < F.col("last")), "short"
    )
    odd = facts.join(lasts, "sequence").select(*PAGE_KEY, none.alias("path"), reason.alias("reason")).filter("reason IS NOT NULL")
    return stray.unionByName(missing.select(*PAGE_KEY, none.alias("path"), F.lit("missing").alias("reason"))).unionByName(odd)


def kept_pages(items: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """The rows of ``page_items`` (or of anything derived from it) that belong to pages inside their sequence.

    The cut of a sequence is computed from the page columns only.
    """
    page = F.col("page_id")
    ids = items.select(*PAGE_KEY).distinct()
    following = ids.select("sequence", (page + 1).alias("page_id")).unionByName(
        ids.select("sequence", F.lit(0).cast("bigint").alias("page_id")).distinct()
    )
    missing = following.join(ids, PAGE_KEY, "left_anti").groupBy("sequence").agg(F.min("page_id").alias("_missing"))
    excluded = items.groupBy("sequence").agg(
        F.min(F.when(F.col("page_ends"), page).when(F.coalesce("page_items", F.lit(0)) < page_size, page + 1)).alias("_excluded")
    )
    cuts = missing.join(excluded, "sequence").select("sequence", F.least("_missing", "_excluded").alias("_cut"))
    return items.join(cuts, "sequence").filter(page < F.col("_cut")).select(*items.columns)


def page_offsets(items: DataFrame, block: int = 10_000) -> DataFrame:
    """``(page_id, page_offset)`` of the sequence without a name: how many items the pages before each page hold.

    The running sum is taken within blocks of pages and then over the block totals.
    """
    pages = items.filter("sequence = ''").groupBy("page_id").agg(F.coalesce(F.max("page_items"), F.lit(0)).alias("_n"))
    blocked = pages.withColumn("_block", F.floor(F.col("page_id") / block))
    totals = blocked.groupBy("_block").agg(F.sum("_n").alias("_total"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_block").orderBy("page_id").rowsBetween(Window.unboundedPreceding, -1)
    local = blocked.select(
        "page_id", "_block", F.coalesce(F.sum("_n").over(within), F.lit(0)).alias("_local")
    )
    return local.join(starts, "_block").select("page_id", (F.col("_start") + F.col("_local")).alias("page_offset"))
