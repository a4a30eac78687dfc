"""Removal of byte strings that start more than once in the corpus, by hash-compared suffix sorting.

Every window of WINDOW bytes picks its anchor: the 32-gram of the least hash in it, the leftmost on ties. Equal windows pick the same anchor at the
same offset, so a window can only repeat where its anchor's gram does. A row is written per anchor with the windows that it serves; about one in
85 positions is an anchor. Where the whole stretch that an anchor serves occurs again, all its windows repeat. Only the others, near the ends of
repeated passages, are looked at byte by byte: the suffixes that start at anchors of one gram are sorted by a merge sort whose comparisons find the common
extension by binary search over prefix hashes; neighbours in that order tell which windows agree to the right, hashes of what stands before the
anchor which agree to the left, and bytes are compared wherever hashes agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnwatch.llm.staging import staged
from burnwatch.llm.worker_memory import release

GRAM = 32
#: Bytes that are hashed at a time; a task holds some 200 bytes of numbers for each.
CHUNK = 1 << 18
#: Stretches that one task sorts at a time; groups of more are counted by window instead.
GROUP = 20_000

_rng = np.random.default_rng(20_240_502)
_BYTES = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD1342543DE82EF95
_BASE_INVERSE = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, 2 * CHUNK), _powers(_BASE_INVERSE, 2 * CHUNK)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Prefixes:
    """Polynomial hashes of all prefixes of a buffer, and so of all its substrings."""

    def __init__(self, buffer: np.ndarray) -> None:
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[buffer] * _UP[: len(buffer)], dtype=np.uint64)))

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * _DOWN[start]


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours, from running minima of blocks in both directions."""
    n = len(keys)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.uint64(2**64 - 1))
    padded[:n] = keys
    grid = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def anchors(pieces: list[np.ndarray], window: int) -> tuple[np.ndarray, ...]:
    """Of byte pieces, at most 2 * CHUNK together: piece, gram hash, stretch hash, anchor, first and last window (places in the piece)."""
    buffer = np.concatenate(pieces)
    lengths = np.array([len(p) for p in pieces])
    offsets = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    prefixes = Prefixes(buffer)
    at = np.arange(len(buffer) - GRAM + 1)
    grams = _mixed(prefixes.of(at, at + GRAM))
    low = np.uint64(0xFFFFFF)
    least = window_minima((grams & ~low) | at.astype(np.uint64), window - GRAM + 1)
    counts = lengths - window + 1
    piece = np.repeat(np.arange(len(pieces)), counts)
    starts = np.arange(counts.sum()) + np.repeat(offsets - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    places = (least[starts] & low).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (places[1:] != places[:-1]) | (piece[1:] != piece[:-1]))))
    last = np.concatenate((new[1:], [len(places)])) - 1
    p, first, final, piece = places[new], starts[new], starts[last], piece[new]
    shape = ((p - first) << 16 | (final - first)).astype(np.uint64)
    # Stretches that occur whole more than once are told apart by this hash alone, so it has no structure that texts could meet by.
    view, digest = memoryview(buffer.tobytes()), xxhash.xxh3_64_intdigest
    contents = np.fromiter((digest(view[a:b]) for a, b in zip(first.tolist(), (final + window).tolist(), strict=True)), np.uint64, len(first))
    stretch = _mixed(contents + shape * np.uint64(0x9E3779B97F4A7C15))
    base = offsets[piece]
    return piece, grams[p].view(np.int64), stretch.view(np.int64), p - base, first - base, final - base


ROW = "key long, check int, gram long, stretch long, anchor int, first int, last int"


def _anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        pieces: list[np.ndarray] = []
        owners: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            piece, gram, stretch, p, first, last = anchors(pieces, window)
            shift = np.array([o[2] for o in owners])[piece]
            keys = pa.array(np.array([o[0] for o in owners], np.int64)[piece])
            checks = pa.array(np.array([o[1] for o in owners], np.int32)[piece])
            numbers = [pa.array((x + shift).astype(np.int32)) for x in (p, first, last)]
            return pa.RecordBatch.from_arrays([keys, checks, pa.array(gram), pa.array(stretch), *numbers], names=["key", "check", "gram", "stretch", "anchor", "first", "last"])

        for batch in batches:
            keys, checks, texts = (batch.column(i) for i in range(3))
            for i in range(batch.num_rows):
                raw = np.frombuffer(texts[i].as_py(), np.uint8)
                for start in range(0, len(raw) - window + 1, CHUNK):
                    # The windows that start in this chunk.
                    piece = raw[start : start + CHUNK + window - 1]
                    if size + len(piece) > 2 * CHUNK - window:
                        yield out()
                        pieces, owners, size = [], [], 0
                    pieces.append(piece)
                    owners.append((keys[i].as_py(), checks[i].as_py(), start))
                    size += len(piece)
        if pieces:
            yield out()

    return docs.where(F.length("bytes") >= window).select("key", "check", "bytes").mapInArrow(run, ROW)


def common_lengths(x: np.ndarray, y: np.ndarray, hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Common prefix of suffixes x and y by binary search: equal prefix hashes up to there."""
    low, high = np.zeros(len(x), np.int64), np.minimum(lengths[x], lengths[y])
    while True:
        open_ = low < high
        if not open_.any():
            return low
        middle = (low + high + 1) >> 1
        same = hashes[x, middle] == hashes[y, middle]
        low, high = np.where(open_ & same, middle, low), np.where(open_ & ~same, middle - 1, high)


def sorted_suffixes(groups: np.ndarray, rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes (rows of bytes of these lengths) within groups that stand together, and each one's common prefix with the one
    before it in its group.

    Bottom-up merge sort of all groups at once: an element's place in a merged run is its place in its own run plus the number of elements of the
    other run before it, found by binary search. Sorted neighbours are compared by bytes in the end; had hashes ever collided, bytes decide.
    """
    n, width = rows.shape
    hashes = np.zeros((n, width + 1), np.uint64)
    np.cumsum(_BYTES[rows] * _UP[:width], axis=1, dtype=np.uint64, out=hashes[:, 1:])
    padded = np.concatenate((rows, np.zeros((n, 1), np.uint8)), axis=1)
    begins = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
    sizes = np.diff(np.concatenate((begins, [n])))
    begin, size = np.repeat(begins, sizes), np.repeat(sizes, sizes)
    inside = np.arange(n) - begin
    order = np.arange(n)

    def before(x: np.ndarray, y: np.ndarray, equal_too: np.ndarray) -> np.ndarray:
        """Whether suffix y stands before suffix x."""
        common = common_lengths(x, y, hashes, lengths)
        ended_x, ended_y = common >= lengths[x], common >= lengths[y]
        less = padded[y, np.minimum(common, width)] < padded[x, np.minimum(common, width)]
        return np.where(ended_x & ended_y, equal_too, np.where(ended_y, True, np.where(ended_x, False, less)))

    run = 1
    while run < sizes.max(initial=1):
        moving = np.flatnonzero(size > run)
        own = inside[moving] // run
        other = own ^ 1
        low = np.minimum(other * run, size[moving])
        high = np.minimum(low + run, size[moving])
        other_begin, x = low.copy(), order[moving]
        equal_too = own % 2 == 1
        while True:
            active = np.flatnonzero(low < high)
            if not len(active):
                break
            middle = (low[active] + high[active]) >> 1
            first = before(x[active], order[begin[moving[active]] + middle], equal_too[active])
            low[active] = np.where(first, middle + 1, low[active])
            high[active] = np.where(first, high[active], middle)
        place = begin[moving] + np.minimum(own, other) * run + (inside[moving] - own * run) + (low - other_begin)
        merged = order.copy()
        merged[place] = x
        order = merged
        run *= 2

    x, y = order[1:], order[:-1]
    common = common_lengths(x, y, hashes, lengths)
    together = groups[1:] == groups[:-1]
    agree = (rows[x] == rows[y]) | (np.arange(width) >= common[:, None])
    ends = (common < np.minimum(lengths[x], lengths[y])) & (padded[x, common] == padded[y, common])
    if not (agree.all(axis=1) | ~together).all() or (ends & together).any():
        order = np.array(sorted(range(n), key=lambda i: (begin[i], rows[i, : lengths[i]].tobytes())))
        x, y = order[1:], order[:-1]
        differ = (rows[x] != rows[y]) | (np.arange(width) >= np.minimum(lengths[x], lengths[y])[:, None])
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, np.concatenate(([0], np.where(together, common, 0)))


def repeated_windows(groups: np.ndarray, stretches: list[bytes], before: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Of stretches, each with its anchor after `before` bytes, in groups of one gram: the largest and smallest offset before the anchor at which
    a window starts that another stretch of the group has too; -1 where none does."""
    n = len(stretches)
    sizes = np.array([len(s) for s in stretches])
    flat = np.frombuffer(b"".join(stretches), np.uint8)
    offsets = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    after, reach = sizes - before, int(before.max())

    def cut(starts: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
        columns = np.arange(width)
        return np.where(columns < lengths[:, None], flat[np.minimum(starts[:, None] + columns, len(flat) - 1)], 0).astype(np.uint8)

    right = cut(offsets + before, after, int(after.max()))
    order, common = sorted_suffixes(groups, right, after)
    # Bytes before the anchor, the nearest first, and the hashes of those stretches.
    columns = np.arange(reach)
    left = np.where(columns < before[:, None], flat[np.maximum((offsets + before)[:, None] - 1 - columns, 0)], 0).astype(np.uint8)
    left_hashes = np.zeros((n, reach + 1), np.uint64)
    np.cumsum(_BYTES[left] * _UP[:reach], axis=1, dtype=np.uint64, out=left_hashes[:, 1:])
    most, least = np.full(n, -1), np.full(n, -1)
    for offset in range(reach + 1):
        # Stretches that serve the window at this offset, with runs of equal suffixes.
        serves = (before >= offset) & (after >= window - offset)
        if serves.sum() < 2:
            continue
        run = np.empty(n, np.int64)
        run[order] = np.cumsum(common < window - offset)
        members = np.flatnonzero(serves)
        ranked = members[np.lexsort((left_hashes[members, offset], run[members]))]
        same = (run[ranked[1:]] == run[ranked[:-1]]) & (left_hashes[ranked[1:], offset] == left_hashes[ranked[:-1], offset])
        pairs = np.flatnonzero(same)
        if offset and len(pairs):
            same[pairs] = (left[ranked[pairs + 1], :offset] == left[ranked[pairs], :offset]).all(axis=1)
        hit = np.zeros(len(ranked), bool)
        hit[1:] |= same
        hit[:-1] |= same
        found = ranked[hit]
        most[found] = offset
        least[found] = np.where(least[found] < 0, offset, least[found])
    return most, least


SPAN = "key long, check int, start int, stop int"


def _sorted_spans(stretches: DataFrame, window: int) -> DataFrame:
    """Spans of repeated windows in stretches that are grouped by gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: list[tuple] = []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            key, check, gram, anchor, first, raw = map(list, zip(*rows, strict=True))
            anchor, first = np.array(anchor), np.array(first)
            most, least = repeated_windows(np.array(gram), raw, anchor - first, window)
            hit = np.flatnonzero(most >= 0)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([key[i] for i in hit], pa.int64()),
                    pa.array([check[i] for i in hit], pa.int32()),
                    pa.array((anchor - most)[hit].astype(np.int32)),
                    pa.array((anchor - least + window)[hit].astype(np.int32)),
                ],
                names=["key", "check", "start", "stop"],
            )

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if len(held) >= 4096 and held[-1][2] != row[2]:
                    yield out(held)
                    held = []
                held.append(row)
        if held:
            yield out(held)

    columns = ["key", "check", "gram", "anchor", "first", "bytes"]
    return stretches.select(*columns).repartition("gram").sortWithinPartitions("gram").mapInArrow(run, SPAN)


def _counted_spans(stretches: DataFrame, window: int) -> DataFrame:
    """The same for grams with very many stretches: every window is a row, and equal ones are counted with partial sums."""
    rows = stretches.select(
        "key", "check", F.posexplode(F.sequence(F.col("first"), F.col("last"))).alias("at", "start"), "bytes"
    ).select(
        "key", "check", "start", F.sha2(F.expr(f"substring(bytes, at + 1, {window})"), 256).alias("content")
    )
    twice = rows.groupBy("content").agg(F.count("*").alias("n")).where("n > 1").select("content")
    return rows.join(twice, "content").select("key", "check", "start", (F.col("start") + window).alias("stop"))


def repeated_spans(docs: DataFrame, window: int = 200, group: int = GROUP, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `carry`, `bytes` and `spans` of each row of (doc_id, text): the text's UTF-8 bytes and spans, sorted, of bytes in windows that start elsewhere too."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # Two hashes stand for a row; equal rows share them, and count twice where windows are counted.
    source = docs.select(
        *carry, F.xxhash64("doc_id", text).alias("_key"), F.hash(text, F.col("doc_id")).alias("_check"), text.cast("binary").alias("bytes")
    )
    # One shuffle by gram serves all counts: how often a gram and a stretch occur, how many kinds of stretches a gram has, and one row that speaks for each.
    rows = _anchor_rows(source.select(F.col("_key").alias("key"), F.col("_check").alias("check"), "bytes"), window).repartition("gram")
    kind, gram = Window.partitionBy("gram", "stretch"), Window.partitionBy("gram")
    speaks = F.row_number().over(kind.orderBy("key", "check", "anchor")) == 1
    counted = rows.withColumn("speaks", speaks).withColumn("copies", F.count("*").over(kind))
    counted = counted.withColumn("rows", F.count("*").over(gram)).withColumn("kinds", F.count_if("speaks").over(gram))
    known = staged(counted.where("rows > 1").select("key", "check", "gram", "anchor", "first", "last", "copies", "kinds", "speaks"))
    whole = known.where("copies > 1").select("key", "check", F.col("first").alias("start"), (F.col("last") + window).alias("stop"))
    # Stretches that occur once, and one for each kind that occurs more often, meet by gram.
    edges = known.where("kinds > 1 AND (copies = 1 OR speaks)").groupBy(F.col("key").alias("_key"), F.col("check").alias("_check")).agg(
        F.collect_set(F.struct("gram", "anchor", "first", "last", "kinds")).alias("edges")
    )
    # The texts are shuffled once, for the stretches and for the result, which are one plan.
    texts = source.repartition("_key", "_check")
    stretches = (
        texts.join(edges, ["_key", "_check"])
        .select(F.col("_key").alias("key"), F.col("_check").alias("check"), "bytes", F.explode("edges").alias("e"))
        .select(
            "key", "check", "e.gram", "e.anchor", "e.first", "e.last", "e.kinds",
            F.expr(f"substring(bytes, e.first + 1, e.last - e.first + {window})").alias("bytes"),
        )
    )
    parts = _sorted_spans(stretches.where(F.col("kinds") <= group), window)
    if not known.where(F.col("kinds") > group).isEmpty():
        parts = parts.unionByName(_counted_spans(stretches.where(F.col("kinds") > group), window))
    spans = whole.unionByName(parts).groupBy(F.col("key").alias("_key"), F.col("check").alias("_check")).agg(
        F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans")
    )
    return texts.join(spans, ["_key", "_check"], "left").select(
        *carry, "bytes", F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int>>")).alias("spans")
    )


def remove_repeats(docs: DataFrame, window: int = 200, group: int = GROUP, carry: tuple[str, ...] = ("doc_id",), as_text: bool = False) -> DataFrame:
    """One row per row of (doc_id, text): the columns in `carry`, then kept, spans (the maximal removed runs, start and stop in bytes), n_bytes.

    Every byte covered by a string of `window` bytes that also starts anywhere else, in the same or another row, is removed; overlaps count, and strings are
    judged on the input. Null texts are empty; texts shorter than `window` are kept whole; repeated rows lose what they share, which is all of it from `window`
    bytes on; rows may share a doc_id or have none. Columns that are not carried are ignored. `kept` is bytes; with `as_text` it is a string, without the
    rests of characters that were cut in two.
    """
    given = T.StructType([*docs.select(*carry).schema.fields, T.StructField("kept", T.StringType() if as_text else T.BinaryType())])
    given = T.StructType([*given.fields, *T.StructType.fromDDL("spans array<struct<start:int,stop:int>>, n_bytes long").fields])
    names = [f.name for f in given.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            kept, merged, sizes = [], [], []
            for raw, spans in zip(*(batch.columns[i].to_pylist() for i in (-2, -1)), strict=True):
                runs: list[dict] = []
                for span in spans:
                    if runs and span["start"] <= runs[-1]["stop"]:
                        runs[-1]["stop"] = max(runs[-1]["stop"], span["stop"])
                    else:
                        runs.append(dict(span))
                edges = [0, *(x for r in runs for x in (r["start"], r["stop"])), len(raw)]
                rest = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                kept.append(rest.decode("utf-8", "ignore") if as_text else rest)
                merged.append(runs)
                sizes.append(len(raw))
            added = [
                pa.array(kept, pa.string() if as_text else pa.binary()),
                pa.array(merged, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
                pa.array(sizes, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *added], names=names)

    return repeated_spans(docs, window, group, carry).mapInArrow(run, given)
