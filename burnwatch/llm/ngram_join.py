"""Near duplicates by the Jaccard likeness of word n-gram sets: a prefix-tree join.

Sets are ordered by one global order, rare n-grams first. Two sets that are alike share an n-gram among the first few of both, so documents meet under
those. In each such group one document is the hub: its set walks prefix trees of the others' sets, from the most frequent n-gram down, adding
up overlaps once for all sets that begin alike and leaving a subtree when the n-grams that remain cannot reach the bound. The hub then leaves
the group. Groups whose documents are all connected are done; the others go on, with sixteen times as many hubs in each round. So the pairs of a large group
of copies are never listed, while every pair that sizes and places allow, and that is not connected already, is tested.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from burnwatch.llm.components import components
from burnwatch.llm.staging import drop_staged, staged
from burnwatch.llm.worker_memory import release

#: Text hashed at a time.
CHUNK = 1 << 18
#: Frequent n-grams that the global order puts last; a bounded list, and any list gives the same links.
FREQUENT = 65_536
#: How often one task must meet an n-gram to report it as possibly frequent.
REPORTED = 4
#: Sets in one prefix tree at most.
TREE = 256
#: Rows of ids and digests that are broadcast at most, some 45 MB; beyond it they are joined by shuffle.
BROADCAST_ROWS = 300_000

#: Masks of the first 0 to 8 bytes of a little-endian number, and odd constants.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_LENGTH, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes of a word that are hashed as two numbers; longer words are hashed one by one.
SHORT = 16


#: An order without frequent n-grams.
_NONE_FREQUENT = np.empty(0, np.uint64), np.empty(0, np.int64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash of each word of ASCII-lower-cased bytes, in order.

    Words of up to 16 bytes are taken as two numbers and mixed, longer ones by xxh3: no family of words collides by its structure, as words of one sum modulo a power of two do.
    """
    out = []
    at = 0
    while at < len(raw):
        stop = min(len(raw), at + CHUNK)
        if stop < len(raw):  # cut between words; a longer word is hashed by itself
            cut = max(raw.rfind(c, at, stop) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut < at:
                words = raw[at:].split(None, 1)
                if not words:
                    break
                if len(words[0]) > CHUNK // 2:
                    out.append(np.array([xxhash.xxh3_64_intdigest(words[0])], np.uint64))
                    at = len(raw) - len(words[1]) if len(words) > 1 else len(raw)
                    continue
                stop = raw.find(words[0], at) + len(words[0])
            else:
                stop = cut + 1
        piece = np.frombuffer(raw, np.uint8, stop - at, at)
        blank = (piece == 32) | ((piece >= 9) & (piece <= 13))
        edge = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        lengths = ends - starts
        # The eight bytes from each place, as one number.
        eight = np.ndarray((len(piece) + 8,), "<u8", piece.tobytes() + bytes(SHORT), strides=(1,))
        first = eight[starts] & _MASKS[np.minimum(lengths, 8)]
        second = eight[starts + 8] & _MASKS[np.clip(lengths - 8, 0, 8)]
        hashes = _mixed(_mixed(first + lengths.astype(np.uint64) * _LENGTH) + second * _SECOND)
        for i in np.flatnonzero(lengths > SHORT).tolist():
            hashes[i] = xxhash.xxh3_64_intdigest(raw[at + starts[i] : at + ends[i]])
        out.append(hashes)
        at = stop
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams; of the whole sequence where it is shorter."""
    n = len(words)
    if n == 0:
        return words
    width = min(size, n)
    h = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        h = _mixed(h * np.uint64(0xA0761D6478BD642F) + words[i : n - width + 1 + i])
    return np.unique(h)


def packed(tokens: np.ndarray) -> bytes:
    return tokens.astype("<u8").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u8")


def token_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    for i in range(len(column)):
        yield shingles(word_hashes((column[i].as_py() or "").encode("utf-8", "replace").lower()), size)


def frequent(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that most documents hold, sorted, with about how many; at most FREQUENT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        waiting, many = [], 0

        def report():
            tokens, n = np.unique(np.concatenate(waiting), return_counts=True)
            keep = n >= REPORTED
            return pa.RecordBatch.from_arrays([pa.array(tokens[keep].astype(np.int64)), pa.array(n[keep])], names=["token", "n"])

        for batch in batches:
            for tokens in token_sets(batch.column(0), size):
                waiting.append(tokens)
                many += len(tokens)
                if many >= 2_000_000:
                    yield report()
                    waiting, many = [], 0
        if waiting:
            yield report()

    top = (
        docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "token").limit(FREQUENT).toPandas()
    )
    tokens, n = top["token"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(tokens)
    return tokens[order], n[order]


@dataclass
class Order:
    """Rare n-grams before frequent ones, then by hash."""

    tokens: np.ndarray
    n: np.ndarray

    def ranks(self, tokens: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.zeros(len(tokens), np.int64)
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return np.where(self.tokens[at] == tokens, np.minimum(self.n[at], 2**15 - 1), 0)

    def places(self, tokens: np.ndarray) -> np.ndarray:
        """Numbers that never fall along the global order; n-grams of one number are rare and need not be equal."""
        return self.ranks(tokens).astype(np.uint64) << np.uint64(49) | tokens >> np.uint64(15)

    def marks(self, tokens: np.ndarray) -> np.ndarray:
        """The same in 32 bits, for bounds from above."""
        return (self.places(tokens) >> np.uint64(32)).astype(np.uint32)

    def sorted(self, tokens: np.ndarray) -> np.ndarray:
        """Tokens, ascending as given, in the global order."""
        return tokens[np.argsort(self.ranks(tokens), kind="stable")]


def least_overlap(n: int, percent: int) -> int:
    """That a set of n needs with any set it is alike to."""
    return -(-percent * n // 100)


def alike(overlap: int, a: int, b: int, percent: int) -> bool:
    return 100 * overlap >= percent * (a + b - overlap)


@dataclass
class Node:
    """An edge of the prefix tree: the n-grams on it, what follows, and the sizes of the sets below."""

    tokens: np.ndarray
    children: list[Node] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    shortest: int = 0
    longest: int = 0


def prefix_tree(sets: list[np.ndarray], places: list[np.ndarray]) -> Node:
    """Tree of sets whose n-grams stand in the global order; `places` are sortable forms of them."""

    def grow(members: list[int], depth: int, parent: Node) -> None:
        sizes = [len(sets[i]) for i in members]
        parent.shortest, parent.longest = min(sizes), max(sizes)
        heads: dict[int, list[int]] = {}
        for i in members:
            if len(sets[i]) == depth:
                parent.ends.append(i)
            else:
                heads.setdefault(int(sets[i][depth]), []).append(i)
        for group in heads.values():
            first, stop = sets[group[0]], min(len(sets[i]) for i in group)
            for i in group[1:]:
                differ = np.flatnonzero(sets[i][depth:stop] != first[depth:stop])
                if len(differ):
                    stop = depth + int(differ[0])
            node = Node(first[depth:stop])
            parent.children.append(node)
            pending.append((group, stop, node))

    root = Node(np.empty(0, np.uint64))
    pending = [(list(range(len(sets))), 0, root)]
    while pending:
        grow(*pending.pop())
    return root


def walk(tree: Node, probe: np.ndarray, sets: list[np.ndarray], percent: int) -> Iterator[int]:
    """Members of the tree that are alike to the probe (sorted by hash)."""
    n = len(probe)
    stack = [(tree, 0, 0)]
    while stack:
        node, depth, overlap = stack.pop()
        if len(node.tokens):
            at = np.minimum(np.searchsorted(probe, node.tokens), n - 1)
            overlap += int(np.count_nonzero(probe[at] == node.tokens))
            depth += len(node.tokens)
        # The overlap can grow by what remains of the longest set below, and by what the probe has left.
        best = overlap + min(node.longest - depth, n - overlap)
        size = max(node.shortest, best)
        if not alike(min(best, n), n, size, percent):
            continue
        for i in node.ends:
            if alike(overlap, n, len(sets[i]), percent):
                yield i
        stack += [(child, depth, overlap) for child in node.children]


def _heads(docs: DataFrame, size: int, percent: int, order) -> DataFrame:
    """(doc_id, n, digest, heads) of each text: the size of its set, a digest of it, and its first n-grams in the global order, one of which
    every set that is alike shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        rank = order.value
        for batch in batches:
            n, digests, heads = [], [], []
            for own in token_sets(batch.column(1), size):
                n.append(len(own))
                digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                take = len(own) - least_overlap(len(own), percent) + 1 if len(own) else 0
                # Sorted by hash before, so a stable sort by rank gives the global order.
                heads.append(packed(own[np.argsort(rank.ranks(own), kind="stable")[:take]]))
            columns = [batch.column(0), pa.array(n, pa.int32()), pa.array(digests, pa.binary()), pa.array(heads, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "digest", "heads"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n int, digest binary, heads binary")


def _met(sets: DataFrame) -> DataFrame:
    """(token, doc_id, n, place) of each of a document's first n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                ids, n, heads = (batch.column(i).slice(start, 1024) for i in range(3))
                firsts = [unpacked(raw) for raw in heads.to_pylist()]
                counts = [len(x) for x in firsts]
                numbers = {
                    "token": np.concatenate(firsts).astype(np.int64),
                    "doc_id": np.repeat(ids.to_numpy(), counts),
                    "n": np.repeat(n.to_numpy(), counts),
                    "place": np.concatenate([np.arange(c, dtype=np.int32) for c in counts]),
                }
                yield pa.RecordBatch.from_pydict({name: pa.array(x) for name, x in numbers.items()})

    return sets.select("doc_id", "n", "heads").mapInArrow(run, "token long, doc_id long, n int, place int")


def _tokens(docs: DataFrame, size: int) -> DataFrame:
    """The other columns and `tokens`, the whole set, of each text."""
    rest = docs.drop("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                tokens = pa.array([packed(x) for x in token_sets(part.column(part.num_columns - 1), size)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], tokens], names=[*part.schema.names[:-1], "tokens"])

    return docs.select(*rest.columns, "text").mapInArrow(run, StructType([*rest.schema.fields, StructField("tokens", BinaryType())]))


def _small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if its rows, a few numbers each, are no more than BROADCAST_ROWS."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _possible(pairs: DataFrame, sets: DataFrame, order, percent: int) -> DataFrame:
    """The pairs (hub, member) whose first n-grams allow that they are alike.

    Before the nearer end of both heads all n-grams of both sets are known; from it on they share at most what the smaller rest holds.
    """
    heads = sets.select("doc_id", "n", "heads")
    of_members = heads.join(_small(pairs.withColumnRenamed("member", "doc_id")), "doc_id").select(F.col("doc_id").alias("member"), "hub", "n", "heads")
    hubs = _small(pairs.select(F.col("hub").alias("doc_id")).distinct())
    of_hubs = heads.join(hubs, "doc_id", "left_semi").select(F.col("doc_id").alias("hub"), F.col("n").alias("hub_n"), F.col("heads").alias("hub_heads"))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        rank = order.value
        for batch in batches:
            marks = [rank.marks(unpacked(raw)).tobytes() for raw in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(marks, pa.binary())], names=batch.schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            keep = []
            for n, raw, hub_n, hub_raw in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                x, y = np.frombuffer(raw, np.uint32), np.frombuffer(hub_raw, np.uint32)
                end = min(x[-1], y[-1])
                known, hub_known = np.searchsorted(x, end), np.searchsorted(y, end)
                common = int(np.isin(x[:known], y[:hub_known]).sum())
                keep.append(alike(common + int(min(n - known, hub_n - hub_known)), n, hub_n, percent))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    # Only the marks move, half as long as the heads. Both sides are shuffled, so that a task has one Python worker and not two.
    of_members, of_hubs = (x.mapInArrow(marked, x.schema) for x in (of_members, of_hubs))
    rows = of_members.join(of_hubs.hint("merge"), "hub").select("hub", "member", "n", "heads", "hub_n", "hub_heads")
    return rows.mapInArrow(run, "hub long, member long")


def _tested(pairs: DataFrame, docs: DataFrame, size: int, order, percent: int) -> DataFrame:
    """The pairs (hub, member) that are alike. Only texts in pairs are read into sets, and a member's set moves to its hubs."""
    of_members = _tokens(docs.join(_small(pairs.withColumnRenamed("member", "doc_id")), "doc_id"), size)
    hubs = _small(pairs.select(F.col("hub").alias("doc_id")).distinct())
    of_hubs = _tokens(docs.join(hubs, "doc_id", "left_semi"), size).select(F.col("doc_id").alias("hub"), F.col("tokens").alias("probe"))
    rows = of_members.withColumnRenamed("doc_id", "member").join(of_hubs.hint("merge"), "hub")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        rank = order.value
        hub, probe, members, sets_ = None, None, [], []

        def answers() -> pa.RecordBatch:
            tree = prefix_tree(sets_, sets_)
            found = [members[i] for i in walk(tree, probe, sets_, percent)]
            return pa.RecordBatch.from_arrays([pa.array([hub] * len(found), pa.int64()), pa.array(found, pa.int64())], names=["a", "b"])

        for batch in batches:
            hubs, ids, tokens, probes = (batch.column(i) for i in range(4))
            for i in range(batch.num_rows):
                this, raw = hubs[i].as_py(), probes[i].as_py()
                if members and (this != hub or len(members) >= TREE or raw != seen):
                    yield answers()
                    members, sets_ = [], []
                if this != hub or not members:
                    hub, seen, probe = this, raw, unpacked(raw)
                own = unpacked(tokens[i].as_py())
                if 100 * min(len(own), len(probe)) >= percent * max(len(own), len(probe)):
                    members.append(ids[i].as_py())
                    sets_.append(rank.sorted(own)[::-1])
        if members:
            yield answers()

    return rows.select("hub", "member", "tokens", "probe").sortWithinPartitions("hub").mapInArrow(run, "a long, b long")


def _groups(docs: DataFrame, size: int, percent: int) -> tuple:
    """The global order, all sets, those that can be linked, and (token, doc_id, n, place, earlier, alone, component) of sets that meet under an n-gram.

    One document stands for a set: the one with the smallest id.
    """
    order = docs.sparkSession.sparkContext.broadcast(Order(*frequent(docs, size)))
    sets = staged(_heads(docs, size, percent, order))
    filled = sets.where("n > 0 AND doc_id IS NOT NULL")
    # Copies of a set would meet under the same n-grams; the smallest stands for them.
    firsts = staged(filled.groupBy("digest").agg(F.min("doc_id").alias("doc_id")))
    met = _met(filled.join(_small(firsts), ["digest", "doc_id"]))
    of_token = Window.partitionBy("token")
    shared = met.withColumn("members", F.count("*").over(of_token)).where("members > 1").drop("members")
    # n-grams of a head that no other document has can be shared with none: a document's `alone` of them are missing from every overlap.
    # `earlier` is the shared n-gram before this one.
    own = Window.partitionBy("doc_id")
    head = F.col("n") - F.ceil(percent * F.col("n") / 100) + 1
    shared = shared.withColumn("earlier", F.lag("token").over(own.orderBy("place"))).withColumn("alone", head - F.count("*").over(own))
    shared = shared.where(100 * (F.col("n") - F.col("alone")) >= percent * F.col("n"))
    return order, sets, filled, staged(shared.withColumn("component", F.col("doc_id")))


_HUB = {"hub": "doc_id", "hub_n": "n", "hub_place": "place", "hub_earlier": "earlier", "hub_component": "component"}


def _hub_columns() -> list[Column]:
    return [F.col(column).alias(name) for name, column in _HUB.items()]


def _ranked(rows: DataFrame) -> DataFrame:
    """Groups that connect nothing yet in part, with each document's turn as a hub and the first hub beside it, by one exchange."""
    whole = Window.partitionBy("token")
    # Documents that keep least to themselves come first: they link most of the others.
    by_turn = whole.orderBy("alone", F.xxhash64("doc_id"), "doc_id")
    first = F.first(F.struct(*_hub_columns())).over(by_turn).alias("first")
    ends = [F.min("component").over(whole).alias("low"), F.max("component").over(whole).alias("high")]
    return rows.select("*", *ends, F.row_number().over(by_turn).alias("turn"), first).where("low <> high").drop("low", "high")


def _meets(percent: int) -> Column:
    """Whether a document and a hub are to be tested for the n-gram that they meet under, taken for the first that they share.

    From there on they share at most what the shorter rest holds. Where both have the same shared n-gram before this one, this is not the first, and they meet
    under an earlier one; so a pair of near copies, which share long runs, comes up a few times and not once for each n-gram.
    """
    most = F.least(F.col("n") - F.col("place"), F.col("hub_n") - F.col("hub_place"))
    first = F.col("earlier").isNull() | F.col("hub_earlier").isNull() | (F.col("earlier") != F.col("hub_earlier"))
    return first & (100 * most >= percent * (F.col("n") + F.col("hub_n") - most))


def links(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Every link between different sets: (a, b) with a < b, where the smallest doc_id of a set stands for it.

    The join itself, where `near_duplicates` needs only what connects: all sets of a group are hubs at once, so a large group of near copies that differ gives as many rows as it has links. Texts are
    taken and compared as there; copies of a set are one node (see `link_counts`).
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order, _, filled, groups = _groups(docs, size, percent)
    pairs = staged(
        groups.join(groups.select("token", *_hub_columns()), "token")
        .where((F.col("doc_id") > F.col("hub")) & _meets(percent))
        .select("hub", F.col("doc_id").alias("member")).distinct()
    )
    drop_staged(groups)
    found = _tested(staged(_possible(pairs, filled, order, percent)), docs, size, order, percent)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def link_counts(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_links) of each document: how many other documents are linked to it, copies counted each, without a row for each pair of copies.

    Documents without words, and rows without a doc_id, have 0 and no row respectively.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = staged(_heads(docs, size, percent, docs.sparkSession.sparkContext.broadcast(Order(*_NONE_FREQUENT))).select("doc_id", "n", "digest"))
    classes = sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count_distinct("doc_id").alias("copies"))
    found = links(docs, size, percent)
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(classes.select(F.col("first").alias("b"), "copies"), "b").groupBy(F.col("a").alias("first")).agg(F.sum("copies").alias("others"))
    counted = classes.join(others, "first", "left").select("digest", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return (
        sets.where("doc_id IS NOT NULL").join(counted, "digest", "left")
        .groupBy("doc_id").agg(F.coalesce(F.max("n_links"), F.lit(0)).alias("n_links"))
    )


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of (doc_id, text): doc_id, n_shingles, component_id.

    Words are what stands between white space (space, tab to carriage return), with A-Z in lower case. Two documents are linked when
    100 * common n-grams >= percent * all n-grams of both; a component is what links connect, named by its smallest doc_id. Texts with fewer words
    than `size` have their whole sequence as one n-gram; null, empty and blank texts have none and are linked with nothing. Equal sets are one
    node, so copies cost nothing. Rows that share a doc_id are one node of links, each with its own count; rows without a doc_id have no component.
    Other columns are ignored. n-grams are compared by 64-bit hashes of their words.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order, sets, filled, groups = _groups(docs, size, percent)

    labels = None
    hubs_each = 1
    ranked = staged(_ranked(groups))
    drop_staged(groups)
    while not ranked.isEmpty():
        if hubs_each == 1:
            met = ranked.where("turn > 1").select("*", "first.*")
        else:
            hubs = ranked.where(F.col("turn") <= hubs_each).select("token", F.col("turn").alias("hub_turn"), *_hub_columns())
            met = ranked.join(hubs, "token").where("turn > hub_turn")
        pairs = staged(
            met.where("component <> hub_component").where(_meets(percent))
            .select("hub", F.col("doc_id").alias("member")).distinct()
        )
        rest = ranked.where(F.col("turn") > hubs_each).drop("turn", "first")
        spent = [ranked, pairs]
        if not pairs.isEmpty():
            possible = staged(_possible(pairs, filled, order, percent))
            found = staged(_tested(possible, docs, size, order, percent))
            joined = found if labels is None else labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found)
            spent += [possible, found] if labels is None else [possible, found, labels]
            labels = staged(components(joined))
        if labels is not None:
            now = labels.select(F.col("node").alias("doc_id"), F.col("component").alias("now"))
            rest = rest.join(now, "doc_id", "left").withColumn("component", F.coalesce("now", "component")).drop("now")
        ranked = staged(_ranked(rest))
        for table in spent:
            drop_staged(table)
        hubs_each *= 16

    firsts = filled.groupBy("digest").agg(F.min("doc_id").alias("first"))
    named = firsts if labels is None else firsts.join(labels.withColumnRenamed("node", "first"), "first", "left")
    named = named.select("digest", F.coalesce("component" if labels is not None else "first", "first").alias("component_id"))
    n = F.col("n").cast("long").alias("n_shingles")
    linked = filled.select("doc_id", "n", "digest").join(named, "digest").select("doc_id", n, "component_id")
    alone = sets.where("n = 0 OR doc_id IS NULL").select("doc_id", n, F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)
