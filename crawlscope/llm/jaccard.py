"""Exact n-gram Jaccard join in the metric space of shingle sets.

Jaccard distance d = 1 - |x & y| / |x | y| is a metric. The join finds the connected classes of the
graph "d(x, y) <= eps" without ever listing the pairs of a group:

1. *Classes of equal sets.* Equal shingle sets (d = 0) become one node by a digest of the set.
2. *Pivot parts and windows.* Two given documents of a corpus nearly always have distance 1, so pivots
   that are documents cut nothing at the top. The first level takes parts of the documents themselves
   as pivots: shingle space is cut into m cells and x belongs to the regions of its own cell contents.
   Where d(x, y) <= eps, at most delta shingles differ, so at least m - delta cells agree whole; a set
   that fills more than delta cells surely shares a filled one. Sets that fill fewer take finer cells
   (see ``signatures``). Shingles of passages that many documents share are left out of the cells where
   the rest suffices: leaving the same shingles out of both sets adds no difference. Sizes of linked sets
   differ by a factor of 1 - eps at most, so size classes are windows: each document is copied to its own
   and to the next lower one.
   Documents that share a region are joined to its least member: the islands of the resulting graph
   hold every link.
3. *Voronoi regions.* Every island is cut by documents as pivots, about the square root of its sets. A
   document goes to the region of its nearest pivot and, by the triangle inequality, to each other pivot
   within 2 eps of the nearest distance; what is far from all pivots forms one more region. A document
   that links to a pivot belongs to the pivot's class, and pairs of one class are never compared. The
   work left in a region is its elements times its sets outside the largest class: none means that the
   region is done, little that one task joins it, much that it is cut again. Where the cut does not halve
   the work, as with documents that all lie equally far apart, the island is joined in pairs of blocks.

Defined cases: null or empty texts and texts without a word have no shingles, link with nothing and
form their own class; texts of fewer than ``n`` words have one shingle, the whole sequence; rows with
equal ids stay separate rows; rows with a null id get a null component unless their class has an id.
Shingles and sets are compared by 64-bit hashes; sets are told apart by 128 bits (see ``classes``).
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlscope.llm import kernels as K
from crawlscope.llm.common import components, parts, stored

SLOTS = 1 << 22  # of the table of common shingles
BITS = 1 << 23  # of a bitmap over rows
FOLD = 1 << 19  # signatures that are folded at once before the shuffle
NONE = 0  # node of documents without shingles


def shingle_sets(data: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct word n-grams of each text; A-Z are lower-cased, words end at ASCII white space."""
    starts, ends, word_bounds = K.words(data, bounds)
    return K.distinct(*K.shingles(K.hashes(data, starts, ends, K.FOLDED), word_bounds, n))


def digests(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of each set."""
    one = K.mix(K.sums(K.mix(values), bounds)).view(np.int64)
    two = K.mix(K.sums(K.mix(values ^ K.ODD[9]), bounds)).view(np.int64)
    return np.where(np.diff(bounds) > 0, np.where(one == NONE, 1, one), NONE), two


# --- size windows and cells -----------------------------------------------------------------
@lru_cache(maxsize=8)
def size_classes(num: int, den: int, top: int = 1 << 40) -> np.ndarray:
    """First size of each class; a set links only to sets of its own and the neighbouring classes."""
    edges = [1]
    while edges[-1] < top:
        edges.append(edges[-1] * den // num + 1)
    return np.array(edges, np.int64)


@lru_cache(maxsize=4096)
def cells(key: int, num: int, den: int) -> int:
    """Number of cells for links with a member of size class ``key``; 0 where only equal sets link."""
    small, delta = int(size_classes(num, den)[key]), differences(key, num, den)
    if delta == 0:
        return 0
    m = delta + 1
    # The chance that a set leaves all but delta cells empty is below C(m, delta) * (delta / m) ** size.
    while (
        math.lgamma(m + 1) - math.lgamma(delta + 1) - math.lgamma(m - delta + 1) + small * math.log(delta / m)
    ) > math.log(0.05):
        m += 1 + m // 64
    return m


@lru_cache(maxsize=4096)
def differences(key: int, num: int, den: int) -> int:
    """Most shingles that differ between linked sets of which one is in size class ``key``."""
    large = int(size_classes(num, den)[key + 1]) - 1
    return (den - num) * (large + large * den // num) // (den + num)


def signatures(members: np.ndarray, cold: np.ndarray, num: int, den: int) -> np.ndarray:
    """Regions of one sorted set; see ``signatures_of``."""
    return signatures_of(members, cold, np.array([0, len(members)]), num, den)[0]


def signatures_of(values: np.ndarray, cold: np.ndarray, bounds: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Regions of sorted sets, and the set of each: a hash of the content of each filled cell, for both size windows.

    ``cold`` marks the shingles that few documents have. Steps: cells of cold shingles, finer cells of
    them, cells of all shingles, finer cells of them, one region for what is left. A set takes the next
    step if it fills at most delta cells in this one. Two linked sets go through the same steps until
    one of them fills more than delta cells, and there they share a filled cell.
    """
    own = np.searchsorted(size_classes(num, den), np.diff(bounds), "right") - 1
    few = values[cold]
    parts = [(few, np.concatenate([[0], np.cumsum(cold)])[bounds], _running(few)), (values, bounds, _running(values))]
    keys, sets = [values[:0]], [np.zeros(0, np.int64)]
    for window in (own, own - 1):
        used, inverse = np.unique(window, return_inverse=True)
        m = np.array([cells(k, num, den) if k >= 0 else 0 for k in used.tolist()], K.U64)[inverse]
        delta = np.array([differences(k, num, den) if k >= 0 else 0 for k in used.tolist()], np.int64)[inverse]
        left = np.flatnonzero(m)
        for step, ((part, cut, running), fine) in enumerate(zip((parts[0], parts[0], parts[1], parts[1]), (1, 4, 1, 4), strict=True)):
            sizes = (cut[1:] - cut[:-1])[left]
            at, of = K.ragged(cut[left], sizes), np.repeat(np.arange(len(left)), sizes)
            cell = ((part[at] >> K.U64(32)) * (K.U64(fine) * m[left])[of]) >> K.U64(32)  # sorted, as each set is
            first = np.ones(len(at), bool)
            first[1:] = (cell[1:] != cell[:-1]) | (of[1:] != of[:-1])
            first = np.flatnonzero(first)
            last = np.append(first[1:], len(at))[: len(first)] - 1
            filled = of[first]
            with np.errstate(over="ignore"):
                salt = K.mix(cell[first] * K.ODD[3] + window[left].astype(K.U64)[filled] * K.ODD[4] + K.U64(step) * K.ODD[5])
                keys.append(K.mix(running[at[last] + 1] - running[at[first]] + salt))
            sets.append(left[filled])
            left = left[np.bincount(filled, minlength=len(left)) <= delta[left]]
            if not len(left):
                break
        else:
            keys.append(K.mix(window[left].astype(K.U64) ^ K.ODD[6]))
            sets.append(left)
    return np.concatenate(keys), np.concatenate(sets)


def _running(part: np.ndarray) -> np.ndarray:
    running = np.zeros(len(part) + 1, K.U64)
    with np.errstate(over="ignore"):
        np.cumsum(K.mix(part ^ K.ODD[7]), out=running[1:])
    return running


def least_of_equal(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with their least node, and the edges (node, least) of the other nodes."""
    if not len(keys):
        return keys, nodes, np.zeros((0, 2), np.int64)
    order = np.argsort(keys)
    keys, nodes = keys[order], nodes[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    least = np.minimum.reduceat(nodes, first)
    to = np.repeat(least, np.diff(np.append(first, len(keys))))
    other = nodes != to
    edges = np.unique(np.stack([nodes[other], to[other]], 1), axis=0) if other.any() else np.zeros((0, 2), np.int64)
    return keys[first], least, edges


# --- exact join of a region in one task ---------------------------------------------------------
class Holders:
    """Which sets hold each element, to meet one set with all at once."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(self.sizes)])
        universe, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.holders = np.repeat(np.arange(len(sets)), self.sizes)[np.argsort(self.flat, kind="stable")]
        self.held = np.bincount(self.flat, minlength=len(universe))
        self.begins = np.cumsum(self.held) - self.held

    def shared(self, one: int) -> np.ndarray:
        """Number of elements that set ``one`` shares with each set."""
        own = self.flat[self.bounds[one] : self.bounds[one + 1]]
        met = self.holders[K.ragged(self.begins[own], self.held[own])]
        return np.bincount(met, minlength=len(self.sizes))


def links_within(sets: list[np.ndarray], num: int, den: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect the classes of a region: pivot by pivot, until all that is left is one class.

    Each pivot is compared with every remaining set and then removed. Pivots come from the smallest
    classes, so that the members of the largest class are never compared with each other. ``known``
    numbers classes that earlier pivots have found.
    """
    index = Holders(sets)
    sizes = index.sizes
    label = np.arange(len(sets)) if known is None else np.unique(known, return_inverse=True)[1]
    open_: dict[int, list[int]] = {}  # members by class, without past pivots
    for i, c in enumerate(label.tolist()):
        open_.setdefault(c, []).append(i)
    whole = {c: list(members) for c, members in open_.items()}
    queue, found = [(len(members), c) for c, members in open_.items()], []
    heapq.heapify(queue)
    left = np.ones(len(sets), bool)
    while len(open_) > 1:
        size, name = heapq.heappop(queue)
        if name not in open_ or len(open_[name]) != size:
            continue
        pivot = open_[name].pop()
        left[pivot] = False
        shared = index.shared(pivot)
        near = left & (label != name) & (den * shared >= num * (sizes + sizes[pivot] - shared))
        for other in np.flatnonzero(near).tolist():
            found.append((pivot, other))
            old = int(label[other])
            if old != name:
                gone, stays = sorted((old, name), key=lambda c: len(whole[c]))
                label[whole[gone]] = stays
                whole[stays] += whole.pop(gone)
                open_[stays] += open_.pop(gone)
                name = stays
        if open_[name]:
            heapq.heappush(queue, (len(open_[name]), name))
        else:
            del open_[name]
    return found


def regions_of(distance: np.ndarray, eps: float, far: float = 0.5) -> np.ndarray:
    """Membership of each set (row) in the regions of the pivots (columns) and in the far region (last).

    Home is the nearest pivot if it is within ``far``, else the far region. If d(x, y) <= eps, the
    triangle inequality puts x into the home of y: a pivot within 2 eps of x's nearest distance, or the
    far region if x's nearest distance is at least ``far`` - eps.
    """
    slack = 1e-9
    nearest = distance.min(axis=1, keepdims=True)
    inside = (distance <= nearest + 2 * eps + slack) & (distance <= far + eps + slack)
    return np.hstack([inside, nearest >= far - eps - slack])


def pivot_classes(edges: list[tuple[int, int]]) -> dict[int, int]:
    """Least pivot of the class of each pivot that occurs in ``edges``."""
    least = {p: p for edge in edges for p in edge}
    for p, q in edges:
        one, two = least[p], least[q]
        if one != two:
            least = {k: min(one, two) if v in (one, two) else v for k, v in least.items()}
    return least


# --- Spark ----------------------------------------------------------------------------------------
def classes(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, text_hash, node, n_shingles) for each row; equal sets share their node. Rows without ``node`` carry
    ``common``, slots of shingles that a task saw often.

    Nodes are 64-bit digests. A second digest tells different sets with an equal node apart; this is
    looked for and raised as an error (chance 1e-3 for 100 million different sets) instead of being
    merged silently.
    """

    def run(batches):
        seen = np.zeros(SLOTS, np.int32)
        for rows, data, bounds in K.pieces(batches):
            values, cut = shingle_sets(data, bounds, n)
            one, two = digests(values, cut)
            _, first = np.unique(one, return_index=True)
            sizes = np.diff(cut)[first]
            np.add.at(seen, _slot(values[K.ragged(cut[first], sizes)]), 1)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(2), pa.array(one), pa.array(two), pa.array(np.diff(cut)), pa.nulls(rows.num_rows, pa.list_(pa.int64()))],
                names,
            )
        load = seen.mean()
        often = np.flatnonzero(seen >= 8 + load + 8 * math.sqrt(load))
        yield pa.RecordBatch.from_arrays(
            [*(pa.nulls(1, pa.int64()) for _ in range(5)), pa.array([often.tolist()], pa.list_(pa.int64()))], names
        )

    names = ["doc_id", "text_hash", "node", "check", "n_shingles", "common"]
    schema = "doc_id long, text_hash long, node long, check long, n_shingles long, common array<long>"
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("text_hash"))
    return stored(texts.mapInArrow(run, schema), "jaccard-classes")


def common_slots(rows: DataFrame) -> np.ndarray:
    """A table of ``SLOTS`` flags for shingles that many documents share. Any table gives right results;
    this one keeps passages of many documents from joining their islands."""
    table = np.zeros(SLOTS, bool)
    found = rows.filter("node IS NULL").select(F.explode("common").alias("slot")).distinct()
    table[np.asarray(found.toArrow().column("slot"), np.int64)] = True
    return table


def _slot(values: np.ndarray) -> np.ndarray:
    return (K.mix(values) >> K.U64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def _folds(found: Iterable[tuple[np.ndarray, np.ndarray]], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of arrays, put together until a pair holds ``most`` entries or more."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for pair in found:
        held.append(pair)
        if sum(len(keys) for keys, _ in held) >= most:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held = []
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def candidate_edges(docs: DataFrame, common: np.ndarray, n: int, num: int, den: int) -> DataFrame:
    """Edges (a, b) between nodes that share a region, as stars around the region's least node.

    Equal regions of about ``FOLD`` signatures are folded before the shuffle; the shuffle moves packed lists
    by hash of the region, so that a region that a third of all rows share is one entry per fold, and the number
    of lists does not grow with the rows times the buckets.
    """
    spread = 4 * parts(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(common))  # SLOTS bits

    def send(batches):
        table = np.unpackbits(shared.value).astype(bool)
        for found, owner in _folds(sign(batches, table), FOLD):
            keys, least, edges = least_of_equal(found, owner)
            bucket = (keys % K.U64(spread)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(spread + 1))
            full = np.flatnonzero(np.diff(cuts))
            cuts = np.append(cuts[full], len(order))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(full),
                    K.lists(keys[order].view(np.int64), cuts, pa.int64()),
                    K.lists(least[order], cuts, pa.int64()),
                ],
                ["bucket", "keys", "nodes"],
            )
            if len(edges):  # stars of this fold travel as regions named by their own node
                yield pa.RecordBatch.from_arrays(
                    [pa.array([-1]), K.lists(edges[:, 0], np.array([0, len(edges)]), pa.int64()), K.lists(edges[:, 1], np.array([0, len(edges)]), pa.int64())],
                    ["bucket", "keys", "nodes"],
                )

    def sign(batches, table):
        for _, data, bounds in K.pieces(batches):
            values, cut = shingle_sets(data, bounds, n)
            nodes, cold = digests(values, cut)[0], ~table[_slot(values)]
            regions, owner = signatures_of(values, cold, cut, num, den)
            yield regions, nodes[owner]

    def meet(batches):
        keys, nodes = [], []
        for batch in batches:
            ready = pc.less(batch.column(0), 0)
            own, rest = batch.filter(ready), batch.filter(pc.invert(ready))
            if own.num_rows:
                yield pa.RecordBatch.from_arrays([own.column(1).flatten(), own.column(2).flatten()], ["a", "b"])
            keys.append(np.asarray(rest.column(1).flatten()).view(K.U64))
            nodes.append(np.asarray(rest.column(2).flatten()))
        if keys:
            edges = least_of_equal(np.concatenate(keys), np.concatenate(nodes))[2]
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])

    sent = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(send, "bucket long, keys array<long>, nodes array<long>")
    # Finished stars have no region left to meet in; a hash of their first node deals them out evenly.
    dealt = sent.repartition(spread // 4, F.when(F.col("bucket") < 0, F.xxhash64(F.col("keys")[0])).otherwise(F.col("bucket")))
    return dealt.mapInArrow(meet, "a long, b long").distinct()


def row_key(doc_id: str, text_hash: str | Column) -> Column:
    """Hash of what tells the rows of ``classes`` apart."""
    return F.xxhash64(F.col(doc_id).cast("long"), text_hash)


def row_bits(keys: DataFrame) -> DataFrame:
    """(word, mask): a bitmap of ``BITS`` bits over the column ``key``, whatever the input."""
    slots = keys.select(F.pmod("key", F.lit(BITS)).alias("slot"))
    words = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot % 64 AS INT))")).alias("mask"))
    return stored(words, "jaccard-bits")


def by_bits(docs: DataFrame, bits: DataFrame, inside: bool) -> DataFrame:
    """Rows of ``docs`` that may be of the keys behind ``bits``, or the others, which surely are not. Texts stay where they lie."""
    slot = F.pmod(row_key("d.doc_id", F.xxhash64("d.text")), F.lit(BITS))
    hit = F.coalesce(F.getbit("b.mask", (slot % 64).cast("int")) == 1, F.lit(False))
    met = docs.alias("d").join(F.broadcast(bits).alias("b"), F.shiftright(slot, 6) == F.col("b.word"), "inner" if inside else "left")
    return met.filter(hit if inside else ~hit).select("d.*")


def member_sets(docs: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """(island, node, elements) of the nodes in ``members``, recomputed from one text of each class.

    A bitmap over the rows that hold these texts spares the others; what slips through leaves in the join.
    """
    bits = row_bits(members.select(row_key("first_id", "first_hash").alias("key")))

    def run(batches):
        for rows, data, bounds in K.pieces(batches):
            values, cut = shingle_sets(data, bounds, n)
            nodes = digests(values, cut)[0]
            # The join keeps the row with the class's least id and text: each piece sends its own least one, null ids last.
            ids, texts, pick = rows.column(0), np.asarray(rows.column(2)), np.flatnonzero(nodes != NONE)
            pick = pick[np.lexsort((texts[pick], np.asarray(ids.fill_null(0))[pick], np.asarray(ids.is_null())[pick], nodes[pick]))]
            pick = np.sort(pick[np.unique(nodes[pick], return_index=True)[1]])
            sizes = cut[pick + 1] - cut[pick]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0).take(pa.array(pick)),
                    rows.column(2).take(pa.array(pick)),
                    pa.array(nodes[pick]),
                    K.lists(values[K.ragged(cut[pick], sizes)].view(np.int64), np.concatenate([[0], np.cumsum(sizes)]), pa.int64()),
                ],
                ["doc_id", "text_hash", "node", "elements"],
            )

    texts = by_bits(docs, bits, True).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("text_hash"))
    found = texts.mapInArrow(run, "doc_id long, text_hash long, node long, elements array<long>")
    # One row per node: that of the class's own document. Rows with equal id and text may still repeat.
    own = (found["node"] == members["node"]) & found["doc_id"].eqNullSafe(members["first_id"]) & (found["text_hash"] == members["first_hash"])
    return found.join(members, own).select(members["island"], found["node"], "elements")


SLICE_SETS, SLICE_ELEMENTS = 500, 1_000_000  # of an island that one task measures against the pivots
WORK = 50_000_000  # elements times open sets of a region that one task joins
LOT = 4 << 20  # bytes of small groups that one call takes
MEETINGS = 1 << 20  # elements times pivots of small groups that are measured at once


def region_links(sets: DataFrame, num: int, den: int, limit: int, pivots: int) -> DataFrame:
    """Links (a, b) inside the islands of ``sets`` (island, node, elements) that connect their classes.

    All islands are cut by pivots first. Regions of at most ``limit`` elements and ``WORK`` are joined in
    one task each, larger ones are cut again or joined in pairs of blocks; both bounds set memory and time
    of a task, never the result. Rounds move ids; elements join them where sets are compared.
    """
    elements = sets.select("node", "elements")
    place = sets.select(
        F.col("island").alias("region"), "node", F.lit(None).cast("long").alias("label"), F.size("elements").cast("long").alias("size")
    )
    links, leaves = None, None
    while True:
        measured = _measure(place, elements, num, den, pivots)
        found = measured.filter("kind = 0").select(F.col("node").alias("a"), F.col("other").alias("b"))
        cut = stored(_regions(measured, 1 - num / den, limit), "jaccard-regions")
        leaf = cut.filter("leaf").select("region", "node", "label")
        links, leaves = (found, leaf) if links is None else (links.union(found), leaves.union(leaf))
        place = cut.filter("NOT leaf").select("region", "node", "label", "size")
        if place.isEmpty():
            break
    joined = _by_groups(leaves.join(elements, "node"), ["region"], lambda lot: _join_small(lot, num, den), "a long, b long")
    return links.union(joined)


def _by_groups(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``fn`` over lots of whole groups of ``keys``, so that a small group costs no call of its own."""

    def run(batches):
        for lot in _lots(batches, keys, LOT):
            yield from fn(lot).to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _lots(batches: Iterable[pa.RecordBatch], keys: list[str], most: int) -> Iterator[pa.Table]:
    """Tables of whole groups out of rows sorted by ``keys``, of about ``most`` bytes unless a group has more."""
    held: list[pa.Table] = []
    size, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(key)) for key in keys]
        begins = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        begins = np.flatnonzero(np.concatenate([[bool(held) and [c[0] for c in columns] != last], begins]))
        table = pa.Table.from_batches([batch])
        last = [c[-1] for c in columns]
        held.append(table)
        size += batch.nbytes
        if size >= most and len(begins) and (len(held) > 1 or begins[-1]):
            yield pa.concat_tables([*held[:-1], table.slice(0, begins[-1])])
            held = [table.slice(begins[-1])]
            size = held[0].nbytes
    if held:
        yield pa.concat_tables(held)


def _cut(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Bounds of the groups of ``keys`` in a table sorted by them."""
    columns = [np.asarray(table.column(key)) for key in keys]
    return np.concatenate([[0], np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1, [table.num_rows]])


def _sets(group: pa.Table) -> list[np.ndarray]:
    lists = group.column("elements").combine_chunks()
    cut, flat = np.asarray(lists.offsets), np.asarray(lists.values).view(K.U64)
    return [flat[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _labels(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Labels of the rows, and which rows have one."""
    column = group.column("label").combine_chunks()
    return np.asarray(column.fill_null(0)), ~np.asarray(column.is_null())


def _join_small(lot: pa.Table, num: int, den: int) -> pa.Table:
    nodes = np.asarray(lot.column("node"))
    label, has = _labels(lot)
    sets, cut, found = _sets(lot), _cut(lot, ["region"]).tolist(), []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        # Classes by label; a row without one is a class of its own.
        known = np.unique(label[a:b], return_inverse=True)[1]
        known = np.where(has[a:b], known, b - a + np.arange(b - a))
        found += [(a + i, a + j) for i, j in (links_within(sets[a:b], num, den, known) if b - a > 1 else [])]
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pa.table({"a": nodes[pairs[:, 0]], "b": nodes[pairs[:, 1]]})


def _shared(sets: list[np.ndarray], group: np.ndarray, pivots: np.ndarray, most: int) -> np.ndarray:
    """Elements that each set shares with each pivot of its group, of at most ``most``; ``pivots`` are in order of groups and ranks."""
    if len(group) and group[0] == group[-1]:
        index = Holders(sets)
        return np.stack([index.shared(p) for p in pivots.tolist()], 1)
    place = np.arange(len(pivots)) - np.searchsorted(group[pivots], group[pivots])
    sizes = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    with np.errstate(over="ignore"):
        flat = flat + K.mix(group.astype(K.U64))[owner]  # tells most groups apart; the others are told apart below
    held = flat[K.ragged((np.cumsum(sizes) - sizes)[pivots], sizes[pivots])]
    holder = np.repeat(np.arange(len(pivots)), sizes[pivots])
    order = np.argsort(held, kind="stable")
    held, holder = held[order], holder[order]
    low, high = np.searchsorted(held, flat), np.searchsorted(held, flat, "right")
    one, other = np.repeat(owner, high - low), holder[K.ragged(low, high - low)]
    inside = group[one] == group[pivots[other]]
    return np.bincount(one[inside] * most + place[other[inside]], minlength=len(sets) * most).reshape(-1, most)


def _measure(place: DataFrame, elements: DataFrame, num: int, den: int, pivots: int) -> DataFrame:
    """One round of pivots over the regions of ``place`` (region, node, label, size), in rows of three kinds.

    0: a link (node, other) with a pivot. 1: ``node`` lies in ``parts`` of its region, ``away`` from their pivots,
    and, unless ``core`` is null, in the class of pivot ``core``. 2: pivots ``part`` and ``other`` are of one class. Pivots have met
    every set of their region and leave. They are copied to slices of the region, so no task reads one whole.
    """
    sizes = place.groupBy("region").agg(F.count("*").alias("sets"), F.sum("size").alias("total")).filter("sets > 1")
    sizes = sizes.select(
        "region",
        F.least(F.lit(pivots), F.ceil(F.sqrt("sets"))).alias("most"),
        F.greatest(F.ceil(F.col("sets") / SLICE_SETS), F.ceil(F.col("total") / SLICE_ELEMENTS)).alias("slices"),
    )
    by_hash = Window.partitionBy("region").orderBy(F.xxhash64("node", "region"), "node")
    first = place.select("region", "node", F.row_number().over(by_hash).alias("rank")).filter(F.col("rank") <= pivots)
    rank = F.when(F.col("rank") <= F.col("most"), F.col("rank"))
    own = F.array(F.pmod(F.xxhash64("node"), F.col("slices")))
    sent = place.join(sizes, "region").join(first, ["region", "node"], "left").withColumn("rank", rank)
    sent = sent.withColumn("slice", F.explode(F.when(F.col("rank").isNull(), own).otherwise(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))))
    eps = 1 - num / den

    def measure(lot):
        cut = _cut(lot, ["region", "slice"])
        ranks = np.asarray(lot.column("rank").combine_chunks().fill_null(0))
        sizes = np.asarray(lot.column("size"))
        counts = np.add.reduceat((ranks > 0).astype(np.int64), cut[:-1])
        meetings = np.cumsum(np.add.reduceat(sizes, cut[:-1]) * counts)
        out, low = [], 0
        while low < len(counts):
            before = meetings[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(meetings, before + MEETINGS, "right")))
            out += measure_some(lot.slice(cut[low], cut[high] - cut[low]), np.diff(cut[low : high + 1]), counts[low:high])
            low = high
        return pa.concat_tables(out)

    def measure_some(lot, lengths, counts):
        nodes, sizes = np.asarray(lot.column("node")), np.asarray(lot.column("size"))
        region, part_of = np.asarray(lot.column("region")), np.asarray(lot.column("slice"))
        label, has = _labels(lot)
        ranks = np.asarray(lot.column("rank").combine_chunks().fill_null(0))
        group, most = np.repeat(np.arange(len(lengths)), lengths), int(counts.max())
        chosen = np.flatnonzero(ranks)
        chosen = chosen[np.lexsort((ranks[chosen], group[chosen]))]
        # Pivots of each group in a row of a table, as wide as the largest group needs.
        real = np.arange(most) < counts[:, None]
        pivot = np.zeros((len(counts), most), np.int64)
        pivot[real] = chosen
        mine, real = pivot[group], real[group]
        shared = _shared(_sets(lot), group, chosen, most)
        union = sizes[:, None] + sizes[mine] - shared
        near = real & (den * shared >= num * union)
        same = near | (real & has[:, None] & has[mine] & (label[:, None] == label[mine]))
        distance = np.where(real, 1 - shared / np.where(real, union, 1), 2.0)  # 2: not a pivot of this group
        rows = np.flatnonzero(ranks == 0)
        # Pivots meet each other in every slice; the first one tells it.
        telling = np.flatnonzero((ranks == 0) | (part_of == 0))
        at, to = np.nonzero(near[telling])
        at, to = telling[at], mine[telling[at], to]
        at, to = at[at != to], to[at != to]
        linked = _rows(region[at], 0, nodes[at], other=nodes[to])
        inside = regions_of(distance[rows], eps)
        who, part = np.nonzero(inside)
        cut = np.concatenate([[0], np.cumsum(inside.sum(axis=1))])
        away = np.hstack([distance[rows], np.full((len(rows), 1), -1.0)])  # -1: far from all pivots
        core = np.where(same[rows].any(axis=1), same[rows].argmax(axis=1), -1)
        far = counts[group[rows]][who]
        member = _rows(
            region[rows], 1, nodes[rows], parts=K.lists(np.minimum(part, far), cut, pa.int64()), away=K.lists(away[who, part], cut, pa.float64()),
            core=pa.array(core, mask=core < 0), label=pa.array(label[rows], mask=~has[rows]), size=sizes[rows],
        )
        # Pivots that a set has in common are of one class: each with the next one.
        who, part = np.nonzero(same[telling])
        after = np.flatnonzero(who[1:] == who[:-1])
        pairs = np.unique(np.stack([region[telling[who[after]]], part[after], part[after + 1]], 1), axis=0)
        return [linked, member, _rows(pairs[:, 0], 2, np.zeros(len(pairs), np.int64), part=pairs[:, 1], other=pairs[:, 2])]

    schema = "region long, kind int, node long, part long, other long, core long, label long, size long, parts array<long>, away array<double>"
    return stored(_by_groups(sent.join(elements, "node"), ["region", "slice"], measure, schema), "jaccard-round")


def _rows(region: np.ndarray, kind: int, node: np.ndarray, **columns) -> pa.Table:
    n = len(node)
    out = {"region": pa.array(region, pa.int64()), "kind": pa.array(np.full(n, kind, np.int32)), "node": pa.array(node, pa.int64())}
    for name in ("part", "other", "core", "label", "size"):
        column = columns.get(name)
        out[name] = pa.nulls(n, pa.int64()) if column is None else column if isinstance(column, pa.Array) else pa.array(column, pa.int64())
    for name, kind_of in (("parts", pa.int64()), ("away", pa.float64())):
        out[name] = columns.get(name, pa.nulls(n, pa.list_(kind_of)))
    return pa.table(out)


def _numbers(count: str) -> Column:
    """0 to ``count`` - 1; empty for 0."""
    return F.filter(F.sequence(F.lit(0).cast("long"), F.col(count)), lambda j: j < F.col(count))


def _open_sets(rows: DataFrame) -> DataFrame:
    """Elements of each (region, part), its largest class, and how many sets lie outside it; ``rows`` (region, part,
    label, n, held) stand for ``n`` sets of ``held`` elements."""
    by_label = rows.groupBy("region", "part", "label").agg(F.sum("n").alias("n"), F.sum("held").alias("held"))
    stats = by_label.groupBy("region", "part").agg(
        F.sum("n").alias("sets"), F.sum("held").alias("total"), F.max(F.when(F.col("label").isNotNull(), F.struct("n", "held", "label"))).alias("main")
    )
    return stats.select(
        "region", "part", "total", F.col("main.label").alias("main"), F.coalesce("main.held", F.lit(0)).alias("main_total"),
        (F.col("sets") - F.coalesce("main.n", F.lit(1))).alias("links_from"),
    )


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings equal keys together, and where each run of them begins in it; not for no rows."""
    order = np.lexsort(keys)
    return order, np.flatnonzero(np.concatenate([[True], np.any([key[order][1:] != key[order][:-1] for key in keys], axis=0)]))


def _windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least and greatest distance of the sets (region, parts, away) of a batch to each pivot of a region, so that
    no row is made for a set and a pivot."""
    for batch in batches:
        region = np.repeat(np.asarray(batch.column("region")), pc.list_value_length(batch.column("parts")).to_numpy(zero_copy_only=False))
        if not len(region):
            continue
        part, away = (np.asarray(batch.column(name).flatten()) for name in ("parts", "away"))
        order, begins = _runs(region, part)
        region, part, away = region[order], part[order], away[order]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (region[begins], part[begins], np.minimum.reduceat(away, begins), np.maximum.reduceat(away, begins))],
            ["region", "parts", "low", "high"],
        )


def _sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number and elements of the sets (region, label, size, parts) of a batch in each part of a region by label, and
    in the region as part -1, so that no row is made for a set and a part."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.list_value_length(batch.column("parts")).to_numpy(zero_copy_only=False)
        row = np.concatenate([np.repeat(np.arange(batch.num_rows), lengths), np.arange(batch.num_rows)])
        part = np.concatenate([np.asarray(batch.column("parts").flatten()), np.full(batch.num_rows, -1)])
        region, size = (np.asarray(batch.column(name))[row] for name in ("region", "size"))
        label, has = np.asarray(batch.column("label").fill_null(0))[row], ~np.asarray(batch.column("label").is_null())[row]
        order, begins = _runs(region, part, label, has)
        first = order[begins]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(region[first]),
                pa.array(part[first]),
                pa.array(label[first], mask=~has[first]),
                pa.array(np.diff(np.append(begins, len(order)))),
                pa.array(np.add.reduceat(size[order], begins)),
            ],
            ["region", "part", "label", "n", "held"],
        )


def _regions(measured: DataFrame, eps: float, limit: int) -> DataFrame:
    """(region, node, label, size, leaf) of the regions in which different classes may still link.

    Sets outside the largest class of a region are open: only they can bring new links. The largest class
    follows into a part only where, by the triangle inequality, it may link to the part's open sets. A set
    keeps its parts in one row until it is known whether the cut halves the work; only then it is dealt out.
    """

    def classes_of(lot: pa.Table) -> pa.Table:
        cut, out = _cut(lot, ["region"]).tolist(), ([], [], [])
        region, part, other = (lot.column(name).to_pylist() for name in ("region", "part", "other"))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            least = pivot_classes(list(zip(part[a:b], other[a:b], strict=True)))
            for column, more in zip(out, ([region[a]] * len(least), least, least.values()), strict=True):
                column += more
        return pa.table({name: pa.array(column, pa.int64()) for name, column in zip(("region", "core", "class"), out, strict=True)})

    # At most the square of the number of pivots for each region.
    same = measured.filter("kind = 2").select("region", "part", "other").distinct()
    same = _by_groups(same, ["region"], classes_of, "region long, core long, class long")
    label = F.when(F.col("core").isNotNull(), F.xxhash64("region", F.coalesce("class", "core"))).otherwise(F.col("label"))
    node = measured.filter("kind = 1").join(same, ["region", "core"], "left").withColumn("label", label)
    each = node.select("region", F.lit(-1).cast("long").alias("part"), "label", F.lit(1).cast("long").alias("n"), F.col("size").alias("held"))
    whole = _open_sets(each).filter("links_from > 0").select("region", "main")
    node = node.join(whole, "region").withColumn("is_open", ~F.coalesce(F.col("label") == F.col("main"), F.lit(False)))
    places = node.withColumn("places", F.arrays_zip("parts", "away"))
    windows = places.filter("is_open").select("region", "parts", "away").mapInArrow(_windows, "region long, parts long, low double, high double")
    windows = windows.groupBy("region", "parts").agg(F.min("low").alias("low"), F.max("high").alias("high")).groupBy("region")
    windows = windows.agg(F.map_from_entries(F.collect_list(F.struct("parts", F.struct("low", "high")))).alias("window"))
    kept = F.filter(
        "places",
        lambda at: F.col("is_open")
        | F.coalesce(at["away"].between(F.col("window")[at["parts"]]["low"] - eps - 1e-9, F.col("window")[at["parts"]]["high"] + eps + 1e-9), F.lit(False)),
    )
    placed = places.join(windows, "region").select("region", "node", "label", "size", F.transform(kept, lambda at: at["parts"]).alias("parts"))
    placed = stored(placed.filter(F.size("parts") > 0), "jaccard-places")
    stats = _open_sets(placed.mapInArrow(_sums, "region long, part long, label long, n long, held long"))
    stats = stats.withColumn("work", F.col("links_from").cast("double") * F.col("total"))
    units = stats.groupBy("region").agg(
        (F.sum(F.when(F.col("part") >= 0, F.col("work"))) <= 0.5 * F.max(F.when(F.col("part") < 0, F.col("work")))).alias("halved"),
        F.collect_list(F.when(F.col("links_from") > 0, F.struct("part", "total", "main", "main_total", "work"))).alias("units"),
    )
    units = units.withColumn("units", F.filter("units", lambda unit: (unit["part"] >= 0) == F.col("halved")))
    mine = F.filter("units", lambda unit: (unit["part"] < 0) | F.array_contains("parts", unit["part"]))
    rows = placed.join(units, "region").select("region", "node", "label", "size", "halved", F.inline(mine))
    rows = rows.withColumn("fits", (F.col("total") <= limit) & (F.col("work") <= WORK))
    one = F.xxhash64("region", "part")
    # Pairs of blocks: open sets meet all others, the largest class does not meet itself.
    of_work = F.sqrt(2 * F.col("work") / WORK)
    blocks = {
        "opens": F.ceil(F.greatest(F.lit(1.0), of_work, 2 * (F.col("total") - F.col("main_total")) / limit)),
        "mains": F.when(F.col("main").isNull(), 0).otherwise(F.ceil(F.greatest(F.lit(1.0), of_work, 2 * F.col("main_total") / limit))),
    }
    rows = rows.withColumns({k: v.cast("long") for k, v in blocks.items()})
    is_main = F.coalesce(F.col("label") == F.col("main"), F.lit(False))
    block = F.pmod(F.xxhash64("node", F.lit("block")), F.when(is_main, F.col("mains")).otherwise(F.col("opens")))
    rows = rows.withColumn("block", block)
    opens, mains = _numbers("opens"), _numbers("mains")
    among = F.transform(opens, lambda j: F.xxhash64(one, F.lit("open"), F.least("block", j), F.greatest("block", j)))
    across = F.transform(mains, lambda j: F.xxhash64(one, F.lit("main"), F.col("block"), j))
    with_open = F.transform(opens, lambda j: F.xxhash64(one, F.lit("main"), j, F.col("block")))
    pairs = F.when(is_main, with_open).otherwise(F.concat(among, across))
    again = F.col("halved") & ~F.col("fits")
    return rows.select(
        F.explode(F.when(F.col("fits") | again, F.array(one)).otherwise(pairs)).alias("region"), "node", "label", "size", (~again).alias("leaf")
    )




def join_nodes(
    docs: DataFrame, n: int, num: int, den: int, limit: int, pivots: int
) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, node, n_shingles), and nodes with their class (node, component_id, root)."""
    stored_rows = classes(docs, n)
    rows = stored_rows.filter("node IS NOT NULL")
    kinds = stored(
        rows.filter(F.col("node") != NONE)
        .groupBy("node")
        .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first"), F.min("check").alias("low"), F.max("check").alias("high"))
        .select("node", F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash"), "low", "high"),
        "jaccard-kinds",
    )
    if not kinds.filter("low <> high").isEmpty():
        raise RuntimeError("two different sets share a 64-bit digest")
    near = stored(candidate_edges(docs, common_slots(stored_rows), n, num, den), "jaccard-near")
    islands = components(near).withColumnRenamed("root", "island")
    members = stored(islands.join(kinds.select("node", "first_id", "first_hash"), "node"), "jaccard-members")
    sets = stored(member_sets(docs, members, n).dropDuplicates(["island", "node"]), "jaccard-sets")
    links = stored(region_links(sets, num, den, limit, pivots), "jaccard-links")
    roots = components(links)
    named = kinds.join(roots, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    ids = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows.select("doc_id", "text_hash", "node", "n_shingles"), named.join(ids, "root").select("node", "component_id", "root")


def jaccard_join(
    docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, limit: int = 2_000_000, pivots: int = 64
) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs`` (doc_id, text, ...): the classes of the graph
    that links texts whose Jaccard similarity on word ``n``-grams is at least ``num`` / ``den``."""
    rows, of_node = join_nodes(docs, n, num, den, limit, pivots)
    # A class may hold a third of all rows: its one row is what the join copies, and adaptive execution
    # splits the rows' side.
    return rows.join(of_node, "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("node") == NONE, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def one_of_each_class(
    docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, limit: int = 2_000_000, pivots: int = 64
) -> DataFrame:
    """The documents without all but the one with the least id of each class, with their columns.

    Documents without shingles all stay. Of rows that repeat the kept id, the one with the least hash of
    its text stays, and one of those that repeat the text too; null ids come last.
    """
    rows, of_node = join_nodes(docs, n, num, den, limit, pivots)
    keys = rows.join(of_node, "node").groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("copies"))
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    best = keys.groupBy("root").agg(F.min(place).alias("best"))
    marked = stored(
        keys.join(best, "root").select("doc_id", "text_hash", "copies", (place == F.col("best")).alias("stays")).filter("NOT stays OR copies > 1"),
        "jaccard-marked",
    ).alias("m")
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("m.doc_id")) & (F.xxhash64("d.text") == F.col("m.text_hash"))
    # Only rows that a bitmap of bounded size finds may have to go; the texts of all others never move.
    bits = row_bits(marked.select(row_key("doc_id", "text_hash").alias("key")))
    sure, kept = by_bits(docs, bits, False), by_bits(docs, bits, True).alias("d").join(marked.filter("NOT stays").alias("m"), same, "left_anti")
    repeated = marked.filter("stays").alias("m")
    if repeated.isEmpty():
        return sure.union(kept)
    once = kept.alias("d").join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return sure.union(kept.alias("d").join(repeated, same, "left_anti")).union(once)
