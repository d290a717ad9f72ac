"""Ranked lexical search over an inverted index by Block-Max MaxScore.

The index is made of shards, each of about ``SHARD`` bytes of consecutive documents of a partition, so no
text moves. A shard has one row of document ids and sizes and one row per term: its postings in blocks
of ``BLOCK`` documents, compressed to the bytes each block needs, and for each block its first and last
document and the least document size among the postings of one, two, three and more occurrences. From
these follow exact score maxima for any totals of the collection, so that totals and document
frequencies are summed from the stored index when a search begins.

A search takes the items in blocks. For every shard and item the terms' global bounds split its lists:
documents that are only in lists whose bounds together stay below the present k-th score are not looked at.
The others get the scores of the essential lists, and are then taken through the remaining lists from the
largest bound down; whoever cannot reach the k-th score with the maximum of the block it would lie in is
rejected before that block is decompressed. A task goes through many shards and keeps one heap per item;
the heaps of all tasks are merged by Spark. Rejections compare upper bounds with a score that k documents
have, so the result is exact.

Defined cases: null and empty texts have no terms, are no results and do not count in N; a null item text
has no results; rows with equal ids are separate documents with separate ranks; null ids come last among
equal scores; the terms of all rows of an item id make one query; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from crawlscope.llm import kernels as K
from crawlscope.llm.common import new_folder, parts

SHARD, BLOCK = 8 << 20, 64
#: Items and bytes of their terms that one pass over the index answers; an item of more bytes has a pass of its own.
MOST_ITEMS, MOST_BYTES = 256, 4 << 20
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
INDEX = "shard long, term string, df long, doc_ids array<long>, sizes array<int>, blocks binary, payload binary"
HITS = "item_id long, doc_id long, score long"
#: first, last, offset in the payload, bytes of a document number, bytes of a count, largest count, least sizes by count.
FIELDS, POINTS = 10, 4
_FAR = np.iinfo(np.int32).max


def _widths(most: np.ndarray) -> np.ndarray:
    return np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))


def _scatter(out: np.ndarray, at: np.ndarray, values: np.ndarray, widths: np.ndarray) -> None:
    """Little-endian bytes of the values at the given places."""
    for k in range(4):
        some = widths > k
        out[at[some] + k] = (values[some] >> (8 * k)) & 255


def compress(term: np.ndarray, doc: np.ndarray, tf: np.ndarray, size: np.ndarray, n_terms: int):
    """Blocks and payload of postings sorted by term and document: (block table, blocks per term, payload, bytes per term)."""
    n = len(term)
    if not n:
        return np.zeros((0, FIELDS), "<i4"), np.zeros(n_terms, np.int64), np.zeros(0, np.uint8), np.zeros(n_terms, np.int64)
    per_term = np.bincount(term, minlength=n_terms)
    place = np.arange(n) - np.repeat(np.cumsum(per_term) - per_term, per_term)
    begins = np.flatnonzero(place % BLOCK == 0)
    counts = np.diff(np.append(begins, n))
    block = np.repeat(np.arange(len(begins)), counts)
    first, last = doc[begins], doc[begins + counts - 1]
    most = np.maximum.reduceat(tf, begins)
    doc_width, tf_width = _widths(last - first), _widths(most - 1)
    nbytes = counts * (doc_width + tf_width)
    owner = term[begins]
    per_term_bytes = np.bincount(owner, nbytes, n_terms).astype(np.int64)
    at = np.cumsum(nbytes) - nbytes
    payload = np.zeros(int(nbytes.sum()), np.uint8)
    inside = np.arange(n) - begins[block]
    _scatter(payload, at[block] + inside * doc_width[block], doc - first[block], doc_width[block])
    _scatter(payload, (at + counts * doc_width)[block] + inside * tf_width[block], tf - 1, tf_width[block])
    table = np.empty((len(begins), FIELDS), "<i4")
    table[:, 0], table[:, 1], table[:, 2] = first, last, at - (np.cumsum(per_term_bytes) - per_term_bytes)[owner]
    table[:, 3], table[:, 4], table[:, 5] = doc_width, tf_width, most
    for c in range(POINTS):
        held = tf == c + 1 if c < POINTS - 1 else tf >= POINTS
        table[:, 6 + c] = np.minimum.reduceat(np.where(held, size, _FAR), begins)
    return table, np.bincount(owner, minlength=n_terms), payload, per_term_bytes


def _number(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Number of the term of each byte range, and the terms. Equal hashes are compared byte by byte.

    Hashes and comparisons need many times the bytes they work on, so both go through the shard in steps.
    """
    steps = list(K.steps(starts, ends))
    hashed = [K.hashes(data[starts[a] : ends[b - 1]], starts[a:b] - starts[a], ends[a:b] - starts[a]) for a, b in steps]
    _, first, number = np.unique(np.concatenate(hashed), return_index=True, return_inverse=True)
    sizes, twins = ends - starts, starts[first]
    same = np.array_equal(sizes, sizes[first][number]) and all(
        np.array_equal(data[K.ragged(twins[number[a:b]], sizes[a:b])], data[K.ragged(starts[a:b], sizes[a:b])]) for a, b in steps
    )
    whole = data.tobytes()
    if same:
        return number, [whole[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    known: dict[bytes, int] = {}
    number = np.array([known.setdefault(whole[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    return number, list(known)


def _shard(shard: int, ids: list[pa.Array], texts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    data = np.concatenate([d for d, _ in texts])
    bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(b) for _, b in texts]))])
    upper = (data >= 0x41) & (data <= 0x5A)
    data = data + (upper * np.uint8(0x20))
    starts, ends, cut = K.words(data, bounds, K.NOT_ALNUM)
    sizes = np.diff(cut).astype(np.int32)
    doc_ids = pa.concat_arrays(ids)
    names = ["shard", "term", "df", "doc_ids", "sizes", "blocks", "payload"]
    rows = [0, len(doc_ids)]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([shard]), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.ListArray.from_arrays(pa.array(rows, pa.int32()), doc_ids),
            K.lists(sizes, np.array(rows), pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()),
        ],
        names,
    )
    if not len(starts):
        return
    number, terms = _number(data, starts, ends)
    key = number * np.int64(len(sizes)) + np.repeat(np.arange(len(sizes)), sizes)
    key.sort()
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    tf = np.diff(np.append(new, len(key)))
    term, doc = np.divmod(key[new], len(sizes))
    table, blocks, payload, nbytes = compress(term, doc, tf, sizes[doc], len(terms))
    df = np.bincount(term, minlength=len(terms))

    def binary(raw: np.ndarray, per_term: np.ndarray) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum(per_term)]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(terms), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])

    whole = pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(terms), shard)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(df), pa.nulls(len(terms), pa.list_(pa.int64())),
            pa.nulls(len(terms), pa.list_(pa.int32())), binary(table, blocks * FIELDS * 4), binary(payload, nbytes),
        ],
        names,
    )
    for low in range(0, len(terms), 20_000):
        yield whole.slice(low, 20_000)


def build_index(docs: DataFrame, path: str | None = None) -> str:
    """Write the index of ``docs`` (doc_id, text, ...) as Parquet and return its path."""
    spark = docs.sparkSession
    path = path or new_folder(spark, "index")

    def run(batches):
        # The shard's number is that of the partition and of the shard in it.
        shard, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0
        for rows, data, bounds in K.pieces(batches):
            if ids and held + len(data) > SHARD:
                yield from _shard(shard, ids, texts)
                shard, ids, texts, held = shard + 1, [], [], 0
            ids.append(rows.column(0))
            texts.append((data.copy(), bounds))
            held += len(data)
        if ids:
            yield from _shard(shard, ids, texts)

    docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, INDEX).write.parquet(path)
    return path


class List:
    """A term's postings in one shard, with the scores they give and bounds of them."""

    __slots__ = ("table", "first", "last", "most", "bound", "payload", "weight", "norm", "sizes", "blocks")

    def __init__(self, table: np.ndarray, most: np.ndarray, bound: int, payload: bytes, weight: int, norm, sizes: np.ndarray):
        self.table, self.most, self.bound, self.payload, self.weight, self.norm, self.sizes = table, most, bound, payload, weight, norm, sizes
        self.first, self.last = table[:, 0], table[:, 1]
        self.blocks: list = [None] * len(table)

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of a block, decompressed when first asked for."""
        if self.blocks[b] is None:
            at, doc_width, tf_width = self.table[b, 2:5].tolist()
            end = self.table[b + 1, 2] if b + 1 < len(self.table) else len(self.payload)
            n = (int(end) - at) // (doc_width + tf_width)
            docs = np.frombuffer(self.payload, f"<u{doc_width}", n, at).astype(np.int64) + self.first[b]
            tf = np.frombuffer(self.payload, f"<u{tf_width}", n, at + n * doc_width).astype(np.int64) + 1
            self.blocks[b] = docs, self.weight * gain(tf, self.norm(self.sizes[docs]))
        return self.blocks[b]

    def between(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of all blocks that meet a window."""
        a, b = int(np.searchsorted(self.last, low)), int(np.searchsorted(self.first, high))
        if b - a == 1:
            return self.block(a)
        found = [self.block(i) for i in range(a, b)]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([d for d, _ in found]), np.concatenate([s for _, s in found])


def lists_of(terms: dict[str, tuple[bytes, bytes]], weight: dict[str, int], norm, sizes: np.ndarray) -> dict[str, List]:
    """The lists of one shard, with the greatest score in each block and in each list."""
    terms = {t: found for t, found in terms.items() if t in weight}
    if not terms:
        return {}
    cuts = np.concatenate([[0], np.cumsum([len(blocks) // (4 * FIELDS) for blocks, _ in terms.values()])])
    table = np.frombuffer(b"".join(blocks for blocks, _ in terms.values()), "<i4").reshape(-1, FIELDS).astype(np.int64)
    weights = np.repeat(np.array([weight[t] for t in terms]), np.diff(cuts))
    least, largest = table[:, 6:], table[:, 5]
    counts = np.repeat(np.arange(1, POINTS + 1)[None, :], len(table), 0)
    counts[:, -1] = np.maximum(largest, POINTS)
    most = weights * np.where(least < _FAR, gain(counts, norm(np.where(least < _FAR, least, 0))), 0).max(1)
    bounds = np.maximum.reduceat(most, cuts[:-1]).tolist()
    return {
        t: List(table[a:b], most[a:b], bound, payload, weight[t], norm, sizes)
        for (t, (_, payload)), a, b, bound in zip(terms.items(), cuts[:-1].tolist(), cuts[1:].tolist(), bounds, strict=True)
    }


def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def norm_of(n_docs: int, total: int):
    """m of document sizes; exact also where 64 bits would not hold the product."""

    def norm(sizes: np.ndarray) -> np.ndarray:
        sizes = np.asarray(sizes, np.int64)
        if not sizes.size or int(sizes.max()) * 90 * n_docs < 1 << 63:
            return 10 + (sizes * (90 * n_docs)) // total
        return 10 + np.array([90 * int(s) * n_docs // total for s in sizes.ravel()], np.int64).reshape(sizes.shape)

    return norm


class Heap:
    """The k best (score, document id) so far; equal scores by ascending id, null last."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.null = k, *(np.zeros(0, np.int64),) * 2, np.zeros(0, bool)

    @property
    def floor(self) -> int:
        """A document below this is no result."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        scores, ids, null = (np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.null, null)))
        best = np.lexsort((ids, null, -scores))[: self.k]
        self.scores, self.ids, self.null = scores[best], ids[best], null[best]


def search_shard(lists: list[List], heap: Heap, ids: np.ndarray, null: np.ndarray, windows: list[int]) -> None:
    """Block-Max MaxScore over one shard; the heap takes what it finds."""
    lists = sorted(lists, key=lambda x: x.bound)
    below = np.concatenate([[0], np.cumsum([x.bound for x in lists])])  # bounds of the lists before each
    for low, high in zip(windows[:-1], windows[1:], strict=True):
        essential = int(np.searchsorted(below[1:], heap.floor))  # the first list that reaches it with those before
        if essential == len(lists):
            return
        score, seen = np.zeros(high - low, np.int64), np.zeros(high - low, bool)
        for x in lists[essential:]:
            docs, gains = x.between(low, high)
            if len(docs) and (docs[0] < low or docs[-1] >= high):
                inside = slice(*np.searchsorted(docs, (low, high)))
                docs, gains = docs[inside], gains[inside]
            score[docs - low] += gains
            seen[docs - low] = True
        docs = np.flatnonzero(seen)
        score = score[docs]
        docs += low
        for i in range(essential - 1, -1, -1):
            x, floor = lists[i], heap.floor
            some = score + below[i + 1] >= floor
            docs, score = docs[some], score[some]
            if not len(docs):
                break
            b = np.minimum(np.searchsorted(x.last, docs), len(x.last) - 1)
            inside = (x.first[b] <= docs) & (docs <= x.last[b])
            some = score + np.where(inside, x.most[b], 0) + below[i] >= floor  # rejected before decompression
            docs, score, b, inside = docs[some], score[some], b[some], inside[some]
            wanted = np.unique(b[inside])
            if len(wanted):
                found = [x.block(j) for j in wanted.tolist()]
                members, gains = (np.concatenate(c) for c in zip(*found, strict=True))
                at = np.minimum(np.searchsorted(members, docs), len(members) - 1)
                score = score + np.where(members[at] == docs, gains[at], 0)
        some = score >= heap.floor
        if some.any():
            docs = docs[some]
            heap.add(score[some], ids[docs], null[docs])


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms): distinct terms of all texts of an id."""
    words = F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0)))
    return items.select(F.col("item_id").cast("long"), words.alias("term")).groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def query_blocks(items: DataFrame) -> Iterator[list[Row]]:
    block, size = [], 0
    for row in query_terms(items).toLocalIterator():
        more = sum(map(len, row.terms))
        if block and (len(block) == MOST_ITEMS or size + more > MOST_BYTES):
            yield block
            block, size = [], 0
        block.append(row)
        size += more
    if block:
        yield block


def _answer(index: DataFrame, block: list[Row], n_docs: int, total: int, k: int) -> DataFrame:
    spark = index.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(t,) for t in sorted({t for r in block for t in r.terms})], "term string"))
    counts = index.select("term", "df").join(wanted, "term").groupBy("term").agg(F.sum("df").alias("df")).collect()  # terms of the block at most
    weight = {r.term: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r.df + 1))) for r in counts}
    weight = {t: w for t, w in weight.items() if w > 0}  # other terms add nothing
    queries = [(r.item_id, terms) for r in block if (terms := [t for t in r.terms if t in weight])]
    norm = norm_of(n_docs, total)

    def shards(batches: Iterable[pa.RecordBatch]):
        """(document ids, sizes, rows of terms) of one shard after the other; a shard's documents come first."""
        ids = sizes = None
        terms: dict[str, tuple[bytes, bytes]] = {}
        for batch in batches:
            for row, (term, blocks, payload) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 5, 6)), strict=True)):
                if term is None:
                    if ids is not None:
                        yield ids, sizes, terms
                    ids, sizes, terms = batch.column(3)[row].values, batch.column(4)[row].values.to_numpy(zero_copy_only=False).astype(np.int64), {}
                else:
                    terms[term] = blocks, payload
        if ids is not None:
            yield ids, sizes, terms

    def run(batches):
        heaps = [Heap(k) for _ in queries]
        for ids, sizes, terms in shards(batches):
            null = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            lists = lists_of(terms, weight, norm, sizes)
            n = len(ids)
            for (_, wanted_terms), heap in zip(queries, heaps, strict=True):
                mine = [lists[t] for t in wanted_terms if t in lists]
                if mine:  # a first small window gives a score to reject with
                    search_shard(mine, heap, ids, null, [0, n] if len(heap.scores) == k or n < 1000 else [0, 250, n])
        for (item, _), heap in zip(queries, heaps, strict=True):
            if len(heap.scores):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(heap.scores), pa.int64()), pa.array(heap.ids, mask=heap.null), pa.array(heap.scores)], ["item_id", "doc_id", "score"]
                )

    heads = index.filter(F.col("term").isNull())
    hits = heads.unionByName(index.join(wanted, "term", "left_semi").select(*index.columns))
    dealt = hits.repartition(parts(spark), "shard").sortWithinPartitions("shard", F.col("term").asc_nulls_first())
    return dealt.mapInArrow(run, HITS)


def search(spark: SparkSession, path: str, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of the index for each item (item_id, text, ...)."""
    index = spark.read.schema(INDEX).parquet(path)
    sizes = index.filter(F.col("sizes").isNotNull()).select(
        F.size(F.filter("sizes", lambda s: s > 0)).cast("long").alias("n"), F.aggregate("sizes", F.lit(0).cast("long"), lambda a, s: a + s).alias("total")
    )
    n_docs, total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    found = spark.createDataFrame([], HITS)
    if n_docs:
        for block in query_blocks(items):
            found = found.unionByName(_answer(index, block, n_docs, total, k))
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
