"""Phrases of two and three words that stand together more often than their parts would, counted in
counting quotient filters.

1. Tasks split their texts into chunks, number the words of a chunk and store the chunk as word numbers, next
   to its word lists with counts, one for each language.
2. The lists are cut by hashes of words into buckets of about ``BUCKET`` bytes, where counts are added up. Only
   words that are frequent enough can be in a phrase that is, so these alone get ids, which go back to
   the chunks. Lists move as packed arrays, not as a row per word.
3. Every run of two or three such words is packed into an integer of three ids and sent through a Feistel
   network, a permutation of integers of that width. Its high bits (quotient) are then spread evenly
   whatever the phrases, its low bits (remainder) are kept in full, so a filter loses nothing: from the place
   of an entry and its remainder follows the phrase. A task's filter is cut by the leading bits of the
   quotient, and filters of equal leading bits from all shards are merged in order, which adds up counters.
4. Scores, cuts and containment are joins among the counted phrases.

A filter is stored as a bit per quotient (occupied), a bit per entry that ends a run, the packed
remainders, and counters only for entries met more than once. A merge takes about ``MERGE`` entries; where the
corpus has more than ``MERGE`` times 2^``STEP``, filters are merged and cut again in rounds, by ``STEP`` bits each.

Defined cases: null texts are empty, a null language is ``und``; texts without words give nothing; equal rows
count as often as they are there; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlscope.llm import kernels as K
from crawlscope.llm.common import parts, stored

BREAK = K.byte_set((0x2E, 0x2E), (0x2C, 0x2C), (0x3B, 0x3B), (0x3A, 0x3A), (0x21, 0x21), (0x3F, 0x3F), (0x0A, 0x0D))
BLANK = K.byte_set((0x20, 0x20), (0x09, 0x09))
NEWLINE = K.byte_set((0x0A, 0x0A))  # in no word
CHUNK, BUCKET, MERGE, STEP, HELD = 1 << 20, 4 << 20, 1 << 19, 10, 1 << 19
MOST_IDS, SPAN = 1 << 32, 1 << 18
CHUNKS = "chunk long, lang string, base int, words string, counts binary, tokens binary"
LISTS = "bucket long, chunk long, lang string, words string, numbers binary, counts binary"
KNOWN = "chunk long, numbers binary, ids binary, lang string, word string, f long, id long"
FILTERS = "bucket long, shard long, n long, filter binary"
_ROUNDS = [K.U64(0x9E3779B97F4A7C15 * (2 * i + 1) & (1 << 64) - 1) for i in range(4)]


# --- words ---------------------------------------------------------------------------------
def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of ascending byte ranges, some at a time, so that little memory is held."""
    cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(data) + SPAN, SPAN)), len(starts)))
    out = np.empty(len(starts), K.U64)
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        a = starts[i]
        out[i:j] = K.hashes(data[a : ends[j - 1]], starts[i:j] - a, ends[i:j] - a)
    return out


def numbered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each word, which is a byte range and a language, and where each number is first met. Words with
    equal hashes are compared byte by byte."""
    lang = lang.astype(K.U64)
    with np.errstate(over="ignore"):
        hashed = K.mix(word_hashes(data, starts, ends) + lang * K.ODD[0])
    _, first, number = np.unique(hashed, return_index=True, return_inverse=True)
    sizes = ends - starts
    same = np.array_equal(sizes, sizes[first][number]) and np.array_equal(lang, lang[first][number])
    if same and np.array_equal(data[K.ragged(starts, sizes)], data[K.ragged(starts[first][number], sizes)]):
        return number, first
    known, whole = {}, data.tobytes()
    keys = zip(lang.tolist(), (whole[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), strict=True)
    number = np.array([known.setdefault(k, len(known)) for k in keys])
    return number, np.unique(number, return_index=True)[1]


def packed(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Binary or string array of the bytes between the bounds."""
    return pa.Array.from_buffers(kind, len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The byte ranges one after the other, as one string from each cut to the next."""
    bounds = np.concatenate([[0], np.cumsum(sizes)])[cuts]
    return packed(data[K.ragged(starts, sizes)], bounds, pa.string())


def _chunk(chunk: int, langs: list[str], texts: list[tuple[np.ndarray, np.ndarray]]):
    """A row of word numbers, 0 between pieces, and a row with the list of words of each language."""
    data = np.concatenate([d for d, _ in texts])
    bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(b) for _, b in texts]))])
    data = data + (((data >= 0x41) & (data <= 0x5A)) * np.uint8(0x20))
    starts, ends, cut = K.words(data, bounds, BREAK | BLANK)
    if not len(starts):
        return
    names, lang_of = np.unique(np.array(langs, object), return_inverse=True)
    lang = np.repeat(lang_of, np.diff(cut))
    number, first = numbered(data, starts, ends, lang)
    order = np.argsort(lang[first], kind="stable")  # words of a language get consecutive numbers
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    number, first = place[number], first[order]
    broken = np.concatenate([[0], np.cumsum(BREAK[data], dtype=np.int64)])
    apart = broken[starts[1:]] != broken[ends[:-1]]
    inner = cut[1:-1]
    apart[inner[(inner > 0) & (inner < len(starts))] - 1] = True
    tokens = np.insert(number + 1, np.flatnonzero(apart) + 1, 0).astype("<u4")
    counts = np.bincount(number, minlength=len(first)).astype("<u4")
    cuts = np.concatenate([[0], np.cumsum(np.bincount(lang[first], minlength=len(names)))])
    lists = gathered(np.append(data, np.uint8(0x0A)), *_lines(starts[first], ends[first], len(data)), 2 * cuts)
    n = len(names)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n + 1, chunk)), pa.array([None, *names], pa.string()), pa.array([None, *cuts[:-1].tolist()], pa.int32()),
            pa.concat_arrays([pa.nulls(1, pa.string()), lists]), pa.concat_arrays([pa.nulls(1, pa.binary()), packed(counts, 4 * cuts, pa.binary())]),
            pa.array([tokens.tobytes()] + [None] * n, pa.binary()),
        ],
        ["chunk", "lang", "base", "words", "counts", "tokens"],
    )


def _lines(starts: np.ndarray, ends: np.ndarray, newline: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of words, each with a range of the line break at ``newline`` behind it."""
    both, sizes = np.full(2 * len(starts), newline), np.ones(2 * len(starts), np.int64)
    both[::2], sizes[::2] = starts, ends - starts
    return both, sizes


def chunks(docs: DataFrame) -> DataFrame:
    def run(batches):
        chunk, langs, texts, held = TaskContext.get().partitionId() << 32, [], [], 0
        for rows, data, bounds in K.pieces(batches):
            if texts and held + len(data) > CHUNK:
                yield from _chunk(chunk, langs, texts)
                chunk, langs, texts, held = chunk + 1, [], [], 0
            langs += rows.column(1).to_pylist()
            texts.append((data.copy(), bounds))
            held += len(data)
        if texts:
            yield from _chunk(chunk, langs, texts)

    rows = docs.select(F.col("text").cast("string"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    return stored(rows.mapInArrow(run, CHUNKS), "chunks")


def cut_lists(rows: pa.RecordBatch, buckets: int) -> pa.RecordBatch:
    """A chunk's list of one language by buckets of the words' hashes."""
    chunk, lang, base, counts = (rows.column(i)[0].as_py() for i in (0, 1, 2, 4))
    data, bounds = K.utf8(rows.column(3))
    starts, ends, _ = K.words(data, bounds, NEWLINE)
    bucket = (word_hashes(data, starts, ends) % K.U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    here, begins = np.unique(bucket[order], return_index=True)
    cuts, n = np.append(begins, len(order)), len(here)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(here), pa.array([chunk] * n, pa.int64()), pa.array([lang] * n, pa.string()),
            gathered(data, starts[order], (ends - starts + 1)[order], cuts), packed((base + 1 + order).astype("<u4"), 4 * cuts, pa.binary()),
            packed(np.frombuffer(counts, "<u4")[order], 4 * cuts, pa.binary()),
        ],
        ["bucket", "chunk", "lang", "words", "numbers", "counts"],
    )


def add_up(rows: pa.Table, buckets: int, least: int) -> pa.Table:
    """Words of one bucket: the ids of frequent ones for each chunk, their counts, and the sum of all by language."""
    rows = rows.combine_chunks()
    data, bounds = K.utf8(rows["words"].chunk(0))
    starts, ends, cut = K.words(data, bounds, NEWLINE)
    names, lang_of = np.unique(np.array(rows["lang"].to_pylist(), object), return_inverse=True)
    lang = np.repeat(lang_of, np.diff(cut))
    number, first = numbered(data, starts, ends, lang)
    numbers, counts = (np.frombuffer(b"".join(rows[c].to_pylist()), "<u4") for c in ("numbers", "counts"))
    order = np.argsort(number, kind="stable")
    f = np.add.reduceat(counts[order].astype(np.int64), np.flatnonzero(np.diff(number[order], prepend=-1)))
    often = f >= least
    ids = (np.cumsum(often) - 1) * buckets + rows["bucket"][0].as_py() + 1
    mine = often[number]
    cuts = 4 * np.concatenate([[0], np.cumsum(mine)])[cut]
    whole, kept = data.tobytes(), first[often]
    sums = np.zeros(len(names), np.int64)
    np.add.at(sums, lang[first], f)
    words = [whole[a:b].decode() for a, b in zip(starts[kept].tolist(), ends[kept].tolist(), strict=True)]
    parts_ = [
        {"chunk": rows["chunk"], "numbers": packed(numbers[mine], cuts, pa.binary()), "ids": packed(ids[number][mine].astype("<u4"), cuts, pa.binary())},
        {"lang": names[lang[kept]].tolist(), "word": words, "f": f[often], "id": ids[often]},
        {"lang": names.tolist(), "f": sums},
    ]
    kinds = {"chunk": pa.int64(), "numbers": pa.binary(), "ids": pa.binary(), "lang": pa.string(), "word": pa.string(), "f": pa.int64(), "id": pa.int64()}
    made = []
    for part in parts_:
        n = len(next(iter(part.values())))
        columns = [part.get(c) if c in part else pa.nulls(n, kind) for c, kind in kinds.items()]
        made.append(pa.table({c: x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, kinds[c]) for c, x in zip(kinds, columns, strict=True)}))
    return pa.concat_tables(made)


def known_words(lists: DataFrame, least: int) -> DataFrame:
    """Rows of chunks (chunk, numbers, ids), of words met ``least`` times (lang, word, f, id) and of languages (lang, f). Ids
    are above 0, and differ by the number of buckets inside a bucket."""
    lists = lists.filter(F.col("words").isNotNull())
    size = lists.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    buckets = 1 + size // BUCKET

    def cut(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield cut_lists(batch.slice(i, 1), buckets)

    def finish(rows: pa.Table) -> pa.Table:
        return add_up(rows, buckets, least)

    return stored(lists.mapInArrow(cut, LISTS).groupBy("bucket").applyInArrow(finish, KNOWN), "words")


# --- the filter ----------------------------------------------------------------------------
class Packing:
    """Integers of three word ids in two halves of equal width, and their permutation."""

    def __init__(self, n_ids: int):
        if n_ids >= MOST_IDS:
            raise ValueError(f"{n_ids} frequent words do not fit into 32-bit ids")
        self.id_bits = max(1, int(n_ids).bit_length())
        self.half = -(-3 * self.id_bits // 2)
        self.mask = K.U64((1 << self.half) - 1)

    def pack(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bits, more = K.U64(self.id_bits), K.U64(self.half - self.id_bits)
        a, b, c = (x.astype(K.U64) for x in (a, b, c))
        high = (a << K.U64(2 * self.id_bits - self.half)) | (b >> more)
        return high, ((b & ((K.U64(1) << more) - K.U64(1))) << bits) | c

    def unpack(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bits, more, up = K.U64(self.id_bits), K.U64(self.half - self.id_bits), K.U64(2 * self.id_bits - self.half)
        c = low & ((K.U64(1) << bits) - K.U64(1))
        b = ((high & ((K.U64(1) << up) - K.U64(1))) << more) | (low >> bits)
        return high >> up, b, c

    def permute(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for key in _ROUNDS:
            high, low = low, high ^ (K.mix(low ^ key) & self.mask)
        return high, low

    def restore(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for key in reversed(_ROUNDS):
            high, low = low ^ (K.mix(high ^ key) & self.mask), high
        return high, low

    def count(self, high: np.ndarray, low: np.ndarray, counts: np.ndarray | None = None):
        """Sorted different keys with the sums of their counts; sorted runs are merged."""
        if 2 * self.half <= 64:
            key = (high << K.U64(self.half)) | low
            if counts is None:
                key.sort()
            else:
                order = np.argsort(key, kind="stable")
                key, counts = key[order], counts[order]
            new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
            high, low = key >> K.U64(self.half), key & self.mask
        else:
            order = np.lexsort((low, high))
            high, low = high[order], low[order]
            counts = None if counts is None else counts[order]
            new = np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])]) if len(high) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        sums = np.diff(np.append(at, len(high))) if counts is None else np.add.reduceat(counts, at) if len(at) else counts
        return high[at], low[at], sums

    def _remainder_bytes(self, lead: int, quotient: int) -> int:
        return -(-(2 * self.half - lead - quotient) // 8)

    def store(self, high: np.ndarray, low: np.ndarray, counts: np.ndarray, lead: int) -> bytes:
        """Filter of sorted different keys that share their first ``lead`` bits."""
        n = len(high)
        q = min(max(0, n.bit_length() - 1), self.half - lead, 32)
        rest = self.half - lead - q  # bits of the high half that go to the remainder
        quotient = ((high >> K.U64(rest)) & K.U64((1 << q) - 1)).astype(np.int64)
        occupied = np.zeros(1 << q, bool)
        occupied[quotient] = True
        ends = np.append(quotient[1:] != quotient[:-1], True)
        # The remainder's bytes: those of the low half, then what is left of the high half.
        width = self._remainder_bytes(lead, q)
        lows = low | ((high & K.U64((1 << rest) - 1)) << K.U64(self.half) if rest and self.half < 64 else K.U64(0))
        raw = np.zeros((n, 16), np.uint8)
        raw[:, :8] = lows.astype("<u8").view(np.uint8).reshape(n, 8)
        raw[:, 8:] = ((high & K.U64((1 << rest) - 1)) >> K.U64(64 - self.half)).astype("<u8").view(np.uint8).reshape(n, 8)
        many = counts > 1
        more = counts[many]
        big = more >= 255
        return b"".join(
            [
                np.array([n, q], "<u4").tobytes(), np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(), np.packbits(many).tobytes(),
                np.ascontiguousarray(raw[:, :width]).tobytes(), np.where(big, 255, more).astype(np.uint8).tobytes(), more[big].astype("<i8").tobytes(),
            ]
        )

    def load(self, raw: bytes, lead: int, bucket: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, q = np.frombuffer(raw, "<u4", 2).tolist()
        rest, width, at = self.half - lead - q, self._remainder_bytes(lead, q), 8

        def take(kind, count):
            nonlocal at
            got = np.frombuffer(raw, kind, count, at)
            at += got.nbytes
            return got

        occupied = np.flatnonzero(np.unpackbits(take(np.uint8, -(-(1 << q) // 8)))[: 1 << q])
        ends = np.unpackbits(take(np.uint8, -(-n // 8)))[:n]
        many = np.unpackbits(take(np.uint8, -(-n // 8)))[:n].astype(bool)
        packed = np.zeros((n, 16), np.uint8)
        packed[:, :width] = take(np.uint8, n * width).reshape(n, width)
        both = packed.view("<u8")
        low = both[:, 0] & self.mask
        left = ((both[:, 0] >> K.U64(self.half)) | (both[:, 1] << K.U64(64 - self.half))) & K.U64((1 << rest) - 1)
        run = np.cumsum(ends) - ends  # the run that an entry belongs to
        quotient = occupied[run].astype(K.U64)
        high = (((K.U64(bucket) << K.U64(q)) | quotient) << K.U64(rest)) | left
        counts = np.ones(n, np.int64)
        small = take(np.uint8, int(many.sum())).astype(np.int64)
        small[small == 255] = take("<i8", int((small == 255).sum()))
        counts[many] = small
        return high, low, counts

    def cut(self, high: np.ndarray, low: np.ndarray, counts: np.ndarray, lead: int, shard: int) -> pa.Table:
        """Filters of sorted different keys, one for each beginning of ``lead`` bits."""
        bucket = (high >> K.U64(self.half - lead)).astype(np.int64)
        begins = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
        ends = np.append(begins[1:], len(bucket))
        made = [self.store(high[a:b], low[a:b], counts[a:b], lead) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
        return pa.table(
            {"bucket": pa.array(bucket[begins]), "shard": pa.array(np.full(len(begins), shard)), "n": pa.array(ends - begins), "filter": pa.array(made, pa.binary())}
        )

    def merged(self, rows: pa.Table, lead: int):
        """All entries of filters that share a bucket, counters added up."""
        found = [self.load(f, lead, b) for b, f in zip(rows["bucket"].to_pylist(), rows["filter"].to_pylist(), strict=True)]
        return self.count(*(np.concatenate(c) for c in zip(*found, strict=True)))

    def cutter(self, lead: int, to: int):
        """Merges filters of a bucket and cuts the result by more bits."""

        def cut(rows: pa.Table) -> pa.Table:
            return self.cut(*self.merged(rows, lead), to, rows["shard"][0].as_py())

        return cut


def runs(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all runs of two and three words; 0 is no word. The third of two is 0."""
    two = np.flatnonzero((tokens[:-1] > 0) & (tokens[1:] > 0))
    three = two[:-1][np.diff(two) == 1] if len(two) else two
    none = np.zeros(len(two), tokens.dtype)
    return (
        np.concatenate([tokens[two], tokens[three]]), np.concatenate([tokens[two + 1], tokens[three + 1]]), np.concatenate([none, tokens[three + 2]])
    )


# --- Spark steps ---------------------------------------------------------------------------
def shard_filters(lists: DataFrame, known: DataFrame, packing: Packing, lead: int) -> DataFrame:
    """Filters of the shards, each a task's chunks up to about ``HELD`` entries."""

    def run(batches):
        shard, held, size = TaskContext.get().partitionId() << 32, [], 0

        def flush():
            columns = (np.concatenate(c) for c in zip(*held, strict=True))
            yield from packing.cut(*packing.count(*columns), lead, shard).to_batches(max_chunksize=64)

        def add(tokens, number, word):
            nonlocal size
            table = np.zeros(int(tokens.max(initial=0)) + 1, np.uint32)
            if number:
                table[np.concatenate(number)] = np.concatenate(word)
            keys = packing.permute(*packing.pack(*runs(table[tokens])))
            for low in range(0, len(keys[0]), HELD):
                high, rest = keys[0][low : low + HELD], keys[1][low : low + HELD]
                held.append(packing.count(high, rest))
                size += len(held[-1][0])
                if size >= HELD:
                    yield

        def fill(*chunk):
            nonlocal shard, size
            for _ in add(*chunk):
                yield from flush()
                shard, size = shard + 1, 0
                held.clear()

        tokens, number, word = None, [], []
        for batch in batches:
            for numbers, ids, text in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if text is not None:  # a chunk's tokens come first
                    if tokens is not None:
                        yield from fill(tokens, number, word)
                    tokens, number, word = np.frombuffer(text, "<u4"), [], []
                else:
                    number.append(np.frombuffer(numbers, "<u4"))
                    word.append(np.frombuffer(ids, "<u4"))
        if tokens is not None:
            yield from fill(tokens, number, word)
        if size:
            yield from flush()

    none = F.lit(None).cast("binary")
    texts = lists.filter(F.col("tokens").isNotNull()).select("chunk", none.alias("numbers"), none.alias("ids"), "tokens")
    back = known.filter(F.col("chunk").isNotNull()).select("chunk", "numbers", "ids", none.alias("tokens"))
    dealt = texts.unionByName(back).repartition(parts(lists.sparkSession), "chunk").sortWithinPartitions("chunk", F.col("tokens").isNull())
    return dealt.mapInArrow(run, FILTERS)


def merge_filters(filters: DataFrame, packing: Packing, lead: int, most: int, least: int) -> DataFrame:
    """(x, y, z, f): the runs met at least ``least`` times in all filters, which have at most ``most`` entries."""

    def finish(rows: pa.Table) -> pa.Table:
        high, low, counts = packing.merged(rows, lead)
        often = counts >= least
        ids = packing.unpack(*packing.restore(high[often], low[often]))
        return pa.table({**{k: pa.array(v.astype(np.int64)) for k, v in zip("xyz", ids, strict=True)}, "f": pa.array(counts[often])})

    while (more := min(STEP, last_lead(packing, most) - lead)) > 0:
        groups = max(1, -(-(most >> lead) // MERGE))

        grouped = filters.groupBy("bucket", F.pmod(F.xxhash64("shard"), F.lit(groups)).alias("_group"))
        filters = grouped.applyInArrow(packing.cutter(lead, lead + more), FILTERS)
        filters, lead = stored(filters, "filters"), lead + more
    return filters.groupBy("bucket").applyInArrow(finish, "x long, y long, z long, f long")


def last_lead(packing: Packing, most: int) -> int:
    return min(packing.half, max(0, math.ceil(math.log2(max(1, most / MERGE)))))


def phrases(docs: DataFrame, least: int = 10, cover: int = 50, k: int = 2_000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of documents (text, lang, ...): the k phrases of a language with the
    highest score a*a/(l*r) in millionths, of those that occur at least ``least`` times and are not
    inside a longer one with at least ``cover`` percent of their occurrences."""
    lists = chunks(docs)
    known = known_words(lists, least)
    ids = known.filter(F.col("id").isNotNull()).select("lang", "word", "f", "id")
    highest, n_words = ids.agg(F.coalesce(F.max("id"), F.lit(0)), F.coalesce(F.sum("f"), F.lit(0))).first()
    packing, most = Packing(highest), 2 * n_words
    lead = min(STEP, last_lead(packing, most))
    filters = shard_filters(lists, known, packing, lead)
    found = stored(merge_filters(filters, packing, lead, most, least), "runs")
    ranked = rank_phrases(score(found, ids, cover), ids, k)
    totals = known.filter(F.col("id").isNull() & F.col("lang").isNotNull()).groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def score(found: DataFrame, ids: DataFrame, cover: int) -> DataFrame:
    """(x, y, z, a, l, r, score) of the counted runs that no longer one covers."""
    pairs = found.filter("z = 0")
    # Counts of what a cut leaves on either side: a word or two words.
    sides = ids.select(F.col("id").alias("x"), F.lit(0).cast("long").alias("y"), "f").unionByName(pairs.select("x", "y", "f"))
    cut = lambda k, lx, ly, rx, ry: F.struct(F.lit(k).alias("k"), *[c.alias(n) for n, c in zip(("lx", "ly", "rx", "ry"), (lx, ly, rx, ry), strict=True)])
    x, y, z, none = F.col("x"), F.col("y"), F.col("z"), F.lit(0).cast("long")
    cuts = F.when(z == 0, F.array(cut(1, x, none, y, none))).otherwise(F.array(cut(1, x, none, y, z), cut(2, x, y, z, none)))
    triples = found.filter("z > 0")
    within = triples.select("x", "y", "f").unionByName(triples.select(y.alias("x"), z.alias("y"), "f")).groupBy("x", "y").agg(F.max("f").alias("longer"))
    open_ = pairs.join(within, ["x", "y"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("f")))
    kept = open_.select("x", "y", "z", "f").unionByName(triples)
    rows = kept.select("x", "y", "z", F.col("f").alias("a"), F.explode(cuts).alias("c")).select("x", "y", "z", "a", "c.*")
    rows = rows.join(sides.toDF("lx", "ly", "l"), ["lx", "ly"]).join(sides.toDF("rx", "ry", "r"), ["rx", "ry"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731  products pass 64 bits
    rows = rows.withColumn("top", wide("a") * wide("a") * F.lit(1_000_000)).withColumn("below", wide("l") * wide("r"))
    rows = rows.withColumn("score", F.expr("top div below"))
    best = F.min(F.struct("score", "k", "l", "r")).alias("best")
    return rows.groupBy("x", "y", "z", "a").agg(best).select("x", "y", "z", "a", "best.l", "best.r", "best.score")


def rank_phrases(scored: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    word = lambda c, *more: ids.select(F.col("id").alias(c), F.col("word").alias(f"{c}_word"), *more)
    near = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    # Ties at the end stay until the words are known.
    first = scored.join(word("x", "lang"), "x").withColumn("_near", F.rank().over(near)).filter(F.col("_near") <= k)
    spelled = first.join(word("y"), "y").join(word("z"), "z", "left").withColumn("phrase", F.concat_ws(" ", "x_word", "y_word", "z_word"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return spelled.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
