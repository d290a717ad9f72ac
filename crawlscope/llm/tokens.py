"""Token ids of texts in ORC files, and reading them back.

Rows go to files by ranges of the document id and lie there in ascending order, so stripe statistics
prune by id, and Bloom filters on ``doc_id`` spare stripes that a range cannot. Ids are integer lists,
which ORC stores run-length encoded; row indexes are written every ``stride`` rows. Any reader may take
one stripe at a time.

Defined cases: a null text is an empty one; each document ends with id 0, so an empty text has one id;
null ids come first; rows with equal ids lie next to each other and count as separate documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlscope.llm import kernels as K
from crawlscope.llm.common import new_folder, parts

END = 0
_PRINTABLE = K.byte_set((0x21, 0x7E))
_LETTER = K.byte_set((0x41, 0x5A), (0x61, 0x7A))
_MARK = K.byte_set((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
SCHEMA = "part int, doc_id long, start_in_part long, n_tokens long, ids array<int>"


class Ragged:
    """Growing list of rows of numbers in one flat array."""

    def __init__(self, kind: type):
        self.flat, self.held = np.empty(1 << 18, kind), 0
        self.begins, self.sizes, self.used = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int32), 0

    def clear(self) -> None:
        self.held = self.used = 0

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        held, used = self.held + len(flat), self.used + len(sizes)
        # By a half: the old and the new array are there at once.
        if len(self.flat) < held:
            self.flat = np.concatenate([self.flat, np.empty(max(held, 3 * len(self.flat) // 2) - len(self.flat), self.flat.dtype)])
        if len(self.sizes) < used:
            more = max(used, 3 * len(self.sizes) // 2) - len(self.sizes)
            self.begins, self.sizes = (np.concatenate([x, np.empty(more, x.dtype)]) for x in (self.begins, self.sizes))
        self.flat[self.held : held] = flat
        self.sizes[self.used : used] = sizes
        self.begins[self.used : used] = self.held + np.cumsum(sizes) - sizes
        self.held, self.used = held, used

    def rows(self, which: np.ndarray) -> np.ndarray:
        """The numbers of these rows, one row after the other."""
        return self.flat[K.ragged(self.begins[which], self.sizes[which])]


class Encoder:
    """Ids of many texts. Byte-level BPE splits a text before a single blank between two visible
    characters and between a letter and a punctuation mark, so the texts are cut there and each different
    piece is encoded once; pieces seen before come from a table of about ``keep`` pieces."""

    def __init__(self, path: str, keep: int = 900_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Hashes of the known pieces in order, with the number of each; by number, the bytes and the ids of a piece.
        self.keys, self.numbers = np.empty(0, K.U64), np.empty(0, np.int32)
        self.text, self.ids = Ragged(np.uint8), Ragged(np.int32)
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.opens[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("\u0120")]] = True
        self.marks = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.keep = keep

    def _encoded(self, pieces: list[bytes], worded: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(which pieces, their ids, ids of each). ``worded`` marks a blank with visible characters: many such pieces
        can be encoded as one text and told apart again."""
        joined, single = np.flatnonzero(worded), [np.flatnonzero(~worded)]
        for low in range(0, len(joined), 4_000):
            some = joined[low : low + 4_000]
            text = b"".join([pieces[i] for i in some.tolist()]).decode()
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
            cut = np.flatnonzero(self.opens[ids])
            if len(cut) == len(some):  # one token that opens with a blank for each piece
                yield some, ids, np.diff(np.append(cut, len(ids)))
            else:
                single.append(some)
        single = np.concatenate(single)
        for low in range(0, len(single), 4_000):  # encodings are large while they live
            some = single[low : low + 4_000]
            found = [e.ids for e in self.tokenizer.encode_batch_fast([pieces[i].decode() for i in some.tolist()], add_special_tokens=False)]
            yield some, np.array(list(chain.from_iterable(found)), np.int32), np.array([len(f) for f in found], np.int64)

    def _find(self, hashed: np.ndarray, data: np.ndarray, a: np.ndarray, b: np.ndarray, worded: np.ndarray) -> np.ndarray | None:
        """Numbers of different pieces, by ascending hashes, in the table, which takes in the new ones. None if a
        known piece with an equal hash has other bytes."""
        if len(self.keys) > self.keep:
            self.keys, self.numbers = self.keys[:0], self.numbers[:0]
            self.text.clear()
            self.ids.clear()
        at = np.searchsorted(self.keys, hashed)
        known = np.append(self.keys, K.U64(0))[at] == hashed
        known &= at < len(self.keys)
        number = np.empty(len(hashed), np.int64)
        number[known] = self.numbers[at[known]]
        sizes = b - a
        old, new = number[known], np.flatnonzero(~known)
        if not np.array_equal(self.text.sizes[old], sizes[known]) or not np.array_equal(self.text.rows(old), data[K.ragged(a[known], sizes[known])]):
            return None
        pieces = [data[i:j].tobytes() for i, j in zip(a[new].tolist(), b[new].tolist(), strict=True)]
        for some, ids, counts in self._encoded(pieces, worded[new]):
            some = new[some]
            number[some] = np.arange(self.ids.used, self.ids.used + len(some))
            self.ids.add(ids, counts)
            self.text.add(data[K.ragged(a[some], sizes[some])], sizes[some])
        self.keys = np.insert(self.keys, at[new], hashed[new])
        self.numbers = np.insert(self.numbers, at[new], number[new].astype(np.int32))
        return number

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds per text), without the end id."""
        starts = piece_starts(data, bounds)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(bounds), np.int64)
        ends = np.append(starts[1:], len(data))
        hashed, first, kind = np.unique(K.hashes(data, starts, ends), return_index=True, return_inverse=True)
        # Pieces with equal hashes are compared byte by byte; a collision falls back to plain encoding,
        # and so does the string of an added token, which a cut could part.
        twin = K.ragged(starts[first][kind], ends - starts)
        whole = data.tobytes()
        plain = len(twin) != len(data) or not np.array_equal(data[twin], data) or any(m in whole for m in self.marks)
        number = None if plain else self._find(hashed, data, starts[first], ends[first], self._worded(data, starts[first], ends[first]))
        if number is None:
            found = [self.tokenizer.encode(whole[a:b].decode(), add_special_tokens=False).ids for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            return np.array(list(chain.from_iterable(found)), np.int32), np.concatenate([[0], np.cumsum([len(f) for f in found])])
        number = number[kind]
        ids = self.ids.rows(number)
        per_piece = np.concatenate([[0], np.cumsum(self.ids.sizes[number])])
        return ids, per_piece[np.searchsorted(starts, bounds)]

    @staticmethod
    def _worded(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each piece is a blank with visible characters."""
        hidden = ~_PRINTABLE[data] & (data != 0xC3)
        hidden[1:] &= data[:-1] != 0xC3
        hidden = np.concatenate([[0], np.cumsum(hidden, dtype=np.int32)])
        return (data[a] == 0x20) & (hidden[b] == hidden[a + 1]) & (b > a + 1)


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One per Python worker, which Spark keeps from task to task; its table stays bounded."""
    return Encoder(path)


def piece_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Starts of texts, single blanks between characters that are surely visible (printable ASCII or a
    character whose first byte is C3, accented Latin letters), and ASCII marks after an ASCII letter."""
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 2:
        before = _PRINTABLE[data[:-2]]
        before[1:] |= (data[:-3] == 0xC3) & (data[1:-2] >= 0x80)
        after = _PRINTABLE[data[2:]] | (data[2:] == 0xC3)
        cut[1:-2] = (data[1:-1] == 0x20) & before & after
    if len(data) > 1:
        cut[1:-1] |= _LETTER[data[:-1]] & _MARK[data[1:]]
    cut[bounds] = True
    cut[len(data)] = False
    return np.flatnonzero(cut)


def write_tokens(docs: DataFrame, tokenizer: str, path: str, files: int | None = None, stride: int = 1_000) -> str:
    """Write the token ids of ``docs`` (doc_id, text, ...) to ORC files under ``path``.

    The text is dealt out by ranges of the id before it is encoded, so the range bounds are found on
    raw rows and each text is encoded once.
    """

    def run(batches):
        encoder, part, start = encoder_of(tokenizer), TaskContext.get().partitionId(), 0
        for rows, data, bounds in K.pieces(batches):
            ids, cut = encoder.encode(data, bounds)
            ids = np.insert(ids, cut[1:], END).astype(np.int32)
            cut = cut + np.arange(len(cut))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(rows.num_rows, part, np.int32)),
                    rows.column(0),
                    pa.array(start + cut[:-1]),
                    pa.array(np.diff(cut)),
                    K.lists(ids, cut, pa.int32()),
                ],
                ["part", "doc_id", "start_in_part", "n_tokens", "ids"],
            )
            start += int(cut[-1])

    order = [F.col("doc_id"), F.xxhash64("text")]
    dealt = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(files or parts(docs.sparkSession), *order)
    (
        dealt.sortWithinPartitions(*order)
        .mapInArrow(run, SCHEMA)
        .write.option("orc.compress", "snappy")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(stride))
        .orc(path)
    )
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows; a filter on ``doc_id`` reaches stripe statistics and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per stored document: the global position of its first id, and
    the checksum of its ids as little-endian unsigned 32-bit integers.

    Positions inside a file are stored; the files' totals, one row per file, are summed up in order.
    """

    def run(batches):
        for batch in batches:
            lists = batch.column(4)
            cut = np.asarray(lists.offsets)
            raw = memoryview(np.ascontiguousarray(np.asarray(lists.values), "<i4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(4)), pa.array(crc, pa.int64())], ["part", "doc_id", "start_in_part", "n_tokens", "ids_crc32"]
            )

    rows = read_tokens(spark, path)
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    checked = rows.mapInArrow(run, "part int, doc_id long, start_in_part long, n_tokens long, ids_crc32 long")
    # One row of 12 bytes for each file that the writer was told to make.
    return checked.join(F.broadcast(files), "part").select(
        "doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_output(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write ``docs`` and return the index read from the files."""
    path = path or new_folder(docs.sparkSession, "tokens")
    return token_index(docs.sparkSession, write_tokens(docs, tokenizer, path))
