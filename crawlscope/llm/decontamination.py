"""Benchmark decontamination by template windows.

Texts become sequences of word tokens in which numbers, names and units are typed placeholders. Windows
of ``width`` tokens of the documents are hash-joined with those of the benchmark items. A document holds
an item if the windows that match about one alignment cover enough of the item, and if the values in
the placeholders were replaced consistently: equal values by equal values. So a question is found again
when its numbers or names were changed.

Defined cases: null and empty texts hold and match nothing; an item of fewer than ``width`` tokens is one
window of its own length; windows with fewer than two words that are not placeholders are left out unless
the item has no other; rows with equal id and text share their result; an empty benchmark finds nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlscope.llm import kernels as K
from crawlscope.llm.common import stored

# Words that count as units after a number, and number words.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons ounce ounces "
    "pound pounds lb lbs ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days "
    "week weeks month months year years percent dollar dollars cent cents euro euros degree degrees watt watts volt volts "
    "mph kmh hz khz mhz ghz kb mb gb tb"
).split()
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split()

NUMBER, NAME, UNIT = (K.mix(np.array([i], K.U64))[0] for i in (101, 102, 103))
_DIGIT = K.byte_set((0x30, 0x39))
_UPPER = K.byte_set((0x41, 0x5A))
_LOWER = K.byte_set((0x61, 0x7A), (0x80, 0xFF))
_STOP = K.byte_set((0x0A, 0x0D), (0x21, 0x21), (0x2E, 0x2E), (0x3A, 0x3A), (0x3F, 0x3F))
WIDTH, SHARE, CONSISTENT = 5, 0.5, 0.8
FILTER_BITS = 22


def _hash_words(listed: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(listed).encode(), np.uint8)
    starts, ends, _ = K.words(data, np.array([0, len(data)]))
    return np.sort(K.hashes(data, starts, ends, K.FOLDED))


_UNIT_HASHES, _NUMBER_HASHES = _hash_words(UNITS), _hash_words(NUMBER_WORDS)


def lower_latin(data: np.ndarray) -> np.ndarray:
    """Accented Latin-1 capitals (C3 80 to C3 9E, but not the sign of multiplication) in lower case."""
    capital = np.zeros(len(data), bool)
    capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    return np.where(capital, data + np.uint8(0x20), data)


def template(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with placeholders, the value in each placeholder (0: none), and token bounds.

    Letters are compared in lower case. A number starts with a digit or is a number word; a unit is a listed word after a number; a name
    starts with a capital followed by small letters, inside a sentence, or at its start if the text has it
    inside one.
    """
    starts, ends, cut = K.words(data, bounds, K.NOT_ALNUM)
    value = K.hashes(lower_latin(data), starts, ends, K.FOLDED)
    n = len(value)
    if not n:
        return value, value, cut
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(cut))
    first = data[starts]
    second = data[np.minimum(starts + 1, len(data) - 1)]
    number = _DIGIT[first] | np.isin(value, _NUMBER_HASHES)
    begins = np.zeros(n, bool)
    begins[cut[:-1][np.diff(cut) > 0]] = True
    unit = np.isin(value, _UNIT_HASHES) & ~begins & np.concatenate([[False], number[:-1]])
    accented = (first == 0xC3) & (second >= 0x80) & (second <= 0x9E)
    third = np.minimum(starts + 1 + accented, len(data) - 1)
    capital = (_UPPER[first] | accented) & _LOWER[data[third]] & (third < ends)  # not words all in capitals
    stops = np.concatenate([[0], np.cumsum(_STOP[data], dtype=np.int64)])
    begins |= np.concatenate([[True], stops[starts[1:]] > stops[ends[:-1]]])
    name = capital & ~begins & ~number & ~unit
    if name.any():
        with np.errstate(over="ignore"):
            place = value ^ (owner.astype(K.U64) * K.ODD[20])
        name |= capital & ~number & ~unit & np.isin(place, place[name])
    tokens = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, value)))
    return tokens, np.where(number | unit | name, value, K.U64(0)), cut


def windows(tokens: np.ndarray, values: np.ndarray, cut: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, token number in the text, usable) of each window of exactly ``width`` tokens."""
    n, counts = len(tokens), np.diff(cut)
    owner = np.repeat(np.arange(len(counts)), counts)
    left = cut[1:][owner] - np.arange(n)
    at = np.flatnonzero(left >= width)
    with np.errstate(over="ignore"):
        total = np.full(len(at), K.U64(width))
        plain = np.zeros(len(at), np.int64)
        for j in range(width):
            total += tokens[at + j] * K.ODD[j]
            plain += values[at + j] == 0
    return K.mix(total), owner[at], at, plain >= min(2, width)


def item_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id, window, item_pos, item_slots, n_windows, length) of the benchmark (item_id, text)."""

    def run(batches):
        for rows, data, bounds in K.pieces(batches):
            tokens, values, cut = template(data, bounds)
            sizes = np.diff(cut)
            for size in np.unique(np.minimum(sizes, width)):
                if not size:
                    continue
                fits = np.minimum(sizes, width) == size
                hashed, owner, at, usable = windows(tokens, values, cut, int(size))
                usable |= ~np.isin(owner, owner[usable])
                keep = usable & fits[owner]
                hashed, owner, at = hashed[keep], owner[keep], at[keep]
                count = np.bincount(owner, minlength=len(sizes))[owner]
                slots = values[at[:, None] + np.arange(size)].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0).take(pa.array(owner)), pa.array(hashed.view(np.int64)), pa.array(at - cut[owner]),
                        K.lists(slots.ravel(), np.arange(len(at) + 1) * size, pa.int64()), pa.array(count), pa.array(np.full(len(at), size)),
                    ],
                    ["item_id", "window", "item_pos", "item_slots", "n_windows", "length"],
                )

    schema = "item_id long, window long, item_pos long, item_slots array<long>, n_windows long, length long"
    return stored(benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema), "benchmark-windows")


def document_windows(docs: DataFrame, lengths: list[int], flags: np.ndarray | None) -> DataFrame:
    """(doc_id, text_hash, window, pos, slots) of the windows whose hash has its flag set, or of all."""
    shared = None if flags is None else docs.sparkSession.sparkContext.broadcast(np.packbits(flags))

    def run(batches):
        table = None if shared is None else np.unpackbits(shared.value).astype(bool)
        for rows, data, bounds in K.pieces(batches):
            tokens, values, cut = template(data, bounds)
            for size in lengths:
                hashed, owner, at, _ = windows(tokens, values, cut, size)
                if table is not None:
                    keep = table[(hashed >> K.U64(64 - FILTER_BITS)).astype(np.int64)]
                    hashed, owner, at = hashed[keep], owner[keep], at[keep]
                if not len(at):
                    continue
                slots = values[at[:, None] + np.arange(size)].view(np.int64)
                mine = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0).take(mine), rows.column(2).take(mine), pa.array(hashed.view(np.int64)), pa.array(at - cut[owner]),
                        K.lists(slots.ravel(), np.arange(len(at) + 1) * size, pa.int64()),
                    ],
                    ["doc_id", "text_hash", "window", "pos", "slots"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, window long, pos long, slots array<long>")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: float = SHARE, consistent: float = CONSISTENT, most_flags: int = 1 << 19
) -> DataFrame:
    """(doc_id, text_hash, item_id, covered, consistency, changed_slots, pos) for each item that a document holds.

    The flags that spare other windows before the join are 2 ** 22 bits; a benchmark of more than
    ``most_flags`` different windows, which would fill them, is joined without.
    """
    items = item_windows(benchmark, width)
    lengths = [r["length"] for r in items.select("length").distinct().orderBy("length").collect()]  # at most ``width`` values
    flags = None
    slots = items.select(F.shiftrightunsigned("window", 64 - FILTER_BITS).alias("slot")).distinct()
    if slots.limit(most_flags + 1).count() <= most_flags:
        flags = np.zeros(1 << FILTER_BITS, bool)
        flags[np.asarray(slots.toArrow().column("slot"), np.int64)] = True
    hits = document_windows(docs, lengths, flags)
    both = hits.join(items, "window")
    shift = F.col("pos") - F.col("item_pos")
    # Alignments that differ by a few tokens lie in one of two overlapping ranges of eight.
    place = F.floor(shift / 4)
    both = both.withColumn("place", F.explode(F.array(place - F.pmod(place, F.lit(2)), place - F.pmod(place + 1, F.lit(2)))))
    keys = ["doc_id", "text_hash", "item_id", "place"]
    # Once per item window: a document may repeat its text on the same alignment range.
    met = both.groupBy(*keys, "item_pos").agg(
        F.first("n_windows").alias("n_windows"), F.min(F.struct("pos", "slots", "item_slots")).alias("m")
    )
    cover = met.groupBy(*keys).agg(
        (F.count("*") / F.first("n_windows")).alias("covered"), F.min("m.pos").alias("pos")
    ).filter(F.col("covered") >= share)
    filled = met.select(*keys, F.explode(F.arrays_zip("m.item_slots", "m.slots")).alias("z")).select(
        *keys, F.col("z.item_slots").alias("was"), F.col("z.slots").alias("now")
    ).filter("was <> 0 OR now <> 0")
    votes = filled.groupBy(*keys, "was", "now").agg(F.count("*").alias("n"))
    per_value = votes.groupBy(*keys, "was").agg(F.max("n").alias("best"), F.sum("n").alias("n"), F.sum(F.when(F.expr("was <> now"), F.col("n")).otherwise(0)).alias("changed"))
    slot_sums = per_value.groupBy(*keys).agg((F.sum("best") / F.sum("n")).alias("consistency"), F.sum("changed").alias("changed"))
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    judged = cover.alias("c").join(slot_sums.alias("s"), same("c", "s"), "left").select(
        *[F.col(f"c.{k}") for k in keys], "covered", "pos",
        F.coalesce("consistency", F.lit(1.0)).alias("consistency"), (F.coalesce("changed", F.lit(0)) > 0).alias("changed_slots"),
    )
    judged = judged.filter(F.col("consistency") >= consistent)
    best = judged.groupBy("doc_id", "text_hash", "item_id").agg(
        F.max(F.struct("covered", "consistency", (-F.col("pos")).alias("back"), "changed_slots")).alias("b")
    )
    return best.select(
        "doc_id", "text_hash", "item_id", F.col("b.covered").alias("covered"), F.col("b.consistency").alias("consistency"),
        F.col("b.changed_slots").alias("changed_slots"), (-F.col("b.back")).alias("pos"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The documents that hold no benchmark item, with their columns."""
    found = stored(contaminated(docs, benchmark, **settings).select("doc_id", "text_hash").distinct(), "contaminated").alias("f")
    rows = docs.alias("d")
    hit = F.col("d.doc_id").cast("long").eqNullSafe(F.col("f.doc_id")) & (F.xxhash64("d.text") == F.col("f.text_hash"))
    return rows.join(found, hit, "left_anti")
