"""Language identification with a blended-spectrum string kernel.

A text is the set of its byte n-grams, n = 1 to 3, over its letters in lower case; the kernel of two texts
is the number of shared n-grams over the root of the product of their numbers. A few training texts are
landmarks: the kernel with them, whitened by their own kernel (Nystroem), is a short feature vector, on
which one ridge regression per language votes against the rest. n-grams are hashed to ``BITS`` bits, so a
batch of texts is scored by matrix products.

Fitting reads at most ``most`` documents per language. Scoring is one pass over whole texts without a
shuffle. Defined cases: null texts and texts without a letter are ``und`` with score 0; without any
training document all texts are; ties go to the first language by name; rows with equal ids are
predicted one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlscope.llm import kernels as K
from crawlscope.llm.common import held_out

BITS, SPECTRUM, BLOCK = 14, 3, 256
UNKNOWN = "und"
_LETTER = np.full(256, 0x20, np.uint8)
_LETTER[0x80:] = np.arange(0x80, 0x100)
_LETTER[0x61:0x7B] = _LETTER[0x41:0x5B] = np.arange(0x61, 0x7B)


def presence(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row per text: 1 where a hashed n-gram occurs. For a block of texts at a time."""
    out = np.zeros((len(bounds) - 1, 1 << BITS), np.float32)
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    left = bounds[1:][owner] - np.arange(len(data))
    letters = _LETTER[data]
    code = np.zeros(len(data), np.uint64)
    for n in range(1, SPECTRUM + 1):
        ok = left >= n
        with np.errstate(over="ignore"):
            code[: len(data) - n + 1] = code[: len(data) - n + 1] * K.U64(257) + letters[n - 1 :] + K.U64(1)
            slot = (code * K.ODD[30]) >> K.U64(64 - BITS)
        out[owner[ok], slot[ok].astype(np.int64)] = 1
    return out


def blocks(data: np.ndarray, bounds: np.ndarray):
    for low in range(0, len(bounds) - 1, BLOCK):
        part = bounds[low : low + BLOCK + 1]
        yield data[part[0] : part[-1]], part - part[0]


@dataclass
class Model:
    names: list[str]
    landmarks: np.ndarray  # n-grams by landmark, each column scaled by the root of its number of n-grams
    weights: np.ndarray  # landmark by language, whitening included
    bias: np.ndarray

    def votes(self, found: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.maximum(found.sum(1, keepdims=True), 1))
        return (found @ self.landmarks / size) @ self.weights + self.bias


def fit_kernel(found: np.ndarray, names: np.ndarray, landmarks: int = 96, ridge: float = 1e-3) -> Model:
    """Kernel ridge regression on the span of ``landmarks`` training texts, taken from all languages in turn."""
    kinds = sorted(set(names.tolist()))
    turns = [np.flatnonzero(names == k) for k in kinds]
    chosen = [t[i] for i in range(max((len(t) for t in turns), default=0)) for t in turns if i < len(t)][:landmarks]
    marks = (found[chosen] / np.sqrt(np.maximum(found[chosen].sum(1, keepdims=True), 1))).T.astype(np.float32)
    values, vectors = np.linalg.eigh((marks.T @ marks).astype(np.float64))
    kept = values > 1e-6 * values.max(initial=1)
    whiten = vectors[:, kept] / np.sqrt(values[kept])
    phi = (found @ marks / np.sqrt(np.maximum(found.sum(1, keepdims=True), 1))) @ whiten
    y = np.where(names[:, None] == np.array(kinds)[None, :], 1.0, -1.0)
    center, mean = phi.mean(0), y.mean(0)
    solved = np.linalg.solve((phi - center).T @ (phi - center) + ridge * len(phi) * np.eye(phi.shape[1]), (phi - center).T @ (y - mean))
    return Model(kinds, marks, (whiten @ solved).astype(np.float32), (mean - center @ solved).astype(np.float32))


def fit(docs: DataFrame, most: int = 300, modulus: int = 5, remainder: int = 0, most_languages: int = 1_000) -> Model | None:
    """Fit to text and lang outside the held-out fold, on the first ``most`` documents by a hash of each language, the
    ``most_languages`` most frequent ones."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out("doc_id", modulus, remainder))
    rows = rows.select("lang", "text", F.xxhash64("doc_id", "text").alias("place"))
    # About three times as many pass a threshold on the hash, so that no task ranks a whole language.
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages)
    rates = counts.select("lang", F.least(F.lit(1.0), 3.0 * most / F.col("count")).alias("rate"))
    passed = rows.join(F.broadcast(rates), "lang").filter(F.pmod("place", F.lit(1 << 31)) <= F.col("rate") * float(1 << 31))
    first = Window.partitionBy("lang").orderBy("place")
    picked = passed.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= most)

    def pack(batches):
        for part, data, bounds in K.pieces(batches):
            bits = [np.packbits(row) for d, b in blocks(data, bounds) for row in presence(d, b).astype(bool)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([b.tobytes() for b in bits], pa.binary())], ["lang", "rank", "bits"])

    found = picked.select("lang", "rank", "text").mapInArrow(pack, "lang string, rank int, bits binary").collect()
    if not found:
        return None
    found = sorted(found, key=lambda r: (r["lang"], r["rank"]))
    bits = np.stack([np.unpackbits(np.frombuffer(r["bits"], np.uint8)) for r in found]).astype(np.float32)
    return fit_kernel(bits, np.array([r["lang"] for r in found], object))


def identify(docs: DataFrame, modulus: int = 5, remainder: int = 0, most: int = 300) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of ``docs``."""
    model = fit(docs, most, modulus, remainder)

    def run(batches):
        for rows, data, bounds in K.pieces(batches):
            for_all = [model.votes(presence(d, b)) for d, b in blocks(data, bounds)] if model else [np.zeros((rows.num_rows, 1))]
            votes = np.concatenate(for_all)
            best = votes.argmax(1)
            names = [model.names[i] for i in best] if model else [UNKNOWN] * rows.num_rows
            score = np.clip((votes.max(1) + 1) / 2, 0, 1) if model else np.zeros(rows.num_rows)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(2), pa.array(names, pa.string()), pa.array(score.astype(np.float64))],
                ["doc_id", "lettered", "lang", "score"],
            )

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), lettered.alias("lettered"))
    found = rows.mapInArrow(run, "doc_id long, lettered boolean, lang string, score double")
    return found.select(
        "doc_id", held_out("doc_id", modulus, remainder).alias("held_out"),
        F.when(F.col("lettered"), F.col("lang")).otherwise(F.lit(UNKNOWN)).alias("lang_pred"),
        F.when(F.col("lettered"), F.col("score")).otherwise(F.lit(0.0)).alias("score"),
    )
