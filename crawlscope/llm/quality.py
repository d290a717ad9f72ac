"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. Its score comes from features of the line and of both neighbours; a weight for
staying good and one for staying bad tie the lines together. Forward and backward sums give each line's
marginal, and the document's quality is their mean weighted by line length. Labels are those of whole
documents: in training, every line of a document carries its label, and each document counts once.

Fitting reads at most ``most`` documents per label. Scoring is one pass over whole texts without a
shuffle. Defined cases: lines end at line feeds, so a null or empty text is one empty line and is scored
as such; without labels all scores are 0.5; with one label only they are the smoothed share of good
documents; rows with equal ids are scored one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlscope.llm import kernels as K
from crawlscope.llm.common import held_out, labelled_sample

_CLASSES = {
    "letter": K.byte_set((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)),
    "capital": K.byte_set((0x41, 0x5A)),
    "digit": K.byte_set((0x30, 0x39)),
    "blank": K.byte_set((0x20, 0x20), (0x09, 0x09)),
    "stop": K.byte_set((0x2C, 0x2C), (0x2E, 0x2E)),
    "mark": K.byte_set((0x21, 0x21), (0x3F, 0x3F)),
    "symbol": K.byte_set((0x22, 0x2B), (0x2F, 0x2F), (0x3A, 0x3E), (0x40, 0x40), (0x5B, 0x60), (0x7B, 0x7E)),
}


def lines(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each line, and line bounds per text; each text has at least one line."""
    feeds = np.flatnonzero(data == 0x0A)
    starts = np.sort(np.concatenate([bounds[:-1], feeds + 1]))
    ends = np.sort(np.concatenate([feeds, bounds[1:]]))
    per_text = np.diff(np.searchsorted(feeds, bounds)) + 1
    return starts, ends, np.concatenate([[0], np.cumsum(per_text)])


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line and its neighbours, line lengths, line bounds per text)."""
    starts, ends, cut = lines(data, bounds)
    length = (ends - starts).astype(np.float32)
    columns = [np.log1p(length), (length == 0).astype(np.float32)]
    counts = {}
    for name, table in _CLASSES.items():
        running = np.concatenate([[0], np.cumsum(table[data], dtype=np.int32)])
        counts[name] = (running[ends] - running[starts]).astype(np.float32)
        columns.append(counts[name] / np.maximum(length, 1))
    columns.append(counts["capital"] / np.maximum(counts["letter"], 1))
    columns.append(np.log1p(length / (counts["blank"] + 1)))  # mean word length
    closes = np.zeros(len(length), np.float32)
    full = ends > starts
    closes[full] = _CLASSES["stop"][data[ends[full] - 1]]
    columns.append(closes)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(cut))
    hashed = K.hashes(data, starts, ends)
    with np.errstate(over="ignore"):
        _, kind, times = np.unique(hashed ^ K.mix(owner.astype(K.U64)), return_inverse=True, return_counts=True)
    columns.append(np.log(times[kind]).astype(np.float32) * full)  # repeats in the text
    again = np.zeros(len(length), np.float32)
    again[1:] = (hashed[1:] == hashed[:-1]) & (owner[1:] == owner[:-1]) & full[1:]
    columns.append(again)
    own = np.stack(columns, 1).astype(np.float32)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:] = own[:-1] * (owner[1:] == owner[:-1])[:, None]
    after[:-1] = own[1:] * (owner[1:] == owner[:-1])[:, None]
    edges = np.zeros((len(own), 2), np.float32)
    edges[cut[:-1], 0] = 1
    edges[cut[1:] - 1, 1] = 1
    return np.hstack([own, own**2, before, after, edges]), length + 1, cut


class Chains:
    """Forward and backward sums of many chains at once; at each step the chains that still run."""

    def __init__(self, cut: np.ndarray):
        sizes = np.diff(cut)
        order = np.argsort(-sizes, kind="stable")
        first, sizes = cut[:-1][order], sizes[order]
        running = np.searchsorted(-sizes, -np.arange(1, int(sizes.max(initial=0)) + 1), "right")
        self.steps = [first[:k] + t for t, k in enumerate(running)]
        self.n = int(cut[-1])

    def marginals(self, score: np.ndarray, stay: np.ndarray, pairs: bool = False):
        """P(good) of each line; with ``pairs``, also P(bad, bad) and P(good, good) of each line and the one before."""
        good = np.exp(np.clip(score, -30, 30)).astype(np.float64)
        bad_bad, good_good = np.exp(stay)
        a, b = np.empty((self.n, 2)), np.ones((self.n, 2))
        for t, at in enumerate(self.steps):
            if t:
                p = a[self.steps[t - 1][: len(at)]]
                lo, hi = p[:, 0] * bad_bad + p[:, 1], (p[:, 0] + p[:, 1] * good_good) * good[at]
            else:
                lo, hi = np.ones(len(at)), good[at]
            total = lo + hi
            a[at, 0], a[at, 1] = lo / total, hi / total
        for t in range(len(self.steps) - 1, 0, -1):
            at = self.steps[t]
            lo, hi = b[at, 0], b[at, 1] * good[at]
            up = lo * bad_bad + hi, lo + hi * good_good
            total = up[0] + up[1]
            to = self.steps[t - 1][: len(at)]
            b[to, 0], b[to, 1] = up[0] / total, up[1] / total
        joint = a * b
        p_good = joint[:, 1] / joint.sum(1)
        if not pairs:
            return p_good
        both = np.zeros((self.n, 2))
        for t in range(1, len(self.steps)):
            at = self.steps[t]
            p = a[self.steps[t - 1][: len(at)]]
            lo, hi = b[at, 0], b[at, 1] * good[at]
            bb, gg = p[:, 0] * bad_bad * lo, p[:, 1] * good_good * hi
            total = bb + gg + p[:, 0] * hi + p[:, 1] * lo
            both[at, 0], both[at, 1] = bb / total, gg / total
        return p_good, both


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the scaled features, then the intercept
    stay: np.ndarray
    constant: float | None = None

    def score(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Quality of each text, 0 to 1."""
        if self.constant is not None:
            return np.full(len(bounds) - 1, self.constant)
        found, length, cut = features(data, bounds)
        line = Chains(cut).marginals(((found - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1], self.stay)
        return np.clip(K.sums(line * length, cut) / K.sums(length.astype(np.float64), cut), 0, 1)


def fit_chains(data: np.ndarray, bounds: np.ndarray, labels: np.ndarray, ridge: float = 0.003, steps: int = 250) -> Model:
    """Penalised conditional likelihood of constant label chains, by Adam over all documents at once."""
    if not len(labels) or labels.min() == labels.max():
        share = (labels.sum() + 0.5) / (len(labels) + 1)
        return Model(np.zeros(1), np.ones(1), np.zeros(2), np.zeros(2), float(share))
    found, _, cut = features(data, bounds)
    mean, scale = found.mean(0), found.std(0) + 1e-3
    x = np.hstack([(found - mean) / scale, np.ones((len(found), 1), np.float32)]).astype(np.float32)
    sizes = np.diff(cut)
    y = np.repeat(labels, sizes).astype(np.float64)
    share = np.repeat(1 / sizes, sizes) / len(labels)  # each document counts once
    first = np.zeros(len(y), bool)
    first[cut[:-1]] = True
    chains, theta = Chains(cut), np.zeros(x.shape[1] + 2)
    move, size = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        p_good, both = chains.marginals(x @ theta[:-2].astype(np.float32), theta[-2:], pairs=True)
        slope = np.concatenate([x.T @ ((p_good - y) * share).astype(np.float32), np.zeros(2)]).astype(np.float64)
        seen = np.where(first, 0, share)
        slope[-2] = ((both[:, 0] - (1 - y)) * seen).sum()
        slope[-1] = ((both[:, 1] - y) * seen).sum()
        slope += ridge * np.concatenate([theta[:-3], [0], 10 * theta[-2:]])
        move, size = 0.9 * move + 0.1 * slope, 0.99 * size + 0.01 * slope**2
        theta -= 0.1 / (1 + step / 100) * (move / (1 - 0.9**step)) / (np.sqrt(size / (1 - 0.99**step)) + 1e-9)
    return Model(mean, scale, theta[:-2].astype(np.float32), theta[-2:])


def fit(docs: DataFrame, labels: DataFrame, most: int = 1_000, modulus: int = 3, remainder: int = 1) -> Model:
    """Fit to ``labels`` (doc_id, quality) outside the held-out fold, on at most 2 * ``most`` documents."""
    sample = labelled_sample(docs, labels, "quality", modulus, remainder, (most, most)).select("doc_id", "y", "text")
    rows = sorted(sample.collect(), key=lambda r: r["doc_id"])
    data, bounds = K.utf8(pa.array([r["text"] for r in rows], pa.string()))
    return fit_chains(data, bounds, np.array([r["y"] for r in rows], np.int64))


def judge(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1, most: int = 1_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``."""
    model = fit(docs, labels, most, modulus, remainder)

    def run(batches):
        for rows, data, bounds in K.pieces(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(model.score(data, bounds), pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id", held_out("doc_id", modulus, remainder).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
