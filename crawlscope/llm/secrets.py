"""Secret scans: fixed patterns plus two character Markov models.

The base patterns mark assignments, access keys and long hexadecimal strings. Besides, every other long
token is scored by two first-order character models, one of random strings and one of ordinary
identifiers; a token whose log-likelihood ratio per character is above a threshold is a secret too. Both
models are trained from labelled samples: by default the values that the base patterns find (random) and
the plain words and numbers of the texts (ordinary), counted over all documents.

Spans are in code points, the end exclusive. Defined cases: null texts are empty; texts without a match
have empty lists; equal texts have equal results; without a sample of one class nothing is added.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlscope.llm import kernels as K
from crawlscope.llm.common import stored

# The base patterns, and the least length of what they must hold.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "markov")

CHARACTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]+")
LEAST_TOKEN, LEAST_WORD, THRESHOLD = 16, 4, 0.5
_SIZE = len(CHARACTERS) + 1
_CODE = np.full(256, 0, np.uint8)
_CODE[[ord(c) for c in CHARACTERS]] = np.arange(1, _SIZE)
_TOKEN_BREAK = ~np.isin(np.arange(256), [ord(c) for c in CHARACTERS])
_HEX_BREAK = ~K.byte_set((0x30, 0x39), (0x61, 0x66))


def base_spans(text: str, hexes: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, leftmost and without overlaps per kind, in order.

    Searching for the least length of a maximal run equals dropping shorter runs, for hex; the other
    patterns are searched as they are and their short matches dropped, as those may hide later ones.
    """
    found = []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if hexes:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST["assign"]]
    return sorted(found)


def free_tokens(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, str]]:
    """(start, token) of the long tokens that no span overlaps; one walk over the tokens and the sorted spans together."""
    free, at, reach = [], 0, 0
    for m in TOKEN.finditer(text):
        if m.end() - m.start() < LEAST_TOKEN:
            continue
        # Of the spans that start before this token's end, the farthest end tells whether one reaches into it.
        while at < len(spans) and spans[at][0] < m.end():
            reach = max(reach, spans[at][2])
            at += 1
        if reach <= m.start():
            free.append((m.start(), m[0]))
    return free


def pair_counts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Counts of character pairs in the given ASCII tokens; 0 stands before the first character."""
    sizes = ends - starts
    codes = _CODE[data[K.ragged(starts, sizes)]].astype(np.int64)
    before = np.concatenate([[0], codes[:-1]]) if len(codes) else codes
    before[(np.cumsum(sizes) - sizes)[sizes > 0]] = 0
    return np.bincount(before * _SIZE + codes, minlength=_SIZE * _SIZE)


def log_ratio(random: np.ndarray, ordinary: np.ndarray, weight: float = 5.0) -> np.ndarray:
    """log P(next | character) of the random over the ordinary model. Pairs are smoothed by the shares of
    the characters, as much as ``weight`` observations, and those by half an observation each."""
    both = []
    for counts in (random, ordinary):
        table = counts.reshape(_SIZE, _SIZE)[:, 1:]
        single = table.sum(0) + 0.5
        both.append(np.log((table + weight * single / single.sum()) / (table.sum(1, keepdims=True) + weight)))
    out = np.zeros((_SIZE, _SIZE))
    out[:, 1:] = both[0] - both[1]
    return out


def token_score(token: str, ratio: np.ndarray) -> float:
    """Log-likelihood ratio per character."""
    codes = _CODE[np.frombuffer(token.encode(), np.uint8)].astype(np.int64)
    return float(ratio[np.concatenate([[0], codes[:-1]]), codes].mean())


def collect_evidence(docs: DataFrame) -> DataFrame:
    """One pass over the texts. Rows of documents: doc_id, base spans and, besides them, the long tokens.
    Rows without spans: pair counts of the base patterns' values and of plain words and numbers, per piece of rows."""

    def run(batches):
        for rows, data, bounds in K.pieces(batches):
            texts = rows.column(1)
            starts, ends, cut = K.words(data, bounds, _TOKEN_BREAK)
            long_ = ends - starts >= LEAST_TOKEN
            owner = np.repeat(np.arange(rows.num_rows), np.diff(cut))
            with_long = np.zeros(rows.num_rows, bool)
            with_long[owner[long_]] = True
            h_starts, h_ends, h_cut = K.words(data, bounds, _HEX_BREAK)
            with_hex = np.zeros(rows.num_rows, bool)
            with_hex[np.repeat(np.arange(rows.num_rows), np.diff(h_cut))[h_ends - h_starts >= LEAST["hex"]]] = True
            letters = np.concatenate([[0], np.cumsum(~_LETTER[data], dtype=np.int64)])
            digits = np.concatenate([[0], np.cumsum(~_DIGIT[data], dtype=np.int64)])
            plain = (ends - starts >= LEAST_WORD) & ((letters[ends] == letters[starts]) | (digits[ends] == digits[starts]))
            spans, tokens, values = [], [], []
            for i in range(rows.num_rows):
                text = texts[i].as_py() or ""
                found = base_spans(text, bool(with_hex[i]))
                spans.append([{"start": a, "kind": k, "end": b} for a, k, b in found])
                values += [text[a:b] if k else ASSIGN.match(text, a)[1] for a, k, b in found]
                tokens.append([{"start": a, "token": t} for a, t in free_tokens(text, found)] if with_long[i] else [])
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(spans, _SPANS), pa.array(tokens, _TOKENS), pa.nulls(len(spans), _COUNTS), pa.nulls(len(spans), _COUNTS)], names
            )
            joined = np.frombuffer(" ".join(values).encode(), np.uint8)
            v_starts, v_ends, _ = K.words(joined, np.array([0, len(joined)]), _TOKEN_BREAK)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(1, pa.int64()), pa.nulls(1, _SPANS), pa.nulls(1, _TOKENS),
                    pa.array([pair_counts(joined, v_starts, v_ends)], _COUNTS), pa.array([pair_counts(data, starts[plain], ends[plain])], _COUNTS),
                ],
                names,
            )

    names = ["doc_id", "spans", "tokens", "random", "ordinary"]
    schema = (
        "doc_id long, spans array<struct<start: long, kind: long, end: long>>, tokens array<struct<start: long, token: string>>, "
        "random array<long>, ordinary array<long>"
    )
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return stored(rows.mapInArrow(run, schema), "secrets")


_LETTER = K.byte_set((0x41, 0x5A), (0x61, 0x7A), (0x5F, 0x5F))
_DIGIT = K.byte_set((0x30, 0x39))
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int64()), ("end", pa.int64())]))
_TOKENS = pa.list_(pa.struct([("start", pa.int64()), ("token", pa.string())]))
_COUNTS = pa.list_(pa.int64())


def train(evidence: DataFrame) -> np.ndarray | None:
    """The log-ratio table out of the pair counts of all documents: 2 * 68 * 68 numbers come to the driver."""
    sums = [np.zeros(_SIZE * _SIZE), np.zeros(_SIZE * _SIZE)]
    counts = evidence.filter("spans IS NULL")
    for out, name in zip(sums, ("random", "ordinary"), strict=True):
        for row in counts.select(F.posexplode(name).alias("pair", "n")).groupBy("pair").agg(F.sum("n").alias("n")).filter("n > 0").collect():
            out[row["pair"]] = row["n"]
    return log_ratio(*sums) if all(s.sum() for s in sums) else None


def train_from_samples(samples: DataFrame) -> np.ndarray | None:
    """The log-ratio table from labelled strings (value, label): 1 random, 0 ordinary."""

    def run(batches):
        for batch in batches:
            label = np.asarray(batch.column(1))
            for y in (0, 1):
                data, bounds = K.utf8(batch.column(0).filter(pa.array(label == y)))
                starts, ends, _ = K.words(data, bounds, _TOKEN_BREAK)
                counts = pair_counts(data, starts, ends)
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), y)), pa.array(at), pa.array(counts[at])], ["label", "pair", "n"])

    rows = samples.filter("value IS NOT NULL AND label IN (0, 1)").select("value", F.col("label").cast("long"))
    sums = [np.zeros(_SIZE * _SIZE), np.zeros(_SIZE * _SIZE)]
    for row in rows.mapInArrow(run, "label long, pair long, n long").groupBy("label", "pair").agg(F.sum("n").alias("n")).collect():
        sums[1 - row["label"]][row["pair"]] = row["n"]
    return log_ratio(*sums) if all(s.sum() for s in sums) else None


def scan(docs: DataFrame, ratio: np.ndarray | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, spans) per row of ``docs``: all spans as (start, kind, end), kinds by their place in ``KINDS``.

    Without a table ``ratio`` the models are trained on the evidence of the texts themselves.
    """
    evidence = collect_evidence(docs)
    ratio = train(evidence) if ratio is None else ratio

    def run(batches):
        for batch in batches:
            spans = batch.column(1).to_pylist()
            if ratio is not None:
                for own, tokens in zip(spans, batch.column(2).to_pylist(), strict=True):
                    for t in tokens:
                        if token_score(t["token"], ratio) > threshold:
                            own.append({"start": t["start"], "kind": 3, "end": t["start"] + len(t["token"])})
                    own.sort(key=lambda s: (s["start"], s["kind"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPANS)], ["doc_id", "spans"])

    rows = evidence.filter("spans IS NOT NULL").select("doc_id", "spans", "tokens")
    return rows.mapInArrow(run, "doc_id long, spans array<struct<start: long, kind: long, end: long>>")


def report(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) with spans as kind:start:end, comma-joined."""
    named = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), (s["kind"] + 1).cast("int")), s["start"], s["end"])), ","
    )
    base = F.filter("spans", lambda s: s["kind"] < 3)
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(named(base), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"),
    )
