"""Toxicity by a counterfactual-regularised classifier.

Logistic regression on the presence of words and word beginnings. In the labelled sentences, identity terms are swapped
for other terms of their group; the squared change of the sentence's score is added to the loss, so a neutral mention
of a group cannot carry weight that belongs to the words around it. A labelled document that names no
group gets a term put into one of its sentences, and the swap is made there: terms that the labelled texts lack are held
to one score too, which matters because they share word beginnings with other words.

Fitting reads at most ``most`` labelled documents, clean and toxic, and of each at most ``PAIRS`` sentences with terms, those
with the least checksums. Features are at most ``most_words`` with the strongest association, and the identity terms.
Scoring reads whole texts, one pass without a shuffle. Defined cases: null and empty texts, and texts without words, get the score of the
intercept; without any labelled document all scores are 0; with one label only, all scores are the
smoothed share of toxic labels; rows with equal ids are scored one by one.
"""

from __future__ import annotations

import math
import re
import sys
import zlib
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlscope.llm.common import held_out, labelled_sample

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")
PAIRS = 4
PREFIXES = range(3, 8)

# Terms that name a group of people without judging it, by language and kind.
IDENTITY = {
    "gender": "man woman men women male female boy girl transgender nonbinary".split(),
    "faith": "christian muslim jewish hindu buddhist sikh catholic protestant atheist mormon".split(),
    "origin": "african american asian european arab mexican chinese indian jew latino hispanic immigrant refugee".split(),
    "colour": "black white brown".split(),
    "orientation": "gay straight lesbian bisexual homosexual heterosexual queer".split(),
    "ability": "deaf blind autistic disabled paralyzed".split(),
    "age": "young old elderly teenage".split(),
    "de gender": "mann frau männer frauen männlich weiblich junge mädchen".split(),
    "de faith": "christ muslim jude hindu buddhist katholik protestant atheist".split(),
    "de origin": "afrikaner amerikaner asiate europäer araber mexikaner chinese inder einwanderer flüchtling".split(),
    "de orientation": "schwul lesbisch bisexuell homosexuell heterosexuell".split(),
    "de ability": "gehörlos blind autistisch behindert".split(),
    "fr gender": "homme femme hommes femmes masculin féminin garçon fille".split(),
    "fr faith": "chrétien musulman juif hindou bouddhiste catholique protestant athée".split(),
    "fr origin": "africain américain asiatique européen arabe mexicain chinois indien immigré réfugié".split(),
    "fr orientation": "gay lesbienne bisexuel homosexuel hétérosexuel".split(),
    "fr ability": "sourd aveugle autiste handicapé".split(),
    "es gender": "hombre mujer hombres mujeres masculino femenino niño niña".split(),
    "es faith": "cristiano musulmán judío hindú budista católico protestante ateo".split(),
    "es origin": "africano americano asiático europeo árabe mexicano chino indio inmigrante refugiado".split(),
    "es orientation": "gay lesbiana bisexual homosexual heterosexual".split(),
    "es ability": "sordo ciego autista discapacitado".split(),
}


def swaps(groups: dict[str, list[str]] | None = None) -> dict[str, str]:
    """Each identity term with the next one of its group; a term of several groups takes the first of them."""
    out: dict[str, str] = {}
    for group in (IDENTITY if groups is None else groups).values():
        for i, term in enumerate(group):
            out.setdefault(term, group[(i + 1) % len(group)])
    return out


def word_set(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def features(words: set[str]) -> set[str]:
    """The words, and their beginnings of 3 to 7 letters, so that inflected forms share a feature."""
    return words | {f"{w[:k]}-" for w in words for k in PREFIXES if len(w) >= k}


def difference(words: set[str], other: set[str]) -> tuple[list[str], list[str]]:
    """Features that only the one, and only the other sentence has."""
    one, two = features(words), features(other)
    return sorted(one - two), sorted(two - one)


def counterfactuals(text: str, swap: dict[str, str], terms: Sequence[str]) -> list[tuple[list[str], list[str]]]:
    """What the swaps change in the sentences of a text. Without a term of ``swap`` in it, one of ``terms`` is put into the
    sentence with the least checksum, which also picks the term."""
    named, plain = [], None
    for m in SENTENCE.finditer(text.lower()):
        words = set(WORD.findall(m[0]))
        if not words:
            continue
        code = zlib.crc32(m[0].encode("utf-8", "surrogatepass"))
        if words & swap.keys():
            named = sorted([*named, (code, sorted(words))])[:PAIRS]
        elif plain is None or code < plain[0]:
            plain = code, words
    out = []
    for _, words in named:
        own = set(words) & swap.keys()
        out.append(difference(set(words), (set(words) - own) | {swap[w] for w in own}))
    if not named and plain and terms:
        term = terms[plain[0] % len(terms)]
        out.append(difference(plain[1] | {term}, plain[1] | {swap[term]}))
    return [(plus, minus) for plus, minus in out if plus or minus]


@dataclass
class Model:
    """Weights of features; ``pairs`` counts the counterfactual pairs of the fit."""

    weights: dict[str, float]
    intercept: float
    pairs: int = 0

    @cached_property
    def stubs(self) -> set[str]:
        """First letters of all features with a weight: words that begin otherwise have none."""
        return {f[: PREFIXES.start] for f in self.weights}

    def score(self, words: set[str]) -> float:
        if self.intercept == -np.inf:
            return 0.0
        stubs, size = self.stubs, PREFIXES.start
        likely = {w for w in words if w[:size] in stubs}
        z = self.intercept + sum(sorted(self.weights[w] for w in self.weights.keys() & features(likely)))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fit_words(
    rows: Sequence[tuple[Sequence[str], int]],
    swap: dict[str, str],
    penalty: float = 50.0,
    ridge: float = 1.0,
    least: int = 5,
    significance: float = 5.0,
    most_words: int = 2_000,
    steps: int = 300,
    pairs: Sequence[tuple[Sequence[str], Sequence[str]]] | None = None,
) -> Model:
    """Fit on (distinct words, label) rows. Words in fewer than ``least`` texts or whose association with
    the label is below ``significance`` (root of the likelihood-ratio statistic) get no weight; identity terms are always in.
    ``pairs`` are the features that each counterfactual removes and adds; by default each row counts as one sentence."""
    if pairs is None:
        named = [(set(words), set(words) & swap.keys()) for words, _ in rows]
        pairs = [difference(w, (w - own) | {swap[t] for t in own}) for w, own in named if own]
    n = np.bincount([y for _, y in rows], minlength=2)
    prior = float(np.log((n[1] + 0.5) / (n[0] + 0.5)))
    if not n.all():
        return Model({}, prior if n.any() else -np.inf)
    seen = Counter(), Counter()
    for words, y in rows:
        seen[y].update(features(set(words)))
    strength = {}
    for w in seen[0].keys() | seen[1].keys():
        a, b = seen[1][w], seen[0][w]
        if a + b >= least:
            z = _association(a, b, n[1], n[0])
            if z >= significance:
                strength[w] = z
    terms = swap.keys() & {f for pair in pairs for side in pair for f in side}
    strongest = sorted(strength, key=lambda w: (-strength[w], w))[:most_words]
    vocabulary = strongest + sorted(terms - set(strongest))
    at = {w: i for i, w in enumerate(vocabulary)}
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    for i, (words, _) in enumerate(rows):
        x[i, [at[w] for w in features(set(words)) & at.keys()]] = 1
    gap = np.zeros((len(pairs), len(vocabulary)), np.float32)
    for i, (plus, minus) in enumerate(pairs):
        gap[i, [at[f] for f in plus if f in at]] = 1
        gap[i, [at[f] for f in minus if f in at]] = -1
    y = np.array([y for _, y in rows], np.float32)
    weight, bias = np.zeros(len(vocabulary), np.float32), np.float32(prior)
    # Accelerated gradient steps, with a step below the reciprocal of the curvature.
    top = 0.25 * _norm(x) / len(rows) + ridge / len(rows) + (penalty * _norm(gap) / len(gap) if len(gap) else 0)
    rate, ahead, old = 1 / (top + 0.25), weight.copy(), weight.copy()
    bias_ahead, bias_old = bias, bias
    for step in range(1, steps + 1):
        error = 1 / (1 + np.exp(-np.clip(x @ ahead + bias_ahead, -60, 60))) - y
        slope = x.T @ error / len(rows) + ridge / len(rows) * ahead
        if len(gap):
            slope += penalty * (gap.T @ (gap @ ahead)) / len(gap)
        weight, bias = ahead - rate * slope, bias_ahead - rate * error.mean()
        speed = (step - 1) / (step + 2)
        ahead, bias_ahead = weight + speed * (weight - old), bias + speed * (bias - bias_old)
        old, bias_old = weight, bias
    return Model({w: float(weight[i]) for w, i in at.items() if abs(weight[i]) > 1e-6}, float(bias), len(pairs))


def _association(a: int, b: int, n_1: int, n_0: int) -> float:
    """Root of the likelihood-ratio statistic for a feature in a of n_1 and b of n_0 texts."""
    share = (a + b) / (n_1 + n_0)
    cells = ((a, n_1 * share), (b, n_0 * share), (n_1 - a, n_1 * (1 - share)), (n_0 - b, n_0 * (1 - share)))
    return math.sqrt(max(0.0, 2 * sum(o * math.log(o / e) for o, e in cells if o)))


def _norm(x: np.ndarray, rounds: int = 20) -> float:
    """About the largest eigenvalue of x'x, from above."""
    if not x.size:
        return 0.0
    v = np.ones(x.shape[1], np.float32)
    for _ in range(rounds):
        v = x.T @ (x @ v)
        size = float(np.linalg.norm(v))
        if size == 0:
            return 0.0
        v /= size
    return 1.2 * size


def fit(
    docs: DataFrame,
    labels: DataFrame,
    most: tuple[int, int] = (3_000, 1_500),
    modulus: int = 5,
    remainder: int = 0,
    groups: dict[str, list[str]] | None = None,
    penalty: float = 50.0,
) -> Model:
    """Fit to ``labels`` (doc_id, toxic) outside the held-out fold, on at most ``most`` clean and toxic documents.
    ``groups`` are the identity terms by group, in any languages; by default ``IDENTITY``."""
    sample = labelled_sample(docs, labels, "toxic", modulus, remainder, most)
    swap = swaps(groups)
    terms = [t for t in swap if swap[t] != t]
    sides = pa.list_(pa.list_(pa.list_(pa.string())))

    def words_of(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [sorted(word_set(t)) for t in texts]
            pairs = [[list(p) for p in counterfactuals(t, swap, terms)] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string())), pa.array(pairs, sides)], ["y", "words", "pairs"])

    found = sample.select("y", "text").mapInArrow(words_of, "y int, words array<string>, pairs array<array<array<string>>>")
    rows, pairs = [], []
    for r in found.toLocalIterator():
        rows.append((r["y"], tuple(map(sys.intern, r["words"]))))
        pairs += [(tuple(plus), tuple(minus)) for plus, minus in r["pairs"]]
    rows.sort()
    model = fit_words([(words, y) for y, words in rows], swap, penalty, pairs=sorted(pairs))
    # The sample's shares of the labels depend on its bounds; the intercept takes back the true ones.
    counted = labels.filter(F.col("doc_id").isNotNull() & ~held_out("doc_id", modulus, remainder))
    all_1, all_0 = counted.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    own_1, own_0 = (sum(y == k for y, _ in rows) for k in (1, 0))
    if own_1 and own_0:
        model.intercept += float(np.log(all_1 / all_0) - np.log(own_1 / own_0))
    return model


def scorer(model: Model):
    """A column function of the text: toxicity, 0 to 1."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: model.score(word_set(t or ""))).astype("float64")

    return F.pandas_udf(run, "double")


def judge(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0, most: tuple[int, int] = (3_000, 1_500)) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``."""
    toxicity = scorer(fit(docs, labels, most, modulus, remainder))
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), toxicity(F.col("text").cast("string")).alias("score"))
    return scored.select(
        "doc_id", held_out("doc_id", modulus, remainder).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def clean(docs: DataFrame, labels: DataFrame, most: tuple[int, int] = (3_000, 1_500)) -> DataFrame:
    """The documents that are not judged toxic, with their columns."""
    toxicity = scorer(fit(docs, labels, most))
    return docs.filter(toxicity(F.col("text").cast("string")) < 0.5)
