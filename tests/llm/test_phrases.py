"""Phrases against counting in plain Python; filters against a counter of exact keys."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crawlscope.llm import kernels as K
from crawlscope.llm import phrases as P

FOLD = {c: c + 32 for c in range(65, 91)}


def brute(rows, least, cover=50, k=2_000):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(FOLD)):
            w = re.findall("[^ \t]+", piece)
            totals[lang] += len(w)
            counts.update((lang, *w[i : i + s]) for s in (1, 2, 3) for i in range(len(w) - s + 1))
    often = {p: f for p, f in counts.items() if f >= least}
    found = []
    for (lang, *p), a in often.items():
        longer = [f for (other, *q), f in often.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if len(p) == 1 or any(100 * f >= cover * a for f in longer):
            continue
        score, _, l, r = min((10**6 * a * a // (often[lang, *p[:i]] * often[lang, *p[i:]]), i, often[lang, *p[:i]], often[lang, *p[i:]]) for i in range(1, len(p)))
        found.append((lang, -score, -a, " ".join(p).encode(), l, r))
    out, rank = [], Counter()
    for lang, score, a, p, l, r in sorted(found):
        rank[lang] += 1
        if rank[lang] <= k:
            out.append((lang, rank[lang], p.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def test_random_texts_in_many_shards_and_rounds(spark, monkeypatch):
    rnd = random.Random(1)
    vocabulary = ["Of", "of", "THE", "new", "york", "city", "é", "ß", "a-b", "x\xa0y", "10%", "((", "zz"]
    rows = [
        ("".join(rnd.choice(vocabulary) + rnd.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ","]) for _ in range(rnd.randrange(50))), rnd.choice(["en", "en", None, "de"]))
        for _ in range(300)
    ]
    rows += [rows[0]] * 15 + [(None, "en"), ("", None), (" . ", "fr")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    expected = brute(rows, 5)
    assert len(expected) > 100
    assert sorted(map(tuple, P.phrases(docs, least=5).collect())) == expected
    # Small bounds: several chunks a task, several filters a chunk, merges in several rounds.
    for name, value in (("CHUNK", 900), ("BUCKET", 300), ("HELD", 40), ("MERGE", 100), ("STEP", 2)):
        monkeypatch.setattr(P, name, value)
    batch, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(batch, 20)
    try:
        lists = P.chunks(docs.repartition(2))
        assert lists.select("chunk").distinct().count() > 4
        assert sorted(map(tuple, P.phrases(docs.repartition(2), least=5).collect())) == expected
        assert sorted(map(tuple, P.phrases(docs, least=5, k=7).collect())) == brute(rows, 5, k=7)
        assert sorted(map(tuple, P.phrases(docs, least=3, cover=80).collect())) == brute(rows, 3, 80)
    finally:
        spark.conf.set(batch, before)


def test_odd_rows(spark, odd_docs, clashing, no_docs):
    expected = brute([(r.text, r.lang) for r in odd_docs.collect()], 10)
    got = P.phrases(odd_docs)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == expected
    assert sorted(map(tuple, P.phrases(clashing.withColumn("f", F.lit(1)).withColumn("word", F.lit("x"))).collect())) == expected
    assert P.phrases(no_docs).collect() == []



@settings(max_examples=60, deadline=None)
@given(n_ids=st.sampled_from([1, 2, 3, 20, 1000, 2**21 - 1, 2**21, 2**27, 2**32 - 1]), seed=st.integers(0, 99), n=st.integers(1, 400), lead=st.integers(0, 5))
def test_filters_lose_nothing(n_ids, seed, n, lead):
    rnd, packing = np.random.default_rng(seed), P.Packing(n_ids)
    lead = min(lead, packing.half)
    keys = [rnd.integers(1, n_ids, n, endpoint=True), rnd.integers(1, n_ids, n, endpoint=True), rnd.integers(0, n_ids, n, endpoint=True)]
    keys = [np.concatenate([k, k[: n // 2]]) for k in keys]
    assert all(np.array_equal(a, b) for a, b in zip(packing.unpack(*packing.pack(*keys)), keys))
    high, low = packing.permute(*packing.pack(*keys))
    assert all(np.array_equal(a, b) for a, b in zip(packing.restore(high, low), packing.pack(*keys)))
    assert int(high.max()) < 1 << packing.half and int(low.max()) < 1 << packing.half
    *sorted_keys, counts = packing.count(high.copy(), low.copy())
    counts = counts * rnd.choice([1, 1, 200, 255, 256, 10**12], len(counts))  # counters of any size
    expected = Counter()
    for *k, c in zip(*(x.tolist() for x in packing.unpack(*packing.restore(*sorted_keys))), counts.tolist()):
        expected[tuple(k)] += 2 * c
    rows = packing.cut(*sorted_keys, counts, lead, 7)
    assert len(rows) <= 1 << lead
    import pyarrow as pa

    twice = pa.concat_tables([rows, rows])
    *merged, sums = packing.merged(twice, lead)
    got = dict(zip(zip(*(x.tolist() for x in packing.unpack(*packing.restore(*merged)))), sums.tolist()))
    assert got == dict(expected)


def test_filters_are_compact():
    packing, rnd = P.Packing(2**18 - 1), np.random.default_rng(1)
    keys = packing.permute(*packing.pack(*(rnd.integers(1, 2**18 - 1, 200_000) for _ in range(3))))
    (raw,) = packing.cut(*packing.count(*keys), 0, 0)["filter"].to_pylist()
    assert len(raw) < 6 * 200_000  # 24 bytes each as three numbers


def test_equal_beginnings_spread():
    """One word before all others, as "the" is: the quotients are even."""
    packing, n = P.Packing(2**18 - 1), 100_000
    second = np.arange(1, n + 1)
    high, _ = packing.permute(*packing.pack(np.full(n, 7), second, np.zeros(n, np.int64)))
    sizes = np.bincount((high >> K.U64(packing.half - 6)).astype(np.int64), minlength=64)
    assert sizes.min() > 0.9 * n / 64 and sizes.max() < 1.1 * n / 64


def test_too_many_ids():
    with pytest.raises(ValueError, match="32-bit"):
        P.Packing(1 << 32)


def test_scores_beyond_64_bits(spark):
    found = spark.createDataFrame([(1, 2, 0, 3 * 10**14 + 7)], "x long, y long, z long, f long")
    ids = spark.createDataFrame([("en", "a", 4 * 10**14 + 1, 1), ("en", "b", 9 * 10**14 + 11, 2)], "lang string, word string, f long, id long")
    (row,) = P.score(found, ids, 50).collect()
    assert row.score == 10**6 * (3 * 10**14 + 7) ** 2 // ((4 * 10**14 + 1) * (9 * 10**14 + 11))
