"""Block-Max MaxScore against scoring every document for every item."""

import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from crawlscope.llm import kernels as K
from crawlscope.llm import ranked_search as R

ITEMS = "item_id long, text string, rank int, score long"


def terms_of(text):
    fold = {ord(a): a.lower() for a in R.UPPER}
    return re.findall(R.TERM, (text or "").translate(fold))


def brute(docs, items, k=10):
    docs = [(i, Counter(t)) for i, text in docs if (t := terms_of(text))]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    queries = {}
    for item, text in items:
        queries.setdefault(item, set()).update(terms_of(text))
    out = []
    for item, terms in queries.items():
        scored = []
        for i, counts in docs:
            m = 100 - 90 + (90 * sum(counts.values()) * n) // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * counts[t]) // (1000 * counts[t] + 8 * m)) for t in terms if counts[t]
            )
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, k=10):
    got = R.search(spark, R.build_index(docs), items, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, got.collect()), key=str)


def random_text(rnd, most):
    return " ".join(f"w{min(int(rnd.paretovariate(0.6)), 400)}" for _ in range(rnd.randrange(most)))


@pytest.mark.parametrize("shard", [600, 4_000, 1 << 20])
def test_random_documents(spark, monkeypatch, shard):
    rnd = random.Random(shard)
    docs = [(i, random_text(rnd, 80)) for i in range(900)]
    docs += [(rnd.randrange(900), docs[rnd.randrange(900)][1]) for _ in range(60)] + [(None, docs[3][1]), (None, None), (77, "")]
    items = [(i, random_text(rnd, 30)) for i in range(40)] + [(3, "w5 w9"), (90, None), (91, "nowhere"), (None, "w7 w50 W7")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    # Small shards, so that a heap goes from shard to shard and several heaps are merged.
    monkeypatch.setattr(R, "SHARD", shard)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, 25)
    try:
        path = R.build_index(frame)
        shards = spark.read.schema(R.INDEX).parquet(path).select("shard").distinct().count()
        assert shards > 20 if shard == 600 else shards >= 3
        got = R.search(spark, path, spark.createDataFrame([(*x, 1, 1) for x in items], ITEMS))
        assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)
    finally:
        spark.conf.set(batch, before)


def test_odd_rows(spark, odd_docs, clashing, no_docs):
    items = [(1, "one TWO seven"), (2, "word3 word96 end é ñ ß"), (2, "don't"), (3, None), (4, "　x 12"), (5, "!?")]
    table = spark.createDataFrame([(*x, 1, 1) for x in items], ITEMS)
    expected = brute([(r.doc_id, r.text) for r in odd_docs.collect()], items)
    assert found(spark, odd_docs, table) == expected
    assert found(spark, clashing, table.withColumn("term", F.lit("x"))) == expected
    assert found(spark, no_docs, table) == []
    assert found(spark, odd_docs, table.limit(0)) == []


def test_items_in_several_passes(spark, monkeypatch):
    rnd = random.Random(5)
    docs = [(i, random_text(rnd, 30)) for i in range(100)]
    items = [(i, random_text(rnd, 9)) for i in range(9)]
    monkeypatch.setattr(R, "MOST_ITEMS", 4)
    table = spark.createDataFrame([(*x, 1, 1) for x in items], ITEMS)
    assert [len(b) for b in R.query_blocks(table)][0] == 4
    assert found(spark, spark.createDataFrame(docs, "doc_id long, text string"), table, 3) == brute(docs, items, 3)


def lists_from(docs, weights):
    """Lists of one shard of documents given as texts."""
    texts = [t.encode() for t in docs]
    data = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    import pyarrow as pa

    head, *rest = R._shard(0, [pa.array(range(len(docs)), pa.int64())], [(data, bounds)])
    sizes = head.column(4)[0].values.to_numpy().astype(np.int64)
    terms = {t: (b, p) for batch in rest for t, b, p in zip(*(batch.column(c).to_pylist() for c in (1, 5, 6)))}
    return R.lists_of(terms, weights, R.norm_of(len(docs), int(sizes.sum())), sizes), sizes


def test_blocks_are_rejected_before_decompression():
    docs = [f"common filler{i}" + (" rare" if i in (40, 41) else "") + " x" * (i % 7) for i in range(6_400)]
    lists, sizes = lists_from(docs, {"common": 10, "rare": 9_000})
    heap = R.Heap(2)
    null = np.zeros(len(docs), bool)
    R.search_shard(list(lists.values()), heap, np.arange(len(docs)), null, [0, 250, len(docs)])
    assert heap.ids.tolist() == [40, 41]
    read = sum(b is not None for b in lists["common"].blocks)
    assert len(lists["common"].blocks) == 100 and read <= 4


def test_block_maxima_are_reached_and_never_passed():
    rnd = random.Random(2)
    docs = [random_text(rnd, 400) for _ in range(500)]
    lists, _ = lists_from(docs, {f"w{i}": 100 + i for i in range(400)})
    for x in lists.values():
        for b, most in enumerate(x.most):
            gains = x.block(b)[1]
            assert gains.max() <= most
            if x.table[b, 5] < R.POINTS:
                assert gains.max() == most


def test_sizes_beyond_64_bits():
    assert R.norm_of(10**14, 10**17)(np.array([10**6, 5])).tolist() == [10 + 90 * 10**6 * 10**14 // 10**17, 10]


def test_terms_of_a_shard_are_numbered_in_steps():
    """Long words across the steps, repeats far apart, and memory that stays small beside a hash of the whole shard."""
    words = [*(f"w{i % 50_000:09d}" for i in range(400_000)), "x" * (2 * K.PIECE), "w000000001", "x" * (2 * K.PIECE), "y"]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = K.words(data, np.array([0, len(data)]), K.NOT_ALNUM)
    R._number(data[:100], starts[:2], ends[:2])
    tracemalloc.start()
    number, terms = R._number(data, starts, ends)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [terms[i].decode() for i in number.tolist()] == words and len(terms) == len(set(words))
    assert peak < 20 * len(data), peak / len(data)
