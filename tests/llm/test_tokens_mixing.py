"""Token files and the source mix against plain Python."""

import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from crawlscope.llm import mixing, tokens
from crawlscope.llm.common import new_folder, table
from crawlscope.llm.queries import tokenizer_path

SMALL = "/root/testdata/sf0.001"



def expected_index(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    start = 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        yield doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


@pytest.mark.parametrize("name", ["odd_docs", "clashing", "no_docs"])
def test_index_equals_encoding_each_text(request, name):
    docs = request.getfixturevalue(name)
    got = sorted((tuple(r) for r in tokens.token_output(docs, tokenizer_path()).collect()), key=lambda r: r[1])
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = list(expected_index(rows))
    assert [g[0] for g in got] == [w[0] for w in want]
    assert Counter((g[0], g[2], g[3]) for g in got) == Counter((w[0], w[2], w[3]) for w in want)
    assert [g[1] for g in got] == [sum(g[2] for g in got[:i]) for i in range(len(got))]


def test_query_on_the_whole_table(spark):
    docs = table(spark, SMALL, "documents")
    got = sorted((tuple(r) for r in tokens.token_output(docs, tokenizer_path()).collect()), key=lambda r: r[1])
    assert got == list(expected_index([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]))


def test_files_keep_order_and_prune_by_id(spark):
    docs = table(spark, SMALL, "documents")
    path = tokens.write_tokens(docs, tokenizer_path(), new_folder(spark, "t"), files=3)
    rows = tokens.read_tokens(spark, path)
    assert rows.select("part").distinct().count() == 3
    assert rows.filter("doc_id = 77").count() == 1
    assert "EqualTo(doc_id,77)" in rows.filter("doc_id = 77")._jdf.queryExecution().toString()
    last = rows.groupBy("part").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).orderBy("part").collect()
    assert all(x["b"] < y["a"] for x, y in zip(last, last[1:]))


def test_pieces_never_change_the_ids():
    from tokenizers import Tokenizer

    rng, tokenizer = np.random.default_rng(5), Tokenizer.from_file(tokenizer_path())
    parts = ["a", "Zoë", "'s", "'ll", " ", "  ", "\n", "\t", ".", ",,", "12", "été", "ñ", "漢字", " ", " ", "x!y", "-", "🙂", "Ö", "ÿ", "×"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 25))) for _ in range(3_000)]
    import pyarrow as pa

    from crawlscope.llm import kernels as K

    data, bounds = K.utf8(pa.array(texts))
    ids, cut = tokens.Encoder(tokenizer_path(), keep=500).encode(data, bounds)
    for text, a, b in zip(texts, cut[:-1], cut[1:], strict=True):
        assert ids[a:b].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def sizes_of(docs):
    return [(r["doc_id"], r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in docs.collect()]


def expected_targets(size):
    """Shares by weight of 150 % of all words, stopped at twice a source's size, the excess dealt again."""
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(size.values()), set(names)
    while left > 1e-9 and open_:
        whole = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / whole for s in open_}
        left = 0.0
        for s, more in share.items():
            target[s] += more
            if target[s] >= 2 * size[s]:
                left += target[s] - 2 * size[s]
                target[s] = 2.0 * size[s]
                open_.discard(s)
    return target


@pytest.mark.parametrize("name", ["odd_docs", "clashing", "small"])
def test_mix_reaches_its_targets(spark, request, name):
    docs = table(spark, SMALL, "documents") if name == "small" else request.getfixturevalue(name)
    rows = sizes_of(docs)
    size, largest, got = Counter(), Counter(), defaultdict(list)
    for _, s, n in rows:
        size[s] += n
        largest[s] = max(largest[s], n)
    report = mixing.mix_report(docs).collect()
    assert Counter((r["doc_id"], r["size"]) for r in report) == Counter((i, n) for i, _, n in rows)
    assert all(r["taken"] % max(r["size"], 1) == 0 and 0 <= r["taken"] <= 2 * r["size"] for r in report)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    for r in mixed.collect():
        got[r["source"]].append(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")))
    target = expected_targets(size)
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    for s in size:
        assert abs(sum(got[s]) - target[s]) <= largest[s] + 1e-6
    assert sum(r["taken"] for r in report) == sum(map(sum, got.values()))
    targets = {(r["source_size"], round(r["target"], 6)) for r in report}
    assert targets == {(size[s], round(target[s], 6)) for s in size}


def test_mix_of_nothing_and_reruns(spark, no_docs):
    assert mixing.mix_report(no_docs).count() == 0
    assert mixing.mix(no_docs).count() == 0
    docs = table(spark, SMALL, "documents")
    one, two = (sorted(map(tuple, mixing.mix_report(d).collect())) for d in (docs, docs.repartition(7)))
    assert one == two


def encoded(encoder, *texts):
    raw = [t.encode() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    ids, cut = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), bounds)
    return [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:])]


def test_known_pieces_take_little_memory():
    encoder = tokens.Encoder(tokenizer_path())
    encoded(encoder, "a first text")
    tracemalloc.start()
    for low in range(0, 300_000, 50_000):
        encoded(encoder, " ".join(f"w{i:06d}" for i in range(low, low + 50_000)))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 120 * 300_000, held / 300_000


def test_known_pieces_with_equal_hashes_are_told_apart(monkeypatch):
    encoder = tokens.Encoder(tokenizer_path())
    texts = ["alpha", "gamma", "alpha", "gammas", "alphas"]
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(tokens.K, "hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    assert [encoded(encoder, t)[0] for t in texts] == want
    assert encoded(encoder, *texts) == want
