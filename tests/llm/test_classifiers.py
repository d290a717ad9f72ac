"""Toxicity, quality and language on held-out labels and on constructed texts."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from crawlscope.llm import kernels as K
from crawlscope.llm import language, quality, toxicity
from crawlscope.llm.common import table

FOLDER = "/root/testdata/sf0.01"


def accuracy(frame, labels, truth, guess):
    rows = frame.join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert held and len(held) < len(rows)
    return sum(r[truth] == r[guess] for r in held) / len(held)


def test_toxicity_on_held_out_labels(spark):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    judged = toxicity.judge(docs, labels).cache()
    assert judged.count() == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in judged.collect())
    assert accuracy(judged, labels, "toxic", "predicted") > 0.9
    clean = toxicity.clean(docs, labels)
    assert clean.columns == docs.columns and clean.count() == judged.filter("predicted = 0").count()


def test_held_out_labels_do_not_matter(spark):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    flipped = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    one, two = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert one.weights == two.weights


def test_swapped_terms_get_no_weight_of_their_own():
    rng = np.random.default_rng(0)
    rows = []
    for i in range(800):
        toxic = int(i % 2)
        words = {f"w{k}" for k in rng.integers(0, 50, 8)}
        if rng.random() < (0.8 if toxic else 0.1):
            words.add("muslim")  # named far more often in toxic texts
        if toxic:
            words.add("scoundrel" if rng.random() < 0.7 else "w1")
        rows.append((sorted(words), toxic))
    free = toxicity.fit_words(rows, toxicity.swaps(), penalty=0.0)
    held = toxicity.fit_words(rows, toxicity.swaps(), penalty=50.0)
    gap = lambda m: abs(m.score({"w2", "muslim"}) - m.score({"w2", "jewish"}))
    assert gap(free) > 0.05 and gap(held) < 0.1 * gap(free)
    assert held.score({"w2", "muslim"}) < 0.5 < held.score({"w2", "scoundrel"})


def test_counterfactual_pairs_act_on_the_given_labels(spark):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    free, held = (toxicity.fit(docs, labels, penalty=p) for p in (0.0, 50.0))
    assert held.pairs == free.pairs > 200
    rows = docs.join(labels, "doc_id").where("toxic IS NOT NULL").select("doc_id", "text", "toxic").collect()
    rows = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    right = lambda m: sum((m.score(toxicity.word_set(r["text"] or "")) >= 0.5) == r["toxic"] for r in rows)
    assert right(held) >= right(free)
    neutral = [toxicity.word_set(s) for r in rows if r["toxic"] == 0 for s in toxicity.SENTENCE.findall(r["text"] or "")[:2]][:50]
    gap = lambda m: np.mean([abs(m.score(n | {a}) - m.score(n | {b})) for n in neutral for a, b in toxicity.swaps().items()])
    assert 0 < gap(held) < 0.5 * gap(free)


def test_counterfactuals_are_made_in_sentences():
    groups = {"faith": ["muslim", "jewish"], "alone": ["x"]}
    swap = toxicity.swaps(groups)
    assert swap == {"muslim": "jewish", "jewish": "muslim", "x": "x"}
    made = toxicity.counterfactuals("A muslim came. Nothing here! Jewish and muslim people", swap, ["muslim", "jewish"])
    # The last sentence holds both terms and does not change; the other changes though the text has both.
    assert made == [toxicity.difference({"a", "muslim", "came"}, {"a", "jewish", "came"})]
    put_in = toxicity.counterfactuals("Nothing here!", swap, ["muslim"])
    assert put_in == [toxicity.difference({"nothing", "here", "muslim"}, {"nothing", "here", "jewish"})]
    for text in ("", "...", "\n\n", "1 2 3"):
        assert toxicity.counterfactuals(text, swap, ["muslim"]) == []
    assert toxicity.counterfactuals("Nothing here!", {}, []) == []
    many = ". ".join(f"muslim w{'abcdefgh'[i]}" for i in range(8))
    assert len(toxicity.counterfactuals(many, swap, ["muslim"])) == toxicity.PAIRS


def test_words_passed_over_do_not_change_scores():
    model = toxicity.Model({"idiot": 2.0, "idi-": 0.5, "muslim": -0.25}, -1.0)
    for words in ({"idiot"}, {"idiots", "muslim"}, {"idiot", "idiots"}, set(), {"z" * 1000}, {"id", "idi", "é"}):
        z = -1.0 + sum(sorted(model.weights[w] for w in model.weights.keys() & toxicity.features(words)))
        assert model.score(words) == model.score(words) == pytest.approx(1 / (1 + np.exp(-z)))


def test_quality_on_held_out_labels(spark):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    judged = quality.judge(docs, labels).cache()
    assert judged.count() == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in judged.collect())
    assert accuracy(judged, labels, "quality", "predicted") > 0.95


def test_marginals_equal_the_sum_over_all_label_chains():
    rng = np.random.default_rng(2)
    cut = np.array([0, 1, 4, 4 + 5])
    score, stay = rng.normal(size=9), np.array([0.7, -0.3])
    p_good, both = quality.Chains(cut).marginals(score, stay, pairs=True)
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        n, total, good, pair = b - a, 0.0, np.zeros(b - a), np.zeros((b - a, 2))
        for code in range(1 << n):
            y = np.array([code >> i & 1 for i in range(n)])
            w = np.exp((score[a:b] * y).sum() + sum(stay[y[i]] for i in range(1, n) if y[i] == y[i - 1]))
            total += w
            good += w * y
            for i in range(1, n):
                if y[i] == y[i - 1]:
                    pair[i, y[i]] += w
        assert np.allclose(p_good[a:b], good / total)
        assert np.allclose(both[a:b][1:], pair[1:] / total)


def test_lines_cover_the_texts():
    texts = ["", "a", "a\n", "\n\n", "x\ny\n\nz", "é\n"]
    data, bounds = K.utf8(pa.array(texts))
    starts, ends, cut = quality.lines(data, bounds)
    raw = data.tobytes()
    for i, text in enumerate(texts):
        assert [raw[a:b].decode() for a, b in zip(starts[cut[i] : cut[i + 1]], ends[cut[i] : cut[i + 1]], strict=True)] == text.split("\n")


def test_language_on_held_out_rows(spark):
    docs = table(spark, FOLDER, "documents")
    found = language.identify(docs).cache()
    assert found.count() == docs.count()
    assert accuracy(found, docs.select("doc_id", "lang"), "lang", "lang_pred") > 0.97


@pytest.mark.parametrize("name", ["odd_docs", "clashing"])
def test_odd_rows(spark, request, name):
    docs = request.getfixturevalue(name)
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, 1), (4, 0, 0), (5, None, None), (None, 1, 1), (6, 0, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
    for rows in (toxicity.judge(docs, labels), quality.judge(docs, labels)):
        rows = rows.collect()
        assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    by_id = {r["doc_id"]: r for r in language.identify(docs).collect()}
    assert {i: by_id[i]["lang_pred"] for i in (1, 2, 7)} == {1: "und", 2: "und", 7: "und"}
    assert all(0 <= r["score"] <= 1 for r in by_id.values())


def test_without_labels_or_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.judge(odd_docs, none).collect()} == {0.0}
    assert {r["score"] for r in quality.judge(odd_docs, none).collect()} == {0.5}
    assert toxicity.clean(odd_docs, none).count() == odd_docs.count()
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.judge(no_docs, labels).count() == quality.judge(no_docs, labels).count() == language.identify(no_docs).count() == 0
    from pyspark.sql import functions as F

    unknown = language.identify(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in unknown} == {("und", 0.0)}
