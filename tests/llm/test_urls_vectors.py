"""The Bloom cascade against the rules themselves, the grid join against all pairs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from crawlscope.llm import grid_join, url_filter
from crawlscope.llm.queries import URL_RULES

URLS = [
    "https://example.com/en/1", "HTTP://WWW.Example.COM/en/", "http://www.example.com/EN/", "ftp://a.net/es/x?y#z", "https://net/fr/", "https://b.net/fr",
    "https://x.org/en/", "no scheme", "", None, "://", "https://", "https://example.com", "https://example.com?/en/", "https://example.com#/en/", "https://notexample.com/en/",
    "https://a.b.example.com/en/q://r", "https://example.com:80/en/", "https://Ünet/es/", "x://y.net/es/1", "x://y.net/es/1",
]


def stated(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        raw = re.match(r"[^/?#]*", rest)[0]
        host, path = re.sub("[A-Z]", lambda m: m[0].lower(), raw), re.match(r"[^?#]*", rest[len(raw) :])[0]
    fits = [(len(h + p), h + p, action) for h, p, action in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, "allow"
    best = max(fits)
    return host, path, best[1], "block" if (best[1], "block") in {(r[1], r[2]) for r in fits} else best[2]


def judged(spark, urls, rules, **options):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("x")).withColumn("keys", F.lit(1))
    frame = spark.createDataFrame(rules, "host string, path string, action string")
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, frame, **options).collect()}


@pytest.mark.parametrize("most_bits", [url_filter.MOST_BITS, 0])
def test_rules_of_the_query(spark, most_bits):
    assert judged(spark, URLS, URL_RULES, most_bits=most_bits) == {i: stated(u, URL_RULES) for i, u in enumerate(URLS)}


def test_many_rules_exactly(spark):
    rng = random.Random(8)
    host = lambda: ".".join(rng.choice(["a", "b", "c", "com", "net", "org", "x1"]) for _ in range(rng.randint(1, 4)))
    path = lambda: "/" + "".join(rng.choice("pq/") for _ in range(rng.randint(0, 4)))
    rules = [(host(), path(), rng.choice(["allow", "block"])) for _ in range(300)] + [("com", "", "block")]
    urls = [f"http://{host()}{path()}{path()}" for _ in range(2_000)]
    assert judged(spark, urls, rules) == {i: stated(u, rules) for i, u in enumerate(urls)}


def test_a_long_list_in_parts(spark, monkeypatch):
    divisions = []
    whole = url_filter._judge_parts
    monkeypatch.setattr(url_filter, "_judge_parts", lambda *a: (divisions.append(a[5] if len(a) > 5 else 0), whole(*a)))
    rng = random.Random(12)
    # Many hosts, and one host with many rules of its own, whose part has to be divided by path.
    rules = [(f"h{i}.com", "", rng.choice(["allow", "block"])) for i in range(120)]
    rules += [("hot.org", f"/p{i:03d}", rng.choice(["allow", "block", "block"])) for i in range(300)] + [("com", "", "block")]
    urls = [f"https://{rng.choice(['', 'www.'])}h{rng.randrange(200)}.com/x{rng.randrange(9)}" for _ in range(500)]
    urls += [f"https://hot.org/p{i:03d}/{i % 3}" for i in range(350)] + ["https://hot.org/p001/1"] * 200 + URLS
    assert judged(spark, urls, rules, most_bits=1 << 10) == {i: stated(u, rules) for i, u in enumerate(urls)}
    assert 0 in divisions and 1 in divisions


def test_cascade_is_exact_on_its_universe(spark):
    keys = spark.range(30_000).select(F.concat(F.lit("k"), "id").alias("key"), (F.xxhash64("id") % 50 == 0).alias("listed"))
    cascade = url_filter.build_cascade(keys)
    assert len(cascade.levels) > 2
    assert keys.filter(cascade.holds(F.col("key")) != F.col("listed")).count() == 0
    assert url_filter.build_cascade(keys, most_bits=64) is None


def test_no_pages_or_rules(spark):
    assert judged(spark, [], URL_RULES) == {}
    assert judged(spark, URLS[:3], []) == {i: (*stated(u, [])[:2], None, "allow") for i, u in enumerate(URLS[:3])}


VECTORS = "vec_id long, embedding array<float>, label int"


def all_pairs(rows, least=0.98):
    good = []
    for i, (_, v, label) in enumerate(rows):
        if label is not None and v and None not in v and np.isfinite(v).all() and any(v):
            good.append((i, np.asarray(np.float32(v), np.float64), label))
    links = {i: set() for i in range(len(rows))}
    for i, a, x in good:
        for j, b, y in good:
            if i < j and x == y and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
                links[i].add(j)
                links[j].add(i)
    out, seen = [None] * len(rows), set()
    for i in links:
        if i in seen:
            continue
        todo, group = [i], {i}
        while todo:
            for k in links[todo.pop()] - group:
                group.add(k)
                todo.append(k)
        seen |= group
        ids = [rows[k][0] for k in group if rows[k][0] is not None]
        for k in group:
            low = min(ids) if ids else None
            out[k] = (rows[k][0], len(links[k]), low, rows[k][0] == low)
    return sorted(out, key=str)


def joined(frame):
    return sorted(map(tuple, grid_join.grid_join(frame).collect()), key=str)


def test_grid_join_equals_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(120, 24))
    rows = []
    for b in base:
        for scale in rng.choice([0.0, 0.02, 0.1, 0.2], rng.integers(1, 8)):
            rows.append((b + scale * rng.normal(size=24)).tolist())
    rows += [rows[0]] * 30
    rows = [(i, v, int(rng.integers(0, 2))) for i, v in enumerate(rows)]
    assert joined(spark.createDataFrame(rows, VECTORS)) == all_pairs(rows)


def test_large_block_counts(spark, monkeypatch):
    monkeypatch.setattr(grid_join, "BLOCK", 16)
    monkeypatch.setattr(grid_join, "LEAF", 4)
    rng = np.random.default_rng(4)
    rows = [(i, (np.eye(8)[i % 3] + 0.12 * rng.normal(size=8)).tolist(), 0) for i in range(600)]
    assert joined(spark.createDataFrame(rows, VECTORS)) == all_pairs(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [2.0, -0.0], 0), (3, [2.0, 0.0], 0), (4, [1.0, 0.0], 1), (5, [1.0, 0.0], None), (6, None, 0), (7, [], 0),
        (8, [0.0, 0.0], 0), (9, [1.0, nan], 0), (10, [inf, 1.0], 0), (11, [1.0, None], 0), (12, [1.0, 0.0, 0.0], 0), (13, [1e-30, 0.0], 0), (14, [-1.0, 0.0], 0),
        (None, [0.0, 5.0], 0), (15, [0.0, 6.0], 0),
    ]
    extra = spark.createDataFrame(rows, VECTORS).withColumn("dim", F.lit(1)).withColumn("raw", F.lit(2)).withColumn("kept", F.lit(3))
    # Row 3 comes twice: its rows have the same smallest id, so both are marked as in the list of pairs.
    assert joined(extra) == all_pairs(rows)
    assert grid_join.grid_join(spark.createDataFrame([], VECTORS)).count() == 0
